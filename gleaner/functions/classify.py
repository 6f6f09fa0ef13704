"""Classifiers of paths, names and texts, as ordered conditions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.plans import signatures as S

# Which paths are tests, generated, examples, forbidden or license files.
TEST_FOLDER = r"(^|/)(__tests__|__test__|tests?|testing|spec|specs|e2e|integration[-_]tests?|androidTest|test[-_]?fixtures|fixtures|testdata|test_data|mocks?|__mocks__|[A-Za-z0-9]+Tests|[A-Za-z0-9]+UITests)(/|$)"
TEST_NAME = r"([._-](test|tests|spec|e2e|stories)\.[a-z0-9]+$)|(_test\.(go|py|rs|rb|exs|dart)$)|(^test_.*\.py$)|(Tests?\.(swift|kt|java|cs)$)|(_spec\.rb$)"
GENERATED_NAME = r"(\.pb\.[a-z]+$)|(_pb2(_grpc)?\.py$)|(\.generated\.[a-z]+$)|(\.g\.dart$)|(\.min\.(js|css)$)|(\.bundle\.js$)|(_generated\.[a-z]+$)|(\.designer\.cs$)"
GENERATED_MARK = r"(?i)(@generated|auto-?generated|do not edit|code generated by|generated by .{0,40}do not modify)"
LICENSE_NAME = r"(?i)^(licen[cs]e|copying|notice|licensing|patents|unlicense)([._-].*)?$"
FORBIDDEN_FILE = r"(?i)(^|/)(\.env(?!\.example$|\.sample$|\.template$)[^/]*|[^/]*\.(pem|key|p12|pfx|keystore|jks)|id_(rsa|ecdsa|ed25519)[^/]*|[^/]*service[-_]?account[^/]*\.json)$"
FORBIDDEN_TO_PUBLISH = r"(?i)(?:^|/)(?:\.env(?!\.example$)[^/]*|[^/]*\.(?:pem|key|p12|pfx)|id_(?:rsa|ecdsa|ed25519)[^/]*|[^/]*service[-_]?account[^/]*\.json)$"
EXAMPLE_FOLDER = r"(?i)(^|/)(examples?|samples?|demos?)(/|$)"
VERSION_TAG = r"^(?:[A-Za-z][\w.-]*[-_/])?v?\d+(?:\.\d+)+(?:[-+.][0-9A-Za-z.-]+)?$"
FIX_SUBJECT = r"(?i)^(?:\w+\()?(?:fix|fixes|fixed|bugfix|hotfix)\b|^\w+(?:\([^)]*\))?!?:\s*fix\b|\bfix(?:es|ed)?\b|\bbug\b"
DOC_FOLDERS = ("docs", "doc", "documentation")
DOC_SUFFIXES = (".md", ".mdx", ".markdown", ".rst", ".adoc")
SCAN_DOC_SUFFIXES = (".md", ".mdx", ".rst", ".txt", ".adoc")
TELEMETRY_SUFFIXES = (".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".mts", ".cts", ".py", ".go", ".rs", ".java", ".kt", ".kts", ".swift", ".m", ".mm", ".c", ".cc", ".cpp", ".h", ".hpp", ".cs", ".rb", ".php", ".dart", ".vue", ".svelte", ".astro", ".html", ".json", ".yml", ".yaml", ".toml", ".plist", ".xml", ".gradle", ".properties", ".env.example", ".sh", ".ps1", ".lua", ".ex", ".exs")
CODE_SUFFIXES = (".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".mts", ".cts", ".py", ".go", ".rs", ".java", ".kt", ".kts", ".swift", ".m", ".mm", ".cs", ".rb", ".php", ".dart", ".vue", ".svelte", ".astro", ".html", ".json", ".yml", ".yaml", ".toml", ".plist", ".xml", ".gradle", ".properties", ".sh", ".ps1", ".ex", ".exs", ".env")
SECURITY_SUFFIXES = (".js", ".mjs", ".cjs", ".ts", ".tsx", ".json", ".yml", ".yaml", ".pbxproj", ".plist", ".xml", ".toml", ".conf", ".rs", ".go", ".py", ".rb", ".php", ".swift", ".kt", ".java", ".html", ".config")
MANIFESTS = ("go.mod", "Gemfile", "Podfile", "Package.swift", "requirements.txt", "Pipfile", "Dockerfile")
SCAN_LOCKFILES = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "Cargo.lock", "Gemfile.lock", "poetry.lock", "go.sum", "composer.lock", "Podfile.lock", "Package.resolved", "uv.lock", "Pipfile.lock", "flake.lock")
SECURITY_LOCKFILES = ("package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "yarn.lock", "Cargo.lock", "poetry.lock", "uv.lock", "Package.resolved", "Podfile.lock", "go.sum")

# Patterns and names of the predicates below.
DOC_NAMES = "^(README|CHANGELOG|CHANGES|HISTORY|RELEASES)"
TELEMETRY_NAMES = ("package.json", "podfile", "gemfile", "cargo.toml", "go.mod")
TELEMETRY_LOCKFILES = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock")
BUILT_FILE = r"(\.min\.js|\.map)$"
SECURITY_NAMES = ("AndroidManifest.xml", "Info.plist")
LOOSE_LICENSES = ("source-available", "source available", "license key")
COPYRIGHT = r"(?i)copyright\s*(\(c\)|©|\d{4})"
SPDX_HEADER = r"(?m)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+\-() ]+?)[ \t]*(?:\*/|-->|#|$)"
SECRET_PREFIX = r"^(gh[pousr]_|github_pat_|AKIA|AIza|xox[abprs]-|(sk|rk)_live_|sk-(proj-)?)"
PLACEHOLDER = r"(?i)example|redact|dummy|fake|placeholder|xxxx|0000|your[_-]?key"
PLACEHOLDER_KEY = "(?i)example|dummy|fake|test"
NO_REPLY = r"(?i)^(?:\d+\+)?([^@]+)@users\.noreply\.github\.com$"
ALLOWED_EMAIL = r"(?i)(?:@example\.(?:com|org|net)|@users\.noreply\.github\.com|^noreply@github\.com)$"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """The last dot and what follows, lower case; empty for none, or a name that only starts with a dot."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]*[^.])$", 1))


def folders(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def top_folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("(root)")


def area(path: Column, depth: int = 1) -> Column:
    """The first depth folders; (root) for paths with no more parts than that."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > depth, F.array_join(F.slice(parts, 1, depth), "/")).otherwise("(root)")


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_FOLDER) | file_name(path).rlike(TEST_NAME)


def in_any(parts: Column, names) -> Column:
    return F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))


def is_skipped(path: Column, keep: tuple[str, ...] = ()) -> Column:
    """Below a folder of dependencies or output, at any depth."""
    return in_any(folders(path), [n for n in S.SKIP_DIRS if n not in keep])


def is_vendored(path: Column) -> Column:
    """Below a vendored folder and no other skipped one."""
    return in_any(folders(path), S.VENDORED_DIRS) & ~is_skipped(path, tuple(S.VENDORED_DIRS))


def language(path: Column) -> Column:
    """Language of the suffix; null for others."""
    pairs = [F.lit(x) for pair in S.LANGUAGES.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), suffix(path))


def source_kind(path: Column, text: Column) -> Column:
    """generated before test before source."""
    return F.when(file_name(path).rlike(GENERATED_NAME) | F.substring(text, 1, 800).rlike(GENERATED_MARK), "generated").when(is_test_path(path), "test").otherwise("source")


def removed_kind(path: Column, is_folder: bool = False) -> Column:
    parts = F.split(path, "/") if is_folder else folders(path)
    tests = path.rlike(TEST_FOLDER) if is_folder else is_test_path(path)
    docs = in_any(parts, DOC_FOLDERS) if is_folder else in_any(parts, DOC_FOLDERS) | suffix(path).isin(*DOC_SUFFIXES)
    return F.when(in_any(parts, S.SKIP_DIRS), "dependencies_or_build").when(tests, "tests").when(docs, "docs").otherwise("source_and_other")


def doc_priority(path: Column) -> Column:
    return F.when(F.upper(file_name(path)).rlike(DOC_NAMES), 0).when(in_any(folders(path), DOC_FOLDERS), 1).otherwise(2)


def telemetry_eligible(path: Column, include_tests: bool = False, include_docs: bool = False) -> Column:
    name = F.lower(file_name(path))
    kinds = suffix(path).isin(*TELEMETRY_SUFFIXES, *(SCAN_DOC_SUFFIXES if include_docs else ())) | name.isin(*TELEMETRY_NAMES)
    out = kinds & ~name.rlike(BUILT_FILE) & ~name.isin(*TELEMETRY_LOCKFILES)
    return out if include_tests else out & ~is_test_path(path)


def code_eligible(path: Column, include_tests: bool = False, include_docs: bool = False) -> Column:
    """'scan', 'test' (counted apart) or '' for a file."""
    name, ext = file_name(path), suffix(path)
    never = name.isin(*SCAN_LOCKFILES) | name.rlike(BUILT_FILE)
    doc = ext.isin(*SCAN_DOC_SUFFIXES)
    code = ext.isin(*CODE_SUFFIXES) | name.isin(*MANIFESTS) | name.startswith(".env")
    return F.when(never, "").when(doc & F.lit(not include_docs), "").when(~doc & ~code, "").when(is_test_path(path) & F.lit(not include_tests), "test").otherwise("scan")


def security_eligible(path: Column, include_tests: bool = False) -> Column:
    name = file_name(path)
    out = ~is_skipped(path, ("build", "release", "releases")) & ~name.isin(*SECURITY_LOCKFILES) & (suffix(path).isin(*SECURITY_SUFFIXES) | name.isin(*SECURITY_NAMES))
    return out if include_tests else out & ~is_test_path(path) & ~path.rlike(EXAMPLE_FOLDER)


def platform(name: Column) -> Column:
    low, out = F.lower(name), None
    for ext, of in S.INSTALLERS.items():
        out = F.when(low.endswith(ext), of) if out is None else out.when(low.endswith(ext), of)
    for of, pattern in S.PLATFORM_HINTS:
        out = out.when(name.rlike(pattern), of)
    return out.otherwise("any")


# Shapes of release file names.
UPDATE_CHECK = r"(?i)(^latest[\w.-]*\.ya?ml$|^appcast[\w.-]*\.xml$|^releases$|^update[\w.-]*\.json$|^latest\.json$)"
UPDATE_DELTA = r"(?i)(\.blockmap$|\.delta$|-delta\.nupkg$|\.patch$)"
CHECKSUM = r"(?i)(\.sha(1|256|512)(sum)?$|^sha(1|256|512)sums?(\.txt)?$|checksums?(\.txt)?$|\.sig$|\.asc$|\.minisig$|\.sbom|\.spdx|\.cdx\.json$|\.intoto\.jsonl$)"
PACKAGE = r"(?i)(\.whl$|\.nupkg$|\.gem$|\.crate$|\.jar$|\.vsix$|\.xpi$|\.crx$|^[\w.-]+-\d[\w.-]*\.tgz$)"
ARCHIVE = r"(?i)(\.zip$|\.tar\.gz$|\.tgz$|\.tar\.xz$|\.tar\.bz2$|\.tar\.zst$|\.7z$)"
VERSION_IN_NAME = r"(^|[-_.v])\d+\.\d+(\.\d+)?([-_.][0-9A-Za-z]+)*"


def asset_category(name: Column) -> Column:
    installer = F.lower(name).rlike("(" + "|".join(e.replace(".", r"\.") for e in S.INSTALLERS) + ")$")
    return (
        F.when(name.rlike(UPDATE_CHECK), "update-check")
        .when(name.rlike(UPDATE_DELTA), "update-delta")
        .when(name.rlike(CHECKSUM), "checksum-or-signature")
        .when(installer, "installer")
        .when(name.rlike(PACKAGE), "package")
        .when(name.rlike(ARCHIVE), F.when(platform(name) == "macos", "update-payload-or-archive").otherwise("archive"))
        .otherwise("other")
    )


def asset_platform(name: Column) -> Column:
    """latest.yml alone is the feed of one platform; others carry theirs in the name."""
    return F.when(F.lower(name) == "latest.yml", "windows").otherwise(platform(name))


def versioned_name(name: Column, tag: Column) -> Column:
    bare = F.regexp_replace(tag, "^v+", "")
    return name.rlike(VERSION_IN_NAME) | (F.coalesce(tag != "", F.lit(False)) & name.contains(bare))


def license_file_type(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.startswith("licensing"), "licensing note").when(low.startswith("notice"), "notice").when(low.startswith("patents"), "patents").otherwise("license")


def is_license_file(path: Column) -> Column:
    return file_name(path).rlike(LICENSE_NAME) & ~suffix(path).isin(*S.NOT_LICENSE_SUFFIXES)


#: Every phrase that names a license holds one of these, none of which has white space.
LICENSE_WORDS = ("licens", "commons", "polyform", "source", "permission", "as-is", "unencumbered", "cc0", "reserved")


def license_family(text: Column) -> Column:
    """Family by the title line first, else by phrases anywhere; the first of the ordered table wins."""
    # The first line that is not blank: after the last line end of the white space in front.
    first = F.regexp_extract(text, r"\A(?:\s*[\r\n])?([^\r\n]*)", 1)
    title = F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.trim(first), "^#+", ""))), "^the ", "")
    held = lambda raw: reduce(lambda a, b: a | b, [raw.contains(w) for w in LICENSE_WORDS])
    # As a variable of a lambda, a text is lowered and collapsed once, not once an arm; and only where no title tells and a word of a phrase is held.
    named = lambda raw: F.get(F.transform(F.array(F.regexp_replace(raw, r"\s+", " ")), _family), 0)
    of_text = lambda raw: F.when(held(raw), named(raw)).otherwise("Unrecognized")
    return F.coalesce(F.get(F.transform(F.array(title), _titled), 0), F.get(F.transform(F.array(F.lower(text)), of_text), 0))


def _titled(title: Column) -> Column:
    own = [(f, ps[0]) for f, _, ps in S.LICENSES if f not in ("Proprietary or custom", "BSD-2-Clause", "BSD-3-Clause")]
    return reduce(lambda out, x: out.when(title.startswith(x[1]), x[0]), own[1:], F.when(title.startswith(own[0][1]), own[0][0]))


def _family(low: Column) -> Column:
    out = None
    for family, _, phrases in S.LICENSES:
        cond = reduce(lambda a, b: a & b, [low.contains(p) for p in phrases])
        out = F.when(cond, family) if out is None else out.when(cond, family)
    loose = low.contains(LOOSE_LICENSES[0]) | low.contains(LOOSE_LICENSES[1]) | low.contains(LOOSE_LICENSES[2])
    return out.when(loose, "Proprietary or custom").otherwise("Unrecognized")


def gpl_version(text: Column, family: Column | None = None) -> Column:
    """The version that a text of the GPL names; family: that of the text, where it is known already."""
    named = lambda v: F.lower(text).rlike(rf"version\s+{v}")
    return F.when((license_family(text) if family is None else family) == "GPL", F.when(named(3), "3").when(named(2), "2"))


def copyright_line(text: Column) -> Column:
    head = F.slice(F.split(text, r"\r\n|\n|\r", 61), 1, 60)
    found = F.when(text.rlike("(?i)copyright"), F.get(F.filter(head, lambda x: x.rlike(COPYRIGHT)), 0))
    return F.substring(F.regexp_replace(F.trim(found), "<[^>]*@[^>]*>", "<email>"), 1, 160)


def spdx(text: Column) -> Column:
    """The first identifier in the first 4000 characters; empty without one."""
    return F.trim(F.regexp_extract(F.substring(text, 1, 4000), SPDX_HEADER, 1))


def is_placeholder(value: Column, line: Column) -> Column:
    """Documentation keys, redaction marks and test values."""
    core = F.regexp_replace(value, SECRET_PREFIX, "")
    few = F.size(F.array_distinct(F.split(core, ""))) <= 6
    words = F.concat_ws(" ", value, line).rlike(PLACEHOLDER)
    return F.when(value.contains("PRIVATE KEY"), line.rlike(PLACEHOLDER_KEY)).otherwise(few | words)


def author_key(name: Column, email: Column) -> Column:
    """Lower-cased e-mail; the handle of a no-reply address; the name without an e-mail."""
    e = F.lower(F.trim(email))
    return F.when(e.rlike(NO_REPLY), F.concat(F.lit("github:"), F.regexp_extract(e, NO_REPLY, 1))).when(e != "", e).otherwise(F.lower(F.trim(name)))


def is_bot(name: Column) -> Column:
    out = F.lit(False)
    for p in S.BOT_AUTHORS:
        out = out | name.rlike("(?i)" + p)
    return out


def allowed_email(address: Column) -> Column:
    return address.rlike(ALLOWED_EMAIL)
