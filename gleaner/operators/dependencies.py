"""Declared and resolved components: line parsers, lock lookups, roll-up, upstream answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.numbers import python_name


def with_table(lines: DataFrame, unit: str) -> DataFrame:
    """TOML lines with the last [table] header above them and the number of that header; comments cut.

    One file's lines are one window; rows stream through it.
    """
    cut = F.when(F.ltrim("text").startswith("#"), "").otherwise(F.rtrim(F.substring_index("text", " #", 1)))
    header = F.nullif(F.trim(F.regexp_extract("body", r"^\s*\[\[?([^\]]+)\]\]?\s*$", 1)), F.lit(""))
    w = Window.partitionBy(unit).orderBy("line")
    return lines.withColumn("body", cut).withColumn("h", header).withColumns({"table": F.coalesce(F.last("h", ignorenulls=True).over(w), F.lit("")), "block": F.count("h").over(w)}).where("h IS NULL AND trim(body) <> ''").drop("h")


_KINDS = {"dependencies": "prod", "dev-dependencies": "dev", "build-dependencies": "build"}


def cargo_rows(lines: DataFrame) -> DataFrame:
    rows = with_table(lines.where(F.substring_index("manifest", "/", -1) == "Cargo.toml"), "manifest")
    section = F.regexp_extract("table", r"(?:^|\.)(dependencies|dev-dependencies|build-dependencies)$", 1)
    line = r"^\s*([A-Za-z0-9_-]+)(\.workspace)?\s*=\s*(.+)$"
    value = F.trim(F.regexp_extract("body", line, 3))
    version = F.nullif(F.regexp_extract(value, r'version\s*=\s*"([^"]+)"', 1), F.lit(""))
    inline = F.coalesce(version, F.when(value.contains("path"), "path").when(value.contains("git"), "git").otherwise(F.substring(value, 1, 60)))
    workspace = (F.regexp_extract("body", line, 2) != "") | value.contains("workspace = true")
    declared = F.when(workspace, "workspace").when(value.startswith("{"), inline).otherwise(F.regexp_replace(value, "^[\"']+|[\"']+$", ""))
    kind = F.element_at(F.create_map(*[F.lit(x) for p in _KINDS.items() for x in p]), F.col("section"))
    return rows.withColumn("section", section).where("section <> ''").where(F.col("body").rlike(line)).select("manifest", F.lit("crates").alias("ecosystem"), F.regexp_extract("body", line, 1).alias("name"), declared.alias("declared"), kind.alias("kind"), F.lit(None).cast("string").alias("resolved"))


# Fixed value: a requirement: name, extras, the rest.
REQUIREMENT = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)(\[[^\]]*\])?\s*(.*)$"


def requirement_rows(lines: DataFrame) -> DataFrame:
    name = F.substring_index("manifest", "/", -1)
    rows = lines.where(name.rlike(r"(?i)^requirements[\w.-]*\.txt$")).withColumn("body", F.trim(F.substring_index("text", "#", 1)))
    rows = rows.where("body <> ''").where(~F.col("body").rlike(r"^(-|git\+|http:|https:|file:|\.)")).where(F.col("body").rlike(REQUIREMENT))
    declared = F.trim(F.substring_index(F.regexp_extract("body", REQUIREMENT, 3), ";", 1))
    kind = F.when(name.rlike("(?i)dev|test|lint|doc"), "dev").otherwise("prod")
    return rows.select("manifest", F.lit("pypi").alias("ecosystem"), F.regexp_extract("body", REQUIREMENT, 1).alias("name"), F.when(declared == "", "*").otherwise(declared).alias("declared"), kind.alias("kind"), F.lit(None).cast("string").alias("resolved"))


def go_rows(lines: DataFrame) -> DataFrame:
    rows = lines.where(F.substring_index("manifest", "/", -1) == "go.mod").withColumn("body", F.trim(F.regexp_replace("text", r"^\s+", "")))
    turn = F.when(F.col("body").startswith("require ("), 1).when(F.col("body") == ")", 0)
    inside = F.coalesce(F.last(turn, ignorenulls=True).over(Window.partitionBy("manifest").orderBy("line")), F.lit(0))
    line = r"^(?:require\s+)?(\S+)\s+(v\S+)(\s*//\s*indirect)?"
    rows = rows.withColumn("inside", inside).where(F.col("body").rlike(line) & ((F.col("inside") == 1) | F.col("body").startswith("require ")) & ~F.col("body").startswith("require ("))
    v = F.regexp_extract("body", line, 2)
    return rows.select("manifest", F.lit("go").alias("ecosystem"), F.regexp_extract("body", line, 1).alias("name"), v.alias("declared"), F.when(F.regexp_extract("body", line, 3) != "", "indirect").otherwise("prod").alias("kind"), v.alias("resolved"))


def pod_rows(lines: DataFrame) -> DataFrame:
    line = r"^  - ([^\s(]+) \(([^)]+)\)"
    rows = lines.where(F.substring_index("manifest", "/", -1) == "Podfile.lock").where(F.col("text").rlike(line))
    v = F.regexp_extract("text", line, 2)
    return rows.select("manifest", F.lit("cocoapods").alias("ecosystem"), F.regexp_extract("text", line, 1).alias("name"), v.alias("declared"), F.lit("prod").alias("kind"), v.alias("resolved"))


def package_json_rows(files: DataFrame) -> DataFrame:
    """String specs of the four sections; a file that is no JSON gives no rows."""
    sections = (("dependencies", "prod"), ("optionalDependencies", "optional"), ("peerDependencies", "peer"), ("devDependencies", "dev"))
    parsed = files.select("manifest", F.from_json("content", ", ".join(f"{s} map<string, string>" for s, _ in sections)).alias("j"))

    def entries(section: str, kind: str):
        own = F.map_entries(F.coalesce(F.col("j")[section], F.from_json(F.lit("{}"), "map<string, string>")))
        return F.transform(own, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("declared"), F.lit(kind).alias("kind")))

    each = [entries(s, k) for s, k in sections]
    rows = parsed.select("manifest", F.explode(F.concat(*each)).alias("e")).where(~F.col("e.declared").rlike(r"^[\[{]"))
    return rows.select("manifest", F.lit("npm").alias("ecosystem"), "e.name", "e.declared", "e.kind", F.lit(None).cast("string").alias("resolved"))


def lock_packages(lines: DataFrame) -> DataFrame:
    """(lockfile, name, version, ord) of [[package]] blocks."""
    rows = with_table(lines, "lockfile").where("table = 'package'")
    field = r'^\s*(name|version)\s*=\s*"([^"]+)"'
    rows = rows.where(F.col("body").rlike(field)).select("lockfile", "block", "line", F.regexp_extract("body", field, 1).alias("f"), F.regexp_extract("body", field, 2).alias("v"))
    pick = lambda f: F.min_by(F.when(F.col("f") == f, F.col("v")), F.when(F.col("f") == f, F.col("line")))
    return rows.groupBy("lockfile", "block").agg(pick("name").alias("name"), pick("version").alias("version")).where("name IS NOT NULL AND version IS NOT NULL").withColumnRenamed("block", "ord")


def yarn_specs(lines: DataFrame) -> DataFrame:
    """(lockfile, name, declared, version): every spec of an entry, split at its last @."""
    w = Window.partitionBy("lockfile").orderBy("line")
    head = F.col("text").rlike(r"^[^\s#].*:\s*$")
    version = F.nullif(F.regexp_extract("text", r'^\s+version:?\s+"?([^"\s]+)"?', 1), F.lit(""))
    rows = lines.withColumns({"specs": F.last(F.when(head, F.regexp_replace("text", r":\s*$", "")), ignorenulls=True).over(w), "version": version}).where("version IS NOT NULL AND specs IS NOT NULL")
    rows = rows.select("lockfile", "version", F.explode(F.transform(F.split("specs", ","), lambda x: F.regexp_replace(F.trim(x), '^"+|"+$', ""))).alias("spec"))
    rows = rows.where(F.col("spec").rlike("^.+@"))
    return rows.select("lockfile", F.regexp_extract("spec", "^(.+)@[^@]*$", 1).alias("name"), F.regexp_replace(F.substring_index("spec", "@", -1), "^npm:", "").alias("declared"), "version")


def package_lock_rows(files: DataFrame) -> DataFrame:
    """(lockfile, importer, name, version) of packages that belong to a workspace, not to another package."""
    parsed = files.select("lockfile", F.from_json("content", "packages map<string, struct<version: string>>").alias("j"))
    rows = parsed.select("lockfile", F.explode("j.packages").alias("path", "info")).where("info.version IS NOT NULL").where(F.col("path").contains("node_modules/"))
    rows = rows.withColumn("importer", F.regexp_replace(F.expr("left(path, length(path) - length(substring_index(path, 'node_modules/', -1)) - 13)"), "/+$", ""))
    return rows.where(~F.col("importer").contains("node_modules")).select("lockfile", "importer", F.substring_index("path", "node_modules/", -1).alias("name"), F.col("info.version").alias("version"))


def ancestors(folder) -> F.col:
    """The folder itself and all above it, with their depth; the root is ''."""
    parts = F.when(folder == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(folder, "/"))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("folder")))


def nearest_lock(rows: DataFrame, locks: DataFrame) -> DataFrame:
    """Rows (folder, ecosystem) with the closest folder at or above them that holds a lock of that ecosystem; null for none.

    An equi-join over the folders' ancestors. Folders are made distinct first, so a large folder is one row in it.
    """
    wanted = rows.select("folder", "ecosystem").distinct().select("folder", "ecosystem", F.explode(ancestors(F.col("folder"))).alias("a")).select("folder", "ecosystem", F.col("a.depth").alias("depth"), F.col("a.folder").alias("lock_folder"))
    best = wanted.join(locks.distinct(), ["ecosystem", "lock_folder"]).groupBy("folder", "ecosystem").agg(F.max_by("lock_folder", "depth").alias("lock_folder"))
    return rows.join(best, ["folder", "ecosystem"], "left")


def npm_resolution(needs: DataFrame, importers: DataFrame, specs: DataFrame) -> DataFrame:
    """needs (importer, name, declared): the importer's version, else the exact spec's, else the root's, else the only one."""
    own = importers.select("importer", "name", F.col("version").alias("v1"))
    exact = specs.select("name", "declared", F.col("version").alias("v2"))
    root = importers.where("importer = ''").select("name", F.col("version").alias("v3"))
    only = specs.groupBy("name").agg(F.countDistinct("version").alias("n"), F.min("version").alias("v4")).where("n = 1").drop("n")
    out = needs.join(own, ["importer", "name"], "left").join(exact, ["name", "declared"], "left").join(root, "name", "left").join(only, "name", "left")
    return out.select("importer", "name", "declared", F.coalesce("v1", "v2", "v3", "v4").alias("resolved"))


def crate_versions(packages: DataFrame) -> DataFrame:
    return packages.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("version")), ", ").alias("resolved"))


def python_versions(packages: DataFrame) -> DataFrame:
    return packages.groupBy(python_name(F.col("name")).alias("name")).agg(F.min_by("version", F.struct("lockfile", "ord")).alias("resolved"))


def roll_up(rows: DataFrame) -> DataFrame:
    """One row per component: first-seen distinct kinds, declared and resolved, manifests, first manifest, first source.

    Rows go by manifest, then kind and declared. A component's distinct values are few; they are sets before they meet.
    """
    at = F.struct("manifest", "kind", "declared")
    seen = lambda c: F.transform(F.array_sort(F.collect_list("f_" + c)), lambda x: x["v"])
    first = None
    for c in ("kind", "declared", "resolved"):
        part = rows.where(F.coalesce(F.col(c), F.lit("")) != "").groupBy("ecosystem", "name", F.col(c).alias("v")).agg(F.min(at).alias("at")).select("ecosystem", "name", F.struct("at", "v").alias("f_" + c)).groupBy("ecosystem", "name").agg(F.array_join(seen(c), "|").alias(c + "s"))
        first = part if first is None else first.join(part, ["ecosystem", "name"], "full")
    base = rows.groupBy("ecosystem", "name").agg(F.count("*").alias("manifests"), F.min("manifest").alias("example_manifest"), F.min_by("source", F.when(F.col("source").isNotNull(), at)).alias("source"))
    return base.join(first, ["ecosystem", "name"], "left").na.fill("", ["kinds", "declareds", "resolveds"])


def latest_version(answers: DataFrame) -> DataFrame:
    """(ecosystem, name, latest) of saved registry answers."""
    g = lambda p: F.get_json_object("body", p)
    eco = F.col("ecosystem")
    latest = (
        F.when(eco == "npm", F.coalesce(g("$.latest"), g("$['dist-tags'].latest")))
        .when(eco == "pypi", g("$.info.version"))
        .when(eco == "crates", F.coalesce(g("$.crate.max_stable_version"), g("$.crate.newest_version")))
        .when(eco == "go", g("$.Version"))
        .when(eco == "maven", g("$.response.docs[0].latestVersion"))
        .when(eco == "swift", F.regexp_replace(g("$.tag_name"), "^v+", ""))
    )
    return answers.select("ecosystem", "name", latest.alias("latest"))


def stable_since(dates: DataFrame, shipped: str, latest: str) -> DataFrame:
    """Days from the shipped version to the latest, and stable releases after it up to the latest."""
    ends = dates.agg(F.min(F.when(F.col("version") == shipped, F.col("published"))).alias("a"), F.min(F.when(F.col("version") == latest, F.col("published"))).alias("b"))
    rows = dates.join(F.broadcast(ends))
    stable = ~F.col("version").rlike("[-+][A-Za-z]") & (F.col("published") > F.col("a")) & (F.col("published") <= F.col("b"))
    return rows.agg(F.floor((F.unix_micros(F.max("b").cast("timestamp")) - F.unix_micros(F.max("a").cast("timestamp"))) / F.lit(86_400_000_000)).cast("long").alias("days_between"), F.count_if(stable).alias("stable_releases_since"))


