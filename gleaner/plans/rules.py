"""Line rules from the fixed tables (S20), each with a gate of substrings that any match must contain."""

from __future__ import annotations

import re
import re._constants as C
import re._parser as parser
from dataclasses import dataclass, replace

from gleaner.plans import signatures as S


@dataclass(frozen=True)
class Rule:
    rule_id: str
    group: str
    label: str
    pattern: str
    strength: str = "strong"
    keywords: tuple[str, ...] = ()
    area: str = ""
    path_pattern: str = ""
    max_line: int = 0
    scan: str = ""


#: Signs that may stand alone as a gate.
_SIGNS = frozenset("$€£#%+@")


def gate(pattern: str) -> tuple[str, ...]:
    """Lower-case substrings of which every match holds one; empty if the pattern tells none."""
    found = _gate(parser.parse(pattern, 0))
    return tuple(dict.fromkeys(found)) if found else ()


def _plain(code: int) -> bool:
    """Characters that lower() leaves as any engine would."""
    return code < 128 or chr(code).lower() == chr(code).upper()


def _choices(op, arg) -> list[str] | None:
    """The strings of a literal or of a small class of characters."""
    if op is C.LITERAL and _plain(arg):
        return [chr(arg).lower()]
    if op is C.IN and len(arg) <= 8 and all(o is C.LITERAL and _plain(x) for o, x in arg):
        return list(dict.fromkeys(chr(x).lower() for _, x in arg))
    return None


def _gate(parsed) -> list[str] | None:
    best: list[str] | None = None
    runs = [""]

    def weight(words: list[str]) -> int:
        return min(1 if w in _SIGNS else 0 if len(w) < 2 or w.isspace() else len(w) for w in words)

    def offer(words: list[str] | None) -> None:
        nonlocal best
        if words and weight(words) and (best is None or weight(words) > weight(best)):
            best = words

    for op, arg in parsed:
        if (more := _choices(op, arg)) and len(runs) * len(more) <= 16:
            runs = [r + m for r in runs for m in more]
            continue
        offer(runs)
        runs = [""]
        if op is C.SUBPATTERN:
            offer(_gate(arg[-1]))
        elif op is C.BRANCH:
            each = [_gate(b) for b in arg[1]]
            offer([w for e in each for w in e] if all(each) else None)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            offer(_gate(arg[2]))
        elif more:
            runs = more
    offer(runs)
    return best


def words_pattern(words) -> str:
    """A pattern that finds, at every place of a text, the longest of these words that starts there (group 1)."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def branches(node: dict) -> str:
        arms = [re.escape(c) + rest(sub) for c, sub in sorted(node.items()) if c]
        if len(arms) > 8:
            # A guard of first characters in front of each few arms.
            firsts = sorted(c for c in node if c)
            arms = ["(?=[" + "".join(map(re.escape, firsts[i : i + 5])) + "])(?:" + "|".join(arms[i : i + 5]) + ")" for i in range(0, len(arms), 5)]
        return "|".join(arms)

    def rest(node: dict) -> str:
        if set(node) == {""}:
            return ""
        arms = branches(node)
        return f"(?:{arms})?" if "" in node else f"(?:{arms})"

    return f"(?=({branches(tree)}))"


#: Fixed value: characters by how often prose in four languages has them, roughly; other signs and digits are rarer.
_COMMON = " enatirsoldhuc.,mpgbf-w'!y:vkqzxj"


@dataclass(frozen=True)
class Near:
    """A lower-case word that every match holds, with what may stand directly before and behind it (patterns without a length, or of one character; empty: anything)."""

    before: str
    word: str
    behind: str


def _rarity(c: str) -> int:
    return 2 if c == " " else 12 if not c.isalnum() else 6 if c.isdigit() or c in "bwyvkxzjq" else 4


def _characters(op, arg) -> str | None:
    """What goes into a class for one element of one character, in lower case; None if that is not told."""
    if op is C.LITERAL:
        return re.escape(chr(arg).lower()) if _plain(arg) else None
    if op is C.RANGE:
        lo, hi = arg
        if hi > 127:
            return None
        return "".join(re.escape(c) for c in sorted({chr(x).lower() for x in range(lo, hi + 1)}))
    if op is C.CATEGORY:
        return {C.CATEGORY_DIGIT: r"\d", C.CATEGORY_SPACE: r"\s", C.CATEGORY_WORD: r"\w"}.get(arg)
    if op is C.IN:
        parts = [_characters(*x) for x in arg]
        return None if None in parts else "".join(parts)
    return None


def _edge(parsed: list, outer: frozenset | None, last: bool) -> frozenset | None:
    """What the first (last) character of these elements may be, as classes, \\b and ^; outer, where they may be empty. None: anything."""
    items = list(parsed)
    if not items:
        return outer
    op, arg = items[-1 if last else 0]
    rest = items[:-1] if last else items[1:]
    if op is C.AT:
        return {C.AT_BOUNDARY: frozenset([r"\b"]), C.AT_BEGINNING: frozenset(["^"])}.get(arg)
    if op is C.SUBPATTERN:
        return _edge(arg[-1], _edge(rest, outer, last), last)
    if op is C.BRANCH:
        each = [_edge(b, _edge(rest, outer, last), last) for b in arg[1]]
        return None if None in each else frozenset().union(*each)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        beyond = _edge(rest, outer, last)
        inner = _edge(arg[2], beyond, last)
        if arg[0]:
            return inner
        return None if inner is None or beyond is None else inner | beyond
    found = _characters(op, arg)
    return None if found is None else frozenset([f"[{found}]"])


def near(pattern: str) -> tuple[Near, ...]:
    """Words of which every match holds one, each with its surroundings: the rarest that the pattern tells; empty if it tells none."""
    try:
        found = _near(list(parser.parse(pattern, 0)), None, None)
    except re.error:  # written for the other engine only
        return ()
    return tuple(dict.fromkeys(found)) if found else ()


def _weight(words: list[Near]) -> int:
    return min(sum(map(_rarity, w.word)) + 2 * bool(w.before) + 2 * bool(w.behind) for w in words)


def _near(parsed: list, before: frozenset | None, behind: frozenset | None) -> list[Near] | None:
    best: list[Near] | None = None
    runs, start = [""], 0

    def text(edge: frozenset | None) -> str:
        """One class for all characters, beside \\b and ^."""
        classes = sorted(dict.fromkeys(x for e in edge or () if len(e) > 2 for x in re.findall(r"\\.|[^\\]", e[1:-1])))
        return "|".join([*(["[" + "".join(classes) + "]"] if classes else []), *sorted(e for e in edge or () if len(e) <= 2)])

    def offer(words: list[Near] | None) -> None:
        nonlocal best
        if words and _weight(words) >= 8 and (best is None or _weight(words) > _weight(best)):
            best = words

    def close(end: int) -> None:
        b, a = text(_edge(parsed[:start], before, True)), text(_edge(parsed[end:], behind, False))
        offer([Near(b, r, a) for r in runs] if all(runs) else None)

    for i, (op, arg) in enumerate(parsed):
        more = _choices(op, arg)
        if not more and op is C.MAX_REPEAT and arg[:2] == (0, 1) and len(arg[2]) == 1 and (once := _choices(*arg[2][0])):
            more = ["", *once]
        if more and len(runs) * len(more) <= 16:
            runs = [r + m for r in runs for m in more]
            continue
        close(i)
        # A new run begins behind this element, or with it if there were too many choices.
        runs, start = (more, i) if more else ([""], i + 1)
        b, a = _edge(parsed[:i], before, True), _edge(parsed[i + 1 :], behind, False)
        if op is C.SUBPATTERN:
            offer(_near(list(arg[-1]), b, a))
        elif op is C.BRANCH:
            each = [_near(list(x), b, a) for x in arg[1]]
            offer([w for e in each for w in e] if all(each) else None)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            inside = arg[:2] == (1, 1)
            offer(_near(list(arg[2]), b if inside else None, a if inside else None))
    close(len(parsed))
    return best


def near_pattern(rules: list[Rule]) -> str:
    """A pattern that lower-case texts hold if a rule may fire in them; empty if a rule tells no word.

    It looks for a rare character of each word first, then at what follows, and last at what stands before: most places
    of a text are passed over after a look at one character.
    """
    words: dict[Near, None] = {}
    for r in rules:
        own, plain = near(r.pattern), tuple(Near("", k, "") for k in r.keywords)
        own = own if own and (not plain or _weight(own) >= _weight(plain)) else plain
        if not own:
            return ""
        words |= dict.fromkeys(own)
    trees: dict[str, dict] = {}
    rank = lambda c: _COMMON.find(c) % 99
    # Words of common characters only come first; the characters that they need are taken for others too.
    for w in sorted(words, key=lambda w: max(map(rank, w.word))):
        k = max(range(len(w.word)), key=lambda i: (w.word[i] in trees, rank(w.word[i]), -i))
        at = trees.setdefault(w.word[k], {})
        for c in w.word[k + 1 :]:
            at = at.setdefault(c, {})
        ahead = f"(?={w.behind})" if w.behind else ""
        behind = f"(?<=(?:{w.before}){re.escape(w.word)})" if w.before else f"(?<={re.escape(w.word)})" if k else ""
        at.setdefault("", []).append(ahead + behind)

    def guarded(found: list[tuple[str, str]]) -> list[str]:
        """Arms by their first character; many are split into three, each behind a guard of first characters."""
        if len(found) <= 8:
            return [arm for _, arm in found]
        third = -(-len(found) // 3)
        parts = [found[i : i + third] for i in range(0, len(found), third)]
        return ["(?=[" + "".join(re.escape(c) for c, _ in x) + "])(?:" + "|".join(guarded(x)) + ")" for x in parts]

    def arms(node: dict) -> str:
        return "|".join([*guarded([(c, re.escape(c) + rest(sub)) for c, sub in sorted(node.items()) if c]), *dict.fromkeys(node.get("", []))])

    def rest(node: dict) -> str:
        return "" if "" in node.get("", []) else f"(?:{arms(node)})"

    return "(?m)(?=[" + "".join(map(re.escape, sorted(trees))) + f"])(?:{arms(trees)})" if trees else ""


def _rule(group: str, n: int, label: str, pattern: str, **more) -> Rule:
    return Rule(f"{group}.{n:02d}", group, label, pattern, **({"keywords": gate(pattern)} | more))


#: The same matches without looking ahead, so that both engines take the pattern.
PORTABLE = {
    S.PAGE_RULES["free"]: S.PAGE_RULES["free"].replace(r"(?![\d.,])", r"(?:[^\d.,]|$)"),
    S.OFFERS[0][0]: S.OFFERS[0][0].replace("(?=", "(?:"),
}

#: The lines of the same pattern, found in time that grows with a line's length: of places from which a match could
#: begin only the first of a run is tried, as any later one lies in what the first goes over. Only Spark takes these.
LINEAR = {
    PORTABLE[S.OFFERS[0][0]]: PORTABLE[S.OFFERS[0][0]].replace("https?://", r"""(?<![^\s"'`)<>])(?>[^\s"'`)<>]*?https?://)"""),
    S.HARDENING[14][2]: S.HARDENING[14][2].replace(r"\baltool\b.*", r"(?s:^(?>.*?\baltool\b).*)"),
    S.HARDENING[22][2]: S.HARDENING[22][2].replace(r"(listen|bind|serve|run)\w*\(.*", r"(?s:^(?>.*?(?<!\w)(?>\w*?(listen|bind|serve|run))\w*\().*)"),
}

# Fixed value: wording that claims too much.
SUPERLATIVES = r"(?:(?:the|our|its|their) (?:first|only)|first[- ]ever|best|fastest|cheapest|leading|#\s?1|number one|guaranteed?|always|never|100\s?%|unbeatable|unmatched|world'?s|most (?:advanced|powerful|secure)|zero (?:risk|bugs))"
SUPERLATIVE_LINE = r"(?i)(?:^|[^\p{L}\p{N}_])" + SUPERLATIVES + r"(?:[^\p{L}\p{N}_]|$)"


#: Lines longer than this are passed over where the limit is asked for, by group; other groups read lines of any length.
LINE_LIMIT = {"telemetry": 2000, "control": 2000, "billing": 2000, "license_gate": 2000, "plan_gate": 2000, "offer": 2000, "lead_capture": 2000, "scan_secret": 3000, "hardening": 3000}


def rules(*groups: str, limited: bool = True) -> list[Rule]:
    """All rules of these groups (all groups without a name), in their fixed order; limited=False: for lines of any length."""
    out: list[Rule] = []
    out += [_rule("scan_secret", i, n, p) for i, (n, p) in enumerate(S.SCAN_SECRETS)]
    out += [_rule("safety_secret", i, n, p) for i, (n, p) in enumerate(S.SAFETY_SECRETS)]
    out += [_rule("hardening", i, n, p, area=a, path_pattern=r"(^|/)(electron-builder(\.[\w-]+)?\.(ya?ml|json|js|cjs|mjs|ts|toml)|package\.json)$" if n == "update signature check setting" else "") for i, (a, n, p) in enumerate(S.HARDENING)]
    bare = re.compile(r"[a-z0-9-]+(\\\.[a-z0-9-]+)+")
    n = 0
    for name, _, patterns, _, keywords in S.TELEMETRY:
        for p in patterns:
            out.append(Rule(f"telemetry.{n:02d}", "telemetry", name, "(?i)" + p, "mention" if bare.fullmatch(p) else "usage", tuple(k.lower() for k in keywords)))
            n += 1
    out += [_rule("control", i, p, "(?i)" + p, keywords=tuple(k.lower() for k in S.CONTROL_KEYWORDS)) for i, p in enumerate(S.CONTROLS)]
    n = 0
    for name, patterns in S.BILLING:
        for p in patterns:
            out.append(_rule("billing", n, name, p))
            n += 1
    for group, table in (("license_gate", S.LICENSE_GATES), ("plan_gate", S.PLAN_GATES), ("offer", S.OFFERS), ("lead_capture", S.LEAD_CAPTURE)):
        out += [_rule(group, i, group, PORTABLE.get(p, p), strength=s) for i, (p, s) in enumerate(table)]
    out += [_rule("page", i, k, PORTABLE.get(p, p), max_line=60 if k == "ctas" else 0) for i, (k, p) in enumerate(S.PAGE_RULES.items())]
    out.append(Rule("superlative.00", "superlative", "superlative", SUPERLATIVE_LINE, keywords=gate("(?i)" + SUPERLATIVES)))
    out.append(_rule("email", 0, "email address", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", keywords=("@",)))
    if limited:
        out = [replace(r, max_line=LINE_LIMIT.get(r.group, 0)) if not r.max_line else r for r in out]
    else:
        out = [replace(r, scan=LINEAR.get(r.pattern, "")) for r in out]
    return [r for r in out if not groups or r.group in groups]
