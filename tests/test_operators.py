"""Operators on small literal inputs: golden values, order of rows, gates, empty tables."""

import itertools

import pytest
from pyspark.sql import functions as F

from gleaner.functions import classify as C
from gleaner.functions import text as T
from gleaner.operators import documents as D
from gleaner.operators import history as H
from gleaner.operators import manifests as M
from gleaner.operators import markdown as MD
from gleaner.operators import pages as P
from gleaner.operators import removals as R
from gleaner.operators import traction as K
from gleaner.operators.match import candidates, signals
from gleaner.plans.rules import Near, Rule, gate, near, near_pattern, rules
from gleaner.queries import fixtures as X
from gleaner.sources import saved


def test_gates_lose_no_hits(spark):
    table = [r for r in rules() if r.group not in ("telemetry", "control")]
    lines = X.SIGNAL_LINES.df(spark).withColumnRenamed("line", "n").unionByName(X.PRICING.df(spark).select(F.col("page").alias("file"), F.col("line").alias("n"), "text"))
    rows = lambda gated: sorted(map(tuple, signals(lines, table, F.col("text"), ["file", "n"], gated=gated).select("file", "n", "rule_id").collect()))
    assert rows(True) == rows(False) and rows(True)


def test_gate_words():
    assert gate(r"\bAKIA[0-9A-Z]{16}\b") == ("akia",)
    assert gate(r"(?i)foo|b[ar]z") == ("foo", "baz", "brz") and gate(r"\d+|x") == ()
    assert set(gate(r"(listen|bind)\w*\(")) == {"listen", "bind"}


def test_word_tree_finds_every_word_of_a_gate(spark):
    import random

    words = [k for r in rules() for k in r.keywords]
    rng = random.Random(1)
    texts = ["".join(rng.choice(words)[: rng.randint(1, 12)] + rng.choice(["", " ", "x"]) for _ in range(rng.randint(0, 12))) for _ in range(200)] + ["", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", candidates(rules(), F.col("t")).alias("c")).collect()
    for r in got:
        assert r["c"] == (None if r["t"] is None else [i for i, x in enumerate(rules()) if any(k in r["t"].lower() for k in x.keywords)])


def _example(parsed, rng, fold):
    """Some string that the parsed pattern matches."""
    out = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out.append(chr(arg))
        elif name == "IN":
            kind, x = arg[0] if str(arg[0][0]) == "NEGATE" else rng.choice(arg)
            out.append("x" if str(kind) == "NEGATE" else chr(x) if str(kind) == "LITERAL" else chr(rng.randint(*x)) if str(kind) == "RANGE" else {"CATEGORY_DIGIT": "7", "CATEGORY_SPACE": rng.choice(" \t"), "CATEGORY_WORD": rng.choice("aZ_3")}[str(x)])
        elif name == "ANY":
            out.append("?")
        elif name == "SUBPATTERN":
            out.append(_example(arg[-1], rng, fold))
        elif name == "BRANCH":
            out.append(_example(rng.choice(arg[1]), rng, fold))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += [_example(arg[2], rng, fold) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2)))]
        else:
            assert name == "AT", name
    text = "".join(out)
    return "".join(rng.choice((c.lower(), c.upper())) if c.isascii() else c for c in text) if fold else text


def test_words_with_their_surroundings_lose_no_hits(spark):
    import random
    import re._parser as parser

    rng, table = random.Random(2), [r for r in rules() if r.group != "superlative"]
    rows = []
    for i, r in enumerate(table):
        p = parser.parse(r.pattern, 0)
        rows += [(i, before + _example(p, rng, r.pattern.startswith("(?i)")) + behind) for before, behind in (("", ""), ("a\n", "\nb"), ("\n ", " "), ("(", ")"), ("é", "ü"), ("-", ".")) for _ in range(8)]
    df = spark.createDataFrame(rows, "i int, t string")
    one = lambda r: F.exists(F.split("t", "\n", -1), lambda x: x.rlike(r.pattern))
    hit = F.coalesce(*[F.when(F.col("i") == i, one(r)) for i, r in enumerate(table)])
    own = F.coalesce(*[F.when(F.col("i") == i, F.lower("t").rlike(near_pattern([r]))) for i, r in enumerate(table)])
    got = df.select("i", "t", hit.alias("hit"), own.alias("own"), F.lower("t").rlike(near_pattern(table)).alias("any")).where("hit").collect()
    assert [x for x in got if not (x["own"] and x["any"])] == []
    assert {x["i"] for x in got} == set(range(len(table)))


def test_words_elsewhere_in_prose_are_no_candidates(spark):
    table = [r for r in rules() if r.group not in ("superlative", "email")]
    prose = [("Football im Quartier, ein Tier; gratis testen: the latest budget in US$, for + only\nforget the seated",), ("7 seats",), ("a\nGet it",), ("forget it",), ("x == 'pro'",), ("tier",), ("",), (None,)]
    got = spark.createDataFrame(prose, "t string").select(F.lower("t").rlike(near_pattern(table)).alias("x")).collect()
    assert [r["x"] for r in got] == [False, True, True, False, True, False, False, None]
    assert near_pattern([*table, Rule("x.00", "x", "x", r"\d+")]) == ""


def test_words_with_surroundings():
    assert near(r"\b\d[\d,.]*\s?(?:GB|seats?)\b") == (Near(r"[,\.\d\s]", "gb", r"\b"), Near(r"[,\.\d\s]", "seat", r"\b"), Near(r"[,\.\d\s]", "seats", r"\b"))
    assert near(r"(?i)^(get|try)\b") == (Near("^", "get", r"\b"), Near("^", "try", r"\b"))
    assert near(r"(?:a*b?)+live$") == (Near("", "live", ""),) and near(r"[^x]live.") == (Near("", "live", ""),)
    assert near(r"\d+|xyz") == () and near(r"\p{L}live") == ()


def test_lines_over_the_limit_are_passed_over(spark):
    line = "posthog.init(key) "
    df = spark.createDataFrame([("a", line), ("b", line + "x" * 2000), ("c", "short\n" + line), ("d", None), ("e", "")], "f string, t string")
    got = signals(df, rules("telemetry"), F.col("t"), ["f"]).select("f", "line").distinct().collect()
    assert sorted(map(tuple, got)) == [("a", 1), ("c", 2)]


def test_html_text_and_title(spark):
    html = "<title>A &amp; B</title><style>x</style><p>Pro</p><script>1</script><b>$49</b> a&nbsp;month<br>"
    row = spark.createDataFrame([(html,)], "h string").select(T.html_to_text(F.col("h")).alias("t"), T.html_title(F.col("h")).alias("n")).head()
    assert row["t"] == "Pro\n$49 a\u00a0month" and row["n"] == "A & B"


def test_price_range_of_two_currencies(spark):
    text = ["Free $0", "Pro $12", "Team $1,234.50 a year", "€4,99", "No price"]
    df = spark.createDataFrame([("p", t) for t in text], "page string, text string")
    got = {r["currency"]: (r["min_amount"], r["max_amount"], r["amounts"]) for r in P.price_range(df, "page").collect()}
    assert got == {"USD": (0.0, 1234.5, 3), "EUR": (4.99, 4.99, 1)}


@pytest.mark.parametrize("counts", [[], [5], [1, 1, 1, 1], [8, 4, 4], [3, 3, 3, 1], [10, 1, 1, 1, 1, 1, 1]])
def test_bus_factor(spark, counts):
    want, run = 0, 0
    for i, n in enumerate(sorted(counts, reverse=True), 1):
        run += n
        if 2 * run >= sum(counts):
            want = i
            break
    df = spark.createDataFrame(list(enumerate(counts)), "k long, n long")
    assert H.bus_factor(df, "k", "n").head()[0] == want


def test_running_copies_of_closed_windows(spark):
    rows = [("v1", "2024-01-01 00:00:00", "latest.yml", 29800), ("v2", "2024-01-22 00:00:00", "latest.yml", 77100), ("v3", "2024-02-26 00:00:00", "latest.yml", 10)]
    df = spark.createDataFrame(rows, "tag string, published_at string, name string, downloads long").withColumn("published_at", F.col("published_at").cast("timestamp"))
    row = K.running_copies(K.release_windows(K.classified(df), F.lit("2024-03-01").cast("timestamp")), 4.0).head()
    assert round(row["checks_per_day"], 1) == 1908.9 and row["copies"] == 318


def test_sample_pages():
    assert K.sample_pages(41, 5) == [1, 11, 21, 31, 41]
    assert K.sample_pages(0, 5) == [] and K.sample_pages(7, 1) == [1]


def test_best_split_against_every_split(spark):
    cases = [(100, [10, 35, 60, 80], 45), (50, [], 60), (90, [30, 60], 30), (90, [40], 45), (70, [5, 10, 40], 35), (12, [3, 6, 9], 5)]
    for total, cuts, limit in cases:
        found = []
        for k in range(len(cuts) + 1):
            for some in itertools.combinations(cuts, k):
                ends = [*some, total]
                sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
                if max(sizes) <= limit:
                    found.append((len(sizes), max(sizes), ends))
        text = "".join(("## " if i in cuts else "x") + "y" * (n - a - (4 if i in cuts else 2)) + "\n" for i, (a, n) in ((a, (a, n)) for a, n in zip([0, *cuts], [*cuts, total], strict=True))) if all(b - a > 4 for a, b in zip([0, *cuts], [*cuts, total], strict=True)) else None
        points = spark.createDataFrame([([0, *cuts, total],)], "p array<long>")
        best, walk = D.best_ends("p", limit)
        row = points.withColumn("_best", F.expr(best)).select(F.expr(f"if(_best[0].parts >= {D.NO_WAY}, null, {walk})").alias("e")).head()
        assert row["e"] == (min(found)[2] if found else None)
        if text:
            got = D.split_documents(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t", limit).orderBy("part").collect()
            assert [r["start"] + r["chars"] for r in got] == (min(found)[2] if found else [total])


def test_cut_points_need_closed_blocks(spark):
    texts = ["## A\n```\n## no\n", "x\n## A\n### B\n", "x\r\n<table>\n## no\n</table>\n## A\u2028## B\r## C", "a\n<callout x\n## no\n", "```\n<table>\n```\n## A", "", None, "</table>\n## A\n```a\n```\n  <table a>\n ## no\n</table>\n## B"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r["k"]: (r["chars"], list(r["cuts"]) if r["balanced"] else None) for r in D.cut_points(df, ["k"], "t").collect()}
    assert got == {0: (15, None), 1: (13, [2, 7]), 2: (len(texts[2]), [texts[2].index("## A"), texts[2].index("## B"), texts[2].index("## C")]), 3: (19, None), 4: (20, [16]), 5: (0, []), 6: (0, []), 7: (len(texts[7]), [9, texts[7].index("## B")])}
    again = spark.createDataFrame([(1, "ab"), (1, "ab"), (None, "ab"), (2, None)], "k int, t string")
    assert sorted(map(tuple, D.split_documents(again, "k", "t", 5).collect()), key=str) == sorted([(1, 0, 0, 2, None), (1, 0, 0, 2, None), (None, 0, 0, 2, None), (2, 0, 0, 0, None)], key=str)


def _converted(text, **style):
    return MD.convert_markdown(text, MD.Style(**{"contents": False} | style))


def test_markdown_blocks():
    text = "# Title\n#### Deep\n- a\n    - b\n      more\n- c\n\ntext\n  loose\n|no|table\n\n| x | y |\n|---|---|\n| 1 | `a|b` |\n> one\n>\n> two\n---\n```\n<raw>\n| 1 |\n```\n```py\n# no title\n```\n1 < 2\n\n\n\nend"
    want = "### Deep\n- a\n\t- b\n\t\tmore\n- c\n\ntext\n  loose\n\\|no\\|table\n\n<table header-row=\"true\">\n\t<tr>\n\t\t<td>x</td>\n\t\t<td>y</td>\n\t</tr>\n\t<tr>\n\t\t<td>1</td>\n\t\t<td>`a|b`</td>\n\t</tr>\n</table>\n> one<br>two\n---\n```text\n<raw>\n| 1 |\n```\n```py\n# no title\n```\n1 \\< 2\n\nend\n"
    assert _converted(text) == (want, [])
    assert _converted("")[0] == "\n" and _converted("a", contents=True)[0] == "<table_of_contents/>\n\na\n"
    assert _converted("# T\n# U\n##### V", drop_first_title=False, deepest_heading=2)[0] == "# T\n# U\n## V\n"


def test_markdown_text_within_lines():
    inline = MD.inline
    assert inline("$29 for <you> in `co$de` and src/index.ts:12-14, not @setup.sh") == "\\$29 for \\<you\\> in `co$de` and `src/index.ts:12-14`, not @setup.sh"
    assert inline("x \\* y \\$ [a^b](https://x.y/c.md) [plain] \U00100000") == "x \\* y \\$ [a\\^b](https://x.y/c.md) \\[plain\\] \U00100000"


def test_markdown_mentions():
    style = MD.Style(pages={"01": "a-a", "A": "bbb"}, files={"Z": "none.md", "A": "more/code.md"}, references=((r"\bdocument (0[1-9])\b", 1, None), (r"\bpart (\d+)", 1, {"7": "ddd"})), literals=(("the old one", "ccc"),), mention_url="https://n/{id}")
    to = lambda x: f'<mention-page url="https://n/{x}"/>'
    got = MD.inline("See document 01, document 02, part 7, `more/code.md`, `code.md`, `none.md` and [the old one](https://x.y)", style)
    assert got == f"See document {to('aa')}, document 02, part {to('ddd')}, {to('bbb')}, {to('bbb')}, `none.md` and [{to('ccc')}](https://x.y)"


def test_markdown_callouts_and_warnings(spark):
    style = MD.Style(callout_markers=("Note",), contents=False)
    df = spark.createDataFrame([(1, "> **Note.** Read\n> this.\n\n| A |\n|---|\n| **bold** + more |\n"), (2, None)], "id long, t string")
    got = {r["id"]: (r["converted"], [tuple(w) for w in r["warnings"]]) for r in MD.convert_documents(df, "id", "t", style).collect()}
    assert got[1][0].startswith('<callout icon="📌" color="gray_bg">\n\t**Note.** Read\n\tthis.\n</callout>\n\n<table') and got[1][1] == [(6, "**bold** + more")]
    assert got[2] == ("\n", [])


def test_saved_comparisons_listings_and_pages(spark, tmp_path):
    (tmp_path / "changes").write_text("D\ta/x.py\nR090\told/a b.md\tnew/a b.md\nM\tc\nA\td\nC075\te\tf\n")
    (tmp_path / "list").write_bytes("a/x.py\0b\nc.md\0ü.txt\0".encode())
    got = saved.tree_changes(spark, str(tmp_path / "changes")).collect()
    assert sorted(map(tuple, got), key=str) == [("D", "a/x.py", None), ("M", "c", "c"), ("R", "old/a b.md", "new/a b.md")]
    assert sorted(r[0] for r in saved.listing(spark, str(tmp_path / "list")).collect()) == ["a/x.py", "b\nc.md", "ü.txt"]
    pages = [("https://h/r?page=1", "[1, 2]"), ("https://h/r?page=2", "[3]"), ("https://h/r?page=2", "[3]"), ("https://h/r?page=3", "[4]"), ("https://h/s", "[9]"), ("https://h/t", "no list"), ("https://h/u", None)]
    got = saved.paged(spark.createDataFrame(pages, "url string, body string"), size=2).select("page", "item").collect()
    assert sorted(map(tuple, got)) == [(1, "1"), (1, "2"), (1, "9"), (2, "3")]


def test_license_titles_win_over_phrases(spark):
    texts = [("Mozilla Public License 2.0\nGNU Affero General Public License", "MPL-2.0"), ("MIT\nPermission is hereby granted, free of charge", "MIT"), ("Released under the MIT License.", "Unrecognized"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("", "Unrecognized")]
    got = spark.createDataFrame(texts, "t string, w string").select(C.license_family(F.col("t")).alias("f"), "w").collect()
    assert all(r["f"] == r["w"] for r in got)


def test_call_arguments_keep_inner_parentheses(spark):
    texts = [".package(a(b)c) .package(d)", "none", ".package(never ends", ".package(x((y)(z)))) tail"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(M.call_arguments(F.col("t"), ".package")).collect()]
    assert got == [["a(b)c", "d"], [], ["never ends"], ["x((y)(z))"]]


def test_python_projects(spark):
    text = "[project]\nname = 'x'\nclassifiers = [\n 'no',\n]\ndependencies = [ 'a>=1', \"b[c]==2 ; x\",\n  'd', # 'no'\n]\n[dependency-groups]\nDocs = ['e']\nweb = [\n 'f~=1',\n 'g']\n[tool.poetry.group.web.dependencies]\nh = '1'\ni = { git = \"" + "y" * 80 + "\" }\n[tool.other]\nj = ['k']\n"
    rows = M.pyproject(spark.createDataFrame([("pyproject.toml", text), ("x/pyproject.toml", None), ("y/pyproject.toml", "")], "manifest string, content string")).collect()
    got = {(r["name"], r["declared"], r["kind"]) for r in rows}
    assert got == {("a", ">=1", "prod"), ("b", "==2", "prod"), ("d", "*", "prod"), ("e", "*", "dev"), ("f", "~=1", "optional"), ("g", "*", "optional"), ("h", "'1'", "dev"), ("i", ('{ git = "' + "y" * 80)[:60], "dev")}


def test_broken_documents_have_no_rows(spark):
    files = spark.createDataFrame([("Package.resolved", "{"), ("sbom.json", "[1"), ("project.yml", "packages:\n  A:\n"), ("Package.swift", None), ("a/project.pbxproj", "")], "manifest string, content string")
    assert M.parsed_files(files).count() == 0 and M.pnpm_rows(files).count() == 0


def test_results_do_not_depend_on_row_order(spark):
    df = X.COMMITS.df(spark)
    a = sorted(map(tuple, H.merged_identities(df).collect()))
    b = sorted(map(tuple, H.merged_identities(df.orderBy(F.desc("sha"))).collect()))
    assert a == b


def test_empty_tables(spark):
    assert R.outermost_gone(X.TREE_OLD.df(spark).limit(0), X.TREE_NEW.df(spark)).count() == 0
    assert P.price_range(X.PRICING.df(spark).limit(0), "page").count() == 0
    assert H.release_gaps(X.TAGS.df(spark).limit(0)).head()["version_tags"] == 0


def test_weekly_stream_equals_batch(spark, tmp_path):
    from gleaner.streaming.weeks import read_events, weekly_counts

    rows = [(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-07 23:59:59", "a"), (3, "2024-01-08 00:00:00", "b")]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), "event_type", F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    df.write.parquet(str(tmp_path / "in"))
    query = weekly_counts(read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = sorted((str(r["week_start"])[:10], r["event_type"], r["events"]) for r in spark.table("weeks").collect())
    assert got == [("2024-01-01", "a", 2), ("2024-01-08", "b", 1)]


def test_tree_reader(spark, tmp_path):
    from gleaner.sources import saved

    for name, data in (("src/a.py", b"x = 1\n"), ("node_modules/b.js", b"no"), ("bin.dat", b"\0\1")):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)
    rows = saved.tree(spark, str(tmp_path))
    assert sorted(r["rel_path"] for r in rows.collect()) == ["bin.dat", "src/a.py"]
    assert [tuple(r) for r in saved.texts(rows).collect()] == [("src/a.py", "x = 1\n")]
