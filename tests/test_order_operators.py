"""Running figures, states, phrases and intervals against plain versions: hot keys, ties, nulls, empty tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleaner.operators import phrases as P
from gleaner.operators import traction as R
from gleaner.operators.joins import interval_join, join_counted, latest_before
from gleaner.operators.running import in_order, running
from gleaner.operators.states import states_at, totals_between

T0 = datetime(2024, 1, 1)


def events(rng, n, users=4):
    """(key, at, id, v): key 1 has most rows, some keys, instants and values are null."""
    return [(rng.choice([1] * 8 + [None, *range(2, 2 + users)]), None if rng.random() < 0.05 else T0 + timedelta(minutes=rng.randrange(60)), i, None if rng.random() < 0.3 else rng.randrange(9)) for i in range(n)]


SHAPE = "key long, at timestamp, id long, v long"


@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_running_figures_over_parts(spark, parts):
    rng = random.Random(int(parts))
    rows = events(rng, 400)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, SHAPE).repartition(5)
        got = running(df, ["key"], ["at", "id"], sums={"n": F.lit(1), "s": F.coalesce("v", F.lit(0))}, last={"l": F.col("v")}, before={"b": F.col("v"), "ba": F.col("at")}).collect()
        every = running(df, [], [F.desc("id")], sums={"n": F.lit(1)}, before={"b": F.col("id")}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, held = {}, {}
    for k, at, i, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or T0, r[2])):
        n, s, last, before, ba = held.get(k, (0, 0, None, None, None))
        held[k] = n + 1, s + (v or 0), last if v is None else v, v, at
        want[i] = (n + 1, s + (v or 0), held[k][2], before, ba)
    assert {r["id"]: (r["n"], r["s"], r["l"], r["b"], r["ba"]) for r in got} == want
    assert {r["id"]: (r["n"], r["b"]) for r in every} == {i: (400 - i, i + 1 if i < 399 else None) for i in range(400)}


def test_running_spreads_rows_that_tie(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        laid = in_order(spark.range(0, 4000, 1, 8).selectExpr("1 as k", "2 as o"), ["k", "o"])
        assert max(r["count"] for r in laid.groupBy("_part").count().collect()) < 2000
        assert running(laid.select("k", "o"), ["k"], ["o"], sums={"n": F.lit(1)}).agg(F.count_distinct("n"), F.max("n")).head()[:] == (4000, 4000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    empty = spark.createDataFrame([], SHAPE)
    assert running(empty, ["key"], ["at"], sums={"n": F.lit(1)}).count() == 0


def test_milestones_and_weighted_median(spark):
    rows = [(1, T0 + timedelta(days=i), i, 0) for i in range(10)] + [(2, T0, 100 + i, 0) for i in range(4)] + [(2, None, 200, 0)]
    got = R.milestones(spark.createDataFrame(rows, SHAPE), ["key"], "at", "id", 4).orderBy("key", "n").collect()
    assert [(r["key"], r["n"], r["days"], r["per_day"]) for r in got] == [(1, 4, 3.0, 1.0), (1, 8, 4.0, 1.0), (2, 4, 0.0, None)]
    rates = spark.createDataFrame([(5.0, 1, 1), (1.0, 3, 2), (2.0, 2, 3), (None, 9, 4)], "rate double, w long, id long")
    assert R.weighted_median(rates.where("rate is not null"), "rate", "w", "id").head()[0] == 1.0
    assert R.weighted_median(rates.limit(0), "rate", "w", "id").head()[0] is None


def test_latest_before_equals_plain(spark):
    rng = random.Random(4)
    points, changes = events(rng, 150), events(rng, 200)
    changes += [(1, T0 + timedelta(minutes=30), 900 + i, i) for i in range(50)]
    got = latest_before(spark.createDataFrame(points, SHAPE), spark.createDataFrame(changes, "key long, at timestamp, id2 long, w long"), ["key"], "at", ["w"], "id2").collect()
    want = {}
    for k, at, i, _ in points:
        best = max(((a, j, w) for kk, a, j, w in changes if kk == k and a and at and a <= at), default=None)
        want[i] = (best[2], best[0]) if best else (None, None)
    assert {r["id"]: (r["w"], r["since"]) for r in got} == want and len(got) == len(points)


@pytest.mark.parametrize("hot", [2, 10_000])
def test_interval_join_equals_plain(spark, hot):
    rng = random.Random(hot)
    points = [(rng.choice([1, 1, 1, 2, None]), None if rng.random() < 0.1 else T0 + timedelta(seconds=rng.randrange(20000)), i) for i in range(200)]
    spans = [(rng.choice([1, 2]), a := T0 + timedelta(seconds=rng.randrange(20000)), a + timedelta(seconds=rng.choice([0, 1, 600, 30000])), i) for i in range(40)] + [(1, T0 + timedelta(9), T0, 99), (1, None, T0, 98)]
    p, s = spark.createDataFrame(points, "key long, at timestamp, id long"), spark.createDataFrame(spans, "key long, lo timestamp, hi timestamp, span long")
    got = interval_join(p, s, "at", "lo", "hi", keys=("key",), width=900_000_000, hot=hot)
    assert sorted((r["id"], r["span"]) for r in got.collect()) == sorted((i, j) for k, at, i in points for kk, lo, hi, j in spans if kk == k and at and lo and lo <= at < hi)
    free = interval_join(p, s.drop("key"), "at", "lo", "hi", width=900_000_000, hot=hot)
    assert free.count() == sum(1 for _, at, _ in points for _, lo, hi, _ in spans if at and lo and lo <= at < hi)
    assert interval_join(p.limit(0), s, "at", "lo", "hi", keys=("key",)).count() == 0


def test_states_and_totals(spark):
    rows = [(1, "2024-01-01", 1, "a"), (1, "2024-01-03", 2, "b"), (1, "2024-01-03", 3, "c"), (2, "2024-01-02", 1, "gone"), (3, "2024-01-09", 1, "a"), (4, "2024-01-01", 1, "a"), (4, "2024-01-04", 1, "gone"), (None, None, 1, "a")]
    df = spark.createDataFrame(rows, "k long, d string, id long, v string").withColumn("at", F.to_timestamp("d"))
    states = states_at(df, ["k"], "at", ["v"], "id", {"old": "2024-01-02", "new": "2024-01-09"})
    assert {r["k"]: (r["old"] and r["old"]["v"], r["new"] and r["new"]["v"]) for r in states.collect()} == {1: ("a", "c"), 2: ("gone", "gone"), 3: (None, "a"), 4: ("a", "gone"), None: (None, None)}
    assert totals_between(states, "old", "new", lambda s: s["v"] == "gone").head()[:] == (2, 2, 1, 1, 1)


@pytest.mark.parametrize("hot", [1, 10_000])
def test_phrases_equal_plain(spark, hot, monkeypatch):
    monkeypatch.setattr(P, "HOT", hot)
    rng = random.Random(hot)
    words = ["the", "the", "the", "a", "b", "c", "Été", "x1"]
    docs = [(i, " ".join(rng.choice(words) + rng.choice(["", ",", "\n"]) for _ in range(rng.randrange(30)))) for i in range(60)] + [(None, "the the a"), (7, None), (8, "the"), (9, "the " * 2000)]
    wanted = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))) for i in range(25)] + [(30, "nowhere the"), (31, ""), (32, None), (33, "the the"), (33, "THE, the")]

    def tokens(t):
        import re

        return re.findall(r"[^\W_]+", (t or "").lower())

    got = P.find_phrases(spark.createDataFrame(docs, "d long, text string"), spark.createDataFrame(wanted, "p long, phrase string"), "d", "text", "p", "phrase")
    want = []
    for d, t in set(docs):
        for p, w in {(p, tuple(tokens(x))) for p, x in wanted}:
            ts = tokens(t)
            n = sum(tuple(ts[i : i + len(w)]) == w for i in range(len(ts) - len(w) + 1)) if w else 0
            if n:
                want.append((d, p, n))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert P.find_phrases(spark.createDataFrame([], "d long, text string"), spark.createDataFrame(wanted, "p long, phrase string"), "d", "text", "p", "phrase").count() == 0


def test_join_counted_splits_the_heaviest(spark):
    rows = spark.range(3000).selectExpr("if(id < 1500, 0, id % 100 + 1) as key", "id as i")
    table = rows.groupBy("key").agg(F.count("*").alias("m"))
    out = join_counted(rows, table, "key", limit=2, most=5)
    assert out.count() == 3000 and "600" in out._jdf.queryExecution().optimizedPlan().toString()


def plain_reworded(rows, similarity, min_chars):
    import difflib

    out = []
    norm = lambda t: " ".join(t.split()).lower()
    for pair in {r[0] for r in rows}:
        side = lambda s: [(n, t.strip(), norm(t)) for p, x, n, t in sorted(rows, key=lambda r: (r[2], r[3] or "")) if p == pair and x == s and t and norm(t)]  # noqa: B023, E731
        old, new = side("old"), side("new")
        texts = {k: t for _, t, k in new}
        free = {k for k in texts if len(k) >= min_chars} - {k for _, _, k in old}
        done = set(texts)
        for n, t, k in old:
            if k in done or len(k) < min_chars:
                continue
            done.add(k)
            near = difflib.get_close_matches(k, free, n=1, cutoff=similarity)
            if near:
                free.remove(near[0])
            out.append((pair, n, "reworded" if near else "removed", t, texts[near[0]] if near else None, round(difflib.SequenceMatcher(None, k, near[0]).ratio(), 2) if near else None))
    return sorted(out, key=str)


def test_reworded_equals_plain(spark):
    from gleaner.operators.removals import reworded

    rng = random.Random(8)
    words = ["plan", "costs", "the", "dollars", "a", "month", "Support", "phone", "yes", "no", "Été"]
    rows = []
    for pair in ("p", "q", "r"):
        base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(14)]
        for i, t in enumerate(base):
            rows.append((pair, "old", i, t))
            for j in range(rng.choice([0, 1, 1, 2])):
                w = t.split()
                w[rng.randrange(len(w))] = rng.choice(words)
                rows.append((pair, "new", i * 3 + j, "  ".join(w)))
    rows += [("p", "old", 50, "aaaaaaaaaaaa bbbb"), ("p", "new", 50, "aaaaaaaaaaab bbbb"), ("p", "new", 51, "aaaaaaaaaaac bbbb"), ("p", "old", 51, "aaaaaaaaaaad bbbb"), ("p", "old", 52, None), ("p", "new", 53, "   "), ("s", "old", 1, "only on the old side"), ("t", "new", 1, "only on the new side")]
    got = reworded(spark.createDataFrame(rows, "pair string, side string, line int, text string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == plain_reworded(rows, 0.75, 12)
    assert reworded(spark.createDataFrame([], "pair string, side string, line int, text string")).count() == 0


def counted(spark, what):
    """The sum of one figure over all stages so far."""
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
    return sum(getattr(stages.apply(i), what)() for i in range(stages.size()))


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    return counted(spark, "shuffleWriteBytes")


def test_reworded_in_cells_and_on_little_disk(spark, monkeypatch):
    from gleaner.operators import removals

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(80)]
    rows = []
    for pair in ("p", "q"):
        for i in range(20):
            w = [rng.choice(words) for _ in range(rng.randint(3, 30))]
            rows.append((pair, "old", i, " ".join(w)))
            for j in range(rng.choice([0, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(words)
                rows.append((pair, "new", i * 5 + j, " ".join(w)))
    frame = spark.createDataFrame(rows, "pair string, side string, line int, text string").localCheckpoint()
    before = shuffled(spark)
    want = sorted(map(tuple, removals.reworded(frame).collect()), key=str)
    assert shuffled(spark) - before < 6 * sum(len(r[3]) for r in rows)
    assert [r[:5] for r in want] == [r[:5] for r in plain_reworded(rows, 0.75, 12)]
    monkeypatch.setattr(removals, "_OLD_A_CELL", 7)
    monkeypatch.setattr(removals, "_NEW_A_CELL", 11)
    assert sorted(map(tuple, removals.reworded(frame).collect()), key=str) == want


def test_lint_lines_leave_plain_texts_in_place(spark, tmp_path):
    from gleaner.operators import lint as L
    from gleaner.queries.copy_checks import lint_lines

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(500)]
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(60)) for _ in range(40)]
    texts += [None, "", "Always the BEST\nfine", "a\n```\nnever\n```\nnever İalways", f"{L.OFF}\nbest\n{L.ON}\nbest", f"best {L.IGNORE}\nbest {L.ON}\nthe first-ever", "faster than  than\nthan 5 users\nnicht v1.2.3", "Game Changer\nRevolutionary\nwe look de la mer", "> " + "w " * 41]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    before = shuffled(spark)
    got = sorted(map(tuple, lint_lines(spark, str(tmp_path)).collect()))
    assert shuffled(spark) - before < sum(len(t or "") for t in texts) / 4
    assert got == [(42, 1, "superlative"), (43, 5, "superlative"), (44, 4, "superlative"), (45, 3, "superlative"), (46, 1, "comparative"), (46, 2, "undated_number"), (47, 1, "forbidden"), (47, 2, "forbidden"), (47, 3, "forbidden"), (48, 1, "too_long")]


def test_ranked_gates_read_their_texts_once(spark, tmp_path, monkeypatch):
    from gleaner.queries import rule_queries

    docs = [(i, "web", "plain\nplan: if (isPro) upgrade for $5") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    monkeypatch.setattr(rule_queries, "running", lambda df, *a, **b: seen.append(df) or running(df, *a, **b))
    rows = rule_queries.ranked_gates(spark, str(tmp_path)).collect()
    # What is put in order, and so read twice, are the hits and not the texts.
    assert not any("documents.parquet" in f for f in seen[0].inputFiles())
    groups = {r.rule_group for r in rows}
    assert all(sorted(r.place for r in rows if r.rule_group == g) == list(range(1, 1 + sum(r.rule_group == g for r in rows))) for g in groups) and len(groups) > 1


def test_lines_of_any_length_are_read_where_the_query_has_no_limit(spark, tmp_path):
    from gleaner.queries import rule_queries as Q

    pad, at = "x" * 3001 + " ", str(tmp_path)
    docs = [(0, "b", "\n".join(pad + x for x in ("isPro", "rollbar", "a consent", "nodeIntegration: true"))), (14, None, "isPro")]
    # The line of addresses takes minutes where each of them is tried to its end.
    docs.append((1, "a", "plain\n" + "https://a.test/b," * 20_000 + "\n" + "https://a.test/b," * 20_000 + "/pricing\n" + pad + "run(x, '0.0.0.0')"))
    spark.createDataFrame(docs, "doc_id long, source string, text string").coalesce(1).write.parquet(at + "/documents.parquet")
    rows = Q.ranked_gates(spark, at).select("rule_group", "file", "line", "rule_id", "strength", "place").collect()
    assert sorted(map(tuple, rows), key=str) == [("offer", "a/d1/src/main.ts", 4, "offer.00", "strong", 1), ("plan_gate", "b/d0/src/main.ts", 2, "plan_gate.02", "weak", 1), ("plan_gate", None, 2, "plan_gate.02", "weak", 2)]
    assert {r["name"]: (r["files"], r["hits"]) for r in Q.telemetry_products(spark, at).collect()}["Rollbar"] == (1, 1)
    assert [(r["file"], r["line"]) for r in Q.control_lines(spark, at).collect()] == [("b/d0/src/main.ts", 4)]
    assert sorted((r["file"], r["line"]) for r in Q.hardening_signals(spark, at).collect()) == [("a/d1/src/main.ts", 5), ("b/d0/src/main.ts", 5)]


def test_linear_patterns_find_the_same_lines(spark):
    from gleaner.plans.rules import LINEAR, rules

    rng = random.Random(4)
    pieces = {"offer": ["http://", "https://", "http:/", "a", "/pricing", "/pro", "/plans", "/", "?", "<", ">", '"', "'", ")", " ", "/buy<", ","], "hardening": ["run", "listen", "Bind", "er", "(", "'0.0.0.0'", '"0.0.0.0"', "0.0.0.0", " ", "_", "host", ": ", "altool", "--notarize", "stapler staple", "[::]:8", "é"]}
    table = [r for r in rules(limited=False) if r.scan]
    assert len(table) == len(LINEAR) and all(r.scan != r.pattern for r in table)
    for r in table:
        lines = ["".join(rng.choice(pieces[r.group]) for _ in range(rng.randrange(14))) for _ in range(3000)]
        got = spark.createDataFrame([(x,) for x in lines], "x string").select("x", F.col("x").rlike(r.pattern).alias("a"), F.col("x").rlike(r.scan).alias("b")).collect()
        assert [x for x in got if x["a"] != x["b"]] == [] and 100 < sum(x["a"] for x in got) < 2900


def test_license_words_and_first_lines(spark):
    from gleaner.functions import classify as C
    from gleaner.plans import signatures as S

    assert all(any(w in p for w in C.LICENSE_WORDS) for p in [*(ps[0] for _, _, ps in S.LICENSES), *C.LOOSE_LICENSES])
    texts = [(None, "Unrecognized"), ("", "Unrecognized"), ("  \n\t\n", "Unrecognized"), ("\r\n \n ## The Mozilla Public License\nAll rights reserved", "MPL-2.0"), ("\tElastic License", "Elastic-2.0"), ("x\nGNU \n General\tPublic License, Version\n 3", "GPL"), ("nothing\nknown", "Unrecognized"), ("a license  key", "Proprietary or custom")]
    df = spark.createDataFrame(texts, "text string, want string").withColumn("family", C.license_family(F.col("text")))
    assert [r.family for r in df.collect()] == [r[1] for r in texts]
    out = df.select(C.gpl_version(F.col("text"), F.col("family")).alias("v"))
    assert [r.v for r in out.collect()] == [None] * 5 + ["3", None, None]
    # With the family at hand, the text is not searched for it again.
    assert "affero" not in out._jdf.queryExecution().analyzed().toString().split("Project")[1]
    many = spark.createDataFrame([("\n".join(["x"] * 59 + ["Copyright (c) 2020 A <a@b.c>"]),), ("\n".join(["x"] * 60 + ["copyright 2020"]),), (None,)], "text string")
    assert [r[0] for r in many.select(C.copyright_line(F.col("text"))).collect()] == ["Copyright (c) 2020 A <email>", None, None]
