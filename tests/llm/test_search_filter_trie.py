"""Lexical search, URL filter and conversation trie against plain versions; odd rows of each."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import lexical_search as L
from gleaner.llm import prefix_trie as T
from gleaner.llm import url_filter as U


def clash(df):
    return df.withColumns({c: F.lit("clash") for c in ("rank", "shard", "term", "n", "m", "host", "path", "base", "block", "pos", "depth", "template")})


# Ranked lexical search -----------------------------------------------------------------------------------------------


def plain_search(docs, items, top):
    def terms(t):
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or ""))

    bags = [(d, collections.Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for d, b in bags:
            m = 10 + 90 * sum(b.values()) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if b[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_bytes,block", [(300, 3), (10**6, 100)])
def test_search_equals_plain(spark, shard_bytes, block, monkeypatch):
    rng = random.Random(5)
    words = ["the", "of", "and"] * 15 + [f"w{i}" for i in range(40)] + ["É", "été", "x7", "a-b", "Q", "日本"]
    docs = [(rng.randrange(50), " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for _ in range(120)]
    docs += [(None, "w1 w2 w3"), (None, "w1 w2 w3"), (7, None), (8, ""), (9, " .- "), (10, "w1"), (10, "w1"), (-3, "w1"), (11, "w5 " * 3000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(6))) for i in range(8)] + [(1, "w1 the W1"), (1, "w1 the W1"), (2, "w2"), (None, "w1 Q"), (3, None), (4, "..."), (5, "nowhere")]
    index = L.build_index(clash(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)), shard_bytes=shard_bytes)
    got = L.search(index, clash(spark.createDataFrame(items, "item_id long, text string")), top=4, block=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(docs, items, 4)


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert L.search(L.build_index(none), items).count() == 0
    some = L.build_index(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert L.search(some, items.limit(0)).count() == 0 and L.search(some, items).count() == 1


def test_terms_are_not_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(L, "PIECE_BYTES", 5)
    text = b"abcdefghijk lm,nop  q" + b"r" * 20
    assert [t for p in L._pieces(text) for t in L.TERM.findall(p)] == L.TERM.findall(text)


def test_integers_round_trip():
    v = np.array([0, 1, 127, 128, 300, 2**14, 2**21 - 1, 2**35, 5, 0])
    data, start = L.encode(v)
    assert L.decode(data.tobytes()).tolist() == v.tolist() and start[0] == 0 and len(start) == len(v)


def test_merge_prunes_but_finds_the_best():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n, top = int(rng.integers(1, 200)), int(rng.integers(1, 6))
        raw = [(np.sort(rng.choice(n, size=int(rng.integers(1, n + 1)), replace=False)), int(rng.integers(1, 4))) for _ in range(int(rng.integers(1, 6)))]
        lists = [L._Postings(d, rng.integers(1, 5, len(d)) * w * w, top) for d, w in raw]
        total = collections.Counter()
        for x in lists:
            for d, s in zip(x.docs, x.scores, strict=True):
                total[d] += s
        heap = []
        L.best_documents(lists, [-d for d in range(n)], top, heap)
        assert sorted(heap, reverse=True) == sorted(((s, -d) for d, s in total.items()), reverse=True)[:top]


# URL filter ----------------------------------------------------------------------------------------------------------


def plain_judge(urls, rules, depth, pages, weight):
    def parse(u):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "", re.S)
        return ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")

    def rule(host, path):
        fit = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[2:] if fit else (None, None)

    rows = [(*parse(u), *rule(*parse(u))) for u in urls]
    shape = [re.sub("[0-9]+", "#", p) for _, p, _, _ in rows]
    label = [None if v is None else int(v == "allow") for *_, v in rows]
    segs = [[] if s == "" else s[1:].split("/") for s in shape]
    segs = [x[:depth] + ["**"] if len(x) > depth else x for x in segs]

    def facts(ids):
        labelled = [label[i] for i in ids if label[i] is not None]
        return len(ids), sum(labelled), len(labelled)

    def differ(a, n, b, k):
        return n > 0 and k > 0 and abs(a / n - b / k) > math.sqrt(0.5 * math.log(40)) * (1 / math.sqrt(n) + 1 / math.sqrt(k))

    template, purity = [""] * len(rows), [0.0] * len(rows)

    def grow(ids, level, name, above):
        _, good, labelled = facts(ids)
        here = (good + weight * above) / (labelled + weight)
        for i in ids:
            template[i], purity[i] = name, here
        on = [i for i in ids if len(segs[i]) > level]
        by = collections.defaultdict(list)
        for i in on:
            by[segs[i][level]].append(i)
        n, g, k = facts(on)
        below = sum(len(segs[i]) > level + 1 for i in on)
        parts = collections.defaultdict(list)
        for seg, own in by.items():
            a, ag, ak = facts(own)
            apart = len(by) == 1 or (a >= pages and a * U.SHARE >= n and (differ(ag, ak, g, k) or differ(sum(len(segs[i]) > level + 1 for i in own), a, below, n)))
            parts[seg if apart else "*"] += own
        for seg, own in parts.items():
            grow(own, level + 1, name + "/" + seg, here)

    _, good, labelled = facts(range(len(rows)))
    for host in {r[0] for r in rows}:
        grow([i for i, r in enumerate(rows) if r[0] == host], 0, "", (good + 1) / (labelled + 2))
    return [(h, p, r, v or ("block" if purity[i] < 0.5 else "allow"), template[i], round(purity[i], 9)) for i, (h, p, r, v) in enumerate(rows)]


@pytest.mark.parametrize("hot", [3, 10**6])
def test_filter_equals_plain(spark, hot, monkeypatch):
    monkeypatch.setattr(U, "HOT", hot)
    rng = random.Random(9)
    urls = [f"http://{rng.choice(['a.com', 'b.A.com', 'x.example.org', 'c.net'])}/{rng.choice(['fr', 'de', 'en'])}/{rng.choice(['', 'u/'])}{rng.randrange(99)}{rng.choice(['', '/', '.html', '?q=1', '#t'])}" for _ in range(1500)]
    urls += [None, "", "no scheme", "x://", "x://h", "x://h?a", "X://EXAMPLE.ORG/es/1", "x://example.org/en/12", "x://example.org/en/2", "x://notexample.org/es/", "x://com/de/", "x://ÀB.Com/fr/é", "a://b://c/d", "x://h/" + "/".join("abcdefghij"), "x://h/" + "k/" * 3000, "x://h//", "x://a.com/fr/\n1"] + ["x://h/z/1"] * 30
    df = clash(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(4))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"], r["template"], round(r["purity"], 9)) for r in U.judge_urls(df).collect()}
    want = plain_judge(urls, U.RULES, U.DEPTH, U.PAGES, U.WEIGHT)
    assert [got[i] for i in range(len(urls))] == want
    assert {"fr", "de"} & {t.split("/")[1] for *_, t, _ in want if t} and any(t.startswith("/*/") for *_, t, _ in want)


def test_filter_carries_columns_and_takes_empty_tables(spark):
    df = spark.createDataFrame([(1, "x://a/b", "k"), (1, "x://a/b", "k"), (None, None, None)], "page_id long, url string, host2 string")
    assert U.judge_urls(df, carry=("host2",)).count() == 3
    assert U.judge_urls(df.limit(0)).count() == 0
    assert "Python" not in U.judge_urls(df)._jdf.queryExecution().toString()


# Conversation prefix trie --------------------------------------------------------------------------------------------


def plain_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(x)] for c, x in own.items()}
    nodes = {}
    for c, turns in sorted(own.items()):
        h = zlib.crc32(str(c).encode()) % 4
        base = int(math.fmod(c, 20))
        path = tuple(own.get(c - base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], ([], []))[0].append(c)
        nodes[path][1].append(c)
    children = collections.Counter(k[:-1] for k in nodes if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, (members, _) in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(members) - 1) * words
    return sorted(((min(m), len(k), min(nodes[k[:-1]][0]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(e))).encode()).hexdigest()) for k, (m, e) in nodes.items()), key=str)


def conversations(rng, families=6):
    said = [f"say {i} " * (i % 4) for i in range(5)]
    rows = []
    for c in rng.sample(range(families * 20), families * 9) + [-5, -21]:
        rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice([*said, None, ""])) for t in range(rng.choice([1, 1, 2, 3, 5, 9, 14]))]
    return rows


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("block,seed", [(4, 1), (5, 2), (1000, 3)])
def test_trie_equals_plain(spark, block, seed, monkeypatch):
    monkeypatch.setattr(T, "HOT", 3)
    rng = random.Random(seed)
    # Equal turns of one conversation differ in nothing but their turn; so ties have one order.
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in conversations(rng)}.values())
    rows += [(40, None, "user", "x y")] * 2 + [(40, 0, "user", "x y"), (200, 0, "u", "one"), (200, 0, "u", "one"), (None, 1, "u", "lost")]
    rows += [(c, t, "u", f"same {t}") for c in (300, 301, 305, 400, 401, 500) for t in range(12)]
    got = T.prefix_trie(clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)), block=block)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(rows)


def test_trie_with_text_and_empty_table(spark):
    rows = [(20, 0, "user", "hello"), (20, 1, "bot", "there"), (21, 0, "user", "mine"), (21, 1, "bot", "other"), (21, 2, "user", "more")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = T.prefix_trie(df, with_text=True)
    h = zlib.crc32(b"21") % 4
    path = (["hello", "there"][:h] + ["mine", "other", "more"][h:])
    assert {r["text"] for r in got.collect()} == {None, "hello", "there", *path}
    assert T.prefix_trie(df.limit(0)).count() == 0


def test_long_ends_are_digested_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE_IDS", 7)
    rows = [(c, 0, "u", "same") for c in range(0, 2000, 20)]
    got = T.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(rows)
