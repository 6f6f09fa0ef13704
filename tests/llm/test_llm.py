"""Operators for training data against plain versions: brute force, libraries, round trips, held-out accuracy; edge cases of each."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import gleaner.llm.jaccard_join as J
import gleaner.llm.suffix_dedup as S
from gleaner.llm import byte_bpe, hamming, license_scan, line_dedup, ordinal_quality, packing, preference_format
from gleaner.llm.common import connected_components, join_counted
from gleaner.llm.shingles import shingle_sets

files = pytest.importorskip("public_tokenizers")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=True):
    """rows (doc_id, text[, source]) as documents, with columns whose names clash with those used inside."""
    df = spark.createDataFrame([(i, t, "en", (s or ["x"])[0], len(t or "")) for i, t, *s in rows], DOC)
    return df.withColumns({c: F.lit("clash") for c in ("rid", "k1", "tok", "marks", "ids", "part")}) if extra else df


def near_copies(rng, base_words, copies, edits):
    out = []
    for _ in range(copies):
        w = list(base_words)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def odd_rows():
    return [(None, "a b c d e f"), (None, "a b c d e f"), (7, None), (8, ""), (9, " \n\t "), (10, "A B"), (11, "a b"), (12, "a b c d e f"), (12, "a b c d e f"), (13, "é é É é é")]


# N-gram Jaccard join -------------------------------------------------------------------------------------------------


def plain_components(rows, width, percent):
    def shingles(t):
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) if x]
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return collections.Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("rare,low,high,listed", [(16, 18, 100, 512), (2, 18, 100, 512), (1, 10, 40, 40)])
def test_jaccard_join_against_all_pairs(spark, monkeypatch, rare, low, high, listed):
    for name, value in (("RARE", rare), ("LOW", low), ("HIGH", high), ("LISTED", listed)):
        monkeypatch.setattr(J, name, value)
    rng = random.Random(rare)
    texts = []
    for size in (12, 30, 60, 90, 150):
        base = [f"w{size}_{rng.randrange(400)}" for _ in range(size)]
        texts += near_copies(rng, base, 14, 4)
    shared = " ".join(f"s{i}" for i in range(25))
    texts += [shared + " " + " ".join(f"q{k}_{i}" for i in range(rng.randint(3, 30))) for k in range(12)]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(25)]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 100)) + odd_rows()
    got = J.link_documents(documents(spark, rows), 4, 85).select("doc_id", "n_shingles", "component_id").collect()
    assert collections.Counter(map(tuple, got)) == plain_components(rows, 4, 85)


@pytest.mark.parametrize("square", [512, 7])
def test_jaccard_join_of_hot_buckets_that_do_not_link(spark, monkeypatch, square):
    monkeypatch.setattr(J, "SQUARE", square)
    rng = random.Random(square)
    pool = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(46)]
    # Single words as shingles: every token is in most documents, few of which are alike enough; sizes differ.
    rows = [(i, " ".join(rng.sample(pool, rng.choice([20, 30, 38, 39, 40, 42])))) for i in range(260)]
    got = J.link_documents(documents(spark, rows, extra=False), 1, 85).select("doc_id", "n_shingles", "component_id").collect()
    assert collections.Counter(map(tuple, got)) == plain_components(rows, 1, 85)


def test_jaccard_join_of_many_nodes_with_frequent_shingles(spark):
    rng = random.Random(2)
    shared = " ".join(f"s{i}" for i in range(23))
    rows = [(i, shared + " " + " ".join(f"q{i}_{j}" for j in range(rng.randint(12, 40)))) for i in range(5000)]
    got = J.link_documents(documents(spark, rows, extra=False), 4, 85).collect()
    assert len(got) == 5000 and all(r["component_id"] == r["doc_id"] for r in got)


def test_jaccard_join_of_many_rows_alike(spark):
    rows = [(None, "a b c d e f g")] * 40 + [(3, "a b c d e f h")] * 3 + [(i, "p q r s t u v w") for i in range(4, 9)]
    got = J.link_documents(documents(spark, rows), 2, 50).select("doc_id", "n_shingles", "component_id").collect()
    assert collections.Counter(map(tuple, got)) == plain_components(rows, 2, 50)


def test_jaccard_join_keeps_one_row_of_each_group(spark):
    rows = odd_rows() + [(20, "a b c d e f"), (3, "a b c d e f")]
    got = J.link_documents(documents(spark, rows), 5, 80, carry=("text", "source")).where("keeps").collect()
    assert sum(r["text"] == "a b c d e f" for r in got) == 1
    assert {r["doc_id"] for r in got if r["text"] == "a b c d e f"} == {3}
    assert sum(r["text"] in (None, "", " \n\t ") for r in got) == 3
    assert J.link_documents(documents(spark, rows).limit(0), 5, 80).count() == 0


def test_shingles_of_short_and_long_words():
    long = b"x" * 40_000
    a, b, c, d, e = shingle_sets([b"One two", b"one TWO", b"two one", b"", long + b" a b c"], 4)
    assert list(a) == list(b) != list(c) and len(d) == 0 and len(e) == 1
    assert len(shingle_sets([b"a b c d a b c d a"], 4)[0]) == 4


def test_join_of_keys_with_many_rows(spark):
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 3), (3, 1), (4, 20)) for i in range(n)], "key long, i long")
    table = spark.createDataFrame([(1, 50, "a"), (2, 3, "b"), (4, 20, "c"), (9, 0, "d")], "key long, m long, v string")
    want = sorted(tuple(r) for r in rows.join(table, "key").select("key", "i", "m", "v").collect())
    for limit, most in ((10, 100), (100, 100), (0, 1), (10, 2)):
        assert sorted(tuple(r) for r in join_counted(rows, table, "key", limit, most).select("key", "i", "m", "v").collect()) == want


def test_connected_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (300, 301), (301, 300)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "x long, y long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {300: 300, 301: 300}


# Suffix-array dedup --------------------------------------------------------------------------------------------------


def plain_repeats(rows, window, keep):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = collections.Counter(b[i : i + window] for _, b in texts for i in range(len(b) - window + 1))
    seen, out = set(), collections.Counter()
    for d, b in sorted(texts, key=lambda r: (r[0] is None, r[0] or 0)):
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            x = b[i : i + window]
            if count[x] > 1 if keep == "none" else x in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(x)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[(d, len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("hot", [256, 2])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_suffix_dedup_against_all_windows(spark, keep, hot):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(40, 90)))
    passages = [word() for _ in range(6)]
    rows = [(i, word() + rng.choice(passages) + word() + (rng.choice(passages) if i % 3 else "")) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "short"), (103, "z" * 200), (104, "ab" * 90), (105, rows[3][1]), (None, word()), (106, passages[0] * 3)]
    got = S.remove_repeats(documents(spark, rows), window=50, keep=keep, with_text=False, gram=16, hot=hot).collect()
    assert collections.Counter(map(tuple, got)) == plain_repeats(rows, 50, keep)


def test_longest_previous_factors_against_every_pair():
    rng = random.Random(1)
    for trial in range(150):
        n, window = rng.randint(1, 90), rng.choice([1, 3, 8, 9, 20, 24, 25, 50, 73])
        data = bytes(rng.choice(b"ab\0" if trial % 2 else b"a") for _ in range(n + window - 1))
        starts = np.arange(n) if trial % 3 else np.array(sorted(rng.sample(range(n), rng.randint(1, n))))

        def common(a, b):
            return next((k for k in range(window) if data[a + k] != data[b + k]), window)  # noqa: B023

        sa, lcp = S.suffix_order(np.frombuffer(data, np.uint8), starts, window)
        want = sorted(starts.tolist(), key=lambda i: (data[i : i + window], i))  # noqa: B023
        assert sa.tolist() == want and lcp.tolist() == [0] + [common(a, b) for a, b in zip(want, want[1:], strict=False)]
        assert S.longest_previous_factors(sa, lcp).tolist() == [max((common(i, j) for j in want if j < i), default=0) for i in want]


@pytest.mark.parametrize("keep", ["none", "first"])
def test_suffix_dedup_at_registered_parameters(spark, keep):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common, rare = word(900), [word(rng.randint(195, 420)) for _ in range(8)]
    rows = [(i, word(rng.randint(0, 300)) + (common[i % 7 :] if i % 3 == 0 else rng.choice(rare)) + word(rng.randint(0, 300))) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)] + [(2000, common * 2), (2001, "x" * 700), (None, rows[5][1]), (None, rows[5][1]), (7, rows[7][1])]
    got = S.remove_repeats(documents(spark, rows).repartition(7), 200, keep, with_text=False).collect()
    if keep == "first":  # equal rows share one result
        assert set(map(tuple, got)) == set(plain_repeats(set(rows), 200, keep))
    else:
        assert collections.Counter(map(tuple, got)) == plain_repeats(rows, 200, keep)


def test_suffix_dedup_carries_columns_of_any_name(spark):
    rows = documents(spark, [(1, "a" * 60), (2, "b" + "a" * 60)]).select("doc_id", "text", *[F.lit(i).alias(c) for i, c in enumerate(("k1", "marks", "_d", "kh", "first"))])
    got = S.remove_repeats(rows, window=50, gram=16, carry=("k1", "marks", "_d", "kh", "first")).orderBy("doc_id").collect()
    assert [(r["kept"], r["k1"], r["marks"], r["_d"], r["kh"], r["first"]) for r in got] == [("a", 0, 1, 2, 3, 4), ("b", 0, 1, 2, 3, 4)]


def test_suffix_dedup_texts_and_repeated_rows(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghij klmnop") for _ in range(S.PIECE + 4000))  # more than one piece
    rows = [(1, text), (2, "prefix:" + text[S.PIECE - 150 : S.PIECE + 150]), (5, text[:120]), (5, text[:120])]
    got = S.remove_repeats(documents(spark, rows), window=60, keep="first", gram=16).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in got] == [0, 300, 120, 120] and got[1]["kept"] == "prefix:" and got[1]["spans"][0]["start"] == 7
    assert S.remove_repeats(documents(spark, rows).limit(0)).count() == 0


# Packing and byte-level BPE ------------------------------------------------------------------------------------------


def texts_for_tokens():
    rng = random.Random(2)
    return ["", "Hello world", "é漢字🙂 \n\n  x", "a" * 3000, "ab" * 700, " " * 50 + "x", "don't stop 123,456", "<|endoftext|> raw", "‍́"] + ["".join(rng.choice("abcdeé漢 \n\t1 !?🙂<>|'") for _ in range(rng.randint(0, 300))) for _ in range(60)]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    texts = texts_for_tokens()
    rows = list(enumerate(texts)) + [(7, None), (None, "no id")]
    path = files.path("byte_bpe_50k.json")
    docs = documents(spark, rows).repartition(5)
    pieces = packing.pack(docs, path, files.path("byte_bpe_50k.tiktoken"), files.PATTERN, length=64, with_ids=True).collect()
    t = Tokenizer.from_file(path)
    own = collections.Counter((d, tuple(t.encode(x or "", add_special_tokens=False).ids + [0])) for d, x in rows)
    by_place = sorted((p["sequence_id"], p["offset"], p) for p in pieces)
    at = 0
    for seq, off, p in by_place:
        assert seq * 64 + off == at and p["length"] == len(p["ids"]) <= 64 - off
        assert zlib.crc32(np.array(p["ids"], dtype="<u4").tobytes()) == p["ids_crc32"]
        at += p["length"]
    made, now = collections.Counter(), []
    for _, _, p in by_place:
        assert p["start"] == len(now)
        now += p["ids"]
        if len(now) == p["doc_tokens"]:
            made[(p["doc_id"], tuple(now))] += 1
            now = []
    assert made == own and not now
    assert {p["padded_to"] for p in pieces if p["sequence_id"] < by_place[-1][0]} == {64}
    assert packing.pack(docs.limit(0), path).count() == 0


def test_sequences_join_pieces(spark):
    pieces = packing.pack(documents(spark, list(enumerate(texts_for_tokens()))), files.path("byte_bpe_50k.json"), length=32, with_ids=True)
    got = packing.sequences(pieces).collect()
    last = max(r["sequence_id"] for r in got)
    assert all(len(r["ids"]) == 32 for r in got if r["sequence_id"] < last)


def test_fast_ids_are_the_librarys(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    for x in texts_for_tokens():
        assert packing.token_ids(x, files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN).tolist() == t.encode(x, add_special_tokens=False).ids


def test_byte_bpe_against_tiktoken(spark):
    import tiktoken

    path = files.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = list(enumerate(texts_for_tokens())) + [(900, None), (None, "x y"), (None, "x y")]
    got = byte_bpe.encode_documents(documents(spark, rows), path, files.PATTERN).collect()
    assert len(got) == len(rows)
    want = collections.Counter((d, tuple(library.encode_ordinary(t or "")), t or "") for d, t in rows)
    assert collections.Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got) == want
    for r in got:
        data = np.array(r["ids"], dtype="<u4").tobytes()
        assert r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(data).hexdigest() and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert byte_bpe.encode_documents(documents(spark, rows).limit(0), path, files.PATTERN).count() == 0


def long_texts():
    rng = random.Random(7)
    prose = " ".join("".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 9))) for _ in range(180_000))
    return [prose, " " * 1_000_001 + "x", "\n" * 50_000 + " a", "a" * 60_000, "q" * 200 + " " + "q" * 200, "!?" * 4000]


def test_ids_of_very_long_texts(spark):
    import tiktoken
    from tokenizers import Tokenizer

    assert len(long_texts()[0]) > 1_000_000
    rows = list(enumerate(long_texts())) + [(9, "q" * 200), (9, "q" * 200)]
    path = files.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    pieces = packing.pack(documents(spark, rows), path, files.path("byte_bpe_50k.tiktoken"), files.PATTERN, with_ids=True).orderBy("sequence_id", "offset").collect()
    made, now = [], []
    for p in pieces:
        now += p["ids"]
        if len(now) == p["doc_tokens"]:
            made.append((p["doc_id"], now))
            now = []
    assert sorted(made) == sorted((d, own.encode(t, add_special_tokens=False).ids + [0]) for d, t in rows)

    path = files.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [r for r in rows if not r[1].startswith(" ")]  # the library gives up on that one
    got = byte_bpe.encode_documents(documents(spark, rows), path, files.PATTERN, with_ids=False).collect()
    want = [(d, hashlib.sha256(np.array(library.encode_ordinary(t), dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows]
    assert sorted((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)


def test_segment_tree_paths_agree():
    v = byte_bpe.vocabulary(files.path("byte_bpe_multi_50k.tiktoken"))
    rng = random.Random(3)
    words = ["".join(rng.choice("aeinrst'é ") for _ in range(rng.randint(2, 30))).encode()[:60] for _ in range(300)]
    for w, ids in zip(words, v.encode_many(words), strict=True):
        assert w in v.ranks or np.frombuffer(ids, "<u4").tolist() == v.encode_long(w)


# Line dedup, preferences ---------------------------------------------------------------------------------------------


def test_line_dedup(spark):
    rows = [(i, f"menu\n  own {i} \n\nfooter {i % 2}", "h") for i in range(20)] + [(50, "menu\nmenu", "other"), (51, None, "h"), (52, "", "h"), (53, "menu", "h"), (None, "menu\nx", "h")]
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(documents(spark, rows), max_ratio=0.3, min_pages=3).collect()}
    assert got[3]["text"] == "  own 3 \n" and got[3]["n_lines"] == 4 and got[3]["n_dropped"] == 2
    assert got[50]["text"] == "menu\nmenu" and got[51]["text"] is None and got[51]["n_lines"] == 0
    assert got[52]["text"] == "" and got[53]["text"] == "" and got[None]["text"] == "x"
    assert line_dedup.drop_boilerplate(documents(spark, rows).limit(0)).count() == 0


def trained(text, mask):
    """The characters that a mask counts, turn by turn."""
    runs, at, out = [int(x) for x in mask.split(",")] if mask else [], 0, []
    for skip, take in zip(runs[::2], runs[1::2], strict=True):
        out.append(text[at + skip : at + skip + take])
        at += skip + take
    assert at == len(text)
    return [x for x in out if x]


def test_preferences(spark):
    shape = "pair_id long, turn long, role string, text string, c string"
    chosen = spark.createDataFrame([(1, 0, "user", "q", ""), (1, 1, "assistant", "good", ""), (2, 0, "user", "same", ""), (3, 0, "user", "only", ""), (None, 0, "user", "x", ""), (4, 0, None, None, ""), (4, 1, "assistant", "é", "")], shape)
    rejected = spark.createDataFrame([(1, 1, "assistant", "bad", ""), (1, 0, "user", "q", ""), (1, 2, "user", "more", ""), (2, 0, "user", "same", ""), (4, 0, "user", "u", "")], shape)
    got = {r["pair_id"]: r for r in preference_format.format_preferences(chosen, rejected).collect()}
    assert set(got) == {1, 2, 4}
    r = got[1]
    assert r["prompt"] == "<|user|>\nq<|end|>\n" and r["prompt_turns"] == 1
    assert trained(r["chosen"], r["chosen_mask"]) == ["good<|end|>\n"] and r["rejected"].endswith("<|user|>\nmore<|end|>\n")
    assert trained(r["rejected"], r["rejected_mask"]) == ["bad<|end|>\n"]
    assert got[2]["chosen"] == got[2]["rejected"] == "" and got[4]["prompt"] == ""
    assert preference_format.format_preferences(chosen.limit(0), rejected).count() == 0


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("pair_id", "c", "o", "at", "k", "p")})


def test_branches_diverge_anywhere_and_lonely_conversations_stay(spark):
    say = lambda c, n: [(c, t, ["user", "assistant"][t % 2], f"{c} says {t}") for t in range(n)]
    rows = say(6, 5) + say(7, 4) + say(10, 3) + say(11, 9) + say(-3, 4) + say(-4, 6) + say(20, 2) + [(None, 0, "user", "x")]
    got = {r["pair_id"]: r for r in preference_format.format_branches(conversations(spark, rows)).collect()}
    assert {i: r["prompt_turns"] for i, r in got.items()} == {6: 1, 7: 3, 10: 1, 11: 2, -3: 1, -4: 2, 20: 2}
    assert got[20]["chosen"] == got[20]["rejected"] == got[20]["chosen_mask"] == ""
    assert "7 says 1<" in got[6]["rejected"] and "7 says 0" not in got[6]["rejected"] and got[6]["prompt"].endswith("6 says 0<|end|>\n")
    assert trained(got[11]["chosen"], got[11]["chosen_mask"]) == [f"11 says {t}<|end|>\n" for t in (3, 5, 7)]


def test_branches_of_long_odd_and_repeated_turns_equal_their_sql(spark):
    import duckdb

    rows = [(1, t, ["user", "assistant"][t % 2], "é🙂" * (t % 5)) for t in range(3000)] + [(0, t, "user" if t % 3 else "assistant", "x" * t) for t in range(2500)]
    rows += [(2, None, "user", "a"), (2, None, "assistant", None), (2, 0, None, "b"), (3, 0, "user", "a"), (3, 0, "user", "a"), (3, 0, "assistant", "z"), (5, 1, "user", ""), (None, 1, "user", "no id"), (8, 0, "user", "y" * 300_000), (9, 0, "user", "y" * 300_000)]
    df = conversations(spark, rows)
    got = preference_format.format_branches(df)
    con = duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toArrow())
    cur = con.execute(preference_format.OP5_SQL)
    names = [d[0] for d in cur.description]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(cur.fetchall())
    assert preference_format.format_branches(df.limit(0)).count() == 0


# Quality, licenses ---------------------------------------------------------------------------------------------------


def test_quality_on_held_out_documents(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["an", "the", "er", "ti", "on", "ou"]) for _ in range(rng.randint(1, 4)))

    def make(grade):
        w = [word() for _ in range(rng.randint(20, 120))]
        if grade == 0:
            w = [x.upper() + "!!" for x in w]
        if grade == 1:
            w[rng.randrange(len(w))] = rng.choice(["vile", "awful"])
        return " ".join(w)

    grades = [rng.choice([0, 1, 2, 2]) for _ in range(900)]
    docs = documents(spark, [(i, make(g)) for i, g in enumerate(grades)])
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(grades[:600])] + [(None, 1), (5, None)], "doc_id long, grade int")
    model = ordinal_quality.fit_on(docs, labels, 3)
    assert model.thresholds == sorted(model.thresholds)
    got = {r["doc_id"]: r for r in ordinal_quality.grade_documents(docs, model).collect()}
    right = np.mean([got[i]["keep"] == (g == 2) for i, g in enumerate(grades) if i >= 600])
    assert right >= 0.97
    mean = [np.mean([got[i]["expected_grade"] for i, g in enumerate(grades) if g == k and i >= 600]) for k in range(3)]
    assert mean == sorted(mean)
    odd = ordinal_quality.grade_documents(documents(spark, odd_rows()), model).collect()
    assert len(odd) == len(odd_rows())
    assert ordinal_quality.grade_documents(docs.limit(0), model).count() == 0
    assert ordinal_quality.grade_documents(docs.limit(5), ordinal_quality.fit_on(docs, labels.limit(0), 3)).where("keep").count() == 5


def test_quality_weighs_rare_words_of_a_rare_grade():
    rng = random.Random(3)
    plain = lambda: [f"w{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}{rng.choice('abcdefgh')}" for _ in range(40)]
    texts, grades = [], []
    for i in range(1000):
        grades.append(1 if i < 100 else 0 if i < 200 else 2)
        texts.append(" ".join(plain() + (["zuvile"] if i < 8 else ["common"] * 3 if i < 100 else [])))
    rows = [ordinal_quality.features(t) for t in texts]
    model = ordinal_quality.fit(np.array([k for r in rows for k in r]), np.array([v for r in rows for v in r.values()]), np.array([len(r) for r in rows]), np.array(grades), 3)
    # Eight toxic documents of a thousand hold the word, no other does.
    assert model.weights.get(ordinal_quality.word_features("zuvile")[0], 0.0) < -0.3


def test_quality_fit_converges_on_many_features():
    rng = np.random.default_rng(5)
    grades = np.repeat([0, 1, 2, 2], 250)
    sizes = np.full(1000, 60)
    bucket = np.concatenate([np.concatenate((rng.choice(400, 30, replace=False) + 500 * g, rng.choice(4000, 30, replace=False) + 5000)) for g in grades])
    model = ordinal_quality.fit(bucket, np.ones(len(bucket)), sizes, grades, 3)
    score = np.array([sum(model.weights.get(int(k), 0.0) for k in row) for row in bucket.reshape(-1, 60)])
    assert np.array_equal((model.tails(score) >= 0.5).sum(axis=1), grades)


def test_license_scan_and_inheritance(spark):
    rows = [("LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/x.py", "print(1)"), ("a/b/LICENSE.txt", "Released under the MIT License.\n"), ("a/b/c/y.py", "code"), ("a/b/z.py", "# All rights reserved.\ncode"), (None, "none"), ("q/empty", None), ("a/x.py", "print(1)")]
    rows += [(f"noise/{i}.txt", f"the and of in to {i} words that mean nothing") for i in range(30)]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(df, carry=("doc_id",)).collect()}
    assert len(got) == len(rows)
    assert (got[0]["license"], got[0]["via"]) == ("Apache-2.0", "own") and got[1]["license"] == "Apache-2.0" and got[1]["via"] == "inherited"
    assert got[3]["license"] == "MIT" and got[3]["source_path"] == "a/b/LICENSE.txt" and got[4]["license"] == "Proprietary" and got[4]["line"] == 1
    assert got[5]["via"] == "none" and got[6]["license"] == "Apache-2.0" and got[20]["via"] == "inherited"
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def plain_loss(p, rows, grades, levels, l2):
    """The model's definition, row by row."""
    m = len(p) - levels + 1
    theta = [p[m]]
    for x in p[m + 1 :]:
        theta.append(theta[-1] + np.exp(x))
    total = 0.0
    for row, g in zip(rows, grades, strict=True):
        s = sum(p[k] * v for k, v in row.items())
        tails = [1.0, *(1 / (1 + np.exp(t - s)) for t in theta), 0.0]
        total -= np.log(tails[g] - tails[g + 1])
    return total / len(rows) + l2 / 2 * sum(x * x for x in p[:m])


@pytest.mark.parametrize("levels", [2, 3, 5])
def test_quality_gradient_against_finite_differences(levels):
    rng = np.random.default_rng(levels)
    rows = [{int(k): float(rng.uniform(0.2, 2)) for k in rng.choice(6, rng.integers(0, 5), replace=False)} for _ in range(40)]
    grades = rng.integers(0, levels, 40)
    at = np.array([k for r in rows for k in r])
    value = np.array([v for r in rows for v in r.values()])
    owner = np.repeat(np.arange(40), [len(r) for r in rows])
    p = rng.standard_normal(6 + levels - 1) * 0.5
    loss, gradient = ordinal_quality.loss_and_gradient(p, at, value, owner, grades, levels, 0.01)
    assert loss == pytest.approx(plain_loss(p, rows, grades, levels, 0.01), rel=1e-12)
    for i in range(len(p)):
        step = np.zeros(len(p))
        step[i] = 1e-5
        slope = (plain_loss(p + step, rows, grades, levels, 0.01) - plain_loss(p - step, rows, grades, levels, 0.01)) / 2e-5
        assert gradient[i] == pytest.approx(slope, abs=1e-7)


def test_quality_fit_reaches_the_optimum():
    rng = np.random.default_rng(8)
    first = 2**18  # shapes: features without a graded penalty
    rows = [{first + int(k): 1.0 for k in rng.choice(4, rng.integers(1, 4), replace=False)} for _ in range(400)]
    grades = np.array([min(2, max(0, int(round(sum((k - first) % 2 for k in r) + rng.normal(0, 0.8))))) for r in rows])
    flat = [np.array([k for r in rows for k in r]), np.array([v for r in rows for v in r.values()]), np.array([len(r) for r in rows])]
    model = ordinal_quality.fit(*flat, grades, 3, l2=1e-3)
    p = np.array([model.weights[first + k] for k in range(4)] + [model.thresholds[0], np.log(model.thresholds[1] - model.thresholds[0])])
    own = [{k - first: v for k, v in r.items()} for r in rows]
    least = plain_loss(p, own, grades, 3, 1e-3)
    for i in range(len(p)):
        for d in (-0.02, 0.02):
            q = p.copy()
            q[i] += d
            assert plain_loss(q, own, grades, 3, 1e-3) >= least - 1e-7
    # Without features the thresholds are the log-odds of the grades' shares.
    none = ordinal_quality.fit(np.zeros(0, int), np.zeros(0), np.zeros(400, int), grades, 3)
    assert none.tails(np.zeros(1))[0] == pytest.approx([(grades >= 1).mean(), (grades >= 2).mean()], abs=1e-4)


def test_quality_scores_equal_the_models_definition_on_odd_and_long_texts(spark):
    words = [f"w{i}" for i in range(300)]
    weights = {k: 0.01 * (k % 7 - 3) for w in words for k in ordinal_quality.word_features(w)}
    model = ordinal_quality.OrdinalModel(weights, [-0.3, 0.4])
    rows = odd_rows() + [(50, " ".join(words * 2000)), (51, "x" * 1_500_000), (52, "w1 " * 300_000)]
    docs = documents(spark, rows).withColumns({c: F.lit("clash") for c in ("keep", "grade", "_c0", "expected_grade")})
    got = ordinal_quality.grade_documents(docs, model, carry=("grade", "_c0")).collect()
    assert {(r["grade"], r["_c0"]) for r in got} == {("clash", "clash")}
    want = []
    for d, t in rows:
        s = sum(weights.get(k, 0.0) * v for k, v in ordinal_quality.features(t or "").items())
        want.append((d, *(1 / (1 + np.exp(x - s)) for x in model.thresholds)))
    key = lambda r: (r[0] is None, r[0] or 0, round(r[1], 9))
    for a, b in zip(sorted(((r["doc_id"], r["expected_grade"] - r["top_probability"], r["top_probability"]) for r in got), key=key), sorted(want, key=key), strict=True):
        assert a == pytest.approx(b, abs=1e-9) if a[0] is not None else a[1:] == pytest.approx(b[1:], abs=1e-9)


def plain_scan(templates, df, n, text, licence_file, least):
    """Dense TF-IDF cosines of every window, without any bound."""
    vocabulary = sorted({w for ts in templates.values() for t in ts for w in license_scan.words(t)})
    idf = {w: np.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    mean = sum(idf.values()) / len(idf)

    def vector(bag, extra):
        own = sorted(extra)
        return np.array([bag[w] * idf[w] for w in vocabulary] + [bag[w] * mean for w in own])

    strong = license_scan.Templates(templates, df, n, least).strong
    lines = text.split("\n")
    parts = [(0, text)] if licence_file else []
    parts += [(i + 1, "\n".join(lines[i : i + k])) for i in range(len(lines)) if strong & set(license_scan.words(lines[i])) for k in license_scan.WINDOWS]
    best = (0.0, "", 0)
    for at, part in parts:
        bag = collections.Counter(license_scan.words(part))
        extra = set(bag) - set(vocabulary)
        x = vector(bag, extra)
        for name in sorted(templates):
            for t in templates[name]:
                y = vector(collections.Counter(license_scan.words(t)), extra)
                score = float(x @ y / np.sqrt((x @ x) * (y @ y))) if x.any() else 0.0
                if score > best[0] + 1e-9:
                    best = (score, name, at)
    return best if best[0] >= least else (0.0, "", 0)


def test_license_scores_against_dense_cosines():
    rng = random.Random(4)
    df = {"the": 90, "of": 80, "and": 80, "in": 70, "to": 70, "is": 60, "license": 9}
    few = {k: license_scan.TEMPLATES[k] for k in ("MIT", "ISC", "GPL-3.0", "CC-BY-NC-4.0", "CC-BY-4.0", "Apache-2.0", "Proprietary")}
    t = license_scan.Templates(few, df, 100, 0.6)
    texts = [x for ts in few.values() for x in ts]
    for _ in range(60):
        out = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(texts).split()
            cut = w[rng.randrange(len(w)) :][: rng.randint(1, 30)] if rng.random() < 0.5 else w
            out += [" ".join(cut[i : i + 7]) for i in range(0, len(cut), 7)] + ["noise here and there"] * rng.randint(0, 2)
        text, of_file = "\n".join(out), rng.random() < 0.5
        a, b = t.scan(text, of_file), plain_scan(few, df, 100, text, of_file, 0.6)
        assert abs(a[0] - b[0]) < 1e-9 and (a[1:] == b[1:] or a[0] == pytest.approx(b[0], abs=1e-9))


def test_license_bound_skips_nothing():
    df = {"the": 90, "of": 80, "and": 80, "in": 70, "to": 70, "is": 60}
    t = license_scan.Templates(license_scan.TEMPLATES, df, 100, 0.6)
    weak = sorted(set(t.idf) - t.strong)
    everything = license_scan.Templates(license_scan.TEMPLATES, df, 100, 0.6)
    everything.strong = frozenset(everything.idf)
    rng = random.Random(4)
    for _ in range(400):
        bag = collections.Counter(rng.choice(weak) for _ in range(rng.randint(1, 14)))
        assert t.best(bag) == (0.0, "") and everything.best(bag)[0] < 0.6


def wrapped(text, n=8):
    w = text.split()
    return "\n".join(" * " + " ".join(w[i : i + n]) for i in range(0, len(w), n))


def test_licenses_by_whole_texts_headers_and_spdx(spark):
    rows = [(name, f"{name}/x{i}.c", "code before\n" + wrapped(t) + "\nint main() {}\n") for name, ts in license_scan.TEMPLATES.items() for i, t in enumerate(ts)]
    rows += [("ISC", "isc/LICENSE", "ISC License\n\nCopyright (c) 2020 Some One\n\n" + wrapped(license_scan.TEMPLATES["ISC"][2])), ("MIT", "m/a.py", "# SPDX-License-Identifier: MIT\nx = 1")]
    plain = [(None, f"plain/{i}.txt", f"the {i} of all words and in that is free to use as it was with no fee " * 3) for i in range(300)]
    df = spark.createDataFrame(rows + plain, "want string, path string, text string").withColumns({c: F.lit("clash") for c in ("own", "dir", "score", "license", "l")})
    got = license_scan.scan_licenses(df, carry=("want", "own", "dir")).collect()
    assert len(got) == len(rows) + len(plain) and {(r["own"], r["dir"]) for r in got} == {("clash", "clash")}
    wrong = [(r["want"], r["license"], r["path"], r["score"]) for r in got if r["want"] != r["license"]]
    assert license_scan.scan_licenses(spark.createDataFrame([(f"{i}", "Mit.\nder und mit") for i in range(50)], "path string, text string")).where("license IS NOT NULL").count() == 0
    assert not wrong


def plain_inheritance(rows, least_score):
    """rows (path, own, score of licence files) to the nearest ancestor's licence, by walking up."""
    held = {}
    for path, own, score in rows:
        name = path.rpartition("/")[2]
        if own and license_scan._FILE.search(name):
            folder = path.rpartition("/")[0]
            held[folder] = min(held.get(folder, (1, "", "")), (-score, path, own))
    out = {}
    for path, own, _ in rows:
        folder = path.rpartition("/")[0]
        while own is None and folder not in held and folder:
            folder = folder.rpartition("/")[0]
        out[path] = own or held.get(folder, (0, "", None))[2]
    return out


def test_inheritance_against_walking_up(spark):
    rng = random.Random(12)
    folders = [""] + ["/".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    notes = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Released under the ISC License.", "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."]
    rows = {}
    for i in range(400):
        folder = rng.choice(folders)
        name = f"LICENSE.{rng.randrange(3)}" if rng.random() < 0.15 else f"f{i}.txt"
        rows[(folder + "/" if folder else "") + name] = rng.choice(notes) if rng.random() < (0.8 if "LICENSE" in name else 0.05) else "x = 1"
    df = spark.createDataFrame(list(rows.items()), "path string, text string")
    got = license_scan.scan_licenses(df).collect()
    want = plain_inheritance([(r["path"], r["license"] if r["via"] == "own" else None, r["score"]) for r in got], 0.6)
    assert {r["path"]: r["license"] for r in got} == want and sum(r["via"] == "inherited" for r in got) > 100
    long = spark.createDataFrame([("d/a.txt", "word " * 400_000 + "\nReleased under the MIT License."), ("d/b.txt", "\n" * 100_000 + "x")], "path string, text string")
    assert {r["path"]: r["via"] for r in license_scan.scan_licenses(long).collect()} == {"d/a.txt": "own", "d/b.txt": "none"}


# Search --------------------------------------------------------------------------------------------------------------


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[n // 2 : n // 2 + 8] = x[0]  # ties
    return x


def test_nearest_codes_are_exact(spark):
    x = vectors(700, 64, 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").withColumn("b", F.lit(1))
    got = collections.defaultdict(list)
    for r in hamming.nearest_codes(df, every=100, k=10, shard_bytes=4000).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["distance"], r["vec_id"]))
    for q in range(0, 700, 100):
        want = sorted((int(((x[i] > 0) != (x[q] > 0)).sum()), i) for i in range(700) if i != q)[:10]
        assert got[q] == want


def test_nearest_by_cosine_recall_and_ties(spark):
    x = vectors(1500, 32, 2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in hamming.nearest_by_cosine(df, every=50, k=5, shard_bytes=100_000).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    y = x.astype(np.float64)
    norm, hits = np.sqrt((y * y).sum(1)), 0
    for q in range(0, 1500, 50):
        s = (y @ y[q]) / (norm * norm[q])
        s[q] = -9
        want = sorted(range(1500), key=lambda i: (-round(s[i], 12), i))[:5]
        hits += len(set(want) & {v for v, _ in got[q]})
        assert len(got[q]) == 5 and all(abs(s[v] - c) < 1e-12 for v, c in got[q])
    assert hits >= 0.9 * 5 * 30
    assert [v for v, _ in got[0]] == [750, 751, 752, 753, 754]


def test_search_leaves_out_unusable_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0]), (7, [0.5, 0.5]), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("uid", "d", "v", "shard", "rank", "_q")})
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in hamming.nearest_by_cosine(df).orderBy("query_id", "rank", "vec_id").collect()]
    assert got == [(0, 1, 50), (0, 2, 50), (0, 3, 7), (50, 1, 0), (50, 1, 0), (50, 2, 50), (50, 2, 50), (50, 3, 7), (50, 3, 7)]
    assert [(r["query_id"], r["vec_id"]) for r in hamming.nearest_codes(df).orderBy("query_id", "rank").collect()] == [(0, 50), (0, 50), (0, 7)]
    assert hamming.nearest_by_cosine(df.limit(0)).count() == 0 and hamming.nearest_codes(df.limit(0)).count() == 0


def test_vectors_of_several_lengths_and_sizes(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(3 if i % 3 else 70) * 10.0 ** (rng.integers(-170, 170) if i % 2 else 0)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    by_cosine, by_sign = collections.defaultdict(list), collections.defaultdict(list)
    for r in hamming.nearest_by_cosine(df, every=10, k=4, bits=128, shard_bytes=20_000).orderBy("query_id", "rank").collect():
        by_cosine[r["query_id"]].append((r["vec_id"], r["score"]))
    for r in hamming.nearest_codes(df, every=10, k=4, least=20).orderBy("query_id", "rank").collect():
        by_sign[r["query_id"]].append((r["distance"], r["vec_id"]))
    x = [np.array(v) / np.abs(v).max() for _, v in rows]
    hits = 0
    for q in range(0, 300, 10):
        others = [i for i in range(300) if i != q and len(x[i]) == len(x[q])]
        score = {i: x[i] @ x[q] / np.sqrt((x[i] @ x[i]) * (x[q] @ x[q])) for i in others}
        want = sorted(others, key=lambda i: -score[i])[:4]  # noqa: B023
        assert len(by_cosine[q]) == 4 and all(abs(score[i] - s) < 1e-12 for i, s in by_cosine[q])
        hits += len(set(want) & {i for i, _ in by_cosine[q]})
        assert by_sign[q] == sorted((int(((x[i] > 0) != (x[q] > 0)).sum()), i) for i in others)[:4]
    assert hits >= 0.9 * 4 * 30


def test_rows_moved_grow_with_the_table(spark):
    rows = spark.range(4000).select(F.col("id").alias("uid"), F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("v"), F.lit(1).alias("d"))
    seen = []
    build = lambda uid, ids, data, d: hamming._Cosines(uid, ids, data, d, 1, np.ones((1, 8)), 8)
    for n, every in ((1000, 500), (4000, 2000)):
        found = hamming._in_shards(rows.where(f"uid < {n}"), F.lit(8), every, build, __import__("pyarrow").float64(), 800, 10**9)
        seen.append(found.count())
    # One answer of each of two queries from each shard of a hundred rows.
    assert seen == [20, 80]


# Pipeline ------------------------------------------------------------------------------------------------------------


def test_pipeline_stages_against_plain_versions(spark):
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages, tables = dict(P.STAGES), {"documents": [tuple(r) for r in docs.select(*P.COLUMNS).collect()]}
    before = "documents"
    for name in list(stages)[:-1]:
        docs = P.materialize(stages[name](spark, docs, sf), f"test-{name}")
        assert sorted(docs.columns) == sorted(P.COLUMNS)
        tables[name] = [tuple(r) for r in docs.select(*P.COLUMNS).collect()]
        assert 0 < len(tables[name]) <= len(tables[before])
        before = name

    # Rejected documents go, the others stay as they are.
    model = ordinal_quality.fit_on(spark.read.parquet(f"{sf}/documents.parquet"), ordinal_quality.label_grades(spark.read.parquet(f"{sf}/labels.parquet")), 3)
    score = np.array([sum(model.weights.get(k, 0.0) * v for k, v in ordinal_quality.features(r[1]).items()) for r in tables["documents"]])
    stay = model.tails(score)[:, -1]
    sure = [r for r, p in zip(tables["documents"], stay, strict=True) if p >= 0.5 + 1e-6]
    unsure = [r for r, p in zip(tables["documents"], stay, strict=True) if abs(p - 0.5) < 1e-6]
    assert set(sure) <= set(tables["quality"]) <= set(sure) | set(unsure)

    # Lines over a tenth of a source's documents, and five, go.
    pages, held = collections.Counter(r[3] for r in tables["quality"]), collections.Counter()
    for r in tables["quality"]:
        held.update({(r[3], x.strip(" ")) for x in r[1].split("\n") if x.strip(" ")})
    cut = lambda r: "\n".join(x for x in r[1].split("\n") if not x.strip(" ") or held[r[3], x.strip(" ")] < 5 or held[r[3], x.strip(" ")] <= 0.1 * pages[r[3]])
    assert sorted(tables["lines"]) == sorted((r[0], t := cut(r), r[2], r[3], len(t)) for r in tables["quality"])

    # Of each group of near duplicates the smallest id stays.
    groups = plain_components([(r[0], r[1]) for r in tables["lines"]], 5, 80)
    least = {d for d, n, c in groups if n == 0 or d == c}
    assert sorted(tables["near_duplicates"]) == sorted(r for r in tables["lines"] if r[0] in least)

    # Later copies of 200 bytes go; what is left of cut characters too.
    seen, want = set(), []
    for r in sorted(tables["near_duplicates"]):
        b = r[1].encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            x = b[i : i + 200]
            if x in seen:
                gone[i : i + 200] = b"\1" * 200
            seen.add(x)
        t = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        want.append((r[0], t, r[2], r[3], len(t)))
    assert sorted(tables["repeats"]) == sorted(want)

    pieces = stages["packing"](spark, docs, sf).collect()
    t = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    sizes = collections.Counter()
    for p in pieces:
        sizes[p["doc_id"]] += p["length"]
    assert sizes == {r[0]: len(t.encode(r[1], add_special_tokens=False).ids) + 1 for r in tables["repeats"]}
    assert P.run(spark, sf).count() == len(pieces)


def test_pipeline_of_odd_rows_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    passage = prose(80)
    rows = odd_rows() + [(i, prose(40) + "\nmenu\n" + (passage if i % 12 == 0 else "")) for i in range(100, 160)] + [(200, prose(250_000)), (300, prose(60))]
    rows += [(301, rows[-1][1]), (None, None), (None, rows[-1][1])]
    clash = {c: F.lit("clash") for c in ("grade", "keep", "rid", "keeps", "marks", "kept", "k1", "first", "label", "part", "ids", "_c0", "_h", "n", "pages")}
    docs = documents(spark, rows, extra=False).withColumn("source", F.when(F.col("doc_id") != 300, F.col("source"))).withColumns(clash)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    none.write.parquet(str(tmp_path / "labels.parquet"))
    stages, now = dict(P.STAGES), docs
    seen = {}
    for name in list(stages)[:-1]:
        now = P.materialize(stages[name](spark, now, str(tmp_path)), f"odd-{name}")
        assert sorted(now.columns) == sorted(P.COLUMNS)
        seen[name] = now.collect()
        now = now.withColumns(clash)
        assert stages[name](spark, docs.limit(0), str(tmp_path)).count() == 0
    assert len(seen["quality"]) == len(rows) == len(seen["lines"])
    assert not any("menu" in (r["text"] or "") for r in seen["lines"] if r["source"]) and sum(r["text"] is None for r in seen["lines"]) == 2
    kept = seen["near_duplicates"]
    assert sum(r["text"] == rows[-1][1] for r in kept) == 1 and min(r["doc_id"] for r in kept if r["text"] == rows[-1][1]) == 300
    assert sum(r["text"] in (None, "", " \n\t ") for r in kept) == 4
    assert sum(passage[20:400] in r["text"] for r in seen["repeats"]) == 1 and all(r["text"] is not None for r in seen["repeats"])
    pieces = P.run(spark, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in kept} and stages["packing"](spark, docs.limit(0), "").count() == 0


def test_pipeline_stages_reject_and_keep(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = P.quality(spark, docs, sf).select("doc_id").withColumn("k", F.lit(1))
    rows = labels.join(kept, "doc_id", "left").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.count("k").alias("k")).collect()
    share = {(r["quality"], r["toxic"]): r["k"] / r["n"] for r in rows}
    assert share[1, 0] >= 0.95 and all(v <= 0.1 for g, v in share.items() if g != (1, 0))


def test_line_dedup_of_long_tied_and_repeated_rows(spark):
    lines = "\n".join(f"line {i}" for i in range(60_000))
    rows = [(1, lines + "\ncommon", "a"), (2, "common\n" * 20_000, "a"), (3, "x\ncommon", "a"), (3, "x\ncommon", "a"), (4, "tie", "b"), (5, "tie", "b"), (6, "u", "b"), (7, "v", "b")]
    docs = documents(spark, rows).withColumns({c: F.lit("clash") for c in ("_h", "_k", "gone", "lines", "h1", "pages", "df")})
    got = collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"], r["gone"]) for r in line_dedup.drop_boilerplate(docs, max_ratio=0.5, min_pages=2, carry=("gone",)).collect())
    want = [(1, 60_001, 1, lines), (2, 20_001, 20_000, ""), (3, 2, 1, "x"), (3, 2, 1, "x"), (4, 1, 0, "tie"), (5, 1, 0, "tie"), (6, 1, 0, "u"), (7, 1, 0, "v")]
    assert got == collections.Counter((*r, "clash") for r in want)


def test_registered_queries_equal_their_sql(spark):
    import os

    import duckdb

    from gleaner.llm.queries import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{t}')")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, sf)
        cols = sorted(df.columns)
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        want = sorted(repr([r[names.index(c)] for c in cols]) for r in cur.fetchall())
        assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == want, name


# What the operators promise about hot keys -----------------------------------------------------------------------------


def test_hot_bucket_is_cut_into_squares(spark):
    named = spark.range(5000).selectExpr("id as rid", "7L as key", "5000L as m", "100 + id % 3 as n", "0L as u", "id % 2 as label", "0 as skip", "cast(array() as array<long>) as prev", "0L as class")
    a, b = J.bucket_sides(named)
    cell = ["key", "class", "across", "down"]
    assert max(r["count"] for side in (a, b) for r in side.groupBy(*cell).count().collect()) <= J.SQUARE
    met = a.join(b, cell).where("ridx < ridy").agg(F.count("*").alias("n"), F.countDistinct("ridx", "ridy").alias("d")).head()
    assert met["n"] == met["d"] == 5000 * 4999 // 2


def test_heaviest_keys_are_split_however_many_are_large(spark):
    rows = spark.range(3000).selectExpr("if(id < 1500, 0, id % 100 + 1) as key", "id as i")
    table = rows.groupBy("key").agg(F.count("*").alias("m"))
    out = join_counted(rows, table, "key", limit=2, most=5)
    assert sorted(map(tuple, out.select("key", "i", "m").collect())) == sorted(map(tuple, rows.join(table, "key").select("key", "i", "m").collect()))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and f"> {3000 // 5}" in plan.replace("m#", "").replace("L", "") or "> 600" in plan


def test_every_mark_comes_from_a_block(spark, monkeypatch):
    rows = [(i, "x" * 10 + "same passage of words " * 30 + str(i)) for i in range(6)] + [(9, "y" * 400), (10, "y" * 400)]
    docs = documents(spark, rows, extra=False).withColumn("k1", F.xxhash64("text"))
    for keep in ("none", "first"):
        assert S.repeated_starts(docs, 50, keep, gram=16).count() > 0
    none = lambda window, keep: lambda batches: iter(())
    monkeypatch.setattr(S, "_suffix_blocks", none)
    monkeypatch.setattr(S, "_run_blocks", none)
    for keep in ("none", "first"):
        assert S.repeated_starts(docs, 50, keep, gram=16).count() == 0


def test_block_marks_by_factors_and_not_by_count():
    # Both rows claim to occur again under one digest; the order of the block alone says what repeats.
    assert S._marked_ranges([b"abcdefghi"], 9, "none", [False]) == {}
    rows = [{"doc_id": 1, "k1": 0, "lo": 5, "bytes": b"abcdefgh", "twice": False, "kh": 1, "c1": 1, "c2": 1}, {"doc_id": 2, "k1": 0, "lo": 0, "bytes": b"zzbcdefgy", "twice": False, "kh": 1, "c1": 2, "c2": 2}]
    assert S._block(rows, 6, "none").to_pydict()["a"] == [6, 2] and S._block(rows, 6, "first").to_pydict()["doc_id"] == [2]
    twice = S._block([rows[0] | {"twice": True}], 6, "first").to_pylist()
    assert [(r["doc_id"], r["c1"], r["later"]) for r in twice] == [(None, 1, [{"a": 0, "b": 2}])]


@pytest.mark.parametrize("hot", [2, 10**6])
def test_hot_boilerplate_lines_are_sent_to_positions(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rows = [(i, f"own {i}\nfooter\n footer \nshared {i % 3}", "h") for i in range(30)] + [(40, "footer\nx", None)]
    got = {r["doc_id"]: (r["n_dropped"], r["text"]) for r in line_dedup.drop_boilerplate(documents(spark, [(i, t, s) if s else (i, t) for i, t, s in rows], extra=False), host="source").collect()}
    assert got[0] == (3, "own 0") and got[40] == (0, "footer\nx") and len(got) == 31


def test_join_of_very_long_texts(spark):
    """Sets of over two megabytes of text each, linked and not linked."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**9)}" for _ in range(220_000)]
    other = words[:110_000] + [f"v{i}" for i in range(110_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-500])), (3, " ".join(other)), (4, "short text of five words")]
    assert len(rows[0][1]) > 2_000_000
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.link_documents(documents(spark, rows, extra=False), width=4, percent=85).collect()}
    assert got == {1: (219_997, 1), 2: (219_497, 1), 3: (219_997, 3), 4: (2, 4)}
