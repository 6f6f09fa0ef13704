"""Exact removal of repeated passages with suffix order and longest-previous-factor arrays, in blocks.

The unit is a window: a string of ``window`` bytes at one start. A global suffix array would compare windows that can
have nothing in common, so windows are first dealt into blocks by content:

* Of the ``gram``-byte strings inside a window the one with the smallest hash (leftmost of equals) is its anchor. Equal
  windows have equal anchors at equal offsets. Consecutive starts with one anchor form a segment, so a document is cut
  into about two segments for every window - gram bytes, and only the anchor's hash and a 128-bit BLAKE2b digest of the
  segment's context (all bytes of its windows) are shuffled.
* Segments are put in one order by anchor, context and position, by range: a context in very many documents lies in as
  many partitions as its rows need, and no row is joined to another. Looking at its neighbours, each row learns whether
  its anchor and its context occur again and whether it is the context's first; for the ends of partitions the driver
  compares one key of each with the next. Anchors that occur once go.
* The first rows of contexts are fetched and dealt by anchor into blocks. Each block is one text; a context that occurs
  more than once counts as two in it, its first and its later copies. The block's suffixes (at starts of windows,
  compared up to ``window`` bytes) are put in order by ranks of three times longer strings in each round. From that
  order and its LCP array follow the previous and next smaller positions, and from these the longest previous factor of
  each start: at ``window`` it has an earlier copy. Its mirror is the longest next factor. Nothing is marked but by these.
* What a block says of a context's later copies holds for all their rows: where blocks found every repeated context to
  repeat as a whole, all later rows do; else rows take their ranges in a join by context. Contexts alone
  under their anchor need no others in their block: neighbours in a document are one run of text there, without a
  shuffle. That rows have one context is known by 128-bit digests; later copies' bytes aren't fetched for a comparison.
* An anchor with more than HOT distinct contexts (a passage in very many documents) isn't gathered in one task. Its
  contexts are split in two by the windows' offset to the anchor, each half under a longer anchor: the bytes that all
  windows of that range of offsets share. Inside a passage halves become equal and count as one, at its ends they
  become unique; what is still too large is split again, down to single windows. Each round at most doubles its rows.

keep="first" removes what the LPF array marks (later copies), keep="none" what it or its mirror marks (every copy).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import discard, join_counted, materialize, row_key, texts_of
from gleaner.llm.shingles import U, mix

#: Bytes of an anchor; contexts of one anchor, and rows of one context, that are handled in one task.
GRAM, HOT, COPIES = 64, 256, 2_000
#: Bytes handled at once, and starts and bytes of a block.
PIECE, BLOCK, BLOCK_BYTES, RUN = 1 << 18, 20_000, 1 << 17, 1 << 15

_RNG = np.random.default_rng(77003)
_BYTE = _RNG.integers(0, 2**63 - 1, 256, dtype=np.int64).astype(U) * U(2) + _RNG.integers(0, 2, 256).astype(U)
_B = 0xD1342543DE82EF95


# Segments ------------------------------------------------------------------------------------------------------------


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out, out=out)


class _Rolling:
    """Hashes of any substring of data in constant time each."""

    power = inverse = np.zeros(0, U)

    def __init__(self, data: np.ndarray):
        if len(self.power) <= len(data):
            size = max(PIECE + PIECE // 4, len(data) + len(data) // 4)
            _Rolling.power, _Rolling.inverse = _powers(_B, size), _powers(pow(_B, -1, 2**64), size)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTE[data] * self.power[: len(data)], out=self.sums[1:])


def _segments(data: np.ndarray, owner_start: np.ndarray, owner_end: np.ndarray, window: int, gram: int):
    """(owner, first start, last start, anchor from there, anchor hash) of all segments of the owners' ranges of data."""
    w = window - gram + 1
    n = len(data) - gram + 1
    if n < w:
        return None
    roll = _Rolling(data)
    h = mix((roll.sums[gram:] - roll.sums[:n]) * roll.inverse[:n])
    bits = U(22)
    key = (h >> bits << bits) | np.arange(n, dtype=U)
    full = np.full(-(-n // w) * w, np.iinfo(U).max, dtype=U)
    full[:n] = key
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[: n - w + 1], ahead[w - 1 : n]) & U((1 << 22) - 1)).astype(np.int64)
    count = np.maximum(owner_end - owner_start - window + 1, 0)
    at = np.repeat(owner_start - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    if not len(at):
        return None
    a = anchor[at]
    owner = np.repeat(np.arange(len(count)), count)
    turn = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (owner[1:] != owner[:-1]))))
    lo = at[turn]
    hi = at[np.concatenate((turn[1:], [len(at)])) - 1]
    return owner[turn], lo, hi, a[turn] - lo, h[a[turn]].view(np.int64)


def _digests(parts: Iterator[bytes]) -> np.ndarray:
    """128-bit digests as two columns of int64."""
    return np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in parts]), "<i8").reshape(-1, 2)


def _pieces(texts: list[bytes], window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes): pieces that hold every window once, long texts cut with window - 1 bytes of overlap."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for off in range(0, max(1, len(t) - window + 1), PIECE):
            piece = t[off : off + PIECE + window - 1]
            if len(piece) < window:
                continue
            if size and size + len(piece) > PIECE:
                yield group
                group, size = [], 0
            group.append((i, off, piece))
            size += len(piece)
    if group:
        yield group


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that only a slice is held as Python objects."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


_ROW = "doc_id long, k1 long, lo int, more int, at int, kh long, c1 long, c2 long"
_NAMES = ["doc_id", "k1", "lo", "more", "at", "kh", "c1", "c2"]


def _cut(window: int, gram: int):
    """Texts to rows of _ROW: each segment's first start, further starts, place of the anchor, anchor's hash and context's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in _slices(batches, 1000):
                for group in _pieces(texts_of(batch.column("text")), window):
                    size = np.array([len(x) for _, _, x in group])
                    start = np.concatenate(([0], np.cumsum(size)[:-1]))
                    data = b"".join(x for _, _, x in group)
                    found = _segments(np.frombuffer(data, np.uint8), start, start + size, window, gram)
                    if found is None:
                        continue
                    owner, lo, hi, at, kh = found
                    c = _digests(data[a:b] for a, b in zip(lo.tolist(), (hi + window).tolist(), strict=True))
                    place = lo - start[owner] + np.array([x for _, x, _ in group])[owner]
                    row = pa.array(np.array([x for x, _, _ in group])[owner])
                    small = [pa.array(x.astype(np.int32)) for x in (place, hi - lo, at)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("k1").take(row), *small, pa.array(kh), pa.array(c[:, 0]), pa.array(c[:, 1])], _NAMES)

    return run


# Order of all segments -----------------------------------------------------------------------------------------------


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with part, first (of their context) and twice (their context occurs again), without anchors that occur once.

    The ends of a part are kept and taken as ends of their contexts; what lies beyond them is added later.
    """
    part = TaskContext.get().partitionId()
    held, before = None, None

    def flagged(rows: pa.RecordBatch, prior, end: bool):
        keys = [rows.column(c).to_numpy() for c in ("kh", "c1", "c2")]
        n = rows.num_rows
        kh, ctx = np.zeros(n + 1, bool), np.zeros(n + 1, bool)  # the row agrees with the one before it
        kh[1:n] = keys[0][1:] == keys[0][:-1]
        ctx[1:n] = kh[1:n] & (keys[1][1:] == keys[1][:-1]) & (keys[2][1:] == keys[2][:-1])
        if prior is not None:
            kh[0] = prior[0] == keys[0][0]
            ctx[0] = prior == tuple(k[0] for k in keys)
        stay = kh[:-1] | kh[1:]
        stay[0] |= prior is None
        m = n if end else n - 1
        stay[-1] |= end
        out = [*rows.columns, pa.array(np.full(n, part, np.int32)), pa.array(~ctx[:-1]), pa.array(ctx[:-1] | ctx[1:])]
        out = pa.RecordBatch.from_arrays(out, [*rows.schema.names, "part", "first", "twice"]).slice(0, m).filter(pa.array(stay[:m]))
        return out, tuple(k[m - 1] for k in keys) if m else prior

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        out, before = flagged(batch, before, end=False)
        if out.num_rows:
            yield out
        held = batch.slice(batch.num_rows - 1)
    if held is not None:
        yield flagged(held, before, end=True)[0]


def _ordered(rows: DataFrame) -> DataFrame:
    """rows of anchors that occur more than once, with first and twice; positions are ordered by doc_id (null last), k1 and lo."""
    order = ["kh", "c1", "c2", F.col("doc_id").asc_nulls_last(), "k1", "lo"]
    shape = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", part int, first boolean, twice boolean"
    made = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, shape), "suffix-order")
    key = F.struct("kh", "c1", "c2")
    ends = sorted(map(tuple, made.groupBy("part").agg(F.min(key).alias("a"), F.max(key).alias("b")).collect()))  # one row a partition
    across = [(p, *tuple(b)) for (p, _, b), (_, a, _) in zip(ends, ends[1:], strict=False) if a == b]
    onward = [(q, *tuple(a)) for (_, _, b), (q, a, _) in zip(ends, ends[1:], strict=False) if a == b]
    if not across:
        return made
    marks = {k: (k in set(onward)) for k in across + onward}
    spark = rows.sparkSession
    known = spark.createDataFrame([(*k, late) for k, late in marks.items()], "part int, kh long, c1 long, c2 long, late boolean")
    out = made.join(F.broadcast(known), ["part", "kh", "c1", "c2"], "left")
    out = out.withColumns({"first": F.col("first") & ~F.coalesce("late", F.lit(False)), "twice": F.col("twice") | F.col("late").isNotNull()}).drop("late")
    out.__dict__["_stage_path"] = made.__dict__["_stage_path"]
    return out


# Suffix order, LCP and LPF -------------------------------------------------------------------------------------------


def suffix_order(data: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the given ascending starts, and its LCP array, both cut at window bytes; every start has that many.

    Equal suffixes lie in the order of their starts. lcp[r] is that of the suffixes at r - 1 and r; lcp[0] is 0.
    """
    n = len(data)
    if not len(starts):
        return starts, np.zeros(0, np.int64)
    fold = 3 if n < 1 << 21 else 2
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    word = np.zeros(n + 1, U)
    for i in range(8):
        word[:n] |= padded[i : i + n].astype(U) << U(8 * (7 - i))
    if window < 8:
        word = word >> U(8 * (8 - window)) << U(8 * (8 - window))
    levels, size = [], min(8, window)
    key = word
    while True:
        # Ranks of the strings of this size at all places; the last place stands for all beyond the end.
        order = np.argsort(key[:n])
        turn = np.concatenate(([1], (key[order][1:] != key[order][:-1]).astype(np.int64)))
        rank = np.zeros(n + 1, np.int64)
        rank[order] = np.cumsum(turn)
        levels.append((size, rank))
        if size * fold >= window:
            break
        bits = 63 // fold
        key = rank.copy()
        for i in range(1, fold):
            key = key << bits | rank[np.minimum(np.arange(n + 1) + i * size, n)]
        size *= fold
    bits = 63 // fold
    rank, key = levels[-1][1], np.zeros(len(starts), np.int64)
    for off in ([0, min(size, window - size), window - size] if fold == 3 else [0, window - size]):
        key = key << bits | rank[starts + off]
    order = np.argsort(key, kind="stable")
    sa, key = starts[order], key[order]
    # The LCP: as many of the longest strings as agree, then of the shorter ones, then bytes.
    lcp = np.zeros(len(sa), np.int64)
    differ = np.flatnonzero(key[1:] != key[:-1]) + 1
    lcp[1:] = window
    a, b, l = sa[differ - 1], sa[differ], np.zeros(len(differ), np.int64)  # noqa: E741
    for size, rank in reversed(levels):
        for _ in range(fold - 1):
            l += np.where(rank[np.minimum(a + l, n)] == rank[np.minimum(b + l, n)], size, 0)  # noqa: E741
    x = word[np.minimum(a + l, n)] ^ word[np.minimum(b + l, n)]
    for i in range(1, 8):
        l += x >> U(64 - 8 * i) == 0  # noqa: E741
    lcp[differ] = np.minimum(l, window)
    return sa, lcp


def _towards_smaller(sa: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each rank the LCP with the nearest rank before it that has a smaller position; 0 without one.

    Every rank looks at the one before it, and from a larger position goes on to where that one looks by now: all
    positions passed over are larger still. Where nothing is in common any more the search ends.
    """
    look, common = np.arange(len(sa)) - 1, lcp.copy()
    common[:1] = 0
    on = np.flatnonzero(common)
    on = on[sa[look[on]] > sa[on]]
    while len(on):
        past = look[on]
        common[on], look[on] = np.minimum(common[on], common[past]), look[past]
        on = on[common[on] > 0]
        on = on[sa[look[on]] > sa[on]]
    return common


def longest_previous_factors(sa: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each rank of a suffix array how much of its suffix also starts at a smaller position.

    The best earlier match of a suffix is the nearest one in suffix order, before or after it, with a smaller position:
    LPF is the larger of the two LCPs.
    """
    back = np.concatenate(([0], lcp[1:][::-1]))
    return np.maximum(_towards_smaller(sa, lcp), _towards_smaller(sa[::-1], back)[::-1])


def marked_starts(contexts: list[bytes], window: int, keep: str, twice: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(context, start) of all starts with a copy elsewhere in the contexts (keep="none") or before them (keep="first").

    The contexts one after the other are the text: positions are ordered by context, then start. Those marked twice
    follow a second time behind all others, as contexts len(contexts) + i; they are sorted once, their suffixes stand
    in the order twice.
    """
    size = np.array([len(x) for x in contexts])
    count = size - window + 1
    ctx = np.repeat(np.arange(len(size)), count)
    off = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin, n = np.cumsum(size) - size, int(size.sum())
    sa, lcp = suffix_order(np.frombuffer(b"".join(contexts), np.uint8), begin[ctx] + off, window)
    if twice is not None and any(twice):
        times = 1 + np.array(twice, np.int64)[np.searchsorted(begin, sa, side="right") - 1]
        rank = np.repeat(np.arange(len(sa)), times)
        second = np.concatenate(([False], rank[1:] == rank[:-1]))
        sa, lcp = sa[rank] + n * second, np.where(second, window, lcp[rank])
    whole = lcp >= window
    some = whole | np.concatenate((whole[1:], [False]))  # ranks beside an equal window; the others' factors are below window
    sa, lcp = sa[some], np.where(whole, lcp, 0)[some]
    if len(sa):
        factor = longest_previous_factors(sa, lcp)
        if keep == "none":
            factor = np.maximum(factor, longest_previous_factors(sa.max() - sa, lcp))  # the longest next factors
        sa = sa[factor >= window]
    second, sa = sa >= n, np.where(sa >= n, sa - n, sa)
    at = np.searchsorted(begin, sa, side="right") - 1
    return at + len(contexts) * second, sa - begin[at]


# Blocks --------------------------------------------------------------------------------------------------------------


_PART = pa.list_(pa.struct([("lo", pa.int32()), ("more", pa.int32()), ("kh", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64())]))
_BYTES = "doc_id long, k1 long, lo int, more int, at int, kh long, c1 long, c2 long, m long, twice boolean, bytes binary, parts array<struct<lo: int, more: int, kh: long, c1: long, c2: long>>"
_FIELDS = [("lo", pa.int32()), ("more", pa.int32()), ("at", pa.int32()), ("kh", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("m", pa.int64()), ("twice", pa.bool_())]


def _runs(wanted: list[dict]) -> Iterator[list[dict]]:
    """Segments that follow each other without a gap, at most RUN starts together."""
    run, size = [], 0
    for x in sorted(wanted, key=lambda x: x["lo"]):
        if run and (x["lo"] != run[-1]["lo"] + run[-1]["more"] + 1 or size >= RUN):
            yield run
            run, size = [], 0
        run.append(x)
        size += x["more"] + 1
    if run:
        yield run


def _contexts(window: int, hot: int):
    """Rows (text, wanted: array of segments) to the segments' bytes; runs of repeated contexts as rows with parts and m = 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 500):
            texts = texts_of(batch.column("text"))
            for i, wanted in enumerate(batch.column("wanted")):
                wanted = wanted.as_py()
                rows = [x | {"parts": None} for x in wanted if x["m"] > 1]
                for parts in _runs([x for x in wanted if x["twice"] and (x["m"] == 1 or x["m"] > hot)]):
                    rows.append(parts[0] | {"more": parts[-1]["lo"] + parts[-1]["more"] - parts[0]["lo"], "m": 0, "parts": parts})
                for a in range(0, len(rows), 4096):
                    part = rows[a : a + 4096]
                    same = [pa.array([batch.column(c)[i].as_py()] * len(part), pa.int64()) for c in ("doc_id", "k1")]
                    own = [pa.array([x[c] for x in part], t) for c, t in _FIELDS]
                    data = pa.array([texts[i][x["lo"] : x["lo"] + x["more"] + window] for x in part], pa.binary())
                    yield pa.RecordBatch.from_arrays([*same, *own, data, pa.array([x["parts"] for x in part], _PART)], ["doc_id", "k1", *[c for c, _ in _FIELDS], "bytes", "parts"])

    return run


def _ranges(owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts of one owner: (owner, first, last)."""
    if not len(owner):
        return owner, start, start
    o = np.lexsort((start, owner))
    owner, start = owner[o], start[o]
    turn = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1))))
    return owner[turn], start[turn], start[np.concatenate((turn[1:], [len(start)])) - 1]


#: Marked starts of a context's first row, or (doc_id to b null) of the later rows of a context, from its begin.
_MARKS = "doc_id long, k1 long, a long, b long, kh long, c1 long, c2 long, later array<struct<a: long, b: long>>"
_LATER = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _marks(firsts: list[tuple], laters: list[tuple]) -> pa.RecordBatch:
    """firsts: (doc_id, k1, a, b); laters: (kh, c1, c2, ranges)."""
    rows = [(*f, None, None, None, None) for f in firsts] + [(None, None, None, None, *x[:3], [{"a": a, "b": b} for a, b in x[3]]) for x in laters]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i < 7 else _LATER) for i in range(8)], ["doc_id", "k1", "a", "b", "kh", "c1", "c2", "later"])


def _marked_ranges(texts: list[bytes], window: int, keep: str, twice: list[bool]) -> dict[int, list[tuple[int, int]]]:
    """By text, the ranges of marked starts; of a text's second copy under len(texts) + its number."""
    out: dict[int, list] = {}
    for o, a, b in zip(*(x.tolist() for x in _ranges(*marked_starts(texts, window, keep, twice))), strict=True):
        out.setdefault(o, []).append((a, b))
    return out


def _block(rows: list[dict], window: int, keep: str) -> pa.RecordBatch:
    """Marks of contexts under the same anchors; one that occurs again counts as two, the second behind all others."""
    rows = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["k1"], r["lo"]))
    found = _marked_ranges([r["bytes"] for r in rows], window, keep, [r["twice"] for r in rows])
    firsts = [(r["doc_id"], r["k1"], r["lo"] + a, r["lo"] + b) for i, r in enumerate(rows) for a, b in found.get(i, ())]
    return _marks(firsts, [(r["kh"], r["c1"], r["c2"], found[i]) for i, r in enumerate(rows, len(rows)) if i in found])


def _run_block(rows: list[dict], window: int, keep: str) -> pa.RecordBatch:
    """Marks of runs of repeated contexts, each counting as two. With keep="first" nothing is said of their first copies."""
    found = _marked_ranges([r["bytes"] for r in rows], window, keep, [True] * len(rows))
    firsts = [(r["doc_id"], r["k1"], r["lo"] + a, r["lo"] + b) for i, r in enumerate(rows) for a, b in found.get(i, ())] if keep == "none" else []
    laters = []
    for i, r in enumerate(rows, len(rows)):
        for p in r["parts"]:
            lo, hi = p["lo"] - r["lo"], p["lo"] - r["lo"] + p["more"]
            own = [(max(a, lo) - lo, min(b, hi) - lo) for a, b in found.get(i, ()) if a <= hi and b >= lo]
            if own:
                laters.append((p["kh"], p["c1"], p["c2"], own))
    return _marks(firsts, laters)


def _suffix_blocks(window: int, keep: str):
    """Contexts sorted by anchor to their marks; blocks hold whole groups, of at most HOT contexts each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, starts, size, last = [], 0, 0, None
        for batch in _slices(batches, 1000):
            for r in batch.to_pylist():
                if r["kh"] != last and (starts >= BLOCK or size >= BLOCK_BYTES):
                    yield _block(held, window, keep)
                    held, starts, size = [], 0, 0
                held.append(r)
                size += len(r["bytes"])
                starts += len(r["bytes"]) - window + 1
                last = r["kh"]
        if held:
            yield _block(held, window, keep)

    return run


def _run_blocks(window: int, keep: str):
    """Rows with parts to their marks, in whatever order they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in _slices(batches, 200):
            for r in batch.to_pylist():
                if size >= BLOCK_BYTES:
                    yield _run_block(held, window, keep)
                    held, size = [], 0
                held.append(r)
                size += len(r["bytes"])
        if held:
            yield _run_block(held, window, keep)

    return run


def _halves(window: int, shift: int):
    """Contexts to their parts by the offset to the anchor, in steps of 2 ** shift, each under the bytes its windows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1024):
            out: list[tuple] = []
            own: list[bytes] = []
            for r in batch.to_pylist():
                x, at = r["bytes"], r["at"]
                least = at - (len(x) - window)
                for g in range(least >> shift, (at >> shift) + 1):
                    a0, a1 = g << shift, ((g + 1) << shift) - 1
                    high, low = min(a1, at), max(a0, least)
                    own.append(x[at - high : at - low + window])
                    shared = xxhash.xxh3_64_intdigest(x[at - a0 : at - a1 + window], seed=a0 & 0xFFFFFFFF)
                    out.append((r["doc_id"], r["k1"], r["lo"] + at - high, high - low, high, shared - (shared >> 63 << 64)))
            if out:
                c = _digests(x + b"%d,%d" % (r[4], r[3]) for x, r in zip(own, out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
                cols = [pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(own, pa.binary())], [*_NAMES, "bytes"])

    return run


def _fetch(wanted: DataFrame, docs: DataFrame, window: int, hot: int) -> DataFrame:
    """The contexts' bytes, from their documents."""
    wanted = wanted.groupBy("doc_id", "k1").agg(F.collect_list(F.struct(*[c for c, _ in _FIELDS])).alias("wanted"))
    wanted = wanted.select(F.col("doc_id").alias("d"), F.col("k1").alias("k"), "wanted")
    fetched = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k1") == F.col("k"))).select("doc_id", "k1", "text", "wanted")
    return fetched.mapInArrow(_contexts(window, hot), _BYTES)


def repeated_starts(docs: DataFrame, window: int = 200, keep: str = "none", gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, k1, a, b): ranges of starts whose window also starts elsewhere (keep="none") or earlier (keep="first").

    docs: doc_id, k1 (row_key of the text), text; no two rows agree in doc_id and k1. Positions are ordered by doc_id
    (null last), k1 and offset. The result reads stage tables, which only_result() deletes.
    """
    docs = docs.select("doc_id", "k1", "text")
    rows = materialize(docs.mapInArrow(_cut(window, gram), _ROW), "suffix-segments")
    marks, bits, level, done = [], (window - gram + 1).bit_length(), 0, []
    context = ["kh", "c1", "c2"]
    while True:
        again = _ordered(rows)
        discard(rows)
        first = again.where("first")
        counted = materialize(first.groupBy("kh").agg(F.count("*").alias("m")), "suffix-anchors")
        wanted = join_counted(first, counted, "kh", hot).where("m > 1 or twice")
        if level == 0:
            wanted = _fetch(wanted, docs, window, hot)
        else:
            alone = F.col("twice") & ((F.col("m") == 1) | (F.col("m") > hot))
            wanted = wanted.withColumn("parts", F.when(alone, F.array(F.struct("lo", "more", *context)))).select("doc_id", "k1", *[c for c, _ in _FIELDS], "bytes", "parts")
        contexts = materialize(wanted, "suffix-bytes", compression="zstd")
        discard(counted)
        few = contexts.where(f"m between 2 and {hot}").drop("parts").repartition("kh").sortWithinPartitions("kh").mapInArrow(_suffix_blocks(window, keep), _MARKS)
        alone = contexts.where("parts is not null").mapInArrow(_run_blocks(window, keep), _MARKS)
        found = materialize(few.unionByName(alone), "suffix-found")
        marks.append(found.where("a is not null").select("doc_id", "k1", "a", "b"))
        copies, keys = again.where("not first"), again.where("first and twice").select(*context, "more")
        whole = found.where("later is not null and size(later) = 1 and later[0].a = 0").select(*context, F.col("later")[0]["b"].cast("int").alias("more"))
        odd = materialize(keys.join(whole, [*context, "more"], "left_anti").select(*context), "suffix-odd")
        if odd.isEmpty():
            # Every repeated context was found to repeat as a whole, and so does each of its later rows.
            marks.append(copies.select("doc_id", "k1", F.col("lo").cast("long").alias("a"), (F.col("lo") + F.col("more")).cast("long").alias("b")))
        else:
            later = found.where("later is not null").select(*context, "later").join(copies.groupBy(*context).agg(F.count("*").alias("m")), context)
            later = join_counted(copies.select("doc_id", "k1", "lo", *context), materialize(later, "suffix-later"), context, COPIES).select("doc_id", "k1", "lo", F.explode("later").alias("r"))
            marks.append(later.select("doc_id", "k1", (F.col("lo") + F.col("r.a")).alias("a"), (F.col("lo") + F.col("r.b")).alias("b")))
        discard(odd)
        done += [again, contexts, found]
        level += 1
        many = contexts.where(f"m > {hot}")
        if level > bits or many.isEmpty():
            break
        rows = materialize(many.mapInArrow(_halves(window, bits - level), _ROW + ", bytes binary"), "suffix-halves")
    out = marks[0]
    for m in marks[1:]:
        out = out.unionByName(m)
    out = materialize(out, "suffix-marks")
    discard(*done)
    return out


# Documents -----------------------------------------------------------------------------------------------------------


def _apply(window: int, text: bool):
    """Rows (doc_id, text, marks) to the result columns, with the kept text or without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1000):
            out = []
            for t, marks in zip(texts_of(batch.column("text")), batch.column("marks"), strict=True):
                spans: list[list[int]] = []
                for m in sorted((x["a"], x["b"]) for x in (marks.as_py() or [])):
                    if spans and m[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], m[1] + window)
                    else:
                        spans.append([m[0], m[1] + window])
                kept = b"".join(t[a:b] for a, b in zip([0] + [s[1] for s in spans], [s[0] for s in spans] + [len(t)], strict=True)) if spans else t
                out.append({"n_bytes": len(t), "n_removed": len(t) - len(kept), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept).hexdigest()} | ({"kept": kept.decode("utf-8", "ignore"), "spans": [{"start": a, "end": b} for a, b in spans]} if text else {}))
            types = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + ([("kept", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))] if text else [])
            cols = [batch.column(i) for i in range(batch.num_columns - 2)] + [pa.array([r[c] for r in out], kind) for c, kind in types]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:-2], *[c for c, _ in types]])

    return run


def remove_repeats(docs: DataFrame, window: int = 200, keep: str = "first", with_text: bool = True, carry: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, carried columns, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, kept (bytes that no longer form a character go) and spans.

    Bytes covered by a marked window go. Null and short texts have no window and are kept whole. Rows that agree in
    doc_id and text share one result: with keep="none" all repeat each other, with keep="first" a copy within such rows
    is the first in each. Other columns of docs, whatever their names, play no part; carried ones may have any name but
    those of the result. An empty table gives an empty result.
    """
    held = [f"_c{i}" for i in range(len(carry))]
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(F.col(text)).alias("k1"), *[F.col(c).alias(h) for c, h in zip(carry, held, strict=True)], F.col(text).alias("text"))
    # Rows that agree in id and text are one here; they repeat as a whole, if they have a window at all.
    alike = materialize(own.groupBy("doc_id", "k1").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size")).where("n > 1"), "suffix-alike")
    single = own.select("doc_id", "k1", "text")
    some = not alike.isEmpty()
    marks = repeated_starts(single.dropDuplicates(["doc_id", "k1"]) if some else single, window, keep, gram, hot)
    if some and keep == "none":
        marks = marks.unionByName(alike.where(f"size >= {window}").select("doc_id", "k1", F.lit(0).cast("long").alias("a"), (F.col("size") - window).cast("long").alias("b")))
    marks = marks.groupBy("doc_id", "k1").agg(F.collect_list(F.struct("a", "b")).alias("marks"))
    marks = marks.select(F.col("doc_id").alias("_d"), F.col("k1").alias("_k"), "marks")
    rows = own.join(marks, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("k1") == F.col("_k")), "left").select("doc_id", *held, "text", "marks")
    kinds = dict(rows.dtypes)
    shape = ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *held)) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string, spans array<struct<start: long, end: long>>" if with_text else "")
    out = rows.mapInArrow(_apply(window, with_text), shape)
    return out.select("doc_id", *[F.col(h).alias(c) for c, h in zip(carry, held, strict=True)], *out.columns[1 + len(held) :])


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte of all documents under a 200-byte string that also starts anywhere else is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, window=200, keep="none", with_text=False)
