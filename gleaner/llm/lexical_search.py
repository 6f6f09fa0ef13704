"""Ranked lexical search over an inverted index in shards, document at a time.

Index: each task cuts its documents into shards of about SHARD_BYTES of text, without any shuffle. A shard holds, per
term, the postings of its documents in the order of doc_id: gaps of local numbers and term counts, as variable-length
integers. A row without a term is the shard's head: doc_ids and lengths. All documents and all terms are indexed.

Search: for a block of items the index is cut down to their terms, and from these rows come the statistics of all
documents (N, L, df). The rows of one shard meet in one task. There every item merges the postings of its terms with a
heap of cursors, one document at a time, and keeps its best in a heap of ``top`` entries keyed by score, then doc_id.
Terms whose largest scores together cannot lift a document into that heap leave the merge and are looked up only for
documents that others have brought up; the heap is carried from shard to shard of a task. Tasks' best are merged by item.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import discard, materialize, texts_of

TERM, NO_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Text of one shard; a longer document is a shard of its own. Text whose terms are held as objects at once.
SHARD_BYTES, PIECE_BYTES = 24_000_000, 4_000_000
#: Items searched at once: what is sent to tasks is bounded by them.
BLOCK_ITEMS = 2_000

_INDEX = "shard long, term binary, df int, tokens long, postings binary"
_COLUMNS = ["shard", "term", "df", "tokens", "postings"]


# Variable-length integers --------------------------------------------------------------------------------------------


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, first byte of each value): seven bits a byte, lowest first, the high bit set where more follow."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >> np.uint64(7 * k) != 0
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[start[some] + k] = ((v[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(size[some] > k + 1, 128, 0).astype(np.uint8)
    return out, start


def decode(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    end = np.flatnonzero(b < 128)
    start = np.concatenate(([0], end[:-1] + 1))
    if len(end) == len(b):
        return b.astype(np.int64)
    place = np.arange(len(b)) - np.repeat(start, end - start + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), start)


# Index ---------------------------------------------------------------------------------------------------------------


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces that end where no term is cut."""
    at = 0
    while at < len(text):
        m = NO_TERM.search(text, at + PIECE_BYTES) if at + PIECE_BYTES < len(text) else None
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


class _Shard:
    def __init__(self):
        self.words: dict[bytes, int] = defaultdict(count().__next__)
        self.ids, self.tf, self.n_terms, self.doc_ids, self.lengths, self.size = [], [], [], [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        self.size += len(text)
        found = [np.fromiter(map(self.words.__getitem__, TERM.findall(p)), np.int32) for p in _pieces(text.lower())]
        ids, tf = np.unique(np.concatenate(found) if found else np.zeros(0, np.int32), return_counts=True)
        if not len(ids):
            return  # without a term a document is not counted anywhere
        self.ids.append(ids)
        self.tf.append(tf.astype(np.int32))
        self.n_terms.append(len(ids))
        self.doc_ids.append(doc_id)
        self.lengths.append(int(tf.sum()))

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        if not self.doc_ids:
            return
        order = sorted(range(len(self.doc_ids)), key=lambda i: (self.doc_ids[i] is None, self.doc_ids[i] or 0))
        local = np.empty(len(order), np.int64)
        local[order] = np.arange(len(order))
        ids, tf, doc = np.concatenate(self.ids), np.concatenate(self.tf), np.repeat(local, self.n_terms)
        by = np.argsort(ids.astype(np.int64) << 32 | doc)
        ids, tf, doc = ids[by], tf[by], doc[by]
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        gap = np.diff(doc, prepend=0)
        gap[first] = doc[first]
        data, start = encode(np.stack((gap, tf), axis=1).ravel())
        bounds = np.append(start[2 * first], len(data))
        df = np.diff(np.append(first, len(ids)))
        head = np.array([self.doc_ids[i] or 0 for i in order], np.int64).tobytes() + bytes(self.doc_ids[i] is None for i in order) + encode(np.array([self.lengths[i] for i in order]))[0].tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([b""], pa.binary()), pa.array([len(order)], pa.int32()), pa.array([sum(self.lengths)], pa.int64()), pa.array([head], pa.binary())], _COLUMNS)
        words, step = list(self.words), 50_000
        for a in range(0, len(first), step):
            b = min(a + step, len(first))
            cut = bounds[a : b + 1]
            own = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((cut - cut[0]).astype(np.int32)), pa.py_buffer(data[cut[0] : cut[-1]].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, number)), pa.array(words[a:b], pa.binary()), pa.array(df[a:b].astype(np.int32)), pa.array(np.zeros(b - a, np.int64)), own], _COLUMNS)


def _shards(shard_bytes: int):
    """Rows (doc_id, text) to rows of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts_of(part.column("text")), strict=True):
                    if shard.size and shard.size + len(text) > shard_bytes:
                        yield from shard.rows(number)
                        number, shard = number + 1, _Shard()
                    shard.add(doc_id, text)
        yield from shard.rows(number)

    return run


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index as a stage table; discard() deletes it. Every row of docs is a document, also where doc_ids repeat or are null."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialize(own.mapInArrow(_shards(shard_bytes), _INDEX), "lexical-index")


# Search --------------------------------------------------------------------------------------------------------------


def terms_of(text: str | None) -> list[bytes]:
    """The distinct terms of an item, in their order."""
    return list(dict.fromkeys(TERM.findall((text or "").encode().lower())))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _head(data: bytes, n: int) -> tuple[list[int], np.ndarray]:
    """Of each document a key that is larger for smaller doc_ids, least for null, and its length."""
    ids, null = np.frombuffer(data[: 8 * n], np.int64).tolist(), data[8 * n : 9 * n]
    return [-(1 << 64) if x else -i for i, x in zip(ids, null, strict=True)], decode(data[9 * n :])


class _Postings:
    """One term's documents (local numbers, ascending), their scores, the largest and the top-th largest of these (0 for fewer)."""

    def __init__(self, docs: np.ndarray, scores: np.ndarray, top: int):
        self.docs, self.scores, self.largest = docs.tolist(), scores.tolist(), int(scores.max())
        self.reached = int(np.partition(scores, len(scores) - top)[len(scores) - top]) if len(scores) >= top else 0


def best_documents(lists: list[_Postings], keys: list[int], top: int, best: list[tuple[int, int]]) -> None:
    """Merge postings into best, a heap of (score, key) of at most top entries.

    Lists are put in the order of their largest scores. Those whose largest scores add up to less than what it takes
    are not merged any more but looked up. What it takes is the least of a full heap, or the top-th largest score in
    one list, which at least that many documents reach.
    """
    lists = sorted(lists, key=lambda x: x.largest)
    bound = np.cumsum([x.largest for x in lists]).tolist()
    floor = max(x.reached for x in lists)
    if len(best) == top:
        floor = max(floor, best[0][0])
    passive = bisect_left(bound, floor)  # their sum stays below floor
    cursors = [(x.docs[0], j, 0) for j, x in enumerate(lists) if j >= passive]
    heapq.heapify(cursors)
    while cursors:
        doc, score = cursors[0][0], 0
        while cursors and cursors[0][0] == doc:
            _, j, i = cursors[0]
            docs = lists[j].docs
            score += lists[j].scores[i]
            i += 1
            if i < len(docs):
                heapq.heapreplace(cursors, (docs[i], j, i))
            else:
                heapq.heappop(cursors)
        for j in range(passive - 1, -1, -1):
            if score + bound[j] < floor:
                break
            docs = lists[j].docs
            i = bisect_left(docs, doc)
            if i < len(docs) and docs[i] == doc:
                score += lists[j].scores[i]
        if score <= 0 or score < floor:
            continue
        entry = (score, keys[doc])
        if len(best) < top:
            heapq.heappush(best, entry)
        elif entry > best[0]:
            heapq.heapreplace(best, entry)
        if len(best) == top and best[0][0] > floor:
            floor = best[0][0]
            if passive < len(lists) and bound[passive] < floor:
                passive = bisect_left(bound, floor)
                cursors = [c for c in cursors if c[1] >= passive]
                heapq.heapify(cursors)


def _ranked(items: list[list[bytes]], weights: dict[bytes, int], n_docs: int, n_tokens: int, top: int):
    """Rows of the index, sorted by shard and term, to each item's best documents of the task: (item, score, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        shard, keys, steps, found = None, [], None, {}

        def finish() -> None:
            for terms, heap in zip(items, best, strict=True):
                if held := [found[t] for t in terms if t in found]:
                    best_documents(held, keys, top, heap)

        for batch in batches:
            for number, term, df, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "term", "df", "postings")), strict=True):
                if number != shard:
                    finish()
                    shard, found = number, {}
                if term == b"":  # the head comes first
                    keys, lengths = _head(data, df)
                    steps = 8 * (10 + 90 * lengths * n_docs // n_tokens)
                    continue
                pair = decode(data)
                doc, tf = np.cumsum(pair[::2]), pair[1::2]
                found[term] = _Postings(doc, weights[term] * (1_000_000_000 * tf // (1000 * tf + steps[doc])), top)
        finish()
        rows = [(i, score, None if key == -(1 << 64) else -key) for i, heap in enumerate(best) for score, key in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["item", "score", "doc_id"])

    return run


def search(index: DataFrame, items: DataFrame, top: int = 10, item_id: str = "item_id", text: str = "text", block: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents of the largest score above 0, ties by doc_id, null last.

    A term is a run of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case. Documents
    without a term (null and empty texts too) are no documents here. Items without a term, and items none of whose
    terms occurs, have no rows. Items that agree in id and text are one; otherwise each row is an item, and rows of one
    id that differ in text are ranked each by itself. Rows of documents are ranked each by itself too. Items are
    searched in blocks, so that the number of items has no bound.
    """
    spark = index.sparkSession
    wanted = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct()
    kind = wanted.schema["item_id"].dataType
    blocks = -(-wanted.count() // block) or 1
    out = []
    for b in range(blocks):
        some = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about one block
        terms = [terms_of(r["text"]) for r in some]
        every = sorted({t for ts in terms for t in ts})
        found = index.join(F.broadcast(spark.createDataFrame([(bytearray(t),) for t in (b"", *every)], "term binary")), "term", "left_semi")
        counts = {bytes(r["term"]): (r["df"], r["tokens"]) for r in found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens")).collect()}  # of the block's terms
        n_docs, n_tokens = counts.pop(b"", (0, 0))
        weights = {t: weight(n_docs, df) for t, (df, _) in counts.items()}
        rows = found.select("shard", "term", "df", "postings").repartition("shard").sortWithinPartitions("shard", "term")
        rows = rows.mapInArrow(_ranked(terms, weights, n_docs, n_tokens, top), "item long, score long, doc_id long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        rows = rows.withColumn("rank", F.row_number().over(order)).where(f"rank <= {int(top)}")
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(some)], f"item long, item_id {kind.simpleString()}")
        out.append(materialize(rows.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "lexical-best"))
    best = out[0]
    for more in out[1:]:
        best = best.unionByName(more)
    return best


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's ten best of all documents."""
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    best = search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), top=10)
    discard(index)
    return best


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
n AS (SELECT r, doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
s AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM n),
i AS (SELECT row_number() OVER () AS k, item_id, list_distinct({_TERMS}) AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
it AS (SELECT k, item_id, unnest(terms) AS term FROM i),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM it) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, big_n),
c AS (SELECT k, item_id, doc_id, r, sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n.n * s.big_n) // s.big_l))))::BIGINT AS score
      FROM it JOIN p USING (term) JOIN w USING (term) JOIN n USING (r), s GROUP BY k, item_id, doc_id, r),
b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM c WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM b WHERE rank <= 10
"""
