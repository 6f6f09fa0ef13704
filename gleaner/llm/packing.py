"""Packing by concatenate and cut.

Pass 1 tokenizes every document once and writes ids, token count and the offset inside its partition to the shared
folder. The partitions' totals (one number each) are summed up to global offsets; pass 2 cuts each document's ids where
the global offset is a multiple of the sequence length. A document that crosses a boundary has one record on each side.
Nothing is shuffled. Every sequence but the last is full.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import chunks, materialize, spans, texts_of


@lru_cache(maxsize=4)
def _slow(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _fast(path: str, ranks: str, pattern: str):
    """The same vocabulary in tiktoken, which gives the same ids about five times as fast."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {t.content: i for i, t in _slow(path).get_added_tokens_decoder().items()}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens=special)


def token_ids(text: str, path: str, ranks: str | None, pattern: str) -> np.ndarray:
    """Ids as Tokenizer.from_file(path).encode(text, add_special_tokens=False) gives them."""
    if ranks:
        try:
            return _fast(path, ranks, pattern).encode_to_numpy(text, allowed_special="all")
        except ValueError:
            pass  # its regular expressions give up on very long runs of white space
    return np.array(_slow(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def _tokenize(path: str, ranks: str | None, pattern: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, begin = TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in chunks(texts):
                n, at, ids = [], [], []
                for t in texts[a:b]:
                    x = np.concatenate((token_ids(t.decode("utf-8", "replace"), path, ranks, pattern), end))
                    n.append(len(x))
                    at.append(begin)
                    begin += len(x)
                    # Two bytes an id where they do; the length tells which.
                    ids.append(x.astype("<u2" if x.max() < 65536 else "<u4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array([part] * len(n), pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "part", "begin", "n", "ids"])

    return run


def _pieces(base: dict[int, int], total: int, length: int, with_ids: bool):
    last = total - total % length
    short = 1 << max(0, (total % length) - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.binary_length(batch.column("ids")).to_pylist()
            for a, b in spans(size):
                rows = batch.slice(a, b - a)
                owner, start, size, crc, where, ids = [], [], [], [], [], []
                for i, (part, begin, n, data) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("part", "begin", "n", "ids")), strict=True)):
                    x = np.frombuffer(data, "<u4" if len(data) == 4 * n else "<u2").astype("<u4")
                    at, off = base[part] + begin, 0
                    while off < n:
                        k = min(n - off, length - (at + off) % length)
                        owner.append(i)
                        start.append(off)
                        size.append(k)
                        crc.append(zlib.crc32(x[off : off + k]))
                        where.append(at + off)
                        if with_ids:
                            ids.append(x[off : off + k].astype(np.int32))
                        off += k
                w = np.array(where, dtype=np.int64)
                cols = [rows.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), rows.column("n").take(pa.array(owner, pa.int64())), pa.array(w // length), pa.array(w % length), pa.array(np.where(w >= last, short, length).astype(np.int64))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to"]
                if with_ids:
                    cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str = "", length: int = 1024, end_id: int = 0, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to (and ids).

    Documents follow each other as they are read. Each is its ids and end_id, so a null or empty text is end_id alone;
    null and repeated doc_ids are kept as they are. padded_to is the sequence's length after padding: length, or for
    the last sequence the power of two that holds it. An empty table gives no pieces. Other columns are ignored.
    tokenizer: a file for the tokenizers library; ranks: the same vocabulary for tiktoken, for speed, or None.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = materialize(rows.mapInArrow(_tokenize(tokenizer, ranks, pattern, end_id), "doc_id long, part long, begin long, n long, ids binary"), "packing-ids", compression="zstd")
    totals = sorted((r["part"], r["t"]) for r in made.groupBy("part").agg(F.sum("n").alias("t")).collect())
    base, at = {}, 0
    for part, t in totals:
        base[part] = at
        at += t
    shape = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long" + (", ids array<int>" if with_ids else "")
    return made.mapInArrow(_pieces(base, at, length, with_ids), shape)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, padded_to) of pieces with ids, each sequence's pieces in order. A sequence is of bounded length."""
    joined = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.max("padded_to").alias("padded_to"))
    return joined.select("sequence_id", F.expr("flatten(transform(p, x -> x.ids))").alias("ids"), "padded_to")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    import public_tokenizers as files

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN, length=1024, end_id=0)
