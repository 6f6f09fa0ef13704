"""Byte-level BPE encoding with a segment tree, and decoding.

A piece of text (one match of the pattern) is a row of bytes. A segment tree over its positions holds at each leaf the
rank of the pair that starts there, in one number with the position, so the root is the leftmost pair of lowest rank.
A merge drops the right token from the list of live neighbours and updates three leaves, each in as many steps as the
tree is high. Short pieces are encoded many at a time, one merge of each per step; long ones by themselves. Pieces
repeat, so the ids of short ones are kept in a bounded table per worker.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import chunks, texts_of

#: Pieces kept per worker, and the longest piece that is kept (characters) or encoded together with others (bytes).
KEPT, SHORT = 300_000, 64
_NONE = np.int64(2**62)


class Vocabulary:
    """Ranks of byte strings; pair ranks come from all splits of an entry into two entries."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {i: t for t, i in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for t, rank in self.ranks.items():
            for i in range(1, len(t)):
                a, b = self.ranks.get(t[:i]), self.ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.of_bytes = np.full((256, 256), _NONE)
        for a in range(256):
            self.of_bytes[a] = self.pair_ranks(np.full(256, self.single[a]), self.single)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; _NONE where the two don't merge or one is missing (below 0)."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.values[at], _NONE)

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces as little-endian 32-bit numbers."""
        out: list[bytes | None] = [None] * len(pieces)
        classes: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (known := self.ranks.get(p)) is not None:
                out[i] = known.to_bytes(4, "little")
            elif len(p) > SHORT:
                out[i] = np.array(self.encode_long(p), dtype="<u4").tobytes()
            else:
                classes.setdefault(max(1, (len(p) - 1).bit_length()), []).append(i)
        for height, which in classes.items():
            step = max(1, (1 << 20) >> height)
            for a in range(0, len(which), step):
                part = which[a : a + step]
                for i, ids in zip(part, self._together([pieces[i] for i in part], height), strict=True):
                    out[i] = ids
        return out  # type: ignore[return-value]

    def _together(self, pieces: list[bytes], height: int) -> list[bytes]:
        count, width = len(pieces), 1 << height
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(count, width)
        place = np.arange(width)
        token = np.where(place < size[:, None], self.single[raw], -1)
        tree = np.full((count, 2 * width), _NONE)
        rank = self.of_bytes[raw[:, :-1], raw[:, 1:]]
        rank[place[:-1] >= size[:, None] - 1] = _NONE
        tree[:, width:-1] = np.where(rank < _NONE, rank * width + place[:-1], _NONE)
        for level in range(height - 1, -1, -1):
            lo, hi = 1 << level, 2 << level
            tree[:, lo:hi] = np.minimum(tree[:, hi : 2 * hi : 2], tree[:, hi + 1 : 2 * hi : 2])
        # Neighbours among live positions; width stands for the end, -1 for the start.
        after = np.broadcast_to(place + 1, (count, width)).copy()
        after[after >= size[:, None]] = width
        before = np.broadcast_to(place - 1, (count, width)).copy()
        live = np.flatnonzero(tree[:, 1] < _NONE)
        while len(live):
            top = tree[live, 1]
            at, new = top % width, top // width
            gone = after[live, at]
            then = after[live, gone]
            token[live, at] = new
            token[live, gone] = -1
            after[live, at] = then
            inner = then < width
            before[live[inner], then[inner]] = at[inner]
            right = np.where(inner, token[live, np.minimum(then, width - 1)], -1)
            prior = before[live, at]
            has = prior >= 0
            left = np.where(has, token[live, np.maximum(prior, 0)], -1)
            self._update(tree, live, gone, np.full(len(live), _NONE), height)
            self._update(tree, live, at, self._leaf(new, right, at, width), height)
            self._update(tree, live[has], prior[has], self._leaf(left[has], new[has], prior[has], width), height)
            live = live[tree[live, 1] < _NONE]
        flat = token.ravel()
        kept = flat >= 0
        ends = np.cumsum(kept.reshape(count, width).sum(axis=1)) * 4
        data = flat[kept].astype("<u4").tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _leaf(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        rank = self.pair_ranks(a, b)
        return np.where(rank < _NONE, rank * width + at, _NONE)

    @staticmethod
    def _update(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, value: np.ndarray, height: int) -> None:
        node = at + (1 << height)
        tree[rows, node] = value
        for _ in range(height):
            value = np.minimum(value, tree[rows, node ^ 1])
            node = node >> 1
            tree[rows, node] = value

    def encode_long(self, piece: bytes) -> list[int]:
        """One piece of any length: n merges of about log2(n) steps each."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        none, pairs = int(_NONE), self.pairs
        token = [int(self.single[b]) for b in piece]
        tree = [none] * (2 * width)
        for i in range(n - 1):
            if (rank := pairs.get(token[i] << 32 | token[i + 1])) is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            node = width + i
            tree[node] = value
            while node > 1:
                value = min(value, tree[node ^ 1])
                node >>= 1
                if tree[node] == value:
                    return
                tree[node] = value

        def pair(i: int, j: int) -> int:
            rank = pairs.get(token[i] << 32 | token[j])
            return none if rank is None else rank * width + i

        while tree[1] < none:
            new, at = divmod(tree[1], width)
            gone = after[at]
            then = after[at] = after[gone]
            token[at], token[gone] = new, -1
            put(gone, none)
            if then < n:
                before[then] = at
            put(at, pair(at, then) if then < n else none)
            if before[at] >= 0:
                put(before[at], pair(before[at], at))
        return [t for t in token if t >= 0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


_KNOWN: dict[tuple[str, str], dict[str, bytes]] = {}


def _words(text: str, pattern: str) -> Iterator[list[str]]:
    """Matches of the pattern, a long text's in parts."""
    if len(text) < 1_000_000:
        yield _pattern(pattern).findall(text)
        return
    found = (m[0] for m in _pattern(pattern).finditer(text))
    while part := list(islice(found, 100_000)):
        yield part


def encode_texts(texts: list[str], path: str, pattern: str) -> Iterator[bytes]:
    """Ids of each text as little-endian 32-bit numbers."""
    vocab = vocabulary(path)
    known = _KNOWN.setdefault((path, pattern), {})
    for a in range(0, len(texts), 64):
        group: list[list[str]] = []
        for t in texts[a : a + 64]:
            if len(t) >= 1_000_000:
                yield from _encode(group, vocab, known)
                group = []
                out = []
                for part in _words(t, pattern):
                    out += _encode([part], vocab, known)
                yield b"".join(out)
            else:
                group += _words(t, pattern)
        yield from _encode(group, vocab, known)


def _encode(groups: list[list[str]], vocab: Vocabulary, known: dict[str, bytes]) -> list[bytes]:
    missing = set().union(*groups).difference(known)
    if len(known) + len(missing) > KEPT:
        known.clear()
        missing = set().union(*groups)
    long = {w: np.array(vocab.encode_long(w.encode()), dtype="<u4").tobytes() if w.encode() not in vocab.ranks else vocab.ranks[w.encode()].to_bytes(4, "little") for w in missing if len(w) > SHORT}
    short = [w for w in missing if len(w) <= SHORT]
    known.update(zip(short, vocab.encode_many([w.encode() for w in short]), strict=True))
    at = (lambda w: known.get(w) or long[w]) if long else known.__getitem__
    return [b"".join(map(at, g)) for g in groups]


def _mapper(path: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in chunks(texts):
                n, ids_sha, back_sha, ids, back = [], [], [], [], []
                for x in encode_texts([t.decode("utf-8", "replace") for t in texts[a:b]], path, pattern):
                    n.append(len(x) // 4)
                    ids_sha.append(hashlib.sha256(x).hexdigest())
                    decoded = vocab.decode(x)
                    back_sha.append(hashlib.sha256(decoded).hexdigest())
                    if with_ids:
                        ids.append(np.frombuffer(x, "<u4").astype(np.int32))
                        back.append(decoded.decode("utf-8", "replace"))
                cols = [batch.column("doc_id")[a:b], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols, names = [*cols, pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], [*names, "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode_documents(docs: DataFrame, ranks: str, pattern: str, with_ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, ids and decoded.

    Each match of the pattern is encoded by itself; a match that is an entry is that entry. Null is the empty text: no
    ids. Null or repeated doc_ids and repeated rows are kept; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_mapper(ranks, pattern, with_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else ""))


def op8_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    import public_tokenizers as files

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, files.path("byte_bpe_multi_50k.tiktoken"), files.PATTERN, with_ids=False)
