"""Multi-index hashing: approximate nearest neighbours by learned codes, and exact top-k search of binary codes.

A binary code is split into substrings, each with an index from its value to rows. Codes within Hamming distance r
differ in at most r // m bits in one of m substrings, so probing all values that near to the query's finds them all.

The index is cut into shards of bounded bytes. Rows are dealt to shards by a number that is written down first, not by
a key, so neither a common vector nor a repeated id makes one large, and a task that runs again deals alike. Every row
moves once, to its shard; queries go to all shards and stream past the index there, a batch at a time, each taking at
most k rows from it. For a given number of queries the rows moved grow in proportion to the table; neither candidates
nor pairs are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import materialize

#: Bytes of a shard's vectors or codes, rows below which a shard isn't cut for the sake of more tasks, vectors that codes and radius are fitted on.
SHARD_BYTES, SHARD_LEAST, SAMPLE = 32_000_000, 10_000, 10_000
#: Of each sort a search answers with: query's row number, its id, found id, and the measure.
_FOUND = "_q long, query_id long, vec_id long"


def valid_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v, d) of usable rows, d their length.

    Null ids go, and vectors that are null, all zero or hold a null or non-finite component. Vectors of several lengths
    may stand in one table; only those of one length are compared. Floats stay floats, other kinds become doubles.
    """
    kind = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("v"))
    fine = rows.where("vec_id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")
    return fine.withColumn("d", F.size("v"))


def _matrix(col: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    chunks = col.chunks if isinstance(col, pa.ChunkedArray) else [col]
    flat = [x.flatten().to_numpy(zero_copy_only=False) for x in chunks]
    return np.concatenate(flat).reshape(-1, d) if flat else np.zeros((0, d))


def _doubles(x: np.ndarray) -> np.ndarray:
    """Vectors in double precision; those whose squares would leave its range are scaled, which changes no cosine."""
    x = x.astype(np.float64)
    most = np.abs(x).max(axis=1, initial=0.0)
    far = (most > 1e150) | (most < 1e-150)
    return np.where(far[:, None], x / np.where(far, most, 1.0)[:, None], x) if far.any() else x


# Codes ---------------------------------------------------------------------------------------------------------------


def pack_bits(positive: np.ndarray) -> np.ndarray:
    """Rows of booleans to rows of 64-bit words, padded with zeros."""
    n, d = positive.shape
    bits = np.zeros((n, -(-d // 64) * 64), dtype=np.uint8)
    bits[:, :d] = positive
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def learn_rotation(sample: np.ndarray, bits: int = 64, rounds: int = 40, seed: int = 11) -> np.ndarray:
    """Iterative quantisation: a rotation of the principal axes that brings unit vectors close to the corners of a cube.

    Vectors shorter than bits get further random rotations beside it.
    """
    x = _doubles(sample)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d, rng = x.shape[1], np.random.default_rng(seed)
    axes = np.linalg.svd(x, full_matrices=False)[2][: min(bits, d)].T if len(x) >= d else np.eye(d)[:, : min(bits, d)]
    y = x @ axes
    r = np.linalg.qr(rng.standard_normal((y.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
        r = (u @ vt).T
    out = [axes @ r]
    while sum(o.shape[1] for o in out) < bits:
        out.append(np.linalg.qr(rng.standard_normal((d, d)))[0])
    return np.concatenate(out, axis=1)[:, :bits]


def learn_radius(sample: np.ndarray, rotation: np.ndarray, k: int, recall: float = 0.97, queries: int = 400) -> int:
    """The radius that holds this share of the true k nearest of some sample vectors; in all rows neighbours are nearer."""
    if len(sample) <= k + 1:
        return rotation.shape[1]
    x = _doubles(sample)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    q = np.arange(0, len(x), max(1, len(x) // queries))
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -2
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    codes = pack_bits(x @ rotation >= 0)
    apart = np.bitwise_count(codes[q][:, None, :] ^ codes[near]).sum(axis=2)
    return int(math.ceil(np.quantile(apart, recall)))


class Substrings:
    """Indices of codes by each of their substrings of ``width`` bits (8 or 16)."""

    def __init__(self, codes: np.ndarray, width: int):
        self.codes, self.width, self.values = codes, width, codes.view(np.uint8 if width == 8 else np.uint16)
        self.m = self.values.shape[1]
        self.order = [np.argsort(self.values[:, j], kind="stable").astype(np.int32) for j in range(self.m)]
        self.start = [np.concatenate(([0], np.cumsum(np.bincount(self.values[:, j], minlength=1 << width)))) for j in range(self.m)]
        self.masks = [np.array([sum(1 << b for b in c) for c in combinations(range(width), r)], dtype=np.int64) for r in range(width + 1)]

    def probe(self, j: int, value: int, radius: int) -> np.ndarray:
        """Rows whose substring j differs from value in exactly radius bits."""
        at = self.masks[radius] ^ value
        first = self.start[j][at]
        count = self.start[j][at + 1] - first
        return self.order[j][np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())]

    def distance(self, rows: np.ndarray, code: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.codes[rows] ^ code).sum(axis=1).astype(np.int64)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows within the radius, by pigeonhole: with radius = m * a + b, b + 1 substrings to a bits, the rest to a - 1."""
        a, b = divmod(radius, self.m)
        value, found = code.view(self.values.dtype), np.zeros(len(self.codes), dtype=bool)
        for j in range(self.m):
            for r in range(min(self.width, a if j <= b else a - 1) + 1):
                found[self.probe(j, int(value[j]), r)] = True
        rows = np.flatnonzero(found)
        return rows[self.distance(rows, code) <= radius]

    def nearest(self, code: np.ndarray, k: int, ids: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest rows but row own, by (distance, id), exactly.

        Search radii grow by one bit in one substring at a time. When substrings up to j are done to r bits and the
        others to r - 1, every code within m * r + j is found; the search ends when the kth distance is not above that.
        """
        value, seen = code.view(self.values.dtype), np.zeros(len(self.codes), dtype=bool)
        rows, apart = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for r in range(self.width + 1):
            for j in range(self.m):
                new = self.probe(j, int(value[j]), r)
                new = new[~seen[new]]
                seen[new] = True
                new = new[new != own]
                rows, apart = np.concatenate((rows, new)), np.concatenate((apart, self.distance(new, code)))
                if len(rows) >= k and np.partition(apart, k - 1)[k - 1] <= self.m * r + j:
                    best = np.lexsort((ids[rows], apart))[:k]
                    return rows[best], apart[best]
        best = np.lexsort((ids[rows], apart))[:k]
        return rows[best], apart[best]


# Shards --------------------------------------------------------------------------------------------------------------


class _Shard:
    """Search in one shard: find(row numbers, vectors or codes of queries) gives (query's place, found ids, measures)."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, d: int):
        self.ids, self.d = ids, d
        self.by_number = np.argsort(numbers)
        self.numbers = numbers[self.by_number]

    def own(self, number: int) -> int:
        """The place of the query's own row in this shard, or -1."""
        i = int(np.searchsorted(self.numbers, number))
        return int(self.by_number[i]) if i < len(self.numbers) and self.numbers[i] == number else -1


class _Cosines(_Shard):
    def __init__(self, numbers, ids, data: pa.ChunkedArray, d: int, k: int, rotation: np.ndarray, radius: int):
        super().__init__(numbers, ids, d)
        self.x, self.k, self.rotation, self.radius, self.bits = _matrix(data, d), k, rotation, radius, rotation.shape[1]
        self.unit, codes = np.empty(self.x.shape, np.float32), []
        for a in range(0, len(ids), 1 << 14):
            x = _doubles(self.x[a : a + (1 << 14)])
            self.unit[a : a + (1 << 14)] = x / np.sqrt((x * x).sum(axis=1))[:, None]
            codes.append(pack_bits(x @ rotation >= 0))
        self.index = Substrings(np.concatenate(codes), 8)

    def find(self, numbers: np.ndarray, data: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        y = _doubles(_matrix(data, self.d))
        codes, length = pack_bits(y @ self.rotation >= 0), np.sqrt((y * y).sum(axis=1))
        slack = 4e-7 * (self.d + 4)  # of a single-precision cosine
        for i, number in enumerate(numbers.tolist()):
            own, r = self.own(number), self.radius
            possible = len(self.ids) - (own >= 0)
            while True:
                near = self.index.within(codes[i], r)
                near = near[near != own]
                if len(near) >= min(self.k, possible):
                    break
                r = min(r + 4, self.bits)
            if len(near) > self.k:
                rough = self.unit[near] @ (y[i] / length[i]).astype(np.float32)
                near = near[rough >= np.partition(rough, len(rough) - self.k)[len(rough) - self.k] - slack]
            x = _doubles(self.x[near])
            score = (x * y[i]).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * length[i])
            best = np.lexsort((self.ids[near], -score))[: self.k]
            yield i, self.ids[near][best], score[best]


class _Signs(_Shard):
    def __init__(self, numbers, ids, data: pa.ChunkedArray, d: int, k: int):
        super().__init__(numbers, ids, d)
        self.k, self.index = k, Substrings(self.codes(data), 16)

    def codes(self, data: pa.Array | pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer(b"".join(data.to_pylist()), np.uint64).reshape(-1, -(-self.d // 64))

    def find(self, numbers: np.ndarray, data: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        codes = self.codes(data)
        for i, number in enumerate(numbers.tolist()):
            rows, apart = self.index.nearest(codes[i], self.k, self.ids, self.own(number))
            yield i, self.ids[rows], apart


def _searched(build: Callable, kind: pa.DataType):
    """An Arrow mapper over rows sorted by (d, shard, asks): each shard's rows, then all queries past their index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None
        for whole in batches:
            keys = np.stack([whole.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("d", "shard", "asks")], axis=1)
            turn = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1), [True]))) if len(keys) else [0]
            for a, b in zip(turn[:-1], turn[1:], strict=True):
                d, number, asks = keys[a].tolist()
                if now != (d, number):
                    now, held, shard = (d, number), [], None
                part = whole.slice(a, b - a)
                if not asks:
                    held.append(part)
                    continue
                if shard is None and held:
                    rows = pa.Table.from_batches(held)
                    shard = build(rows["uid"].to_numpy(), rows["vec_id"].to_numpy(), rows["v"], d)
                    held = []
                if shard is None:
                    continue
                for c in range(0, part.num_rows, 1024):
                    some = part.slice(c, 1024)
                    uid, asked = some.column("uid").to_numpy(), some.column("vec_id").to_numpy()
                    place, ids, measures = [], [np.zeros(0, np.int64)], [np.zeros(0)]
                    for i, found, measure in shard.find(uid, some.column("v")):
                        place += [i] * len(found)
                        ids.append(found)
                        measures.append(measure)
                    at = np.array(place, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(uid[at]), pa.array(asked[at]), pa.array(np.concatenate(ids)), pa.array(np.concatenate(measures)).cast(kind)], ["_q", "query_id", "vec_id", "measure"])

    return run


def _in_shards(rows: DataFrame, width: Column, every: int, build: Callable, kind: pa.DataType, shard_bytes: int, least: int) -> DataFrame:
    """All queries of rows (uid, vec_id, v, d) against all rows of their length; width: a row's bytes."""
    spark = rows.sparkSession
    sizes = {r["d"]: (r["n"], r["w"]) for r in rows.groupBy("d").agg(F.count("*").alias("n"), F.max(width).alias("w")).collect()}  # one row a length
    tasks = spark.sparkContext.defaultParallelism
    shards = {d: max(-(-n * w // shard_bytes), min(tasks, -(-n // least))) for d, (n, w) in sizes.items()}
    if not shards:
        shards = {0: 1}
    count = F.element_at(F.create_map(*[F.lit(x).cast("int") for p in shards.items() for x in p]), F.col("d"))
    data = rows.select("d", F.pmod(F.xxhash64("uid"), count).cast("int").alias("shard"), F.lit(0).alias("asks"), "uid", "vec_id", "v")
    asks = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("d", F.explode(F.sequence(F.lit(0), count - 1)).alias("shard"), F.lit(1).alias("asks"), "uid", "vec_id", "v")
    dealt = data.unionByName(asks).repartition(sum(shards.values()), "d", "shard").sortWithinPartitions("d", "shard", "asks")
    return dealt.mapInArrow(_searched(build, kind), f"{_FOUND}, measure {'double' if kind == pa.float64() else 'long'}")


def _best(found: DataFrame, order: Column, k: int, name: str) -> DataFrame:
    """The k first of each query over its shards, at most k from each."""
    w = Window.partitionBy("_q").orderBy(order, "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("measure").alias(name))


def nearest_by_cosine(df: DataFrame, every: int = 50, k: int = 5, bits: int = 64, vec_id: str = "vec_id", vector: str = "embedding", shard_bytes: int = SHARD_BYTES, least: int = SHARD_LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by every, the k nearest found by cosine.

    Codes and radius are learned on at most SAMPLE vectors, by length; every row is indexed and searched, and found rows
    are ranked by the cosine of the original vectors in double precision, ties to the smaller id. Where fewer than k
    rows of a shard are within the radius, it grows; a length that the sample lacks is searched in full. Only the
    query's own row is no candidate: rows that repeat it, or its id, are, and each such row asks for itself.
    valid_vectors tells which vectors take no part; an empty table gives no rows.
    """
    rows = materialize(valid_vectors(df, vec_id, vector).withColumn("uid", F.monotonically_increasing_id()), "nearest-rows")
    few = rows.orderBy(F.xxhash64("vec_id"), "uid").limit(SAMPLE).select("d", "v").toArrow()
    models = {}
    for d in sorted(set(few["d"].to_pylist())):
        sample = _matrix(few.filter(pa.compute.equal(few["d"], d))["v"], d)
        rotation = learn_rotation(sample, bits)
        models[d] = rotation, learn_radius(sample, rotation, k)

    def build(uid, ids, data, d) -> _Shard:
        rotation, radius = models.get(d) or (learn_rotation(np.ones((1, d)), bits), bits)
        return _Cosines(uid, ids, data, d, k, rotation, radius)

    found = _in_shards(rows, F.col("d") * 8, every, build, pa.float64(), shard_bytes, least)
    return _best(found, F.desc("measure"), k, "score")


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = batch.column("d").to_numpy()
        codes = np.empty(len(size), object)
        for d in np.unique(size).tolist():
            at = np.flatnonzero(size == d)
            words = pack_bits(_matrix(batch.column("v").take(pa.array(at)), d) > 0)
            codes[at] = [x.tobytes() for x in words]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(codes.tolist(), pa.binary()), batch.column("d")], ["vec_id", "v", "d"])


def nearest_codes(df: DataFrame, every: int = 100, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", shard_bytes: int = SHARD_BYTES, least: int = SHARD_LEAST) -> DataFrame:
    """(query_id, rank, vec_id, distance): the exact k nearest by Hamming distance of the signs of the components.

    Component i gives bit i: 1 if it is above zero. Codes of one length are compared. Ties go to the smaller id. Only
    the query's own row is no candidate: rows that repeat it, or its id, are, and each such row asks for itself; where
    fewer than k are left, all are returned. valid_vectors tells which vectors take no part; an empty table gives no
    rows.
    """
    coded = valid_vectors(df, vec_id, vector).mapInArrow(_coded, "vec_id long, v binary, d int")
    rows = materialize(coded.withColumn("uid", F.monotonically_increasing_id()), "codes-rows")
    found = _in_shards(rows, F.octet_length("v") + 8, every, lambda uid, ids, data, d: _Signs(uid, ids, data, d, k), pa.int64(), shard_bytes, least)
    return _best(found, F.col("measure"), k, "distance")


def op2_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every 50th vector."""
    return nearest_by_cosine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest sign codes of every 100th vector."""
    return nearest_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.b, c.b), lambda z: abs(z[1] - z[2])))::BIGINT AS distance
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r AND len(q.b) = len(c.b)),
n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY distance, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM n WHERE rank <= 10
"""
