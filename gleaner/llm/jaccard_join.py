"""N-gram Jaccard join by token-combination prefixes.

Every document is the set of its hashed word shingles; equal sets become one node at once. Two nodes link when their
Jaccard similarity is at least ``percent`` / 100. With sets x, y in one global order of tokens, a linked pair shares at
least k tokens among the first p(n) + k - 1 of each, p(n) = n - ceil(n * percent / 100) + 1. That gives two rounds:

1. Tokens in the order of their hashes, k = half of p(n) (prefixes extended by k - 1). Document frequencies are counted
   over all extended prefixes. Tokens of at most RARE documents index pairs by themselves, and an upper bound of the
   intersection prunes them. A pair that shares no rare token shares k frequent ones, so both nodes hold that many;
   only such nodes go on to round 2.
2. Those nodes' whole sets, tokens in the order of their frequency in that group, rarest first. Rare tokens index
   singly; frequent tokens in combinations of two from prefixes extended by one for sets of 18 to 100 tokens (smaller
   and larger sets singly, as their combinations would be too few or too many; sizes near a border are in both). In a
   bucket of frequent tokens all nodes are first compared with the most central one, that is with the fewest tokens of
   its own. After that only pairs that are still in different components are made, and only of sizes that can link: a
   bucket is joined by classes of size, and a large one is cut into squares of at most SQUARE nodes a side, so that its
   pairs are shared out among tasks.

All remaining pairs are verified exactly on whole sets. No bucket of unbounded size is ever collected, and no pair of
two nodes that are known to be connected is made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import chunks, connected_components, discard, join_counted, materialize, row_key, texts_of
from gleaner.llm.shingles import shingle_sets

#: A token of more documents than this counts as frequent. Buckets of rare tokens are small enough to pair off.
RARE = 16
#: Sizes of sets whose frequent tokens are indexed in combinations of two.
LOW, HIGH = 18, 100
#: Up to this size a node's keys carry the tokens before them, so that a pair is made at its first common key only.
LISTED = 512
#: Nodes of one side of a square of a hot bucket at most; nodes are dealt by hash, to three quarters of that on average.
SQUARE = 512

_SETS = "rid long, doc_id long, k1 long, n long, s1 long, s2 long, prefix array<long>"


def _need(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _sizes(prefix: bool, width: int, percent: int):
    """An Arrow mapper: (rid, doc_id, k1, text) to sizes, digests and extended prefixes, or to whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in chunks(texts):
                sets = shingle_sets(texts[a:b], width)
                n = pa.array([len(x) for x in sets], pa.int64())
                if prefix:
                    digest = np.array([np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64) for x in sets]).reshape(-1, 2)
                    kept = [x[: (p := _need(len(x), percent)) + (p + 1) // 2 - 1] for x in sets]
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in kept]), pa.int32()), pa.array(np.concatenate(kept)))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c)[a:b] for c in ("rid", "doc_id", "k1")), n, pa.array(digest[:, 0]), pa.array(digest[:, 1]), lists], ["rid", "doc_id", "k1", "n", "s1", "s2", "prefix"])
                else:
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in sets]), pa.int32()), pa.array(np.concatenate(sets)))
                    yield pa.RecordBatch.from_arrays([batch.column("rid")[a:b], n, lists], ["rid", "n", "tokens"])

    return run


def _ceil_share(n: str, percent: int) -> str:
    return f"(({n} * {percent} + 99) div 100)"


def _p(n: str, percent: int) -> str:
    return f"({n} - {_ceil_share(n, percent)} + 1)"


def _k(n: str, percent: int) -> str:
    return f"(({_p(n, percent)} + 1) div 2)"


def _enough(shared: str, x: str, y: str, percent: int) -> str:
    """100 * intersection >= percent * union, from the intersection's size."""
    return f"(100 + {percent}) * ({shared}) >= {percent} * ({x} + {y})"


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    x = sets.select(F.col("rid").alias("x"), F.col("n").alias("nx"), F.col("tokens").alias("tx"))
    y = sets.select(F.col("rid").alias("y"), F.col("n").alias("ny"), F.col("tokens").alias("ty"))
    both = pairs.select("x", "y").join(y, "y").join(x, "x").withColumn("shared", F.size(F.array_intersect("tx", "ty")))
    return both.where(_enough("shared", "nx", "ny", percent)).select("x", "y")


def bucket_sides(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two sides of a join of every bucket with itself, cut into squares.

    named has m, the rows of its bucket. One side is dealt by hash to rows of squares and goes to each square of its
    row, the other is dealt to columns; so in a square no side has more than SQUARE nodes. A node of the second side
    also meets the class below its own, where somewhat smaller sets are.
    """
    cuts = F.ceil(F.col("m") * 4 / (SQUARE * 3)).cast("int")
    own, every = F.pmod(F.xxhash64("rid"), F.col("cuts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    side = lambda df, s: df.select("key", "class", "across", "down", *[F.col(c).alias(c + s) for c in ("rid", "n", "u", "label", "skip", "prev")])
    named = named.withColumn("cuts", cuts)
    a = named.withColumn("down", own).withColumn("across", every)
    b = named.withColumn("across", own).withColumn("down", every).withColumn("class", F.explode(F.array(F.col("class"), F.col("class") - 1)))
    return side(a, "x"), side(b, "y")


def link_documents(docs: DataFrame, width: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: (doc_id, n_shingles, component_id, keeps) and carried columns.

    component_id is the smallest doc_id reachable by links, itself included; null only where all ids there are null.
    keeps is true for one row of each component: the one with the smallest doc_id (nulls last), among equal ids the
    first read. Null, empty and all-white texts have no shingles and link with nothing. Equal rows are equal sets and
    link. Other columns of docs are ignored. An empty table gives an empty result.
    """
    t = percent
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), row_key(F.col(text)).alias("k1"), F.col(text).alias("text"))
    if carry:
        # A table of its own: each row keeps its number, so that carried columns find their row among equal ones.
        held = ["text" if c == text else f"_c{i}" for i, c in enumerate(carry)]
        extra = [F.col(c).alias(h) for c, h in zip(carry, held, strict=True) if h != "text"]
        table = materialize(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), row_key(F.col(text)).alias("k1"), F.col(text).alias("text"), *extra), "jaccard-rows", compression="zstd")
        rows = table.select("rid", "doc_id", "k1", "text")
    found = materialize(rows.mapInArrow(_sizes(True, width, t), _SETS), "jaccard-sets")

    nodes = materialize(found.where("n > 0").groupBy("s1", "s2").agg(F.min("rid").alias("rep")), "jaccard-nodes")
    member = materialize(found.select("rid", "doc_id", "n", "s1", "s2").join(nodes, ["s1", "s2"], "left").select("rid", "doc_id", "n", "rep"), "jaccard-members")
    heads = found.join(member.where("rid = rep").select("rid"), "rid", "left_semi")

    # Round 1: rare tokens of extended prefixes.
    tokens = heads.select("rid", F.explode("prefix").alias("tok"))
    common = materialize(tokens.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1"), "jaccard-common")
    shared = materialize(tokens.join(common, "tok"), "jaccard-tokens")
    lists = shared.where(f"df <= {RARE}").groupBy("tok").agg(F.sort_array(F.collect_list("rid")).alias("m"))
    seen = lists.select(F.explode(F.expr("flatten(transform(sequence(1, size(m) - 1), i -> transform(slice(m, i + 1, size(m)), y -> struct(m[i - 1] as x, y as y))))")).alias("p")).select("p.x", "p.y")
    seen = seen.groupBy("x", "y").agg(F.count("*").alias("rare"))
    frequent = shared.where(f"df > {RARE}").groupBy("rid").agg(F.count("*").alias("nf"))
    facts = found.select("rid", "doc_id", "k1", "n", F.size("prefix").alias("l"), F.array_max("prefix").alias("last")).join(member.where("rid = rep").select("rid"), "rid", "left_semi").join(frequent, "rid", "left").withColumn("nf", F.coalesce("nf", F.lit(0)))
    facts = materialize(facts.join(shared.select("rid").distinct(), "rid", "left_semi"), "jaccard-facts")
    side = lambda s: facts.select(F.col("rid").alias(s), *[F.col(c).alias(c + s) for c in ("n", "l", "last", "nf")])
    rest = "if(lastx <= lasty, nx - lx, ny - ly)"
    pairs = seen.join(side("x"), "x").join(side("y"), "y").where(_enough("least(nx, ny)", "nx", "ny", t)).where(_enough(f"rare + least(nfx, nfy) + {rest}", "nx", "ny", t))
    pairs = materialize(pairs.select("x", "y"), "jaccard-pairs")

    # Whole sets of the nodes that are still of interest.
    dense = facts.where(f"nf >= {_k(_ceil_share('n', t), t)}").select("rid")
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("rid")).unionByName(dense).distinct()
    wanted = facts.join(wanted, "rid", "left_semi").select("rid", F.col("doc_id").alias("d"), F.col("k1").alias("k"))
    again = rows.drop("rid")
    if not found.groupBy("doc_id", "k1").count().where("count > 1").isEmpty():
        again = again.dropDuplicates(["doc_id", "k1"])  # of rows alike one does, and many under one key aren't sent there
    again = again.join(wanted, (F.col("doc_id").eqNullSafe(F.col("d"))) & (F.col("k1") == F.col("k"))).select("rid", "text")
    sets = materialize(again.mapInArrow(_sizes(False, width, t), "rid long, n long, tokens array<long>").dropDuplicates(["rid"]), "jaccard-whole")

    # Round 2: frequent tokens, rarest first, among the dense nodes.
    own = sets.join(dense, "rid", "left_semi").select("rid", "n", F.explode("tokens").alias("tok"))
    counts = own.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    order = own.join(counts, "tok").groupBy("rid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("o"))
    order = order.withColumn("u", F.expr("n - size(o)"))
    p = _p("n", t)
    order = order.withColumn("head", F.expr(f"slice(o, 1, greatest(0, {p} + 1 - u))"))
    singly = f"n <= {LOW} * 100 / {t} or n > {HIGH} * {t} / 100"
    # skip and prev let a pair be made at its first common key only, with a bound from the keys before it.
    order = order.withColumn("f", F.expr(f"transform(filter(head, e -> e.df > {RARE}), e -> e.tok)")).withColumn("h", F.expr("transform(head, e -> e.tok)"))
    none = "cast(array() as array<bigint>)"
    single = f"filter(transform(head, (e, i) -> struct(e.tok as key, e.df > {RARE} as hot, e.df <= {RARE} or (({singly}) and i < {p} - u) as keep, if(n <= {LISTED}, u + i, u) as skip, if(n <= {LISTED} and e.df > {RARE}, slice(h, 1, i), {none}) as prev)), e -> e.keep)"
    two = "struct(xxhash64(f[i - 1], f[j - 1]) as key, true as hot, true as keep, u + size(h) - size(f) + j - 2 as skip, array_remove(slice(h, 1, size(h) - size(f) + j - 1), f[i - 1]) as prev)"
    double = f"if(n between {LOW} and {HIGH} and size(f) > 1, flatten(transform(sequence(1, size(f) - 1), i -> transform(sequence(i + 1, size(f)), j -> {two}))), array())"
    order = order.withColumn("keys", F.expr(f"concat({single}, {double})"))
    keyed = materialize(order.select("rid", "n", "u", F.explode("keys").alias("e")).select("rid", "n", "u", "e.key", "e.hot", "e.skip", "e.prev"), "jaccard-keys")
    cold = keyed.where("not hot").groupBy("key").agg(F.sort_array(F.collect_list("rid")).alias("m")).where("size(m) > 1")
    cold = cold.select(F.explode(F.expr("flatten(transform(sequence(1, size(m) - 1), i -> transform(slice(m, i + 1, size(m)), y -> struct(m[i - 1] as x, y as y))))")).alias("p")).select("p.x", "p.y")
    hot = keyed.where("hot")
    centre = materialize(hot.groupBy("key").agg(F.min(F.struct("u", "rid", "n")).alias("c"), F.count("*").alias("m")).where("m > 1"), "jaccard-centres")
    allowed = lambda nx, ux, ny, uy: _enough(f"least({nx} - {ux}, {ny} - {uy})", nx, ny, t)
    star = join_counted(hot, centre, "key", SQUARE).where("rid <> c.rid").where(allowed("n", "u", "c.n", "c.u")).select(F.least("rid", F.col("c.rid")).alias("x"), F.greatest("rid", F.col("c.rid")).alias("y"))
    links = materialize(_verify(pairs.unionByName(cold).unionByName(star).distinct(), sets, t), "jaccard-links")

    # What the centres left: pairs of different components in one bucket.
    label = connected_components(links, "jaccard-star")
    named = hot.join(label.withColumnRenamed("node", "rid"), "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    mixed = materialize(named.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("m")).where("a <> b").select("key", "m"), "jaccard-mixed-keys")
    named = materialize(join_counted(named, mixed, "key", SQUARE), "jaccard-mixed")
    # Linked sizes lie in one class or in two that follow each other: a class is as wide as the widest ratio of linked sizes.
    named = named.withColumn("class", F.floor(F.log("n") / F.lit(math.log(100 / t) * (1 + 1e-9) if t < 100 else 1e-9)).cast("long"))
    a, b = bucket_sides(named)
    cross = a.join(b, ["key", "class", "across", "down"]).where("(nx < ny or (nx = ny and ridx < ridy)) and labelx <> labely").where(_enough("nx", "nx", "ny", t)).where(allowed("nx", "ux", "ny", "uy"))
    cross = cross.where(f"ny > {LISTED} or (not arrays_overlap(prevx, prevy) and {allowed('nx', 'skipx', 'ny', 'skipy')})")
    late = materialize(_verify(cross.select(F.col("ridx").alias("x"), F.col("ridy").alias("y")).distinct(), sets, t), "jaccard-late")
    # The late links join whole components: only their labels are linked again.
    known = label
    name = lambda c: known.select(F.col("node").alias(c), F.col("label").alias(c + "l"))
    ends = late.join(name("x"), "x", "left").join(name("y"), "y", "left").select(F.coalesce("xl", "x").alias("x"), F.coalesce("yl", "y").alias("y"))
    further = connected_components(ends, "jaccard-components")
    joined = known.unionByName(further.join(known.select("node"), "node", "left_anti")).join(further.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left")
    label = materialize(joined.select("node", F.coalesce("least", "label").alias("label")), "jaccard-labels")
    discard(nodes, common, shared, facts, pairs, sets, keyed, centre, mixed, named, links, late, found, known, further)
    named = member.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep", "rid"))
    named = named.withColumn("label", F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("rid")))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first"))
    least = materialize(least, "jaccard-least")
    out = named.join(least, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("rid").alias("_rid"), (F.col("rid") == F.col("first.rid")).alias("keeps"))
    if not carry:
        return out.drop("_rid")
    beside = table.select(F.col("rid").alias("_rid"), *[F.col(h).alias(c) for c, h in zip(carry, held, strict=True)])
    return beside.join(out, "_rid").drop("_rid")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles of all documents, linked at a Jaccard similarity of 0.85."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return link_documents(docs, width=4, percent=85).select("doc_id", "n_shingles", "component_id")
