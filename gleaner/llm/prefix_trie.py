"""Prefix trie of conversations, family first.

A conversation's first turns are lent by the base conversation of its family (FAMILY ids in a row): rebuilt, the
members of a family share most of their prefixes. Turns are numbered in the order of all conversations by range
partitions, so a conversation of any length is nobody's single task, and are digests from then on.

* Families are cogrouped by base id with their base's first turns and what is known of each member. A task rebuilds
  its members' paths and combines them into the family's small trie. A longer conversation comes in blocks of BLOCK
  turns, each a group of its own, so that no group has more than FAMILY * BLOCK turns.
* Only the combined nodes of families are shuffled; nodes of one prefix are merged over all families.
* A node's value (is it childless, what would it save) belongs to its smallest member, which passes through all
  ancestors. The families are cogrouped a second time with these values, sum them along their members' paths and
  again shuffle one row per family node. So subtree sums need no walk through the levels of the trie.

A node's key is 128 bits: the exclusive or of a hash of depth and turn over its turns. It can be continued at any depth
from the key there, which is how blocks of one conversation fit together.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import discard, join_counted, materialize
from gleaner.llm.shingles import U, mix
from gleaner.operators.running import running

#: Ids of one family, modulus of the number of lent turns, turns of one group's member, rows of one parent in one task.
FAMILY, LENT, BLOCK, HOT = 20, 4, 1_000, 2_000
#: Decimal ids of one piece of an ends list.
PIECE_IDS = 4_096
_EMPTY = hashlib.sha256(b"").hexdigest()

_WORDS = r"[^\x20\x09-\x0D]+"
#: What stands beside a family's turns: its members (last block, turns of the base), lent turns, keys at the begin of later
#: blocks, values of nodes, values of all later blocks.
MEMBER, LOAN, CARRY, VALUE, LATER = range(5)
_BESIDE = "base long, block long, kind int, conv_id long, at long, a long, b long, words long"
_NODES = "k1 long, k2 long, depth long, p1 long, p2 long, n_convs long, conv_id long, block long, src long, pos long, words long, ends array<long>"


def lent_turns(conv_id: int) -> int:
    """How many first turns the base lends."""
    return zlib.crc32(str(conv_id).encode()) % LENT


def turn_keys(x1: np.ndarray, x2: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of turns (two digests) at their depths."""
    with np.errstate(over="ignore"):
        d = depth.astype(U)
        return mix(x1.view(U) ^ mix(d * U(0x9E3779B97F4A7C15))), mix(x2.view(U) ^ mix(d * U(0xD1342543DE82EF95) + U(1)))


class _Path:
    """A member's turns within one block: keys and depths, from the key where the block begins."""

    def __init__(self, conv_id: int, block: int, base: int, base_turns: int, loans: list, carry: tuple, own: tuple):
        h = lent_turns(conv_id)
        t = min(h, base_turns)
        pos, x1, x2, words = own
        stay = pos > h
        pos, x1, x2, words = pos[stay], x1[stay], x2[stay], words[stay]
        depth, src = pos - h + t, np.full(len(pos), conv_id, np.int64)
        if block == 0 and t:
            lent = np.array(sorted(loans)[:t], np.int64)  # (pos, x1, x2, words)
            depth, src, pos = np.concatenate((lent[:, 0], depth)), np.concatenate((np.full(t, base), src)), np.concatenate((lent[:, 0], pos))
            x1, x2, words = np.concatenate((lent[:, 1], x1)), np.concatenate((lent[:, 2], x2)), np.concatenate((lent[:, 3], words))
        k1, k2 = turn_keys(np.ascontiguousarray(x1), np.ascontiguousarray(x2), depth)
        start = np.array(carry, np.int64).view(U)
        keys = [np.bitwise_xor.accumulate(np.concatenate(([s], k))).view(np.int64).tolist() for s, k in zip(start, (k1, k2), strict=True)]
        self.conv_id, self.block = conv_id, block
        self.keys = list(zip(*keys, strict=True))  # the first is the begin's, for block 0 the root
        self.depth, self.words, self.src, self.pos = [depth[0] - 1 if block else 0, *depth.tolist()], [0, *words.tolist()], [conv_id, *src.tolist()], [0, *pos.tolist()]


def _paths(key, turns: pa.Table, beside: pa.Table) -> tuple[list[_Path], list[dict]]:
    """The members' paths by conv_id, and all that stands beside the turns."""
    base, block = key[0].as_py(), key[1].as_py()
    facts = beside.to_pylist()
    loans = [(r["at"], r["a"], r["b"], r["words"]) for r in facts if r["kind"] == LOAN]
    carry = {r["conv_id"]: (r["a"], r["b"]) for r in facts if r["kind"] == CARRY}
    turns = turns.sort_by([("conv_id", "ascending"), ("pos", "ascending")])
    conv, *cols = (turns.column(c).to_numpy() for c in ("conv_id", "pos", "x1", "x2", "words"))
    out = []
    for r in sorted(facts, key=lambda r: r["conv_id"] or 0):
        if r["kind"] == MEMBER:
            a, b = np.searchsorted(conv, [r["conv_id"], r["conv_id"] + 1])
            out.append(_Path(r["conv_id"], block, base, r["b"], loans, carry.get(r["conv_id"], (0, 0)), tuple(c[a:b] for c in cols)))
    return out, facts


def _table(rows: list[tuple], shape: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(shape)], schema=shape)


_NODE_SCHEMA = pa.schema([(c.split()[0], pa.int64()) for c in _NODES.split(", ")[:-1]] + [("ends", pa.list_(pa.int64()))])
_SUM_SCHEMA = pa.schema([(c, pa.int64()) for c in ("k1", "k2", "leaves", "saved")])


def _family_trie(key, turns: pa.Table, beside: pa.Table) -> pa.Table:
    """The combined nodes of a family's members."""
    nodes: dict[tuple, list] = {}
    paths, facts = _paths(key, turns, beside)
    ending = {r["conv_id"] for r in facts if r["kind"] == MEMBER and r["at"] == r["block"]}
    for path in paths:
        for i, k in enumerate(path.keys):
            if i == 0 and path.block:
                continue
            node = nodes.get(k)
            if node is None:
                nodes[k] = node = [*k, path.depth[i], *(path.keys[i - 1] if i else (None, None)), 0, path.conv_id, path.block, path.src[i], path.pos[i], path.words[i], []]
            node[5] += 1
        if path.conv_id in ending:
            nodes[path.keys[-1]][-1].append(path.conv_id)
    return _table([tuple(n) for n in nodes.values()], _NODE_SCHEMA)


def _family_sums(key, turns: pa.Table, beside: pa.Table) -> pa.Table:
    """Values of the members' own nodes, summed over each family node's subtree."""
    paths, facts = _paths(key, turns, beside)
    values = {(r["conv_id"], r["at"]): (r["a"], r["b"]) for r in facts if r["kind"] == VALUE}
    later = {r["conv_id"]: (r["a"], r["b"]) for r in facts if r["kind"] == LATER}
    sums: dict[tuple, list[int]] = {}
    for path in paths:
        leaves, saved = later.get(path.conv_id, (0, 0))
        for i in range(len(path.keys) - 1, 0 if path.block else -1, -1):
            a, b = values.get((path.conv_id, path.depth[i]), (0, 0))
            leaves, saved = leaves + a, saved + b
            if leaves or saved:
                own = sums.setdefault(path.keys[i], [0, 0])
                own[0] += leaves
                own[1] += saved
    return _table([(*k, *v) for k, v in sums.items()], _SUM_SCHEMA)


def _block_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k1, k2 = turn_keys(*(np.ascontiguousarray(batch.column(c).to_numpy()) for c in ("x1", "x2", "depth")))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))], ["conv_id", "block", "a", "b"])


# Ends ----------------------------------------------------------------------------------------------------------------


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k1, k2, conv_id) in order to pieces (k1, k2, first, text): runs of ids of one node, joined by commas."""
    names, held, key = ["k1", "k2", "first", "text"], [], None
    out: list[tuple] = []
    for batch in batches:
        for a, b, c in zip(*(batch.column(x).to_pylist() for x in ("k1", "k2", "conv_id")), strict=True):
            if held and ((a, b) != key or len(held) == PIECE_IDS):
                out.append((*key, held[0], ",".join(map(str, held))))
                held = []
            key = (a, b)
            held.append(c)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names)
            out = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, held[0], ",".join(map(str, held)))], names)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to (k1, k2, sha) of each node's whole list, one piece at a time."""
    key, sha = None, None
    for batch in batches:
        out = []
        for a, b, text in zip(*(batch.column(x).to_pylist() for x in ("k1", "k2", "text")), strict=True):
            if (a, b) == key:
                sha.update(b"," + text.encode())
            else:
                if key:
                    out.append((*key, sha.hexdigest()))
                key, sha = (a, b), hashlib.sha256(text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["k1", "k2", "ends_sha256"])
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, sha.hexdigest())], ["k1", "k2", "ends_sha256"])


# Trie ----------------------------------------------------------------------------------------------------------------


def _base(conv: str):
    return F.col(conv) - F.col(conv) % FAMILY


def _beside(df: DataFrame, kind: int, **cols) -> DataFrame:
    given = {"conv_id": None, "at": None, "a": None, "b": None, "words": None} | cols
    return df.select("base", F.col("block").cast("long").alias("block"), F.lit(kind).alias("kind"), *[(F.lit(v).cast("long") if v is None else F.col(v)).alias(c) for c, v in given.items()])


def _carries(turns: DataFrame, members: DataFrame, loans: DataFrame, size: int) -> DataFrame | None:
    """(conv_id, block, a, b): keys where the later blocks of long conversations begin; None where there are none."""
    long = members.where(f"n > {size}").withColumns({"h": F.expr(f"crc32(cast(conv_id as string)) % {LENT}")}).withColumn("t", F.least("h", "base_turns"))
    if long.isEmpty():
        return None
    own = join_counted(turns, long.select("conv_id", "h", "t", F.col("n").alias("m")), "conv_id", size).where("pos > h")
    own = own.select("conv_id", "block", "x1", "x2", F.expr("pos - h + t").alias("depth"))
    lent = long.join(loans.withColumnRenamed("conv_id", "base"), "base").where("pos <= t").select("conv_id", F.lit(0).cast("long").alias("block"), "x1", "x2", F.col("pos").alias("depth"))
    keys = own.unionByName(lent).mapInArrow(_block_keys, "conv_id long, block long, a long, b long").groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return keys.select("conv_id", "block", F.bit_xor("a").over(before).alias("a"), F.bit_xor("b").over(before).alias("b")).where("block > 0").withColumn("base", _base("conv_id"))


def prefix_trie(conversations: DataFrame, with_text: bool = False, block: int = BLOCK, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 and, with_text, role and text of its last turn.

    Turns are ordered by turn, null first; equal turns by role and then by a digest of role and text, so repeated rows
    are turns of their own. Null roles and texts are empty. Rows with a null conv_id belong to no conversation and go.
    Other columns, whatever their names, play no part. An empty table gives no rows, not even a root. Turns of one
    conversation beyond ``block`` (LENT at least) are other groups' work. The result reads a stage table, which
    discard() deletes.
    """
    own = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).where("conv_id is not null")
    own = own.withColumns({"x1": F.xxhash64(F.lit(1), "role", "text"), "x2": F.xxhash64(F.lit(2), "role", "text"), "words": F.regexp_count("text", F.lit(_WORDS)).cast("long")})
    own = own if with_text else own.drop("text")
    order = running(own, ["conv_id"], [F.col("turn").asc_nulls_first(), "role", "x1", "x2"], sums={"pos": F.lit(1).cast("long")}, name="trie-order")
    told = materialize(order.drop("turn", *([] if with_text else ["role"])).withColumns({"base": _base("conv_id"), "block": F.expr(f"(pos - 1) div {block}")}), "trie-turns")
    discard(order)
    turns = told.select("base", "block", "conv_id", "pos", "x1", "x2", "words")

    # A family has at most FAMILY members and LENT - 1 turns to lend; these joins have no large keys.
    sizes = turns.groupBy("base", "conv_id").agg(F.count("*").alias("n"))
    members = sizes.join(sizes.where("conv_id = base").select("base", F.col("n").alias("base_turns")), "base", "left").withColumn("base_turns", F.coalesce("base_turns", F.lit(0)))
    members = materialize(members, "trie-members")
    loans = turns.where(f"conv_id = base and pos < {LENT}").select("conv_id", "pos", "x1", "x2", "words")
    blocks = members.withColumn("last", F.expr(f"(n - 1) div {block}")).withColumn("block", F.explode(F.expr("sequence(0L, last)")))
    beside = _beside(blocks, MEMBER, conv_id="conv_id", at="last", b="base_turns").unionByName(_beside(loans.select(F.col("conv_id").alias("base"), F.lit(0).alias("block"), "pos", "x1", "x2", "words"), LOAN, at="pos", a="x1", b="x2", words="words"))
    carries = _carries(turns, members, loans, block)
    if carries is not None:
        beside = beside.unionByName(_beside(carries, CARRY, conv_id="conv_id", a="a", b="b"))
    beside = materialize(beside, "trie-beside")
    by = lambda df: df.groupBy("base", "block")
    family = materialize(by(turns).cogroup(by(beside)).applyInArrow(_family_trie, _NODES), "trie-family")

    merged = family.groupBy("k1", "k2").agg(F.min("depth").alias("depth"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.sum("n_convs").alias("n_convs"), F.max("words").alias("words"), F.min(F.struct("conv_id", "block", "src", "pos")).alias("least"))
    merged = materialize(merged.select("k1", "k2", "depth", "p1", "p2", "n_convs", "words", "least.*"), "trie-merged")
    children = merged.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = materialize(merged.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")
    above = nodes.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("n_children").alias("m"), F.col("conv_id").alias("parent_conv_id"))
    named = join_counted(nodes.where("depth > 0"), above, ["p1", "p2"], HOT).drop("m").unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))

    values = nodes.withColumns({"base": _base("conv_id"), "leaf": (F.col("n_children") == 0).cast("long"), "saves": (F.col("n_convs") - 1) * F.col("words")}).where("leaf > 0 or saves > 0")
    beside2 = beside.unionByName(_beside(values, VALUE, conv_id="conv_id", at="depth", a="leaf", b="saves"))
    if carries is not None:
        after = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
        own_sums = values.groupBy("conv_id", "block").agg(F.sum("leaf").alias("leaf"), F.sum("saves").alias("saves"))
        later = blocks.where("last > 0").join(own_sums, ["conv_id", "block"], "left").withColumns({"leaf": F.sum("leaf").over(after), "saves": F.sum("saves").over(after)}).where("leaf is not null")
        beside2 = beside2.unionByName(_beside(later, LATER, conv_id="conv_id", a="leaf", b="saves"))
    sums = by(turns).cogroup(by(beside2)).applyInArrow(_family_sums, "k1 long, k2 long, leaves long, saved long").groupBy("k1", "k2").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    ids = family.select("k1", "k2", F.explode("ends").alias("conv_id"))
    pieces = ids.repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(_joined, "k1 long, k2 long, first long, text string")
    ends = pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_digested, "k1 long, k2 long, ends_sha256 string")

    out = named.join(sums, ["k1", "k2"], "left").join(ends, ["k1", "k2"], "left")
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256")]
    if with_text:
        said = told.select(F.col("conv_id").alias("src"), "pos", "role", "text")
        out, cols = out.join(said, ["src", "pos"], "left"), [*cols, "role", "text"]
    result = materialize(out.select(*cols), "trie-result")
    discard(told, members, beside, family, merged, nodes)
    return result


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt from their families' bases."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), x -> [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384::BIGINT) ELSE crc >> 1 END), 4294967295::BIGINT)".replace("x -> [", "lambda x: [")

OP13_SQL = f"""
WITH o AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, own, {_CRC} % {LENT} AS h FROM o),
b AS (SELECT h.conv_id, list_concat(coalesce(base.own, [])[1:h.h], h.own[h.h + 1:]) AS turns FROM h LEFT JOIN o base ON base.conv_id = h.conv_id - h.conv_id % {FAMILY}),
p AS (SELECT conv_id, turns, d, turns[1:d] AS k FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM b)),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(turns) = d), '') AS ends FROM p GROUP BY k, d),
c AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(k[d].t, '[^\\x20\\x09-\\x0D]+')) END AS saves FROM n LEFT JOIN c USING (k)),
s AS (SELECT a AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saves) AS saved_tokens FROM (SELECT k[1:i] AS a, n_children, saves FROM (SELECT k, n_children, saves, unnest(range(d + 1)) AS i FROM v)) GROUP BY a)
SELECT v.conv_id, v.d::BIGINT AS depth, CASE WHEN v.d > 0 THEN u.conv_id END AS parent_conv_id, v.n_convs::BIGINT AS n_convs, v.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN s ON s.k = v.k LEFT JOIN n u ON v.d > 0 AND u.k = v.k[1:v.d - 1]
"""
