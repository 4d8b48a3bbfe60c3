"""Merkle manifest of a table by a tree of SHA-256 midstates.

A row's leaf is the digest of its columns, made by Spark's own ``sha2``. Per group
the leaves ascend by key, and runs of ``arity`` nodes become their parent until one is
left, the group's subroot; the subroots, ordered by group, give the root in the same way.

While a parent is hashed, the state of the hash before each child slot is copied
and kept (``MidstateTree.states``). To fold a changed child, the copy before its slot is
resumed with the replacement and the siblings on its right; what stands on the
left is never hashed again.

A group is cut into aligned blocks of ``block`` consecutive nodes, a power of the
arity. A block is one small task's work and becomes a single node of the next round, so a
group of any size takes log(rows) / log(block) rounds. The way from each block
to the root goes back down through the same blocks, one row per block; at the
bottom it is met by the block's leaves, each of which is folded to the root. Only leaves
travel, never texts.

Defined results: a null is ``-``, any other value its UTF-8 byte count, ``:`` and the value;
null groups form one group, which comes first; null keys come first; rows with
equal keys are ordered by their leaves; equal rows are separate leaves. A group of one row has its leaf as its subroot,
a table of one group its subroot as root. Rows that are not changed are folded with their
own leaf. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressmill.llm.common import materialize, prepare, read, shuffle_parts

ARITY = 2
#: Nodes that one task call holds: the largest power of the arity up to this.
BLOCK = 4096

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One step to the root: the hex digests left and right of the node in its run.
STEPS = "array<struct<left:string,right:string>>"


class MidstateTree:
    """The tree over ``leaves`` (hex digests as bytes), raised ``levels`` times, or until one node is left."""

    def __init__(self, leaves: list[bytes], arity: int = ARITY, levels: int | None = None):
        self.arity = arity
        self.nodes = [leaves]
        self.states: list[list] = []
        while len(self.states) < levels if levels is not None else len(self.nodes[-1]) > 1:
            below, states, above = self.nodes[-1], [], []
            for at in range(0, len(below), arity):
                parent = hashlib.sha256()
                for child in below[at:at + arity]:
                    states.append(parent.copy())
                    parent.update(child)
                above.append(parent.hexdigest().encode())
            self.states.append(states)
            self.nodes.append(above)
        self.root = self.nodes[-1][0]

    def fold(self, at: int, replacement: bytes) -> bytes:
        """The root with the leaf at ``at`` replaced."""
        node = replacement
        for below, states in zip(self.nodes, self.states):
            state = states[at].copy()
            state.update(node)
            for right in below[at + 1:at - at % self.arity + self.arity]:
                state.update(right)
            node = state.hexdigest().encode()
            at //= self.arity
        return node

    def steps(self, at: int) -> list[tuple[bytes, bytes]]:
        """The siblings left and right of the way from the leaf at ``at`` to the root."""
        out = []
        for below in self.nodes[:-1]:
            first = at - at % self.arity
            out.append((b"".join(below[first:at]), b"".join(below[at + 1:first + self.arity])))
            at //= self.arity
        return out


class Way:
    """Steps above a tree; each keeps the state of its parent before the slot of the node."""

    def __init__(self, steps: list[tuple[bytes, bytes]]):
        self.slots = [(hashlib.sha256(left), right) for left, right in steps]

    def fold(self, node: bytes) -> bytes:
        for before, right in self.slots:
            state = before.copy()
            state.update(node + right)
            node = state.hexdigest().encode()
        return node


def record(*values: Column) -> Column:
    """The text that stands for a row of these columns."""
    shown = [v.cast("string") for v in values]
    return F.concat(*[F.when(v.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in shown])


def digest(*values: Column) -> Column:
    return F.sha2(record(*values).cast("binary"), 256)


def _placed(leaves: DataFrame, order: list) -> DataFrame:
    """``leaves`` (with column g) and pos, the place within g in the given order, and n, g's rows. A range
    partition holds bounded parts of groups; counts per partition and group give the rest."""
    spread = leaves.withColumn("tie", F.monotonically_increasing_id())
    cut = materialize(spread.repartitionByRange(shuffle_parts(leaves), "g", *order, "tie")
                      .sortWithinPartitions("g", *order, "tie").drop("tie"))
    row = F.monotonically_increasing_id()
    cut = cut.withColumn("m", row).withColumn("pid", F.shiftright("m", 33))
    parts = cut.groupBy("pid", "g").agg(F.count(F.lit(1)).alias("c"), F.min("m").alias("first"))
    all_of = Window.partitionBy("g")
    parts = parts.select("pid", "g", "first", (F.sum("c").over(all_of.orderBy("pid")) - F.col("c")).alias("before"),
                         F.sum("c").over(all_of).alias("n"))
    return (cut.join(parts, ["pid", "g"]).withColumn("pos", F.col("m") - F.col("first") + F.col("before"))
            .drop("pid", "m", "first", "before"))


def _block_levels(arity: int, block: int) -> tuple[int, int]:
    levels = 1
    while arity ** (levels + 1) <= block:
        levels += 1
    return levels, arity ** levels


def _tree(table: pa.Table, arity: int, levels: int, size: int) -> MidstateTree:
    """The tree of a block's rows, ordered by pos. Where the group goes on beyond the block it is
    raised by all its levels, even if the last block holds less."""
    nodes = [x.encode() for x in table.column("node").to_pylist()]
    return MidstateTree(nodes, arity, levels if table.column("n")[0].as_py() > size else None)


def _raised(nodes: DataFrame, arity: int, block: int) -> DataFrame:
    """One node per block of ``nodes`` (g, pos, n, node): g, pos, n, node."""
    levels, size = _block_levels(arity, block)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table.column("n")[0].as_py()
        return pa.table({"g": table.column("g").slice(0, 1), "pos": table.column("block").slice(0, 1),
                         "n": pa.array([-(-n // size)], pa.int64()),
                         "node": pa.array([_tree(table, arity, levels, size).root.decode()])})

    return (nodes.select("g", "pos", "n", "node", F.expr(f"pos div {size}").alias("block"))
            .groupBy("g", "block").applyInArrow(run, "g string, pos long, n long, node string"))


def _rounds(nodes: DataFrame, arity: int, block: int) -> list[DataFrame]:
    """``nodes`` and what each round of blocks makes of them, up to one node per group."""
    rounds = [nodes]
    while rounds[-1].where("n > 1").limit(1).count():
        rounds.append(materialize(_raised(rounds[-1], arity, block)))
    return rounds


def _ways_down(nodes: DataFrame, ways: DataFrame, arity: int, block: int) -> DataFrame:
    """The ways of single nodes (g, pos, way, subroot, root), given those of their blocks."""
    levels, size = _block_levels(arity, block)
    schema = f"g string, pos long, way {STEPS}, subroot string, root string"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("pos")
        tree = _tree(left, arity, levels, size)
        above = right.column("way")[0].as_py()
        own = [[{"left": a.decode(), "right": b.decode()} for a, b in tree.steps(at)] + above for at in range(len(left))]
        return pa.table({"g": left.column("g"), "pos": left.column("pos"),
                         "way": pa.array(own, right.schema.field("way").type),
                         "subroot": pa.array(right.column("subroot").to_pylist() * len(left), pa.string()),
                         "root": pa.array(right.column("root").to_pylist() * len(left), pa.string())})

    return (nodes.select("g", "pos", "n", "node", F.expr(f"pos div {size}").alias("block")).groupBy("g", "block")
            .cogroup(ways.select("g", F.col("pos").alias("block"), "way", "subroot", "root").groupBy("g", "block"))
            .applyInArrow(run, schema))


def manifest(rows: DataFrame, arity: int = ARITY, block: int = BLOCK) -> DataFrame:
    """``rows`` has group (string), key, leaf and changed (a leaf to fold in its stead, or null). Returns
    key, leaf, subroot, root, proof_sha256 (of the siblings on the way to the root), folded_root, verified."""
    if arity < 2 or block < arity:
        raise ValueError("arity must be at least 2 and block at least the arity")
    prepare(rows.sparkSession)
    key_type = rows.schema["key"].dataType.simpleString()
    levels, size = _block_levels(arity, block)
    # '' is the null group, '+' goes before any name: their order is that of the names, null first
    leaves = rows.select(F.coalesce(F.concat(F.lit("+"), "group"), F.lit("")).alias("g"), "key",
                         F.col("leaf").alias("node"), "changed")
    leaves = materialize(_placed(leaves, ["key", "node"]))
    rounds = _rounds(leaves.select("g", "pos", "n", "node"), arity, block)
    subroots = rounds[-1].select(F.lit("").alias("g"), F.col("g").alias("of"), "node")
    top = materialize(_placed(subroots, ["of"]))
    over = _rounds(top.select("g", "pos", "n", "node"), arity, block)

    # down again: from the root to the subroots, from there to the lowest blocks
    none = F.array().cast(STEPS)
    ways = over[-1].select("g", "pos", none.alias("way"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    for nodes in over[-2::-1]:
        ways = _ways_down(nodes, ways, arity, block)
    ways = top.join(ways.drop("subroot"), ["g", "pos"]).select(F.col("of").alias("g"), F.lit(0).cast("long").alias("pos"),
                                                               "way", F.col("node").alias("subroot"), "root")
    if len(rounds) == 1:  # no group has more than one leaf
        rounds = rounds * 2
    for nodes in rounds[-2:0:-1]:
        ways = materialize(_ways_down(nodes, ways, arity, block))

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("pos")
        tree = _tree(left, arity, levels, size)
        above = [(s["left"].encode(), s["right"].encode()) for s in right.column("way")[0].as_py()]
        way, tail = Way(above), b"".join(a + b for a, b in above)
        subroot, root = right.column("subroot")[0].as_py(), right.column("root")[0].as_py()
        proofs, folded = [], []
        for at, (own, changed) in enumerate(zip(tree.nodes[0], left.column("changed").to_pylist())):
            siblings = b"".join(a + b for a, b in tree.steps(at)) + tail
            proofs.append(hashlib.sha256(siblings).hexdigest())
            folded.append(way.fold(tree.fold(at, own if changed is None else changed.encode())).decode())
        return pa.table({"key": left.column("key"), "leaf": left.column("node"),
                         "subroot": pa.array([subroot] * len(left), pa.string()),
                         "root": pa.array([root] * len(left), pa.string()),
                         "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()),
                         "verified": pa.array([f == root for f in folded], pa.bool_())})

    blocks = leaves.withColumn("block", F.expr(f"pos div {size}")).groupBy("g", "block")
    ways = ways.select("g", F.col("pos").alias("block"), "way", "subroot", "root").groupBy("g", "block")
    return blocks.cogroup(ways).applyInArrow(
        fold, f"key {key_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
              "verified boolean")


def op12_merkle_manifest(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents", *FIELDS)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    tampered = digest(*[more if c == "n_chars" else F.col(c) for c in FIELDS])
    rows = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("key"),
                       digest(*[F.col(c) for c in FIELDS]).alias("leaf"), F.when(hit, tampered).alias("changed"))
    return manifest(rows).withColumnRenamed("key", "doc_id")


_SQL_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"

OP12_SQL = r"""
WITH RECURSIVE
d AS MATERIALIZED (
  SELECT doc_id, lang, sha256({record}) AS leaf, sha256({changed}) AS changed,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
               lambda c: ascii(c)::BIGINT)),
             lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
               lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) AS crc
  FROM documents),
p AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS rid,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n
  FROM d),
up AS (
  SELECT lang, 0 AS lvl, pos, n, leaf AS node FROM p
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, any_value(n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos))
  FROM up WHERE n > 1 GROUP BY lang, lvl, pos // 2),
s AS MATERIALIZED (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, pos, n, subroot AS node FROM s
  UNION ALL
  SELECT lvl + 1, pos // 2, any_value(n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos))
  FROM top WHERE n > 1 GROUP BY lvl, pos // 2),
w AS MATERIALIZED (  -- the way of each row: its nodes' places and their siblings
  SELECT p.rid, 0 AS phase, o.lvl, o.pos, b.node AS sibling
  FROM p JOIN up o ON o.lang IS NOT DISTINCT FROM p.lang AND o.n > 1 AND o.pos = p.pos >> o.lvl
  LEFT JOIN up b ON b.lang IS NOT DISTINCT FROM p.lang AND b.lvl = o.lvl AND b.pos = xor(o.pos, 1)
  UNION ALL
  SELECT p.rid, 1, o.lvl, o.pos, b.node
  FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang JOIN top o ON o.n > 1 AND o.pos = s.pos >> o.lvl
  LEFT JOIN top b ON b.lvl = o.lvl AND b.pos = xor(o.pos, 1)),
steps AS MATERIALIZED (
  SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY phase, lvl) - 1 AS step, pos, coalesce(sibling, '') AS sibling
  FROM w),
fold AS (
  SELECT rid, 0 AS step, CASE WHEN crc % 7 = 0 THEN changed ELSE leaf END AS node FROM p
  UNION ALL
  SELECT f.rid, f.step + 1, sha256(CASE WHEN t.pos % 2 = 1 THEN t.sibling || f.node ELSE f.node || t.sibling END)
  FROM fold f JOIN steps t ON t.rid = f.rid AND t.step = f.step),
proof AS (SELECT rid, string_agg(sibling, '' ORDER BY step) AS siblings FROM steps GROUP BY rid),
last AS (SELECT rid, arg_max(node, step) AS folded_root FROM fold GROUP BY rid)
SELECT p.doc_id, p.leaf, s.subroot, r.node AS root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root,
       folded_root = r.node AS verified
FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang CROSS JOIN (SELECT node FROM top WHERE n = 1) r
LEFT JOIN proof USING (rid) JOIN last USING (rid)
""".replace("{record}", " || ".join(_SQL_FIELD.format(c) for c in FIELDS)).replace(
    "{changed}", " || ".join(_SQL_FIELD.format("(n_chars + 1)" if c == "n_chars" else c) for c in FIELDS))
