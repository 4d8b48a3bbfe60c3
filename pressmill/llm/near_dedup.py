"""Near-duplicate groups by MinHash with tensored banding.

A document is the set of its word shingles. Two small collections of hashes are
computed, U_1..U_m and V_1..V_m, each a group of ``ROWS`` minhashes; the table
keys are all pairs (U_i, V_j). So m * m tables of 2 * ROWS minhashes each come from
2 * m * ROWS minhash computations. Documents that share a key are candidates, and every
candidate is confirmed on the full shingle sets before it counts as a link.

With m = 16 and ROWS = 3 a pair of similarity s shares a key with probability
(1 - (1 - s**3)**16)**2: 0.99998 at 0.8, 0.0001 at 0.1.

How it stays linear where groups are large:

- Documents of equal shingle sets are one class; only its smallest id goes on.
- A key is made only if both its halves occur in another document too.
- In each table every member is first paired with the table's smallest id only. Links found
  so give components, and most members of a large group are in one by then.
- Tables of the same members count once.
- What is left are tables that hold several components. Their members, each written once beside the table's
  smallest id, are joined into families; a family's documents, in order of size, are dealt into blocks of bounded
  weight, and every two blocks between which sizes can fit meet in one task. Documents of different components that share a
  table (one of the U and one of the V) are compared in memory there, so no candidate pair
  is skipped and no row is made per pair or per component: a document goes to as many tasks as there are
  blocks of its size in its family, and a task gives as many links as it takes to connect what it connects.
- Pairs whose minhashes agree in far fewer places than the threshold asks
  for (five standard deviations) are not fetched for confirmation.

Components come from alternating large-star and small-star steps on the links.
Shingles are compared by 64-bit hashes. Links between documents of one id do not matter.

Defined results: a text of fewer words than a shingle is one shingle of all of
them; a text without words (or null) has an empty set and links with nothing; rows repeated
with one id are one document with the larger set; rows with null ids each stand alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressmill.llm.common import compact, materialize, prepare, read, shuffle_parts

SHINGLE = 5
THRESHOLD = 80  # per cent
COLLECTIONS = 16
ROWS = 3
SEED = 77
#: Shingles that the documents of a block have, each document counting as ``DOC_WEIGHT`` more.
BLOCK_WEIGHT = 1 << 18
DOC_WEIGHT = 128
#: Words remembered per worker.
MEMORY = 1_000_000
#: Shingles hashed at a time: bounds a worker's memory on very long texts.
STEP = 4096

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Sketcher:
    def __init__(self, size: int = SHINGLE, collections: int = COLLECTIONS, rows: int = ROWS, seed: int = SEED):
        if size < 1:
            raise ValueError("a shingle has one word at least")
        self.size, self.collections, self.rows = size, collections, rows
        rng = np.random.default_rng(seed)
        n = 2 * collections * rows
        self.mult = rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        self.weights = rng.integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.known: dict[bytes, int] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes."""
        words = (text or "").encode("utf-8").translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > MEMORY:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        for w in words:
            if len(w) > 64:
                known.pop(w, None)
        width = min(self.size, len(codes))
        out = np.full(len(codes) - width + 1, np.uint64(width), np.uint64)
        for k in range(width):
            out = _mix((out ^ codes[k:k + len(out)]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
        return np.unique(out)

    def minhashes(self, shingles: np.ndarray) -> np.ndarray:
        """16 bits of each minhash (the low bits of the smallest 48-bit value)."""
        low = np.full(len(self.mult), np.uint64(0xFFFFFFFFFFFFFFFF))
        for i in range(0, len(shingles), STEP):
            part = shingles[i:i + STEP, None] * self.mult[None, :] + self.add[None, :]
            np.minimum(low, part.min(axis=0), out=low)
        return (_mix(low) & np.uint64(0xFFFF)).astype(np.uint16)

    def halves(self, minhashes: np.ndarray) -> np.ndarray:
        """One 64-bit code per group of minhashes: U_1..U_m, then V_1..V_m."""
        groups = minhashes.reshape(2 * self.collections, self.rows).astype(np.uint64)
        code = np.arange(1, 2 * self.collections + 1, dtype=np.uint64)
        for k in range(self.rows):
            code = _mix((code ^ groups[:, k]) * self.weights[k])
        return code.view(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def sketches(src: DataFrame, sketcher_args: tuple) -> DataFrame:
    """doc_id, n (set size), content (digest of the set), sig (minhashes), halves."""

    def run(batches):
        s = Sketcher(*sketcher_args)
        for b in batches:
            n, content, sig, halves = [], [], [], []
            for t in b.column(1).to_pylist():
                sh = s.shingles(t)
                n.append(len(sh))
                content.append(hashlib.blake2b(sh.tobytes(), digest_size=16).digest())
                m = s.minhashes(sh) if len(sh) else None
                sig.append(None if m is None else m.tobytes())
                halves.append([] if m is None else s.halves(m).tolist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(content, pa.binary()), pa.array(sig, pa.binary()),
                 pa.array(halves, pa.list_(pa.int64()))], names=["doc_id", "n", "content", "sig", "halves"])

    return src.mapInArrow(run, "doc_id long, n long, content binary, sig binary, halves array<long>")


def table_members(reps: DataFrame, collections: int) -> DataFrame:
    """(lead, id) of the tables that hold two documents or more: each member with the table's smallest id, once."""
    half = reps.select(F.col("doc_id").alias("id"), F.posexplode("halves").alias("at", "h"))
    shared = half.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h")
    # a document has 2 * collections halves, so these lists are bounded
    live = (half.join(shared, "h").groupBy("id")
            .agg(F.collect_list(F.when(F.col("at") < collections, F.col("h"))).alias("u"),
                 F.collect_list(F.when(F.col("at") >= collections, F.col("h"))).alias("v")))
    keys = live.select("id", F.explode(F.flatten(F.transform(
        "u", lambda a: F.transform("v", lambda b: F.xxhash64(a, b))))).alias("key"))
    tables = keys.groupBy("key").agg(
        F.min("id").alias("lead"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("members"),
        F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).where("lead < hi")
    # tables of the same members count once
    tables = tables.groupBy("lead", "hi", "members", "x", "y").agg(F.min("key").alias("key")).select("key", "lead")
    return materialize(keys.join(tables, "key").where("lead < id").select("lead", "id").distinct())


def _alike(pairs: DataFrame, reps: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) that sizes and minhashes do not rule out."""
    info = reps.select("doc_id", "n", "sig")
    p = (pairs.join(info.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
         .join(info.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
         .where((100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))))

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.array([np.frombuffer(v, np.uint16) for v in b.column(2).to_pylist()])
                y = np.array([np.frombuffer(v, np.uint16) for v in b.column(3).to_pylist()])
                share = (x == y).mean(axis=1)
                t, k = threshold / 100, x.shape[1]
                fine = share >= t - 5 * np.sqrt(t * (1 - t) / k)
                yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(fine))

    return p.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _full_sets(src: DataFrame, ids: DataFrame, sketcher_args: tuple) -> DataFrame:
    """(doc_id, set): the full shingle sets of ``ids`` (doc_id)."""

    def sets(batches):
        s = Sketcher(*sketcher_args)
        for b in batches:
            found = [s.shingles(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f.tobytes() for f in found], pa.binary())],
                                             names=["doc_id", "set"])

    full = src.where("doc_id IS NOT NULL").join(ids.distinct(), "doc_id", "left_semi").mapInArrow(sets, "doc_id long, set binary")
    # of rows repeated with one id the larger set counts
    return materialize(full.groupBy("doc_id").agg(F.max_by("set", F.struct(F.octet_length("set"), "set")).alias("set")))


def _confirm(pairs: DataFrame, src: DataFrame, sketcher_args: tuple, threshold: int) -> DataFrame:
    """Pairs whose full shingle sets are alike enough. ``pairs`` is a written table."""
    full = _full_sets(src, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), sketcher_args)

    def compare(batches):
        for b in batches:
            fine, last, a = [], None, None
            for key, x, y in zip(*(b.column(c).to_pylist() for c in (0, 2, 3))):
                if key != last:
                    last, a = key, np.frombuffer(x, np.uint64)
                c = np.frombuffer(y, np.uint64)
                both = np.concatenate([a, c])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                fine.append(100 * common >= threshold * (len(both) - common))
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(fine, pa.bool_()))

    with_b = pairs.join(full.select(F.col("doc_id").alias("b"), F.col("set").alias("sb")), "b")
    both = with_b.join(full.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), "a").select("a", "b", "sa", "sb")
    return both.mapInArrow(compare, "a long, b long")


def _dealt(docs: DataFrame) -> DataFrame:
    """``docs`` (family, doc_id, n, ...) with block: the families' documents in order of size, in blocks of bounded
    weight. A range partition holds a bounded part of a family; sums per partition give the rest."""
    order = ["family", "n", "doc_id"]
    cut = materialize(docs.repartitionByRange(shuffle_parts(docs), *order).sortWithinPartitions(*order)
                      .withColumn("pid", F.spark_partition_id()))
    weight = F.col("n") + F.lit(DOC_WEIGHT)
    within = Window.partitionBy("pid", "family").orderBy("n", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy("pid", "family").agg(F.sum(weight).alias("w"))
    parts = parts.select("pid", "family", (F.sum("w").over(Window.partitionBy("family").orderBy("pid")) - F.col("w")).alias("before"))
    at = F.coalesce(F.sum(weight).over(within), F.lit(0)) + F.col("before")
    return (cut.join(parts, ["pid", "family"]).withColumn("block", F.floor(at / F.lit(BLOCK_WEIGHT)).cast("long")).drop("pid", "before"))


def _block_pairs(docs: DataFrame, threshold: int) -> DataFrame:
    """(family, x, y): the blocks x <= y of a family between which a link's sizes fit."""
    spans = docs.groupBy("family", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return (spans.select("family", F.col("block").alias("x"), F.col("hi").alias("xhi"))
            .join(spans.select("family", F.col("block").alias("y"), F.col("lo").alias("ylo")), "family")
            .where((F.col("x") <= F.col("y")) & (100 * F.col("xhi") >= threshold * F.col("ylo"))).select("family", "x", "y"))


def _meet(sides: DataFrame, compare, schema: str) -> DataFrame:
    """Bring each unit's (family, x, y) documents of block x (side 0), then those of block y (side 1), past
    ``compare(unit, ids, datas)``, which takes side 0 and returns a function of a document (id, data) of side 1 giving
    output rows, and one of the end."""
    unit_of = ["family", "x", "y"]
    parts = max(8, shuffle_parts(sides))
    sorted_ = (sides.select(*unit_of, "side", "doc_id", "data").repartition(parts, *unit_of)
               .sortWithinPartitions(*unit_of, "side", "doc_id"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        unit, ids, datas, call, end = None, [], [], None, None
        for b in batches:
            out = []
            for f, x, y, side, doc, value in zip(*(b.column(c).to_pylist() for c in range(6))):
                if (f, x, y) != unit:
                    out += end() if end else []
                    unit, ids, datas, call, end = (f, x, y), [], [], None, None
                if side == 0:
                    ids.append(doc)
                    datas.append(value)
                elif ids:
                    if call is None:
                        call, end = compare(unit, ids, datas)
                    out += call(doc, value)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
        if end and (out := end()):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return sorted_.mapInArrow(run, schema)


def _meet_sketches(threshold: int, collections: int):
    """The documents of each side that have a partner in another component which shares a table with them and
    which minhashes and sizes do not rule out."""

    def compare(unit, ids, datas):
        heads = np.array([np.frombuffer(d[:16], ">i8") for d in datas])
        n, component = heads[:, 0], heads[:, 1]
        halves = np.array([np.frombuffer(d[16:16 + 16 * collections], ">i8") for d in datas])
        sig = np.array([np.frombuffer(d[16 + 16 * collections:], np.uint16) for d in datas])
        used = np.zeros(len(ids), bool)
        t, k = threshold / 100, sig.shape[1]
        least = (t - 5 * np.sqrt(t * (1 - t) / k)) * k

        def call(doc, value):
            own, of = np.frombuffer(value[:16], ">i8")
            near = np.flatnonzero((component != of) & (100 * np.minimum(n, own) >= threshold * np.maximum(n, own)))
            if len(near):
                near = near[(sig[near] == np.frombuffer(value[16 + 16 * collections:], np.uint16)).sum(axis=1) >= least]
            if len(near):
                same = halves[near] == np.frombuffer(value[16:16 + 16 * collections], ">i8")
                near = near[same[:, :collections].any(axis=1) & same[:, collections:].any(axis=1)]
            if not len(near):
                return []
            used[near] = True
            return [(*unit, 1, doc)]

        return call, lambda: [(*unit, 0, ids[k]) for k in np.flatnonzero(used)]

    return compare


def _meet_sets(threshold: int):
    """Links between documents whose full sets are alike enough, as many as it takes to connect what they connect: the
    components that a unit has joined already are remembered in it."""

    def compare(unit, ids, datas):
        component = [int.from_bytes(d[:8], "big", signed=True) for d in datas]
        sets = [np.frombuffer(d[8:], np.uint64) for d in datas]
        n = np.array([len(x) for x in sets])
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        root: dict[int, int] = {}

        def find(c):
            while (up := root.get(c, c)) != c:
                root[c] = c = root.get(up, up)
            return c

        def call(doc, value):
            of, own = int.from_bytes(value[:8], "big", signed=True), np.frombuffer(value[8:], np.uint64)
            lo, hi = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
            count = hi - lo
            at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            common = np.bincount(owner[at], minlength=len(sets))
            out = []
            for k in np.flatnonzero(100 * common >= threshold * (n + len(own) - common)).tolist():
                a, b = find(component[k]), find(of)
                if a != b:
                    root[a] = b
                    out.append((ids[k], doc))
            return out

        return call, lambda: []

    return compare


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id that has a link: the smallest id reachable.
    Alternating large-star and small-star steps; each is an aggregate with map-side
    minima and a join, so a hub's links are not gathered anywhere."""
    edges = compact(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    if edges.isEmpty():
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    while True:
        # large star: every larger neighbour goes to the smallest of the neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u > v").distinct())
        # small star: every smaller neighbour, and the node, go to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        after = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        after = compact(after)
        # a star forest: no id is both a leaf and a centre, and each leaf has one centre
        leaves = after.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        settled = leaves.where("n > 1").isEmpty() and after.join(after.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()
        edges = after
        if settled:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def near_links(src: DataFrame, reps: DataFrame, sketcher_args: tuple, threshold: int) -> DataFrame:
    """(id, component) of the representatives that have a link."""
    pairs = table_members(reps, sketcher_args[1]).select(F.col("lead").alias("a"), F.col("id").alias("b"))
    star = compact(_alike(pairs, reps, threshold))
    links = compact(_confirm(star, src, sketcher_args, threshold))
    groups = components(links)

    # leads whose tables still hold several components: their members form families
    of = groups.select("id", "component")
    labelled = (pairs.join(of.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left")
                .join(of.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
                .select("a", "b", (F.coalesce("ca", "a") != F.coalesce("cb", "b")).alias("apart")))
    leads = labelled.where("apart").select("a").distinct()
    edges = compact(pairs.join(leads, "a", "left_semi"))
    if edges.isEmpty():
        return groups
    families = components(edges).withColumnRenamed("component", "family")
    families = families.unionByName(families.select(F.col("family").alias("id"), "family").distinct())
    info = reps.select(F.col("doc_id").alias("id"), "n", "sig", "halves")
    docs = (families.join(of, "id", "left").join(info, "id")
            .select("family", F.col("id").alias("doc_id"), "n", F.coalesce("component", "id").alias("component"), "sig", "halves"))
    docs = materialize(_dealt(docs))
    units = compact(_block_pairs(docs, threshold))

    def number(c):
        return F.unhex(F.lpad(F.hex(c), 16, "0"))

    sketch = F.concat(number(F.col("n")), number(F.col("component")),
                      F.unhex(F.array_join(F.transform("halves", lambda h: F.lpad(F.hex(h), 16, "0")), "")), F.col("sig"))
    light = docs.select("family", "block", "doc_id", sketch.alias("data"))
    sides = [light.join(units.withColumn("block", F.col(k)), ["family", "block"]).drop("block").withColumn("side", F.lit(at))
             for at, k in enumerate(("x", "y"))]
    hits = compact(_meet(sides[0].unionByName(sides[1]), _meet_sketches(threshold, sketcher_args[1]),
                         "family long, x long, y long, side long, doc_id long"))
    if hits.isEmpty():
        return groups
    sets = (_full_sets(src, hits.select("doc_id"), sketcher_args).join(docs.select("doc_id", "component"), "doc_id")
            .select("doc_id", F.concat(number(F.col("component")), "set").alias("data")))
    more = _meet(hits.join(sets, "doc_id"), _meet_sets(threshold), "a long, b long")
    return components(links.unionByName(more))


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                threshold: int = THRESHOLD, collections: int = COLLECTIONS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest id
    reachable by links, itself included), kept (doc_id = component_id). Ids are integers."""
    prepare(df.sparkSession)
    args = (size, collections, rows)
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marks = materialize(sketches(src, args))
    # classes of equal sets; empty sets and null ids are classes of their own
    linked = marks.where("doc_id IS NOT NULL AND n > 0")
    own = linked.groupBy("doc_id").agg(F.max(F.struct("n", "content", "sig", "halves")).alias("m")).select("doc_id", "m.*")
    first = own.groupBy("content").agg(F.min("doc_id").alias("rep"))
    belongs = own.select("doc_id", "content").join(first, "content").select("doc_id", "rep")
    reps = materialize(own.join(first, (own["content"] == first["content"]) & (own["doc_id"] == first["rep"]), "left_semi"))
    groups = near_links(src, reps, args, threshold)
    result = (belongs.join(groups, belongs["rep"] == groups["id"], "left")
              .select("doc_id", F.coalesce("component", "rep").alias("component_id")))
    return (marks.select("doc_id", F.col("n").alias("n_shingles")).join(result, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group (the smallest id), all columns unchanged."""
    gone = (near_groups(docs, id_col, text_col, **options).where(~F.col("kept"))
            .select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone, F.col(id_col).cast("long") == F.col("_gone"), "left_anti")


def op4_near_dedup(spark, sf_dir) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents", "doc_id", "text"), size=2)
