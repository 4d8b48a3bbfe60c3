"""Packing token sequences by cutting-stock column generation.

Every document (its ids and one closing id) is cut into full sequences and a
rest shorter than one. The rests' lengths, rounded up to classes, form a
histogram of fixed width, whatever the corpus' size. On it the linear program
of the cutting-stock problem is solved by column generation: a pattern says how
many rests of each class share a sequence; the simplex prices classes, an
unbounded knapsack over the sequence's capacity (dynamic programming) finds the
pattern that is worth most, and it enters the basis until none is worth more
than a sequence. Pattern counts are rounded down, what is left over (less than one
sequence per pattern) is packed first-fit by decreasing length.

The plan is a small table: per class, runs of ranks with the pattern's first
sequence. Documents are ranked within their class (hash-dealt pieces, an offset
per piece: no window holds a class), and a rank decides sequence and place.

Defined results: a null or empty text is the closing id alone; repeated rows and
null ids are documents of their own, told apart by nothing but their rank.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressmill.llm.common import bucket_of, materialize, prepare, read, shuffle_parts

TOKENIZER_FILE = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY = 2048
#: Lengths are rounded up to multiples of this in the linear program.
UNIT = 16
END_ID = 1
MEMORY = 500_000
MEMORY_CHARS = 64

_LOOSE_BLANK = re.compile(r" (?:\s|$)").search


class Tokens:
    """Ids as little-endian 32-bit bytes, by a tokenizers file whose
    pre-tokens begin at every blank before a visible character."""

    def __init__(self, path: str):
        import json

        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if (spec["model"]["type"], pre["type"], pre["add_prefix_space"], spec["normalizer"]) != ("BPE", "ByteLevel", False, None):
            raise ValueError("a byte-level BPE file without prefix blank or normaliser is needed")
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.mark = re.compile("|".join(map(re.escape, self.added))) if self.added else None
        byte_of = _byte_alphabet()
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        # merges are listed in the order of the ids they make, so ids are ranks
        self.lib = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.units: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return np.array(self.lib.encode_ordinary(text), "<u4").tobytes()

    def _part(self, text: str) -> bytes:
        if _LOOSE_BLANK(text):
            return self._plain(text)
        units = self.units
        if len(units) > MEMORY:
            units.clear()
        head, *rest = text.split(" ")
        fresh = set(rest).difference(units)
        encode, pack = self.lib.encode_ordinary, np.array
        for u in fresh:
            units[u] = pack(encode(" " + u), "<u4").tobytes()
        out = self._plain(head) + b"".join(map(units.__getitem__, rest))
        for u in fresh:
            if len(u) > MEMORY_CHARS:
                del units[u]
        return out

    def ids(self, text: str) -> bytes:
        """The text's ids and the closing id."""
        end = END_ID.to_bytes(4, "little")
        if self.mark is None or not self.mark.search(text):
            return self._part(text) + end
        out, at = [], 0
        for m in self.mark.finditer(text):
            out += [self._part(text[at:m.start()]), self.added[m.group()].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._part(text[at:]), end])


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def cut_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  path: str = TOKENIZER_FILE, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens. All but
    a document's last piece are full."""
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):
        tok = tokens(path)
        for b in batches:
            at, start, length, crc, total = [], [], [], [], []
            for row, t in enumerate(b.column(1).to_pylist()):
                ids = memoryview(tok.ids(t or ""))
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    part = ids[4 * s:4 * (s + capacity)]
                    at.append(row)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]],
                names=names)

    return src.mapInArrow(run, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long")


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: best value, count per item."""
    order = np.argsort(sizes, kind="stable")
    sizes, values = sizes[order], values[order]
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    best, item = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c], item[c] = best[c - 1], -1
        if k := fits[c]:
            worth = best[c - sizes[:k]] + values[:k]
            j = int(worth.argmax())
            if worth[j] > best[c] + 1e-12:
                best[c], item[c] = worth[j], j
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if item[c] < 0:
            c -= 1
        else:
            counts[order[item[c]]] += 1
            c -= int(sizes[item[c]])
    return float(best[capacity]), counts


def inverse_of(matrix: np.ndarray) -> np.ndarray:
    """The inverse by row operations. This runs on the driver, beside a live session, where a threaded
    linear algebra library may wait for itself; so neither this nor ``matvec`` calls one."""
    m = len(matrix)
    work = np.hstack([matrix.astype(float), np.eye(m)])
    for k in range(m):
        lead = k + int(np.abs(work[k:, k]).argmax())
        if abs(work[lead, k]) < 1e-12:
            raise ValueError("singular matrix")
        work[[k, lead]] = work[[lead, k]]
        work[k] /= work[k, k]
        others = work[:, k].copy()
        others[k] = 0.0
        work -= others[:, None] * work[k]
    return work[:, m:]


def matvec(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector).sum(axis=1)


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int,
                   gap: float = 5e-4, rounds: int = 3_000, patience: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Column generation for min sum(x), patterns @ x = demand: (patterns as
    columns, x). Stops when no pattern is worth more than a sequence, when the
    sequences are within ``gap`` of the least that the total length allows, or when
    ``patience`` rounds have saved less than a hundredth of that; any basis is a plan."""
    m = len(sizes)
    least = float((demand * sizes).sum()) / capacity
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    x = matvec(inverse, demand)
    before = np.inf
    for step in range(rounds):
        if step % patience == 0:
            if x.sum() > before - 0.01 * gap * least:
                break
            before = x.sum()
        prices = inverse.sum(axis=0)  # all costs are one sequence
        value, pattern = knapsack(prices, sizes, capacity)
        if value <= 1 + 1e-6 or x.sum() <= least * (1 + gap):
            break
        column = pattern.astype(float)
        way = matvec(inverse, column)
        ratio = np.full(m, np.inf)
        up = way > 1e-9
        ratio[up] = x[up] / way[up]
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = column
        row = inverse[leave] / way[leave]
        inverse -= np.outer(way, row)
        inverse[leave] = row
        if step % 100 == 99:  # rounding errors add up
            try:
                inverse = inverse_of(basis)
            except ValueError:
                break
        x = np.maximum(matvec(inverse, demand), 0.0)
    return np.rint(basis).astype(np.int64), x


def first_fit_decreasing(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[np.ndarray]:
    """One pattern per sequence for what rounding has left over."""
    left, out = demand.astype(np.int64).copy(), []
    order = np.argsort(-sizes, kind="stable")
    while left.any():
        room, pattern = capacity, np.zeros(len(sizes), np.int64)
        for k in order:
            n = min(int(left[k]), room // int(sizes[k]))
            pattern[k] += n
            room -= n * int(sizes[k])
        # the same pattern serves as long as its pieces last
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        left -= pattern * times
        out += [pattern] * times
    return out


def plan_sequences(histogram: dict[int, int], capacity: int, unit: int = UNIT) -> list[tuple]:
    """Rows (class, first_rank, last_rank, per_sequence, first_sequence, place): the ranks first..last
    of a class go, ``per_sequence`` to each, to the sequences from ``first_sequence`` on, and stand
    there from ``place`` on among the sequence's pieces."""
    if not histogram:
        return []
    classes = np.array(sorted(histogram))
    demand = np.array([histogram[int(c)] for c in classes], dtype=np.int64)
    room = capacity // unit
    patterns, x = solve_patterns(classes, demand.astype(float), room)
    plan, sequence, done = [], 0, np.zeros(len(classes), np.int64)

    def use(pattern, times):
        nonlocal sequence
        place = 0
        for k in np.flatnonzero(pattern):
            n = int(pattern[k])
            first = int(done[k])
            done[k] += n * times
            plan.append((int(classes[k]), first, int(done[k]) - 1, n, sequence, place))
            place += n
        sequence += times

    for j in np.argsort(-x, kind="stable"):
        pattern = patterns[:, j]
        have = pattern > 0
        times = min(int(x[j] + 1e-6), int(((demand - done)[have] // pattern[have]).min()) if have.any() else 0)
        if times > 0:
            use(pattern, times)
    for pattern in first_fit_decreasing(classes, demand - done, room):
        use(pattern, 1)
    return plan


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER_FILE,
         capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id (gapless from 0), offset (gapless from 0 within the sequence)."""
    if capacity % unit:
        raise ValueError("unit must divide capacity")
    spark = prepare(df.sparkSession)
    pieces = materialize(cut_documents(df, id_col, text_col, path, capacity)
                         .withColumn("_class", F.ceil(F.col("length") / F.lit(unit)).cast("int"))
                         .withColumn("_row", F.monotonically_increasing_id()))
    histogram = {r[0]: r[1] for r in pieces.groupBy("_class").count().collect()}  # capacity / unit rows at most
    plan = plan_sequences(histogram, capacity, unit)
    runs = spark.createDataFrame(plan, "_class int, _first long, _last long, _per long, _seq long, _place long")

    # rank within the class without a window over the class
    parts = max(8, shuffle_parts(df))
    dealt = pieces.withColumn("_part", bucket_of(parts, "_row"))
    sizes = dealt.groupBy("_class", "_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_class", "_part", (F.sum("_n").over(
        Window.partitionBy("_class").orderBy("_part")) - F.col("_n")).alias("_off"))
    place = F.row_number().over(Window.partitionBy("_class", "_part").orderBy("doc_id", "start", "_row")) - 1
    ranked = (dealt.withColumn("_at", place).join(offsets, ["_class", "_part"])
              .withColumn("_rank", F.col("_off") + F.col("_at")))
    # the plan has at most one row per class and pattern
    hit = ranked.join(F.broadcast(runs), (ranked["_class"] == runs["_class"])
                      & (ranked["_rank"] >= runs["_first"]) & (ranked["_rank"] <= runs["_last"]))
    since = F.col("_rank") - F.col("_first")
    placed = hit.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_row",
                        (F.col("_seq") + F.floor(since / F.col("_per"))).cast("long").alias("sequence_id"),
                        (F.col("_place") + since % F.col("_per")).alias("_at"))
    before = Window.partitionBy("sequence_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))


def op10_packing(spark, sf_dir) -> DataFrame:
    return pack(read(spark, sf_dir, "documents", "doc_id", "text"))
