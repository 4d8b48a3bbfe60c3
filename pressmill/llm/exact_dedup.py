"""Exact de-duplication by composable polynomial fingerprints.

A text is normalised (ASCII white space deleted), encoded to UTF-8 and cut into
chunks. Every chunk gets a polynomial hash under several moduli, independent
of the other chunks; a document's fingerprint is composed from them by
length-shifted arithmetic, ``h(a + b) = h(a) * B**len(b) + h(b)``. A
fingerprint is a candidate key only: rows that share one are compared chunk by
chunk (the smallest and largest chunk at each place must be the same bytes), and
where they are not, the group is split by the texts themselves.

Defined results: a null text counts as empty; all empty (or all-white) texts
are equal to each other; rows repeated with the same id are the same document
and share one decision; a null id sorts after all others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import materialize, prepare, read

#: Primes below 2**31: a chunk's products (8 + 31 bits) can be summed over
#: 2**20 terms in 64 bits without a reduction in between.
MODULI = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1000003, 998244353, 1610612741, 805306457)
CHUNK_BYTES = 1 << 16

_BLANKS = b" \t\n\x0b\x0c\r"


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8").translate(None, _BLANKS)


class Fingerprint:
    """Chunk hashes and their composition for one set of moduli."""

    def __init__(self, moduli=MODULI, bases=BASES, chunk_bytes: int = CHUNK_BYTES):
        if not 0 < chunk_bytes <= 1 << 20:
            raise ValueError("chunk_bytes must be in 1..2**20")
        self.moduli, self.chunk_bytes = moduli, chunk_bytes
        self.bases = [b % m for b, m in zip(bases, moduli)]
        self.powers = []  # per modulus: B**(chunk-1) ... B**0
        for m, b in zip(moduli, self.bases):
            p = np.ones(1, np.int64)
            while len(p) < chunk_bytes:
                p = np.concatenate([p, p * pow(b, len(p), m) % m])[:chunk_bytes]
            self.powers.append(np.ascontiguousarray(p[::-1]))

    def chunk(self, data: bytes) -> tuple[int, ...]:
        symbols = np.frombuffer(data, np.uint8).astype(np.int64) + 1
        n = len(symbols)
        return tuple(int(np.dot(symbols, p[len(p) - n:]) % m) for m, p in zip(self.moduli, self.powers))

    def compose(self, left: tuple[int, ...], right: tuple[int, ...], right_len: int) -> tuple[int, ...]:
        return tuple((a * pow(b, right_len, m) + c) % m
                     for a, c, b, m in zip(left, right, self.bases, self.moduli))

    def of(self, data: bytes) -> tuple[int, ...]:
        size = self.chunk_bytes
        if len(data) <= size:
            return self.chunk(data)
        total = (0,) * len(self.moduli)
        for i in range(0, len(data), size):
            part = data[i:i + size]
            total = self.compose(total, self.chunk(part), len(part))
        return total

    def text_key(self, data: bytes) -> str:
        return f"{len(data):x}-" + "".join(f"{h:08x}" for h in self.of(data))


def _columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 moduli=MODULI, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_points (code points of the original
    text), fingerprint, text_sha256 (of the normalised text)."""
    src = _columns(df, id_col, text_col)
    id_type = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        fp = Fingerprint(moduli, chunk_bytes=chunk_bytes)
        for b in batches:
            texts = b.column(1).to_pylist()
            data = [normalised(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t or "") for t in texts], pa.int64()),
                 pa.array([fp.text_key(d) for d in data], pa.string()),
                 pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string())],
                names=["doc_id", "n_points", "fingerprint", "text_sha256"])

    return src.mapInArrow(run, f"doc_id {id_type}, n_points long, fingerprint string, text_sha256 string")


def _chunks(src: DataFrame, moduli, chunk_bytes: int) -> DataFrame:
    """(fingerprint, place, chunk) of every text; an empty text has one empty chunk."""

    def run(batches):
        fp = Fingerprint(moduli, chunk_bytes=chunk_bytes)
        for b in batches:
            for t in b.column("text").to_pylist():
                data = normalised(t)
                places = range(0, max(1, len(data)), chunk_bytes)
                key = fp.text_key(data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(places), pa.string()), pa.array(places, pa.int64()),
                     pa.array([data[i:i + chunk_bytes] for i in places], pa.binary())],
                    names=["fingerprint", "place", "chunk"])

    def packed(batches):
        held, size = [], 0
        for b in run(batches):
            held.append(b)
            size += b.nbytes
            if size > 1 << 22 or len(held) >= 512:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return src.select("text").mapInArrow(packed, "fingerprint string, place long, chunk binary")


def _choose(df: DataFrame, key: str) -> DataFrame:
    """Per key: the group's size and the id that stays (most code points, then
    the smallest id); a map-side combined aggregate, so a hot group is no task's burden."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("z"),
                       F.col("doc_id").alias("id"))).alias("best")
    ).select(key, "group_size", F.col("best.id").alias("keep_id"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 moduli=MODULI, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    prepare(df.sparkSession)
    src = _columns(df, id_col, text_col)
    marks = materialize(fingerprints(df, id_col, text_col, moduli, chunk_bytes))
    groups = _choose(marks, "fingerprint")

    # compare the texts of every fingerprint that several rows share
    shared = groups.where("group_size > 1").select("fingerprint")
    ids = marks.join(shared, "fingerprint", "left_semi").select(F.col("doc_id").alias("_id")).distinct()
    members = src.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    unequal = (_chunks(members, moduli, chunk_bytes).groupBy("fingerprint", "place")
               .agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
               .where(F.col("lo") != F.col("hi")).select("fingerprint").distinct())
    unequal = materialize(unequal)

    out = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    if unequal.isEmpty():
        return marks.join(groups, "fingerprint").select(*out)
    # texts that only look alike: the text itself is the key
    alike = marks.join(unequal, "fingerprint", "left_semi")
    fine = marks.join(unequal, "fingerprint", "left_anti").join(groups, "fingerprint").select(*out)
    bodies = src.join(alike.select(F.col("doc_id").alias("_id")).distinct(),
                      F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    bodies = (bodies.withColumn("body", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]", ""))
              .withColumn("text_sha256", F.sha2(F.col("body").cast("binary"), 256))
              .withColumn("n_points", F.length(F.coalesce("text", F.lit(""))).cast("long"))
              .join(alike.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct(),
                    F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha")), "left_semi"))
    return fine.unionByName(bodies.join(_choose(bodies, "body"), "body").select(*out))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` does not keep, all columns
    unchanged. Of rows repeated with the same id and equal text one stays."""
    groups = materialize(exact_groups(docs, id_col, text_col))
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_sha"))
    digest = F.sha2(F.regexp_replace(F.coalesce(text_col, F.lit("")), r"[\x20\x09-\x0D]", "").cast("binary"), 256)
    left = docs.join(gone, F.col(id_col).eqNullSafe(F.col("_gone")) & (digest == F.col("_sha")), "left_anti")
    again = materialize(groups.where("kept").groupBy(F.col("doc_id").alias("_again"), F.col("text_sha256").alias("_sha"))
                        .count().where("count > 1").drop("count"))
    if again.isEmpty():
        return left
    same = F.col(id_col).eqNullSafe(F.col("_again")) & (digest == F.col("_sha"))
    repeated = left.join(again, same, "left_semi").withColumn("_digest", digest)
    return left.join(again, same, "left_anti").unionByName(
        repeated.dropDuplicates([id_col, "_digest"]).drop("_digest"))


def op3_exact_dedup(spark, sf_dir) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents", "doc_id", "text"))


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents),
g AS (
  SELECT doc_id, body,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY n_points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM g
"""
