"""Document fingerprints from modular prefix arrays of polynomial hashes.

For a text s and a modulus p the prefix array holds ``P[i] = sum(s[j] * B**j, j < i)``.
Any two spans are then equal exactly if their differences of prefixes,
shifted to a common power, agree under every modulus, and the longest common
extension of two places is found by binary search over the span's length.

The likeness of two texts goes on past every edit: characters count that stand in a span of ``SPAN``
characters that the other text has at any place (or all of the shorter text, if it is shorter), or in the
longest common extensions from the front and the back. The text with fewer of them is set against
the longer one's length: 1 for equal texts.

A fingerprint in writing is the text's length, whole-text hashes and the ``MINIMA`` smallest span hashes, so fingerprints
that are stored apart from their texts can be compared too: ``written_likeness`` is the share of
the smallest span hashes of both that both have, an estimate of the spans in common of all spans.

The query sets each text against an edited copy, whose tail comes from the next
document in descending id order. Only neighbours meet: ids are cut into ranges
by quantiles, each range is sorted and streamed once with the row before in
hand, and a range's first document is also sent, as a guest, to the range before it.

Defined results: a null text counts as empty; two empty texts have likeness 1; a
single document's next is itself; null ids come last; rows with one id are
ordered by a hash of their text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import prepare, read, shuffle_parts

#: Primes below 2**31: products stay in 62 bits, sums of 2**32 residues in 63.
MODULI = (2147483647, 2147483629, 2147483587)
BASES = (911382323, 972663749, 1000000007)
#: Characters of the spans that coverage looks for.
SPAN = 16
#: Span hashes that a written fingerprint carries.
MINIMA = 48
_LAST = -(1 << 63)


class Powers:
    """B**0, B**1, ... per modulus, grown as longer texts come."""

    def __init__(self, moduli=MODULI, bases=BASES):
        self.moduli = moduli
        self.bases = [b % m for b, m in zip(bases, moduli)]
        self.tables = [np.ones(1, np.int64) for _ in moduli]
        self.back: Powers | None = None

    def inverse(self) -> Powers:
        """Powers of the bases' inverses, which shift a span to the front."""
        if self.back is None:
            self.back = Powers(self.moduli, [pow(b, -1, m) for m, b in zip(self.moduli, self.bases)])
        return self.back

    def upto(self, n: int) -> list[np.ndarray]:
        for k, (m, b) in enumerate(zip(self.moduli, self.bases)):
            t = self.tables[k]
            while len(t) <= n:
                t = np.concatenate([t, t * pow(b, len(t), m) % m])
            self.tables[k] = t
        return self.tables


class PrefixHashes:
    """Prefix arrays of one text."""

    def __init__(self, text: str, powers: Powers):
        symbols = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) + 1
        self.n = n = len(symbols)
        self.powers = powers
        self.sums = []  # not reduced: a prefix is taken modulo p when it is read
        for m, t in zip(powers.moduli, powers.upto(n)):
            s = np.zeros(n + 1, np.int64)
            np.cumsum(symbols * t[:n] % m, out=s[1:])
            self.sums.append(s)
        self.spans: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.written: str | None = None

    def key(self) -> str:
        """The fingerprint in writing: length, whole-text hashes, smallest span hashes."""
        if self.written is None:
            whole = "".join(f"{int(s[-1]) % m:08x}" for s, m in zip(self.sums, self.powers.moduli))
            self.written = f"{self.n:x}-{whole}-" + ".".join(f"{v:08x}" for v in self.minima())
        return self.written

    def same_span(self, i: int, other: PrefixHashes, j: int, length: int) -> bool:
        """Whether [i, i + length) here equals [j, j + length) there."""
        shift = j - i
        for s, o, m, t in zip(self.sums, other.sums, self.powers.moduli, self.powers.tables):
            a, b = int(s[i + length] - s[i]) % m, int(o[j + length] - o[j]) % m
            if shift > 0:
                a = a * int(t[shift]) % m
            elif shift < 0:
                b = b * int(t[-shift]) % m
            if a != b:
                return False
        return True

    def common_prefix(self, other: PrefixHashes, i: int = 0, j: int = 0) -> int:
        """Longest common extension to the right of place i here and j there."""
        lo, hi = 0, min(self.n - i, other.n - j)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.same_span(i, other, j, mid):
                lo = mid
            else:
                hi = mid - 1
        return lo

    def common_suffix(self, other: PrefixHashes) -> int:
        """Longest common extension to the left of both ends."""
        lo, hi = 0, min(self.n, other.n)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.same_span(self.n - mid, other, other.n - mid, mid):
                lo = mid
            else:
                hi = mid - 1
        return lo

    def span_keys(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all spans of a length by place (two moduli in one number), and sorted."""
        if length not in self.spans:
            n = self.n - length + 1
            keys = np.zeros(n, np.int64)
            for s, m, t in zip(self.sums[:2], self.powers.moduli, self.powers.inverse().upto(n)):
                keys = (keys << 31) | ((s[length:] - s[:n]) % m * t[:n] % m)
            self.spans[length] = keys, np.sort(keys)
        return self.spans[length]

    def minima(self) -> list[int]:
        """The smallest distinct span hashes, to 32 bits."""
        if not self.n:
            return []
        ordered, take = self.span_keys(min(SPAN, self.n))[1], MINIMA
        while len(found := np.unique(ordered[:take] >> 30)) < MINIMA and take < len(ordered):
            take *= 4
        return found[:MINIMA].tolist()

    def likeness(self, other: PrefixHashes) -> float:
        longer, shorter = max(self.n, other.n), min(self.n, other.n)
        if not shorter:
            return float(not longer)
        front = self.common_prefix(other)
        if front == longer:
            return 1.0
        back, length = self.common_suffix(other), min(SPAN, shorter)
        covered = []
        for a, b in ((self, other), (other, self)):
            keys, there = a.span_keys(length)[0], b.span_keys(length)[1]
            # spans within the extensions are known to be there
            lo = max(0, front - length + 1)
            hi = max(lo, min(len(keys), a.n - back))
            found = np.zeros(len(keys), np.int64)
            found[lo:hi] = there[np.minimum(np.searchsorted(there, keys[lo:hi]), len(there) - 1)] == keys[lo:hi]
            ends = np.zeros(a.n + 1, np.int64)
            ends[:len(keys)] += found
            ends[length:] -= found
            inside = ends[:-1].cumsum() > 0
            inside[:front] = True
            inside[a.n - back:] = True
            covered.append(int(inside.sum()))
        return min(covered) / longer


def written_likeness(one: str, two: str) -> float:
    """Likeness of two fingerprints in writing."""
    if one == two:
        return 1.0
    a, b = (set(f.rsplit("-", 1)[1].split(".")) - {""} for f in (one, two))
    if not a or not b:
        return 0.0
    # what is smaller than all that both sides list is known of both
    whole = [len(x) < MINIMA for x in (a, b)]
    bound = min((max(x) for x, w in zip((a, b), whole) if not w), default=max(a | b))
    seen = {x for x in a | b if x <= bound}
    return len(a & b & seen) / len(seen) if seen else 0.0


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint per row."""
    prepare(df.sparkSession)
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        powers = Powers()
        for b in batches:
            hashes = [PrefixHashes(t or "", powers) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([h.n for h in hashes], pa.int64()), pa.array([h.key() for h in hashes], pa.string())],
                names=["doc_id", "n_chars", "fingerprint"])

    return src.mapInArrow(run, f"doc_id {id_type}, n_chars long, fingerprint string")


def _ranges(src: DataFrame, parts: int) -> tuple[list[int], dict[int, list[int]]]:
    """Descending cuts between ranges of ids, and for the first id of each
    range the ranges that it visits as a guest. Both are as many as ``parts`` at most."""
    shares = [k / parts for k in range(1, parts)]
    cuts = src.where(F.col("key") > F.lit(_LAST)).approxQuantile("key", shares, 0.2 / parts) if shares else []
    cuts = sorted({int(c) for c in cuts})

    def firsts(batches):
        edges = np.array(cuts, np.int64)
        for b in batches:
            keys = b.column(0).to_numpy()
            if len(keys):
                place = np.searchsorted(edges, keys, side="left")
                best = np.full(len(edges) + 1, _LAST, np.int64)
                np.maximum.at(best, place, keys)
                there = np.unique(place)
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(best[there], pa.int64())],
                                                 names=["place", "first"])

    found = (src.select("key").mapInArrow(firsts, "place int, first long").groupBy("place").agg(F.max("first").alias("first"))
             .orderBy(F.desc("place")).collect())
    guests: dict[int, list[int]] = {}
    for k, r in enumerate(found):
        before = found[k - 1] if k else found[-1]
        guests.setdefault(r["first"], []).append(before["place"])
    return cuts, guests


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next (likeness), cover_edited, cover_next (coverage). Ids are integers."""
    prepare(df.sparkSession)
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = src.withColumn("key", F.coalesce("doc_id", F.lit(_LAST)))
    parts = parts or 2 * shuffle_parts(df)
    cuts, guests = _ranges(keyed.select("key"), parts)

    def deal(batches):
        edges, pack = np.array(cuts, np.int64), zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            keys = b.column(0).to_numpy()
            place = np.searchsorted(edges, keys, side="left")
            bodies = [pack((t or "").encode("utf-8")) for t in b.column(3).to_pylist()]
            extra = [(i, p) for i, k in enumerate(keys.tolist()) if k in guests for p in guests[k]]
            rows = np.array([*range(len(keys)), *(i for i, _ in extra)], np.int64)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array([*place.tolist(), *(p for _, p in extra)], np.int32)),
                 pa.array([False] * len(keys) + [True] * len(extra), pa.bool_()),
                 b.column(0).take(at), b.column(1).take(at), b.column(2).take(at),
                 pa.array([bodies[i] for i in rows], pa.binary())],
                names=["place", "guest", "key", "tie", "doc_id", "body"])

    dealt = (keyed.select("key", F.xxhash64("text").alias("tie"), "doc_id", "text")
             .mapInArrow(deal, "place int, guest boolean, key long, tie long, doc_id long, body binary")
             .repartition(parts, "place").sortWithinPartitions("place", "guest", F.desc("key"), "tie"))
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, written_edited double, written_next double")
    names = [c.split()[0] for c in schema.split(", ")]

    def stream(batches):
        powers, unpack = Powers(), zstandard.ZstdDecompressor().decompress
        held = None  # place, doc_id, text, hashes of the row before
        for b in batches:
            out = [[] for _ in names]
            for place, guest, doc_id, body in zip(*(b.column(c).to_pylist() for c in (0, 1, 4, 5))):
                if guest and held is None:
                    continue  # other rows of a guest's id
                text = unpack(body).decode("utf-8")
                own = PrefixHashes(text, powers)
                if held is not None:
                    _, before_id, before, hashes = held
                    n = hashes.n
                    edited = before[:n - n // 3] + text[:n // 3]
                    changed = PrefixHashes(edited, powers)
                    keys = hashes.key(), changed.key(), own.key()
                    row = (before_id, n, hashlib.sha256(edited.encode("utf-8")).hexdigest(), *keys[:2], hashes.likeness(changed),
                           hashes.likeness(own), written_likeness(keys[0], keys[1]), written_likeness(keys[0], keys[2]))
                    for column, v in zip(out, row):
                        column.append(v)
                held = None if guest else (place, doc_id, text, own)
            if out[0]:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return dealt.mapInArrow(stream, schema)


def op2_prefix_fingerprints(spark, sf_dir) -> DataFrame:
    return edited_pairs(read(spark, sf_dir, "documents", "doc_id", "text"))


