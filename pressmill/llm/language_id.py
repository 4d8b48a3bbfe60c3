"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, every run of other than letters becomes one blank, and
its character n-grams are hashed into a fixed number of buckets. Counts per
language and bucket come from all learning rows, summed in each task and
then across tasks; their log probabilities form one matrix (languages x buckets),
whose size does not depend on the corpus and which goes to every worker. Scoring
gathers the matrix' columns of a batch's n-grams and adds them up per text.

``score`` is the posterior probability of the language chosen, after dividing the
log likelihoods by the square root of the n-grams' number, so that long texts
do not all come out as 1.

The posterior only compares the learned languages, so text of another language, another script or
noise can score 1. Its fit tells: the chosen language's mean log likelihood of an n-gram, with
an allowance for short texts, against the ``FIT_QUANTILE`` of that language's learning rows, less a margin. Those are
weighed by the counts of the half of the rows that they are not in, as unseen texts are.

Defined results: null texts and texts without a letter are ``und`` with
score 0; so is every text if there is nothing to learn from. Of equally likely
languages the first by name is chosen.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import prepare, read

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
SMOOTHING = 0.5
UNKNOWN = "und"
#: The pipeline keeps documents of a known language at this score or above.
LEAST_SCORE = 0.35
#: Share of a language's learning rows that may fit worse than its least fit.
FIT_QUANTILE = 0.001
#: How far a text may fall below that quantile, which few learning rows give only roughly.
FIT_MARGIN = 0.75
#: Standard deviations of the mean that are allowed to a text for its length.
FIT_SLACK = 3.0
#: Width of a bin of the histogram of fits.
FIT_STEP = 0.01
#: Code points that one scoring step handles: bounds a worker's memory.
STEP_POINTS = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _clean(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in a row, each text in blanks; the text of
    each; whether a text has a letter."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t) for t in lowered], np.int64) + 1
    owner = np.repeat(np.arange(len(texts)), sizes)[:len(points)]
    letter = _letters()[points]
    has = np.zeros(len(texts), bool)
    has[owner[letter]] = True
    before = np.concatenate([[False], letter[:-1]])
    keep = letter | before  # the first blank after a letter stays
    keep[:1] = True
    first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    keep |= first
    points = np.where(letter, points, np.uint32(32))
    return points[keep], owner[keep], has


def grams(texts: list[str], orders=ORDERS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text number) of every n-gram, and which texts have letters."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    points, owner, has = _clean(texts)
    points = points.astype(np.uint64)
    shift = np.uint64(64 - (buckets - 1).bit_length())
    out, who = [], []
    code = np.zeros(len(points), np.uint64)
    for n in range(1, max(orders) + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        code = code[:m] * _STEP + points[n - 1:] + np.uint64(1)
        if n in orders:
            fine = owner[:m] == owner[n - 1:]
            if n == 1:
                fine = fine & (points != 32)
            mixed = (code + np.uint64(n)) * _MIX
            out.append(((mixed ^ (mixed >> np.uint64(29))) * _STEP >> shift)[fine])
            who.append(owner[:m][fine])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    return np.concatenate(out).astype(np.int64), np.concatenate(who), has


def _steps(texts: list[str]):
    """Runs of texts of bounded total length (one text at least)."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > STEP_POINTS:
            yield at, k
            at, size = k, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


class Model:
    """Log probabilities: rows are buckets, columns languages by name."""

    def __init__(self, languages: list[str], logs: np.ndarray, prior: np.ndarray, orders=ORDERS):
        self.languages, self.logs, self.prior, self.orders = languages, logs, prior, tuple(orders)
        #: least fit that a text of each language needs: any, until it has been learned
        self.least_fit = np.full(len(languages), -np.inf)
        p = np.exp(np.asarray(logs, np.float64))
        mean = (p * logs).sum(axis=0)
        self.spread = np.sqrt(np.maximum((p * np.square(logs)).sum(axis=0) - mean ** 2, 0))

    def fit(self, total: np.ndarray, count: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Mean log likelihood of the texts' n-grams, with the allowance for few of them."""
        count = np.maximum(count, 1)
        return total / count + FIT_SLACK * self.spread[language] / np.sqrt(count)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and whether the text fits that language."""
        labels, scores, fits = [], np.zeros(len(texts)), np.zeros(len(texts), bool)
        filled = [t or "" for t in texts]
        for lo, hi in _steps(filled):
            part = filled[lo:hi]
            if not self.languages:
                labels += [UNKNOWN] * len(part)
                continue
            bucket, owner, has = grams(part, self.orders, len(self.logs))
            count = np.bincount(owner, minlength=len(part))
            total = np.stack([np.bincount(owner, self.logs[bucket, k], len(part)) for k in range(len(self.languages))], 1)
            raw = total
            total = (total + self.prior) / np.sqrt(np.maximum(count, 1))[:, None]
            total -= total.max(axis=1, keepdims=True)
            best = total.argmax(axis=1)
            fits[lo:hi] = has & (self.fit(raw[np.arange(len(part)), best], count, best) >= self.least_fit[best])
            scores[lo:hi] = np.where(has, 1.0 / np.exp(total).sum(axis=1), 0.0)
            labels += [self.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())]
        return labels, scores, fits


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", orders=ORDERS, buckets: int = BUCKETS,
          smoothing: float = SMOOTHING, fit: bool = True) -> Model:
    """Model learned from all rows of non-null text and language; with ``fit`` also the least fit of each
    language, in a second pass. The driver gets at most 2 x languages x buckets counts."""
    prepare(rows.sparkSession)
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    src = (rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
           .where("text IS NOT NULL AND lang IS NOT NULL").withColumn("half", (F.crc32(F.encode("text", "utf-8")) % 2).cast("int")))

    def count(batches):
        sums: dict[tuple[str, int], np.ndarray] = {}
        texts_of: dict[tuple[str, int], int] = {}
        for b in batches:
            texts, kinds = b.column(0).to_pylist(), list(zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
            names = sorted(set(kinds))
            for n in names:
                sums.setdefault(n, np.zeros(buckets, np.int64))
            code = np.array([names.index(x) for x in kinds], np.int64)
            for lo, hi in _steps(texts):
                bucket, owner, has = grams(texts[lo:hi], orders, buckets)
                got = np.bincount(code[lo:hi][owner] * buckets + bucket, minlength=len(names) * buckets)
                for k, n in enumerate(names):
                    sums[n] += got[k * buckets:(k + 1) * buckets]
                    texts_of[n] = texts_of.get(n, 0) + int((code[lo:hi] == k).sum())
        for (n, half), v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array([n] * (len(at) + 1), pa.string()), pa.array(np.full(len(at) + 1, half, np.int32)),
                 pa.array(np.append(at, -1)), pa.array(np.append(v[at], texts_of.get((n, half), 0)))],
                names=["lang", "half", "bucket", "n"])

    table = (src.mapInArrow(count, "lang string, half int, bucket long, n long").groupBy("lang", "half", "bucket")
             .agg(F.sum("n").alias("n")).toArrow())
    names = sorted(set(table.column("lang").to_pylist()))
    halves, texts = np.zeros((2, buckets, len(names))), np.zeros(len(names))
    place = {n: k for k, n in enumerate(names)}
    column = np.array([place[x] for x in table.column("lang").to_pylist()], np.int64)
    half, bucket, n = (table.column(c).to_numpy() for c in ("half", "bucket", "n"))
    real = bucket >= 0
    halves[half[real], bucket[real], column[real]] = n[real]
    np.add.at(texts, column[~real], n[~real])
    if not names:
        return Model([], halves[0], texts, orders)

    def logs_of(counts):
        return (np.log(counts + smoothing) - np.log(counts.sum(axis=0) + smoothing * buckets)).astype(np.float32)

    model = Model(names, logs_of(halves.sum(axis=0)), np.log(texts / texts.sum()), orders)
    if fit:
        model.least_fit = _least_fits(src, model, [logs_of(h) for h in halves], place)
    return model


def _least_fits(src: DataFrame, model: Model, halves: list[np.ndarray], place: dict[str, int]) -> np.ndarray:
    """Per language the low quantile of its rows' fits, each by the half that it is not in. The driver gets
    a histogram per language."""
    shared = src.sparkSession.sparkContext.broadcast((model, halves))

    def bins(batches):
        model, halves = shared.value
        for b in batches:
            texts = b.column(0).to_pylist()
            lang = np.array([place[x] for x in b.column(1).to_pylist()], np.int64)
            half = b.column(2).to_numpy()
            for lo, hi in _steps(texts):
                bucket, owner, has = grams(texts[lo:hi], model.orders, len(model.logs))
                own, other = lang[lo:hi], 1 - half[lo:hi]
                total = np.zeros(hi - lo)
                for h in (0, 1):
                    at = other[owner] == h
                    total += np.bincount(owner[at], halves[h][bucket[at], own[owner[at]]], hi - lo)
                fit = model.fit(total, np.bincount(owner, minlength=hi - lo), own)
                at, n = np.unique(np.stack([own, np.floor(fit / FIT_STEP).astype(np.int64)], 1)[has], axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(n)], names=["lang", "bin", "n"])

    found = src.mapInArrow(bins, "lang long, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow().sort_by("bin")
    lang, at, n = (found.column(c).to_numpy() for c in ("lang", "bin", "n"))
    least = np.full(len(model.languages), -np.inf)
    for k in range(len(least)):
        mine = lang == k
        if mine.any():
            below = n[mine].cumsum()
            least[k] = at[mine][np.searchsorted(below, FIT_QUANTILE * below[-1], side="right")] * FIT_STEP - FIT_MARGIN
    return least


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score per row."""
    prepare(df.sparkSession)
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            labels, scores = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(labels, pa.string()), pa.array(scores)],
                                             names=["doc_id", "lang_pred", "score"])

    return src.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` that fit a learned language, at a score of ``least`` or more, all columns unchanged."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            labels, scores, fits = shared.value.judge(b.column(place).to_pylist())
            yield b.filter(pa.array([x != UNKNOWN and s >= least and f for x, s, f in zip(labels, scores.tolist(), fits.tolist())],
                                    pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learning_rows(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose crc32 of the id as text leaves other than 2 modulo 4 (a null id: empty text)."""
    return df.where(_fold(id_col) != 2)


def _fold(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def op8_language_id(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train(learning_rows(docs), fit=False)
    return identify(docs, model).select("doc_id", (_fold("doc_id") == 2).alias("held_out"), "lang_pred", "score")
