"""Quality classifier: ordinal cumulative-link regression on graded ratings.

The model is ``P(grade <= k | x) = 1 / (1 + exp(w.x - t_k))`` with one weight
vector w for all grades and ordered thresholds t_0 < t_1 < ..., so a text has
one quality scale and every grade a band on it. Features are hashed: the words that
a text has (lower-cased letters), the share of each word shape (letters, digits and marks in
runs), and the share of repeated lines and of repeated words.

It is fitted in numpy on a sample of the rated rows: the ``MAX_RATED`` of smallest
hash of their id, or all if there are fewer. The rest covers all rows and whole texts.

Grades of the label table: 0 if quality is 0, 1 if it is 1 but the text is toxic, else 2.
Rows with a null label are not rated (a null toxic counts as 0).

Results per text: the expected grade and the tail probabilities P(grade >= k).
``keep`` holds where the probability of a grade of ``LEAST_GRADE`` or more is
``LEAST_TAIL`` at least. Defined results: null and empty texts have no features, so the
thresholds alone decide; without rated rows every grade is equally likely and all are kept.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import prepare, read

#: Upper bound of the rated rows that the model is fitted on.
MAX_RATED = 16_000
BUCKETS = 1 << 19
GRADES = 3
LEAST_GRADE = 2
LEAST_TAIL = 0.4
#: Weight of a shape's share, and of the repetition shares, beside a word's 1.
SHARE_SCALE = 8.0

_BLOCKS = 1 << 18  # words below, shares above
_SALT = 0x9E3779B1


def _code(s: str) -> int:
    import zlib
    return zlib.crc32(s.encode("utf-8"), _SALT)


@lru_cache(maxsize=400_000)
def _word(w: str) -> tuple[int, int]:
    """Buckets of a word's lower-cased letters (-1 if it has none) and of its shape."""
    letters = _NOT_LETTERS("", w).lower()
    runs, last = [], ""
    for c in w:
        kind = "a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else "l" if c.isalpha() else c
        if kind != last:
            runs.append(kind)
            last = kind
    return (_code(letters) % _BLOCKS if letters else -1), _BLOCKS + _code("shape " + "".join(runs)) % (BUCKETS - _BLOCKS)


_NOT_LETTERS = regex.compile(r"\P{L}+").sub
_REPEATED_LINES = _BLOCKS + _code("repeated lines") % (BUCKETS - _BLOCKS)
_REPEATED_WORDS = _BLOCKS + _code("repeated words") % (BUCKETS - _BLOCKS)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted buckets and their values."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    count: dict[str, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    present, share, n = set(), {}, len(words)
    for w, c in count.items():
        letters, shape = _word(w) if len(w) <= 64 else _word.__wrapped__(w)
        if letters >= 0:
            present.add(letters)
        share[shape] = share.get(shape, 0.0) + c / n
    lines = [x for x in text.split("\n") if x.strip()]
    share[_REPEATED_LINES] = share.get(_REPEATED_LINES, 0.0) + 1 - len(set(lines)) / len(lines)
    share[_REPEATED_WORDS] = share.get(_REPEATED_WORDS, 0.0) + 1 - len(count) / n
    at = np.fromiter(present, np.int32, len(present))
    at.sort()
    shares = sorted(share)
    return (np.concatenate([at, np.array(shares, np.int32)]),
            np.concatenate([np.ones(len(at), np.float32),
                            np.array([share[s] * SHARE_SCALE for s in shares], np.float32)]))


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, values: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of texts with these w.x."""
        return _sigmoid(values[:, None] - self.thresholds[None, :])

    def values(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for k, t in enumerate(texts):
            at, x = features(t)
            out[k] = self.weights[at] @ x
        return out

    def judge(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        tails = self.tails(self.values(texts))
        return tails.sum(axis=1), tails


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], grades: int = GRADES, epochs: int = 15, rate: float = 0.3,
        decay: float = 1e-3, batch: int = 64, least_rows: int = 5, seed: int = 11) -> Model:
    """Maximum penalised likelihood by Adagrad over shuffled batches. Thresholds are kept in order
    by fitting the first and the logarithms of the steps. ``rows``: buckets, values, grade.
    Buckets of fewer than ``least_rows`` rows keep weight 0: they would only single out their rows."""
    if not rows:
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(grades - 1))
    y = np.array([g for *_, g in rows])
    share = np.clip(np.array([(y < k).mean() for k in range(1, grades)]), 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-2 * np.arange(grades - 1))
    params = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    sizes = np.array([len(a) for a, *_ in rows])
    at = np.concatenate([a for a, *_ in rows]).astype(np.int64)
    x = np.concatenate([v for _, v, _ in rows]).astype(float)
    common = np.bincount(at, minlength=BUCKETS) >= least_rows
    sizes = np.bincount(np.repeat(np.arange(len(rows)), sizes), common[at], len(rows)).astype(np.int64)
    x, at = x[common[at]], at[common[at]]
    used, at = np.unique(at, return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    weights = np.zeros(len(used))
    norm2, pnorm2 = np.full(len(used), 1e-8), np.full(grades - 1, 1e-8)
    rng = np.random.default_rng(seed)
    mean, pmean, steps = np.zeros(len(used)), np.zeros(grades - 1), 0  # over the last half: steadier than the last step
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            pick = order[lo:lo + batch]
            take = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in pick])
            owner = np.repeat(np.arange(len(pick)), sizes[pick])
            a, v, g = at[take], x[take], y[pick]
            value = np.bincount(owner, weights[a] * v, len(pick))
            cuts = np.concatenate([[-np.inf], params[0] + np.concatenate([[0], np.cumsum(np.exp(params[1:]))]), [np.inf]])
            upper, lower = _sigmoid(cuts[g + 1] - value), _sigmoid(cuts[g] - value)
            p = np.maximum(upper - lower, 1e-9)
            du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p  # d log p / d cut
            grad = np.bincount(a, (du - dl)[owner] * v, len(used)) / len(pick) + decay * weights
            dcut = np.zeros(grades + 1)
            np.add.at(dcut, g + 1, -du)
            np.add.at(dcut, g, dl)
            dcut = dcut[1:-1] / len(pick)
            dparam = np.concatenate([[dcut.sum()], [dcut[k + 1:].sum() * np.exp(params[k + 1]) for k in range(grades - 2)]])
            norm2 += grad ** 2
            pnorm2 += dparam ** 2
            weights -= rate * grad / np.sqrt(norm2)
            params -= rate * dparam / np.sqrt(pnorm2)
            if 2 * epoch >= epochs:
                steps += 1
                mean += (weights - mean) / steps
                pmean += (params - pmean) / steps
    out = np.zeros(BUCKETS, np.float32)
    out[used] = mean
    return Model(out, pmean[0] + np.concatenate([[0], np.cumsum(np.exp(pmean[1:]))]))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade of the label table's rated rows."""
    return (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
            .groupBy("doc_id").agg(F.min(F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1)
                                         .otherwise(2)).alias("grade")))


def train(docs: DataFrame, rated: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          max_rated: int = MAX_RATED, grades: int = GRADES) -> Model:
    """Fit on the rated rows (doc_id, grade) of smallest hash, ``max_rated`` at most."""
    prepare(docs.sparkSession)
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rated)
    sample = sample.select(F.col("doc_id").alias("_id"), "grade")
    src = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
           .join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))  # max_rated rows at most
           .select("doc_id", "text", "grade"))

    def run(batches):
        for b in batches:
            found = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2).cast(pa.int32()), pa.array([a for a, _ in found], pa.list_(pa.int32())),
                 pa.array([v for _, v in found], pa.list_(pa.float32()))], names=["doc_id", "grade", "at", "x"])

    kind = src.schema["doc_id"].dataType.simpleString()
    table = src.mapInArrow(run, f"doc_id {kind}, grade int, at array<int>, x array<float>").toArrow()
    table = table.take(np.argsort(table.column("doc_id").to_numpy(), kind="stable")).combine_chunks().slice(0, max_rated)
    rows = []
    if table.num_rows:
        at, x = table.column("at").combine_chunks(), table.column("x").combine_chunks()
        cut, a, v = at.offsets.to_numpy(), at.values.to_numpy(), x.values.to_numpy()
        rows = [(a[i:j], v[i:j], g) for i, j, g in zip(cut[:-1], cut[1:], table.column("grade").to_pylist())]
    return fit(rows, grades)


def assess(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
           least_grade: int = LEAST_GRADE, least_tail: float = LEAST_TAIL) -> DataFrame:
    """doc_id, expected_grade, p_usable (P(grade >= 1)), p_top (of the best grade), keep."""
    prepare(df.sparkSession)
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            expected, tails = shared.value.judge(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(expected), pa.array(tails[:, 0]), pa.array(tails[:, -1]),
                 pa.array(tails[:, least_grade - 1] >= least_tail)],
                names=["doc_id", "expected_grade", "p_usable", "p_top", "keep"])

    return src.mapInArrow(run, f"doc_id {id_type}, expected_grade double, p_usable double, p_top double, keep boolean")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least_grade: int = LEAST_GRADE,
              least_tail: float = LEAST_TAIL) -> DataFrame:
    """``docs`` that the model keeps, all columns unchanged."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            _, tails = shared.value.judge(b.column(place).to_pylist())
            yield b.filter(pa.array(tails[:, least_grade - 1] >= least_tail))

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return assess(docs, train(docs, graded(read(spark, sf_dir, "labels"))))
