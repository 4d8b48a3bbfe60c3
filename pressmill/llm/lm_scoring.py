"""Language-model scoring with a causal self-attention model, trained in numpy.

Texts are words (ASCII white space between, A-Z lower-cased) and one end. A word's
subword ids come from a given byte-level vocabulary. The model predicts the next id in three steps, its group, the
branch of the group and the member of the branch (all follow the ids' frequency, so the frequent ones share
few products). Of the 50,258 ids of the rank file the 50,652 places leave every id its own; a larger file's
rarest ids would share the last place by their counts.
One attention layer with a feed-forward layer reads the ids before, in windows of
``WINDOW`` places. Windows overlap: of each, only the last ``FRESH`` places are scored, so
every token is scored once and has ``WINDOW - FRESH`` places of context at least (or
all there are). Windows go through attention in batches, under a causal mask.

What is learned: word and subword counts and the network's weights come from all learning
rows; the weights in one round over them of local training (one trainer per partition, in
bounded runs, Adam on the rows of weights that a batch touches) and averaging, each row of weights by its steps.

Beside the model's score there is the add-0.1 unigram score over words. Counts of the
most frequent words (``HOT_WORDS`` at most) go to every worker; a text's other words
meet their counts in a join, which no frequent word can skew.

Defined results: a null or empty text is the end alone; repeated rows are scored each;
a null id counts as an empty id; with nothing to learn from, all ids are alike.
"""

from __future__ import annotations

import base64
import math
import uuid
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import prepare, read, shuffle_parts
from pressmill.session import checkpoint_dir

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WINDOW = 48
FRESH = 32
WIDTH = 16
HIDDEN = 32
#: Choices at each of the three levels of the output; that many cubed are the places.
SIDE = 37
PLACES = SIDE ** 3
#: Logits beyond this are shifted by their row's largest, so that no exponential overflows.
MOST_LOGIT = np.float32(60)
#: Words whose counts go to every worker.
HOT_WORDS = 200_000
#: Tokens of the texts that are scored together (a longer text alone).
STEP_TOKENS = 1 << 18
#: Words per trainer, as far as there are partitions.
TRAINER_WORDS = 100_000
#: Steps that a trainer takes at least, over its rows again if they are few.
LEAST_STEPS = 60
RATE = 2e-2
#: Windows per step: the first for few windows, growing with them to the second.
BATCH = 32
MOST_BATCH = 256
#: Tokens that a trainer holds at once; longer texts are trained in pieces.
RUN_TOKENS = 1 << 19
#: Weights per row when trainers' results are averaged, about.
BLOCK = 1 << 13
#: Windows that are scored together.
SCORED = 512
#: Distinct words that a task counts before it hands them on.
COUNT_AT_ONCE = 300_000
SEED = 5

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_END = b""  # no word is empty


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_LOWER).split()


class Subwords:
    """Ids of words by a rank file; the end has the id after the last rank."""

    def __init__(self, path: str):
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.end = max(ranks.values()) + 1
        self.size = self.end + 1
        self.lib = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.begins = np.zeros(self.size, bool)
        self.begins[[r for t, r in ranks.items() if t.startswith(b" ")]] = True

    def words(self, words: list[bytes]) -> np.ndarray:
        """Ids of the words, each with a blank before it. Words are encoded in one go: no match of the pattern goes
        beyond the blank between two words, unless they hold white space of their own (other than ASCII's)."""
        text = b" ".join([b"", *words]).decode("utf-8")
        if text.isascii() or " ".join(["", *text.split()]) == text:
            return np.array(self.lib.encode_ordinary(text), np.uint32)
        return np.array([i for w in words for i in self.lib.encode_ordinary(" " + w.decode("utf-8"))], np.uint32)

    def text(self, words: list[bytes]) -> np.ndarray:
        """Ids of the words and the end."""
        return np.append(self.words(words), np.uint32(self.end))


@lru_cache(maxsize=2)
def subwords(path: str) -> Subwords:
    return Subwords(path)


class Vocabulary:
    """Place of each id in order of count; ids beyond the last place share it (``inner``: log10 of the share)."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        self.place_of = np.full(len(counts), PLACES - 1, np.int32)
        self.place_of[order[:PLACES - 1]] = np.arange(min(PLACES - 1, len(counts)))
        smooth = counts + 0.5
        total = np.bincount(self.place_of, smooth, PLACES)
        self.inner = np.log10(smooth / total[self.place_of])
        total = np.maximum(total, 1e-3).reshape(SIDE, SIDE, SIDE)
        shares = []
        for level in (total.sum(axis=(1, 2)), total.sum(axis=2), total):
            shares.append(np.log(level / level.sum(axis=-1, keepdims=True)))
        self.group_logs, self.branch_logs, self.member_logs = shares


#: name, shape of each block of weights, in the order of the flat vector. The last row of a softmax's matrix is its bias.
DENSE = [("place", (WINDOW, WIDTH)), ("wq", (WIDTH, WIDTH)), ("wk", (WIDTH, WIDTH)), ("wv", (WIDTH, WIDTH)), ("wo", (WIDTH, WIDTH)),
         ("w1", (WIDTH, HIDDEN)), ("b1", (HIDDEN,)), ("w2", (HIDDEN, WIDTH)), ("group", (WIDTH + 1, SIDE))]
#: Blocks of which a step touches single rows.
SPARSE = [("embed", (PLACES + 1, WIDTH)), ("branch", (SIDE, WIDTH + 1, SIDE)), ("member", (SIDE * SIDE, WIDTH + 1, SIDE))]
DENSE_SIZE = sum(math.prod(shape) for _, shape in DENSE)
#: What stands before a text.
START = PLACES


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, where each begins, and the end) of keys in order."""
    begin = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return sorted_keys[begin], np.append(begin, len(sorted_keys))


def _picked(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``rows[at]``, for places that exist: numpy is faster where it needs not report others."""
    return rows.take(at, axis=0, mode="clip")


def _with_ones(h: np.ndarray) -> np.ndarray:
    out = np.ones((*h.shape[:-1], h.shape[-1] + 1), np.float32)
    out[..., :-1] = h
    return out


class Network:
    def __init__(self, flat: np.ndarray):
        self.flat = np.array(flat, np.float32)
        self.w, at = {}, 0
        for name, shape in DENSE + SPARSE:
            n = math.prod(shape)
            self.w[name] = self.flat[at:at + n].reshape(shape)
            at += n
        places = np.arange(WINDOW)
        self.mask = np.where(places[None, :] <= places[WINDOW - FRESH:, None], 0, -1e9).astype(np.float32)

    @classmethod
    def start(cls, vocabulary: Vocabulary, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        biases = {"group": vocabulary.group_logs, "branch": vocabulary.branch_logs, "member": vocabulary.member_logs}
        parts = []
        for name, shape in DENSE + SPARSE:
            x = rng.normal(0, 0.08 if name in biases or name == "place" else 0.25, shape)
            if name in biases:
                x[..., -1, :] = biases[name].reshape(x[..., -1, :].shape)
            parts.append(np.zeros(shape) if name == "b1" else x)
        return cls(np.concatenate([x.ravel() for x in parts]))

    def forward(self, x_at: np.ndarray):
        """Last layer at the fresh places of each window, and what the backward pass needs."""
        w, d, n = self.w, WIDTH, len(x_at)
        x = _picked(w["embed"], x_at)
        x += w["place"]
        flat, fresh = x.reshape(-1, d), np.ascontiguousarray(x[:, WINDOW - FRESH:]).reshape(-1, d)
        k, v = (flat @ w["wk"]).reshape(n, WINDOW, d), _with_ones((flat @ w["wv"]).reshape(n, WINDOW, d))
        q = (fresh @ w["wq"]).reshape(n, FRESH, d)
        q *= np.float32(d ** -0.5)
        e = np.matmul(q, k.transpose(0, 2, 1))
        e += self.mask
        if e.max(initial=0) > MOST_LOGIT:
            e -= e.max(axis=2, keepdims=True)
        np.exp(e, out=e)
        o = np.matmul(e, v)  # the ones give each row's sum
        norm = o[..., d:]
        o = (o[..., :d] / norm).reshape(-1, d)
        h1 = fresh + o @ w["wo"]
        r = h1 @ w["w1"]
        r += w["b1"]
        np.maximum(r, 0, out=r)
        return h1 + r @ w["w2"], (flat, fresh, k, v, q, e, norm, o, h1, r)

    def _softmax(self, h: np.ndarray, y: np.ndarray):
        """Of rows in order of their place: exponentials at the three levels, the logit of each
        place and the runs of equal branches and members."""
        w, rows = self.w, np.arange(len(y))
        e = np.empty((3, len(y), SIDE), np.float32)
        np.matmul(h, w["group"], out=e[0])
        runs = []
        for level, name, keys in ((1, "branch", y // (SIDE * SIDE)), (2, "member", y // SIDE)):
            which, at = _runs(keys)
            for g, lo, hi in zip(which.tolist(), at.tolist(), at[1:].tolist()):
                np.matmul(h[lo:hi], w[name][g], out=e[level, lo:hi])
            runs.append((name, which, at))
        digits = (y // (SIDE * SIDE), y // SIDE % SIDE, y % SIDE)
        chosen = sum(e[level, rows, c].astype(np.float64) for level, c in enumerate(digits))
        if e.max(initial=0) > MOST_LOGIT:  # of each row the largest goes first, so that none overflows
            most = e.max(axis=2, keepdims=True)
            e -= most
            chosen -= most.sum(axis=(0, 2), dtype=np.float64)
        np.exp(e, out=e)
        return e, e @ np.ones(SIDE, np.float32), chosen, digits, runs

    def log_probabilities(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural logs of the ids' places, by the last layer."""
        if not len(y):
            return np.zeros(0)
        order = np.argsort(y.astype(np.uint16), kind="stable")
        _, norm, chosen, _, _ = self._softmax(_with_ones(_picked(h, order)), y[order].astype(np.int64))
        out = np.empty(len(y))
        out[order] = chosen - np.log(norm.astype(np.float64)).sum(axis=0)
        return out

    def touched_gradient(self, x_at: np.ndarray, y: np.ndarray, real: np.ndarray):
        """Mean loss over the real places; its gradient by the dense weights, and per sparse
        block (rows that the batch touches, gradient by them)."""
        w, d, n = self.w, WIDTH, len(x_at)
        last, (flat, fresh, k, v, q, e, norm, o, h1, r) = self.forward(x_at)
        at = np.flatnonzero(real)
        at = at[np.argsort(y[at].astype(np.uint16), kind="stable")]
        total = max(1, len(at))
        dh, sparse = np.zeros_like(last), {}
        h, rows = _with_ones(_picked(last, at)), np.arange(len(at))
        p, sums, chosen, digits, runs = self._softmax(h, y[at])
        loss = float((np.log(sums.astype(np.float64)).sum() - chosen.sum()) / total)
        p *= (np.float32(1 / total) / sums)[..., None]
        for level, c in enumerate(digits):
            p[level, rows, c] -= np.float32(1 / total)
        g = {"group": h.T @ p[0]}
        dsoft = p[0] @ w["group"].T
        for level, (name, which, begin) in enumerate(runs, 1):
            by = np.empty((len(which), d + 1, SIDE), np.float32)
            for j, (key, lo, hi) in enumerate(zip(which.tolist(), begin.tolist(), begin[1:].tolist())):
                np.matmul(h[lo:hi].T, p[level, lo:hi], out=by[j])
                dsoft[lo:hi] += p[level, lo:hi] @ w[name][key].T
            sparse[name] = (which, by.reshape(len(which), -1))
        dh[at] = dsoft[:, :d]
        g["w2"] = r.T @ dh
        dr = (dh @ w["w2"].T) * (r > 0)
        g["w1"], g["b1"] = h1.T @ dr, dr.sum(axis=0)
        dh += dr @ w["w1"].T
        g["wo"] = o.T @ dh
        do = (dh @ w["wo"].T).reshape(n, FRESH, d)
        # e / norm is the attention; its gradient by the logits is e * (do . v - do . o) / norm
        do = np.concatenate([do, -(do * o.reshape(n, FRESH, d)).sum(axis=2, keepdims=True)], axis=2) / norm
        ds = np.matmul(do, v.transpose(0, 2, 1))
        ds *= e
        dv = np.matmul(e.transpose(0, 2, 1), do[..., :d]).reshape(-1, d)
        dq = (np.matmul(ds, k) * np.float32(d ** -0.5)).reshape(-1, d)
        dk = np.matmul(ds.transpose(0, 2, 1), q).reshape(-1, d)
        g["wq"], g["wk"], g["wv"] = fresh.T @ dq, flat.T @ dk, flat.T @ dv
        dx = (dk @ w["wk"].T + dv @ w["wv"].T).reshape(n, WINDOW, d)
        dx[:, WINDOW - FRESH:] += (dh + dq @ w["wq"].T).reshape(n, FRESH, d)
        g["place"] = dx.sum(axis=0)
        order = np.argsort(x_at.ravel().astype(np.uint16), kind="stable")
        which, begin = _runs(x_at.ravel()[order])
        sparse["embed"] = (which, np.add.reduceat(_picked(dx.reshape(-1, d), order), begin[:-1], axis=0))
        return loss, np.concatenate([g[name].ravel() for name, _ in DENSE]), sparse

    def gradient(self, x_at: np.ndarray, y: np.ndarray, real: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss over the real places, and its gradient as a flat vector."""
        loss, dense, sparse = self.touched_gradient(x_at, y, real)
        out = [dense]
        for name, shape in SPARSE:
            full = np.zeros((shape[0], math.prod(shape[1:])), np.float32)
            full[sparse[name][0]] = sparse[name][1]
            out.append(full.ravel())
        return loss, np.concatenate(out)


def windows(places: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows over texts laid end to end: (inputs, targets, real,
    text of each target)."""
    blocks = -(-sizes // FRESH)
    context = WINDOW - FRESH
    room = context + blocks * FRESH
    base = np.cumsum(room) - room
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(places)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inputs = np.full(int(room.sum()) + WINDOW, START, np.int32)
    fed = at < sizes[text] - 1  # the last token is never an input
    inputs[base[text[fed]] + context + 1 + at[fed]] = places[fed]
    owner = np.repeat(np.arange(len(sizes)), blocks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    x_at = inputs[(base[owner] + number * FRESH)[:, None] + np.arange(WINDOW)]
    y, real = np.zeros(len(owner) * FRESH, np.int64), np.zeros(len(owner) * FRESH, bool)
    place = (np.cumsum(blocks) - blocks)[text] * FRESH + at
    y[place], real[place] = places, True
    return x_at, y, real, np.repeat(owner, FRESH)


class Scorer:
    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray, path: str):
        self.vocabulary, self.network, self.path = vocabulary, Network(flat), path

    def __reduce__(self):
        return Scorer, (self.vocabulary, self.network.flat, self.path)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """log10 probability of each text."""
        sub, voc = subwords(self.path), self.vocabulary
        ids = [sub.text(words_of(t)) for t in texts]
        return self.score_places([voc.place_of[x] for x in ids]) + np.array([voc.inner[x].sum() for x in ids])

    def score_places(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of texts of places."""
        net, out = self.network, np.zeros(len(texts))
        lo = 0
        while lo < len(texts):  # texts of bounded total size; a longer one goes alone
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= STEP_TOKENS):
                size += len(texts[hi])
                hi += 1
            sizes = np.array([len(x) for x in texts[lo:hi]])
            x_at, y, real, text = windows(np.concatenate(texts[lo:hi]), sizes)
            logs = np.zeros(len(y))
            for b in range(0, len(x_at), SCORED):  # blocks that stay in the processor's cache
                part = slice(b * FRESH, (b + SCORED) * FRESH)
                keep = real[part]
                h = net.forward(x_at[b:b + SCORED])[0]
                logs[part][keep] = net.log_probabilities(h[keep], y[part][keep])
            out[lo:hi] = np.bincount(text, logs, hi - lo) / math.log(10)
            lo = hi
        return out


class Trainer:
    """Adam from the given weights; a step updates the dense weights and the sparse rows that its batch
    touches, each row by its own count of steps. The rate falls over ``tokens``, the expected number."""

    def __init__(self, flat: np.ndarray, rate: float, tokens: float, least_steps: int, seed: int):
        self.net = Network(flat)
        self.rate, self.rng = rate, np.random.default_rng(seed)
        windows_expected = max(1.0, tokens / FRESH)
        self.batch = int(min(MOST_BATCH, max(BATCH, windows_expected // LEAST_STEPS)))
        self.expected = max(least_steps, windows_expected / self.batch)
        self.done = 0
        self.rows = {name: self.net.w[name].reshape(shape[0], -1) for name, shape in SPARSE}
        self.rows["dense"] = self.net.flat[:DENSE_SIZE].reshape(1, -1)
        self.first = {name: np.zeros_like(x) for name, x in self.rows.items()}
        self.second = {name: np.zeros_like(x) for name, x in self.rows.items()}
        self.steps = {name: np.zeros(len(x), np.int64) for name, x in self.rows.items()}

    def _update(self, name: str, which: np.ndarray, g: np.ndarray, rate: float) -> None:
        self.steps[name][which] += 1
        n = self.steps[name][which][:, None]
        first, second = self.first[name][which], self.second[name][which]
        first += np.float32(0.1) * (g - first)
        second += np.float32(0.01) * (g * g - second)
        self.first[name][which], self.second[name][which] = first, second
        first *= (rate / (1 - 0.9 ** n)).astype(np.float32)
        second *= (1 / (1 - 0.99 ** n)).astype(np.float32)
        np.sqrt(second, out=second)
        second += np.float32(1e-8)
        first /= second
        self.rows[name][which] -= first

    def learn(self, texts: list[np.ndarray], least_steps: int = 0) -> None:
        """One pass over the windows of texts of places, or more up to ``least_steps`` steps."""
        sizes = np.array([len(t) for t in texts])
        x_at, y, real, _ = windows(np.concatenate(texts), sizes)
        y, real = y.reshape(-1, FRESH), real.reshape(-1, FRESH)
        stop = self.done + max(-(-len(x_at) // self.batch), least_steps)
        while self.done < stop:
            order = self.rng.permutation(len(x_at))
            for b in range(0, len(order), self.batch):
                pick = order[b:b + self.batch]
                _, dense, sparse = self.net.touched_gradient(x_at[pick], y[pick].ravel(), real[pick].ravel())
                rate = self.rate * max(0.05, 1 - 0.95 * self.done / self.expected)
                self._update("dense", np.zeros(1, np.int64), dense[None], rate)
                for name, (which, g) in sparse.items():
                    self._update(name, which, g, rate)
                self.done += 1
                if self.done >= stop:
                    break

    def touched(self):
        """(start in the flat vector, weights, steps) per row that was trained, in bounded runs of rows."""
        at = 0
        for name in ("dense", *(name for name, _ in SPARSE)):
            rows, width = self.rows[name], self.rows[name].shape[1]
            per = max(1, BLOCK // width)
            for lo in range(0, len(rows), per):
                steps = self.steps[name][lo:lo + per]
                if steps.any():
                    yield at + lo * width, rows[lo:lo + per], steps
            at += rows.size


def train_locally(flat: np.ndarray, vocabulary: Vocabulary, texts: list[np.ndarray], rate: float, least_steps: int,
                  seed: int) -> np.ndarray:
    """Adam from the given weights over the windows of texts of ids."""
    trainer = Trainer(flat, rate, sum(map(len, texts)), least_steps, seed)
    trainer.learn([vocabulary.place_of[t] for t in texts], least_steps)
    return trainer.net.flat


def written(df: DataFrame) -> DataFrame:
    """A compressed table in the shared folder, read again."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows of ``texts`` (one column); the end is the empty word."""

    def run(batches):
        def rows(c):
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())],
                                              names=["word", "c"])
        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                counts.update(words_of(t))
            counts[_END] += b.num_rows
            if len(counts) > COUNT_AT_ONCE:
                yield rows(counts)
                counts = Counter()
        if counts:
            yield rows(counts)

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def hot_words(counts: DataFrame, most: int = HOT_WORDS) -> tuple[int, dict[bytes, int]]:
    """(least count, words with it) such that there are ``most`` at most."""
    step = F.floor(F.log2("c") * 8).cast("int")
    histogram = counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).orderBy(F.desc("s")).collect()
    total, least = 0, 1 << 62
    for r in histogram:
        total += r["n"]
        if total > most:
            break
        least = r["least"]
    table = counts.where(F.col("c") >= least).toArrow()
    return least, dict(zip(table.column("word").to_pylist(), table.column("c").to_pylist()))


def subword_counts(counts: DataFrame, path: str) -> np.ndarray:
    """Count of every subword id in the counted words; one row per id reaches the driver."""

    def run(batches):
        sub = subwords(path)
        total = np.zeros(sub.size)
        for b in batches:
            words, c = b.column(0).to_pylist(), b.column(1).to_numpy()
            ends = np.array([w == _END for w in words], bool)
            total[sub.end] += c[ends].sum()
            ids = sub.words([w for w in words if w != _END])
            # of a word's ids the first begins with the blank before it, and no other
            total += np.bincount(ids, c[~ends][np.cumsum(sub.begins[ids]) - 1], sub.size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], names=["id", "n"])

    table = counts.mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(subwords(path).size)
    out[table.column("id").to_numpy()] = table.column("n").to_numpy()
    return out


def encoded(rows: DataFrame, vocabulary: Vocabulary, path: str) -> DataFrame:
    """``rows`` (with a column text) with places (16 bits each) and inner (log10 of the shares in a common
    place) instead of text."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary.place_of.astype(np.uint16), vocabulary.inner))
    kept = [c for c in rows.columns if c != "text"]

    def run(batches):
        sub, (place_of, inner) = subwords(path), shared.value
        for b in batches:
            ids = [sub.text(words_of(t)) for t in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(kept)], pa.array([place_of[x].tobytes() for x in ids], pa.binary()),
                 pa.array([float(inner[x].sum()) for x in ids], pa.float64())], names=[*kept, "places", "inner"])

    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, "text").mapInArrow(run, f"{types}, places binary, inner double")


def train_network(rows: DataFrame, vocabulary: Vocabulary, path: str, words: int, least_steps: int = LEAST_STEPS) -> np.ndarray:
    """As ``train_on_places``, on ``rows`` (doc_id, text), which have ``words`` words."""
    return train_on_places(encoded(rows.select("doc_id", "text"), vocabulary, path), vocabulary, words, words * 3, least_steps)


def train_on_places(rows: DataFrame, vocabulary: Vocabulary, words: int, tokens: float, least_steps: int = LEAST_STEPS) -> np.ndarray:
    """One round over all ``rows`` (doc_id, places): a trainer takes the rows of a partition in bounded runs; a row of weights
    becomes the mean of the trainers that touched it, by their steps on it."""
    flat = Network.start(vocabulary).flat
    trainers = max(1, min(shuffle_parts(rows), words // TRAINER_WORDS))
    # dealt and ordered by a hash, so that each trainer sees a mixture; the text's part in it spreads a repeated id
    mixed = F.xxhash64("doc_id", "places")
    taken = (rows.select(mixed.alias("mix"), "places").repartition(trainers, "mix").sortWithinPartitions("mix").select("places"))
    start = rows.sparkSession.sparkContext.broadcast(flat)

    def learn(batches):
        # a trainer learns from one bounded run of texts after the other
        trainer, held, size = None, [], 0
        for b in batches:
            for places in b.column(0):
                x = np.frombuffer(places.as_py(), np.uint16).astype(np.int32)
                for lo in range(0, len(x), RUN_TOKENS):
                    held.append(x[lo:lo + RUN_TOKENS])
                    size += len(held[-1])
                    if size >= RUN_TOKENS:
                        trainer = trainer or Trainer(start.value, RATE, tokens / trainers, least_steps, SEED)
                        trainer.learn(held)
                        held, size = [], 0
        if held:
            more = 0 if trainer else least_steps
            trainer = trainer or Trainer(start.value, RATE, size, least_steps, SEED)
            trainer.learn(held, more)
        if trainer:
            for at, w, n in trainer.touched():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([w.tobytes()], pa.binary()),
                                                  pa.array([n.tobytes()], pa.binary())], names=["at", "w", "n"])

    def average(block: pa.Table) -> pa.Table:
        at, total, steps = block.column("at")[0].as_py(), 0.0, 0
        for n, w in zip(block.column("n").to_pylist(), block.column("w").to_pylist()):
            n = np.frombuffer(n, np.int64).astype(np.float64)[:, None]
            total, steps = total + n * np.frombuffer(w, np.float32).reshape(len(n), -1), steps + n
        before = start.value[at:at + total.size].reshape(total.shape)
        w = np.where(steps > 0, total / np.maximum(steps, 1), before).astype(np.float32)
        return pa.table({"at": pa.array([at], pa.int32()), "w": pa.array([w.tobytes()], pa.binary())})

    table = taken.mapInArrow(learn, "at int, w binary, n binary").groupBy("at").applyInArrow(average, "at int, w binary").toArrow()
    for at, w in zip(table.column("at").to_pylist(), table.column("w").to_pylist()):
        w = np.frombuffer(w, np.float32)
        flat[at:at + len(w)] = w
    return flat


def unigram_scores(src: DataFrame, counts: DataFrame, hot: dict[bytes, int], total: int, distinct: int) -> DataFrame:
    """Per (doc_id, tie): n_tokens, n_known, base_score, each summed over ``copies`` rows."""
    kind = src.schema["doc_id"].dataType.simpleString()
    floor = math.log10(total + 0.1 * (distinct + 1))
    shared = src.sparkSession.sparkContext.broadcast({w: math.log10(c + 0.1) - floor for w, c in hot.items()})

    def run(batches):
        logs = shared.value
        for b in batches:
            at, word, n, known, base, tokens = [], [], [], [], [], []
            for row, t in enumerate(b.column(2).to_pylist()):
                found = Counter(words_of(t))
                found[_END] += 1
                score, seen, size, before = 0.0, 0, 0, len(word)
                for w, k in found.items():
                    size += k
                    g = logs.get(w)
                    if g is None:
                        word.append(w)
                        n.append(k)
                    else:
                        score += g * k
                        seen += k
                more = len(word) - before
                # the text's own row: its key has a blank, which no word has, and is its alone
                word.append(b" %d %d" % (b.column(0)[row].as_py() or 0, b.column(1)[row].as_py()))
                at += [row] * (more + 1)
                n.append(0)
                known += [0] * more + [seen]
                base += [0.0] * more + [score]
                tokens += [0] * more + [size]
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(word, pa.binary()), pa.array(n, pa.int32()),
                 pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "tie", "word", "n", "known", "base", "tokens"])

    rows = src.select("doc_id", "tie", "text").mapInArrow(
        run, f"doc_id {kind}, tie long, word binary, n int, known long, base double, tokens long")
    joined = rows.join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    # a text's own row has n = 0
    return joined.groupBy("doc_id", "tie").agg(
        F.sum("tokens").alias("tokens"), F.sum(F.col("known") + F.when(c > 0, F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("base") + F.col("n") * (F.log10(c + F.lit(0.1)) - F.lit(floor))).alias("base"),
        F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).alias("copies"))


def score_texts(df: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", path: str = RANK_FILE) -> DataFrame:
    """Per row: doc_id, held_out (not learned from), n_tokens, n_known, train_tokens, base_score, score.
    ``learn`` is a Column over doc_id: the rows learned from."""
    spark = prepare(df.sparkSession)
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    learning = src.where(learn)
    counts = written(word_counts(learning.select("text")))
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    least, hot = hot_words(counts)
    ids = subword_counts(counts, path)
    vocabulary = Vocabulary(ids)
    tied = src.withColumn("tie", F.xxhash64("text"))
    rare = counts.where(F.col("c") < least)
    base = unigram_scores(tied, rare, hot, size["total"], size["distinct"])
    places = written(encoded(tied.select("doc_id", "tie", (~learn).alias("held_out"), "text"), vocabulary, path))
    flat = train_on_places(places.where(~F.col("held_out")), vocabulary, size["total"], float(ids.sum()))

    shared = spark.sparkContext.broadcast(Scorer(vocabulary, flat, path))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = [np.frombuffer(x, np.uint16).astype(np.int32) for x in b.column(3).to_pylist()]
            scores = shared.value.score_places(texts) + b.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(scores)], names=["doc_id", "tie", "held_out", "score"])

    scored = places.select("doc_id", "tie", "held_out", "places", "inner").mapInArrow(
        run, f"doc_id {kind}, tie long, held_out boolean, score double")
    base = base.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "tokens", "known", "base", "copies")
    return (scored.join(base, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")))
            .select("doc_id", "held_out", (F.col("tokens") / F.col("copies")).cast("long").alias("n_tokens"),
                    (F.col("known") / F.col("copies")).cast("long").alias("n_known"),
                    F.lit(size["total"]).cast("long").alias("train_tokens"),
                    (F.col("base") / F.col("copies")).alias("base_score"), "score"))


def learned_from(id_col: str = "doc_id"):
    """Rows whose crc32 of the id as text leaves other than 0 modulo 10 (a null id: empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 != 0


def op5_lm_scoring(spark, sf_dir) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents", "doc_id", "text"), learned_from())
