"""Language identification and bookkeeping.

A6 is a character-trigram naive-Bayes scorer:

* ``train_profiles``: labelled texts -> (lang, gram, log p) with add-one
  smoothing over the shared gram vocabulary. Tasks count their texts' grams in
  numpy, in bounded steps; Spark sums the counts;
* ``detect``: texts -> what their grams add per language -> ``max_by`` the
  language. The most frequent grams' profile rows (``HOT_CELLS`` at most) go to
  every worker, which sums them up; a text's other grams, one row per distinct
  gram, meet the rest of the profile in a join.

A gram's key is its three code points in one 64-bit integer, so no two grams
share a key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.functions import text as tx
from pressmill.session import checkpoint_dir, materialize, small_batches

#: (gram, language) cells of the profile that go to every worker.
HOT_CELLS = 1 << 20
#: Characters that are looked at together.
STEP_CHARS = 1 << 19
#: Distinct (language, gram) that a training task holds before it hands them on.
COUNT_AT_ONCE = 500_000


def _norm(c: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(tx.collapse_ws(c)), F.lit(" "))


def _steps(texts):
    """(rows, grams, piece of each gram) of normalised texts (bytes or None), about ``STEP_CHARS`` at a time; a
    piece is a text, or a part of a longer one, and ``rows`` names each piece's text."""
    rows, pieces, size = [], [], 0
    for row, t in enumerate(texts):
        codes = np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le"), np.uint32) if t is not None else ()
        for lo in range(0, len(codes) - 2, STEP_CHARS):
            rows.append(row)
            pieces.append(codes[lo:lo + STEP_CHARS + 2])
            size += len(pieces[-1])
            if size >= STEP_CHARS:
                yield np.array(rows), *_packed(pieces)
                rows, pieces, size = [], [], 0
    if rows:
        yield np.array(rows), *_packed(pieces)


def _packed(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of pieces of three characters at least, and the piece of each."""
    codes = np.concatenate(pieces).astype(np.int64)
    sizes = np.array([len(p) for p in pieces])
    grams = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    inside = np.ones(len(codes), bool)  # no gram begins at a piece's last two characters
    inside[np.cumsum(sizes) - 1] = inside[np.cumsum(sizes) - 2] = False
    return grams[inside[:-2]], np.repeat(np.arange(len(pieces)), sizes - 2)


def _counts(*keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The distinct rows of ``keys``, and the count (or the sum of ``n``) of each."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    begin = np.flatnonzero(new)
    sums = np.diff(np.append(begin, len(order))) if n is None else np.add.reduceat(n[order], begin)
    return *[k[begin] for k in keys], sums


def train_profiles(labelled: DataFrame, key: str = "doc_id", text_col: str = "text",
                   lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Returns (profile(lang, gram, delta), prior(lang, unseen)).

    With add-one smoothing over the shared vocabulary V,
    ``log p(g|lang) = log(n + 1) - log(total_lang + V)``: ``unseen`` is the
    second term (negated), ``delta = log(n + 1)`` is what a seen gram adds."""
    small_batches(labelled.sparkSession)
    t = labelled.select(F.col(lang_col).cast("string").alias("lang"), _norm(F.col(text_col)).cast("binary").alias("_t"))

    def run(batches):
        names, held, size = {}, [], 0

        def rows(lang, gram, n):
            return pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()).take(pa.array(lang)), pa.array(gram), pa.array(n)],
                                              names=["lang", "gram", "n"])
        for b in batches:
            langs = b.column(0).to_pylist()
            for of, grams, piece in _steps(b.column(1).to_pylist()):
                code = np.array([names.setdefault(langs[r], len(names)) for r in of.tolist()])
                met, code = np.unique(code), code[piece]
                if len(met) <= 16:
                    for c in met:
                        gram, n = np.unique(grams[code == c], return_counts=True)
                        held.append((np.full(len(gram), c), gram, n))
                else:
                    held.append(_counts(code, grams))
                size = sum(len(h[1]) for h in held)
                if size > COUNT_AT_ONCE:
                    lang, gram, n = map(np.concatenate, zip(*held))
                    held = [_counts(lang, gram, n=n)]
                    size = len(held[0][0])
                    if size > COUNT_AT_ONCE // 2:
                        yield rows(*held[0])
                        names, held, size = {}, [], 0
        if held:
            lang, gram, n = map(np.concatenate, zip(*held))
            yield rows(*_counts(lang, gram, n=n))

    occ = t.mapInArrow(run, "lang string, gram long, n long")
    # checkpointed once: both the profile and the prior read it
    per = materialize(occ.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    prof = per.select("lang", "gram", F.log(F.col("n") + 1).alias("delta"))
    prior = per.sparkSession.sql(
        "SELECT lang, -ln(sum(n) + (SELECT count(DISTINCT gram) FROM {per})) AS unseen FROM {per} GROUP BY lang",
        per=per)
    return prof, prior


def _hot_grams(profile: DataFrame, prior: DataFrame, cells: int) -> tuple[list[str], np.ndarray, np.ndarray, DataFrame | None]:
    """(languages, grams, what they add by language and gram, the other grams' profile or None): the most
    frequent grams, such that they have ``cells`` cells at most."""
    langs = sorted(r[0] for r in prior.select("lang").where("lang IS NOT NULL").collect())
    grams = (profile.where("lang IS NOT NULL").groupBy("gram")
             .agg(F.floor(F.log2(F.sum(F.exp("delta"))) * 8).alias("step"), F.collect_list(F.struct("lang", "delta")).alias("cells")))
    total, least, rest = 0, 1 << 30, False
    for r in grams.groupBy("step").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():
        total += r["n"]
        if total * len(langs) > cells:
            rest = True
            break
        least = r["step"]
    cell = grams.select("step", "gram", F.explode("cells").alias("c")).select("step", "gram", "c.lang", "c.delta")
    hot = cell.where(F.col("step") >= least).select("gram", "lang", "delta").toArrow()
    keys, at = np.unique(hot.column("gram").to_numpy(), return_inverse=True)
    number = {x: i for i, x in enumerate(langs)}
    adds = np.zeros((len(langs), len(keys) + 1))  # the last one is of no gram
    adds[[number[x] for x in hot.column("lang").to_pylist()], at] = hot.column("delta").to_numpy()
    return langs, keys, adds, cell.where(F.col("step") < least).select("gram", "lang", "delta") if rest else None


def _hits(df: DataFrame, profile: DataFrame, prior: DataFrame, key: str, text_col: str, cells: int) -> DataFrame:
    """(key, n_grams, lang, hit), several rows per text and language."""
    spark = df.sparkSession
    small_batches(spark)
    langs, grams, adds, others = _hot_grams(profile, prior, cells)
    shared = spark.sparkContext.broadcast((grams, adds))
    any_cold = others is not None

    def run(batches):
        hot, adds = shared.value
        index, names, number = pd.Index(hot), pa.array(langs, pa.string()), 0
        for b in batches:
            hits, sizes, cold = np.zeros((b.num_rows, len(langs))), np.zeros(b.num_rows, np.int64), []
            for of, g, piece in _steps(b.column(1).to_pylist()):
                first, count = of[0], of[-1] - of[0] + 1
                row, at = (of - first)[piece], index.get_indexer(g)
                sizes[first:first + count] += np.bincount(row, minlength=count)
                for k in range(len(langs)):
                    hits[first:first + count, k] += np.bincount(row, adds[k][at], count)
                if any_cold and (missed := at < 0).any():
                    r, gram, n = _counts(row[missed], g[missed])
                    cold.append((r + first, gram, n))
            row, lang = np.nonzero(hits > 0)
            # no gram has a negative key, and these spread
            own = -1 - np.arange(number, number + len(row))
            number += len(row)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(sizes[row]), names.take(pa.array(lang)), pa.array(hits[row, lang]),
                 pa.array(own), pa.array(np.zeros(len(row), np.int64))], names=[key, "n_grams", "lang", "hit", "gram", "cnt"])
            for row, gram, n in cold:
                none = pa.nulls(len(row))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row)), pa.array(sizes[row]), none.cast(pa.string()), none.cast(pa.float64()),
                     pa.array(gram), pa.array(n)], names=[key, "n_grams", "lang", "hit", "gram", "cnt"])

    t = df.select(key, _norm(F.col(text_col)).cast("binary").alias("_t"))
    kind = df.schema[key].dataType.simpleString()
    rows = t.mapInArrow(run, f"`{key}` {kind}, n_grams long, lang string, hit double, gram long, cnt long")
    if not any_cold:
        return rows.select(key, "n_grams", "lang", "hit")
    others = others.select("gram", F.col("lang").alias("_lang"), "delta")
    return (rows.join(others, "gram", "left")
            .select(key, "n_grams", F.coalesce("lang", "_lang").alias("lang"),
                    F.coalesce("hit", F.col("cnt") * F.col("delta")).alias("hit")))


def detect(df: DataFrame, profile: DataFrame, prior: DataFrame, key: str, text_col: str,
           out: str = "detected", cells: int = HOT_CELLS) -> DataFrame:
    """(key, out): best-scoring language per text; NULL when no gram of the
    text was ever seen. Languages without a single shared gram are not
    candidates (their score is the floor ``n * unseen``).

    ``cells`` bounds what of the profile goes to every worker, not the result."""
    prior_b = F.broadcast(prior)   # one row per language
    hit = (_hits(df, profile, prior, key, text_col, cells)
           .groupBy(key, "lang").agg(F.sum("hit").alias("hit"), F.max("n_grams").alias("n_grams")))
    scores = (hit.join(prior_b, "lang")
              .select(key, "lang", (F.col("n_grams") * F.col("unseen") + F.col("hit")).alias("score")))
    best = scores.groupBy(key).agg(F.max_by("lang", F.struct(F.col("score"), F.col("lang"))).alias(out))
    return df.select(key).join(best, key, "left")


def english_passthrough(articles: DataFrame, lang_col: str = "source_language") -> DataFrame:
    """L2: English articles carry their originals as translations."""
    en = F.col(lang_col) == "en"
    return (articles
            .withColumn("translated_title", F.when(en, F.col("title")).otherwise(F.col("translated_title")))
            .withColumn("translated_body", F.when(en, F.col("body")).otherwise(F.col("translated_body")))
            .withColumn("translated", F.when(en, F.lit(True)).otherwise(F.col("translated"))))


def agree(title_lang: Column, body_lang: Column) -> Column:
    """L3: language kept only when title and body agree; undetected = ''."""
    t, b = F.coalesce(title_lang, F.lit("")), F.coalesce(body_lang, F.lit(""))
    return F.when(t == b, b).otherwise(F.lit(""))


def undetermined(articles: DataFrame, lang_col: str = "source_language") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) — 'und' articles are removed from the store."""
    und = F.coalesce(F.col(lang_col) == "und", F.lit(False))
    return articles.filter(~und), articles.filter(und)


def untranslated(articles: DataFrame) -> DataFrame:
    """The translation backlog."""
    return articles.filter(~F.coalesce(F.col("translated"), F.lit(False)))


def fill_language(articles: DataFrame, profile: DataFrame, prior: DataFrame, key: str = "id",
                  lang_col: str = "source_language", body_col: str = "body") -> DataFrame:
    """L4: an empty language is detected again on the first translation part
    of the body; the result fills the gap (NULL stays when nothing is found)."""
    empty = F.coalesce(F.col(lang_col), F.lit("")) == ""
    todo = articles.filter(empty).select(key, F.get(tx.translation_parts(F.col(body_col)), 0).alias("_first"))
    found = detect(todo, profile, prior, key, "_first", out="_fill")
    return (articles.join(found, key, "left")
            .withColumn(lang_col, F.when(empty, F.col("_fill")).otherwise(F.col(lang_col))).drop("_fill"))


def _input_key(df: DataFrame) -> str:
    """Identity of a DataFrame's input: every file's path, length and
    modification time (Hadoop file system metadata, any cluster store)."""
    import hashlib
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    parts = []
    for f in sorted(df.inputFiles()):
        p = jvm.org.apache.hadoop.fs.Path(f)
        st = p.getFileSystem(conf).getFileStatus(p)
        parts.append(f"{f}|{st.getLen()}|{st.getModificationTime()}")
    return hashlib.sha1("\n".join(parts).encode()).hexdigest()[:20]


def load_or_train(labelled: DataFrame, key: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """A trained profile is a model table: trained once per training input and
    stored under the shared checkpoint folder, then read by every detection
    job. A changed input (any file's length or time) trains a new one."""
    spark = labelled.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/models/lang-points-{_input_key(labelled)}-{text_col}-{lang_col}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    done = jvm.org.apache.hadoop.fs.Path(f"{base}/prior/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        prof, prior = train_profiles(labelled, key, text_col, lang_col)
        prof.write.mode("overwrite").parquet(f"{base}/profile")
        prior.write.mode("overwrite").parquet(f"{base}/prior")     # written last: marks the model complete
    return spark.read.parquet(f"{base}/profile"), spark.read.parquet(f"{base}/prior")
