import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pressmill.operators import lang

TRAIN = [(1, "the quick brown fox \U0001F98A\U0001F98A jumps over the lazy dog", "en"), (2, "le renard brun saute par dessus le chien", "fr"),
         (3, "der schnelle braune Fuchs", "de"), (4, None, "de"), (5, "the the\tthe", None), (6, "the cat", "en")]
TEXTS = [(1, "the dog \U0001F98A\U0001F98A x"), (2, "le chien et le chat"), (3, ""), (4, None), (5, "中文字"), (6, "Der  Fuchs\n" * 50),
         (7, "the the"), (8, "zz the fuchs zz qq"), (None, "the dog")]


def grams(text):
    t = " " + " ".join(text.lower().replace("\n", " ").replace("\t", " ").split(" ")) + " "
    while "  " in t:
        t = t.replace("  ", " ")
    return Counter(t[i:i + 3] for i in range(len(t) - 2))


def brute():
    per, total = {}, Counter()
    for _, text, of in TRAIN:
        for g, n in grams(text).items() if text is not None else ():
            per.setdefault(of, Counter())[g] += n
            total[g] += n
    unseen = {of: -math.log(sum(c.values()) + len(total)) for of, c in per.items() if of}
    out = {}
    for key, text in TEXTS:
        own = grams(text) if text is not None else Counter()
        scores = [(sum(own.values()) * unseen[of] + sum(n * math.log(per[of][g] + 1) for g, n in own.items()), of)
                  for of in unseen if any(g in per[of] for g in own)]
        out[key] = max(scores)[1] if scores and key is not None else None
    return out


@pytest.mark.parametrize("cells", [0, 40, 1 << 20])
@pytest.mark.parametrize("step", [5, 1 << 19])
def test_languages_as_by_brute_force_however_much_goes_to_the_workers(spark, monkeypatch, cells, step):
    prof, prior = lang.train_profiles(spark.createDataFrame(TRAIN, "doc_id long, text string, lang string"))
    df = spark.createDataFrame(TEXTS, "id long, t string")
    found = {r["id"]: r["detected"] for r in lang.detect(df, prof, prior, "id", "t", cells=cells).collect()}
    assert found == brute()
    # the steps that a text is cut into change nothing
    monkeypatch.setattr(lang, "STEP_CHARS", step)
    texts = [t.encode() if t is not None else None for _, t in TEXTS]
    counts = Counter()
    for rows, g, piece in lang._steps(texts):
        counts.update(zip(rows[piece].tolist(), g.tolist()))
    expected = Counter((row, (ord(t[i]) << 42) | (ord(t[i + 1]) << 21) | ord(t[i + 2]))
                       for row, (_, t) in enumerate(TEXTS) if t for i in range(len(t) - 2))
    assert counts == expected


def test_no_row_per_gram(spark):
    prof, prior = lang.train_profiles(spark.createDataFrame(TRAIN, "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(i, "the quick brown fox " * 100) for i in range(20)], "id long, t string")
    assert lang._hits(df, prof, prior, "id", "t", lang.HOT_CELLS).count() <= 20 * 3
    # a gram that few workers know by heart: one row for all its places in a text
    rows = lang._hits(df, prof, prior, "id", "t", 0)
    assert rows.where(F.col("lang").isNotNull()).count() <= 20 * 3 * len(grams("the quick brown fox " * 2))
