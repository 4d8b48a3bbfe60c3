import hashlib
import random

from pyspark.sql import types as T

from pressmill.llm import exact_dedup as ed

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("kept", T.StringType()), T.StructField("fingerprint", T.StringType())])


def blankless(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def brute(docs):
    groups = {}
    for d, t in docs:
        groups.setdefault(blankless(t), []).append((-len(t or ""), d is None, d))
    out = []
    for d, t in docs:
        key = blankless(t)
        keep = min(groups[key])[2]
        out.append((d, keep, len(groups[key]), d == keep, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


def sample(rng, n):
    bases = ["".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 30))) for _ in range(12)]
    return [(i, "".join(c + rng.choice(["", "", " ", "\t"]) for c in rng.choice(bases))) for i in range(n)]


def test_composition_equals_the_whole_hash():
    rng = random.Random(1)
    for _ in range(50):
        data = bytes(rng.randrange(256) for _ in range(rng.randint(0, 400)))
        whole = ed.Fingerprint(chunk_bytes=1 << 10).of(data)
        assert all(ed.Fingerprint(chunk_bytes=c).of(data) == whole for c in (1, 7, 64, 400))
        cut = rng.randint(0, len(data))
        f = ed.Fingerprint(chunk_bytes=1 << 10)
        assert f.compose(f.of(data[:cut]), f.of(data[cut:]), len(data) - cut) == whole


def test_groups_against_brute_force(spark):
    docs = sample(random.Random(2), 200)
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], SCHEMA).repartition(3)
    assert rows_of(ed.exact_groups(df, chunk_bytes=5)) == brute(docs)


def test_colliding_fingerprints_are_split_by_the_text(spark):
    docs = sample(random.Random(3), 150)
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], SCHEMA)
    # under the modulus 2 most texts of one length collide
    assert rows_of(ed.exact_groups(df, moduli=(2,), chunk_bytes=4)) == brute(docs)


def test_nulls_long_repeated_rows_and_empty_tables(spark):
    long = "word " * 60_000
    docs = [(1, long), (2, long + "\n"), (3, None), (4, " \n"), (None, "abc"), (5, "a b c"), (5, "a b c"), (6, ""), (7, "a b")]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], SCHEMA)
    assert rows_of(ed.exact_groups(df)) == brute(docs)
    left = ed.drop_copies(df)
    assert left.columns == df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "4", "5", "7"]
    assert ed.exact_groups(df.limit(0)).collect() == [] and ed.drop_copies(df.limit(0)).collect() == []
