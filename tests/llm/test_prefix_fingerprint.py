import hashlib
import random

from pyspark.sql import types as T

from pressmill.llm import prefix_fingerprint as pf

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("key", T.StringType()), T.StructField("place", T.StringType())])


def brute(rows):
    """Expected (doc_id, n, edited sha, near_edited, near_next) of rows with distinct ids."""
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (d, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1] or ""
        t = t or ""
        e = t[:len(t) - len(t) // 3] + nxt[:len(t) // 3]
        out[d] = (len(t), hashlib.sha256(e.encode()).hexdigest(), near(t, e), near(t, nxt))
    return out


def near(a, b):
    """Likeness by plain comparison of spans."""
    if not a or not b:
        return float(a == b)
    f = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    s = next((k for k, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    n, got = min(pf.SPAN, len(a), len(b)), []
    for x, y in ((a, b), (b, a)):
        have = {y[i:i + n] for i in range(len(y) - n + 1)}
        inside = set(range(f)) | set(range(len(x) - s, len(x)))
        for i in range(len(x) - n + 1):
            if x[i:i + n] in have:
                inside.update(range(i, i + n))
        got.append(len(inside))
    return min(got) / max(len(a), len(b))


def test_span_equality_and_extensions_against_strings():
    rng, powers = random.Random(7), pf.Powers()
    for _ in range(200):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randint(0, 40)))
        b = "".join(rng.choice("abé😀") for _ in range(rng.randint(0, 40)))
        ha, hb = pf.PrefixHashes(a, powers), pf.PrefixHashes(b, powers)
        for _ in range(20):
            i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
            n = rng.randint(0, min(len(a) - i, len(b) - j))
            assert ha.same_span(i, hb, j, n) == (a[i:i + n] == b[j:j + n])
            ext = ha.common_prefix(hb, i, j)
            assert a[i:i + ext] == b[j:j + ext]
            assert i + ext == len(a) or j + ext == len(b) or a[i + ext] != b[j + ext]
        assert ha.likeness(hb) == hb.likeness(ha) == near(a, b)
        assert (ha.key() == hb.key()) == (a == b)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs)
    got = pf.op2_prefix_fingerprints(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == want[r.doc_id]


def test_many_ranges_and_single_document(spark):
    rng = random.Random(1)
    docs = [(i * 3, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 9)))) for i in range(101)]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], SCHEMA).repartition(5)
    for parts in (1, 7, 200):
        got = {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next)
               for r in pf.edited_pairs(df, parts=parts).collect()}
        assert got == brute(docs)
    one = pf.edited_pairs(df.where("doc_id = 30")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_nulls_repeated_rows_long_and_empty_tables(spark):
    long = "xyz " * 50_000
    df = spark.createDataFrame([(5, None, None, None), (5, None, "a", "b"), (None, "abc", "a", "b"), (None, "abc", "a", "b"),
                                (9, long, "a", "b"), (9, "", "a", "b")], SCHEMA)
    rows = pf.edited_pairs(df, parts=3).collect()
    assert len(rows) == 6
    assert sorted(r.n_chars for r in rows) == [0, 0, 0, 3, 3, 200_000]
    assert len({r.fingerprint for r in rows}) == 3
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert pf.edited_pairs(df.limit(0)).collect() == []
    assert pf.fingerprints(df).count() == 6


def jaccard(a, b):
    x, y = ({t[i:i + pf.SPAN] for i in range(len(t) - pf.SPAN + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_likeness_goes_on_past_scattered_edits(spark):
    rng, powers = random.Random(3), pf.Powers()
    for _ in range(300):
        a = "".join(rng.choice("ab😀") for _ in range(rng.randint(0, 60)))
        b = list(a) if rng.random() < 0.5 else [rng.choice("ab😀") for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            b.insert(rng.randint(0, len(b)), rng.choice("ab"))
        b = "".join(b)
        ha, hb = pf.PrefixHashes(a, powers), pf.PrefixHashes(b, powers)
        assert ha.likeness(hb) == hb.likeness(ha) == near(a, b)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    copy = [w if k % 25 else "changed" for k, w in enumerate(words)]
    stranger = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400))
    docs = [(3, " ".join(words), "", ""), (2, " ".join(copy), "", ""), (1, stranger, "", "")]
    rows = {r.doc_id: r for r in pf.edited_pairs(spark.createDataFrame(docs, SCHEMA), parts=2).collect()}
    assert rows[3].near_next > 0.9 and rows[3].written_next > 0.5
    assert rows[2].near_next < 0.05 and rows[2].written_next < 0.05
    assert 0.6 < rows[3].near_edited < 0.75 and rows[3].near_next == near(docs[0][1], docs[1][1])


def test_written_fingerprints_estimate_the_spans_in_common():
    rng, powers = random.Random(11), pf.Powers()
    off = []
    for _ in range(80):
        a = "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([20, 50, 400, 3000])))
        cut = rng.randint(0, len(a))
        b = a[:cut] + "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 400)))
        got = pf.written_likeness(pf.PrefixHashes(a, powers).key(), pf.PrefixHashes(b, powers).key())
        off.append(got - jaccard(a, b))
        assert abs(off[-1]) < 0.35
    assert abs(sum(off) / len(off)) < 0.04
    same = pf.PrefixHashes("one text", powers).key()
    assert pf.written_likeness(same, pf.PrefixHashes("one text", powers).key()) == 1.0
    assert pf.written_likeness(same, pf.PrefixHashes("", powers).key()) == 0.0
    repeated = pf.PrefixHashes("ab" * 5_000, powers)  # two spans in all
    assert len(repeated.minima()) == 2
