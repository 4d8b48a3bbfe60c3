import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill.llm import merkle_manifest as mm

SCHEMA = T.StructType([T.StructField("group", T.StringType()), T.StructField("key", T.LongType()),
                       T.StructField("leaf", T.StringType()), T.StructField("changed", T.StringType()),
                       T.StructField("g", T.StringType()), T.StructField("pos", T.StringType())])


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def brute(rows, arity=2):
    """rows: (group, key, leaf, changed) -> sorted result tuples."""
    def first(value):
        return (value is not None, value if value is not None else 0)
    groups = {}
    for r in sorted(rows, key=lambda r: (first(r[1]), r[2])):
        groups.setdefault(r[0], []).append(r)
    names = sorted(groups, key=lambda g: b"" if g is None else b"+" + g.encode())
    trees = {g: brute_levels([r[2] for r in groups[g]], arity) for g in names}
    top = brute_levels([trees[g][-1][0] for g in names], arity)
    out = []
    for place, g in enumerate(names):
        for at, (_, key, leaf, changed) in enumerate(groups[g]):
            node, proof = changed or leaf, []
            for tree, i in ((trees[g], at), (top, place)):
                for level in tree[:-1]:
                    start = i - i % arity
                    run = level[start:start + arity]
                    proof += run[:i - start] + run[i - start + 1:]
                    node = h(*run[:i - start], node, *run[i - start + 1:])
                    i //= arity
            out.append((key, leaf, trees[g][-1][0], top[-1][0], h(*proof), node, node == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_fold_resumes_the_state_before_the_slot(arity):
    for n in list(range(1, 20)) + [64, 65]:
        leaves = [h(str(i)) for i in range(n)]
        tree = mm.MidstateTree([x.encode() for x in leaves], arity)
        assert tree.root.decode() == brute_levels(leaves, arity)[-1][0]
        for at in range(n):
            other = leaves[:at] + [h("x")] + leaves[at + 1:]
            assert tree.fold(at, h("x").encode()).decode() == brute_levels(other, arity)[-1][0]
            assert mm.Way(tree.steps(at)).fold(h("x").encode()) == tree.fold(at, h("x").encode())
        for level, states in zip(tree.nodes, tree.states):  # copies: before slot k, the k children on the left are in
            for at, state in enumerate(states):
                assert state.hexdigest() == hashlib.sha256(b"".join(level[at - at % arity:at])).hexdigest()


@pytest.mark.parametrize("arity,block,sizes", [(2, 4, {"en": 70, None: 5, "de": 1, "": 4, "ü": 17}), (3, 9, {"a": 100, "b": 9}),
                                               (2, 2, {str(i): 1 for i in range(11)}), (2, 4096, {"x": 1}), (2, 8, {"x": 9})])
def test_manifest_against_brute_force(spark, arity, block, sizes):
    rng = random.Random(3)
    rows = []
    for g, n in sizes.items():
        for i in range(n):
            rows.append((g, rng.choice([None, 7, rng.randint(-50, 10**12)]), h(str(rng.random())),
                         h("c", str(i)) if rng.random() < 0.3 else None))
    rows += rows[:3]  # repeated rows
    rng.shuffle(rows)
    df = spark.createDataFrame([r + ("p", "q") for r in rows], SCHEMA).repartition(3)
    got = mm.manifest(df, arity, block).collect()
    # equal rows may differ only in which of them is the changed one; here copies are whole copies
    assert sorted(map(tuple, got), key=str) == brute(rows, arity)


def test_query_nulls_ties_long_texts_clashing_columns_and_empty_table(spark, tmp_path):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType()), T.StructField("leaf", T.StringType()),
                           T.StructField("node", T.StringType())])
    docs = [(None, None, None, None, None, "a", "b"), (1, "", "en", "s", 0, "a", "b"), (1, "", "en", "s", 0, "a", "b"),
            (2, "größe 中" * 50_000, "en", "-", 5, "a", "b"), (3, "a", None, None, None, "a", "b"),
            (4, "x\n:-", "", "3:abc", 2**63 - 1, "a", "b"), (-5, "x", "de", "s", -1, "a", "b")]
    docs += [(i, f"t{i}", "en", "s", i, None, None) for i in range(10, 60)]
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    rows = []
    for doc_id, text, lang, source, n_chars, *_ in docs:
        change = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        more = n_chars + 1 if n_chars is not None else None
        rows.append((lang, doc_id, h(*map(field, (doc_id, source, lang, n_chars, text))),
                     h(*map(field, (doc_id, source, lang, more, text))) if change else None))
    got = mm.op12_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert any(r[3] for r in rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert mm.manifest(empty).collect() == []
    only = mm.manifest(spark.createDataFrame([("g", 1, h("a"), None, "", "")], SCHEMA)).first()
    assert only.subroot == only.root == only.folded_root == h("a") and only.proof_sha256 == h("") and only.verified
    assert spark.range(1).select(mm.record(F.lit("ü"), F.lit(None), F.lit(12))).first()[0] == "2:ü-2:12"
