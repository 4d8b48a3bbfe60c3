import random
import re

import pytest
from pyspark.sql import types as T

from pressmill.llm import license_scan as ls

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def places(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]


def brute_notices(words):
    """(first, last, label) of every phrase that does not lie within a longer one."""
    found = [(i, i + len(p.split()), label) for p, label in {**ls.BASE, **ls.PHRASES}.items() for i in places(words, p)]
    return [f for f in found if not any((g[0] <= f[0] and f[1] <= g[1] and g[:2] != f[:2]) for g in found)]


def descend(tokens):
    """Recursive evaluation of a whole expression: (labels, value)."""
    def alone():
        if tokens[0] == "(":
            tokens.pop(0)
            got = either()
            assert tokens.pop(0) == ")"
            return got
        label = ls.label_of(tokens.pop(0).lower().encode()) or "other"
        return {label}, ls.BINDS[label]

    def excepted():
        labels, value = alone()
        while tokens[:1] == ["WITH"]:
            del tokens[:2]
            value /= 2
        return labels, value

    def both():
        labels, value = excepted()
        while tokens[:1] == ["AND"]:
            tokens.pop(0)
            more, v = excepted()
            labels, value = labels | more, max(value, v)
        return labels, value

    def either():
        labels, value = both()
        while tokens[:1] == ["OR"]:
            tokens.pop(0)
            more, v = both()
            labels, value = labels | more, min(value, v)
        return labels, value
    return either()


def grow(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return [rng.choice(["MIT", "Apache-2.0", "GPL-3.0-only", "GPL-2.0+", "CC0-1.0", "LicenseRef-x", "BSD-3-Clause"])]
    kind = rng.random()
    if kind < 0.2:
        return ["(", *grow(rng, depth - 1), ")"]
    if kind < 0.35:
        return [rng.choice(["GPL-2.0-only", "Apache-2.0"]), "WITH", "Some-exception"]
    return [*grow(rng, depth - 1), rng.choice(["AND", "OR"]), *grow(rng, depth - 1)]


def test_shunting_yard_against_recursive_descent():
    rng = random.Random(4)
    for _ in range(500):
        tokens = grow(rng, 5)
        text = " ".join(tokens).replace("( ", "(").replace(" )", ")")
        labels, value, listed = ls.evaluate(text.lower().encode())
        assert (set(labels), value) == descend(tokens[:]), text
        assert listed == ("LicenseRef-x" not in tokens)


@pytest.mark.parametrize("text,labels,value", [
    ("mit or", {"mit"}, 0.2), ("(mit or (", {"mit"}, 0.2), ("mit and (gpl-3.0", {"mit", "gpl-3"}, 0.7), ("mit.", {"mit"}, 0.2),
    ("mit apache-2.0", {"mit"}, 0.2), ("mit)", {"mit"}, 0.2), ("mit\nor gpl-2.0", {"mit"}, 0.2), ("(mit\n  or gpl-2.0)", {"mit", "gpl-2"}, 0.2),
    ("gpl-2.0-or-later with classpath-exception-2.0 and mit", {"gpl-2", "mit"}, 0.35), ("mit with", {"mit"}, 0.2),
    ("mit with (x)", {"mit"}, 0.2), ("((((mit))))", {"mit"}, 0.2), ("(" * 50_000 + "mit" + ")" * 50_000, {"mit"}, 0.2),
    ("mit or gpl-3.0 and cc0-1.0", {"mit", "gpl-3", "cc0"}, 0.2), ("(mit or gpl-3.0) and agpl-3.0", {"mit", "gpl-3", "agpl-3"}, 0.8)])
def test_expressions(text, labels, value):
    assert ls.evaluate(text.encode())[:2] == (labels, value)


@pytest.mark.parametrize("text", ["", "(", ")", "and mit", "\nmit", "()", "((", "é"])
def test_no_expression(text):
    assert ls.evaluate(text.encode()) is None


TEXTS = [
    None, "", " \n", "Released under the MIT License.", "UNDER-THE_mit/license under the mit license under the MIT licensed",
    "Licensed under the Apache License, Version 2.0. CC BY-NC 4.0; cc by nc", "under the mit", "xunder the mit license",
    "under the mité license", "cc by nc sa", "CC BY-NC-SA 4.0 and CC-BY 4.0", "under the mit under the mit license",
    "the GNU General Public License, version 3.", "the license: which was given", "My License: MIT", '"license": "Apache-2.0"',
    "license = (MIT OR GPL-3.0-only)", "License: MIT and more", "license mit", "// SPDX-License-Identifier: GPL-2.0-only WITH x\nfoo",
    "SPDX-License-Identifier: LicenseRef-own AND (MIT\n OR CC0-1.0)", "license spdx license identifier: MIT\nlicense: isc",
    "SPDX-License-Identifier:", "SPDX License Identifier MIT", "a" * 200_000 + " under the mit license", "中文 under the mit license 中",
    "word " * 100_000 + "cc by nc", "All rights reserved."]


def brute(text):
    words = words_of(text)
    base = sorted(i for p in ls.BASE for i in places(words, p))
    labels = {label for p, label in ls.BASE.items() if places(words, p)}
    return (len(words), len(base), base[0] if base else None, base[-1] if base else None, ",".join(sorted(labels)))


def test_base_columns_notices_and_texts(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("labels", T.StringType()), T.StructField("score", T.StringType())])
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], None, None)] * 2
    df = spark.createDataFrame(rows, schema)
    got = ls.scan(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[r.doc_id] if r.doc_id is not None else TEXTS[3]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text), text
        if "license" not in words_of(text) or not re.search(r"(?i)license\W*[:=]|identifier", text):
            notices = brute_notices(words_of(text))
            assert set(filter(None, r.labels.split(","))) == {n[2] for n in notices} | set(filter(None, r.base_labels.split(","))), text
            assert r.score == max([ls.BINDS[n[2]] for n in notices], default=0.0)
    of = {TEXTS[r.doc_id]: (r.labels, r.score) for r in got if r.doc_id is not None}
    assert of["My License: MIT"] == ("mit", 0.2)
    assert of['"license": "Apache-2.0"'] == ("apache-2", 0.25)
    assert of["license = (MIT OR GPL-3.0-only)"] == ("gpl-3,mit", 0.2)
    assert of["the license: which was given"] == of["License: MIT and more"] == of["license mit"] == ("", 0.0)
    assert of["// SPDX-License-Identifier: GPL-2.0-only WITH x\nfoo"] == ("gpl-2", 0.35)
    assert of["SPDX-License-Identifier: LicenseRef-own AND (MIT\n OR CC0-1.0)"] == ("cc0,mit,other", 0.5)
    assert of["license spdx license identifier: MIT\nlicense: isc"] == ("isc,mit", 0.2)
    assert of["SPDX-License-Identifier:"] == of["SPDX License Identifier MIT"] == ("", 0.0)
    assert ls.scan(df.limit(0)).collect() == []


def test_query_against_brute_force_and_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = ls.op13_license_scan(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = words_of(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.labels.split(","))) == {n[2] for n in brute_notices(words)}
        assert (r.score > 0) == bool(r.labels)
    assert {"mit", "gpl-3"} <= {x for r in rows for x in r.labels.split(",")}
