"""Corpus pipeline: quality, language, exact copies, near copies, packing.

``STAGES`` lists (name, function) in order; a function takes (spark, docs, sf_dir).
All but the last return ``docs`` without the rows that they drop, columns
unchanged; the last returns the pieces of packed sequences. ``run`` writes each
stage's result as Parquet into the shared folder and reads it again as the next
one's input, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pressmill.llm import exact_dedup, language_id, near_dedup, packing, quality  # noqa: E402
from pressmill.llm.common import prepare, read  # noqa: E402
from pressmill.session import checkpoint_dir  # noqa: E402


def good_quality(spark, docs, sf_dir):
    """Drops documents that the ordinal classifier, fitted on the rated ones, grades low."""
    prepare(spark)
    model = quality.train(docs, quality.graded(read(spark, sf_dir, "labels")))
    return quality.keep_good(docs, model)


def known_language(spark, docs, sf_dir):
    """Drops documents whose language the model, learned from their tags, doesn't know."""
    prepare(spark)
    return language_id.keep_known(docs, language_id.train(language_id.learning_rows(docs)))


def without_copies(spark, docs, sf_dir):
    """Of documents equal but for white space the longest stays."""
    prepare(spark)
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark, docs, sf_dir):
    """Of each group linked by a similarity of 0.8 on five-word shingles one stays."""
    prepare(spark)
    return near_dedup.drop_near_copies(docs)


def packed(spark, docs, sf_dir):
    """Pieces of token sequences."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("packing", packed),
]

#: The classifiers have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
