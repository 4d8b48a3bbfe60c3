"""Licence scan: notice phrases and identifier tags by Aho-Corasick, licence expressions by a shunting yard.

A text is lower-cased (A-Z) and its words are the runs of digits, letters and non-ASCII characters. One
automaton runs over the words, joined by single blanks, and reports every place of every notice phrase
and of the tag words (``SPDX-License-Identifier:``, ``License:``). What follows a tag is a licence
expression, read from the original text: identifiers, ``and``, ``or``, ``with`` and parentheses, by
precedence with > and > or. It ends at the first token that cannot go on, or at the end
of the line outside parentheses.

An expression has a value beside its labels: how far the licence binds a user, from 0 (public
domain) to 1 (all rights reserved). ``and`` binds as its stricter side, ``or`` as the milder one,
``with`` (an exception) halves what it excepts from. A document's ``score`` is the strictest of its
notices and expressions, 0 where it has none.

Defined results: a null text counts as empty: no words, no labels ('' in both label columns), null places, score 0.
A method's phrase inside a longer one at the same place counts as the longer one; base phrases count always. An identifier that is not
listed is labelled ``other`` behind an SPDX tag; behind ``License:`` the whole expression is then no licence. Texts of any length
are read whole. Repeated rows and null ids are rows like any other.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import prepare, read

#: Fixed: the contract's phrases.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: How far each label binds a user.
BINDS = {
    "public-domain": 0.0, "cc0": 0.0, "unlicense": 0.0, "mit": 0.2, "bsd-2": 0.2, "bsd-3": 0.2, "isc": 0.2, "zlib": 0.2,
    "apache-2": 0.25, "cc-by": 0.3, "mpl-2": 0.5, "epl-2": 0.5, "lgpl-2.1": 0.5, "lgpl-3": 0.5, "other": 0.5, "cc-by-sa": 0.6,
    "gpl-2": 0.7, "gpl-3": 0.7, "agpl-3": 0.8, "cc-by-nd": 0.8, "cc-by-nc": 0.9, "cc-by-nc-sa": 0.9, "cc-by-nc-nd": 0.95,
    "all-rights-reserved": 1.0,
}

#: Words of common notices.
PHRASES = {
    "mit license": "mit", "the mit license": "mit", "released under mit": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache license 2": "apache-2", "licensed under apache 2": "apache-2",
    "redistribution and use in source and binary forms": "bsd-2", "neither the name of": "bsd-3",
    "bsd 2 clause": "bsd-2", "bsd 3 clause": "bsd-3", "isc license": "isc", "zlib license": "zlib",
    "mozilla public license version 2": "mpl-2", "mozilla public license 2": "mpl-2", "eclipse public license 2": "epl-2",
    "gnu general public license version 2": "gpl-2", "gnu general public license version 3": "gpl-3",
    "gnu general public license v2": "gpl-2", "gnu general public license v3": "gpl-3",
    "gnu lesser general public license version 2 1": "lgpl-2.1", "gnu lesser general public license version 3": "lgpl-3",
    "gnu affero general public license": "agpl-3", "cc0 1 0": "cc0", "public domain dedication": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "dedicated to the public domain": "public-domain", "cc by 4 0": "cc-by", "cc by 3 0": "cc-by", "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution 4 0": "cc-by", "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution noderivatives": "cc-by-nd",
    "all rights reserved": "all-rights-reserved",
}

#: Identifiers in expressions (lower case), but for the versions' ``-only``, ``-or-later`` and ``+``.
IDENTIFIERS = {
    "mit": "mit", "apache-2.0": "apache-2", "bsd-2-clause": "bsd-2", "bsd-3-clause": "bsd-3", "isc": "isc", "zlib": "zlib",
    "mpl-2.0": "mpl-2", "epl-2.0": "epl-2", "gpl-2.0": "gpl-2", "gpl-3.0": "gpl-3", "lgpl-2.1": "lgpl-2.1", "lgpl-3.0": "lgpl-3",
    "agpl-3.0": "agpl-3", "cc0-1.0": "cc0", "unlicense": "unlicense", "cc-by-4.0": "cc-by", "cc-by-3.0": "cc-by",
    "cc-by-sa-4.0": "cc-by-sa", "cc-by-sa-3.0": "cc-by-sa", "cc-by-nd-4.0": "cc-by-nd", "cc-by-nc-4.0": "cc-by-nc",
    "cc-by-nc-sa-4.0": "cc-by-nc-sa", "cc-by-nc-nd-4.0": "cc-by-nc-nd",
}

#: Tag words, and whether identifiers that are not listed make a licence.
TAGS = {"spdx license identifier": True, "license": False}

_SEPARATORS = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b >= 128 else 32
                    for b in bytes(range(256)).lower())
_RUNS = re.compile(rb" {2,}")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_AFTER_TAG = re.compile(rb"""["']?[ \t]*[:=][ \t]*["']?""")
_TOKEN = re.compile(rb"([ \t]*)((\n|\r)\s*)?(?:([()])|([a-z0-9][a-z0-9.+-]*))")
_RANK = {b"with": 3, b"and": 2, b"or": 1}


def words_of(text: bytes) -> bytes:
    """`` word word `` of a text: lower case, single blanks, one at each end; of a text without words one blank."""
    return _RUNS.sub(b" ", b" " + text.translate(_SEPARATORS) + b" ")


def label_of(identifier: bytes) -> str | None:
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier.decode().rstrip("."))
    return IDENTIFIERS.get(name)


def evaluate(text: bytes, at: int = 0) -> tuple[frozenset, float, bool] | None:
    """The expression that begins at ``at`` of a lower-cased text: its labels, its value and whether all its identifiers
    are listed; None where there is none."""
    values: list = []   # (labels, value, listed) or the name of an exception
    waiting: list[bytes] = []
    depth, operand = 0, True  # whether an operand has to come next

    def apply():
        op, right, left = waiting.pop(), values.pop(), values.pop()
        if op == b"with":
            values.append((left[0], left[1] / 2, left[2]))
        else:
            pick = max if op == b"and" else min
            values.append((left[0] | right[0], pick(left[1], right[1]), left[2] and right[2]))

    while True:
        token = _TOKEN.match(text, at)
        if not token or (token.group(2) and not depth):
            break
        mark, word = token.group(4), token.group(5)
        if operand:
            if mark == b"(" and not (waiting and waiting[-1] == b"with"):
                waiting.append(mark)
                depth += 1
            elif word and word not in _RANK:
                label = label_of(word)
                values.append((frozenset([label or "other"]), BINDS[label or "other"], label is not None))
                operand = False
            else:
                break
        elif mark == b")" and depth:
            while waiting[-1] != b"(":
                apply()
            waiting.pop()
            depth -= 1
        elif word in _RANK:
            while waiting and waiting[-1] != b"(" and _RANK[waiting[-1]] >= _RANK[word]:
                apply()
            waiting.append(word)
            operand = True
        else:
            break
        at = token.end()
    while operand and waiting:  # open parentheses at the end, and the operator before them
        operand = waiting.pop() == b"("
    while waiting:
        if waiting[-1] == b"(":
            waiting.pop()
        else:
            apply()
    return values[0] if values else None


class Scanner:
    """The automaton over base phrases, ``phrases`` and tags."""

    def __init__(self, base=None, phrases=None):
        import ahocorasick
        self.base, self.phrases = BASE if base is None else base, PHRASES if phrases is None else phrases
        self.machine = ahocorasick.Automaton()
        for phrase in {**self.base, **self.phrases, **TAGS}:
            self.machine.add_word(f" {phrase} ", phrase)
        self.machine.make_automaton()

    def scan(self, text: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base labels, labels, score."""
        words = words_of(text)
        n_words = max(0, words.count(b" ") - 1)
        hits = [(end - len(p) - 1, end, p) for end, p in self.machine.iter(words.decode("latin-1"))]
        starts = [start for start, _, p in hits if p in self.base]
        base_labels = {self.base[p] for _, _, p in hits if p in self.base}
        labels, tagged, scores = set(base_labels), [], [0.0]
        reach = tag_reach = -1  # the furthest end so far: what lies within it is part of a longer one
        for start, end, phrase in sorted(hits, key=lambda hit: (hit[0], -hit[1], hit[2])):
            if phrase in TAGS:
                if end > tag_reach:
                    tag_reach = end
                    tagged.append((start, phrase))
            elif end > reach:
                reach = end
                label = self.phrases.get(phrase) or self.base[phrase]
                labels.add(label)
                scores.append(BINDS.get(label, BINDS["other"]))
        if tagged:
            for found, value in self._expressions(text, words, tagged):
                labels |= found
                scores.append(value)

        def place(start):
            return words.count(b" ", 0, start + 1) - 1
        return (n_words, len(starts), place(min(starts)) if starts else None, place(max(starts)) if starts else None,
                ",".join(sorted(base_labels)), ",".join(sorted(labels)), max(scores))

    @staticmethod
    def _expressions(text: bytes, words: bytes, tagged):
        lower = text.lower()
        spans, seen, index, at = _WORD.finditer(lower), -1, -1, 0
        for start, phrase in tagged:  # in the order of their places
            index += words.count(b" ", at, start + 1)
            at = start + 1
            while seen < index + phrase.count(" "):  # up to the tag's last word
                span, seen = next(spans), seen + 1
            behind = _AFTER_TAG.match(lower, span.end())
            got = evaluate(lower, behind.end()) if behind else None
            if got and (got[2] or TAGS[phrase]):
                yield got[0], got[1]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=None, phrases=None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row."""
    prepare(df.sparkSession)
    src = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    columns = (("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
               ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()))

    def run(batches):
        scanner = Scanner(base, phrases)
        for b in batches:
            rows = [scanner.scan(t) for t in b.column(1).to_pylist()]
            cells = list(zip(*rows)) or [()] * len(columns)
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(c, t) for c, (_, t) in zip(cells, columns)],
                                             names=["doc_id"] + [name for name, _ in columns])

    return src.mapInArrow(run, f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, "
                               "base_labels string, labels string, score double")


def op13_license_scan(spark, sf_dir) -> DataFrame:
    return scan(read(spark, sf_dir, "documents", "doc_id", "text"))
