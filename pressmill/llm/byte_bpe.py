"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of many pre-tokens form one doubly linked list of spans, with no links
across pre-tokens. Every adjacent pair whose joined bytes are in the
vocabulary waits, by its left span's position, in the bucket of its rank. A
bitmap over the ranks, in words of 256 bits under one top word, tells by
find-first-set which bucket is next; its positions are merged from left to right.
A merge only writes the links and queues the two new pairs beside it: entries
that it makes untrue stay where they are and are skipped when they come up. If
a new pair has a lower rank than the bucket at work, the rest of the bucket waits
until that pair is done. Each pre-token therefore sees its own merges
lowest rank first, and one of n bytes costs O(n log n), which matters for
runs of thousands of bytes without a break.

The split pattern and the vocabulary file are parameters. Ids of pre-tokens, and
of whole blank-separated units, are remembered per worker in tables of bounded
size, so only what a worker has not seen yet goes through the queue.

Defined results: a null text is an empty text; an empty text has no tokens;
marks of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import prepare, read

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Pre-tokens, and blank-separated units, remembered per worker.
MEMORY = 1_000_000
#: Longer ones are forgotten after the batch they stand in.
MEMORY_CHARS = 64

#: Bits per word of the rank bitmap.
_WORD_BITS = 8
#: A blank that may not be cut before: white space or the end follows.
_LOOSE_BLANK = re.compile(r" (?:\s|$)").search
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = MEMORY):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        # under this pattern every blank with a visible character behind it begins a pre-token
        self.cuts_at_blanks = pattern == public_tokenizers.PATTERN
        self.by_id = {i: b for b, i in ranks.items()}
        self.text_of = {i: str(i) for i in self.by_id}
        self.memory = memory
        self.tokens: dict[str, tuple[int, ...]] = {}
        # keys: what follows the blank
        self.units: dict[str, tuple[int, ...]] = {}
        self.trips: dict[str, tuple[str, bytes]] = {}
        self.pairs: dict[int, int] = {}  # joined rank of two ids, -1 if there is none
        self.shift = max(ranks.values()).bit_length()
        try:
            self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        except KeyError as e:
            raise ValueError("a byte-level vocabulary has all 256 single bytes") from e
        self.byte_pairs = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        return cls(ranks, pattern)

    def _pair(self, key: int) -> int:
        joined = self.by_id[key >> self.shift] + self.by_id[key & ((1 << self.shift) - 1)]
        if len(self.pairs) >= 1_000_000:
            self.pairs.clear()
        rank = self.pairs[key] = self.ranks.get(joined, -1)
        return rank

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece (the bytes of a pre-token; not empty)."""
        out: list = [None] * len(pieces)
        parts = []
        for k, data in enumerate(pieces):
            whole = self.ranks.get(data)
            if whole is None:
                parts.append(k)
            else:
                out[k] = (whole,)
        if not parts:
            return out
        sizes = np.array([len(pieces[k]) for k in parts])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        raw = np.frombuffer(b"".join([pieces[k] for k in parts]), np.uint8).astype(np.int64)
        n = len(raw)
        waits_at = np.full(n, -1, np.int64)  # the rank by which a position waits, -1 for none
        waits_at[:-1] = self.byte_pairs[(raw[:-1] << 8) | raw[1:]]
        waits_at[starts[1:] - 1] = -1
        ids = self.single[raw].tolist()
        waits = waits_at.tolist()
        ahead_at, back_at = np.arange(1, n + 1), np.arange(-1, n - 1)
        ahead_at[starts[1:] - 1] = -1
        back_at[starts[:-1]] = -1
        ahead, back = ahead_at.tolist(), back_at.tolist()

        # the queue: buckets of positions, and a bitmap of the ranks that have one
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}
        top = 0
        queued = np.flatnonzero(waits_at >= 0)
        queued = queued[np.argsort(waits_at[queued], kind="stable")]
        ranks, first = np.unique(waits_at[queued], return_index=True)
        for r, group in zip(ranks.tolist(), np.split(queued, first[1:])):
            buckets[r] = group.tolist()
            w = r >> _WORD_BITS
            words[w] = words.get(w, 0) | (1 << (r & 255))
            top |= 1 << w
        shift, known_pair, pair = self.shift, self.pairs.get, self._pair
        while top:
            w = (top & -top).bit_length() - 1
            word = words[w]
            low = word & -word
            r = (w << _WORD_BITS) | (low.bit_length() - 1)
            word ^= low
            words[w] = word
            if not word:
                top ^= 1 << w
            bucket = buckets.pop(r)
            bucket.sort()
            for at, i in enumerate(bucket):
                if waits[i] != r:
                    continue  # stale
                j = ahead[i]
                k = ahead[j]
                h = back[i]
                ids[i] = r
                ids[j] = waits[j] = -1
                ahead[i] = k
                s = -1
                if k >= 0:
                    back[k] = i
                    key = (r << shift) | ids[k]
                    s = known_pair(key)
                    if s is None:
                        s = pair(key)
                waits[i] = lowest = s
                if s >= 0:
                    if s in buckets:
                        buckets[s].append(i)
                    else:
                        buckets[s] = [i]
                        w = s >> _WORD_BITS
                        words[w] = words.get(w, 0) | (1 << (s & 255))
                        top |= 1 << w
                if h >= 0:
                    key = (ids[h] << shift) | r
                    s = known_pair(key)
                    if s is None:
                        s = pair(key)
                    if s != waits[h]:
                        waits[h] = s
                        if s >= 0:
                            if s in buckets:
                                buckets[s].append(h)
                            else:
                                buckets[s] = [h]
                                w = s >> _WORD_BITS
                                words[w] = words.get(w, 0) | (1 << (s & 255))
                                top |= 1 << w
                            if s < lowest or lowest < 0:
                                lowest = s
                if 0 <= lowest <= r and at + 1 < len(bucket):
                    buckets.setdefault(r, []).extend(bucket[at + 1:])
                    w = r >> _WORD_BITS
                    words[w] = words.get(w, 0) | (1 << (r & 255))
                    top |= 1 << w
                    break

        left = np.array(ids)
        ends = np.cumsum(left >= 0)[starts[1:] - 1].tolist()
        left = left[left >= 0].tolist()
        begin = 0
        for k, end in zip(parts, ends):
            out[k] = tuple(left[begin:end])
            begin = end
        return out

    def _read(self, texts: list[str], known: dict) -> tuple[list, dict, list]:
        """Per text its pre-tokens up to the first blank and its units behind; the pre-tokens of the units that
        ``known`` lacks; the pre-tokens that were new. All pre-tokens have their ids in ``tokens`` then."""
        tokens, split = self.tokens, self.split
        for table in (tokens, known):
            if len(table) > self.memory:
                table.clear()
        plans, fresh = [], set()
        for t in texts:
            if self.cuts_at_blanks and not _LOOSE_BLANK(t):
                head, *rest = t.split(" ")
                plans.append((split(head), rest))
                fresh |= set(rest).difference(known)
            else:
                plans.append((split(t), ()))
        # letters alone are one pre-token with the blank before them
        cut = {u: [" " + u] if _LETTERS(u) else split(" " + u) for u in fresh}
        unseen = {p for head, _ in plans for p in head}
        unseen.update(chain.from_iterable(cut.values()))
        unseen = list(unseen.difference(tokens))
        for p, ids in zip(unseen, self.merge([p.encode("utf-8") for p in unseen])):
            tokens[p] = ids
        return plans, cut, unseen

    @staticmethod
    def _forget(table: dict, new) -> None:
        for x in new:
            if len(x) > MEMORY_CHARS:
                del table[x]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        units, flat = self.units, chain.from_iterable
        plans, cut, unseen = self._read(texts, units)
        token = self.tokens.__getitem__
        for u, pieces in cut.items():
            units[u] = token(pieces[0]) if len(pieces) == 1 else tuple(flat(map(token, pieces)))
        unit = units.__getitem__
        out = [[*flat(map(token, head)), *flat(map(unit, rest))] for head, rest in plans]
        self._forget(self.tokens, unseen)
        self._forget(units, cut)
        return out

    def round_trips(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """Per text its decimal ids joined by one blank and the bytes that its ids decode to. Both are
        made once per unit, from the unit's ids, and joined from there."""
        known, flat, decimal = self.trips, chain.from_iterable, self.text_of.__getitem__
        plans, cut, unseen = self._read(texts, known)
        token = self.tokens.__getitem__
        for u, pieces in cut.items():
            ids = token(pieces[0]) if len(pieces) == 1 else (*flat(map(token, pieces)),)
            known[u] = (" ".join(map(decimal, ids)), self.decode(ids))
        trip, out = known.__getitem__, []
        for head, rest in plans:
            ids = [*flat(map(token, head))]
            front = [(" ".join(map(decimal, ids)), self.decode(ids))] if ids else []
            shown, data = zip(*front, *map(trip, rest)) if ids or rest else ((), ())
            out.append((" ".join(shown), b"".join(data)))
        self._forget(self.tokens, unseen)
        self._forget(known, cut)
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBPE:
    """One coder per worker process and vocabulary."""
    return ByteBPE.from_file(path, pattern)


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     path: str = RANK_FILE, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids (array of token ids) per row."""
    prepare(df.sparkSession)
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = coder(path, pattern)
        for b in batches:
            ids = bpe.encode_batch([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return src.mapInArrow(run, f"doc_id {id_type}, ids array<int>")


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids",
               path: str = RANK_FILE, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, data (decoded bytes) per row; null ids decode to no bytes."""
    prepare(df.sparkSession)
    src = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    id_type = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = coder(path, pattern)
        for b in batches:
            data = [bpe.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return src.mapInArrow(run, f"doc_id {id_type}, data binary")


def token_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  path: str = RANK_FILE, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Round trip in one pass: doc_id, n_tokens, ids_sha256 (decimal ids joined
    by one space), decoded_sha256 (bytes decoded from the ids)."""
    prepare(df.sparkSession)
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bpe = coder(path, pattern)
        sha = hashlib.sha256
        for b in batches:
            sizes, left, right = [], [], []
            for ids, data in bpe.round_trips([t or "" for t in b.column(1).to_pylist()]):
                sizes.append(ids.count(" ") + 1 if ids else 0)
                left.append(sha(ids.encode()).hexdigest())
                right.append(sha(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(left, pa.string()), pa.array(right, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return src.mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_byte_bpe(spark, sf_dir) -> DataFrame:
    return token_digests(read(spark, sf_dir, "documents", "doc_id", "text"))
