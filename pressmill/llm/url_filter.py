"""URL filter by a bit-parallel wildcard automaton.

All glob rules (``*`` any run, ``?`` any one character) are packed side by side
into the bits of a few 64-bit words. A bit stands for a rule's state after so many
of its characters; one step over a character c is, for every rule at once,
``D = ((D << 1) & B[c]) | (D & S)``, where B[c] has the states that c leads to and
S the states on which a ``*`` stands. The words of a batch of URLs are one
numpy array, and the URLs go through the automaton side by side, longest first,
so that a step touches only those that still have a character. Whatever the
number of rules, a URL costs one step per character.

A URL's canonical form is ``.host#path``: the host is what follows the first
``://`` up to ``/ ? #``, with A-Z lower-cased, the path what follows up to ``? #``.
``#`` can stand in neither, so a rule's host part cannot match inside a path.

Defined results: a null URL, or one without ``://``, has empty host and path; no
rule with a host fits it and the default verdict holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import prepare, read

#: (verdict, host and path prefix): the host and all its subdomains.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Where no rule fits: (verdict, glob over the canonical form).
GLOBS = (("block", "*.spam-farm.*#*"), ("block", "*.cheap-pills.*#*"), ("block", "*#*/wp-login.php*"))
DEFAULT = "allow"


class Automaton:
    """All patterns at once; bit 0 of each pattern's run is its start state."""

    def __init__(self, patterns: list[str]):
        self.count = len(patterns)
        runs = []  # per pattern: literal characters, states with a self-loop
        for p in patterns:
            chars, loops = [], set()
            for c in p:
                if c == "*":
                    loops.add(len(chars))
                else:
                    chars.append(c)
            runs.append((chars, loops))
        bits = sum(len(c) + 1 for c, _ in runs)
        self.words = max(1, -(-bits // 64))
        self.alphabet = np.array(sorted({ord(c) for chars, _ in runs for c in chars if c != "?"}), np.uint32)
        # row 0 is any character that no rule names
        self.table = np.zeros((len(self.alphabet) + 1, self.words), np.uint64)
        self.loops = np.zeros(self.words, np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.final: list[tuple[int, int]] = []
        at = 0
        for chars, loops in runs:
            self._set(self.start, at)
            for k in loops:
                self._set(self.loops, at + k)
            for k, c in enumerate(chars):
                if c == "?":
                    for row in self.table:
                        self._set(row, at + k + 1)
                else:
                    self._set(self.table[1 + int(np.searchsorted(self.alphabet, ord(c)))], at + k + 1)
            end = at + len(chars)
            self.final.append((end // 64, end % 64))
            at = end + 1

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    def matches(self, texts: list[str]) -> np.ndarray:
        """Boolean array (texts x patterns): whether the whole text matches."""
        n = len(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        if len(self.alphabet):
            place = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
            symbol = np.where(self.alphabet[place] == points, place + 1, 0)
        else:
            symbol = np.zeros(len(points), np.int64)
        begin = (np.cumsum(sizes) - sizes)[order]
        falling = -sizes[order]
        state = np.tile(self.start, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        for step in range(int(sizes.max()) if n else 0):
            live = int(np.searchsorted(falling, -step, side="left"))  # longer than step
            d = state[:live]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            moved &= self.table[symbol[begin[:live] + step]]
            state[:live] = moved | (d & self.loops)
        out = np.zeros((n, self.count), bool)
        for k, (word, bit) in enumerate(self.final):
            out[order, k] = (state[:, word] >> np.uint64(bit)) & one == one
        return out


def rule_glob(rule: str) -> str:
    """The glob of a ``host/path`` rule over the canonical form."""
    host, slash, path = rule.partition("/")
    return f"*.{host}#{slash}{path}*"


def canonical(df: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path per row."""
    src = df.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("_url"))
    rest = F.when(F.instr("_url", "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    src = src.select("page_id", rest.alias("_rest"))
    host = F.regexp_extract("_rest", r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract("_rest", r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return src.select("page_id", F.translate(host, upper, lower).alias("host"), path.alias("path"))


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, globs=GLOBS,
          default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule (the longest rule that fits, or null), verdict,
    glob_rule (the glob that decided where no rule fits, or null)."""
    prepare(df.sparkSession)
    src = canonical(df, id_col, url_col)
    id_type = src.schema["page_id"].dataType.simpleString()
    names = [r for _, r in rules] + [g for _, g in globs]
    verdicts = [v for v, _ in rules] + [v for v, _ in globs]
    # rules by length, then globs in their order; what comes first decides
    rank = sorted(range(len(rules)), key=lambda k: (-len(rules[k][1]), rules[k][1])) + list(range(len(rules), len(names)))

    def run(batches):
        machine = Automaton([rule_glob(r) for _, r in rules] + [g for _, g in globs])
        for b in batches:
            texts = [f".{h}#{p}" if h or p else "" for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            hit = machine.matches(texts)[:, rank] if names else np.zeros((len(texts), 0), bool)
            first = np.where(hit.any(axis=1), hit.argmax(axis=1), -1) if names else np.full(len(texts), -1)
            which = [rank[f] if f >= 0 else -1 for f in first.tolist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2),
                 pa.array([names[k] if 0 <= k < len(rules) else None for k in which], pa.string()),
                 pa.array([verdicts[k] if k >= 0 else default for k in which], pa.string()),
                 pa.array([names[k] if k >= len(rules) else None for k in which], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict", "glob_rule"])

    return src.mapInArrow(run, f"page_id {id_type}, host string, path string, rule string, verdict string, glob_rule string")


def op6_url_filter(spark, sf_dir) -> DataFrame:
    return judge(read(spark, sf_dir, "pages", "page_id", "url"))


OP6_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
r AS (
  SELECT page_id, host, path,
         CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule,
         CASE WHEN ('.' || host) LIKE '%.spam-farm.%' THEN '*.spam-farm.*#*'
              WHEN ('.' || host) LIKE '%.cheap-pills.%' THEN '*.cheap-pills.*#*'
              WHEN path LIKE '%/wp-login.php%' THEN '*#*/wp-login.php*' END AS by_glob
  FROM h)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN by_glob IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NULL THEN by_glob END AS glob_rule
FROM r
"""
