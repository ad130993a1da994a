"""URL verdicts: prefix rules first, then exact membership in a domain list by a Bloom filter cascade.

Level 0 of the cascade encodes the listed keys. Level 1 encodes the corpus's keys that level 0
wrongly holds, level 2 the listed keys that level 1 wrongly holds, and so on until a level has
no false positive. The levels are built against all distinct keys of the corpus, so that for each
of them the answer is exact. They reach the rows as scalar subqueries, arrays of 64-bit words
that an expression reads; no row of the corpus is joined or shuffled for its verdict.

Only DataFrame functions are used.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, has_columns

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text before the first ://, host, path.
URL_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
#: Keys of one level that are encoded in one array: 10 bits each, so an array has 5 MB at most.
MOST_KEYS = 4_000_000


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, for paths that start with path ('' fits every path)."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ://."""
    part = lambda k: F.coalesce(F.regexp_extract(url, URL_PARTS, k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def first_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is tested first, so it is wrapped last
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def domains(host: Column, labels: int) -> list[Column]:
    """The host's last 1, 2, ... labels: itself, if it is no longer, and its parent domains."""
    return [F.substring_index(host, ".", -k) for k in range(1, labels + 1)]


@dataclass(frozen=True)
class Level:
    """A Bloom filter as a one-row frame with the array words."""

    words: DataFrame
    bits: int
    hashes: int
    seed: int

    def holds(self, key: Column) -> Column:
        found = F.lit(True)
        words = self.words.select("words").scalar()
        for p in _positions(key, self.bits, self.hashes, self.seed):
            found = found & (_shift("shiftright", F.element_at(words, (F.shiftright(p, 6) + 1).cast("int")), p).bitwiseAND(F.lit(1)) == 1)
        return found


def _shift(how: str, word: Column, position: Column) -> Column:
    """The word shifted by the position's place in a word of 64 bits."""
    return F.call_function(how, word, F.pmod(position, F.lit(64)).cast("int"))


def _positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    one = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(bits))
    step = F.pmod(F.xxhash64(F.lit(seed + 1), key), F.lit(bits - 1)) + 1
    return [F.pmod(one + k * step, F.lit(bits)) for k in range(hashes)]


def bloom(keys: DataFrame, n: int, seed: int, bits_per_key: int = 10, hashes: int = 5) -> Level:
    """A filter of the frame's column key; n is the number of its rows."""
    size = max(64, 64 * math.ceil(bits_per_key * n / 64))
    marks = keys.select(F.explode(F.array(*_positions(F.col("key"), size, hashes, seed))).alias("p"))
    words = marks.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(_shift("shiftleft", F.lit(1).cast("long"), F.col("p"))).alias("bits"))
    every = keys.sparkSession.range(size // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    # size / 64 rows, at most MOST_KEYS * bits_per_key / 64, become one array.
    dense = words.union(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    packed = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))
    return Level(cut(packed), size, hashes, seed)


@dataclass(frozen=True)
class Cascade:
    """Levels of one part of the key space each; parts split a list that is too long for one array."""

    parts: Sequence[Sequence[Level]]

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        answers = [self._within(levels, key) for levels in self.parts]
        if len(answers) == 1:
            return answers[0]
        part = F.pmod(F.xxhash64(F.lit(-1), key), F.lit(len(answers)))
        out = F.lit(False)
        for k, answer in enumerate(answers):
            out = F.when(part == k, answer).otherwise(out)
        return out

    @staticmethod
    def _within(levels: Sequence[Level], key: Column) -> Column:
        # What passes the first k levels and fails the next is listed iff k is odd.
        out = F.lit(len(levels) % 2 == 1)
        for k in reversed(range(len(levels))):
            out = F.when(~levels[k].holds(key), F.lit(k % 2 == 1)).otherwise(out)
        return out


def build_cascade(listed: DataFrame, universe: DataFrame, *, most_keys: int = MOST_KEYS, bits_per_key: int = 10, seed: int = 100) -> Cascade:
    """A cascade that is exact on universe.

    Both frames have a column key; repeats and nulls in them do not count. Listed keys outside the
    universe are encoded too. A list longer than most_keys is dealt by hash into parts, each with
    its own levels, so that an array stays within its bound.
    """
    listed = cut(listed.select("key").where("key is not null").distinct())
    others = cut(universe.select("key").where("key is not null").distinct().join(listed, "key", "left_anti"))
    n = listed.count()
    parts = max(1, math.ceil(n / most_keys))
    out = []
    for part in range(parts):
        own = F.pmod(F.xxhash64(F.lit(-1), "key"), F.lit(parts)) == part
        now, against, levels = listed.where(own), others.where(own), []
        while (count := now.count()) > 0:
            levels.append(bloom(now, count, seed + 2 * len(levels), bits_per_key))
            now, against = cut(against.where(levels[-1].holds(F.col("key")))), now
        out.append(levels)
    return Cascade(out)


def judge_urls(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame) -> DataFrame:
    """All rows and columns of pages, with url_host, url_path, url_rule and url_verdict (allow or block).

    Needs url. The longest fitting rule decides; without one, a page is blocked iff its host or a
    parent domain of it is in listed (column key). A null URL, or one without ://, has empty host
    and path; the empty host is a key as any other. Rows that repeat get the same verdict; an
    empty table gives an empty table; an empty list blocks nothing by itself. Columns of the
    added names are replaced.
    """
    has_columns(pages, "url")
    own = ["url_host", "url_path", "url_rule", "url_verdict"]
    host, path = host_and_path(F.col("url"))
    split = pages.withColumns({"url_host": host, "url_path": path})
    # Longer keys than the list has cannot be members, so a host gives a bounded number of keys.
    labels = listed.agg(F.max(F.size(F.split("key", "\\.")))).first()[0] or 1
    universe = split.select("url_host").distinct().select(F.explode(F.array_distinct(F.array(*domains(F.col("url_host"), labels)))).alias("key"))
    cascade = build_cascade(listed, universe)
    name, verdict = first_rule(F.col("url_host"), F.col("url_path"), rules)
    member = functools.reduce(operator.or_, map(cascade.contains, domains(F.col("url_host"), labels)))
    return split.withColumns({
        "url_rule": name,
        "url_verdict": F.coalesce(verdict, F.when(member, F.lit("block")).otherwise(F.lit("allow"))),
    }).select(*[c for c in pages.columns if c not in own], *own)
