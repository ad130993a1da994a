"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A document is a set of five-word shingles, each weighted 1 + ln(count). Every shingle is a Poisson
process of that rate: its arrivals fall on slots of the signature, and a slot keeps the shingle
that arrives first. Two documents agree in a slot with their probability Jaccard similarity,
which falls below set Jaccard where a shingle repeats more often in one of them; so every document
has the signature of equal weights too, whose slots agree with set Jaccard. A
shingle's process ends once it is later than all slots, so that long documents cost little more
than one arrival a shingle.

Bands of slots are hashed into candidate clusters, inside which exact shingle sets are compared
in blocks of bounded size (see blocks.py). Exact copies are one node throughout.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import classes, postings_links, text_key
from .common import WORD, bounded_batches, cut, has_columns


@dataclass(frozen=True)
class NearRules:
    """Shingles, signature and verification. At set similarity 0.8 a pair misses all 32 bands of 5 slots of equal weights with probability 3e-6, whatever repeats."""

    width: int = 5
    similarity: float = 0.8
    bands: int = 32
    rows: int = 5
    #: Shingles in a block of a cluster, about; a task holds two blocks.
    block_shingles: int = 1 << 14
    seed: int = 11


_words = re.compile(WORD).findall
_GOLD = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with good avalanche (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle hashes of texts; remembers the hashes of words."""

    def __init__(self, width: int) -> None:
        self.width, self.known = width, {}

    def all(self, text: str | None) -> np.ndarray:
        """A 64-bit hash for every run of width words; one for the whole text where it has fewer; none without words."""
        words = _words(text or "")
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > 200_000:
            known.clear()
        hashes = list(map(known.get, words))
        if None in hashes:
            for w in set(words).difference(known):
                known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            hashes = list(map(known.__getitem__, words))
        codes = np.array(hashes, np.uint64)
        spans = max(1, len(codes) - self.width + 1)
        total = np.zeros(spans, np.uint64)
        for k in range(min(self.width, len(codes))):
            total = _mix(total * np.uint64(0x100000001B3) + codes[k : k + spans] + np.uint64(k))
        return total


def signatures(shingles: list[np.ndarray], weights: list[np.ndarray], slots: int, seed: int) -> np.ndarray:
    """ProbMinHash signatures (rows of winning shingle hashes) of non-empty weighted sets."""
    n = len(shingles)
    lengths = np.fromiter(map(len, shingles), np.int64, n)
    item, rate, owner = np.concatenate(shingles), np.concatenate(weights), np.repeat(np.arange(n), lengths)
    first = np.full(n * slots, np.inf)
    winner = np.zeros(n * slots, np.uint64)
    time = np.zeros(len(item))
    state = _mix(item + np.uint64(seed))
    with np.errstate(over="ignore"):
        while len(item):
            state = state + np.uint64(_GOLD)
            draw = _mix(state)
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / rate
            place = owner * slots + (_mix(draw) % np.uint64(slots)).astype(np.int64)
            np.minimum.at(first, place, time)
            won = first[place] == time
            winner[place[won]] = item[won]
            alive = time < first.reshape(n, slots).max(axis=1)[owner]
            item, rate, owner, time, state = item[alive], rate[alive], owner[alive], time[alive], state[alive]
    return winner.reshape(n, slots)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of each signature."""
    parts = signature.reshape(len(signature), bands, rows)
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_GOLD), (len(signature), bands))
    for k in range(rows):
        total = _mix(total * np.uint64(0x100000001B3) + parts[:, :, k])
    return total.view(np.int64)


def near_classes(docs: DataFrame, rules: NearRules | None = None) -> DataFrame:
    """doc_id, text_key, class_key and class_id for every row of docs.

    Needs doc_id and text. text_key: MD5 of the text. class_key: least text_key of the class.
    class_id: least doc_id of the class (null if it has none). Two texts are linked if the Jaccard
    similarity of their sets of five-word shingles is at least rules.similarity; a text of fewer
    than five words has one shingle, all of it. Classes are the connected components, so a class
    can hold two texts that are less alike. Equal texts always share a class.

    Texts without a word have no shingles and are linked to nothing; those that are equal (all
    nulls count as one text) share a class. Rows that repeat each give a row. An empty table gives
    an empty table.
    """
    has_columns(docs, "doc_id", "text")
    bounded_batches(docs)
    rules = rules or NearRules()
    slots = rules.bands * rules.rows

    @F.pandas_udf("bands array<long>, mass long")
    def marks(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(rules.width)
        for texts in parts:
            bands: list = [[]] * len(texts)
            sizes = [0] * len(texts)
            held: list[tuple[int, np.ndarray, np.ndarray]] = []

            def flush(held=held, bands=bands) -> None:
                if held:
                    hashes = band_hashes(signatures([x[1] for x in held], [x[2] for x in held], slots, rules.seed), rules.bands, rules.rows)
                    for (i, _, _), row in zip(held, hashes, strict=True):
                        bands[i] = np.union1d(bands[i], row) if len(bands[i]) else row
                    held.clear()

            mass = 0
            for i, text in enumerate(texts):
                every = shingler.all(text)
                if len(every):
                    items, counts = np.unique(every, return_counts=True)
                    sizes[i] = len(items)
                    held.append((i, items, np.ones(len(items))))
                    mass += len(items) + slots
                    if counts.max() > 1:  # else both signatures are one
                        held.append((i, items, 1.0 + np.log(counts)))
                        mass += len(items) + slots
                    if mass > 400_000:
                        flush()
                        mass = 0
            flush()
            yield pd.DataFrame({"bands": bands, "mass": sizes})

    keyed = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.col("text").alias("payload"))
    marked = cut(keyed.withColumn("m", marks("payload")).select("doc_id", "text_key", "m.bands", "m.mass"))
    similarity = Fraction(rules.similarity).limit_denominator(10_000)
    num, den = similarity.numerator, similarity.denominator

    def links():
        shingler = Shingler(rules.width)
        # common / (a + b - common) >= num / den
        return lambda texts, left: postings_links([np.unique(shingler.all(t)) for t in texts], left, lambda common, size, sizes: (den + num) * common >= num * (size + sizes))

    return classes(keyed, marked, links, rules.block_shingles)


def drop_near_copies(docs: DataFrame, rules: NearRules | None = None) -> DataFrame:
    """One row of docs for each class of near_classes: the one with the least doc_id (null ids first), then text."""
    found = near_classes(docs, rules)
    first = found.groupBy("class_key").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("first.*")
    first = first.select(F.col("doc_id").alias("first_id"), F.col("text_key").alias("first_key"))
    keyed = docs.withColumn("near_key", text_key(F.col("text")))
    kept = keyed.join(first, (F.col("near_key") == F.col("first_key")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    # Rows equal in doc_id and text: one of them stays.
    if not found.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "near_key"])
    return kept.select(*docs.columns)
