"""Finding license notices: MinHash bands retrieve templates for text windows, exact containment verifies them.

Words are lower-cased without punctuation, and shingles are five words (all of a shorter
template). Templates of like length (between powers of two) share windows: windows begin every
stride, a quarter of the longest template at most, and are so long that an occurrence lies wholly
in one. Every window of a text has a least shingle hash for each hash function, and every template
too; a band is one such hash, and a template is retrieved for a window that agrees with it in a
band. A window that holds 0.8 of a template is like it at 0.28 or more, so that all 32 bands miss
it with a chance of 3e-5 at most. What is retrieved is compared exactly: the share of the
template's shingles that stand in the window, within the template's length. One pass reads each
text once, and nothing is shuffled; templates travel with the function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bounded_batches, has_columns
from .license_texts import TEMPLATES

_words = re.compile(WORD).findall
_STRIP = ".,;:!?()[]{}\"'“”‘’«»"
_GOLD = 0x9E3779B97F4A7C15


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values stand in the sorted array of."""
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


#: Shingles whose least hashes are held at a time, so that memory does not grow with a text; a multiple of every stride.
SEGMENT = 1 << 14
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Group(NamedTuple):
    """Templates of like length: windows begin every stride shingles and are so many strides long; (number, shingles, words) of each template, and its least hashes."""

    stride: int
    strides: int
    templates: list[tuple[int, np.ndarray, int]]
    least: np.ndarray


def _previous(values: np.ndarray) -> np.ndarray:
    """Where each value stood before, -1 for its first place."""
    order = np.argsort(values, kind="stable")
    out = np.full(len(values), -1)
    again = values[order[1:]] == values[order[:-1]]
    out[order[1:][again]] = order[:-1][again]
    return out


@dataclass(frozen=True)
class ScanRules:
    """Width of shingles, hash functions (bands of one row), share of a template's shingles that counts as a match."""

    width: int = 5
    hashes: int = 32
    containment: float = 0.8
    seed: int = 5


class WindowScanner:
    """Templates by shingle width and length class, with their least hashes."""

    def __init__(self, templates: Sequence[tuple[str, str]], rules: ScanRules) -> None:
        self.rules, self.known = rules, {}
        one = np.arange(1, rules.hashes + 1, dtype=np.uint64) * np.uint64(_GOLD) + np.uint64(rules.seed)
        one = (one ^ (one >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.factors = (one ^ (one >> np.uint64(32))) | np.uint64(1)
        members: dict[tuple[int, int], list[tuple[int, np.ndarray, int]]] = {}
        for t, (_, text) in enumerate(templates):
            codes = self.codes(text)[0]
            if not len(codes):
                raise ValueError(f"template {t} has no words")
            width = min(rules.width, len(codes))
            members.setdefault((width, len(codes).bit_length()), []).append((t, np.unique(self.shingles(codes, width)), len(codes)))
        #: Groups by shingle width.
        self.groups: dict[int, list[Group]] = {}
        for (width, _), own in sorted(members.items(), key=lambda g: g[0]):
            longest = max(n for *_, n in own) - width + 1
            stride = 1 << max(0, (longest // 4).bit_length() - 1)
            least = np.stack([(s[:, None] * self.factors).min(axis=0) for _, s, _ in own])
            self.groups.setdefault(width, []).append(Group(stride, -(-(longest + stride - 1) // stride), own, least))

    def codes(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the plain words, and the places of these among all words of the text."""
        words, known = _words(text or ""), self.known
        if len(known) > 200_000:
            known.clear()
        hashes = list(map(known.get, words))
        if None in hashes:
            for w in set(words).difference(known):
                plain = w.strip(_STRIP).lower()
                known[w] = (xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass")) or 1) if plain else 0
            hashes = list(map(known.__getitem__, words))
        codes = np.array(hashes, np.uint64)
        places = np.flatnonzero(codes)
        return codes[places], places

    def shingles(self, codes: np.ndarray, width: int) -> np.ndarray:
        spans = len(codes) - width + 1
        if spans <= 0:
            return np.empty(0, np.uint64)
        total = np.zeros(spans, np.uint64)
        for k in range(width):
            total = (total ^ (total >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + codes[k : k + spans]
        total = (total ^ (total >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return total ^ (total >> np.uint64(27))

    def _retrieved(self, every: np.ndarray, valid: np.ndarray, groups: list[Group]) -> Iterator[tuple[Group, int, int]]:
        """(group, number of a template in it, first shingle of the window) for every window that agrees with the template in a band, by template and window.

        Least hashes of blocks are taken once for all groups; a window is a run of blocks.
        """
        block, widest = min(g.stride for g in groups), max(g.stride for g in groups)
        reach = max(g.stride * g.strides for g in groups)
        found: dict[tuple[int, int], list[int]] = {}
        for lo in range(0, len(every), SEGMENT):
            part = every[lo : lo + SEGMENT + reach]
            apart = np.flatnonzero(~valid[lo : lo + SEGMENT + reach])
            edges = np.arange(0, len(part), block)
            # Beyond the end there is nothing, up to a multiple of the widest stride.
            least = np.full((len(self.factors), -(-(len(part) + reach) // widest) * (widest // block)), _NONE)
            for k, factor in enumerate(self.factors):
                hashed = part * factor
                hashed[apart] = _NONE
                least[k, : len(edges)] = hashed if block == 1 else np.minimum.reduceat(hashed, edges)
            stride = block
            for g, group in enumerate(groups):
                while stride < group.stride:
                    least, stride = np.minimum(least[:, ::2], least[:, 1::2]), stride * 2
                n = min(-(-len(part) // stride), SEGMENT // stride)
                window = least[:, :n].copy()
                for k in range(1, group.strides):
                    np.minimum(window, least[:, k : k + n], out=window)
                for t, own in enumerate(group.least):
                    hits = np.flatnonzero(window == own[:, None])
                    if len(hits):
                        found.setdefault((g, t), []).extend((np.unique(hits % n) * stride + lo).tolist())
        for (g, t), starts in found.items():
            for a in starts:
                yield groups[g], t, a

    def _layout(self, words: list[tuple[np.ndarray, np.ndarray]], width: int, groups: list[Group]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingles of all texts end to end, which of them lie in a text, and where each text begins.

        Texts begin at a multiple of the widest stride and no window reaches from one into the
        next, so that each is searched as if it were alone.
        """
        gap, step = max(g.stride * g.strides for g in groups), max(g.stride for g in groups)
        starts, at = [], 0
        for codes, _ in words:
            starts.append(at)
            at = -(-(at + len(codes) + gap) // step) * step
        whole = np.zeros(at, np.uint64)
        valid = np.zeros(at, bool)
        for start, (codes, _) in zip(starts, words, strict=True):
            whole[start : start + len(codes)] = codes
            valid[start : start + max(0, len(codes) - width + 1)] = True
        return self.shingles(whole, width), valid[: max(0, at - width + 1)], np.array(starts, np.int64)

    def scan(self, texts: Sequence[str | None]) -> list[list[tuple[int, int, int, float]]]:
        """(template, first word, words, containment) of every match in each text; matches of a template do not overlap."""
        words = [self.codes(t) for t in texts]
        found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        for width, groups in self.groups.items():
            every, valid, starts = self._layout(words, width, groups)
            last: dict[int, int] = {}
            for group, k, a in self._retrieved(every, valid, groups):
                t, own, n = group.templates[k]
                d = int(np.searchsorted(starts, a, side="right")) - 1
                start, (codes, places) = int(starts[d]), words[d]
                lo, hi = max(a, last.get(t, -1) + 1), min(a + group.stride * group.strides, start + len(codes) - width + 1)
                inside = np.flatnonzero(_member(every[lo:hi], own)) + lo if lo < hi else ()
                if not len(inside):
                    continue
                # The stretch of the template's length that holds most of its shingles, repeats not counted.
                after = np.searchsorted(inside, inside + n - width, side="right")
                rich = np.flatnonzero(after - np.arange(len(inside)) >= self.rules.containment * len(own))
                if not len(rich):
                    continue
                before = _previous(every[inside])
                distinct = [int((before[i : after[i]] < i).sum()) for i in rich]
                best = int(np.argmax(distinct))
                stretch = inside[rich[best] : after[rich[best]]]
                share = distinct[best] / len(own)
                if share >= self.rules.containment:
                    first, end = int(stretch[0]) - start, int(stretch[-1]) + width - 1 - start
                    found[d].append((t, int(places[first]), int(places[end] - places[first]) + 1, share))
                    last[t] = end + start
        return [sorted(x, key=lambda m: (m[1], m[0])) for x in found]


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, rules: ScanRules | None = None) -> DataFrame:
    """All rows and columns of docs with license_hits, an array of (template, license, first_word, n_words, containment).

    Needs text. A hit is a stretch of words that holds at least rules.containment of a template's
    shingles within the template's length; of overlapping hits of one template the first counts.
    Stretches that lie across two windows, both of which hold it wholly, are found once.

    Null and empty texts have no hits. Rows that repeat get equal hits. An existing column of the
    name is replaced.
    """
    has_columns(docs, "text")
    bounded_batches(docs)
    rules = rules or ScanRules()

    @F.pandas_udf("array<struct<template int, license string, first_word long, n_words long, containment double>>")
    def hits(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = WindowScanner(templates, rules)
        for texts in parts:
            yield pd.Series([[{"template": t, "license": templates[t][0], "first_word": a, "n_words": n, "containment": c} for t, a, n, c in x] for x in scanner.scan(list(texts))], dtype=object)

    return docs.withColumn("license_hits", hits(F.col("text")))
