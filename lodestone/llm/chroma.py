"""Chroma fingerprints of recordings, and their alignment.

A recording is a row of pitch-class frames (12 energies each). Filters compare two areas of a
patch of frames through an integral image, so each costs a few look-ups however large it is; 16
filters of two bits are packed into one integer per frame position. Two recordings are aligned by
a histogram of the offsets between equal integers; at the best offset, the share of equal integers
and of differing bits decide.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import classes, postings_links, text_key
from .common import bounded_batches, cut, has_columns
from .probminhash import band_hashes, signatures


@dataclass(frozen=True)
class ChromaRules:
    #: Frames of a filter's patch.
    span: int = 8
    #: Quantiser steps on both sides of 0, for log ratios of areas.
    step: float = 0.35
    #: Equal integers at the best offset, as a share of the longer recording.
    hits: float = 0.6
    #: Differing bits at the best offset, as a share.
    errors: float = 0.15
    #: Recordings that match share hits / (2 - hits) = 0.43 of their items (see items) at least; a pair misses all bands with probability 9.5e-6.
    bands: int = 57
    rows: int = 2
    #: Share of slots in which two documents of a bucket must agree: 5 standard deviations under 0.43.
    agreement: float = 0.2
    #: Integers in a block of a candidate cluster, about.
    block_codes: int = 1 << 14
    seed: int = 23

    def least_share(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """5 standard deviations under the share of items that recordings of so many integers have in common at least if they match; infinite if they cannot."""
        ratio = np.minimum(one, two) / np.maximum(np.maximum(one, two), 1)
        common = self.hits / (1 + np.maximum(ratio, self.hits) - self.hits)
        return np.where(ratio < self.hits - 1e-9, np.inf, common - 5 * np.sqrt(common * (1 - common) / (self.bands * self.rows)))


def pcm_frames(samples: np.ndarray, rate: int, size: int = 4096, hop: int = 1365, low: float = 55.0, high: float = 3520.0) -> np.ndarray:
    """Pitch-class frames of mono samples: spectra of overlapping windows, folded into the 12 classes from A on."""
    if len(samples) < size:
        return np.empty((0, 12))
    at = np.arange(0, len(samples) - size + 1, hop)
    window = np.hanning(size)
    freq = np.fft.rfftfreq(size, 1.0 / rate)
    used = np.flatnonzero((freq >= low) & (freq <= high))
    pitch = np.round(12 * np.log2(freq[used] / 440.0)).astype(int) % 12
    out = np.zeros((len(at), 12))
    for lo in range(0, len(at), 256):
        part = np.stack([samples[a : a + size] for a in at[lo : lo + 256]]) * window
        power = np.abs(np.fft.rfft(part, axis=1))[:, used] ** 2
        for p in range(12):
            out[lo : lo + 256, p] = power[:, pitch == p].sum(axis=1)
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-9)


def wav_samples(data: bytes | None, rate: int = 11_025) -> tuple[np.ndarray, int]:
    """Mono samples and their rate of a WAV file of whole numbers; other bytes are taken as 16-bit samples at the given rate.

    A file whose header is broken off or of another coding gives no samples.
    """
    data = bytes(data or b"")
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(float), rate
    at, channels, width, coding, body = 12, 0, 0, 0, b""
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        part = data[at + 8 : at + 8 + size]
        if name == b"fmt " and len(part) >= 16:
            coding, channels = int.from_bytes(part[:2], "little"), int.from_bytes(part[2:4], "little")
            rate, width = int.from_bytes(part[4:8], "little"), int.from_bytes(part[14:16], "little") // 8
        elif name == b"data":
            body = part
        at += 8 + size + size % 2
    if coding not in (1, 0xFFFE) or not channels or width not in (1, 2, 3, 4) or not rate:
        return np.empty(0), rate or 1
    frame = channels * width
    raw = np.frombuffer(body[: len(body) // frame * frame], np.uint8).reshape(-1, channels, width)
    if width == 1:
        values = raw[:, :, 0].astype(float) - 128
    else:
        padded = np.zeros((*raw.shape[:2], 4), np.uint8)
        padded[:, :, 4 - width :] = raw
        values = np.ascontiguousarray(padded).view("<i4")[:, :, 0] / 2.0 ** (8 * (4 - width))
    return values.mean(axis=1), rate


def audio_frames(data: bytes | None, rate: int = 11_025) -> np.ndarray:
    """Pitch-class frames of a WAV file or of raw samples (see wav_samples), three a fold of about 0.37 seconds."""
    samples, rate = wav_samples(data, rate)
    size = max(256, 1 << round(math.log2(max(1, rate) * 0.3715)))
    return pcm_frames(samples, rate, size, size // 3)


def word_frames(text: str | None) -> np.ndarray:
    """One frame for each word, in which every UTF-8 byte sounds the class that it leaves modulo 12."""
    body = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    inside = ~((body == 32) | ((body >= 9) & (body <= 13)))
    begins = inside & ~np.concatenate(([False], inside[:-1]))
    n = int(begins.sum())
    if not n:
        return np.empty((0, 12))
    word = np.cumsum(begins)[inside] - 1
    return np.bincount(word * 12 + body[inside] % 12, minlength=n * 12).reshape(n, 12).astype(float)


def filters(span: int) -> list[tuple[int, int, int, int]]:
    """16 of (kind, first pitch, pitches, frames): kinds in turn, bands and widths that vary by fixed strides."""
    return [(k % 3, (5 * k) % 9, (2, 4)[k // 3 % 2], max(2, span - 2 * (k % 4))) for k in range(16)]


#: Positions whose filters are computed at a time.
POSITIONS = 1 << 14
#: log1p of the whole numbers that areas of word_frames take as a rule.
LOGS = np.log1p(np.arange(4096.0))


def codes(frames: np.ndarray, rules: ChromaRules) -> np.ndarray:
    """A 32-bit integer for every position whose patch lies in the recording."""
    n = len(frames) - rules.span + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    # A row for each pitch, so that areas are differences of rows that lie in one piece.
    image = np.zeros((13, len(frames) + 1))
    np.cumsum(np.ascontiguousarray(frames.T).cumsum(axis=1), axis=0, out=image[1:, 1:])
    plan = filters(rules.span)
    if whole := bool(image[-1, -1] < 2**53 and (frames == np.rint(frames)).all()):
        image = image.astype(np.intp)
    out = np.empty(n, np.uint32)
    for lo in range(0, n, POSITIONS):
        m = min(POSITIONS, n - lo)

        def area(t: int, p: int, width: int, height: int, at: int = lo, m: int = m) -> np.ndarray:
            height = min(height, 12 - p)
            a, b = slice(at + t, at + t + m), slice(at + t + width, at + t + width + m)
            return image[p + height, b] - image[p + height, a] - image[p, b] + image[p, a]

        both = np.empty((2, len(plan), m), image.dtype)
        for k, (kind, p, height, width) in enumerate(plan):
            h, w = max(1, height // 2), width // 2
            if kind == 0:  # low against high pitches
                both[:, k] = area(0, p, width, h), area(0, p + h, width, h)
            elif kind == 1:  # early against late frames
                both[:, k] = area(0, p, w, height), area(w, p, w, height)
            else:  # one diagonal against the other
                both[:, k] = area(0, p, w, h) + area(w, p + h, w, h), area(w, p, w, h) + area(0, p + h, w, h)
        np.maximum(both, 0, out=both)
        logs = LOGS.take(both) if whole and both.max() < len(LOGS) else np.log1p(both)
        ratio = logs[0] - logs[1]
        level = (ratio > -rules.step).astype(np.uint32) + (ratio > 0) + (ratio > rules.step)
        level ^= level >> np.uint32(1)  # Gray code: neighbours differ in one bit
        level <<= (2 * np.arange(len(plan) - 1, -1, -1, dtype=np.uint32))[:, None]
        out[lo : lo + m] = np.bitwise_or.reduce(level, axis=0)
    return out


def items(own: np.ndarray) -> np.ndarray:
    """The integers as a sorted set of (occurrence, integer): n equal positions of two recordings are n common items, repeats included."""
    ordered = np.sort(own)
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(own) else np.empty(0, np.int64)
    occurrence = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
    return np.sort(occurrence.astype(np.uint64) << np.uint64(32) | ordered.astype(np.uint64))


def offsets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Histogram of equal integers by offset: entry k counts the pairs a[i] == b[j] with i - j = k - (len(b) - 1)."""
    total = np.zeros(len(a) + len(b) - 1, np.int64)
    order = np.argsort(b, kind="stable")
    ordered = b[order]
    lo, hi = np.searchsorted(ordered, a, "left"), np.searchsorted(ordered, a, "right")
    n = hi - lo
    few = np.flatnonzero((n > 0) & (n <= 64))
    if len(few):
        m = n[few]
        at = np.arange(int(m.sum())) + np.repeat(lo[few] - np.concatenate(([0], np.cumsum(m)[:-1])), m)
        total += np.bincount(np.repeat(few, m) - order[at] + len(b) - 1, minlength=len(total))
    # Integers that b repeats often (held notes, repeated words): a correlation each, so that memory stays linear.
    for code in np.unique(a[n > 64]):
        size = 1 << (len(total) - 1).bit_length()
        one, two = np.fft.rfft(a == code, size), np.fft.rfft((b == code)[::-1], size)
        total += np.rint(np.fft.irfft(one * two, size)[: len(total)]).astype(np.int64)
    return total


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """Best offset (of a's positions over b's), equal integers there, and the share of bits that differ where both sound."""
    histogram = offsets(a, b)
    k = int(histogram.argmax())
    offset = k - (len(b) - 1)
    one, two = a[max(0, offset) :], b[max(0, -offset) :]
    n = min(len(one), len(two))
    return offset, int(histogram[k]), float(np.bitwise_count(one[:n] ^ two[:n]).sum() / (32 * n))


def matches(a: np.ndarray, b: np.ndarray, rules: ChromaRules) -> bool:
    """Whether two recordings are the same but for some frames."""
    if not len(a) or not len(b):
        return False
    _, hits, errors = align(a, b)
    return hits >= rules.hits * max(len(a), len(b)) and errors <= rules.errors


def recording_classes(docs: DataFrame, rules: ChromaRules | None = None) -> DataFrame:
    """doc_id, n_frames, n_codes and class_id for every row of docs.

    Needs doc_id and text. The tables hold no sound, so a text is played: one frame a word (see
    word_frames); audio_classes takes recordings. Two recordings match if, at their
    best offset, at least rules.hits of the longer one's integers are equal and at most
    rules.errors of the bits differ. class_id is the least doc_id of the connected component;
    equal texts always share one.

    Null texts, and texts of fewer words than a patch, have no integers and match nothing but
    their copies. Rows that repeat each give a row. An empty table gives an empty table.
    """
    has_columns(docs, "doc_id", "text")
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.col("text").alias("payload"))
    return _classes(keyed, word_frames, rules or ChromaRules())


def audio_classes(recordings: DataFrame, rules: ChromaRules | None = None, rate: int = 11_025) -> DataFrame:
    """doc_id, n_frames, n_codes and class_id for every row of recordings.

    Needs doc_id and audio, a binary column of WAV files (whole numbers of 8 to 32 bits, any
    number of channels) or of raw 16-bit mono samples at the given rate. See recording_classes for
    what matches. Null, broken and very short recordings have no integers and match nothing but
    their copies. Rows that repeat each give a row. An empty table gives an empty table.
    """
    has_columns(recordings, "doc_id", "audio")
    key = F.unhex(F.md5(F.coalesce(F.col("audio"), F.unhex(F.lit("")))))
    key = F.when(F.col("audio").isNull(), F.unhex(F.md5(F.lit("null").cast("binary")))).otherwise(key)
    keyed = recordings.select("doc_id", key.alias("text_key"), F.col("audio").alias("payload"))
    return _classes(keyed, lambda data: audio_frames(data, rate), rules or ChromaRules())


def _classes(keyed: DataFrame, sound: Callable[..., np.ndarray], rules: ChromaRules) -> DataFrame:
    """The result of recording_classes for doc_id, text_key and payload, whose frames sound gives."""
    bounded_batches(keyed)
    slots = rules.bands * rules.rows

    @F.pandas_udf("bands array<long>, sketch binary, mass long, n_frames long")
    def marks(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            bands: list = [[]] * len(texts)
            sketches = [b""] * len(texts)
            mass, frames, held, weight = [0] * len(texts), [0] * len(texts), [], 0

            def flush(held=held, bands=bands, sketches=sketches) -> None:
                if held:
                    sets = [x[1] for x in held]
                    found = signatures(sets, [np.ones(len(x)) for x in sets], slots, rules.seed)
                    for (i, _), row, winners in zip(held, band_hashes(found, rules.bands, rules.rows), found, strict=True):
                        bands[i], sketches[i] = row, (winners * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8).tobytes()
                    held.clear()

            for i, text in enumerate(texts):
                heard = sound(text)
                own = codes(heard, rules)
                frames[i], mass[i] = len(heard), len(own)
                if len(own):
                    held.append((i, items(own)))
                    weight += len(own) + slots
                if weight > 400_000:
                    flush()
                    weight = 0
            flush()
            yield pd.DataFrame({"bands": bands, "sketch": sketches, "mass": mass, "n_frames": frames})

    marked = cut(keyed.withColumn("m", marks("payload")).select("doc_id", "text_key", "m.bands", "m.sketch", "m.mass", "m.n_frames"))

    @F.pandas_udf("binary")
    def heard_codes(texts: pd.Series) -> pd.Series:
        return pd.Series([codes(sound(t), rules).tobytes() for t in texts], dtype=object)

    def links():
        def compare(prints: list, left: int) -> list[tuple[int, int]]:
            own = [np.frombuffer(x, np.uint32) for x in prints]
            sets = [items(x) for x in own]

            def enough(common: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
                return common >= rules.hits * np.maximum(size, sizes)

            return postings_links(sets, left, enough, lambda i, j: matches(own[i], own[j], rules))

        return compare

    found = classes(keyed, marked.select("doc_id", "text_key", "bands", "sketch", "mass"), links, rules.block_codes, rules.agreement, many_bands=True, prepared=heard_codes, least_share=rules.least_share)
    sizes = marked.groupBy("text_key").agg(F.max("n_frames").alias("n_frames"), F.max("mass").alias("n_codes")).withColumnRenamed("text_key", "size_key")
    return found.join(sizes, found["text_key"] == sizes["size_key"]).select("doc_id", "n_frames", "n_codes", "class_id")
