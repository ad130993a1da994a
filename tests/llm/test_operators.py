"""Every training-data operator: against SQL or brute force, and on edge cases."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import random
import re
import struct
from pyspark.sql import functions as F

from lodestone.llm import blocks, chroma, common, licenses, linededup, mixing, packing, prefix_tokens, probminhash, quality, sharding, urlfilter
from lodestone.llm.graph import components
from lodestone.llm.queries import LISTED_DOMAINS, ORACLES, QUERIES, URL_RULES, tokenizer

from ..compare import same
from ..conftest import SF_DIR
from .conftest import edge_rows, edited, prose

WORD = re.compile("[^\x20\x09-\x0D]+")


def docs_of(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, duck):
    same(QUERIES[name](spark, SF_DIR), duck, ORACLES[name])


# 1 Mixing


def check_mix(rows, mixed, max_repeats=3):
    sizes = Counter()
    for _, text, _, source, *_ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))]
    left, open_, want = float(sum(sizes.values())), set(range(len(names))), {}
    while open_:
        total = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / total > max_repeats * sizes[names[i]]]
        for i in above or open_:
            want[names[i]] = max_repeats * sizes[names[i]] if above else left * weights[i] / total
        left -= sum(want[names[i]] for i in above)
        open_ -= set(above or open_)
    taken = Counter()
    for r in mixed:
        assert r.mix_source_size == sizes[r.source] and abs(r.mix_target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.mix_taken <= max_repeats * r.mix_size
        taken[r.source] += r.mix_taken
    total = sum(sizes.values())
    for s in names:
        assert abs(taken[s] - want[s]) <= 4 * max(1, total // 65_536 + 1)


def test_mix(edges, nothing):
    got = mixing.mix_sources(edges.withColumn("mix_taken", F.lit("x"))).collect()
    check_mix(edge_rows(), got)
    assert len(got) == len(edge_rows())
    again = mixing.mix_sources(edges.repartition(7)).collect()
    assert sorted((str(r.doc_id), str(r.text), r.mix_taken) for r in got) == sorted((str(r.doc_id), str(r.text), r.mix_taken) for r in again)
    assert mixing.mix_sources(nothing).count() == 0


def test_a_long_tail_of_small_sources(spark):
    import pandas as pd

    # Three large sources (0, 1, 2) and a tail, at about 5e9 words.
    sizes = [2_500_000_000, 1_500_000_000, 996_500_000] + [10_000] * 200 + [30_000] * 50 + [7, 1, 0]
    sources = pd.DataFrame({"source": [f"s{i:04}" for i in range(len(sizes))], "source_size": sizes})
    plan = mixing.plan_blocks(sources, (5.0, 2.0, 1.0), 65_536, 64, 3, 1, 1)
    taken = (plan["times"] * (plan["source_size"] - plan["block"] * plan["length"]).clip(upper=plan["length"]).clip(lower=0)).groupby(plan["source"]).sum()
    for source, rows in plan.groupby("source"):
        size, target = rows["source_size"].iloc[0], rows["target"].iloc[0]
        assert abs(taken[source] - target) <= max(0.02 * target, 1), (source, size, target, taken[source])
    # More sources than seats.
    many = pd.DataFrame({"source": [f"s{i:03}" for i in range(300)], "source_size": [100_000] * 2 + [40] * 298})
    plan = mixing.plan_blocks(many, (5.0, 2.0, 1.0), 64, 4, 3, 1, 1)
    taken = (plan["times"] * (plan["source_size"] - plan["block"] * plan["length"]).clip(upper=plan["length"])).groupby(plan["source"]).sum()
    assert all(taken[s] == 120 for s in many["source"][2:])
    # By rows: documents of a tiny source are there, each as often as its target says.
    docs = spark.createDataFrame([(0, "a", prose(700, 60_000))] + [(i, f"t{i}", prose(700 + i, 20)) for i in range(1, 9)], "doc_id long, source string, text string")
    for r in mixing.mix_sources(docs, house=100, min_block=1024).where("doc_id > 0").collect():
        assert r.mix_taken == r.mix_target == 60 and r.mix_copies == 3


def test_whole_documents_are_taken(edges):
    rows = mixing.mix_sources(edges, min_block=8).collect()
    taken = mixing.take_documents(mixing.mix_sources(edges, min_block=8))
    assert taken.columns == edges.columns and taken.count() == sum(r.mix_copies for r in rows)


def test_sainte_lague():
    assert mixing.sainte_lague([53, 24, 23], 7, [99] * 3) == [3, 2, 2]
    assert mixing.sainte_lague([100, 1], 5, [2, 9]) == [2, 3]
    assert mixing.targets([10, 90], [9, 1], 3) == [30.0, 70.0]


# 2 Quality


def slow_repeats(words):
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    return len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)})


def test_quality(edges, nothing):
    for r in quality.judge_documents(edges.withColumn("quality", F.lit(1))).collect():
        text = r.text or ""
        words, q = WORD.findall(text), r.quality
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (q.n_words, q.word_chars, q.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert q.n_repeat_words == slow_repeats(words) and q.n_dup_lines == len(lines) - len(set(lines))
        assert q.base_failed == (len(words) < 10 or 100 * q.n_repeat_words > 20 * len(words)) and not (q.base_failed and q.kept)
    kept = {r.doc_id: r.text for r in quality.clean_documents(edges).collect()}
    assert 1 in kept and 4 not in kept and 8 not in kept
    assert 11 not in kept or "|" not in kept[11]
    assert quality.clean_documents(edges).columns == edges.columns and quality.clean_documents(nothing).count() == 0


def test_repeat_words_ranks_large_vocabularies():
    words = [str(i % 9000) for i in range(12_000)]
    assert quality.repeat_words(words) == slow_repeats(words)


@pytest.mark.parametrize(("line", "rule"), [
    ("Home | About | Contact", "navigation"), ("this*** is*** bad&&& stuff%%%", "punctuation"), ("WE SHOUT ALL THE TIME. YES", "shouting"), ("Click here for more.", "boilerplate"),
    ("no sentence ends in this line at all", "punctuation"), ("A plain sentence stands here.", None), ("Title", None),
])
def test_line_rules(line, rule):
    assert quality.bad_line(line, WORD.findall(line), quality.LineRules()) == rule


# 3 Sharding


def test_sharding(edges, nothing):
    got = sharding.shard_documents(edges.withColumn("shard", F.lit("x"))).collect()
    slots = defaultdict(list)
    for r in got:
        body = (r.text or "").encode()
        assert r.size == len(body) + 1 and r.text_crc32 == zlib.crc32(body)
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(8)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(nothing).count() == 0
    loose = Counter(r.shard for r in sharding.shard_documents(edges, epsilon=0.25, columns=["doc_id"]).collect())
    assert max(loose.values()) <= 1.25 * len(got) / 8 + 1


def test_a_new_shard_moves_few_keys():
    counts = [10] * 1024
    rows = sum(counts)

    def homes(n):
        parts = sharding.place(counts, sharding.ring_orders(n, 64, 1024, 7), sharding.capacities(rows, n, 0.25), 7)
        return {(s, k): shard for s, lo, hi, shard, _ in parts for k in range(lo, hi)}

    one, two = homes(8), homes(9)
    moved = sum(one[k] != two[k] for k in one)
    assert len(one) == rows and moved < 0.3 * rows
    tight = sharding.place(counts, sharding.ring_orders(8, 64, 1024, 7), sharding.capacities(rows, 8, 0), 7)
    assert set(Counter(shard for *_, shard, _ in [(lo, hi, shard, b) for _, lo, hi, shard, b in tight for _ in range(hi - lo)]).values()) == {rows // 8}


def test_ring_against_brute_force():
    rng, shards, vnodes, slots, seed = random.Random(8), 5, 6, 64, 3
    nodes = sorted((sharding._hash(seed, "node", s, v), s) for s in range(shards) for v in range(vnodes))
    orders = sharding.ring_orders(shards, vnodes, slots, seed)
    for slot in range(slots):
        # Clockwise: nodes of the slot itself first, then those of the next ones, round the ring.
        met = sorted(nodes, key=lambda n: ((n[0] % slots - slot) % slots, n[0]))
        assert orders[slot] == list(dict.fromkeys(s for _, s in met))
    for epsilon in (0, 0.1, 0.5):
        counts = [rng.choice([0, 1, 5, 40]) for _ in range(slots)]
        capacity = sharding.capacities(sum(counts), shards, epsilon)
        # Key by key: in each turn the slots in seeded order, a key at a time.
        left, load, home = {s: list(range(n)) for s, n in enumerate(counts)}, [0] * shards, {}
        for turn in range(shards):
            for s in sorted(left, key=lambda s: sharding._hash(seed, "slot", s)):
                for key in list(left[s]):
                    shard = orders[s][turn]
                    if load[shard] < capacity[shard]:
                        home[s, key] = (shard, load[shard])
                        load[shard] += 1
                        left[s].remove(key)
        got = {(s, k): (shard, base + k - lo) for s, lo, hi, shard, base in sharding.place(counts, orders, capacity, seed) for k in range(lo, hi)}
        assert got == home and len(got) == sum(counts)


@pytest.mark.parametrize(("epsilon", "all_moves", "between_old"), [(0.0, 0.16, 0.02), (0.25, 0.13, 0.02)])
def test_moves_to_a_ninth_shard(epsilon, all_moves, between_old):
    rng = random.Random(1)
    counts = [sum(rng.random() < 0.5 for _ in range(40)) for _ in range(8192)]
    rows = sum(counts)

    def homes(n):
        parts = sharding.place(counts, sharding.ring_orders(n, 64, 8192, 7), sharding.capacities(rows, n, epsilon), 7)
        return {(s, k): shard for s, lo, hi, shard, _ in parts for k in range(lo, hi)}

    one, two = homes(8), homes(9)
    assert sum(one[k] != two[k] for k in one) < all_moves * rows
    assert sum(one[k] != two[k] != 8 for k in one) < between_old * rows


def test_repeated_rows_are_numbered(spark, edges):
    rows = [(None, None, None, None, None)] * 120 + [(5, prose(1, 40), "en", "a", 1)] * 120 + [(100 + i, prose(i, 30), "en", "b", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, edges.schema).repartition(5)
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    got = defaultdict(list)
    for r in common.number_copies(keyed, "key", "copy").collect():
        got[r.key].append(r.copy)
    assert sorted(map(len, got.values()))[-2:] == [120, 120] and all(sorted(v) == list(range(len(v))) for v in got.values())
    placed = sharding.shard_documents(docs, columns=["doc_id"]).collect()
    counts = Counter(r.shard for r in placed)
    assert len(placed) == 300 and max(counts.values()) - min(counts.values()) <= 1 and len({(r.shard, r.slot) for r in placed}) == 300
    check_mix(rows, mixing.mix_sources(docs).collect())
    narrow = mixing.mix_sources(docs, columns=["doc_id"])
    assert narrow.columns[0] == "doc_id" and narrow.count() == 300


def test_many_sources_are_planned_in_a_task(edges, monkeypatch):
    rows = sorted((str(r.doc_id), str(r.text), r.mix_taken) for r in mixing.mix_sources(edges).collect())
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    assert sorted((str(r.doc_id), str(r.text), r.mix_taken) for r in mixing.mix_sources(edges, house=65_536).collect()) == rows


# 4 Near copies


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_classes(rows, linked):
    """Class by row number: equal texts and linked pairs."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] or linked(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(rows))]


def test_near_classes(spark, edges, nothing):
    rows = edge_rows() + [(200 + k, edited(prose(9, 150), 30 + k, f"w{k}"), None, "n", 1) for k in range(40)]
    df = spark.createDataFrame(rows, edges.schema)
    sets = [shingles(r[1]) for r in rows]
    want = slow_classes(rows, lambda i, j: bool(sets[i]) and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])))
    groups = defaultdict(list)
    for r, w in zip(rows, want, strict=True):
        groups[w].append(r[0])
    ids = [min((x for x in groups[w] if x is not None), default=None) for w in want]
    # Small blocks make every cluster a matter of many units.
    for rules in (None, probminhash.NearRules(block_shingles=300)):
        got = probminhash.near_classes(df, rules).collect()
        assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == sorted((str(r[0]), str(c)) for r, c in zip(rows, ids, strict=True))
    kept = probminhash.drop_near_copies(df)
    assert kept.columns == df.columns and kept.count() == len(set(want))
    assert probminhash.near_classes(nothing).count() == 0 and probminhash.drop_near_copies(nothing).count() == 0


def test_probability_jaccard():
    r = np.random.default_rng(5)
    one = r.integers(1, 1 << 60, 300, dtype=np.uint64)
    two = np.concatenate([one[:200], r.integers(1, 1 << 60, 100, dtype=np.uint64)])
    w1, w2 = np.ones(300), np.ones(300)
    s = probminhash.signatures([one, two], [w1, w2], 4096, 3)
    assert abs((s[0] == s[1]).mean() - 200 / 400) < 0.04
    # Scaling all weights of a set changes nothing.
    assert (probminhash.signatures([one], [w1], 64, 3) == probminhash.signatures([one], [w1 * 7.5], 64, 3)).all()


def test_near_copies_with_unequal_repeats(spark):
    # Pairs of set similarity 0.82 to 0.83; in one text of each the middle is repeated 100 times.
    rows = []
    for k in range(40):
        own = [prose(500 + 3 * k + i, n, n).replace(".", f"x{k}").split(" ") for i, n in enumerate((10, 110, 10))]
        middle = [f"{w}{k}" for w in own[1]]
        rows.append((2 * k, " ".join(own[0][:4] + middle + own[0][4:])))
        rows.append((2 * k + 1, " ".join(middle + own[2][4:] + ["\n"] + middle[40:70] * 100)))
    sets = [shingles(t) for _, t in rows]
    similar = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 80, 2)]
    assert min(similar) >= 0.8 and max(similar) < 0.9
    got = {r.doc_id: r.class_id for r in probminhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(80)}


@pytest.mark.parametrize("block_mass", [40])
def test_large_clusters_lose_no_link(spark, block_mass):
    # One candidate cluster of a large group, small groups, a chain that only neighbours link, and strangers.
    token_sets = [{f"big{k}" for k in range(9)} | {f"own{i}"} for i in range(60)]
    token_sets += [{f"g{i % 7}_{k}" for k in range(3)} | {f"x{i}"} for i in range(35)]
    token_sets += [{f"c{i + k}" for k in range(4)} for i in range(40)] + [{f"s{i}"} for i in range(20)] + [{f"big{k}" for k in range(9)} | {"own0", "late"}]
    rng = random.Random(2)
    rng.shuffle(token_sets)
    rows = [(i, " ".join(sorted(t))) for i, t in enumerate(token_sets)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")
    keyed = docs.select("doc_id", blocks.text_key(F.col("text")).alias("text_key"), F.col("text").alias("payload"))
    marked = keyed.select("doc_id", "text_key", F.array(F.lit(1).cast("long")).alias("bands"), F.lit(10).cast("long").alias("mass"))

    def links():
        def compare(texts, left):
            sets = [np.unique(np.array([zlib.crc32(w.encode()) for w in t.split()], np.uint64)) for t in texts]
            return blocks.postings_links(sets, left, lambda common, size, sizes: 2 * common >= size + sizes - common)

        return compare

    got = {r.doc_id: r.class_id for r in blocks.classes(keyed, marked, links, block_mass).collect()}
    label = slow_classes(rows, lambda a, b: 2 * len(token_sets[a] & token_sets[b]) >= len(token_sets[a] | token_sets[b]))
    assert got == {i: label[i] for i in range(len(rows))}


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, 101, 102)}


def test_rounds_leave_no_estimates(spark):
    # The driver holds a plan's estimated size; a round that joins its frame with itself must not square it.
    links = spark.createDataFrame([((i * 37) % 101, ((i + 1) * 37) % 101) for i in range(100)], "a long, b long")
    assert components(links)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**64


# 5 Recordings


def test_alignment_finds_the_offset():
    rules = chroma.ChromaRules()
    r = np.random.default_rng(1)
    a = r.random((200, 12))
    one, two = chroma.codes(a, rules), chroma.codes(a[37:150], rules)
    assert chroma.align(one, two) == (37, len(two), 0.0)
    noisy = a.copy()
    noisy[::40] = r.random((5, 12))
    assert chroma.matches(one, chroma.codes(noisy, rules), rules) and not chroma.matches(one, chroma.codes(r.random((200, 12)), rules), rules)
    held = np.zeros(300, np.uint32)
    assert chroma.offsets(held, held)[299] == 300


def test_pcm_frames_hear_the_pitch():
    t = np.arange(44100) / 11025
    for hertz, pitch in ((440.0, 0), (523.25, 3), (880.0, 0), (659.26, 7)):
        frames = chroma.pcm_frames(np.sin(2 * np.pi * hertz * t), 11025)
        assert len(frames) and (frames.argmax(axis=1) == pitch).all()
    assert len(chroma.pcm_frames(np.zeros(10), 11025)) == 0 and len(chroma.codes(chroma.pcm_frames(np.zeros(40_000), 11025), chroma.ChromaRules())) > 0


def test_recording_classes(edges, nothing, spark):
    rows = edge_rows() + [(200 + k, edited(prose(9, 150), 40, f"w{k}"), None, "n", 1) for k in range(8)]
    rules = chroma.ChromaRules()
    own = [chroma.codes(chroma.word_frames(r[1]), rules) for r in rows]
    want = slow_classes(rows, lambda i, j: chroma.matches(own[i], own[j], rules))
    groups = defaultdict(list)
    for r, w in zip(rows, want, strict=True):
        groups[w].append(r[0])
    got = chroma.recording_classes(spark.createDataFrame(rows, edges.schema)).collect()
    ids = [min((x for x in groups[w] if x is not None), default=None) for w in want]
    assert sorted((str(r.doc_id), r.n_codes, str(r.class_id)) for r in got) == sorted((str(r[0]), len(o), str(c)) for r, o, c in zip(rows, own, ids, strict=True))
    assert chroma.recording_classes(nothing).count() == 0


def melody(seed, seconds=12.0, rate=11_025):
    r = np.random.default_rng(seed)
    notes = 220.0 * 2 ** (r.integers(0, 24, int(seconds / 0.25)) / 12)
    t = np.arange(int(0.25 * rate)) / rate
    return np.concatenate([np.sin(2 * np.pi * f * t) + 0.3 * np.sin(4 * np.pi * f * t) for f in notes])


def wav(samples, rate=11_025, width=2, channels=1):
    top = 2.0 ** (8 * width - 1) - 1
    whole = np.repeat(np.round(samples / np.abs(samples).max() * 0.8 * top).astype(np.int64)[:, None], channels, axis=1)
    body = (whole + 128).astype(np.uint8).tobytes() if width == 1 else whole.astype("<i8").view(np.uint8).reshape(*whole.shape, 8)[:, :, :width].tobytes()
    head = b"fmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * width * channels, width * channels, 8 * width)
    return b"RIFF" + struct.pack("<I", 4 + len(head) + 8 + len(body)) + b"WAVE" + head + b"data" + struct.pack("<I", len(body)) + body


def test_wav_samples():
    tone = melody(1, 2.0)
    for width in (1, 2, 3, 4):
        for channels in (1, 2):
            samples, rate = chroma.wav_samples(wav(tone, 8_000, width, channels))
            assert rate == 8_000 and len(samples) == len(tone) and np.corrcoef(samples, tone)[0, 1] > 0.99
    raw = np.round(tone * 9_000).astype("<i2").tobytes()
    assert chroma.wav_samples(raw + b"x")[1] == 11_025 and len(chroma.wav_samples(raw + b"x")[0]) == len(tone)
    for broken in (None, b"", b"RIFF", wav(tone)[:30], b"RIFF\0\0\0\0WAVEfmt \xff\xff\xff\xff", wav(tone).replace(b"fmt ", b"fmx ")):
        assert chroma.audio_frames(broken).shape[1] == 12


def test_audio_classes(spark):
    rows = [(i, wav(melody(i))) for i in range(6)]
    rows += [(10, wav(0.3 * melody(0), width=3)), (11, wav(melody(1), channels=2)), (12, wav(np.concatenate([melody(2), melody(77, 1.0)]))), (13, np.round(melody(3) * 8_000).astype("<i2").tobytes())]
    rows += [(20, None), (21, b""), (22, b"RIFF"), (23, None), (24, wav(melody(4)))]
    schema = "doc_id long, audio binary"
    got = {r.doc_id: r.class_id for r in chroma.audio_classes(spark.createDataFrame([(i, None if a is None else bytearray(a)) for i, a in rows], schema)).collect()}
    assert got == {i: i for i in range(6)} | {10: 0, 11: 1, 12: 2, 13: 3, 20: 20, 21: 21, 22: 22, 23: 20, 24: 4}
    assert chroma.audio_classes(spark.createDataFrame([], schema)).count() == 0


def test_recall_of_planted_recordings(spark):
    rng, rows, planted = random.Random(12), [], []
    for i in range(150):
        text = prose(5000 + i, rng.choice([40, 120, 400]))
        words = text.split(" ")
        for _ in range(max(1, len(words) // rng.choice([30, 60, 200]))):
            words[rng.randrange(len(words))] = "edit"
        if i % 3 == 0:
            words = prose(9000 + i, 6).split(" ") + words
        rows += [(2 * i, text), (2 * i + 1, " ".join(words))]
        planted.append(chroma.matches(*(chroma.codes(chroma.word_frames(t), chroma.ChromaRules()) for _, t in rows[-2:]), chroma.ChromaRules()))
    got = {r.doc_id: r.class_id for r in chroma.recording_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = [got[2 * i] == got[2 * i + 1] for i, p in enumerate(planted) if p]
    # Measured: all of them.
    assert len(caught) > 60 and sum(caught) >= 0.98 * len(caught), (sum(caught), len(caught))


def test_recordings_of_repeated_lines(spark):
    # Six pairs and a trio share 70 refrains of 10 words and nothing else; two more share half of one text.
    r = np.random.default_rng(6)
    rows = []
    for k in range(7):
        line = prose(400 + k, 10, 10)
        for _ in range(2 + (k == 6)):
            rows.append((len(rows), "\n".join([line] * 70 + [" ".join("".join(r.choice(list("abcdefghijklmnop"), 7)) for _ in range(300))])))
    rows += [(90, prose(410, 200) + "\n" + prose(411, 200)), (91, prose(410, 200) + "\n" + prose(412, 200))]
    rules = chroma.ChromaRules()
    own = [chroma.codes(chroma.word_frames(t), rules) for _, t in rows]
    matched = [(i, j) for i in range(len(rows)) for j in range(i) if chroma.matches(own[i], own[j], rules)]
    assert len(matched) >= 7 and all(len(np.intersect1d(own[i], own[j])) < 0.1 * len(np.union1d(own[i], own[j])) for i, j in matched)
    for i, j in matched:
        assert len(np.intersect1d(chroma.items(own[i]), chroma.items(own[j]))) >= rules.hits * max(len(own[i]), len(own[j]))
    want = slow_classes(rows, lambda i, j: (i, j) in matched)
    got = {x.doc_id: x.class_id for x in chroma.recording_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == [rows[w][0] for w in want]
    # A pair at the least share of items misses all bands with a probability near 1e-5.
    assert (1 - (rules.hits / (2 - rules.hits)) ** rules.rows) ** rules.bands < 1.1e-5


def test_a_strangers_bucket_parts_no_pair(spark):
    # Keys in the order of the ids that buckets are led by: the first is the stranger.
    keys = [bytes(r.key) for r in spark.range(8).select(F.md5(F.col("id").cast("string")).cast("binary").alias("key")).orderBy(F.xxhash64("key")).collect()]
    stranger, other, half = bytes(100), bytes([1]) * 100, bytes(30) + bytes([2]) * 70
    # The one that agrees with the leader too (a third of its slots) is compared with those that do not.
    sketches, payloads = [stranger, other, other, bytes([5]) * 100, half, bytes([2]) * 100, stranger, bytes([6]) * 100], ["s", "x", "x", "t", "y", "y", "u", "v"]
    keyed = spark.createDataFrame([(i, k, p) for i, (k, p) in enumerate(zip(keys, payloads, strict=True))], "doc_id long, text_key binary, payload string")
    marked = spark.createDataFrame([(i, k, [7], x, 10) for i, (k, x) in enumerate(zip(keys, sketches, strict=True))], "doc_id long, text_key binary, bands array<long>, sketch binary, mass long")
    equal = lambda: lambda texts, left: [(i, j) for i in range(left or len(texts)) for j in range(left or i + 1, len(texts)) if texts[i] == texts[j]]
    for many in (False, True):
        got = {r.doc_id: r.class_id for r in blocks.classes(keyed, marked, equal, 1000, 0.25, many_bands=many).collect()}
        assert got == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}
    # Any size of block gives the components of all pairs that agree.
    r = np.random.default_rng(3)
    own = r.integers(0, 3, (60, 40), dtype=np.uint8)
    ids = [x.a for x in spark.createDataFrame([(bytes([i]),) for i in range(60)], "k binary").select(F.xxhash64("k").alias("a")).collect()]
    hub = min(ids)
    star = spark.createDataFrame([(1, 60, i, hub) for i in ids if i != hub], "band long, size long, a long, b long")
    mine = spark.createDataFrame([(bytes([i]), own[i].tobytes()) for i in range(60)], "text_key binary, sketch binary")
    for share in (0.5, 0.55):
        want = slow_classes([(i, str(i)) for i in range(60)], lambda i, j: (own[i] == own[j]).mean() >= share)
        for rows in (7, 1000):
            links = {(ids.index(x.a), ids.index(x.b)) for x in blocks.agreeing(star, mine, share, rows).collect()}
            assert slow_classes([(i, str(i)) for i in range(60)], lambda i, j: (i, j) in links or (j, i) in links) == want
        assert 1 < len(set(want)) < 60


def test_chains_of_strangers_cost_their_pairs(spark):
    # One cluster: each recording's sketch agrees with its neighbours' alone; every tenth matches the one after the next too.
    n, share, r = 200, 0.25, np.random.default_rng(5)
    values = r.integers(0, 256, (n + 4, 20), dtype=np.uint8)
    sketches = [values[i : i + 4].tobytes() for i in range(n)]  # 80 slots, moved by 20 for each neighbour
    sketches = [b"".join(x[20 * ((k - i) % 4) : 20 * ((k - i) % 4) + 20] for k in range(4)) for i, x in enumerate(sketches)]
    own = np.array([np.frombuffer(x, np.uint8) for x in sketches])
    agree = (own[:, None] == own).mean(axis=2) >= share
    block = r.integers(0, 9, n)
    for first in (0, 70):
        got = blocks.agreeing_blocks(own, block, first, share)
        assert len(got) == len(set(got)) and set(got) == {(i, block[j]) for i in range(n) for j in range(n) if i != j and agree[i, j] and (not first or (i < first) != (j < first))}
    assert blocks.agreeing_blocks(own[:1], block[:1], 0, share) == []

    rows = [(i, str(i - 2 if i % 10 == 2 else i)) for i in range(n)]
    keys = [i.to_bytes(4, "big") for i in range(n)]
    keyed = spark.createDataFrame([(i, keys[i], p) for i, p in rows], "doc_id long, text_key binary, payload string")
    marked = spark.createDataFrame([(i, keys[i], [i, i + 1, i + 2, i + 3], sketches[i], 10) for i in range(n)], "doc_id long, text_key binary, bands array<long>, sketch binary, mass long")
    compared = spark.sparkContext.accumulator(0)

    def links():
        def compare(texts, left):
            compared.add(len(texts))
            return [(i, j) for i in range(left or len(texts)) for j in range(left or i + 1, len(texts)) if texts[i] == texts[j]]

        return compare

    got = {x.doc_id: x.class_id for x in blocks.classes(keyed, marked, links, 20, share, prepared=lambda c: F.concat(F.lit("p"), c)).collect()}
    assert got == {i: int(p) for i, p in rows}
    assert agree[0, 2] and 0 < compared.value < 8 * n  # all blocks with all: 100 * n


def test_near_copies_meet_pivots_not_each_other(spark):
    # One cluster: 200 near copies, whose sketches all agree, and four strangers that agree with them too.
    n, r = 204, np.random.default_rng(8)
    base = r.integers(0, 256, 100, dtype=np.uint8)
    sketches = []
    for i in range(n):
        own = base.copy()
        own[r.choice(100, 20 if i < 200 else 65, replace=False)] = r.integers(0, 256, 20 if i < 200 else 65)
        sketches.append(own.tobytes())
    sketches[203] = sketches[200]
    rows = [(i, "copy" if i < 200 else f"stranger{i % 3}") for i in range(n)]
    keys = [i.to_bytes(4, "big") for i in range(n)]
    keyed = spark.createDataFrame([(i, keys[i], p) for i, p in rows], "doc_id long, text_key binary, payload string")
    marked = spark.createDataFrame([(i, keys[i], [7], sketches[i], 8 + i % 5) for i in range(n)], "doc_id long, text_key binary, bands array<long>, sketch binary, mass long")
    compared = spark.sparkContext.accumulator(0)

    def links():
        def compare(texts, left):
            compared.add(len(texts))
            return [(i, j) for i in range(left or len(texts)) for j in range(left or i + 1, len(texts)) if texts[i] == texts[j]]

        return compare

    got = {x.doc_id: x.class_id for x in blocks.classes(keyed, marked, links, 20, 0.25, many_bands=True).collect()}
    assert got == {i: 0 if i < 200 else 200 if i == 203 else i for i in range(n)}
    assert 0 < compared.value < 20 * n  # all blocks with all: 100 * n


def test_sizes_that_cannot_match_are_not_compared():
    rules, r = chroma.ChromaRules(), np.random.default_rng(9)
    for one, two in r.integers(1, 400, (2000, 2)):
        least = math.ceil(rules.hits * max(one, two) - 1e-9)
        share = rules.least_share(np.array([one]), np.array([two]))[0]
        assert share == math.inf if least > min(one, two) else share < least / (one + two - least)
    own, mass, block = r.integers(0, 3, (80, 114), dtype=np.uint8), r.integers(50, 200, 80), r.integers(0, 9, 80)
    agree = ((own[:, None] == own).mean(axis=2) >= 0.3) & ((own[:, None] == own).mean(axis=2) >= rules.least_share(mass[:, None], mass))
    for first in (0, 30):
        got = blocks.agreeing_blocks(own, block, first, 0.3, mass, rules.least_share)
        assert set(got) == {(i, block[j]) for i in range(80) for j in range(80) if i != j and agree[i, j] and (not first or (i < first) != (j < first))}


# 6 Line runs


def slow_runs(rows, least=50):
    """Lines to delete by (id, text): every run of at least so many words that occurs earlier."""
    documents = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    seqs = {d: [(k, x.strip(" \t\n\x0b\x0c\r")) for k, x in enumerate(d[1].split("\n")) if WORD.search(x)] for d in documents}
    seen, gone = set(), defaultdict(set)
    for d in documents:
        lines = seqs[d]
        size = [len(WORD.findall(x)) for _, x in lines]
        for i in range(len(lines)):
            fresh = []
            for j in range(i, len(lines)):
                if sum(size[i : j + 1]) >= least:
                    run = tuple(x for _, x in lines[i : j + 1])
                    if run in seen:
                        gone[d].update(lines[k][0] for k in range(i, j + 1))
                    fresh.append(run)
            seen.update(fresh)
    return gone


def test_line_runs(spark, edges, nothing):
    shared = prose(20, 90, 15)
    rows = edge_rows() + [(300, prose(21, 30) + "\n" + shared, "", "", 1), (301, shared + "\n" + prose(22, 20) + "\n\n" + shared, "", "", 1), (302, "x y.\n" * 80, "", "", 1)]
    rows = [r for r in rows if not (r[0] is None or r[0] == 8)]  # their order among each other is by hash
    got = linededup.dedup_lines(spark.createDataFrame(rows, edges.schema)).collect()
    want = slow_runs(rows)
    for r in got:
        text = next(x[1] for x in rows if x[0] == r.doc_id)
        assert sorted(r.gone_lines) == sorted(want[(r.doc_id, text)]), r.doc_id
        if text is not None:
            assert r.text == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in set(r.gone_lines))
    assert any(r.gone_lines for r in got)
    whole = linededup.dedup_lines(edges)
    assert whole.count() == len(edge_rows()) and linededup.drop_emptied(whole).columns == edges.columns and linededup.dedup_lines(nothing).count() == 0


def test_line_runs_of_very_long_texts(spark):
    import time

    shared = "\n".join(f"shared line {k} has some more words in it" for k in range(40))
    body = [f"line {k} of a long text, with words {k * 7919 % 10007}" for k in range(160_000)]
    text = "\n".join(body[:80_000] + shared.split("\n") + body[80_000:] + shared.split("\n"))
    docs = spark.createDataFrame([(1, shared), (2, text)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    assert time.time() - began < 60
    assert got[1].gone_lines == [] and got[2].gone_lines == [*range(80_000, 80_040), *range(160_040, 160_080)]
    assert got[2].text == "\n".join(body)


def test_fingerprints_are_few_and_shared(spark):
    rows = [(1, prose(30, 600, 9)), (2, prose(31, 300, 9) + "\n" + prose(32, 108, 9) + "\n" + prose(33, 90, 9)), (3, prose(34, 45, 9) + "\n" + prose(32, 108, 9))]
    documents = linededup._documents(spark.createDataFrame(rows, "doc_id long, text string"), 50).cache()
    for r in documents.collect():
        assert len({p for p in r.least if p}) < sum(x is not None for x in r.ahead)  # winnowed: neighbours select the same line
    shared = linededup.shared_positions(documents)
    # Only texts that share a passage are followed, and only around it: it begins with line 35 and with line 6.
    places = {r.run_doc: r.places for r in shared.collect()}
    assert set(places) == {2, 3} and all(34 < p <= 46 for p in places[2]) and [p - 34 for p in places[2]] == [p - 5 for p in places[3]]
    assert linededup.windows(documents, shared, 50).count() < linededup.windows(documents, documents.selectExpr("run_doc", "run_row", "filter(array_distinct(least), p -> p is not null) places"), 50).count() / 2


# 7 URLs


def test_cascade_is_exact(spark):
    listed = spark.createDataFrame([(f"k{i}",) for i in range(0, 3000, 3)] + [(None,), ("k0",)], "key string")
    universe = spark.createDataFrame([(f"k{i}",) for i in range(6000)], "key string")
    for most in (10**6, 400):
        c = urlfilter.build_cascade(listed, universe, most_keys=most, bits_per_key=3)
        assert max(map(len, c.parts)) > 1 and (len(c.parts) > 1) == (most == 400)
        got = {r.key: r.m for r in universe.withColumn("m", c.contains(F.col("key"))).collect()}
        assert got == {f"k{i}": i < 3000 and i % 3 == 0 for i in range(6000)}


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Adult-X.Example.COM", "http://a.com/de/1", "http://a.com/fr/", "http://x.org?q=/es/", "http://example.org/es/1", "http://notexample.org/es/1", "http://example.org/en/12", "x://y://z/p"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, url_host string")
    listed = spark.createDataFrame([(x,) for x in LISTED_DOMAINS], "key string")
    got = {r.page_id: (r.url_host, r.url_path, r.url_rule, r.url_verdict) for r in urlfilter.judge_urls(pages, URL_RULES, listed).collect()}
    assert [got[i] for i in range(4)] == [("", "", None, "allow")] * 4
    assert got[4] == ("www.adult-x.example.com", "", None, "block") and got[5][2:] == ("com/de/", "block") and got[6][2:] == ("com/fr/", "allow")
    assert got[7] == ("x.org", "", None, "allow") and got[8][2:] == ("example.org/es/", "block") and got[9][2:] == ("org/", "allow") and got[10][2:] == ("example.org/en/1", "block")
    assert got[11][0] == "y:" and urlfilter.judge_urls(pages.limit(0), URL_RULES, listed).count() == 0
    assert urlfilter.judge_urls(pages, [], listed.limit(0)).where("url_verdict = 'block'").count() == 0
    twice = urlfilter.judge_urls(pages.union(pages), URL_RULES, listed).collect()
    assert Counter((r.page_id, r.url_host, r.url_verdict) for r in twice) == {(i, g[0], g[3]): 2 for i, g in got.items()}


# 8 Packing


def test_packing(edges, nothing):
    rules = packing.PackRules(lengths=(64, 128, 256), pack_rows=16)
    got = packing.pack_documents(edges, rules).collect()
    words, bins = defaultdict(list), defaultdict(list)
    for r in got:
        words[r.doc_id, r.copy].append((r.start, r.words))
        if r.words:
            bins[r.pack, r.bin].append((r.place, r.words, r.bin_length))
        else:
            assert r.bin is None
    sizes = Counter((r[0], len(WORD.findall(r[1] or ""))) for r in edge_rows())
    assert Counter((k[0], sum(n for _, n in v)) for k, v in words.items()) == sizes or sum(n for v in words.values() for _, n in v) == sum(len(WORD.findall(r[1] or "")) for r in edge_rows())
    for v in bins.values():
        v.sort()
        length, end = v[0][2], 0
        for place, n, size in v:
            assert place == end and size == length
            end += n
        assert end <= length and not any(end <= x for x in rules.lengths if x < length)
    assert packing.pack_documents(nothing).count() == 0


def test_packing_keeps_ids(spark):
    # Long ids beside a null, where a float column would round them, and ids of another type.
    ids = [2**60 + 1, 2**60 + 3, None, -(2**62) - 1]
    docs = spark.createDataFrame([(i, "some words here") for i in ids], "doc_id long, text string")
    assert {r.doc_id for r in packing.pack_documents(docs).collect()} == set(ids)
    named = docs.selectExpr("'d' || doc_id as doc_id", "text")
    got = packing.pack_documents(named)
    assert dict(got.dtypes)["doc_id"] == "string" and {r.doc_id for r in got.collect()} == {None if i is None else f"d{i}" for i in ids}


def test_best_fit_against_every_plan():
    def best(pieces, rules):
        permitted, least = sorted(rules.lengths), [float("inf")]

        def go(i, bins):
            if i == len(pieces):
                least[0] = min(least[0], sum(rules.cost(next(n for n in permitted if n >= used)) for used in bins))
                return
            for j in range(len(bins)):
                if bins[j] + pieces[i] <= permitted[-1]:
                    go(i + 1, [n + pieces[i] * (k == j) for k, n in enumerate(bins)])
            go(i + 1, [*bins, pieces[i]])

        go(0, [])
        return least[0]

    rng, ratios, opened = random.Random(4), [], Counter()
    for _ in range(200):
        rules = packing.PackRules(lengths=(8, 16, 32, 64), fixed=rng.choice([1, 4, 16]), square=rng.choice([64, 256, 1024]))
        pieces = [rng.randint(1, rng.choice([8, 64])) for _ in range(rng.randint(1, 7))]
        lengths = {b: n for b, _, n in packing.best_fit(pieces, rules)}
        opened.update(lengths.values())
        ratios.append(sum(map(rules.cost, lengths.values())) / best(pieces, rules))
    assert max(ratios) < 1.35 and sum(ratios) / len(ratios) < 1.01
    assert set(opened) == {8, 16, 32, 64}


def test_best_fit_opens_and_downsizes():
    rules = packing.PackRules(lengths=(10, 20), fixed=100.0, square=1e9)
    assert packing.best_fit([12, 8, 5], rules) == [(0, 0, 20), (0, 12, 20), (1, 0, 10)]
    assert packing.best_fit([], rules) == []


# 9 Licenses


def plain_words(text):
    return [p for w in WORD.findall(text) if (p := w.strip(licenses._STRIP).lower())]


def grams(words, width):
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


def slow_containment(words, template):
    """The greatest share of the template's shingles in a stretch of its length."""
    own = plain_words(template)
    width = min(5, len(own))
    want, every = set(grams(own, width)), grams(words, width)
    # A best stretch begins with a shingle of the template.
    return max((len(set(every[a : a + len(own) - width + 1]) & want) / len(want) for a, g in enumerate(every) if g in want), default=0.0)


def test_licenses(spark, edges, nothing):
    notices = [t for _, t in licenses.TEMPLATES]
    r = np.random.default_rng(4)
    rows = []
    for i in range(60):
        body = prose(i, 300).split(" ")
        for k in r.choice(len(notices), size=i % 3, replace=False):
            notice = notices[int(k)].split(" ")
            if i % 2:
                notice[int(r.integers(0, len(notice)))] = "edited"
            at = int(r.integers(0, len(body)))
            body[at:at] = notice
        rows.append((i, " ".join(body), None, None, 1))
    got = licenses.scan_licenses(spark.createDataFrame(rows, edges.schema)).collect()
    hits = 0
    for row in got:
        words = plain_words(row.text)
        for k, t in enumerate(notices):
            assert (slow_containment(words, t) >= 0.8) == any(h.template == k for h in row.license_hits), (row.doc_id, k)
        for h in row.license_hits:
            hits += 1
            stretch = plain_words(" ".join(WORD.findall(row.text)[h.first_word : h.first_word + h.n_words]))
            assert abs(slow_containment(stretch, notices[h.template]) - h.containment) < 1e-9 and len(stretch) <= len(plain_words(notices[h.template]))
    assert hits > 40
    assert licenses.scan_licenses(edges.withColumn("license_hits", F.lit(0))).where("size(license_hits) > 0").count() == 0
    assert licenses.scan_licenses(nothing).count() == 0


def test_retrieval_of_licenses():
    assert len({name for name, _ in licenses.TEMPLATES}) >= 15
    scanner, rng = licenses.WindowScanner(licenses.TEMPLATES, licenses.ScanRules()), random.Random(6)
    texts, want = [], []
    for i in range(12 * len(licenses.TEMPLATES)):
        k = i % len(licenses.TEMPLATES)
        notice, body = licenses.TEMPLATES[k][1].split(" "), prose(i, rng.choice([0, 40, 300])).split()
        for _ in range(len(notice) // 60):
            notice[rng.randrange(len(notice))] = "edited"
        at = rng.randint(0, len(body))
        text = " ".join(body[:at] + notice + body[at:])
        texts.append(text)
        want.append(k if slow_containment(plain_words(text), licenses.TEMPLATES[k][1]) >= 0.8 else None)
    found = [{m[0] for m in x} for x in scanner.scan(texts)]
    planted = [k in f for k, f in zip(want, found, strict=True) if k is not None]
    assert len(planted) > 300 and sum(planted) >= 0.99 * len(planted)
    # In batches or one by one, with texts that have no words, and beyond one segment.
    assert [scanner.scan([t])[0] for t in texts[:40]] == scanner.scan([None, "", *texts[:40]])[2:]
    long = prose(77, 60_000) + " " + licenses.TEMPLATES[1][1] + " " + prose(78, 20_000)
    assert {m[0] for m in scanner.scan([long])[0]} >= {1, 2} and scanner.scan([]) == []
    # What decides is the retrieval: without bands in common there is no match.
    blind = licenses.WindowScanner(licenses.TEMPLATES, licenses.ScanRules())
    for groups in blind.groups.values():
        for group in groups:
            group.least[:] = 1
    assert not any(blind.scan(texts))


# 10 Tokens


@pytest.fixture(scope="module")
def counter():
    return prefix_tokens.PrefixTokens(tokenizer("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))


def test_prefixes_equal_the_library(counter, library):
    r = np.random.default_rng(8)
    alphabet = list("ab cdethe  ▁\n\té日本😀<s>[INST]ﬁ①") + ["</s>", "<unk>", "    ", "the ", " and"]
    for _ in range(1500):
        text = "".join(r.choice(alphabet, size=int(r.integers(0, 25))))
        assert counter.count(text) == len(library.encode(text)), text
    for text in (prose(1, 60), "x" * 400, "ab" * 100 + "\n\n" + " " * 70, edge_rows()[11][1]):
        counts = counter.prefix_counts(text)
        assert counts == [len(library.encode(text[:i])) for i in range(len(text) + 1)]
        for limit in (0, 1, 9, 10**6):
            assert counter.longest_prefix(text, limit) == max(i for i, c in enumerate(counts) if c <= limit)


def test_count_tokens(spark, edges, nothing, library):
    model = tokenizer("piece_bpe_32k.model")
    for df in (edges.withColumn("n_tokens", F.lit("x")), docs_of(spark)):
        for r in prefix_tokens.count_tokens(df, model, limit=50).collect():
            text = r.text or ""
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), len(library.encode(text)), len(library.encode(text)) > 50)
            assert len(library.encode(text[: r.fit_chars])) <= 50
    stored = prefix_tokens.count_tokens(edges.where("doc_id = 9"), model, prefixes=True)
    r = stored.select("text", prefix_tokens.fits("prefix_tokens", 40).alias("fit"), prefix_tokens.tokens_within("prefix_tokens", 100).alias("n")).first()
    assert r.n == len(library.encode(r.text[:100])) and len(library.encode(r.text[: r.fit])) <= 40 < len(library.encode(r.text[: r.fit + 1]))
    assert prefix_tokens.count_tokens(nothing, model).count() == 0
