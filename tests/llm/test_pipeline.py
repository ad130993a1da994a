"""The pipeline's stages on edge cases, and run() against brute force."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
from lodestone.llm import quality

from ..conftest import SF_DIR
from .test_operators import WORD, shingles, slow_classes, slow_runs


def test_stages_keep_columns(spark, edges, nothing):
    for docs in (edges, nothing):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF_DIR)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == edges.columns
                docs = spark.createDataFrame(out.collect(), edges.schema)
        assert (out.count() > 0) == (docs.count() > 0)


def test_run_against_brute_force(spark):
    docs = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    clean = {}
    for i, (text, source) in docs.items():
        row = quality.judge(text, quality.LineRules())
        if row[9]:
            clean[i] = row[10]
    gone = slow_runs([(i, t) for i, t in clean.items()])
    left = {}
    for i, t in clean.items():
        kept = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t])
        if not gone[i, t] or WORD.search(kept):
            left[i] = kept
    ids = sorted(left)
    sets = [shingles(left[i]) for i in ids]
    label = slow_classes([(i, left[i]) for i in ids], lambda a, b: bool(sets[a]) and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])))
    unique = {ids[c] for c in label}

    got = corpus_pipeline.run(spark, SF_DIR).collect()
    words = Counter()
    for r in got:
        words[r.doc_id, r.copy] += r.words
    # What is packed are whole copies of what near_dedup kept, at most three of each.
    assert {i for i, _ in words} <= unique
    assert all(n == len(WORD.findall(left[i])) for (i, _), n in words.items())
    assert max(Counter(i for i, _ in words).values()) <= 3
    taken, have = defaultdict(int), defaultdict(int)
    for (i, _), n in words.items():
        taken[docs[i][1]] += n
    for i in unique:
        have[docs[i][1]] += len(WORD.findall(left[i]))
    assert sum(taken.values()) > 0.8 * sum(have.values())
    fill = defaultdict(int)
    for r in got:
        if r.words:
            fill[r.pack, r.bin, r.bin_length] += r.words
    assert all(n <= k[2] for k, n in fill.items())
