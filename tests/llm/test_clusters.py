"""The n-gram Jaccard join in clusters that no task holds whole: chains and bridges between balls."""

from __future__ import annotations

import random

import pytest

from millwright.llm.jaccard import jaccard_components, linked_across
from millwright.llm.shingles import shingle_sets


def brute(texts, width, percent):
    """Least id that each text reaches by links."""
    sets = {i: {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} for i, w in ((i, t.split()) for i, t in texts) if w}
    label = {i: i for i in sets}
    order = sorted(sets)
    for a in order:
        for b in order:
            if a < b and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if c == high else c for i, c in label.items()}
    return label


def found(spark, texts, **options):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    return {r["doc_id"]: r["component_id"] for r in jaccard_components(docs, shingle_words=4, percent=85, **options).collect()}


W = [f"v{k}" for k in range(400)]


@pytest.mark.parametrize("cluster_shingles", [50, 150])
def test_chains_hang_together(spark, cluster_shingles):
    texts = [(10 * j + k, " ".join(W[6 * k + 25 * j : 6 * k + 25 * j + 103])) for j in range(12) for k in range(4)]
    assert found(spark, texts, cluster_shingles=cluster_shingles) == brute(texts, 4, 85)
    if cluster_shingles == 50:
        return
    texts = [(j, " ".join(W[6 * j : 6 * j + 103])) for j in range(40)]  # one chain of forty
    assert set(found(spark, texts, cluster_shingles=cluster_shingles).values()) == {0}


@pytest.mark.parametrize("cluster_shingles", [300, 2500])
def test_made_up_clusters(spark, cluster_shingles):
    rng = random.Random(cluster_shingles)
    texts = []
    for i in range(160):
        at = rng.choice((0, 0, 0, 9, 14, 18, 60))
        words = W[at : at + 103]
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
            words[rng.randrange(len(words))] = f"u{rng.randrange(1000)}"
        texts.append((i, " ".join(words)))
    expected = brute(texts, 4, 85)
    assert len(set(expected.values())) > 3
    assert found(spark, texts, cluster_shingles=cluster_shingles) == expected


def test_balls_are_bridged_at_the_default_size(spark):
    texts = [(k, f"{' '.join(W[:103])} u{k}") for k in range(2100)] + [(5000 + k, f"{' '.join(W[18:121])} u{k}") for k in range(2100)]
    bridge = [(9000, " ".join(W[6:109])), (9001, " ".join(W[12:115]))]
    assert set(found(spark, texts + bridge).values()) == {0}
    assert set(found(spark, texts + bridge[:1]).values()) == {0, 5000}


def test_linked_across():
    rng = random.Random(3)
    texts = [" ".join(rng.choices("ab", k=12)) for _ in range(60)]
    hashes, offsets = shingle_sets(texts, 2)
    sets = [set(hashes[a:b].tolist()) for a, b in zip(offsets, offsets[1:])]
    expected = [next((i for i in range(25) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])), -1) for j in range(25, 60)]
    assert linked_across(hashes, offsets, 25, 85).tolist() == expected
