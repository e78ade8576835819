"""Signatures and classes of near-duplicates."""

from collections import Counter
from itertools import combinations

import numpy as np

from limbwise.llm import components, neardup
from limbwise.llm.words import HashCache
from tests.llm.cases import BASE, ROWS, crowded, docs, words


def shingled(text):
    found = words(text)
    return Counter(tuple(found[i:i + 5]) for i in range(max(1, len(found) - 4))) if found else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def test_signatures_estimate_the_weighted_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        hits = truth = 0.0
        for _ in range(40):
            values = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
            a = rng.integers(1, 9, 300)
            b = np.where(rng.random(300) < share, a, rng.integers(1, 9, 300))
            owner = np.repeat([0, 1], 300)
            s = neardup.signatures(np.concatenate((values, values)), np.concatenate((a, b)), owner, 2)
            hits += (s[0] == s[1]).mean()
            truth += np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs(hits - truth) / 40 < 0.02


def test_similarity_and_sets_agree_with_counters():
    rng = np.random.default_rng(2)
    cache = HashCache(most=3)
    texts = [" ".join(map(str, rng.integers(0, 4, n))) for n in (3, 5, 40, 60, 200)] + [BASE, BASE.replace("alpha9 ", "")]
    parts = [neardup.shingles(words(t), cache) for t in texts]
    for i, j in combinations(range(len(texts)), 2):
        truth = jaccard(shingled(texts[i]), shingled(texts[j]))
        assert abs(neardup.similarity(parts[i], parts[j]) - truth) < 1e-12
        x, y = neardup.expanded(parts[i]), neardup.expanded(parts[j])
        assert abs(len(x & y) / len(x | y) - truth) < 1e-12


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (3, 4), (4, 5), (5, 6), (6, 7), (20, 20)] + [(100, 100 + k) for k in range(1, 50)]
    frame = spark.createDataFrame(edges, "u bigint, v bigint")
    out = {r["node"]: r["label"] for r in components.components(frame).collect()}
    assert out == {**{n: 1 for n in range(1, 8)}, 10: 10, 11: 10, **{100 + k: 100 for k in range(50)}}
    assert components.components(frame.limit(0)).count() == 0


def test_classes_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [f"v{x}" for x in rng.integers(0, 900, 150)]
    texts = []
    for k in range(120):   # a group whose members differ by few or many words, so some are linked only through others
        copy = list(base)
        for at in rng.integers(0, 150, k % 9):
            copy[at] = f"n{k}_{at}"
        texts.append(" ".join(copy))
    texts += [" ".join(f"u{x}" for x in rng.integers(0, 5000, 80)) for _ in range(60)] + ["one two", "one two", "two one"]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    sets = [shingled(t) for t in texts]
    for i, j in combinations(range(len(texts)), 2):
        if jaccard(sets[i], sets[j]) >= 0.8:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    out = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert out == {i: root(i) for i in range(len(texts))}


def test_odd_rows(spark):
    out = neardup.near_duplicates(crowded(spark)).collect()
    assert len(out) == len(ROWS)
    ids = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in out}
    assert ids[6] == ids[7] == ids[8] == (6, 3) and ids[9] == (9, 2) and ids[2] == (2, 1) and ids[3] == (3, 1) and ids[None] == (None, 1)
    kept = neardup.one_per_class(crowded(spark))
    assert kept.columns == crowded(spark).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 4, 5, 6, 9, None, 10, 11])
    assert neardup.near_duplicates(docs(spark, [])).count() == 0 and neardup.one_per_class(docs(spark, [])).count() == 0
