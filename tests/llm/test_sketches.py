import random

import corpus_pipeline as cp
import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.llm import sketches
from barspark.llm.graph import components


def jaccard(a, b, words=5):
    x, y = (set(sketches.shingle_hashes(t.encode(), words).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


def corpus(seed=0, groups=60, length=200):
    """Texts, each with edits of it that keep from a little to nearly all of its shingles."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=length)
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4, 6, 12):
            own = list(base)
            for at in rng.sample(range(length), edits):
                own[at] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("homes", [4096, 2])
def test_recall_and_precision_against_all_pairs(spark, homes):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(3)
    root = {r.node: r.root for r in components(sketches.similar(df, homes=homes)).collect()}
    pairs = [(a, b, jaccard(texts[a], texts[b])) for k in range(0, len(texts), 7) for a in range(k, k + 7) for b in range(a + 1, k + 7)]
    alike = [(a, b) for a, b, j in pairs if j >= 0.8]
    met = sum(root.get(a, a) == root.get(b, b) for a, b in alike)
    assert len(alike) > 200 and met / len(alike) >= 0.95
    # what has nothing at 0.7 or more stays alone
    lone = [a for a in range(len(texts)) if max(j for x, y, j in pairs if a in (x, y)) < 0.7]
    assert lone and not any(a in root for a in lone)


def test_links_join_what_all_pairs_do():
    rng = np.random.default_rng(0)
    signs = rng.integers(0, 3, (120, sketches.PERMUTATIONS)).astype(np.uint8)
    for k in range(1, 120):
        if rng.random() < 0.7:
            signs[k] = np.where(rng.random(sketches.PERMUTATIONS) < 0.85, signs[rng.integers(0, k)], signs[k])

    def parts(links):
        label = list(range(120))
        for a, b in links:
            x, y = label[a], label[b]
            label = [min(x, y) if z in (x, y) else z for z in label]
        return label

    every = [(a, b) for a in range(120) for b in range(a) if (signs[a] == signs[b]).mean() >= 0.8]
    assert parts(zip(*sketches.linked(signs, 0.8))) == parts(every) and 5 < len(set(parts(every))) < 115


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (6, "one two three"), (7, "x " * 3000), (8, "x " * 3001)]
    df = spark.createDataFrame(rows, "node long, text string")
    got = {frozenset((r.a, r.b)) for r in sketches.similar(df).collect()}
    assert got == {frozenset((4, 5)), frozenset((7, 8))}
    assert sketches.similar(df.limit(0)).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    texts = corpus(3, groups=25)
    rows = [(len(texts) - k, t, "en") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.text for r in cp.near_dedup(spark, docs, "").collect()}
    ids = list(kept)
    near = [jaccard(kept[a], kept[b]) for k, a in enumerate(ids) for b in ids[:k]]
    assert max(near) < 0.85
    text = {i: t for i, t, _ in rows}
    for i, t in text.items():  # what is gone is like a document that stays, by way of others
        if i not in kept:
            assert max(jaccard(t, other) for k, other in text.items() if k != i) >= 0.7
    for k in range(0, len(texts), 7):
        assert len(texts) - k - 6 in kept or any(len(texts) - k - x in kept for x in range(7))


def test_rows_of_one_id(spark):
    """Each text stays once, whatever ids its rows have."""
    a, b = " ".join(f"a{k}" for k in range(80)), " ".join(f"b{k}" for k in range(80))
    for rows, want in (([(2, a), (2, b), (1, a)], {(1, a), (2, b)}), ([(1, a), (1, b), (2, b)], {(1, a), (1, b)}), ([(1, a), (1, a), (None, a), (2, a)], {(1, a), (None, a)})):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = [tuple(r) for r in cp.near_dedup(spark, docs, "").collect()]
        assert set(got) == want and len(got) == len(want)
