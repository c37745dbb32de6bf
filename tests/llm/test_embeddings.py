import math

import numpy as np
import pytest

from barspark.llm import embeddings


def brute(rows, cosine=0.93):
    good = []
    for k, (i, label, e) in enumerate(rows):
        if label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e):
            good.append((k, label, np.array(e, float)))
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            (k, p, x), (m, q, y) = good[a], good[b]
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                n[k] += 1
                n[m] += 1
                root[max(find(k), find(m))] = min(find(k), find(m))
    low = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, n[k], low.get(find(k)), i is not None and i == low[find(k)]) for k, (i, _, _) in enumerate(rows)), key=str)


def rows(dims=24, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(25):
        center = rng.standard_normal(dims)
        for _ in range(10):
            v = (center + rng.standard_normal(dims) * rng.choice([0.02, 0.2, 0.27, 0.3])).astype(np.float32).tolist()
            out.append((len(out), int(c % 3), v))
    same = rng.standard_normal(dims).astype(np.float32).tolist()
    out += [(len(out) + k, 1, same) for k in range(6)] + [(900, None, same), (901, 2, same), (902, 1, None), (903, 1, [0.0] * dims), (904, 1, []), (905, 1, [float("nan")] + same[1:]), (906, 1, [None] + same[1:]), (907, 1, same[:5]), (908, 1, [float("inf")] + same[1:])]
    return out + [(908, 1, same), (None, 1, same), (None, 0, [1.0] * dims)]


@pytest.mark.parametrize("homes", [2048, 40, 7])
def test_against_brute_force(spark, homes):
    data = rows()
    df = spark.createDataFrame([(*r, 1) for r in data], "vec_id long, label int, embedding array<float>, n int")
    got = embeddings.near_duplicates(df, homes=homes).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == brute(data)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert embeddings.near_duplicates(df).count() == 0


def test_a_cosine_too_close_to_one_is_refused():
    with pytest.raises(ValueError):
        list(embeddings._cells(np.eye(8), 1 - 1e-9))
