import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.llm import neighbours


def brute(rows, top=20):
    """{(query_id, vector): [(vec_id, score), ...]} of rows (vec_id, vector)."""
    good = {(i, tuple(e)) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)}
    out = {}
    for i, e in good:
        if i % 20 == 0:
            found = [(-float((np.array(e, np.float32).astype(float) * np.array(f, np.float32).astype(float)).sum()), j) for j, f in good if j != i and len(f) == len(e)]
            out[i, e] = [(j, -s) for s, j in sorted(found)[:top]]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, e, "x", 3) for i, e in rows], "vec_id long, embedding array<float>, node string, k int").repartition(3)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, **kw).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {i: [(v, s) for _, v, s in sorted(x)] for i, x in got.items()}, got


def recall(got, want):
    hit = all_ = 0
    for (i, _), found in want.items():
        if found:
            least = found[-1][1]
            hit += sum(s >= least - 1e-9 for _, s in got.get(i, []))
            all_ += len(found)
    return hit / all_


def floats(x):
    return np.asarray(x, np.float32).tolist()


def made(kind, n=1500, dims=24, seed=0):
    rng = np.random.default_rng(seed)
    if kind == "spread":
        x = rng.standard_normal((n, dims))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    elif kind == "norms":
        x = rng.standard_normal((n, dims)) * np.exp(rng.standard_normal((n, 1)) * 1.5)
    else:
        centers = rng.standard_normal((30, dims))
        x = centers[rng.integers(0, 30, n)] + rng.standard_normal((n, dims)) * 0.2
    return [(k, floats(v)) for k, v in enumerate(x)]


@pytest.mark.parametrize("kind,options", [("spread", {}), ("norms", {}), ("groups", {}), ("groups", {"sample": 150, "first": 2}), ("spread", {"sample": 200, "first": 2})])
def test_recall(spark, kind, options):
    rows = made(kind)
    got, ranks = run(spark, rows, **options)
    want = brute(rows)
    assert set(got) == {i for i, _ in want}
    assert all([r for r, _, _ in sorted(x)] == list(range(1, 21)) for x in ranks.values())
    assert recall(got, want) >= 0.95
    score = {i: np.array(e, np.float32).astype(float) for i, e in rows}
    for i, found in got.items():
        assert all(abs(s - score[i] @ score[v]) < 1e-9 and v != i for v, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("homes,probes", [(8192, 4096), (30, 7)])
def test_copies_ties_and_odd_rows(spark, monkeypatch, homes, probes):
    monkeypatch.setattr(neighbours, "HOMES", homes)
    monkeypatch.setattr(neighbours, "PROBES", probes)
    rng = np.random.default_rng(3)
    same, other = floats(rng.standard_normal(8)), floats(rng.standard_normal(8))
    rows = [(k, same) for k in range(0, 200)] + [(k, other) for k in range(200, 215)] + [(k, floats(np.eye(8)[k % 8])) for k in range(215, 330)]
    rows += [(k, floats(np.ones(3) * k)) for k in range(340, 345)] + [(360, [1.0]), (361, [2.0]), (380, [1.0, 2.0])]
    rows += [(400, None), (420, []), (440, [0.0] * 8), (460, [float("nan")] * 8), (480, [float("inf")] + same[1:]), (500, [None] + same[1:]), (None, same), (0, same), (20, same)]
    got, _ = run(spark, rows)
    want = brute(rows)
    assert set(got) == {i for (i, _), found in want.items() if found}
    for (i, _), found in want.items():
        if found:
            assert [v for v, _ in got[i]] == [v for v, _ in found], i
            assert np.allclose([s for _, s in got[i]], [s for _, s in found])


def test_empty_and_alone(spark):
    assert run(spark, []) == ({}, {})
    assert run(spark, [(20, [1.0, 2.0])]) == ({}, {})
    assert run(spark, [(None, None)]) == ({}, {})


@pytest.mark.parametrize("m", [2, 3, 5, 16, 21, 32])
@pytest.mark.parametrize("radius", [0, 1, 7, 16, 31, 47, 64])
def test_probing_finds_every_code_within_the_radius(m, radius):
    sizes = neighbours.split(m)
    assert sum(sizes) == 64
    rng = np.random.default_rng(radius)
    most = neighbours.flips(radius, sizes)
    for _ in range(200):
        flipped = np.zeros(64, bool)
        flipped[rng.choice(64, rng.integers(0, radius + 1), replace=False)] = True
        edges = np.cumsum([0, *sizes])
        assert any(flipped[a:b].sum() <= f for a, b, f in zip(edges, edges[1:], most))


def test_query_against_brute_force(spark, sf):
    from barspark.llm.queries import queries

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = {}
    for r in queries()["op12_nearest"](spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert recall(got, brute(rows)) >= 0.97


def test_doubles(spark):
    df = spark.createDataFrame([(k, [float(k % 7), 1.0]) for k in range(41)], "vec_id int, embedding array<double>")
    found = neighbours.nearest(df, F.col("vec_id") == 40, top=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == [(40, 1, 6, 31.0), (40, 2, 13, 31.0)]
