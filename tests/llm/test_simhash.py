import random

import numpy as np
import pandas as pd
import xxhash

from barspark.llm import simhash


def brute(texts):
    out = []
    for t in texts:
        words = (t or "").encode().lower().split()
        got = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        ones = [0] * 64
        for g in got:
            h = xxhash.xxh64_intdigest(g, 42)
            for b in range(64):
                ones[b] += h >> b & 1
        out.append(sum(1 << b for b in range(64) if got and 2 * ones[b] > len(got)))
    return out


def component(prints, ids):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i in range(len(prints)):
        low[find(i)] = min(low.get(find(i), 1 << 64), ids[i])
    return [low[find(i)] for i in range(len(prints))]


def test_covering_meets_every_close_pair():
    rng = random.Random(3)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(1, 3)):
            y ^= 1 << b
        fp = np.array([x, y], np.uint64).view(np.int64)
        key, copy, row = simhash.covering(fp)
        homes = [set(key[(row == k) & ~copy].tolist()) for k in (0, 1)]
        every = [set(key[row == k].tolist()) for k in (0, 1)]
        assert homes[0] & every[1] or homes[1] & every[0]


def check(spark, texts, ids, **more):
    df = spark.createDataFrame(pd.DataFrame({"doc_id": ids, "text": texts, "fp": 1, "root": "x"}))
    got = {}
    for r in simhash.near_duplicates(df).collect():
        got[r.doc_id] = (r.fp % (1 << 64), r.component_id)
    prints = brute(texts)
    want = dict(zip(ids, zip(prints, component(prints, ids))))
    assert got == want


def test_against_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "one", "ONE", "one two", "É é\x0bx", "a b c", "A  B\nC"]
    for _ in range(12):
        base = [f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 120))]
        for _ in range(8):
            near = list(base)
            near[rng.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
    check(spark, texts, list(range(len(texts))))


def test_crowded_anchor_is_split(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = sorted({base ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(60)} | {rng.getrandbits(64) for _ in range(40)})
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    from barspark.llm.graph import components

    got = {r.node: r.root for r in components(simhash.links(df, homes=5)).collect()}
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    want = dict(zip(signed, component(prints, signed)))
    counts = pd.Series(want).value_counts()
    assert got == {k: v for k, v in want.items() if counts[v] > 1}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c"), (None, "other words here now")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(df).collect() if r.component_id)
    assert got == [(0, 7), (7, 7), (7, 7)]
