import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from barspark.llm import bpe, packing

PATH = bpe.public_vocabulary()


@pytest.mark.parametrize("lengths", [[], [1], [64], [40, 30, 24, 24, 10], list(range(1, 65)) * 3, [33] * 9, [21] * 50 + [22] * 7 + [1] * 300])
def test_plan_uses_every_length_once(lengths):
    made = packing.plan(dict(Counter(lengths)), 64, 16)
    used = Counter()
    for own, n in made:
        assert 0 < sum(own) <= 64 and n > 0
        for x in own:
            used[x] += n
    assert used == Counter(lengths)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    lengths = Counter((np.minimum(rng.exponential(900, 40000), 4095).astype(int) + 1).tolist())
    made = packing.plan(lengths)
    assert sum(n for _, n in made) <= 1.002 * sum(k * v for k, v in lengths.items()) / 4096 + 1


def test_least_squares():
    a, b = np.array([[1.0, 0, 1], [0, 2, 1], [1, 1, 0]]), np.array([3.0, 1, -1])
    x = packing.non_negative_least_squares(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and (slope <= 1e-8).all() and np.abs(slope[x > 0]).max() < 1e-8


def test_documents(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "x1"]) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (None, "some text"), (202, "same"), (202, "same"), (203, "word " * 500)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, length string")
    got = packing.pack_documents(df, PATH, capacity=64).collect()
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 64):
            own = np.array(ids[k : k + 64], "<u4").tobytes()
            want[i, k // 64, k, len(own) // 4, zlib.crc32(own)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= 1.1 * sum(r.length for r in got) / 64 + 1


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_columns_of_any_name(spark):
    names = ["_part", "_rank", "_spread", "c0", "sequence_id"]
    df = spark.createDataFrame([(k % 7 + 1, *[f"{n}{k}" for n in names], k) for k in range(60)], ["length", *names, "id"])
    out = packing.pack(df.withColumn("length", df.length.cast("long")), 8)
    assert out.columns == ["length", *names[:-1], "id", "sequence_id", "offset"]
    rows = out.collect()
    assert sorted(r.id for r in rows) == list(range(60)) and all(r[n] == f"{n}{r.id}" for r in rows for n in names[:-1])
