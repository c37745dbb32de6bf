import numpy as np
import pytest
import xxhash

from barspark.llm import sharding


def brute(shards, slots):
    orders = []
    for s in shards:
        a, b = sharding._number(f"start:{s}") % slots, sharding._number(f"skip:{s}") % (slots - 1) + 1
        orders.append([(a + i * b) % slots for i in range(slots)])
    table = [None] * slots
    while None in table:
        for k, order in enumerate(orders):
            if None in table:
                table[next(s for s in order if table[s] is None)] = k
    return table


def test_turns_and_balance():
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 101)
    assert table.tolist() == brute(names, 101)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1


def test_removal_moves_few_slots():
    names = [f"s{i}" for i in range(20)]
    before, after = sharding.lookup_table(names, 5003), sharding.lookup_table(names[:-1], 5003)
    stayed = before != 19
    assert (before[stayed] != after[stayed]).mean() < 0.15


def test_bad_arguments():
    for shards, slots in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(shards, slots)


def test_place(spark):
    rows = [(1, "x"), (1, "y"), (None, "z"), (-5, None), (10**12, "s")]
    df = spark.createDataFrame(rows, "doc_id long, shard string")
    names = ["a", "b", "c"]
    table = brute(names, 31)
    got = sharding.place(df, "doc_id", names, 31).collect()
    assert len(got) == 5
    for r in got:
        h = 42 if r.doc_id is None else xxhash.xxh64_intdigest(int(r.doc_id).to_bytes(8, "little", signed=True), 42)
        assert (r.slot, r.shard) == (h % 31 if h < 1 << 63 else (h - (1 << 64)) % 31, names[table[r.slot]])
    assert sharding.place(df.limit(0), "doc_id").count() == 0


def test_write_shards(spark, tmp_path):
    rows = [(7, f"hot {i}", i, "old") for i in range(900)] + [(i, f"row {i}", i, None) for i in range(300)] + [(None, None, 1, "x"), (None, None, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot long, shard string").repartition(3)
    names = [f"s{i}" for i in range(5)]
    got = sharding.write_shards(df, "doc_id", f"file://{tmp_path}/out", names, 31)
    want = sharding.place(df, "doc_id", names, 31)
    assert got.columns == ["doc_id", "text", "slot", "shard"]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    # the hot key's shard is dealt over files, none of which holds most of it
    hot = got.where("doc_id = 7").select("shard").first()[0]
    sizes = [spark.read.parquet(f"file://{f}").count() for f in (tmp_path / "out" / f"shard={hot}").glob("*.parquet")]
    assert len(sizes) >= 3 and max(sizes) <= sum(sizes) / 2
    assert {p.name for p in (tmp_path / "out").glob("shard=*")} == {f"shard={r.shard}" for r in want.select("shard").distinct().collect()}
    empty = sharding.write_shards(df.limit(0), "doc_id", f"file://{tmp_path}/none", names, 31)
    assert empty.count() == 0 and empty.columns == got.columns
    same = sharding.write_shards(df.drop("slot"), "shard", f"file://{tmp_path}/by_shard", names, 31)
    assert same.columns == ["doc_id", "text", "shard", "_slot", "_shard"] and same.count() == len(rows)


def test_query(spark, sf):
    got = sharding.op7_sharding(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").toPandas()
    table = sharding.lookup_table(sharding.SHARDS)
    slot = [xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 42) for i in docs.doc_id]
    want = {(int(i), sharding.SHARDS[table[(h if h < 1 << 63 else h - (1 << 64)) % sharding.SLOTS]]) for i, h in zip(docs.doc_id, slot)}
    assert set(zip(got.doc_id, got.shard)) == want


def test_columns_of_any_name_pass_through(spark, tmp_path):
    names = ["_slot", "_shard", "_part", "_parts", "part", "parts", "c0", "c1", "slot", "shard"]
    df = spark.createDataFrame([(k, *[f"{n}{k}" for n in names]) for k in range(40)], ["key", *names])
    for out in (sharding.place(df, "key", ["a", "b", "c"], 101), sharding.write_shards(df, "key", str(tmp_path / "shards"), ["a", "b", "c"], 101)):
        assert out.columns == ["key", *names[:-2], "slot", "shard"]
        rows = out.collect()
        assert sorted(r.key for r in rows) == list(range(40))
        for r in rows:
            assert all(r[n] == f"{n}{r.key}" for n in names[:-2])
            assert 0 <= r.slot < 101 and r.shard in "abc"
    by = df.withColumnRenamed("shard", "other").withColumnRenamed("key", "shard").drop("_slot", "_shard")
    assert sharding.write_shards(by, "shard", str(tmp_path / "by"), ["a"], 7).columns == [*by.drop("slot").columns, "_slot", "_shard"]
