"""Stages of the pipeline on the smallest table and on odd rows."""

import re
from collections import Counter

import corpus_pipeline as cp
from barspark.llm import queries, simhash


def test_stages(spark, sf):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "language_id", "line_dedup", "near_dedup", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, kept = docs.columns, {}
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, sf)
        assert docs.columns == names, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert kept[name].keys() <= before.keys()
        if name == "quality_rules":
            for i, r in before.items():
                words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
                if len(words) < 50:
                    assert i not in kept[name]
        if name == "language_id":
            same = [kept[name][i].lang == before[i].lang for i in kept[name] if before[i].lang]
            assert sum(same) >= 0.9 * len(same) and len(kept[name]) >= 0.95 * len(before)
        if name == "line_dedup":
            lines = Counter()
            for r in kept[name].values():
                own = {x.strip(" \t\n\r\x0b\x0c").lower() for x in r.text.split("\n")}
                lines.update(x for x in own if len(x) >= 10 and x.isascii())
                assert r.n_chars == len(r.text)
            assert not lines or max(lines.values()) == 1
        if name == "near_dedup":
            prints = [simhash.fingerprint(r.text.encode(), 5) for r in kept[name].values()]
            assert all(((a ^ b) & (1 << 64) - 1).bit_count() > 3 for k, a in enumerate(prints) for b in prints[:k])
    packed = cp.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == set(kept["near_dedup"])


def test_odd_rows(spark, sf):
    long = " ".join(f"word{i % 97} und the {i}" for i in range(400))
    rows = [(1, long, "en", "s", 5), (1, long, "en", "s", 5), (None, long, None, None, None), (2, None, "en", "s", 0), (3, "", None, "s", None), (4, long.upper(), "de", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, stage in cp.STAGES:
            out = stage(spark, table, sf)
            table = spark.createDataFrame(out.collect(), out.schema)


def test_registered_queries(spark):
    found = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(found)


def test_clashing_names_pass_through(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: cp.F.concat(cp.F.lit("own "), cp.F.col("doc_id").cast("string")) for c in ("kept", "Kept_Text", "n_lines", "lang_pred", "lang_lead", "fp", "_id", "_text", "c1", "own_7")})
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        for r in docs.collect():
            assert r.kept == r.Kept_Text == r.fp == r._id == r.c1 == r.own_7 == f"own {r.doc_id}", name


def test_foreign_and_mixed_documents_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and length(text) > 600")
    clean = docs.select("doc_id", "text", "lang", "source", "n_chars")
    text = {r.lang: r.text for r in clean.where("lang in ('en', 'es', 'de')").groupBy("lang").agg(cp.F.min("text").alias("text")).collect()}
    n = min(map(len, text.values()))
    foreign = "Kymmenen iloista hiirta juoksi metsan lapi ja loysi suuren juuston kannon alta eika kukaan tiennyt mista se oli tullut. " * 6
    planted = [(-1, text["en"][:n] + " " + text["es"][:n], "en"), (-2, text["de"][:n] + "\\n" + text["en"][:n], "de"), (-3, foreign, "en"), (-4, "1234 5678 " * 60, "en")]
    rows = spark.createDataFrame([(*x, "s", len(x[1])) for x in planted], clean.schema)
    kept = {r.doc_id for r in cp.language_id(spark, clean.union(rows), "").collect()}
    assert not kept & {-1, -2, -3, -4}
    assert len(kept) >= 0.98 * clean.count()
