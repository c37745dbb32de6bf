import itertools
import zlib

import numpy as np
import pytest

from barspark.llm import langid


def brute(word, pieces, p, column):
    """The sum over all ways to cut a word."""
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        product = 1.0
        for i, j in zip(at, at[1:]):
            s = word[i:j]
            product *= p[pieces.index(s), column] if s in pieces else p[-1, column] if j - i == 1 else 0
        total += product
    return total


def test_sum_over_segmentations():
    pieces = ["a", "ab", "b", "ba", "▁", "▁a", "▁ab"]
    p = np.random.default_rng(0).random((8, 2))
    p /= p.sum(0)
    scorer = langid.Model(pieces, ["x", "y"], np.log(p)).scorer()
    words = ["a", "ab", "abba", "bac", "ccab"]
    got = scorer.words(words)
    for k, w in enumerate(words):
        for c in (0, 1):
            assert abs(got[k, c] - np.log(brute("▁" + w, pieces, p, c))) < 1e-9


def by_logs(word, pieces, p, column):
    """The log of the sum over all ways to cut a word, place by place."""
    at = [0.0]
    for e in range(1, len(word) + 1):
        terms = []
        for s in range(max(0, e - 4), e):
            part = word[s:e]
            if part in pieces:
                terms.append(at[s] + np.log(p[pieces.index(part), column]))
            elif e - s == 1:
                terms.append(at[s] + np.log(p[-1, column]))
        at.append(np.logaddexp.reduce(terms))
    return at[-1]


def test_long_words_are_summed_whole(monkeypatch):
    pieces = ["a", "ab", "b", "ba", "▁", "▁a", "▁ab"]
    p = np.random.default_rng(1).random((8, 2))
    p /= p.sum(0)
    p[-1] = 1e-9
    scorer = langid.Model(pieces, ["x", "y"], np.log(p)).scorer()
    letters = np.random.default_rng(2)
    words = ["".join(letters.choice(list("abc"), n)) for n in (1, 30, 31, 32, 33, 48, 63, 64, 65, 200, 999)] + ["ab" * 400]
    want = np.array([[by_logs("▁" + w, pieces, p, c) for c in (0, 1)] for w in words])
    assert np.allclose(scorer.words(words), want, rtol=1e-9)
    for together in (7, 50, 333):
        monkeypatch.setattr(langid, "TOGETHER", together)
        assert np.allclose(scorer.words(words), want, rtol=1e-9)
    monkeypatch.undo()
    assert np.isfinite(scorer.words(["ab" * 300_000])).all()


def test_fit_on_long_words_equals_fit_on_logs(spark):
    words = ["ab" * 60 + "ba", "ba" * 20]
    df = spark.createDataFrame([(k, w, "en") for k, w in enumerate(words)], "doc_id long, text string, lang string")
    pieces = ["a", "ab", "b", "ba", "▁", "▁a", "▁ab"]
    model = langid.fit(df, pieces=pieces)
    size = np.array([len(x) for x in pieces] + [1])
    p = 0.02 ** np.minimum(size, 4.0) + 1e-7
    p = (p / p.sum())[:, None]
    for _ in range(langid.ROUNDS):  # expected numbers are slopes of the log of the sum
        total = np.full(len(p), 0.02)
        for w in words:
            for k in range(len(pieces)):
                up, down = p.copy(), p.copy()
                up[k] *= np.exp(1e-5)
                down[k] *= np.exp(-1e-5)
                total[k] += (by_logs("▁" + w, pieces, up, 0) - by_logs("▁" + w, pieces, down, 0)) / 2e-5
        p = (total / total.sum())[:, None]
    assert np.allclose(np.exp(model.log_p[:, 0]), p[:, 0], rtol=1e-4)


def test_held_out_accuracy(spark, sf):
    got = langid.op6_langid(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    assert len(got) == len(docs)
    both = got.merge(docs, on="doc_id")
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id]).all()
    both = both[both.held_out & both.lang.notna() & both.text.notna()]
    assert (both.lang == both.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "the cat sat", "en"), (2, "der hund und", "de"), (3, None, "en"), (4, "12 !!", None), (None, "the dog", "en"), (1, "the cat sat", "en"), (5, "語" * 300, None), (6, "² ½ Ⅷ", None)], "doc_id long, text string, lang_pred string")
    model = langid.fit(df.withColumn("lang", F_col(df)), sample=10)
    got = langid.predict(df, model).collect()
    assert len(got) == 8 and {r.lang_pred for r in got if r.doc_id in (3, 4, 6)} == {"und"}
    assert [r.lang_pred for r in got if r.doc_id in (1, 2)] == ["en", "de", "en"]
    assert langid.predict(df.limit(0), model).count() == 0
    none = langid.fit(df.withColumn("lang", F_col(df)).limit(0))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}


def F_col(df):
    return df["lang_pred"]


def test_too_many_languages_are_refused(spark):
    rows = spark.range(1000).selectExpr("id as doc_id", "'some text' as text", "concat('l', id) as lang")
    with pytest.raises(ValueError, match="more than 256"):
        langid.fit(rows)


def test_recognised_keeps_columns_of_any_name(spark):
    rows = [("en", 0.9, 1.0, "x", "y", "z"), ("en", 0.9, 1.0, "x", "y", "z"), ("en", 0.9, 0.1, "x", "y", "z"), ("und", 0.0, None, "x", "y", "z")]
    df = spark.createDataFrame(rows, "lang_pred string, lang_score double, lang_lead double, _lang string, _usual string, c0 string")
    out = langid.recognised(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == rows[:2]
