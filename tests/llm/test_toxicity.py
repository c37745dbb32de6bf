import time
import zlib
from itertools import product

from barspark.llm import toxicity as tox


def letters():
    words = "the idiot moron loser scum a stupid cat sat worthless trash other words here nothing special about letters".split()
    counts = {}
    for w in words:
        w = "  " + w + " "
        for i in range(len(w) - 2):
            counts[w[i : i + 3]] = counts.get(w[i : i + 3], 0) + 5
    return tox.Letters(counts)


def brute(chunk, model):
    best = None
    for path in product(*tox.lattice(chunk)):
        context, s = "  ", 0.0
        for emitted, cost in path:
            s += cost
            for c in emitted:
                s += model.log_p(context, c)
                context = context[1] + c
        s += model.log_p(context, " ")
        if best is None or s > best[0]:
            best = (s, "".join(e for e, _ in path))
    return best[1]


def test_viterbi_is_the_best_path():
    model = letters()
    for chunk in ["1d10t", "m0r0n", "$cum", "l0$3r", "sttupiiid", "i d i o t", "tr@sh!", "7h3", "w0r+hle55"]:
        assert tox.decode(chunk, model) == brute(chunk, model)


def test_restores_disguises():
    model = letters()
    for text, word in [("an 1d10t!", "idiot"), ("M0R0N", "moron"), ("you $cum.", "scum"), ("stuuuupid", "stupid"), ("i d i o t", "idiot"), ("m.o.r.o.n", "moron"), ("l-0-s-e-r", "loser"), ("tr@$h,", "trash"), ("idiot###", "idiot"), ("idiiiiot", "idiot")]:
        assert word in tox.restore(text, model), text
    assert set(tox.restore("The cat sat", model)) == {"the", "cat", "sat"}


def test_restores_disguises_at_the_ends(monkeypatch):
    counts = {}
    for w in "ass piss shit stupid idiot cunt bull a pi bu the cat sat it in at".split():
        w = "  " + w + " "
        for i in range(len(w) - 2):
            counts[w[i : i + 3]] = counts.get(w[i : i + 3], 0) + 500
    model = tox.Letters(counts)
    for text, word in [("a$$", "ass"), ("pi$$", "piss"), ("shi+", "shit"), ("stupi|)", "stupid"), ("|diot", "idiot"), ("(unt", "cunt"), ("bu11", "bull"), ("a55", "ass"), ("iddiioott", "idiot"), ("a s s", "ass"), ("a.s.s", "ass")]:
        assert word in tox.restore(text, model), (text, tox.restore(text, model))
    for chunk in ["stupi|)", "a$$", "iddiioott"]:
        assert tox.decode(chunk, model) == brute(chunk, model)
    scorer = tox.Scorer(tox.Model(counts, {tox.features("ass")[0]: 5.0}))
    assert scorer.row("a s s")[0] == 5.0 and scorer.row("a s t")[0] == 0.0


def test_long_stretches_are_decoded_whole():
    model = letters()
    spaced = " ".join("thestupidmoronsatthecatsatthestupididiot")
    assert "idiot" in tox.decode(spaced, model).split() or "idiot" in tox.decode(spaced, model)
    # any cut into stretches breaks one of many copies
    for n in (7, 12, 13, 20, 60):
        assert tox.decode("1d10t" * n, model) == "idiot" * n
    assert tox.decode("1d10t" * 20_000, model) == "idiot" * 20_000


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = tox.op3_toxicity(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    both = got.merge(labels, on="doc_id")
    both = both[both.held_out]
    toxic, clean = both[both.toxic == 1], both[both.toxic == 0]
    order = both.score.rank()
    auc = (order[both.toxic == 1].sum() - len(toxic) * (len(toxic) + 1) / 2) / len(toxic) / len(clean)
    print("held out", len(both), "auc", auc, "recall", toxic.predicted.mean(), "false", clean.predicted.mean())
    assert auc > 0.97 and toxic.predicted.mean() > 0.9 and clean.predicted.mean() < 0.02


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, "you idiot moron" if i % 3 == 0 else "a cat sat here", "x") for i in range(60)] + [(None, "idiot", "x"), (70, None, "x"), (71, "", "x"), (71, "", "x"), (72, "1d10t " * 3000, "x")], "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (3, None), (6, 0)], "doc_id long, toxic int")
    model = tox.train(docs, labels)
    got = tox.score(docs, model)
    assert got.columns == ["doc_id", "text", "toxicity"] and got.count() == 65
    assert tox.score(docs.limit(0), model).count() == 0
    assert tox.score(docs, tox.train(docs, labels.limit(0))).where("toxicity >= 0.5").count() == 0


def test_long_texts_take_linear_time():
    model = letters()
    scorer = tox.Scorer(tox.Model(dict(model.three), {tox.features("idiot")[0]: 5.0}))
    began = time.time()
    for text in ["x" * 1_000_000, "a" * 500_000 + "1" * 500_000, "i d i o t " * 200_000, "1d10t" * 200_000, "ab" * 500_000, "a1" * 500_000, "(" * 1_000_000, "a." * 500_000]:
        assert 0 <= scorer.scores([text])[0] <= 1
    assert time.time() - began < 120


def test_letters_are_counted_over_all_texts(spark):
    docs = spark.createDataFrame([(1, "Idiot idiot"), (2, "ΑΒ 漢"), (3, None), (None, "idiot"), (3, "")], "doc_id long, text string")
    got = tox.count_letters(docs)
    assert got["  i"] == 3 and got["ot "] == 3
    assert got["  ?"] == 2 and got[" ??"] == 1 and got["?? "] == 1
    model = tox.Letters(got)
    assert model.log_p("  ", "β") == model.log_p("  ", "漢") == model.log_p("  ", "?")
    assert tox.count_letters(docs.limit(0)) == {}
