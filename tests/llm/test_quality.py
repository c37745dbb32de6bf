import re
from collections import Counter, defaultdict

import numpy as np

from barspark.llm import quality


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    hit = set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_rules():
    texts = [None, "", " \n ", "a b c a b c", "a a a a", "a b c d", "x\ny\nx\n \nx y", "#é* $\x85 <>\n", "one two three", "w " * 70, "a b c\x1cd a b c\x1cd"]
    for t in texts:
        assert quality.base_rules(t)[:5] == brute_rules(t), t


def brute_model(words):
    """Modified Kneser-Ney over letter 4-grams within words, written out; returns p(letter | three before)."""
    grams = {4: Counter()}
    for w, n in words.items():
        c = [0, 0, 32, *map(ord, w), 32]
        for i in range(3, len(c)):
            grams[4][(c[i - 3], c[i - 2], c[i - 1], c[i])] += n
    for k in (3, 2, 1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    d, by_context = {}, {}
    for k in (1, 2, 3, 4):
        n = [sum(v == i for v in grams[k].values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        d[k] = [0.0] + [max(0.1, min(i - 0.1, i - (i + 1) * y * (n[i + 1] / n[i] if n[i] else 1.0))) for i in (1, 2, 3)]
        by_context[k] = defaultdict(dict)
        for g, v in grams[k].items():
            by_context[k][g[:-1]][g[-1]] = v

    def p(context, letter):
        k = len(context) + 1
        below = p(context[1:], letter) if k > 1 else 1 / 65536
        seen = by_context[k].get(context)
        if not seen:
            return below
        total = sum(seen.values())
        mass = sum(d[k][min(v, 3)] for v in seen.values())
        v = seen.get(letter, 0)
        return (v - d[k][min(v, 3)]) / total + mass / total * below

    return p


def test_model_against_written_out_one(spark):
    texts = ["the cat sat on the mat then that", "a cat a hat é", "zz the the", None, "ab\tab\nab"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(9, "le chat est là", "fr"), (10, "no lang", None)], "doc_id long, text string, lang string")
    model = quality.train(df)
    p = brute_model(Counter(w for t in texts if t for w in t.split()))
    for word in ["the", "cat", "hat", "é", "unseen", "zzq", "ж"]:
        c = [0, 0, 32, *map(ord, word), 32]
        want = sum(np.log(p(tuple(c[i - 3 : i]), c[i])) for i in range(3, len(c)))
        got = model.word_scores("en", [word.encode()])[0]
        assert abs(got - want) < 1e-4, word
    assert model.word_scores("xx", [b"the"])[0] <= 4 * quality.UNSEEN * 0.99


def test_judge(spark):
    rng = np.random.default_rng(0)
    common = ["the", "reason", "of", "station", "and", "nation", "ration", "on", "a", "ratio"]
    rows = [(i, " ".join(rng.choice(common, 80)), "en", "keep") for i in range(60)]
    rows += [(100, " ".join("".join(chr(rng.integers(0x100, 0x2000)) for _ in range(9)) for _ in range(80)), "en", "x"), (101, None, "en", "x"), (102, "the of", "en", "x"), (103, "a b c d " * 30, "en", "x"), (None, " ".join(rng.choice(common, 80)), "en", "keep")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, mark string")
    # names that the operator uses itself
    df = df.withColumns({"kept": quality.F.lit("clash"), "N_Words": quality.F.lit(7), "_middle": quality.F.lit(0), "_lang": quality.F.lit("zz"), "c0": quality.F.lit(1)})
    judged = quality.judge(df)
    assert judged.columns == ["doc_id", "text", "lang", "mark", "_middle", "_lang", "c0", *quality.ADDED, "base_failed", "log_perplexity", "kept"]
    got = judged.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.kept == (r.mark == "keep"), r.doc_id
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert quality.judge(df.limit(0)).count() == 0


def prose(rng, n):
    """Sentences of adjective, noun and verb, which show in the words' beginnings and ends."""
    body = ["mar", "sel", "tor", "lin", "ban", "der", "gal", "hem", "rin", "sol", "wit", "pel"]
    parts = [("gra", "ous"), ("sta", "tion"), ("be", "eth")]
    return [parts[i % 3][0] + body[rng.integers(12)] + body[rng.integers(12)] + parts[i % 3][1] for i in range(n)]


def test_junk_and_word_salad_are_rejected(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(prose(rng, int(rng.integers(60, 400)))), "en", "keep") for i in range(150)]
    # the words of prose in any order: only what meets at the blanks tells
    rows += [(200 + i, " ".join(rng.permutation(prose(rng, 300))), "en", "salad") for i in range(10)]
    # more than 5 % junk on either side, which percentile bands would take in
    rows += [(300 + i, " ".join("".join(rng.choice(list("qxzjkvw"), 7)) for _ in range(200)), "en", "junk") for i in range(15)]
    rows += [(400, " ".join(f"avec{k} une{k} autre{k}" for k in range(40)), "en", "foreign")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, mark string")
    got = quality.judge(df).toPandas()
    assert not got.base_failed.any()
    kept = got.groupby("mark").kept.mean()
    assert kept[["salad", "junk", "foreign"]].eq(0).all(), kept
    assert got[got.mark == "keep"].kept.mean() >= 0.98


def test_grams_across_blanks_against_written_out_ones(spark):
    texts = ["the cat sat on a mat", "a b", "é", "on the mat\n\nthe cat"]
    want = Counter()
    for t in texts:
        before = ""
        for w in t.split():
            c = [0, 0, *map(ord, before)][-2:] + [32, *map(ord, w), 32]
            for i in range(3, len(c)):
                want[sum(x << 16 * (3 - k) for k, x in enumerate(c[i - 3 : i + 1]))] += 1
            before = w
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = quality.count_grams(df, "text", quality.F.lit("en"), across=True).collect()
    assert {r.gram & (1 << 64) - 1: r.n for r in got} == want


def test_unseen_words_of_a_large_model_back_off(spark):
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 6))) for _ in range(30_000)]
    df = spark.createDataFrame([(" ".join(words[i : i + 300]), "zh") for i in range(0, len(words), 300)], "text string, lang string")
    p = brute_model(Counter(words))
    unseen = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 6))) for _ in range(20)]
    got = quality.train(df).word_scores("zh", [w.encode() for w in unseen])
    for w, x in zip(unseen, got):
        c = [0, 0, 32, *map(ord, w), 32]
        assert abs(x - sum(np.log(p(tuple(c[i - 3 : i]), c[i])) for i in range(3, len(c)))) < 1e-4, w


def test_blocks_measure_as_the_broadcast_does(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("more", quality.F.create_map(quality.F.lit("k"), quality.F.col("doc_id")))
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumns({"text": quality.F.lit(None).cast("string"), "lang": quality.F.lit(None).cast("string")}))
    model = quality.train(docs, across=True)
    monkeypatch.setattr(quality, "BLOCK_LETTERS", 100_000)
    a, b = (sorted(map(repr, quality.measure(docs, model, most=most).collect())) for most in (1 << 40, 0))
    assert a == b and len(a) == docs.count()
