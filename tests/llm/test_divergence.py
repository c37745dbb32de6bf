import re
from collections import Counter, defaultdict

import pytest

from barspark.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, term string, digest int, n_chars int"


def brute(rows, top=200):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        own = TERM.findall((text or "").translate(LOWER))
        n[lang, source].update(own)
        docs[lang].update(set(own))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in docs[lang].items() if k >= 3]
        total = Counter({t: sum(n[lang, s][t] for s in sources) for t in kept})

        def shares(count):
            size = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // size for t in kept}

        p, q = {s: shares(n[lang, s]) for s in sources}, shares(total)
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def made(seed=1):
    import random

    rng = random.Random(seed)
    words = ["The", "the", "Été", "naïve", "a", "b", "zz", "汉字", "x-y", "don't", "É", "\U0001f600", "q r", "\x7f", "abc123def", *(f"w{chr(97 + k)}" for k in range(26))]
    rows = []
    for k in range(160):
        lang = rng.choice(["en", "en", "de", None, ""])
        source = rng.choice(["s0"] * 6 + ["s1", "s2", None, "S", "é"])
        rows.append((" ".join(rng.choices(words, k=rng.choice([0, 1, 5, 30, 90]))), lang, source))
    return rows + [(None, "fr", "s0"), ("", "fr", None), ("only once here", "fr", "s1"), ("1 2 3 !", "xx", "lonely"), ("same same", "yy", "a"), ("same", "yy", "a"), ("same", "yy", "b")] + rows[:9] * 3


def frame(spark, rows):
    return spark.createDataFrame([(k, *r, "own", k, None) for k, r in enumerate(rows)], SCHEMA).repartition(3)


@pytest.mark.parametrize("bits,top,most", [(64, 200, 1000), (64, 3, 4), (4, 200, 1000), (2, 5, 1000)])
def test_against_brute_force(spark, bits, top, most):
    rows = made()
    got = divergence.audit(frame(spark, rows), bits=bits, top=top, most=most).collect()
    assert sorted((r.lang, r["source"], r.part, r["item"], r.value, r["rank"]) for r in got) == brute(rows, top)


def test_tasks_that_send_on_what_they_hold(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 7)
    rows = made(2)
    got = divergence.audit(frame(spark, rows), bits=5).collect()
    assert sorted((r.lang, r["source"], r.part, r["item"], r.value, r["rank"]) for r in got) == brute(rows)


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 10)
    for text in ("", "   ", "abc", "a" * 35, "ab " * 20, "x" * 12 + " yy " + "é" * 30 + " end", " " * 25 + "b", "0123456789abc", "abcdefghij klmnopqrst u"):
        assert [w.decode() for part in divergence._terms(text.encode()) for w in part] == TERM.findall(text), text


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_term_is_kept(spark):
    rows = [("a b", "en", "s"), ("c", "en", "t"), (None, "en", "u")]
    got = divergence.audit(frame(spark, rows)).collect()
    assert sorted((r.lang, r["source"], r.part, r["item"], r.value, r["rank"]) for r in got) == brute(rows)
    assert len(got) == 6 and all(r.value == 0 for r in got)


def test_shares_are_exact():
    import numpy as np

    rng = np.random.default_rng(0)
    of = np.concatenate([rng.integers(1, 50, 500), rng.integers(1, 2**53, 500)])
    n = np.minimum(np.concatenate([rng.integers(1, 50, 500), rng.integers(1, 2**53, 500)]), of)
    assert divergence.share(n, of).tolist() == [1 + 10**9 * int(a) // int(b) for a, b in zip(n, of)]


def test_query_and_its_twin(spark, sf):
    import duckdb

    from barspark.llm.queries import oracle_sql, queries

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = queries()["op11_source_divergence"](spark, sf)
    want = c.execute(oracle_sql()["op11_source_divergence"])
    names = [d[0] for d in want.description]
    assert sorted(tuple(r[n] for n in names) for r in found.collect()) == sorted(want.fetchall())
