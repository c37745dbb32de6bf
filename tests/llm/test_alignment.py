import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barspark.llm import alignment
from barspark.llm.bpe import _byte_letters, public_vocabulary

_loaded = []


def tokens(text):
    """(ids, bytes) of both tokenizers over the whole text at once; None if bytes do not come back."""
    if not _loaded:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(public_vocabulary(alignment.TOKENIZER_A))
        a.encode_special_tokens = True
        _loaded.extend([a, SentencePieceProcessor(model_file=public_vocabulary(alignment.TOKENIZER_B)), {c: b for b, c in _byte_letters().items()}])
    a, b, byte = _loaded
    if not text:
        return None
    own_a = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    own_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    data = (" " + text).encode()
    return None if b"".join(x for _, x in own_a) != data or b"".join(x for _, x in own_b) != data else (own_a, own_b)


def places(own):
    at, out = 0, []
    for i, x in own:
        out.append((at, at + len(x), i))
        at += len(x)
    return out


def brute(texts):
    rows, count = [], Counter()
    for t in texts:
        got = tokens(t)
        if got is None:
            rows.append(None)
            continue
        a, b = map(places, got)
        links = [(i, j) for s, e, i in a for u, v, j in b if s < v and u < e]
        count.update(links)
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, lo = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for s, e, i in a if lo < e <= c) + "|" + ",".join(str(i) for s, e, i in b if lo < e <= c))
            lo = c
        rows.append((len(a), len(b), cuts, links, ";".join(groups)))
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    zero = (0, 0, 0, 0, 0, 0, "", [])
    return [zero if r is None else (r[0], r[1], len(r[2]), len(r[3]), sum(count[x] == best[x[1]] for x in r[3]), sum(count[x] for x in r[3]), r[4], r[2]) for r in rows]


TEXTS = [
    None, "", " ", "   ", "a", "a  b", " a", "a ", "a\nb c\n\nd", "word word word", "The quick brown fox, the lazy dog's tail.", "naïve café — déjà vu", "汉字 and 😀😀 mixed 👩‍👩‍👧 x", "<|endoftext|> <s> <0x41> <unk>",
    "under▁score", "tab\there \t and", "x y 　 z᠎ q", "ｆｕｌｌ ｗｉｄｔｈ ﬁ", "1234567 8,9.0 $#@!", "a" * 700, "q " * 300, "\u0000 \u0001", "don't can't we'll ́x ́", "The quick brown fox, the lazy dog's tail.", "\r\n\r\n line", "Straße ÄÖÜ ß", "é 각 한국어 عربى हिन्दी",
]


@pytest.mark.parametrize("most", [1 << 22, 90])
def test_against_brute_force(spark, most):
    df = spark.createDataFrame([(k, t, "mine", 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, groups string, links int", ).repartition(3)
    got = {r.doc_id: r for r in alignment.align(df, most=most).collect()}
    assert len(got) == len(TEXTS)
    for k, want in enumerate(brute(TEXTS)):
        r = got[k]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups, r.cuts) == want, TEXTS[k]
        assert r.links == 1 and r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "")


def test_query_against_brute_force(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    some = [t if len(t) < 1500 else t[:1500] for _, t in docs[:60]]
    want = brute(some)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(some)], "doc_id long, text string")
    assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups, r.cuts) for r in alignment.align(df).orderBy("doc_id").collect()] == want
    from barspark.llm.queries import queries

    rows = {r.doc_id: r for r in queries()["op13_alignment"](spark, sf).collect()}
    assert len(rows) == len(docs)
    for k, t in docs[:60]:
        if len(t) < 1500:
            own = brute([t])[0]
            assert (rows[k].n_a, rows[k].n_b, rows[k].n_groups, rows[k].n_links) == own[:4]
            assert rows[k].groups_sha256 == (hashlib.sha256(own[6].encode()).hexdigest() if own[0] else "")
            assert rows[k].n_best <= rows[k].n_links and rows[k].count_sum >= rows[k].n_links


def test_empty_nulls_repeats_and_clashes(spark):
    schema = "row long, n_a string, _text string, c0 string, text string"
    assert alignment.align(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, "x", "y", "z", "a b"), (1, "x", "y", "z", "a b"), (None, None, None, None, None)], schema)
    for most in (100, 1):
        got = sorted((tuple(r) for r in alignment.align(df, most=most).select("row", "_text", "c0", "text", "n_a", "n_b", "n_links", "n_best", "count_sum").collect()), key=str)
        assert got == [(1, "y", "z", "a b", 2, 2, 2, 2, 4)] * 2 + [(None, None, None, None, 0, 0, 0, 0, 0)]


def test_memory_is_bounded_and_whole(spark, monkeypatch):
    monkeypatch.setattr(alignment, "MEMO", 5)
    aligner = alignment.Aligner(public_vocabulary(alignment.TOKENIZER_A), public_vocabulary(alignment.TOKENIZER_B))
    n = 0
    for k in range(50):
        x = aligner.texts([f"word{k} and more{k}"])[0]
        n += int(np.array(aligner.n_a)[x].sum())
        assert len(aligner.memo) <= 5 + 3
    assert n == sum(len(tokens(f"word{k} and more{k}")[0]) for k in range(50))


@pytest.mark.parametrize("spans", [True, False])
def test_parts_that_came_most_are_kept(monkeypatch, spans):
    monkeypatch.setattr(alignment, "MEMO", 6)
    aligner = alignment.Aligner(public_vocabulary(alignment.TOKENIZER_A), public_vocabulary(alignment.TOKENIZER_B))
    aligner.spans, added, add = spans, [], alignment.Aligner.add
    aligner.forget()
    monkeypatch.setattr(alignment.Aligner, "add", lambda self, new, told=True: added.extend(new) or add(self, new, told))
    for k in range(60):
        text = f"often é\u6c49 often thing{k} often é\u6c49 rare{k}"
        x = aligner.texts([text])[0]
        want = brute([text])[0]
        codes, begin = np.array(aligner.codes), np.array(aligner.begin)
        links = np.concatenate([codes[begin[i] : begin[i] + aligner.n_links[i]] for i in x])
        assert (*(int(np.array(getattr(aligner, n))[x].sum()) for n in alignment.NUMBERS), ";".join(aligner.groups[i] for i in x), len(links)) == (*want[:4], want[6], want[3])
        if spans:
            assert alignment._cuts(aligner, [x]).to_pylist()[0] == want[7]
    assert added.count("often") == added.count("é\u6c49") == 1


def test_long_text_is_cut_into_the_same_parts():
    text = " ".join(f"w{k}  \n x{k} y" for k in range(3000))
    assert [p for b in alignment.blocks(text, 100) for p in alignment.parts(b)] == alignment.parts(text)
    assert " ".join(alignment.parts(text)) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("ab'sTZ09 .,\n\t ▁᠎ééß汉😀‍")), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text(text):
    aligner = alignment._aligner(public_vocabulary(alignment.TOKENIZER_A), public_vocabulary(alignment.TOKENIZER_B))
    x = aligner.texts([text])[0]
    want = brute([text])[0]
    got = (0, 0, 0, 0, "") if x is None else (*(int(np.array(getattr(aligner, n))[x].sum()) for n in ("n_a", "n_b", "n_groups", "n_links")), ";".join(aligner.groups[i] for i in x))
    assert got == (*want[:4], want[6])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abcdefgh'sTZ09.,\n▁ééß汉😀")), min_size=1, max_size=12), max_size=40))
def test_parts_encoded_together(words):
    aligner = alignment.Aligner.__new__(alignment.Aligner)
    aligner.__dict__.update(alignment._aligner(public_vocabulary(alignment.TOKENIZER_A), public_vocabulary(alignment.TOKENIZER_B)).__dict__)
    aligner.forget()
    new = list(dict.fromkeys(words))
    aligner.add(new)
    for k, w in enumerate(new):
        own = brute([w])[0]
        assert (aligner.n_a[k], aligner.n_b[k], aligner.n_groups[k], aligner.n_links[k], aligner.groups[k], np.frombuffer(aligner.cuts[k], np.int64).tolist()) == (*own[:4], own[6], own[7]), w


def _same(aligner, texts):
    for text, x in zip(texts, aligner.texts(texts)):
        want = brute([text])[0]
        got = (0, 0, 0, 0, "") if x is None else (*(int(np.array(getattr(aligner, n))[x].sum()) for n in alignment.NUMBERS), ";".join(aligner.groups[i] for i in x))
        assert got == (*want[:4], want[6]), text
        assert alignment._cuts(aligner, [x]).to_pylist()[0] == want[7], text


def test_a_word_is_aligned_once_whatever_follows(monkeypatch):
    aligner, added, add = alignment.Aligner(public_vocabulary(alignment.TOKENIZER_A), public_vocabulary(alignment.TOKENIZER_B)), [], alignment.Aligner.add
    monkeypatch.setattr(alignment.Aligner, "add", lambda self, new, told=True: added.extend(new) or add(self, new, told))
    _same(aligner, [f"Wörter{a} Wörter don't{b}\nWörter{b} (Wörter){a} Wörter{a}{b}\n\n Wörter{b}\n" for a in (",", ".", "!!", "") for b in ("?", "'s", "###", "_")])
    assert sum(x.startswith("Wörter") for x in added) == 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Zé", "ﬁ", "1", "汉", "́", "don't", "'", "'s", ".", ",", "$$", "_", "<s>", "▁", "\n", " ", "\t", "😀"]), max_size=14))
def test_letters_marks_and_line_breaks(pieces):
    _same(alignment._aligner(public_vocabulary(alignment.TOKENIZER_A), public_vocabulary(alignment.TOKENIZER_B)), ["".join(pieces)])


def test_no_tails_where_a_piece_has_letter_and_mark(monkeypatch, tmp_path):
    from sentencepiece import SentencePieceProcessor, SentencePieceTrainer

    lines = iter(["go.on go.on to.on don't"] * 50)
    SentencePieceTrainer.train(sentence_iterator=lines, model_prefix=f"{tmp_path}/m", vocab_size=290, model_type="bpe", byte_fallback=True, normalization_rule_name="identity", split_by_unicode_script=False, remove_extra_whitespaces=False, hard_vocab_limit=False, minloglevel=2)
    tokens("a")
    monkeypatch.setitem(globals(), "_loaded", [_loaded[0], SentencePieceProcessor(model_file=f"{tmp_path}/m.model"), _loaded[2]])
    aligner = alignment.Aligner(public_vocabulary(alignment.TOKENIZER_A), f"{tmp_path}/m.model")
    assert not aligner.tails and any("." in aligner.b.id_to_piece(i)[1:] for i in range(aligner.b.get_piece_size()))
    _same(aligner, ["go.on, to.on. don't\ngo.", "go on"])
