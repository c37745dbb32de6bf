import hashlib
import random
import time

import numpy as np
import pytest
from tokenizers import Tokenizer

from barspark.llm import bpe

PATH = bpe.public_vocabulary()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(0)
    pool = [chr(i) for lo, hi in [(0, 0x250), (0x300, 0x340), (0x390, 0x3C0), (0x400, 0x450), (0x3041, 0x3090), (0xAC00, 0xAC40), (0x1F600, 0x1F620)] for i in range(lo, hi) if chr(i).isprintable() or i < 0x21]
    out = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    out += ["Σίσυφος ΟΔΟΣ ΑΣ", "it's WE'LL don't 's", "<|endoftext|>a<|startoftext|>b", "x<|endoftext|>", "<|endof", "", " \n", "á ́e", "1234 5,6", "İstanbul", "a" * 3000, "\x1ca\x85b　c", "a\u0378b\u1c891 \u20c1x", "\u209e\x94z"]
    return out + [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 14))) for _ in range(60)) for _ in range(60)]


@pytest.mark.parametrize("speculate", [True, False])
def test_same_as_library(library, speculate):
    e = bpe.Encoder(PATH, memo=500, speculate=speculate)
    all_texts = texts()
    for lo in range(0, len(all_texts), 50):
        part = all_texts[lo : lo + 50]
        for text, got in zip(part, e.encode_batch(part)):
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(got, "<u4").tolist() == want, text
            assert e.decode(got) == library.decode(want, skip_special_tokens=False)


def test_every_token_encodes_to_itself():
    e = bpe.Encoder(PATH)
    closed = {t[: -len(e.end)]: i for t, i in e.vocab.items() if t.endswith(e.end) and len(t) > len(e.end)}
    assert all(e._merged(t, True) == [i] for t, i in closed.items())
    assert all(e._merged(t, False) == [i] for t, i in e.inner.items())


def test_table(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (None, "The same words", "x"), (None, "The same words", "x"), (5, "word " * 5000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_documents(df, PATH).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 3, 3, 5000]
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes()
        assert hashlib.sha256(r.decoded.encode()).digest() == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).digest()
    back = bpe.decode_documents(bpe.encode_documents(df, PATH), PATH)
    assert sorted(r.decoded for r in back.collect()) == sorted(r.decoded for r in got)
    assert bpe.encode_documents(df.limit(0), PATH).count() == 0


def test_long_words_take_near_linear_time(library):
    rng = random.Random(2)
    e = bpe.Encoder(PATH)
    began = time.time()
    for text in ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (199, 200, 201, 202, 300, 1000, 200_000)] + ["ab" * 100_000, "x" * 300_000, "é漢" * 30_000]:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(e.encode_batch([text])[0], "<u4").tolist() == want
    assert time.time() - began < 60
    # each length by both ways of merging
    for n in (5, 50, 250, 600):
        words = ["".join(rng.choice("abcdefgh") for _ in range(n)) for _ in range(20)]
        ids = [[*e.letter_ids[list(map(ord, w[:-1]))].tolist(), int(e.last_letter_ids[ord(w[-1])])] for w in words]
        assert [e.merge(list(x)) for x in ids] == [e.merge_long(list(x)) for x in ids] == [np.frombuffer(x, "<u4").tolist() for x in e.merge_many(words)]
