"""Language identification by unigrams summed over all segmentations.

The vocabulary is a fixed public list of pieces. Each language has a probability for each piece,
fitted by expectation maximisation on a bounded sample of labelled documents. A word's
probability is the sum over all ways to cut it into pieces, by the forward algorithm; a text's
score is the posterior of its words under the languages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm.common import materialize, read_table, release, worker_state

LETTERS = re.compile(r"[^\W\d_]+")
#: Labelled documents of each language in the training sample, as expected number.
SAMPLE = 1500
#: Languages that a model tells apart at most: their table of pieces is on the driver (0.3 MB each) and broadcast.
LANGUAGES = 256
ROUNDS = 2
#: Factor a letter, which keeps products of probabilities in range over RESCALE letters; then sums are scaled anew.
SCALE = 24.0
RESCALE = 32
#: Letters and places of words that are summed at once; a longer word is summed in stretches that carry their last sums over.
TOGETHER = 200_000
MEMO = 300_000
#: Part of the usual lead of its language that a recognised text has.
LEAST_LEAD = 0.4
UNKNOWN = "und"


def public_pieces(name: str = "piece_bpe_32k.model") -> list[str]:
    """The pieces of a public vocabulary, lower-cased, without control and byte pieces; ``▁`` opens a word."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    own = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return sorted({p for p in (model.id_to_piece(i).lower() for i in own) if LETTERS.fullmatch(p.removeprefix("▁")) or p == "▁"})


class Lattice:
    """All occurrences of pieces in words."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        #: Letters of the longest piece.
        self.reach = max(map(len, pieces), default=1)
        #: Piece numbers; -1 for what only begins a piece.
        self.trie: dict[str, int] = {}
        for k, p in enumerate(pieces):
            for n in range(1, len(p)):
                self.trie.setdefault(p[:n], -1)
        self.trie |= {p: k for k, p in enumerate(pieces)}

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(word, start, end, piece)`` of each arc, by end and word. Any letter alone is an arc: the last piece number stands for one that is no piece."""
        get, other = self.trie.get, self.size
        out: list[int] = []
        add = out.extend
        for w, text in enumerate(words):
            n = len(text)
            for i in range(n):
                k = get(text[i], -1)
                add((w, i, i + 1, k if k >= 0 else other))
                j = i + 2
                while j <= n:
                    k = get(text[i:j])
                    if k is None:
                        break
                    if k >= 0:
                        add((w, i, j, k))
                    j += 1
        arcs = np.array(out, np.int64).reshape(-1, 4)
        arcs = arcs[np.lexsort((arcs[:, 0], arcs[:, 2]))]
        return arcs[:, 0], arcs[:, 1], arcs[:, 2], arcs[:, 3]


def forward(arcs: tuple[np.ndarray, ...], n: int, length: np.ndarray, weight: np.ndarray, begin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all paths to each place of each word, and the logs by which they were scaled down.

    ``weight`` is (arcs, columns), already scaled by SCALE a letter. ``begin`` holds the sums at the
    first places, (places, 1, columns), where a stretch goes on from another; else a word begins at its first.
    """
    word, start, end, _ = arcs
    most = int(length.max(initial=0))
    at = np.zeros((most + 1, n, weight.shape[1]))
    shift = np.zeros((most + 1, n, weight.shape[1]) if most > RESCALE else (1, 1, 1))
    first_end = 1
    if begin is None:
        at[0] = 1
    else:
        at[: len(begin)] = begin
        first_end = len(begin)
    cut = np.searchsorted(end, np.arange(1, most + 2))
    reach = int((end - start).max(initial=1))
    for e in range(first_end, most + 1):
        lo, hi = cut[e - 1], cut[e]
        if lo < hi:
            w = word[lo:hi]
            first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            at[e, w[first]] = np.add.reduceat(at[start[lo:hi], w] * weight[lo:hi], first, axis=0)
        if most > RESCALE:
            shift[e] = shift[e - 1]
            if e % RESCALE == 0:
                # the places that later ones build on get one scale; they are all within reach
                near = slice(max(0, e - reach + 1), e + 1)
                at[near] *= np.exp(shift[near] - shift[e])
                by = np.where(at[e] > 0, at[e], 1.0)
                at[near] /= by
                shift[near] = shift[e] + np.log(by)
    return at, shift


def _groups(length: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of words of like length, about TOGETHER places at a time."""
    order = np.argsort(length, kind="stable")
    lo = 0
    while lo < len(order):
        hi = min(lo + 4096, len(order))
        while hi - lo > 1 and (hi - lo) * (length[order[hi - 1]] + 1) > TOGETHER:
            hi = lo + max(1, (hi - lo) // 2)
        yield order[lo:hi]
        lo = hi


@dataclass
class Model:
    """``log_p`` is (pieces + 1, languages): the last row is for a letter that is no piece."""

    pieces: list[str]
    languages: list[str]
    log_p: np.ndarray

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores words with a bounded memo."""

    def __init__(self, model: Model):
        self.lattice, self.p = Lattice(model.pieces), np.exp(model.log_p)
        self.languages = model.languages
        self.memo: dict[str, int] = {}
        self.table = np.zeros((MEMO, len(model.languages)), np.float32)

    def words(self, words: list[str]) -> np.ndarray:
        """Log probabilities (words, languages)."""
        marked = ["▁" + w for w in words]
        length = np.fromiter(map(len, marked), np.int64, len(marked))
        out = np.zeros((len(marked), self.p.shape[1]))
        for own in _groups(length):
            if length[own[0]] > TOGETHER:
                out[own[0]] = self.long_word(marked[own[0]])
                continue
            arcs = self.lattice.arcs([marked[k] for k in own])
            weight = self.p[arcs[3]] * (SCALE ** (arcs[2] - arcs[1]))[:, None]
            at, shift = forward(arcs, len(own), length[own], weight)
            here = length[own], np.arange(len(own))
            out[own] = np.log(np.maximum(at[here], 1e-300)) - length[own, None] * np.log(SCALE)
            if len(shift) > 1:
                out[own] += shift[here]
        return out

    def long_word(self, word: str) -> np.ndarray:
        """Log probabilities of one word, stretch by stretch."""
        reach, carried, total = self.lattice.reach, None, np.zeros(self.p.shape[1])
        for lo in range(0, len(word), TOGETHER):
            back = min(lo, reach)
            part = word[lo - back : lo + TOGETHER]
            arcs = self.lattice.arcs([part])
            weight = self.p[arcs[3]] * (SCALE ** (arcs[2] - arcs[1]))[:, None]
            at, shift = forward(arcs, 1, np.array([len(part)]), weight, carried)
            last = slice(max(0, len(part) - reach), None)
            if len(shift) == 1:
                shift = np.zeros(at.shape)
            carried = at[last] * np.exp(shift[last] - shift[-1])
            by = np.where(carried[-1] > 0, carried[-1], 1.0)
            carried = carried / by
            total += (shift[-1] + np.log(by))[0]
        return total - len(word) * np.log(SCALE)

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None], list[float | None]]:
        """Of each text the language, its posterior, its log probability a letter and its lead a letter over the next language."""
        split = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        # the pattern also finds numerals that are no digits; alone they are no letters
        split = [own if any(map(str.isalpha, "".join(own))) else [] for own in split]
        new = list(set().union(*split).difference(self.memo))
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = list(set().union(*split))
        if len(new) > len(self.table):
            self.table = np.zeros((len(new), self.table.shape[1]), np.float32)
        if new:
            at = len(self.memo)
            self.table[at : at + len(new)] = self.words(new)
            self.memo.update(zip(new, range(at, at + len(new))))
        got, score, each, lead = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts), [None] * len(texts)
        take = self.memo.__getitem__
        for k, own in enumerate(split):
            if own and self.languages:
                total = self.table[np.fromiter(map(take, own), np.int64, len(own))].sum(0, dtype=np.float64)
                best = int(total.argmax())
                got[k], score[k] = self.languages[best], float(1 / np.exp(total - total[best]).sum())
                letters = sum(map(len, own)) + len(own)
                each[k] = float(total[best] / letters)
                if len(total) > 1:
                    lead[k] = float((total[best] - np.partition(total, -2)[-2]) / letters)
        return got, score, each, lead


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE, pieces: list[str] | None = None, most: int = LANGUAGES) -> Model:
    """A model of ``labelled``; about ``sample`` rows of each language, chosen by a hash of the id, are read.

    What reaches the driver is one number per language and piece, so a column of more than ``most`` languages
    is refused with a ``ValueError`` before any of them is read.
    """
    pieces = pieces or public_pieces()
    rows = labelled.select(F.col(doc_id).alias("_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(most + 1).collect()}
    if len(sizes) > most:
        raise ValueError(f"the column {lang} has more than {most} values; name fewer languages")
    languages = sorted(sizes)
    if not languages:
        return Model(pieces, [], np.zeros((len(pieces) + 1, 0)))
    part = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))])[F.col("lang")]
    chosen = rows.where(F.pmod(F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit(""))), F.lit(1_000_000)) < part * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for own, body in zip(*(c.to_pylist() for c in batch.columns)):
                found.update((own, w) for w in LETTERS.findall(body.lower()))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    words = chosen.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialize(words, "language_words")
    numbers = {k: i for i, k in enumerate(languages)}
    size = np.array([len(p) for p in pieces] + [1])
    p = np.repeat((0.02 ** np.minimum(size, 4.0) + 1e-7)[:, None], len(languages), 1)
    p /= p.sum(0)
    spark = labelled.sparkSession
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(p)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, p = Lattice(pieces), shared.value
            total = np.zeros(p.shape)
            for batch in batches:
                own, word, n = (c.to_pylist() for c in batch.columns)
                texts = ["▁" + w for w in word]
                column, times = np.fromiter((numbers[x] for x in own), np.int64, len(own)), np.array(n, float)
                length = np.fromiter(map(len, texts), np.int64, len(texts))
                for at in _groups(length):
                    size = length[at]
                    w, s, e, k = arcs = lattice.arcs([texts[i] for i in at])
                    weight = p[k, column[at][w]] * SCALE ** (e - s)
                    ahead, lifted = (x[:, :, 0] for x in forward(arcs, len(at), size, weight[:, None]))
                    back = (w, size[w] - e, size[w] - s, k)
                    order = np.lexsort((back[0], back[2]))
                    behind, lowered = (x[:, :, 0] for x in forward(tuple(x[order] for x in back), len(at), size, weight[order, None]))
                    through = ahead[s, w] * weight * behind[size[w] - e, w] / np.maximum(ahead[size[w], w], 1e-300)
                    if len(lifted) > 1:
                        through *= np.exp(lifted[s, w] + lowered[size[w] - e, w] - lifted[size[w], w])
                    np.add.at(total, (k, column[at][w]), through * times[at][w])
            at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(total[at])], ["piece", "lang", "n"])

        got = words.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        total = np.full(p.shape, 0.02)
        total[got.column("piece").to_numpy(), got.column("lang").to_numpy()] += got.column("n").to_numpy()
        p = total / total.sum(0)
    release(words)
    return Model(pieces, languages, np.log(p))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` (the posterior), ``lang_log_p`` (log probability a letter, the end of a word counts as one) and ``lang_lead`` (its lead over the next language), which replace columns of these names.

    A null text or one without a letter gives ``und``, 0 and nulls; the lead is null where only one
    language is known. Ties go to the first language by name. Texts and words of any length are
    summed whole. Other columns pass through and repeated rows stay; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    token = shared._jbroadcast.id() if shared._jbroadcast is not None else id(shared)
    added = ["lang_pred", "lang_score", "lang_log_p", "lang_lead"]
    base = docs.drop(*(c for c in added if c != text))
    names = base.columns
    rows = base.toDF(*[f"c{i}" for i in range(len(names))])
    rows = rows.withColumn("_text", F.col(f"c{names.index(text)}").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_state(("language", token), shared.value.scorer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                got, *numbers = scorer.texts(part.columns[-1].to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got, pa.string()), *(pa.array(x, pa.float64()) for x in numbers)], [*part.schema.names[:-1], *added])

    schema = rows.drop("_text").schema.add("lang_pred", "string")
    for c in added[1:]:
        schema = schema.add(c, "double")
    return rows.mapInArrow(run, schema).toDF(*names, *added)


def recognised(found: DataFrame, least_lead: float = LEAST_LEAD) -> DataFrame:
    """The rows of :func:`predict` that are in one learned language.

    Texts without a letter go, and those whose lead over the next language is, letter by letter, below
    ``least_lead`` of the median lead of their language: texts in no learned language, or with a large
    part in another. Where only one language is known there is no lead, and all texts with a letter stay.
    """
    names = found.columns
    own = {c: f"c{names.index(c)}" for c in ("lang_pred", "lang_lead")}
    found = found.toDF(*[f"c{k}" for k in range(len(names))]).withColumnsRenamed({v: k for k, v in own.items()})
    usual = found.where("lang_lead is not null").groupBy(F.col("lang_pred").alias("_lang")).agg(F.percentile_approx("lang_lead", 0.5, 10_000).alias("_usual"))
    joined = found.join(F.broadcast(usual), F.col("lang_pred") == F.col("_lang"), "left")  # a row per learned language: LANGUAGES at most
    kept = joined.where((F.col("lang_pred") != UNKNOWN) & F.coalesce(F.col("lang_lead") >= least_lead * F.col("_usual"), F.lit(True)))
    return kept.drop("_lang", "_usual").toDF(*names)


def held_out(doc_id: str = "doc_id"):
    """Whether a row is held out of training; a null id is neither learned from nor held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by a model of those that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
