"""Quality rules and n-gram perplexity bands.

A modified Kneser-Ney model of letter 4-grams, which run across the blanks between words, is
counted by Spark over all documents, per language. Probabilities stay under their whole gram: a
small table is broadcast, a larger one joined with the grams of blocks of documents. Documents whose
perplexity lies outside the band of their language are rejected; centre and width of a band are
medians, so that up to half of a language may be junk without widening it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barspark.llm.common import materialize, read_table, release, worker_state

ORDER = 4
BLANKS = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
#: A table of at most so many grams is broadcast (12 bytes each); a larger one is joined by a shuffle.
BROADCAST_GRAMS = 1 << 22
#: Letters of a block of documents of that join.
BLOCK_LETTERS = 1 << 24
#: A document is kept within this many spreads of its language's median log perplexity. A spread is
#: the median distance to that median, or the median of distance * sqrt(letters) over the root of
#: the document's letters, whichever is greater, and never below the two least values.
SPREADS, LEAST_SPREAD, LEAST_NOISE = 4.0, 0.005, 0.5
#: A median distance as a standard deviation.
DEVIATION = 1.4826
#: A language with fewer documents takes the spreads of all documents.
LEAST_DOCUMENTS = 20
UNKNOWN = "und"
MEMO = 300_000
UNSEEN = float(np.log(1 / 65536))


def base_rules(text: str | None) -> tuple[int, int, int, int, int, list[str]]:
    """``(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words)`` of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0, []
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    n, repeated = len(words), 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows) if len(set(windows)) < len(windows) else None
        if counts:
            hit = np.fromiter((counts[x] > 1 for x in windows), bool, len(windows))
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : k + len(hit)] |= hit
            repeated = int(covered.sum())
    chars = len(text) - sum(map(text.count, BLANKS))
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, words


def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter 4-grams of words and of their ends, packed into 64 bits: ``(grams, word of each, places of each word)``.

    A letter is a code point of at most 16 bits, larger ones count as one letter; before the
    blank that opens a word stands zero.
    """
    text = b" ".join([b"", *words, b""]).decode()
    c = np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), 0xFFFD).astype(np.uint64)
    blank = c == 32
    one = c[:-1]
    two = np.where(blank[:-1], 0, np.concatenate([[0], c[:-2]]).astype(np.uint64))
    three = np.where(blank[:-1] | (two == 32) | (two == 0), 0, np.concatenate([[0, 0], c[:-3]]).astype(np.uint64))
    grams = three << np.uint64(48) | two << np.uint64(32) | one << np.uint64(16) | c[1:]
    ends = np.flatnonzero(blank[1:])
    size = np.diff(np.concatenate([[-1], ends]))
    return grams, np.repeat(np.arange(len(words)), size), size


def _inner(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The letter 4-grams of words that no word before has a part in, and the word of each."""
    grams, word, size = _letters(words)
    keep = np.arange(len(grams)) - np.repeat(np.cumsum(size) - size, size) > 1
    return grams[keep], word[keep]


def _joint_grams(joints: list[str]) -> np.ndarray:
    """The two letter 4-grams of each joint of :class:`Joints`."""
    c = np.minimum(np.frombuffer("".join(joints).encode("utf-32-le"), "<u4"), 0xFFFD).astype(np.uint64).reshape(-1, 5)
    first = c[:, 0] << np.uint64(48) | c[:, 1] << np.uint64(32) | c[:, 2] << np.uint64(16) | c[:, 3]
    return np.column_stack([first, first << np.uint64(16) | c[:, 4]])


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Joints:
    """What meets at the blanks of texts: two letters of the word before (zeros where there are none), the blank, and two of the word and its end.

    Words, ends of words and beginnings of words are numbered; at most about MEMO words are remembered.
    """

    def __init__(self):
        self.words = Numbers()
        self.tails, self.heads = Numbers({"\0\0 ": 0}), Numbers()
        self.ends = np.zeros((0, 2), np.int64)

    def of(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of texts and of the joint before each: that of the tail * 2**32 + that of the head."""
        size = np.fromiter(map(len, split), np.int64, len(split))
        own = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, size.sum())
        new = list(islice(self.words, len(self.ends), None))
        if new:
            text = [w.decode() for w in new]
            ends = [(self.tails[x[-2:].rjust(2, "\0") + " "], self.heads[(x + " ")[:2]]) for x in text]
            self.ends = np.concatenate([self.ends, np.array(ends, np.int64)])
        tails = np.zeros(len(own), np.int64)
        tails[1:] = self.ends[own[:-1], 0]
        starts = np.cumsum(size) - size
        tails[starts[size > 0]] = 0
        return own, tails << 32 | self.ends[own, 1]

    def names(self, joints: np.ndarray) -> list[str]:
        tails, heads = list(self.tails), list(self.heads)
        return [tails[k >> 32] + heads[k & 0xFFFFFFFF] for k in joints.tolist()]


def count_grams(docs: DataFrame, text: str, lang: Column, across: bool = False, block: Column | None = None) -> DataFrame:
    """``(lang, gram, n)`` over all words of all documents; each task sums its own first.

    Grams stay within words, or run ``across`` the blanks between them. With a ``block``, whose rows
    must be in one partition, the result is ``(block, lang, gram, n)``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]] = {}
        joints = Joints()
        for batch in batches:
            keyed, texts = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), batch.column(2).to_pylist()
            for lo in range(0, len(texts), 2048):
                found: dict[tuple[int, str], list[list[bytes]]] = {}
                for own, body in zip(keyed[lo : lo + 2048], texts[lo : lo + 2048]):
                    found.setdefault(own, []).append(body.split())
                if len(joints.words) > MEMO:
                    joints = Joints()
                for own, split in found.items():
                    at, between = joints.of(split)
                    if len(at):
                        at, n = np.unique(at, return_counts=True)
                        words = list(map(list(joints.words).__getitem__, at.tolist()))
                        grams, word = _inner(words) if across else _letters(words)[:2]
                        n = n[word]
                        if across:
                            between, times = np.unique(between, return_counts=True)
                            grams = np.concatenate([grams, _joint_grams(joints.names(between)).ravel()])
                            n = np.concatenate([n, np.repeat(times, 2)])
                        old = sums.get(own, (grams[:0], n[:0]))
                        keys, at = np.unique(np.concatenate([old[0], grams]), return_inverse=True)
                        sums[own] = keys, np.bincount(at, np.concatenate([old[1], n]), len(keys)).astype(np.int64)
        for (number, own), (keys, n) in sums.items():
            for lo in range(0, len(keys), 100_000):
                part = keys[lo : lo + 100_000].view(np.int64)
                columns = [pa.array([number] * len(part), pa.int64()), pa.array([own] * len(part), pa.string()), pa.array(part), pa.array(n[lo : lo + 100_000])]
                yield pa.RecordBatch.from_arrays(columns, ["block", "lang", "gram", "n"])

    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select((F.lit(0) if block is None else block).cast("long").alias("block"), lang.alias("lang"), body.alias("text"))
    counted = rows.mapInArrow(run, "block long, lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")) if block is None else counted


def kneser_ney(counts: DataFrame) -> DataFrame:
    """``counts(lang, gram, n)`` to ``(lang, kind, gram, value)``, written to the shared folder.

    ``kind`` k from 1 to 4 holds the natural log of the interpolated probability of the last
    letter after the k - 1 before it, and 10 + k the log of the weight of order k - 1 after
    these letters. Orders below the highest count the different letters before. Discounts
    are those of modified Kneser-Ney, from the numbers of grams that occur 1 to 4 times.
    """
    orders = {ORDER: materialize(counts, "grams_4")}
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1))
        orders[k] = materialize(orders[k + 1].select("lang", shorter.alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n")), f"grams_{k}")
    lower, out, steps = None, [], list(orders.values())
    for k in range(1, ORDER + 1):
        table = orders[k].withColumn("context", F.shiftrightunsigned("gram", 16).cast("long"))
        of = lambda i: F.count_if(F.col("n") == i).cast("double")
        sizes = table.groupBy("lang").agg(*[of(i).alias(f"n{i}") for i in (1, 2, 3, 4)])
        y = F.coalesce(F.try_divide("n1", F.col("n1") + 2 * F.col("n2")), F.lit(0.5))

        def discount(i: int) -> Column:
            raw = F.lit(float(i)) - (i + 1) * y * F.coalesce(F.try_divide(f"n{i + 1}", f"n{i}"), F.lit(1.0))
            return F.greatest(F.lit(0.1), F.least(raw, F.lit(i - 0.1)))

        sizes = sizes.select("lang", *[discount(i).alias(f"d{i}") for i in (1, 2, 3)])
        with_d = table.join(F.broadcast(sizes), "lang")  # a row per language
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        totals = materialize(with_d.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum(cut).alias("mass")), f"contexts_{k}")
        share = with_d.join(totals, ["lang", "context"]).select("lang", "gram", ((F.col("n") - cut) / F.col("total")).alias("own"), (F.col("mass") / F.col("total")).alias("weight"))
        if lower is None:
            full = share.select("lang", "gram", (F.col("own") + F.col("weight") * float(np.exp(UNSEEN))).alias("p"))
        else:
            below = lower.select("lang", F.col("gram").alias("short"), F.col("p").alias("q"))
            short = F.col("gram").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1))
            full = share.withColumn("short", short).join(below, ["lang", "short"]).select("lang", "gram", (F.col("own") + F.col("weight") * F.col("q")).alias("p"))
        lower = materialize(full, f"probabilities_{k}")
        steps += [totals, lower]
        out.append(lower.select("lang", F.lit(k).alias("kind"), "gram", F.log("p").alias("value")))
        out.append(totals.select("lang", F.lit(10 + k).alias("kind"), F.col("context").alias("gram"), F.log(F.col("mass") / F.col("total")).alias("value")))
    every = out[0]
    for x in out[1:]:
        every = every.union(x)
    every = materialize(every, "kneser_ney")
    release(*steps)
    return every


class Model:
    """The numbers of :func:`kneser_ney`, which stay in their table."""

    def __init__(self, table: DataFrame):
        self.table = table

    def find(self, lang: str, asked: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Of each kind the grams among those asked for that the table has, in order, and their values."""
        kinds = np.concatenate([np.full(len(x), k, np.int32) for k, x in asked.items()])
        wanted = pd.DataFrame({"kind": kinds, "gram": np.concatenate(list(asked.values())).view(np.int64)})
        wanted = self.table.sparkSession.createDataFrame(wanted, "kind int, gram long")
        got = self.table.where(F.col("lang") == lang).join(wanted, ["kind", "gram"]).select("kind", "gram", "value").toArrow()
        kind, gram, value = (got.column(k).to_numpy() for k in range(3))
        gram = gram.view(np.uint64)
        order = np.argsort(gram)
        return {k: (gram[at], value[at]) for k in asked for at in [order[kind[order] == k]]}

    def log_p(self, lang: str, grams: np.ndarray) -> np.ndarray:
        """The natural log probability of the last letter of each gram after the others."""
        orders = {k: grams & np.uint64((1 << 16 * k) - 1) for k in range(ORDER, 0, -1)}
        stored = self.find(lang, {k: np.unique(x) for k, x in orders.items()} | {10 + k: np.unique(x >> np.uint64(16)) for k, x in orders.items()})
        total, left = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(ORDER, 0, -1):
            hit, value = _look_up(*stored[k], orders[k][left])
            total[left[hit]] += value[hit]
            left = left[~hit]
            hit, value = _look_up(*stored[10 + k], orders[k][left] >> np.uint64(16))
            total[left[hit]] += value[hit]
        total[left] += UNSEEN
        return total

    def word_scores(self, lang: str, words: list[bytes]) -> np.ndarray:
        """The natural log probability of each word and its end, by itself."""
        grams, word, _ = _letters(words)
        return np.bincount(word, self.log_p(lang, grams), len(words))


def _look_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key asked for is among the sorted keys, and its value where it is."""
    if not len(keys):
        return np.zeros(len(asked), bool), np.zeros(len(asked))
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return keys[at] == asked, values[at]


class Scorer:
    """Scores documents whose grams are all in ``tables``: of each language the sorted grams and their log probabilities."""

    def __init__(self, tables: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.tables = tables
        self.memo: dict[str, tuple[Joints, np.ndarray]] = {}

    def log_p(self, lang: str, grams: np.ndarray) -> np.ndarray:
        hit, value = _look_up(*self.tables.get(lang, (grams[:0], np.zeros(0))), grams)
        if not hit.all():
            raise ValueError(f"a text of {lang} has letters that were not counted: the table changed between two reads")
        return value

    def document_scores(self, langs: list[str], split: list[list[bytes]], letters: list[int]) -> list[float | None]:
        """The log perplexity per letter (words' ends count) of each document; None without a word."""
        if sum(len(x[0].words) for x in self.memo.values()) > MEMO:
            self.memo.clear()
        out: list[float | None] = [None] * len(split)
        places: dict[str, list[int]] = {}
        for k, (lang, words) in enumerate(zip(langs, split)):
            if words:
                places.setdefault(lang, []).append(k)
        for lang, own in places.items():
            joints, inner = self.memo.get(lang, (Joints(), np.zeros(0)))
            texts = [split[k] for k in own]
            at, between = joints.of(texts)
            missing = list(islice(joints.words, len(inner), None))
            if missing:
                grams, word = _inner(missing)
                inner = np.concatenate([inner, np.bincount(word, self.log_p(lang, grams), len(missing))])
            self.memo[lang] = joints, inner
            between, of = np.unique(between, return_inverse=True)
            joint = self.log_p(lang, _joint_grams(joints.names(between)).ravel()).reshape(-1, 2).sum(1)
            size = [len(words) for words in texts]
            total = np.bincount(np.repeat(np.arange(len(own)), size), inner[at] + joint[of], len(own))
            for k, x, n in zip(own, total.tolist(), size):
                out[k] = -x / (letters[k] + n)
        return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", across: bool = False) -> Model:
    """The model of all documents, of words by themselves or ``across`` blanks."""
    language = F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN))
    return Model(kneser_ney(count_grams(docs, text, language, across)))


def _tables(langs: list[str], lang: np.ndarray, gram: np.ndarray, value: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Columns as the tables of a :class:`Scorer`; ``lang`` holds places in ``langs``."""
    order = np.lexsort((gram.view(np.uint64), lang))
    lang, gram, value = lang[order], gram.view(np.uint64)[order], value[order].astype(np.float64)
    cut = np.searchsorted(lang, np.arange(len(langs) + 1))
    return {x: (gram[cut[k] : cut[k + 1]], value[cut[k] : cut[k + 1]]) for k, x in enumerate(langs)}


ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measured(part: pa.RecordBatch, width: int, own: Scorer) -> pa.RecordBatch:
    """The first ``width`` columns of a batch, base counts, ``base_failed`` and ``log_perplexity``."""
    texts, langs = part.column("_text").to_pylist(), part.column("_lang").to_pylist()
    ruled = [base_rules(t) for t in texts]
    score = own.document_scores(langs, [x[5] for x in ruled], [x[1] for x in ruled])
    counts = [pa.array([x[k] for x in ruled], pa.int64()) for k in range(5)]
    failed = [x[0] < LEAST_WORDS or 100 * x[4] > 50 * x[0] for x in ruled]
    return pa.RecordBatch.from_arrays([*part.columns[:width], *counts, pa.array(failed), pa.array(score, pa.float64())], [*part.schema.names[:width], *ADDED, "base_failed", "log_perplexity"])


def measure(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang", most: int | None = None) -> DataFrame:
    """``docs`` with the base counts, ``base_failed`` and ``log_perplexity``, which replace columns of these names.

    ``model`` is that of ``docs`` across blanks, so that it has all their 4-grams. More than ``most``
    of these (BROADCAST_GRAMS if not given) are not broadcast but joined with the grams of blocks of documents.
    """
    base = docs.drop(*[c for c in (*ADDED, "base_failed", "log_perplexity") if c != text and c != lang])
    names = base.columns
    width = len(names)
    rows = base.toDF(*[f"c{i}" for i in range(width)])
    schema = rows.schema
    for c in ADDED:
        schema = schema.add(c, "long")
    schema = schema.add("base_failed", "boolean").add("log_perplexity", "double")
    rows = rows.withColumns({"_text": F.col(f"c{names.index(text)}").cast("string"), "_lang": F.coalesce(F.col(f"c{names.index(lang)}").cast("string"), F.lit(UNKNOWN))})
    table = model.table.where(F.col("kind") == ORDER).select("lang", "gram", F.col("value").cast("float").alias("value"))
    held = table.count() <= (BROADCAST_GRAMS if most is None else most)
    return (_by_broadcast if held else _by_blocks)(rows, width, table, schema).toDF(*names, *ADDED, "base_failed", "log_perplexity")


def _by_broadcast(rows: DataFrame, width: int, table: DataFrame, schema: StructType) -> DataFrame:
    spark = rows.sparkSession
    langs = sorted(r["lang"] for r in table.select("lang").distinct().collect())
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1 if langs else F.lit(0)
    stored = table.select(number.alias("k"), "gram", "value").toArrow()  # at most BROADCAST_GRAMS
    shared = spark.sparkContext.broadcast(_tables(langs, *(stored.column(k).to_numpy() for k in range(3))))
    token = shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_state(("quality", token), lambda: Scorer(shared.value))
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                yield _measured(batch.slice(lo, 512), width, scorer)

    return rows.mapInArrow(run, schema)


def _by_blocks(rows: DataFrame, width: int, table: DataFrame, schema: StructType) -> DataFrame:
    """Rows are dealt into blocks; a block's grams are joined with the table and go before its rows."""
    letters = rows.agg(F.sum(F.length("_text"))).first()[0] or 0
    blocks = max(1, -(-letters // BLOCK_LETTERS))
    # rows of one text should not share a block; maps cannot be hashed
    keys = [f.name for f in rows.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(blocks)))
    own = count_grams(dealt.select("_block", "_text", "_lang").repartition(blocks, "_block"), "_text", F.col("_lang"), True, F.col("_block"))
    own = own.join(table, ["lang", "gram"])
    own = own.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != "_lang"], F.col("lang").alias("_lang"), F.col("block").alias("_block"), F.col("gram").alias("_gram"), F.col("value").alias("_value"))
    both = dealt.withColumns({"_gram": F.lit(None).cast("long"), "_value": F.lit(None).cast("float")}).unionByName(own).withColumn("_after", F.col("_gram").isNull())
    both = both.repartition(blocks, "_block").sortWithinPartitions("_block", "_after")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, scorer = None, [], None
        for batch in batches:
            block, after = batch.column("_block").to_numpy(), batch.column("_after").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (after[1:] != after[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                if not part.num_rows:
                    continue
                if block[lo] != at:
                    at, held, scorer = block[lo], [], None
                if not after[lo]:
                    held.append(part.select(["_lang", "_gram", "_value"]))
                    continue
                if scorer is None:
                    grams = pa.Table.from_batches(held, held[0].schema).combine_chunks() if held else None
                    held, tables = [], {}
                    if grams is not None:
                        names = grams.column("_lang").combine_chunks().dictionary_encode()
                        tables = _tables(names.dictionary.to_pylist(), names.indices.to_numpy(), grams.column("_gram").to_numpy(), grams.column("_value").to_numpy())
                    scorer = Scorer(tables)
                for k in range(0, part.num_rows, 512):
                    yield _measured(part.slice(k, 512), width, scorer)

    return both.mapInArrow(run, schema)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``log_perplexity`` and ``kept``, which replace columns of these names.

    A null or empty text has no word and fails. A null language is a language of its own. A text of
    any length is measured whole. Repeated rows stay, other columns pass through whatever their
    names; an empty table gives an empty table.
    """
    added = [*ADDED, "base_failed", "log_perplexity", "kept"]
    base = docs.drop(*(c for c in added if c not in (text, lang)))
    names = base.columns
    base = base.toDF(*[f"c{i}" for i in range(len(names))])
    text, lang = (f"c{names.index(c)}" for c in (text, lang))
    model = train(base, text, lang, across=True)
    measured = materialize(measure(base, model, text, lang), "measured")
    release(model.table)
    kept = ~F.col("base_failed") & F.coalesce(F.abs(F.col("log_perplexity") - F.col("_middle")) <= F.col("_width"), F.lit(False))
    return bands(measured, lang).select(*measured.columns, kept.alias("kept")).toDF(*names, *added)


def bands(measured: DataFrame, lang: str = "lang") -> DataFrame:
    """Measured documents with the centre ``_middle`` and half the width ``_width`` of the band of their language and length."""
    language = F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN))
    root = F.sqrt(F.col("word_chars") + F.col("n_words"))

    def median(x: Column | str) -> Column:
        return F.percentile_approx(x, 0.5, 10_000)

    judged = measured.where("not base_failed").select(language.alias("_lang"), "log_perplexity", root.alias("_root"))
    middle = judged.groupBy("_lang").agg(median("log_perplexity").alias("_middle"))
    far = judged.join(F.broadcast(middle), "_lang")  # a row per language
    far = materialize(far.select("_lang", "_middle", F.abs(F.col("log_perplexity") - F.col("_middle")).alias("_far"), "_root"), "distances")
    spreads = [(DEVIATION * median("_far")).alias("_between"), (DEVIATION * median(F.col("_far") * F.col("_root"))).alias("_noise")]
    every = far.agg(*[x.alias(f"_all{k}") for k, x in enumerate(spreads)])
    few = F.col("_n") < LEAST_DOCUMENTS
    own = far.groupBy("_lang", "_middle").agg(F.count("*").alias("_n"), *spreads).crossJoin(F.broadcast(every))  # a row
    own = own.select("_lang", "_middle", *[F.when(few, F.col(f"_all{k}")).otherwise(F.col(c)).alias(c) for k, c in enumerate(("_between", "_noise"))])
    width = SPREADS * F.greatest(F.col("_between"), F.greatest("_noise", F.lit(LEAST_NOISE)) / root, F.lit(LEAST_SPREAD))
    return measured.join(F.broadcast(own), language == F.col("_lang"), "left").withColumn("_width", width)  # a row per language


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of rules and perplexity bands for all documents."""
    found = judge(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")
