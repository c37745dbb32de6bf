"""Toxicity scores after noisy-channel deobfuscation.

A stretch of text that may be disguised (signs or digits for letters, letters repeated, letters
set apart) becomes a lattice of what each sign can stand for, and a Viterbi decoder picks the
reading that is likeliest under a character language model and the costs of the channel.
Restored words are then looked up in a table of evidence, learned from labelled documents, and
a logistic regression on a document's evidence gives its score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm.common import materialize, read_table, release

#: Expected numbers of labelled documents that are read to learn from.
TOXIC_DOCUMENTS, CLEAN_DOCUMENTS = 4000, 8000
#: What a sign may stand for (fixed values).
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
#: Two signs for one letter.
PAIRS = {"|)": "d"}
SIGNS = re.escape("".join(STANDS_FOR))
#: Letters set apart: at least three, one by one.
APART = re.compile(rf"(?<![^\W_])[^\W\d_](?:[ .\-_*·]{{1,2}}(?:[^\W_]|[{SIGNS}])(?![^\W_])){{2,}}")
CHUNK = re.compile(r"\S+")
WORD = re.compile(r"[^\W\d_]+")
#: A sign or digit beside a letter, or a letter repeated.
DISGUISED = re.compile(rf"[^\W\d_][{SIGNS}0-9]|[{SIGNS}0-9][^\W\d_]|([^\W\d_])\1")
#: Letters that each stand once.
SINGLE = re.compile(r"(?:([^\W\d_])(?!\1))+")
BETWEEN = re.compile(r"^[^\w@$!]+|[^\w]+$")
CHANGE, DROP, JOIN, SPLIT = -1.5, -0.7, -0.3, -1.5
PREFIXES = (3, 4, 5, 6)
#: The model of letters tells letters below this code point apart; all others are one letter to it.
ALPHABET = 0x180
MEMO = 400_000


def features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    parts = [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]
    return [xxhash.xxh64_intdigest(p.encode()) >> 1 for p in parts]


def plain(letters: str) -> str:
    """Letters as the model of letters tells them apart."""
    return letters if letters.isascii() else "".join(c if ord(c) < ALPHABET else "?" for c in letters)


class Letters:
    """A character trigram model with interpolated back-off; a blank bounds words.

    ``counts`` has trigrams of :func:`plain` letters. At most MEMO grams are remembered.
    """

    def __init__(self, counts: dict[str, int]):
        self.three, self.two, self.one = Counter(counts), Counter(), Counter()
        for gram, n in counts.items():
            self.two[gram[1:]] += n
            self.one[gram[2:]] += n
        self.context_two, self.context_one = Counter(), Counter()
        for gram, n in self.three.items():
            self.context_two[gram[:2]] += n
        for gram, n in self.two.items():
            self.context_one[gram[:1]] += n
        self.total = sum(self.one.values())
        self.memo: dict[str, float] = {}

    def log_p(self, context: str, letter: str) -> float:
        gram = context + letter
        if (got := self.memo.get(gram)) is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            asked, gram = gram, plain(gram)
            letter = gram[2:]
            p = (self.one[letter] + 0.1) / (self.total + 100)
            p = (self.two[gram[1:]] + 8 * p) / (self.context_one[gram[1:2]] + 8)
            p = (self.three[gram] + 8 * p) / (self.context_two[gram[:2]] + 8)
            got = self.memo[asked] = float(np.log(p))
        return got


def lattice(chunk: str) -> list[list[tuple[str, float]]]:
    """What each sign of a chunk, or run of one letter, can stand for, with the cost; letters with one reading stay together."""
    out: list[list[tuple[str, float]]] = []
    i, n = 0, len(chunk)
    while i < n:
        if fixed := SINGLE.match(chunk, i):
            out.append([(fixed[0], 0.0)])
            i = fixed.end()
            continue
        c, j = chunk[i], i + 1
        while j < n and chunk[j] == c:
            j += 1
        run = j - i
        if (pair := chunk[i : i + 2]) in PAIRS:
            own = [(PAIRS[pair], CHANGE)] + [(x + pair[1], CHANGE) for x in STANDS_FOR[c]] + [(pair, 0.0)]
            j = i + 2
        elif c.isalpha():
            own = [(c * k, 0.0 if k == run else DROP) for k in (1, 2) if k <= run]
            if run > 2:
                own.append((c * run, 0.0))
        elif c in STANDS_FOR:
            own = [(x, CHANGE) for x in STANDS_FOR[c]] + ([(x * 2, CHANGE) for x in STANDS_FOR[c]] if run == 2 else [])
            own.append((c * run, 0.0))
        elif c in " .-_*·":
            own = [("", JOIN), (" ", SPLIT)]
        else:
            own = [(c * run, 0.0), ("", DROP * 2)]
        out.append(own)
        i = j
    return out


def decode(chunk: str, letters: Letters) -> str:
    """The likeliest reading of a chunk."""
    # a state is its score and the last of its steps, each of which holds the one before
    states: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}
    known = letters.memo.get
    for options in lattice(chunk):
        following: dict[str, tuple[float, tuple, str]] = {}
        for context, (score, step) in states.items():
            for emitted, cost in options:
                now, s = context, score + cost
                for c in emitted:
                    gram = now + c
                    if (p := known(gram)) is None:
                        p = letters.log_p(now, c)
                    s += p
                    now = gram[1:]
                old = following.get(now)
                if old is None or s > old[0]:
                    following[now] = (s, step, emitted)
        states = {k: (s, (step, emitted)) for k, (s, step, emitted) in following.items()}
    step, out = max(states.items(), key=lambda x: x[1][0] + letters.log_p(x[0], " "))[1][1], []
    while step:
        step, emitted = step
        out.append(emitted)
    return "".join(reversed(out))


def restore(text: str, letters: Letters) -> list[str]:
    """The words of a text, in lower case, with disguised stretches decoded."""
    text = text.lower()
    out = [w for m in APART.finditer(text) for w in WORD.findall(decode(m[0], letters))]
    for chunk in set(CHUNK.findall(text)):
        out += restore_chunk(chunk, letters)
    return out


def restore_chunk(chunk: str, letters: Letters) -> list[str]:
    core = BETWEEN.sub("", chunk)
    if core.isalpha() and not DISGUISED.search(chunk):
        return [core]
    words = WORD.findall(core)
    at = chunk.find(core)
    around = chunk[:at] + chunk[at + len(core) :]
    # signs at either end may be letters or marks around the word: both readings count
    for form in (core, chunk) if any(x in STANDS_FOR for x in around) else (core,):
        if DISGUISED.search(form):
            for part in re.split(r"[,;:/\"]+", form):
                if DISGUISED.search(part):
                    words += WORD.findall(decode(part, letters))
    return words


@dataclass
class Model:
    letters: dict[str, int] = field(default_factory=dict)
    #: Hash of a feature to the log ratio of its rates in toxic and clean documents.
    evidence: dict[int, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0, 0, 0, 0]))


class Scorer:
    """Scores texts; ``memo`` and ``known`` hold the evidence of the chunks and words seen last."""

    def __init__(self, model: Model):
        self.letters, self.evidence, self.weights = Letters(model.letters), model.evidence, model.weights
        self.memo: dict[str, float] = {}
        self.known: dict[str, float] = {}

    def of_words(self, words: list[str]) -> float:
        known, get, most = self.known, self.evidence.get, 0.0
        for w in words:
            if (x := known.get(w)) is None:
                x = known[w] = max(get(f, 0.0) for f in features(w))
            if x > most:
                most = x
        return most

    def row(self, text: str | None) -> list[float]:
        """Greatest evidence, logs of the sum of evidence and of the number of chunks with strong evidence, and of length."""
        if not text:
            return [0.0, 0.0, 0.0, 0.0]
        text, memo = text.lower(), self.memo
        chunks = set(text.split())
        if len(memo) > MEMO:
            memo.clear()
        if len(self.known) > MEMO:
            self.known.clear()
        for chunk in chunks.difference(memo):
            memo[chunk] = self.of_words(restore_chunk(chunk, self.letters))
        found = [x for x in map(memo.__getitem__, chunks) if x > 0]
        for m in APART.finditer(text):
            x = self.of_words([w for w in WORD.findall(decode(m[0], self.letters)) if len(w) > 2])
            if x > 0:
                found.append(x)
        return [max(found, default=0.0), float(np.log1p(sum(found))), float(np.log1p(sum(x > 3 for x in found))), float(np.log1p(len(chunks)))]

    def scores(self, texts: list[str | None]) -> list[float]:
        rows = np.array([[1.0, *self.row(t)] for t in texts]).reshape(-1, len(self.weights))
        return (1 / (1 + np.exp(-np.clip(rows @ self.weights, -30, 30)))).tolist()


def logistic_regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Weights of a logistic regression with an intercept, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def count_letters(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """How often each trigram of letters occurs in the words of all texts.

    Tasks sum their own grams first; what is collected is bounded by the alphabet (ALPHABET).
    """

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        found: Counter = Counter()

        def settle() -> None:
            for w, n in words.items():
                w = f"  {plain(w)} "
                for i in range(len(w) - 2):
                    found[w[i : i + 3]] += n
            words.clear()

        for batch in batches:
            for body in batch.column(0).to_pylist():
                words.update(WORD.findall(body.lower()))
                if len(words) > MEMO:
                    settle()
        settle()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["gram", "n"])

    texts = docs.select(F.col(text).cast("string").alias("text")).where("text is not null")
    counted = texts.mapInArrow(grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(counted.column("gram").to_pylist(), counted.column("n").to_pylist()))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", toxic: int = TOXIC_DOCUMENTS, clean: int = CLEAN_DOCUMENTS) -> Model:
    """A model of the labelled rows of ``docs``: about ``toxic`` and ``clean`` of them, chosen by a hash of the id.

    The model of letters is that of all rows of ``docs``, with or without a label. Two thirds give the evidence, the other third the regression. Rows without an id, a text or
    a label, and ids with both labels, teach nothing; equal texts count once. Without toxic or
    without clean rows every score is low.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("y")).where("_id is not null and y in (0, 1)")
    marks = marks.groupBy("_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")
    sizes = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    part = {k: min(1.0, n / max(1, sizes.get(k, 0))) for k, n in ((1, toxic), (0, clean))}
    draw = F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1_000_000)) / 1e6
    chosen = marks.where(draw < F.when(F.col("y") == 1, F.lit(part[1])).otherwise(F.lit(part[0])))
    # the chosen labels are bounded by the two parameters, whatever the size of the tables
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), "_id")
    rows = rows.groupBy(F.xxhash64("text").alias("_h"), F.length("text").alias("_n")).agg(F.min(F.struct("_id", "text", "y")).alias("r")).select("r.*")
    rows = materialize(rows.withColumn("third", F.pmod(F.xxhash64("_id", F.lit("third")), F.lit(3)) == 0), "labelled")

    letters = count_letters(docs, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = Letters(letters), {}
        for batch in batches:
            seen: dict[int, list[np.ndarray]] = {0: [], 1: []}
            for body, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own: set[int] = set()
                for w in set(restore(body, model)):
                    if (f := memo.get(w)) is None:
                        f = memo[w] = features(w)
                    own.update(f)
                seen[y].append(np.fromiter(own, np.int64, len(own)))
            if len(memo) > MEMO:
                memo.clear()
            for y, arrays in seen.items():
                if arrays:
                    keys, n = np.unique(np.concatenate(arrays), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n if y else 0 * n), pa.array(n)], ["feature", "toxic", "n"])

    first = rows.where("not third")
    base = {r["y"]: r["count"] for r in first.groupBy("y").count().collect()}
    if not base.get(0) or not base.get(1):
        release(rows)
        return Model(letters)
    table = first.select("text", "y").repartition(12).mapInArrow(count, "feature long, toxic long, n long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    a, c = F.col("toxic").cast("double"), (F.col("n") - F.col("toxic")).cast("double")
    ratio = F.log((a + 0.5) / (base[1] + 1.0)) - F.log((c + 0.5) / (base[0] + 1.0))
    share = F.lit(base[1] / (base[0] + base[1]))
    gain = 2 * (a * F.log(F.greatest(a, F.lit(1e-9)) / (F.col("n") * share)) + c * F.log(F.greatest(c, F.lit(1e-9)) / (F.col("n") * (1 - share))))
    # features of at least four of at most `toxic` documents: bounded by the sample
    strong = table.where((F.col("toxic") >= 4) & (gain > 20) & (ratio > 1)).select("feature", F.least(ratio, F.lit(6.0)).alias("v")).toArrow()
    evidence = dict(zip(strong.column("feature").to_pylist(), strong.column("v").to_pylist()))
    model = Model(letters, evidence)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([scorer.row(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    got = rows.where("third").select("text", "y").mapInArrow(measure, "x array<double>, y int").toArrow()  # four numbers a sampled document
    release(rows)
    y = got.column("y").to_numpy()
    if len(set(y.tolist())) == 2:
        x = np.array(got.column("x").to_pylist())
        model.weights = logistic_regression(x, y, np.where(y == 1, 1 / part[1], 1 / part[0]))
    return model


_scorers: dict[int, Scorer] = {}


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` from 0 to 1, which replaces a column of that name.

    A null or empty text has no evidence. A text of any length is scored whole, in time linear
    in its length. Repeated rows stay and other columns pass through; an empty table gives an
    empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    token = shared._jbroadcast.id()
    base = docs.drop("toxicity")
    names = base.columns
    rows = base.toDF(*[f"c{i}" for i in range(len(names))])
    rows = rows.withColumn("_text", F.col(f"c{names.index(text)}").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _scorers:
            _scorers.clear()
            _scorers[token] = Scorer(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                got = _scorers[token].scores(part.columns[-1].to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got, pa.float64())], [*part.schema.names[:-1], "toxicity"])

    return rows.mapInArrow(run, rows.drop("_text").schema.add("toxicity", "double")).toDF(*names, "toxicity")


def held_out(doc_id: str = "doc_id"):
    """Whether a row is held out of training; a null id is neither learned from nor held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labels that are not held out."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out()))
    found = score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"))
