"""Alignment of two tokenizers' tokens over the bytes of each text.

Both tokenizers say where their tokens lie: one in characters, the other in bytes of the text it
was given. These spans are coarse cuts. A character that several tokens share, or that a byte
fallback spells, is cut by the decoded bytes of its tokens, counted on from the cut before it.

A text falls apart at single spaces between characters that are no white space: neither tokenizer
has a token across such a place, so its parts are aligned once and remembered, and a text is the
sequence of its parts. It also falls apart between a Latin letter and the punctuation after it, and
before a line break that follows either, unless a tokenizer may have a token there.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from barspark.llm.bpe import _byte_letters, public_vocabulary
from barspark.llm.common import materialize, read_table

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Counted pairs that are broadcast at once (13 bytes each); more are taken slice by slice, one pass over the texts each.
PAIRS = 1 << 22
#: Parts, and characters in them, after which a worker forgets half of what it remembers or more, and keeps what came most.
MEMO, MEMO_CHARS = 200_000, 1 << 24
#: Characters of clean parts that are encoded as one text; the second tokenizer takes longer a character in longer texts.
LONGEST = 1024
#: Links, or pairs, that a task gathers before it sums them, or sends them.
HELD = 1 << 22
#: Bytes of texts that are worked on together, and characters of a long text that are cut into parts at a time.
TOGETHER, BLOCK = 1 << 19, 1 << 20
#: Not white space to every library; no text is cut beside it.
ODD_SPACE = "\u180e"
UNCLEAN = re.compile(r" (?:[\s\u180e]|(?<=[\s\u180e] ))")
#: Begins a part that has no space before it; no text has it, as it is half of a surrogate pair.
TAIL = "\ud800"
LETTERS, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-/:-@\[-`{-~"
TAILS = re.compile(rf"[{MARKS}](?<=[{LETTERS}].)|\n(?<=[{LETTERS}{MARKS}].)", re.DOTALL)
ID_END = attrgetter("id", "end")


def _open(c: str) -> bool:
    return not c.isspace() and c != ODD_SPACE


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """``text`` cut at clean single spaces, which are left out, into stretches of at least ``size`` characters."""
    lo = 0
    while True:
        at = text.find(" ", lo + size)
        while 0 <= at < len(text) - 1 and not (_open(text[at - 1]) and _open(text[at + 1])):
            at = text.find(" ", at + 1)
        if not 0 <= at < len(text) - 1:
            yield text[lo:]
            return
        yield text[lo:at]
        lo = at + 1


def parts(text: str) -> list[str]:
    """``text`` cut at single spaces, which are left out, between characters that are no white space."""
    pieces = text.split(" ")
    if pieces[0] and pieces[-1] and not UNCLEAN.search(text):
        return pieces
    found: list[str] = []
    joins = False
    for piece in pieces:
        if joins or found and not (piece and _open(piece[0])):
            found[-1] += " " + piece
        else:
            found.append(piece)
        joins = not (piece and _open(piece[-1]))
    return found


def byte_ends(ends: np.ndarray, holds: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where tokens end: at ``ends`` where a span ``holds``, else counted on in bytes from the last one that does."""
    done = np.cumsum(size)
    last = np.maximum.accumulate(np.where(holds, np.arange(len(ends)), -1))
    known = last >= 0
    return np.where(known, ends[last] + done - done[last], done)


class Aligner:
    """Aligns parts of texts, and remembers them."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_padding(), self.a.no_truncation()
        self.b = SentencePieceProcessor(model_file=path_b)
        byte = {c: b for b, c in _byte_letters().items()}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in names]
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.spans = True
        #: Whether no token of either goes across a place before ``TAILS``: the first one's words end there, and no piece of the second one has it inside.
        plain = self.a.normalizer is None and isinstance(self.a.pre_tokenizer, ByteLevel) and self.a.pre_tokenizer.use_regex and all(t.special for t in self.a.get_added_tokens_decoder().values())
        self.tails = plain and not any(TAILS.search(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)))
        #: Ids as written in a group, and as its last of a tokenizer.
        self.names = [f"{i}{c}" for x, last in ((self.bytes_a, "|"), (self.bytes_b, ";")) for i in range(len(x)) for c in (",", last)]
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.chars = 0
        #: Of each part: whether tokens give its bytes back, numbers of tokens, groups and links, bytes, and where its links begin.
        self.good, self.n_a, self.n_b, self.n_groups, self.n_links, self.sizes, self.begin = (array("q") for _ in range(7))
        self.groups: list[str] = []
        self.cuts: list[bytes] = []
        self.codes = array("I")
        #: How often each part came, halved whenever others are forgotten.
        self.uses = np.zeros(0, np.int64)

    def trim(self) -> None:
        """Forget all but half of ``MEMO`` parts and of ``MEMO_CHARS``: those that came most stay."""
        words, numbers = list(self.memo), np.fromiter(self.memo.values(), np.int64, len(self.memo))
        best = np.argsort(-self.uses[numbers], kind="stable")[: MEMO // 2]
        best = best[np.cumsum(np.fromiter((len(words[k]) for k in best.tolist()), np.int64, len(best))) <= MEMO_CHARS // 2]
        kept, words = numbers[best], [words[k] for k in best.tolist()]
        rows = [np.array(x, np.int64)[kept] for x in (self.good, self.n_a, self.n_b, self.n_groups, self.n_links, self.sizes, self.begin)]
        groups, cuts = [self.groups[k] for k in kept.tolist()], [self.cuts[k] for k in kept.tolist()] if self.spans else []
        codes, uses = np.array(self.codes, np.uint32)[_slices(rows[6], rows[4])], self.uses[kept] // 2
        self.forget()
        rows[6] = np.cumsum(rows[4]) - rows[4]
        for into, row in zip((self.good, self.n_a, self.n_b, self.n_groups, self.n_links, self.sizes, self.begin), rows):
            into.frombytes(row.tobytes())
        self.codes.frombytes(codes.tobytes())
        self.groups, self.cuts, self.uses, self.chars = groups, cuts, uses, sum(map(len, words))
        self.memo = dict(zip(words, range(len(words))))

    def _encoded(self, texts: list[str]) -> Iterator[tuple[bytes, list[int], list[tuple[int, int]], list[tuple[int, int]]] | None]:
        """Of each text, which begins with a space: bytes, of the first tokenizer ids and spans in characters, of the second ids and ends of spans in bytes without the space; None where bytes do not come back."""
        for text in texts:
            a = self.a.encode(text, add_special_tokens=False)
            data, own_a = text.encode(), a.ids
            b = list(map(ID_END, self.b.encode(text[1:], return_type="proto").pieces))
            if b"".join(map(self.bytes_a.__getitem__, own_a)) != data or b"".join([self.bytes_b[i] for i, _ in b]) != data:
                yield None
                continue
            yield data, own_a, a.offsets, b

    def add(self, new: list[str], told: bool = True) -> int:
        """Align ``new`` parts; the number of the first. Clean parts are encoded in one text, tails after a letter; groups are written out if ``told``."""
        at, stretches, size, letter = len(self.good), [], LONGEST + 1, len(new)
        written = [" " + x if x[:1] != TAIL else x[1:] for x in new] + [" a"]
        alone = lambda k: [k] if new[k][:1] != TAIL else [letter, k]
        for k, text in enumerate(new):
            clean = text != "" and len(text.strip()) == len(text) and text[0] != ODD_SPACE != text[-1]
            size += len(text) + 1
            if clean and size <= LONGEST and stretches and stretches[-1][0]:
                stretches[-1][1].extend(alone(k))
            else:
                stretches.append((clean, alone(k)))
                size = len(text)
        order, ids_a, spans_a, ids_b, edges, sizes, count_a, count_b = [], [], [], [], [], [], [], []
        stretches = [own for _, own in stretches]
        flat = lambda x, width: np.fromiter(chain.from_iterable(x), np.int64, width * len(x)).reshape(-1, width)
        while stretches:
            failed = []
            whole = ["".join([written[k] for k in own]) for own in stretches]
            for own, text, found in zip(stretches, whole, self._encoded(whole)):
                if found is None:
                    real = [k for k in own if k != letter]
                    failed += map(alone, real) if len(real) > 1 else []
                    continue
                data, a, spans, b = found
                order += own
                ids_a += a
                own_a, ends = flat(spans, 2), np.cumsum(np.fromiter((len(written[k]) for k in own), np.int64, len(own)))
                if len(data) > len(text):
                    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
                    place = np.cumsum(np.concatenate([[0], 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)]))
                    own_a, ends = place[own_a], place[ends]
                spans_a.append(own_a), ids_b.append(flat(b, 2)), edges.append(ends), sizes.append(len(data)), count_a.append(len(a)), count_b.append(len(b))
            stretches = failed
        a, sizes, none = np.array(ids_a, np.int64), np.array(sizes, np.int64), np.zeros(0, np.int64)
        start = np.cumsum(sizes) - sizes
        edge = np.concatenate([none, *edges]) + np.repeat(start, [len(x) for x in edges])
        length = np.diff(edge, prepend=0)
        spans, near = np.concatenate([flat([], 2), *spans_a]), np.concatenate([flat([], 2), *ids_b])
        after = np.repeat(start + 1, count_b)
        b, near = near[:, 0], near[:, 1] + after
        spans += np.repeat(start, count_a)[:, None]
        end_a = byte_ends(spans[:, 1], np.append(spans[1:, 0] >= spans[:-1, 1], np.ones(min(len(a), 1), bool)), self.size_a[a])
        end_b = byte_ends(near, near > np.maximum(np.append(0, near)[:-1], after), self.size_b[b])
        count = lambda x: np.bincount(x, minlength=len(order))
        part_a, part_b = np.searchsorted(edge, end_a), np.searchsorted(edge, end_b)
        first = np.searchsorted(end_b, end_a - self.size_a[a], "right")
        many = np.searchsorted(end_b, end_a, "left") - first + 1
        of_a = np.repeat(np.arange(len(a)), many)
        of_b = np.repeat(first, many) + np.arange(len(of_a)) - np.repeat(np.cumsum(many) - many, many)
        n_links, n_a, n_b = count(part_a[of_a]), count(part_a), count(part_b)
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        n_groups = count(np.searchsorted(edge, cuts))
        own = np.zeros((7, len(new) + 1), np.int64)
        own[:, order] = [np.ones(len(order), np.int64), n_a, n_b, n_groups, n_links, length, len(self.codes) + np.cumsum(n_links) - n_links]
        for into, row in zip((self.good, self.n_a, self.n_b, self.n_groups, self.n_links, self.sizes, self.begin), own[:, :-1]):
            into.frombytes(row.tobytes())
        self.codes.frombytes((a[of_a] << 16 | b[of_b]).astype(np.uint32).tobytes())
        groups, ends = [""] * (len(new) + 1), [b""] * (len(new) + 1)
        if told:
            group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
            last_a, last_b = (cuts[g] == e if len(cuts) else e > 0 for g, e in ((group_a, end_a), (group_b, end_b)))
            names = np.empty(len(a) + len(b), np.int64)  # ids as written: a group's first ids, then its second ones
            names[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = 2 * a + last_a
            names[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = 2 * (len(self.bytes_a) + b) + last_b
            written, lo = list(map(self.names.__getitem__, names.tolist())), 0
            for k, n in zip(order, (n_a + n_b).tolist()):
                groups[k] = "".join(written[lo : lo + n])[:-1]
                lo += n
            if self.spans:
                lo, packed = 0, (cuts - np.repeat(edge - length, n_groups)).tobytes()
                for k, n in zip(order, n_groups.tolist()):
                    ends[k] = packed[8 * lo : 8 * (lo + n)]
                    lo += n
        self.groups += groups[:-1]
        if self.spans:
            self.cuts += ends[:-1]
        self.chars += sum(map(len, new))
        return at

    def texts(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Of each text the numbers of its parts; None without tokens."""
        if len(self.memo) > MEMO or self.chars > MEMO_CHARS:
            self.trim()
        mark = (lambda x: TAILS.sub(rf" {TAIL}\g<0>", x)) if self.tails else str
        cut = [list(chain.from_iterable(parts(mark(block)) for block in blocks(t))) if t else None for t in texts]
        found = [np.fromiter(map(self.memo.get, c, repeat(-1)), np.int64, len(c)) if c else None for c in cut]
        missing = [(c, x, np.flatnonzero(x < 0).tolist()) for c, x in zip(cut, found) if c]
        new = list({c[k] for c, _, own in missing for k in own})
        at = self.add(new)
        self.memo.update(zip(new, range(at, at + len(new))))
        for c, x, own in missing:
            x[own] = [self.memo[c[k]] for k in own]
        good = np.array(self.good, bool)
        if not good.all():  # a part whose bytes do not come back: the whole text decides
            odd = [k for k, x in enumerate(found) if x is not None and not good[x].all()]
            at = self.add([texts[k] for k in odd])
            for k, i in zip(odd, range(at, at + len(odd))):
                found[k] = np.array([i]) if self.good[i] else None
        uses = np.bincount(np.concatenate([np.zeros(0, np.int64), *(x for x in found if x is not None)]), minlength=len(self.good))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        return found


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(a: str, b: str) -> Aligner:
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


def _together(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows of up to 1,024 texts and about ``TOGETHER`` bytes."""
    lo = size = 0
    for k, n in enumerate(sizes.tolist()):
        size += n
        if size >= TOGETHER or k - lo >= 1023:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


def _slices(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices of stretches from ``begin``, each of its ``size``, one after the other."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def linked(docs: DataFrame, text: str = "text", path_a: str | None = None, path_b: str | None = None, spans: bool = True) -> DataFrame:
    """``docs``, as columns ``c0``, ``c1`` and so on, with the numbers of :func:`align`, ``groups_sha256``, if ``spans``, ``groups`` and ``cuts``, and ``links``.

    ``links`` has the id pairs of a text's links, packed: little-endian unsigned 32-bit numbers, the
    first id << 16 | the second.
    """
    path_a, path_b = path_a or public_vocabulary(TOKENIZER_A), path_b or public_vocabulary(TOKENIZER_B)
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    told = [StructField("groups", StringType()), StructField("cuts", ArrayType(LongType()))] if spans else []
    schema = StructType([*rows.schema.fields, *(StructField(c, LongType()) for c in NUMBERS), StructField("groups_sha256", StringType()), *told, StructField("links", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        if aligner.spans != spans:
            aligner.spans = spans
            aligner.forget()
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for lo, hi in _together(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)):
                found = aligner.texts(column.slice(lo, hi - lo).to_pylist())
                known = [np.array(getattr(aligner, n), np.int64) for n in NUMBERS]
                sums = [pa.array([0 if x is None else int(each[x].sum()) for x in found], pa.int64()) for each in known]
                groups = ["" if x is None else ";".join(map(aligner.groups.__getitem__, x.tolist())) for x in found]
                digest = pa.array([sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string())
                codes, begin = np.array(aligner.codes, np.uint32), np.array(aligner.begin, np.int64)
                links = pa.array([b"" if x is None else codes[_slices(begin[x], known[3][x])].tobytes() for x in found], pa.binary())
                more = [pa.array(groups, pa.string()), _cuts(aligner, found)] if spans else []
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:-1], *sums, digest, *more, links], schema.names)

    return rows.withColumn("_text", F.col(f"c{docs.columns.index(text)}").cast("string")).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``aligned(links)`` to ``(code, n)``: how many links of all texts hold each pair of ids.

    A task sums a pair before it sends it, as often as it has gathered ``HELD`` links or pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, held, size = np.zeros(0, np.uint32), np.zeros(0, np.int64), [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            new, times = np.unique(np.concatenate([np.zeros(0, np.uint32), *held]), return_counts=True)
            codes, at = np.unique(np.concatenate([own, new]), return_inverse=True)
            total = np.zeros(len(codes), np.int64)
            np.add.at(total, at, np.concatenate([n, times]))
            return codes, total

        for batch in batches:
            for x in batch.column(0).to_pylist():
                held.append(np.frombuffer(x or b"", np.uint32))
                size += len(held[-1])
                if size >= HELD:
                    own, n = summed()
                    held, size = [], 0
                    if len(own) >= HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(n)], ["code", "n"])
                        own, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        own, n = summed()
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(n)], ["code", "n"])

    return aligned.select("links").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, text: str = "text", path_a: str | None = None, path_b: str | None = None, most: int = PAIRS, spans: bool = True) -> DataFrame:
    """``docs`` with the alignment of each text's tokens, in columns that replace those of the same names.

    ``n_a``, ``n_b``, ``n_groups``, ``n_links``: tokens of either tokenizer, groups between byte
    offsets at which both have an end, and pairs of tokens whose bytes overlap. ``n_best``: links whose pair is
    the most frequent of its second id over all texts, ties included; ``count_sum``: the sum of the links'
    counts. ``groups_sha256``: of the ids, ``a1,a2|b1;a3|b2,b3``. If ``spans``, ``groups``: these ids, and ``cuts``: the groups'
    ends in bytes of the text with a space before it.

    Null and empty texts, and those whose tokens do not give back their bytes, have zeros, an
    empty ``groups`` and ``groups_sha256`` and no ``cuts``. Texts of any length are aligned whole. Repeated rows count and stay,
    other columns pass through, and an empty table gives an empty table. Texts are encoded once; their links are written, counted and
    read back. Of the counted pairs, ``most`` are broadcast at once; if there are more, each slice of them is one more pass over the links.
    """
    spark = docs.sparkSession
    added = [*NUMBERS, "groups_sha256", *(["groups", "cuts"] if spans else []), "n_best", "count_sum"]
    base = docs.drop(*(c for c in added if c != text))
    aligned = linked(base, text, path_a, path_b, spans)
    if text in added:
        aligned = aligned.drop(f"c{base.columns.index(text)}")
    names = [c for c in base.columns if c not in added]
    aligned = materialize(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    among = Window.partitionBy(F.col("code").bitwiseAND(0xFFFF))  # no more rows than the first vocabulary has ids
    counted = materialize(pair_counts(aligned), "pair_counts")
    pairs = materialize(counted.withColumn("best", F.col("n") == F.max("n").over(among)), "pairs")
    slices = max(1, -(-pairs.count() // most))
    schema = StructType([*(f for f in aligned.schema.fields if f.name != "links"), StructField("n_best", LongType()), StructField("count_sum", LongType())])

    def weighed(k: int) -> DataFrame:
        own = pairs.where(F.pmod(F.xxhash64("code"), F.lit(slices)) == k).select("code", "n", "best").orderBy("code").toArrow()
        table = own.column("code").to_numpy().astype(np.uint32), own.column("n").to_numpy(), own.column("best").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        shared = spark.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, n, best = shared.value
            for batch in batches:
                sums = np.zeros((2, batch.num_rows), np.int64)
                for i, links in enumerate(batch.column(batch.num_columns - 1).to_pylist() if len(known) else ()):
                    codes = np.frombuffer(links, np.uint32)
                    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                    at = at[known[at] == codes]
                    sums[:, i] = best[at].sum(), n[at].sum()
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums[0]), pa.array(sums[1])], schema.names)

        return aligned.select(*(c for c in aligned.columns if c != "links"), "links").mapInArrow(run, schema)

    found = weighed(0)
    for k in range(1, slices):
        found = found.union(weighed(k))
    if slices > 1:
        found = found.groupBy("row").agg(*(F.any_value(c).alias(c) for c in schema.names if c not in ("row", "n_best", "count_sum")), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.select(*(c for c in schema.names if c != "row")).toDF(*names, *added)


def _cuts(aligner: Aligner, found: list[np.ndarray | None]) -> pa.Array:
    sizes, out, count = np.array(aligner.sizes, np.int64), [], [0]
    for x in found:
        own = np.zeros(0, np.int64)
        if x is not None:
            start = np.cumsum(sizes[x]) - sizes[x]
            each = [np.frombuffer(aligner.cuts[i], np.int64) for i in x.tolist()]
            own = np.concatenate(each) + np.repeat(start, [len(e) for e in each])
        out.append(own)
        count.append(count[-1] + len(own))
    return pa.ListArray.from_arrays(pa.array(count, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *out])))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tokenizations of all documents, aligned."""
    found = align(read_table(spark, sf_dir, "documents").select("doc_id", "text"), spans=False)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
