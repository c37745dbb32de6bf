"""BPE encoding and decoding by speculation and verification.

The tokens of a word are guessed by greedy longest match. A token sequence is what merging
gives exactly if merging gives back each adjacent pair of its tokens, so all pairs of a batch
are looked up at once in a table of pairs known to hold or not, and only words with a pair
that does not hold are merged step by step.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm.common import read_table, worker_state

#: Words that a Python worker remembers; a full memo is emptied.
MEMO = 400_000
#: Bits of the table of merges, and the odd factor that spreads pairs over it.
TABLE, HASH = 18, np.uint64(0x9E3779B97F4A7C15)
#: Words that are merged together.
BLOCK = 8192
#: A longer word is merged by itself.
LONG = 200
#: The way words are cut that ``PLAIN`` follows, for a text with no character that ``BEYOND`` finds.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-zß-öø-ÿ0-9]+")
BEYOND = re.compile(r"[^\x00-\x1b\x20-\x7fß-öø-ÿ]")


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Encodes and decodes with a word-end BPE vocabulary file; ``memo`` bounds what it remembers."""

    def __init__(self, path: str, memo: int = MEMO, speculate: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.end = path, spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.vocab = vocab
        self.names = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {vocab[a] << 20 | vocab[b]: i for i, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        pieces = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pattern = regex.compile(pieces)
        self.letters = _byte_letters()
        self.latin = "".join(self.letters[b] for b in range(256))
        code = np.array(list(self.rank), np.int64)
        at = (code.view(np.uint64) * HASH >> np.uint64(64 - TABLE)).astype(np.int64)
        self.slot_code, self.slot_rank = np.full(1 << TABLE, -1), np.zeros(1 << TABLE, np.int64)
        self.slot_code[at], self.slot_rank[at] = code, np.arange(len(code))
        spilled = np.flatnonzero(self.slot_code[at] != code)
        spilled = spilled[np.argsort(code[spilled])]
        self.spilled_code, self.spilled_rank = code[spilled], spilled
        self.made_ids = np.array(self.made)
        self.letter_ids, self.last_letter_ids = np.zeros(512, np.int64), np.zeros(512, np.int64)
        for c in self.letters.values():
            self.letter_ids[ord(c)], self.last_letter_ids[ord(c)] = vocab[c], vocab[c + self.end]
        n = len(self.end)
        self.last = {t[:-n]: i for t, i in vocab.items() if t.endswith(self.end) and len(t) > n}
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(self.end) and t not in self.special}
        #: By the first three letters, the longest inner token.
        self.reach: dict[str, int] = {}
        for t in self.inner:
            self.reach[t[:3]] = max(self.reach.get(t[:3], 1), len(t))
        self.longest_last = max(map(len, self.last))
        self.pairs: dict[int, bool] = {}
        self.plain, self.speculate = pieces == CUT, speculate
        self.memo_size, self.memo = memo, {" " + t: array("I", [i]).tobytes() for t, i in self.special.items()}
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging: always the adjacent pair of lowest rank, leftmost first."""
        get, none, made = self.rank.get, len(self.made), self.made
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            ids[i : i + 2] = [made[low]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], none)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """Exact merging of a long word by a heap of pairs, in time linear but for a logarithm."""
        get, made, n = self.rank.get, self.made, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, code) for i, code in enumerate(a << 20 | b for a, b in zip(ids, ids[1:])) if (r := get(code)) is not None]
        heapify(heap)
        while heap:
            r, i, code = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or ids[i] << 20 | ids[j] != code:
                continue  # one of the two is part of another token by now
            ids[i], ids[j] = made[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get(code := ids[i] << 20 | ids[k])) is not None:
                    heappush(heap, (r, i, code))
            if (h := before[i]) >= 0 and (r := get(code := ids[h] << 20 | ids[i])) is not None:
                heappush(heap, (r, h, code))
        return [x for x in ids if x >= 0]

    def _merged(self, word: str, closed: bool) -> list[int]:
        ids = list(map(self.inner.__getitem__, word))
        if closed:
            ids[-1] = self.last[word[-1]]
        return self.merge(ids)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of ids, or the number of merges: a hash table with two places a pair."""
        code = a << 20 | b
        at = (code.view(np.uint64) * HASH >> np.uint64(64 - TABLE)).astype(np.int64)
        out = np.where(self.slot_code[at] == code, self.slot_rank[at], len(self.made))
        if len(self.spilled_code):
            k = np.minimum(np.searchsorted(self.spilled_code, code), len(self.spilled_code) - 1)
            np.copyto(out, self.spilled_rank[k], where=self.spilled_code[k] == code)
        return out

    def merge_many(self, words: list[str]) -> list[bytes]:
        """Exact merging of many words at once, by length: each round merges the lowest pair of every word. Words of over LONG letters are merged one by one."""
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) <= LONG:
                by_length.setdefault(len(w), []).append(k)
            else:
                letters = np.frombuffer(w.encode("utf-32-le"), "<u4")
                out[k] = array("I", self.merge_long([*self.letter_ids[letters[:-1]].tolist(), int(self.last_letter_ids[letters[-1]])])).tobytes()
        none = len(self.made)
        for length, members in by_length.items():
            for lo in range(0, len(members), BLOCK):
                rows = members[lo : lo + BLOCK]
                letters = np.frombuffer("".join([words[k] for k in rows]).encode("utf-32-le"), "<u4").reshape(-1, length)
                ids = self.letter_ids[letters]
                ids[:, -1] = self.last_letter_ids[letters[:, -1]]
                final, size = ids.copy(), np.full(len(ids), length)
                live = np.arange(len(ids))
                ranks = self._ranks(ids[:, :-1], ids[:, 1:]) if length > 1 else np.zeros((len(ids), 0), np.int64)
                width = length
                while width > 1 and len(live):
                    at = ranks.argmin(1)
                    row = np.arange(len(live))
                    low = ranks[row, at]
                    done = low >= none
                    if done.any():
                        final[live[done], :width], size[live[done]] = ids[done], width
                        go = ~done
                        live, ids, ranks, at, low = live[go], ids[go], ranks[go], at[go], low[go]
                        row = np.arange(len(live))
                        if not len(live):
                            break
                    # every live word has had one merge a round, so all have the same number of tokens
                    ids[row, at] = self.made_ids[low]
                    column = np.arange(width - 1)
                    ids = np.take_along_axis(ids, column + (column > at[:, None]), 1)
                    width -= 1
                    if width == 1:
                        break
                    column = column[:-1]
                    ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), 1)
                    right, left = at < width - 1, at > 0
                    r, c = row[right], at[right]
                    ranks[r, c] = self._ranks(ids[r, c], ids[r, c + 1])
                    r, c = row[left], at[left]
                    ranks[r, c - 1] = self._ranks(ids[r, c - 1], ids[r, c])
                if len(live):
                    final[live, :width], size[live] = ids, width
                for n in np.unique(size).tolist():
                    of = np.flatnonzero(size == n)
                    whole = final[of, :n].astype("<u4").tobytes()
                    for i, k in enumerate(of.tolist()):
                        out[rows[k]] = whole[4 * n * i : 4 * n * (i + 1)]
        return out

    def _guess(self, word: str) -> list[int]:
        """Greedy longest match from the left."""
        out, i, n = [], 0, len(word)
        last, inner, reach, most = self.last, self.inner, self.reach, self.longest_last
        while True:
            if n - i <= most and (t := last.get(word[i:])) is not None:
                out.append(t)
                return out
            for j in range(min(i + reach.get(word[i : i + 3], 2), n - 1), i, -1):
                if (t := inner.get(word[i:j])) is not None:
                    break
            out.append(t)
            i = j

    def _pair_holds(self, code: int) -> bool:
        a, b = self.names[code >> 20], self.names[code & 0xFFFFF]
        closed = b.endswith(self.end)
        whole = a + (b[: -len(self.end)] if closed else b)
        return self._merged(whole, closed) == [code >> 20, code & 0xFFFFF]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Token ids of words in byte letters: guessed, verified, and merged where the guess fails."""
        guesses = [self._guess(w) for w in words]
        size = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), np.int64, int(size.sum()))
        inside = np.ones(len(flat), bool)
        inside[np.cumsum(size) - 1] = False
        at = np.flatnonzero(inside)
        codes, inverse = np.unique(flat[at] << 20 | flat[np.minimum(at + 1, len(flat) - 1)], return_inverse=True)
        known = self.pairs
        if len(known) > 8 * self.memo_size:
            known.clear()
        holds = np.empty(len(codes), bool)
        for i, code in enumerate(codes.tolist()):
            if (ok := known.get(code)) is None:
                ok = known[code] = self._pair_holds(code)
            holds[i] = ok
        word = np.repeat(np.arange(len(guesses)), size)
        wrong = np.unique(word[at[~holds[inverse]]])
        out = [array("I", g).tobytes() for g in guesses]
        wrong = wrong.tolist()
        for w, ids in zip(wrong, self.merge_many([words[w] for w in wrong])):
            out[w] = ids
        return out

    def pretokens(self, text: str) -> list[str]:
        """The words and signs of a stretch of text without a special token, normalised."""
        raw = text
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # letter by letter: no final sigma
        if self.plain and not BEYOND.search(text):
            return PLAIN.findall(text)
        if any(unicodedata.category(c) == "Cn" for c in set(text)):
            # what is a letter there depends on the version of Unicode: the library's own cut, marked as byte letters
            return ["\n" + w for w, _ in self.cutter.pre_tokenizer.pre_tokenize_str(self.cutter.normalizer.normalize_str(raw))]
        return self.pattern.findall(text)

    @cached_property
    def cutter(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def byte_letters(self, word: str) -> str:
        if word[0] == "\n":
            return word[1:]
        return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.latin)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split: list[list[str]] = []
        for text in texts:
            if "<|" in text and self.special_pattern and self.special_pattern.search(text):
                parts: list[str] = []
                at = 0
                for m in self.special_pattern.finditer(text):
                    parts += self.pretokens(text[at : m.start()])
                    parts.append(" " + m[0])  # with a blank, which no word has
                    at = m.end()
                split.append(parts + self.pretokens(text[at:]))
            else:
                split.append(self.pretokens(text))
        memo = self.memo
        new = set().union(*split).difference(memo)  # looks the words up; difference_update would walk over the memo
        if len(memo) + len(new) > self.memo_size:
            memo.clear()
            memo.update({" " + t: array("I", [i]).tobytes() for t, i in self.special.items()})
            new = set().union(*split).difference(memo)
        if new:
            words = list(map(self.byte_letters, new))
            memo.update(zip(new, self.encode_words(words) if self.speculate else self.merge_many(words)))
        return [b"".join(map(memo.__getitem__, parts)) for parts in split]

    def decode(self, ids: bytes) -> str:
        """Tokens joined by blanks, as a vocabulary file without a decoder asks for."""
        return " ".join(map(self.names.__getitem__, array("I", ids)))


def encoder(path: str, speculate: bool = True) -> Encoder:
    """The encoder of this Python worker for a vocabulary file; without ``speculate`` it merges every new word."""
    return worker_state(("bpe", path, speculate), lambda: Encoder(path, speculate=speculate))


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), slices: int = 256) -> DataFrame:
    """The columns ``keep``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers) and ``decoded``.

    A null text counts as empty and gives no ids and an empty ``decoded``. A text of any length
    is encoded whole. Rows come out as often as they go in; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, slices):
                part = batch.slice(lo, slices)
                ids = e.encode_batch(part.column(0).to_pylist())
                decoded = list(map(e.decode, ids))
                columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], [*part.schema.names[1:], "n_tokens", "ids", "decoded"])

    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), *keep)
    schema = rows.drop("_text").schema.add("n_tokens", "long").add("ids", "binary").add("decoded", "string")
    return rows.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``decoded``, from a column of ids as ``encode_documents`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            out = [e.decode(x or b"") for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.string())], [*batch.schema.names[1:], "decoded"])

    rows = encoded.select(F.col(ids).alias("_ids"), *keep)
    return rows.mapInArrow(run, rows.drop("_ids").schema.add("decoded", "string"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and the decoded text of all documents."""
    found = encode_documents(read_table(spark, sf_dir, "documents"), public_vocabulary())
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
