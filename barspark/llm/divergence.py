"""How a source's terms diverge from those of the other sources of its language.

Terms are counted, shuffled and compared by digests of fixed width. Where digests meet, the least and the
greatest string of a digest tell whether several terms share it; those are split, so counts never mix.
Strings come back for the terms that can be in the result, and for no others.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspark.llm.common import later_pairs, materialize, read_table, release, whole_runs

#: Documents of its language that a term must be in, terms that a group reports, and what probabilities are parts of.
LEAST_DOCUMENTS, TOP, PARTS = 3, 200, 1_000_000_000
#: Terms that a task counts before it sends them on, and bytes of a text that it cuts into terms at a time.
HELD, BLOCK = 400_000, 1 << 22
#: Groups whose sizes are broadcast at once (32 bytes each).
GROUPS = 1 << 18
#: Letters and all that is not ASCII make terms; A-Z are lower-cased; the rest parts them.
_TABLE = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, block by block."""
    lo = 0
    while lo < len(text):
        part = text[lo : lo + BLOCK].translate(_TABLE)
        hi = lo + len(part)
        if hi < len(text):  # end at the last parting, or go on to the next one
            at = part.rfind(b" ")
            while at < 0 and hi < len(text):
                more = text[hi : hi + BLOCK].translate(_TABLE)
                at, part, hi = (x if (x := more.find(b" ")) < 0 else len(part) + x), part + more, hi + len(more)
            if at >= 0:
                hi, part = lo + at, part[:at]
        yield part.split()
        lo = hi + (hi == lo)


def identified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` as ``(lang_id, group_id, text)``, and the groups ``(lang, source, lang_id, group_id)``, whose ids are all different."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    seed = 0
    while True:
        ids = F.xxhash64(F.lit(seed), "lang").alias("lang_id"), F.xxhash64(F.lit(seed), "lang", "source").alias("group_id")
        groups = materialize(rows.select("lang", "source").distinct().select("lang", "source", *ids), "groups")
        size = groups.agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("ids"), F.count_distinct("lang").alias("langs"), F.count_distinct("lang_id").alias("lang_ids")).first()
        if size["n"] == size["ids"] and size["langs"] == size["lang_ids"]:
            return rows.select(*ids, "text"), groups
        seed += 1


#: A group's occurrences of a term, and documents with it, as tasks send them.
_ENTRY = np.dtype([("group", "<i8"), ("n", "<u4"), ("docs", "<u4")])
_KEPT = np.dtype([("group", "<i8"), ("n", "<i8")])


def term_counts(docs: DataFrame, bits: int = 64) -> DataFrame:
    """``docs(lang_id, group_id, text)`` to ``(lang_id, digest, term, counts)``: a row for a term that a task has held, with an entry a group.

    A task counts terms in memory until it holds ``HELD`` of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[tuple[int, int], Counter] = {}
        among: dict[tuple[int, int], Counter] = {}
        held = words_held = 0

        def told() -> Iterator[pa.RecordBatch]:
            for lang in {k[0] for k in times}:
                own = {g: n for (k, g), n in times.items() if k == lang}
                terms = list(set().union(*own.values()))
                number = dict(zip(terms, range(len(terms))))
                at = np.concatenate([np.fromiter(map(number.__getitem__, n), np.int64, len(n)) for n in own.values()])
                entries = np.empty(len(at), _ENTRY)
                entries["group"] = np.repeat(np.fromiter(own, np.int64, len(own)), [len(n) for n in own.values()])
                entries["n"] = np.concatenate([np.fromiter(n.values(), np.int64, len(n)) for n in own.values()])
                entries["docs"] = np.concatenate([np.fromiter(map(among[lang, g].__getitem__, n), np.int64, len(n)) for g, n in own.items()])
                order = np.lexsort((entries["group"], at))
                ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(terms)))]) * _ENTRY.itemsize
                packed = entries[order].tobytes()
                for lo in range(0, len(terms), 50_000):
                    hi = min(lo + 50_000, len(terms))
                    counts = pa.array([packed[x:y] for x, y in zip(ends[lo:hi].tolist(), ends[lo + 1 : hi + 1].tolist())], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, lang)), pa.array(terms[lo:hi], pa.binary()).cast(pa.string()), counts], ["lang_id", "term", "counts"])

        for batch in batches:
            for lang, group, text in zip(*(c.to_pylist() for c in batch.columns)):
                own, docs = times.setdefault((lang, group), Counter()), among.setdefault((lang, group), Counter())
                before, seen = len(own), set()
                for words in _terms(text):
                    own.update(words)
                    seen.update(words)
                    words_held += len(words)
                docs.update(seen)
                held += len(own) - before
                if held >= HELD or words_held >= 1 << 31:
                    yield from told()
                    times, among, held, words_held = {}, {}, 0, 0
        yield from told()

    found = docs.select("lang_id", "group_id", "text").mapInArrow(run, "lang_id long, term string, counts binary")
    digest = F.xxhash64("term") if bits == 64 else F.shiftrightunsigned(F.xxhash64("term"), 64 - bits)
    return found.select("lang_id", digest.alias("digest"), "term", "counts")


def _bytes(column: pa.ChunkedArray | pa.Array) -> tuple[bytes, np.ndarray]:
    """The values of a binary column one after the other, and the length of each."""
    values = column.to_pylist()
    return b"".join(values), np.fromiter(map(len, values), np.int64, len(values))


def _slots(table: pa.Table, start: np.ndarray) -> np.ndarray:
    """Of each row the place of its term among those that share its digest; a run whose least and greatest terms are equal has one."""
    term, slot = table.column("term").combine_chunks(), np.zeros(table.num_rows, np.int64)
    differs = np.zeros(table.num_rows, bool)
    differs[1:] = ~pc.equal(term.slice(1), term.slice(0, max(0, len(term) - 1))).to_numpy(zero_copy_only=False)
    differs[start] = False
    end = np.append(start[1:], table.num_rows)
    for r in np.unique(np.searchsorted(start, np.flatnonzero(differs), "right") - 1).tolist():
        own = term.slice(start[r], end[r] - start[r]).to_pylist()
        place = {t: k for k, t in enumerate(sorted(set(own)))}
        slot[start[r] : end[r]] = [place[t] for t in own]
    return slot


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the rows of each term of a language, and keeps those in enough documents."""
    for table, start in whole_runs(batches, ["digest", "lang_id"], 100_000):
        run = np.repeat(np.arange(len(start)), np.diff(np.append(start, table.num_rows)))
        slot = _slots(table, start)
        term_of, first = np.unique(run * (slot.max() + 1) + slot, return_index=True)
        at = np.searchsorted(term_of, run * (slot.max() + 1) + slot)
        packed, size = _bytes(table.column("counts"))
        entries = np.frombuffer(packed, _ENTRY)
        at = np.repeat(at, size // _ENTRY.itemsize)
        order = np.lexsort((entries["group"], at))
        at, entries = at[order], entries[order]
        new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (entries["group"][1:] != entries["group"][:-1])))
        n, docs = (np.add.reduceat(entries[c].astype(np.int64), new) for c in ("n", "docs"))
        at, group = at[new], entries["group"][new]
        among = np.bincount(at, docs, len(term_of)) >= LEAST_DOCUMENTS
        stay = among[at]
        out = np.empty(stay.sum(), _KEPT)
        out["group"], out["n"] = group[stay], n[stay]
        ends = np.concatenate([[0], np.cumsum(np.bincount(at[stay], minlength=len(term_of))[among])]) * _KEPT.itemsize
        packed, rows = out.tobytes(), pa.array(first[among])
        counts = pa.array([packed[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())
        one = table.select(["lang_id", "digest", "term"]).take(rows).combine_chunks()
        yield from pa.table([one.column("lang_id"), one.column("digest"), pa.array(slot[first[among]].astype(np.int32)), one.column("term"), counts], names=["lang_id", "digest", "slot", "term", "counts"]).to_batches()


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By group, occurrences and terms; by language, the same."""
    for batch in batches:
        packed, size = _bytes(batch.column(1))
        entries, lang = np.frombuffer(packed, _KEPT), batch.column(0).to_numpy()
        langs, of_lang = np.unique(lang, return_inverse=True)
        groups, of_group = np.unique(entries["group"], return_inverse=True)
        sums = np.zeros(len(langs) + len(groups), np.int64)
        np.add.at(sums, np.repeat(of_lang, size // _KEPT.itemsize), entries["n"])
        np.add.at(sums, of_group + len(langs), entries["n"])
        terms = np.concatenate([np.bincount(of_lang, minlength=len(langs)), np.bincount(of_group, minlength=len(groups))])
        whole = np.arange(len(sums)) < len(langs)
        yield pa.RecordBatch.from_arrays([pa.array(whole), pa.array(np.concatenate([langs, groups])), pa.array(sums), pa.array(terms)], ["whole", "id", "size", "terms"])


def share(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(PARTS * ``n`` / ``of``), exact for ``n`` up to ``of`` up to 2^53, by three digits at a time."""
    found, rest = np.divmod(n, of)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, of)
        found = found * 1000 + more
    return 1 + found


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


PAIR, TERM, OFTEN = 0, 1, 2


def _measured(batches: Iterator[pa.RecordBatch], known: dict[str, np.ndarray], top: int) -> Iterator[pa.RecordBatch]:
    """Of kept terms, in rows ``(kind, group_id, other, slot, value)``:

    sums, by pair of groups, of what terms that both have differ by from terms that one of them lacks; digests that may be
    among a group's ``top`` and their values; and how often each probability occurs in a group.
    """
    held: list[tuple[np.ndarray, ...]] = []

    def rows(kind: int, group: np.ndarray, other: np.ndarray, slot: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(group), kind, np.int32)), pa.array(group), pa.array(other), pa.array(slot.astype(np.int32)), pa.array(value)], ["kind", "group_id", "other", "slot", "value"])

    def leading() -> tuple[np.ndarray, ...]:
        """What is held without values that ``top`` of the group exceed; ties stay."""
        group, digest, slot, value = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((-value, group))
        group, digest, slot, value = group[order], digest[order], slot[order], value[order]
        new = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(new, len(group)))
        least = np.where(size >= top, value[np.minimum(new + top - 1, len(value) - 1)], -1)
        stay = value >= np.repeat(least, size)
        return group[stay], digest[stay], slot[stay], value[stay]

    for batch in batches:
        for lo in range(0, batch.num_rows, 50_000):
            part = batch.slice(lo, 50_000)
            packed, size = _bytes(part.column(part.schema.get_field_index("counts")))
            if not packed:
                continue
            entries, many = np.frombuffer(packed, _KEPT), size // _KEPT.itemsize
            digest, slot = (np.repeat(part.column(c).to_numpy(), many) for c in ("digest", "slot"))
            n, group = entries["n"], entries["group"]
            at = np.searchsorted(known["group_id"], group)
            z, begin = known["z"][at], np.cumsum(many) - many
            p = share(n + 1, known["size"][at])
            q = share(np.repeat(np.add.reduceat(n, begin), many) + 1, known["lang_size"][at])
            out = np.flatnonzero(p > q)
            held.append((group[out], digest[out], slot[out], _apart(p[out], q[out])))
            if sum(len(x[0]) for x in held) > 500_000:
                held = [leading()]
                if len(held[0][0]) > 250_000:
                    yield rows(TERM, *held[0])
                    held = []
            codes, times = np.unique(np.stack([at, p]), axis=1, return_counts=True)
            yield rows(OFTEN, known["group_id"][codes[0]], codes[1], np.zeros(len(times)), times)
            ids, own = np.unique(at, return_inverse=True)
            for i, j in later_pairs(np.arange(len(p)), np.repeat(begin + many, many), 1_000_000):
                i, j = np.concatenate([i, j]), np.concatenate([j, i])
                value = _apart(p[i], p[j]) - _apart(p[i], z[j]) - _apart(z[i], p[j]) + _apart(z[i], z[j])
                code, inverse = np.unique(own[i] * len(ids) + own[j], return_inverse=True)
                total = np.zeros(len(code), np.int64)
                np.add.at(total, inverse, value)
                yield rows(PAIR, known["group_id"][ids[code // len(ids)]], known["group_id"][ids[code % len(ids)]], np.zeros(len(code)), total)
    if held:
        yield rows(TERM, *leading())


def audit(docs: DataFrame, bits: int = 64, top: int = TOP, most: int = GROUPS) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of all groups ``(lang, source)`` of ``docs(lang, source, text)``.

    Part ``pair`` compares a group with each other source of its language, over all terms kept in the language; part
    ``term`` has the ``top`` terms by which a group stands out from its language. Null columns are read
    as empty, so they make groups of their own; texts of any length are counted whole; repeated rows are documents
    of their own; ties go to the smaller item; further columns are ignored; an empty table gives an empty table.
    A language has a row a pair of its sources in the result, so its sources are taken to be few; its terms, and the languages, may be any number.

    For a pair of groups, terms that neither has are told by their number, and terms that one of them has by how often each
    probability occurs in it. Only terms that both have are compared one by one, and summed where they are compared. The sizes of
    ``most`` groups or so are broadcast at once; languages beyond that are taken in further passes over the kept terms.
    """
    spark = docs.sparkSession
    rows, groups = identified(docs)
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = term_counts(rows, bits).repartition(number, "digest", "lang_id").sortWithinPartitions("digest", "lang_id")
    kept = materialize(dealt.mapInArrow(_kept, "lang_id long, digest long, slot int, term string, counts binary"), "kept_terms")

    sizes = kept.select("lang_id", "counts").mapInArrow(_sizes, "whole boolean, id long, size long, terms long").groupBy("whole", "id").agg(F.sum("size").alias("size"), F.sum("terms").alias("terms"))
    of_group = sizes.where("not whole").select(F.col("id").alias("group_id"), F.col("size").alias("own_size"), F.col("terms").alias("own"))
    of_lang = sizes.where("whole").select(F.col("id").alias("lang_id"), F.col("size").alias("all_size"), "terms")
    stats = groups.join(of_group, "group_id", "left").join(of_lang, "lang_id", "left").na.fill(0, ["own_size", "own", "all_size", "terms"])
    stats = stats.withColumns({"size": F.greatest(F.col("own_size") + F.col("terms"), F.lit(1)), "lang_size": F.greatest(F.col("all_size") + F.col("terms"), F.lit(1))})
    stats = materialize(stats.withColumn("z", 1 + F.expr(f"{PARTS} div size")), "groups")

    slices, found = max(1, -(-stats.count() // most)), None
    for k in range(slices):
        own = F.pmod("lang_id", F.lit(slices)) == k
        table = stats.where(own).select("group_id", "size", "lang_size", "z").orderBy("group_id").toArrow()
        known = spark.sparkContext.broadcast({c: table.column(c).to_numpy() for c in table.column_names})
        part = kept.where(own).select("digest", "slot", "counts").mapInArrow(lambda x, known=known: _measured(x, known.value, top), "kind int, group_id long, other long, slot int, value long")
        found = part if found is None else found.union(part)
    measured = materialize(found, "measured")

    # terms: the value of the last rank first, by digests alone; then names for all that reach it
    out = measured.where(F.col("kind") == TERM).select("group_id", F.col("other").alias("digest"), "slot", "value")
    by_group = Window.partitionBy("group_id")
    ranked = out.withColumn("rank", F.row_number().over(by_group.orderBy(F.desc("value"), "digest", "slot"))).where(F.col("rank") <= top)
    bound = ranked.groupBy("group_id").agg(F.min("value").alias("bound"))
    near = out.join(bound, "group_id").where("value >= bound").join(stats.select("group_id", "lang_id", "lang", "source"), "group_id")
    named = near.join(kept.select("lang_id", "digest", "slot", "term"), ["lang_id", "digest", "slot"])
    rank = F.row_number().over(by_group.orderBy(F.desc("value"), "item"))
    terms = named.withColumn("item", F.col("term")).withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    # pairs
    often = measured.where(F.col("kind") == OFTEN).groupBy("group_id", F.col("other").alias("p")).agg(F.sum("value").alias("k")).join(stats.select("group_id", "lang_id"), "group_id")
    others = stats.select("lang_id", F.col("group_id").alias("other_id"), F.col("z").alias("other_z"), F.col("own").alias("other_own"), F.col("source").alias("item"))
    exact = lambda k, p, q: F.expr(f"cast({k} as decimal(19, 0)) * cast(({p} - {q}) * ({p} - {q}) div {q} as decimal(19, 0))")
    met = often.join(others, "lang_id").where("group_id <> other_id")
    neither = stats.join(others, "lang_id").where("group_id <> other_id")
    sums = (
        measured.where(F.col("kind") == PAIR).select("group_id", F.col("other").alias("other_id"), F.col("value").cast("decimal(38, 0)").alias("value"))
        .union(met.groupBy("group_id", "other_id").agg(F.sum(exact("k", "p", "other_z"))))
        .union(often.join(stats.select("lang_id", F.col("group_id").alias("other_id"), "z"), "lang_id").where("group_id <> other_id").groupBy("other_id", "group_id").agg(F.sum(exact("k", "z", "p"))))
        .union(neither.select("group_id", "other_id", exact("(terms - own - other_own)", "z", "other_z")))
    )
    pairs = sums.groupBy("group_id", "other_id").agg(F.sum("value").cast("long").alias("value"))
    pairs = pairs.join(stats.select("group_id", "lang", "source"), "group_id").join(others.select("other_id", "item"), "other_id").withColumn("rank", rank)
    result = materialize(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").union(terms), "divergence")
    release(kept, measured)
    return result


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), t AS (
  SELECT id, lang, source, unnest(ts) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), of_lang AS (
  SELECT lang, count(*) AS v, sum(total) AS size FROM kept GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), s AS (
  SELECT lang, source, sum(n) AS size FROM c GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.size, 0) + l.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.total + 1)) // (l.size + l.v)::HUGEINT AS q
  FROM g JOIN kept k ON k.lang = g.lang JOIN of_lang l ON l.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
), summed AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), term AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 200
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
"""
