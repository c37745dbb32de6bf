"""A corpus pipeline: each stage reads what the one before it wrote.

Every stage takes documents with null or repeated ids, null, empty or very long texts and further
columns of any name, which pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm import bpe, langid, linededup, packing, quality, simhash, sketches
from barspark.llm.common import materialize, read_table
from barspark.llm.graph import components

#: A document with a lower posterior of its language is rejected.
LEAST_POSTERIOR = 0.5
#: Words of a shingle of the near-duplicate stage, and how far the shingles of near-duplicates overlap at least.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def _aside(docs: DataFrame, *needed: str) -> DataFrame:
    """``docs`` with all but the columns ``needed`` under names that no operator uses."""
    return docs.toDF(*[c if c in needed else f"own_{k}" for k, c in enumerate(docs.columns)])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and the perplexity bands keep. A null or empty text fails the rules."""
    own = _aside(docs, "text", "lang")
    return quality.judge(own).where("kept").select(*own.columns).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in one learned language; ``lang`` becomes that language.

    The model is fitted on the documents of the stage that have a language and are not held out.
    Documents without a letter go, as do those with too low a posterior or too small a lead, letter by
    letter, over the next language: texts in no learned language, or half in another. If no
    document has a language, none is recognised.
    """
    own = _aside(docs, "doc_id", "text", "lang")
    model = langid.fit(own.where(~langid.held_out() & F.col("doc_id").isNotNull()))
    found = materialize(langid.predict(own, model), "languages")
    kept = langid.recognised(found).where(F.col("lang_score") >= LEAST_POSTERIOR)
    return kept.withColumn("lang", F.col("lang_pred")).select(*own.columns).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; one that loses all its text goes.

    ``n_chars`` becomes the length of the text that is left. Rows of one id are one document, and a
    null id is the last one.
    """
    own = _aside(docs, "doc_id", "text", "n_chars")
    found = linededup.deduplicate_lines(own)
    found = found.withColumn("text", F.col("kept_text")).where(F.length(F.trim("text")) > 0)
    if "n_chars" in own.columns:
        found = found.withColumn("n_chars", F.length("text").cast(own.schema["n_chars"].dataType))
    return found.select(*own.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id, and among several texts of that id the one of least hash.

    Documents are grouped if their fingerprints differ in at most three bits, or if the sketches of their shingles agree
    as those of texts do whose shingles overlap by ``SIMILARITY`` or more; groups that share a document are one. It is decided by row, so rows of one id with
    different texts are different documents; equal rows become one. A document with no id stays.
    """
    own = _aside(docs, "doc_id", "text").withColumn("node", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    marked = materialize(simhash.near_duplicates(own, words=SHINGLE_WORDS, keep=("node",)).select("doc_id", "root", "node").distinct(), "marked")
    stars = marked.groupBy("root").agg(F.min("node").alias("low"))
    alike = sketches.similar(own.select("node", "text"), SHINGLE_WORDS, SIMILARITY)
    groups = components(marked.join(stars, "root").select(F.col("node").alias("a"), F.col("low").alias("b")).where("a <> b").union(alike))
    grouped = marked.join(groups, "node", "left").withColumn("group", F.coalesce(groups["root"], "node")).where("doc_id is not null")
    keep = materialize(grouped.groupBy("group").agg(F.min(F.struct("doc_id", "node")).alias("one")).select("one.*"), "kept_rows")
    known = own.where("doc_id is not null").join(keep, ["doc_id", "node"], "left_semi").dropDuplicates(["doc_id", "node"])
    return known.union(own.where("doc_id is null").select(*known.columns)).select(*_aside(docs, "doc_id", "text").columns).toDF(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences. A null text is an empty one: a piece of its end token."""
    return packing.pack_documents(docs, bpe.public_vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: The stages' models are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
