"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barspark.llm import divergence, embeddings, linededup, warc
from barspark.llm.alignment import op13_alignment
from barspark.llm.bpe import op5_bpe
from barspark.llm.divergence import op11_source_divergence
from barspark.llm.embeddings import op10_embedding_dedup
from barspark.llm.langid import op6_langid
from barspark.llm.linededup import op8_line_dedup
from barspark.llm.neighbours import op12_nearest
from barspark.llm.packing import op4_pack
from barspark.llm.quality import op9_quality
from barspark.llm.sharding import op7_sharding
from barspark.llm.simhash import op1_simhash
from barspark.llm.toxicity import op3_toxicity
from barspark.llm.warc import op2_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_simhash, op2_warc, op3_toxicity, op4_pack, op5_bpe, op6_langid, op7_sharding, op8_line_dedup, op9_quality, op10_embedding_dedup, op11_source_divergence, op12_nearest, op13_alignment)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Twins of the queries that SQL can express; the others are tested against brute force."""
    return {"op2_warc": warc.ORACLE, "op8_line_dedup": linededup.ORACLE, "op10_embedding_dedup": embeddings.ORACLE, "op11_source_divergence": divergence.ORACLE}
