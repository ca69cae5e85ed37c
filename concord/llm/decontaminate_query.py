"""op2: the documents that hold benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from concord.llm import decontaminate
from concord.llm.registry import query, table


@query("op2_decontamination")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "first_word", "n_words", "n_equal")
