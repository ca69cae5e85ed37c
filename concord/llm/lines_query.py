"""op6: every document without the passages that an earlier one has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concord.llm import lines
from concord.llm.registry import query, table


@query("op6_line_dedup")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
