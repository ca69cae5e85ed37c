"""op13: near-duplicate components of all documents by their fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concord.llm import simhash
from concord.llm.registry import query, table


@query("op13_simhash")
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))
