"""op7: the 20 nearest of every twentieth embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from concord.llm import forest
from concord.llm.registry import query, table


@query("op7_forest")
def op7_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forest.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return found.withColumnRenamed("id", "vec_id").select("query_id", "rank", "vec_id", "score")
