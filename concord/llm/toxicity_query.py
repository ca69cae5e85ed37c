"""op1: every document scored, learned from the documents that are not held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from concord.llm import toxicity
from concord.llm.registry import id_remainder, query, table


def document_labels(labels: DataFrame) -> DataFrame:
    """One label per document: toxic if any of its labels says so."""
    return labels.where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = document_labels(table(spark, sf_dir, "labels")).where(id_remainder("doc_id", 5) != 0)
    model = toxicity.fit(docs, known)
    return docs.select(
        "doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"),
        toxicity.score(F.col("text"), model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
