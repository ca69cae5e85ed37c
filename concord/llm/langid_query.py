"""op4: the language of every document, learned from those that are not held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from concord.llm import langid
from concord.llm.registry import id_remainder, query, table


@query("op4_langid")
def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(id_remainder("doc_id", 4) != 2))
    found = docs.select(
        "doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), langid.predict(F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")
