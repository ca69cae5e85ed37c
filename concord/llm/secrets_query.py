"""op8: secrets in every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from concord.llm import secrets
from concord.llm.registry import query, table


@query("op8_secrets")
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["sure"])

    def count(number: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["sure"] & (s["kind"] == number))).cast("long")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.span_text(base).cast("binary"), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"))
