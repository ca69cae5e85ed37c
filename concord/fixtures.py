"""Views with the roles of the package's inputs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from concord.functions.columns import hash_uniform
from concord.functions.keys import word_set
from concord.session import dealt

# Total order within an order key; (l_orderkey, l_linenumber) alone is not unique.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
ARMS = ["A", "B", "C"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "*",
        F.col("l_orderkey").cast("string").alias("ck"),
        F.concat_ws("|", F.col("l_orderkey"), (F.col("l_linenumber") % 2)).alias("fk"),
        F.struct(*LINE_ORDER).alias("ord"),
        F.array(F.concat(F.lit("S"), F.col("l_suppkey"))).alias("refs"),
    )


def obs_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where("l_linenumber <= 3").select(
        "ck", "fk", "ord", (F.col("l_linestatus") == "O").cast("int").alias("label"), "refs"
    )


def obs_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where("l_returnflag <> 'N'").select(
        "ck", "fk", "ord", (F.col("l_returnflag") == "R").cast("int").alias("label")
    )


def obs_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where("l_linenumber >= 4").select(
        "ck", "ord", F.round(F.col("l_discount") - 0.05, 3).alias("value"), "refs"
    )


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _lines(spark, sf_dir)
        .groupBy(F.col("ck").alias("item"), (F.col("l_suppkey") % 5).cast("int").alias("source"))
        .agg(F.min_by((F.col("l_linestatus") == "O").cast("int"), F.col("ord")).alias("label"))
    )


def wide_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per item: view, gold and one column per arm."""
    k = F.get_json_object("props", "$.k").cast("double")
    a = F.col("value") / (F.lit(1.0) + F.col("value"))
    b = k / F.lit(99.0)
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 3).cast("int").alias("view"),
        F.col("event_id").alias("item_id"),
        F.col("event_type").isin("purchase", "signup").cast("int").alias("gold"),
        a.alias("A"), b.alias("B"), ((a + b) / F.lit(2.0)).alias("C"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form (view, arm, item_id, gold, pred)."""
    return wide_predictions(spark, sf_dir).unpivot(
        ["view", "item_id", "gold"], ARMS, "arm", "pred"
    )


def seeded_predictions(spark: SparkSession, sf_dir: str, seeds: int = 4) -> DataFrame:
    """The long form once per seed, each with its own repeatable jitter."""
    jitter = (hash_uniform(F.col("seed"), F.col("item_id")) - 0.5) * 0.1
    # A seed's jitter is the same for all arms of an item, so it is made before the arms become rows.
    # A few bytes of events become many rows, so items are dealt out first, once their props are read.
    wide = dealt(wide_predictions(spark, sf_dir)).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    long = wide.withColumn("_jitter", jitter).unpivot(["view", "item_id", "gold", "seed", "_jitter"], ARMS, "arm", "pred")
    return long.select(
        "view", "arm", "seed", "item_id", "gold",
        F.greatest(F.least(F.col("pred") + F.col("_jitter"), F.lit(1.0)), F.lit(0.0)).alias("pred"))


def assay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an id, an ordinal class and a measurement that may be censored.

    A slice of the ids comes twice, the second time with a shifted value.
    """
    base = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_type").alias("ordinal"),
        F.col("p_size").alias("size"),
    )
    again = base.where(F.substring(F.md5(F.col("id").cast("binary")), 1, 2) < "03").withColumn(
        "size", F.col("size") + 1
    )
    measure = F.when(F.col("size") >= 40, F.concat(F.lit(">"), F.col("size"))).otherwise(
        F.col("size").cast("string")
    )
    return (
        base.withColumn("ord", F.lit(0)).unionByName(again.withColumn("ord", F.lit(1)))
        .select("id", "ordinal", measure.alias("measure"), "ord")
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a fine and a coarse text key and their optional labels."""
    tidy = F.lower(F.regexp_replace(F.trim("text"), "[ \\t\\n\\r\\f]+", " "))
    keyed = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", "text",
        F.md5(tidy.cast("binary")).alias("canon_key"),
        word_set(F.col("text")).alias("parent_key"),
    )
    return keyed.join(table(spark, sf_dir, "labels"), "doc_id", "left")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")
