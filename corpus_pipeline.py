"""A training corpus from raw documents, in five stages of the llm operators.

Every stage reads what the one before it kept. All but the last return the
columns of ``documents``:

- ``toxicity`` drops documents scored 0.5 or more by a machine trained on the
  labelled documents of the table.
- ``line_dedup`` removes passages that an earlier document has; ``n_chars``
  follows the text, and a document of which nothing but blanks remains goes.
- ``near_duplicates`` keeps the document with the smallest id of every group of
  near-duplicates. Each row is judged by its own text; of those kept, one row
  (the smallest text, nulls last) of an id that is repeated stays.
- ``decontamination`` drops documents that hold a benchmark item.
- ``packing`` returns the pieces of what is left with their places in
  sequences of 1024 tokens.

Rows without doc_id pass the first four stages as any others do, except that
nothing is a near-duplicate of them; null texts are kept as they are.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from concord.llm import decontaminate, jaccard, lines, packing, toxicity
from concord.llm.registry import table
from concord.llm.rows import fresh, row_key
from concord.llm.toxicity_query import document_labels
from concord.session import cut_lineage, shared_folder

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None
#: Rows of ids that may be broadcast, after they have been counted.
BROADCAST_ROWS = 500_000


def _few(ids: DataFrame) -> DataFrame:
    ids = cut_lineage(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, document_labels(table(spark, sf_dir, "labels")))
    return docs.where(toxicity.score(F.col("text"), model) < 0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = lines.remove_repeats(docs)
    changed = F.col(fresh(docs, "n_removed")) > 0
    kept = found.where(~changed | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Every (id, text) is judged by its own class, whatever else stands under its id.
    row = row_key("doc_id", "text")
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(row.alias("row"), "doc_id", "text")
    found = jaccard.near_duplicates(texts.select(F.col("row").alias("doc_id"), "text")).select(
        F.col("doc_id").alias("row"), F.col("component_id").alias("part")).distinct()
    member = cut_lineage(found.join(texts.select("row", "doc_id").distinct(), "row"))
    first = member.groupBy("part").agg(F.count("*").alias("many"), F.min(F.struct("doc_id", "row")).alias("first")).where("many > 1")
    gone = member.join(first, "part").where(F.col("row") != F.col("first.row")).select(F.col("row").alias("_gone"))
    gone = _few(gone)
    kept = docs.join(gone, F.col("text").isNotNull() & (row == F.col("_gone")), "left_anti")
    repeated = cut_lineage(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    order = W.partitionBy("doc_id").orderBy(
        F.col("text").asc_nulls_last(), *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    n = fresh(docs, "n")
    single = kept.join(repeated, "doc_id", "left_semi").withColumn(n, F.row_number().over(order)).where(F.col(n) == 1)
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(single.select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
