"""op9: conversations read as tool use, calls linked with results.

The tables hold plain turns. Every assistant turn is read as a call that quotes
the turn before it and refers to the calls at half and a third of its turn;
every later user turn is the result of the turn before it. Spark derives both
from all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from concord.llm import toolcalls
from concord.llm.registry import query, table

TOOLS = ["lookup", "search", "write"]
SCHEMAS = {
    "lookup": {"properties": {"query": {"type": "string", "minLength": 1}, "n": {"type": "integer", "minimum": 1}},
               "required": ["query", "n"]},
    "search": {"properties": {"query": {"type": "string"}, "n": {"type": "integer", "minimum": 1, "maximum": 200}},
               "required": ["n", "query"]},
    "write": {"properties": {"query": {"type": "string"}, "n": {"type": "integer"}}, "required": ["n"],
              "additionalProperties": False},
}


def derived(talks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of all turns."""
    turns = talks.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))

    def name_of(turn):
        return toolcalls.text_id(F.col("conv_id").cast("string"), turn.cast("string"))

    # One quoted turn for each place: the smallest text, should a place come more than once.
    before = turns.groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min("text").alias("quoted"))
    calls = turns.where("role = 'assistant'").join(before, ["conv_id", "turn"], "left")
    places = F.array_distinct(F.filter(
        F.array(F.floor(F.col("turn") / 2), F.floor(F.col("turn") / 3)), lambda t: (t >= 1) & (t < F.col("turn"))))
    refs = F.transform(places, name_of)
    calls = calls.select(
        "conv_id", name_of(F.col("turn")).alias("call_id"), "turn",
        F.element_at(F.array(*[F.lit(t) for t in TOOLS]), (F.pmod(F.xxhash64("text"), F.lit(3)) + 1).cast("int")).alias("name"),
        F.to_json(F.struct(F.coalesce("quoted", F.lit("")).alias("query"), F.size(F.split("text", " ")).alias("n"))).alias("arguments"),
        refs.alias("refs"))
    roles = turns.where("role = 'assistant'").select("conv_id", F.col("turn").alias("t")).distinct()
    # Only references to turns that are calls.
    single = calls.select("conv_id", "call_id", F.explode("refs").alias("ref")).join(
        roles.select("conv_id", name_of(F.col("t")).alias("ref")), ["conv_id", "ref"], "left_semi")
    calls = calls.drop("refs").join(
        single.groupBy("conv_id", "call_id").agg(F.collect_set("ref").alias("refs")), ["conv_id", "call_id"], "left")
    results = turns.where("role = 'user' AND turn >= 1").select(
        "conv_id", name_of(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


@query("op9_tool_calls")
def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.link(*derived(table(spark, sf_dir, "conversations")), SCHEMAS)
