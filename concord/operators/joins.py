"""Merging channels, matching keys and excluding what was already seen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from concord.operators.ranking import first_rows


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys both channels label, with both labels."""
    return a.select(key, F.col("label").alias("a_label")).join(
        b.select(key, F.col("label").alias("b_label")), key
    )


def merge_channels(a: DataFrame, b: DataFrame, key: str, text: str | None = None) -> DataFrame:
    """Full outer merge of two consolidated channels (see ``consolidate``)."""
    def prefixed(df: DataFrame, p: str) -> DataFrame:
        return df.select(key, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != key])

    m = prefixed(a, "a").join(prefixed(b, "b"), key, "full_outer")
    both = F.col("a_label").isNotNull() & F.col("b_label").isNotNull()
    m = m.withColumns({
        "overlap": both.cast("int"),
        "divergence": F.coalesce((F.col("a_label") != F.col("b_label")).cast("int"), F.lit(0)),
        "source": F.when(both, "overlap").when(F.col("b_label").isNotNull(), "b_only").otherwise("a_only"),
    })
    if text:
        m = m.withColumn(text, F.coalesce(f"b_{text}", f"a_{text}")).drop(f"a_{text}", f"b_{text}")
    return m


def join_many_to_one(left: DataFrame, right: DataFrame, on: str, repeated: str = "fail") -> DataFrame:
    """Left join to a table that must have each key once.

    With ``repeated="fail"`` a repeated right key ends the job with an error as
    soon as it meets a left row. ``"first"`` takes the smallest right row and
    goes on. Either way ``right_rows`` tells how many right rows there were, and
    a repeated key never multiplies left rows.
    """
    if repeated not in ("fail", "first"):
        raise ValueError(f"repeated: {repeated}")
    rest = [c for c in right.columns if c != on]
    one = right.groupBy(on).agg(
        F.min(F.struct(*rest)).alias("_row"), F.count(F.lit(1)).alias("right_rows")
    )
    rows = F.coalesce("right_rows", F.lit(0))
    if repeated == "fail":
        message = F.concat(F.lit("more than one right row for key "), F.col(on).cast("string"))
        rows = F.when(rows > 1, F.raise_error(message).cast("long")).otherwise(rows)
    return left.join(one, on, "left").select(
        *left.columns, *[F.col(f"_row.{c}").alias(c) for c in rest], rows.alias("right_rows"),
    )


def tiered_match(left: DataFrame, right: DataFrame, tiers: dict[str, str], left_id: str, right_id: str) -> DataFrame:
    """Best match per left id: earlier tiers win, then the smallest ids.

    Both sides are reduced to their first row per tier key, so each tier is
    one-to-one and a hot key cannot multiply. All tiers go through one pass over
    each side, in which its keys are made once, and one aggregation.
    """
    keys = [f"_key{rank}" for rank in range(len(tiers))]

    def keyed(df: DataFrame, own: str, is_left: bool) -> DataFrame:
        found = [(rank, F.col(key)) for rank, key in enumerate(tiers.values())]
        each = F.filter(F.array(*[F.when(c.isNotNull(), F.lit(rank)) for rank, c in found]), lambda t: t.isNotNull())
        long = df.select(F.col(own).alias("_id"), *[c.alias(f"_key{rank}") for rank, c in found], F.explode(each).alias("_tier"))
        side = F.col("_id"), F.lit(None)
        return long.select(
            "_tier", *[F.when(F.col("_tier") == rank, F.col(k)).alias(k) for rank, k in enumerate(keys)], F.lit(is_left).alias("_left"),
            side[not is_left].alias("left_id"), side[is_left].alias("right_id"))

    both = keyed(left, left_id, True).unionByName(keyed(right, right_id, False))
    hits = both.groupBy("_tier", *keys).agg(
        F.min("left_id").alias("left_id"), F.min("right_id").alias("right_id"), F.min("_left").alias("_lo"), F.max("_left").alias("_hi"))
    hits = hits.where("_lo <> _hi").select("left_id", "right_id", F.element_at(F.lit(list(tiers)), F.col("_tier") + 1).alias("match"), "_tier")
    return first_rows(hits, ["left_id"], ["_tier", "right_id"]).select("left_id", "right_id", "match")


def overlap_flags(df: DataFrame, refs: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One boolean column per reference: is the row's key among its keys?

    ``refs`` maps a flag name to (reference table, key column in both).
    """
    for flag, (ref, key) in refs.items():
        keys = ref.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_hit", F.lit(True))
        df = df.join(keys, key, "left").withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_hit")
    return df


def derived_overlap(coarse: str, fine: str, fragments: Column) -> dict[str, Column]:
    only = F.col(coarse) & ~F.col(fine)
    return {"coarse_only_fragments": only & fragments, "coarse_only_single": only & ~fragments}


def exclude_seen(df: DataFrame, ref: DataFrame, key: str) -> DataFrame:
    return df.join(ref.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def lookup(df: DataFrame, mapping: DataFrame, key: str, value: str, default) -> DataFrame:
    """Dictionary lookup; rows without an entry get ``default``."""
    return df.join(mapping.select(key, value), key, "left").withColumn(
        value, F.coalesce(F.col(value), F.lit(default))
    )


def pairwise_identity(df: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """For each pair of named vectors: how many values differ, by how much, correlation.

    ``name`` takes few values (arms), so the join multiplies an item's rows
    only by the number of arms.
    """
    l = df.select(key, F.col(name).alias("left"), F.col(value).alias("a"))
    r = df.select(key, F.col(name).alias("right"), F.col(value).alias("b"))
    gap = F.abs(F.col("a") - F.col("b"))
    return (
        l.join(r, key).where("left < right").groupBy("left", "right").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(gap > F.lit(1e-8) + F.lit(1e-5) * F.abs("b")).alias("different"),
            F.max(gap).alias("max_abs_diff"),
            F.corr("a", "b").alias("correlation"),
        )
    )


def cluster_members(a: DataFrame, b: DataFrame, coarse: str, fine: str) -> DataFrame:
    """Fine keys both channels know, under their coarse key."""
    cols = [F.col(coarse), F.col(fine)]
    ok = F.col(coarse).isNotNull() & F.col(fine).isNotNull()
    return a.where(ok).select(*cols).intersect(b.where(ok).select(*cols))


def item_refs(df: DataFrame, key: str, refs: str = "refs") -> DataFrame:
    """Long membership table instead of a dense item x reference matrix."""
    return df.select(key, F.explode(refs).alias("ref")).distinct()


def check_alignment(a: DataFrame, b: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Do both tables hold the same keys with the same values?"""
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(key, F.lit(True).alias(f"in_{p}"), *[F.col(c).alias(f"{p}_{c}") for c in cols])

    m = side(a, "a").join(side(b, "b"), key, "full_outer")
    present = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    return m.agg(
        F.count_if(F.col("in_b").isNull()).alias("only_a"),
        F.count_if(F.col("in_a").isNull()).alias("only_b"),
        *[
            F.count_if(present & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(f"differ_{c}")
            for c in cols
        ],
    )
