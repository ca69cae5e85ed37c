"""Conflict audits between two label channels under every merging rule."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from concord.functions.tails import sign_test
from concord.operators.ranking import carried, running_sums, spread_buckets

MODES = ("first", "majority")
FILTERS = ("all", "consistent")


def label_summary(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: first and majority label, counts and the conflict flag.

    Every aggregate combines map-side; no distinct is needed, since a 0/1 label
    conflicts exactly when its smallest and largest value differ.
    """
    known = [F.col(k).isNotNull() for k in keys]
    n, ones = F.col("n"), F.col("ones")
    return (
        obs.where(reduce(lambda a, b: a & b, known))
        .groupBy(*keys)
        .agg(
            F.min_by("label", "ord").alias("first"),
            F.count("label").alias("n"),
            F.sum("label").cast("bigint").alias("ones"),
            (F.min("label") != F.max("label")).alias("conflict"),
        )
        .withColumn(
            "majority",
            F.when(2 * ones == n, F.lit(None).cast("int")).otherwise((2 * ones > n).cast("int")),
        )
    )


def first_label(obs: DataFrame, key: str) -> DataFrame:
    return label_summary(obs, [key]).select(key, F.col("first").alias("label"))


def majority_label(obs: DataFrame, key: str) -> DataFrame:
    return label_summary(obs, [key]).select(key, F.col("majority").alias("label"), "n", "ones")


def conflict_keys(obs: DataFrame, key: str) -> DataFrame:
    return label_summary(obs, [key]).where("conflict").select(key)


def soft_label(obs: DataFrame, key: str) -> DataFrame:
    return obs.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg("label").alias("soft"))


def merge_duplicates(obs: DataFrame, key: str) -> DataFrame:
    return obs.groupBy(key).agg((F.avg("label") >= 0.5).cast("int").alias("label"))


def paired_labels(a: DataFrame, b: DataFrame, identities: dict[str, str]) -> DataFrame:
    """Keys known to both channels, for all identity columns in one join.

    ``identities`` names each identity and its column. Both channels are
    stacked by identity, so each is aggregated once and the join reuses that
    partitioning.
    """
    def stacked(obs: DataFrame) -> DataFrame:
        pairs = F.array(*[
            F.struct(F.lit(name).alias("identity"), F.col(column).alias("key"))
            for name, column in identities.items()
        ])
        return obs.select("ord", "label", F.explode(pairs).alias("id")).select(
            "id.identity", "id.key", "ord", "label"
        )

    keys = ["identity", "key"]
    left = label_summary(stacked(a), keys).select(
        *keys, F.col("first").alias("a_first"), F.col("majority").alias("a_majority"),
        F.col("conflict").alias("a_conflict"),
    )
    right = label_summary(stacked(b), keys).select(
        *keys, F.col("first").alias("b_label"), F.col("conflict").alias("b_conflict")
    )
    return left.join(right, keys)


def _in_filter(name: str):
    return F.lit(True) if name == "all" else ~(F.col("a_conflict") | F.col("b_conflict"))


def cell_counts(prefix: str = "") -> dict[tuple[str, str, str], object]:
    """The counting expressions of the four (mode, filter) cells."""
    out = {}
    for mode in MODES:
        a, b = F.col(f"a_{mode}"), F.col("b_label")
        for name in FILTERS:
            kept = _in_filter(name)
            out[mode, name, "total_overlap"] = kept
            out[mode, name, "resolved"] = kept & a.isNotNull()
            out[mode, name, "ties"] = kept & a.isNull()
            out[mode, name, "n01"] = kept & (a == 1) & (b == 0)
            out[mode, name, "n10"] = kept & (a == 0) & (b == 1)
    return out


def conflict_audit(a: DataFrame, b: DataFrame, identities: dict[str, str]) -> DataFrame:
    """One row per rule: overlap, ties, both directions, effect, p and BH q."""
    cells = cell_counts()
    counted = paired_labels(a, b, identities).groupBy("identity").agg(
        *[F.count_if(cond).alias("|".join(cell)) for cell, cond in cells.items()]
    )
    measures = ["total_overlap", "resolved", "ties", "n01", "n10"]
    # One row per identity even where nothing overlaps.
    names = a.sparkSession.createDataFrame([(n,) for n in identities], "identity string")
    rows = F.array(*[
        F.struct(
            F.lit(mode).alias("mode"), F.lit(name).alias("filter"),
            *[F.coalesce(F.col(f"`{mode}|{name}|{m}`"), F.lit(0)).alias(m) for m in measures],
        )
        for mode in MODES for name in FILTERS
    ])
    rules = (
        names.join(counted, "identity", "left")
        .select("identity", F.explode(rows).alias("r")).select("identity", "r.*")
        .withColumn("discordant", F.col("n01") + F.col("n10"))
        .withColumn("rho", direction_effect("n01", "n10"))
        .withColumn("p", sign_test("n01", "n10"))
    )
    return bh_adjust(rules, "p", tie=["identity", "mode", "filter"])


def conflict_trace(a: DataFrame, b: DataFrame, identities: dict[str, str]) -> DataFrame:
    """Every discordant key under every rule, with its direction."""
    cells = F.array(*[
        F.struct(
            F.lit(mode).alias("mode"), F.lit(name).alias("filter"),
            F.col(f"a_{mode}").alias("a_label"), _in_filter(name).alias("kept"),
        )
        for mode in MODES for name in FILTERS
    ])
    return (
        paired_labels(a, b, identities)
        .select("identity", "key", "b_label", F.explode(cells).alias("c"))
        .where("c.kept AND c.a_label <> b_label")
        .select(
            "identity", "c.mode", "c.filter", "key", "c.a_label", "b_label",
            F.when(F.col("c.a_label") == 1, "n01").otherwise("n10").alias("direction"),
        )
    )


def direction_effect(n01: str, n10: str):
    return F.try_divide(F.col(n01).cast("double"), (F.col(n01) + F.col(n10)).cast("double"))


def bh_adjust(df: DataFrame, p: str, family: Sequence[str] = (), tie: Sequence[str] = (), out: str = "q") -> DataFrame:
    """Benjamini-Hochberg q within each family of tests.

    A family is a report (tens of rows), not data, so a plain window fits.
    """
    up = W.partitionBy(*family).orderBy(F.col(p), *tie)
    down = W.partitionBy(*family).orderBy(F.col(p).desc(), *[F.col(t).desc() for t in tie])
    m = F.count(F.lit(1)).over(W.partitionBy(*family))
    return (
        df.withColumn("_raw", F.col(p) * m / F.row_number().over(up))
        .withColumn(out, F.least(F.lit(1.0), F.min("_raw").over(down.rowsBetween(W.unboundedPreceding, 0))))
        .drop("_raw")
    )


def holm_adjust(df: DataFrame, p: str, family: Sequence[str] = (), tie: Sequence[str] = (), out: str = "p_holm") -> DataFrame:
    up = W.partitionBy(*family).orderBy(F.col(p), *tie)
    m = F.count(F.lit(1)).over(W.partitionBy(*family))
    return (
        df.withColumn("_raw", F.least(F.lit(1.0), (m - F.row_number().over(up) + 1) * F.col(p)))
        .withColumn(out, F.max("_raw").over(up.rowsBetween(W.unboundedPreceding, 0)))
        .drop("_raw")
    )


def _by_value(df: DataFrame, p: str, family: Sequence[str]) -> DataFrame:
    """Distinct p values of each family with how many tests have one and how many have one up to it."""
    g = df.where(F.col(p).isNotNull()).groupBy(*family, p).agg(F.count(F.lit(1)).alias("c"))
    return running_sums(spread_buckets(g, p, family), [F.col(p)], ["c"], family)


def bh_adjust_large(df: DataFrame, p: str, family: Sequence[str] = (), out: str = "q") -> DataFrame:
    """Benjamini-Hochberg q in families of any size: as ``bh_adjust``, with suffix minima carried across value ranges.

    A null p has no q and does not count in its family.
    """
    family = list(family)
    raw = _by_value(df, p, family).withColumn("_raw", F.col(p) * F.col("all_c") / F.col("cum_c"))
    low = carried(raw, [F.col(p).desc()], "_raw", family, F.min, True, "_q")
    q = low.select(*family, p, F.least(F.lit(1.0), "_q").alias(out))
    return df.join(q, [*family, p], "left").select(*df.columns, out)


def holm_adjust_large(df: DataFrame, p: str, family: Sequence[str] = (), out: str = "p_holm") -> DataFrame:
    """Holm's adjusted p in families of any size: as ``holm_adjust``, with prefix maxima carried across value ranges."""
    family = list(family)
    first = F.col("all_c") - (F.col("cum_c") - F.col("c"))
    raw = _by_value(df, p, family).withColumn("_raw", F.least(F.lit(1.0), first * F.col(p)))
    high = carried(raw, [F.col(p).asc()], "_raw", family, F.max, False, out)
    return df.join(high.select(*family, p, out), [*family, p], "left").select(*df.columns, out)


def divergence_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """First-label divergence of the overlap, both directions, with its p."""
    from concord.operators.joins import overlap

    both = overlap(first_label(a, key), first_label(b, key), key)
    return both.agg(
        F.count(F.lit(1)).alias("overlap"),
        F.expr("count_if(a_label = b_label)").alias("agree"),
        F.expr("count_if(a_label = 1 AND b_label = 0)").alias("n01"),
        F.expr("count_if(a_label = 0 AND b_label = 1)").alias("n10"),
    ).select(
        "overlap", "agree", (F.col("n01") + F.col("n10")).alias("divergent"), "n01", "n10",
        F.coalesce(
            F.try_divide((F.col("n01") + F.col("n10")).cast("double"), F.col("overlap").cast("double")),
            F.lit(0.0),
        ).alias("rate"),
        sign_test("n01", "n10").alias("p"),
    )
