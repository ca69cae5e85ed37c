"""Consolidating observations per entity and summarising reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from concord.functions.tails import t_multiplier_95
from concord.operators.audit import label_summary


def key_refs(obs: DataFrame, key: str, refs: str = "refs") -> DataFrame:
    """Sorted union of references per key; duplicates go before the lists are built."""
    pairs = obs.where(F.col(key).isNotNull()).select(key, F.explode(refs).alias("ref")).distinct()
    return pairs.groupBy(key).agg(F.sort_array(F.collect_list("ref")).alias("refs"))


def consolidate(obs: DataFrame, key: str, refs: str | None = None, first: Sequence[str] = ()) -> DataFrame:
    """One row per key: label set, label, conflict flag, references, first text.

    The label is the only one, else the first in order.
    """
    known = obs.where(F.col(key).isNotNull())
    out = known.groupBy(key).agg(
        F.sort_array(F.collect_set("label")).alias("raw_labels"),
        F.min_by("label", "ord").alias("label"),
        (F.min("label") != F.max("label")).cast("int").alias("conflict"),
        *[F.min_by(c, "ord").alias(c) for c in first],
    )
    if refs:
        out = out.join(key_refs(obs, key, refs), key, "left").withColumns({
            "refs": F.coalesce("refs", F.array().cast("array<string>")),
        }).withColumn("n_refs", F.size("refs"))
    return out


def summarise_values(obs: DataFrame, key: str, value: str = "value", refs: str | None = "refs") -> DataFrame:
    known = obs.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    out = known.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(value)), lambda x: F.round(x, 3)).alias("values"),
        F.round(F.min(value), 3).alias("value_min"),
        F.round(F.max(value), 3).alias("value_max"),
        F.count(value).alias("value_n"),
        F.sum(value).alias("value_sum"),
    )
    if refs:
        out = out.join(key_refs(known, key, refs).withColumnRenamed("refs", "value_refs"), key, "left")
    return out


def ref_frequency(refs: DataFrame, key: str) -> DataFrame:
    """Entities per reference and their share, from a long (key, ref) table."""
    n_keys = refs.select(key).distinct().agg(F.count(F.lit(1)).cast("double"))
    counts = refs.groupBy("ref").agg(F.count(F.lit(1)).alias("n_items"))
    return counts.select("ref", "n_items", (F.col("n_items") / n_keys.scalar()).alias("share"))


def group_size_summary(counts: DataFrame, n: str) -> DataFrame:
    """Number, smallest, median and largest of group sizes; the median is found by counts, not in one task."""
    from concord.operators.ranking import exact_quantiles

    median = exact_quantiles(counts, n, [0.5]).select(F.col("edges")[0].alias("m"))
    return counts.agg(
        F.count(F.lit(1)).alias("groups"), F.min(n).alias("size_min"), F.max(n).alias("size_max"),
    ).select("groups", "size_min", median.scalar().alias("size_median"), "size_max")


def ref_distribution(refs: DataFrame, key: str) -> DataFrame:
    """How many entities have 1, 2, ... references, with shares."""
    sizes = refs.groupBy(key).agg(F.count(F.lit(1)).alias("n_refs"))
    dist = sizes.groupBy("n_refs").agg(F.count(F.lit(1)).alias("n_items"))
    total = dist.agg(F.sum("n_items").cast("double"))
    return dist.select(
        "n_refs", "n_items", (F.col("n_items") / total.scalar()).alias("share"),
        (F.col("n_refs") >= 2).cast("int").alias("multi_source"),
    )


def crosstab(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def summary_stats(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, sd, min and max of every metric, flattened to ``<metric>_<stat>``."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[f(m).alias(f"{m}_{name}") for m in metrics for name, f in (
            ("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max))],
    )


def replicate_summary(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, sd and 95% t interval of each metric over replicates."""
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_reps"),
        *[x for m in metrics for x in (F.avg(m).alias(f"mean_{m}"), F.stddev_samp(m).alias(f"sd_{m}"),
                                       F.count(m).alias(f"_n_{m}"))],
    )
    for m in metrics:
        n = F.col(f"_n_{m}")
        half = F.when(n > 1, t_multiplier_95(n - 1) * F.col(f"sd_{m}") / F.sqrt(n))
        out = out.withColumns({f"lo_{m}": F.col(f"mean_{m}") - half, f"hi_{m}": F.col(f"mean_{m}") + half}).drop(f"_n_{m}")
    return out


def paired_pivot(df: DataFrame, by: Sequence[str], name: str, value: str, names: Sequence[str], base: str) -> DataFrame:
    """Names become columns; every other name gets its difference from ``base``."""
    wide = df.groupBy(*by).pivot(name, list(names)).agg(F.first(value))
    return wide.select(
        *by, *names, *[(F.col(base) - F.col(n)).alias(f"{base}_minus_{n}") for n in names if n != base]
    )


def collapse(df: DataFrame, key: str, rules: dict[str, str], order: str) -> DataFrame:
    """Dedup by key with a rule per column: first, mean, max or joined text."""
    def one(c: str, rule: str) -> Column:
        if rule == "first":
            return F.min_by(c, order)
        if rule == "mean":
            return F.avg(c)
        if rule == "max":
            return F.max(c)
        if rule == "text":
            rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))
            return F.array_join(F.transform(rows, lambda r: r["v"].cast("string")), "|")
        raise ValueError(f"unknown rule {rule!r}")

    return df.groupBy(key).agg(*[one(c, r).alias(c) for c, r in rules.items()])


def within_variance(obs: DataFrame, key: str, value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Mean population variance of entities with two or more values, else of all values.

    Everything comes from per-entity sums, so the data is grouped only once.
    """
    per = obs.groupBy(*by, key).agg(
        F.count(value).alias("n"), F.sum(value).alias("s"),
        F.sum(F.col(value) * F.col(value)).alias("q"), F.var_pop(value).alias("v"),
    )
    n = F.sum("n").cast("double")
    mean = F.sum("s") / n
    return per.groupBy(*by).agg(
        F.expr("count_if(n >= 2)").alias("n_repeated"),
        F.avg(F.when(F.col("n") >= 2, F.col("v"))).alias("within"),
        (F.sum("q") / n - mean * mean).alias("overall"),
    ).withColumn("variance", F.coalesce("within", "overall"))


def channel_labels(a_label: str, a_n: str, b_label: str, b_n: str) -> dict[str, Column]:
    """Hard, unweighted and evidence-count-weighted label of two channels."""
    la, lb = F.col(a_label).cast("double"), F.col(b_label).cast("double")
    channels = F.filter(
        F.array(F.struct(la.alias("y"), F.greatest(F.col(a_n), F.lit(1)).cast("double").alias("w")),
                F.struct(lb.alias("y"), F.greatest(F.col(b_n), F.lit(1)).cast("double").alias("w"))),
        lambda c: c["y"].isNotNull(),
    )
    size = F.size(channels)
    num = F.aggregate(channels, F.lit(0.0), lambda s, c: s + c["y"] * c["w"])
    den = F.aggregate(channels, F.lit(0.0), lambda s, c: s + c["w"])
    plain = F.aggregate(channels, F.lit(0.0), lambda s, c: s + c["y"])
    return {
        "hard": la,
        "majority": F.when(size > 0, plain / size.cast("double")),
        "weighted": F.when(size > 0, num / den),
    }


def agg_where(df: DataFrame, where: str, value: str, label: str) -> DataFrame:
    """Mean value and count by label inside a subset."""
    v = F.col(value).isNotNull()
    return df.where(where).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col(label) == 1, F.col(value))).alias("mean_pos"),
        F.avg(F.when(F.col(label) == 0, F.col(value))).alias("mean_neg"),
        F.count_if((F.col(label) == 1) & v).alias("n_pos"),
        F.count_if((F.col(label) == 0) & v).alias("n_neg"),
    )


def consensus(a: DataFrame, b: DataFrame, c: DataFrame, key: str) -> DataFrame:
    """The consensus table: both label channels and the continuous one, one row per key."""
    from concord.operators.joins import merge_channels

    ca = consolidate(a, key, refs="refs")
    counts = label_summary(a, [key]).select(key, F.col("n").alias("n_obs"))
    ca = ca.join(counts, key)
    cb = consolidate(b, key).join(label_summary(b, [key]).select(key, F.col("n").alias("n_obs")), key)
    merged = merge_channels(ca, cb, key)
    values = summarise_values(c, key)
    # Measurements attach to entities of channel A only; others keep none.
    kept = values.join(ca.select(key), key, "left_semi")
    out = merged.join(kept, key, "left")
    return out.withColumns({
        "refs": F.coalesce("a_refs", F.array().cast("array<string>")),
        "n_refs": F.coalesce("a_n_refs", F.lit(0)),
        "value_n": F.coalesce("value_n", F.lit(0)),
    }).drop("a_refs", "a_n_refs")
