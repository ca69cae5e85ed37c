"""Merging one vote per item and source: means, Dawid-Skene and a latent score."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from concord.functions.columns import clip, sigmoid
from concord.operators.calibrate import fit_logistic_1d
from concord.session import cut_lineage, small_table


def _of_all(scored: DataFrame, items: DataFrame | None) -> DataFrame:
    """Scores of all ``items``; one that nobody voted on gets a half."""
    if items is None:
        return scored
    return items.select("item").distinct().join(scored, "item", "left").select("item", F.coalesce("score", F.lit(0.5)).alias("score"))


def vote_mean(votes: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Mean vote per item; an item nobody voted on gets a half."""
    return _of_all(votes.groupBy("item").agg(F.avg("label").alias("score")), items)


def linear_weights(votes: DataFrame, first: float = 1.0, last: float = 0.7) -> DataFrame:
    """Weights falling evenly over the sources in order. Sources are a short list."""
    from pyspark.sql import Window as W

    sources = votes.select("source").distinct()
    pos = F.row_number().over(W.orderBy("source")) - 1
    n = F.count(F.lit(1)).over(W.partitionBy())
    return sources.select("source", (
        F.lit(first) + (last - first) * F.coalesce(F.try_divide(pos.cast("double"), (n - 1).cast("double")), F.lit(0.0))
    ).alias("weight"))


def vote_weighted(votes: DataFrame, weights: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Mean vote with the sources' weights; an item nobody voted on gets a half."""
    return _of_all(votes.join(weights, "source").groupBy("item").agg(
        F.coalesce(F.try_divide(F.sum(F.col("label") * F.col("weight")), F.sum("weight")), F.lit(0.5)).alias("score")), items)


def vote_patterns(votes: DataFrame, values: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Group items that got the same votes (and value): (item, pid) and (pid, source, label, cnt, value).

    ``pid`` is a hash of the pattern's content, so it is stable across retries.
    """
    rows = F.sort_array(F.collect_list(F.struct("source", "label")))
    per = votes.groupBy("item").agg(rows.alias("votes"))
    if values is not None:
        per = per.join(values.select("item", F.round("value", 9).alias("value")), "item", "left")
    else:
        per = per.withColumn("value", F.lit(None).cast("double"))
    per = per.withColumn("pid", F.sha2(F.to_json(F.struct("votes", "value")), 256))
    groups = per.groupBy("pid").agg(
        F.first("votes").alias("votes"), F.first("value").alias("value"), F.count(F.lit(1)).alias("cnt"))
    long = groups.select("pid", "value", "cnt", F.explode("votes").alias("v")).select(
        "pid", "value", "cnt", F.col("v.source").alias("source"), F.col("v.label").alias("label"))
    return per.select("item", "pid"), long


def dawid_skene(votes: DataFrame, beta: float = 1.0, max_iter: int = 100, tol: float = 1e-7,
                items: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Two-class EM over sources' sensitivity and specificity, smoothed by ``beta``.

    The posterior depends only on the source table of the previous round, so a
    round is one aggregation over the vote patterns, and only that table (one
    entry per source, looked up by position) moves between rounds. ``beta=2``
    gives the MAP variant. Returns (item, score), of all ``items`` if given, and
    (source, sensitivity, specificity).
    """
    spark = votes.sparkSession
    names = sorted(r["source"] for r in votes.select("source").distinct().collect())
    kind = dict(votes.dtypes)["source"]
    index = small_table(spark, [(n, i) for i, n in enumerate(names)], f"source {kind}, s int")
    placed = votes.join(F.broadcast(index), "source").select("item", "s", F.col("label").cast("int").alias("label"))
    rows = F.sort_array(F.collect_list(F.struct("s", "label")))
    per = cut_lineage(placed.groupBy("item").agg(rows.alias("votes")))
    patterns = cut_lineage(per.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("cnt")))

    def posterior(sens: list[float], spec: list[float]) -> Column:
        yes = F.lit([math.log(a) - math.log(1 - b) for a, b in zip(sens, spec)])
        no = F.lit([math.log(1 - a) - math.log(b) for a, b in zip(sens, spec)])
        return sigmoid(F.aggregate("votes", F.lit(0.0), lambda t, v: t + F.when(
            v["label"] == 1, F.element_at(yes, v["s"] + 1)).otherwise(F.element_at(no, v["s"] + 1))))

    size = F.size("votes").cast("double")
    before = clip(F.aggregate("votes", F.lit(0.0), lambda t, v: t + v["label"]) / size, 0.05, 0.95)
    sens, spec = [0.75] * len(names), [0.75] * len(names)
    for _ in range(max_iter):
        q = posterior(sens, spec)
        scored = patterns.select("votes", "cnt", q.alias("q"), F.abs(q - before).alias("moved"))
        z, w = F.col("v.label").cast("double"), F.col("cnt")
        sums = scored.select("cnt", "q", "moved", F.explode("votes").alias("v")).groupBy("v.s").agg(
            F.sum(w * z * F.col("q")).alias("hit"), F.sum(w * F.col("q")).alias("pos"),
            F.sum(w * (1 - z) * (1 - F.col("q"))).alias("rej"), F.sum(w * (1 - F.col("q"))).alias("neg"),
            F.max("moved").alias("moved"),
        ).collect()
        before = q
        bound = lambda x: min(max(x, 1e-4), 1 - 1e-4)
        for r in sums:
            sens[r["s"]] = bound((r["hit"] + beta) / (r["pos"] + 2 * beta))
            spec[r["s"]] = bound((r["rej"] + beta) / (r["neg"] + 2 * beta))
        if max(r["moved"] for r in sums) < tol:
            break
    sources = small_table(
        spark, list(zip(names, sens, spec)), f"source {kind}, sensitivity double, specificity double")
    # The scores are those of the last E-step, before the last source update.
    return _of_all(per.select("item", before.alias("score")), items), sources


def fit_latent_multi(votes: DataFrame, values: DataFrame | None = None, rounds: int = 15,
                     items: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A latent score behind sources with their own slope and bias, and an optional value.

    Each round fits the sources' logistic lines by grouped Newton sums, the
    value line by regression sums, then moves all patterns one damped step.
    Returns (item, score), of all ``items`` if given, and (source, slope, bias).
    """
    spark = votes.sparkSession
    members, long = vote_patterns(votes, values)
    members = cut_lineage(members)
    q = clip(F.avg("label"), 0.05, 0.95)
    state = cut_lineage(long.groupBy("pid").agg(
        clip(F.ln(q / clip(1.0 - F.avg("label"), 0.05, 0.95)), -3.0, 3.0).alias("mu"),
        F.first("value").alias("value"), F.first("cnt").alias("cnt")))
    long = cut_lineage(long.select("pid", "source", "label", "cnt"))
    classes = long.groupBy("source").agg((F.min("label") == F.max("label")).alias("one")).where("one").take(1)
    if classes:
        raise ValueError(f"source {classes[0]['source']} has one class only")
    lines, warm = None, None
    for _ in range(rounds):
        rows = long.join(state.select("pid", "mu"), "pid")
        warm = fit_logistic_1d(rows, "label", "mu", ["source"], ridge=0.1, weight="cnt", start=warm)
        lines = warm.select("source", F.greatest(F.abs("slope"), F.lit(0.05)).alias("slope"), F.col("intercept").alias("bias"))
        a, b, sig = 1.0, 0.0, 1.0
        if values is not None:
            w, m, v = F.col("cnt").cast("double"), F.col("mu"), F.col("value")
            s = state.where("value IS NOT NULL").agg(
                F.sum(w).alias("n"), F.sum(w * m).alias("m"), F.sum(w * v).alias("v"),
                F.sum(w * m * m).alias("mm"), F.sum(w * m * v).alias("mv"), F.sum(w * v * v).alias("vv")).first()
            if s["n"] is not None and s["n"] > 2:
                mean_m, mean_v = s["m"] / s["n"], s["v"] / s["n"]
                vm, cov = s["mm"] / s["n"] - mean_m**2, s["mv"] / s["n"] - mean_m * mean_v
                slope = cov / vm if vm > 0 else 0.0
                b, a = mean_v - slope * mean_m, max(abs(slope), 0.05)
                # Residual spread around the line with the bounded slope.
                var = (s["vv"] / s["n"] - mean_v**2) + a * a * vm - 2 * a * cov
                sig = max(math.sqrt(max(var, 0.0)), 0.1)
        p = sigmoid(F.col("slope") * F.col("mu") + F.col("bias"))
        pulls = rows.join(lines, "source").groupBy("pid").agg(
            F.sum(F.col("slope") * (p - F.col("label"))).alias("_g"),
            F.sum(F.col("slope") * F.col("slope") * p * (1.0 - p)).alias("_h"))
        seen = F.col("value").isNotNull()
        g = 0.1 * F.col("mu") + F.col("_g") + F.when(seen, a * (a * F.col("mu") + b - F.col("value")) / sig**2).otherwise(0.0)
        h = 0.1 + F.col("_h") + F.when(seen, F.lit(a * a / sig**2)).otherwise(0.0)
        state = cut_lineage(state.join(pulls, "pid").select(
            "pid", clip(F.col("mu") - 0.7 * g / F.greatest(h, F.lit(0.1)), -5.0, 5.0).alias("mu"), "value", "cnt"))
    scored = members.join(state, "pid").select("item", sigmoid("mu").alias("score"))
    return _of_all(scored, items), lines
