"""Logistic calibration by grouped Newton sums, and paired t tests."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from concord.functions.columns import clip, logit, sigmoid
from concord.functions.tails import student_t_p, t_multiplier_95
from concord.operators.audit import holm_adjust
from concord.operators.splits import stratified_folds
from concord.session import cut_lineage, small_table


def fit_logistic_1d(df: DataFrame, y: str, x: str, by: Sequence[str] = (), ridge: float = 0.0,
                    weight: str | None = None, max_iter: int = 40, tol: float = 1e-9,
                    start: DataFrame | None = None) -> DataFrame:
    """Logistic line of ``y`` on ``x`` per group: (by, intercept, slope, n).

    All groups take a Newton step together from one aggregation of seven sums;
    the groups are folds, sources or arms, so their parameter table is short.
    ``ridge`` penalises the slope only (1/C in the usual notation). Steps are
    halved while the loss rises, so separated data cannot diverge.
    """
    by = list(by)
    spark = df.sparkSession
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = cut_lineage(df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(
        *by, F.col(y).cast("double").alias("_y"), F.col(x).cast("double").alias("_x")
    ).agg(F.sum(w).alias("_w")))
    types = dict(df.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in by], "_b double, _s double"])
    groups = [tuple(r) for r in rows.select(*by).distinct().collect()] if by else [()]
    theta = {g: np.zeros(2) for g in groups}
    if start is not None:
        for r in start.collect():
            g = tuple(r[c] for c in by)
            if g in theta:
                theta[g] = np.array([r["intercept"], r["slope"]])
    base, step, counts, done = dict(theta), {g: np.zeros(2) for g in groups}, {}, set()
    best = {g: np.inf for g in groups}
    for _ in range(max_iter):
        live = [g for g in groups if g not in done]
        if not live:
            break
        table = small_table(spark, [(*g, float(theta[g][0]), float(theta[g][1])) for g in live], schema)
        joined = rows.join(F.broadcast(table), by) if by else rows.withColumns(
            {"_b": F.lit(float(theta[()][0])), "_s": F.lit(float(theta[()][1]))})
        z = F.col("_b") + F.col("_s") * F.col("_x")
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(z, -700.0, 700.0)))
        v = F.col("_w") * p * (1.0 - p)
        g0 = F.col("_w") * (p - F.col("_y"))
        loss = F.col("_w") * (F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - F.col("_y") * z)
        sums = joined.groupBy(*by).agg(
            F.sum("_w").alias("n"), F.sum(g0).alias("g0"), F.sum(g0 * F.col("_x")).alias("g1"), F.sum(v).alias("h0"),
            F.sum(v * F.col("_x")).alias("h1"), F.sum(v * F.col("_x") * F.col("_x")).alias("h2"), F.sum(loss).alias("loss"),
        ).collect()
        for r in sums:
            g = tuple(r[c] for c in by)
            counts[g] = r["n"]
            t = theta[g]
            value = r["loss"] + 0.5 * ridge * t[1] ** 2
            if value > best[g] + 1e-9 * abs(best[g]) and np.abs(step[g]).max() > tol:
                step[g] = step[g] / 2
                theta[g] = base[g] + step[g]
                continue
            best[g], base[g] = value, t
            grad = np.array([r["g0"], r["g1"] + ridge * t[1]])
            hess = np.array([[r["h0"], r["h1"]], [r["h1"], r["h2"] + ridge]]) + 1e-12 * np.eye(2)
            step[g] = -np.linalg.solve(hess, grad)
            theta[g] = t + step[g]
            if np.abs(step[g]).max() < tol * (1 + np.abs(t).max()):
                done.add(g)
    return small_table(
        spark, [(*g, float(theta[g][0]), float(theta[g][1]), float(counts.get(g, 0.0))) for g in groups],
        schema.replace("_b double, _s double", "intercept double, slope double, n double"))


def calibration_line(df: DataFrame, y: str = "gold", p: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Intercept and slope of the outcome on logit(p), nearly unpenalised."""
    return fit_logistic_1d(df.withColumn("_lp", logit(p)), y, "_lp", by, ridge=1e-6)


def platt_fit(df: DataFrame, y: str = "gold", p: str = "pred", by: Sequence[str] = (), c: float = 1.0) -> DataFrame:
    """Logistic line on the raw score with the usual default penalty."""
    return fit_logistic_1d(df, y, p, by, ridge=1.0 / c)


def platt_apply(df: DataFrame, lines: DataFrame, p: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Add the calibrated probability and its margin uncertainty."""
    lines = lines.select(*by, "intercept", "slope")
    joined = df.join(F.broadcast(lines), list(by)) if by else df.withColumn(
        "_l", lines.select(F.struct("intercept", "slope")).scalar()).select("*", "_l.*").drop("_l")
    cal = sigmoid(F.col("intercept") + F.col("slope") * F.col(p), 700.0)
    return joined.withColumn("p_cal", cal).withColumn(
        "u_cal", F.lit(0.5) - F.abs(F.col("p_cal") - 0.5)).drop("intercept", "slope")


def crossfit_platt(df: DataFrame, item: str, folds: int = 5, seed: int = 0, y: str = "gold", p: str = "pred",
                   by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Calibrate every fold by the line fitted on the others; also the lines.

    Each row joins the training sets of the other folds, so all folds of all
    groups are fitted in the same passes.
    """
    by = list(by)
    folded = stratified_folds(df.withColumn("_strat", F.concat_ws("|", *by, y)), item, "_strat", folds, seed).drop("_strat")
    folded = cut_lineage(folded.withColumn("_lp", logit(p)))
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold"))
    train = folded.select(*by, y, "_lp", F.explode(others).alias("fold"))
    lines = fit_logistic_1d(train, y, "_lp", [*by, "fold"], ridge=1e-6)
    scored = folded.join(F.broadcast(lines.drop("n")), [*by, "fold"]).withColumn(
        "p_cal", sigmoid(F.col("intercept") + F.col("slope") * F.col("_lp"), 700.0))
    sizes = folded.groupBy(*by, "fold").agg(F.count(F.lit(1)).alias("n_test"))
    params = lines.join(sizes, [*by, "fold"]).select(
        *by, "fold", F.col("n").cast("bigint").alias("n_train"), "n_test", "intercept", "slope")
    return scored.drop("_lp", "intercept", "slope"), params


def channel_baseline(df: DataFrame, y: str, value: str, train: Column) -> DataFrame:
    """Score items by one standardised value alone; items without it stay null.

    Mean and sd come from training rows that have both value and label.
    """
    usable = df.where(train & F.col(value).isNotNull() & F.col(y).isNotNull())
    ms = usable.agg(F.struct(F.avg(value).alias("m"), F.stddev_pop(value).alias("s")))
    scale = lambda d: d.withColumn("_ms", ms.scalar()).withColumn(
        "_z", F.try_divide(F.col(value) - F.col("_ms.m"), F.col("_ms.s"))).drop("_ms")
    line = fit_logistic_1d(scale(usable), y, "_z", ridge=1e-6).first()
    if line["n"] < 30:
        raise ValueError("fewer than 30 training rows have both value and label")
    return scale(df).withColumn("p_channel", sigmoid(F.lit(line["intercept"]) + line["slope"] * F.col("_z"), 700.0)).drop("_z")


def paired_t(df: DataFrame, a: str, others: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Paired t test of ``a`` against each other column over replicates, Holm-adjusted."""
    by = list(by)
    rows = F.array(*[F.struct(F.lit(f"{a} - {o}").alias("contrast"), (F.col(a) - F.col(o)).alias("d")) for o in others])
    d = df.select(*by, F.explode(rows).alias("r")).select(*by, "r.*").where("d IS NOT NULL")
    g = d.groupBy(*by, "contrast").agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd")).where("n >= 3")
    se = F.col("sd") / F.sqrt(F.col("n"))
    t = F.try_divide(F.col("mean"), se)
    half = t_multiplier_95(F.col("n") - 1) * se
    tested = g.select(
        *by, "contrast", "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"),
        t.alias("t"), student_t_p(t, F.col("n") - 1).alias("p"))
    return holm_adjust(tested, "p", by, ["contrast"])
