"""Evaluation metrics with a grouping key and optional row weights.

Bootstraps, strata, arms and variants are all grouping keys, so they share
these functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from concord.functions.columns import clip
from concord.operators.ranking import average_ranks, exact_quantiles, ordered_running, running_sums, spread_buckets


def _weight(weight: str | None) -> Column:
    return F.col(weight).cast("double") if weight else F.lit(1.0)


def _usable(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.where(F.col(y).isin(0, 1) & F.col(p).isNotNull() & ~F.isnan(p))


# ---- ranking metrics -------------------------------------------------------

def score_curve(df: DataFrame, y: str = "gold", p: str = "pred", by: Sequence[str] = (),
                weight: str | None = None, few: bool = False) -> DataFrame:
    """One row per distinct score with cumulative counts from the highest score down.

    ``few`` tells that ``by`` has few groups, whose tables of score ranges may be broadcast.
    """
    w = _weight(weight)
    g = _usable(df, y, p).groupBy(*by, F.col(p).alias("score")).agg(
        F.sum(F.when(F.col(y) == 1, w).otherwise(0.0)).alias("pos"),
        F.sum(F.when(F.col(y) == 0, w).otherwise(0.0)).alias("neg"),
    )
    g = spread_buckets(g, "score", by, few=few)
    return running_sums(g, [F.col("score").desc()], ["pos", "neg"], by, descending=True, few=few).drop("_bucket")


def auc_ap(df: DataFrame, y: str = "gold", p: str = "pred", by: Sequence[str] = (),
           weight: str | None = None, few: bool = False) -> DataFrame:
    """Tie-correct ROC AUC and average precision; null where one class is missing."""
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    wins = F.sum(F.col("neg") * (tp - F.col("pos") / 2.0))
    area = F.sum(F.try_divide(F.col("pos") * tp, tp + fp))
    pos, neg = F.sum("pos"), F.sum("neg")
    both = (pos > 0) & (neg > 0)
    return score_curve(df, y, p, by, weight, few).groupBy(*by).agg(
        F.when(both, F.try_divide(wins, pos * neg)).alias("auc"),
        F.when(both, F.try_divide(area, pos)).alias("ap"),
    )


# ---- moment metrics --------------------------------------------------------

def moments(df: DataFrame, y: str = "gold", p: str = "pred", by: Sequence[str] = (),
            weight: str | None = None, eps: float = 0.0) -> DataFrame:
    """Counts, accuracy, MCC, Brier and the high-confidence error rate in one pass."""
    w = _weight(weight)
    pc = clip(F.col(p), eps, 1.0 - eps)
    yes, truth = F.col(p) >= 0.5, F.col(y) == 1
    sure = (pc <= 0.1) | (pc >= 0.9)

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, w).otherwise(0.0))

    sums = _usable(df, y, p).groupBy(*by).agg(
        F.sum(w).alias("_n"),
        total(truth & yes).alias("_tp"), total(truth & ~yes).alias("_fn"),
        total(~truth & yes).alias("_fp"), total(~truth & ~yes).alias("_tn"),
        F.sum(w * F.pow(pc - F.col(y), 2)).alias("_sq"),
        total(sure).alias("_hc"), total(sure & (yes != truth)).alias("_hce"),
    )
    tp, fn, fp, tn, n = (F.col(c) for c in ("_tp", "_fn", "_fp", "_tn", "_n"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return sums.select(
        *by, n.cast("bigint").alias("n"), (tp + fn).cast("bigint").alias("positives"),
        F.try_divide(tp + tn, n).alias("accuracy"),
        F.coalesce(F.try_divide(tp * tn - fp * fn, root), F.lit(0.0)).alias("mcc"),
        F.try_divide(F.col("_sq"), n).alias("brier"),
        F.col("_hc").cast("bigint").alias("high_conf_n"),
        F.try_divide(F.col("_hce"), F.col("_hc")).alias("high_conf_error"),
    )


def reliability_bins(df: DataFrame, y: str = "gold", p: str = "pred", by: Sequence[str] = (),
                     weight: str | None = None, bins: int = 10) -> DataFrame:
    """Equal-width bins: bounds, weight, mean prediction, observed rate."""
    w = _weight(weight)
    pc = clip(F.col(p), 0.0, 1.0)
    b = F.least(F.floor(pc * float(bins)), F.lit(bins - 1)).cast("int")
    g = _usable(df, y, p).groupBy(*by, b.alias("_b")).agg(
        F.sum(w).alias("_w"), F.sum(w * pc).alias("_p"), F.sum(w * F.col(y)).alias("_y")
    )
    return g.select(
        *by, (F.col("_b") + 1).alias("bin"), (F.col("_b") / float(bins)).alias("lower"),
        ((F.col("_b") + 1) / float(bins)).alias("upper"), F.col("_w").cast("bigint").alias("n"),
        F.try_divide(F.col("_p"), F.col("_w")).alias("mean_pred"),
        F.try_divide(F.col("_y"), F.col("_w")).alias("observed"),
    )


def ece(df: DataFrame, y: str = "gold", p: str = "pred", by: Sequence[str] = (),
        weight: str | None = None, bins: int = 10) -> DataFrame:
    rows = reliability_bins(df, y, p, by, weight, bins).where("n > 0")
    gap = F.sum(F.col("n") * F.abs(F.col("mean_pred") - F.col("observed")))
    return rows.groupBy(*by).agg((gap / F.sum("n")).alias("ece"))


def all_metrics(df: DataFrame, y: str = "gold", p: str = "pred", by: Sequence[str] = (),
                weight: str | None = None) -> DataFrame:
    by = list(by)
    if not by:
        return all_metrics(df.withColumn("_all", F.lit(0)), y, p, ["_all"], weight).drop("_all")
    return (
        moments(df, y, p, by, weight).join(auc_ap(df, y, p, by, weight), by)
        .join(ece(df, y, p, by, weight), by)
    )


def stratified_metrics(df: DataFrame, strata: dict[str, Column], by: Sequence[str] = (), min_n: int = 10,
                       y: str = "gold", p: str = "pred") -> DataFrame:
    """Metrics per level of each stratifier; thin or one-class levels are recorded as such."""
    pairs = F.array(*[F.struct(F.lit(n).alias("stratifier"), c.cast("string").alias("level")) for n, c in strata.items()])
    long = df.withColumn("_s", F.explode(pairs)).select("*", "_s.stratifier", "_s.level").drop("_s")
    keys = ["stratifier", "level", *by]
    m = all_metrics(long.where("level IS NOT NULL"), y, p, keys)
    ok = (F.col("n") >= min_n) & F.col("auc").isNotNull()
    return m.select(
        *keys, "n",
        *[F.when(ok, F.col(c)).alias(c) for c in ("auc", "ap", "brier", "ece")],
        F.when(~ok, F.lit("too few rows or one class")).alias("reason"),
    )


def compare_views(metrics: DataFrame, view: str, arm: str, value: str, left: str, right: str) -> DataFrame:
    wide = metrics.groupBy(view).pivot(arm, [left, right]).agg(F.first(value))
    return wide.withColumn(
        "better",
        F.when(F.col(left) > F.col(right), left).when(F.col(right) > F.col(left), right).otherwise("tie"),
    )


# ---- continuous agreement --------------------------------------------------

def concordance(df: DataFrame, a: str, b: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Pearson, Spearman, MAE, bias and limits of agreement; correlations need 3 rows."""
    by = list(by)
    w = _weight(weight)
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    moments = d.groupBy(*by).agg(*_paired_moments(F.col(a), F.col(b), w), F.sum(w * F.abs(F.col(a) - F.col(b))).alias("_abs"))
    rank_a = average_ranks(d, a, by, weight).withColumnRenamed("rank_avg", "_ra")
    rank_b = average_ranks(d, b, by, weight).withColumnRenamed("rank_avg", "_rb")
    ranked = d.join(rank_a, [*by, a]).join(rank_b, [*by, b])
    rho = ranked.groupBy(*by).agg(*_paired_moments(F.col("_ra"), F.col("_rb"), w))
    rho = rho.select(*by, _pearson().alias("spearman"))
    n, bias = F.col("_n"), (F.col("_a") - F.col("_b")) / F.col("_n")
    var = F.try_divide(F.col("_aa") - 2 * F.col("_ab") + F.col("_bb") - n * bias * bias, n - 1.0)
    sd = F.sqrt(F.greatest(var, F.lit(0.0)))
    out = moments.select(
        *by, n.cast("bigint").alias("n"), F.when(n >= 3, _pearson()).alias("pearson"),
        (F.col("_abs") / n).alias("mae"), bias.alias("bias"),
        (bias - 1.96 * sd).alias("loa_low"), (bias + 1.96 * sd).alias("loa_high"),
    )
    joined = out.join(rho, by) if by else out.withColumn("spearman", rho.scalar())
    return joined.withColumn("spearman", F.when(F.col("n") >= 3, F.col("spearman")))


def _paired_moments(a: Column, b: Column, w: Column) -> list[Column]:
    return [
        F.sum(w).alias("_n"), F.sum(w * a).alias("_a"), F.sum(w * b).alias("_b"),
        F.sum(w * a * a).alias("_aa"), F.sum(w * b * b).alias("_bb"), F.sum(w * a * b).alias("_ab"),
    ]


def _pearson() -> Column:
    n = F.col("_n")
    cov = F.col("_ab") - F.col("_a") * F.col("_b") / n
    va = F.col("_aa") - F.col("_a") * F.col("_a") / n
    vb = F.col("_bb") - F.col("_b") * F.col("_b") / n
    return F.try_divide(cov, F.sqrt(F.greatest(va, F.lit(0.0)) * F.greatest(vb, F.lit(0.0))))


# ---- abstention and coverage -----------------------------------------------

def _wrong(y: str, p: str) -> Column:
    return ((F.col(p) >= 0.5) != (F.col(y) == 1)).cast("int")


def coverage_risk_tau(df: DataFrame, u: str, y: str = "gold", p: str = "pred", by: Sequence[str] = (), points: int = 21) -> DataFrame:
    """Coverage and risk at evenly spaced uncertainty thresholds.

    Rows are counted per grid cell first: the first threshold that covers a
    row decides its cell, and cells are then summed upward.
    """
    from pyspark.sql import Window as W

    by = list(by)
    top = df.groupBy(*by).agg((F.max(u) + 1e-6).alias("_top"), F.count(F.lit(1)).alias("_all"))
    grid = top.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "tau", F.col("_top") * F.col("step") / float(points - 1)
    )
    guess = F.ceil(F.col(u) * float(points - 1) / F.col("_top"))
    tau_of = lambda s: F.col("_top") * s / float(points - 1)
    low = F.greatest(guess - 1, F.lit(0))
    step = F.when(F.col(u) <= tau_of(low), low).when(F.col(u) <= tau_of(guess), guess).otherwise(guess + 1)
    joined = df.join(top, by) if by else df.withColumns({"_top": top.select("_top").scalar()})
    cells = joined.groupBy(*by, step.cast("int").alias("step")).agg(
        F.count(F.lit(1)).alias("c"), F.sum(_wrong(y, p)).alias("e")
    )
    run = W.partitionBy(*by).orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    filled = grid.join(cells, [*by, "step"], "left")
    n_cov = F.coalesce(F.sum("c").over(run), F.lit(0))
    return filled.withColumns({"n_covered": n_cov, "_e": F.coalesce(F.sum("e").over(run), F.lit(0))}).select(
        *by, "step", "tau", "n_covered",
        (F.col("n_covered") / F.col("_all").cast("double")).alias("coverage"),
        F.when(F.col("n_covered") == 0, 1.0).otherwise(F.try_divide(F.col("_e").cast("double"), F.col("n_covered").cast("double"))).alias("risk"),
    )


def coverage_risk_curve(df: DataFrame, u: str, item: str, y: str = "gold", p: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Risk among the k most certain rows, for every k."""
    scored = df.withColumn("_err", _wrong(y, p))
    run = ordered_running(scored, u, [item], ["_err"], by)
    n = F.col("n").cast("double")
    return run.select(
        *by, item, F.col("rank").alias("n_covered"), (F.col("rank") / n).alias("coverage"),
        (F.col("cum__err") / F.col("rank").cast("double")).alias("risk"),
    )


def aurc(df: DataFrame, u: str, item: str, y: str = "gold", p: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Area under the risk-coverage curve and how well uncertainty finds errors.

    The trapezoid over evenly spaced coverages is the mean of inner risks plus
    half the end risks, so no neighbour lookup is needed.
    """
    by = list(by)
    if not by:
        return aurc(df.withColumn("_all", F.lit(0)), u, item, y, p, ["_all"]).drop("_all")
    scored = df.withColumn("_err", _wrong(y, p))
    run = ordered_running(scored, u, [item], ["_err"], by)
    risk = F.col("cum__err") / F.col("rank").cast("double")
    edge = F.when((F.col("rank") == 1) | (F.col("rank") == F.col("n")), 0.5).otherwise(1.0)
    area = run.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.when(F.max("n") > 2, F.sum(risk * edge) / F.max("n").cast("double")).alias("aurc"),
    )
    found = auc_ap(scored, "_err", u, by).withColumnsRenamed({"auc": "error_auroc", "ap": "error_auprc"})
    return area.join(found, by)


def risk_at_coverage(df: DataFrame, u: str, item: str, grid: Sequence[float], rounding: str = "floor",
                     y: str = "gold", p: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Risk, Brier risk and mean uncertainty of the most certain share, per grid point."""
    by = list(by)
    ready = df.withColumns({
        "_err": _wrong(y, p), "_sq": F.pow(F.col(p) - F.col(y), 2), "_u": F.col(u).cast("double"),
    })
    run = ordered_running(ready, u, [item], ["_err", "_sq", "_u"], by)
    cut = F.floor if rounding == "floor" else F.bround
    points = F.array(*[F.lit(float(c)) for c in grid])
    wanted = F.filter(points, lambda c: F.greatest(F.lit(1), cut(F.col("n") * c).cast("bigint")) == F.col("rank"))
    k = F.col("rank").cast("double")
    return run.select("*", F.explode(wanted).alias("grid")).select(
        *by, "grid", F.col("rank").alias("n_covered"), (k / F.col("n")).alias("coverage"),
        (F.col("cum__err") / k).alias("risk"), (F.col("cum__sq") / k).alias("brier_risk"),
        (F.col("cum__u") / k).alias("mean_u"),
    )


def abstain_summary(df: DataFrame, u: str, tau: float, y: str = "gold", p: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    kept = F.col(u) <= F.lit(float(tau))
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(~kept).alias("n_abstain"),
        F.count_if(kept).alias("n_covered"), F.count_if(kept & (_wrong(y, p) == 0)).alias("_right"),
    )
    acc = F.try_divide(F.col("_right").cast("double"), F.col("n_covered").cast("double"))
    return sums.select(
        *by, "n_total", "n_abstain", (F.col("n_abstain") / F.col("n_total").cast("double")).alias("abstain_ratio"),
        "n_covered", acc.alias("covered_accuracy"), (1.0 - acc).alias("covered_risk"),
    )


# ---- equal-frequency calibration -------------------------------------------

def quantile_calibration(df: DataFrame, y: str = "gold", p: str = "pred", by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Calibration by equal-frequency bins whose repeated edges are merged."""
    by = list(by)
    if not by:
        return quantile_calibration(df.withColumn("_all", F.lit(0)), y, p, ["_all"], bins).drop("_all")
    edges = exact_quantiles(df, p, [i / bins for i in range(bins + 1)], by).select(
        *by, F.array_distinct("edges").alias("_edges"))
    above = F.size(F.filter("_edges", lambda e: e < F.col(p)))
    return df.join(edges, by).groupBy(*by, F.greatest(above, F.lit(1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"), F.avg(y).alias("observed")
    )
