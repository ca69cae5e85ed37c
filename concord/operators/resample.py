"""Bootstraps and permutations as weights, never as materialised resamples.

Draws come from md5, so a replicate does not depend on partitioning, task
retries or the session. One md5 yields four draws or 32 coin flips.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from concord.functions.columns import hash_hex, hex_int
from concord.operators.audit import FILTERS, MODES, cell_counts, direction_effect, paired_labels
from concord.operators.ranking import hash_rank
from concord.operators.rank_replicates import cluster_replicates, concordance_replicates, drawn_cluster_weights
from concord.session import cut_lineage, dealt
from concord.operators.replicates import (
    CHUNK, DRAWS_PER_HASH, block_replicates, block_share, bootstrap_replicates, complete, drawn_weights, hash_blocks,
    mixed_swaps, permutation_replicates, weighted_metrics)


def indexed(df: DataFrame, keys: Sequence[str], by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Give rows a dense ``idx`` 0..n-1 in hash order per group, and ``n``."""
    return hash_rank(df, keys, seed, by).withColumn("idx", F.col("rank") - 1).drop("rank")


def draws(idx: DataFrame, n_boot: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, rep, idx): n draws with replacement per replicate.

    The rows themselves spread the work: row i makes draw i of every replicate.
    """
    blocks = F.sequence(F.lit(0), F.lit((n_boot + DRAWS_PER_HASH - 1) // DRAWS_PER_HASH - 1))
    hashed = idx.select(*by, "n", "idx", F.explode(blocks).alias("_block")).select(
        *by, "n", "_block", hash_hex(seed, F.col("_block"), F.col("idx")).alias("_h")
    )
    four = F.array(*[
        F.struct((F.col("_block") * DRAWS_PER_HASH + k).alias("rep"), (hex_int(F.col("_h"), k) % F.col("n")).alias("idx"))
        for k in range(DRAWS_PER_HASH)
    ])
    return hashed.select(*by, F.explode(four).alias("_d")).select(*by, "_d.rep", "_d.idx").where(F.col("rep") < n_boot)


def resample(df: DataFrame, keys: Sequence[str], n_boot: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """``df`` once per draw with its ``rep``; aggregate it at once, never store it."""
    idx = indexed(df, keys, by, seed)
    return _pick(draws(idx.select(*by, "idx", "n"), n_boot, seed, by), idx.drop("n"), [*by, "idx"]).drop("idx")


def _pick(drawn: DataFrame, rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """Join draws to rows, always hashing the rows.

    Draws outnumber rows by the replicates, which the size estimate of an
    exploded table does not know, so the side to build is stated here.
    """
    return drawn.join(rows.hint("shuffle_hash"), list(on))


def _long_arms(df: DataFrame, by: Sequence[str], arms: Sequence[str], y: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("pred")) for a in arms])
    return df.select(*by, y, F.explode(pairs).alias("_a")).select(*by, y, "_a.arm", "_a.pred")


def _pair_rows(metrics: DataFrame, by: Sequence[str], arms: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per pair of arms with the difference of each metric."""
    wide = metrics.groupBy(*by).pivot("arm", list(arms)).agg(*[F.first(m).alias(m) for m in names])
    pairs = [(a, b) for i, a in enumerate(arms) for b in arms[i + 1:]]
    rows = F.array(*[
        F.struct(F.lit(a).alias("arm1"), F.lit(b).alias("arm2"),
                 *[(F.col(f"{a}_{m}") - F.col(f"{b}_{m}")).alias(f"d_{m}") for m in names])
        for a, b in pairs
    ])
    return wide.select(*by, F.explode(rows).alias("_p")).select(*by, "_p.*")


def _quantiles(c: str, qs: Sequence[float]) -> Column:
    return F.percentile(F.col(c), F.array(*[F.lit(q) for q in qs]))


def paired_bootstrap(wide: DataFrame, item: str, arms: Sequence[str], n_boot: int, seed: int,
                     by: Sequence[str] = (), y: str = "gold", sampler: str = "multinomial") -> DataFrame:
    """Median and 95% interval of the AUC and AP differences of all arm pairs.

    One set of draws serves all arms and pairs. Replicates with one class are
    left out and counted. Rows count where all arms have a finite score. ``sampler`` is ``multinomial`` or ``md5`` (draws
    that plain SQL can repeat); both give weights to the same sums.
    """
    if sampler == "multinomial":
        per_rep = bootstrap_replicates(wide, item, arms, n_boot, seed, by, y, calibration=False)
    else:
        weights = drawn_weights(indexed(complete(wide, [*by, item], arms, y), [item], by, seed), arms, n_boot, seed, by, y)
        per_rep = weighted_metrics(weights, by, n_boot, calibration=False)
    diffs = _pair_rows(per_rep, [*by, "rep"], arms, ["auc", "ap"]).where("d_auc IS NOT NULL")
    qs = (0.5, 0.025, 0.975)
    g = diffs.groupBy(*by, "arm1", "arm2").agg(
        F.count(F.lit(1)).alias("n_valid"),
        _quantiles("d_auc", qs).alias("_auc"), _quantiles("d_ap", qs).alias("_ap"),
    )
    return g.select(
        *by, "arm1", "arm2", "n_valid",
        *[F.col(f"_{m}")[i].alias(f"{m}_{name}") for m in ("auc", "ap") for i, name in enumerate(("median", "low", "high"))],
    )


def paired_permutation(wide: DataFrame, item: str, pairs: Sequence[tuple[str, str]], n_perm: int, seed: int,
                       by: Sequence[str] = (), y: str = "gold", skip_degenerate: bool = False,
                       sampler: str = "random") -> DataFrame:
    """Two-sided p of the AUC and AP differences under random swaps of the arms.

    Swaps are per item and replicate, shared by all pairs. Observed values are
    computed by the same code as a replicate with no swap. ``sampler`` is
    ``random`` or ``md5`` (flips that plain SQL can repeat); both are swap vectors.
    """
    by = list(by)
    m = permutation_replicates(wide, item, pairs, n_perm, seed, by, y, sampler).withColumn("_p", F.split("arm", "\\|"))
    m = m.select(*by, (F.col("rep") - 1).alias("rep"), F.col("_p")[0].alias("arm1"), F.col("_p")[1].alias("arm2"),
                 "side", "auc", "ap")
    d = _side_difference(m, by)
    if skip_degenerate:
        mixed = mixed_swaps(wide, item, _arms_of(pairs), n_perm, seed, by, y, sampler).select(*by, (F.col("rep") - 1).alias("rep"))
        d = d.where("rep = -1").unionByName(d.join(mixed, [*by, "rep"], "left_semi").select(*d.columns))
    return _swap_p(d, by, n_perm)


def _side_difference(m: DataFrame, by: Sequence[str]) -> DataFrame:
    keys = [*by, "arm1", "arm2", "rep"]
    first = lambda c: F.max(F.when(F.col("side") == 0, F.col(c))) - F.max(F.when(F.col("side") == 1, F.col(c)))
    return m.groupBy(*keys).agg(first("auc").alias("auc"), first("ap").alias("ap"))


def _swap_p(d: DataFrame, by: Sequence[str], n_perm: int) -> DataFrame:
    seen = d.where("rep = -1").select(*by, "arm1", "arm2", F.col("auc").alias("_oa"), F.col("ap").alias("_op"))
    joined = d.where("rep >= 0").join(seen, [*by, "arm1", "arm2"])
    tol = 1e-12

    def p_value(c: str, obs: str) -> Column:
        # Skipped replicates stay in the denominator: they count as no hit.
        hits = F.count_if(F.abs(c) >= F.abs(obs) - tol)
        return F.when(F.first(obs).isNotNull(), (hits + 1) / F.lit(n_perm + 1.0))

    return joined.groupBy(*by, "arm1", "arm2").agg(
        F.first("_oa").alias("auc_diff"), F.first("_op").alias("ap_diff"),
        p_value("auc", "_oa").alias("auc_p"), p_value("ap", "_op").alias("ap_p"),
        F.count(F.lit(1)).alias("n_perm"),
    )


def _arms_of(pairs: Sequence[tuple[str, str]]) -> list[str]:
    return sorted({x for pair in pairs for x in pair})


METRICS = ("auc", "ap", "brier", "ece")


def replicate_metrics(wide: DataFrame, item: str, arms: Sequence[str], n_boot: int, seed: int,
                      by: Sequence[str] = (), y: str = "gold", redraw: bool = True, sampler: str = "multinomial") -> DataFrame:
    """AUC, AP, Brier and ECE per arm and replicate, on rows with finite scores of all arms.

    With ``redraw`` one-class replicates are replaced by further draws until
    every group has ``n_boot`` of them; a group with one class alone raises.
    Without it they are only dropped.
    """
    from pyspark.sql import Window as W

    by = list(by)
    rows = complete(wide, [*by, item], arms, y)
    if redraw:
        flat = rows.groupBy(*by).agg(F.min(y).alias("_lo"), F.max(y).alias("_hi")).where("_lo = _hi").limit(1).collect()
        if flat:
            raise ValueError(f"a group has labels of one class alone, no replicate can be valid: {flat[0]}")
    kept, first, total = None, 0, n_boot + (max(1, n_boot // 10) if redraw else 0)
    while True:
        total += -total % DRAWS_PER_HASH
        if sampler == "multinomial":
            m = bootstrap_replicates(rows, item, arms, total, seed, by, y, first)
        else:
            m = weighted_metrics(drawn_weights(indexed(rows, [item], by, seed), arms, total, seed, by, y), by, total)
        m = m.where("auc IS NOT NULL").select(*by, "rep", "arm", *METRICS)
        if not redraw:
            return m
        m = cut_lineage(m)
        # The weight sampler continues where it stopped; a last chunk that was cut short is drawn again.
        kept = m if kept is None else cut_lineage(kept.where(F.col("rep") < first * CHUNK).union(m)) if first else m
        found = kept.groupBy(*by, "arm").count().agg(F.min("count"), F.count("*")).first()
        wanted = rows.select(*by).distinct().count() * len(arms) if by else len(arms)
        if found[1] == wanted and found[0] >= n_boot:
            break
        done = total
        total *= 2
        first = done // CHUNK if sampler == "multinomial" else 0
    order = F.dense_rank().over(W.partitionBy(*by, "arm").orderBy("rep"))
    return kept.withColumn("_k", order).where(F.col("_k") <= n_boot).select(*by, "rep", "arm", *METRICS)


def bootstrap_metrics(wide: DataFrame, item: str, arms: Sequence[str], baseline: str, n_boot: int, seed: int,
                      by: Sequence[str] = (), y: str = "gold", redraw: bool = True, sampler: str = "multinomial") -> DataFrame:
    """95% intervals of every metric per arm, and of its difference to the baseline."""
    by = list(by)
    per_rep = replicate_metrics(wide, item, arms, n_boot, seed, by, y, redraw, sampler)
    long = per_rep.unpivot([*by, "rep", "arm"], list(METRICS), "metric", "value")
    base = long.where(F.col("arm") == baseline).select(*by, "rep", "metric", F.col("value").alias("_b"))
    both = long.join(base, [*by, "rep", "metric"])
    kinds = F.array(
        F.struct(F.lit("value").alias("kind"), F.col("value").alias("v")),
        F.struct(F.lit("difference").alias("kind"), (F.col("value") - F.col("_b")).alias("v")),
    )
    rows = both.select(*by, "arm", "metric", F.explode(kinds).alias("_k")).select(*by, "arm", "metric", "_k.*")
    rows = rows.where((F.col("kind") == "value") | (F.col("arm") != baseline))
    g = rows.groupBy(*by, "arm", "metric", "kind").agg(
        F.count(F.lit(1)).alias("n_valid"), _quantiles("v", (0.025, 0.975)).alias("_q")
    )
    return g.select(*by, "arm", "metric", "kind", "n_valid", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def block_bootstrap(seeded: DataFrame, item: str, seed_col: str, arms: Sequence[str], baseline: str, n_boot: int,
                    seed: int, by: Sequence[str] = (), y: str = "gold") -> DataFrame:
    """Resample items and seeds; predictions average over the drawn seeds.

    Seeds are few: each item keeps its predictions as an array by seed, which
    meets the draws that hit the item as packed counts; see ``block_replicates``.
    """
    by = list(by)
    own = lambda a: F.collect_list(F.when(F.col("arm") == a, F.struct(F.col(seed_col).alias("s"), F.col("pred").cast("double").alias("p"))))
    wide = seeded.groupBy(*by, item, y).agg(*[F.sort_array(own(a)).alias(a) for a in arms])
    wide = wide.select(*by, item, y, *[F.transform(a, lambda s: s["p"]).alias(a) for a in arms])
    m = block_replicates(indexed(wide, [item], by, seed), arms, n_boot, seed, by, y)
    m = m.where("auc IS NOT NULL").select(*by, "rep", "arm", *METRICS)
    tall = m.unpivot([*by, "rep", "arm"], list(METRICS), "metric", "value")
    base = tall.where(F.col("arm") == baseline).select(*by, "rep", "metric", F.col("value").alias("_b"))
    d = tall.where(F.col("arm") != baseline).join(base, [*by, "rep", "metric"]).withColumn("d", F.col("value") - F.col("_b"))
    g = d.groupBy(*by, "arm", "metric").agg(
        F.avg("d").alias("estimate"), _quantiles("d", (0.025, 0.975)).alias("_q"), F.count(F.lit(1)).alias("n_valid")
    )
    return g.select(*by, "arm", "metric", "estimate", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"), "n_valid")


def cluster_bootstrap(df: DataFrame, cluster: str, a: str, b: str, n_boot: int, seed: int, by: Sequence[str] = (),
                      sampler: str = "multinomial") -> DataFrame:
    """Concordance intervals when whole clusters are drawn together.

    Equal (a, b) pairs of a cluster are merged first, so a huge cluster of
    repeated measurements adds only its distinct pairs to each replicate. Only
    rows with two finite values count. ``sampler`` is ``multinomial`` or ``md5``
    (draws that plain SQL can repeat); both give weights to the same sums.
    """
    by = list(by)
    pairs = cut_lineage(df.where(_finite(a) & _finite(b)).groupBy(*by, cluster, a, b).agg(F.count(F.lit(1)).alias("copies")))
    clusters = pairs.select(*by, cluster).distinct()
    if sampler == "multinomial":
        per_rep = cluster_replicates(pairs, clusters, cluster, a, b, n_boot, seed, by)
    else:
        weights = drawn_cluster_weights(indexed(clusters, [cluster], by, seed), cluster, n_boot, seed, by)
        per_rep = concordance_replicates(pairs, weights, cluster, a, b, n_boot, by)
    per_rep = per_rep.where("n >= 3")
    names = ("pearson", "spearman", "mae", "bias")
    g = per_rep.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_valid"), *[_quantiles(m, (0.025, 0.975)).alias(f"_{m}") for m in names]
    )
    return g.select(
        *by, "n_valid", *[F.col(f"_{m}")[i].alias(f"{m}_{end}") for m in names for i, end in enumerate(("low", "high"))]
    )


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


#: Where the distribution of a sum is cut off, in standard deviations, and how far its transform is followed.
REACH = 14.0
STEPS = 40


def prevalence_distribution(df: DataFrame, p: str, y: str, by: Sequence[str] = (), shares: Sequence[float] = (0.025, 0.975)) -> DataFrame:
    """Where the positive rate lies if every row is positive with its own probability, without any draw.

    The number of positives is a sum of independent coin flips. Its transform at
    a few frequencies is a product over rows, so the logarithms are plain sums
    that combine map-side; turned back, they give the probability of every count
    within 14 standard deviations of the mean. What is cut off lies below 1e-15.
    A group's counts in that window, about 28 times the square root of its rows
    at most, are all that one task holds. Rows without a probability from 0 to 1
    or a label of 0 or 1 do not count.

    Returns (by, n, observed, expected, sd, low, high, p_low, inside): ``low`` and
    ``high`` are the smallest rates reached with the given shares, ``p_low`` is
    the probability of a rate up to the observed one.
    """
    if not by:
        return prevalence_distribution(df.withColumn("_all", F.lit(0)), p, y, ["_all"], shares).drop("_all")
    by = list(by)
    rows = df.where(F.col(p).between(0.0, 1.0) & F.col(y).isin(0, 1)).select(*by, F.col(p).cast("double").alias("_p"), F.col(y).alias("_y"))
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").cast("long").alias("positives"), F.sum("_p").alias("mean"),
        F.sqrt(F.sum(F.col("_p") * (1 - F.col("_p")))).alias("sd"))
    width = (2 * F.ceil(F.lit(REACH) * F.col("sd")) + 3).alias("width")
    base = base.select("*", width)
    # Groups are few: their widths travel to the rows.
    marked = rows.join(base.select(*by, "width"), by)
    angle = lambda j: F.lit(2.0 * np.pi * j) / F.col("width")
    size = lambda j: 0.5 * F.ln(F.greatest(1 - 2 * F.col("_p") * (1 - F.col("_p")) * (1 - F.cos(angle(j))), F.lit(1e-300)))
    turn = lambda j: F.atan2(F.col("_p") * F.sin(angle(j)), 1 - F.col("_p") + F.col("_p") * F.cos(angle(j)))
    sums = marked.groupBy(*by).agg(
        F.array(*[F.sum(size(j)) for j in range(1, STEPS + 1)]).alias("size"),
        F.array(*[F.sum(turn(j)) for j in range(1, STEPS + 1)]).alias("turn"))
    kinds = dict(base.dtypes)

    def turned(key, pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        width, n = int(r["width"]), int(r["n"])
        first = int(np.floor(r["mean"])) - width // 2
        k = np.arange(first, first + width)
        j = np.arange(1, min(STEPS, (width - 1) // 2) + 1)
        wave = np.exp(np.asarray(r["size"])[:len(j)]) * np.exp(1j * np.asarray(r["turn"])[:len(j)])
        mass = np.full(width, 1.0)
        for a, z in zip(j, wave):
            mass += 2 * (z * np.exp(-2j * np.pi * a * k / width)).real
        total = np.cumsum(np.maximum(mass / width, 0))
        total = np.minimum(total / total[-1], 1.0)
        rate = [float(np.clip(k[np.searchsorted(total, q - 1e-12)], 0, n)) / n for q in shares]
        seen = int(r["positives"])
        below = 0.0 if seen < first else 1.0 if seen >= first + width else float(total[seen - first])
        return pd.DataFrame([[*key, n, seen / n, r["mean"] / n, r["sd"] / n, *rate, below, rate[0] <= seen / n <= rate[1]]],
                            columns=[*by, "n", "observed", "expected", "sd", "low", "high", "p_low", "inside"])

    head = "".join(f"`{c}` {kinds[c]}, " for c in by)
    return base.join(sums, by).groupBy(*by).applyInPandas(
        turned, head + "n long, observed double, expected double, sd double, low double, high double, p_low double, inside boolean")


def prevalence_check(df: DataFrame, item: str, p: str, y: str, reps: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Does the observed positive rate sit inside what the probabilities predict?"""
    if not by:
        return prevalence_check(df.withColumn("_all", F.lit(0)), item, p, y, reps, seed, ["_all"]).drop("_all")
    blocks = F.sequence(F.lit(0), F.lit(-(-reps // DRAWS_PER_HASH) - 1))
    hashed = df.select(*by, p, F.explode(blocks).alias("_block"), item).withColumn(
        "_h", hash_hex(seed, F.col("_block"), F.col(item)))
    sums = hashed.groupBy(*by, "_block").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(hex_int(F.col("_h"), k) / F.lit(4294967296.0) < F.col(p)).alias(f"_s{k}") for k in range(DRAWS_PER_HASH)],
    )
    each = F.array(*[F.struct((F.col("_block") * DRAWS_PER_HASH + k).alias("rep"),
                              (F.col(f"_s{k}") / F.col("_n").cast("double")).alias("rate")) for k in range(DRAWS_PER_HASH)])
    rates = sums.select(*by, F.explode(each).alias("_e")).select(*by, "_e.*").where(F.col("rep") < reps)
    g = rates.groupBy(*by).agg(F.avg("rate").alias("replicated"), _quantiles("rate", (0.025, 0.975)).alias("_q"))
    seen = df.groupBy(*by).agg(F.avg(y).alias("observed"))
    return g.join(seen, list(by)).select(
        *by, "observed", "replicated", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"),
        F.col("observed").between(F.col("_q")[0], F.col("_q")[1]).alias("inside"),
    )


def permute_column(df: DataFrame, key: str, value: str, seed: int) -> DataFrame:
    """Hand each row another row's value: two hash orders joined by rank."""
    left = hash_rank(df.select(key), [key], seed).select(key, "rank")
    right = hash_rank(df.select(key, value), [key], seed + 1).select("rank", F.col(value).alias(value))
    return left.join(right, "rank").drop("rank")


# ---- the multiverse of audit rules -----------------------------------------

CELLS = [(mode, name, m) for mode in MODES for name in FILTERS for m in ("n01", "n10")]


def cluster_contributions(a: DataFrame, b: DataFrame, coarse: str, fine: str) -> DataFrame:
    """What each overlapping coarse key adds to the 16 counts of the 8 rules.

    Every rule count is a sum over clusters, so replicates only re-weigh these
    vectors. Fine keys count under every coarse key both channels put them in.
    """
    from concord.operators.joins import cluster_members

    both = paired_labels(a, b, {"coarse": coarse, "fine": fine})
    cells = cell_counts()
    flags = [cells[c].cast("int") for c in CELLS]
    rows = both.select("identity", "key", *[F.coalesce(f, F.lit(0)).alias(f"c{i}") for i, f in enumerate(flags)])
    n = len(CELLS)
    coarse_rows = rows.where("identity = 'coarse'").select(
        F.col("key").alias("cluster"), *[F.col(f"c{i}").alias(f"x{i}") for i in range(n)],
        *[F.lit(0).alias(f"x{n + i}") for i in range(n)],
    )
    members = cluster_members(a, b, coarse, fine).select(F.col(coarse).alias("cluster"), F.col(fine).alias("key"))
    fine_rows = rows.where("identity = 'fine'").join(members, "key").select(
        "cluster", *[F.lit(0).alias(f"x{i}") for i in range(n)], *[F.col(f"c{i}").alias(f"x{n + i}") for i in range(n)],
    )
    known = coarse_rows.select("cluster")
    return coarse_rows.unionByName(fine_rows.join(known, "cluster", "left_semi")).groupBy("cluster").agg(
        *[F.sum(f"x{i}").cast("bigint").alias(f"x{i}") for i in range(2 * n)]
    )


def _rule_rows(counts: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Unfold the 16 counts to one row per rule with its effect."""
    n = len(CELLS)
    cells = [(identity, base + i, CELLS[i]) for identity, base in (("coarse", 0), ("fine", n)) for i in range(0, n, 2)]
    rows = F.array(*[
        F.struct(F.lit(identity).alias("identity"), F.lit(c[0]).alias("mode"), F.lit(c[1]).alias("filter"),
                 F.col(f"x{j}").alias("n01"), F.col(f"x{j + 1}").alias("n10"))
        for identity, j, c in cells
    ])
    return counts.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*").withColumn(
        "rho", direction_effect("n01", "n10"))


REPS_PER_CHUNK = 125
GROUPS_PER_BLOCK = 2048


def multinomial_totals(rows: DataFrame, count: str, values: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """Sum ``values`` over n draws with replacement from n units, per replicate.

    ``rows`` are groups of equal units with their ``count``. Drawing units and
    counting draws per group is a multinomial sample of the groups: blocks of
    groups find their shares in a tree of binomial splits, then each block
    samples its own groups and adds up its vectors. No draw is ever shuffled, no
    block is known outside its task, and the cost follows the number of distinct
    groups, not of units.
    """
    values = list(values)
    spread, blocks = hash_blocks(rows.select(count, *values), values, (), GROUPS_PER_BLOCK, count)
    chunks = -(-n_boot // REPS_PER_CHUNK)

    def run(key, pdf: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        block, at = int(key[0]), path.iloc[0]
        pdf = pdf.sort_values(values)
        x = pdf[values].to_numpy(dtype=np.float64)
        p = pdf[count].to_numpy(dtype=np.float64)
        made = []
        for chunk in range(chunks):
            n = min(REPS_PER_CHUNK, n_boot - chunk * REPS_PER_CHUNK)
            shares = block_share(block, int(at["depth"]), int(at["total"]), at["left"], at["right"], n, seed, (), chunk)
            picked = np.random.default_rng([seed, chunk, block + 1]).multinomial(shares, p / p.sum())
            out = pd.DataFrame(picked @ x, columns=values)
            out.insert(0, "rep", chunk * REPS_PER_CHUNK + np.arange(n))
            made.append(out)
        return pd.concat(made, ignore_index=True)

    schema = "rep int, " + ", ".join(f"`{v}` double" for v in values)
    parts = dealt(spread, "_blk").groupBy("_blk").cogroup(dealt(blocks, "_blk").groupBy("_blk")).applyInPandas(run, schema)
    return parts.groupBy("rep").agg(*[F.sum(v).alias(v) for v in values])


def multiverse_bootstrap(a: DataFrame, b: DataFrame, coarse: str, fine: str, n_boot: int, seed: int,
                         sampler: str = "multinomial") -> DataFrame:
    """Effect, 95% and Bonferroni intervals of all 8 rules under cluster resampling.

    ``sampler`` is ``multinomial`` (cost by distinct contribution vectors) or
    ``md5`` (one draw per cluster and replicate, reproducible in plain SQL).
    """
    vectors = cluster_contributions(a, b, coarse, fine)
    values = [f"x{i}" for i in range(2 * len(CELLS))]
    if sampler == "multinomial":
        groups = cut_lineage(vectors.groupBy(*values).agg(F.count(F.lit(1)).alias("_c")))
        sums = multinomial_totals(groups, "_c", values, n_boot, seed)
        totals = groups.agg(*[F.sum(F.col(v) * F.col("_c")).alias(v) for v in values])
    else:
        vectors = cut_lineage(vectors)
        idx = indexed(vectors, ["cluster"], (), seed)
        # Clusters without any discordance add nothing, so their draws need no join partner.
        busy = idx.where(" + ".join(values) + " > 0").drop("cluster", "n")
        hits = _pick(draws(idx.select("idx", "n"), n_boot, seed), busy, ["idx"])
        reps = a.sparkSession.range(n_boot).select(F.col("id").cast("int").alias("rep"))
        sums = reps.join(hits.groupBy("rep").agg(*[F.sum(v).alias(v) for v in values]), "rep", "left").na.fill(0)
        totals = vectors.agg(*[F.sum(v).alias(v) for v in values])
    observed = _rule_rows(totals, [])
    keys = ["identity", "mode", "filter"]
    boot = _rule_rows(sums, ["rep"]).where("rho IS NOT NULL").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_valid"), F.avg("rho").alias("mean_rho"),
        _quantiles("rho", (0.025, 0.975, 0.003125, 0.996875)).alias("_q"),
    )
    return observed.join(boot, keys, "left").select(
        *keys, "n01", "n10", "rho", "mean_rho", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"),
        F.col("_q")[2].alias("sim_low"), F.col("_q")[3].alias("sim_high"), "n_valid",
        (F.col("_q")[0] > 0.5).alias("excludes_half"),
    )
