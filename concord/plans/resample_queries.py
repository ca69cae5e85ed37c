"""Bootstraps and permutations over the prediction and channel views."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord import fixtures as fx
from concord.operators import resample as rs
from concord.plans.audit_queries import SUMMARY
from concord.plans.common import rounded, tidy
from concord.plans.registry import query
from concord.plans.views import with_views

REPS = 40
PAIRS = [("A", "B"), ("A", "C"), ("B", "C")]


def draws_sql(source: str, key: str, by: str, seed: int, reps: int, idx_seed: int | None = None) -> str:
    """CTEs idx (rows with a dense hash index) and dr (by, rep, idx)."""
    part = f"partition by {by} " if by else ""
    lead = f"{by}, " if by else ""
    idx_seed = seed if idx_seed is None else idx_seed
    return f"""idx as (select *, row_number() over ({part}order by md5('{idx_seed}:' || {key}), {key}) - 1 as idx,
    count(*) over ({part}) as n_ from {source}),
dr as (select {lead}rep, idx from (select {lead}blk * 4 + k as rep,
    cast(('0x' || substr(md5('{seed}:' || blk || ':' || idx), cast(k * 8 + 1 as bigint), 8)) as bigint) % n_ as idx
    from idx, range({(reps + 3) // 4}) t(blk), range(4) u(k)) where rep < {reps})"""


def curve_sql(source: str, by: str, weight: str = "1") -> str:
    """CTE sc: auc and ap per group of ``by`` from (gold, pred) rows."""
    return f"""g_ as (select {by}, pred as score, sum(gold * {weight})::double as pos, sum((1 - gold) * {weight})::double as neg from {source} group by all),
cv_ as (select *, sum(pos) over w as cp, sum(neg) over w as cn from g_ window w as (partition by {by} order by score desc rows unbounded preceding)),
sc as (select {by}, sum(neg * (cp - pos / 2)) / nullif(sum(pos) * sum(neg), 0) as auc, case when sum(neg) > 0 then sum(pos * cp / (cp + cn)) / nullif(sum(pos), 0) end as ap from cv_ group by all)"""


def long_arms(source: str, by: str) -> str:
    return " union all ".join(f"select {by}, gold, '{a}' as arm, {a} as pred from {source}" for a in fx.ARMS)


R1 = f"""{draws_sql('wide', 'item_id', 'view', 11, REPS)},
s as (select view, rep, gold, A, B, C from dr join idx using (view, idx)),
l as ({long_arms('s', 'view, rep')}),
{curve_sql('l', 'view, rep, arm')},
d as (select x.view, x.rep, x.arm as arm1, y.arm as arm2, x.auc - y.auc as auc, x.ap - y.ap as ap from sc x join sc y on x.view = y.view and x.rep = y.rep and x.arm < y.arm where x.auc is not null)
select view, arm1, arm2, count(*) as n_valid, median(auc) as auc_median, quantile_cont(auc, 0.025) as auc_low, quantile_cont(auc, 0.975) as auc_high,
    median(ap) as ap_median, quantile_cont(ap, 0.025) as ap_low, quantile_cont(ap, 0.975) as ap_high from d group by 1, 2, 3"""


@query("r1_paired_bootstrap", rounded(with_views("wide", R1), "auc_median auc_low auc_high ap_median ap_low ap_high"))
def r1(spark, d):
    return tidy(rs.paired_bootstrap(fx.wide_predictions(spark, d), "item_id", fx.ARMS, REPS, 11, ["view"], sampler="md5"))


@query("r1_paired_bootstrap_weights")
def r1_fast(spark, d):
    return tidy(rs.paired_bootstrap(fx.wide_predictions(spark, d), "item_id", fx.ARMS, 2000, 42, ["view"]))


@query("r2_paired_permutation_weights")
def r2_fast(spark, d):
    return tidy(rs.paired_permutation(fx.wide_predictions(spark, d), "item_id", PAIRS, 2000, 42, ["view"]))


@query("r4_bootstrap_metrics_weights")
def r4_fast(spark, d):
    return tidy(rs.bootstrap_metrics(fx.wide_predictions(spark, d), "item_id", fx.ARMS, "A", 2000, 42, ["view"]))


def _perm_sql(extra: str, skip: bool) -> str:
    sides = " union all ".join(
        f"select view, rep, swap, gold, '{a}' as arm1, '{b}' as arm2, {side} as side, case when swap = ({side} = 1) then {a} else {b} end as pred from s"
        for a, b in PAIRS for side in (0, 1))
    keep = "and d.rep in (select rep from f where f.view = d.view group by rep having min(swap) <> max(swap))" if skip else ""
    return f"""f as (select view, rep, gold, A, B, C, swap from (select view, gold, A, B, C, blk * 32 + k as rep,
        substr(md5('13:' || blk || ':' || item_id), cast(k + 1 as bigint), 1) >= '8' as swap from {extra}, range({(REPS + 31) // 32}) t(blk), range(32) u(k)) where rep < {REPS}),
s as (select view, -1 as rep, gold, A, B, C, false as swap from {extra} union all select * from f),
l as ({sides}), {curve_sql('l', 'view, arm1, arm2, rep, side')},
d as (select view, arm1, arm2, rep, max(auc) filter (side = 0) - max(auc) filter (side = 1) as auc, max(ap) filter (side = 0) - max(ap) filter (side = 1) as ap from sc group by 1, 2, 3, 4)
select d.view, arm1, arm2, o.auc as auc_diff, o.ap as ap_diff, (1 + count(*) filter (abs(d.auc) >= abs(o.auc) - 1e-12)) / ({REPS} + 1)::double as auc_p,
    (1 + count(*) filter (abs(d.ap) >= abs(o.ap) - 1e-12)) / ({REPS} + 1)::double as ap_p, count(*) as n_perm
from d join (select * from d where rep = -1) o using (view, arm1, arm2) where d.rep >= 0 {keep} group by all"""


@query("r2_paired_permutation", rounded(with_views("wide", _perm_sql("wide", False)), "auc_diff ap_diff auc_p ap_p"))
def r2(spark, d):
    return tidy(rs.paired_permutation(fx.wide_predictions(spark, d), "item_id", PAIRS, REPS, 13, ["view"], sampler="md5"))


@query("r3_permutation_skip_degenerate", rounded(with_views("wide", _perm_sql("wide", True)), "auc_diff ap_diff auc_p ap_p"))
def r3(spark, d):
    return tidy(rs.paired_permutation(fx.wide_predictions(spark, d), "item_id", PAIRS, REPS, 13, ["view"], skip_degenerate=True, sampler="md5"))


def _metrics_sql(source: str, by: str) -> str:
    """CTE m: auc, ap, brier, ece per ``by`` from unweighted (gold, pred) rows."""
    return f"""{curve_sql(source, by)},
br as (select {by}, avg(pow(pred - gold, 2)) as brier from {source} group by all),
rb as (select {by}, least(floor(pred * 10), 9) as b, count(*) as n, avg(pred) as mp, avg(gold) as ob from {source} group by all),
ec as (select {by}, sum(n * abs(mp - ob)) / sum(n) as ece from rb group by all),
m as (select * from sc natural join br natural join ec where auc is not null)"""


def _boot_sql(redraw: bool) -> str:
    total = REPS + max(1, REPS // 10) if redraw else REPS
    total += -total % 4
    return f"""{draws_sql('wide', 'item_id', 'view', 17, total)},
s as (select view, rep, gold, A, B, C from dr join idx using (view, idx)), l as ({long_arms('s', 'view, rep')}),
{_metrics_sql('l', 'view, rep, arm')},
kept as (select * from (select *, dense_rank() over (partition by view, arm order by rep) as k from m) where k <= {REPS}),
tall as (select view, rep, arm, 'auc' as metric, auc as v from kept union all select view, rep, arm, 'ap', ap from kept
    union all select view, rep, arm, 'brier', brier from kept union all select view, rep, arm, 'ece', ece from kept),
kinds as (select view, arm, metric, 'value' as kind, v from tall union all
    select t.view, t.arm, t.metric, 'difference', t.v - b.v from tall t join tall b on t.view = b.view and t.rep = b.rep and t.metric = b.metric and b.arm = 'A' where t.arm <> 'A')
select view, arm, metric, kind, count(*) as n_valid, quantile_cont(v, 0.025) as low, quantile_cont(v, 0.975) as high from kinds group by 1, 2, 3, 4"""


@query("r4_bootstrap_metrics", rounded(with_views("wide", _boot_sql(True)), "low high"))
def r4(spark, d):
    return tidy(rs.bootstrap_metrics(fx.wide_predictions(spark, d), "item_id", fx.ARMS, "A", REPS, 17, ["view"], sampler="md5"))


@query("r5_bootstrap_without_redraw", rounded(with_views("wide", _boot_sql(False)), "low high"))
def r5(spark, d):
    return tidy(rs.bootstrap_metrics(fx.wide_predictions(spark, d), "item_id", fx.ARMS, "A", REPS, 17, ["view"], redraw=False, sampler="md5"))


R6 = f"""w as (select view, item_id, gold, list(pred order by seed) filter (arm = 'A') as A, list(pred order by seed) filter (arm = 'B') as B,
    list(pred order by seed) filter (arm = 'C') as C from seeded group by 1, 2, 3),
{draws_sql('w', 'item_id', 'view', 19, REPS)},
pk as (select range as rep, [cast(('0x' || substr(md5('20:' || range || ':' || j), 1, 8)) as bigint) % 4 + 1 for j in [0, 1, 2, 3]] as p from range({REPS})),
s as (select view, rep, gold, round((A[p[1]] + A[p[2]] + A[p[3]] + A[p[4]]) / 4.0::double, 12) as A, round((B[p[1]] + B[p[2]] + B[p[3]] + B[p[4]]) / 4.0::double, 12) as B,
    round((C[p[1]] + C[p[2]] + C[p[3]] + C[p[4]]) / 4.0::double, 12) as C from dr join idx using (view, idx) join pk using (rep)),
l as ({long_arms('s', 'view, rep')}), {_metrics_sql('l', 'view, rep, arm')},
tall as (select view, rep, arm, 'auc' as metric, auc as v from m union all select view, rep, arm, 'ap', ap from m
    union all select view, rep, arm, 'brier', brier from m union all select view, rep, arm, 'ece', ece from m),
d as (select t.view, t.arm, t.metric, t.v - b.v as d from tall t join tall b on t.view = b.view and t.rep = b.rep and t.metric = b.metric and b.arm = 'A' where t.arm <> 'A')
select view, arm, metric, avg(d) as estimate, quantile_cont(d, 0.025) as low, quantile_cont(d, 0.975) as high, count(*) as n_valid from d group by 1, 2, 3"""


@query("r6_block_bootstrap", rounded(with_views("seeded", R6), "estimate low high"))
def r6(spark, d):
    return tidy(rs.block_bootstrap(fx.seeded_predictions(spark, d), "item_id", "seed", fx.ARMS, "A", REPS, 19, ["view"]))


def _cluster_sql(cluster: str, reps: int) -> str:
    return f"""x as (select view, cl, a, b, count(*) as c from (select view, {cluster} as cl, A as a, B as b from wide_) group by all),
cl_ as (select distinct view, cl from x), {draws_sql('cl_', 'cl', 'view', 23, reps)},
sm as (select view, rep, a, b, sum(c) as w from dr join idx using (view, idx) join x using (view, cl) group by 1, 2, 3, 4),
ra as (select view, rep, a, sum(w) over (partition by view, rep order by a rows unbounded preceding) - (w - 1) / 2.0::double as ra from (select view, rep, a, sum(w) as w from sm group by 1, 2, 3)),
rb as (select view, rep, b, sum(w) over (partition by view, rep order by b rows unbounded preceding) - (w - 1) / 2.0::double as rb from (select view, rep, b, sum(w) as w from sm group by 1, 2, 3)),
j as (select * from sm join ra using (view, rep, a) join rb using (view, rep, b)),
st as (select view, rep, sum(w) as n, (sum(w * a * b) - sum(w * a) * sum(w * b) / sum(w)) / sqrt((sum(w * a * a) - sum(w * a) * sum(w * a) / sum(w)) * (sum(w * b * b) - sum(w * b) * sum(w * b) / sum(w))) as pearson,
    (sum(w * ra * rb) - sum(w * ra) * sum(w * rb) / sum(w)) / sqrt((sum(w * ra * ra) - sum(w * ra) * sum(w * ra) / sum(w)) * (sum(w * rb * rb) - sum(w * rb) * sum(w * rb) / sum(w))) as spearman,
    sum(w * abs(a - b)) / sum(w) as mae, (sum(w * a) - sum(w * b)) / sum(w) as bias from j group by 1, 2)
select view, count(*) as n_valid, """ + ", ".join(
        f"quantile_cont({m}, 0.025) as {m}_low, quantile_cont({m}, 0.975) as {m}_high" for m in ("pearson", "spearman", "mae", "bias")
    ) + " from st group by 1"


CI_COLS = " ".join(f"{m}_{e}" for m in ("pearson", "spearman", "mae", "bias") for e in ("low", "high"))


@query("r7_cluster_bootstrap", rounded(with_views("wide", "wide_ as (select w.*, user_id from wide w join events on event_id = item_id), " + _cluster_sql("user_id", REPS)), CI_COLS))
def r7(spark, d):
    users = fx.table(spark, d, "events").select(F.col("event_id").alias("item_id"), "user_id")
    df = fx.wide_predictions(spark, d).join(users, "item_id")
    return tidy(rs.cluster_bootstrap(df, "user_id", "A", "B", REPS, 23, ["view"], sampler="md5"))


@query("r7_cluster_bootstrap_2000")
def r7_full(spark, d):
    users = fx.table(spark, d, "events").select(F.col("event_id").alias("item_id"), "user_id")
    return tidy(rs.cluster_bootstrap(fx.wide_predictions(spark, d).join(users, "item_id"), "user_id", "A", "B", 2000, 23, ["view"]))


@query("r8_bootstrap_spearman", f"select view, n_valid, spearman_low, spearman_high from ({rounded(with_views('wide', 'wide_ as (select * from wide), ' + _cluster_sql('item_id', REPS)), CI_COLS)})")
def r8(spark, d):
    out = rs.cluster_bootstrap(fx.wide_predictions(spark, d), "item_id", "A", "B", REPS, 23, ["view"], sampler="md5")
    return tidy(out.select("view", "n_valid", "spearman_low", "spearman_high"))


@query("r8_bootstrap_spearman_2000")
def r8_full(spark, d):
    out = rs.cluster_bootstrap(fx.wide_predictions(spark, d), "item_id", "A", "B", 2000, 23, ["view"])
    return tidy(out.select("view", "n_valid", "spearman_low", "spearman_high"))


@query("r3_permutation_skip_degenerate_1000")
def r3_full(spark, d):
    return tidy(rs.paired_permutation(fx.wide_predictions(spark, d), "item_id", PAIRS, 1000, 13, ["view"], skip_degenerate=True))


@query("r5_bootstrap_without_redraw_2000")
def r5_full(spark, d):
    return tidy(rs.bootstrap_metrics(fx.wide_predictions(spark, d), "item_id", fx.ARMS, "A", 2000, 17, ["view"], redraw=False))


M18 = f"""b as (select view, arm, count(*) as n, sum(gold) as positives, sum(pred) as mean, sqrt(sum(pred * (1 - pred))) as sd from pred group by all),
g as (select *, 2 * ceil({rs.REACH} * sd) + 3 as width from b),
f as (select view, arm, j, sum(0.5 * ln(greatest(1 - 2 * pred * (1 - pred) * (1 - cos(2 * pi() * j / width)), 1e-300))) as size,
    sum(atan2(pred * sin(2 * pi() * j / width), 1 - pred + pred * cos(2 * pi() * j / width))) as turn
    from pred join g using (view, arm), range(1, {rs.STEPS} + 1) t(j) group by all),
k as (select view, arm, n, positives, mean, sd, width, floor(mean) - floor(width / 2) + i as k from g, lateral (select unnest(range(cast(width as bigint))) as i)),
m as (select view, arm, n, positives, mean, sd, k, greatest((1 + 2 * sum(exp(size) * cos(turn - 2 * pi() * j * k / width))) / any_value(width), 0) as mass
    from k join f using (view, arm) where j <= floor((width - 1) / 2) group by all),
c as (select *, sum(mass) over (partition by view, arm order by k) / sum(mass) over (partition by view, arm) as total from m)
select view, arm, n, positives / n as observed, mean / n as expected, sd / n as sd,
    min(k) filter (total >= 0.025 - 1e-12) / n as low, min(k) filter (total >= 0.975 - 1e-12) / n as high,
    max(total) filter (k = positives) as p_low, low <= observed and observed <= high as inside from c group by view, arm, n, positives, mean, sd"""


@query("m18_prevalence_distribution", f"select view, arm, n, round(observed, 6) as observed, round(expected, 6) as expected, round(sd, 6) as sd, round(low, 6) as low, round(high, 6) as high, round(coalesce(p_low, case when observed < expected then 0 else 1 end), 6) as p_low, inside from ({with_views('pred', M18)})")
def m18_exact(spark, d):
    return tidy(rs.prevalence_distribution(fx.predictions(spark, d), "pred", "gold", ["view", "arm"]))


R9 = f"""{SUMMARY},
flag as (select identity, key, mode, filter, case when a_label = 1 and b_label = 0 then 1 else 0 end as n01, case when a_label = 0 and b_label = 1 then 1 else 0 end as n10 from cells),
mem as (select ck as cluster, fk as key from obs_a intersect select ck, fk from obs_b),
cl as (select key as cluster from sa join sb using (identity, key) where identity = 'coarse'),
con as (select cluster, identity, mode, filter, n01, n10 from (select key as cluster, * exclude (key) from flag where identity = 'coarse'
    union all select cluster, flag.* exclude (key) from flag join mem using (key) where identity = 'fine')),
obs as (select identity, mode, filter, sum(n01) as n01, sum(n10) as n10 from con semi join cl using (cluster) group by 1, 2, 3),
{draws_sql('cl', 'cluster', '', 29, REPS)},
wt as (select rep, cluster, count(*) as w from dr join idx using (idx) group by 1, 2),
bt as (select rep, identity, mode, filter, sum(w * n01) / nullif(sum(w * n01) + sum(w * n10), 0)::double as rho from wt join con using (cluster) group by 1, 2, 3, 4)
select identity, mode, filter, cast(any_value(n01) as bigint) as n01, cast(any_value(n10) as bigint) as n10, any_value(n01) / nullif(any_value(n01 + n10), 0)::double as rho,
    avg(bt.rho) as mean_rho, quantile_cont(bt.rho, 0.025) as low, quantile_cont(bt.rho, 0.975) as high, quantile_cont(bt.rho, 0.003125) as sim_low,
    quantile_cont(bt.rho, 0.996875) as sim_high, count(bt.rho) as n_valid, quantile_cont(bt.rho, 0.025) > 0.5 as excludes_half
from obs join bt using (identity, mode, filter) group by 1, 2, 3"""


@query("r9_multiverse_bootstrap", rounded(with_views("obs_a obs_b", R9), "rho mean_rho low high sim_low sim_high"))
def r9(spark, d):
    return tidy(rs.multiverse_bootstrap(fx.obs_a(spark, d), fx.obs_b(spark, d), "ck", "fk", REPS, 29, sampler="md5"))


@query("r9_multiverse_multinomial")
def r9_fast(spark, d):
    return tidy(rs.multiverse_bootstrap(fx.obs_a(spark, d), fx.obs_b(spark, d), "ck", "fk", 2000, 29))


@query("r11_permute_column", with_views("wide", """l as (select item_id, row_number() over (order by md5('31:' || item_id), item_id) as r from wide),
    q as (select round(A, 6) as A, row_number() over (order by md5('32:' || item_id), item_id) as r from wide) select item_id, A from l join q using (r)"""))
def r11(spark, d):
    return tidy(rs.permute_column(fx.wide_predictions(spark, d).select("item_id", "A"), "item_id", "A", 31))


@query("m18_prevalence_check", rounded(with_views("pred", f"""h as (select view, arm, gold, b, md5('37:' || b || ':' || item_id) as h, pred from pred, range({REPS // 4}) t(b)),
    r as (select view, arm, b, k, avg(case when cast(('0x' || substr(h, cast(k * 8 + 1 as bigint), 8)) as bigint) / 4294967296.0::double < pred then 1.0::double else 0.0::double end) as rate from h, range(4) u(k) group by 1, 2, 3, 4),
    o as (select view, arm, avg(gold) as observed from pred group by 1, 2)
    select view, arm, any_value(observed) as observed, avg(rate) as replicated, quantile_cont(rate, 0.025) as low, quantile_cont(rate, 0.975) as high,
    any_value(observed) between quantile_cont(rate, 0.025) and quantile_cont(rate, 0.975) as inside from r join o using (view, arm) group by 1, 2"""), "observed replicated low high"))
def m18(spark, d):
    return tidy(rs.prevalence_check(fx.predictions(spark, d), "item_id", "pred", "gold", REPS, 37, ["view", "arm"]))
