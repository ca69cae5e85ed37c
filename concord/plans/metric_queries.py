"""Windows, splits, metrics and calibration tables over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord import fixtures as fx
from concord.functions import columns as c
from concord.operators import aggregate as agg, metrics as mt, ranking, splits
from concord.operators.audit import bh_adjust, sign_test
from concord.plans.audit_queries import sign_p
from concord.plans.common import rounded, tidy
from concord.plans.registry import query
from concord.plans.views import with_views

BY = ["view", "arm"]

# ---- windows ---------------------------------------------------------------


@query("w1_average_ranks", with_views("pred", """d as (select view, arm, pred, count(*) as n from pred group by 1, 2, 3)
    select view, arm, round(pred, 6) as pred, sum(n) over (partition by view, arm order by pred rows unbounded preceding) - (n - 1) / 2.0::double as rank_avg from d"""))
def w1(spark, d):
    return tidy(ranking.average_ranks(fx.predictions(spark, d), "pred", BY))


CURVE = """g as (select view, arm, pred as score, sum(gold)::double as pos, sum(1 - gold)::double as neg from pred group by 1, 2, 3),
curve as (select *, sum(pos) over w as cum_pos, sum(neg) over w as cum_neg, sum(pos) over (partition by view, arm) as all_pos,
    sum(neg) over (partition by view, arm) as all_neg from g
    window w as (partition by view, arm order by score desc rows unbounded preceding))"""


@query("w2_score_curve", with_views("pred", f"{CURVE} select view, arm, round(score, 6) as score, pos, neg, cum_pos, cum_neg, all_pos, all_neg from curve"))
def w2(spark, d):
    return tidy(mt.score_curve(fx.predictions(spark, d), by=BY).select(
        *BY, "score", "pos", "neg", "cum_pos", "cum_neg", "all_pos", "all_neg"))


@query("w3_running_minimum", rounded(f"""with s as (select l_suppkey, l_returnflag, count(*) filter (l_linestatus = 'O') as n01,
    count(*) filter (l_linestatus = 'F') as n10 from lineitem group by 1, 2), t as (select *, {sign_p('n01', 'n10')} as p from s),
    r as (select *, p * count(*) over (partition by l_returnflag) / row_number() over (partition by l_returnflag order by p, l_suppkey) as raw from t)
    select l_suppkey, l_returnflag, n01, n10, p, least(1.0::double, min(raw) over (partition by l_returnflag order by p desc, l_suppkey desc rows unbounded preceding)) as q from r""", "p q"))
def w3(spark, d):
    s = fx.table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.expr("count_if(l_linestatus = 'O')").alias("n01"), F.expr("count_if(l_linestatus = 'F')").alias("n10"))
    return tidy(bh_adjust(s.withColumn("p", sign_test("n01", "n10")), "p", ["l_returnflag"], ["l_suppkey"]))


@query("w4_running_group_size", """with g as (select o_custkey, count(*) as size from orders group by 1),
    r as (select *, sum(size) over (order by md5('5:' || o_custkey), o_custkey rows unbounded preceding) - size as before from g)
    select o_custkey, size, cast(before as bigint) as before, before < 5000 as taken from r""")
def w4(spark, d):
    g = agg.crosstab(fx.table(spark, d, "orders"), ["o_custkey"]).withColumnRenamed("n", "size")
    h = g.withColumn("_h", c.hash_hex(5, "o_custkey")).withColumn("_bucket", F.substring("_h", 1, 3))
    run = ranking.running_sums(h, [F.col("_h"), F.col("o_custkey")], ["size"])
    before = F.col("cum_size") - F.col("size")
    return run.select("o_custkey", "size", before.alias("before"), (before < 5000).alias("taken"))


UNSURE = "0.5::double - abs(pred - 0.5::double)"
ORDERED = f"""o as (select *, {UNSURE} as u, case when (pred >= 0.5) <> (gold = 1) then 1 else 0 end as err from pred),
ranked as (select *, row_number() over w as k, count(*) over (partition by view, arm) as n, sum(err) over w as cerr,
    sum((pred - gold) * (pred - gold)) over w as csq, sum(u) over w as cu from o
    window w as (partition by view, arm order by u, md5('0:' || item_id), item_id rows unbounded preceding))"""


def _unsure(spark, d):
    return fx.predictions(spark, d).withColumn("u", F.lit(0.5) - F.abs(F.col("pred") - 0.5))


@query("w5_prefix_error", rounded(with_views("pred", f"{ORDERED} select view, arm, item_id, k as n_covered, k / n::double as coverage, cerr / k::double as risk from ranked"), "coverage risk"))
def w5(spark, d):
    return tidy(mt.coverage_risk_curve(_unsure(spark, d), "u", "item_id", by=BY))


QCAL = """e as (select view, arm, list_distinct(quantile_cont(pred, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) as edges from pred group by 1, 2),
b as (select *, greatest(cast(len(list_filter(edges, lambda x: x < pred)) as integer), 1) as bin from pred join e using (view, arm))"""


@query("w6_equal_frequency_bins", with_views("pred", f"{QCAL} select view, arm, bin, count(*) as n from b group by 1, 2, 3"))
def w6(spark, d):
    return mt.quantile_calibration(fx.predictions(spark, d), by=BY).select(*BY, "bin", "n")


# ---- splits ----------------------------------------------------------------

KEYS_B = "kb as (select distinct ck from obs_b)"


@query("x1_holdout", with_views("obs_b", f"""{KEYS_B} select ck, case when row_number() over (order by md5('42:' || ck), ck)
    <= round_even(count(*) over () * 0.15::double, 0) then 1 else 0 end as held_out from kb"""))
def x1(spark, d):
    return splits.holdout(fx.obs_b(spark, d), "ck", 0.15, 42)


SPLIT = """ka as (select ck, list_sort(list(distinct ref)) as refs, arg_min(fk, ord) as fk from obs_a group by 1),
kb as (select ck, arg_min(label, ord) as b_label from obs_b group by 1),
m as (select ck, b_label, fk, case when list_has_any(coalesce(refs, []), ['S1', 'S2']) then 1 else 0 end as source_out
    from ka full outer join kb using (ck)),
t as (select ck, case when row_number() over (order by md5('42:' || ck), ck) <= round_even(count(*) over () * 0.15::double, 0) then 1 else 0 end as test
    from m where b_label is not null),
m2 as (select m.*, coalesce(test, 0) as test from m left join t using (ck)),
v as (select ck, case when row_number() over (order by md5('43:' || ck), ck) <= round_even(count(*) over () * (0.15::double / (1 - 0.15::double)), 0) then 1 else 0 end as val
    from m2 where test = 0 and source_out = 0),
split_ as (select ck, fk, source_out, case when test = 1 then 'test' when val = 1 then 'validation' when val = 0 then 'train' end as split,
    substr(md5(ck), 1, 3) as grp from m2 left join v using (ck))"""


def _split(spark, d):
    refs = agg.key_refs(fx.obs_a(spark, d), "ck")
    fk = fx.obs_a(spark, d).groupBy("ck").agg(F.min_by("fk", "ord").alias("fk"))
    a = refs.join(fk, "ck")
    b = fx.obs_b(spark, d).groupBy("ck").agg(F.min_by("label", "ord").alias("b_label"))
    merged = a.join(b, "ck", "full_outer").withColumn("refs", F.coalesce("refs", F.array().cast("array<string>")))
    out = splits.assign_split(merged, "ck", "b_label", "refs", ["S1", "S2"])
    return out.withColumn("grp", F.substring(F.md5(F.col("ck").cast("binary")), 1, 3))


@query("x2_source_holdout", with_views("obs_a obs_b", f"{SPLIT} select ck, source_out from split_"))
def x2(spark, d):
    return _split(spark, d).select("ck", "source_out")


@query("x3_assign_split", with_views("obs_a obs_b", f"{SPLIT} select ck, source_out, split from split_"))
def x3(spark, d):
    return _split(spark, d).select("ck", "source_out", "split")


@query("x4_leak_report", with_views("obs_a obs_b", f"""{SPLIT} select 'train_test' as "check", 0::bigint as n
    union all select 'train_source_out', count(*) from split_ where split = 'train' and source_out = 1
    union all select 'group_train_test', count(*) from (select grp from split_ where split = 'train' intersect select grp from split_ where split = 'test')"""))
def x4(spark, d):
    return splits.leak_report(_split(spark, d), "ck", "grp")


TWO_LEVEL = """sha256(string_agg(dg, chr(10) order by b)) as digest, cast(sum(n) as bigint) as n"""


@query("x5_split_digest", with_views("obs_a obs_b", f"""{SPLIT}, h as (select sha256(sha256('+' || ck || chr(31) || coalesce('+' || split, '-') || chr(31) || '+' || source_out)) as hx from split_),
    l as (select substr(hx, 1, 3) as b, sha256(string_agg(hx, chr(10) order by hx)) as dg, count(*) as n from h group by 1) select {TWO_LEVEL} from l"""))
def x5(spark, d):
    return splits.split_digest(_split(spark, d), ["ck", "split", "source_out"])


GROUPED = f"""{SPLIT}, g as (select fkp, count(*) as size from (select *, substr(md5('g' || ck), 1, 4) as fkp from split_) where split = 'train' group by 1),
gr as (select *, sum(size) over (order by md5('7:' || fkp), fkp rows unbounded preceding) - size as before, round_even(sum(size) over () * 0.2::double, 0) as target from g),
gs as (select ck, fkp, case when s.split = 'train' then case when before < target then 'validation' else 'train' end else 'test' end as group_split
    from (select *, substr(md5('g' || ck), 1, 4) as fkp from split_) s left join gr using (fkp)
    where s.split = 'train' or gr.fkp is null)"""


def _group_split(spark, d):
    df = _split(spark, d).withColumn("fkp", F.substring(F.md5(F.concat(F.lit("g"), F.col("ck")).cast("binary")), 1, 4))
    return splits.group_split(df, "ck", "fkp", 0.2, 7)


@query("x6_group_split", with_views("obs_a obs_b", f"{GROUPED} select ck, fkp, group_split from gs"))
def x6(spark, d):
    return _group_split(spark, d).select("ck", "fkp", "group_split")


@query("a19_split_counts", with_views("obs_a obs_b", f"{GROUPED} select group_split, count(*) as n from gs group by 1"))
def a19(spark, d):
    return agg.crosstab(_group_split(spark, d), ["group_split"])


VIEWS_SQL = f"""{GROUPED}, vw as (select 'test' as view, ck as key from split_ where split = 'test'
    union all select 'source_out', ck from split_ where source_out = 1
    union all select 'group_test', ck from gs where group_split = 'test' union all select 'train', ck from split_ where split = 'train')"""


def _views(spark, d):
    base, grouped = _split(spark, d), _group_split(spark, d)
    pick = lambda df, cond, name: df.where(cond).select(F.lit(name).alias("view"), F.col("ck").alias("key"))
    return (
        pick(base, "split = 'test'", "test").unionByName(pick(base, "source_out = 1", "source_out"))
        .unionByName(pick(grouped, "group_split = 'test'", "group_test")).unionByName(pick(base, "split = 'train'", "train"))
    )


@query("x7_freeze_views", with_views("obs_a obs_b", f"""{VIEWS_SQL}, h as (select view, sha256(key) as hx from vw),
    l as (select view, substr(hx, 1, 3) as b, sha256(string_agg(hx, chr(10) order by hx)) as dg, count(*) as n from h group by 1, 2)
    select view, {TWO_LEVEL} from l group by 1"""))
def x7(spark, d):
    return splits.freeze_views(_views(spark, d))


@query("x7_view_overlaps", with_views("obs_a obs_b", f"""{VIEWS_SQL} select l.view as "left", r.view as "right", count(*) as n_common
    from vw l join vw r using (key) where l.view < r.view group by 1, 2"""))
def x7_overlaps(spark, d):
    return splits.view_overlaps(_views(spark, d))


@query("x8_stratified_folds", with_views("wide", """select item_id, gold, cast((row_number() over (partition by gold order by md5('3:' || item_id), item_id) - 1) % 5 as integer) as fold from wide"""))
def x8(spark, d):
    return splits.stratified_folds(fx.wide_predictions(spark, d).select("item_id", "gold"), "item_id", "gold", 5, 3)


@query("x9_seeded_holdout", with_views("obs_b", f"""{KEYS_B} select cast(seed as integer) as seed, ck, case when row_number() over (partition by seed order by md5(seed || ':' || ck), ck)
    <= round_even(count(*) over (partition by seed) * 0.15::double, 0) then 1 else 0 end as held_out from kb, (values (1), (2), (3)) t(seed)"""))
def x9(spark, d):
    return splits.seeded_holdout(fx.obs_b(spark, d), "ck", 0.15, [1, 2, 3])


# ---- metrics ---------------------------------------------------------------

AUC_AP = """sum(neg * (cum_pos - pos / 2)) / (max(all_pos) * max(all_neg)) as auc, sum(pos * cum_pos / (cum_pos + cum_neg)) / max(all_pos) as ap"""


@query("m1_auc", rounded(with_views("pred", f"{CURVE} select view, arm, auc from (select view, arm, {AUC_AP} from curve group by 1, 2)"), "auc"))
def m1(spark, d):
    return tidy(mt.auc_ap(fx.predictions(spark, d), by=BY).drop("ap"))


@query("m2_average_precision", rounded(with_views("pred", f"{CURVE} select view, arm, ap from (select view, arm, {AUC_AP} from curve group by 1, 2)"), "ap"))
def m2(spark, d):
    return tidy(mt.auc_ap(fx.predictions(spark, d), by=BY).drop("auc"))


MOMENTS = """mo as (select view, arm, count(*) as n, cast(sum(gold) as bigint) as positives,
    avg(case when (pred >= 0.5) = (gold = 1) then 1.0::double else 0.0::double end) as accuracy,
    count(*) filter (gold = 1 and pred >= 0.5)::double as tp, count(*) filter (gold = 1 and pred < 0.5)::double as fn,
    count(*) filter (gold = 0 and pred >= 0.5)::double as fp, count(*) filter (gold = 0 and pred < 0.5)::double as tn,
    avg(pow(greatest(least(pred, 1 - 1e-7::double), 1e-7::double) - gold, 2)) as brier,
    count(*) filter (pred <= 0.1 or pred >= 0.9) as high_conf_n,
    count(*) filter ((pred <= 0.1 or pred >= 0.9) and (pred >= 0.5) <> (gold = 1)) / nullif(count(*) filter (pred <= 0.1 or pred >= 0.9), 0)::double as high_conf_error
    from pred group by 1, 2),
mm as (select *, coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) as mcc from mo)"""


def _moments(spark, d, *cols):
    return tidy(mt.moments(fx.predictions(spark, d), by=BY, eps=1e-7).select(*BY, *cols))


@query("m3_accuracy", rounded(with_views("pred", f"{MOMENTS} select view, arm, n, accuracy from mm"), "accuracy"))
def m3(spark, d):
    return _moments(spark, d, "n", "accuracy")


@query("m4_mcc", rounded(with_views("pred", f"{MOMENTS} select view, arm, mcc from mm"), "mcc"))
def m4(spark, d):
    return _moments(spark, d, "mcc")


@query("m5_brier", rounded(with_views("pred", f"{MOMENTS} select view, arm, brier from mm"), "brier"))
def m5(spark, d):
    return _moments(spark, d, "brier")


BINS = """rb as (select view, arm, cast(least(floor(pred * 10), 9) as integer) as b, count(*) as n, avg(pred) as mean_pred, avg(gold) as observed from pred group by 1, 2, 3),
ec as (select view, arm, sum(n * abs(mean_pred - observed)) / sum(n) as ece from rb group by 1, 2)"""


@query("m6_ece", rounded(with_views("pred", f"{BINS} select * from ec"), "ece"))
def m6(spark, d):
    return tidy(mt.ece(fx.predictions(spark, d), by=BY))


@query("m7_reliability_bins", rounded(with_views("pred", f"""{BINS} select view, arm, b + 1 as bin, b / 10.0::double as lower, (b + 1) / 10.0::double as upper, n, mean_pred, observed from rb"""), "lower upper mean_pred observed"))
def m7(spark, d):
    return tidy(mt.reliability_bins(fx.predictions(spark, d), by=BY))


@query("m8_quantile_calibration", rounded(with_views("pred", f"{QCAL} select view, arm, bin, count(*) as n, avg(pred) as mean_pred, avg(gold) as observed from b group by 1, 2, 3"), "mean_pred observed"))
def m8(spark, d):
    return tidy(mt.quantile_calibration(fx.predictions(spark, d), by=BY))


@query("m9_high_confidence", rounded(with_views("pred", f"{MOMENTS} select view, arm, high_conf_n, high_conf_error from mm"), "high_conf_error"))
def m9(spark, d):
    return _moments(spark, d, "high_conf_n", "high_conf_error")


@query("m13_concordance", rounded(with_views("wide", """ra as (select view, A, min(r) + (count(*) - 1) / 2.0::double as ra from (select view, A, row_number() over (partition by view order by A) as r from wide) group by 1, 2),
    rb as (select view, B, min(r) + (count(*) - 1) / 2.0::double as rb from (select view, B, row_number() over (partition by view order by B) as r from wide) group by 1, 2)
    select view, count(*) as n, corr(A, B) as pearson, corr(ra, rb) as spearman, avg(abs(A - B)) as mae, avg(A - B) as bias,
    avg(A - B) - 1.96 * stddev_samp(A - B) as loa_low, avg(A - B) + 1.96 * stddev_samp(A - B) as loa_high
    from wide join ra using (view, A) join rb using (view, B) group by 1"""), "pearson spearman mae bias loa_low loa_high"))
def m13(spark, d):
    return tidy(mt.concordance(fx.wide_predictions(spark, d), "A", "B", ["view"]))


@query("m14_coverage_risk_tau", rounded(with_views("pred", f"""{ORDERED}, top as (select view, arm, max(u) + 1e-6::double as t, count(*) as n from o group by 1, 2),
    grid as (select view, arm, cast(range as integer) as step, t * range / 20.0::double as tau, n from top, range(21)),
    agg as (select g.view, g.arm, g.step, g.tau, g.n, count(o.u) as n_covered, avg(o.err) as risk from grid g left join o on o.view = g.view and o.arm = g.arm and o.u <= g.tau group by all)
    select view, arm, step, tau, n_covered, n_covered / n::double as coverage, coalesce(risk, 1.0::double) as risk from agg"""), "tau coverage risk"))
def m14(spark, d):
    return tidy(mt.coverage_risk_tau(_unsure(spark, d), "u", by=BY))


@query("m15_aurc", rounded(with_views("pred", f"""{ORDERED},
    area as (select view, arm, max(n) as n, sum(cerr / k::double * case when k = 1 or k = n then 0.5::double else 1.0::double end) / max(n) as aurc from ranked group by 1, 2),
    g as (select view, arm, u as score, sum(err)::double as pos, sum(1 - err)::double as neg from o group by 1, 2, 3),
    curve as (select *, sum(pos) over w as cum_pos, sum(neg) over w as cum_neg, sum(pos) over (partition by view, arm) as all_pos, sum(neg) over (partition by view, arm) as all_neg from g
    window w as (partition by view, arm order by score desc rows unbounded preceding)),
    det as (select view, arm, {AUC_AP} from curve group by 1, 2)
    select view, arm, n, aurc, auc as error_auroc, ap as error_auprc from area join det using (view, arm)"""), "aurc error_auroc error_auprc"))
def m15(spark, d):
    return tidy(mt.aurc(_unsure(spark, d), "u", "item_id", by=BY))


GRID19 = [0.1 + 0.05 * i for i in range(19)]
GRID10 = [0.1 * (i + 1) for i in range(10)]


def _grid_sql(grid, cut):
    values = ", ".join(f"({g!r}::double)" for g in grid)
    return rounded(with_views("pred", f"""{ORDERED} select view, arm, grid, k as n_covered, k / n::double as coverage, cerr / k::double as risk,
        csq / k as brier_risk, cu / k as mean_u from ranked, (values {values}) t(grid) where k = greatest(1, cast({cut} as bigint))"""), "grid coverage risk brier_risk mean_u")


@query("m16_risk_at_coverage_floor", _grid_sql(GRID10, "floor(n * grid)"))
def m16(spark, d):
    return tidy(mt.risk_at_coverage(_unsure(spark, d), "u", "item_id", GRID10, "floor", by=BY))


@query("m16_risk_at_coverage_round", _grid_sql(GRID19, "round_even(n * grid, 0)"))
def m16_round(spark, d):
    return tidy(mt.risk_at_coverage(_unsure(spark, d), "u", "item_id", GRID19, "round", by=BY))


@query("m17_abstain_summary", rounded(with_views("pred", f"""{ORDERED} select view, arm, count(*) as n_total, count(*) filter (u > 0.3) as n_abstain,
    count(*) filter (u > 0.3) / count(*)::double as abstain_ratio, count(*) filter (u <= 0.3) as n_covered, avg(1 - err) filter (u <= 0.3) as covered_accuracy,
    1 - avg(1 - err) filter (u <= 0.3) as covered_risk from o group by 1, 2"""), "abstain_ratio covered_accuracy covered_risk"))
def m17(spark, d):
    return tidy(mt.abstain_summary(_unsure(spark, d), "u", 0.3, by=BY))


@query("m19_stratified_metrics", rounded(with_views("pred", """s as (select 'half' as stratifier, case when item_id % 2 = 0 then 'even' else 'odd' end as level, arm, gold, pred from pred
    union all select 'rare', case when item_id % 1000 = 0 then 'thin' else 'thick' end, arm, gold, pred from pred),
    base as (select stratifier, level, arm, count(*) as n, avg(pow(pred - gold, 2)) as brier, min(gold) <> max(gold) as two from s group by 1, 2, 3),
    rb as (select stratifier, level, arm, least(floor(pred * 10), 9) as b, count(*) as n, avg(pred) as mp, avg(gold) as ob from s group by 1, 2, 3, 4),
    ec as (select stratifier, level, arm, sum(n * abs(mp - ob)) / sum(n) as ece from rb group by 1, 2, 3),
    g as (select stratifier, level, arm, pred as score, sum(gold)::double as pos, sum(1 - gold)::double as neg from s group by 1, 2, 3, 4),
    cv as (select *, sum(pos) over w as cp, sum(neg) over w as cn from g window w as (partition by stratifier, level, arm order by score desc rows unbounded preceding)),
    ra as (select stratifier, level, arm, sum(neg * (cp - pos / 2)) / nullif(sum(pos) * sum(neg), 0) as auc, sum(pos * cp / (cp + cn)) / nullif(sum(pos), 0) as ap from cv group by 1, 2, 3)
    select stratifier, level, arm, n, case when n >= 15 and two then auc end as auc, case when n >= 15 and two then ap end as ap, case when n >= 15 and two then brier end as brier,
    case when n >= 15 and two then ece end as ece, case when n >= 15 and two then null else 'too few rows or one class' end as reason
    from base join ec using (stratifier, level, arm) join ra using (stratifier, level, arm)"""), "auc ap brier ece"))
def m19(spark, d):
    strata = {
        "half": F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd"),
        "rare": F.when(F.col("item_id") % 1000 == 0, "thin").otherwise("thick"),
    }
    return tidy(mt.stratified_metrics(fx.predictions(spark, d), strata, ["arm"], min_n=15))


@query("m20_complete_case", rounded(with_views("wide", """o as (select view, gold, A, case when B >= 0.3 then B end as B from wide),
    s as (select view, gold, 'A' as arm, A as pred from o where B is not null union all select view, gold, 'B', B from o where B is not null),
    g as (select view, arm, pred as score, sum(gold)::double as pos, sum(1 - gold)::double as neg, count(*) as n from s group by 1, 2, 3),
    cv as (select *, sum(pos) over w as cp, sum(neg) over w as cn from g window w as (partition by view, arm order by score desc rows unbounded preceding))
    select view, arm, cast(sum(n) as bigint) as n, sum(neg * (cp - pos / 2)) / (sum(pos) * sum(neg)) as auc, sum(pos * cp / (cp + cn)) / sum(pos) as ap from cv group by 1, 2"""), "auc ap"))
def m20(spark, d):
    observed = fx.wide_predictions(spark, d).withColumn("B", F.when(F.col("B") >= 0.3, F.col("B")))
    long = observed.where("B IS NOT NULL").unpivot(["view", "gold"], ["A", "B"], "arm", "pred")
    return tidy(mt.moments(long, by=BY).select(*BY, "n").join(mt.auc_ap(long, by=BY), BY))


MAIN = f"{CURVE}, {MOMENTS}, sc as (select view, arm, {AUC_AP} from curve group by 1, 2)"


@query("m22_main_table", rounded(with_views("pred", f"""{MAIN}, {BINS} select view, arm, n, positives, accuracy, mcc, brier, high_conf_n, high_conf_error, auc, ap, ece
    from mm join sc using (view, arm) join ec using (view, arm)"""), "accuracy mcc brier high_conf_error auc ap ece"))
def m22(spark, d):
    return tidy(mt.all_metrics(fx.predictions(spark, d), by=BY))


@query("m23_compare_views", rounded(with_views("pred", f"""{MAIN}, wd as (select view, max(auc) filter (arm = 'A') as A, max(auc) filter (arm = 'C') as C from sc group by 1)
    select view, A, C, case when A > C then 'A' when C > A then 'C' else 'tie' end as better from wd"""), "A C"))
def m23(spark, d):
    return tidy(mt.compare_views(mt.auc_ap(fx.predictions(spark, d), by=BY), "view", "arm", "auc", "A", "C"))


# ---- replicate summaries ---------------------------------------------------

SEEDS = """g as (select view, arm, seed, pred as score, sum(gold)::double as pos, sum(1 - gold)::double as neg from seeded group by 1, 2, 3, 4),
curve as (select *, sum(pos) over w as cum_pos, sum(neg) over w as cum_neg, sum(pos) over (partition by view, arm, seed) as all_pos, sum(neg) over (partition by view, arm, seed) as all_neg from g
    window w as (partition by view, arm, seed order by score desc rows unbounded preceding)),
per as (select view, arm, seed, """ + AUC_AP + " from curve group by 1, 2, 3)"


def _per_seed(spark, d):
    return mt.auc_ap(fx.seeded_predictions(spark, d), by=[*BY, "seed"], few=True)


@query("a12_replicate_summary", rounded(with_views("seeded", f"""{SEEDS} select arm, count(*) as n_reps, avg(auc) as mean_auc, stddev_samp(auc) as sd_auc,
    avg(auc) - 2.200985160082949::double * stddev_samp(auc) / sqrt(12.0::double) as lo_auc, avg(auc) + 2.200985160082949::double * stddev_samp(auc) / sqrt(12.0::double) as hi_auc from per group by 1"""), "mean_auc sd_auc lo_auc hi_auc"))
def a12(spark, d):
    return tidy(agg.replicate_summary(_per_seed(spark, d), ["arm"], ["auc"]))


@query("a13_paired_pivot", rounded(with_views("seeded", f"""{SEEDS}, p as (select view, seed, max(auc) filter (arm = 'A') as A, max(auc) filter (arm = 'B') as B, max(auc) filter (arm = 'C') as C from per group by 1, 2)
    select *, A - B as A_minus_B, A - C as A_minus_C from p"""), "A B C A_minus_B A_minus_C"))
def a13(spark, d):
    return tidy(agg.paired_pivot(_per_seed(spark, d), ["view", "seed"], "arm", "auc", fx.ARMS, "A"))
