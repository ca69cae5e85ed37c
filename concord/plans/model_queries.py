"""Evidence tables, latent fits, vote merging, calibration lines and learners."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord import fixtures as fx
from concord.operators import aggregate as agg, calibrate as cal, evidence as ev, joins, latent, learn, metrics as mt, provenance as pv, votes as vt
from concord.operators.ranking import hash_rank
from concord.plans.common import rounded, tidy
from concord.plans import provenance_queries as views
from concord.plans.metric_queries import SEEDS, _per_seed
from concord.plans.provenance_queries import CONS, TIER
from concord.plans.registry import query
from concord.plans.resample_queries import curve_sql, long_arms
from concord.plans.views import with_views
from concord.session import cut_lineage

# ---- evidence --------------------------------------------------------------


def consensus(spark, d, refs=True):
    """Labels and values of an item; ``refs`` asks for its sources and the flag that follows from them as well."""
    a = agg.consolidate(fx.obs_a(spark, d), "ck", "refs" if refs else None).select("ck", "raw_labels", *["refs"] * refs)
    b = fx.obs_b(spark, d).groupBy("ck").agg(F.min_by("label", "ord").alias("b_label"))
    c = agg.summarise_values(fx.obs_c(spark, d), "ck", refs=None).select("ck", "values")
    out = a.join(b, "ck", "full_outer").join(c, "ck", "full_outer")
    return out if not refs else out.withColumn("source_out", F.coalesce(F.arrays_overlap("refs", F.array(F.lit("S1"), F.lit("S2"))), F.lit(False)).cast("int"))


def evidence(spark, d, source_out=None):
    return ev.build_evidence(consensus(spark, d, refs=source_out is not None), "ck", "raw_labels", "b_label", "values", source_out)


def refs(spark, d):
    return joins.item_refs(fx.obs_a(spark, d), "ck").withColumnRenamed("ck", "item")


def test_items(spark, d):
    """A fixed 15% of the B-labelled items, whose B label is the gold."""
    b = fx.obs_b(spark, d).groupBy(F.col("ck").alias("item")).agg(F.min_by("label", "ord").alias("gold"))
    ranked = hash_rank(b, ["item"], 42)
    return ranked.where(F.col("rank") <= F.bround(F.col("n") * 0.15)).select("item", "gold")


EVIDENCE = """ra as (select ck, list_has_any(list(ref), ['S1', 'S2']) as out_ from obs_a group by 1),
ea as (select distinct ck as item, label from obs_a),
eb as (select ck as item, arg_min(label, ord) as label from obs_b group by 1),
evi as (select item, 'a' as channel, cast(row_number() over (partition by item order by label) - 1 as integer) as ord, label::double as value from ea
    union all select item, 'b', 0, label::double from eb
    union all select ck, 'c', cast(row_number() over (partition by ck order by value) - 1 as integer), round(value, 3) + 0.0::double from obs_c)"""


@query("l1_build_evidence", with_views("obs_a obs_b obs_c", f"""{EVIDENCE} select e.* from evi e left join ra on ck = item where not coalesce(out_, false)"""))
def l1(spark, d):
    return tidy(evidence(spark, d, "source_out"))


MASKED = f"""{EVIDENCE}, cited as (select distinct ck as item from obs_a where ref in ('S3', 'S4')),
ti as (select item from (select item, row_number() over (order by md5('42:' || item), item) as r, count(*) over () as n from eb) where r <= round_even(n * 0.15::double, 0)),
nob as (select * from evi where not (channel = 'b' and item in (select item from ti))),
cut as (select * from nob where channel = 'b' or item not in (select item from cited))"""


@query("l2_mask_evidence", with_views("obs_a obs_b obs_c", f"""{MASKED} select item, channel, case when channel = 'a' then 0 else ord end as ord, value from cut where channel <> 'a'
    union all select item, 'a', 0, case when avg(value) >= 0.5 then 1.0::double else 0.0::double end from cut where channel = 'a' group by 1"""))
def l2(spark, d):
    e = ev.without_items(evidence(spark, d), test_items(spark, d), "b")
    e = ev.without_refs(e, refs(spark, d), ["S3", "S4"])
    return tidy(ev.merged_duplicates(e).select("item", "channel", "ord", "value"))


@query("l2_tier_evidence", with_views("obs_a obs_b obs_c", f"""{EVIDENCE}, {CONS}, tr as (select ck as item, {TIER} as tier from tier where v0 is not null)
    select * from evi where channel = 'b' or item in (select item from tr where tier in ('L1', 'L2'))"""))
def l2_tiers(spark, d):
    return tidy(ev.only_tiers(evidence(spark, d), tiers(spark, d), ["L1", "L2"]).select("item", "channel", "ord", "value"))


# ---- the latent model ------------------------------------------------------


def _leak_free(spark, d):
    return ev.without_items(evidence(spark, d), test_items(spark, d), "b")


@query("l3_fit_latent")
def l3(spark, d):
    return tidy(latent.fit_latent(evidence(spark, d)).items)


@query("l4_score_uncertainty")
def l4(spark, d):
    fit = latent.fit_latent(_leak_free(spark, d), items=test_items(spark, d))
    return tidy(fit.items.select("item", "p", "sigma"))


@query("l5_objective")
def l5(spark, d):
    e = evidence(spark, d)
    return tidy(latent.objective(latent.fit_latent(e), e), 4)


@query("l6_save_load_fit")
def l6(spark, d):
    from concord.plans.table_queries import _scratch

    path = _scratch(spark)
    latent.save_fit(latent.fit_latent(evidence(spark, d)), path)
    return tidy(latent.load_fit(spark, path).params)


def tiers(spark, d):
    """(item, tier) of the items with two comparable values, by H9."""
    return pv.provenance_tiers(views.consensus(spark, d, labels=False), "refs", views.LISTED, "v0", "mid").select(F.col("ck").alias("item"), "tier")


def _item_flags(spark, d, listed):
    """Items with their evidence, which of the ``listed`` sources they cite, their tier and whether they are test items.

    The B label of test items is not known to any but the retrospective variant.
    """
    everything = cut_lineage(evidence(spark, d))
    rows = latent.item_evidence(everything, ev.permuted_values(everything, 5))
    cited = refs(spark, d).where(F.col("ref").isin(*listed)).groupBy("item").agg(F.collect_set("ref").alias("cited"))
    test = test_items(spark, d).select("item", F.lit(True).alias("test"))
    out = rows.join(cited, "item", "left").join(tiers(spark, d), "item", "left").join(test, "item", "left")
    return out.withColumns({"cited": F.coalesce("cited", F.array().cast("array<string>")), "test": F.coalesce("test", F.lit(False))})


def _cites(*names):
    return F.arrays_overlap("cited", F.array(*[F.lit(n) for n in names]))


def _known_b():
    return F.when(~F.col("test"), F.col("yb"))


def _full(**settings):
    """A variant in which the B labels of test items are hidden."""
    return latent.variant(yb=_known_b(), **settings)


def ablation_variants(spark, items):
    """The 13 variants of the evidence as expressions over one row per item."""
    train = items.where("NOT test").agg(
        (F.sum("s") / F.sum("n")).alias("m"), F.sqrt(F.sum("q") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2)).alias("d")).first()
    moved = (F.lit(float(train["m"])), F.lit(float(train["d"])))
    not_in = lambda *t: ~F.coalesce(F.col("tier").isin(*t), F.lit(False))
    merged = (F.col("ya_mean") >= 0.5).cast("double")
    return {
        "full": _full(), "no_values": _full(values=None), "no_offset": _full(), "prior_0.01": _full(), "prior_1": _full(),
        "without_refs": _full(hidden=_cites("S1", "S2")), "merged_duplicates": _full(ya=merged),
        "tier_1": _full(hidden=not_in("L1")), "tier_1_2": _full(hidden=not_in("L1", "L2")),
        "tier_1_2_3": _full(hidden=not_in("L1", "L2", "L3")), "no_b": latent.variant(yb=F.lit(None).cast("double")),
        "no_a": latent.variant(ya=_known_b(), yb=F.lit(None).cast("double")), "permuted": _full(values=("sp", "qp", "vp")),
        "standardised": _full(moved=moved), "no_offset_merged": _full(ya=merged),
    }


@query("l7_ablate")
def l7(spark, d):
    items = cut_lineage(_item_flags(spark, d, ["S1", "S2"]))
    return tidy(latent.ablate(items, ablation_variants(spark, items), test_items(spark, d),
                              prior={"prior_0.01": 0.01, "prior_1": 1.0}, frozen=["no_offset", "no_offset_merged"]))


@query("l7_variant_counts", with_views("obs_a obs_b obs_c", f"""{EVIDENCE}, {CONS},
tr as (select ck as item, {TIER} as tier from tier where v0 is not null),
ti as (select item from (select item, row_number() over (order by md5('42:' || item), item) as r, count(*) over () as n from eb) where r <= round_even(n * 0.15::double, 0)),
it as (select item, max(value) filter (channel = 'a') as ya, max(value) filter (channel = 'b' and item not in (select item from ti)) as yb, count(*) filter (channel = 'c') as n,
    item in (select ck from obs_a where ref in ('S1', 'S2')) as cites, tier from evi left join tr using (item) group by item, tier),
v as (select 'full' as variant, false as gone, * from it union all select 'without_refs', cites, * from it
    union all select 'tier_1', tier is null or tier <> 'L1', * from it union all select 'tier_1_2', tier is null or tier not in ('L1', 'L2'), * from it
    union all select 'tier_1_2_3', tier is null, * from it)
select variant, cast(count(*) filter (gone) as bigint) as n_removed, count(*) filter (yb is not null or (not gone and (ya is not null or n > 0))) as n_known,
    cast(coalesce(sum(n) filter (not gone), 0) as bigint) as n_values from v group by 1"""))
def l7_counts(spark, d):
    """How much evidence the masks of five variants leave, from the shared item rows."""
    items = cut_lineage(_item_flags(spark, d, ["S1", "S2"]))
    kept = ("full", "without_refs", "tier_1", "tier_1_2", "tier_1_2_3")
    known, spread = latent.read_variants(items, {k: v for k, v in ablation_variants(spark, items).items() if k in kept})
    left = known.groupBy("variant").agg(F.count("*").alias("n_known"), F.sum("n").alias("n_values"))
    return spread.select("variant", "n_removed").join(left, "variant")


@query("l8_sensitivity")
def l8(spark, d):
    items = cut_lineage(_item_flags(spark, d, ["S1"]))
    priors = {"full": 0.1, "prior_0.01": 0.01, "prior_1": 1.0}
    starts = {f"start_{s}": s for s in (11, 22, 33, 44, 55)}
    return tidy(latent.ablate(items, {v: _full() for v in [*priors, *starts]}, test_items(spark, d), prior=priors, starts=starts))


@query("l9_leave_one_source_out")
def l9(spark, d):
    top = [x["ref"] for x in refs(spark, d).groupBy("ref").count().orderBy(F.desc("count"), "ref").limit(5).collect()]
    items = cut_lineage(_item_flags(spark, d, top))
    return tidy(latent.ablate(items, {"full": _full(), **{f"without_{x}": _full(hidden=_cites(x)) for x in top}}, test_items(spark, d)))


@query("l10_held_out_scores")
def l10(spark, d):
    """Held-out scores of each view beside those of the fit that saw everything."""
    items = cut_lineage(_item_flags(spark, d, ["S1"]))
    a_view = hash_rank(items.where("ya IS NOT NULL").select("item"), ["item"], 43)
    a_items = cut_lineage(a_view.where(F.col("rank") <= F.bround(F.col("n") * 0.15)).select("item", F.lit(True).alias("a_test")))
    items = cut_lineage(items.join(a_items, "item", "left").withColumn("a_test", F.coalesce("a_test", F.lit(False))))
    known, spread = latent.read_variants(items, {
        "retrospective": latent.variant(), "b_held_out": _full(),
        "a_held_out": latent.variant(ya=F.when(~F.col("a_test"), F.col("ya")))})
    fit = latent.fit_items(known, spread)
    views_ = test_items(spark, d).select("item", F.lit("b_held_out").alias("variant")).unionByName(
        a_items.select("item", F.lit("a_held_out").alias("variant")))
    held = fit.items.join(views_, ["variant", "item"]).select("item", F.col("variant").alias("view"), "p", "sigma")
    seen = fit.items.where("variant = 'retrospective'").select("item", F.col("p").alias("p_seen"), F.col("sigma").alias("sigma_seen"))
    return tidy(held.join(seen, "item"))


# ---- votes -----------------------------------------------------------------


def _items(spark, d):
    """All items, voted on or not."""
    return fx.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("item"))


@query("l11_vote_mean", rounded(with_views("votes", "select o_orderkey::varchar as item, coalesce(avg(label), 0.5::double) as score from orders left join votes on item = o_orderkey::varchar group by 1"), "score"))
def l11(spark, d):
    return tidy(vt.vote_mean(fx.votes(spark, d), _items(spark, d)))


@query("l12_vote_weighted", rounded(with_views("votes", """w as (select source, 1.0::double - 0.3::double * (row_number() over (order by source) - 1) / (count(*) over () - 1)::double as weight from (select distinct source from votes))
    select o_orderkey::varchar as item, coalesce(sum(label * weight) / sum(weight), 0.5::double) as score
    from orders left join (votes join w using (source)) on item = o_orderkey::varchar group by 1"""), "score"))
def l12(spark, d):
    v = fx.votes(spark, d)
    return tidy(vt.vote_weighted(v, vt.linear_weights(v), _items(spark, d)))


@query("l13_dawid_skene")
def l13(spark, d):
    return tidy(vt.dawid_skene(fx.votes(spark, d), items=_items(spark, d))[0])


@query("l14_dawid_skene_map")
def l14(spark, d):
    return tidy(vt.dawid_skene(fx.votes(spark, d), beta=2.0, items=_items(spark, d))[0])


@query("l15_fit_latent_multi")
def l15(spark, d):
    values = fx.obs_c(spark, d).groupBy(F.col("ck").alias("item")).agg(F.avg("value").alias("value"))
    return tidy(vt.fit_latent_multi(fx.votes(spark, d), values, items=_items(spark, d))[0])


# ---- calibration lines and tests -------------------------------------------

BY = ["view", "arm"]


@query("m10_calibration_line")
def m10(spark, d):
    return tidy(cal.calibration_line(fx.predictions(spark, d), by=BY), 4)


@query("m11_crossfit_platt")
def m11(spark, d):
    scored, _ = cal.crossfit_platt(fx.predictions(spark, d), "item_id", seed=3, by=BY)
    return tidy(scored.select("view", "arm", "item_id", "fold", "p_cal"))


@query("m12_platt")
def m12(spark, d):
    pred = fx.predictions(spark, d)
    lines = cal.platt_fit(pred.where("view = 0"), by=["arm"])
    return tidy(cal.platt_apply(pred.where("view <> 0"), lines, by=["arm"]).select("view", "arm", "item_id", "p_cal", "u_cal"))


@query("m21_channel_baseline")
def m21(spark, d):
    b = fx.obs_b(spark, d).groupBy(F.col("ck").alias("item")).agg(F.min_by("label", "ord").alias("label"))
    c = fx.obs_c(spark, d).groupBy(F.col("ck").alias("item")).agg(F.avg("value").alias("value"))
    test = test_items(spark, d).select("item", F.lit(True).alias("test"))
    df = b.join(c, "item", "left").join(test, "item", "left").withColumn("test", F.coalesce("test", F.lit(False)))
    return tidy(cal.channel_baseline(df, "label", "value", ~F.col("test")).where("test").select("item", "value", "p_channel"))


@query("r10_paired_t")
def r10(spark, d):
    wide = agg.paired_pivot(_per_seed(spark, d), ["view", "seed"], "arm", "auc", fx.ARMS, "A")
    return tidy(cal.paired_t(wide, "A", ["B", "C"]))


# ---- learners --------------------------------------------------------------


JOINT = """lim as (select avg(1 - C) filter (gold = 0) as t0, avg(C) filter (gold = 1) as t1 from wide),
jn as (select item_id, gold, C, case when 1 - C >= t0 and C >= t1 then case when C > 0.5 then 1 else 0 end when C >= t1 then 1 when 1 - C >= t0 then 0 end as j from wide, lim),
joint_ as (select gold, count(*) filter (j = 0) as as_0, count(*) filter (j = 1) as as_1, count(*) as n from jn group by 1)"""


@query("g3_confident_joint", with_views("wide", f"{JOINT} select * from joint_"))
def g3_joint(spark, d):
    return learn.confident_joint(fx.wide_predictions(spark, d), "gold", "C")


ISSUES = f"""{JOINT}, sc as (select item_id, gold, C, case when gold = 1 then C else 1 - C end as self_confidence from wide),
rk as (select *, row_number() over (partition by gold order by self_confidence, md5('0:' || item_id), item_id) as r from sc),
iss as (select item_id, gold, C, self_confidence, r <= round_even(case when gold = 1 then as_0 else as_1 end / (as_0 + as_1)::double * n, 0) and self_confidence < 0.5 as issue
    from rk join joint_ using (gold))"""


@query("g3_label_issues", rounded(with_views("wide", f"{ISSUES} select * from iss"), "C self_confidence"))
def g3(spark, d):
    return tidy(learn.label_issues(fx.wide_predictions(spark, d), "item_id", "gold", "C"))


@query("g4_flip_labels", with_views("wide", f"{ISSUES} select item_id, gold, issue, case when issue then 1 - gold else gold end as cleaned from iss"))
def g4(spark, d):
    issues = learn.label_issues(fx.wide_predictions(spark, d), "item_id", "gold", "C")
    return learn.flip_labels(issues, "gold").select("item_id", "gold", "issue", "cleaned")


@query("g5_noise_matrix", rounded(with_views("wide", f"{JOINT} select gold, as_0 / (as_0 + as_1)::double as p_0, as_1 / (as_0 + as_1)::double as p_1 from joint_"), "p_0 p_1"))
def g5(spark, d):
    return tidy(learn.noise_matrix(learn.confident_joint(fx.wide_predictions(spark, d), "gold", "C"), "gold"))


@query("g6_ensemble", rounded(with_views("seeded", f"""e as (select view, arm, item_id, gold, round(avg(pred), 12) as pred from seeded group by 1, 2, 3, 4),
    {curve_sql('e', 'view, arm')} select * from sc"""), "auc ap"))
def g6(spark, d):
    mean = learn.ensemble(fx.seeded_predictions(spark, d), "item_id", BY).withColumn("pred", F.round("pred", 12))
    return tidy(mt.auc_ap(mean, by=BY))


@query("g6_seed_summary", rounded(with_views("seeded", f"""{SEEDS} select view, arm, count(*) as n, avg(auc) as auc_mean, stddev_samp(auc) as auc_sd, min(auc) as auc_min, max(auc) as auc_max,
    avg(ap) as ap_mean, stddev_samp(ap) as ap_sd, min(ap) as ap_min, max(ap) as ap_max from per group by 1, 2"""), "auc_mean auc_sd auc_min auc_max ap_mean ap_sd ap_min ap_max"))
def g6_seeds(spark, d):
    return tidy(agg.summary_stats(_per_seed(spark, d), BY, ["auc", "ap"]))


RULES = """w as (select *, case when item_id % 10 = 0 then 0 else gold end as y_low, case when item_id % 10 = 0 then 1 else gold end as y_high from wide),
w3 as (select 'y' as rule, gold, A, B, C from w union all select 'y_low', y_low, A, B, C from w union all select 'y_high', y_high, A, B, C from w)"""


@query("g7_evaluate_rules", rounded(with_views("wide", f"""{RULES}, l as ({long_arms('w3', 'rule')}), {curve_sql('l', 'rule, arm')},
    br as (select rule, arm, count(*) as n, cast(sum(gold) as bigint) as positives, avg(pow(pred - gold, 2)) as brier from l group by 1, 2)
    select rule, arm, n, positives, auc, ap, brier from sc join br using (rule, arm)"""), "auc ap brier"))
def g7(spark, d):
    at = F.col("item_id") % 10 == 0
    wide = fx.wide_predictions(spark, d).withColumns({
        "y_low": F.when(at, 0).otherwise(F.col("gold")), "y_high": F.when(at, 1).otherwise(F.col("gold"))})
    out = learn.evaluate_rules(wide, {"y": "gold", "y_low": "y_low", "y_high": "y_high"}, fx.ARMS)
    return tidy(out.select("rule", "arm", "n", "positives", "auc", "ap", "brier"))


@query("g8_failure_rates", rounded("""select o_orderpriority, count(*) as n_units, count(*) filter (o_orderstatus = 'F') as n_failed,
    avg(case when o_orderstatus = 'F' then 1.0::double else 0.0::double end) as failure_rate from orders group by 1""", "failure_rate"))
def g8(spark, d):
    units = fx.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    failures = units.where("o_orderstatus = 'F'").select("o_orderkey")
    return tidy(learn.failure_rates(units, failures, ["o_orderkey"], ["o_orderpriority"]))
