"""Fits against plain numpy on whole small fixtures, and their invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord import fixtures as fx
from concord.operators import calibrate, evidence as ev, latent, metrics as mt, replicates as rp, resample as rs, votes as vt
from concord.plans.model_queries import evidence


def sig(x):
    return 1 / (1 + np.exp(-x))


def plain_latent(rows, rounds, epochs, prior=0.1, lr=0.01):
    """Item by item, with the true mean loss over all B rows."""
    items = sorted({r[0] for r in rows})
    pos = {k: i for i, k in enumerate(items)}
    ya, yb, vals = np.full(len(items), np.nan), np.full(len(items), np.nan), [[] for _ in items]
    for item, channel, value in sorted(rows):
        i = pos[item]
        if channel == "a":
            ya[i] = value
        elif channel == "b":
            yb[i] = value
        else:
            vals[i].append(value)
    n, sv = np.array([len(v) for v in vals]), np.array([sum(v) for v in vals])
    within = [np.var(v) for v in vals if len(v) > 1]
    var = float(np.mean(within)) if within else float(np.var(np.concatenate(vals)))
    sd, theta, mu = max(math.sqrt(var), 0.05), np.array([0.0, 1.0, 0.0]), np.zeros(len(items))
    a_, b_ = ~np.isnan(ya), ~np.isnan(yb)
    for _ in range(rounds):
        delta, a, b = theta
        for step in range(31):
            p, q = sig(mu), sig(mu + delta)
            g = prior * mu + np.where(a_, p - np.nan_to_num(ya), 0) + np.where(b_, q - np.nan_to_num(yb), 0) + a * (n * (a * mu + b) - sv) / sd**2
            h = prior + np.where(a_, p * (1 - p), 0) + np.where(b_, q * (1 - q), 0) + n * a * a / sd**2
            if step < 30:
                mu = np.clip(mu - 0.5 * g / np.maximum(h, 0.1), -5, 5)
        sigma = 1 / np.sqrt(np.maximum(h, 1e-8))
        m, v = np.zeros(3), np.zeros(3)
        for t in range(1, epochs + 1):
            delta, a, b = theta
            res = n * (a * mu + b) - sv
            grad = np.array([np.mean(sig(mu[b_] + delta) - yb[b_]), (res * mu).sum() / sd**2, res.sum() / sd**2])
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta - lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        sd = math.sqrt(min(max(var, 0.0025), 25.0))
    return {k: (mu[i], sigma[i]) for k, i in pos.items()}, theta


def test_latent_equals_item_by_item_fit(spark, sf):
    e = evidence(spark, sf).cache()
    rows = [(r["item"], r["channel"], r["value"]) for r in e.collect()]
    want, theta = plain_latent(rows, 8, 20)
    fit = latent.fit_latent(e, rounds=8, epochs=20)
    got = {r["item"]: (r["mu"], r["sigma"]) for r in fit.items.collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k][j] - want[k][j]) for k in want for j in (0, 1)) < 1e-9
    p = fit.params.first()
    assert [p["delta"], p["a"], p["b"]] == pytest.approx(list(theta), abs=1e-9)
    assert all(abs(m) <= 5 and s <= 1 / math.sqrt(0.1) + 1e-12 for m, s in got.values())


def test_latent_item_without_evidence_and_variants(spark):
    e = spark.createDataFrame([("x", "a", 0, 1.0), ("y", "b", 0, 0.0)], "item string, channel string, ord int, value double")
    stacked = latent.stack_variants({"full": e, "no_b": ev.without_channel(e, "b")})
    items = spark.createDataFrame([("x",), ("y",), ("z",)], "item string")
    fit = latent.fit_latent(stacked, rounds=3, epochs=5, items=items)
    got = {(r["variant"], r["item"]): r for r in fit.items.collect()}
    assert got["full", "z"]["mu"] == 0 and got["full", "z"]["sigma"] == pytest.approx(1 / math.sqrt(0.1))
    assert got["no_b", "y"]["mu"] == 0 and got["full", "y"]["mu"] < 0 < got["full", "x"]["mu"]


def test_frozen_offset_and_priors(spark, sf):
    e = evidence(spark, sf)
    fit = latent.fit_latent(latent.stack_variants({"full": e, "fixed": e}), rounds=3, epochs=10, frozen=["fixed"], prior={"fixed": 1.0})
    p = {r["variant"]: r for r in fit.params.collect()}
    assert p["fixed"]["delta"] == 0 and p["full"]["delta"] != 0 and p["fixed"]["prior"] == 1.0 and p["full"]["prior"] == 0.1


def plain_dawid_skene(x, beta, rounds=100, tol=1e-7):
    seen = ~np.isnan(x)
    z = np.nan_to_num(x)
    q = np.clip(z.sum(1) / seen.sum(1), 0.05, 0.95)
    se, sp = np.full(x.shape[1], 0.75), np.full(x.shape[1], 0.75)
    for _ in range(rounds):
        old = q
        t = np.where(z == 1, np.log(se) - np.log(1 - sp), np.log(1 - se) - np.log(sp))
        q = sig(np.clip((t * seen).sum(1), -30, 30))
        w = q[:, None] * seen
        u = (1 - q)[:, None] * seen
        se = np.clip(((z * w).sum(0) + beta) / (w.sum(0) + 2 * beta), 1e-4, 1 - 1e-4)
        sp = np.clip((((1 - z) * u).sum(0) + beta) / (u.sum(0) + 2 * beta), 1e-4, 1 - 1e-4)
        if np.abs(q - old).max() < tol:
            break
    return q, se


@pytest.mark.parametrize("beta", [1.0, 2.0])
def test_dawid_skene_equals_dense_em(spark, sf, beta):
    v = fx.votes(spark, sf)
    pdf = v.toPandas().pivot(index="item", columns="source", values="label")
    want, sens = plain_dawid_skene(pdf.to_numpy(dtype=float), beta, rounds=12)
    scores, sources = vt.dawid_skene(v, beta=beta, max_iter=12)
    got = {r["item"]: r["score"] for r in scores.collect()}
    assert max(abs(got[i] - w) for i, w in zip(pdf.index, want)) < 1e-9
    assert [r["sensitivity"] for r in sources.orderBy("source").collect()] == pytest.approx(list(sens), abs=1e-9)


def test_dawid_skene_unanimous(spark):
    rows = [(f"i{i}", s, i % 2) for i in range(20) for s in range(3)]
    scores, _ = vt.dawid_skene(spark.createDataFrame(rows, "item string, source int, label int"))
    assert all((r["score"] > 0.99) == (int(r["item"][1:]) % 2 == 1) for r in scores.collect())


def test_latent_multi_follows_votes(spark, sf):
    v = fx.votes(spark, sf)
    scores, lines = vt.fit_latent_multi(v, rounds=3)
    both = scores.join(vt.vote_mean(v).withColumnRenamed("score", "mean"), "item")
    assert both.select(F.corr("score", "mean")).first()[0] > 0.9
    assert lines.count() == 5 and both.agg(F.min("score"), F.max("score")).first()[0] >= 0


def test_logistic_line_equals_newton(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    y = (rng.random(300) < sig(0.4 + 1.3 * x)).astype(int)
    b = np.zeros(2)
    d = np.c_[np.ones(300), x]
    for _ in range(30):
        p = sig(d @ b)
        b = b - np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + np.diag([0, 0.5]), d.T @ (p - y) + np.array([0, 0.5 * b[1]]))
    df = spark.createDataFrame([(int(i), float(j)) for i, j in zip(y, x)], "y int, x double")
    r = calibrate.fit_logistic_1d(df, "y", "x", ridge=0.5).first()
    assert [r["intercept"], r["slope"]] == pytest.approx(list(b), abs=1e-7)


def test_crossfit_keeps_folds_apart(spark, sf):
    pred = fx.predictions(spark, sf).where("arm = 'A'")
    scored, params = calibrate.crossfit_platt(pred, "item_id", seed=1)
    assert scored.count() == pred.count() and params.count() == 5
    n = pred.count()
    assert all(r["n_train"] + r["n_test"] == n for r in params.collect())


@pytest.mark.parametrize("size", [16384, 40])
def test_replicate_metrics_equal_weighted_metrics(spark, sf, size):
    """The packed weights, unfolded to rows, give the same numbers through plain SQL operators."""
    wide = fx.wide_predictions(spark, sf)
    weights = rp.bootstrap_weights(wide, "item_id", fx.ARMS, 130, 3, ["view"], range_rows=size)
    weights = weights.cache()
    got = {(r["view"], r["arm"], r["rep"]): r for r in rp.weighted_metrics(weights, ["view"], 130).collect()}
    assert len(got) == 3 * 3 * 130
    rows = []
    for r in weights.where("chunk = 1 AND view = 0").collect():
        score, y = np.frombuffer(r["score"], "<f8").tolist(), np.frombuffer(r["y"], np.uint8).tolist()
        for p, label, w in zip(score, y, rp.unpack_weights(bytes(r["w"]), 5)):
            rows += [(r["view"], r["arm"], 125 + k, p, label, int(c)) for k, c in enumerate(w) if c]
    long = spark.createDataFrame(rows, "view int, arm string, rep int, pred double, gold int, w int")
    for r in mt.all_metrics(long, by=["view", "arm", "rep"], weight="w").collect():
        g = got[r["view"], r["arm"], r["rep"]]
        for m in ("auc", "ap", "brier", "ece"):
            assert g[m] == pytest.approx(r[m], abs=1e-9)
    sizes = long.groupBy("view", "arm", "rep").agg(F.sum("w").alias("n")).select("n").distinct().collect()
    assert [r["n"] for r in sizes] == [wide.where("view = 0").count()]


def test_fast_permutation_observes_the_true_difference(spark, sf):
    wide = fx.wide_predictions(spark, sf)
    m = {(r["view"], r["arm"]): r["auc"] for r in mt.auc_ap(fx.predictions(spark, sf), by=["view", "arm"]).collect()}
    for r in rs.paired_permutation(wide, "item_id", [("A", "B"), ("B", "C")], 40, 2, ["view"]).collect():
        assert r["auc_diff"] == pytest.approx(m[r["view"], r["arm1"]] - m[r["view"], r["arm2"]], abs=1e-9)
        assert 1 / 41 <= r["auc_p"] <= 1 and r["n_perm"] == 40


def test_multiverse_samplers_agree_in_distribution(spark, sf):
    a, b = fx.obs_a(spark, sf), fx.obs_b(spark, sf)
    key = lambda r: (r["identity"], r["mode"], r["filter"])
    fast = {key(r): r for r in rs.multiverse_bootstrap(a, b, "ck", "fk", 500, 1).collect()}
    slow = {key(r): r for r in rs.multiverse_bootstrap(a, b, "ck", "fk", 500, 1, sampler="md5").collect()}
    assert fast.keys() == slow.keys() and len(fast) == 8
    for k, f in fast.items():
        assert (f["n01"], f["n10"]) == (slow[k]["n01"], slow[k]["n10"])
        assert f["low"] <= f["mean_rho"] <= f["high"] and f["sim_low"] <= f["low"]
        assert f["mean_rho"] == pytest.approx(slow[k]["mean_rho"], abs=0.01)
        assert f["low"] == pytest.approx(slow[k]["low"], abs=0.025)


def test_multinomial_totals_are_whole(spark):
    rows = spark.range(5000).select((F.col("id") % 7 + 1).alias("c"), F.lit(1).alias("one"), F.col("id").alias("x"))
    got = rs.multinomial_totals(rows, "c", ["one", "x"], 130, 5).toPandas()
    total = sum(i % 7 + 1 for i in range(5000))
    assert len(got) == 130 and (got["one"] == total).all()
    assert got["x"].mean() == pytest.approx(sum(i * (i % 7 + 1) for i in range(5000)), rel=0.01)


def test_missing_scores_drop_the_row_for_all_arms(spark, sf):
    wide = fx.wide_predictions(spark, sf)
    holes = wide.withColumn("B", F.when(F.col("item_id") % 5 == 0, F.lit(None)).when(F.col("item_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("B")))
    whole = wide.where("item_id % 5 <> 0 AND item_id % 7 <> 0")
    for sampler in ("multinomial", "md5"):
        a = rs.paired_bootstrap(holes, "item_id", ["A", "B"], 60, 5, ["view"], sampler=sampler).collect()
        assert sorted(a) == sorted(rs.paired_bootstrap(whole, "item_id", ["A", "B"], 60, 5, ["view"], sampler=sampler).collect())
    a = rs.paired_permutation(holes, "item_id", [("A", "B")], 40, 5, ["view"]).collect()
    assert sorted(a) == sorted(rs.paired_permutation(whole, "item_id", [("A", "B")], 40, 5, ["view"]).collect())


def test_a_group_keeps_its_draws_when_another_grows(spark, sf):
    wide = fx.wide_predictions(spark, sf)
    grown = wide.union(wide.where("view = 1").withColumn("item_id", F.col("item_id") + 10**6))
    for _ in range(4):
        grown = grown.union(grown.where("view = 1").withColumn("item_id", F.col("item_id") * 3 + 1))
    alone = rs.paired_bootstrap(wide.where("view = 0"), "item_id", ["A", "B"], 50, 5, ["view"]).collect()
    assert rs.paired_bootstrap(grown, "item_id", ["A", "B"], 50, 5, ["view"]).where("view = 0").collect() == alone


def test_redraw_goes_on_until_every_replicate_counts(spark):
    rows = spark.range(400).select(F.col("id").alias("item_id"), (F.col("id") == 7).cast("int").alias("gold"),
                                   F.rand(1).alias("A"), F.rand(2).alias("B"))
    for sampler in ("multinomial", "md5"):
        got = rs.replicate_metrics(rows, "item_id", ["A", "B"], 30, 3, sampler=sampler).groupBy("arm").count().collect()
        assert sorted(got) == [("A", 30), ("B", 30)]
    with pytest.raises(ValueError):
        rs.replicate_metrics(rows.where("gold = 0"), "item_id", ["A"], 30, 3)


def test_prevalence_uses_the_replicates_asked_for(spark, sf):
    df = fx.predictions(spark, sf).where("arm = 'A'")
    one = rs.prevalence_check(df, "item_id", "pred", "gold", 1, 3).first()
    assert one["low"] == one["high"] == one["replicated"]


def test_score_buckets_follow_the_data(spark):
    from concord.operators.ranking import spread_buckets
    df = spark.range(20000).select((F.pow(F.rand(1), 8) * 0.001).alias("score"), F.lit(1).alias("g")).union(
        spark.range(2000).select(F.lit(0.5), F.lit(2)))
    got = spread_buckets(df, "score", ["g"], 500).groupBy("g", "_bucket").agg(
        F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).orderBy("g", "lo").collect()
    one = [r for r in got if r["g"] == 1]
    assert len(one) > 40 and max(r["n"] for r in one) < 3000 and len(got) == len(one) + 1
    assert [r["_bucket"] for r in one] == sorted(r["_bucket"] for r in one)
    assert all(a["hi"] <= b["lo"] for a, b in zip(one, one[1:]))


def test_soft_labels_come_from_training_rows(spark, sf):
    from concord.plans.tree_queries import _labelled
    rows = _labelled(spark, sf).join(fx.docs(spark, sf).select("doc_id", "source"), "doc_id").select(
        "source", "quality", "soft", "train").collect()
    assert any(not r["train"] for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r["quality"] for r in rows if r["source"] == source and r["train"]]
        soft = {None if r["soft"] is None else round(r["soft"], 9) for r in rows if r["source"] == source}
        assert soft == {round(sum(own) / len(own), 9) if own else None}


def test_votes_score_every_item(spark, sf):
    from concord.operators import votes as vt
    votes = fx.votes(spark, sf)
    items = votes.select("item").union(spark.createDataFrame([("unvoted",)], "item string"))
    n = items.distinct().count()
    for scored in (vt.vote_weighted(votes, vt.linear_weights(votes), items), vt.dawid_skene(votes, max_iter=2, items=items)[0],
                   vt.fit_latent_multi(votes, rounds=1, items=items)[0]):
        got = {r["item"]: r["score"] for r in scored.collect()}
        assert len(got) == n and got["unvoted"] == 0.5 and all(0 <= s <= 1 for s in got.values())


@pytest.mark.parametrize("name", ["l4", "l5", "l6"])
def test_registered_latent_fits_run_all_rounds(monkeypatch, name):
    from concord.plans import model_queries, table_queries

    class Seen(Exception):
        pass

    def fit(*args, **settings):
        raise Seen(settings)

    for step in ("evidence", "_leak_free", "test_items"):
        monkeypatch.setattr(model_queries, step, lambda *args: None)
    monkeypatch.setattr(table_queries, "_scratch", lambda spark: "")
    monkeypatch.setattr(model_queries.latent, "fit_latent", fit)
    with pytest.raises(Seen) as seen:
        getattr(model_queries, name)(None, None)
    assert not {"rounds", "epochs"} & set(seen.value.args[0])


def test_items_with_starts_of_their_own_are_merged_and_scored_as_before(spark, monkeypatch):
    rows = [(v, f"i{i}", [1.0, 0.0, None][i % 3], [0.0, 1.0][i % 2] if i % 5 else None, i % 4 // 2, 0.25 * (i % 4 // 2))
            for v in ("full", "start_1", "start_2") for i in range(240)]
    known = spark.createDataFrame(rows, "variant string, item string, ya double, yb double, n long, sv double")
    spread = spark.createDataFrame([(v, 0.04) for v in ("full", "start_1", "start_2")], "variant string, variance double")
    step, sizes = latent._score_step, []

    def counted(patterns, history):
        sizes.append((patterns.count(), len(history)))
        return step(patterns, history)

    monkeypatch.setattr(latent, "_score_step", counted)
    fit = lambda: latent.fit_items(known, spread, rounds=6, epochs=10, starts={"start_1": 1, "start_2": 2})
    got = {(r.variant, r.item): (r.mu, r.sigma) for r in fit().items.collect()}
    # Single items are looked at once per round, and no longer than they differ.
    assert all(again == 1 for n, again in sizes if n >= 480) and sizes[0][0] > 480 and sizes[-1][0] < 240
    monkeypatch.setattr(latent, "MERGE_AFTER", 99)
    monkeypatch.setattr(latent, "BROADCAST_PATTERNS", 0)
    want = {(r.variant, r.item): (r.mu, r.sigma) for r in fit().items.collect()}
    assert got.keys() == want.keys() and len(got) == len(rows)
    assert all(abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], want[k]))
    starts = {k[1]: v for k, v in got.items() if k[0] == "start_1"}
    assert len({round(v[0], 6) for v in starts.values()}) > 3
