"""Operators that carry sums and ranks across ranges, against their plain forms."""

import math
import re
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord import fixtures as fx
from concord.operators import audit, contracts, metrics as mt, rank_replicates as rr, ranking, replicates as rp, resample as rs
from concord.session import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def measured(spark, n, hot):
    draw = random.Random(n)
    rows = []
    for i in range(n):
        a = 0.5 if hot and i % 3 else round(draw.random(), 3)
        rows.append((i % 2, f"c{0 if hot and i % 4 == 0 else draw.randrange(n // 4)}", a, round(a + draw.gauss(0, 0.3), 2), 1 + i % 3))
    return spark.createDataFrame(rows, "g int, cluster string, a double, b double, copies long")


@pytest.mark.parametrize("hot,size", [(False, 8192), (False, 30), (True, 25)])
def test_rank_replicates_equal_weighted_concordance(spark, hot, size):
    """Fed the weights of md5 draws, packed sums and ranks equal those of one row per draw."""
    reps, df = 130, measured(spark, 240, hot)
    clusters = df.select("g", "cluster").distinct()
    idx = rs.indexed(clusters, ["cluster"], ["g"], 5)
    drawn = rs.draws(idx.select("g", "idx", "n"), reps, 5, ["g"])
    weights = rr.counted_weights(drawn, "idx", reps, ["g"]).join(idx.drop("n"), ["g", "idx"]).drop("idx")
    got = {(r.g, r.rep): r for r in rr.concordance_replicates(df, weights, "cluster", "a", "b", reps, ["g"], size).collect()}
    long = drawn.join(idx.drop("n"), ["g", "idx"]).join(df, ["g", "cluster"]).groupBy("g", "rep", "a", "b").agg(F.sum("copies").alias("w"))
    want = mt.concordance(long, "a", "b", ["g", "rep"], "w").collect()
    assert len(want) == 2 * reps == len(got)
    for r in want:
        for m in ("n", "pearson", "spearman", "mae", "bias"):
            assert got[r.g, r.rep][m] == pytest.approx(r[m], abs=1e-9), m


def test_cluster_weights_draw_as_many_as_there_are(spark):
    clusters = spark.range(9000).select((F.col("id") % 3).alias("g"), F.col("id").alias("cluster"))
    rows = rr.cluster_weights(clusters, "cluster", 130, 7, ["g"]).where("chunk = 1").collect()
    total = {g: np.zeros(5, np.int64) for g in range(3)}
    for r in rows:
        total[r.g] += rr.unpack_weights(bytes(r.w), 5)[0].astype(np.int64)
    assert len(rows) == 9000 and all((t == 3000).all() for t in total.values())
    again = rr.cluster_weights(clusters.repartition(7), "cluster", 130, 7, ["g"]).where("chunk = 1").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_block_shares_are_a_multinomial_sample(spark):
    rows = spark.range(5000).select(F.col("id").alias("item"), (1 + F.col("id") % 4).alias("c"))
    spread, blocks = rp.hash_blocks(rows, ["item"], (), 100, "c")
    found = blocks.collect()
    sizes = {r._blk: r.c for r in spread.groupBy("_blk").agg(F.sum("c").alias("c")).collect()}
    assert len(found) == len(sizes) > 32 and {r.total for r in found} == {12500}
    share = {r._blk: rp.block_share(r._blk, r.depth, r.total, r.left, r.right, 400, 3, (), 0) for r in found}
    assert (sum(share.values()) == 12500).all()
    for b, s in share.items():
        assert s.mean() == pytest.approx(sizes[b], abs=5 * math.sqrt(sizes[b] / 400))


@pytest.mark.parametrize("top", [0, 1, 9, 200, 40000])
def test_weights_are_packed_and_unpacked(top):
    w = np.random.default_rng(top).integers(0, top + 1, (7, 13))
    assert (rp.unpack_weights(rp.pack_weights(w), 13) == w).all()
    assert (rr._matrix(rr._rows_of(w) + rr._rows_of(w % 2), 13) == np.r_[w, w % 2]).all()


def test_mixed_swaps_leave_out_replicates_that_agree(spark):
    tiny = spark.createDataFrame([(0, i, i % 2, 0.1 * i, 0.3) for i in range(2)], "g int, item int, gold int, A double, B double")
    kept = {r.rep for r in rp.mixed_swaps(tiny, "item", ["A", "B"], 200, 1, ["g"]).collect()}
    assert 0 not in kept and 60 < len(kept) < 140
    out = rs.paired_permutation(tiny, "item", [("A", "B")], 200, 1, ["g"], skip_degenerate=True).first()
    assert out.n_perm == len(kept)


def plain_counts(p):
    mass = np.ones(1)
    for x in p:
        mass = np.convolve(mass, [1 - x, x])
    return np.cumsum(mass)


def test_distribution_of_a_prevalence(spark):
    draw = random.Random(4)
    groups = {"wide": [draw.random() for _ in range(300)], "sure": [0.0, 1.0, 1.0, 0.0], "rare": [0.001] * 200, "one": [0.3], "near": [0.999] * 50 + [1.0] * 5}
    rows = [(g, p, int(draw.random() < p)) for g, ps in groups.items() for p in ps]
    rows += [("wide", None, 1), ("wide", 1.5, 1), ("wide", float("nan"), 1), ("wide", 0.5, None)]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    for r in rs.prevalence_distribution(df, "p", "y", ["g"]).collect():
        total, n = plain_counts(groups[r.g]), len(groups[r.g])
        assert r.n == n and r.expected == pytest.approx(np.mean(groups[r.g]))
        assert round(r.low * n) == int(np.searchsorted(total, 0.025 - 1e-12)), r.g
        assert round(r.high * n) == int(np.searchsorted(total, 0.975 - 1e-12)), r.g
        assert r.p_low == pytest.approx(total[round(r.observed * n)], abs=1e-9)
    assert rs.prevalence_distribution(df.limit(0), "p", "y").count() == 0


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_digest_trees_find_what_changed(spark, monkeypatch, levels):
    monkeypatch.setattr(contracts, "LEVEL_DIGITS", 1)
    a = spark.range(400).select(F.col("id").cast("string").alias("t"))
    b = spark.range(3, 405).select(F.col("id").cast("string").alias("t")).repartition(3)
    assert contracts.digest_tree(a, "t", (), levels).where("level = 0").collect() == contracts.digest_tree(a.repartition(5), "t", (), levels).where("level = 0").collect()
    tree = contracts.digest_tree(a, "t", (), levels)
    assert {r.n for r in tree.groupBy("level").agg(F.sum("n").alias("n")).collect()} == {400} and tree.count() == sum(
        r.c for r in a.select(F.explode(F.array(*[F.struct(F.lit(k), F.substring(F.sha2("t", 256), 1, k)) for k in range(levels + 1)])).alias("x")).distinct().groupBy().agg(F.count("*").alias("c")).collect())
    monkeypatch.setattr(contracts, "digest_levels", lambda df, by=(): levels)
    got = {tuple(r) for r in contracts.changed_texts(a, b, "t").collect()}
    assert got == {(str(i), True, False) for i in range(3)} | {(str(i), False, True) for i in range(400, 405)}
    assert contracts.changed_texts(a, a.repartition(2), "t").count() == 0


def test_digest_depth_follows_the_count(spark, monkeypatch):
    monkeypatch.setattr(contracts, "LEAF_TEXTS", 2)
    monkeypatch.setattr(contracts, "LEVEL_DIGITS", 1)
    assert [contracts.digest_levels(spark.range(n)) for n in (0, 32, 33, 512, 513)] == [1, 1, 2, 2, 3]


def test_large_families_equal_small_ones(spark):
    draw = random.Random(6)
    rows = [(g, i, 1.0 if i % 5 == 0 else draw.choice((round(draw.random(), 2), draw.random() ** 6))) for g in "xy" for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, p double")
    for large, small, out in ((audit.bh_adjust_large, audit.bh_adjust, "q"), (audit.holm_adjust_large, audit.holm_adjust, "p_holm")):
        got = {(r.g, r.i): r[out] for r in large(df, "p", ["g"]).collect()}
        want = {(r.g, r.i): r[out] for r in small(df, "p", ["g"], ["i"]).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    missing = df.union(spark.createDataFrame([("x", 999, None)], df.schema))
    assert audit.bh_adjust_large(missing, "p", ["g"]).where("i = 999").first().q is None


def test_hash_ranks_do_not_depend_on_the_bucket_depth(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 2).alias("g"))
    want = sorted(map(tuple, ranking.hash_rank(df, ["id"], 3, ["g"]).collect()))
    spans = ranking.with_hash_bucket.__defaults__
    ranking.with_hash_bucket.__defaults__ = ((), 4)
    try:
        deep = ranking.with_hash_bucket(df.withColumn("h", F.md5(F.col("id").cast("string"))), "h", ["g"])
        assert deep.select("_bucket").distinct().count() > 200
        assert sorted(map(tuple, ranking.hash_rank(df, ["id"], 3, ["g"]).collect())) == want
    finally:
        ranking.with_hash_bucket.__defaults__ = spans
    assert [r[-2] for r in sorted(want, key=lambda r: (r[1], r[-2]))] == [*range(1, 1501)] * 2


def test_seeded_holdout_deals_no_rows_by_seed_alone(spark):
    from concord.operators import splits

    df = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    made = splits.seeded_holdout(df, "k", 0.15, [1, 2, 3])
    assert not re.findall(r"Join \[seed#\d+\]", made._jdf.queryExecution().executedPlan().toString())
    assert {r.seed: (r.n, r.s) for r in made.groupBy("seed").agg(F.count("*").alias("n"), F.sum("held_out").alias("s")).collect()} == {
        s: (3000, 450) for s in (1, 2, 3)}


def test_tiered_match_reads_each_side_once(spark):
    """Keys cost as much as reading the texts, so tiers share one pass; null ids and keys of any type match as in a join."""
    from concord.operators import joins

    left = spark.createDataFrame([(1, "a", 1.0), (2, "b", -0.0), (3, None, 2.0), (4, "a", None)], "id int, k string, x double")
    right = spark.createDataFrame([(7, "a", 2.0), (8, "c", 0.0), (9, "a", 1.0), (None, "d", 5.0)], "id int, k string, x double")
    found = joins.tiered_match(left, right, {"name": "k", "number": "x"}, "id", "id")
    assert sorted(found.collect()) == [(1, 7, "name"), (2, 8, "number"), (3, 7, "number")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2


def test_items_of_one_pattern_are_not_dealt_to_one_task(spark):
    """Most items may share a pattern of evidence: scores are joined by broadcast, and rows per item and variant are not stored."""
    from pyspark.sql import functions as F

    from concord.operators import latent

    rows = [(f"i{i}", "b", 0, 1.0 if i % 40 else 0.0) for i in range(400)]
    evidence = spark.createDataFrame(rows, "item string, channel string, ord int, value double")
    items = latent.item_evidence(evidence)
    known, spread = latent.read_variants(items, {"x": latent.variant(), "no_b": latent.variant(yb=F.lit(None).cast("double"))})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fit = latent.fit_items(known, spread, rounds=2)
        plan = fit.items._jdf.queryExecution().executedPlan().toString()
        got = fit.items.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    # The variant without any evidence has no rows and no parameters.
    assert len(got) == 400 and {r.variant for r in got} == {"x"} and len({r.mu for r in got}) == 2
    assert [r.variant for r in fit.params.collect()] == ["x"]


def test_seeded_items_are_dealt_out_and_curves_agree(spark, tmp_path):
    rows = [(i % 7, None if i % 50 == 0 else i % 400, ("purchase", "view")[i % 2], i % 13 / 3.0, '{"k": %d}' % (i % 99)) for i in range(500)]
    schema = "user_id long, event_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    long = fx.seeded_predictions(spark, str(tmp_path), 3)
    # One small file is one task, whatever its rows become.
    places = long.select("view", F.spark_partition_id().alias("p")).distinct().groupBy().agg(F.count_distinct("p")).first()[0]
    assert places > 1 and long.count() == 500 * 3 * 3
    by = ["view", "arm", "seed"]
    few = {tuple(r) for r in mt.auc_ap(long, by=by, few=True).select(*by, F.round("auc", 9), F.round("ap", 9)).collect()}
    assert few == {tuple(r) for r in mt.auc_ap(long, by=by).select(*by, F.round("auc", 9), F.round("ap", 9)).collect()}
    assert len(few) == 27
