"""Edge cases on small literal tables, and exact arithmetic."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from concord.functions import columns as c, keys
from concord.functions.tails import student_t_p, t_multiplier_95
from concord.operators import audit, joins, metrics as mt, ranking, resample as rs, splits

OBS = "ck string, fk string, ord int, label int"


def exact_sign_p(a, b):
    n, lo = a + b, min(a, b)
    if n == 0:
        return 1.0
    term, total = 1, 0
    for k in range(lo + 1):
        total += term
        term = term * (n - k) // (k + 1)
    return float(min(Fraction(1), Fraction(2 * total, 2**n)))


def test_sign_test_is_exact(spark):
    pairs = [(0, 0), (0, 1), (1, 0), (0, 30), (12, 46), (5, 5), (1, 1), (100, 140), (3000, 3100), (0, 800), (20, 21), (2933, 2920)]
    rows = spark.createDataFrame(pairs, "a bigint, b bigint").withColumn("p", audit.sign_test("a", "b")).collect()
    for r in rows:
        assert r["p"] == pytest.approx(exact_sign_p(r["a"], r["b"]), rel=1e-9, abs=1e-300)


def test_sign_test_survives_huge_counts(spark):
    df = spark.createDataFrame([(5_000_000_000, 5_000_100_000)], "a bigint, b bigint")
    z = 100_000 / math.sqrt(10_000_100_000)
    assert df.select(audit.sign_test("a", "b")).first()[0] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-4)


def test_t_tail_and_quantile(spark):
    df = spark.createDataFrame([(12.706204736, 1), (2.776445105, 4), (2.0, 10), (1.983971519, 100)], "t double, df int")
    got = [r[0] for r in df.select(student_t_p("t", "df")).collect()]
    assert got == pytest.approx([0.05, 0.05, 0.07338803, 0.05], rel=1e-6)
    q = spark.range(1, 3).select(t_multiplier_95(F.when(F.col("id") == 1, 11).otherwise(100))).collect()
    assert [r[0] for r in q] == pytest.approx([2.200985160, 1.983971519], rel=1e-8)


def test_empty_overlap_gives_p_one(spark):
    a = spark.createDataFrame([("x", "x|0", 1, 1)], OBS)
    b = spark.createDataFrame([("y", "y|0", 1, 0)], OBS)
    rows = audit.conflict_audit(a, b, {"coarse": "ck", "fine": "fk"}).collect()
    assert len(rows) == 8
    assert all(r["p"] == 1.0 and r["total_overlap"] == 0 and r["rho"] is None for r in rows)


def test_null_keys_and_ties(spark):
    a = spark.createDataFrame([(None, "n|0", 1, 1), ("x", "x|0", 2, 0), ("x", "x|0", 1, 1)], OBS)
    s = audit.label_summary(a, ["ck"]).collect()
    assert len(s) == 1
    assert (s[0]["first"], s[0]["majority"], s[0]["conflict"]) == (1, None, True)


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([("v", 1, 0.2), ("v", 1, 0.4)], "view string, gold int, pred double")
    r = mt.stratified_metrics(df, {"view": F.col("view")}, min_n=1).first()
    assert r["auc"] is None and r["reason"] is not None


def test_auc_ties_by_hand(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "gold int, pred double")
    r = mt.auc_ap(df).first()
    assert r["auc"] == pytest.approx(0.875)
    assert r["ap"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_permutation_of_an_arm_against_itself(spark):
    df = spark.range(40).select(
        F.col("id").alias("item_id"), (F.col("id") % 2).cast("int").alias("gold"), (F.col("id") / 40).alias("A"), (F.col("id") / 40).alias("B"))
    for sampler in ("md5", "random"):
        r = rs.paired_permutation(df, "item_id", [("A", "B")], 32, 1, sampler=sampler).first()
        assert r["auc_p"] == 1.0 and r["ap_p"] == 1.0 and r["auc_diff"] == pytest.approx(0)


def test_censored_and_labels(spark):
    df = spark.createDataFrame([(">10",), (" 7.5",), ("n/a",), (None,)], "t string")
    v, flag = c.parse_censored("t")
    assert [tuple(r) for r in df.select(v, flag).collect()] == [(10.0, True), (7.5, False), (None, False), (None, None)]
    df = spark.createDataFrame([("1",), ("0.0",), ("2",), ("",)], "t string")
    assert [r[0] for r in df.select(c.parse_label("t")).collect()] == [1.0, 0.0, None, None]


def test_one_value_shared_by_most_rows_keeps_ranks_whole(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.col("id") / 3000.0).otherwise(0.5).alias("u"))
    rows = ranking.ordered_running(df, "u", ["id"]).select("u", "rank", "n").collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 3001))
    assert all(a["u"] <= b["u"] for a, b in zip(*(lambda s: (s, s[1:]))(sorted(rows, key=lambda r: r["rank"]))))


def test_partition_count_does_not_matter(spark, sf):
    from concord import fixtures as fx

    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "4", "32"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            digest = splits.split_digest(splits.holdout(fx.obs_b(spark, sf), "ck", 0.15, 42), ["ck", "held_out"]).first()["digest"]
            boot = rs.paired_bootstrap(fx.wide_predictions(spark, sf), "item_id", fx.ARMS, 50, 7, ["view"])
            rows = tuple(sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in boot.collect()))
            seen.add((digest, rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_hot_coarse_key_counts_everything(spark):
    rows = [("hot", f"h|{i % 7}", i, i % 2) for i in range(900)] + [(f"k{i}", f"k{i}|0", 0, i % 2) for i in range(300)]
    a = spark.createDataFrame(rows, OBS)
    b = spark.createDataFrame([(k, f, o, 1 - l) for k, f, o, l in rows], OBS)
    r = audit.conflict_audit(a, b, {"coarse": "ck"}).where("mode = 'first' AND filter = 'all'").first()
    assert r["total_overlap"] == 301 and r["discordant"] == 301


def test_many_to_one_fails_on_a_repeated_key(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1, "a"), (3, "b"), (3, "c")], "k int, v string")
    assert joins.join_many_to_one(left, right, "k").where("v = 'a' AND right_rows = 1").count() == 1
    with pytest.raises(Exception, match="more than one right row for key 3"):
        joins.join_many_to_one(left.union(spark.createDataFrame([(3,)], "k int")), right, "k").collect()
    assert joins.join_many_to_one(left.union(spark.createDataFrame([(3,)], "k int")), right, "k", "first").count() == 4


def test_failed_user_keys_say_why(spark):
    got = keys.identity_keys_with(spark.createDataFrame([("a b",), ("",)], "text string"), "text", lambda t: (t, t.split()[0]))
    assert {r["text"]: (r["coarse_key"], r["key_error"]) for r in got.collect()} == {"a b": ("a", None), "": (None, "IndexError")}
