"""Draws and flips from md5 as packed weights, and the sums over them, against their plain forms."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.operators import metrics as mt, rank_replicates as rr, replicates as rp, resample as rs
from concord.session import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def scored(spark, n, seed=3):
    draw = random.Random(seed)
    return spark.createDataFrame(
        [(i % 2, i // 2, int(draw.random() < 0.4), round(draw.random(), 2), draw.random()) for i in range(n)],
        "g int, item int, gold int, A double, B double")


def counts_of(rows, reps):
    """(group, arm, rep, score, label) -> weight of packed rows."""
    out = {}
    for r in rows:
        n = min(rp.CHUNK, reps - r.chunk * rp.CHUNK)
        w = rp.unpack_weights(bytes(r.w), n)
        for i, (p, label) in enumerate(zip(np.frombuffer(r.score, "<f8"), np.frombuffer(r.y, np.uint8))):
            for k in np.flatnonzero(w[i]):
                key = (r.g, r.arm, r.chunk * rp.CHUNK + int(k), float(p), int(label))
                out[key] = out.get(key, 0) + int(w[i, k])
    return out


@pytest.mark.parametrize("block,size", [(4096, 16384), (32, 20)])
def test_md5_draws_become_weights(spark, monkeypatch, block, size):
    """Every draw counts once for the row it hits, also where rows fall to several blocks and ranges."""
    monkeypatch.setattr(rp, "HELD_DRAWS", 1000)
    df, reps = scored(spark, 300), 130
    idx = rs.indexed(df, ["item"], ["g"], 9)
    got = counts_of(rp.drawn_weights(idx, ["A", "B"], reps, 9, ["g"], range_rows=size, block=block).collect(), reps)
    long = rs.resample(df, ["item"], reps, 9, ["g"])
    want = {}
    for a in ("A", "B"):
        for r in long.groupBy("g", "rep", a, "gold").count().collect():
            want[r.g, a, r.rep, r[a], r.gold] = r["count"]
    assert got == want


def test_md5_flips_become_weights(spark):
    df, n = scored(spark, 60), 140
    got = counts_of(rp.permutation_weights(df, "item", [("A", "B")], n, 7, ["g"], sampler="md5").collect(), n + 1)
    want = {}
    for r in df.collect():
        for rep in range(n + 1):
            digit = hashlib.md5(f"7:{(rep - 1) // 32}:{r.item}".encode()).hexdigest()[(rep - 1) % 32]
            p = r.B if rep and digit >= "8" else r.A
            key = (r.g, "A|B", rep, p, r.gold)
            want[key] = want.get(key, 0) + 1
    assert got == want


@pytest.mark.parametrize("digits,share", [(1, 0.4), (9, 0.4), (2, 0.0), (2, 1.0)])
def test_sweep_equals_pairs_counted_one_by_one(digits, share):
    rng = np.random.default_rng(5)
    n, reps = 90, 11
    part = rp._Part.__new__(rp._Part)
    part.score, part.y = np.round(rng.random(n), digits), (rng.random(n) < share).astype(np.uint8)
    part.copies = rng.integers(1, 4, n).astype(np.uint32)
    part.w = rng.integers(0, part.copies + 1, (reps, n)).T.astype(np.uint8)
    above = [(rng.integers(0, 9, reps).astype(float), rng.integers(0, 9, reps).astype(float)) for _ in range(2)]
    for side, found in enumerate(rp._sweep(part, reps, above, False)):
        w, (tp, fp) = part.side(side).astype(float), above[side]
        up = part.y == 1
        beats = (part.score[None, ~up] > part.score[up][:, None]) + 0.5 * (part.score[None, ~up] == part.score[up][:, None])
        least = part.score[None, :] >= part.score[up][:, None]
        for k in range(reps):
            pos, neg = w[up, k], w[~up, k]
            run_p, run_n = least[:, up] @ pos + tp[k], least[:, ~up] @ neg + fp[k]
            want = [pos.sum(), neg.sum(), pos @ (beats @ neg + fp[k]), (pos * run_p / np.maximum(run_p + run_n, 1)).sum()]
            assert found[k] == pytest.approx(want, abs=1e-9)


def test_md5_metrics_equal_those_of_drawn_rows(spark):
    df, reps = scored(spark, 240), 12
    long = rs._long_arms(rs.resample(df, ["item"], reps, 4, ["g"]), ["g", "rep"], ["A", "B"], "gold")
    want = {(r.g, r.rep, r.arm): r for r in mt.all_metrics(long, "gold", "pred", ["g", "rep", "arm"]).collect()}
    got = rs.replicate_metrics(df, "item", ["A", "B"], reps, 4, ["g"], redraw=False, sampler="md5").collect()
    assert len(got) == len(want) == 2 * 2 * reps
    for r in got:
        for m in rs.METRICS:
            assert r[m] == pytest.approx(want[r.g, r.rep, r.arm][m], abs=1e-9), m


def test_md5_cluster_draws_become_weights(spark):
    reps = 130
    idx = rs.indexed(spark.range(150).select((F.col("id") % 2).alias("g"), F.col("id").alias("cluster")), ["cluster"], ["g"], 5)
    got = {}
    for r in rr.drawn_cluster_weights(idx, "cluster", reps, 5, ["g"], block=32).collect():
        w = rp.unpack_weights(bytes(r.w), min(rp.CHUNK, reps - r.chunk * rp.CHUNK))[0]
        got.update({(r.g, r.cluster, r.chunk * rp.CHUNK + int(k)): int(w[k]) for k in np.flatnonzero(w)})
    drawn = rs.draws(idx.select("g", "idx", "n"), reps, 5, ["g"]).join(idx.drop("n"), ["g", "idx"])
    assert got == {(r.g, r.cluster, r.rep): r["count"] for r in drawn.groupBy("g", "cluster", "rep").count().collect()}


def test_ranges_in_one_part_send_no_ranks_of_values(spark):
    """A range needs only the weight below it; values travel where a range is cut into parts."""
    rows = spark.range(64).selectExpr("0 g", "cast(id % 2 as int) chunk", "cast(id * 4 div 64 as long) rng", "0 salt", "1 salt_n",
                                      "cast(id as double) a", "cast(id as double) b", "1L copies").withColumn(
        "w", F.lit(bytearray(rp.pack_weights(np.ones((1, 125), np.int64)))))
    found = rr._ranks(rows, ["g"], 250, "a", "rng", "salt").collect()
    assert len(found) == 8 and all(len(r["values"]) == 0 for r in found)
    assert {r.rng: int(np.frombuffer(bytes(r.ranks), "<i8")[7]) for r in found if r.chunk == 0} == {0: 0, 1: 8, 2: 16, 3: 24}


@pytest.mark.parametrize("block,size", [(None, 65536), (16, 10)])
def test_block_weights_are_the_drawn_rows_under_the_drawn_seeds(spark, block, size):
    """Rows drawn in a replicate count with their mean over its seeds, also over several blocks and ranges."""
    draw = random.Random(5)
    rows = [(i % 2, i // 2, draw.randrange(2) if i % 11 else None, [draw.random() for _ in range(3)],
             None if i % 13 == 0 else [draw.random() if i % 7 else None, draw.random(), draw.random()]) for i in range(120)]
    df, reps = spark.createDataFrame(rows, "g int, item int, gold int, A array<double>, B array<double>"), 9
    idx = rs.indexed(df, ["item"], ["g"], 9)
    made = rp.block_weights(idx, ["A", "B"], reps, 9, ["g"], range_rows=size, block=block).collect()
    assert (len({r["_range"] for r in made}) > 2) == (size == 10)
    got = {}
    for r in made:
        for p, label, w in zip(np.frombuffer(r.score, "<f8"), np.frombuffer(r.y, np.uint8), rp.unpack_weights(bytes(r.w), 1)[:, 0]):
            key = (r.g, r.arm, r.chunk, float(p), int(label))
            got[key] = got.get(key, 0) + int(w)
    want = {}
    for r in rs.resample(df, ["item"], reps, 9, ["g"]).collect():
        at = [int(hashlib.md5(f"10:{r.rep}:{j}".encode()).hexdigest()[:8], 16) % 3 for j in range(3)]
        for a in ("A", "B"):
            if r.gold is not None and r[a] is not None and None not in (seen := [r[a][j] for j in at]):
                key = (r.g, a, r.rep, float(np.round(sum(seen) / 3.0, 12)), r.gold)
                want[key] = want.get(key, 0) + 1
    assert got == want


def test_block_bootstrap_agrees_with_its_rows(spark):
    """Intervals of the difference to the baseline, against metrics of the rows drawn."""
    draw = random.Random(6)
    long = [(i % 2, a, s, i // 2, (i * 7) % 5 % 2, draw.random()) for i in range(80) for a in ("A", "B") for s in range(2)]
    got = {(r.g, r.metric): r for r in rs.block_bootstrap(
        spark.createDataFrame(long, "g int, arm string, seed int, item int, gold int, pred double"), "item", "seed", ["A", "B"], "A", 8, 3, ["g"]).collect()}
    wide = {}
    for g, a, s, item, gold, pred in long:
        wide.setdefault((g, item, gold), {}).setdefault(a, {})[s] = pred
    df = spark.createDataFrame([(*k, [v["A"][0], v["A"][1]], [v["B"][0], v["B"][1]]) for k, v in wide.items()],
                               "g int, item int, gold int, A array<double>, B array<double>")
    flat = []
    for r in rs.resample(df, ["item"], 8, 3, ["g"]).collect():
        at = [int(hashlib.md5(f"4:{r.rep}:{j}".encode()).hexdigest()[:8], 16) % 2 for j in range(2)]
        flat += [(r.g, r.rep, a, r.gold, float(np.round((r[a][at[0]] + r[a][at[1]]) / 2.0, 12))) for a in ("A", "B")]
    m = {(r.g, r.rep, r.arm): r for r in mt.all_metrics(
        spark.createDataFrame(flat, "g int, rep int, arm string, gold int, pred double"), by=["g", "rep", "arm"]).collect()}
    for g in (0, 1):
        for metric in ("auc", "ap", "brier", "ece"):
            d = [m[g, r, "B"][metric] - m[g, r, "A"][metric] for r in range(8)]
            one = got[g, metric]
            assert one.n_valid == 8
            assert [one.estimate, one.low, one.high] == pytest.approx([np.mean(d), *np.quantile(d, [0.025, 0.975])], abs=1e-9)
