"""Replicates in several passes: the same rows with less disk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord import fixtures as fx
from concord.operators import rank_replicates as rr, replicates as rp, resample as rs
from concord.session import FREED, cut_lineage

PAIRS = [("A", "B"), ("B", "C")]


def shuffle_files(spark) -> int:
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()


def test_stored_steps_leave_no_shuffle_files(spark):
    step = lambda seed: cut_lineage(spark.range(1000).groupBy((F.col("id") * seed % 97).alias("k")).count())
    before, was = shuffle_files(spark), spark.conf.get(FREED, None)
    made = step(5)
    assert shuffle_files(spark) <= before and spark.conf.get(FREED, None) == was
    assert made.agg(F.sum("count")).first()[0] == 1000


def test_passes_cover_all_chunks_once():
    assert rp.passes(0, 16, 1) == [range(16)]
    assert rp.passes(3, 16, rp.PASS_BYTES // 4) == [range(3, 7), range(7, 11), range(11, 15), range(15, 16)]
    assert rp.passes(0, 3, 10 * rp.PASS_BYTES) == [range(1), range(1, 2), range(2, 3)]


@pytest.mark.parametrize("name,by", [("bootstrap", ["view"]), ("permutation", ["view"]), ("blocks", ["view"]), ("clusters", ["view"]), ("clusters", [])])
def test_many_passes_give_the_rows_of_one(spark, sf, monkeypatch, name, by):
    wide = cut_lineage(fx.wide_predictions(spark, sf))
    arrays = wide.select("view", "item_id", "gold", *[F.array(F.col(a), F.col(a) / 2).alias(a) for a in "AB"])
    pairs = wide.select("view", (F.col("item_id") % 50).alias("cluster"), "A", "B", F.lit(1).alias("copies"))
    make = {
        "bootstrap": lambda: rs.replicate_metrics(wide, "item_id", ["A", "B"], 130, 3, by, redraw=False),
        "permutation": lambda: rs.paired_permutation(wide, "item_id", PAIRS, 130, 3, by),
        "blocks": lambda: rp.block_replicates(rs.indexed(arrays, ["item_id"], by, 3), ["A", "B"], 8, 3, by),
        "clusters": lambda: rr.cluster_replicates(pairs, pairs.select(*by, "cluster").distinct(), "cluster", "A", "B", 130, 3, by),
    }[name]
    made, real = [], rp.cut_lineage
    monkeypatch.setattr(rp, "cut_lineage", lambda df: made.append(1) or real(df))

    def rows():
        made.clear()
        return sorted(tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r) for r in make().collect())

    one, few = rows(), len(made)
    monkeypatch.setattr(rp, "PASS_BYTES", 1)
    assert rows() == one
    # Each of two passes is stored on its own.
    assert len(made) >= few + 2


def test_cut_ranges_travel_packed(spark):
    """Parts of a cut range get the weight of each value in a few bits; a range that is a little too long is not cut."""
    rows = spark.range(400).selectExpr("0 g", "cast(id as double) a", "cast(id % 7 as double) b", "id cluster", "1L copies")
    assert {r[0] for r in rr._placed(rows, "cluster", "a", "b", ["g"], 150).select("_sa_n").collect()} == {1}
    long = spark.range(64).selectExpr("0 g", "0 chunk", "0L rng", "cast(id % 2 as int) salt", "2 salt_n", "cast(id as double) a",
                                      "cast(id as double) b", "1L copies").withColumn("w", F.lit(bytearray(rp.pack_weights(np.ones((1, 125), np.int64)))))
    found = rr._ranks(long, ["g"], 125, "a", "rng", "salt").toPandas()
    assert len(found) == 2 and all(len(s) == 1 + 64 * 16 for s in found["sums"])
    ranks = rr._looked_up(np.array([3.0, 10.0]), np.ones((2, 125), np.int64), found.iloc[:1], 125)
    assert ranks.tolist() == [[8] * 125, [22] * 125]
