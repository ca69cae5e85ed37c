"""Boosted trees on bits against trees grown one node at a time, in every way rows may be dealt out."""

import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from concord.functions import keys
from concord.operators import boost, learn
from concord.session import ship

N_BITS = 40


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def table(n, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        own = sorted(b for b in range(N_BITS) if draw.random() < (0.5 if b < 6 else 0.1))
        hard = float((0 in own) ^ (1 in own) if draw.random() < 0.9 else draw.random() < 0.5)
        rows.append((i, own, hard, None if i % 11 == 0 else 0.3 * (2 in own) + 0.5 * hard, i % 3))
    return rows


SCHEMA = "item long, positions array<int>, hard double, soft double, fold int"


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return keys.packed_bits(df, F.col("positions"), N_BITS)


def plain_trees(spark, rows, label, settings, left_out=None):
    """Trees grown node by node from their definition; returns the margin of every row."""
    h = {r.item: r.h for r in spark.createDataFrame([(r[0],) for r in rows], "item long").select(
        "item", F.xxhash64("item").alias("h")).collect()}
    x = np.zeros((len(rows), N_BITS), bool)
    for i, r in enumerate(rows):
        x[i, r[1]] = True
    y = np.array([np.nan if r[label] is None else r[label] for r in rows], float)
    member = ~np.isnan(y) & np.array([left_out is None or r[4] != left_out for r in rows])
    base = y[member].mean()
    if settings.loss == "logistic":
        base = np.log(base / (1 - base))
    margin = np.full(len(rows), base)
    hashes = np.array([h[r[0]] for r in rows], np.int64).view(np.uint64)
    for t in range(settings.trees):
        kept = member & (boost._drawn(hashes, settings.seed, t) < settings.row_share)
        allowed = boost.chosen_bits(N_BITS, settings, t)
        if settings.loss == "squared":
            g, c = margin - y, np.ones(len(rows))
        else:
            p = 1 / (1 + np.exp(-margin))
            g, c = p - y, p * (1 - p)

        def grow(inside, depth):
            own = inside & kept
            value = -settings.rate * g[own].sum() / (c[own].sum() + settings.ridge)
            best = (1e-6, None)
            if depth < settings.depth:
                for b in np.flatnonzero(allowed):
                    part = [own & ~x[:, b], own & x[:, b]]
                    if min(c[s].sum() for s in part) >= settings.least:
                        gain = sum(g[s].sum() ** 2 / (c[s].sum() + settings.ridge) for s in part)
                        gain -= g[own].sum() ** 2 / (c[own].sum() + settings.ridge)
                        if gain > best[0] + 1e-7:
                            best = (gain, b)
            if best[1] is None:
                margin_step[inside] = value
                return
            grow(inside & ~x[:, best[1]], depth + 1)
            grow(inside & x[:, best[1]], depth + 1)

        margin_step = np.zeros(len(rows))
        grow(np.ones(len(rows), bool), 0)
        margin = margin + margin_step
    return margin


@pytest.mark.parametrize("settings", [
    boost.Settings(trees=4, depth=3, rate=0.3, row_share=1.0, bit_share=1.0),
    boost.Settings(trees=13, depth=2, rate=0.2, row_share=0.7, bit_share=0.6, seed=5),
    boost.Settings(trees=5, depth=3, rate=0.3, row_share=0.8, bit_share=0.8, loss="logistic"),
])
def test_trees_equal_plain_ones(spark, settings):
    rows = table(150, 1)
    arms = {"hard": "hard"} if settings.loss == "logistic" else {"hard": "hard", "soft": "soft"}
    df = frame(spark, rows)
    model = boost.fit(df, "item", "bits", arms, N_BITS, settings=settings)
    got = {(r.arm, r.item): r.pred for r in boost.predict(df, "item", "bits", model).collect()}
    for arm, label in (("hard", 2), ("soft", 3))[:len(arms)]:
        margin = plain_trees(spark, rows, label, settings)
        want = margin if settings.loss == "squared" else 1 / (1 + np.exp(-margin))
        assert np.allclose([got[arm, r[0]] for r in rows], want, atol=1e-6)
    made = boost.nodes(spark, model)
    assert made.where("node = 0").count() == settings.trees * len(arms) and made.where("bit >= 0 AND gain <= 0").count() == 0


def test_folds_grow_together_and_never_see_their_own(spark):
    rows = table(160, 2)
    settings = boost.Settings(trees=4, depth=2, rate=0.3, loss="logistic")
    df = frame(spark, rows)
    model = boost.fit(df, "item", "bits", {"hard": "hard"}, N_BITS, "fold", 3, settings)
    got = {r.item: r.pred for r in boost.predict(df, "item", "bits", model, "fold").collect()}
    assert len(got) == len(rows)
    for left_out in range(3):
        margin = plain_trees(spark, rows, 2, settings, left_out)
        mine = [i for i, r in enumerate(rows) if r[4] == left_out]
        assert np.allclose([got[rows[i][0]] for i in mine], 1 / (1 + np.exp(-margin[mine])), atol=1e-6)


def test_a_model_does_not_depend_on_tasks_or_on_who_adds_up(spark, monkeypatch):
    rows = table(300, 3)
    settings = boost.Settings(trees=3, depth=3, rate=0.3)
    arms = {"hard": "hard", "soft": "soft"}
    one = boost.fit(frame(spark, rows), "item", "bits", arms, N_BITS, settings=settings)
    monkeypatch.setattr(boost, "TASK_ROWS", 20)
    monkeypatch.setattr(boost, "GATHER_BYTES", 0)
    monkeypatch.setattr(boost, "BIT_BLOCK", 16)
    monkeypatch.setattr(boost, "STEP_ROWS", 7)
    monkeypatch.setattr(boost, "KEEP", 1)
    two = boost.fit(frame(spark, rows[::-1]).repartition(5), "item", "bits", arms, N_BITS, settings=settings)
    assert (one.bit == two.bit).all() and (one.value == two.value).all() and (one.base == two.base).all()


def test_no_labels_one_class_and_missing_bits(spark):
    settings = boost.Settings(trees=2, depth=2)
    rows = [(1, [0], 1.0, None, 0), (2, [1], 1.0, None, 0), (3, None, 1.0, None, 0), (4, [], 1.0, None, 0)]
    df = frame(spark, rows)
    model = boost.fit(df, "item", "bits", {"hard": "hard", "soft": "soft"}, N_BITS, settings=settings)
    got = {(r.arm, r.item): r.pred for r in boost.predict(df, "item", "bits", model).collect()}
    assert len(got) == 8 and all(p == (1.0 if arm == "hard" else 0.0) for (arm, _), p in got.items())
    assert boost.fit(df.limit(0), "item", "bits", {"hard": "hard"}, N_BITS, settings=settings).grown == 2


def test_bits_of_texts_and_vectors(spark):
    df = spark.createDataFrame([(1, "Abcde  fg"), (2, ""), (3, None), (4, "ab")], "i long, t string")
    unfold = lambda b: [i for i, x in enumerate(np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")) if x]
    got = {r.i: unfold(r.bits) for r in keys.hashed_bits(df, "t", 64).collect()}
    want = {r.i: r.p for r in df.select("i", keys.bit_positions(F.col("t"), 64).alias("p")).collect()}
    assert got[1] == want[1] and len(got[1]) >= 4 and len(got[4]) == 1 and got[3] == []
    vec = spark.createDataFrame([(1, Vectors.sparse(20, [3, 17], [1.0, 2.0])), (2, Vectors.dense([0.0] * 5 + [1.0] + [0.0] * 14)),
                                 (3, Vectors.sparse(20, [2, 4], [0.0, 1.0]))], ["i", "v"])
    assert {r.i: unfold(r.bits) for r in keys.vector_bits(vec, "v", 20).collect()} == {1: [3, 17], 2: [5], 3: [4]}


def test_pooled_family_of_arm_comparisons(spark, sf):
    from concord import fixtures as fx

    wide = fx.wide_predictions(spark, sf)
    rows = learn.compare_arms(wide, "item_id", [("A", "B"), ("A", "C"), ("B", "C")], 40, 3, ["view"]).collect()
    assert len(rows) == 18 and all(r.low <= r.median <= r.high and r.p <= r.q + 1e-12 and r.q <= 1 for r in rows)
    order = sorted(rows, key=lambda r: r.p)
    want, low = {}, 1.0
    for k in range(len(order), 0, -1):
        low = min(low, order[k - 1].p * len(order) / k)
        want[id(order[k - 1])] = low
    assert all(abs(want[id(r)] - r.q) < 1e-9 for r in order)


def test_only_the_lighter_child_is_summed(spark, monkeypatch):
    asked, sums = [], boost._level_sums
    monkeypatch.setattr(boost, "_level_sums", lambda *a: asked.append((a[5], len(a[6]))) or sums(*a))
    model = boost.fit(frame(spark, table(300, 4)), "item", "bits", {"hard": "hard", "soft": "soft"}, N_BITS,
                      settings=boost.Settings(trees=2, depth=3, rate=0.3))
    assert (model.bit[:, :, 0] >= 0).all() and asked[0] == (0, 2)
    assert all(n <= 2 << max(level - 1, 0) for level, n in asked) and len(asked) == 6


def test_places_of_shingles_are_looked_up_once_per_task(spark, monkeypatch):
    import hashlib

    texts = [None, "", "  ", "ab", "abcd", "A\n\nb\tc  d", "\U0001f600" * 5, "a\U0001f600", "\u65e5\u672c\u8a9e\u30c6\u30ad", "x" * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    tidy = {r.i: r.t for r in df.select("i", F.lower(F.regexp_replace(F.trim("t"), "[ \\t\\n\\r\\f]+", " ")).alias("t")).collect()}
    shingles = {i: set() if t is None else {t[j:j + 4] for j in range(max(len(t) - 3, 1))} for i, t in tidy.items()}
    rows = df.select("i", keys.bit_positions(F.col("t"), 64).alias("p"))
    assert "lambda" not in rows._jdf.queryExecution().toString()
    place = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16) % 64
    assert {r.i: r.p for r in rows.collect()} == {i: sorted({place(x) for x in s}) for i, s in shingles.items()}
    # A task that may keep no more than two places still finds all.
    monkeypatch.setattr(keys, "REMEMBERED", 2)
    held = keys._Places(64)
    assert [held[s] for s in ("a", "b", "c", "a")] == [place(s) for s in ("a", "b", "c", "a")] and len(held) <= 2


def test_features_are_those_of_all_shingles(spark):
    from pyspark.ml.feature import HashingTF

    texts = [None, "", "ab", "abcd", "A\n\nb\tc  d", "\U0001f600" * 5 + "x", "a\U0001f600", "xyxyxyxyxy"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    made = keys.hashed_features(df, "t", 256)
    assert "lambda" not in made._jdf.queryExecution().toString()
    tidy = [t and " ".join(t.lower().split()) for t in texts]
    plain = HashingTF(inputCol="s", outputCol="features", numFeatures=256, binary=True).transform(spark.createDataFrame(
        [(i, [None] if t is None else sorted({t[j:j + 4] for j in range(max(len(t) - 3, 1))})) for i, t in enumerate(tidy)], "i long, s array<string>"))
    assert {r.i: r.features for r in made.collect()} == {r.i: r.features for r in plain.collect()}
