"""Global ranks and running sums without one task seeing the whole table.

A window without a partition key moves everything to one task. Here rows get a
bucket that rises with the sort key; bucket totals (a bounded table) give each
bucket its offset, and the window runs inside buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from concord.functions.columns import hash_hex


#: Rows (or distinct values) that one bucket is meant to hold.
BUCKET_ROWS = 16384
FIRST_BUCKETS = 4096
SECOND_BITS = 20
SECOND_BUCKETS = 1 << SECOND_BITS


def _squashed(value: Column) -> Column:
    """Any real value, infinite ones too, within -1 and 1 and in the same order.

    Repeated square roots, which never change the order, draw apart what lies
    close to zero on many scales.
    """
    v = value.cast("double")
    size = F.when(F.abs(v) == float("inf"), F.lit(1.0)).otherwise(F.abs(v) / (F.lit(1.0) + F.abs(v)))
    for _ in range(4):
        size = F.sqrt(size)
    return F.signum(v) * size


def _place(low: str, high: str, count: str, most: int, rows: int) -> Column:
    """Bucket of ``_v`` between the smallest and largest value, as many as the count asks for."""
    buckets = F.least(F.ceil(F.col(count) / F.lit(float(rows))), F.lit(most))
    share = (F.col("_v") - F.col(low)) / (F.col(high) - F.col(low))
    inside = F.least(F.floor(share * buckets), buckets - 1)
    return F.when(F.col(high) > F.col(low), F.greatest(inside, F.lit(0))).otherwise(F.lit(0)).cast("long")


def bucket_spans(df: DataFrame, value: str, by: Sequence[str] = (), rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame, int]:
    """Two small tables from which ``with_bucket`` cuts a column of each group into buckets of about ``rows`` rows.

    Buckets follow the data: first the group's own range of values is split,
    then every part of it by its own range, so scores packed into a narrow
    range or around many powers of ten still spread.
    """
    by = list(by)
    ready = df.select(*by, _squashed(F.col(value)).alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    ends = [F.min("_v"), F.max("_v"), F.count(F.lit(1))]
    first = ready.groupBy(*by).agg(*[e.alias(n) for e, n in zip(ends, ("_lo", "_hi", "_n"))])
    if not by:
        first, ready = first.withColumn("_all", F.lit(0)), ready.withColumn("_all", F.lit(0))
    keys = by or ["_all"]
    one = ready.join(first, keys).withColumn("_b1", _place("_lo", "_hi", "_n", FIRST_BUCKETS, rows))
    second = one.groupBy(*keys, "_b1").agg(*[e.alias(n) for e, n in zip(ends, ("_lo2", "_hi2", "_n2"))])
    return first, second, rows


def with_bucket(df: DataFrame, spans: tuple[DataFrame, DataFrame, int], value: str, by: Sequence[str] = (),
                name: str = "_bucket", few: bool = False) -> DataFrame:
    """``df`` with a bucket number that never falls as ``value`` rises; missing values share the highest one.

    With ``few`` groups the tables of buckets, a row for thousands of ``df``, are
    broadcast, so that ``df`` is not shuffled to meet them.
    """
    by = list(by)
    first, second, rows = spans
    if few:
        first, second = F.broadcast(first), F.broadcast(second)
    keys = by or ["_all"]
    ready = df.withColumn("_v", _squashed(F.col(value)))
    ready = ready if by else ready.withColumn("_all", F.lit(0))
    one = ready.join(first, keys, "left").withColumn("_b1", _place("_lo", "_hi", "_n", FIRST_BUCKETS, rows))
    two = one.join(second, [*keys, "_b1"], "left")
    number = F.col("_b1") * SECOND_BUCKETS + _place("_lo2", "_hi2", "_n2", SECOND_BUCKETS, rows)
    missing = F.col("_v").isNull() | F.isnan("_v")
    return two.select(*df.columns, F.when(missing, F.lit(1 << 62)).otherwise(number).alias(name))


def spread_buckets(df: DataFrame, value: str, by: Sequence[str] = (), rows: int = BUCKET_ROWS,
                   few: bool = False) -> DataFrame:
    return with_bucket(df, bucket_spans(df, value, by, rows), value, by, few=few)


def _offsets(totals: DataFrame, by: Sequence[str], sums: Sequence[str], descending: bool) -> DataFrame:
    """Sums before each bucket and over the whole group, in two levels so that no window holds all buckets.

    Buckets that are texts are digits of a hash; those that begin alike stand
    together. Numbered buckets stand together by their leading part.
    """
    text = dict(totals.dtypes)["_bucket"] == "string"
    top = F.substring("_bucket", 1, 3) if text else F.shiftright("_bucket", SECOND_BITS)
    ready = totals.withColumn("_top", top)
    order = lambda c: F.col(c).desc() if descending else F.col(c).asc()
    upper = ready.groupBy(*by, "_top").agg(*[F.sum(c).alias(c) for c in sums])
    before = W.partitionBy(*by).orderBy(order("_top")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    upper = upper.select(
        *by, "_top", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_top_{c}") for c in sums],
        *[F.sum(c).over(whole).alias(f"_all_{c}") for c in sums])
    inside = W.partitionBy(*by, "_top").orderBy(order("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    lower = ready.select(*by, "_top", "_bucket", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{c}") for c in sums])
    return lower.join(upper, [*by, "_top"]).select(
        *by, "_bucket", *[(F.col(f"_top_{c}") + F.col(f"_in_{c}")).alias(f"_before_{c}") for c in sums],
        *[f"_all_{c}" for c in sums])


def running_sums(
    df: DataFrame, order: Sequence[Column], sums: Sequence[str], by: Sequence[str] = (),
    descending: bool = False, few: bool = False,
) -> DataFrame:
    """Add ``cum_<c>`` (up to and with the row) and ``all_<c>`` for each column.

    ``df`` carries ``_bucket``, monotone in the first order column; ``order``
    has its direction already set and must be total within a bucket. With ``few``
    groups the buckets' offsets are broadcast.
    """
    by = list(by)
    totals = df.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(c) for c in sums])
    keys = by + ["_bucket"]
    inner = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = _offsets(totals, by, sums, descending)
    joined = df.join(F.broadcast(offsets) if few else offsets, keys)
    return joined.select(
        *df.columns,
        *[(F.col(f"_before_{c}") + F.sum(c).over(inner)).alias(f"cum_{c}") for c in sums],
        *[F.col(f"_all_{c}").alias(f"all_{c}") for c in sums],
    )


def ordered_running(df: DataFrame, value: str, tie: Sequence[str], sums: Sequence[str] = (),
                    by: Sequence[str] = (), descending: bool = False, rows: int = BUCKET_ROWS) -> DataFrame:
    """Rank rows by ``value`` and add ``rank``, ``n`` and ``cum_<c>`` / ``all_<c>``.

    Equal values are ordered by the md5 of their ``tie`` columns. That order
    splits into even buckets, so even one value shared by most rows never
    lands in a single task: values are summed once per distinct value, rows
    once per hash bucket inside their value.
    """
    by, sums = list(by), ["_one", *sums]
    ready = df.withColumn("_one", F.lit(1))
    per_value = ready.groupBy(*by, value).agg(*[F.sum(c).alias(c) for c in sums])
    per_value = spread_buckets(per_value, value, by, rows)
    first = F.col(value).desc() if descending else F.col(value).asc()
    outer = running_sums(per_value, [first], sums, by, descending).select(
        *by, value,
        *[(F.col(f"cum_{c}") - F.col(c)).alias(f"_base_{c}") for c in sums],
        *[F.col(f"all_{c}").alias(f"_total_{c}") for c in sums],
    )
    hashed = ready.withColumn("_h", hash_hex(0, *tie)).withColumn("_bucket", F.substring("_h", 1, 3))
    inner = running_sums(hashed, [F.col("_h"), *[F.col(t) for t in tie]], sums, [*by, value])
    out = inner.join(outer, [*by, value])
    for c in sums:
        out = out.withColumn(f"cum_{c}", F.col(f"_base_{c}") + F.col(f"cum_{c}")).withColumn(
            f"all_{c}", F.col(f"_total_{c}"))
    kept = [c for c in sums if c != "_one"]
    return out.select(
        *df.columns, F.col("cum__one").alias("rank"), F.col("all__one").alias("n"),
        *[f"cum_{c}" for c in kept], *[f"all_{c}" for c in kept],
    )


def with_hash_bucket(df: DataFrame, hashed: str, by: Sequence[str] = (), rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``_bucket``: as many leading digits of a hash as leave about ``rows`` rows, per group.

    Hashes are even, so every group gets the depth its own count asks for and
    no bucket grows with the table.
    """
    by = list(by)
    one = df if by else df.withColumn("_every", F.lit(0))
    keys = by or ["_every"]
    digits = F.least(F.lit(12), F.greatest(F.lit(1), F.ceil(F.log2(F.count(F.lit(1)) / F.lit(float(rows))) / 4.0))).cast("int")
    # Groups that one bucket holds need no count to tell them so.
    deep = one.groupBy(*keys).agg(digits.alias("_digits"), F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > 16 * rows)
    deep = deep.drop("_rows") if by else F.broadcast(deep.drop("_rows"))  # without groups it is one row
    out = one.join(deep, keys, "left").withColumn("_bucket", F.expr(f"substring({hashed}, 1, coalesce(_digits, 1))"))
    return out.select(*df.columns, "_bucket")


def hash_rank(df: DataFrame, keys: Sequence[str], seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Add ``rank`` (1..n) in a repeatable shuffled order, and ``n``.

    The order is md5 of seed and keys, whose leading digits are even buckets by
    construction; there are as many as the rows ask for.
    """
    ready = df.withColumn("_h", hash_hex(seed, *keys)).withColumn("_one", F.lit(1))
    ready = with_hash_bucket(ready, "_h", by)
    out = running_sums(ready, [F.col("_h"), *[F.col(k) for k in keys]], ["_one"], by)
    return out.withColumnsRenamed({"cum__one": "rank", "all__one": "n"}).drop("_h", "_bucket", "_one")


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None,
                  rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per distinct value with its tie-averaged rank (``rank_avg``).

    With weights a row counts as that many copies.
    """
    w = F.col(weight) if weight else F.lit(1)
    g = df.groupBy(*by, value).agg(F.sum(w).cast("double").alias("w"))
    g = spread_buckets(g, value, by, rows)
    out = running_sums(g, [F.col(value)], ["w"], by)
    return out.select(*by, value, (F.col("cum_w") - (F.col("w") - 1.0) / 2.0).alias("rank_avg"))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row per key. ``min_by`` combines map-side, so a hot key never sorts."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return packed.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (),
                    rows: int = BUCKET_ROWS) -> DataFrame:
    """Linearly interpolated quantiles per group as array ``edges``.

    Positions are looked up in running counts of distinct values, so no task
    holds a group's values.
    """
    g = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    g = spread_buckets(g, value, by, rows)
    run = running_sums(g, [F.col(value)], ["c"], by)
    first, last = F.col("cum_c") - F.col("c"), F.col("cum_c")
    spots = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(end).alias("end"),
                 (F.floor if end == 0 else F.ceil)((F.col("all_c") - 1) * F.lit(float(q))).alias("at"),
                 ((F.col("all_c") - 1) * F.lit(float(q)) % 1.0).alias("part"))
        for i, q in enumerate(shares) for end in (0, 1)
    ])
    hits = run.select(*by, value, F.explode(F.filter(spots, lambda s: (s["at"] >= first) & (s["at"] < last))).alias("s"))
    at = lambda i, end: F.max(F.when((F.col("s.i") == i) & (F.col("s.end") == end), F.col(value)))
    part = lambda i: F.max(F.when(F.col("s.i") == i, F.col("s.part")))
    edges = [at(i, 0) + (at(i, 1) - at(i, 0)) * part(i) for i in range(len(shares))]
    return hits.groupBy(*by).agg(F.array(*edges).alias("edges"))


def carried(df: DataFrame, order: Sequence[Column], value: str, by: Sequence[str], take, descending: bool, out: str) -> DataFrame:
    """Add ``out``: ``take`` (``F.min`` or ``F.max``) of ``value`` over the rows up to and with each one.

    ``df`` carries ``_bucket`` like ``running_sums``. What earlier buckets hold is
    carried in two levels, so no window sees a whole group.
    """
    by = list(by)
    direction = lambda c: F.col(c).desc() if descending else F.col(c).asc()
    ready = df.withColumn("_top", F.shiftright("_bucket", SECOND_BITS))
    lower = ready.groupBy(*by, "_top", "_bucket").agg(take(value).alias("_v"))
    upper = lower.groupBy(*by, "_top").agg(take("_v").alias("_v"))
    past = lambda part, c: W.partitionBy(*part).orderBy(direction(c)).rowsBetween(W.unboundedPreceding, -1)
    upper = upper.select(*by, "_top", take("_v").over(past(by, "_top")).alias("_above"))
    lower = lower.select(*by, "_top", "_bucket", take("_v").over(past([*by, "_top"], "_bucket")).alias("_beside"))
    seen = lower.join(upper, [*by, "_top"]).select(*by, "_bucket", "_above", "_beside")
    inner = W.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    both = F.least if take is F.min else F.greatest
    return df.join(seen, [*by, "_bucket"]).select(*df.columns, both("_above", "_beside", take(value).over(inner)).alias(out))
