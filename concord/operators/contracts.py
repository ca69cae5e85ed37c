"""Data contracts, quarantines, digests and table comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from concord.session import cut_lineage


def expect(df: DataFrame, rules: dict[str, tuple[Column, object]]) -> DataFrame:
    """Check aggregate expressions against expected values in one pass.

    Each rule is (aggregate column, expected value); the report has one row per
    rule, so failures are data the caller can store or raise on.
    """
    seen = df.agg(*[expr.cast("double").alias(name) for name, (expr, _) in rules.items()])
    rows = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(name).alias("observed"),
                 F.lit(float(want)).alias("expected"))
        for name, (_, want) in rules.items()
    ])
    return seen.select(F.explode(rows).alias("r")).select("r.*").withColumn(
        "ok", F.col("observed").eqNullSafe(F.col("expected"))
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and keys that occur more than once."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    return counts.agg(
        F.sum("c").alias("n_rows"), F.count(key).alias("n_keys"), F.expr("count_if(c > 1)").alias("n_repeated")
    )


def require_key(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull())


def quarantine(df: DataFrame, key: str, reason: str) -> tuple[DataFrame, DataFrame]:
    good = df.where(F.col(key).isNotNull())
    bad = df.where(F.col(key).isNull()).withColumn("reason", F.lit(reason))
    return good, bad


def parse_rate(sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    parts = [
        df.agg(
            F.lit(name).alias("source"), F.count(key).alias("parsed"), F.count(F.lit(1)).alias("total")
        ).withColumn("rate", F.try_divide(F.col("parsed").cast("double"), F.col("total").cast("double")))
        for name, (df, key) in sources.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def row_counts(sources: dict[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("n_rows")).withColumn("present", F.col("n_rows") > 0)
        for name, df in sources.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def row_digest(cols: Sequence[str]) -> Column:
    """SHA-256 of a row; null and empty text differ."""
    parts = [
        F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(c).cast("string")))
        for c in cols
    ]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


#: Texts that one digest of the lowest level covers, about, and hash digits per level.
LEAF_TEXTS, LEVEL_DIGITS = 16384, 3


def digest_levels(df: DataFrame, by: Sequence[str] = ()) -> int:
    """Levels below the root that leave about ``LEAF_TEXTS`` texts to a leaf, for the largest group."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    levels = 1
    while counts > LEAF_TEXTS * 16 ** (LEVEL_DIGITS * levels):
        levels += 1
    return levels


def digest_tree(df: DataFrame, text: str, by: Sequence[str] = (), levels: int | None = None) -> DataFrame:
    """(by, level, prefix, digest, n) of a Merkle tree over the texts' SHA-256 hashes.

    A leaf covers the hashes that begin with its prefix and digests them in
    order; a node above digests its children in order; level 0 is the root. The
    depth follows the count, so no task holds more than a leaf's texts or 4,096
    children. Trees of one depth can be compared node by node.
    """
    by, levels = list(by), levels or digest_levels(df, by)
    joined = lambda c: F.sha2(F.array_join(c, "\n"), 256)
    hashed = df.select(*by, F.sha2(F.col(text), 256).alias("_h"))
    level = hashed.groupBy(*by, F.substring("_h", 1, LEVEL_DIGITS * levels).alias("prefix")).agg(
        joined(F.sort_array(F.collect_list("_h"))).alias("digest"), F.count(F.lit(1)).alias("n"))
    # A node's children are read from the level below, which is written once.
    level = cut_lineage(level)
    tree = level.select(*by, F.lit(levels).alias("level"), "prefix", "digest", "n")
    for k in range(levels - 1, -1, -1):
        level = level.groupBy(*by, F.substring("prefix", 1, LEVEL_DIGITS * k).alias("_p")).agg(
            joined(F.transform(F.sort_array(F.collect_list(F.struct("prefix", "digest"))), lambda x: x["digest"])).alias("digest"),
            F.sum("n").alias("n")).withColumnRenamed("_p", "prefix")
        tree = tree.unionByName(level.select(*by, F.lit(k).alias("level"), "prefix", "digest", "n"))
    return tree


def set_digest(df: DataFrame, text: str, by: Sequence[str] = ()) -> DataFrame:
    """SHA-256 of a set of texts, whatever their order or partitioning: the root of its digest tree.

    Up to about 67 million texts the tree has one level of 4,096 leaves.
    """
    return digest_tree(df, text, by).where("level = 0").select(*by, "digest", "n")


def changed_texts(a: DataFrame, b: DataFrame, text: str) -> DataFrame:
    """(text, in_a, in_b) of the texts that only one of two sets has.

    The trees are walked from the root down: only children of nodes that differ
    are compared, and only texts under leaves that differ are read again.
    """
    levels = max(digest_levels(a), digest_levels(b))
    left, right = (cut_lineage(digest_tree(x, text, (), levels)) for x in (a, b))
    differ = None
    for k in range(levels + 1):
        pair = [t.where(F.col("level") == k).select("prefix", F.col("digest").alias(n)) for t, n in ((left, "l"), (right, "r"))]
        if differ is not None:
            parent = F.substring("prefix", 1, LEVEL_DIGITS * (k - 1))
            pair = [p.join(differ.select(F.col("prefix").alias("_p")), parent == F.col("_p"), "left_semi") for p in pair]
        differ = cut_lineage(pair[0].join(pair[1], "prefix", "full_outer").where("NOT (l <=> r)").select("prefix"))
    leaf = F.substring(F.sha2(F.col(text), 256), 1, LEVEL_DIGITS * levels)
    own = [x.select(text).join(differ, leaf == F.col("prefix"), "left_semi").withColumn(f"in_{n}", F.lit(True))
           for x, n in ((a, "a"), (b, "b"))]
    both = own[0].join(own[1], text, "full_outer").select(
        text, F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))
    return both.where("in_a <> in_b")


def compare_tables(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: present on either side, both digests, identical or not."""
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(*keys, F.lit(True).alias(f"in_{p}"), row_digest(sorted(df.columns)).alias(f"digest_{p}"))

    return side(a, "a").join(side(b, "b"), list(keys), "full_outer").select(
        *keys, F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"),
        "digest_a", "digest_b", F.col("digest_a").eqNullSafe(F.col("digest_b")).alias("identical"),
    )


def dedupe_first(df: DataFrame, key: str, order: str) -> DataFrame:
    from concord.operators.ranking import first_rows

    return first_rows(df.where(F.col(key).isNotNull()), [key], [order])


def ambiguous_duplicates(df: DataFrame, key: str, category: str, value: str, order: str) -> DataFrame:
    """Repeated ids whose category or value disagree, with their records as text."""
    rows = F.sort_array(F.collect_list(F.struct(
        F.col(order).alias("o"),
        F.concat_ws(":", F.col(category), F.format_string("%.3f", F.col(value))).alias("v"))))
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_records"),
        (F.min(category) != F.max(category)).alias("_c"),
        (F.min(value) != F.max(value)).alias("_v"),
        F.array_join(F.transform(rows, lambda r: r["v"]), "|").alias("measurements"),
    ).select(
        key, "n_records",
        (F.coalesce("_c", F.lit(False)) | F.coalesce("_v", F.lit(False))).alias("ambiguous"),
        F.when(F.col("n_records") > 1, F.col("measurements")).alias("measurements"),
    )
