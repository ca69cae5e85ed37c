"""Connected components over links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from concord.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in ``links``; the component is the smallest id reachable.

    Each round every id takes the smallest label among its neighbours and then
    the label of that label, so the rounds grow with the logarithm of a path's
    length. Both aggregations combine before they shuffle, so an id with very
    many links is no burden. Null and self links are ignored.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = cut_lineage(edges.union(edges.select("y", "x")).distinct())
    label = cut_lineage(edges.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("low")).select(
        "id", F.least("id", "low").alias("component")))
    while True:
        near = edges.join(label, edges["y"] == label["id"]).groupBy("x").agg(F.min("component").alias("near"))
        lower = label.join(near, label["id"] == near["x"]).select(
            "id", "component", F.least("component", "near").alias("next"))
        # A label is an id itself: take over its label, and give what was found to the old label as well.
        hooks = lower.groupBy(F.col("component").alias("root")).agg(F.min("next").alias("hook"))
        step = lower.join(hooks, lower["next"] == hooks["root"], "left").join(
            hooks.withColumnRenamed("root", "old").withColumnRenamed("hook", "pulled"),
            F.col("component") == F.col("old"), "left",
        ).select("id", F.least("next", "hook", "pulled").alias("component"), F.col("component").alias("before"))
        step = cut_lineage(step)
        moved = step.where("component <> before").limit(1).count()
        label = step.select("id", "component")
        if not moved:
            return label
