"""Time the headline workloads and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from concord import fixtures as fx  # noqa: E402
from concord.operators import audit, latent, metrics, resample  # noqa: E402
from concord.plans import load_all  # noqa: E402
from concord.plans.model_queries import evidence  # noqa: E402
from concord.session import local_session  # noqa: E402

PAIRS = [("A", "B"), ("A", "C"), ("B", "C")]


def workloads(registry):
    q = registry.QUERIES
    return {
        "h2_conflict_audit": q["h2_conflict_audit"],
        "h3_conflict_trace": q["h3_conflict_trace"],
        "a1_consolidate": q["a1_consolidate"],
        "j1_merge_channels": q["j1_merge_channels"],
        "x3_assign_split": q["x3_assign_split"],
        "x6_group_split": q["x6_group_split"],
        "m22_main_table": q["m22_main_table"],
        "m15_aurc": q["m15_aurc"],
        "r1_paired_bootstrap_2000": lambda s, d: resample.paired_bootstrap(
            fx.wide_predictions(s, d), "item_id", fx.ARMS, 2000, 42, ["view"]),
        "r2_paired_permutation_2000": lambda s, d: resample.paired_permutation(
            fx.wide_predictions(s, d), "item_id", PAIRS, 2000, 42, ["view"]),
        "r9_multiverse_bootstrap_2000": lambda s, d: resample.multiverse_bootstrap(
            fx.obs_a(s, d), fx.obs_b(s, d), "ck", "fk", 2000, 20260816),
        "l3_fit_latent_25_rounds": lambda s, d: latent.fit_latent(evidence(s, d)).items,
        "l13_dawid_skene": q["l13_dawid_skene"],
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", partitions=int(cpus))
    only = sys.argv[1:]
    fx.table(spark, sf_dir, "lineitem").groupBy("l_linestatus").count().collect()
    times = {}
    for name, fn in workloads(load_all()).items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds over headline workloads", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
