"""Wall-clock of the headline queries; prints one JSON line.

BENCH_SF_DIR selects the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sphereframe.plans.catalog import all_queries  # noqa: E402
from sphereframe.session import build_session  # noqa: E402

HEADLINE = [
    # sources and reshaping
    "read_grid", "write_grid", "relayout_by_node", "pending_files", "unstack_levels", "stack_features",
    # selection and alignment
    "topk_by_median", "head_timesteps", "align_many", "persistence_forecast", "climatology_forecast", "forecast_error",
    # statistics
    "feature_extrema", "global_standard_transform", "anomaly_transform_standardized", "climatology_dayofyear",
    "mergeable_moments", "missing_timesteps",
    # verification and diagrams
    "persistence_skill_global", "deterministic", "skill_spearman", "skill_distribution", "benchmark", "ensemble_median",
    "hovmoller_lat", "hovmoller_diff",
    # samples
    "lag_features", "targets", "batches", "rollout",
    # grids, remapping, graphs
    "grid_healpix", "overlap_weights", "remap_fracarea", "max_value_pool", "nested_max_pool", "stencil",
    "knn_graph", "laplacian_normalized", "chebyshev_basis", "cotan_laplacian",
    # streams
    "stream_moments", "stream_verify",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false", spark__driver__memory="12g",
                          # small tables: a core for every small partition; scratch tables go where the run's other temporary files are
                          spark__sql__adaptive__coalescePartitions__minPartitionSize="128KB", spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="bench-"))
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    registered["time_slice"].run(spark, sf).write.format("noop").mode("overwrite").save()  # start-up
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registered[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf.rsplit("sf", 1)[-1]}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
