"""Time the headline queries: a warm-up, then the median of three runs each, results written nowhere.

Prints one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS (3) as in the environment. The line also has the
rows that each query returns and the megabytes that its last run shuffled.
"""

import json
import os
import statistics
import time

from galewatch import catalog
from galewatch.session import build_session

HEADLINE = (
    "climatology_stats", "zscore_cells", "flag_extremes_high", "region_boxes", "top_box_per_frame", "track_gating", "lifecycle_phases", "transition_rows",
    "bilinear_regrid", "neighbourhood_features", "quantile_map", "field_errors", "graph_smoothing", "persistence_skill", "missing_hours", "lead_time_error", "roc_auc",
)


def shuffled_mb(spark, since: int) -> tuple[float, int]:
    """Megabytes that stages from number ``since`` on wrote to shuffles, and the next stage's number."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    own = [stages.apply(k) for k in range(stages.size())]
    return sum(s.shuffleWriteBytes() for s in own if s.stageId() >= since) / 1e6, max((s.stageId() for s in own), default=-1) + 1


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, took, rows, moved, stage = catalog.queries(), {}, {}, {}, 0
    for name in HEADLINE:
        rows[name] = queries[name](spark, sf_dir).count()  # the warm-up
        seconds = []
        for _ in range(runs):
            _, stage = shuffled_mb(spark, stage)
            start = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds.append(time.time() - start)
        moved[name] = round(shuffled_mb(spark, stage)[0], 3)
        took[name] = round(statistics.median(seconds), 3)
    print(json.dumps({
        "metric": "headline queries, total of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1],
        "rows": rows, "shuffle_mb": moved, "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
