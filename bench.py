"""Time the headline queries on $BENCH_SF_DIR and print one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from undertone.plans import catalog  # noqa: E402
from undertone.session import build_session  # noqa: E402

HEADLINES = [
    "flow_features", "compression_statistics", "flow_assignment", "payload_entropy", "dns_export_packets",
    "raw_frame_packets", "fold_scalers", "ranking_metrics", "loso_single_feature", "correlation_matrix",
    "describe_by_label", "isolation_forest_scores", "autoencoder_errors", "score_captures", "stream_flow_windows",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false",
        # The tables are a few MB: let small shuffles keep all cores busy.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    })
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINES
    # Start the JVM and the Python workers, and let the flow code compile, before timing.
    catalog.QUERIES["flow_features"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
