"""Times the main steps of the pipeline: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# Step -> registered query. Each query builds its whole plan from the raw tables; only the
# fitted encoders, the encoded events and the batch plan are kept between steps (as stored files
# would be), and each is timed on its own.
STEPS = (
    "point_in_time_records", "ordered_events", "event_schema_issues", "numeric_boundaries",
    "category_vocabulary", "aggregated_features", "commerce_features", "escalating_labels",
    "event_tokens", "tokenized_records", "stored_train_records", "masked_tokens", "mask_coverage",
    "packed_batches", "flat_batches", "text_value_ids", "history_lengths", "rank_auc",
)


def main() -> None:
    from eventlens.plans import QUERIES, plain, workspace

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("eventlens-bench")
        .config("spark.driver.memory", "20g").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", os.environ.get("BENCH_PARTITIONS", CPUS))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="eventlens-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(10).count()
    ws = workspace(spark, FOLDER)
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.time()
        run()
        times[name] = round(time.time() - start, 3)

    timed("fit_commerce", lambda: ws.commerce.bundle)
    timed("fit_with_text", lambda: ws.commerce_text.bundle)
    timed("store_encoded_events", lambda: (ws.commerce.stored, ws.commerce.stored_profiles))
    timed("plan_batches", lambda: ws.commerce.batches)
    only = sys.argv[1:]
    for name in STEPS:
        if not only or name in only:
            timed(name, lambda: plain(QUERIES[name].run(ws)).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "pipeline steps, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
