"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from locusloom.plans.queries import QUERIES  # noqa: E402
from locusloom.session import build_session  # noqa: E402

HEADLINE = [
    "merge_overlapping",
    "coverage",
    "mask_complement",
    "roi_overlap",
    "roi_features",
    "containment_eval",
    "jaccard_rollup",
    "sliding_windows",
    "bin_weighted",
    "assoc_regions",
    "liftover_signal",
    "clip_percentile",
    "decile_rank",
    "qnorm",
    "merge_stat",
    "binned_dump",
    "masked_stats",
    "corr_full",
    "corr_segments",
    "spearman",
    "kendall",
    "rank_forms",
    "gc_content",
    "kmer_freq",
    "motif_counts",
    "dnase_pwm",
    "window_sequences",
    "stack_distinct",
    "roc_auc",
    "chebyshev_nearest",
    "chebyshev_knn",
    "roi_restricted_eval",
    "complement_sample",
    "preprocess_qnorm",
    "downsample_rows",
    "map_select",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # one small query starts the JVM's code paths before timing
    QUERIES["coverage"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name:24s} {times[name]:8.3f}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
        )
    )


if __name__ == "__main__":
    main()
