"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from skein.plans import registry  # noqa: E402

HEADLINES = [
    "most_common_part", "counter_merge", "frecency_event_type", "word_freq_alpha", "word_freq_delim", "line_freq", "unique_lines", "anagram_groups", "upsert_last", "get_or_default", "delete_one_occurrence",
    "multiset_compare", "lg_quantiles", "quantile_midrank", "hist_distribution", "moments_pop", "stats_merge", "moving_moments", "moving_q_linear", "ew_hist_final", "rank_of", "kway_merge_pos", "diffs_ratios_returns",
    "cms_estimate", "kmv_distinct", "fingerprint_set", "kll_quantiles", "tdigest_quantiles", "running_q_exp", "stream_counts", "stream_moving_stats", "order_stat_nth", "neighbors",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="skein-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINES:
        best = None
        for _ in range(2):  # the first run compiles code
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "total_seconds_of_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
