"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of local threads and
BENCH_QUERIES an optional comma-separated choice. Each query runs once to warm
up and then BENCH_RUNS times; the best time counts. Results go to the noop
sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "revenue_by_nation", "filter_multi", "cast_types", "expr_column", "join_inner", "join_full",
    "join_salted_hot_key", "zip_columns", "union_rows", "distinct_keys", "groupby_agg",
    "pivot_agg", "feature_agg", "unpivot", "explode", "order_by", "top_k", "fillna", "dropna_n",
    "imputer_mean", "corr_matrix", "cov_matrix", "quantiles", "quantiles_approx",
    "freq_items_exact", "profile_stats", "profile", "hash_encode", "hash_encode_pair",
    "vector_dot", "vector_sum_normalize", "piecewise_similar", "string_index",
    "string_index_distributed", "assemble", "standard_scale", "tokenize", "count_vectorize",
    "linreg", "naive_bayes", "kmeans", "rforest_reg", "fp_rules", "eval_binary", "eval_roc_curve",
    "eval_regression", "eval_multiclass", "io_parquet", "io_csv", "io_tfrecord",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from millrace.plans import QUERIES

    timings = {}
    for name in chosen:
        best = None
        for run in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            elapsed = time.perf_counter() - start
            spark.catalog.clearCache()
            if run > 0:
                best = elapsed if best is None else min(best, elapsed)
        timings[name] = round(best, 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries, warm",
        "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
