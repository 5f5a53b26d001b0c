"""Time the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]`` and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "pseudobulk_sum", "pseudobulk_log_cpm", "pseudobulk_restricted_genes", "pseudobulk_fraction_expressing", "donor_totals",
    "mean_pooled_vectors", "composition_wide_with_patients", "cell_quality_metrics", "highly_variable_genes", "rank_tokens",
    "audit_summary", "leakage_report", "auroc_events_by_user", "average_precision", "bootstrap_auroc_interval",
    "permutation_test_two_sided", "paired_permutation_test", "shuffled_stratified_folds", "held_out_medians",
    "nearest_neighbors", "nested_cross_validation", "wide_feature_cross_validation", "matrix_market_pseudobulk", "incremental_pseudobulk",
)


def replicated(spark, sf_dir: str, times: int = 50) -> tuple[int, float]:
    """Entries and seconds of pseudobulk over ``times`` copies of the counts (each with cells of its own), which tells the
    rate apart from the start-up that a small table is all about. The copies are written before the clock starts."""
    from pyspark.sql import functions as F

    from donorlake.operators import pseudobulk as pb
    from donorlake.plans.registry import cells, counts
    from donorlake.session import scratch

    def copies(df, name):
        path = scratch(spark, name)
        spread = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
        spread.withColumn("cell_id", F.col("cell_id") * times + F.col("_copy")).drop("_copy").write.parquet(path)
        return spark.read.parquet(path)

    many, people = copies(counts(spark, sf_dir), "bench-counts"), copies(cells(spark, sf_dir).select("cell_id", "donor_id"), "bench-cells")
    entries = many.count()
    start = time.perf_counter()
    pb.pseudobulk(many, people).write.format("noop").mode("overwrite").save()
    return entries, round(time.perf_counter() - start, 3)


def machine_seconds() -> float:
    """A fixed loop without Spark, so that a slow machine can be told from a slow query."""
    start, x = time.perf_counter(), 1
    for _ in range(5_000_000):
        x = (x * 1103515245 + 12345) & 0x7FFFFFFF
    return round(time.perf_counter() - start, 3)


def main() -> None:
    from donorlake.plans import all_queries
    from donorlake.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g", spark__ui__showConsoleProgress="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries().QUERIES

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    machine = machine_seconds()
    run("pseudobulk_sum")  # start the JVM's compilers and the file cache
    seconds = {name: round(run(name), 3) for name in HEADLINE}
    replica, replica_seconds = replicated(spark, sf_dir)
    entries = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    cells = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(os.path.basename(sf_dir.rstrip("/")).replace("sf", "") or 0),
        "pseudobulk_entries_per_sec": round(entries / seconds["pseudobulk_sum"]),
        "pseudobulk_cells_per_sec": round(cells / seconds["pseudobulk_sum"]),
        "pseudobulk_replica_entries": replica,
        "pseudobulk_replica_seconds": replica_seconds,
        "pseudobulk_replica_entries_per_sec": round(replica / replica_seconds),
        "machine_loop_seconds": machine,
        "cpus": int(cpus),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
