"""Times the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set), BENCH_RUNS (default 1).
"""

from __future__ import annotations

import json
import os
import sys
import time

from cohortry.plans import ranking_plans as rp
from cohortry.plans import registry
from cohortry.session import build_session

HEADLINE = [
    "auroc_ap", "lineitem_auroc", "best_f1", "operating_points", "roc_curve", "rank_intervals",
    "bootstrap_1000", "fit_numeric", "impute_scale", "onehot", "freq_encode", "ordinal_codes",
    "vocab_ids", "availability_by_year", "feature_drift", "strat_split", "render_sentence",
    "render_chunks", "docs_truncation", "chunk_pool", "fit_scaler", "interval_gaps",
    "prediction_sink", "stream_apply", "lr_fit_score"]


def bootstrap_1000(spark, sf_dir):
    """The full number of draws, for every cell at once."""
    from cohortry.operators import bootstrap
    from cohortry.plans import fixtures as fx
    sums = bootstrap.draw_sums(fx.test_scores(spark, sf_dir), bootstrap.N_DRAWS)
    return bootstrap.intervals(bootstrap.long_draws(
        bootstrap.rank_draws(sums), rp.CELL, ["auroc", "auprc"]), [*rp.CELL, "metric"])


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    all_queries = {**registry.QUERIES, "bootstrap_1000": bootstrap_1000}
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start the executors

    seconds = {}
    for q in names:
        best = None
        for _ in range(runs):
            t = time.perf_counter()
            all_queries[q](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - t
            best = took if best is None else min(best, took)
        seconds[q] = round(best, 3)
        print(f"{q}: {best:.2f}s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
