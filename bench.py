"""Times the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from strandflow.functions.tables import drop_staged
from strandflow.plans.queries import QUERIES

HEADLINE = ["read_dedup", "pileup", "site_entropy", "variant_sites", "entropy_corrected_reads", "variant_sites_post", "compact_dedup", "kmer_edges", "edge_prune", "match_matrix", "support_matrix", "read_fraction", "nearest_haplotype", "distance_histogram", "mismatch_profile", "window_membership", "class_consensus", "majority_vote"]

#: Longer ones, run once and not part of the total.
HEAVY = ["local_haplotypes", "region_split", "credibility_score", "fit_grid", "solution", "gibbs_assign"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str, times: int) -> float:
        runs = []
        for _ in range(times):
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
            drop_staged(spark)
        return round(statistics.median(runs), 3)

    took = {name: timed(name, repeats) for name in names}
    heavy = {name: timed(name, 1) for name in HEAVY} if names is HEADLINE else {}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "heavy": heavy, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
