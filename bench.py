"""Times the headline queries: one JSON line.  BENCH_SF_DIR names the tables' folder, BENCH_CPUS the number of cores."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = ["g01_bm25", "g03_frequency", "g07_smart", "g09_formula", "j01_union", "j08_inrange", "j12_sequence", "j14_sequence_struct", "f02_selection_passes", "f06_acl", "z04_listmatch", "z05_accumatch", "s07_document_terms", "d02_statistics_map", "w02_partial_update", "x05_similar_vectors", "fn_if_gt"]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from rankloom import queries as engine

    began = time.time()
    corpus = engine.from_tables(spark, sf_dir)
    for df in (corpus.postings, corpus.metadata, corpus.docs, corpus.forward, corpus.structures):
        df.count()
    built = time.time() - began
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            t = time.time()
            engine.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "collection_build_sec": round(built, 3), "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
