"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is planned and run in full (noop sink) once; before that all run on the smaller tables
beside, where there are any, so that code is compiled.
per_query_ms relates retrieval times to the number of questions answered in the batch.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

QUERIES = ["chk_chunks", "ret_term_stats", "ret_bm25_top20", "ret_bm25_scoped", "ret_dense_topk", "ret_rrf", "ret_hybrid", "ret_rerank_len", "evl_summary", "qlt_flags", "qlt_multiset_residual", "evd_lookup_window", "evd_parent_expand", "lay_nearest", "blk_groups", "agt_policy_outcomes", "use_api_usage", "ret_dense_bm25", "ret_search", "evl_five_arms"]


def main() -> None:
    from pyspark.sql import SparkSession

    from docsift import registry

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.files.maxPartitionBytes", "4m").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, small = {}, os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for folder in (small, sf_dir) if os.path.isdir(small) else (sf_dir,):
        for name in QUERIES:
            began = time.time()
            registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    texts = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id % 20 = 0").count()
    each = {n: round(1000 * took[n] / (vectors if n in ("ret_dense_topk", "ret_rrf") else texts), 3) for n in ("ret_bm25_top20", "ret_dense_topk", "ret_rrf", "ret_hybrid", "ret_rerank_len")}
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "per_query_ms": each, "sf": float(scale[1]) if scale else None}))


if __name__ == "__main__":
    main()
