"""Headline queries on one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scholarweave.plans import catalog  # noqa: E402
from scholarweave.session import build_session  # noqa: E402

HEADLINE = [
    "keyword_cooccurrence", "author_collaboration", "author_stats", "journal_stats", "citation_lag", "frequent_terms", "abstract_extract",
    "query_plan", "knn_topk_per_node", "vector_search", "connected_components", "clustering_coefficient", "unify_nodes", "cross_specializes_in",
    "bfs_local", "memory_hybrid",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalog.queries(), {}
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine before the clock
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
