"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from paperfold.catalog.registry import QUERIES, load_all
from paperfold.session import build_session

HEADLINE = (
    "cosine_topk_one_query",
    "cosine_topk_topic_queries",
    "nearest_of_every_vector",
    "search_mixed_filters",
    "search_rerank_threshold",
    "hash_embeddings",
    "context_packing",
    "chunk_bracket_papers",
    "chunk_bare_papers",
    "running_lines_removed",
    "access_states",
    "chunk_lookup",
    "index_permutations",
    "render_block_problems",
    "eval_hit_metrics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    load_all()
    spark = build_session(cpus, "paperfold-bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr)
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
