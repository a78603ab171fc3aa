"""Times the headline queries and prints one JSON line."""

import json
import os
import time

from lemmaflow.plans.registry import QUERIES
from lemmaflow.session import build_session

HEADLINE = [
    "negative_sampling", "label_buckets", "last_given_frontier", "ranking_metrics", "auc_ap", "static_tokens", "clause_normalize",
    "canonical_formula", "prefilter_topk", "score_request_join", "two_stage_rerank", "score_fusion", "run_report", "failure_log",
    "formula_nodes", "truncation_plan", "rerank_scored",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["label_buckets"](spark, sf).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
