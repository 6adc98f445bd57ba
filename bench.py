"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spanwright.plans.registered import REGISTERED  # noqa: E402
from spanwright.session import build_session  # noqa: E402

HEADLINE = ("annotate_documents", "tag_documents", "assert_by_rules", "section_paths", "model_inputs",
            "exact_codes", "map_by_lookup", "bm25_search", "dense_search", "map_gated",
            "align_segments", "build_dev", "near_duplicates", "vote_clusters", "graft", "postprocess",
            "score_dataset_concept", "tune_gate", "tune_assertions", "synthesize")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "20g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(10).selectExpr("sum(id)").collect()  # start-up is not part of the first query
    times = {}
    for name in names:
        start = time.perf_counter()
        REGISTERED[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
