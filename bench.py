"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_ALL=1 for every query.
A query's time covers building its plan and running it to the end; the result is counted by a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flt02_search_offers", "flt05_text_search", "rec01_recommend", "rec01_candidate_counts", "jn01_match_by_name", "jn03_match_by_containment",
    "agg01_offer_statistics", "agg03_entity_rollup", "agg08_profile_numeric", "agg14_group_bias", "agg19_consolidate_pages", "agg26_quartiles_by",
    "snk01_upsert_replace", "col03_standardise_offers", "col07_classify_degree_type", "tier01_derive_tier", "win05_average_ranks", "ev07_evaluate_recommendations",
    "val03_validate_entities", "lk01_target_correlation", "dr04_drift_report", "sim01_similar_exact", "pg01_page_text", "pg02_extract_links",
    "pg05_reachable_pages", "ml10_roc_auc", "st02_rate_abuse",
]


def main() -> None:
    from offerloom import plans, registry
    from offerloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    plans.load()
    names = list(registry.QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the engine
    times = {}
    for name in names:
        t = time.time()
        try:
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t, 3)
        except Exception as e:  # a failed query must not hide the others
            print(f"{name}: {type(e).__name__}: {str(e)[:300]}", file=sys.stderr)
            times[name] = None
    total = round(sum(v for v in times.values() if v is not None), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
