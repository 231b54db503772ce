"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "agg_patterns", "url_normalize", "url_pattern", "ext_links", "ext_forms", "ext_markdown", "cls_structural",
    "dd_url", "dd_near_content", "agg_crawl_stats", "agg_domain_stats", "agg_project_stats", "agg_histogram",
    "win_pattern_cap", "win_failure_streak", "win_delay_multiplier", "win_change", "win_quota", "win_domain_schedule",
    "fr_candidates", "fr_preflight", "fr_next_round", "fr_depth", "join_robots", "kg_nodes", "kg_page_links", "wf_hubs",
    "dc_assemble", "st_usage", "st_block",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    from siteatlas.plans import catalog
    from siteatlas.session import build_session

    spark = build_session("bench", cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    entries = catalog.load()
    spark.range(1000).selectExpr("sum(id)").collect()
    # The given pages are one file of one row group; on a cluster a table has more splits than cores.
    splits = spark.sparkContext.defaultParallelism
    entries["url_normalize"].build(catalog.Tables(spark, folder, splits)).write.format("noop").mode("overwrite").save()
    spent, planned = {}, {}
    for name in HEADLINE:
        start = time.perf_counter()
        job = entries[name].build(catalog.Tables(spark, folder, splits))
        planned[name] = round(time.perf_counter() - start, 3)
        job.write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - start, 3)
        print(name, planned[name], spent[name], file=sys.stderr, flush=True)
    rows = {t: spark.read.parquet(f"{folder}/{t}.parquet").count() for t in ("pages", "documents", "events", "lineitem")}
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline query time", "value": round(sum(spent.values()), 3), "unit": "sec",
                      "queries": spent, "build": planned, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale, "rows": rows}))


if __name__ == "__main__":
    main()
