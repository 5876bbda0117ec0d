"""Time the headline queries: one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import time

from checks import load_all
from checks.verify import session

HEADLINE = [
    "reconcile_by_code", "reconcile_by_code_and_modifier", "reconcile_field_diffs", "compare_summary", "compare_diff_profile", "capped_result_residue_last",
    "current_flags", "version_listing", "known_content", "ingest_registry", "prune_unpublished", "expanded_json_table", "flattened_records",
    "upserted_mappings", "bulk_import_saved", "resolved_labels", "html_table_rows", "file_candidates", "file_link_catalog", "related_links",
    "grid_bodies", "delimited_lines", "linked_rows", "loose_and_strict_numbers", "portal_dates", "normalized_text",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session(cpus, cpus)
    spark.sparkContext.setLogLevel("ERROR")
    known = load_all()
    known["keep_lowest_id"].run(spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        known[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
