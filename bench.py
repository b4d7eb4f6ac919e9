"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tessera.plans import catalogue

HEADLINE = ["daily_event_rollup", "journal_by_group", "full_outer_cells", "top_customers", "rolling_zscore", "islands_merge", "ot_caps", "asof_lookup", "three_way_groupings", "gst_split", "repeat_line_collapse", "jaccard_turns", "rule_significance", "content_hash"]
# Timed too, but not part of the total, which stays comparable with earlier rounds.
ALSO = ["similarity_pairs", "near_dup_greedy", "word_diff", "difference_cleanup", "org_tree", "box_overlaps", "back_pressure", "attendance_resolution"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE + ALSO:
        runs = []
        for _ in range(2 if name in HEADLINE else 1):  # the second run is warm
            began = time.time()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took[n] for n in HEADLINE), 3), "unit": "sec", "queries": took, "sf": sf_dir}))


if __name__ == "__main__":
    main()
