"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
HEADLINE = (
    "subject_instability", "rank_materiality", "panel_reproduction_audit", "model_accuracy", "kendalls_w", "leave_one_subject_out", "bootstrap_accuracy_ci", "bootstrap_rank_ci", "null_rank_range",
    "irt_proxy_items", "hierarchical_logit", "roc_auc", "multiple_testing", "fleiss_kappa", "shortcut_retention", "item_forensics_join", "ngram_overlap", "rank_transfer",
)


def main() -> None:
    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from plumbline.plans import registry

    queries, took = registry.queries(), {}
    queries["model_accuracy"](spark, sf_dir).count()  # class loading
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
