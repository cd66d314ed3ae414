"""The canonical tables as temporary views, for SQL of one's own."""

from __future__ import annotations

from pyspark.sql import SparkSession

from plumbline.plans.bindings import Tables

VIEWS = {"responses": "responses", "full_responses": "full", "ablated_responses": "variant", "binary_responses": "binary", "second_benchmark": "second", "families": "families", "judgments": "judgments", "detector_scores": "detector", "items": "items"}


def register(spark: SparkSession, sf_dir: str) -> list[str]:
    """Create or replace the views over a data folder; their names."""
    t = Tables(spark, sf_dir)
    for view, name in VIEWS.items():
        getattr(t, name).createOrReplaceTempView(view)
    return list(VIEWS)


ACCURACY_AT_ALL_LEVELS = """
SELECT model_id, subject, avg(score) AS accuracy, count(*) AS cells
FROM full_responses GROUP BY GROUPING SETS ((model_id, subject), (model_id), (subject), ())
"""
