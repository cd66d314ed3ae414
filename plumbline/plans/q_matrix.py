"""Queries of the response matrix."""

from pyspark.sql import functions as F

from plumbline.functions.stats import r9
from plumbline.operators import matrix
from plumbline.plans.bindings import Tables
from plumbline.plans.registry import query


@query("model_accuracy", "SELECT model_id, round(a, 9) AS accuracy FROM acc")
def _(t: Tables):
    return matrix.accuracy(t.full).select("model_id", r9("accuracy").alias("accuracy"))


@query("subject_accuracy", "SELECT model_id, subject, round(a, 9) AS accuracy FROM sa")
def _(t: Tables):
    return matrix.accuracy(t.full, "model_id", "subject").select("model_id", "subject", r9("accuracy").alias("accuracy"))


@query("item_difficulty", "SELECT item_id, n, round(p, 9) AS p, round(sp, 9) AS sd_pop, round(ss, 9) AS sd_sample, round(p * (1 - p), 9) AS disagreement FROM it")
def _(t: Tables):
    return matrix.item_statistics(t.full).select("item_id", "n", *[r9(c).alias(c) for c in ("p", "sd_pop", "sd_sample", "disagreement")])


@query("matrix_adequacy", """, c AS (SELECT count(DISTINCT model_id) AS models, count(DISTINCT item_id) AS items, count(score) AS cells FROM f)
SELECT models, items, cells, models * items - cells AS missing, round(1 - cells / (models * items), 9) AS missing_fraction,
  round(min(a), 9) AS lowest, round(max(a), 9) AS highest, round(quantile_cont(a, 0.1), 9) AS p10, round(quantile_cont(a, 0.9), 9) AS p90, round(stddev_pop(a), 9) AS sd,
  round(avg(CASE WHEN abs(a - 0.25) <= 0.05 THEN 1.0 ELSE 0.0 END), 9) AS near_chance FROM acc, c GROUP BY models, items, cells""")
def _(t: Tables):
    return matrix.adequacy(t.full).select("models", "items", "cells", "missing", *[r9(c).alias(c) for c in ("missing_fraction", "lowest", "highest", "p10", "p90", "sd", "near_chance")])


ITEMS = [str(i) for i in range(200)]  # of the binding


@query("matrix_pivot_mean", "SELECT model_id, " + ", ".join(f"round(max(CASE WHEN item_id = '{i}' THEN score END), 9) AS i{i}" for i in ITEMS) + " FROM f GROUP BY 1")
def _(t: Tables):
    wide = matrix.pivot(t.full, ITEMS)
    return wide.select("model_id", *[r9(F.col(f"`{i}`")).alias(f"i{i}") for i in ITEMS])


@query("matrix_unpivot", "SELECT model_id, item_id, round(score, 9) AS score FROM f")
def _(t: Tables):
    return matrix.unpivot(matrix.pivot(t.full, ITEMS)).where("score is not null").select("model_id", "item_id", r9("score").alias("score"))


@query("matrix_missing_cells", "SELECT count(DISTINCT model_id) AS models, count(DISTINCT item_id) AS items, count(score) AS cells, count(DISTINCT model_id) * count(DISTINCT item_id) - count(score) AS missing FROM f")
def _(t: Tables):
    return matrix.missing_cells(t.full).drop("missing_fraction")


@query("align_to_full", "SELECT f.model_id, f.item_id, round(f.score, 9) AS score, round(v.score, 9) AS variant_score FROM f LEFT JOIN v USING (model_id, item_id)")
def _(t: Tables):
    return matrix.align(t.full, t.variant).select("model_id", "item_id", r9("score").alias("score"), r9("variant_score").alias("variant_score"))


@query("weighted_accuracy", """, w AS (SELECT item_id, p * (1 - p) AS w FROM it WHERE CAST(item_id AS INT) % 3 > 0), i AS (SELECT DISTINCT item_id, coalesce(w, 1.0) AS w FROM f LEFT JOIN w USING (item_id))
SELECT model_id, round(sum(w * score) / (SELECT sum(w) FROM i), 9) AS weighted_accuracy FROM f JOIN i USING (item_id) GROUP BY 1""")
def _(t: Tables):
    w = matrix.item_statistics(t.full).where("cast(item_id as int) % 3 > 0").select("item_id", F.col("disagreement").alias("weight"))
    return matrix.weighted_accuracy(t.full, w).select("model_id", r9("weighted_accuracy").alias("weighted_accuracy"))


@query("normalized_model_matrix", "SELECT model_id, item_id, round(avg(score), 9) AS score FROM (SELECT CASE WHEN CAST(model_id AS INT) < 12 THEN 'm' || CAST(CAST(model_id AS INT) % 6 AS VARCHAR) ELSE 'm' || model_id END AS model_id, item_id, score FROM f) GROUP BY ALL")
def _(t: Tables):
    m = F.col("model_id").cast("int")
    raw = t.full.withColumn("model_id", F.when(m < 6, F.concat(F.lit(" M"), m.cast("string"))).when(m < 12, F.concat(F.lit("m"), (m % 6).cast("string"), F.lit(" "))).otherwise(F.concat(F.lit("M"), "model_id")))
    return matrix.normalized_models(raw).select("model_id", "item_id", r9("score").alias("score"))


@query("accuracy_at_all_levels", "SELECT model_id, subject, round(avg(score), 9) AS accuracy, count(*) AS cells FROM f GROUP BY GROUPING SETS ((model_id, subject), (model_id), (subject), ())")
def _(t: Tables):
    from plumbline.plans import views

    views.register(t.spark, t.dir)
    return t.spark.sql(views.ACCURACY_AT_ALL_LEVELS).withColumn("accuracy", r9("accuracy"))
