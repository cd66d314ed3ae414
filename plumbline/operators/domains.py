"""Validity checks of domain benchmarks; each gives one row (or one for each item) from item metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import pearson, ratio


def _share(c) -> F.Column:
    return F.avg(F.coalesce(c.cast("double"), F.lit(0.0)))


def code(items: DataFrame) -> DataFrame:
    """weak_tests (share under three hidden tests), flaky (any), locked (share), hidden_public, languages, risks."""
    s = items.agg(
        _share(F.col("hidden_tests") < 3).alias("weak_tests"), F.coalesce(F.max(F.col("flaky_reruns") > 0), F.lit(False)).alias("flaky"), _share(F.col("lock_hash").isNotNull()).alias("locked"),
        F.avg(F.when(F.col("public_tests") > 0, F.col("hidden_tests") / F.col("public_tests"))).alias("hidden_public"), F.count_distinct("language").alias("languages"),
    )
    risks = sum((F.coalesce(c, F.lit(False)).cast("int") for c in (F.col("weak_tests") > 0.3, F.col("flaky"), F.col("locked") < 1, F.col("hidden_public") < 0.5)), F.lit(0))
    return s.withColumn("risks", risks)


def safety(items: DataFrame) -> DataFrame:
    """policies, rubrics, styles, mean score where refusal is due, risks."""
    s = items.agg(F.count_distinct("policy").alias("policies"), F.count_distinct("rubric").alias("rubrics"), F.count_distinct("style").alias("styles"), F.avg(F.when(F.col("refuse"), F.col("score"))).alias("refusal_score"))
    return s.withColumn("risks", (F.col("policies") > 1).cast("int") + (F.col("rubrics") > 1).cast("int") + F.coalesce(F.col("refusal_score") > 0.3, F.lit(False)).cast("int"))


def medical(items: DataFrame) -> DataFrame:
    s = items.agg(F.count_distinct("site").alias("sites"), _share(F.col("annotators") < 2).alias("single_annotator"), F.count_distinct("severity").alias("severities"), F.avg("utility").alias("utility"), _share(F.col("uncertainty") >= 0.7).alias("uncertain"))
    return s.withColumn("risks", (F.col("sites") < 2).cast("int") + (F.col("single_annotator") > 0.3).cast("int"))


def graph(items: DataFrame) -> DataFrame:
    s = items.agg(F.count_distinct("timestamp").alias("timestamps"), (F.count("*") - F.count_distinct("entity")).alias("repeated_entities"), _share(F.col("degree") >= 100).alias("hubs"), F.avg("degree").alias("degree"), _share(F.col("neighbour_rate") >= 0.9).alias("leaky"), F.count_distinct("split").alias("splits"))
    return s.withColumn("risks", (F.col("hubs") > 0.2).cast("int") + (F.col("splits") < 2).cast("int"))


def multimodal(items: DataFrame) -> DataFrame:
    inside = F.contains(F.lower("ocr"), F.lower("answer")) & (F.length("answer") > 0)
    return items.agg(F.count_distinct("modality").alias("modalities"), _share(F.col("ocr") != "").alias("ocr_coverage"), F.count_if(inside).alias("answer_in_ocr"), F.count_distinct("crop").alias("crops"), _share(F.col("asset").isNotNull()).alias("assets"))


def agents(traces: DataFrame) -> DataFrame:
    """traces, steps, complete (every step has an action and an observation), hashed, rewarded (a reward of .99 or more
    without success), errors: ``steps`` is an array of structs."""
    s = traces.select(
        F.size("steps").alias("n"), F.forall("steps", lambda x: x["action"].isNotNull() & x["observation"].isNotNull()).alias("complete"), F.forall("steps", lambda x: x["state_hash"].isNotNull()).alias("hashed"),
        (F.exists("steps", lambda x: x["reward"] >= 0.99) & ~F.col("success")).alias("hacked"), F.size(F.filter("steps", lambda x: x["error"].isNotNull())).alias("errors"),
    )
    return s.agg(F.count("*").alias("traces"), F.sum("n").alias("steps"), _share(F.col("complete")).alias("complete"), _share(F.col("hashed")).alias("hashed"), F.count_if("hacked").alias("rewarded"), F.sum("errors").alias("errors"))


def rag(items: DataFrame) -> DataFrame:
    """score_delta (without minus with context; a missing cell makes it null), reliance, supported (share of items whose
    spans all stand in the context), cited, unanswerable, position_correlation."""
    span = F.forall("spans", lambda s: F.contains(F.col("context"), s)) & (F.size("spans") > 0)
    lost = F.count_if(F.col("ablated").isNull())
    return items.agg(F.when(lost == 0, F.avg(F.col("ablated") - F.col("score"))).alias("score_delta"), ratio(F.avg("score") - F.avg("ablated"), F.avg("score")).alias("reliance"), _share(span).alias("supported"), _share(F.size("citations") > 0).alias("cited"), _share(~F.col("answerable")).alias("unanswerable"), pearson("position", "score").alias("position_correlation"))
