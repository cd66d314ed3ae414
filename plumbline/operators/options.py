"""Answers from the shape of the options alone: lengths, keywords, priors. ``options``: item_id, label, text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X


def extreme_length(options: DataFrame, longest: bool) -> DataFrame:
    """item_id, label of the longest (ties: the last label) or shortest option (ties: the first)."""
    pick = F.max if longest else F.min
    return options.groupBy("item_id").agg(pick(F.struct(F.length("text").alias("n"), "label")).alias("m")).select("item_id", F.col("m.label").alias("label"))


def keyword_overlap(options: DataFrame, prompts: DataFrame) -> DataFrame:
    """item_id, label of the option that shares most tokens with the prompt (ties: the last label); A if none shares any."""
    p = prompts.select("item_id", F.array_distinct(X.tokens(F.col("prompt"))).alias("asked"))
    n = F.size(F.array_intersect("asked", F.array_distinct(X.tokens(F.col("text")))))
    best = options.join(p, "item_id").groupBy("item_id").agg(F.max(F.struct(n.alias("n"), "label")).alias("m"))
    return best.select("item_id", F.when(F.col("m.n") > 0, F.col("m.label")).otherwise("A").alias("label"))


def most_common_label(answers: DataFrame, default: str = "A") -> str:
    """The most frequent answer (ties: the first label); ``answers``: label."""
    row = answers.groupBy("label").count().orderBy(F.desc("count"), "label").first()
    return default if row is None else row["label"]
