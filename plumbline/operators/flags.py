"""Flags of diagnostics on items: export, severity, filters, top lists, and issue-specific scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def severity(score: Column) -> Column:
    # The ladder of severities.
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").when(score > 0, "low").otherwise("none")


def export(parts: dict[str, tuple[DataFrame, str]], benchmark: str, complement: tuple[str, ...] = ("discrimination", "stability")) -> DataFrame:
    """benchmark, diagnostic, item_id, score, severity from per-item frames: {diagnostic: (frame, measure)}. Measures of
    goodness become risks: 1 - |discrimination| and 1 - stability, 0 at least."""
    rows = []
    for name, (frame, measure) in parts.items():
        value = F.col(measure).cast("double")
        risk = F.greatest(F.lit(0.0), 1 - (F.abs(value) if measure == "discrimination" else value)) if measure in complement else value
        rows.append(frame.select(F.lit(benchmark).alias("benchmark"), F.lit(name).alias("diagnostic"), "item_id", F.coalesce(F.round(risk, 9), F.lit(0.0)).alias("score")))
    out = reduce(DataFrame.unionByName, rows)
    return out.withColumn("severity", severity(F.col("score")))


def filtered(issues: DataFrame, types: list[str] | None = None, severities: list[str] | None = None) -> DataFrame:
    """The issues of the named types and severities; none named means all."""
    out = issues if not types else issues.where(F.col("issue_type").isin(*types))
    return out if not severities else out.where(F.col("severity").isin(*severities))


def top(flags: DataFrame, issues: DataFrame, k: int = 50) -> DataFrame:
    """place, item_id, diagnostic, score, has_issue, issue_types of the k largest scores (then diagnostic, then item)."""
    known = issues.groupBy("item_id").agg(F.array_join(F.sort_array(F.collect_set("issue_type")), ",").alias("issue_types"))
    best = flags.orderBy(F.desc("score"), "diagnostic", "item_id").limit(k)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "diagnostic", "item_id")  # k rows
    return best.join(known, "item_id", "left").select(F.row_number().over(w).alias("place"), "item_id", "diagnostic", "score", F.col("issue_types").isNotNull().alias("has_issue"), F.coalesce("issue_types", F.lit("")).alias("issue_types"))


def issue_scores(items: DataFrame) -> DataFrame:
    """item_id, diagnostic, score for issue-specific validation; ``items``: item_id, p, discrimination, n, entropy, bimodal,
    top_share. Disagreement is 4 p (1 - p), low discrimination 1 - clipped discrimination, wrong-key suspicion the share of
    the most chosen option times the share that is wrong."""
    clip = lambda c: F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    measures = {
        "item_disagreement": clip(4 * F.col("p") * (1 - F.col("p"))), "low_discrimination": clip(1 - clip(F.col("discrimination"))), "negative_discrimination": clip(-F.col("discrimination")),
        "option_entropy": clip(F.col("entropy")), "bimodal_choice": clip(F.col("bimodal") * F.col("entropy")), "wrong_key": clip(F.col("top_share") * (1 - F.col("p"))), "difficulty": clip(1 - F.col("p")),
    }
    stack = ", ".join(f"'{n}', `{n}`" for n in measures)
    return items.select("item_id", *[F.round(e, 9).alias(n) for n, e in measures.items()]).selectExpr("item_id", f"stack({len(measures)}, {stack}) as (diagnostic, score)")
