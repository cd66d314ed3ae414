"""How findings carry over between benchmarks: families, held-out families, overlap, conclusions and their gates.

``panels`` is long: benchmark, model_id, accuracy (one row for each benchmark and model, rounded to 12 places)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import adjusted, kendall, percentile, spearman

# The ladder of conclusions.
SUPPORTED, PARTIAL, SPECIFIC_RANGE = 0.70, 0.35, 0.40


def pairs(panels: DataFrame, key: str = "model_id") -> DataFrame:
    """benchmark_a, benchmark_b, key, x, y for every two benchmarks over the keys of both."""
    a, b = panels.alias("a"), panels.alias("b")
    met = a.join(b, F.expr(f"a.{key} = b.{key} and a.benchmark < b.benchmark"))
    return met.select(F.col("a.benchmark").alias("benchmark_a"), F.col("b.benchmark").alias("benchmark_b"), F.col(f"a.{key}").alias(key), F.col("a.accuracy").alias("x"), F.col("b.accuracy").alias("y"))


def overlap(panels: DataFrame) -> DataFrame:
    """benchmark_a, benchmark_b, models_a, models_b, overlap: how many models both have."""
    n = panels.groupBy("benchmark").agg(F.count_distinct("model_id").alias("n"))
    a, b = n.alias("a"), n.alias("b")
    every = a.join(b, F.expr("a.benchmark < b.benchmark")).select(F.col("a.benchmark").alias("benchmark_a"), F.col("b.benchmark").alias("benchmark_b"), F.col("a.n").alias("models_a"), F.col("b.n").alias("models_b"))
    both = pairs(panels).groupBy("benchmark_a", "benchmark_b").agg(F.count("*").alias("overlap"))
    return every.join(both, ["benchmark_a", "benchmark_b"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))


def family_transfer(panels: DataFrame, families: DataFrame, least: int = 5) -> DataFrame:
    """benchmark_a, benchmark_b, families, spearman, tau_b, underpowered: families' mean accuracies, so that many models
    of one family count once."""
    means = panels.join(families, "model_id").groupBy("benchmark", "family").agg(F.round(F.avg("accuracy"), 12).alias("accuracy"))
    p, by = pairs(means, "family"), ["benchmark_a", "benchmark_b"]
    out = spearman(p, "x", "y", by).withColumnRenamed("n", "families").join(kendall(p, "x", "y", "family", by).drop("gamma"), by)
    return out.withColumn("underpowered", F.col("families") < least)


def without_family(panels: DataFrame, families: DataFrame, least: int = 20) -> DataFrame:
    """benchmark_a, benchmark_b, excluded_family, models, spearman, underpowered: rank agreement without each family."""
    p = pairs(panels).join(families, "model_id")
    left_out = families.select(F.col("family").alias("excluded_family")).distinct()
    rest = p.join(left_out, F.col("family") != F.col("excluded_family"))
    out = spearman(rest, "x", "y", ["benchmark_a", "benchmark_b", "excluded_family"]).withColumnRenamed("n", "models")
    return out.withColumn("underpowered", F.col("models") < least)


def with_adjusted(rows: DataFrame, p: str, key: str, method: str = "bh") -> DataFrame:
    """Adds adjusted_p over the rows whose p is known; the others keep null."""
    known = adjusted(rows.where(F.col(p).isNotNull()), p, key).select(key, F.col(method).alias("adjusted_p"))
    return rows.join(known, key, "left")


def conclusion(rows: DataFrame, models: int, least: int = 5) -> DataFrame:
    """correlations, median, range, conclusion from rank correlations (``spearman``) of benchmark pairs: one row."""
    s = rows.agg(F.count("spearman").alias("correlations"), percentile("spearman", 0.5).alias("median"), (F.max("spearman") - F.min("spearman")).alias("range"))
    text = F.when(F.lit(models < least), "UNDERPOWERED").when(F.col("correlations") == 0, "BLOCKED").when((F.col("correlations") > 1) & (F.col("range") >= SPECIFIC_RANGE), "TRANSFER_BENCHMARK_SPECIFIC")
    return s.withColumn("conclusion", text.when(F.col("median") >= SUPPORTED, "TRANSFER_SUPPORTED").when(F.col("median") >= PARTIAL, "TRANSFER_PARTIAL").otherwise("TRANSFER_NOT_SUPPORTED"))


def disagreement(matrices: DataFrame) -> DataFrame:
    """benchmark_a, benchmark_b, value_a, value_b, delta of the mean p(1 - p) of items; ``matrices`` has benchmark."""
    items = matrices.groupBy("benchmark", "item_id").agg(F.avg("score").alias("p"))
    v = items.groupBy("benchmark").agg(F.avg(F.col("p") * (1 - F.col("p"))).alias("v"))
    a, b = v.alias("a"), v.alias("b")
    return a.join(b, F.expr("a.benchmark < b.benchmark")).select(F.col("a.benchmark").alias("benchmark_a"), F.col("b.benchmark").alias("benchmark_b"), F.col("a.v").alias("value_a"), F.col("b.v").alias("value_b"), F.abs(F.expr("a.v - b.v")).alias("delta"))


def gates(panels: DataFrame, families: DataFrame, least_models: int = 5, least_families: int = 3) -> DataFrame:
    """gate, value, passed: what an analysis across benchmarks needs; it is blocked unless all pass."""
    benchmarks = panels.agg(F.count_distinct("benchmark").alias("n"))
    common = panels.join(benchmarks, F.lit(True)).groupBy("model_id", "n").agg(F.count_distinct("benchmark").alias("c")).where("c = n").select("model_id")
    mapped = common.join(families, "model_id", "left")
    one = mapped.agg(F.count_distinct("model_id").alias("common_models"), F.count_distinct("family").alias("common_families"), F.count_if(F.col("family").isNull()).alias("unmapped")).crossJoin(benchmarks)
    rows = one.selectExpr("stack(4, 'benchmarks', n, 'common_models', common_models, 'common_families', common_families, 'unmapped_models', unmapped) as (gate, value)")
    need = F.when(F.col("gate") == "benchmarks", F.col("value") >= 2).when(F.col("gate") == "common_models", F.col("value") >= least_models).when(F.col("gate") == "common_families", F.col("value") >= least_families)
    return rows.withColumn("passed", need.otherwise(F.col("value") == 0))


def analysis(panels: DataFrame, families: DataFrame, least_models: int = 5) -> dict[str, DataFrame]:
    """All tables of an analysis across benchmarks; raises with the gates that fail, before anything is computed."""
    failed = [r["gate"] for r in gates(panels, families, least_models).where("not passed").collect()]
    if failed:
        raise ValueError(f"blocked: {', '.join(sorted(failed))}")
    rank = spearman(pairs(panels), "x", "y", ["benchmark_a", "benchmark_b"])
    models = panels.select("model_id").distinct().count()
    return {"overlap": overlap(panels), "rank_transfer": rank, "family_transfer": family_transfer(panels, families), "without_family": without_family(panels, families), "conclusion": conclusion(rank, models, least_models)}
