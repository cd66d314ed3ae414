"""The long response matrix: pivots, alignment, means, adequacy. Wide frames exist only as an export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import percentile, ratio


def build(predictions: DataFrame, keys: tuple[str, ...] = ("model_id", "item_id")) -> DataFrame:
    """One score for each key: the mean of its duplicates."""
    return predictions.groupBy(*keys).agg(F.avg("score").alias("score"))


def build_strict(rows: DataFrame, keys: tuple[str, ...] = ("model_id", "subject", "item_id")) -> DataFrame:
    """One score for each key from ``correct`` (null counts as wrong); a repeated key is an error."""
    repeated = rows.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"repeated prediction: {repeated[0].asDict()}")
    return rows.select(*keys, F.coalesce(F.col("correct"), F.lit(False)).cast("double").alias("score"))


def missing_cells(matrix: DataFrame) -> DataFrame:
    """models, items, cells, missing, missing_fraction: one row."""
    return matrix.agg(F.count_distinct("model_id").alias("models"), F.count_distinct("item_id").alias("items"), F.count("score").alias("cells")).withColumns(
        {"missing": F.col("models") * F.col("items") - F.col("cells"), "missing_fraction": 1 - ratio(F.col("cells"), F.col("models") * F.col("items"))}
    )


def align(full: DataFrame, variant: DataFrame) -> DataFrame:
    """Every cell of ``full`` with the variant's score, null where it has none; other cells of the variant go."""
    return full.join(variant.select("model_id", "item_id", F.col("score").alias("variant_score")), ["model_id", "item_id"], "left")


def pivot(matrix: DataFrame, items: list[str]) -> DataFrame:
    """Wide export, models by the named items."""
    return matrix.groupBy("model_id").pivot("item_id", items).agg(F.first("score"))


def unpivot(wide: DataFrame, model: str = "model_id") -> DataFrame:
    """Long form of a wide table; values that are no numbers become null."""
    items = [c for c in wide.columns if c != model]
    texts = wide.select(F.col(model).cast("string").alias("model_id"), *[F.col(f"`{c}`").cast("string").alias(c) for c in items])
    return texts.unpivot("model_id", items, "item_id", "value").select("model_id", "item_id", F.col("value").try_cast("double").alias("score"))


def accuracy(matrix: DataFrame, *by: str) -> DataFrame:
    return matrix.groupBy(*(by or ("model_id",))).agg(F.avg("score").alias("accuracy"))


def item_statistics(matrix: DataFrame) -> DataFrame:
    """item_id, n, p, sd_pop, sd_sample, disagreement p(1-p)."""
    out = matrix.groupBy("item_id").agg(F.count("score").alias("n"), F.avg("score").alias("p"), F.stddev_pop("score").alias("sd_pop"), F.stddev_samp("score").alias("sd_sample"))
    return out.withColumn("disagreement", F.col("p") * (1 - F.col("p")))


def weighted_accuracy(matrix: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum of weight * score over the sum of all weights, whether a cell is there or not; items without one weigh 1."""
    items = matrix.select("item_id").distinct().join(weights, "item_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    total = items.agg(F.sum("weight").alias("_w"))
    got = matrix.join(items, "item_id").groupBy("model_id").agg(F.sum(F.col("weight") * F.coalesce("score", F.lit(0.0))).alias("_s"))
    return got.crossJoin(F.broadcast(total)).select("model_id", (F.col("_s") / F.col("_w")).alias("weighted_accuracy"))


def adequacy(matrix: DataFrame, chance: float = 0.25, margin: float = 0.05) -> DataFrame:
    """Missing cells, spread of ability and share of models near chance: one row."""
    acc = accuracy(matrix)
    spread = acc.agg(F.min("accuracy").alias("lowest"), F.max("accuracy").alias("highest"), percentile("accuracy", 0.1).alias("p10"), percentile("accuracy", 0.9).alias("p90"), F.stddev_pop("accuracy").alias("sd"), F.avg((F.abs(F.col("accuracy") - chance) <= margin).cast("double")).alias("near_chance"))
    return missing_cells(matrix).crossJoin(spread)


def normalized_models(matrix: DataFrame) -> DataFrame:
    """Model ids trimmed and lower-cased; ids that meet are averaged."""
    return matrix.withColumn("model_id", F.lower(F.trim("model_id"))).groupBy("model_id", "item_id").agg(F.avg("score").alias("score"))


def check_binary(matrix: DataFrame) -> list[str]:
    """Why a matrix isn't a binary one of at least two by two, from one aggregate."""
    row = matrix.agg(F.count_distinct("model_id"), F.count_distinct("item_id"), F.count_if(F.col("score").isNotNull() & ~F.col("score").isin(0.0, 1.0)), F.count("*"), F.count_distinct("model_id", "item_id")).first()
    out = [f"fewer than two {what}" for n, what in ((row[0], "models"), (row[1], "items")) if n < 2]
    out += ["values other than 0 and 1"] * bool(row[2]) + ["repeated cells"] * (row[3] != row[4])
    return out
