"""Metrics of scores against 0/1 truth: thresholds, curves, calibration, top-k, empirical nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.stats import average_precision, percentile, ratio, roc_auc


def confusion(rows: DataFrame, threshold: Column | float, by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn and the rates at score >= threshold; a rate without cases is null."""
    flag, pos = F.col("score") >= threshold, F.col("y") == 1
    c = rows.groupBy(*(by or [])).agg(F.count_if(flag & pos).alias("tp"), F.count_if(flag & ~pos).alias("fp"), F.count_if(~flag & ~pos).alias("tn"), F.count_if(~flag & pos).alias("fn"))
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    return c.withColumns({"sensitivity": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "fpr": ratio(fp, tn + fp), "fnr": ratio(fn, tp + fn), "precision": ratio(tp, tp + fp), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def bundle(rows: DataFrame, by: list[str]) -> DataFrame:
    """Threshold at the median of the group, its confusion, auc and ap."""
    cut = rows.groupBy(*by).agg(percentile("score", 0.5).alias("threshold"))
    at = confusion(rows.join(F.broadcast(cut), by), F.col("threshold"), [*by, "threshold"])
    return at.join(roc_auc(rows, "y", "score", by), by).join(average_precision(rows, "y", "score", "doc_id", by), by)


def calibration_curve(rows: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mid, mean_score, rate: equal widths between the least and the largest score; empty bins have n = 0."""
    ends = rows.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    r = rows.crossJoin(F.broadcast(ends))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("score") - F.col("lo")) / width), F.lit(bins - 1)))
    got = r.groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg((F.col("y") == 1).cast("double")).alias("rate"))
    grid = rows.sparkSession.range(bins).withColumnRenamed("id", "bin").crossJoin(F.broadcast(ends))
    return grid.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), (F.col("lo") + (F.col("bin") + 0.5) * width).alias("mid"), "mean_score", "rate")


def calibration_error(rows: DataFrame, confidence: str, correct: str, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """n, ece (bins of [0, 1], the last one closed), brier, nll (clipped at 1e-8), overconfidence."""
    by = by or []
    c, y = F.col(confidence), F.col(correct)
    clip = F.greatest(F.least(c, F.lit(1 - 1e-8)), F.lit(1e-8))
    per = rows.withColumn("_b", F.least(F.floor(c * bins), F.lit(bins - 1))).groupBy(*by, "_b").agg(
        F.count("*").alias("_n"), F.sum(y).alias("_y"), F.sum(c).alias("_c"), F.sum(F.pow(c - y, F.lit(2))).alias("_q"), F.sum(-(y * F.log(clip) + (1 - y) * F.log(1 - clip))).alias("_l")
    )
    n = F.sum("_n")
    return per.groupBy(*by).agg(n.alias("n"), (F.sum(F.abs(F.col("_y") - F.col("_c"))) / n).alias("ece"), (F.sum("_q") / n).alias("brier"), (F.sum("_l") / n).alias("nll"), (F.sum("_c") / n - F.sum("_y") / n).alias("overconfidence"))


def abstention(rows: DataFrame) -> DataFrame:
    """coverage, selective_risk, inappropriate refusals and answers, and coverage * (1 - risk): one row.

    ``rows``: answered (boolean), correct (0/1), answerable (boolean)."""
    n, a = F.count("*"), F.count_if(F.col("answered"))
    risk = F.avg(F.when(F.col("answered"), 1 - F.col("correct")))
    return rows.agg((a / n).alias("coverage"), risk.alias("selective_risk"), ratio(F.count_if(~F.col("answered") & F.col("answerable")), F.count_if(~F.col("answered"))).alias("inappropriate_refusal"), ratio(F.count_if(F.col("answered") & ~F.col("answerable")), a).alias("inappropriate_answer"), (a / n * (1 - F.coalesce(risk, F.lit(0.0)))).alias("risk_coverage"))


def at_k(rows: DataFrame, ks: tuple[int, ...], by: list[str]) -> DataFrame:
    """k, hits, precision, recall, enrichment among the k largest scores (then subject, then id)."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.desc("score"), "subject", "doc_id")
    r = rows.withColumn("_k", F.row_number().over(w)).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    hit = (F.col("y") == 1).cast("int")
    g = r.groupBy(*by, "k").agg(F.sum(F.when(F.col("_k") <= F.col("k"), hit)).alias("hits"), F.count_if(F.col("_k") <= F.col("k")).alias("_n"), F.sum(hit).alias("_p"), F.count("*").alias("_all"))
    precision = F.col("hits") / F.col("_n")
    return g.select(*by, "k", "hits", precision.alias("precision"), ratio(F.col("hits"), F.col("_p")).alias("recall"), ratio(precision, F.col("_p") / F.col("_all")).alias("enrichment"))


def empirical_p(scores: DataFrame, null: DataFrame, key: str) -> DataFrame:
    """key, p, null_percentile: (1 + null >= score) / (n + 1), and the share of null <= score.

    Scores and null values are sorted together once; a running count replaces a pair for each score and null value.
    """
    both = scores.select(key, F.col("score").alias("v"), F.lit(1).alias("_s"), F.lit(0).alias("_c")).unionByName(null.select(F.lit(None).cast(dict(scores.dtypes)[key]).alias(key), F.col("score").alias("v"), F.lit(0).alias("_s"), F.lit(1).alias("_c")))
    values = both.groupBy("v").agg(F.sum("_c").alias("c"))
    run = values.select("v", "c", F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("below"), F.sum("c").over(Window.partitionBy(F.lit(0))).alias("total"))
    out = scores.join(run, scores["score"] == run["v"])
    return out.select(key, ((1 + F.col("total") - F.col("below") + F.col("c")) / (F.col("total") + 1)).alias("p"), ratio(F.col("below"), F.col("total")).alias("null_percentile"))


def threshold_at_fpr(rows: DataFrame, fpr: float) -> DataFrame:
    """The score that a share ``fpr`` of clean rows exceed: one row."""
    return rows.where("y <> 1").agg(percentile("score", 1 - fpr).alias("threshold"))


def zscores(rows: DataFrame, by: str) -> DataFrame:
    """Adds z: (score - mean) / population deviation of the group; 0 without deviation."""
    w = Window.partitionBy(by)
    sd = F.stddev_pop("score").over(w)
    return rows.withColumn("z", F.when(sd > 0, (F.col("score") - F.avg("score").over(w)) / sd).otherwise(0.0))


def summary(rows: DataFrame, value: str) -> DataFrame:
    """n, mean, sd, least, largest, p95, p99: one row."""
    return rows.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("largest"), percentile(value, 0.95).alias("p95"), percentile(value, 0.99).alias("p99"))


def effect_sizes(rows: DataFrame) -> DataFrame:
    """cohens_d (null below two a group; 0 without deviation), risk_ratio of score >= median (null without risk below)."""
    cut = rows.agg(percentile("score", 0.5).alias("cut"))
    rows = rows.crossJoin(F.broadcast(cut))  # one row
    g = rows.groupBy((F.col("y") == 1).alias("p")).agg(F.count("*").alias("n"), F.avg("score").alias("m"), F.var_samp("score").alias("v"), F.avg((F.col("score") >= F.col("cut")).cast("double")).alias("r"))
    s = g.agg(*[F.max(F.when(F.col("p") if x == "p" else ~F.col("p"), F.col(c))).alias(f"{c}{x}") for x in "pq" for c in ("n", "m", "v", "r")])
    pooled = F.sqrt(((F.col("np") - 1) * F.col("vp") + (F.col("nq") - 1) * F.col("vq")) / (F.col("np") + F.col("nq") - 2))
    return s.select(F.when((F.col("np") >= 2) & (F.col("nq") >= 2), F.when(pooled == 0, 0.0).otherwise((F.col("mp") - F.col("mq")) / pooled)).alias("cohens_d"), F.when(F.col("rq") > 0, F.col("rp") / F.col("rq")).alias("risk_ratio"))
