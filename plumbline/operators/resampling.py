"""Resampling with the portable hash generator: bootstraps, permutations, null models.

Replicates are a dimension of the plan. A bootstrap draws places, counts them to weights for each replicate and
unit, and aggregates score * weight; the fact table is never repeated once for each drawn row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.ranks import average_rank, place
from plumbline.functions.rng import uniform
from plumbline.functions.stats import pearson, percentile
from plumbline.functions.text import expit, logit


def replicates(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("replicate"))


def weights(units: DataFrame, unit: str, n: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """by..., replicate, unit, weight: how often a bootstrap of the units (within ``by``) drew it; zero rows are left out."""
    by = by or []
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    units = units.select(*by, unit).distinct().withColumns({"_i": F.row_number().over(w.orderBy(unit)), "_n": F.count("*").over(w)})
    drawn = units.crossJoin(F.broadcast(replicates(units, n)))
    drawn = drawn.select(*by, "replicate", (F.floor(uniform(seed, "replicate", *by, "_i") * F.col("_n")) + 1).cast("int").alias("_i"))
    counts = drawn.groupBy(*by, "replicate", "_i").agg(F.count("*").alias("weight"))
    return counts.join(units.select(*by, unit, "_i"), [*by, "_i"]).drop("_i")


def accuracy_ci(matrix: DataFrame, n: int, seed: int) -> DataFrame:
    """model_id, low, mid, high: 95 % percentile interval of accuracy over resampled items."""
    w = weights(matrix, "item_id", n, seed)
    acc = matrix.join(w, "item_id").groupBy("replicate", "model_id").agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("a"))
    q = F.percentile("a", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return acc.groupBy("model_id").agg(q.alias("q")).select("model_id", F.col("q")[0].alias("low"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("high"))


def subject_rank_replicates(matrix: DataFrame, n: int, seed: int) -> DataFrame:
    """replicate, subject, model_id, rank (ties averaged): items resampled within their subject."""
    w = weights(matrix, "item_id", n, seed, ["subject"])
    acc = matrix.join(w, ["subject", "item_id"]).groupBy("replicate", "subject", "model_id").agg(F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 12).alias("a"))
    return acc.withColumn("rank", average_rank("a", ["replicate", "subject"])).drop("a")


def rank_confidence(ranks: DataFrame) -> DataFrame:
    """model_id, subject, low, mid, high of the rank."""
    q = F.percentile("rank", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return ranks.groupBy("model_id", "subject").agg(q.alias("q")).select("model_id", "subject", F.col("q")[0].alias("low"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("high"))


def outranking(ranks: DataFrame) -> DataFrame:
    """subject, model_a, model_b, p: chance that a ranks before b, ties half."""
    a, b = ranks.alias("a"), ranks.alias("b")
    met = a.join(b, F.expr("a.replicate = b.replicate and a.subject = b.subject and a.model_id <> b.model_id"))
    win = F.expr("case when a.rank < b.rank then 1.0D when a.rank = b.rank then 0.5D else 0.0D end")
    return met.groupBy(F.col("a.subject").alias("subject"), F.col("a.model_id").alias("model_a"), F.col("b.model_id").alias("model_b")).agg(F.avg(win).alias("p"))


def top_k_membership(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    return ranks.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).groupBy("model_id", "subject", "k").agg(F.avg((F.col("rank") <= F.col("k")).cast("double")).alias("p"))


def composition_ranks(matrix: DataFrame, n: int, seed: int) -> DataFrame:
    """model_id, low, mid, high of the rank when whole subjects are resampled."""
    sa = matrix.groupBy("model_id", "subject").agg(F.avg("score").alias("a"))
    w = weights(sa, "subject", n, seed)
    acc = sa.join(F.broadcast(w), "subject").groupBy("replicate", "model_id").agg(F.round(F.sum(F.col("a") * F.col("weight")) / F.sum("weight"), 12).alias("a"))
    return rank_confidence(acc.withColumn("rank", average_rank("a", ["replicate"])).withColumn("subject", F.lit("all"))).drop("subject")


def ranking_uncertainty(matrix: DataFrame, n: int, seed: int, k: int = 3) -> DataFrame:
    """model_id, full_rank, mean_rank, top_k share, flipped (the two ranks are a place or more apart)."""
    w = weights(matrix, "item_id", n, seed)
    acc = matrix.join(w, "item_id").groupBy("replicate", "model_id").agg(F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 12).alias("a"))
    r = acc.withColumn("r", place("a", ["replicate"], F.col("model_id").desc()))
    full = matrix.groupBy("model_id").agg(F.round(F.avg("score"), 12).alias("a")).withColumn("full_rank", place("a", [], F.col("model_id").desc()).cast("long")).select("model_id", "full_rank")
    out = r.groupBy("model_id").agg(F.avg("r").alias("mean_rank"), F.avg((F.col("r") <= k).cast("double")).alias("top_k")).join(full, "model_id")
    return out.withColumn("flipped", F.abs(F.col("full_rank") - F.col("mean_rank")) >= 1)


def paired_difference(matrix: DataFrame, n: int, seed: int) -> DataFrame:
    """model_a, model_b, difference, low, high of the mean item difference over resampled items."""
    w = weights(matrix, "item_id", n, seed)
    a, b = matrix.alias("a"), matrix.alias("b")
    d = a.join(b, F.expr("a.item_id = b.item_id and a.model_id < b.model_id")).select(F.col("a.model_id").alias("model_a"), F.col("b.model_id").alias("model_b"), F.col("a.item_id").alias("item_id"), F.expr("a.score - b.score").alias("d"))
    means = d.groupBy("model_a", "model_b").agg(F.avg("d").alias("difference"))
    reps = d.join(w, "item_id").groupBy("model_a", "model_b", "replicate").agg((F.sum(F.col("d") * F.col("weight")) / F.sum("weight")).alias("d"))
    q = reps.groupBy("model_a", "model_b").agg(percentile("d", 0.025).alias("low"), percentile("d", 0.975).alias("high"))
    return means.join(q, ["model_a", "model_b"])


def family_bootstrap(matrix: DataFrame, families: DataFrame, n: int, seed: int) -> DataFrame:
    """family, low, mid, high of the family's rank when each replicate picks one model of each family."""
    acc = matrix.groupBy("model_id").agg(F.round(F.avg("score"), 12).alias("a")).join(families, "model_id")
    drawn = acc.crossJoin(F.broadcast(replicates(acc, n)))
    drawn = drawn.withColumn("k", F.row_number().over(Window.partitionBy("replicate", "family").orderBy(uniform(seed, "replicate", "model_id"), "model_id"))).where("k = 1")
    ranks = drawn.withColumn("rank", average_rank("a", ["replicate"])).select(F.col("family").alias("model_id"), F.lit("all").alias("subject"), "rank")
    return rank_confidence(ranks).drop("subject").withColumnRenamed("model_id", "family")


def permutation_p(pairs: DataFrame, n: int, seed: int) -> DataFrame:
    """observed, p: two-sided add-one p of Pearson's correlation of x and y over permutations of y by ``key``: one row."""
    base = pairs.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("key"))).select("key", "i", "x", "y")
    grid = base.crossJoin(F.broadcast(replicates(base, n)))
    moved = grid.select("replicate", "y", F.row_number().over(Window.partitionBy("replicate").orderBy(uniform(seed, "replicate", "key"), "key")).alias("i"))
    rho = grid.select("replicate", "i", "x").join(moved, ["replicate", "i"]).groupBy("replicate").agg(pearson("x", "y").alias("r"))
    seen = base.agg(pearson("x", "y").alias("observed"))
    both = rho.crossJoin(F.broadcast(seen))
    return both.groupBy("observed").agg(((1 + F.count_if(F.round(F.abs("r"), 9) >= F.round(F.abs(F.col("observed")), 9))) / (F.count("*") + 1)).alias("p"))


def additive_probabilities(matrix: DataFrame, smooth: float = 0.5) -> DataFrame:
    """model_id, item_id, p: logits of model and item shares (smoothed) around the grand logit."""
    def share(by: list[str]) -> Column:
        n, s = F.count("score"), F.sum("score")
        return logit((s + smooth) / (n + 2 * smooth), 1e-8)

    m = matrix.groupBy("model_id").agg(share(["model_id"]).alias("_m"))
    i = matrix.groupBy("item_id").agg(share(["item_id"]).alias("_i"))
    g = matrix.agg(share([]).alias("_g"))
    return matrix.select("model_id", "item_id", "subject").join(m, "model_id").join(i, "item_id").crossJoin(F.broadcast(g)).select("model_id", "item_id", "subject", expit(F.col("_m") + F.col("_i") - F.col("_g")).alias("p"))


def empirical_bayes_probabilities(matrix: DataFrame, strength: float = 20.0) -> DataFrame:
    """model_id, subject, p: subject share shrunk to the model's own by n / (n + strength)."""
    s = matrix.groupBy("model_id", "subject").agg(F.count("score").alias("n"), F.avg("score").alias("a"))
    m = matrix.groupBy("model_id").agg(F.avg("score").alias("g"))
    w = F.col("n") / (F.col("n") + strength)
    return s.join(m, "model_id").select("model_id", "subject", (w * F.col("a") + (1 - w) * F.col("g")).alias("p"))


def sample_null(probabilities: DataFrame, n: int, seed: int) -> DataFrame:
    """replicate, model_id, item_id, subject, score: independent draws where the panel has a cell."""
    return probabilities.crossJoin(F.broadcast(replicates(probabilities, n))).withColumn("score", (uniform(seed, "replicate", "model_id", "item_id") < F.col("p")).cast("double")).drop("p")


def permuted_null(matrix: DataFrame, n: int, seed: int) -> DataFrame:
    """replicate, model_id, item_id, subject, score: each model's scores permuted over its items; totals stay."""
    base = matrix.withColumn("i", F.row_number().over(Window.partitionBy("model_id").orderBy("item_id")))
    grid = base.crossJoin(F.broadcast(replicates(base, n)))
    moved = grid.select("replicate", "model_id", "score", F.row_number().over(Window.partitionBy("replicate", "model_id").orderBy(uniform(seed, "replicate", "model_id", "item_id"), "item_id")).alias("i"))
    return grid.drop("score").join(moved, ["replicate", "model_id", "i"]).drop("i")


def rank_range_null(null: DataFrame) -> DataFrame:
    """replicate, median_range, mean_range, max_range of models' average subject ranks."""
    acc = null.groupBy("replicate", "model_id", "subject").agg(F.avg("score").alias("a"))
    r = acc.withColumn("r", average_rank("a", ["replicate", "subject"])).groupBy("replicate", "model_id").agg((F.max("r") - F.min("r")).alias("rr"))
    return r.groupBy("replicate").agg(percentile("rr", 0.5).alias("median_range"), F.avg("rr").alias("mean_range"), F.max("rr").alias("max_range"))


def exceedance(matrix: DataFrame, null_ranges: DataFrame) -> DataFrame:
    """statistic, observed, p: add-one share of null replicates at or above the observed rank ranges."""
    seen = rank_range_null(matrix.withColumn("replicate", F.lit(0))).drop("replicate")
    names = ("median_range", "mean_range", "max_range")
    wide = null_ranges.select(*[F.round(c, 9).alias(c) for c in names]).crossJoin(F.broadcast(seen.select(*[F.round(c, 9).alias(f"o_{c}") for c in names])))
    parts = [wide.agg(F.lit(c).alias("statistic"), F.max(f"o_{c}").alias("observed"), ((1 + F.count_if(F.col(c) >= F.col(f"o_{c}"))) / (F.count("*") + 1)).alias("p")) for c in names]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def matched_null(rows: DataFrame, k: int, n: int, seed: int) -> DataFrame:
    """replicate, precision: of subject-matched draws of non-positives in the positives' numbers, the share within the k best scores."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "subject", "doc_id")
    r = rows.withColumn("rk", F.row_number().over(w))
    need = r.where("y = 1").groupBy("subject").agg(F.count("*").alias("need"))
    pool = r.where("y <> 1").join(need, "subject").crossJoin(F.broadcast(replicates(r, n)))
    drawn = pool.withColumn("d", F.row_number().over(Window.partitionBy("replicate", "subject").orderBy(uniform(seed, "replicate", "doc_id"), "doc_id"))).where("d <= need")
    return drawn.groupBy("replicate").agg((F.count_if(F.col("rk") <= k) / F.lit(float(k))).alias("precision"))


def baseline_iterations(matrix: DataFrame, n: int, seed: int) -> DataFrame:
    """replicate, spearman, top5, max_delta, mean_delta: rankings on resampled items against the full one (ties share the first place)."""
    w = weights(matrix, "item_id", n, seed)
    acc = matrix.join(w, "item_id").groupBy("replicate", "model_id").agg(F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight"), 12).alias("a"))
    full = matrix.groupBy("model_id").agg(F.round(F.avg("score"), 12).alias("f"))
    r = acc.withColumns({"r": F.rank().over(Window.partitionBy("replicate").orderBy(F.desc("a"))), "ra": average_rank("a", ["replicate"])})
    f = full.withColumns({"fr": F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("f"))), "fa": average_rank("f", [])})
    both = r.join(F.broadcast(f), "model_id")
    return both.groupBy("replicate").agg(pearson("ra", "fa").alias("spearman"), (F.count_if((F.col("r") <= 5) & (F.col("fr") <= 5)) / F.lit(5.0)).alias("top5"), F.max(F.abs(F.col("r") - F.col("fr"))).alias("max_delta"), F.avg(F.abs(F.col("r") - F.col("fr"))).alias("mean_delta"))


def truncated_ci(values: DataFrame, value: str, quantiles: tuple[float, ...] = (0.025, 0.975)) -> DataFrame:
    """The values at places floor(q * (n - 1)), without interpolation: low, high: one row."""
    s = values.withColumns({"_i": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(value)) - 1, "_n": F.count("*").over(Window.partitionBy(F.lit(0)))})
    at = [F.max(F.when(F.col("_i") == F.floor(F.lit(q) * (F.col("_n") - 1)), F.col(value))) for q in quantiles]
    return s.agg(at[0].alias("low"), at[1].alias("high"))


def agreement_bootstrap(labels: DataFrame, n: int, seed: int) -> DataFrame:
    """low, high of raw agreement over resampled tasks, by truncated places: one row."""
    tasks = labels.groupBy("task_id", "label").agg(F.count("*").alias("c")).groupBy("task_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).where("n > 1")
    w = weights(tasks, "task_id", n, seed)
    reps = tasks.join(w, "task_id").groupBy("replicate").agg((F.sum(F.col("same") * F.col("weight")) / F.sum(F.col("n") * (F.col("n") - 1) * F.col("weight"))).alias("a"))
    return truncated_ci(reps, "a")


def _interval(reps: DataFrame, value: str) -> DataFrame:
    return reps.agg(percentile(value, 0.025).alias("low"), percentile(value, 0.5).alias("mid"), percentile(value, 0.975).alias("high"))


def mean_ci(rows: DataFrame, unit: str, value: str, n: int, seed: int) -> DataFrame:
    """low, mid, high of the mean of ``value`` over resampled units: one row."""
    reps = rows.join(weights(rows, unit, n, seed), unit).groupBy("replicate").agg((F.sum(F.col(value) * F.col("weight")) / F.sum("weight")).alias("m"))
    return _interval(reps, "m")


def auc_ci(rows: DataFrame, unit: str, n: int, seed: int) -> DataFrame:
    """low, mid, high of the area under the curve over resampled rows (y, score): weighted rank sums, so that no drawn row is
    repeated: one row."""
    w = rows.join(weights(rows, unit, n, seed), unit)
    upto = F.sum("weight").over(Window.partitionBy("replicate").orderBy("score").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    r = w.withColumn("_r", upto - (F.sum("weight").over(Window.partitionBy("replicate", "score")) - 1) / 2.0)
    pos, neg = F.sum(F.when(F.col("y") == 1, F.col("weight"))), F.sum(F.when(F.col("y") != 1, F.col("weight")))
    top = F.sum(F.when(F.col("y") == 1, F.col("weight") * F.col("_r")))
    return _interval(r.groupBy("replicate").agg(F.try_divide(top - pos * (pos + 1) / 2.0, pos * neg).alias("auc")), "auc")
