"""Rankings, their agreement, and their stability over subjects, families and held-out parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.ranks import average_rank, min_rank, place
from plumbline.functions.stats import ratio, spearman
from plumbline.operators.matrix import accuracy


def level(matrix: DataFrame, *by: str) -> DataFrame:
    """Accuracies rounded to 12 places, so that ties don't depend on the order in which cells were added up."""
    return accuracy(matrix, *by).withColumn("accuracy", F.round("accuracy", 12))


def ranked(scores: DataFrame, value: str = "accuracy", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds rank_average, rank_min, and rank_place (ties by falling id)."""
    by = list(by)
    return scores.withColumns({"rank_average": average_rank(value, by), "rank_min": min_rank(value, by).cast("long"), "rank_place": place(value, by, F.col("model_id").desc()).cast("long")})


def compare(a: DataFrame, b: DataFrame, value: str = "accuracy") -> DataFrame:
    """model_id, rank_a, rank_b, delta over the models of both."""
    x = ranked(a, value).select("model_id", F.col("rank_place").alias("rank_a"))
    y = ranked(b, value).select("model_id", F.col("rank_place").alias("rank_b"))
    return x.join(y, "model_id").withColumn("delta", F.col("rank_b") - F.col("rank_a"))


def subject_ranks(matrix: DataFrame) -> DataFrame:
    """model_id, subject, accuracy and its ranks within the subject."""
    return ranked(level(matrix, "model_id", "subject"), by=("subject",))


def subject_instability(matrix: DataFrame) -> DataFrame:
    """Of each model the range, spread and distance from the overall rank of its subject ranks (ties share the first)."""
    full = ranked(level(matrix)).select("model_id", F.col("rank_min").alias("full_rank"))
    by = subject_ranks(matrix).join(full, "model_id").withColumn("delta", F.abs(F.col("rank_min") - F.col("full_rank")))
    return by.groupBy("model_id", "full_rank").agg(
        F.count("*").alias("subjects"), F.min("rank_min").alias("best_rank"), F.max("rank_min").alias("worst_rank"), (F.max("rank_min") - F.min("rank_min")).alias("rank_range"),
        F.stddev_pop("rank_min").alias("rank_sd"), F.avg("delta").alias("mean_delta"), F.max("delta").alias("max_delta"),
    )


def rank_ranges(matrix: DataFrame) -> DataFrame:
    """Range, normalised range, spread of accuracy and normalised entropy of average subject ranks."""
    ranks = subject_ranks(matrix)
    n = ranks.agg(F.count_distinct("model_id").alias("models"))
    p = ranks.groupBy("model_id", "rank_average").agg(F.count("*").alias("c"))
    w = Window.partitionBy("model_id")
    entropy = p.withColumn("q", F.col("c") / F.sum("c").over(w)).groupBy("model_id").agg((-F.sum(F.col("q") * F.log("q"))).alias("h"), F.sum("c").alias("s"))
    base = ranks.groupBy("model_id").agg((F.max("rank_average") - F.min("rank_average")).alias("rank_range"), F.stddev_pop("accuracy").alias("accuracy_sd"))
    out = base.join(entropy, "model_id").crossJoin(F.broadcast(n))
    return out.select("model_id", "rank_range", ratio(F.col("rank_range"), F.col("models") - 1).alias("normalized_range"), "accuracy_sd", (F.col("h") / F.log(F.greatest(F.least("models", "s"), F.lit(2)))).alias("rank_entropy"))


def kendalls_w(matrix: DataFrame) -> DataFrame:
    """Concordance of subjects' rankings, corrected for ties, within 0 and 1: one row."""
    ranks = subject_ranks(matrix)
    sums = ranks.groupBy("model_id").agg(F.sum("rank_average").alias("s")).agg(F.count("*").alias("n"), F.var_pop("s").alias("v"))
    ties = ranks.groupBy("subject", "rank_average").agg(F.count("*").alias("c")).agg(F.sum(F.pow("c", F.lit(3)) - F.col("c")).alias("t"), F.count_distinct("subject").alias("m"))
    n, m = F.col("n"), F.col("m")
    w = ratio(12 * n * F.col("v"), m * m * (n * n * n - n) - m * F.col("t"))
    return sums.crossJoin(ties).select(F.greatest(F.least(w, F.lit(1.0)), F.lit(0.0)).alias("w"), m.alias("subjects"), n.alias("models"))


def top_k_jaccard(matrix: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """k, subject_a, subject_b, jaccard of their models of rank <= k, ties at the edge included; nothing above is 1."""
    ranks = subject_ranks(matrix).select("model_id", "subject", "rank_average").withColumn("k", F.explode(F.array(*map(F.lit, ks)))).withColumn("top", F.col("rank_average") <= F.col("k"))
    a, b = ranks.alias("a"), ranks.alias("b")
    pairs = a.join(b, F.expr("a.k = b.k and a.model_id = b.model_id and a.subject < b.subject"), "inner")
    both, either = F.count_if(F.expr("a.top and b.top")), F.count_if(F.expr("a.top or b.top"))
    return pairs.groupBy(F.col("a.k").alias("k"), F.col("a.subject").alias("subject_a"), F.col("b.subject").alias("subject_b")).agg(F.when(either == 0, 1.0).otherwise(both / either).alias("jaccard"))


def effect_reversals(matrix: DataFrame, least: float = 0.01) -> DataFrame:
    """Model pairs and subject pairs whose accuracy difference changes sign, both at least ``least``."""
    acc = level(matrix, "model_id", "subject")
    a, b = acc.alias("a"), acc.alias("b")
    d = a.join(b, F.expr("a.subject = b.subject and a.model_id < b.model_id")).select(F.col("a.model_id").alias("model_a"), F.col("b.model_id").alias("model_b"), F.col("a.subject").alias("subject"), (F.col("a.accuracy") - F.col("b.accuracy")).alias("d")).where(F.abs("d") >= least)
    x, y = d.alias("x"), d.alias("y")
    return x.join(y, F.expr("x.model_a = y.model_a and x.model_b = y.model_b and x.subject < y.subject and x.d * y.d < 0")).groupBy(F.col("x.model_a").alias("model_a"), F.col("x.model_b").alias("model_b")).agg(F.count("*").alias("reversals"))


def leave_one_out(matrix: DataFrame, column: str) -> DataFrame:
    """left_out, spearman, max_change: rankings without one value of ``column`` against the full one.

    Sums are taken once for each (model, value) and subtracted, so no value is scanned again for each one left out.
    """
    cells = matrix.groupBy("model_id", column).agg(F.sum("score").alias("s"), F.count("score").alias("c"))
    total = cells.groupBy("model_id").agg(F.sum("s").alias("ts"), F.sum("c").alias("tc"))
    out = cells.select(F.col(column).alias("left_out")).distinct()
    grid = total.crossJoin(F.broadcast(out)).join(cells.withColumnRenamed(column, "left_out"), ["model_id", "left_out"], "left")
    rest = grid.select("left_out", "model_id", ratio(F.col("ts") - F.coalesce("s", F.lit(0.0)), F.col("tc") - F.coalesce("c", F.lit(0))).alias("accuracy")).withColumn("accuracy", F.round("accuracy", 12))
    full = ranked(total.select("model_id", F.round(F.col("ts") / F.col("tc"), 12).alias("accuracy"))).select("model_id", F.col("rank_average").alias("full_rank"))
    ranks = ranked(rest, by=("left_out",)).join(full, "model_id")
    rho = spearman(ranks, "rank_average", "full_rank", ["left_out"]).drop("n")
    return ranks.groupBy("left_out").agg(F.max(F.abs(F.col("rank_average") - F.col("full_rank"))).alias("max_change")).join(rho, "left_out")


def leave_one_family_out(matrix: DataFrame, families: DataFrame) -> DataFrame:
    """family, models, spearman, max_change: full ranks of the other families' models against ranks among themselves;
    under two models left the row is marked blocked."""
    acc = accuracy(matrix).withColumn("accuracy", F.round("accuracy", 12)).join(families, "model_id")
    full = ranked(acc).select("model_id", F.col("rank_average").alias("full_rank"))
    grid = acc.select("model_id", "accuracy", F.col("family").alias("own")).crossJoin(F.broadcast(families.select("family").distinct())).where("own <> family")
    ranks = ranked(grid, by=("family",)).join(full, "model_id").withColumn("old", average_rank("full_rank", ["family"], descending=False))
    rho = spearman(ranks, "rank_average", "old", ["family"]).drop("n")
    return ranks.groupBy("family").agg(F.count("*").alias("models"), F.max(F.abs(F.col("rank_average") - F.col("old"))).alias("max_change")).join(rho, "family").withColumn("blocked", F.col("models") < 2)


def family_ranking(matrix: DataFrame, families: DataFrame) -> DataFrame:
    """family, members, accuracy (mean of subjects of the mean of members) and its average rank."""
    acc = accuracy(matrix, "model_id", "subject").join(families, "model_id")
    by = acc.groupBy("family", "subject").agg(F.avg("accuracy").alias("a")).groupBy("family").agg(F.avg("a").alias("accuracy"))
    members = families.groupBy("family").agg(F.count_distinct("model_id").alias("members"))
    return by.withColumn("accuracy", F.round("accuracy", 12)).withColumn("rank", average_rank("accuracy", [])).join(members, "family")


def subject_correlations(matrix: DataFrame) -> DataFrame:
    """subject_a, subject_b, spearman, n over the models of both subjects."""
    acc = accuracy(matrix, "model_id", "subject")
    a, b = acc.alias("a"), acc.alias("b")
    pairs = a.join(b, F.expr("a.model_id = b.model_id and a.subject < b.subject")).select(F.col("a.subject").alias("subject_a"), F.col("b.subject").alias("subject_b"), F.round("a.accuracy", 12).alias("x"), F.round("b.accuracy", 12).alias("y"))
    return spearman(pairs, "x", "y", ["subject_a", "subject_b"])


def top_k(scores: DataFrame, k: int, value: str = "accuracy") -> DataFrame:
    """The k best, ties by rising id."""
    return scores.orderBy(F.desc(value), F.asc("model_id")).limit(k)


def top_k_agreement(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Share of the k best of one that are among the k best of the other (ties by falling id): one row."""
    x, y = (ranked(s).where(F.col("rank_place") <= k).select("model_id") for s in (a, b))
    return x.join(y, "model_id", "left_semi").agg((F.count("*") / F.lit(float(k))).alias("agreement"))


def pairwise_flips(a: DataFrame, b: DataFrame) -> DataFrame:
    """Model pairs that two rankings order differently, and the share that they order alike: one row."""
    s = a.select("model_id", F.round("accuracy", 12).alias("x")).join(b.select("model_id", F.round("accuracy", 12).alias("y")), "model_id")
    p, q = s.alias("p"), s.alias("q")
    sign = F.signum(F.expr("p.x - q.x")) * F.signum(F.expr("p.y - q.y"))
    return p.join(q, F.expr("p.model_id < q.model_id")).agg(F.count("*").alias("pairs"), F.count_if(sign < 0).alias("flips"), ratio(F.count_if(sign > 0), F.count_if(sign != 0)).alias("agreement"))


def monotonicity(rows: DataFrame, strength: str, value: str, by: list[str]) -> DataFrame:
    """Share of steps to a larger strength on which the value doesn't fall; equal strengths are no step."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(strength, value)
    steps = rows.withColumns({"_s": F.lag(strength).over(w), "_v": F.lag(value).over(w)}).where(F.col("_s") < F.col(strength))
    return steps.groupBy(*by).agg(F.avg((F.col(value) >= F.col("_v")).cast("double")).alias("monotonicity"))
