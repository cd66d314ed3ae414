"""Statistics over long tables, each as one aggregate or one window pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.ranks import average_rank


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def r9(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


def pearson(x: str, y: str) -> Column:
    """Pearson correlation of the pairs where both are known; null below two pairs or without variance, whatever the
    arithmetic mode: the quotient is tried, not taken."""
    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(known, F.col(x)), F.when(known, F.col(y))
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((F.count(a) >= 2) & (sa > 1e-15) & (sb > 1e-15), F.try_divide(F.covar_pop(a, b), sa * sb))


def with_pair_ranks(pairs: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rising average ranks of x and y among the pairs where both are known."""
    known = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return known.withColumns({"_rx": average_rank(x, by, descending=False), "_ry": average_rank(y, by, descending=False)})


def spearman(pairs: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by..., spearman, n: Pearson correlation of average ranks."""
    return with_pair_ranks(pairs, x, y, by).groupBy(*by).agg(pearson("_rx", "_ry").alias("spearman"), F.count("*").alias("n"))


def kendall(pairs: DataFrame, x: str, y: str, key: str, by: list[str]) -> DataFrame:
    """by..., gamma (ties ignored), tau_b (ties corrected). Pairs of rows are formed within a group only, so groups
    must be panels (models of a benchmark), not facts."""
    known = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, key, x, y)
    a, b = known.alias("a"), known.alias("b")
    on = reduce(lambda p, q: p & q, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by] + [F.col(f"a.{key}") < F.col(f"b.{key}")])
    dx, dy = F.signum(F.col(f"a.{x}") - F.col(f"b.{x}")), F.signum(F.col(f"a.{y}") - F.col(f"b.{y}"))
    both = a.join(b, on).select(*[F.col(f"a.{c}").alias(c) for c in by], dx.alias("dx"), dy.alias("dy"))
    s, nx, ny = F.sum(F.col("dx") * F.col("dy")), F.sum(F.abs("dx")), F.sum(F.abs("dy"))
    untied = F.sum(F.abs(F.col("dx") * F.col("dy")))
    return both.groupBy(*by).agg(ratio(s, untied).alias("gamma"), ratio(s, F.sqrt(nx * ny)).alias("tau_b"))


def roc_auc(rows: DataFrame, y: str, score: str, by: list[str]) -> DataFrame:
    """by..., auc from rank sums (ties count half); null with one class only."""
    r = rows.where(F.col(score).isNotNull()).withColumn("_r", average_rank(score, by, descending=False))
    p, n = F.count_if(F.col(y) == 1).cast("double"), F.count_if(F.col(y) != 1).cast("double")
    top = F.sum(F.when(F.col(y) == 1, F.col("_r")))
    return r.groupBy(*by).agg(F.when((p > 0) & (n > 0), (top - p * (p + 1) / 2) / (p * n)).alias("auc"))


def average_precision(rows: DataFrame, y: str, score: str, key: str, by: list[str]) -> DataFrame:
    """by..., ap: precision summed over the places of the positives, falling score, then rising key."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    w = w.orderBy(F.col(score).desc_nulls_last(), F.col(key))
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = (F.col(y) == 1).cast("int")
    r = rows.withColumns({"_p": F.sum(hit).over(running) / F.row_number().over(w), "_hit": hit})
    return r.groupBy(*by).agg(ratio(F.sum(F.col("_p") * F.col("_hit")), F.sum("_hit")).alias("ap"))


def percentile(c: str | Column, q: float) -> Column:
    """Linear interpolation between order statistics."""
    return F.percentile(c, F.lit(q))


def adjusted(rows: DataFrame, p: str, key: str, by: list[str] | None = None) -> DataFrame:
    """Adds bonferroni, holm, bh and by_ to rows of p-values, each family (``by``) for itself."""
    by = by or []
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    n = F.count(p).over(w).cast("double")
    up = w.orderBy(F.col(p), F.col(key))
    down = w.orderBy(F.col(p).desc(), F.col(key).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.where(F.col(p).isNotNull()).withColumns({"_n": n, "_k": F.row_number().over(up)})
    # the sum 1 + 1/2 + ... + 1/n, by its rows
    rows = rows.withColumn("_h", F.sum(F.lit(1.0) / F.col("_k")).over(w))
    step = F.col(p) * F.col("_n") / F.col("_k")
    rows = rows.withColumns({"_bh": F.min(step).over(down), "_by": F.min(step * F.col("_h")).over(down), "_holm": F.max(F.col(p) * (F.col("_n") - F.col("_k") + 1)).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    one = F.lit(1.0)
    return rows.withColumns({"bonferroni": F.least(one, F.col(p) * F.col("_n")), "holm": F.least(one, F.col("_holm")), "bh": F.least(one, F.col("_bh")), "by_": F.least(one, F.col("_by"))}).drop("_n", "_k", "_h", "_bh", "_by", "_holm")
