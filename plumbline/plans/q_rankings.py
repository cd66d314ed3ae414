"""Queries of rankings and their stability."""

from pyspark.sql import functions as F

from plumbline.functions.stats import kendall, r9, spearman
from plumbline.operators import matrix, rankings
from plumbline.plans.bindings import Tables
from plumbline.plans.registry import query


def _acc(m):
    return matrix.accuracy(m).withColumn("accuracy", F.round("accuracy", 12))


_RANKS = "rank() OVER (ORDER BY a DESC) + (count(*) OVER (PARTITION BY a) - 1) / 2.0"


@query("model_ranks", f"SELECT model_id, {_RANKS} AS rank_average, rank() OVER (ORDER BY a DESC) AS rank_min, row_number() OVER (ORDER BY a DESC, model_id DESC) AS rank_place FROM (SELECT model_id, round(a, 12) AS a FROM acc)")
def _(t: Tables):
    return rankings.ranked(_acc(t.full)).drop("accuracy")


@query("subject_ranks", "SELECT model_id, subject, r AS rank_average, mr AS rank_min FROM sar")
def _(t: Tables):
    return rankings.subject_ranks(t.full).select("model_id", "subject", "rank_average", "rank_min")


@query("compare_rankings", "SELECT x.model_id, x.r AS rank_a, y.r AS rank_b, y.r - x.r AS delta FROM (SELECT model_id, row_number() OVER (ORDER BY round(a, 12) DESC, model_id DESC) AS r FROM acc) x JOIN (SELECT model_id, row_number() OVER (ORDER BY round(a, 12) DESC, model_id DESC) AS r FROM acc2) y USING (model_id)")
def _(t: Tables):
    return rankings.compare(_acc(t.full), _acc(t.second))


@query("subject_instability", """, fr AS (SELECT model_id, rank() OVER (ORDER BY round(a, 12) DESC) AS full_rank FROM acc)
SELECT model_id, full_rank, count(*) AS subjects, min(mr) AS best_rank, max(mr) AS worst_rank, max(mr) - min(mr) AS rank_range, round(stddev_pop(mr), 9) AS rank_sd, round(avg(abs(mr - full_rank)), 9) AS mean_delta, max(abs(mr - full_rank)) AS max_delta
FROM sar JOIN fr USING (model_id) GROUP BY model_id, full_rank""")
def _(t: Tables):
    out = rankings.subject_instability(t.full)
    return out.withColumns({c: r9(c) for c in ("rank_sd", "mean_delta")})


@query("rank_materiality", """, n AS (SELECT count(DISTINCT model_id) AS m FROM f), p AS (SELECT model_id, r, count(*) AS c FROM sar GROUP BY ALL),
e AS (SELECT model_id, -sum(c / s * ln(c / s)) AS h, max(s) AS s FROM (SELECT *, sum(c) OVER (PARTITION BY model_id) AS s FROM p) GROUP BY 1)
SELECT model_id, max(r) - min(r) AS rank_range, round((max(r) - min(r)) / (max(m) - 1), 9) AS normalized_range, round(stddev_pop(a), 9) AS accuracy_sd, round(max(h) / ln(greatest(least(max(m), max(s)), 2)), 9) AS rank_entropy FROM sar JOIN e USING (model_id), n GROUP BY 1""")
def _(t: Tables):
    out = rankings.rank_ranges(t.full)
    return out.withColumns({c: r9(c) for c in ("normalized_range", "accuracy_sd", "rank_entropy")})


@query("kendalls_w", """, s AS (SELECT model_id, sum(r) AS s FROM sar GROUP BY 1), ti AS (SELECT sum(c * c * c - c) AS t FROM (SELECT subject, r, count(*) AS c FROM sar GROUP BY ALL)), k AS (SELECT count(DISTINCT subject) AS m FROM sar)
SELECT round(12.0 * count(*) * var_pop(s) / (max(m) * max(m) * (count(*) * count(*) * count(*) - count(*)) - max(m) * max(t)), 9) AS w, max(m) AS subjects, count(*) AS models FROM s, ti, k""")
def _(t: Tables):
    return rankings.kendalls_w(t.full).withColumn("w", r9("w"))


@query("topk_jaccard", """, tk AS (SELECT *, r <= k AS top FROM sar, (SELECT unnest([1, 3, 5, 10]) AS k))
SELECT CAST(a.k AS INT) AS k, a.subject AS subject_a, b.subject AS subject_b, round(CASE WHEN count(*) FILTER (a.top OR b.top) = 0 THEN 1.0 ELSE count(*) FILTER (a.top AND b.top) / count(*) FILTER (a.top OR b.top) END, 9) AS jaccard
FROM tk a JOIN tk b ON a.k = b.k AND a.model_id = b.model_id AND a.subject < b.subject GROUP BY ALL""")
def _(t: Tables):
    return rankings.top_k_jaccard(t.full).withColumn("jaccard", r9("jaccard"))


@query("effect_size_reversals", """, d AS (SELECT a.model_id AS ma, b.model_id AS mb, a.subject, a.a - b.a AS d FROM sa a JOIN sa b ON a.subject = b.subject AND a.model_id < b.model_id WHERE abs(a.a - b.a) >= 0.01)
SELECT x.ma AS model_a, x.mb AS model_b, count(*) AS reversals FROM d x JOIN d y ON x.ma = y.ma AND x.mb = y.mb AND x.subject < y.subject AND x.d * y.d < 0 GROUP BY ALL""")
def _(t: Tables):
    return rankings.effect_reversals(t.full)


def _loo(column: str) -> str:
    return f""", g AS (SELECT o.h AS left_out, model_id, round(sum(CASE WHEN {column} <> o.h THEN score END) / count(CASE WHEN {column} <> o.h THEN score END), 12) AS a FROM f, (SELECT DISTINCT {column} AS h FROM f) o GROUP BY ALL),
gr AS (SELECT *, rank() OVER (PARTITION BY left_out ORDER BY a DESC) + (count(*) OVER (PARTITION BY left_out, a) - 1) / 2.0 AS r FROM g),
fr AS (SELECT model_id, rank() OVER (ORDER BY a DESC) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS fr FROM (SELECT model_id, round(a, 12) AS a FROM acc))
SELECT left_out, max(abs(r - fr)) AS max_change, round(corr(r, fr), 9) AS spearman FROM gr JOIN fr USING (model_id) GROUP BY 1"""


@query("leave_one_subject_out", _loo("subject"))
def _(t: Tables):
    return rankings.leave_one_out(t.full, "subject").withColumn("spearman", r9("spearman"))


@query("leave_one_family_out", """, a AS (SELECT model_id, round(a, 12) AS a, family FROM acc JOIN fam USING (model_id)), fr AS (SELECT *, rank() OVER (ORDER BY a DESC) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS fr FROM a),
g AS (SELECT o.family, model_id, a, fr FROM fr, (SELECT DISTINCT family FROM fam) o WHERE fr.family <> o.family),
r AS (SELECT *, rank() OVER (PARTITION BY family ORDER BY a DESC) + (count(*) OVER (PARTITION BY family, a) - 1) / 2.0 AS r, rank() OVER (PARTITION BY family ORDER BY fr) + (count(*) OVER (PARTITION BY family, fr) - 1) / 2.0 AS o FROM g)
SELECT family, count(*) AS models, max(abs(r - o)) AS max_change, round(corr(r, o), 9) AS spearman, count(*) < 2 AS blocked FROM r GROUP BY 1""")
def _(t: Tables):
    return rankings.leave_one_family_out(t.full, t.families).withColumn("spearman", r9("spearman"))


@query("family_dedup_ranking", """, s AS (SELECT family, subject, avg(a) AS a FROM sa JOIN fam USING (model_id) GROUP BY ALL), m AS (SELECT family, round(avg(a), 12) AS a FROM s GROUP BY 1)
SELECT family, round(a, 9) AS accuracy, rank() OVER (ORDER BY a DESC) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS rank, (SELECT count(*) FROM fam x WHERE x.family = m.family) AS members FROM m""")
def _(t: Tables):
    return rankings.family_ranking(t.full, t.families).withColumn("accuracy", r9("accuracy"))


_PAIRS = ", pr AS (SELECT a.subject AS subject_a, b.subject AS subject_b, round(a.a, 12) AS x, round(b.a, 12) AS y FROM sa a JOIN sa b ON a.model_id = b.model_id AND a.subject < b.subject), "
_RK = "rank() OVER (PARTITION BY subject_a, subject_b ORDER BY {0}) + (count(*) OVER (PARTITION BY subject_a, subject_b, {0}) - 1) / 2.0"


@query("subject_correlations", _PAIRS + f"q AS (SELECT *, {_RK.format('x')} AS rx, {_RK.format('y')} AS ry FROM pr) SELECT subject_a, subject_b, round(corr(rx, ry), 9) AS spearman, count(*) AS n FROM q GROUP BY ALL")
def _(t: Tables):
    return rankings.subject_correlations(t.full).withColumn("spearman", r9("spearman"))


@query("top_k_models", "SELECT model_id, round(a, 9) AS accuracy FROM acc ORDER BY round(a, 12) DESC, model_id LIMIT 5")
def _(t: Tables):
    return rankings.top_k(_acc(t.full), 5).select("model_id", r9("accuracy").alias("accuracy"))


@query("top_k_agreement", "SELECT count(*) / 5.0 AS agreement FROM (SELECT model_id FROM acc ORDER BY round(a, 12) DESC, model_id DESC LIMIT 5) x JOIN (SELECT model_id FROM acc2 ORDER BY round(a, 12) DESC, model_id DESC LIMIT 5) y USING (model_id)")
def _(t: Tables):
    return rankings.top_k_agreement(_acc(t.full), _acc(t.second), 5)


_XY = ", s AS (SELECT model_id, round(acc.a, 12) AS x, round(acc2.a, 12) AS y FROM acc JOIN acc2 USING (model_id)), d AS (SELECT sign(p.x - q.x) AS dx, sign(p.y - q.y) AS dy FROM s p JOIN s q ON p.model_id < q.model_id) "


@query("pairwise_flips", _XY + "SELECT count(*) AS pairs, count(*) FILTER (dx * dy < 0) AS flips, round(count(*) FILTER (dx * dy > 0) / count(*) FILTER (dx * dy <> 0), 9) AS agreement FROM d")
def _(t: Tables):
    return rankings.pairwise_flips(_acc(t.full), _acc(t.second)).withColumn("agreement", r9("agreement"))


@query("kendall_correlations", _XY + "SELECT round(sum(dx * dy) / sum(abs(dx * dy)), 9) AS gamma, round(sum(dx * dy) / sqrt(sum(abs(dx)) * sum(abs(dy))), 9) AS tau_b FROM d")
def _(t: Tables):
    pairs = _acc(t.full).withColumnRenamed("accuracy", "x").join(_acc(t.second).withColumnRenamed("accuracy", "y"), "model_id").withColumn("g", F.lit(1))
    return kendall(pairs, "x", "y", "model_id", ["g"]).select(r9("gamma").alias("gamma"), r9("tau_b").alias("tau_b"))


@query("spearman_benchmarks", _XY.replace("d AS", "z AS") + ", r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM s) SELECT round(corr(rx, ry), 9) AS spearman, count(*) AS n FROM r")
def _(t: Tables):
    pairs = _acc(t.full).withColumnRenamed("accuracy", "x").join(_acc(t.second).withColumnRenamed("accuracy", "y"), "model_id").withColumn("g", F.lit(1))
    return spearman(pairs, "x", "y", ["g"]).select(r9("spearman").alias("spearman"), "n")


@query("rank_monotonicity", """, s AS (SELECT subject, CAST(model_id AS INT) AS st, round(a, 12) AS v FROM sa), l AS (SELECT *, lag(st) OVER (PARTITION BY subject ORDER BY st, v) AS ps, lag(v) OVER (PARTITION BY subject ORDER BY st, v) AS pv FROM s)
SELECT subject, round(avg(CASE WHEN v >= pv THEN 1.0 ELSE 0.0 END), 9) AS monotonicity FROM l WHERE ps < st GROUP BY 1""")
def _(t: Tables):
    rows = matrix.accuracy(t.full, "model_id", "subject").select("subject", F.col("model_id").cast("int").alias("strength"), F.round("accuracy", 12).alias("v"))
    return rankings.monotonicity(rows, "strength", "v", ["subject"]).withColumn("monotonicity", r9("monotonicity"))
