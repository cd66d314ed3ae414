"""Queries of the resampling layer; SQL repeats the hash generator."""

from pyspark.sql import functions as F

from plumbline.functions.stats import r9
from plumbline.operators import matrix, resampling
from plumbline.plans.bindings import Tables
from plumbline.plans.registry import query

B = 40


def _u(*parts: str) -> str:
    key = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(concat('0x', substr(md5(concat_ws('|', {key})), 1, 8)) AS BIGINT) / 4294967296.0)"


def _rounded(df, *columns):
    return df.withColumns({c: r9(c) for c in columns})


_REP = f", rp AS (SELECT CAST(unnest(range({B})) AS INT) AS rep)"


def _weights(table: str, unit: str, seed: int, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    pre = f"{by}, " if by else ""
    u = _u(str(seed), "rep", *([by] if by else []), "i")
    return f""", un AS (SELECT {pre}{unit}, row_number() OVER ({part}ORDER BY {unit}) AS i, count(*) OVER ({part}) AS n FROM (SELECT DISTINCT {pre}{unit} FROM {table})),
dr AS (SELECT {pre}rep, CAST(floor({u} * n) + 1 AS INT) AS i FROM un, rp), wt AS (SELECT {", ".join(f"un.{b}" for b in by.split(", ")) + ", " if by else ""}rep, un.{unit}, count(*) AS w FROM dr JOIN un ON {f"dr.{by} = un.{by} AND " if by else ""}dr.i = un.i GROUP BY ALL)"""


_ITEMS = _REP + _weights("f", "item_id", 7)
_REPACC = _ITEMS + ", ra AS (SELECT rep, model_id, sum(score * w) / sum(w) AS a FROM f JOIN wt USING (item_id) GROUP BY ALL)"


@query("bootstrap_accuracy_ci", _REPACC + " SELECT model_id, round(quantile_cont(a, 0.025), 9) AS low, round(quantile_cont(a, 0.5), 9) AS mid, round(quantile_cont(a, 0.975), 9) AS high FROM ra GROUP BY 1")
def _(t: Tables):
    return _rounded(resampling.accuracy_ci(t.full, B, 7), "low", "mid", "high")


_SUBJ = _REP + _weights("f", "item_id", 11, "subject") + """, rs AS (SELECT rep, f.subject, model_id, round(sum(score * w) / sum(w), 12) AS a FROM f JOIN wt ON f.subject = wt.subject AND f.item_id = wt.item_id GROUP BY ALL),
rk AS (SELECT rep, subject, model_id, rank() OVER (PARTITION BY rep, subject ORDER BY a DESC) + (count(*) OVER (PARTITION BY rep, subject, a) - 1) / 2.0 AS r FROM rs)"""


@query("bootstrap_rank_ci", _SUBJ + " SELECT model_id, subject, round(quantile_cont(r, 0.025), 9) AS low, round(quantile_cont(r, 0.5), 9) AS mid, round(quantile_cont(r, 0.975), 9) AS high FROM rk GROUP BY ALL")
def _(t: Tables):
    return _rounded(resampling.rank_confidence(resampling.subject_rank_replicates(t.full, B, 11)), "low", "mid", "high")


@query("outranking_probability", _SUBJ + " SELECT a.subject, a.model_id AS model_a, b.model_id AS model_b, round(avg(CASE WHEN a.r < b.r THEN 1.0 WHEN a.r = b.r THEN 0.5 ELSE 0.0 END), 9) AS p FROM rk a JOIN rk b ON a.rep = b.rep AND a.subject = b.subject AND a.model_id <> b.model_id GROUP BY ALL")
def _(t: Tables):
    return _rounded(resampling.outranking(resampling.subject_rank_replicates(t.full, B, 11)), "p")


@query("topk_membership", _SUBJ + " SELECT model_id, subject, CAST(k AS INT) AS k, round(avg(CASE WHEN r <= k THEN 1.0 ELSE 0.0 END), 9) AS p FROM rk, (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY ALL")
def _(t: Tables):
    return _rounded(resampling.top_k_membership(resampling.subject_rank_replicates(t.full, B, 11)), "p")


@query("composition_rank_ci", _REP + _weights("sa", "subject", 13) + """, ra AS (SELECT rep, model_id, round(sum(a * w) / sum(w), 12) AS a FROM sa JOIN wt USING (subject) GROUP BY ALL), rk AS (SELECT *, rank() OVER (PARTITION BY rep ORDER BY a DESC) + (count(*) OVER (PARTITION BY rep, a) - 1) / 2.0 AS r FROM ra)
SELECT model_id, round(quantile_cont(r, 0.025), 9) AS low, round(quantile_cont(r, 0.5), 9) AS mid, round(quantile_cont(r, 0.975), 9) AS high FROM rk GROUP BY 1""")
def _(t: Tables):
    return _rounded(resampling.composition_ranks(t.full, B, 13), "low", "mid", "high")


@query("ranking_uncertainty", _REPACC + """, r AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY round(a, 12) DESC, model_id DESC) AS r FROM ra), fr AS (SELECT model_id, row_number() OVER (ORDER BY round(a, 12) DESC, model_id DESC) AS full_rank FROM acc)
SELECT model_id, full_rank, round(avg(r), 9) AS mean_rank, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 9) AS top_k, abs(full_rank - avg(r)) >= 1 AS flipped FROM r JOIN fr USING (model_id) GROUP BY model_id, full_rank""")
def _(t: Tables):
    return _rounded(resampling.ranking_uncertainty(t.full, B, 7), "mean_rank", "top_k")


@query("paired_difference_ci", _ITEMS + """, d AS (SELECT a.model_id AS ma, b.model_id AS mb, a.item_id, a.score - b.score AS d FROM f a JOIN f b ON a.item_id = b.item_id AND a.model_id < b.model_id),
m AS (SELECT ma, mb, avg(d) AS difference FROM d GROUP BY ALL), r AS (SELECT ma, mb, rep, sum(d * w) / sum(w) AS x FROM d JOIN wt USING (item_id) GROUP BY ALL)
SELECT ma AS model_a, mb AS model_b, round(max(difference), 9) AS difference, round(quantile_cont(x, 0.025), 9) AS low, round(quantile_cont(x, 0.975), 9) AS high FROM r JOIN m USING (ma, mb) GROUP BY ALL""")
def _(t: Tables):
    return _rounded(resampling.paired_difference(t.full, B, 7), "difference", "low", "high")


@query("family_bootstrap", _REP + f""", d AS (SELECT rep, family, round(a, 12) AS a, row_number() OVER (PARTITION BY rep, family ORDER BY {_u("5", "rep", "model_id")}, model_id) AS k FROM acc JOIN fam USING (model_id), rp),
r AS (SELECT family, rank() OVER (PARTITION BY rep ORDER BY a DESC) + (count(*) OVER (PARTITION BY rep, a) - 1) / 2.0 AS r FROM d WHERE k = 1)
SELECT family, round(quantile_cont(r, 0.025), 9) AS low, round(quantile_cont(r, 0.5), 9) AS mid, round(quantile_cont(r, 0.975), 9) AS high FROM r GROUP BY 1""")
def _(t: Tables):
    return _rounded(resampling.family_bootstrap(t.full, t.families, B, 5), "low", "mid", "high")


@query("permutation_p", _REP + f""", s AS (SELECT model_id AS key, acc.a AS x, acc2.a AS y FROM acc JOIN acc2 USING (model_id)), b AS (SELECT *, row_number() OVER (ORDER BY key) AS i FROM s), g AS (SELECT * FROM b, rp),
m AS (SELECT rep, y, row_number() OVER (PARTITION BY rep ORDER BY {_u("3", "rep", "key")}, key) AS i FROM g), r AS (SELECT rep, corr(g.x, m.y) AS r FROM g JOIN m USING (rep, i) GROUP BY 1)
SELECT round(max(o), 9) AS observed, round((1 + count(*) FILTER (round(abs(r), 9) >= round(abs(o), 9))) / (count(*) + 1), 9) AS p FROM r, (SELECT corr(x, y) AS o FROM s)""")
def _(t: Tables):
    x = matrix.accuracy(t.full).select(F.col("model_id").alias("key"), F.col("accuracy").alias("x"))
    y = matrix.accuracy(t.second).select(F.col("model_id").alias("key"), F.col("accuracy").alias("y"))
    return _rounded(resampling.permutation_p(x.join(y, "key"), B, 3), "observed", "p")


def _lg(e: str) -> str:
    return f"ln(greatest(least({e}, 1 - 1e-8), 1e-8) / (1 - greatest(least({e}, 1 - 1e-8), 1e-8)))"


_ADD = f""", lm AS (SELECT model_id, {_lg("(sum(score) + 0.5) / (count(score) + 1.0)")} AS m FROM bin GROUP BY 1), li AS (SELECT item_id, {_lg("(sum(score) + 0.5) / (count(score) + 1.0)")} AS i FROM bin GROUP BY 1), lg AS (SELECT {_lg("(sum(score) + 0.5) / (count(score) + 1.0)")} AS g FROM bin),
ad AS (SELECT model_id, item_id, subject, 1 / (1 + exp(-(m + i - g))) AS p FROM bin JOIN lm USING (model_id) JOIN li USING (item_id), lg)"""


@query("additive_null_probs", _ADD + " SELECT model_id, item_id, round(p, 9) AS p FROM ad")
def _(t: Tables):
    return _rounded(resampling.additive_probabilities(t.binary), "p").drop("subject")


@query("empirical_bayes_probs", "SELECT model_id, subject, round(n / (n + 20.0) * a + (1 - n / (n + 20.0)) * g, 9) AS p FROM (SELECT model_id, subject, count(score) AS n, avg(score) AS a FROM bin GROUP BY ALL) JOIN (SELECT model_id, avg(score) AS g FROM bin GROUP BY 1) USING (model_id)")
def _(t: Tables):
    return _rounded(resampling.empirical_bayes_probabilities(t.binary), "p")


_NULL = _REP + f""", nl AS (SELECT rep, model_id, item_id, subject, CASE WHEN {_u("9", "rep", "model_id", "item_id")} < p THEN 1.0 ELSE 0.0 END AS score FROM ad, rp)"""
_RANGE = """, {0}a AS (SELECT rep, model_id, subject, avg(score) AS a FROM {1} GROUP BY ALL), {0}r AS (SELECT rep, model_id, max(r) - min(r) AS rr FROM (SELECT rep, model_id, rank() OVER (PARTITION BY rep, subject ORDER BY a DESC) + (count(*) OVER (PARTITION BY rep, subject, a) - 1) / 2.0 AS r FROM {0}a) GROUP BY ALL),
{0}s AS (SELECT rep, round(quantile_cont(rr, 0.5), 9) AS median_range, round(avg(rr), 9) AS mean_range, max(rr) AS max_range FROM {0}r GROUP BY 1)"""


@query("null_rank_range", _ADD + _NULL + _RANGE.format("n", "nl") + " SELECT rep AS replicate, median_range, mean_range, max_range FROM ns")
def _(t: Tables):
    null = resampling.sample_null(resampling.additive_probabilities(t.binary), B, 9)
    return _rounded(resampling.rank_range_null(null), "median_range", "mean_range")


@query("null_exceedance", _ADD + _NULL + _RANGE.format("n", "nl") + ", ob AS (SELECT 0 AS rep, * FROM bin)" + _RANGE.format("q", "ob") + ", ".join([""] + [f"e{i} AS (SELECT '{c}' AS statistic, max(o.{c}) AS observed, round((1 + count(*) FILTER (ns.{c} >= o.{c})) / (count(*) + 1), 9) AS p FROM ns, qs o)" for i, c in enumerate(("median_range", "mean_range", "max_range"))]) + " SELECT * FROM e0 UNION ALL SELECT * FROM e1 UNION ALL SELECT * FROM e2")
def _(t: Tables):
    null = resampling.sample_null(resampling.additive_probabilities(t.binary), B, 9)
    return _rounded(resampling.exceedance(t.binary, resampling.rank_range_null(null)), "p")


@query("permutation_null_range", _REP + f""", b AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY item_id) AS i FROM bin), g AS (SELECT * FROM b, rp), m AS (SELECT rep, model_id, score, row_number() OVER (PARTITION BY rep, model_id ORDER BY {_u("4", "rep", "model_id", "item_id")}, item_id) AS i FROM g),
nl AS (SELECT g.rep, g.model_id, g.item_id, g.subject, m.score FROM g JOIN m USING (rep, model_id, i))""" + _RANGE.format("n", "nl") + " SELECT rep AS replicate, median_range, mean_range, max_range FROM ns")
def _(t: Tables):
    return _rounded(resampling.rank_range_null(resampling.permuted_null(t.binary, B, 4)), "median_range", "mean_range")


@query("subject_matched_null", _REP + f""", r AS (SELECT *, row_number() OVER (ORDER BY score DESC, subject, doc_id) AS rk FROM det), nd AS (SELECT subject, count(*) AS need FROM r WHERE y = 1 GROUP BY 1),
d AS (SELECT rep, rk, need, row_number() OVER (PARTITION BY rep, r.subject ORDER BY {_u("6", "rep", "doc_id")}, doc_id) AS d FROM r JOIN nd USING (subject), rp WHERE y <> 1)
SELECT rep AS replicate, count(*) FILTER (rk <= 25) / 25.0 AS precision FROM d WHERE d <= need GROUP BY 1""")
def _(t: Tables):
    return resampling.matched_null(t.detector, 25, B, 6)


@query("panel_baseline_iterations", _REPACC + """, r AS (SELECT rep, model_id, rank() OVER (PARTITION BY rep ORDER BY round(a, 12) DESC) AS r, rank() OVER (PARTITION BY rep ORDER BY round(a, 12) DESC) + (count(*) OVER (PARTITION BY rep, round(a, 12)) - 1) / 2.0 AS ra FROM ra),
fr AS (SELECT model_id, rank() OVER (ORDER BY round(a, 12) DESC) AS fr, rank() OVER (ORDER BY round(a, 12) DESC) + (count(*) OVER (PARTITION BY round(a, 12)) - 1) / 2.0 AS fa FROM acc)
SELECT rep AS replicate, round(corr(ra, fa), 9) AS spearman, count(*) FILTER (r <= 5 AND fr <= 5) / 5.0 AS top5, max(abs(r - fr)) AS max_delta, round(avg(abs(r - fr)), 9) AS mean_delta FROM r JOIN fr USING (model_id) GROUP BY 1""")
def _(t: Tables):
    return _rounded(resampling.baseline_iterations(t.full, B, 7), "spearman", "mean_delta")


@query("agreement_bootstrap", _REP + """, lc AS (SELECT task_id, label, count(*) AS c FROM jud GROUP BY ALL), tk AS (SELECT task_id, sum(c) AS n, sum(c * (c - 1)) AS same FROM lc GROUP BY 1 HAVING sum(c) > 1)""" + _weights("tk", "task_id", 8) + """, r AS (SELECT rep, sum(same * w) / sum(n * (n - 1) * w) AS a FROM tk JOIN wt USING (task_id) GROUP BY 1), o AS (SELECT a, row_number() OVER (ORDER BY a) - 1 AS i, count(*) OVER () AS n FROM r)
SELECT round(max(CASE WHEN i = floor(0.025 * (n - 1)) THEN a END), 9) AS low, round(max(CASE WHEN i = floor(0.975 * (n - 1)) THEN a END), 9) AS high FROM o""")
def _(t: Tables):
    return _rounded(resampling.agreement_bootstrap(t.judgments, B, 8), "low", "high")
