"""Queries of the diagnostics and psychometric operators."""

from pyspark.sql import functions as F

from plumbline.functions.stats import r9
from plumbline.operators import diagnostics as D
from plumbline.operators import matrix
from plumbline.plans.bindings import Tables
from plumbline.plans.registry import query


def _rounded(df, *columns):
    return df.withColumns({c: r9(c) for c in columns})


def _avg_rank(e: str, part: str = "", desc: bool = False) -> str:
    p = f"PARTITION BY {part} " if part else ""
    q = f"PARTITION BY {part}, {e}" if part else f"PARTITION BY {e}"
    return f"rank() OVER ({p}ORDER BY {e}{' DESC' if desc else ''}) + (count(*) OVER ({q}) - 1) / 2.0"


def _choices(t: Tables):
    """model_id, item_id, choice: the last option a model gave on an item, as letters."""
    i = F.col("l_partkey") % 200
    rows = t.raw("lineitem").select((F.col("l_suppkey") % 24).cast("string").alias("model_id"), i.cast("string").alias("item_id"), F.col("l_linenumber"))
    return rows.groupBy("model_id", "item_id").agg(F.max("l_linenumber").alias("n")).select("model_id", "item_id", F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("n") % 4 + 1).cast("int")).alias("choice"))


_CH = ", ch AS (SELECT CAST(l_suppkey % 24 AS VARCHAR) AS model_id, CAST(l_partkey % 200 AS VARCHAR) AS item_id, substr('ABCD', CAST(max(l_linenumber) % 4 + 1 AS INT), 1) AS choice FROM lineitem GROUP BY 1, 2)"
_AL = ", al AS (SELECT f.model_id, f.item_id, f.subject, f.score, v.score AS vs FROM f LEFT JOIN v USING (model_id, item_id))"


@query("shortcut_retention", _AL + " SELECT 'context_removed' AS prompt_variant, round(avg(score), 9) AS full_score, round(avg(vs), 9) AS ablated_score, round(avg(vs) / avg(score), 9) AS retention, avg(vs) / avg(score) >= 0.70 AS high FROM al")
def _(t: Tables):
    return _rounded(D.shortcut(t.full, t.responses.where("prompt_variant <> 'full'")), "full_score", "ablated_score", "retention")


@query("shortcut_models", _AL + " SELECT model_id, round(avg(score), 9) AS full_score, round(avg(vs), 9) AS ablated_score, round(avg(vs) / nullif(avg(score), 0), 9) AS retention FROM al GROUP BY 1")
def _(t: Tables):
    return _rounded(D.shortcut_models(t.full, t.variant), "full_score", "ablated_score", "retention")


@query("shortcut_items", _AL + " SELECT item_id, round(greatest(coalesce(avg(vs) - avg(score), 0), 0), 9) AS suspicion FROM al GROUP BY 1")
def _(t: Tables):
    return _rounded(D.shortcut_items(t.full, t.variant), "suspicion")


_AM = _AL + ", am AS (SELECT model_id, round(avg(score), 12) AS x, round(avg(vs), 12) AS y, avg(vs - score) AS d FROM al GROUP BY 1), ar AS (SELECT *, " + _avg_rank("x") + " AS rx, " + _avg_rank("y") + " AS ry, row_number() OVER (ORDER BY x DESC, model_id DESC) AS px, row_number() OVER (ORDER BY y DESC, model_id DESC) AS py FROM am)"


@query("prompt_sensitivity", _AM + " SELECT round(avg(d), 9) AS mean_delta, round(corr(rx, ry), 9) AS spearman, count(*) FILTER (abs(px - py) >= 2) AS flips FROM ar")
def _(t: Tables):
    return _rounded(D.prompt_sensitivity(t.full, t.variant), "mean_delta", "spearman")


@query("variant_variance", "SELECT model_id, count(*) AS variants, round(var_pop(a), 9) AS variance FROM (SELECT model_id, prompt_variant, avg(score) AS a FROM responses GROUP BY ALL) GROUP BY 1")
def _(t: Tables):
    return _rounded(D.variant_variance(t.responses), "variance")


@query("reliability", _AM + " SELECT round(corr(rx, ry), 9) AS spearman, (SELECT round(avg(CASE WHEN coalesce(score >= 0.5, false) = coalesce(vs >= 0.5, false) THEN 1.0 ELSE 0.0 END), 9) FROM al) AS agreement, (SELECT round(avg(abs(score - vs)), 9) FROM al) AS mean_abs_delta FROM ar")
def _(t: Tables):
    return _rounded(D.reliability(t.full, t.variant), "spearman", "agreement", "mean_abs_delta")


@query("item_stability", _AL + " SELECT item_id, round(avg(CASE WHEN coalesce(score >= 0.5, false) = coalesce(vs >= 0.5, false) THEN 1.0 ELSE 0.0 END), 9) AS stability FROM al GROUP BY 1")
def _(t: Tables):
    return _rounded(D.item_stability(t.full, t.variant), "stability")


_SAT = ", b AS (SELECT model_id, a FROM acc ORDER BY round(a, 12) DESC, model_id LIMIT 3), i AS (SELECT item_id, subject, avg(CASE WHEN model_id IN (SELECT model_id FROM b) THEN score END) AS top, avg(score) AS p, stddev_samp(score) AS sd FROM f GROUP BY ALL)"


@query("saturation", _SAT + """, s AS (SELECT count(*) AS items, avg(CASE WHEN top >= 0.999 THEN 1.0 ELSE 0.0 END) AS solved, avg(CASE WHEN p <= 0.001 THEN 1.0 ELSE 0.0 END) AS failed, count(*) FILTER (p > 0.05 AND p < 0.95 AND sd > 0.05) AS discriminating FROM i),
c AS (SELECT max(a) AS ceiling, 1 - stddev_samp(a) / greatest(avg(a), 1e-8) AS compression FROM acc)
SELECT items, round(solved, 9) AS solved, round(failed, 9) AS failed, discriminating, round(ceiling, 9) AS ceiling, round(compression, 9) AS compression, (SELECT round(max(a) - min(a), 9) FROM b) AS top_range,
CASE WHEN items < 10 THEN 'insufficient evidence' WHEN ceiling >= 0.9 OR solved >= 0.75 OR discriminating / items < 0.15 THEN 'severe' WHEN ceiling >= 0.8 OR solved >= 0.5 OR discriminating / items < 0.3 THEN 'moderate' WHEN ceiling >= 0.7 OR solved >= 0.25 THEN 'mild' ELSE 'not saturated' END AS category FROM s, c""")
def _(t: Tables):
    return _rounded(D.saturation(t.full), "solved", "failed", "ceiling", "compression", "top_range")


@query("saturation_by_tag", _SAT + " SELECT subject AS tag, count(*) AS items, round(avg(p), 9) AS mean, round(avg(top), 9) AS top_mean, round(avg(CASE WHEN top >= 0.999 THEN 1.0 ELSE 0.0 END), 9) AS solved FROM i GROUP BY 1")
def _(t: Tables):
    out = D.saturation_by_tag(t.full.drop("subject"), t.full.select("item_id", F.col("subject").alias("tag")).distinct())
    return _rounded(out, "mean", "top_mean", "solved")


@query("dif_effects", """, im AS (SELECT item_id, avg(score) AS im FROM f GROUP BY 1), r AS (SELECT item_id, family, avg(score) - max(im) AS r FROM f JOIN im USING (item_id) JOIN fam USING (model_id) GROUP BY ALL)
SELECT x.item_id, x.family AS group_a, y.family AS group_b, round(x.r - y.r, 9) AS effect, abs(round(x.r - y.r, 9)) >= 0.30 AS suspicious FROM r x JOIN r y ON x.item_id = y.item_id AND x.family < y.family""")
def _(t: Tables):
    out = _rounded(D.dif(t.full, t.families), "effect")
    return out.withColumn("suspicious", F.abs("effect") >= 0.30)


@query("power_table", """, pn AS (SELECT (SELECT avg(a) FROM acc) AS m, (SELECT count(DISTINCT item_id) FROM f) AS n)
SELECT model_id, round(a, 9) AS accuracy, round(sqrt(greatest(a * (1 - a), 0) / n), 9) AS se, round(1.96 * sqrt(2 * m * (1 - m) / n), 9) AS detectable, """ + ", ".join(f"CAST(ceil((1.96 + 0.84) * (1.96 + 0.84) * greatest(m * (1 - m), 1e-6) / ({d} / 100.0 * {d} / 100.0)) AS BIGINT) AS items_for_{d}" for d in (1, 2, 5)) + " FROM acc, pn")
def _(t: Tables):
    return _rounded(D.power(t.full), "accuracy", "se", "detectable")


@query("coverage_entropy", "SELECT count(*) AS tags, round(-sum(p * log2(p)), 9) AS entropy, round(-sum(p * log2(p)) / log2(count(*)), 9) AS balance, count(*) FILTER (c = 1) AS singletons FROM (SELECT c, c / sum(c) OVER () AS p FROM (SELECT lang, count(*) AS c FROM documents GROUP BY 1))", prelude=False)
def _(t: Tables):
    return _rounded(D.coverage(t.items), "entropy", "balance")


@query("predictive_corr", "SELECT count(*) AS n, round(corr(acc.a, acc2.a), 9) AS pearson, CASE WHEN abs(corr(acc.a, acc2.a)) >= 0.7 THEN 'strong' WHEN abs(corr(acc.a, acc2.a)) >= 0.4 THEN 'moderate' ELSE 'weak' END AS reading FROM acc JOIN acc2 USING (model_id)")
def _(t: Tables):
    return _rounded(D.predictive(t.full, matrix.accuracy(t.second).withColumnRenamed("accuracy", "criterion")), "pearson")


@query("goodhart_drift", """, i AS (SELECT accv.model_id, accv.a AS pre, acc2.a AS post FROM accv JOIN acc2 USING (model_id) WHERE CAST(accv.model_id AS INT) % 4 > 0)
SELECT acc.model_id, round(a, 9) AS accuracy, round(post - pre, 9) AS drift, round(a - post, 9) AS gap, coalesce(post - pre > 0.05 AND a > post + 0.1, false) AS gaming FROM acc LEFT JOIN i USING (model_id)""")
def _(t: Tables):
    pre = matrix.accuracy(t.variant).withColumnRenamed("accuracy", "pre")
    post = matrix.accuracy(t.second).withColumnRenamed("accuracy", "post")
    return _rounded(D.goodhart(t.full, pre.join(post, "model_id").where("cast(model_id as int) % 4 > 0")), "accuracy", "drift", "gap").drop("pre", "post")


_IRT = """, ms AS (SELECT model_id, sum(score) AS s FROM f GROUP BY 1), sz AS (SELECT count(DISTINCT item_id) AS items, count(DISTINCT model_id) AS models FROM f), rw AS (SELECT f.*, round((s - score) / (items - 1), 12) AS rest FROM f JOIN ms USING (model_id), sz),
ip AS (SELECT item_id, count(score) AS n, avg(score) AS p, coalesce(round(CASE WHEN stddev_pop(score) > 1e-15 AND stddev_pop(rest) > 1e-15 THEN corr(score, rest) END, 12), 0) AS total_r FROM rw GROUP BY 1),
kd AS (SELECT CASE WHEN count(*) FILTER (p > 0.05 AND p < 0.95 AND total_r > 0.05) >= max(l) THEN 'strict' WHEN count(*) FILTER (total_r > 0) >= max(l) THEN 'loose' ELSE 'none' END AS kind, max(l) AS least FROM ip, (SELECT least(5, greatest(2, items // 4)) AS l FROM sz)),
an AS (SELECT item_id, CASE kind WHEN 'strict' THEN p > 0.05 AND p < 0.95 AND total_r > 0.05 WHEN 'loose' THEN total_r > 0 ELSE false END AS anchor FROM ip, kd), ac AS (SELECT count(*) FILTER (anchor) AS anchors FROM an),
asum AS (SELECT model_id, sum(score) FILTER (anchor) AS asum FROM f JOIN an USING (item_id) GROUP BY 1),
px AS (SELECT item_id, score, round(CASE WHEN anchor AND anchors - 1 >= least THEN (asum - score) / (anchors - 1) WHEN anchors >= least THEN asum / anchors ELSE rest END, 12) AS proxy FROM rw JOIN an USING (item_id) JOIN asum USING (model_id), ac, kd),
rr AS (SELECT *, """ + _avg_rank("score", "item_id") + " AS rx, " + _avg_rank("proxy", "item_id") + """ AS ry FROM px),
d AS (SELECT item_id, coalesce(CASE WHEN stddev_pop(rx) > 1e-15 AND stddev_pop(ry) > 1e-15 THEN corr(rx, ry) END, CASE WHEN stddev_pop(score) > 1e-15 AND stddev_pop(proxy) > 1e-15 THEN corr(score, proxy) END) AS d0 FROM rr GROUP BY 1),
ir AS (SELECT item_id, n, p, -ln(greatest(least(p, 1 - 1e-4), 1e-4) / (1 - greatest(least(p, 1 - 1e-4), 1e-4))) AS difficulty, coalesce(d0, total_r) AS discrimination, greatest(coalesce(d0, total_r), 0) * p * (1 - p) AS information, anchor FROM ip JOIN d USING (item_id) JOIN an USING (item_id))"""


@query("irt_proxy_items", _IRT + " SELECT item_id, n, round(p, 9) AS p, round(difficulty, 9) AS difficulty, round(discrimination, 9) AS discrimination, round(information, 9) AS information, CASE WHEN models < 5 THEN 'insufficient_panel' WHEN anchors = 0 OR p <= 0.05 OR p >= 0.95 THEN 'unstable_estimate' WHEN discrimination < -0.05 THEN 'negative_discrimination' WHEN abs(discrimination) < 0.05 THEN 'low_discrimination' ELSE 'positive_discrimination' END AS label, p >= 0.95 AS too_easy, p <= 0.05 AS too_hard, anchor FROM ir, ac, sz")
def _(t: Tables):
    return _rounded(D.irt_items(t.full), "p", "difficulty", "discrimination", "information")


@query("irt_proxy_abilities", "SELECT model_id, round(a, 9) AS accuracy, round(ln(greatest(least(a, 1 - 1e-4), 1e-4) / (1 - greatest(least(a, 1 - 1e-4), 1e-4))), 9) AS ability FROM acc")
def _(t: Tables):
    return _rounded(D.irt_abilities(t.full), "accuracy", "ability")


_HI = _IRT + ", hi AS (SELECT item_id, round(information, 9) AS information FROM ir ORDER BY round(information, 9) DESC, round(discrimination, 9) DESC NULLS LAST, item_id LIMIT 25)"


@query("high_information_subset", _HI + " SELECT item_id, information FROM hi")
def _(t: Tables):
    return D.high_information(_rounded(D.irt_items(t.full), "discrimination", "information"), 25).select("item_id", "information")


@query("subset_fidelity", _HI + ", y AS (SELECT model_id, round(avg(score), 12) AS y FROM f WHERE item_id IN (SELECT item_id FROM hi) GROUP BY 1), j AS (SELECT model_id, round(a, 12) AS x, y FROM acc JOIN y USING (model_id)), r AS (SELECT " + _avg_rank("x") + " AS rx, " + _avg_rank("y") + " AS ry, row_number() OVER (ORDER BY x DESC, model_id DESC) AS px, row_number() OVER (ORDER BY y DESC, model_id DESC) AS py FROM j) SELECT round(corr(rx, ry), 9) AS spearman, count(*) FILTER (px <= 3 AND py <= 3) / 3.0 AS topk, (SELECT count(*) FROM hi) AS size FROM r")
def _(t: Tables):
    chosen = D.high_information(_rounded(D.irt_items(t.full), "discrimination", "information"), 25)
    return _rounded(D.subset_fidelity(t.full, chosen), "spearman")


def _lg(e: str) -> str:
    return f"ln(greatest(least({e}, 1 - 1e-8), 1e-8) / (1 - greatest(least({e}, 1 - 1e-8), 1e-8)))"


_SH = _lg("(sum(score) + 0.5) / (count(score) + 1.0)")
_HL = f""", c AS (SELECT model_id, subject, {_SH} AS c, count(score) AS n FROM bin GROUP BY ALL), m AS (SELECT model_id, m - avg(m) OVER () AS m FROM (SELECT model_id, {_SH} AS m FROM bin GROUP BY 1)), s AS (SELECT subject, s - avg(s) OVER () AS s FROM (SELECT subject, {_SH} AS s FROM bin GROUP BY 1)), g AS (SELECT {_SH} AS g FROM bin),
hl AS (SELECT model_id, subject, 1 / (1 + exp(-(g + m + s))) AS additive, 1 / (1 + exp(-(g + m + s + (c - (g + m + s)) * n / (n + 20.0)))) AS p FROM c JOIN m USING (model_id) JOIN s USING (subject), g)"""


@query("hierarchical_logit", _HL + " SELECT model_id, subject, round(additive, 9) AS additive, round(p, 9) AS p FROM hl")
def _(t: Tables):
    return _rounded(D.hierarchical_logit(t.binary), "additive", "p")


@query("model_fit", _HL + " SELECT round(avg((p - score) * (p - score)), 9) AS brier, round(avg(-(score * ln(p) + (1 - score) * ln(1 - p))), 9) AS log_loss FROM bin JOIN hl USING (model_id, subject)")
def _(t: Tables):
    return _rounded(D.model_fit(t.binary, D.hierarchical_logit(t.binary), "p"), "brier", "log_loss")


@query("interaction_variance", """, r AS (SELECT model_id, 'a' AS b, a FROM acc WHERE model_id IN (SELECT model_id FROM acc2) UNION ALL SELECT model_id, 'b', a FROM acc2 WHERE model_id IN (SELECT model_id FROM acc))
SELECT count(*) AS n, round(var_samp(r), 9) AS variance FROM (SELECT a - avg(a) OVER (PARTITION BY model_id) - avg(a) OVER (PARTITION BY b) + avg(a) OVER () AS r FROM r)""")
def _(t: Tables):
    return _rounded(D.interaction_variance(t.full, t.second), "variance")


@query("option_entropy", _CH + """, c AS (SELECT item_id, choice, c, sum(c) OVER (PARTITION BY item_id) AS n, row_number() OVER (PARTITION BY item_id ORDER BY c DESC, choice) AS k FROM (SELECT item_id, choice, count(*) AS c FROM ch GROUP BY ALL))
SELECT item_id, CAST(n AS BIGINT) AS n, round(-sum(c / n * ln(c / n)) / ln(4.0), 9) AS entropy, round(sum(CASE WHEN k <= 2 THEN c / n END), 9) AS bimodal, round(max(c / n), 9) AS top_share FROM c GROUP BY item_id, n""")
def _(t: Tables):
    return _rounded(D.option_shape(_choices(t)), "entropy", "bimodal", "top_share")


@query("answer_distribution", _CH + " SELECT choice, n, round(n / sum(n) OVER (), 9) AS share, round(n / sum(n) OVER () - 1.0 / count(*) OVER (), 9) AS imbalance FROM (SELECT choice, count(*) AS n FROM ch GROUP BY 1)")
def _(t: Tables):
    return _rounded(D.answer_distribution(_choices(t)), "share", "imbalance")


@query("distractor_quality", _CH + """, st AS (SELECT model_id, a >= (SELECT quantile_cont(a, 0.75) FROM acc) AS strong FROM acc), g AS (SELECT DISTINCT item_id, substr('ABCD', CAST(CAST(item_id AS INT) % 4 + 1 AS INT), 1) AS answer, unnest(['A', 'B', 'C', 'D']) AS choice FROM f),
c AS (SELECT item_id, choice, count(*) AS total, count(*) FILTER (strong) AS strong FROM ch JOIN st USING (model_id) GROUP BY ALL)
SELECT item_id, choice, coalesce(total, 0) AS total, coalesce(strong, 0) AS strong, coalesce(strong, 0) - coalesce(total, 0) AS discrimination, coalesce(total, 0) = 0 AS dead FROM g LEFT JOIN c USING (item_id, choice) WHERE choice <> answer""")
def _(t: Tables):
    answers = t.full.select("item_id").distinct().select("item_id", F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("item_id").cast("int") % 4 + 1)).alias("answer"))
    return D.distractors(_choices(t), answers, matrix.accuracy(t.full))


def _outputs(t: Tables):
    k = F.col("turn") % 5
    letter = F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("conv_id") % 4 + 1).cast("int"))
    raw = F.when(k == 0, letter).when(k == 1, F.concat(F.lit("The answer is "), letter, F.lit("."))).when(k == 2, F.lit("I cannot answer that.")).when(k == 3, F.lit("  ")).otherwise(F.concat(F.lit("("), letter, F.lit(") because")))
    return t.raw("conversations").select(F.col("role").alias("model_id"), raw.alias("raw_output"))


@query("extract_answers", """SELECT role AS model_id, count(*) AS n, round(avg(CASE WHEN turn % 5 = 0 THEN 1.0 ELSE 0.0 END), 9) AS strict, round(avg(CASE WHEN turn % 5 IN (0, 1, 4) THEN 1.0 ELSE 0.0 END), 9) AS lenient, round(avg(CASE WHEN turn % 5 = 1 THEN 1.0 ELSE 0.0 END), 9) AS stated,
0.0 AS disagreement, round(avg(CASE WHEN turn % 5 = 2 THEN 1.0 ELSE 0.0 END), 9) AS refusals, round(avg(CASE WHEN turn % 5 = 3 THEN 1.0 ELSE 0.0 END), 9) AS invalid FROM conversations GROUP BY 1""", prelude=False)
def _(t: Tables):
    return _rounded(D.extraction_robustness(_outputs(t)), "strict", "lenient", "stated", "disagreement", "refusals", "invalid")


@query("tag_profiles", "SELECT subject AS tag, round(avg(a), 9) AS mean, round(var_pop(a), 9) AS variance FROM sa GROUP BY 1")
def _(t: Tables):
    return _rounded(D.tag_profiles(t.full.drop("subject"), t.full.select("item_id", F.col("subject").alias("tag")).distinct()), "mean", "variance")


@query("cluster_weighted_accuracy", """, i AS (SELECT item_id, 1.0 / count(*) OVER (PARTITION BY CAST(item_id AS INT) % 60) AS w FROM (SELECT DISTINCT item_id FROM f)) SELECT model_id, round(sum(score * w) / sum(w), 9) AS accuracy FROM f JOIN i USING (item_id) GROUP BY 1""")
def _(t: Tables):
    clusters = t.full.select("item_id").distinct().withColumn("cluster", F.col("item_id").cast("int") % 60)
    return _rounded(D.cluster_weighted(t.full, clusters), "accuracy")


@query("balanced_by_tag", """, x AS (SELECT item_id, round(p * (1 - p), 9) AS v, subject AS tag FROM it UNION ALL SELECT item_id, round(p * (1 - p), 9), 'even' FROM it WHERE CAST(item_id AS INT) % 2 = 0),
r AS (SELECT item_id, tag, row_number() OVER (PARTITION BY tag ORDER BY v DESC, item_id) AS rd FROM x), m AS (SELECT item_id, tag, rd FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rd, tag) AS k FROM r) WHERE k = 1) SELECT item_id, tag FROM m ORDER BY rd, tag LIMIT 40""")
def _(t: Tables):
    it = _rounded(matrix.item_statistics(t.full).select("item_id", F.col("disagreement").alias("value")), "value")
    one = it.join(t.full.select("item_id", F.col("subject").alias("tag")).distinct(), "item_id")
    return D.balanced_subset(one.unionByName(it.where("cast(item_id as int) % 2 = 0").withColumn("tag", F.lit("even"))), 40)
