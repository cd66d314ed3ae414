"""Queries of domain checks, fits, baselines and planning formulas."""

from pyspark.sql import functions as F

from plumbline.functions.stats import r9
from plumbline.operators import diagnostics, domains, matrix
from plumbline.operators import psychometrics as P
from plumbline.plans.bindings import Tables
from plumbline.plans.registry import query


def _rounded(df, *columns):
    return df.withColumns({c: r9(c) for c in columns})


@query("code_validity", """WITH s AS (SELECT avg(CASE WHEN p_size < 3 THEN 1.0 ELSE 0.0 END) AS weak_tests, bool_or(p_partkey % 50 = 0) AS flaky, avg(CASE WHEN p_partkey % 9 > 0 THEN 1.0 ELSE 0.0 END) AS locked, avg(CASE WHEN p_partkey % 4 > 0 THEN p_size / (p_partkey % 4) END) AS hp, count(DISTINCT p_brand) AS languages FROM part)
SELECT round(weak_tests, 9) AS weak_tests, flaky, round(locked, 9) AS locked, round(hp, 9) AS hidden_public, languages, CAST(weak_tests > 0.3 AS INT) + CAST(flaky AS INT) + CAST(locked < 1 AS INT) + CAST(hp < 0.5 AS INT) AS risks FROM s""", prelude=False)
def _(t: Tables):
    k = F.col("p_partkey")
    items = t.raw("part").select(F.col("p_size").alias("hidden_tests"), (k % 4).alias("public_tests"), F.when(k % 50 == 0, 1).otherwise(0).alias("flaky_reruns"), F.when(k % 9 > 0, F.lit("h")).alias("lock_hash"), F.col("p_brand").alias("language"))
    return _rounded(domains.code(items), "weak_tests", "locked", "hidden_public")


@query("safety_validity", "WITH s AS (SELECT count(DISTINCT o_orderstatus) AS policies, count(DISTINCT o_orderpriority) AS rubrics, count(DISTINCT o_orderkey % 4) AS styles, avg(CASE WHEN o_custkey % 3 = 0 THEN CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END END) AS r FROM orders) SELECT policies, rubrics, styles, round(r, 9) AS refusal_score, CAST(policies > 1 AS INT) + CAST(rubrics > 1 AS INT) + CAST(r > 0.3 AS INT) AS risks FROM s", prelude=False)
def _(t: Tables):
    items = t.raw("orders").select(F.col("o_orderstatus").alias("policy"), F.col("o_orderpriority").alias("rubric"), (F.col("o_orderkey") % 4).alias("style"), (F.col("o_custkey") % 3 == 0).alias("refuse"), (F.col("o_orderstatus") == "F").cast("double").alias("score"))
    return _rounded(domains.safety(items), "refusal_score")


@query("medical_validity", "WITH s AS (SELECT count(DISTINCT c_nationkey) AS sites, avg(CASE WHEN c_custkey % 5 < 2 THEN 1.0 ELSE 0.0 END) AS sa, count(DISTINCT c_mktsegment) AS severities, avg(c_acctbal) AS u, avg(CASE WHEN c_custkey % 10 / 10.0 >= 0.7 THEN 1.0 ELSE 0.0 END) AS un FROM customer) SELECT sites, round(sa, 9) AS single_annotator, severities, round(u, 6) AS utility, round(un, 9) AS uncertain, CAST(sites < 2 AS INT) + CAST(sa > 0.3 AS INT) AS risks FROM s", prelude=False)
def _(t: Tables):
    items = t.raw("customer").select(F.col("c_nationkey").alias("site"), (F.col("c_custkey") % 5).alias("annotators"), F.col("c_mktsegment").alias("severity"), F.col("c_acctbal").alias("utility"), (F.col("c_custkey") % 10 / 10.0).alias("uncertainty"))
    return domains.medical(items).withColumns({"single_annotator": r9("single_annotator"), "uncertain": r9("uncertain"), "utility": F.round("utility", 6)})


@query("graph_validity", "WITH s AS (SELECT count(DISTINCT o_orderdate) AS timestamps, count(*) - count(DISTINCT o_custkey) AS repeated_entities, avg(CASE WHEN o_orderkey % 130 >= 100 THEN 1.0 ELSE 0.0 END) AS hubs, avg(o_orderkey % 130) AS degree, avg(CASE WHEN o_custkey % 10 / 10.0 >= 0.9 THEN 1.0 ELSE 0.0 END) AS leaky, count(DISTINCT o_orderstatus) AS splits FROM orders) SELECT timestamps, repeated_entities, round(hubs, 9) AS hubs, round(degree, 6) AS degree, round(leaky, 9) AS leaky, splits, CAST(hubs > 0.2 AS INT) + CAST(splits < 2 AS INT) AS risks FROM s", prelude=False)
def _(t: Tables):
    items = t.raw("orders").select(F.col("o_orderdate").alias("timestamp"), F.col("o_custkey").alias("entity"), (F.col("o_orderkey") % 130).alias("degree"), (F.col("o_custkey") % 10 / 10.0).alias("neighbour_rate"), F.col("o_orderstatus").alias("split"))
    return domains.graph(items).withColumns({"hubs": r9("hubs"), "leaky": r9("leaky"), "degree": F.round("degree", 6)})


@query("multimodal_validity", "SELECT count(DISTINCT lang) AS modalities, round(avg(CASE WHEN text <> '' THEN 1.0 ELSE 0.0 END), 9) AS ocr_coverage, count(*) FILTER (contains(lower(text), lower(source))) AS answer_in_ocr, count(DISTINCT n_chars % 10) AS crops, round(avg(CASE WHEN doc_id % 6 > 0 THEN 1.0 ELSE 0.0 END), 9) AS assets FROM documents", prelude=False)
def _(t: Tables):
    items = t.raw("documents").select(F.col("lang").alias("modality"), F.col("text").alias("ocr"), F.col("source").alias("answer"), (F.col("n_chars") % 10).alias("crop"), F.when(F.col("doc_id") % 6 > 0, "x").alias("asset"))
    return _rounded(domains.multimodal(items), "ocr_coverage", "assets")


@query("agent_validity", """WITH s AS (SELECT conv_id, count(*) AS n, bool_and(role IS NOT NULL AND text IS NOT NULL) AS complete, bool_and(turn % 7 <> 5) AS hashed, bool_or(length(text) % 100 >= 99) AND NOT (conv_id % 2 = 0) AS hacked, count(*) FILTER (turn % 4 = 3) AS errors FROM conversations GROUP BY 1)
SELECT count(*) AS traces, CAST(sum(n) AS BIGINT) AS steps, round(avg(CAST(complete AS INT)), 9) AS complete, round(avg(CAST(hashed AS INT)), 9) AS hashed, count(*) FILTER (hacked) AS rewarded, CAST(sum(errors) AS BIGINT) AS errors FROM s""", prelude=False)
def _(t: Tables):
    step = F.struct("turn", F.col("role").alias("action"), F.col("text").alias("observation"), F.when(F.col("turn") % 7 != 5, "h").alias("state_hash"), (F.length("text") % 100 / 100.0).alias("reward"), F.when(F.col("turn") % 4 == 3, "e").alias("error"))
    traces = t.raw("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(step)).alias("steps")).withColumn("success", F.col("conv_id") % 2 == 0)
    return _rounded(domains.agents(traces), "complete", "hashed")


@query("rag_validity", """, r AS (SELECT f.item_id, f.score, v.score AS ab, CAST(f.item_id AS INT) AS i FROM f LEFT JOIN v USING (model_id, item_id))
SELECT CASE WHEN count(*) FILTER (ab IS NULL) = 0 THEN round(avg(ab - score), 9) END AS score_delta, round((avg(score) - avg(ab)) / avg(score), 9) AS reliance, round(avg(CASE WHEN i % 3 > 0 THEN 1.0 ELSE 0.0 END), 9) AS supported, round(avg(CASE WHEN i % 4 > 0 THEN 1.0 ELSE 0.0 END), 9) AS cited, round(avg(CASE WHEN i % 10 = 0 THEN 1.0 ELSE 0.0 END), 9) AS unanswerable, round(corr(i % 5, score), 9) AS position_correlation FROM r""")
def _(t: Tables):
    i = F.col("item_id").cast("int")
    rows = matrix.align(t.full, t.variant).select("score", F.col("variant_score").alias("ablated"), F.lit("the context").alias("context"), F.when(i % 3 > 0, F.array(F.lit("context"))).otherwise(F.array(F.lit("other"))).alias("spans"), F.when(i % 4 > 0, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>")).alias("citations"), (i % 10 > 0).alias("answerable"), (i % 5).alias("position"))
    return _rounded(domains.rag(rows), "score_delta", "reliance", "supported", "cited", "unanswerable", "position_correlation")


@query("planning_formulas", """, s AS (SELECT model_id, a AS p, 200 AS n FROM acc WHERE a > 0 AND a < 1)
SELECT model_id, round(2 * 1.959963984540054 / (1 + 1.959963984540054 * 1.959963984540054 / n) * sqrt(p * (1 - p) / n + 1.959963984540054 * 1.959963984540054 / (4.0 * n * n)), 9) AS wilson,
round((exp(2 * (atanh(p) + 1.959963984540054 / sqrt(n - 3))) - 1) / (exp(2 * (atanh(p) + 1.959963984540054 / sqrt(n - 3))) + 1) - (exp(2 * (atanh(p) - 1.959963984540054 / sqrt(n - 3))) - 1) / (exp(2 * (atanh(p) - 1.959963984540054 / sqrt(n - 3))) + 1), 9) AS fisher,
round(sqrt((p * (1 - p) + 49 * (p / (2 - p) - p * p) + 149 * (2 * p * p / (1 + p) - p * p)) / (50.0 * 150.0)), 9) AS auc_se, round(200 * (64 + 0.1 * 512) / (12.0 * 2) / 3600 / 0.95 + 0.25, 9) AS hours FROM s""")
def _(t: Tables):
    s = matrix.accuracy(t.full).where("accuracy > 0 and accuracy < 1").select("model_id", F.col("accuracy").alias("p"), F.lit(200.0).alias("n"))
    out = s.select("model_id", P.wilson_width(F.col("p"), F.col("n")).alias("wilson"), P.fisher_width(F.col("p"), F.col("n")).alias("fisher"), P.auc_error(F.col("p"), F.lit(50.0), F.lit(150.0)).alias("auc_se"), P.gpu_hours(F.lit(200.0), F.lit(64.0), F.lit(512.0), F.lit(12.0)).alias("hours"))
    return _rounded(out, "wilson", "fisher", "auc_se", "hours")


def _items(t: Tables):
    words = F.filter(F.split(F.col("text"), " "), lambda w: w != "")
    b = t.raw("benchmark").select("item_id", F.col("text").alias("prompt"), F.slice(words, 1, 4).alias("choices"), F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("item_id") % 4 + 1).cast("int")).alias("answer"))
    return b.where(F.size("choices") == 4)


@query("baseline_zoo")
def _(t: Tables):
    return P.baselines(_items(t)).groupBy("baseline").agg(F.count("*").alias("n"), r9(F.avg("score")).alias("score"))


@query("baseline_gap")
def _(t: Tables):
    return _rounded(P.gap(P.baselines(_items(t)), matrix.accuracy(t.full)), "best_model", "best_baseline", "gap")


@query("rasch_fit")
def _(t: Tables):
    return P.rasch(t.binary, "subject").withColumn("value", F.round("value", 6))


@query("two_pl_proxy")
def _(t: Tables):
    return P.two_pl(_rounded(diagnostics.irt_items(t.full), "discrimination", "difficulty"), 24)


@query("rasch_simulation")
def _(t: Tables):
    return P.simulate(12, 40, 17, t.spark).groupBy("model_id").agg(F.avg("score").alias("accuracy"))
