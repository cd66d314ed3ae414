"""Queries of transfer, flags, integrity gates, repair policies, synthetic panels, options and importers' helpers."""

from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions.stats import r9, roc_auc
from plumbline.operators import diagnostics, flags, forensics, integrity, matrix, options, rankings, repairs, resampling, synthetic, transfer
from plumbline.plans.bindings import Tables
from plumbline.plans.q_diagnostics import _AL, _CH, _IRT, _avg_rank, _choices
from plumbline.plans.q_forensics import _SQZ, _STOP, _TEMPLATE, _bench
from plumbline.plans.q_records import _PAN, _panels
from plumbline.plans.q_resampling import _u, _weights
from plumbline.plans.registry import query


def _rounded(df, *columns):
    return df.withColumns({c: r9(c) for c in columns})


def _pan(t: Tables):
    return _panels(t)


# --- transfer
_PP = _PAN + ", pp AS (SELECT x.bm AS ba, y.bm AS bb, x.model_id, x.a AS u, y.a AS v FROM pn x JOIN pn y ON x.model_id = y.model_id AND x.bm < y.bm)"


@query("benchmark_overlap", _PP + ", n AS (SELECT bm, count(DISTINCT model_id) AS n FROM pn GROUP BY 1) SELECT a.bm AS benchmark_a, b.bm AS benchmark_b, a.n AS models_a, b.n AS models_b, (SELECT count(*) FROM pp WHERE ba = a.bm AND bb = b.bm) AS overlap FROM n a JOIN n b ON a.bm < b.bm")
def _(t: Tables):
    return transfer.overlap(_pan(t))


@query("family_transfer", _PAN + ", fm AS (SELECT bm, family, round(avg(a), 12) AS a FROM pn JOIN fam USING (model_id) GROUP BY ALL), q AS (SELECT x.bm AS ba, y.bm AS bb, x.family, x.a AS u, y.a AS v FROM fm x JOIN fm y ON x.family = y.family AND x.bm < y.bm), r AS (SELECT *, " + _avg_rank("u", "ba, bb") + " AS ru, " + _avg_rank("v", "ba, bb") + """ AS rv FROM q),
d AS (SELECT a.ba, a.bb, sign(a.u - b.u) AS dx, sign(a.v - b.v) AS dy FROM q a JOIN q b ON a.ba = b.ba AND a.bb = b.bb AND a.family < b.family), k AS (SELECT ba, bb, sum(dx * dy) / sqrt(sum(abs(dx)) * sum(abs(dy))) AS tau FROM d GROUP BY ALL)
SELECT ba AS benchmark_a, bb AS benchmark_b, count(*) AS families, round(corr(ru, rv), 9) AS spearman, round(max(tau), 9) AS tau_b, count(*) < 5 AS underpowered FROM r JOIN k USING (ba, bb) GROUP BY ALL""")
def _(t: Tables):
    return _rounded(transfer.family_transfer(_pan(t), t.families), "spearman", "tau_b")


@query("leave_one_family_transfer", _PP + ", q AS (SELECT ba, bb, o.family AS ex, u, v FROM pp JOIN fam USING (model_id) JOIN (SELECT DISTINCT family FROM fam) o ON o.family <> fam.family), r AS (SELECT *, " + _avg_rank("u", "ba, bb, ex") + " AS ru, " + _avg_rank("v", "ba, bb, ex") + """ AS rv FROM q)
SELECT ba AS benchmark_a, bb AS benchmark_b, ex AS excluded_family, count(*) AS models, round(corr(ru, rv), 9) AS spearman, count(*) < 20 AS underpowered FROM r GROUP BY ALL""")
def _(t: Tables):
    return _rounded(transfer.without_family(_pan(t), t.families), "spearman")


_RHO = _PP + ", r AS (SELECT *, " + _avg_rank("u", "ba, bb") + " AS ru, " + _avg_rank("v", "ba, bb") + " AS rv FROM pp), s AS (SELECT ba, bb, corr(ru, rv) AS s FROM r GROUP BY ALL)"


@query("transfer_conclusion", _RHO + """, c AS (SELECT count(s) AS correlations, quantile_cont(s, 0.5) AS median, max(s) - min(s) AS range FROM s)
SELECT correlations, round(median, 9) AS median, round(range, 9) AS range, CASE WHEN (SELECT count(DISTINCT model_id) FROM pn) < 5 THEN 'UNDERPOWERED' WHEN correlations = 0 THEN 'BLOCKED' WHEN correlations > 1 AND range >= 0.40 THEN 'TRANSFER_BENCHMARK_SPECIFIC' WHEN median >= 0.70 THEN 'TRANSFER_SUPPORTED' WHEN median >= 0.35 THEN 'TRANSFER_PARTIAL' ELSE 'TRANSFER_NOT_SUPPORTED' END AS conclusion FROM c""")
def _(t: Tables):
    return _rounded(transfer.analysis(_pan(t), t.families)["conclusion"], "median", "range")


@query("transfer_gates", _PAN + """, c AS (SELECT model_id FROM pn GROUP BY 1 HAVING count(DISTINCT bm) = (SELECT count(DISTINCT bm) FROM pn)), m AS (SELECT c.model_id, family FROM c LEFT JOIN fam USING (model_id))
SELECT 'benchmarks' AS gate, count(DISTINCT bm) AS value, count(DISTINCT bm) >= 2 AS passed FROM pn UNION ALL SELECT 'common_models', count(DISTINCT model_id), count(DISTINCT model_id) >= 5 FROM m UNION ALL SELECT 'common_families', count(DISTINCT family), count(DISTINCT family) >= 3 FROM m UNION ALL SELECT 'unmapped_models', count(*) FILTER (family IS NULL), count(*) FILTER (family IS NULL) = 0 FROM m""")
def _(t: Tables):
    return transfer.gates(_pan(t), t.families)


@query("disagreement_transfer", """, i AS (SELECT 'first' AS bm, item_id, avg(score) AS p FROM f GROUP BY ALL UNION ALL SELECT 'second', item_id, avg(score) FROM b2 GROUP BY ALL), dv AS (SELECT bm, avg(p * (1 - p)) AS v FROM i GROUP BY 1)
SELECT a.bm AS benchmark_a, b.bm AS benchmark_b, round(a.v, 9) AS value_a, round(b.v, 9) AS value_b, round(abs(a.v - b.v), 9) AS delta FROM dv a JOIN dv b ON a.bm < b.bm""")
def _(t: Tables):
    both = t.full.select(F.lit("first").alias("benchmark"), "model_id", "item_id", "score").unionByName(t.second.select(F.lit("second").alias("benchmark"), "model_id", "item_id", "score"))
    return _rounded(transfer.disagreement(both), "value_a", "value_b", "delta")


@query("adjusted_known_only", ", k AS (SELECT key, CASE WHEN key % 3 > 0 THEN p END AS p FROM tst), r AS (SELECT key, p, count(*) OVER () AS n, row_number() OVER (ORDER BY p, key) AS i FROM k WHERE p IS NOT NULL), a AS (SELECT key, least(1, min(p * n / i) OVER (ORDER BY p DESC, key DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r) SELECT k.key, round(p, 9) AS p, round(q, 9) AS adjusted_p FROM k LEFT JOIN a USING (key)")
def _(t: Tables):
    return _rounded(transfer.with_adjusted(t.tests.withColumn("p", F.when(F.col("key") % 3 > 0, F.col("p"))), "p", "key"), "p", "adjusted_p")


# --- flags
_FLAGS = _IRT + _AL + """, st AS (SELECT item_id, avg(CASE WHEN coalesce(score >= 0.5, false) = coalesce(vs >= 0.5, false) THEN 1.0 ELSE 0.0 END) AS s, greatest(coalesce(avg(vs) - avg(score), 0), 0) AS sus FROM al GROUP BY 1),
fl AS (SELECT 'bench' AS benchmark, 'irt' AS diagnostic, item_id, round(greatest(0, 1 - abs(discrimination)), 9) AS score FROM ir UNION ALL SELECT 'bench', 'reliability', item_id, round(greatest(0, 1 - s), 9) FROM st UNION ALL SELECT 'bench', 'shortcut', item_id, round(sus, 9) FROM st),
fs AS (SELECT *, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END AS severity FROM fl),
iss AS (SELECT CAST(o_orderkey % 200 AS VARCHAR) AS item_id, 'status_' || o_orderstatus AS issue_type, o_orderpriority AS severity FROM orders WHERE o_orderkey % 400 < 60)"""


def _flags(t: Tables):
    parts = {"irt": (diagnostics.irt_items(t.full), "discrimination"), "reliability": (diagnostics.item_stability(t.full, t.variant), "stability"), "shortcut": (diagnostics.shortcut_items(t.full, t.variant), "suspicion")}
    return flags.export(parts, "bench")


def _issues(t: Tables):
    o = t.raw("orders").where("o_orderkey % 400 < 60")
    return o.select((F.col("o_orderkey") % 200).cast("string").alias("item_id"), F.concat(F.lit("status_"), "o_orderstatus").alias("issue_type"), F.col("o_orderpriority").alias("severity"))


@query("export_flags", _FLAGS + " SELECT * FROM fs")
def _(t: Tables):
    return _flags(t)


@query("filter_issues", _FLAGS + " SELECT issue_type, severity, count(*) AS issues FROM iss WHERE issue_type IN ('status_F') AND severity IN ('1-URGENT', '2-HIGH') GROUP BY ALL")
def _(t: Tables):
    return flags.filtered(_issues(t), ["status_F"], ["1-URGENT", "2-HIGH"]).groupBy("issue_type", "severity").agg(F.count("*").alias("issues"))


@query("top_flagged_items", _FLAGS + """, ki AS (SELECT item_id, array_to_string(list_sort(list(DISTINCT issue_type)), ',') AS it FROM iss GROUP BY 1), tp AS (SELECT * FROM fs ORDER BY score DESC, diagnostic, item_id LIMIT 50)
SELECT CAST(row_number() OVER (ORDER BY score DESC, diagnostic, item_id) AS INT) AS place, item_id, diagnostic, score, it IS NOT NULL AS has_issue, coalesce(it, '') AS issue_types FROM tp LEFT JOIN ki USING (item_id)""")
def _(t: Tables):
    return flags.top(_flags(t), _issues(t))


def _c(e: str) -> str:
    return f"least(greatest(coalesce({e}, 0), 0), 1)"


_ISS = _FLAGS + _CH + """, oc AS (SELECT item_id, choice, c, sum(c) OVER (PARTITION BY item_id) AS n, row_number() OVER (PARTITION BY item_id ORDER BY c DESC, choice) AS k FROM (SELECT item_id, choice, count(*) AS c FROM ch GROUP BY ALL)),
os AS (SELECT item_id, -sum(c / n * ln(c / n)) / ln(4.0) AS entropy, sum(CASE WHEN k <= 2 THEN c / n END) AS bimodal, max(c / n) AS top_share FROM oc GROUP BY item_id), j AS (SELECT * FROM ir JOIN os USING (item_id)), sc AS (""" + " UNION ALL ".join(
    f"SELECT item_id, '{n}' AS diagnostic, round({e}, 9) AS score FROM j"
    for n, e in (("item_disagreement", _c("4 * p * (1 - p)")), ("low_discrimination", _c(f"1 - {_c('discrimination')}")), ("negative_discrimination", _c("-discrimination")), ("option_entropy", _c("entropy")), ("bimodal_choice", _c("bimodal * entropy")), ("wrong_key", _c("top_share * (1 - p)")), ("difficulty", _c("1 - p")))
) + ")"


def _issue_scores(t: Tables):
    shape = diagnostics.option_shape(_choices(t)).drop("n")
    return flags.issue_scores(diagnostics.irt_items(t.full).join(shape, "item_id"))


@query("issue_specific_scores", _ISS + " SELECT * FROM sc")
def _(t: Tables):
    return _issue_scores(t)


@query("issue_specific_auc", _ISS + ", lb AS (SELECT sc.*, CASE WHEN item_id IN (SELECT item_id FROM iss) THEN 1 ELSE 0 END AS y FROM sc), rk AS (SELECT *, " + _avg_rank("score", "diagnostic") + " AS r FROM lb) SELECT diagnostic, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 9) AS auc FROM rk GROUP BY 1")
def _(t: Tables):
    labelled = _issue_scores(t).join(_issues(t).select("item_id").distinct().withColumn("y", F.lit(1)), "item_id", "left").withColumn("y", F.coalesce("y", F.lit(0)))
    return _rounded(roc_auc(labelled, "y", "score", ["diagnostic"]), "auc")


_REP = ", rp AS (SELECT unnest(range(20)) AS rep)"


@query("auc_bootstrap", _REP + _weights("det", "doc_id", 11) + ", wr AS (SELECT rep, y, score, w, sum(w) OVER (PARTITION BY rep ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(w) OVER (PARTITION BY rep, score) AS tied FROM det JOIN wt USING (doc_id)), au AS (SELECT rep, (sum(w * (upto - (tied - 1) / 2.0)) FILTER (y = 1) - (sum(w) FILTER (y = 1)) * (sum(w) FILTER (y = 1) + 1) / 2.0) / ((sum(w) FILTER (y = 1)) * (sum(w) FILTER (y <> 1))) AS auc FROM wr GROUP BY 1) SELECT round(quantile_cont(auc, 0.025), 9) AS low, round(quantile_cont(auc, 0.5), 9) AS mid, round(quantile_cont(auc, 0.975), 9) AS high FROM au")
def _(t: Tables):
    return _rounded(resampling.auc_ci(t.detector, "doc_id", 20, 11), "low", "mid", "high")


@query("brier_bootstrap", _REP + _weights("det", "doc_id", 12) + ", br AS (SELECT rep, sum(w * (score / 997.0 - y) * (score / 997.0 - y)) / sum(w) AS b FROM det JOIN wt USING (doc_id) GROUP BY 1) SELECT round(quantile_cont(b, 0.025), 9) AS low, round(quantile_cont(b, 0.5), 9) AS mid, round(quantile_cont(b, 0.975), 9) AS high FROM br")
def _(t: Tables):
    rows = t.detector.withColumn("value", F.pow(F.col("score") / 997.0 - F.col("y"), F.lit(2)))
    return _rounded(resampling.mean_ci(rows, "doc_id", "value", 20, 12), "low", "mid", "high")


# --- integrity
@query("measurement_assumptions", """, z AS (SELECT count(DISTINCT model_id) AS models, count(DISTINCT item_id) AS items, count(DISTINCT subject) AS subjects, count(score) AS cells FROM bin), ab AS (SELECT avg(score) AS a FROM bin GROUP BY model_id),
s AS (SELECT models, items, subjects, 1 - cells / (models * items) AS mf, (SELECT max(a) - min(a) FROM ab) AS spread, (SELECT count(*) FILTER (a <= 0.01 OR a >= 0.99) FROM ab) AS saturated_models, (SELECT max(c) / sum(c) FROM (SELECT count(*) AS c FROM fam GROUP BY family)) AS fs, (SELECT min(c) FROM (SELECT count(DISTINCT item_id) AS c FROM bin GROUP BY subject)) AS li FROM z),
b AS (SELECT *, array_to_string(list_filter([CASE WHEN models < 8 THEN 'model_count_below_8' END, CASE WHEN items < 40 THEN 'item_count_below_40' END, CASE WHEN subjects < 2 THEN 'subject_count_below_2' END, CASE WHEN li < 5 THEN 'subject_item_count_below_5' END, CASE WHEN mf > 0.10 THEN 'missingness_too_high' END, CASE WHEN spread < 0.05 THEN 'ability_spread_too_narrow' END, CASE WHEN fs > 0.50 THEN 'model_family_concentration_too_high' END], lambda x: x IS NOT NULL), ',') AS blockers FROM s)
SELECT models, items, subjects, round(mf, 9) AS missing_fraction, round(spread, 9) AS spread, saturated_models, round(fs, 9) AS family_share, blockers, blockers = '' AS ready FROM b""")
def _(t: Tables):
    return _rounded(integrity.measurement_assumptions(t.binary, t.families), "missing_fraction", "spread", "family_share")


@query("panel_readiness", """, z AS (SELECT count(DISTINCT model_id) AS models, count(DISTINCT item_id) AS items, count(score) AS cells FROM f), s AS (SELECT models, items, 1 - cells / (models * items) AS mf, (SELECT max(a) - min(a) FROM acc) AS spread, (SELECT avg(CASE WHEN abs(a - 0.25) <= 0.05 THEN 1.0 ELSE 0.0 END) FROM acc) AS nc FROM z),
b AS (SELECT *, array_to_string(list_filter([CASE WHEN models < 50 THEN 'too_few_models' END, CASE WHEN items < 198 THEN 'too_few_items' END, CASE WHEN mf > 0.10 THEN 'too_many_missing' END, CASE WHEN spread < 0.05 THEN 'spread_too_narrow' END], lambda x: x IS NOT NULL), ',') AS blockers FROM s)
SELECT models, items, round(mf, 9) AS missing_fraction, round(spread, 9) AS spread, round(nc, 9) AS near_chance, blockers, blockers = '' AS ready FROM b""")
def _(t: Tables):
    return _rounded(integrity.panel_readiness(t.full), "missing_fraction", "spread", "near_chance")


_VAR = ", vr AS (SELECT coalesce(r.v, q.v) AS prompt_variant, coalesce(r.c, 0) AS cells, CASE WHEN q.v IS NULL THEN 'extra' WHEN r.v IS NULL THEN 'missing' ELSE 'present' END AS status FROM (SELECT prompt_variant AS v, count(*) AS c FROM responses GROUP BY 1) r FULL JOIN (SELECT unnest(['full', 'question_removed']) AS v) q ON r.v = q.v)"


@query("variant_cache", _VAR + " SELECT * FROM vr")
def _(t: Tables):
    return integrity.variants(t.responses, ["full", "question_removed"])


def _record_rules(t: Tables):
    return integrity.record_contract(t.raw("lineitem"), ["l_orderkey", "l_shipdate"], {"l_returnflag": ["A", "N"], "l_linestatus": ["F", "O"]}, {"l_discount": (0.0, 0.08)})


_CONTRACT = ", ct AS (" + " UNION ALL ".join(f"SELECT '{n}' AS check, count(*) FILTER (NOT ({e})) AS failed FROM lineitem" for n, e in (("l_orderkey_given", "l_orderkey IS NOT NULL"), ("l_shipdate_given", "l_shipdate IS NOT NULL"), ("l_returnflag_known", "l_returnflag IN ('A', 'N')"), ("l_linestatus_known", "l_linestatus IN ('F', 'O')"), ("l_discount_in_range", "l_discount BETWEEN 0.0 AND 0.08"))) + ")"


@query("record_contract", _CONTRACT + " SELECT \"check\", failed, failed = 0 AS passed FROM ct")
def _(t: Tables):
    return _record_rules(t)


@query("go_no_go", _VAR + _CONTRACT + ", al2 AS (SELECT failed = 0 AS ok FROM ct UNION ALL SELECT status <> 'missing' FROM vr) SELECT count(*) AS checks, count(*) FILTER (NOT ok) AS failed, bool_and(ok) AS go FROM al2")
def _(t: Tables):
    present = integrity.variants(t.responses, ["full", "question_removed"]).select(F.col("prompt_variant").alias("check"), (F.col("status") != "missing").alias("passed"))
    return integrity.verdict(_record_rules(t), present)


@query("execution_identity", "SELECT 'status' AS field, count(*) AS compared, count(*) FILTER (a.o_orderstatus IS DISTINCT FROM b.o_orderstatus) AS different FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 UNION ALL SELECT 'priority', count(*), count(*) FILTER (a.o_orderpriority IS DISTINCT FROM b.o_orderpriority) FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1", prelude=False)
def _(t: Tables):
    left = t.raw("orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return integrity.identity(left, left.withColumn("o_orderkey", F.col("o_orderkey") - 1), "o_orderkey", ["status", "priority"])


def _option_items(t: Tables):
    """item_id, prompt and four options: runs of words of the benchmark's texts."""
    w = F.split(X.squeeze(F.col("text")), " ")
    part = lambda k: F.array_join(F.slice(w, k * 3 + 1, 3 + k), " ")
    return _bench(t).select("item_id", F.col("text").alias("prompt"), F.create_map(*[e for k, c in enumerate("ABCD") for e in (F.lit(c), part(k))]).alias("choices"))


_OPT = f"sw AS (SELECT item_id, text, string_split({_SQZ}, ' ') AS w FROM benchmark), op AS (" + " UNION ALL ".join(f"SELECT item_id, text, '{c}' AS label, array_to_string(w[{k * 3 + 1}:{k * 3 + 3 + k}], ' ') AS o FROM sw" for k, c in enumerate("ABCD")) + ")"


@query("choice_item_checks", "WITH " + _OPT + """, im AS (SELECT item_id, text, count(DISTINCT o) AS d, ['A', 'B', 'C', 'D', 'E'][CAST(item_id % 5 + 1 AS INT)] AS answer FROM op GROUP BY ALL)
SELECT 'labels' AS check, CAST(0 AS BIGINT) AS failed, true AS passed UNION ALL SELECT 'distinct_options', count(*) FILTER (d < 4), count(*) FILTER (d < 4) = 0 FROM im UNION ALL SELECT 'answer', count(*) FILTER (answer = 'E'), count(*) FILTER (answer = 'E') = 0 FROM im UNION ALL SELECT 'question', count(*) FILTER (trim(text) = ''), count(*) FILTER (trim(text) = '') = 0 FROM im
UNION ALL SELECT 'answer_not_told', count(*) FILTER (item_id % 7 = 0), count(*) FILTER (item_id % 7 = 0) = 0 FROM im UNION ALL SELECT 'repeated_item_id', coalesce(sum(c - 1), 0), coalesce(sum(c - 1), 0) = 0 FROM (SELECT count(*) AS c FROM im GROUP BY item_id % 50 HAVING count(*) > 1) UNION ALL SELECT 'repeated_question', coalesce(sum(c - 1), 0), coalesce(sum(c - 1), 0) = 0 FROM (SELECT count(*) AS c FROM im GROUP BY text HAVING count(*) > 1)""", prelude=False)
def _(t: Tables):
    items = _option_items(t).withColumn("answer", F.element_at(F.array(*map(F.lit, "ABCDE")), (F.col("item_id") % 5 + 1).cast("int")))
    told = F.when(F.col("item_id") % 7 == 0, F.create_map(F.lit("Gold"), F.lit("A"))).otherwise(F.create_map(F.lit("topic"), F.lit("x")))
    return integrity.choice_items(items.select((F.col("item_id") % 50).alias("item_id"), F.col("prompt").alias("question"), "choices", "answer", told.alias("metadata")))


# --- options
@query("extreme_length_options", "WITH " + _OPT + ", l AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(o) DESC, label DESC) AS a, row_number() OVER (PARTITION BY item_id ORDER BY length(o), label) AS b FROM op) SELECT item_id, max(CASE WHEN a = 1 THEN label END) AS longest, max(CASE WHEN b = 1 THEN label END) AS shortest FROM l GROUP BY 1", prelude=False)
def _(t: Tables):
    o = _option_items(t).select("item_id", F.explode("choices").alias("label", "text"))
    return options.extreme_length(o, True).withColumnRenamed("label", "longest").join(options.extreme_length(o, False).withColumnRenamed("label", "shortest"), "item_id")


@query("keyword_options", "WITH " + _OPT + f""", tk AS (SELECT item_id, label, list_distinct(list_filter(regexp_extract_all(o, '[a-z0-9]+'), lambda x: length(x) > 1 AND NOT list_contains(['{_STOP}'], x))) AS t FROM op), pt AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(reverse(text)), '[a-z0-9]+'), lambda x: length(x) > 1 AND NOT list_contains(['{_STOP}'], x))) AS p FROM benchmark),
s AS (SELECT item_id, label, len(list_intersect(t, p)) AS n, row_number() OVER (PARTITION BY item_id ORDER BY len(list_intersect(t, p)) DESC, label DESC) AS k FROM tk JOIN pt USING (item_id)) SELECT item_id, CASE WHEN n > 0 THEN label ELSE 'A' END AS label FROM s WHERE k = 1""", prelude=False)
def _(t: Tables):
    o = _option_items(t)
    return options.keyword_overlap(o.select("item_id", F.explode("choices").alias("label", "text")), o.select("item_id", F.reverse("prompt").alias("prompt")))


# --- repair
_REPAIR = _IRT + _AL + """, sus AS (SELECT item_id, round(greatest(coalesce(avg(vs) - avg(score), 0), 0), 9) AS suspicion, round(avg(abs(score - vs)), 9) AS pi FROM al GROUP BY 1),
rw2 AS (SELECT item_id, round(discrimination, 9) AS discrimination, CAST(item_id AS INT) % 37 = 0 AS duplicate, suspicion, CASE CAST(item_id AS INT) % 20 WHEN 3 THEN 'high local evidence' WHEN 4 THEN 'moderate local evidence' ELSE 'low local evidence' END AS overlap, pi, (CAST(item_id AS INT) % 15) / 100.0 AS si, CAST(item_id AS INT) % 11 = 0 AS critical FROM ir LEFT JOIN sus USING (item_id))"""


def _repair_rows(t: Tables):
    al = matrix.align(t.full, t.variant)
    sus = _rounded(diagnostics.shortcut_items(t.full, t.variant), "suspicion")
    pi = al.groupBy("item_id").agg(r9(F.avg(F.abs(F.col("score") - F.col("variant_score")))).alias("prompt_instability"))
    n = F.col("item_id").cast("int")
    rows = diagnostics.irt_items(t.full).select("item_id", r9("discrimination").alias("discrimination")).join(sus, "item_id", "left").join(pi, "item_id", "left")
    return rows.withColumns({"duplicate": n % 37 == 0, "overlap": F.when(n % 20 == 3, "high local evidence").when(n % 20 == 4, "moderate local evidence").otherwise("low local evidence"), "scorer_instability": (n % 15) / 100.0, "critical": n % 11 == 0})


_WHY = {
    "conservative": "CASE WHEN discrimination < -0.05 THEN 'negative_discrimination' END, CASE WHEN discrimination < 0.05 THEN 'low_discrimination' END, CASE WHEN duplicate THEN 'duplicate_cluster' END, CASE WHEN suspicion >= 0.5 THEN 'shortcut_risk' END, CASE WHEN overlap = 'high local evidence' THEN 'local_overlap_risk' END, CASE WHEN pi > 0.4 THEN 'prompt_instability' END",
    "stable": "CASE WHEN discrimination < -0.05 THEN 'negative_discrimination' END, CASE WHEN discrimination < 0 THEN 'low_discrimination' END, CASE WHEN duplicate THEN 'duplicate_cluster' END, CASE WHEN suspicion >= 0.75 THEN 'shortcut_risk' END, CASE WHEN overlap = 'high local evidence' THEN 'local_overlap_risk' END, CASE WHEN pi > 0.2 THEN 'prompt_instability' END, CASE WHEN si > 0.1 THEN 'scorer_instability' END",
    "low_contamination_risk": "CASE WHEN duplicate THEN 'duplicate_cluster' END, CASE WHEN suspicion >= 0.9 THEN 'shortcut_risk' END, CASE WHEN overlap IN ('moderate local evidence', 'high local evidence') THEN 'local_overlap_risk' END",
    "high_information": "CASE WHEN discrimination < -0.05 THEN 'negative_discrimination' END, CASE WHEN discrimination < 0 THEN 'low_discrimination' END, CASE WHEN duplicate THEN 'duplicate_cluster' END, CASE WHEN suspicion >= 1 THEN 'shortcut_risk' END",
}


def _selected(policy: str) -> str:
    base = f"SELECT *, list_filter([{_WHY[policy]}], lambda x: x IS NOT NULL) AS rs FROM rw2"
    kept = f"SELECT *, len(rs) > 0 AND critical AS override, len(rs) = 0 OR critical AS sel FROM ({base})"
    if policy != "high_information":
        return f"SELECT '{policy}' AS policy, item_id, sel AS selected, override, array_to_string(rs, ',') AS reasons, discrimination, suspicion FROM ({kept})"
    cut = f"SELECT *, sel AND NOT critical AND row_number() OVER (PARTITION BY sel ORDER BY critical DESC, discrimination DESC, suspicion, item_id DESC) > round((SELECT count(*) FROM rw2) * 0.75) AS cut FROM ({kept})"
    return f"SELECT '{policy}', item_id, sel AND NOT cut, override, CASE WHEN cut THEN 'lower_information' ELSE array_to_string(rs, ',') END, discrimination, suspicion FROM ({cut})"


_POL = _REPAIR + ", sl AS (" + " UNION ALL ".join(map(_selected, _WHY)) + ")"


@query("repair_policies", _POL + " SELECT policy, item_id, selected, override, reasons FROM sl")
def _(t: Tables):
    rows, out = _repair_rows(t), None
    for p in repairs.POLICIES:
        one = repairs.select(rows, p).select(F.lit(p).alias("policy"), "item_id", "selected", "override", F.array_join("reasons", ",").alias("reasons"))
        out = one if out is None else out.unionByName(one)
    return out


@query("run_repair", _POL + " SELECT policy, count(*) AS items, count(*) FILTER (selected) AS kept, count(*) FILTER (override) AS overrides, round(avg(discrimination), 9) AS discrimination_before, round(avg(discrimination) FILTER (selected), 9) AS discrimination_after, round(avg(suspicion), 9) AS suspicion_before, round(avg(suspicion) FILTER (selected), 9) AS suspicion_after FROM sl GROUP BY 1")
def _(t: Tables):
    rows, out = _repair_rows(t), None
    for p in repairs.POLICIES:
        out = repairs.repair(rows, p) if out is None else out.unionByName(repairs.repair(rows, p))
    return _rounded(out, "discrimination_before", "discrimination_after", "suspicion_before", "suspicion_after")


# --- synthetic
@query("mock_panel", ", it2 AS (SELECT DISTINCT item_id FROM f), md AS (SELECT 'm' || k AS model_id, 0.1 * k + 0.1 AS ability FROM (SELECT unnest(range(8)) AS k)) SELECT model_id, count(*) AS items, avg(CASE WHEN " + _u("5", "model_id", "item_id") + " < ability THEN 1.0 ELSE 0.0 END) AS accuracy FROM it2, md GROUP BY 1")
def _(t: Tables):
    panel = synthetic.mock_panel(t.full.select("item_id").distinct(), [(f"m{k}", 0.1 * k + 0.1) for k in range(8)], 5)
    return panel.groupBy("model_id").agg(F.count("*").alias("items"), F.avg("score").alias("accuracy"))


@query("decoupled_readout", _CH + """, o AS (SELECT item_id, choice AS prediction, substr('ABCD', CAST(CAST(item_id AS INT) % 4 + 1 AS INT), 1) AS answer, CAST(model_id AS INT) % 9 > 0 AS valid FROM ch), g AS (SELECT item_id, avg(CASE WHEN valid THEN 0.0 ELSE 1.0 END) AS inv, avg(CASE WHEN prediction = answer THEN 1.0 ELSE 0.0 END) AS p FROM o GROUP BY 1)
SELECT item_id, round(greatest(inv, 1 - greatest(p, 1 - p)), 9) AS score FROM g""")
def _(t: Tables):
    answer = F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("item_id").cast("int") % 4 + 1))
    rows = _choices(t).select("item_id", F.col("choice").alias("prediction"), answer.alias("answer"), (F.col("model_id").cast("int") % 9 > 0).alias("valid"))
    return _rounded(synthetic.fixed_readout(rows), "score")


_SWEEP = ", sw2 AS (SELECT s AS strength, k AS seed, item_id, y, round(s * y + " + _u("k", "item_id") + ", 9) AS score FROM (SELECT item_id, CASE WHEN CAST(item_id AS INT) % 4 = 0 THEN 1 ELSE 0 END AS y FROM it), (SELECT unnest([0.0, 0.25, 0.5]) AS s), (SELECT unnest(range(4)) AS k))"


@query("detector_sweep", _SWEEP + ", rk AS (SELECT *, " + _avg_rank("score", "strength, seed") + " AS r FROM sw2), au AS (SELECT strength, seed, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM rk GROUP BY ALL) SELECT CAST(strength AS DOUBLE) AS strength, (SELECT round(avg(auc), 9) FROM au WHERE au.strength = sw2.strength) AS auc, round(avg(score) FILTER (y = 1), 9) AS flawed, round(avg(score) FILTER (y = 0), 9) AS clean FROM sw2 GROUP BY strength")
def _(t: Tables):
    items = t.full.select("item_id").distinct().withColumn("y", F.when(F.col("item_id").cast("int") % 4 == 0, 1).otherwise(0))
    return _rounded(synthetic.sweep_summary(synthetic.detector_sweep(items, [0.0, 0.25, 0.5], 4)), "auc", "flawed", "clean")


@query("ordinal_spearman", ", r AS (SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY score, doc_id) AS x, row_number() OVER (PARTITION BY subject ORDER BY y, doc_id) AS z FROM det) SELECT subject, round(corr(x, z), 9) AS spearman FROM r GROUP BY 1")
def _(t: Tables):
    return _rounded(synthetic.ordinal_spearman(t.detector, "score", "y", "doc_id", ["subject"]), "spearman")


@query("synthetic_flaws", "WITH g AS (SELECT CAST(i AS VARCHAR) AS item_id FROM (SELECT unnest(range(300)) AS i)), w AS (SELECT item_id, CASE WHEN " + _u("9", "item_id", "'is'") + " < 0.5 THEN ['" + "', '".join(synthetic.FLAWS) + "'][CAST(floor(" + _u("9", "item_id", "'which'") + f" * {len(synthetic.FLAWS)}) + 1 AS INT)] ELSE 'clean' END AS flaw FROM g) SELECT flaw, count(*) AS items, CASE WHEN flaw IN ('wrong_key', 'no_correct') THEN 0.05 WHEN flaw IN ('two_correct', 'ambiguous_wording', 'scorer_mismatch') THEN 0.5 WHEN flaw = 'format_sensitive' THEN 0.7 WHEN flaw = 'outdated_fact' THEN 0.3 ELSE 0.95 END AS right_if_known, CASE WHEN flaw IN ('answer_prior', 'longest_is_correct', 'keyword_leak', 'context_not_needed') THEN 0.7 WHEN flaw = 'contaminated' THEN 0.9 WHEN flaw = 'two_correct' THEN 0.5 WHEN flaw = 'no_correct' THEN 0.05 ELSE 0.25 END AS right_if_not FROM w GROUP BY 1", prelude=False)
def _(t: Tables):
    items = t.spark.range(300).select(F.col("id").cast("string").alias("item_id"))
    return synthetic.flawed(items, 0.5, 9).groupBy("flaw", "right_if_known", "right_if_not").agg(F.count("*").alias("items"))


@query("materiality_ladder", _AL + ", m AS (SELECT model_id, round(avg(vs) / nullif(avg(score), 0), 9) AS e FROM al GROUP BY 1) SELECT model_id, CASE WHEN e IS NULL THEN 'uncalibrated' WHEN CAST(model_id AS INT) % 7 = 0 THEN 'ranking-changing' WHEN abs(e) >= 0.70 THEN 'practically material' WHEN abs(e) > 0 THEN 'statistically detectable' ELSE 'negligible' END AS label FROM m")
def _(t: Tables):
    m = _rounded(diagnostics.shortcut_models(t.full, t.variant), "retention")
    return m.select("model_id", synthetic.materiality(F.lit("shortcut"), F.col("retention"), F.col("model_id").cast("int") % 7 == 0).alias("label"))


@query("rank_thresholds", ", x AS (SELECT model_id, rank() OVER (ORDER BY round(a, 12) DESC) AS r FROM acc), y AS (SELECT model_id, rank() OVER (ORDER BY round(a, 12) DESC) AS r FROM acc2), s AS (SELECT model_id, abs(x.r - y.r) AS rank_shift, (SELECT max(mr) - min(mr) FROM sar WHERE sar.model_id = x.model_id) AS subject_range FROM x JOIN y USING (model_id)) SELECT CAST(t AS INT) AS threshold, count(*) FILTER (rank_shift >= t) AS rank_shift, count(*) FILTER (subject_range >= t) AS subject_range FROM s, (SELECT unnest([1, 3, 5, 10]) AS t) GROUP BY 1, t")
def _(t: Tables):
    a, b = (rankings.ranked(rankings.level(m)).select("model_id", F.col("rank_min").alias(c)) for m, c in ((t.full, "x"), (t.second, "y")))
    ranges = rankings.subject_instability(t.full).select("model_id", F.col("rank_range").alias("subject_range"))
    return synthetic.rank_thresholds(a.join(b, "model_id").join(ranges, "model_id").select("model_id", F.abs(F.col("x") - F.col("y")).alias("rank_shift"), "subject_range"))


def _raw_outputs(t: Tables):
    """Real turns, some of them with a stated answer behind."""
    letter = F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("conv_id") % 4 + 1).cast("int"))
    k = (F.col("conv_id") + F.col("turn")) % 4
    raw = F.when(k == 0, F.concat("text", F.lit("\nThe answer is "), letter, F.lit("."))).when(k == 1, letter).when(k == 2, F.lit("  ")).otherwise(F.col("text"))
    return t.raw("conversations").select(F.col("role"), F.concat_ws("-", "conv_id", "turn").alias("task_id"), raw.alias("raw_output"), F.lit("B").alias("gold"))


_RAW = r"""WITH ro AS (SELECT role, conv_id || '-' || turn AS task_id, CASE (conv_id + turn) % 4 WHEN 0 THEN text || chr(10) || 'The answer is ' || substr('ABCD', CAST(conv_id % 4 + 1 AS INT), 1) || '.' WHEN 1 THEN substr('ABCD', CAST(conv_id % 4 + 1 AS INT), 1) WHEN 2 THEN '  ' ELSE text END AS o FROM conversations),
ex AS (SELECT *, nullif(upper(regexp_extract(trim(o), '^\(?([A-Da-d])\)?\.?$', 1)), '') AS a, coalesce(CASE WHEN regexp_full_match(upper(trim(o)), '[A-D]') THEN upper(trim(o)) END, nullif(regexp_extract(upper(trim(o)), '^\(?([A-D])[\).:]', 1), ''), nullif(regexp_extract(upper(trim(o)), '(^|[^A-Z0-9])([A-D])([^A-Z0-9]|$)', 2), '')) AS b,
list_extract(regexp_extract_all(upper(o), '(?:ANSWER(?: IS)?|OPTION|CHOICE)\s*[:=]?\s*\(?([A-D])(?:[^A-Z]|$)', 1), -1) AS c, regexp_matches(o, '(i can(no|''t)|i cannot|i am unable|i''m unable|unable to (answer|comply|help)|can(no|''t)t (answer|comply|help|assist)|as an ai|i won''t|i will not|not able to (answer|provide))', 'i') AS r, trim(o) = '' AS i FROM ro)"""


@query("extraction_audit", _RAW + """, q AS (SELECT role, a, b, c, i OR r OR coalesce(a, c, b) IS NULL AS bad, len(list_distinct(list_filter([a, b, c], lambda x: x IS NOT NULL))) AS k FROM ex)
SELECT role, count(*) AS n, round(avg(CASE WHEN a IS NOT NULL THEN 1.0 ELSE 0.0 END), 9) AS strict, round(avg(CASE WHEN b IS NOT NULL THEN 1.0 ELSE 0.0 END), 9) AS lenient, round(avg(CASE WHEN c IS NOT NULL THEN 1.0 ELSE 0.0 END), 9) AS stated, count(*) FILTER (k > 1) AS disagreements, count(*) FILTER (bad) AS invalid, round(1 - count(*) FILTER (bad) / count(*), 9) AS success, 1 - count(*) FILTER (bad) / count(*) >= 0.95 AS passed FROM q GROUP BY 1""", prelude=False)
def _(t: Tables):
    return _rounded(integrity.extraction_audit(_raw_outputs(t), ["role"]), "strict", "lenient", "stated", "success")


@query("judge_predictions", _RAW + """, v AS (SELECT task_id, variant, CASE variant WHEN 'strict' THEN a WHEN 'regex' THEN c ELSE CASE WHEN NOT r THEN b END END AS f FROM ex, (SELECT unnest(['strict', 'lenient', 'regex', 'mock']) AS variant))
SELECT task_id, variant, CASE variant WHEN 'regex' THEN 'regex_regex' WHEN 'mock' THEN 'local_mock_mock' ELSE 'rule_based_' || variant END AS judge, CASE WHEN f IS NULL THEN 'unscorable' WHEN f = 'B' THEN 'correct' ELSE 'incorrect' END AS label, CASE WHEN f IS NULL THEN 0.4 WHEN variant IN ('strict', 'regex') THEN 0.9 ELSE 0.75 END AS confidence FROM v""", prelude=False)
def _(t: Tables):
    return synthetic.judges(_raw_outputs(t))


# --- forensics in one table
@query("data_forensics", f""", k AS (SELECT doc_id, lang, source, md5({_SQZ}) AS x, md5({_TEMPLATE}) AS y FROM documents), n AS (SELECT count(DISTINCT doc_id) AS n FROM documents),
s AS (SELECT 'exact_duplicate' AS signal, count(*) AS flagged FROM k WHERE doc_id > (SELECT min(doc_id) FROM k z WHERE z.x = k.x) UNION ALL SELECT 'template_duplicate', count(*) FROM k WHERE doc_id > (SELECT min(doc_id) FROM k z WHERE z.y = k.y) UNION ALL SELECT 'relative_time', count(*) FROM documents WHERE regexp_matches(text, '\\b(today|current|currently|latest|recent|now|this year|last year|as of)\\b', 'i'))
SELECT signal, flagged, round(flagged / n, 9) AS rate, CASE WHEN flagged = 0 THEN 'no local evidence found' WHEN flagged / n < 0.05 THEN 'low local evidence' WHEN flagged / n < 0.20 THEN 'moderate local evidence' ELSE 'high local evidence' END AS risk FROM s, n""")
def _(t: Tables):
    d = t.raw("documents").select(F.col("doc_id").alias("item_id"), "text")
    same = lambda e: forensics.duplicate_ids(d.select("item_id", F.md5(e).alias("key")), "key")
    parts = {"exact_duplicate": same(X.squeeze(F.col("text"))), "template_duplicate": same(X.template(F.col("text"))), "relative_time": d.where(F.col("text").rlike(forensics.RELATIVE_TIME))}
    return _rounded(synthetic.signals(parts, d), "rate")


@query("observable_success", "SELECT p_partkey, round(least(greatest(CASE WHEN p_size % 2 = 0 THEN 0.5 + 0.15 * (p_size / 50.0) - 0.25 * ((p_partkey % 10) / 10.0) ELSE 0.5 + 0.2 * (p_size / 50.0) - 0.2 * ((p_partkey % 10) / 10.0) END, 0), 1), 9) AS p FROM part", prelude=False)
def _(t: Tables):
    low = (F.col("p_partkey") % 10) / 10.0
    p = synthetic.observable_success(F.col("p_size") / 50.0, low, low, F.col("p_size") % 2 == 0)
    return t.raw("part").select("p_partkey", r9(p).alias("p"))
