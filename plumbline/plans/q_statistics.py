"""Queries of agreement, detector metrics, multiplicity and calibration."""

from pyspark.sql import functions as F

from plumbline.functions.stats import adjusted, average_precision, r9, roc_auc
from plumbline.operators import agreement, detectors, matrix
from plumbline.plans.bindings import Tables
from plumbline.plans.registry import query


def _rounded(df, *columns):
    return df.withColumns({c: r9(c) for c in columns})


_TC = ", lc AS (SELECT task_id, label, count(*) AS c FROM jud GROUP BY ALL), tk AS (SELECT task_id, sum(c) AS n, sum(c * (c - 1)) AS same, sum(c * c) AS cc FROM lc GROUP BY 1 HAVING sum(c) > 1), sh AS (SELECT label, sum(c) AS c FROM lc WHERE task_id IN (SELECT task_id FROM tk) GROUP BY 1) "


@query("raw_agreement", _TC + "SELECT CAST(sum(n * (n - 1)) / 2 AS BIGINT) AS pairs, round(sum(same) / sum(n * (n - 1)), 9) AS agreement FROM tk")
def _(t: Tables):
    return _rounded(agreement.raw_agreement(t.judgments), "agreement")


_P2 = ", pp AS (SELECT a.task_id, a.annotator AS rater_a, b.annotator AS rater_b, a.label AS la, b.label AS lb FROM jud a JOIN jud b ON a.task_id = b.task_id AND a.annotator < b.annotator) "


@query("cohen_kappa", _P2 + """, po AS (SELECT rater_a, rater_b, count(*) AS tasks, avg(CASE WHEN la = lb THEN 1.0 ELSE 0.0 END) AS po FROM pp GROUP BY ALL),
pe AS (SELECT x.rater_a, x.rater_b, sum(x.c * y.c) AS e FROM (SELECT rater_a, rater_b, la AS l, count(*) AS c FROM pp GROUP BY ALL) x JOIN (SELECT rater_a, rater_b, lb AS l, count(*) AS c FROM pp GROUP BY ALL) y USING (rater_a, rater_b, l) GROUP BY ALL)
SELECT rater_a, rater_b, tasks, round(CASE WHEN e >= tasks * tasks THEN 1.0 ELSE (po - coalesce(e, 0) / (tasks * tasks)) / (1 - coalesce(e, 0) / (tasks * tasks)) END, 9) AS kappa FROM po LEFT JOIN pe USING (rater_a, rater_b)""")
def _(t: Tables):
    return _rounded(agreement.cohen(t.judgments), "kappa")


@query("fleiss_kappa", _TC + ", p AS (SELECT avg(same / (n * (n - 1))) AS p, sum(n) AS total, count(*) AS tasks FROM tk), e AS (SELECT sum((c / total) * (c / total)) AS e FROM sh, p) SELECT tasks, round((p - e) / (1 - e), 9) AS kappa FROM p, e")
def _(t: Tables):
    return _rounded(agreement.fleiss(t.judgments, certain=float("nan")), "kappa")


@query("krippendorff_alpha", _TC + "SELECT CAST(total AS BIGINT) AS total, round(1 - differ / ((total * total - cc) / (total - 1)), 9) AS alpha FROM (SELECT sum((n * n - cc) / (n - 1)) AS differ, sum(n) AS total FROM tk), (SELECT sum(c * c) AS cc FROM sh)")
def _(t: Tables):
    return _rounded(agreement.krippendorff(t.judgments, certain=float("nan")), "alpha")


@query("label_confusion", _P2 + "SELECT least(la, lb) AS label_a, greatest(la, lb) AS label_b, count(*) AS pairs FROM pp GROUP BY ALL")
def _(t: Tables):
    return agreement.confusion(t.judgments)


@query("ambiguity_rate", "SELECT count(*) AS tasks, round(avg(CASE WHEN d > 1 THEN 1.0 ELSE 0.0 END), 9) AS ambiguity_rate FROM (SELECT task_id, count(*) AS n, count(DISTINCT label) AS d FROM jud GROUP BY 1) WHERE n > 1")
def _(t: Tables):
    return _rounded(agreement.ambiguity(t.judgments), "ambiguity_rate")


@query("majority_label", _TC.replace(" HAVING sum(c) > 1", "") + "SELECT task_id, label, votes, annotators FROM (SELECT task_id, label, max(c) OVER (PARTITION BY task_id) AS votes, CAST(sum(c) OVER (PARTITION BY task_id) AS BIGINT) AS annotators, row_number() OVER (PARTITION BY task_id ORDER BY c DESC, label) AS k FROM lc) WHERE k = 1")
def _(t: Tables):
    return agreement.majority(t.judgments)


def _judged(t: Tables):
    c = t.raw("conversations")
    return c.select(F.col("role").alias("judge"), "conv_id", (F.length("text") % 2).alias("score"), (F.col("conv_id") % 2).cast("int").alias("human"), F.length("text").alias("length"), (F.col("turn") % 3 == 0).alias("refused"))


@query("judge_reliability", """SELECT judge, count(*) AS n, round(avg(CASE WHEN score = human THEN 1.0 ELSE 0.0 END), 9) AS human_agreement, round(var_pop(score), 9) AS variance,
round(avg(CASE WHEN len > mid THEN score END) - avg(CASE WHEN len <= mid THEN score END), 9) AS length_bias, round(avg(CASE WHEN refused THEN score END) - avg(CASE WHEN NOT refused THEN score END), 9) AS refusal_bias
FROM (SELECT role AS judge, length(text) % 2 AS score, conv_id % 2 AS human, length(text) AS len, turn % 3 = 0 AS refused, quantile_cont(length(text), 0.5) OVER (PARTITION BY role) AS mid FROM conversations) GROUP BY 1""", prelude=False)
def _(t: Tables):
    return _rounded(agreement.judge_reliability(_judged(t)), "human_agreement", "variance", "length_bias", "refusal_bias")


@query("adjudication_queue", """, t AS (SELECT task_id, count(*) AS n, count(DISTINCT label) AS d FROM jud GROUP BY 1), q AS (
SELECT task_id, 'disagreement' AS queue, 1 AS priority FROM t WHERE d > 1 UNION ALL SELECT task_id, 'invalid_item', 0 FROM t WHERE task_id % 11 = 0 UNION ALL
SELECT task_id, 'ambiguous', 2 FROM t WHERE task_id % 7 = 0 UNION ALL SELECT task_id, 'single_annotator', 3 FROM t WHERE n < 2) SELECT * FROM q""")
def _(t: Tables):
    flags = t.judgments.select("task_id").distinct().select("task_id", (F.col("task_id") % 11 == 0).alias("invalid"), (F.col("task_id") % 7 == 0).alias("ambiguous"))
    return agreement.adjudication_queue(t.judgments, flags)


@query("adjudicated_labels", """, m AS (SELECT task_id, label FROM (SELECT task_id, label, row_number() OVER (PARTITION BY task_id ORDER BY c DESC, label) AS k FROM (SELECT task_id, label, count(*) AS c FROM jud GROUP BY ALL)) WHERE k = 1)
SELECT task_id, CASE WHEN task_id % 9 = 0 THEN 'X' ELSE label END AS label, task_id % 9 = 0 AND task_id % 2 = 0 AS invalid FROM m""")
def _(t: Tables):
    d = t.judgments.where("task_id % 9 = 0").select("task_id", F.when(F.col("annotator") >= 0, "X").alias("label"), (F.col("task_id") % 2 == 0).alias("invalid"), F.col("annotator").alias("sequence"))
    return agreement.apply_decisions(t.judgments, d)


_CONF = """count(*) FILTER (score >= 500 AND y = 1) AS tp, count(*) FILTER (score >= 500 AND y <> 1) AS fp, count(*) FILTER (score < 500 AND y <> 1) AS tn, count(*) FILTER (score < 500 AND y = 1) AS fn"""


@query("confusion_at_threshold", f", c AS (SELECT subject, {_CONF} FROM det GROUP BY 1) SELECT subject, tp, fp, tn, fn, round(tp / nullif(tp + fn, 0), 9) AS sensitivity, round(tn / nullif(tn + fp, 0), 9) AS specificity, round(fp / nullif(tn + fp, 0), 9) AS fpr, round(fn / nullif(tp + fn, 0), 9) AS fnr, round(tp / nullif(tp + fp, 0), 9) AS precision, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM c")
def _(t: Tables):
    return _rounded(detectors.confusion(t.detector, 500.0, ["subject"]), "sensitivity", "specificity", "fpr", "fnr", "precision", "f1")


_AUC = "SELECT subject, round((sum(CASE WHEN y = 1 THEN rk END) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y <> 1), 0), 9) AS auc FROM (SELECT *, rank() OVER (PARTITION BY subject ORDER BY score) + (count(*) OVER (PARTITION BY subject, score) - 1) / 2.0 AS rk FROM det) GROUP BY 1"
_AP = "SELECT subject, round(sum(p * h) / nullif(sum(h), 0), 9) AS ap FROM (SELECT subject, h, sum(h) OVER w / row_number() OVER w AS p FROM (SELECT *, CASE WHEN y = 1 THEN 1 ELSE 0 END AS h FROM det) WINDOW w AS (PARTITION BY subject ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)) GROUP BY 1"


@query("roc_auc", _AUC)
def _(t: Tables):
    return _rounded(roc_auc(t.detector, "y", "score", ["subject"]), "auc")


@query("pr_auc", _AP)
def _(t: Tables):
    return _rounded(average_precision(t.detector, "y", "score", "doc_id", ["subject"]), "ap")


@query("metric_bundle", f", m AS (SELECT subject, quantile_cont(score, 0.5) AS threshold FROM det GROUP BY 1), u AS ({_AUC}), p AS ({_AP}), c AS (SELECT subject, threshold, {_CONF.replace('500', 'threshold')} FROM det JOIN m USING (subject) GROUP BY ALL) SELECT subject, threshold, tp, fp, tn, fn, auc, ap FROM c JOIN u USING (subject) JOIN p USING (subject)")
def _(t: Tables):
    return _rounded(detectors.bundle(t.detector, ["subject"]), "auc", "ap").select("subject", "threshold", "tp", "fp", "tn", "fn", "auc", "ap")


@query("calibration_curve", """, e AS (SELECT min(score) AS lo, max(score) AS hi FROM det), g AS (SELECT least(floor((score - lo) / ((hi - lo) / 10)), 9) AS b, count(*) AS n, avg(score) AS ms, avg(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END) AS rate FROM det, e GROUP BY 1)
SELECT i AS bin, coalesce(n, 0) AS n, round(lo + (i + 0.5) * (hi - lo) / 10, 9) AS mid, round(ms, 9) AS mean_score, round(rate, 9) AS rate FROM (SELECT unnest(range(10)) AS i), e LEFT JOIN g ON b = i""")
def _(t: Tables):
    return _rounded(detectors.calibration_curve(t.detector), "mid", "mean_score", "rate")


@query("ece_brier_nll", """, c AS (SELECT subject, y, score / 997.0 AS c FROM det), g AS (SELECT subject, least(floor(c * 10), 9) AS b, count(*) AS n, sum(y) AS sy, sum(c) AS sc, sum((c - y) * (c - y)) AS q, sum(-(y * ln(greatest(least(c, 1 - 1e-8), 1e-8)) + (1 - y) * ln(1 - greatest(least(c, 1 - 1e-8), 1e-8)))) AS l FROM c GROUP BY ALL)
SELECT subject, CAST(sum(n) AS BIGINT) AS n, round(sum(abs(sy - sc)) / sum(n), 9) AS ece, round(sum(q) / sum(n), 9) AS brier, round(sum(l) / sum(n), 9) AS nll, round(sum(sc) / sum(n) - sum(sy) / sum(n), 9) AS overconfidence FROM g GROUP BY 1""")
def _(t: Tables):
    rows = t.detector.withColumn("c", F.col("score") / 997.0)
    return _rounded(detectors.calibration_error(rows, "c", "y", by=["subject"]), "ece", "brier", "nll", "overconfidence")


@query("abstention", """, r AS (SELECT score >= 300 AS answered, y AS correct, doc_id % 5 > 0 AS answerable FROM det)
SELECT round(count(*) FILTER (answered) / count(*), 9) AS coverage, round(avg(CASE WHEN answered THEN 1.0 - correct END), 9) AS selective_risk, round(count(*) FILTER (NOT answered AND answerable) / count(*) FILTER (NOT answered), 9) AS inappropriate_refusal,
round(count(*) FILTER (answered AND NOT answerable) / count(*) FILTER (answered), 9) AS inappropriate_answer, round(count(*) FILTER (answered) / count(*) * (1 - avg(CASE WHEN answered THEN 1.0 - correct END)), 9) AS risk_coverage FROM r""")
def _(t: Tables):
    rows = t.detector.select((F.col("score") >= 300).alias("answered"), F.col("y").alias("correct"), (F.col("doc_id") % 5 > 0).alias("answerable"))
    return _rounded(detectors.abstention(rows), "coverage", "selective_risk", "inappropriate_refusal", "inappropriate_answer", "risk_coverage")


@query("precision_at_k", """, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, subject, doc_id) AS rk, CASE WHEN y = 1 THEN 1 ELSE 0 END AS h FROM det)
SELECT CAST(k AS INT) AS k, CAST(sum(CASE WHEN rk <= k THEN h END) AS BIGINT) AS hits, round(sum(CASE WHEN rk <= k THEN h END) / count(*) FILTER (rk <= k), 9) AS precision, round(sum(CASE WHEN rk <= k THEN h END) / sum(h), 9) AS recall, round(sum(CASE WHEN rk <= k THEN h END) / count(*) FILTER (rk <= k) / (sum(h) / count(*)), 9) AS enrichment FROM r, (SELECT unnest([10, 25, 50]) AS k) GROUP BY 1""")
def _(t: Tables):
    return _rounded(detectors.at_k(t.detector, (10, 25, 50), []), "precision", "recall", "enrichment")


@query("empirical_p_values", """, n AS (SELECT score FROM det WHERE y <> 1), s AS (SELECT doc_id, score FROM det WHERE y = 1)
SELECT doc_id, round((1 + (SELECT count(*) FROM n WHERE n.score >= s.score)) / ((SELECT count(*) FROM n) + 1), 9) AS p, round((SELECT count(*) FROM n WHERE n.score <= s.score) / (SELECT count(*) FROM n), 9) AS null_percentile FROM s""")
def _(t: Tables):
    return _rounded(detectors.empirical_p(t.detector.where("y = 1").select("doc_id", "score"), t.detector.where("y <> 1"), "doc_id"), "p", "null_percentile")


@query("multiple_testing", """, r AS (SELECT key, p, row_number() OVER (ORDER BY p, key) AS k, count(*) OVER () AS n FROM tst), h AS (SELECT sum(1.0 / k) AS h FROM r)
SELECT key, round(p, 9) AS p, round(least(1, p * n), 9) AS bonferroni, round(least(1, max(p * (n - k + 1)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)), 9) AS holm,
round(least(1, min(p * n / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 9) AS bh, round(least(1, min(p * n / k * h) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 9) AS by_ FROM r, h""")
def _(t: Tables):
    return _rounded(adjusted(t.tests, "p", "key"), "p", "bonferroni", "holm", "bh", "by_")


@query("false_flag_budget", """, r AS (SELECT p, row_number() OVER (ORDER BY p, key) AS k, count(*) OVER () AS n FROM tst), q AS (SELECT p, min(p * n / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS q FROM r)
SELECT count(*) AS tests, count(*) FILTER (q <= 0.1) AS flags, round(count(*) * 0.05, 9) AS expected_false_flags, round(sum(CASE WHEN q <= 0.1 THEN least(1, q) ELSE 0 END), 6) AS expected_false_discoveries FROM q""")
def _(t: Tables):
    a = adjusted(t.tests, "p", "key")
    return a.agg(F.count("*").alias("tests"), F.count_if(F.col("bh") <= 0.1).alias("flags"), F.round(F.count("*") * 0.05, 9).alias("expected_false_flags"), F.round(F.sum(F.when(F.col("bh") <= 0.1, F.col("bh")).otherwise(0)), 6).alias("expected_false_discoveries"))


@query("threshold_at_fpr", "SELECT round(quantile_cont(score, 0.95), 9) AS threshold FROM det WHERE y <> 1")
def _(t: Tables):
    return _rounded(detectors.threshold_at_fpr(t.detector, 0.05), "threshold")


@query("subject_zscore", "SELECT doc_id, round(CASE WHEN sd > 0 THEN (score - m) / sd ELSE 0 END, 9) AS z FROM (SELECT doc_id, score, avg(score) OVER (PARTITION BY subject) AS m, stddev_pop(score) OVER (PARTITION BY subject) AS sd FROM det)")
def _(t: Tables):
    return _rounded(detectors.zscores(t.detector, "subject"), "z").select("doc_id", "z")


@query("distribution_summary", "SELECT count(score) AS n, round(avg(score), 9) AS mean, round(stddev_pop(score), 9) AS sd, min(score) AS least, max(score) AS largest, round(quantile_cont(score, 0.95), 9) AS p95, round(quantile_cont(score, 0.99), 9) AS p99 FROM det")
def _(t: Tables):
    return _rounded(detectors.summary(t.detector, "score"), "mean", "sd", "p95", "p99")


@query("effect_sizes", """SELECT round((avg(score) FILTER (y = 1) - avg(score) FILTER (y <> 1)) / sqrt(((count(*) FILTER (y = 1) - 1) * var_samp(score) FILTER (y = 1) + (count(*) FILTER (y <> 1) - 1) * var_samp(score) FILTER (y <> 1)) / (count(*) - 2)), 9) AS cohens_d,
round(avg(CASE WHEN score >= (SELECT quantile_cont(score, 0.5) FROM det) THEN 1.0 ELSE 0.0 END) FILTER (y = 1) / avg(CASE WHEN score >= (SELECT quantile_cont(score, 0.5) FROM det) THEN 1.0 ELSE 0.0 END) FILTER (y <> 1), 9) AS risk_ratio FROM det""")
def _(t: Tables):
    return _rounded(detectors.effect_sizes(t.detector), "cohens_d", "risk_ratio")
