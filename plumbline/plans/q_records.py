"""Queries of linkage, integrity, repair, transfer, views and synthetic panels."""

from pyspark.sql import functions as F

from plumbline.functions.rng import uniform
from plumbline.functions.stats import r9
from plumbline.operators import diagnostics, matrix, rankings
from plumbline.operators import records as R
from plumbline.plans.bindings import Tables
from plumbline.plans.q_diagnostics import _AL, _IRT
from plumbline.plans.registry import query
from plumbline.streaming.ingest import running_accuracy


def _rounded(df, *columns):
    return df.withColumns({c: r9(c) for c in columns})


def _sides(t: Tables):
    d = t.raw("documents").select("doc_id", F.md5("text").alias("h"), F.col("lang"), F.col("n_chars"))
    left = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("left_id"), F.when(F.col("doc_id") % 6 == 0, F.col("doc_id") + 1).alias("sid"), "h", "lang", "n_chars")
    right = d.where("doc_id % 2 = 1").select(F.col("doc_id").alias("right_id"), F.col("doc_id").alias("sid"), "h", "lang", "n_chars")
    return left, right


@query("tiered_alignment", """WITH d AS (SELECT doc_id, md5(text) AS h, lang, n_chars FROM documents), l AS (SELECT doc_id AS left_id, CASE WHEN doc_id % 6 = 0 THEN doc_id + 1 END AS sid, h, lang, n_chars FROM d WHERE doc_id % 2 = 0), r AS (SELECT doc_id AS right_id, doc_id AS sid, h, lang, n_chars FROM d WHERE doc_id % 2 = 1),
m AS (SELECT left_id, right_id, 0 AS k, 'direct' AS tier, 1.0 AS c FROM l JOIN r USING (sid) UNION ALL SELECT left_id, right_id, 1, 'hash', 0.95 FROM l JOIN r USING (h) UNION ALL SELECT left_id, right_id, 2, 'structure', 0.85 FROM l JOIN r USING (lang, n_chars)),
b AS (SELECT left_id, min(k) AS k FROM m GROUP BY 1), g AS (SELECT left_id, min(right_id) AS right_id, count(*) AS n, min(tier) AS tier, min(c) AS c FROM m JOIN b USING (left_id, k) GROUP BY 1)
SELECT left_id, CASE WHEN n = 1 THEN right_id END AS right_id, CASE WHEN n IS NULL THEN 'unaligned' WHEN n = 1 THEN tier ELSE 'ambiguous' END AS tier, CAST(CASE WHEN n = 1 THEN c WHEN n > 1 THEN least(c, 0.5) ELSE 0 END AS DOUBLE) AS confidence FROM l LEFT JOIN g USING (left_id)""", prelude=False)
def _(t: Tables):
    left, right = _sides(t)
    return R.tiered_alignment(left, right, [("direct", ["sid"], 1.0), ("hash", ["h"], 0.95), ("structure", ["lang", "n_chars"], 0.85)])


@query("flags_vs_issues", """WITH fl AS (SELECT doc_id AS item_id, n_chars FROM documents WHERE n_chars > 2000), i AS (SELECT doc_id AS item_id, array_to_string(list_sort(list(DISTINCT CASE WHEN toxic = 1 THEN 'toxic' ELSE 'quality' END)), ',') AS issue_types FROM labels WHERE toxic = 1 OR quality = 0 GROUP BY 1)
SELECT item_id, n_chars, issue_types, issue_types IS NOT NULL AS confirmed FROM fl LEFT JOIN i USING (item_id)""", prelude=False)
def _(t: Tables):
    flags = t.raw("documents").where("n_chars > 2000").select(F.col("doc_id").alias("item_id"), "n_chars")
    issues = t.raw("labels").where("toxic = 1 or quality = 0").select(F.col("doc_id").alias("item_id"), F.when(F.col("toxic") == 1, "toxic").otherwise("quality").alias("issue_type"), F.lit("major").alias("severity"))
    return R.flags_with_issues(flags, issues).select("item_id", "n_chars", F.array_join("issue_types", ",").alias("issue_types"), "confirmed")


@query("anti_missing_predictions", "SELECT model_id, (SELECT count(DISTINCT item_id) FROM responses) - count(DISTINCT item_id) AS missing FROM f GROUP BY 1")
def _(t: Tables):
    return R.missing_predictions(t.full, t.responses.select("item_id").distinct())


@query("set_differences", "SELECT item_id, 'left' AS side FROM (SELECT item_id FROM f EXCEPT SELECT item_id FROM b2) UNION ALL SELECT item_id, 'right' FROM (SELECT item_id FROM b2 EXCEPT SELECT item_id FROM f)")
def _(t: Tables):
    return R.set_differences(t.full, t.second, "item_id")


@query("duplicate_key_audit", "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (d > 1) AS contradictory FROM (SELECT l_suppkey % 24 AS m, l_partkey % 200 AS i, count(*) AS n, count(DISTINCT l_returnflag) AS d FROM lineitem GROUP BY 1, 2)", prelude=False)
def _(t: Tables):
    rows = t.raw("lineitem").select((F.col("l_suppkey") % 24).alias("m"), (F.col("l_partkey") % 200).alias("i"), "l_returnflag")
    return R.key_audit(rows, ["m", "i"], F.col("l_returnflag"))


@query("panel_reproduction_audit", """, a AS (SELECT l_suppkey % 24 AS m, l_partkey % 200 AS i, l_linestatus AS g FROM lineitem), p AS (SELECT i, count(DISTINCT g) AS g, count(DISTINCT m) AS c FROM a GROUP BY 1)
SELECT count(*) AS items, count(*) FILTER (g > 1) AS gold_conflicts, count(*) FILTER (c < (SELECT count(DISTINCT m) FROM a)) AS partial, bool_and(c = (SELECT count(DISTINCT m) FROM a)) AS complete FROM p""")
def _(t: Tables):
    rows = t.raw("lineitem").select((F.col("l_suppkey") % 24).alias("model_id"), (F.col("l_partkey") % 200).alias("item_id"), "l_linestatus")
    return R.panel_audit(rows, F.col("l_linestatus"))


@query("record_checks", "SELECT 'positive_price' AS check, count(*) FILTER (o_totalprice <= 0) AS failed, count(*) FILTER (o_totalprice <= 0) = 0 AS passed FROM orders UNION ALL SELECT 'known_status', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')), count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) = 0 FROM orders", prelude=False)
def _(t: Tables):
    return R.checks(t.raw("orders"), {"positive_price": F.col("o_totalprice") > 0, "known_status": F.col("o_orderstatus").isin("F", "O")})


def _forensics(t: Tables):
    items = t.full.select("item_id").distinct().withColumn("duplicate", F.col("item_id").cast("int") % 37 == 0)
    irt = _rounded(diagnostics.irt_items(t.full).select("item_id", "p", "discrimination"), "p", "discrimination")
    return R.recommendation(R.item_forensics(items, irt, _rounded(diagnostics.shortcut_items(t.full, t.variant), "suspicion")))


_FOR = _IRT + _AL + """, sus AS (SELECT item_id, round(greatest(coalesce(avg(vs) - avg(score), 0), 0), 9) AS suspicion FROM al GROUP BY 1), fr AS (SELECT item_id, CAST(item_id AS INT) % 37 = 0 AS duplicate, round(p, 9) AS p, round(discrimination, 9) AS discrimination, suspicion FROM ir LEFT JOIN sus USING (item_id)),
wy AS (SELECT *, list_filter([CASE WHEN duplicate THEN 'duplicate' END, CASE WHEN discrimination < -0.05 THEN 'negative_discrimination' END, CASE WHEN suspicion > 0.2 THEN 'shortcut' END, CASE WHEN p >= 0.95 THEN 'too_easy' END, CASE WHEN p <= 0.05 THEN 'too_hard' END], lambda x: x IS NOT NULL) AS rs FROM fr),
rc AS (SELECT *, CASE WHEN duplicate OR len(rs) >= 2 THEN 'remove' WHEN len(rs) = 1 THEN 'review' ELSE 'keep' END AS action FROM wy)"""


@query("item_forensics_join", _FOR + " SELECT item_id, duplicate, p, discrimination, suspicion, array_to_string(rs, ',') AS reasons, action FROM rc")
def _(t: Tables):
    return _forensics(t).select("item_id", "duplicate", "p", "discrimination", "suspicion", F.array_join("reasons", ",").alias("reasons"), "action")


@query("repair_diff", _FOR + " SELECT action = 'keep' AS selected, count(*) AS items, round(avg(p), 9) AS p, round(avg(discrimination), 9) AS discrimination, round(avg(suspicion), 9) AS suspicion FROM rc GROUP BY 1")
def _(t: Tables):
    return _rounded(R.repair_diff(_forensics(t)), "p", "discrimination", "suspicion")


@query("removed_by_reason", _FOR + " SELECT reason, count(*) AS items FROM (SELECT unnest(rs) AS reason FROM rc WHERE action <> 'keep') GROUP BY 1")
def _(t: Tables):
    return R.removed_by_reason(_forensics(t))


def _panels(t: Tables):
    a = [("first", t.full), ("second", t.second), ("ablated", t.variant)]
    out = None
    for name, m in a:
        p = matrix.accuracy(m).select(F.lit(name).alias("benchmark"), "model_id", F.round("accuracy", 12).alias("accuracy"))
        out = p if out is None else out.unionByName(p)
    return out


_PAN = ", pn AS (SELECT 'first' AS bm, model_id, round(a, 12) AS a FROM acc UNION ALL SELECT 'second', model_id, round(a, 12) FROM acc2 UNION ALL SELECT 'ablated', model_id, round(a, 12) FROM accv)"


@query("rank_transfer", _PAN + """, pp AS (SELECT x.bm AS a, y.bm AS b, x.a AS u, y.a AS v FROM pn x JOIN pn y ON x.model_id = y.model_id AND x.bm < y.bm), r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY u) + (count(*) OVER (PARTITION BY a, b, u) - 1) / 2.0 AS ru, rank() OVER (PARTITION BY a, b ORDER BY v) + (count(*) OVER (PARTITION BY a, b, v) - 1) / 2.0 AS rv FROM pp),
s AS (SELECT a, b, round(corr(ru, rv), 9) AS spearman, count(*) AS n FROM r GROUP BY ALL) SELECT a, b, spearman, n, round(1 - spearman, 9) AS distance, CASE WHEN n < 5 THEN 'underpowered' WHEN spearman >= 0.7 THEN 'transfers' WHEN spearman >= 0.35 THEN 'partial' ELSE 'does not transfer' END AS conclusion FROM s""")
def _(t: Tables):
    return _rounded(R.rank_transfer(_panels(t)), "spearman", "distance")


@query("common_models", _PAN + " SELECT model_id FROM pn GROUP BY 1 HAVING count(DISTINCT bm) = 3")
def _(t: Tables):
    return R.common_models(_panels(t))


@query("ranking_views", _AL + """, sv AS (SELECT model_id, avg(score) - avg(vs) AS s FROM al WHERE CAST(model_id AS INT) % 5 > 0 GROUP BY 1), st AS (SELECT model_id, avg(least(score, coalesce(vs, 0))) AS s FROM al GROUP BY 1),
w AS (SELECT 'raw' AS view, model_id, round(a, 9) AS score, false AS fallback FROM acc UNION ALL SELECT 'shortcut', model_id, round(coalesce(s, a), 9), s IS NULL FROM acc LEFT JOIN sv USING (model_id) UNION ALL SELECT 'prompt_stable', model_id, round(coalesce(s, a), 9), s IS NULL FROM acc LEFT JOIN st USING (model_id))
SELECT *, rank() OVER (PARTITION BY view ORDER BY score DESC) AS rank FROM w""")
def _(t: Tables):
    al = matrix.align(t.full, t.variant)
    short = al.where("cast(model_id as int) % 5 > 0").groupBy("model_id").agg((F.avg("score") - F.avg("variant_score")).alias("score"))
    stable = al.groupBy("model_id").agg(F.avg(F.least("score", F.coalesce("variant_score", F.lit(0.0)))).alias("score"))
    return R.views(t.full, {"shortcut": short, "prompt_stable": stable})


@query("audit_diff", ", j AS (SELECT model_id AS key, acc.a AS before, accv.a AS after FROM (SELECT * FROM acc WHERE CAST(model_id AS INT) > 2) acc FULL JOIN (SELECT * FROM accv WHERE CAST(model_id AS INT) < 20) accv USING (model_id)) SELECT key, round(before, 9) AS before, round(after, 9) AS after, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' WHEN abs(after - before) > 1e-9 THEN 'changed' ELSE 'same' END AS change FROM j")
def _(t: Tables):
    a = matrix.accuracy(t.full).where("cast(model_id as int) > 2").select(F.col("model_id").alias("key"), F.col("accuracy").alias("value"))
    b = matrix.accuracy(t.variant).where("cast(model_id as int) < 20").select(F.col("model_id").alias("key"), F.col("accuracy").alias("value"))
    return _rounded(R.audit_diff(a, b), "before", "after")


@query("badges", _AL + """, r AS (SELECT model_id, rank() OVER (ORDER BY round(a, 12) DESC) AS rank FROM acc), t AS (SELECT model_id, avg(vs) / avg(score) AS retention FROM al GROUP BY 1), g AS (SELECT model_id, max(mr) - min(mr) AS rr FROM sar GROUP BY 1)
SELECT model_id, 'leader' AS badge FROM r WHERE rank <= 3 UNION ALL SELECT model_id, 'context_grounded' FROM t WHERE round(retention, 9) < 0.7 UNION ALL SELECT model_id, 'stable' FROM g WHERE rr <= 3""")
def _(t: Tables):
    acc = matrix.accuracy(t.full).withColumn("accuracy", F.round("accuracy", 12))
    ranks = rankings.ranked(acc).select("model_id", F.col("rank_min").alias("rank"))
    rows = ranks.join(_rounded(diagnostics.shortcut_models(t.full, t.variant), "retention"), "model_id").join(rankings.subject_instability(t.full).select("model_id", "rank_range"), "model_id")
    return R.badges(rows)


@query("runtime_recalibration", "SELECT o_orderpriority AS benchmark, CAST(o_custkey % 5 AS VARCHAR) AS model_id, count(*) AS examples, round(sum(o_totalprice), 2) AS seconds, CAST(sum(o_orderkey) AS BIGINT) AS tokens, round(count(*) / sum(o_totalprice), 9) AS per_second FROM orders GROUP BY 1, 2", prelude=False)
def _(t: Tables):
    rows = t.raw("orders").select(F.col("o_orderpriority").alias("benchmark"), (F.col("o_custkey") % 5).cast("string").alias("model_id"), F.col("o_totalprice").alias("seconds"), F.col("o_orderkey").alias("tokens"))
    return R.runtime(rows).withColumns({"seconds": F.round("seconds", 2), "per_second": r9("per_second")})


@query("deterministic_shards", "SELECT p_partkey, CAST(ntile(7) OVER (ORDER BY p_partkey) - 1 AS INT) AS shard FROM part", prelude=False)
def _(t: Tables):
    return R.shards(t.raw("part"), "p_partkey", 7)


@query("running_accuracy", "SELECT date_trunc('hour', ts) AS window_start, event_type AS model_id, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM events GROUP BY 1, 2", prelude=False)
def _(t: Tables):
    e = t.raw("events").select("ts", F.col("event_type").alias("model_id"), "event_id", (F.col("value") > 50).cast("double").alias("score"))
    return running_accuracy(e, key=["event_id"]).withColumn("accuracy", r9("accuracy"))


_U = "(CAST(concat('0x', substr(md5(concat_ws('|', '21', CAST(m AS VARCHAR), CAST(i AS VARCHAR), s)), 1, 8)) AS BIGINT) / 4294967296.0)"


@query("synthetic_panel", f"""WITH g AS (SELECT m, i, s, (m / 10.0) AS ability, (i % 5) / 5.0 AS difficulty FROM (SELECT unnest(range(10)) AS m), (SELECT unnest(range(60)) AS i), (SELECT unnest(['clean', 'flawed']) AS s)),
r AS (SELECT m, s, CASE WHEN {_U} < CASE WHEN s = 'flawed' AND i % 4 = 0 THEN 0.9 ELSE 1 / (1 + exp(-3 * (ability - difficulty))) END THEN 1.0 ELSE 0.0 END AS score FROM g) SELECT m AS model_id, s AS condition, avg(score) AS accuracy FROM r GROUP BY ALL""", prelude=False)
def _(t: Tables):
    g = t.spark.range(10).withColumnRenamed("id", "m").crossJoin(t.spark.range(60).withColumnRenamed("id", "i")).withColumn("s", F.explode(F.array(F.lit("clean"), F.lit("flawed"))))
    p = F.when((F.col("s") == "flawed") & (F.col("i") % 4 == 0), 0.9).otherwise(1 / (1 + F.exp(-3 * (F.col("m") / 10.0 - (F.col("i") % 5) / 5.0))))
    return g.withColumn("score", (uniform(21, "m", "i", "s") < p).cast("double")).groupBy(F.col("m").alias("model_id"), F.col("s").alias("condition")).agg(F.avg("score").alias("accuracy"))
