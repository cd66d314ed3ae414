"""Queries of sampling, scoring and ambiguity."""

from pyspark.sql import functions as F

from plumbline.functions import scoring
from plumbline.functions.stats import r9
from plumbline.operators import diagnostics, sampling
from plumbline.plans.bindings import Tables
from plumbline.plans.q_diagnostics import _IRT
from plumbline.plans.q_resampling import _u
from plumbline.plans.registry import query


def _items(t: Tables):
    d = diagnostics.irt_items(t.full).select("item_id", r9("p").alias("p"), r9("discrimination").alias("discrimination"), r9("information").alias("information"))
    s = diagnostics.item_stability(t.full, t.variant).select("item_id", r9("stability").alias("stability"))
    return d.join(s, "item_id", "left").withColumns({"risky": F.col("item_id").cast("int") % 3 == 0, "tag": F.col("item_id").cast("int") % 8})


_IT = _IRT + ", sm AS (SELECT item_id, round(p, 9) AS p, round(discrimination, 9) AS d, round(information, 9) AS i, CAST(item_id AS INT) % 3 = 0 AS risky, CAST(item_id AS INT) % 8 AS tag FROM ir)"


def _mode(name: str, order: str, where: str = "true") -> str:
    return f"SELECT '{name}' AS mode, item_id FROM (SELECT item_id FROM sm WHERE {where} ORDER BY {order} LIMIT 20)"


@query("subset_modes", _IT + ", bt AS (SELECT item_id, row_number() OVER (PARTITION BY tag ORDER BY i DESC, item_id) AS rd, tag FROM sm) " + " UNION ALL ".join([
    _mode("random_baseline", f"{_u('2', 'item_id')}, item_id"), _mode("top_discrimination", "d DESC, item_id DESC"), _mode("maximum_information", "i DESC, item_id DESC"), _mode("high_reliability", "i DESC, item_id DESC", "d >= 0.05"),
    _mode("low_contamination_risk", "risky, CASE WHEN NOT risky THEN i END DESC NULLS LAST, item_id"), "SELECT 'balanced_by_construct_tag' AS mode, item_id FROM (SELECT item_id FROM bt ORDER BY rd, tag LIMIT 20)", "SELECT 'coverage_constrained' AS mode, item_id FROM (SELECT item_id FROM bt ORDER BY rd, tag LIMIT 20)",
]))
def _(t: Tables):
    items, out = _items(t), None
    for mode in sampling.MODES:
        got = sampling.subset(items, mode, 20, 2).select(F.lit(mode).alias("mode"), "item_id")
        out = got if out is None else out.unionByName(got)
    return out


@query("annotation_packet", _IT + f" SELECT item_id, priority FROM (SELECT item_id, tag, row_number() OVER (PARTITION BY tag ORDER BY {_u('4', 'item_id')}, item_id) AS priority FROM sm) ORDER BY priority, tag LIMIT 30")
def _(t: Tables):
    return sampling.packet(_items(t), "coverage_balanced", 30, 4)


@query("flaw_assignment", f"SELECT flaw, count(*) AS items FROM (SELECT CASE WHEN {_u('6', 'item_id', chr(39) + 'is' + chr(39))} < 0.3 THEN ['typo', 'two_answers', 'leak'][CAST(floor({_u('6', 'item_id', chr(39) + 'which' + chr(39))} * 3) + 1 AS INT)] ELSE 'clean' END AS flaw FROM it) GROUP BY 1")
def _(t: Tables):
    return sampling.with_flaws(t.full.select("item_id").distinct(), ["typo", "two_answers", "leak"], 0.3, 6).groupBy("flaw").agg(F.count("*").alias("items"))


@query("scoring_ambiguity", """, vt AS (SELECT task_id AS item_id, label, count(*) AS c FROM jud GROUP BY ALL), m AS (SELECT item_id, n, c, label FROM (SELECT *, sum(c) OVER (PARTITION BY item_id) AS n, row_number() OVER (PARTITION BY item_id ORDER BY c DESC, label DESC) AS k FROM vt) WHERE k = 1)
SELECT item_id, array_to_string(list_filter([CASE WHEN NOT list_contains(CASE WHEN item_id % 5 = 0 THEN ['F', 'O'] ELSE ['F'] END, label) THEN 'majority_against_gold' END, CASE WHEN c / n < 0.6 THEN 'split_votes' END, CASE WHEN item_id % 5 = 0 THEN 'several_golds' END, CASE WHEN n < 2 THEN 'few_votes' END], lambda x: x IS NOT NULL), ',') AS reasons FROM m""")
def _(t: Tables):
    items = t.judgments.select(F.col("task_id").alias("item_id")).distinct().withColumn("golds", F.when(F.col("item_id") % 5 == 0, F.array(F.lit("F"), F.lit("O"))).otherwise(F.array(F.lit("F"))))
    return sampling.ambiguity_reasons(items, t.judgments.withColumnRenamed("task_id", "item_id")).select("item_id", F.array_join("reasons", ",").alias("reasons"))


@query("score_answers", "SELECT k AS family, count(*) AS n, round(avg(s), 9) AS score FROM (SELECT ['choice', 'boolean', 'numeric', 'text'][CAST(conv_id % 4 + 1 AS INT)] AS k, CASE WHEN turn % 2 = 0 THEN 1.0 ELSE 0.0 END AS s FROM conversations) GROUP BY 1", prelude=False)
def _(t: Tables):
    k = F.element_at(F.array(*map(F.lit, ("choice", "boolean", "numeric", "text"))), (F.col("conv_id") % 4 + 1).cast("int"))
    even = F.col("turn") % 2 == 0
    raw = F.when(k == "choice", F.when(even, "The answer is B").otherwise("C")).when(k == "boolean", F.when(even, "so yes").otherwise("no")).when(k == "numeric", F.when(even, "total #### 1,200").otherwise("about 7")).otherwise(F.when(even, ' "Big  Cat" ').otherwise("dog"))
    gold = F.when(k == "choice", "b").when(k == "boolean", "true").when(k == "numeric", "1200.0").otherwise("big cat")
    rows = t.raw("conversations").select(k.alias("family"), raw.alias("raw"), gold.alias("gold"))
    return rows.groupBy("family").agg(F.count("*").alias("n"), r9(F.avg(scoring.by_family(F.col("family"), F.col("raw"), F.col("gold")))).alias("score"))
