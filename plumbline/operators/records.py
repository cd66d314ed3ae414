"""Record linkage, integrity audits, item repair, cross-benchmark tables and ranking views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.ranks import min_rank, place
from plumbline.functions.stats import ratio, spearman
from plumbline.operators.matrix import accuracy


def tiered_alignment(left: DataFrame, right: DataFrame, tiers: list[tuple[str, list[str], float]]) -> DataFrame:
    """left_id, right_id, tier, confidence: the first tier whose keys agree decides; more than one partner in that
    tier is ambiguous (right_id null); none is unaligned."""
    out = None
    for k, (name, keys, confidence) in enumerate(tiers):
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys])
        r = right.where(known).groupBy(*keys).agg(F.min("right_id").alias("right_id"), F.count("*").alias("n"))
        met = left.where(known).join(r, keys).select("left_id", "right_id", "n", F.lit(k).alias("k"), F.lit(name).alias("tier"), F.lit(confidence).alias("confidence"))
        out = met if out is None else out.unionByName(met)
    best = out.groupBy("left_id").agg(F.min(F.struct("k", "right_id", "n", "tier", "confidence")).alias("m"))
    j = left.select("left_id").join(best, "left_id", "left")
    one = F.col("m.n") == 1
    return j.select("left_id", F.when(one, F.col("m.right_id")).alias("right_id"), F.when(F.col("m").isNull(), "unaligned").when(one, F.col("m.tier")).otherwise("ambiguous").alias("tier"), F.when(one, F.col("m.confidence")).when(F.col("m").isNotNull(), F.least(F.col("m.confidence"), F.lit(0.5))).otherwise(0.0).alias("confidence"))


def flags_with_issues(flags: DataFrame, issues: DataFrame) -> DataFrame:
    """Every flag with the sorted issue types and severities of its item, and whether there are any."""
    i = issues.groupBy("item_id").agg(F.sort_array(F.collect_set("issue_type")).alias("issue_types"), F.sort_array(F.collect_set("severity")).alias("severities"))
    return flags.join(i, "item_id", "left").withColumn("confirmed", F.col("issue_types").isNotNull())


def missing_predictions(rows: DataFrame, items: DataFrame) -> DataFrame:
    """model_id, missing: items of the list that a model has no row for, by counts: no grid is built."""
    have = rows.join(items, "item_id", "left_semi").groupBy("model_id").agg(F.count_distinct("item_id").alias("have"))
    return have.crossJoin(F.broadcast(items.agg(F.count_distinct("item_id").alias("want")))).select("model_id", (F.col("want") - F.col("have")).alias("missing"))


def key_audit(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """rows, keys, repeated keys, contradictory keys (repeats whose value differs): one row."""
    k = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(value).alias("d"))
    return k.agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("d") > 1).alias("contradictory"))


def panel_audit(rows: DataFrame, gold: Column) -> DataFrame:
    """items, items with more than one gold answer, items not answered by all models, complete: one row."""
    models = rows.agg(F.count_distinct("model_id").alias("m"))
    i = rows.groupBy("item_id").agg(F.count_distinct(gold).alias("g"), F.count_distinct("model_id").alias("c")).crossJoin(F.broadcast(models))
    return i.agg(F.count("*").alias("items"), F.count_if(F.col("g") > 1).alias("gold_conflicts"), F.count_if(F.col("c") < F.col("m")).alias("partial"), F.every(F.col("c") == F.col("m")).alias("complete"))


def set_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: keys that only one of two frames has."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("side", F.lit("right")))


def checks(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """check, failed, passed for every rule, from one pass."""
    one = rows.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    pairs = ", ".join(f"'{n}', `{n}`" for n in rules)
    return one.selectExpr(f"stack({len(rules)}, {pairs}) as (check, failed)").withColumn("passed", F.col("failed") == 0)


def item_forensics(items: DataFrame, *parts: DataFrame) -> DataFrame:
    """Every item with the measures of each part (left joins on item_id)."""
    return reduce(lambda d, p: d.join(p, "item_id", "left"), parts, items)


def recommendation(rows: DataFrame) -> DataFrame:
    """Adds reasons, action, confidence by rules over p, discrimination, suspicion and duplicate."""
    why = F.array_compact(F.array(
        F.when(F.col("duplicate"), F.lit("duplicate")), F.when(F.col("discrimination") < -0.05, F.lit("negative_discrimination")), F.when(F.col("suspicion") > 0.2, F.lit("shortcut")),
        F.when(F.col("p") >= 0.95, F.lit("too_easy")), F.when(F.col("p") <= 0.05, F.lit("too_hard")),
    ))
    rows = rows.withColumn("reasons", why)
    action = F.when(F.array_contains("reasons", "duplicate"), "remove").when(F.size("reasons") >= 2, "remove").when(F.size("reasons") == 1, "review").otherwise("keep")
    known = sum((F.col(c).isNotNull().cast("int") for c in ("p", "discrimination", "suspicion")), F.lit(0))
    return rows.withColumns({"action": action, "confidence": F.when(known == 3, "high").when(known == 2, "medium").otherwise("low")})


def repair_diff(rows: DataFrame) -> DataFrame:
    """selected, items, mean p, mean discrimination, mean suspicion of kept and dropped items."""
    return rows.groupBy((F.col("action") == "keep").alias("selected")).agg(F.count("*").alias("items"), F.avg("p").alias("p"), F.avg("discrimination").alias("discrimination"), F.avg("suspicion").alias("suspicion"))


def removed_by_reason(rows: DataFrame) -> DataFrame:
    return rows.where("action <> 'keep'").select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("items"))


def rank_transfer(panels: DataFrame) -> DataFrame:
    """a, b, n, spearman, distance (1 - spearman), conclusion for pairs of benchmarks over their common models."""
    x, y = panels.alias("x"), panels.alias("y")
    p = x.join(y, F.expr("x.model_id = y.model_id and x.benchmark < y.benchmark")).select(F.col("x.benchmark").alias("a"), F.col("y.benchmark").alias("b"), F.col("x.accuracy").alias("u"), F.col("y.accuracy").alias("v"))
    s = spearman(p, "u", "v", ["a", "b"])
    r = F.col("spearman")
    return s.withColumns({"distance": 1 - r, "conclusion": F.when(F.col("n") < 5, "underpowered").when(r >= 0.7, "transfers").when(r >= 0.35, "partial").otherwise("does not transfer")})


def common_models(panels: DataFrame) -> DataFrame:
    """Models that every benchmark has."""
    n = panels.agg(F.count_distinct("benchmark").alias("n"))
    return panels.groupBy("model_id").agg(F.count_distinct("benchmark").alias("c")).crossJoin(F.broadcast(n)).where("c = n").select("model_id")


def views(full: DataFrame, scores: dict[str, DataFrame]) -> DataFrame:
    """view, model_id, score, rank, fallback: a ranking for each view; models without its evidence fall back to accuracy."""
    raw = accuracy(full)
    out = raw.select(F.lit("raw").alias("view"), "model_id", F.col("accuracy").alias("score"), F.lit(False).alias("fallback"))
    for name, s in scores.items():
        j = raw.join(s.select("model_id", F.col("score").alias("_s")), "model_id", "left")
        out = out.unionByName(j.select(F.lit(name).alias("view"), "model_id", F.coalesce("_s", "accuracy").alias("score"), F.col("_s").isNull().alias("fallback")))
    out = out.withColumn("score", F.round("score", 9))
    return out.withColumn("rank", min_rank("score", ["view"]))


def audit_diff(before: DataFrame, after: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """key, before, after, change: added, removed, changed or same."""
    j = before.select("key", F.col("value").alias("before")).join(after.select("key", F.col("value").alias("after")), "key", "full")
    return j.withColumn("change", F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.abs(F.col("after") - F.col("before")) > tolerance, "changed").otherwise("same"))


def badges(rows: DataFrame) -> DataFrame:
    """model_id, badge: by accuracy and evidence."""
    b = F.array_compact(F.array(F.when(F.col("rank") <= 3, F.lit("leader")), F.when(F.col("retention") < 0.7, F.lit("context_grounded")), F.when(F.col("rank_range") <= 3, F.lit("stable"))))
    return rows.select("model_id", F.explode(b).alias("badge"))


def runtime(rows: DataFrame) -> DataFrame:
    """benchmark, model_id, examples, seconds, tokens, examples per second."""
    return rows.groupBy("benchmark", "model_id").agg(F.count("*").alias("examples"), F.sum("seconds").alias("seconds"), F.sum("tokens").alias("tokens"), ratio(F.count("*"), F.sum("seconds")).alias("per_second"))


def shards(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Contiguous shards of sorted keys that differ by one row at most."""
    w = Window.partitionBy(F.lit(0)).orderBy(key)
    return rows.select(key).withColumn("shard", F.ntile(n).over(w) - 1)


def placed(scores: DataFrame, value: str) -> DataFrame:
    return scores.withColumn("place", place(value, [], F.col("model_id").desc()))
