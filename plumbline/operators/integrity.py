"""Integrity gates: item files, variants, records, panels, run identity, extraction audits. Every gate is a table of checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators.matrix import accuracy
from plumbline.operators.records import checks

# Names under which an item must not carry its answer, and labels of four-option items.
ANSWER_KEYS = ("answer", "correct", "gold", "label", "solution", "target")
LABELS = ("A", "B", "C", "D")


def choice_items(items: DataFrame) -> DataFrame:
    """check, failed, passed of four-option items (item_id, question, choices as map, answer, metadata as map): repeated
    ids, questions and options, other labels than A-D, answers outside them, answers told by the metadata."""
    repeated = lambda key: items.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("failed"))
    told = F.exists(F.map_keys(F.coalesce("metadata", F.create_map().cast("map<string,string>"))), lambda k: F.lower(k).isin(*ANSWER_KEYS))
    rules = {
        "labels": F.sort_array(F.map_keys("choices")) == F.array(*map(F.lit, LABELS)), "distinct_options": F.size(F.array_distinct(F.transform(F.map_values("choices"), X.squeeze))) == F.size("choices"),
        "answer": F.col("answer").isin(*LABELS), "question": F.length(F.trim(F.coalesce("question", F.lit("")))) > 0, "answer_not_told": ~told,
    }
    twice = [repeated(key).select(F.lit(f"repeated_{key}").alias("check"), "failed", (F.col("failed") == 0).alias("passed")) for key in ("item_id", "question")]
    return reduce(DataFrame.unionByName, [checks(items, rules), *twice])


def variants(responses: DataFrame, required: list[str]) -> DataFrame:
    """prompt_variant, cells, status: present, missing (required and without cells) or extra."""
    have = responses.groupBy("prompt_variant").agg(F.count("*").alias("cells"))
    need = responses.sparkSession.createDataFrame([(v,) for v in required], "prompt_variant string").withColumn("required", F.lit(True))
    out = have.join(need, "prompt_variant", "full")
    return out.select("prompt_variant", F.coalesce("cells", F.lit(0)).alias("cells"), F.when(F.col("required").isNull(), "extra").when(F.col("cells").isNull(), "missing").otherwise("present").alias("status"))


def verdict(*tables: DataFrame) -> DataFrame:
    """checks, failed, go of several tables with ``passed``: one row; it is a go only if every check passes."""
    every = reduce(DataFrame.unionByName, [t.select("check", "passed") for t in tables])
    return every.agg(F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("failed"), F.coalesce(F.every("passed"), F.lit(False)).alias("go"))


def panel_readiness(matrix: DataFrame, least_models: int = 50, least_items: int = 198, chance: float = 0.25, most_missing: float = 0.10, least_spread: float = 0.05) -> DataFrame:
    """models, items, missing_fraction, spread, near_chance, blockers (text), ready: one row."""
    size = matrix.agg(F.count_distinct("model_id").alias("models"), F.count_distinct("item_id").alias("items"), F.count("score").alias("cells"))
    acc = accuracy(matrix).agg((F.max("accuracy") - F.min("accuracy")).alias("spread"), F.avg((F.abs(F.col("accuracy") - chance) <= 0.05).cast("double")).alias("near_chance"))
    s = size.crossJoin(acc).withColumn("missing_fraction", 1 - F.try_divide(F.col("cells"), F.col("models") * F.col("items")))
    why = [(F.col("models") < least_models, "too_few_models"), (F.col("items") < least_items, "too_few_items"), (F.col("missing_fraction") > most_missing, "too_many_missing"), (F.col("spread") < least_spread, "spread_too_narrow")]
    return with_blockers(s.drop("cells"), why)


def with_blockers(rows: DataFrame, why: list[tuple[Column, str]]) -> DataFrame:
    """Adds blockers, the names of the conditions that hold (in order, joined by commas), and ready."""
    names = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in why])), ",")
    return rows.withColumn("blockers", names).withColumn("ready", F.col("blockers") == "")


def measurement_assumptions(matrix: DataFrame, families: DataFrame, least_models: int = 8, least_items: int = 40, least_subjects: int = 2, least_subject_items: int = 5, most_missing: float = 0.10, least_spread: float = 0.05, most_family: float = 0.50) -> DataFrame:
    """models, items, subjects, missing_fraction, spread, saturated_models, family_share, blockers, ready: one row."""
    size = matrix.agg(F.count_distinct("model_id").alias("models"), F.count_distinct("item_id").alias("items"), F.count_distinct("subject").alias("subjects"), F.count("score").alias("cells"))
    acc = accuracy(matrix).agg((F.max("accuracy") - F.min("accuracy")).alias("spread"), F.count_if((F.col("accuracy") <= 0.01) | (F.col("accuracy") >= 0.99)).alias("saturated_models"))
    small = matrix.groupBy("subject").agg(F.count_distinct("item_id").alias("c")).agg(F.min("c").alias("least_items"))
    fam = matrix.select("model_id").distinct().join(families, "model_id", "left").groupBy("family").agg(F.count("*").alias("c")).agg((F.max("c") / F.sum("c")).alias("family_share"), F.coalesce(F.sum(F.when(F.col("family").isNull(), F.col("c"))), F.lit(0)).alias("unmapped"))
    s = size.crossJoin(acc).crossJoin(small).crossJoin(fam).withColumn("missing_fraction", 1 - F.try_divide(F.col("cells"), F.col("models") * F.col("items")))
    why = [
        (F.col("models") < least_models, f"model_count_below_{least_models}"), (F.col("items") < least_items, f"item_count_below_{least_items}"), (F.col("subjects") < least_subjects, f"subject_count_below_{least_subjects}"),
        (F.col("least_items") < least_subject_items, f"subject_item_count_below_{least_subject_items}"), (F.col("missing_fraction") > most_missing, "missingness_too_high"), (F.col("spread") < least_spread, "ability_spread_too_narrow"),
        (F.col("unmapped") > 0, "model_family_mapping_incomplete"), ((F.col("unmapped") == 0) & (F.col("family_share") > most_family), "model_family_concentration_too_high"),
    ]
    return with_blockers(s, why).drop("cells", "least_items", "unmapped")


def record_contract(rows: DataFrame, required: list[str], enums: dict[str, list[str]], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """check, failed, passed: required fields that are null, values outside an enumeration or a range (nulls are the first
    rule's)."""
    rules: dict[str, Column] = {f"{c}_given": F.col(c).isNotNull() for c in required}
    rules |= {f"{c}_known": F.col(c).isNull() | F.col(c).isin(*v) for c, v in enums.items()}
    rules |= {f"{c}_in_range": F.col(c).isNull() | F.col(c).between(*v) for c, v in ranges.items()}
    return checks(rows, rules)


def identity(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """field, compared, different over the keys of both; nulls are equal to each other."""
    a, b = left.alias("a"), right.alias("b")
    j = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"))
    one = j.agg(F.count("*").alias("n"), *[F.count_if(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))).alias(f) for f in fields])
    stack = ", ".join(f"'{f}', n, `{f}`" for f in fields)
    return one.selectExpr(f"stack({len(fields)}, {stack}) as (field, compared, different)")


def extraction_audit(outputs: DataFrame, by: list[str], least: float = 0.95) -> DataFrame:
    """by..., n, strict, lenient, stated, disagreements, invalid, success, passed over raw outputs; an output fails if it is
    empty, refuses or gives no label."""
    t = F.col("raw_output")
    o = outputs.select(*by, X.strict_letter(t).alias("a"), X.mcq_label(t).alias("b"), X.final_answer(t).alias("c"), (X.invalid(t) | X.refusal(t) | X.extracted(t).isNull()).alias("bad"))
    kinds = F.size(F.array_distinct(F.array_compact(F.array("a", "b", "c"))))
    g = o.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(F.col(c).isNotNull().cast("double")).alias(n) for c, n in (("a", "strict"), ("b", "lenient"), ("c", "stated"))], F.count_if(kinds > 1).alias("disagreements"), F.count_if("bad").alias("invalid"))
    return g.withColumn("success", 1 - F.col("invalid") / F.col("n")).withColumn("passed", F.col("success") >= least)
