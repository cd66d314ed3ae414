"""Choosing items: subset modes, annotation packets, blinded packets with controls, synthetic flaws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.rng import uniform
from plumbline.operators.diagnostics import balanced_subset

#: Modes of choosing items, by columns p, discrimination, information, risky, tag and value.
MODES = ("random_baseline", "top_discrimination", "maximum_information", "high_reliability", "low_contamination_risk", "balanced_by_construct_tag", "coverage_constrained")


def subset(items: DataFrame, mode: str, k: int, seed: int = 0) -> DataFrame:
    """item_id of the k items that a mode takes. Ties go to the larger id. ``high_reliability`` takes items of clear positive
    discrimination by information, and all by information if there are none; ``low_contamination_risk`` fills up with
    risky items by id; both balanced modes take turns over ``tag`` by information."""
    if mode not in MODES:
        raise ValueError(f"unknown subset mode: {mode}")
    if mode in ("balanced_by_construct_tag", "coverage_constrained"):
        return balanced_subset(items.withColumn("value", F.col("information")), k).select("item_id")
    if mode == "random_baseline":
        return items.orderBy(uniform(seed, "item_id"), "item_id").limit(k).select("item_id")
    disc, info, last = F.col("discrimination"), F.desc_nulls_last("information"), F.desc("item_id")
    if mode == "high_reliability":
        clear = items.where(disc >= 0.05)
        return subset(items if clear.isEmpty() else clear, "maximum_information", k)
    if mode == "low_contamination_risk":
        return items.orderBy(F.asc("risky"), F.when(~F.col("risky"), F.col("information")).desc_nulls_last(), F.asc("item_id")).limit(k).select("item_id")
    return items.orderBy(F.desc_nulls_last("discrimination") if mode == "top_discrimination" else info, last).limit(k).select("item_id")


def packet(items: DataFrame, strategy: str, k: int, seed: int = 0) -> DataFrame:
    """item_id, priority of an annotation packet: random, high_disagreement, low_discrimination, shortcut_suspicious or
    coverage_balanced (in turn over tags)."""
    u = uniform(seed, "item_id")
    if strategy == "coverage_balanced":
        turn = F.row_number().over(Window.partitionBy("tag").orderBy(u, "item_id"))
        return items.withColumn("priority", turn).orderBy("priority", "tag").limit(k).select("item_id", "priority")
    score = {"random": u, "high_disagreement": F.col("p") * (1 - F.col("p")), "low_discrimination": -F.coalesce("discrimination", F.lit(0.0)), "shortcut_suspicious": F.col("suspicion")}[strategy]
    return items.withColumn("priority", F.round(score, 9)).orderBy(F.desc("priority"), "item_id").limit(k).select("item_id", "priority")


def blinded_packet(items: DataFrame, controls: DataFrame, k: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(public, private): a simple random sample and all controls under blinded ids; the key stays private.

    ``controls``: item_id, expected. Every sampled item has the same inclusion probability, which is recorded."""
    n = items.count()
    drawn = items.join(controls, "item_id", "left_anti").orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), "item_id"), 256)).limit(k)
    rows = drawn.select("item_id", "text", F.lit(None).cast("string").alias("expected"), F.lit(min(1.0, k / max(n, 1))).alias("inclusion"))
    rows = rows.unionByName(items.join(controls, "item_id").select("item_id", "text", "expected", F.lit(1.0).alias("inclusion")))
    rows = rows.withColumn("blinded_id", F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit("blind"), "item_id"), 256), 1, 16))
    return rows.select("blinded_id", "text").orderBy("blinded_id"), rows.select("blinded_id", "item_id", "expected", "inclusion")


def control_match(labels: DataFrame, key: DataFrame, least: float = 0.8) -> DataFrame:
    """annotator, controls, matched, accepted: share of control items answered as expected."""
    j = labels.join(key.where("expected is not null"), "blinded_id")
    g = j.groupBy("annotator").agg(F.count("*").alias("controls"), F.avg((F.col("label") == F.col("expected")).cast("double")).alias("matched"))
    return g.withColumn("accepted", F.col("matched") >= least)


def with_flaws(items: DataFrame, flaws: list[str], share: float, seed: int) -> DataFrame:
    """Adds flaw: a share of items get one of the flaws by the hash generator, others are clean."""
    u, v = uniform(seed, "item_id", F.lit("is")), uniform(seed, "item_id", F.lit("which"))
    which = F.element_at(F.array(*map(F.lit, flaws)), (F.floor(v * len(flaws)) + 1).cast("int"))
    return items.withColumn("flaw", F.when(u < share, which).otherwise("clean"))


def ambiguity_reasons(items: DataFrame, votes: DataFrame) -> DataFrame:
    """item_id, reasons: majority against gold, split votes, several gold answers, no answer, few votes."""
    v = votes.groupBy("item_id", "label").agg(F.count("*").alias("c")).groupBy("item_id").agg(F.sum("c").alias("n"), F.max(F.struct("c", "label")).alias("m"))
    j = items.join(v, "item_id", "left")
    why = F.array_compact(F.array(
        F.when(F.col("m.label").isNotNull() & ~F.array_contains("golds", F.col("m.label")), F.lit("majority_against_gold")), F.when(F.col("m.c") / F.col("n") < 0.6, F.lit("split_votes")),
        F.when(F.size("golds") > 1, F.lit("several_golds")), F.when(F.size("golds") == 0, F.lit("no_gold")), F.when(F.coalesce("n", F.lit(0)) < 2, F.lit("few_votes")),
    ))
    return j.select("item_id", why.alias("reasons"))


def forbidden_fields(df: DataFrame, names: set[str]) -> list[str]:
    """Paths of the schema (structs and arrays of them included) whose last part is a forbidden name."""
    from pyspark.sql import types as T

    def walk(kind, path):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                here = f"{path}.{f.name}".lstrip(".")
                if f.name.lower() in names:
                    yield here
                yield from walk(f.dataType, here)
        elif isinstance(kind, T.ArrayType):
            yield from walk(kind.elementType, path)
        elif isinstance(kind, T.MapType):
            yield from walk(kind.valueType, path)

    return list(walk(df.schema, ""))
