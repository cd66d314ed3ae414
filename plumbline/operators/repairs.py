"""Item repair by policies: reasons to remove an item, items that coverage keeps, and subsets of a wanted size.

``rows``: item_id, discrimination, duplicate, suspicion, overlap (level, text), prompt_instability, scorer_instability,
critical (of coverage). Missing measures never remove an item."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Policy:
    negative: bool = True
    discrimination: float | None = None
    suspicion: float = 1.0
    overlaps: tuple[str, ...] = ()
    prompt: float | None = None
    scorer: float | None = None
    share: float | None = None  # of the items that stay, the most informative first


# The four policies.
POLICIES = {
    "conservative": Policy(discrimination=0.05, suspicion=0.50, overlaps=("high local evidence",), prompt=0.40),
    "stable": Policy(discrimination=0.0, suspicion=0.75, overlaps=("high local evidence",), prompt=0.20, scorer=0.10),
    "low_contamination_risk": Policy(negative=False, suspicion=0.90, overlaps=("moderate local evidence", "high local evidence")),
    "high_information": Policy(discrimination=0.0, suspicion=1.0, share=0.75),
}


def reasons(p: Policy) -> Column:
    """Why an item goes, in order."""
    d = F.col("discrimination")
    why = [(d < -0.05, "negative_discrimination")] if p.negative else []
    why += [(d < p.discrimination, "low_discrimination")] if p.discrimination is not None else []
    why += [(F.col("duplicate"), "duplicate_cluster"), (F.col("suspicion") >= p.suspicion, "shortcut_risk")]
    why += [(F.col("overlap").isin(*p.overlaps), "local_overlap_risk")] if p.overlaps else []
    why += [(F.col("prompt_instability") > p.prompt, "prompt_instability")] if p.prompt is not None else []
    why += [(F.col("scorer_instability") > p.scorer, "scorer_instability")] if p.scorer is not None else []
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in why]))


def select(rows: DataFrame, policy: str, size: int | None = None) -> DataFrame:
    """item_id, selected, override, reasons: items with a reason go unless coverage needs them; of those left, at most
    ``size`` (or the policy's share of all) stay, critical ones first, then by discrimination and low suspicion."""
    p = POLICIES[policy]
    r = rows.withColumn("reasons", reasons(p)).withColumn("override", (F.size("reasons") > 0) & F.coalesce(F.col("critical"), F.lit(False)))
    r = r.withColumn("selected", (F.size("reasons") == 0) | F.col("override"))
    if p.share is not None or size:
        wanted = F.lit(size) if size else F.round(F.count("*").over(Window.partitionBy(F.lit(0))) * p.share)
        critical = F.coalesce(F.col("critical"), F.lit(False))
        # items of one benchmark: a panel's dimension, not its cells
        place = F.row_number().over(Window.partitionBy("selected").orderBy(F.desc(critical), F.coalesce("discrimination", F.lit(0.0)).desc(), F.coalesce("suspicion", F.lit(0.0)).asc(), F.desc("item_id")))
        r = r.withColumns({"_place": place, "_wanted": wanted})
        trim = F.col("selected") & (F.col("_place") > F.col("_wanted")) & (~critical if p.share is not None else F.lit(True))
        r = r.withColumn("reasons", F.when(trim, F.array(F.lit("lower_information" if p.share is not None else "target_size_trim"))).otherwise(F.col("reasons"))).withColumn("selected", F.col("selected") & ~trim)
    return r.select("item_id", "selected", "override", "reasons")


def repair(rows: DataFrame, policy: str, size: int | None = None) -> DataFrame:
    """policy, items, kept, overrides, mean discrimination before and after, mean suspicion before and after: one row."""
    j = rows.join(select(rows, policy, size), "item_id")
    kept = lambda c: F.avg(F.when(F.col("selected"), F.col(c)))
    return j.agg(F.lit(policy).alias("policy"), F.count("*").alias("items"), F.count_if("selected").alias("kept"), F.count_if("override").alias("overrides"), F.avg("discrimination").alias("discrimination_before"), kept("discrimination").alias("discrimination_after"), F.avg("suspicion").alias("suspicion_before"), kept("suspicion").alias("suspicion_after"))
