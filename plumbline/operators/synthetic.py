"""Synthetic panels and detector sweeps by the portable hash generator, fixed readouts, judges and materiality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import text as X
from plumbline.functions.rng import uniform
from plumbline.functions.stats import pearson, roc_auc

#: Flaws that a synthetic item may have; each names what it changes.
FLAWS = ("wrong_key", "two_correct", "no_correct", "ambiguous_wording", "answer_prior", "longest_is_correct", "keyword_leak", "near_duplicate", "exact_duplicate", "template_reuse", "context_not_needed", "format_sensitive", "outdated_fact", "scorer_mismatch", "contaminated")


def flawed(items: DataFrame, share: float, seed: int, flaws: tuple[str, ...] = FLAWS) -> DataFrame:
    """Adds flaw (or clean) and what it does to the item: chance that a model that knows the answer is scored right, and that
    one that doesn't is."""
    from plumbline.operators.sampling import with_flaws

    out, f = with_flaws(items, list(flaws), share, seed), F.col("flaw")
    known = F.when(f.isin("wrong_key", "no_correct"), 0.05).when(f.isin("two_correct", "ambiguous_wording", "scorer_mismatch"), 0.5).when(f == "format_sensitive", 0.7).when(f == "outdated_fact", 0.3).otherwise(0.95)
    guess = F.when(f.isin("answer_prior", "longest_is_correct", "keyword_leak", "context_not_needed"), 0.7).when(f == "contaminated", 0.9).when(f.isin("two_correct"), 0.5).when(f == "no_correct", 0.05).otherwise(0.25)
    return out.withColumns({"right_if_known": known, "right_if_not": guess})


def mock_panel(items: DataFrame, models: list[tuple[str, float]], seed: int) -> DataFrame:
    """model_id, item_id, score: models of an ability each, 1 if the hash of (seed, model, item) lies below it."""
    m = items.sparkSession.createDataFrame(models, "model_id string, ability double")
    return items.select("item_id").crossJoin(F.broadcast(m)).select("model_id", "item_id", (uniform(seed, "model_id", "item_id") < F.col("ability")).cast("double").alias("score"))


def observable_success(ability: Column, uncertainty: Column, format_sensitivity: Column, stressed: Column) -> Column:
    """Chance of a right answer from what can be observed of model and item, never from labels of flaws."""
    p = F.when(stressed, 0.5 + 0.15 * ability - 0.25 * format_sensitivity).otherwise(0.5 + 0.2 * ability - 0.2 * uncertainty)
    return F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def fixed_readout(outputs: DataFrame) -> DataFrame:
    """item_id, score: the larger of the share of invalid outputs and 1 - max(p, 1 - p) of the share p of right ones, the
    same for every kind of flaw. ``outputs``: item_id, prediction, answer, valid."""
    right = F.coalesce((F.col("prediction") == F.col("answer")).cast("double"), F.lit(0.0))
    g = outputs.groupBy("item_id").agg(F.avg((~F.col("valid")).cast("double")).alias("invalid"), F.avg(right).alias("p"))
    return g.select("item_id", F.greatest(F.col("invalid"), 1 - F.greatest(F.col("p"), 1 - F.col("p"))).alias("score"))


def detector_sweep(items: DataFrame, strengths: list[float], seeds: int, noise: float = 1.0) -> DataFrame:
    """strength, seed, item_id, y, score: a detector's score is strength * y + noise * uniform; all strengths and seeds are
    rows of one frame. ``items``: item_id, y."""
    grid = F.explode(F.array(*map(F.lit, strengths)))
    rows = items.withColumn("strength", grid).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    return rows.withColumn("score", F.round(F.col("strength") * F.col("y") + noise * uniform(F.col("seed"), "item_id"), 9))


def sweep_summary(rows: DataFrame) -> DataFrame:
    """strength, auc (mean over seeds), flawed and clean mean scores."""
    auc = roc_auc(rows, "y", "score", ["strength", "seed"]).groupBy("strength").agg(F.avg("auc").alias("auc"))
    means = rows.groupBy("strength").agg(F.avg(F.when(F.col("y") == 1, F.col("score"))).alias("flawed"), F.avg(F.when(F.col("y") != 1, F.col("score"))).alias("clean"))
    return auc.join(means, "strength")


def ordinal_spearman(rows: DataFrame, x: str, y: str, key: str, by: list[str]) -> DataFrame:
    """by..., spearman of ordinal ranks: ties are not shared but go by key. A group is a panel of items."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    r = rows.withColumns({"_x": F.row_number().over(w.orderBy(x, key)).cast("double"), "_y": F.row_number().over(w.orderBy(y, key)).cast("double")})
    return r.groupBy(*by).agg(pearson("_x", "_y").alias("spearman"))


def judges(tasks: DataFrame) -> DataFrame:
    """task_id, variant, judge, label, confidence of four rule judges; ``tasks``: task_id, raw_output, gold (a letter)."""
    t = F.col("raw_output")
    found = F.when(F.col("variant") == "strict", X.strict_letter(t)).when(F.col("variant") == "regex", X.final_answer(t)).otherwise(F.when(~X.refusal(t), X.mcq_label(t)))
    rows = tasks.withColumn("variant", F.explode(F.array(*map(F.lit, ("strict", "lenient", "regex", "mock"))))).withColumn("found", found)
    kind = F.when(F.col("variant") == "regex", "regex").when(F.col("variant") == "mock", "local_mock").otherwise("rule_based")
    label = F.when(F.col("found").isNull(), "unscorable").when(F.col("found") == F.col("gold"), "correct").otherwise("incorrect")
    sure = F.when(F.col("found").isNull(), 0.4).when(F.col("variant").isin("strict", "regex"), 0.9).otherwise(0.75)
    return rows.select("task_id", "variant", F.concat_ws("_", kind, "variant").alias("judge"), label.alias("label"), sure.alias("confidence"))


# From where on an effect is material.
MATERIAL = {"shortcut": 0.70, "score_delta": 0.05, "saturation_range": 0.03, "redundancy": 0.20}


def materiality(diagnostic: Column, effect: Column, ranking_changed: Column | None = None, decision_changed: Column | None = None) -> Column:
    """The ladder from uncalibrated to decision-changing; a saturation effect is a range, material when small."""
    e, no = F.abs(effect), F.lit(False)
    material = (
        ((diagnostic == "shortcut") & (e >= MATERIAL["shortcut"])) | (diagnostic.isin("extraction_robustness", "prompt_sensitivity", "reliability") & (e >= MATERIAL["score_delta"]))
        | ((diagnostic == "redundancy") & (e >= MATERIAL["redundancy"])) | ((diagnostic == "saturation") & (e <= MATERIAL["saturation_range"]))
    )
    return (
        F.when(effect.isNull(), "uncalibrated").when(no if decision_changed is None else decision_changed, "decision-changing").when(no if ranking_changed is None else ranking_changed, "ranking-changing")
        .when(material, "practically material").when(e > 0, "statistically detectable").otherwise("negligible")
    )


def rank_thresholds(shifts: DataFrame, thresholds: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """threshold, and for each measure (columns but model_id) how many models reach it."""
    measures = [c for c in shifts.columns if c != "model_id"]
    rows = shifts.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return rows.groupBy("threshold").agg(*[F.count_if(F.col(c) >= F.col("threshold")).alias(c) for c in measures])


def risk_from_fraction(share: Column) -> Column:
    # The ladder of local evidence.
    return F.when(share.isNull(), "unknown/unmeasured").when(share <= 0, "no local evidence found").when(share < 0.05, "low local evidence").when(share < 0.20, "moderate local evidence").otherwise("high local evidence")


def signals(parts: dict[str, DataFrame], items: DataFrame) -> DataFrame:
    """signal, flagged, rate, risk of item-level findings ({signal: frame with item_id}) against all items."""
    n, out = items.agg(F.count_distinct("item_id").alias("n")), None
    for name, frame in parts.items():
        one = frame.agg(F.count_distinct("item_id").alias("flagged")).crossJoin(n).select(F.lit(name).alias("signal"), "flagged", (F.col("flagged") / F.col("n")).alias("rate"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("risk", risk_from_fraction(F.col("rate")))
