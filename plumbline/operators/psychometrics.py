"""Fits that are no single aggregate, planning formulas, and heuristic baselines."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions.rng import uniform

MOST_PARAMETERS = 2000  # a joint fit of more isn't tried


def rasch_fit(model: np.ndarray, item: np.ndarray, score: np.ndarray, ridge: float = 0.01, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Joint maximum likelihood with a ridge; difficulties sum to zero. Alternating Newton steps of both sides."""
    n, m = model.max() + 1, item.max() + 1
    ability, hard = np.zeros(n), np.zeros(m)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(ability[model] - hard[item])))
        v = p * (1 - p)
        d = (np.bincount(model, score - p, n) - ridge * ability) / (np.bincount(model, v, n) + ridge)
        ability = ability + np.clip(d, -1, 1)
        p = 1 / (1 + np.exp(-(ability[model] - hard[item])))
        v = p * (1 - p)
        e = (np.bincount(item, p - score, m) - ridge * hard) / (np.bincount(item, v, m) + ridge)
        hard = hard + np.clip(e, -1, 1)
        shift = hard.mean()
        hard, ability = hard - shift, ability - shift
        if max(np.abs(d).max(), np.abs(e).max()) < 1e-8:
            break
    return ability, hard


def rasch(matrix: DataFrame, by: str | None = None) -> DataFrame:
    """panel, kind (ability or difficulty), id, value. A panel of under 4 models, under 6 items or more than
    MOST_PARAMETERS parameters gives no rows; panels are fitted side by side, each bounded by that number."""
    panel = F.col(by).cast("string") if by else F.lit("all")
    rows = matrix.where("score is not null").select(panel.alias("panel"), "model_id", "item_id", "score")
    size = rows.groupBy("panel").agg(F.count_distinct("model_id").alias("n"), F.count_distinct("item_id").alias("m"))
    fits = size.where((F.col("n") >= 4) & (F.col("m") >= 6) & (F.col("n") + F.col("m") <= MOST_PARAMETERS)).select("panel")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["model_id", "item_id"])
        m, models = pd.factorize(pdf["model_id"], sort=True)
        i, items = pd.factorize(pdf["item_id"], sort=True)
        ability, hard = rasch_fit(m, i, pdf["score"].to_numpy(float))
        return pd.DataFrame({"panel": pdf["panel"].iloc[0], "kind": ["ability"] * len(models) + ["difficulty"] * len(items), "id": [*models, *items], "value": [*ability, *hard]})

    return rows.join(F.broadcast(fits), "panel", "left_semi").groupBy("panel").applyInPandas(run, "panel string, kind string, id string, value double")


def two_pl(items: DataFrame, models: int) -> DataFrame:
    """Slopes from discriminations, never below 0; needs 8 models and 10 items."""
    n = items.agg(F.count("*").alias("m"))
    return items.crossJoin(F.broadcast(n)).select("item_id", F.greatest(F.coalesce("discrimination", F.lit(0.0)), F.lit(0.0)).alias("slope"), "difficulty", ((F.lit(models) >= 8) & (F.col("m") >= 10)).alias("available"))


def simulate(models: int, items: int, seed: int, spark) -> DataFrame:
    """Responses of a one-parameter panel with evenly spread abilities and difficulties."""
    m = spark.range(models).select(F.col("id").cast("string").alias("model_id"), (F.col("id") * 4 / max(models - 1, 1) - 2).alias("ability"))
    i = spark.range(items).select(F.col("id").cast("string").alias("item_id"), (F.col("id") * 4 / max(items - 1, 1) - 2).alias("difficulty"))
    return m.crossJoin(i).withColumn("score", (uniform(seed, "model_id", "item_id") < X.expit(F.col("ability") - F.col("difficulty"))).cast("double"))


def wilson_width(p: Column, n: Column, z: float = 1.959963984540054) -> Column:
    return 2 * z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))


def fisher_width(r: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """Width of a correlation's interval."""
    h = z / F.sqrt(n - 3)
    return F.tanh(F.atanh(r) + h) - F.tanh(F.atanh(r) - h)


def auc_error(auc: Column, positives: Column, negatives: Column) -> Column:
    """Standard error of an area under the curve by Hanley and McNeil."""
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    return F.sqrt((auc * (1 - auc) + (positives - 1) * (q1 - auc * auc) + (negatives - 1) * (q2 - auc * auc)) / (positives * negatives))


def gpu_hours(items: Column, out_tokens: Column, in_tokens: Column, per_second: Column, workers: int = 2, in_weight: float = 0.1, retry: float = 0.05, fixed: float = 0.25) -> Column:
    """Hours of a run: weighted tokens over throughput, retries, and fixed loading time."""
    return items * (out_tokens + in_weight * in_tokens) / (per_second * workers) / 3600 / (1 - retry) + fixed


def _options(items: DataFrame) -> DataFrame:
    o = items.select("item_id", "answer", "prompt", F.posexplode("choices").alias("k", "choice"))
    return o.withColumns({"label": F.element_at(F.array(*map(F.lit, "ABCDEFGH")), F.col("k") + 1), "len": F.length("choice")})


def baselines(items: DataFrame, seed: int = 0) -> DataFrame:
    """baseline, item_id, prediction, score of heuristics that look at options alone, or at options and prompt."""
    o = _options(items)
    overlap = F.size(F.array_intersect(X.tokens(F.col("prompt")), X.tokens(F.col("choice"))))
    rules: dict[str, Column] = {
        "always_first": -F.col("k"), "longest": F.col("len"), "shortest": -F.col("len"), "keyword_overlap": overlap,
        "random": uniform(seed, "item_id", "label"), "question_only": overlap - F.col("len") / 1000.0,
    }
    picks = None
    for name, rule in rules.items():
        p = o.groupBy("item_id", "answer").agg(F.max(F.struct(rule.cast("double").alias("s"), (-F.col("k")).alias("nk"), "label")).alias("m")).select(F.lit(name).alias("baseline"), "item_id", F.col("m.label").alias("prediction"), "answer")
        picks = p if picks is None else picks.unionByName(p)
    major = items.groupBy("answer").agg(F.count("*").alias("c")).agg(F.max(F.struct("c", "answer")).alias("m"))
    p = items.select("item_id", "answer").crossJoin(F.broadcast(major)).select(F.lit("majority").alias("baseline"), "item_id", F.col("m.answer").alias("prediction"), "answer")
    return picks.unionByName(p).select("baseline", "item_id", "prediction", (F.col("prediction") == F.col("answer")).cast("double").alias("score"))


def gap(baseline_rows: DataFrame, models: DataFrame) -> DataFrame:
    """best_model, best_baseline, gap: one row."""
    b = baseline_rows.groupBy("baseline").agg(F.avg("score").alias("s")).agg(F.max("s").alias("best_baseline"))
    return models.agg(F.max("accuracy").alias("best_model")).crossJoin(b).withColumn("gap", F.col("best_model") - F.col("best_baseline"))


_PLUGINS: dict[tuple[str, str], Callable] = {}
KINDS = ("benchmark_loader", "model_runner", "scorer", "extractor", "diagnostic", "report_section", "repair_policy", "domain_pack", "visualization")


def register(kind: str, name: str):
    """Register a plug-in: a scorer or extractor is a column function, a diagnostic takes and gives a frame."""
    if kind not in KINDS:
        raise ValueError(f"no such kind: {kind}")

    def wrap(f: Callable) -> Callable:
        if (kind, name) in _PLUGINS:
            raise ValueError(f"{kind} {name} is there already")
        _PLUGINS[kind, name] = f
        return f

    return wrap


def plugin(kind: str, name: str) -> Callable:
    return _PLUGINS[kind, name]


def plugins(kind: str | None = None) -> list[tuple[str, str]]:
    return sorted(k for k in _PLUGINS if kind in (None, k[0]))
