"""Operator 4: document quality by hierarchical empirical Bayes.

A logistic model over character and repetition statistics of the whole text gives each document's own evidence.
Grouped aggregates of that evidence give a posterior mean for each host, shrunk to the global mean, and for each
host and path, shrunk to its host's. Both levels have a shrinkage weight of their own, from the spread between hosts and
between the paths of a host (method of moments), so sparse sites stay near the prior. A document's odds are then
corrected by the odds of its site without itself.

The model is fitted on at most ``fit_rows`` labelled rows, chosen by a hash of doc_id; everything else covers all rows.

Defined cases: a null or empty text has all statistics 0; null hosts and paths are a site of their own; without
labels of both kinds every document's evidence is the prior (0.5 without labels) and all are kept; rows that repeat
a doc_id are judged each for itself; of clashing labels of a doc_id the better one counts; columns of any name come back
as they are; an empty table gives no rows. Sites are broadcast or joined by shuffling, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.store import materialize, small_batches
from plumbline.llm.textvec import sequence_hash, word_lists

FIT_ROWS = 20_000
THRESHOLD = 0.5
SITES_SENT = 200_000  # paths whose posteriors are broadcast; more are joined by shuffling
PARTS = 64  # parts of a site in that join
_LETTER_GROUPS = [range(65, 91), range(97, 123), range(48, 58), range(128, 256), (32,), (10,), (9, 13)]
_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
N_FEATURES = len(_LETTER_GROUPS) + len(_SIGNS) + 6


def statistics(text: str, words: np.ndarray) -> np.ndarray:
    """Character shares, word length and repetition of one text."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    size, n = counts.sum(), len(words)
    shares = [counts[list(g)].sum() / size for g in _LETTER_GROUPS]
    signs = np.minimum(np.sqrt(counts[_SIGNS] / size), 0.4)
    single = len(np.unique(words)) / n if n else 0.0
    triples = sequence_hash(words, 3)
    fresh = len(np.unique(triples)) / len(triples) if len(triples) else 1.0
    return np.r_[shares, signs, np.log1p(n), min(size / max(n, 1), 30.0), single, fresh, single * np.log1p(n), float(n < 5)]


def features(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t or "", w) for t, w in zip(texts, word_lists(texts), strict=True)]).reshape(len(texts), N_FEATURES)


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> dict:
    """Penalised logistic regression by Newton steps on standardised features."""
    if len(y) == 0 or y.min() == y.max():
        prior = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return {"mean": np.zeros(N_FEATURES), "scale": np.ones(N_FEATURES), "weights": np.r_[np.zeros(N_FEATURES), np.log(prior / (1 - prior))], "learned": False}
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.c_[np.clip((x - mean) / scale, -8, 8), np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), np.r_[np.full(N_FEATURES, penalty), 1e-6]
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w = w + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return {"mean": mean, "scale": scale, "weights": w, "learned": True}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8) @ model["weights"][:-1] + model["weights"][-1]
    return 1 / (1 + np.exp(-np.clip(z, -8, 8)))


def fit_sample(documents: DataFrame, labels: DataFrame, label: str, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, text, y of at most about ``fit_rows`` labelled documents, chosen by a hash of doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    share = min(1.0, 0.95 * fit_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * share))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.join(F.broadcast(known), "doc_id")  # at most fit_rows pairs of numbers


def learn(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = features(batch.column(1).to_pylist()).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([r.tobytes() for r in rows], pa.binary())], names=["y", "x"])

    small_batches(documents.sparkSession)
    rows = fit_sample(documents, labels, "quality", fit_rows).select("doc_id", "text", "y").mapInArrow(run, "y double, x binary").collect()
    x = np.array([np.frombuffer(r["x"], dtype=np.float32) for r in rows], dtype=float).reshape(len(rows), N_FEATURES)
    return fit(x, np.array([r["y"] for r in rows]))


def with_evidence(documents: DataFrame, model: dict, *carry: str) -> DataFrame:
    """The columns of ``carry`` and evidence: the model's probability of good quality from the text alone."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = predict(sent.value, features(batch.column(batch.num_columns - 1).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64())], names=[*batch.schema.names[:-1], "evidence"])

    rows = documents.select(*carry, F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("evidence", T.DoubleType())]))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def _shrinkage(n: float, groups: int, squares: float, spread: float, within: float) -> float:
    """How many rows of a group weigh as much as the mean above it, by moments: of groups of n_k rows (``squares`` is the
    sum of n_k squared) E[spread] = groups * within + (n - squares / n) * between, ``groups`` less the means estimated."""
    between = max((spread - groups * within) / max(n - squares / max(n, 1), 1e-9), 1e-6) if groups > 0 else 1e-6
    return float(min(max(within / between - 1, 2.0), 1000.0))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """host, path, and of each its pages and evidence sum; global prior and the weights of hosts and of paths."""
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("path_n"), F.sum("evidence").alias("path_sum"))
    hosts = paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_sum").alias("host_sum"), F.count("*").alias("paths"), F.sum(F.pow(F.col("path_sum") / F.col("path_n"), F.lit(2)) * F.col("path_n")).alias("q"), (F.sum(F.col("path_n") * F.col("path_n")) / F.sum("path_n")).alias("nn"))
    mean = F.col("host_sum") / F.col("host_n")
    row = hosts.agg(
        F.sum("host_n").alias("n"), F.sum("host_sum").alias("s"), F.count("*").alias("h"), F.sum(F.col("host_n") * mean * mean).alias("q"), F.sum(F.col("host_n") * F.col("host_n")).alias("nn"),
        F.sum(F.col("q") - F.col("host_n") * mean * mean).alias("path_spread"), F.sum(F.col("paths") - 1).alias("path_groups"), F.sum("nn").alias("path_nn"), F.sum(F.col("host_n") * mean * (1 - mean)).alias("path_within"),
    ).first()
    n, h = row["n"] or 0, row["h"] or 0
    prior = row["s"] / n if n else 0.5
    within = max(prior * (1 - prior), 1e-6)
    weight = _shrinkage(n, h - 1, row["nn"] or 0, (row["q"] or 0.0) - n * prior * prior, within)
    path_weight = _shrinkage(n, row["path_groups"] or 0, n * (row["path_nn"] or 0), row["path_spread"] or 0.0, max((row["path_within"] or 0.0) / max(n, 1), 1e-6))
    return paths.join(hosts.select("host", "host_n", "host_sum"), "host").withColumns({"prior": F.lit(float(prior)), "weight": F.lit(weight), "path_weight": F.lit(path_weight)})


def _at_sites(scored: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows with their site's posteriors: few sites are broadcast, of more each is dealt to PARTS parts, so that a
    site of very many rows isn't one task's."""
    if sites.count() <= SITES_SENT:
        return scored.join(F.broadcast(sites), ["host", "path"])
    parts = sites.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return scored.withColumn("_part", F.pmod(F.xxhash64("evidence"), F.lit(PARTS)).cast("int")).join(parts, ["host", "path", "_part"]).drop("_part")


def judge(scored: DataFrame, threshold: float = THRESHOLD, sites: DataFrame | None = None) -> DataFrame:
    """Adds host_posterior, path_posterior, score and keep to rows with host, path and evidence."""
    out = _at_sites(scored, materialize(site_posteriors(scored)) if sites is None else sites)
    own = F.col("evidence")
    host = (F.col("host_sum") - own + F.col("weight") * F.col("prior")) / (F.col("host_n") - 1 + F.col("weight"))
    path = (F.col("path_sum") - own + F.col("path_weight") * F.col("host_posterior")) / (F.col("path_n") - 1 + F.col("path_weight"))
    out = out.withColumn("host_posterior", host).withColumn("path_posterior", path)
    score = 1 / (1 + F.exp(-(_logit(own) + _logit(F.col("path_posterior")) - _logit(F.col("prior")))))
    out = out.withColumn("score", score).withColumn("keep", F.col("score") >= threshold)
    return out.drop("path_n", "path_sum", "host_n", "host_sum", "prior", "weight", "path_weight")


def classify(documents: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, host, path, evidence, host_posterior, path_posterior, score, keep of every row of ``documents``."""
    model = learn(documents, labels, fit_rows)
    rows = documents.select("doc_id", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((host, "host"), (path, "path"))], F.col("text").alias("text"))
    return judge(materialize(with_evidence(rows, model, "doc_id", "host", "path")), threshold)


def keep_good(documents: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that ``classify`` keeps, with their columns. Texts aren't shuffled while the sites are few."""
    model = learn(documents, labels, fit_rows)
    # the row travels as one column, so names of the input can't clash with those made here
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")).alias("path"), F.col("text").alias("text"))
    sites = materialize(site_posteriors(with_evidence(rows, model, "host", "path")))
    judged = judge(with_evidence(rows, model, "row", "host", "path"), threshold, sites)
    return judged.where("keep").select("row.*")
