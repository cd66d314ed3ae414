"""Large arrays of counts that every task adds to: one compressed blob a task and slice, summed in bounded groups."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "slice int, part int, blob binary"


def packed(counts: np.ndarray, slices: int, part: int) -> list[dict]:
    """The rows of one task: its counts, cut to ``slices`` runs of equal length; runs without counts are left out."""
    cut = np.array_split(counts.astype(np.uint32), slices)
    return [{"slice": k, "part": part, "blob": zlib.compress(c.tobytes(), 1)} for k, c in enumerate(cut) if c.any()]


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = None
    for blob in pdf["blob"]:
        one = np.frombuffer(zlib.decompress(blob), dtype=np.uint32).astype(np.uint64)
        total = one if total is None else total + one
    return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "part": [0], "blob": [zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)]})


def total(rows: DataFrame, size: int, slices: int) -> np.ndarray:
    """The sum of all tasks' counts, ``size`` numbers: each group of the first round adds about the root of the tasks."""
    rows = rows.select("slice", "part", "blob")
    parts = rows.agg(F.countDistinct("part")).first()[0]
    if parts > 64:
        rows = rows.withColumn("g", F.col("part") % max(1, int(parts**0.5))).groupBy("slice", "g").applyInPandas(lambda p: _add(p[["slice", "part", "blob"]]), SCHEMA)
    out = np.array_split(np.zeros(size, dtype=np.uint32), slices)
    for row in rows.groupBy("slice").applyInPandas(_add, SCHEMA).collect():
        out[row["slice"]] = np.frombuffer(zlib.decompress(row["blob"]), dtype=np.uint32)
    return np.concatenate(out)
