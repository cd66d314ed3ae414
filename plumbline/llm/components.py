"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import materialize


ONE_TASK = 16_384  # links that one task may hold; more are worked by joins


def _within(edges: pd.DataFrame) -> pd.DataFrame:
    """The components of few links, by union-find."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    for u, v in zip(edges["u"].tolist(), edges["v"].tolist(), strict=True):
        a, b = find(u), find(v)
        if a != b:
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    return pd.DataFrame({"doc_id": nodes, "component_id": [find(x) for x in nodes]}, dtype="int64")


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(doc_id, component_id) for every node of ``links``; component_id is the smallest reachable id.

    Self links and nulls are ignored. Each step only takes minima and equi-joins, so a node with very many
    links never has its neighbours gathered in one task. Steps end when the edges no longer change.
    """
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = materialize(edges)
    seen = _print(edges)
    if seen[0] <= ONE_TASK:
        return edges.select("u", "v", F.lit(0).alias("g")).groupBy("g").applyInPandas(lambda p: _within(p), "doc_id long, component_id long")
    while seen[0]:
        # large star: every larger neighbour of u goes to the smallest node at u
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(moved.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = _print(edges)
        if now == seen:
            break
        seen = now
    ends = edges.select(F.col("v").alias("u"), "v").distinct()
    return edges.union(ends).groupBy(F.col("u").alias("doc_id")).agg(F.min("v").alias("component_id"))
