"""The canonical tables over the test tables, and the same as SQL for an independent engine."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Lazily bound tables of one data folder; nothing is read before a query asks for it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def responses(self) -> DataFrame:
        """model_id, item_id, subject, prompt_variant, score: duplicates averaged."""
        item = F.col("l_partkey") % 200
        rows = self.raw("lineitem").select(
            (F.col("l_suppkey") % 24).cast("string").alias("model_id"), item.cast("string").alias("item_id"), (item % 8).cast("string").alias("subject"),
            F.when(F.col("l_linestatus") == "F", "full").otherwise("context_removed").alias("prompt_variant"), (F.col("l_returnflag") == "R").cast("double").alias("score"),
        )
        return rows.groupBy("model_id", "item_id", "subject", "prompt_variant").agg(F.avg("score").alias("score"))

    @cached_property
    def full(self) -> DataFrame:
        return self.responses.where("prompt_variant = 'full'").drop("prompt_variant")

    @cached_property
    def variant(self) -> DataFrame:
        return self.responses.where("prompt_variant = 'context_removed'").drop("prompt_variant")

    @cached_property
    def binary(self) -> DataFrame:
        return self.full.withColumn("score", (F.col("score") >= 0.5).cast("double"))

    @cached_property
    def second(self) -> DataFrame:
        """Another benchmark: model_id, item_id, score."""
        rows = self.raw("orders").select((F.col("o_custkey") % 24).cast("string").alias("model_id"), (F.col("o_orderkey") % 150).cast("string").alias("item_id"), (F.col("o_orderstatus") == "F").cast("double").alias("score"))
        return rows.groupBy("model_id", "item_id").agg(F.avg("score").alias("score"))

    @cached_property
    def families(self) -> DataFrame:
        """model_id, family."""
        return self.full.select("model_id").distinct().withColumn("family", (F.col("model_id").cast("int") % 5).cast("string"))

    @cached_property
    def judgments(self) -> DataFrame:
        """task_id, annotator, label."""
        rows = self.raw("orders").select((F.col("o_orderkey") % 500).alias("task_id"), (F.col("o_custkey") % 7).alias("annotator"), F.col("o_orderstatus").alias("label"))
        return rows.groupBy("task_id", "annotator").agg(F.min("label").alias("label"))

    @cached_property
    def detector(self) -> DataFrame:
        """doc_id, y, score, subject."""
        docs = self.raw("documents").select("doc_id", "n_chars", F.col("lang").alias("subject"))
        rows = self.raw("labels").select("doc_id", F.col("quality").cast("int").alias("y")).join(docs, "doc_id")
        return rows.select("doc_id", "y", (F.col("n_chars") % 997).cast("double").alias("score"), "subject")

    @cached_property
    def tests(self) -> DataFrame:
        """key, p: p-values that both engines make alike."""
        return self.raw("part").select(F.col("p_partkey").alias("key"), ((F.col("p_partkey") * 7919 % 10007 + 1) / F.lit(10008.0)).alias("p"))

    @cached_property
    def items(self) -> DataFrame:
        """item_id, text, tag(s), answer: documents read as items."""
        return self.raw("documents").select(F.col("doc_id").alias("item_id"), "text", F.col("lang").alias("tag"), F.col("source").alias("split"))


PRELUDE = """WITH responses AS (
  SELECT CAST(l_suppkey % 24 AS VARCHAR) AS model_id, CAST(l_partkey % 200 AS VARCHAR) AS item_id, CAST((l_partkey % 200) % 8 AS VARCHAR) AS subject,
         CASE WHEN l_linestatus = 'F' THEN 'full' ELSE 'context_removed' END AS prompt_variant, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS score
  FROM lineitem GROUP BY ALL),
f AS (SELECT model_id, item_id, subject, score FROM responses WHERE prompt_variant = 'full'),
v AS (SELECT model_id, item_id, subject, score FROM responses WHERE prompt_variant = 'context_removed'),
bin AS (SELECT model_id, item_id, subject, CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END AS score FROM f),
b2 AS (SELECT CAST(o_custkey % 24 AS VARCHAR) AS model_id, CAST(o_orderkey % 150 AS VARCHAR) AS item_id, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS score FROM orders GROUP BY ALL),
fam AS (SELECT DISTINCT model_id, CAST(CAST(model_id AS INT) % 5 AS VARCHAR) AS family FROM f),
jud AS (SELECT o_orderkey % 500 AS task_id, o_custkey % 7 AS annotator, min(o_orderstatus) AS label FROM orders GROUP BY ALL),
det AS (SELECT doc_id, CAST(quality AS INT) AS y, CAST(n_chars % 997 AS DOUBLE) AS score, lang AS subject FROM labels JOIN documents USING (doc_id)),
tst AS (SELECT p_partkey AS key, (p_partkey * 7919 % 10007 + 1) / 10008.0 AS p FROM part),
acc AS (SELECT model_id, avg(score) AS a FROM f GROUP BY 1),
acc2 AS (SELECT model_id, avg(score) AS a FROM b2 GROUP BY 1),
accv AS (SELECT model_id, avg(score) AS a FROM v GROUP BY 1),
sa AS (SELECT model_id, subject, round(avg(score), 12) AS a FROM f GROUP BY ALL),
sar AS (SELECT *, rank() OVER (PARTITION BY subject ORDER BY a DESC) + (count(*) OVER (PARTITION BY subject, a) - 1) / 2.0 AS r,
               rank() OVER (PARTITION BY subject ORDER BY a DESC) AS mr FROM sa),
it AS (SELECT item_id, subject, avg(score) AS p, count(*) AS n, stddev_pop(score) AS sp, stddev_samp(score) AS ss FROM f GROUP BY ALL)
"""
