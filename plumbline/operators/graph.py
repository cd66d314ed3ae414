"""Connected components of pairs, as a plan: minima travel along links until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clusters(pairs: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """id, cluster (the smallest id of the component) for every id in a pair.

    A round takes the least label among neighbours and then the label's own label, so paths halve; state is written
    to the checkpoint folder each round.
    """
    spark = pairs.sparkSession
    ensure_checkpoint_dir(spark)
    edges = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct().checkpoint()
    labels = edges.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.first("x")).alias("cluster")).checkpoint()
    for _ in range(most_rounds):
        near = edges.join(labels.select(F.col("id").alias("y"), F.col("cluster").alias("c")), "y").groupBy(F.col("x").alias("id")).agg(F.min("c").alias("m"))
        step = labels.join(near, "id").select("id", F.least("cluster", "m").alias("cluster"), F.col("cluster").alias("old"))
        jump = step.join(labels.select(F.col("id").alias("cluster"), F.col("cluster").alias("j")), "cluster", "left")
        new = jump.select("id", F.least("cluster", F.coalesce("j", "cluster")).alias("cluster"), "old").checkpoint()
        changed = not new.where("cluster <> old").isEmpty()
        labels = new.drop("old")
        if not changed:
            break
    return labels


def ensure_checkpoint_dir(spark) -> None:
    """Use the session's ``spark.checkpoint.dir``; only where it is unset and the session is local, a folder of our own."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        import atexit
        import shutil
        import tempfile

        named = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(named)
