"""Working tables that every executor can read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a folder of this session (local mode only)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="plumbline-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python 1,000 rows at a time where the session leaves Spark's 10,000: documents are large rows, and
    each batch is held by the JVM and by the worker at once. A value of the session's own stays."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")


def gone_at_exit(spark: SparkSession, path: str) -> str:
    """Have a working table deleted when the application ends, whatever its file system; gives the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage and survives lost executors. The
    table is deleted when the application ends; results read it lazily, so it can't go before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(gone_at_exit(spark, path))


SENT = 1_000_000  # ids that are broadcast; more are joined by shuffling


def without(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """``documents`` but those whose doc_id is in the one column of ``ids``. Rows with a null doc_id stay."""
    ids = materialize(ids.toDF("doc_id").where("doc_id is not null").distinct())
    few = ids.count() <= SENT
    return documents.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti")
