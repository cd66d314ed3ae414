"""Operator 10: sharding by extendible hashing, in DataFrame functions only.

A shard is named by the leading bits that the hashes of its rows share. Starting from one shard, only shards above
the byte limit are split on one more bit. The bytes of all prefixes come from one aggregate of a fine prefix, so no
pass over the rows is made for a split; prefixes that are still too large go on with further bits.

Defined cases: a null key hashes as the empty string; a null text has no bytes; a row larger than the limit has a
shard of its own that is marked oversize; rows of equal keys beyond the limit are parted by further bits from their
place in the table; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import materialize

BITS = 60  # of the key's hash; as many more tell rows of equal keys apart
ROUND = 16  # bits looked at in one aggregate
LIMIT = 1 << 20


def key_hash(key: Column) -> Column:
    """The leading 60 bits of the MD5 of the key's text: the same in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _prefix(depth: Column | str) -> Column:
    """The first ``depth`` bits of (h, h2), as text of 0 and 1 behind the depth."""
    return F.expr(f"named_struct('d', {depth}, 'p', shiftright(h, greatest({BITS} - {depth}, 0)), 'q', if({depth} > {BITS}, shiftright(h2, 2 * {BITS} - {depth}), 0L))")


def directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The shards (at: depth and prefix, shard_bytes, shard_rows) of rows with h, h2 and n_bytes of at most ``limit``."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, out, left = 0, None, rows
    high = min(24, max(0, math.ceil(math.log2(max(1, total / limit)))) + 4)
    while True:
        sums = left.groupBy(_prefix(f"{high}").alias("at")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("r"))
        sums = sums.select(F.col("at.p").alias("p"), F.col("at.q").alias("q"), "b", "r", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("d"))
        up = F.expr(f"named_struct('d', d, 'p', shiftright(p, least({BITS}, {high}) - least({BITS}, d)), 'q', if(d > {BITS}, shiftright(q, {high} - d), 0L))")
        nodes = materialize(sums.groupBy(up.alias("at")).agg(F.sum("b").alias("shard_bytes"), F.sum("r").alias("shard_rows")))
        parent = F.expr(f"named_struct('d', at.d - 1, 'p', if(at.d <= {BITS}, shiftright(at.p, 1), at.p), 'q', if(at.d > {BITS}, shiftright(at.q, 1), 0L))")
        large = nodes.where(F.col("shard_bytes") > limit).select(F.col("at").alias("parent"))
        fit = nodes.where(F.col("shard_bytes") <= limit).withColumn("parent", parent)
        top = fit.where("at.d = 0").drop("parent") if low == 0 else None
        found = fit.where("at.d > 0").join(large, "parent", "left_semi").drop("parent")
        found = found if top is None else found.unionByName(top)
        out = found if out is None else out.unionByName(found)
        over = nodes.where((F.col("shard_bytes") > limit) & (F.col("at.d") == high)).select("at")
        if high == 2 * BITS or over.isEmpty():
            return out if high < 2 * BITS else out.unionByName(nodes.where((F.col("shard_bytes") > limit) & (F.col("at.d") == high)))
        left = materialize(left.withColumn("at", _prefix(f"{high}")).join(over, "at", "left_semi").drop("at"))
        low, high = high, min(high + ROUND, 2 * BITS)


def _sharded(documents: DataFrame, key: str, limit: int, carry: list[str]) -> DataFrame:
    """row (the columns of ``carry``), shard_id, depth, n_bytes, shard_bytes, oversize. These columns travel as one, so their
    names can't clash with those made here."""
    whole = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    rows = documents.select(whole, key_hash(F.col(f"`{key}`")).alias("h"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("place"))
    rows = materialize(rows.withColumn("h2", F.shiftrightunsigned(F.xxhash64("place"), 4)).withColumn("h2", F.col("h2").bitwiseAND((1 << BITS) - 1)))
    usual, large = rows.where(F.col("n_bytes") <= limit), rows.where(F.col("n_bytes") > limit)
    shards = materialize(directory(usual, limit))
    depths = sorted(r[0] for r in shards.select("at.d").distinct().collect())  # at most 121 numbers
    name = F.expr(f"if(at.d = 0, '', concat(lpad(bin(at.p), least(at.d, {BITS}), '0'), if(at.d > {BITS}, lpad(bin(at.q), at.d - {BITS}, '0'), '')))")
    if depths:
        at = F.explode(F.array(*[_prefix(f"{d}") for d in depths]))
        met = usual.withColumn("at", at).join(shards, "at").select("row", name.alias("shard_id"), F.col("at.d").alias("depth"), "n_bytes", "shard_bytes", F.lit(False).alias("oversize"))
    else:
        met = usual.where("false").select("row", F.lit("").alias("shard_id"), F.lit(0).alias("depth"), "n_bytes", F.col("n_bytes").alias("shard_bytes"), F.lit(False).alias("oversize"))
    own = F.concat(F.lit("big-"), F.lpad(F.hex("h"), 15, "0"), F.lit("-"), F.col("place").cast("string"))
    return met.unionByName(large.select("row", own.alias("shard_id"), F.lit(0).alias("depth"), "n_bytes", F.col("n_bytes").alias("shard_bytes"), F.lit(True).alias("oversize")))


def shard_rows(documents: DataFrame, key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """The key, shard_id (bits), depth, n_bytes, shard_bytes, oversize for every row of ``documents``."""
    out = _sharded(documents, key, limit, [key])
    return out.select(F.col(f"row.`{key}`").alias(key), "shard_id", "depth", "n_bytes", "shard_bytes", "oversize")


def write_shards(documents: DataFrame, path: str, key: str = "doc_id", limit: int = LIMIT) -> str:
    """Write ``documents`` with a folder for each shard; gives the name of the column that names the folders: shard_id,
    with underscores behind it while the input has such a column. Its values have an s before the bits, lest readers take
    01 and 1 for one number."""
    name = "shard_id"
    while name.lower() in map(str.lower, documents.columns):
        name += "_"
    rows = _sharded(documents, key, limit, documents.columns).select("row.*", F.concat(F.lit("s"), "shard_id").alias(name))
    rows.repartition(name).write.partitionBy(name).parquet(path)
    return name


OP10_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, CAST(concat('0x', substr(md5(CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) AS h,
         CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents),
usual AS (SELECT * FROM rows WHERE n_bytes <= {LIMIT}),
nodes AS (
  SELECT d, h >> (60 - d) AS p, CAST(sum(n_bytes) AS BIGINT) AS b
  FROM usual, (SELECT unnest(range(0, 31)) AS d) GROUP BY ALL),
shards AS (
  SELECT n.d, n.p, n.b FROM nodes n LEFT JOIN nodes u ON u.d = n.d - 1 AND u.p = n.p >> 1
  WHERE n.b <= {LIMIT} AND (n.d = 0 OR u.b > {LIMIT}))
SELECT doc_id, CASE WHEN d = 0 THEN '' ELSE substr(CAST(CAST(h AS BIT) AS VARCHAR), 5, CAST(d AS INT)) END AS shard_id,
       CAST(d AS INT) AS depth, n_bytes, b AS shard_bytes, false AS oversize
FROM usual JOIN shards ON h >> (60 - d) = p
"""
