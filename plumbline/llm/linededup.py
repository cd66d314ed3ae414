"""Operator 5: lines that a site repeats, by their share of the site's pages.

A line is boilerplate of a page when more than ``ratio`` of the site's other pages contain it as well; this one rule
holds for sites of every size, and a line on one page alone is never boilerplate. Exact copies of a page within a site
count once, in both numbers, so that a page that is published many times isn't taken for boilerplate. The ratio is within
a site: a passage that repeats across sites, a few times on each, is out of this method's reach.

Defined cases: lines are compared after trimming blanks and tabs; blank lines are never counted nor dropped; a null
text stays null; a null site is a site of its own; a page of which all lines go keeps its row with an empty text; rows
that repeat a doc_id are pages each for itself; other columns of any name come back as they are, and lines_dropped is
added unless the input has it; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import materialize

RATIO = 0.075
SENT = 200_000  # boilerplate lines that are broadcast; more are joined by site, with the same result
PARTS = 64  # parts of a site in that join


def _line_key(line: Column) -> Column:
    return F.when(F.trim(F.translate(line, "\t\r", "  ")) == "", F.lit(None)).otherwise(F.xxhash64(F.trim(F.translate(line, "\t\r", "  "))))


def _site(site: str) -> Column:
    return F.coalesce(F.col(f"`{site}`").cast("string"), F.lit(""))


def boilerplate(documents: DataFrame, site: str = "source", ratio: float = RATIO) -> DataFrame:
    """site, line (key of a boilerplate line) of every site. A site has at most (mean distinct lines a page) / ratio."""
    pages = documents.where("text is not null").select(_site(site).alias("site"), F.xxhash64("text").alias("page"), "text")
    total = pages.groupBy("site").agg(F.count_distinct("page").alias("pages"))
    lines = pages.select("site", "page", F.explode(F.array_distinct(F.transform(F.split("text", "\n", -1), _line_key))).alias("line")).where("line is not null")
    often = lines.groupBy("site", "line", "page").agg(F.lit(1).alias("one")).groupBy("site", "line").agg(F.count("*").alias("n")).where("n > 1")
    return often.join(total, "site").where(F.col("n") - 1 > ratio * (F.col("pages") - 1)).select("site", "line")


def drop_boilerplate(documents: DataFrame, site: str = "source", ratio: float = RATIO) -> DataFrame:
    """``documents`` without boilerplate lines: text is replaced, n_chars (if there) counts it anew; lines_dropped is added."""
    found = materialize(boilerplate(documents, site, ratio))
    few = found.count() <= SENT
    lists = found.groupBy("site").agg(F.collect_list("line").alias("lines"))
    # the row travels as one column, so names of the input can't clash with those made here
    docs = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), _site(site).alias("site"), F.col("text").alias("text"))
    if few:
        docs = docs.join(F.broadcast(lists), "site", "left")
    else:
        parts = lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        docs = docs.withColumn("part", F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(PARTS)).cast("int")).join(parts, ["site", "part"], "left")
    lines = F.split("text", "\n", -1)
    # a blank line's key is null, for which array_contains is null: kept
    kept = F.filter(lines, lambda line: ~F.coalesce(F.array_contains("lines", _line_key(line)), F.lit(False)))
    docs = docs.select("row", "text", F.when(F.col("lines").isNotNull(), kept).alias("kept"))
    dropped = F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("kept"))
    text = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    new = {"text": text, "n_chars": F.length(text).cast(dict(documents.dtypes).get("n_chars", "long"))}
    columns = [new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in documents.columns]
    return docs.select(*columns, *([] if "lines_dropped" in documents.columns else [dropped.alias("lines_dropped")]))


def _sql(table: str = "documents") -> str:
    return f"""
    SELECT p.doc_id, CASE WHEN p.text IS NULL THEN NULL ELSE array_to_string(list_filter(string_split(p.text, chr(10)), lambda x: NOT coalesce(list_contains(b.lines, trim(translate(x, chr(9) || chr(13), '  '))), false)), chr(10)) END AS text,
           p.lang, p.source
    FROM {table} p LEFT JOIN (
      SELECT o.site, list(o.line) AS lines FROM (
        SELECT site, line, count(*) AS n FROM (
          SELECT DISTINCT coalesce(source, '') AS site, text, trim(translate(line, chr(9) || chr(13), '  ')) AS line
          FROM (SELECT source, text, unnest(string_split(text, chr(10))) AS line FROM {table}) WHERE trim(translate(line, chr(9) || chr(13), '  ')) <> '')
        GROUP BY ALL HAVING count(*) > 1) o
      JOIN (SELECT coalesce(source, '') AS site, count(DISTINCT text) AS pages FROM {table} GROUP BY ALL) t ON t.site = o.site
      WHERE o.n - 1 > {RATIO} * (t.pages - 1) GROUP BY o.site) b ON b.site = coalesce(p.source, '')"""


OP5_SQL = f"SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n_chars FROM ({_sql()})"
