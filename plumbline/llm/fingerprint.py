"""Operator 7: threshold-scaled sketches of word shingles, in DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so the share of common hashes estimates
Jaccard similarity or containment of very unequal documents. So that no text with words has an empty sketch, one whose
shingles all lie above the threshold keeps its smallest hash instead. Sketches of equal fraction merge: ``merge`` of two
is the sketch of both shingle sets together.

Defined cases: a null text is the empty text, its sketch is empty; two empty sketches are alike (1.0), an empty and
a non-empty one are not (0.0); rows that repeat a doc_id follow each other in the order of a hash of their texts;
null doc_ids come first; a table of one row is its own next document; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH = 5
FRACTION = 1 / 4
GROUP = 512  # documents, about, of a range of ids that are ordered together
FANOUT = 1024  # ranges that a range of ids is parted into at a time, twice at most


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Hashes of the words of a text, lower-cased."""
    split = F.split(F.lower(text), r"[\x09-\x0D\x20]+")
    return F.transform(F.filter(split, lambda w: w != ""), lambda w: F.xxhash64(w))


def _threshold(fraction: float) -> int:
    return min(-(2**63) + int(2**64 * fraction), 2**63 - 1)


def _below(hashes: Column, most: int) -> Column:
    """Of a non-empty array those below ``most``, or else the least."""
    least = F.array_min(hashes)
    return F.when(least < most, F.filter(hashes, lambda h: h < most)).otherwise(F.array(least))


def sketch_of(words: Column, width: int = WIDTH, fraction: float = FRACTION) -> Column:
    """The sketch of a text of which ``words`` holds the word hashes: sorted, distinct."""
    most = _threshold(fraction)

    def shingles(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, width)))

    def kept(every: Column) -> Column:
        return F.sort_array(F.array_distinct(_below(every, most)))

    # a lambda's variable is worked out once; an expression within a lambda would be worked out for every element
    some = _let(words, lambda w: F.when(F.size(w) > 0, _let(shingles(w), kept)))
    return F.coalesce(some, F.array().cast("array<bigint>"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first sketch's text that the second one's holds."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of the union of two shingle sets, from their sketches: of two least hashes above the threshold the
    smaller one stays, and none beside a hash below it."""
    return _let(F.array_union(a, b), lambda u: F.when(F.size(u) > 0, F.sort_array(_below(u, _threshold(fraction)))).otherwise(u))


def as_text(sketch: Column) -> Column:
    return F.concat_ws(",", F.transform(sketch, lambda h: F.lower(F.hex(h))))


def sketches(documents: DataFrame, width: int = WIDTH, fraction: float = FRACTION) -> DataFrame:
    """doc_id and sketch of each document."""
    docs = documents.select("doc_id", words_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words"))
    return docs.select("doc_id", sketch_of(F.col("words"), width, fraction).alias("sketch"))


def _cuts(parts: int) -> Column:
    return F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10 * FANOUT)


def with_ranges(docs: DataFrame) -> DataFrame:
    """Adds range: numbers of ranges of ascending ids with about GROUP rows each, from quantiles of the ids; rows of equal
    ids share one. Nothing is computed from the ids themselves, so any ids will do, dense or far apart. Of more than
    FANOUT ranges each first one is parted again by its own quantiles; their table has at most FANOUT rows of FANOUT
    numbers, which bounds what is broadcast."""
    n = docs.count()
    parts = max(1, min(-(-n // GROUP), FANOUT))
    ids = docs.select("doc_id").where("doc_id is not null")

    def above(cuts: Column) -> Column:
        return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.size(F.filter(cuts, lambda c: c <= F.col("doc_id"))))

    cuts = (ids.agg(_cuts(parts)).first()[0] or []) if parts > 1 else []
    first = above(F.lit(sorted(set(cuts)))) if cuts else F.lit(0)
    docs = docs.withColumn("range", first.cast("long"))
    if n > GROUP * FANOUT:
        again = min(-(-n // (GROUP * FANOUT)), FANOUT)
        finer = docs.select("doc_id", "range").groupBy("range").agg(_cuts(again).alias("cuts"))
        docs = docs.join(F.broadcast(finer), "range").withColumn("range", F.col("range") * FANOUT + F.coalesce(above(F.col("cuts")), F.lit(0))).drop("cuts")
    return docs


def with_next(docs: DataFrame, columns: list[str], after: dict[str, Column] | None = None) -> DataFrame:
    """Adds next_<column> of the document that follows in ascending doc_id (equal ones by ``tie``); the first follows the
    last. ``after`` adds columns once the rows are dealt to their ranges, so that they aren't shuffled.

    Ranges of ids are ordered each for itself. The first document of a range is also dealt to the range before it,
    so a range needs no other. The table of first documents has a row a range.
    """
    docs = with_ranges(docs)
    firsts = docs.groupBy("range").agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("open"))
    every = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("range").over(Window.orderBy("range")), F.last("range").over(every))
    docs = docs.join(F.broadcast(firsts.withColumn("before", before)), "range")
    is_first = F.when(F.col("open"), F.col("doc_id").isNull()).otherwise(F.col("doc_id") == F.col("low"))
    here = F.struct(F.lit(False).alias("extra"), F.col("range").alias("range"))
    to = F.when(is_first, F.array(here, F.struct(F.lit(True).alias("extra"), F.col("before").alias("range")))).otherwise(F.array(here))
    docs = docs.withColumn("to", F.explode(to)).withColumns({"extra": F.col("to.extra"), "range": F.col("to.range")}).drop("to", "before", "low", "open")
    docs = docs.repartition("range").withColumns(after or {})
    follow = Window.partitionBy("range").orderBy("extra", F.asc_nulls_first("doc_id"), "tie")
    return docs.withColumns({f"next_{c}": F.lead(c).over(follow) for c in columns}).where("not extra").drop("range", "extra", "tie")


def edited_fingerprints(documents: DataFrame, width: int = WIDTH, fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of every document and of its edited text: its last half replaced by the next document's beginning."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    docs = with_next(docs, ["text", "sketch"], {"sketch": sketch_of(words_of(F.col("text")), width, fraction)})
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    docs = docs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    docs = docs.withColumns({"edited_sha256": F.sha2("edited", 256), "edited_sketch": sketch_of(words_of(F.col("edited")), width, fraction)})
    return docs.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
