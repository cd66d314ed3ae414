"""Operator 2: exact n-gram Jaccard join over globally ordered sets, verified in prefix trees.

Every document's shingle set is put in one global order (rare first, then by hash), so that documents of
Jaccard similarity >= t share an element among the first ``n - ceil(t n) + 1`` of each. The rarity comes from a
table of counts of fixed size over all documents; it only sets the order, so its collisions can't change results.

1. Documents with equal sets become one class, represented by its smallest doc_id.
2. Representatives meet a leader at each of a few min-wise hashes; verified links collapse large groups of near
   copies into components before anything is enumerated.
3. Prefix elements are joined. Only pairs of *different* components that pass the length and position bounds, and
   whose parity bitmaps differ in no more bits than linked sets may, become candidates, so a group of k copies costs
   about k pairs, never k squared. All bounds are exact: they leave no linked pair out.
4. The second documents of the candidate pairs are dealt to groups, each to one: that of its smallest partner. A group's
   ordered sets form one prefix tree, which all partners of its members walk: overlaps of shared beginnings are counted
   once and a subtree is left as soon as its remaining lengths can't reach the threshold. Every pair found is a link,
   whether it was a candidate or not. Large groups are dealt to blocks of members and of walkers, so a task holds few texts.

Defined cases: null or wordless texts have the empty set and are linked with nothing; a row with a null doc_id
comes back with a null component; rows that repeat a doc_id are one document, linked by any of its texts, and each of
them is returned; other columns of the input are ignored; an empty table gives no rows. Small tables are broadcast and
large ones joined by shuffling, with the same result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import counters
from plumbline.llm.components import components
from plumbline.llm.store import materialize, small_batches, without
from plumbline.llm.textvec import U, mix, shingle_sets

SLOTS = 1 << 22  # counters of the order table
SLICES = 16
KEYS = 6  # min-wise hashes with which leaders are found
BLOCK = 200  # members of a prefix tree, and documents that walk it in one task
BUCKET_ROWS = 1_000_000  # prefix elements of a bucket
FLUSH = 400_000  # prefix elements that a task holds before it deals them out
MARKS = 8  # 64-bit words of the parity bitmap
HOT = 4096  # an element counted so often is joined by Spark alone, not inside a bucket
SENT = 500_000  # rows of a table of keys that are broadcast
HOT_KEYS = 10_000
BITS = 1 << 23  # of the filter that names the texts to be read again
ENTRY = np.dtype([("token", "i8"), ("doc_id", "i8"), ("sig", "i8"), ("n", "i4"), ("pos", "i4")])


def reaches(overlap: int, nx: int, ny: int, num: int, den: int) -> bool:
    """Whether a Jaccard similarity of num/den is reached: den * overlap >= num * union."""
    return (den + num) * overlap >= num * (nx + ny)


def ordered(values: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set in global order, as sort keys: rarity in the top six bits, then the hash."""
    level = levels[(values & U(SLOTS - 1)).astype(np.int64)].astype(U)
    return np.sort((level << U(58)) | (mix(values) >> U(6)))


class Node:
    """A node of the prefix tree: the elements it adds, the sets that end in it, and the sizes found below."""

    __slots__ = ("segment", "ends", "children", "shortest", "longest")

    def __init__(self, segment: np.ndarray, ends: list[int], children: list[Node], sizes: list[int]):
        self.segment, self.ends, self.children = segment, ends, children
        self.shortest, self.longest = min(sizes), max(sizes)


def build_tree(sets: list[np.ndarray], members: list[int] | None = None, depth: int = 0) -> Node:
    """The prefix tree of ordered sets; a path is stored as one segment up to where sets part."""
    members = list(range(len(sets))) if members is None else members
    sizes = [len(sets[i]) for i in members]
    reach = min(sizes)
    lead = sets[members[0]][depth:reach]
    for i in members[1:]:
        other = sets[i][depth : depth + len(lead)]
        apart = np.flatnonzero(other != lead)
        if len(apart):
            lead = lead[: apart[0]]
    deep = depth + len(lead)
    ends, parts = [], {}
    for i in members:
        if len(sets[i]) == deep:
            ends.append(i)
        else:
            parts.setdefault(int(sets[i][deep]), []).append(i)
    return Node(lead, ends, [build_tree(sets, p, deep) for _, p in sorted(parts.items())], sizes)


def search_tree(root: Node, probe: np.ndarray, num: int, den: int) -> list[int]:
    """The sets in the tree whose Jaccard similarity with ``probe`` is at least num/den."""
    found, nx, stack = [], len(probe), [(root, 0, 0, 0)]
    while stack:
        node, depth, overlap, seen = stack.pop()
        alive = True
        for a in range(0, len(node.segment), 64):
            part = node.segment[a : a + 64]
            at = np.searchsorted(probe, part)
            overlap += int((probe[np.minimum(at, nx - 1)] == part).sum())
            depth += len(part)
            seen = int(np.searchsorted(probe, part[-1], side="right"))
            best = min(max(nx - seen + depth, node.shortest), node.longest)
            if not reaches(overlap + min(nx - seen, best - depth), nx, best, num, den):
                alive = False
                break
        if alive:
            if node.ends and reaches(overlap, nx, depth, num, den):
                found += node.ends
            stack += [(child, depth, overlap, seen) for child in node.children]
    return found


def _ids(batch: pa.RecordBatch) -> tuple[list, list]:
    return batch.column(0).to_pylist(), batch.column(1).to_pylist()


def parity(values: np.ndarray) -> np.ndarray:
    """How often, modulo 2, the set's elements fall on each of 64 * MARKS places. Each element that only one of two
    sets holds changes one place, so the sets differ in at least as many elements as their bitmaps in bits."""
    at = (values >> U(20)) % U(64 * MARKS)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=64 * MARKS) & 1).view("i8")


def _first_pass(width: int):
    factors = mix(np.arange(11, 11 + KEYS, dtype=U)) | U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, schema = np.zeros(SLOTS, dtype=np.uint32), FIRST_ARROW
        for batch in batches:
            ids, texts = _ids(batch)
            rows = []
            for i, s in zip(ids, shingle_sets(texts, width), strict=True):
                n, sig, keys, marks = len(s), (0, 0), [], []
                if n:
                    np.add.at(counts, (s & U(SLOTS - 1)).astype(np.int64), 1)
                    with np.errstate(over="ignore"):
                        sig = tuple(int(x) for x in np.array([s.sum(), mix(s ^ U(0x5851F42D4C957F2D)).sum()]).view("i8"))
                        keys = [int(k) for k in np.array([mix(s * f).min() for f in factors]).view("i8")]
                    marks = parity(s).tolist()
                rows.append((i, n, *sig, keys, marks, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist(counters.packed(counts, SLICES, part), schema=schema)

    return run


FIRST = "doc_id long, n int, s1 long, s2 long, keys array<long>, marks array<long>, slice int, part int, blob binary"
FIRST_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()), ("keys", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64())), ("slice", pa.int32()), ("part", pa.int32()), ("blob", pa.binary())])


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(63, np.round(2 * np.log2(counts.astype(np.float64) + 1))).astype(np.uint8)


def _prefixes(levels, hot, width: int, num: int, den: int, buckets: int):
    """Prefix elements of all documents, as one blob for each task and bucket; buckets below 0 hold frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, own = levels.value, TaskContext.get().partitionId()

        def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
            rows = np.concatenate(held)
            token = rows["token"].view(U)
            to = (mix(token) % U(buckets)).astype(np.int64)
            to[(token >> U(58)) >= U(hot)] = -1 - own
            rows, to = rows[order := np.argsort(to, kind="stable")], to[order]
            names, at = np.unique(to, return_index=True)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([zlib.compress(x.tobytes(), 1) for x in np.split(rows, at[1:])], pa.binary())], names=["bucket", "blob"])

        held, size = [], 0
        for batch in batches:
            ids, texts = _ids(batch)
            for i, s in zip(ids, shingle_sets(texts, width), strict=True):
                n = len(s)
                if n and i is not None:
                    with np.errstate(over="ignore"):
                        sig = s.sum().view("i8")
                    first = ordered(s, table)[: n - -(-num * n // den) + 1]
                    rows = np.empty(len(first), dtype=ENTRY)
                    rows["token"], rows["doc_id"], rows["sig"], rows["n"], rows["pos"] = first.view("i8"), i, sig, n, np.arange(len(first))
                    held.append(rows)
                    size += len(rows)
                    if size >= FLUSH:
                        yield dealt(held)
                        held, size = [], 0
        if held:
            yield dealt(held)

    return run


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket, the elements that documents of at least two classes hold, once for each class."""
    rows = np.concatenate([np.frombuffer(zlib.decompress(b), dtype=ENTRY) for b in pdf["blob"]])
    rows = rows[np.lexsort((rows["doc_id"], rows["sig"], rows["token"]))]
    again = np.r_[False, (rows["token"][1:] == rows["token"][:-1]) & (rows["sig"][1:] == rows["sig"][:-1])]
    rows = rows[~again]
    if pdf["bucket"].iloc[0] >= 0:
        same = rows["token"][1:] == rows["token"][:-1]
        rows = rows[np.r_[False, same] | np.r_[same, False]] if len(rows) else rows
    return pd.DataFrame({k: rows[k] for k in ENTRY.names})


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U)) & U(BITS - 1)).astype(np.int64)


def _named(ids: DataFrame):
    """A filter of fixed size, true for all ids of the one column and for few others."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, dtype=bool)
        for batch in batches:
            bits[_bit(batch.column(0).to_numpy(zero_copy_only=False))] = True
        yield pa.RecordBatch.from_pylist([{"bits": zlib.compress(np.packbits(bits).tobytes(), 1)}])

    out = np.zeros(BITS // 8, dtype=np.uint8)
    for row in ids.coalesce(16).mapInArrow(mark, "bits binary").toLocalIterator():
        out |= np.frombuffer(zlib.decompress(row["bits"]), dtype=np.uint8)
    return ids.sparkSession.sparkContext.broadcast(out)


def _texts_of(docs: DataFrame, named) -> DataFrame:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = named.value
        for batch in batches:
            at = _bit(batch.column(0).to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))

    return docs.where("doc_id is not null and text is not null").mapInArrow(keep, "doc_id long, text string").dropDuplicates(["doc_id", "text"])


def verified(docs: DataFrame, pairs: DataFrame, levels, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) among the documents of ``pairs``, each of the pairs that reaches the threshold among them."""
    home = pairs.groupBy("b").agg(F.min("a").alias("g"))
    blocks = home.groupBy("g").agg((F.floor(F.count("*") / BLOCK) + 1).alias("blocks"))
    home = materialize(home.join(blocks, "g").select("b", "g", F.pmod(F.xxhash64("b"), "blocks").alias("block")))
    walkers = pairs.join(home, "b").select("g", "block", "a").distinct()
    many = walkers.groupBy("g", "block").agg((F.floor(F.count("*") / BLOCK) + 1).alias("many"))
    walkers = walkers.join(many, ["g", "block"]).select("g", "block", F.pmod(F.xxhash64("a"), "many").alias("part"), F.col("a").alias("doc_id"), F.lit(True).alias("walks"))
    members = home.join(many, ["g", "block"]).select("g", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("part"), F.col("b").alias("doc_id"), F.lit(False).alias("walks"))
    uses = materialize(walkers.unionByName(members))
    texts = _texts_of(docs, _named(uses.select("doc_id")))

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        table, ids, walks = levels.value, pdf["doc_id"].to_numpy(), pdf["walks"].to_numpy()
        sets = [ordered(s, table) for s in shingle_sets(pdf["text"], width)]
        rest = [k for k, w in enumerate(walks) if not w and len(sets[k])]
        out = []
        if rest:
            tree = build_tree([sets[k] for k in rest])
            for k in np.flatnonzero(walks):
                if len(sets[k]):
                    out += [(ids[k], ids[rest[h]]) for h in search_tree(tree, sets[k], num, den) if ids[rest[h]] != ids[k]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return uses.join(texts, "doc_id").groupBy("g", "block", "part").applyInPandas(check, "a long, b long")


def _beside(keyed: DataFrame, table: DataFrame) -> DataFrame:
    """``keyed`` with the columns of a table of one row a (k, key). A table of few rows is broadcast. Of more the rows of
    hot keys, of which there can be few, are broadcast and the others joined, so that no key's rows meet in one task."""
    table = materialize(table)
    if table.count() <= SENT:
        return keyed.join(F.broadcast(table), ["k", "key"])
    total = keyed.count()
    hot = materialize(keyed.groupBy("k", "key").agg(F.count("*").alias("_c")).where(F.col("_c") > total / HOT_KEYS).select("k", "key"))  # fewer than HOT_KEYS
    few = F.broadcast(table.join(F.broadcast(hot), ["k", "key"]))
    rest = keyed.join(F.broadcast(hot), ["k", "key"], "left_anti").join(table, ["k", "key"])
    return keyed.join(few, ["k", "key"]).unionByName(rest)


def _leaders(reps: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of each representative with the most typical one at each of its min-wise hashes; at most KEYS for each."""
    keyed = reps.select("doc_id", "n", F.posexplode("keys").alias("k", "key"))
    sizes = keyed.groupBy("k", "key").agg(F.count("*").alias("c")).where("c > 1")
    keyed = materialize(_beside(keyed, sizes))
    weight = keyed.groupBy("doc_id").agg(F.sum("c").alias("w"))
    lead = keyed.join(weight, "doc_id").groupBy("k", "key").agg(F.max(F.struct("w", -F.col("doc_id"), "n")).alias("m"))
    met = _beside(keyed, lead.select("k", "key", (-F.col("m.col2")).alias("a"), F.col("m.n").alias("na")))
    return met.where((F.col("a") != F.col("doc_id")) & (den * F.least("n", "na") >= num * F.greatest("n", "na"))).select("a", F.col("doc_id").alias("b")).distinct()


def _across(shared: DataFrame, labels: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components at a shared prefix element, within the length and position bounds."""
    rows = shared.groupBy("token", "sig", "n", "pos").agg(F.min("doc_id").alias("doc_id"))
    rows = rows.join(labels, "doc_id", "left").withColumn("label", F.coalesce("component_id", "doc_id")).select("token", "doc_id", "n", "pos", "label")
    many = rows.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token").agg(F.count("*").alias("l"), F.max(F.struct("c", "label")).alias("m")).where("l > 1")
    rows = rows.join(many.select("token", F.col("m.label").alias("major")), "token")
    rows = rows.join(classes.select(F.col("class_id").alias("doc_id"), *[F.col("marks")[k].alias(f"m{k}") for k in range(MARKS)]), "doc_id")
    rows = materialize(rows)
    apart = " + ".join(f"bit_count(x.m{k} ^ y.m{k})" for k in range(MARKS))
    x, y = rows.where("label <> major").alias("x"), rows.alias("y")
    met = x.join(y, F.expr(f"""x.token = y.token and x.label <> y.label and (y.label = y.major or x.label < y.label)
        and {den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n)
        and ({den} + {num}) * ({apart}) <= ({den} - {num}) * (x.n + y.n)
        and ({den} + {num}) * (1 + least(x.pos, y.pos) + least(x.n - x.pos - 1, y.n - y.pos - 1)) >= {num} * (x.n + y.n)"""))
    return met.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()


def jaccard_links(documents: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(documents' sets, links). Sets: doc_id, n_shingles, class_id for every row; links: verified (a, b) of classes
    that together connect every two classes of similarity >= num/den, directly or through others."""
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = materialize(docs.mapInArrow(_first_pass(width), FIRST))
    counts = counters.total(first.where("blob is not null"), SLOTS, SLICES)
    levels = spark.sparkContext.broadcast(_levels(counts))
    # frequent against the mean slot, so that a full table of a large corpus doesn't make everything frequent
    hot = int(_levels(np.array([HOT + 4 * counts.mean()]))[0])
    sets = first.where("blob is null").select("doc_id", "n", "s1", "s2", "keys", "marks")
    classes = sets.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("class_id"), F.first("keys").alias("keys"), F.first("marks").alias("marks"))
    classes = materialize(classes)
    reps = classes.select(F.col("class_id").alias("doc_id"), "n", "keys")

    near = materialize(verified(docs, materialize(_leaders(reps, num, den)), levels, width, num, den))
    labels = components(near)
    total = classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * num / den) + 1)).first()[0] or 0
    entries = docs.mapInArrow(_prefixes(levels, hot, width, num, den, max(1, total // BUCKET_ROWS + 1) * 8), "bucket long, blob binary")
    shared = materialize(entries.groupBy("bucket").applyInPandas(_shared, "token long, doc_id long, sig long, n int, pos int"))
    pairs = materialize(_across(shared, labels, classes, num, den))
    links = near
    if not pairs.isEmpty():
        links = near.union(verified(docs, pairs, levels, width, num, den))
    # a doc_id whose rows hold different texts ties their classes
    known = sets.join(classes.select("n", "s1", "s2", "class_id"), ["n", "s1", "s2"])
    ties = known.where("doc_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a <> b").select("a", "b")
    links = links.unionByName(ties)
    out = sets.join(classes.select("n", "s1", "s2", "class_id"), ["n", "s1", "s2"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "class_id")
    return out, links


def near_duplicates(documents: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included) for every row."""
    sets, links = jaccard_links(documents, width, num, den)
    found = components(materialize(links)).withColumnRenamed("doc_id", "class_id")
    return sets.join(found, "class_id", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "class_id", "doc_id")).alias("component_id"))


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """The documents that are alone or the smallest id of their group; rows that repeat a doc_id stay."""
    return without(documents, near_duplicates(documents.select("doc_id", "text"), **options).where("doc_id <> component_id").select("doc_id"))
