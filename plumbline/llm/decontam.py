"""Operator 3: benchmark decontamination by greedy string tiling.

Word runs of ``least`` words that a document shares with a benchmark item are seeds, found by joining running Karp-Rabin
hashes. Within a document and item the longest match that overlaps no earlier tile becomes a tile, again and again: the
greatest length at which both still have a free run in common is found by halving over Karp-Rabin hashes of that many
words, so repeated runs are never paired with each other. The share of the item's words under tiles is its coverage, so
passages whose parts were reordered or split are still caught.

The benchmark's seeds are a table. While it has at most ``sent`` rows it is broadcast, and documents are searched where
they lie. A larger one is joined: documents send on the runs that pass a bitmap of all seeds (of fixed size), these meet the
seeds by hash, and every document and item is a group of its own. Both ways give the same rows.

Defined cases: null texts have no words; items of fewer than ``least`` words are never found; rows that repeat a
doc_id or an item_id are each judged, and the best coverage of a (doc_id, item_id) is returned once; null item_ids are
left out, a null doc_id is carried as it is; other columns are ignored by ``contamination`` and kept by ``clean``; words are
runs of letters, digits and non-ASCII bytes with A-Z folded; an empty table gives no rows.
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

from plumbline.llm.store import materialize, small_batches, without
from plumbline.llm.textvec import MARKS, U, mix, word_lists

LEAST = 5
COVERAGE = 0.5
SENT = 4_000_000  # seeds that are broadcast
BITS = 1 << 27  # of the bitmap of more seeds
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
FOUND = "doc_id long, item_id long, coverage double, matched_words int, tiles int"


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[U(1), np.full(max(n - 1, 0), U(base), dtype=U)], dtype=U)[:n]


def running_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``width`` words, from one running sum modulo 2**64."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    with np.errstate(over="ignore"):
        total = np.r_[U(0), np.cumsum(words * _powers(BASE, len(words)), dtype=U)]
        return mix((total[width:] - total[:-width]) * _powers(INVERSE, n))


def _reach(alive: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """How many usable runs follow each other from each place on; ``breaks`` marks places that follow no other."""
    ends = np.flatnonzero(np.r_[breaks[1:] | ~alive[:-1] | ~alive[1:], True][: len(alive)]) + 1
    stop = ends[np.searchsorted(ends, np.arange(len(alive)), side="right")]
    return np.where(alive, stop - np.arange(len(alive)), 0)


def tile(item: np.ndarray, grams: np.ndarray, places: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (words, place in the item, place in the document), longest first, ties by place.

    ``item`` holds the hashes of the item's word runs in order, ``grams`` and ``places`` those runs of the document that
    the item has, and where they start. A tile makes all runs that touch its words unusable on both sides."""
    whole, breaks = np.zeros(len(item), dtype=bool), np.r_[True, np.diff(places) != 1]
    free, left = np.ones(len(item), dtype=bool), np.ones(len(places), dtype=bool)
    tiles: list[tuple[int, int, int]] = []
    while True:
        ri, rd = _reach(free, whole), _reach(left, breaks)

        def windows(t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Places and hashes of t usable runs on end, in the item and in the document."""
            i, j = np.flatnonzero(ri >= t), np.flatnonzero(rd >= t)
            return i, running_hashes(item, t)[i] if len(i) else item[:0], j, running_hashes(grams, t)[j] if len(j) else grams[:0]

        low, high = 0, int(min(ri.max(initial=0), rd.max(initial=0)))
        while low < high:
            t = (low + high + 1) // 2
            _, hi, _, hj = windows(t)
            low, high = (t, high) if np.isin(hi, hj).any() else (low, t - 1)
        if not low:
            return tiles
        i, hi, j, hj = windows(low)
        order = np.argsort(hj, kind="stable")
        starts, stops = np.searchsorted(hj[order], hi, "left"), np.searchsorted(hj[order], hi, "right")
        tried: dict[int, int] = {}  # of a hash, how many of its places in the document are used up
        for a, x, y in zip(i.tolist(), starts.tolist(), stops.tolist(), strict=True):
            if x == y or not free[a : a + low].all():
                continue
            k = tried.get(x, x)
            while k < y and not left[j[order[k]] : j[order[k]] + low].all():
                k += 1
            tried[x] = k
            if k < y:
                b, n = int(places[j[order[k]]]), low + width - 1
                free[max(a - width + 1, 0) : a + n] = False
                left[np.searchsorted(places, b - width + 1) : np.searchsorted(places, b + n)] = False
                tiles.append((n, a, b))


def judged(item: np.ndarray, size: int, grams: np.ndarray, places: np.ndarray, width: int, coverage: float) -> tuple[int, int] | None:
    """Words under tiles and their number, if they reach the coverage of an item of ``size`` words."""
    hit = np.flatnonzero(np.isin(item, grams))
    under = np.zeros(size + 1, dtype=np.int64)
    np.add.at(under, hit, 1)
    np.add.at(under, hit + width, -1)
    if (np.cumsum(under) > 0).sum() < coverage * size:  # words that any tile could hold
        return None
    tiles = tile(item, grams, places, width)
    covered = sum(t[0] for t in tiles)
    return (covered, len(tiles)) if covered >= coverage * size else None


def _seeds(width: int):
    schema = pa.schema([("gram", pa.int64()), ("item", pa.int64()), ("item_id", pa.int64()), ("place", pa.int32()), ("size", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = TaskContext.get().partitionId() << 40
        for batch in batches:
            for item_id, words in zip(batch.column(0).to_pylist(), word_lists(batch.column(1).to_pylist(), MARKS), strict=True):
                grams, item = running_hashes(words, width), item + 1
                n = len(grams)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(grams.view("i8")), pa.array([item] * n, pa.int64()), pa.array([item_id] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array([len(words)] * n, pa.int32())], schema=schema)

    return run


class Benchmark:
    """All seeds: distinct hashes in order, the items of each, and the runs of each item."""

    def __init__(self, seeds: pa.Table):
        gram, item, place = (seeds.column(c).to_numpy() for c in ("gram", "item", "place"))
        order = np.lexsort((place, item))
        gram, item = gram[order].view(U), item[order]
        _, first, self.of = np.unique(item, return_index=True, return_inverse=True)
        self.ends = np.r_[first, len(item)]
        self.gram, self.sizes, self.ids = gram, seeds.column("size").to_numpy()[order][first], seeds.column("item_id").to_numpy()[order][first]
        pairs = np.unique(np.rec.fromarrays([gram, self.of], names="g,k"))
        self.known, self.start = np.unique(pairs["g"], return_index=True)
        self.items, self.start = pairs["k"], np.r_[self.start, len(pairs)]

    def of_item(self, k: int) -> np.ndarray:
        return self.gram[self.ends[k] : self.ends[k + 1]]

    def search(self, words: np.ndarray, width: int, coverage: float) -> Iterator[tuple[int, int, int]]:
        """(item, words covered, tiles) of the items that a document covers."""
        grams = running_hashes(words, width)
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        places = np.flatnonzero(self.known[at] == grams) if len(self.known) else at[:0]
        if not len(places):
            return
        hits, grams = np.unique(at[places]), grams[places]
        n = self.start[hits + 1] - self.start[hits]
        asked = self.items[np.repeat(self.start[hits] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        items, shared = np.unique(asked, return_counts=True)
        sizes = self.sizes[items]
        # a run that the item repeats may cover more words than its own; only few items repeat runs
        distinct = np.array([len(np.unique(self.of_item(k))) for k in items])
        for k in items[(shared * width >= coverage * sizes) | (distinct < self.ends[items + 1] - self.ends[items])].tolist():
            mine = np.isin(grams, self.of_item(k))
            if (got := judged(self.of_item(k), int(self.sizes[k]), grams[mine], places[mine], width, coverage)) is not None:
                yield k, *got


def _searched(docs: DataFrame, seeds: DataFrame, width: int, coverage: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(Benchmark(seeds.toArrow()))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("matched_words", pa.int32()), ("tiles", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = sent.value
        for batch in batches:
            out = []
            for doc, words in zip(batch.column(0).to_pylist(), word_lists(batch.column(1).to_pylist(), MARKS), strict=True):
                out += [(doc, int(bench.ids[k]), c / int(bench.sizes[k]), c, t) for k, c, t in bench.search(words, width, coverage)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return docs.mapInArrow(run, FOUND)


def _bit(grams: np.ndarray) -> np.ndarray:
    return (mix(grams.view(U)) & U(BITS - 1)).astype(np.int64)


def _joined(docs: DataFrame, seeds: DataFrame, width: int, coverage: float) -> DataFrame:
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, dtype=bool)
        for batch in batches:
            bits[_bit(batch.column(0).to_numpy(zero_copy_only=False))] = True
        yield pa.RecordBatch.from_pylist([{"bits": zlib.compress(np.packbits(bits).tobytes(), 1)}])

    bits = np.zeros(BITS // 8, dtype=np.uint8)
    for row in seeds.select("gram").coalesce(16).mapInArrow(mark, "bits binary").toLocalIterator():
        bits |= np.frombuffer(zlib.decompress(row["bits"]), dtype=np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, doc = sent.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc_id, words in zip(batch.column(0).to_pylist(), word_lists(batch.column(1).to_pylist(), MARKS), strict=True):
                grams, doc = running_hashes(words, width), doc + 1
                at = _bit(grams)
                places = np.flatnonzero((known[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
                if n := len(places):
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array([doc_id] * n, pa.int64()), pa.array(grams[places].view("i8")), pa.array(places.astype(np.int32))], names=["doc", "doc_id", "gram", "at"])

    found = materialize(docs.mapInArrow(hits, "doc long, doc_id long, gram long, at int"))
    # a document's side has its runs that the item holds, the item's side all of its own: neither is paired with the other
    ours = found.join(materialize(seeds.select("gram", "item").distinct()), "gram").select("doc", "doc_id", "item", "gram", F.col("at").alias("place"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("long").alias("item_id"))
    ours = materialize(ours)
    theirs = ours.select("doc", "doc_id", "item").distinct().join(seeds, "item").select("doc", "doc_id", "item", "gram", "place", "size", "item_id")

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["item_id"].notna()
        item, doc = pdf[side].sort_values("place"), pdf[~side].sort_values("place")
        size = int(item["size"].iloc[0])
        got = judged(item["gram"].to_numpy().view(U), size, doc["gram"].to_numpy().view(U), doc["place"].to_numpy().astype(np.int64), width, coverage)
        rows = [] if got is None else [(pdf["doc_id"].iloc[0], int(item["item_id"].iloc[0]), got[0] / size, *got)]
        return pd.DataFrame(rows, columns=["doc_id", "item_id", "coverage", "matched_words", "tiles"])

    return ours.unionByName(theirs).groupBy("doc", "item").applyInPandas(check, FOUND)


def contamination(documents: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, sent: int = SENT) -> DataFrame:
    """doc_id, item_id, coverage, matched_words, tiles for every document that holds enough of an item."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    small_batches(documents.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    seeds = materialize(items.mapInArrow(_seeds(least), "gram long, item long, item_id long, place int, size int"))
    way = _searched if seeds.count() <= sent else _joined
    best = F.max(F.struct("coverage", "matched_words", "tiles")).alias("b")
    return way(docs, seeds, least, coverage).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.coverage", "b.matched_words", "b.tiles")


def clean(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no item to the threshold."""
    return without(documents, contamination(documents, benchmark, **options).select("doc_id"))
