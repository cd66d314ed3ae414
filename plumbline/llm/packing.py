"""Operator 1: packing documents into sequences of at most ``cap`` tokens by swap-based local search.

Documents become pieces (only longer ones are cut; the first piece takes the remainder). Pieces are dealt at random
to shards of bounded size. A shard starts from best fit decreasing and then improves: the emptiest bin exchanges with
the other underfull bins by moves, swaps of one for one, of two for one and of one for two. All such steps are looked at,
only those that raise the sum of squared fills are taken, the largest rise first, and so on until the bin is empty or no
step is left; then the next emptiest follows, over and over until a whole round of bins changes nothing or the number of
bins has reached the total's lower bound. Bins filled below ``FULL`` then meet those of other shards, whole as they are,
and exchange again: rounds go on until one shard holds them all or a round leaves as many of them as the one before.

Defined cases: a null text is the empty text, which is one piece of the end token; a null doc_id is carried as it
is; rows that repeat a doc_id are packed each for itself; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import materialize, small_batches

SHARD = 8192  # pieces that one task packs together
FULL = 0.95  # bins filled less go to the next round
CACHED = 240_000  # words whose ids a worker keeps
PIECES = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
_coders: dict = {}


class Coder(dict):
    """Token ids, as little-endian bytes, of words with the blank before them, by the library that the vocabulary is for.

    The vocabulary splits a text before its merges: a blank belongs to the word behind it, and of a run of white space all
    but the last character is one part. So a blank starts a part unless white space stands on both sides of it, or it ends
    the text behind white space. Texts without such blanks are the concatenation of their blank-led words, whose ids are
    worked out once. All others, and those that hold a special token's string, are encoded whole.

    ``ranks`` is a rank file of the same vocabulary. It encodes words of Latin letters, digits and signs, several times as
    fast; all others are left to the library, whose character tables may be of another age.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str = ""):
        from tokenizers import Tokenizer

        self.tokenizer, self.plain = Tokenizer.from_file(path), None
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([r"(?:^|\s) (?:\s|$)", r"^ ", r" $", *map(re.escape, special)]))
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

        self.special, self.old = special, {}

    def ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _latin(self, text: str) -> bytes:
        if self.plain and (text.isascii() or max(text) < "\u0250"):
            return array("I", self.plain.encode_ordinary(text)).tobytes()
        return self.ids(text)

    def __missing__(self, word: str) -> bytes:
        # the words of the last half are kept aside, so that frequent ones aren't worked out again
        if len(self) >= CACHED // 2:
            self.old = self.copy()
            self.clear()
        got = self.old.get(word)
        self[word] = got = self._latin(" " + word) if got is None else got
        return got

    def by_words(self, text: str) -> bool:
        """Whether a text is the concatenation of its blank-led words; looked up quickly where it has no other white space
        than blanks and line feeds."""
        if any(map(text.__contains__, self.special)):
            return False
        if text.replace("\n", "").isprintable():
            return text[0] != " " and text[-1] != " " and "   " not in text and "\n  " not in text and "  \n" not in text and "\n \n" not in text
        return not self.whole.search(text)

    def encode(self, text: str) -> bytes:
        if not text or not self.by_words(text):
            return self.ids(text)
        first, *rest = text.split(" ")
        return self._latin(first) + b"".join(map(self.__getitem__, rest))


def _pieces(files: tuple, end_id: int, cap: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if files not in _coders:
            _coders[files] = Coder(*files)
        coder, end = _coders[files], np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out = []
            for doc, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = coder.encode(text) + end if text else end
                n = len(ids) // 4
                cuts = [0, *range(n % cap or cap, n + 1, cap)] if n > cap else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[4 * a : 4 * b]
                    out.append((doc, row, k, a, b - a, zlib.crc32(part), part if with_ids else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), PIECES.types, strict=True)], schema=PIECES)

    return run


def best_fit(sizes: np.ndarray, cap: int) -> np.ndarray:
    """The bin of each piece, by best fit decreasing."""
    order, place = np.argsort(-sizes, kind="stable"), np.empty(len(sizes), dtype=np.int64)
    by_free: dict[int, list[int]] = {}
    frees, bins = 0, 0
    for i in order.tolist():
        size = int(sizes[i])
        open_ = frees >> size
        if open_:
            free = size + ((open_ & -open_).bit_length() - 1)
            b = by_free[free].pop()
            if not by_free[free]:
                frees &= ~(1 << free)
        else:
            free, b, bins = cap, bins, bins + 1
        place[i] = b
        by_free.setdefault(free - size, []).append(b)
        frees |= 1 << (free - size)
    return place


def improve(sizes: np.ndarray, place: np.ndarray, cap: int) -> np.ndarray:
    """Local search from a packing: every step raises the sum of squared fills, so it ends, and no bin is ever added."""
    place = place.copy()
    fill = np.bincount(place, weights=sizes).astype(np.int64)
    least = -(-int(fill.sum()) // cap)
    while True:
        stuck, changed = np.zeros(len(fill), dtype=bool), False
        while (fill > 0).sum() > least:
            ready = np.flatnonzero((fill > 0) & (fill < cap) & ~stuck)
            if len(ready) < 2:
                break
            v = int(ready[np.argmin(fill[ready])])
            items = np.flatnonzero((fill < cap)[place])
            while fill[v] and _step(sizes, place, fill, items, v, cap):
                changed = True
            stuck[v] = fill[v] > 0
        if not changed or (fill > 0).sum() <= least:
            return place


def _best(rise: np.ndarray) -> tuple[int, tuple]:
    if not rise.size:
        return 0, ()
    at = np.unravel_index(int(np.argmax(rise)), rise.shape)
    return int(rise[at]), at


def _step(sizes, place, fill, items, v: int, cap: int) -> bool:
    """Take the step between bin v and another underfull bin that raises the sum of squared fills most; False if none does.

    Sizes are whole numbers up to ``cap``, so the pieces and pairs of v are looked at once for each different size."""
    own, other = items[place[items] == v], items[place[items] != v]
    if not len(other):
        return False
    target = fill[place[other]]

    def rise(gain: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Twice the rise of fill[at]^2 + fill[v]^2 when ``gain`` goes from v to there; 0 where it doesn't fit or falls."""
        ok = (gain > 0) & (gain <= cap - at)
        return np.where(ok, gain * (at - fill[v] + gain), 0).clip(min=0)

    ones, first = np.unique(sizes[own], return_index=True)
    give = [own[k : k + 1] for k in first]
    amounts = [ones]
    if len(own) > 1:  # pairs of v, one for each different sum
        x, y = np.triu_indices(len(own), 1)
        sums, at = np.unique(sizes[own[x]] + sizes[own[y]], return_index=True)
        amounts.append(sums)
        give += [own[[x[k], y[k]]] for k in at]
    amount = np.concatenate(amounts)
    bins, where = np.unique(place[other], return_index=True)
    best, plan = _best(rise(ones[:, None], target[where][None, :]))  # a move
    if plan:
        plan = give[plan[0]], other[:0], int(bins[plan[1]])
    got, at = _best(rise(amount[:, None] - sizes[other][None, :], target[None, :]))  # one or two for one
    if got > best:
        best, plan = got, (give[at[0]], other[at[1] : at[1] + 1], int(place[other[at[1]]]))
    a, b = _pairs_within(place[other])
    got, at = _best(rise(ones[:, None] - (sizes[other[a]] + sizes[other[b]])[None, :], target[a][None, :]))  # one for two
    if got > best:
        best, plan = got, (give[at[0]], other[[a[at[1]], b[at[1]]]], int(place[other[a[at[1]]]]))
    if best <= 0:
        return False
    given, taken, j = plan
    gain = int(sizes[given].sum() - sizes[taken].sum())
    place[given], place[taken] = j, v
    fill[v] -= gain
    fill[j] += gain
    return True


def _pairs_within(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of elements of equal group."""
    order = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[order], group[order], side="right")
    later = ends - np.arange(len(group)) - 1
    a = np.repeat(np.arange(len(group)), later)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
    return order[a], order[b]


def pack_sizes(sizes: np.ndarray, cap: int, place: np.ndarray | None = None) -> np.ndarray:
    """The bin of each piece of at most ``cap``, without gaps in the numbers: by best fit decreasing and local search.
    With a packing to start from, that one is improved too and the better of both is taken."""
    rest = np.flatnonzero(sizes < cap)
    out = len(sizes) + np.arange(len(sizes))
    if len(rest):
        found = improve(sizes[rest], best_fit(sizes[rest], cap), cap)
        if place is not None:
            other = improve(sizes[rest], np.unique(place[rest], return_inverse=True)[1], cap)
            found = other if len(np.unique(other)) < len(np.unique(found)) else found
        out[rest] = found
    return np.unique(out, return_inverse=True)[1]


def _pack_shard(level: int, cap: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "row", "piece"], kind="stable", ignore_index=True)
        sizes = pdf["length"].to_numpy()
        place = pack_sizes(sizes, cap, pdf["sequence_id"].to_numpy() if level else None)
        fill = np.bincount(place, weights=sizes)
        pdf["offset"] = pdf.groupby(place)["length"].cumsum() - pdf["length"]
        pdf["sequence_id"] = (level << 56) | (int(pdf["shard"].iloc[0]) << 14) | place
        pdf["again"] = (fill[place] < FULL * cap) & (not last)
        return pdf

    return run


def pack_documents(documents: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str = "", cap: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids (little-endian uint32).

    ``tokenizer`` is the path of a tokenizers file, which every executor must be able to read; so is ``ranks``, if given, a
    rank file of the same vocabulary whose splitting pattern is ``pattern``: ids are the same, found faster."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    small_batches(documents.sparkSession)
    columns = "doc_id long, row long, piece int, start long, length long, ids_crc32 long, ids binary"
    left = materialize(docs.mapInArrow(_pieces((tokenizer, ranks, pattern), end_id, cap, with_ids), columns)).withColumn("sequence_id", F.lit(0).cast("long"))
    out, level, before = None, 0, None
    while True:
        n, bins = left.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        shards = max(1, -(-n // SHARD))
        # bins travel whole once there are any
        key = F.xxhash64("sequence_id", F.lit(level)) if level else F.xxhash64("doc_id", "row", "piece")
        last = shards == 1 or (level > 1 and bins >= before) or level == 60
        dealt = left.withColumn("shard", F.pmod(key, F.lit(shards)))
        packed = dealt.groupBy("shard").applyInPandas(_pack_shard(level, cap, last), f"{columns}, sequence_id long, shard long, offset long, again boolean")
        packed = packed if last else materialize(packed)
        done = packed.where("not again")
        out = done if out is None else out.unionByName(done)
        if last:
            return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
        left, before, level = packed.where("again").drop("shard", "offset", "again"), bins, level + 1
