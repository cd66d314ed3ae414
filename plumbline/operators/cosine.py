"""Pairs of unit vectors whose cosine reaches a threshold, without a row for each candidate.

1. A vector is packed into one row: numbers of the tokens that some other vector has too, and their weights. Equal vectors
   are one class.
2. Classes are dealt to tiles of like numbers of tokens. The tiles are the only thing written. A task compares one tile
   with some of those that are no longer, which it reads from the checkpoint folder.
3. Two vectors' dot product is at most the norm of one on as many of its largest weights as the other has tokens; and at
   most the product of their sketches. A sketch has places for the most common tokens, and others that tokens share, each
   with the norm of its tokens. The sketches of two tiles are multiplied as matrices; they are as wide as the shorter
   vectors need. Both bounds are exact: no pair that reaches the threshold is left out.
4. What passes is verified by the whole vectors in the same task, and written out for the members of both classes.

Work grows with the square of the number of classes of like lengths, the disk with the vectors alone. Tokens are 64-bit
hashes. The table of tokens that more than one item has is sent to all tasks.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import setjoin
from plumbline.operators.setjoin import mix, placed

TILE = 3000  # vectors of a tile
TILE_TOKENS = 1_500_000  # and their tokens
WIDTHS = (128, 8192)  # least and greatest width of a sketch
TASK = 30_000_000_000  # multiplications of a task
AT_ONCE = 500_000  # rows that a task writes at once
SLACK = 1e-4  # of products in single precision
U = np.uint64


def _band(n: np.ndarray) -> np.ndarray:
    """Of a number of tokens; the numbers of a band differ by a factor of up to the root of two."""
    return np.floor(2 * np.log2(n)).astype(np.int64)


def _counted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, token, count of the distinct tokens of each row of a batch (item_id, hashes), by row and token."""
    lists = batch.column(1)
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat, row = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)
    order = np.lexsort((flat, row))
    flat, row = flat[order], row[order]
    at = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])]) if len(flat) else np.zeros(0, dtype=np.int64)
    return row[at], flat[at], np.diff(np.r_[at, len(flat)])


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows have a token (band false), and how many a number of tokens in a band (band true)."""
    for batch in batches:
        row, token, _ = _counted(batch)
        n = np.bincount(row)
        for band, keys in ((False, token), (True, _band(n[n > 0]))):
            keys, c = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), band)), pa.array(keys, pa.int64()), pa.array(c, pa.int64())], names=["band", "key", "c"])


class _Table:
    """Numbers of the tokens that more than one item has, the most common first; tiles of the bands."""

    def __init__(self, tallies: pa.Table):
        band, key, c = (tallies.column(k).to_numpy(zero_copy_only=False) for k in ("band", "key", "c"))
        band = band.astype(bool)
        token, df = key[~band], c[~band]
        by = np.lexsort((token, -df))
        self.df = df[by]
        order = np.argsort(token[by])
        self.token, self.number = token[by][order], order.astype(np.int32)
        self.first, self.tiles, at = {}, {}, 0
        for b, count in sorted(zip(key[band].tolist(), c[band].tolist(), strict=True)):
            most = max(1, min(TILE, int(TILE_TOKENS / 2 ** ((b + 1) / 2))))
            self.first[b], self.tiles[b] = at, math.ceil(count / most)
            at += self.tiles[b]
        self.all_tiles = at

    def numbers(self, token: np.ndarray) -> np.ndarray:
        """Of tokens; -1 of one that a single item has."""
        if not len(self.token):
            return np.full(len(token), -1, dtype=np.int32)
        at = np.minimum(np.searchsorted(self.token, token), len(self.token) - 1)
        return np.where(self.token[at] == token, self.number[at], np.int32(-1))


PACKED = "tile int, s1 long, s2 long, least int, norm double, tokens array<int>, values array<double>, members array<{}>"


def _pack(table: _Table, ids: pa.Array, row: np.ndarray, token: np.ndarray, value: np.ndarray, weight: np.ndarray, norm: np.ndarray | None, least: float) -> pa.RecordBatch:
    """Rows of ``PACKED``, one for each class of equal vectors of a batch. least: of the largest weights that others can
    share so many have a norm of ``least``; a vector where all have less is left out."""
    n = np.bincount(row, minlength=len(ids))
    if norm is None:
        norm = np.sqrt(np.bincount(row, weight * weight, minlength=len(ids)))
    number = table.numbers(token)
    shared = number >= 0
    r, w = row[shared], weight[shared] / norm[row[shared]]
    order = np.lexsort((-np.abs(w), r))
    square = np.cumsum((w * w)[order])
    own = np.bincount(r, minlength=len(ids))
    ends = np.cumsum(own)
    before = np.r_[0.0, square][ends - own]
    needs = np.bincount(r[order], square - before[r[order]] < least * least - 1e-7, minlength=len(ids)).astype(np.int64) + 1
    starts = np.cumsum(n) - n
    classes: dict[bytes, list[int]] = {}
    for k in np.flatnonzero((needs <= own) & (own > 0) & ids.is_valid().to_numpy(zero_copy_only=False)).tolist():
        s = slice(starts[k], starts[k] + n[k])
        classes.setdefault(hashlib.blake2b(token[s].tobytes() + value[s].tobytes(), digest_size=16).digest(), []).append(k)
    one = np.array([k[0] for k in classes.values()], dtype=np.int64)
    sign = np.array([np.frombuffer(k, dtype=np.int64) for k in classes], dtype=np.int64).reshape(-1, 2)
    band = _band(n[one]).tolist()
    tile = [table.first[b] + s % table.tiles[b] for b, s in zip(band, sign[:, 0].tolist(), strict=True)]
    l = own[one]
    at = np.repeat(ends[one] - l - (np.cumsum(l) - l), l) + np.arange(l.sum())
    v, number = value[shared], number[shared]
    by = np.lexsort((number, r))  # ascending numbers
    offsets = pa.array(np.r_[0, np.cumsum(l)].astype(np.int32))
    members = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(k) for k in classes.values()])].astype(np.int32)), ids.take(pa.array([i for k in classes.values() for i in k], pa.int64())))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x[by][at])) for x in (number.astype(np.int32), v.astype(np.float64))]
    cols = [pa.array(tile, pa.int32()), pa.array(sign[:, 0]), pa.array(sign[:, 1]), pa.array(needs[one], pa.int32()), pa.array(norm[one], pa.float64()), *lists, members]
    return pa.RecordBatch.from_arrays(cols, names=["tile", "s1", "s2", "least", "norm", "tokens", "values", "members"])


class _Tile:
    def __init__(self, uris: list[str], scale: np.ndarray | None, void: int):
        parts = []
        for uri in uris:
            system, path = FileSystem.from_uri(uri)
            with system.open_input_file(path) as f:
                parts.append(pq.ParquetFile(f).read())
        t = pa.concat_tables(parts).combine_chunks()
        s1, s2, least, norm = (t.column(k).to_numpy() for k in ("s1", "s2", "least", "norm"))
        # classes of other batches' equal vectors are one
        order = np.lexsort((s2, s1))
        new = np.r_[True, (s1[order][1:] != s1[order][:-1]) | (s2[order][1:] != s2[order][:-1])]
        kind = np.empty(len(order), dtype=np.int64)
        kind[order] = np.cumsum(new) - 1
        one = order[new]
        members = t.column("members").combine_chunks()
        of = np.repeat(kind, members.value_lengths().to_numpy())
        self.members = members.flatten().take(pa.array(np.argsort(of, kind="stable")))
        self.size = np.bincount(of, minlength=len(one))
        self.first = np.cumsum(self.size) - self.size
        tokens, values = (t.column(k).combine_chunks() for k in ("tokens", "values"))
        n = tokens.value_lengths().to_numpy().astype(np.int64)
        start = np.cumsum(n) - n
        self.n, self.least = n[one], least[one].astype(np.int64)
        at = np.repeat(start[one] - (np.cumsum(self.n) - self.n), self.n) + np.arange(self.n.sum())
        self.row = np.repeat(np.arange(len(one)), self.n)
        self.token, value = tokens.flatten().to_numpy()[at], values.flatten().to_numpy()[at]
        self.weight = (value if scale is None else value * scale[self.token]) / norm[one][self.row]
        self.start = np.cumsum(self.n) - self.n
        # the same as a rectangle
        pos = np.arange(len(self.row)) - self.start[self.row]
        shape = len(one), int(self.n.max())
        self.tokens, self.weights = np.full(shape, void, dtype=np.int32), np.zeros(shape)
        self.tokens[self.row, pos], self.weights[self.row, pos] = self.token, self.weight
        self._sketches: dict[int, np.ndarray] = {}

    def sketch(self, width: int) -> np.ndarray:
        if width not in self._sketches:
            half = width // 2
            t = self.token.astype(np.int64)
            place = np.where(t < half, t, half + (mix(t.view(U)) % U(width - half)).astype(np.int64))
            square = np.bincount(self.row * width + place, self.weight * self.weight, minlength=len(self.n) * width)
            self._sketches[width] = np.sqrt(square).astype(np.float32).reshape(-1, width)
        return self._sketches[width]


def _width(n: int) -> int:
    """Of the sketches that bound products with vectors of up to ``n`` tokens."""
    return min(WIDTHS[1], max(WIDTHS[0], 1 << max(n - 1, 1).bit_length()))


def _met(x: _Tile, y: _Tile, least: float, seen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``x`` and of ``y``, and the cosines, of their pairs that reach ``least``; in one tile each pair once, and
    classes of several members with themselves."""
    if x is y:
        many = np.flatnonzero(x.size > 1)
        yield many, many, np.add.reduceat(x.weight * x.weight, x.start)[many]
    width = _width(int(min(x.n.max(), y.n.max())))
    i, j = np.flatnonzero(x.least <= y.n.max()), np.flatnonzero(y.least <= x.n.max())
    bound = x.sketch(width)[i] @ y.sketch(width)[j].T
    passed = bound >= least - SLACK
    if x is y:
        passed = np.triu(passed, 1)
    del bound
    p, q = np.nonzero(passed)
    q = j[q]
    some, at = np.unique(p, return_index=True)
    for k, rows in zip(i[some].tolist(), np.split(q, at[1:]) if len(some) else [], strict=True):
        s = slice(x.start[k], x.start[k] + x.n[k])
        seen[x.token[s]] = x.weight[s]
        step = max(1, 500_000 // y.tokens.shape[1])
        dots = np.concatenate([np.einsum("ij,ij->i", seen.take(y.tokens[part]), y.weights[part]) for part in (rows[a : a + step] for a in range(0, len(rows), step))])
        seen[x.token[s]] = 0
        ok = dots >= least - 1e-9
        if ok.any():
            yield np.full(ok.sum(), k), rows[ok], dots[ok]


def _written(x: _Tile, y: _Tile, p: np.ndarray, q: np.ndarray, cosine: np.ndarray) -> Iterator[pa.RecordBatch]:
    """a < b, cosine of all pairs of members."""
    each = x.size[p] * y.size[q]
    ends = np.cumsum(each)
    for a in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
        g = np.arange(a, min(a + AT_ONCE, int(ends[-1])))
        pair = np.searchsorted(ends, g, side="right")
        k = g - (ends - each)[pair]
        i, j = p[pair], q[pair]
        left, right = x.members.take(pa.array(x.first[i] + k // y.size[j])), y.members.take(pa.array(y.first[j] + k % y.size[j]))
        cos = cosine[pair]
        if x is y:
            stays = pc.or_(pa.array(i != j), pc.less(left, right))
            left, right, cos = left.filter(stays), right.filter(stays), cos[stays.to_numpy(zero_copy_only=False)]
        less = pc.less(left, right)
        yield pa.RecordBatch.from_arrays([pc.if_else(less, left, right), pc.if_else(less, right, left), pa.array(cos)], names=["a", "b", "cosine"])


def _pairs(packed: DataFrame, table: _Table, scale: np.ndarray | None, least: float, kind: str) -> DataFrame:
    spark = packed.sparkSession
    tiles = placed(packed.repartition(max(1, table.all_tiles), "tile"), "tile")
    meta = {r["tile"]: r for r in tiles.groupBy("tile").agg(F.count("*").alias("c"), F.max(F.size("tokens")).alias("n"), F.min("least").alias("least")).collect()}
    files: dict[int, list[str]] = {}
    for uri in tiles.inputFiles() if meta else []:
        files.setdefault(int(re.search(r"/tile=(\d+)/", uri)[1]), []).append(uri)
    tasks = []
    for k, x in meta.items():
        some, cost = [], 0
        for l, y in sorted(meta.items()):
            if l > k or x["least"] > y["n"] or y["least"] > x["n"]:
                continue
            some.append(l)
            cost += x["c"] * y["c"] * (_width(min(x["n"], y["n"])) + 256)
            if cost > TASK:
                tasks.append((cost, k, some))
                some, cost = [], 0
        if some:
            tasks.append((cost, k, some))
    tasks.sort(key=lambda t: -t[0])
    void = len(table.df)
    sent = spark.sparkContext.broadcast((tasks, files, scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tasks, files, scale = sent.value
        seen = np.zeros(void + 1)
        for k in (k for batch in batches for k in batch.column(0).to_pylist()):
            _, one, others = tasks[k]
            x = _Tile(files[one], scale, void)
            for other in others:
                y = x if other == one else _Tile(files[other], scale, void)
                found, rows = [], 0
                for met in _met(x, y, least, seen):
                    found.append(met)
                    rows += len(met[0])
                    if rows > AT_ONCE:
                        yield from _written(x, y, *map(np.concatenate, zip(*found, strict=True)))
                        found, rows = [], 0
                if rows:
                    yield from _written(x, y, *map(np.concatenate, zip(*found, strict=True)))

    return spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInArrow(run, f"a {kind}, b {kind}, cosine double")


def cosine_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """a, b (a < b), cosine >= ``least`` of unit vectors (item_id, token, weight)."""
    kind = vectors.schema["item_id"].dataType.simpleString()
    v = setjoin.kept(vectors.select("item_id", F.xxhash64("token").alias("token"), "weight"))
    bands = v.groupBy("item_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("c")).collect()
    tallies = v.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select(F.lit(False).alias("band"), F.col("token").alias("key"), "c").toArrow()
    table = _Table(pa.concat_tables([tallies.cast(TALLIES), pa.table([[True] * len(bands), [int(_band(np.array(r["n"]))) for r in bands], [r["c"] for r in bands]], schema=TALLIES)]).group_by(["band", "key"]).aggregate([("c", "sum")]).rename_columns(["band", "key", "c"]))
    sent = v.sparkSession.sparkContext.broadcast(table)
    lists = v.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("token", "weight"))).alias("v")).select("item_id", "v.token", "v.weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = np.repeat(np.arange(batch.num_rows), batch.column(1).value_lengths().to_numpy())
            token, weight = (batch.column(k).flatten().to_numpy() for k in (1, 2))
            yield _pack(sent.value, batch.column(0), row, token, weight, weight, np.ones(batch.num_rows), least)

    return setjoin.kept(_pairs(lists.mapInArrow(run, PACKED.format(kind)), table, None, least, kind))


TALLIES = pa.schema([("band", pa.bool_()), ("key", pa.int64()), ("c", pa.int64())])


def tfidf_pairs(items: DataFrame, tokens: str, least: float) -> DataFrame:
    """``cosine_pairs`` of the items' tf-idf vectors (tf * (ln((1 + n) / (1 + df)) + 1), of unit length) without a row for
    each token of an item: tokens are counted, numbered and packed in two passes over the items."""
    kind = items.schema["item_id"].dataType.simpleString()
    docs = items.count()
    hashed = items.select("item_id", F.transform(tokens, lambda t: F.xxhash64(t)).alias("h"))
    if not items.groupBy("item_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        hashed = hashed.groupBy("item_id").agg(F.flatten(F.collect_list("h")).alias("h"))
    tallies = hashed.mapInArrow(_tallied, "band boolean, key long, c long").groupBy("band", "key").agg(F.sum("c").alias("c"))
    table = _Table(tallies.where("band or c > 1").toArrow())
    scale, alone = np.log((1.0 + docs) / (1 + table.df)) + 1, math.log((1.0 + docs) / 2) + 1
    sent = items.sparkSession.sparkContext.broadcast((table, scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, scale = sent.value
        for batch in batches:
            row, token, count = _counted(batch)
            number = table.numbers(token)
            weight = count * np.where(number >= 0, np.r_[scale, alone][number], alone)
            yield _pack(table, batch.column(0), row, token, count.astype(np.float64), weight, None, least)

    return _pairs(hashed.mapInArrow(run, PACKED.format(kind)), table, scale, least, kind)
