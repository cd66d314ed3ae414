"""Operator 6: toxicity by nearest labelled examples of exact TF-IDF cosine.

Documents and examples are vectors of (1 + ln tf) * idf over all words of the examples; idf counts all documents. Every
text is compared with the examples over all these words by a block-max inverted index, and the k nearest are exact. A
word that no example holds has no place in these vectors: it would scale a text's similarities, not order them.

Besides, terms are learned from the labels: words, and beginnings of words, of whose examples a clearly larger share
than usual is toxic, by a likelihood-ratio test that few random words pass. A second index of the same kind finds the
nearest examples over these terms alone. A text without such a term has the toxic share of examples that have none
either.

In both, votes weigh by squared similarity against the prior. A logistic regression on the log odds of the two votes,
and a monotone map, both fitted on the examples' leave-one-out votes, give the score. ``nearest`` and ``similarity``
are the neighbours over all words.

The index holds at most ``fit_rows`` labelled rows, chosen by a hash of doc_id; the labels of rows held out (crc32 of the
doc_id's text modulo 4 is 2) are never learned from. All rows are scored, each from its whole text.

Defined cases: null and empty texts, and those that share no word with any example, have no neighbours; without labels
every score is 0; of equal similarities the smaller example id is nearer; examples of equal texts are one, under the
smallest id and with the worse of clashing labels; rows that repeat a doc_id are scored each for itself; a null doc_id is
scored and never held out; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import counters
from plumbline.llm.quality import fit_sample
from plumbline.llm.store import materialize, small_batches

FIT_ROWS = 20_000
TERMS = 4096
STRENGTH = 15.0  # of the likelihood-ratio statistic: one in ten thousand random terms
THRESHOLD = 0.3
SHARE = THRESHOLD  # of the examples with a term that are toxic, at least: what it takes to decide
NEAREST = 15
BLOCK = 64
DENSE = 1024  # words whose weights are a matrix
TOGETHER = 256  # texts that are compared at once
SLICES = 8
ERROR = 5e-5  # of a similarity in single precision, at most
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def terms_of(word: str) -> list[str]:
    """A word's terms: itself, and its beginnings of four to six letters."""
    return [word, *(f"{word[:n]}-" for n in (4, 5, 6) if len(word) >= n)]


def _term_counts(known: dict[str, int] | None):
    """Documents with each term in a batch of texts; with ``known`` of these terms alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = None if known is None else {t[:4] for t in known}
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = set(_WORD.findall((text or "").lower()))
                if heads is not None:
                    words = [w for w in words if w[:4] in heads]
                counts.update({t for w in words for t in terms_of(w) if known is None or t in known})
        yield pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    return run


def choose_terms(sample: DataFrame, bad: int, good: int, terms: int = TERMS, strength: float = STRENGTH) -> list[tuple[str, int]]:
    """The terms whose document shares differ most between labels, with their document counts.

    A term that k toxic examples and no other hold has the largest statistic that k allows, 2 k ln(n / bad); so terms of too
    few toxic examples are left out before the others are counted."""
    n = bad + good
    least = max(3, math.ceil(strength / (2 * math.log(n / bad))))
    toxic, rest = sample.where("y > 0.5").select("text"), sample.where("y <= 0.5").select("text")
    first = toxic.mapInArrow(_term_counts(None), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    in_bad = {r["term"]: r["n"] for r in first.collect()}  # at most the terms of the bounded sample
    in_good = {r["term"]: r["n"] for r in rest.mapInArrow(_term_counts(in_bad), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}

    def part(k: int, of: int, expected: float) -> float:
        return (k * math.log(k / expected) if k else 0.0) + ((of - k) * math.log((of - k) / (of - expected)) if of > k else 0.0)

    found = []
    for term, k in in_bad.items():
        df = k + in_good.get(term, 0)
        if df < n and k >= SHARE * df:
            g = 2 * (part(k, bad, df * bad / n) + part(df - k, good, df * good / n))
            if g >= strength:
                found.append((-g, term, df))
    return [(term, df) for _, term, df in sorted(found)[:terms]]


class Terms(dict):
    """Term numbers of words; worked out once for a word, and only for words that begin as some term does."""

    def __init__(self, numbers: dict[str, int]):
        self.numbers = numbers
        self.heads = {t[:4] for t in numbers}

    def __reduce__(self):
        return Terms, (self.numbers,)

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        self[word] = got = tuple(k for t in terms_of(word) if (k := self.numbers.get(t)) is not None)
        return got


def bag(words: Counter, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of the terms of a text's words."""
    counts: dict[int, int] = {}
    heads = terms.heads
    for w in [w for w in words if w[:4] in heads]:
        for k in terms[w]:
            counts[k] = counts.get(k, 0) + words[w]
    return np.fromiter(counts.keys(), dtype=np.int64, count=len(counts)), np.fromiter(counts.values(), dtype=float, count=len(counts))


def _alike(dense: np.ndarray) -> np.ndarray:
    """An order of the columns in which those alike lie together: parted again and again by the main direction in which a
    group varies. It only tightens the blocks' bounds."""
    out, stack = [], [np.arange(dense.shape[1])]
    while stack:
        group = stack.pop()
        if len(group) <= BLOCK:
            out.append(group)
            continue
        x = dense[:, group]
        x = x - x.mean(axis=1, keepdims=True)
        w = x.var(axis=1) + 1e-9
        for _ in range(6):
            w = x @ (w @ x)
            w /= max(float(np.linalg.norm(w)), 1e-30)
        along = w @ x
        order = np.argsort(along, kind="stable")
        cut = int(np.searchsorted(along[order], 0.0))
        cut = cut if len(group) / 8 <= cut <= 7 * len(group) / 8 else len(group) // 2
        stack += [group[order[cut:]], group[order[:cut]]]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


class Index:
    """Block-max inverted index of example vectors; nearest examples by cosine, exact.

    Examples that are alike lie together in blocks. Words that few examples hold have lists of these; the often held ones
    have their weights in a matrix and keep their largest weight in each block. A query first adds up the lists: that is
    no more than each similarity, so its k-th largest sum is no more than the k-th similarity. A block whose largest sum
    and largest weights of the query's often held words can't reach it together is skipped; of the others the matrix part
    is added, in single precision. Examples within twice its error of the k-th best are then worked out in double precision."""

    def __init__(self, rows: np.ndarray, at: np.ndarray, counts: np.ndarray, ys: np.ndarray, ids: np.ndarray, idf: np.ndarray, prior: float):
        """``rows`` holds the ends of the examples' parts of ``at`` and ``counts``; ``ids`` ascend."""
        self.idf, self.prior, self.query = idf, prior, np.zeros(len(idf))
        size, n = np.diff(np.r_[0, rows]), len(ids)
        place = np.repeat(np.arange(n), size)
        weight = (1 + np.log(counts)) * idf[at]
        weight = weight / np.maximum(np.sqrt(np.bincount(place, weights=weight**2, minlength=n)), 1e-12)[place]
        held = np.bincount(at, minlength=len(idf))
        often = np.argsort(-held, kind="stable")[:DENSE]
        self.column = np.full(len(idf), -1, dtype=np.int32)
        self.column[often] = np.arange(len(often))
        in_matrix = self.column[at] >= 0
        dense = np.zeros((len(often), n), dtype=np.float32)
        dense[self.column[at[in_matrix]], place[in_matrix]] = weight[in_matrix]
        order = _alike(dense[:128])
        self.y, self.ids, self.width = ys[order], ids[order], len(often)
        self.places = {i: p for p, i in enumerate(self.ids.tolist())}
        to = np.empty(n, dtype=np.int64)
        to[order] = np.arange(n)
        by = np.argsort(to[place], kind="stable")
        self.at, self.weight, place, in_matrix = at[by].astype(np.int32), weight[by], to[place][by], in_matrix[by]
        self.rows = np.r_[0, np.cumsum(size[order])].astype(np.int64)
        lists = np.flatnonzero(~in_matrix)
        lists = lists[np.argsort(self.at[lists], kind="stable")]
        self.list_place, self.list_weight = place[lists].astype(np.int32), self.weight[lists].astype(np.float32)
        self.start = np.r_[0, np.cumsum(np.where(self.column < 0, held, 0))].astype(np.int64)
        self.blocks = np.arange(0, n, BLOCK)
        self.parts = [np.ascontiguousarray(dense[:, order[a : a + BLOCK]]) for a in self.blocks]
        self.most = np.stack([p.max(axis=1) for p in self.parts], axis=1) if n and len(often) else np.zeros((len(often), len(self.blocks)), dtype=np.float32)

    def weights(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[at]
        return w / max(np.sqrt((w**2).sum()), 1e-12)

    def _sums(self, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Similarities over the words that have lists."""
        rare = self.column[at] < 0
        first = self.start[at[rare]]
        n = self.start[at[rare] + 1] - first
        read = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.list_place[read], weights=self.list_weight[read] * np.repeat(w[rare].astype(np.float32), n), minlength=len(self.ids))

    def nearest(self, bags: list[tuple[np.ndarray, np.ndarray]], k: int = NEAREST, skip: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each bag similarities and places of the k nearest examples: falling similarity, then rising id. ``skip``
        has for each bag the place of an example to leave out."""
        for a in range(0, len(bags), TOGETHER):
            some = bags[a : a + TOGETHER]
            if not len(self.ids):
                yield from ((np.zeros(0), np.zeros(0, dtype=np.int64)) for _ in some)
                continue
            weights = [self.weights(*b) for b in some]
            rough, q = np.empty((len(some), len(self.ids)), dtype=np.float32), np.zeros((len(some), self.width), dtype=np.float32)
            for row, sums, (at, _), w in zip(q, rough, some, weights, strict=True):
                column = self.column[at]
                row[column[column >= 0]] = w[column >= 0]
                sums[:] = self._sums(at, w)
            if skip is not None:
                rough[np.arange(len(some)), skip[a : a + TOGETHER]] = -2.0
            bound, top = q @ self.most, np.maximum.reduceat(rough, self.blocks, axis=1)
            asked = (bound > 0) & (top + bound >= self._floor(top, k)[:, None] - 2 * ERROR)
            for b in np.flatnonzero(asked.any(axis=0)):
                who = np.flatnonzero(asked[:, b])
                who = who if 2 * len(who) < len(some) else slice(None)  # more than asked does no harm
                rough[who, b * BLOCK : (b + 1) * BLOCK] += q[who] @ self.parts[b]
            floor = self._floor(np.maximum.reduceat(rough, self.blocks, axis=1), k)
            for sums, low, (at, _), w in zip(rough, floor, some, weights, strict=True):
                yield self._exact(sums, low, at, w, k)

    @staticmethod
    def _floor(top: np.ndarray, k: int) -> np.ndarray:
        """No more than the k-th best of a row: the k-th best of its blocks' best."""
        return np.partition(top, -k, axis=1)[:, -k].clip(min=0) if top.shape[1] > k else np.zeros(len(top), dtype=np.float32)

    def _exact(self, rough: np.ndarray, low: float, at: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        left = np.flatnonzero(rough >= max(low - 2 * ERROR, 1e-30))
        if len(left) > k:
            left = left[rough[left] >= np.partition(rough[left], -k)[-k] - 2 * ERROR]
        if not len(left):
            return np.zeros(0), left
        self.query[at] = w
        n = self.rows[left + 1] - self.rows[left]
        starts = np.cumsum(n) - n
        read = np.repeat(self.rows[left] - starts, n) + np.arange(n.sum())
        sims = np.round(np.add.reduceat(self.query[self.at[read]] * self.weight[read], starts), 12)
        self.query[at] = 0.0
        left, sims = left[sims > 0], sims[sims > 0]
        best = np.lexsort((self.ids[left], -sims))[:k]
        return sims[best], left[best]

    def vote(self, near: tuple[np.ndarray, np.ndarray]) -> float:
        return vote(zip(near[0].tolist(), self.y[near[1]].tolist(), strict=True), self.prior)


def vote(near: Iterable[tuple[float, float]], prior: float) -> float:
    """The share of toxic ones among (similarity, label) of neighbours, by squared similarity and against the prior."""
    bad, total = 0.5 * prior, 0.5
    for s, y in near:
        bad, total = bad + s * s * y, total + s * s
    return float(bad / total)


def words_of(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def word_bag(words: Counter, numbers: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of the words that ``numbers`` holds."""
    found = words.keys() & numbers.keys()
    return np.fromiter(map(numbers.__getitem__, found), dtype=np.int64, count=len(found)), np.fromiter(map(words.__getitem__, found), dtype=float, count=len(found))


class Model:
    """What is sent to the workers; each builds the indexes of the packed examples once. ``none`` is the vote of a text
    without a learned term."""

    def __init__(self, terms: dict[str, int], marks: tuple[np.ndarray, ...], examples: tuple[np.ndarray, ...], prior: float, none: float):
        self.terms, self.prior, self.none = Terms(terms), prior, none
        self.packed = [[(zlib.compress(x.tobytes(), 1), x.dtype.str) for x in arrays] for arrays in (marks, examples)]

    def _index(self, k: int) -> Index:
        return Index(*(np.frombuffer(zlib.decompress(x), dtype=kind) for x, kind in self.packed[k]), self.prior)

    @cached_property
    def marks(self) -> Index:
        return self._index(0)

    @cached_property
    def index(self) -> Index:
        return self._index(1)

    def judge(self, texts: list[str | None], words: dict[str, int], skip: list[int] | None = None) -> Iterator[tuple[float, float, np.ndarray, np.ndarray]]:
        """The votes of the learned terms and of the words, and the nearest examples by words, of each text; ``skip`` has
        the id of an example to leave out for each."""
        for a in range(0, len(texts), TOGETHER):
            found = [words_of(t) for t in texts[a : a + TOGETHER]]
            left = None if skip is None else skip[a : a + TOGETHER]
            terms = [bag(w, self.terms) for w in found]
            marked = [k for k, t in enumerate(terms) if len(t[0])]
            votes = np.full(len(found), self.none)
            near = self.marks.nearest([terms[k] for k in marked], skip=None if left is None else [self.marks.places[left[k]] for k in marked])
            votes[marked] = [self.marks.vote(n) for n in near]
            near = self.index.nearest([word_bag(w, words) for w in found], skip=None if left is None else [self.index.places[i] for i in left])
            for v, (sims, places) in zip(votes.tolist(), near, strict=True):
                yield v, self.index.vote((sims, places)), sims, places


@dataclass
class Scale:
    """Weights of the log odds of the two votes, and a monotone map of their sum to shares."""

    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def __call__(self, a: float, b: float) -> float:
        return float(np.interp(float(sides(a, b) @ self.weights), *self.steps))


def calibrate(votes: np.ndarray, y: np.ndarray, prior: float) -> Scale:
    """By penalised logistic regression, then by pooling adjacent violators; ``votes`` are those of the examples, each
    without itself."""
    if not len(y) or y.min() == y.max():
        return Scale(np.zeros(3), (np.array([0.0]), np.array([prior])))
    x, w, penalty = np.array([sides(a, b) for a, b in votes]), np.zeros(3), np.array([1.0, 1.0, 1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
    pools: list[list[float]] = []
    for v, one in sorted(zip((x @ w).tolist(), y.tolist(), strict=True)):
        pools.append([v, one, 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, s, n = pools.pop()
            pools[-1][1] += s
            pools[-1][2] += n
    return Scale(w, (np.array([p[0] for p in pools]), np.array([(p[1] + prior) / (p[2] + 1) for p in pools])))


def sides(a: float, b: float) -> np.ndarray:
    """The log odds of both votes, and one."""
    p = np.clip(np.array([a, b]), 1e-3, 1 - 1e-3)
    return np.r_[np.log(p / (1 - p)), 1.0]


def word_table(documents: DataFrame, sample: DataFrame) -> tuple[Broadcast, np.ndarray]:
    """Numbers of all words of ``sample``, broadcast, and their idf over all of ``documents``."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[str] = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(_WORD.findall((text or "").lower()))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])

    words = sorted(sample.select("text").mapInArrow(distinct, "word string").distinct().toArrow().column("word").to_pylist())
    sent = documents.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(words)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = sent.value
        df = np.zeros(len(numbers) + 1, dtype=np.int64)  # the last counts the documents
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = numbers.keys() & set(_WORD.findall((text or "").lower()))
                df[np.fromiter(map(numbers.__getitem__, found), dtype=np.int64, count=len(found))] += 1
            df[-1] += batch.num_rows
        yield pa.RecordBatch.from_pylist(counters.packed(df, SLICES, TaskContext.get().partitionId()), schema=pa.schema([("slice", pa.int32()), ("part", pa.int32()), ("blob", pa.binary())]))

    counts = documents.select(F.col("text").cast("string")).mapInArrow(count, counters.SCHEMA)
    df = counters.total(materialize(counts), len(words) + 1, SLICES).astype(float)
    return sent, np.log((1 + df[-1]) / (1 + df[:-1])) + 1


def learn(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[Broadcast, Broadcast, Scale]:
    small_batches(documents.sparkSession)
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    # of equal texts the smallest id stands for all, with the worse of their labels
    sample = materialize(fit_sample(documents, usable, "toxic", fit_rows).groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y")))
    shares = {r["y"]: r["count"] for r in sample.groupBy((F.col("y") > 0.5).alias("y")).count().collect()}
    bad, good = shares.get(True, 0), shares.get(False, 0)
    chosen = choose_terms(sample, bad, good) if bad and good else []
    numbers = {t: k for k, (t, _) in enumerate(chosen)}
    idf = np.log((1 + bad + good) / (1 + np.array([df for _, df in chosen], dtype=float))) + 1
    words, word_idf = word_table(documents, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(numbers)
        for batch in batches:
            found = [words_of(t) for t in batch.column(1).to_pylist()]
            sides = [[bag(w, terms) for w in found], [word_bag(w, words.value) for w in found]]
            arrays = [pa.array([b[k].astype("int32") for b in bags], pa.list_(pa.int32())) for bags in sides for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *arrays], names=["doc_id", "y", "term", "term_count", "word", "word_count"])

    rows = sample.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y double, term array<int>, term_count array<int>, word array<int>, word_count array<int>").toArrow().sort_by("doc_id")
    ids, ys = rows.column("doc_id").to_numpy(), (rows.column("y").to_numpy() > 0.5).astype(float)
    prior = bad / max(bad + good, 1)

    def packed(kind: str, rows: pa.Table, ids: np.ndarray, ys: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, ...]:
        at, count = (rows.column(c).combine_chunks() for c in (kind, f"{kind}_count"))
        return np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False)), at.flatten().to_numpy(), count.flatten().to_numpy(), ys, ids, idf

    has = rows.column("term").combine_chunks().value_lengths().to_numpy(zero_copy_only=False) > 0
    none = (ys[~has].sum() + prior) / ((~has).sum() + 1)
    marks = packed("term", rows.filter(pa.array(has)), ids[has], ys[has], idf)
    sent = documents.sparkSession.sparkContext.broadcast(Model(numbers, marks, packed("word", rows, ids, ys, word_idf), prior, float(none)))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(sent.value.judge(batch.column(1).to_pylist(), words.value, batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "y", "a", "b"])

    got = sample.select("doc_id", "text", "y").mapInArrow(votes, "doc_id long, y double, a double, b double").toArrow().sort_by("doc_id")
    return sent, words, calibrate(np.c_[got.column("a").to_numpy(), got.column("b").to_numpy()], (got.column("y").to_numpy() > 0.5).astype(float), prior)


def score_toxicity(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, nearest (ids), similarity of every row of ``documents``."""
    sent, words, scale = learn(documents, labels, fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = sent.value
            got = [(scale(a, b), model.index.ids[places], sims) for a, b, sims, places in model.judge(batch.column(1).to_pylist(), words.value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.float64()))], names=["doc_id", "score", "nearest", "similarity"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = docs.mapInArrow(run, "doc_id long, score double, nearest array<long>, similarity array<double>")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "nearest", "similarity")
