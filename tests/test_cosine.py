"""Cosine pairs against SQL and brute force, and what they write on the way."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from oracle import available, connect, rows
from pyspark.sql.readwriter import DataFrameWriter

from plumbline.operators import cosine
from plumbline.plans import registry


def _texts(seed=4):
    """Long texts that share their common words, near and exact copies, short and empty ones."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    share = [1 / (k + 3) for k in range(3000)]
    out = []
    for n in [400] * 30 + [60] * 20 + [3, 3, 1, 1]:
        base = r.choices(words, share, k=n)
        out += [" ".join(w if r.random() > x else r.choice(words) for w in base) for x in r.choice([(0,), (0, 0), (0, 0.05, 0.1, 0.3)])]
    out += ["w1 w2 w3"] * 4 + ["w1 w2 w3 w1 w2 w3", "w7", "w7 w7", "", None, "alone here"]
    r.shuffle(out)
    return out


@pytest.mark.skipif(not available(), reason="no test tables here")
@pytest.mark.parametrize("again", [0, 5])
def test_query_equals_sql_and_writes_no_row_for_a_token_or_a_candidate(spark, tmp_path, monkeypatch, again):
    texts = _texts()
    ids = [k % (len(texts) - again) for k in range(len(texts))]  # some ids twice
    docs = list(zip(ids, texts, ["en"] * len(ids), ["s"] * len(ids), [0] * len(ids), strict=True))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = connect()
    con.execute(f"create or replace view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["semantic_duplicate_pairs"]).df()
    monkeypatch.setattr(cosine, "TILE", 6)
    monkeypatch.setattr(cosine, "TASK", 2000)
    counts, write = [], DataFrameWriter.parquet

    def counted(self, path, *args, **more):
        write(self, path, *args, **more)
        counts.append(spark.read.parquet(path).count())

    monkeypatch.setattr(DataFrameWriter, "parquet", counted)
    got = registry.queries()["semantic_duplicate_pairs"](spark, str(tmp_path)).toPandas()
    assert len(want) > 40 and rows(got) == rows(want)
    assert max(counts) <= len(texts)


def test_sketches_bound_the_product():
    r = np.random.default_rng(1)
    sides = []
    for _ in range(2):
        n = r.integers(1, 300, 40)
        row, token = np.repeat(np.arange(40), n), np.concatenate([r.choice(5000, k, replace=False) for k in n]).astype(np.int32)
        weight = r.random(len(row))
        weight /= np.sqrt(np.bincount(row, weight * weight))[row]
        whole = np.zeros((40, 5000))
        whole[row, token] = weight
        sides.append((SimpleNamespace(row=row, token=token, weight=weight, n=n, _sketches={}), whole))
    (x, a), (y, b) = sides
    for width in (128, 1024):
        assert (cosine._Tile.sketch(x, width) @ cosine._Tile.sketch(y, width).T >= a @ b.T - cosine.SLACK).all()


def test_members_are_written_in_parts(monkeypatch):
    monkeypatch.setattr(cosine, "AT_ONCE", 4)
    x = SimpleNamespace(members=pa.array([9, 4, 7, 1, 2]), size=np.array([3, 2]), first=np.array([0, 3]))
    p, q = np.array([0, 1, 0]), np.array([0, 1, 1])
    got = [r for b in cosine._written(x, x, p, q, np.array([1.0, 1.0, 0.9])) for r in b.to_pylist()]
    assert sorted((r["a"], r["b"], r["cosine"]) for r in got) == sorted([(4, 9, 1.0), (7, 9, 1.0), (4, 7, 1.0), (1, 2, 1.0)] + [(a, b, 0.9) for a in (1, 2) for b in (4, 7, 9)])


def test_other_ids_and_weights_below_zero(spark):
    r = random.Random(2)
    own = {}
    for k in range(60):
        base = own[f"i{r.randrange(k)}"] if k and r.random() < 0.4 else {f"t{r.randrange(200)}": r.choice([-1, 1]) * r.random() for _ in range(r.choice([1, 4, 30]))}
        v = {t: w * r.uniform(0.8, 1.2) for t, w in base.items()}
        own[f"i{k}"] = {t: w / sum(x * x for x in v.values()) ** 0.5 for t, w in v.items()}
    dots = {(i, j): sum(w * y.get(t, 0.0) for t, w in x.items()) for i, x in own.items() for j, y in own.items() if i < j}
    df = spark.createDataFrame([(i, t, w) for i, v in own.items() for t, w in v.items()], "item_id string, token string, weight double")
    got = {(x["a"], x["b"]): x["cosine"] for x in cosine.cosine_pairs(df, 0.85).collect()}
    assert len(got) > 10 and got.keys() == {k for k, d in dots.items() if d >= 0.85} and all(abs(dots[k] - d) < 1e-9 for k, d in got.items())


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, []), (3, None)], "item_id long, t array<string>")
    assert cosine.tfidf_pairs(df, "t", 0.85).collect() == []
