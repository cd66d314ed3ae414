"""The registered queries against SQL on the smallest tables, and the pipeline stage by stage."""

import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("~" if str(v) in ("None", "<NA>", "nan") else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", ["op5_line_dedup", "op8_url_filter", "op10_sharding"])
def test_same_rows_as_sql(spark, name):
    from plumbline.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, DATA).toPandas()) == rows(con.execute(queries.SQL[name]).df())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, seen = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        seen.append(out.select("doc_id").distinct().count())
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    assert seen == sorted(seen, reverse=True) and seen[-1] == seen[-2] > 100
    assert corpus_pipeline.run(spark, DATA).count() == docs.count()


def odd(spark, rows=3):
    """Nulls everywhere, repeats, an empty and a long text, and columns with names that operators use inside."""
    names = ["row", "host", "path", "evidence", "keep", "site", "lines", "kept", "component_id", "n", "coverage", "piece", "my col"]
    texts = ["one good line of plain words\nand another one", None, "", "w " * 30_000, "one good line of plain words\nand another one"]
    data = [(i if i != 1 else None, t, None if i == 2 else "en", None if i == 3 else "s", None if i == 0 else len(t or ""), *names) for i, t in enumerate(texts)] * (1 if rows else 0)
    return spark.createDataFrame(data + data[:1], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))


def test_stages_take_odd_tables(spark):
    import corpus_pipeline

    docs = odd(spark)
    for docs_in in (docs, odd(spark, 0).limit(0)):
        empty = docs_in is not docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs_in, DATA)
            if name == "packing":
                assert out.count() == (0 if empty else docs_in.count() + out.where("piece > 0").count())
            else:
                assert out.columns == docs_in.columns
                got = out.collect()
                assert len(got) <= docs_in.count() and all(r["my col"] == "my col" and r["keep"] == "keep" for r in got)
                if not empty and name == "near_duplicates":
                    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in got) == [-1, 0, 0, 2, 3]


def test_pipeline_like_plain_stages(spark):
    """Every row of the whole pipeline, with the stages done again on collected rows, by plain versions where there are any."""
    import collections

    import corpus_pipeline
    from plumbline.llm import quality

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r["doc_id"] for r in quality.classify(docs, spark.read.parquet(f"{DATA}/labels.parquet")).where("keep").collect()}
    rows = [r for r in docs.collect() if r["doc_id"] in kept]
    pages, holds = collections.defaultdict(set), collections.defaultdict(set)
    key = lambda line: line.replace("\t", " ").replace("\r", " ").strip(" ")
    for r in rows:
        pages[r["source"]].add(r["text"])
    for s, texts in pages.items():
        for t in texts:
            for line in {key(x) for x in t.split("\n")} - {""}:
                holds[s, line].add(t)
    gone = {k for k, v in holds.items() if len(v) > 1 and len(v) - 1 > 0.075 * (len(pages[k[0]]) - 1)}
    texts = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if (r["source"], key(x)) not in gone) for r in rows}

    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    left = [i for i in ids if find(i) == i]
    from test_operators import brute_contamination

    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    five = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.lower().split() for _, t in bench)]
    near = [i for i in left if any(len(set(zip(*[texts[i].lower().split()[k:] for k in range(5)])) & f) >= 1 for f in five)]
    found = {near[d] for d, _ in brute_contamination([texts[i] for i in near], bench)}
    got = corpus_pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == set(left) - found
