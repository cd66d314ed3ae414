"""Cases worked out by hand, and invariants."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions.ranks import average_rank
from plumbline.functions.stats import adjusted, kendall, roc_auc, spearman
from plumbline.operators import agreement, forensics, matrix, psychometrics, rankings, resampling
from plumbline.operators.graph import clusters
from plumbline.sources import archives, readers
from plumbline.streaming.ingest import running_accuracy


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()[0]


def test_tied_leaders_share_the_mean_place(spark):
    df = spark.createDataFrame([("a", 0.9), ("b", 0.9), ("c", 0.1)], "m string, s double")
    assert {r["m"]: r["r"] for r in df.withColumn("r", average_rank("s", [])).collect()} == {"a": 1.5, "b": 1.5, "c": 3.0}


def test_spearman_and_kendall(spark):
    df = spark.createDataFrame([(1, 1.0, 10.0, 30.0), (2, 2.0, 20.0, 20.0), (3, 3.0, 30.0, 10.0)], "k int, x double, y double, z double").withColumn("g", F.lit(1))
    assert spearman(df, "x", "y", ["g"]).first()["spearman"] == pytest.approx(1)
    assert spearman(df, "x", "z", ["g"]).first()["spearman"] == pytest.approx(-1)
    assert kendall(df, "x", "z", "k", ["g"]).first()["tau_b"] == pytest.approx(-1)


def test_kappa_of_two_raters(spark):
    a, b = ["y", "y", "n", "n"], ["y", "y", "n", "y"]
    rows = [(i, r, lab) for r, labels in (("a", a), ("b", b)) for i, lab in enumerate(labels)]
    df = spark.createDataFrame(rows, "task_id int, annotator string, label string")
    assert agreement.cohen(df).first()["kappa"] == pytest.approx(0.5)
    assert agreement.raw_agreement(df).first()["agreement"] == pytest.approx(0.75)


def test_concordance_of_equal_rankings_is_one(spark):
    rows = [(f"m{m}", str(s), f"{s}-{i}", float(i < m)) for m in range(4) for s in range(3) for i in range(4)]
    df = spark.createDataFrame(rows, "model_id string, subject string, item_id string, score double")
    assert rankings.kendalls_w(df).first()["w"] == pytest.approx(1)


def test_permutation_keeps_totals(spark):
    rows = [(f"m{m}", "s", str(i), float((i * 7 + m) % 3 == 0)) for m in range(4) for i in range(12)]
    df = spark.createDataFrame(rows, "model_id string, subject string, item_id string, score double")
    want = {r["model_id"]: r["t"] for r in df.groupBy("model_id").agg(F.sum("score").alias("t")).collect()}
    null = resampling.permuted_null(df, 5, 1).groupBy("replicate", "model_id").agg(F.sum("score").alias("t")).collect()
    assert len(null) == 20 and all(r["t"] == want[r["model_id"]] for r in null)


def test_bootstrap_draws_as_many_as_there_are(spark):
    df = spark.createDataFrame([(str(i),) for i in range(17)], "item_id string")
    total = resampling.weights(df, "item_id", 6, 3).groupBy("replicate").agg(F.sum("weight").alias("t")).collect()
    assert [r["t"] for r in total] == [17] * 6


def test_auc_with_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.3)], "y int, score double").withColumn("g", F.lit(1))
    assert roc_auc(df, "y", "score", ["g"]).first()["auc"] is None


def test_adjusted_p_values_by_hand(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "key int, p double")
    got = {r["key"]: r for r in adjusted(df, "p", "key").collect()}
    assert got[1]["holm"] == pytest.approx(0.03) and got[2]["holm"] == pytest.approx(0.06) and got[3]["holm"] == pytest.approx(0.06)
    assert got[1]["bh"] == pytest.approx(0.03) and got[3]["bh"] == pytest.approx(0.04)


@pytest.mark.parametrize(("text", "want"), [("B", "B"), ("(c)", "C"), ("The answer is D.", "D"), ("I cannot answer", None), ("", None), ("A) because", "A")])
def test_extracted_answers(spark, text, want):
    assert one(spark, text, X.extracted) == want


def test_numbers_and_fractions(spark):
    assert float(one(spark, "so 1,200 in all #### 1,234", X.number)) == 1234
    assert one(spark, "2/4", X.fraction_key) == one(spark, "0.5", X.fraction_key)


def test_template_order(spark):
    assert one(spark, 'Say "hello" 3 times', X.template).count("<num>") == 1


def test_strict_matrix_refuses_repeats(spark):
    df = spark.createDataFrame([("m", "s", "i", True), ("m", "s", "i", None)], "model_id string, subject string, item_id string, correct boolean")
    with pytest.raises(ValueError, match="repeated"):
        matrix.build_strict(df)


def test_components(spark):
    df = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7)], "a long, b long")
    assert {r["id"]: r["cluster"] for r in clusters(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}


def test_longest_common_substring():
    assert forensics.longest_common_substring("abcdef", "zcdexf") == 3
    assert forensics.longest_common_substring("", "a") == 0


def test_rasch_recovers_order(spark):
    panel = psychometrics.simulate(12, 60, 5, spark)
    got = {r["id"]: r["value"] for r in psychometrics.rasch(panel).where("kind = 'ability'").collect()}
    x = np.array([got[str(i)] for i in range(12)])
    assert np.corrcoef(x, np.arange(12))[0, 1] > 0.9
    hard = [r["value"] for r in psychometrics.rasch(panel).where("kind = 'difficulty'").collect()]
    assert abs(sum(hard)) < 1e-6


def test_import_by_aliases_and_all_or_nothing(spark, tmp_path):
    good = [{"model": "m1", "question_id": "q1", "task": "bio", "pred": "A", "target": "A"}, {"model": "m1", "question_id": "q2", "task": "bio", "pred": "B", "target": "C"}]
    p = tmp_path / "a.jsonl"
    p.write_text("\n".join(map(json.dumps, good)))
    rows = {r["item_id"]: r["correct"] for r in readers.import_predictions(spark, str(p)).collect()}
    assert rows == {"q1": True, "q2": False}
    p2 = tmp_path / "b.jsonl"
    p2.write_text("\n".join(map(json.dumps, [*good, good[0]])))
    with pytest.raises(ValueError, match="repeated key"):
        readers.import_predictions(spark, str(p2))


def test_option_scores(spark):
    df = spark.createDataFrame([([-3.0, -1.0, 0.0],)], "s array<double>")
    assert df.select(readers.best_option(F.col("s"))).first()[0] == "B"


def test_wide_matrix_round_trip(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("model_id,bio::q1,bio::q2\nm1,1,0\nm2,x,1\n")
    got = {(r["model_id"], r["subject"], r["item_id"]): r["score"] for r in readers.load_matrix(spark, str(p)).collect()}
    assert got == {("m1", "bio", "q1"): 1.0, ("m1", "bio", "q2"): 0.0, ("m2", "bio", "q1"): None, ("m2", "bio", "q2"): 1.0}


def test_unsafe_archives(tmp_path):
    p = str(tmp_path / "x.zip")
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("../evil", "x")
        z.writestr("inner.zip", "x")
    assert len(archives.unsafe_members(p)) == 2
    with pytest.raises(ValueError, match="leaves"):
        archives.unpack(p, str(tmp_path / "out"))
    q, r = str(tmp_path / "q.zip"), str(tmp_path / "r.zip")
    for name in (q, r):
        archives.pack({"b": b"2", "a": b"1"}, name)
    assert open(q, "rb").read() == open(r, "rb").read()


def test_stream_counts_repeats_once(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "m", "e1", 1.0), ("2024-01-01 00:20:00", "m", "e1", 1.0), ("2024-01-01 00:30:00", "m", "e2", 0.0), ("2024-01-02 00:00:00", "m", "e3", 1.0)]
    df = spark.createDataFrame(rows, "ts string, model_id string, item_id string, score double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = running_accuracy(stream, key=["item_id"]).writeStream.outputMode("append").format("memory").queryName("ra").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["n"], r["accuracy"]) for r in spark.sql("select * from ra order by window_start").collect()][:1] == [(2, 0.5)]


def test_plugins():
    @psychometrics.register("scorer", "exact")
    def f(c):
        return c

    assert psychometrics.plugin("scorer", "exact") is f and ("scorer", "exact") in psychometrics.plugins("scorer")
    with pytest.raises(ValueError):
        psychometrics.register("nothing", "x")


def test_shingles_of_many_items_count_and_no_copy_is_lost(spark):
    common = " ".join(f"c{i}" for i in range(12))
    texts = [f"{common} x{i} y{i}" for i in range(510)] + [f"same words in {' '.join(f'z{k}' for k in range(9))}"] * 25
    d = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    sets = [{tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for t in texts]
    for least in (0.7, 0.8):
        want = {(a, b) for a, s in enumerate(sets) for b, t in enumerate(sets) if len(s & t) >= least * len(s | t)}
        got = forensics.shingle_candidates(d, d, least).collect()
        assert len(got) == len(want) and {(r["left_id"], r["right_id"]) for r in got} == want


def test_minhash_pairs_of_all_items(spark):
    h = {5: ["a", "b", "c", "d"], 40: ["a", "x", "c", "y"], 41: ["a", "b", "c", "d"], 900: ["q", "r", "s", "t"]}
    d = spark.createDataFrame(list(h.items()), "item_id long, h array<string>")
    got = {(r["a"], r["b"]): r["similarity"] for r in forensics.minhash_pairs(d, "h").collect()}
    assert got == {(5, 40): 0.5, (5, 41): 1.0, (40, 41): 0.5}


def test_correlation_without_variance_is_null(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (2, None, 1.0)], "g int, x double, y double")
    from plumbline.functions.stats import pearson

    assert [r["r"] for r in df.groupBy("g").agg(pearson("x", "y").alias("r")).collect()] == [None, None]


@pytest.mark.parametrize("parts", [1, 200])
def test_ties_do_not_depend_on_the_order_of_sums(spark, parts):
    import random

    rng, scores = random.Random(1), [0.1, 0.2, 0.3, 0.7, 0.9, 1e-3]
    rows = [(m, "s", str(i), x) for m in ("a", "b", "c") for i, x in enumerate(rng.sample(scores, 6))]
    df = spark.createDataFrame(rows, "model_id string, subject string, item_id string, score double").repartition(parts)
    assert {r["rank_average"] for r in rankings.subject_ranks(df).collect()} == {2.0}
    assert {r["rank_range"] for r in rankings.subject_instability(df).collect()} == {0}


def test_constant_items_do_not_fail(spark):
    from plumbline.operators import diagnostics

    rows = [(f"m{m}", "s", f"i{i}", 1.0 if i == 0 else float(m > i)) for m in range(6) for i in range(8)]
    got = {r["item_id"]: r for r in diagnostics.irt_items(spark.createDataFrame(rows, "model_id string, subject string, item_id string, score double")).collect()}
    assert got["i0"]["discrimination"] == 0 and got["i0"]["label"] == "unstable_estimate" and got["i2"]["label"] == "positive_discrimination"


@pytest.mark.parametrize(
    "text, value",
    [("#### 1,200", 1200), ("so 3 and 4", None), ("it is 7, yes 7.0", 7), (r"1 2 \boxed{5}", 5), ("The answer is 3/6\nor 9", 0.5), ("Therefore 12 eggs", 12), ("", None), ("none", None), ("I cannot answer 5", None), ("-2e3", -2000)],
)
def test_stated_numbers(spark, text, value):
    got = one(spark, text, X.number)
    assert got is None if value is None else float(got) == value


def test_leak_texts_decode_before_they_are_made_compatible(spark):
    assert one(spark, "&#65313;\u2019s <b>X</b>\\quad y &lt;i&gt; \ufb01", forensics.normalize_leak_text) == "a's x y fi"
    assert one(spark, "(B) Stra\u00dfe", lambda c: forensics.normalize_leak_text(c, True)) == "strasse"


def test_templates_follow_their_order(spark):
    assert one(spark, "What is 'the  Name' of 12 cats?", X.template) == "<word> is <<word>> of <num> <word>?"


def test_containment_beyond_whole_tokens(spark):
    corpus = spark.createDataFrame([(1, "xxabc defg hijkl"), (2, "abc defg hi"), (3, "zz"), (4, "abc")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "abc defg hi"), (2, "z"), (3, "q r s")], "item_id long, text string")
    assert sorted(map(tuple, forensics.containing(items, corpus).collect())) == [(1, 1), (1, 2), (2, 3)]
