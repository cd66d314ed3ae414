"""Importers on small files: aliases, nesting, all-or-nothing batches."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import sampling
from plumbline.sources import importers


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


@pytest.mark.parametrize("adapter", importers.ADAPTERS)
def test_outputs_of_every_tool(spark, tmp_path, adapter):
    if adapter == "generic-csv":
        (tmp_path / "o.csv").write_text("model,id,output,acc\nm,1,B,true\nm,2,C,0.5\n")
        path = str(tmp_path / "o.csv")
    else:
        path = lines(tmp_path / "o.jsonl", [{"model": "m", "id": 1, "output": "B", "acc": 1.0}, {"model": "m", "id": 2, "output": "C", "acc": 0.5}])
    got = {r["item_id"]: r for r in importers.import_outputs(spark, path, adapter).collect()}
    assert (got["1"]["score"], got["1"]["is_correct"], got["2"]["score"], got["2"]["is_correct"]) == (1.0, True, 0.5, None)
    assert got["1"]["prediction"] == got["1"]["raw_output"] == "B" and got["1"]["prompt_variant"] == "full"


def test_outputs_without_scores_block_or_count_as_unknown(spark, tmp_path):
    path = lines(tmp_path / "o.jsonl", [{"model": "m", "id": "1", "metadata": {"variant": "x"}, "pred": ["A", "B"]}, {"model": "m", "id": "2", "pred": ["C"], "score": {"acc": 1}}])
    with pytest.raises(ValueError, match="1 records without a score"):
        importers.import_outputs(spark, path)
    got = {r["item_id"]: r for r in importers.import_outputs(spark, path, require_scores=False).collect()}
    assert (got["1"]["score"], got["1"]["is_correct"], got["1"]["prediction"], got["1"]["prompt_variant"]) == (0.0, None, "A", "x") and got["2"]["is_correct"] is True
    with pytest.raises(ValueError, match="unknown adapter"):
        importers.import_outputs(spark, path, "other")


def test_nested_details(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"request_states": [{"model": "m", "instance": {"id": "i1", "references": "B"}, "request": {"temperature": 0}, "result": {"completions": [{"text": " b"}]}}]}))
    row = importers.import_published(spark, str(tmp_path / "h.json"), "nested_json").first()
    assert (row["model_id"], row["item_id"], row["prediction"], row["gold"], row["correct"]) == ("m", "i1", "b", "B", True)
    path = lines(tmp_path / "l.jsonl", [{"model": "m", "item_id": "1", "pred": "A", "target": "A"}, {"model": "m", "item_id": "1", "pred": "B", "target": "A"}])
    with pytest.raises(ValueError, match="repeated key"):
        importers.import_published(spark, path, "leaderboard_jsonl")
    with pytest.raises(ValueError, match="unknown form"):
        importers.import_published(spark, path, "other")


def test_known_issues_keep_unknown_types(spark, tmp_path):
    path = lines(tmp_path / "g.jsonl", [{"subset": "s", "id": "1", "flaw_type": "ambiguous"}, {"subset": "s", "id": "1", "flaw_type": "ambiguous"}, {"subset": "s", "id": "2", "flaw_type": "odd"}])
    got = sorted((r["item_id"], r["unknown_type"], r["repeats"]) for r in importers.import_known_issues(spark, path).collect())
    assert got == [("1", False, 2), ("1", False, 2), ("2", True, 1)]


def items(n=3, **change):
    return [{"item_id": f"i{k}", "question": f"q{k}", "choices": {c: f"{c}{k}" for c in "ABCD"}, "answer": "ABCD"[k % 4], "metadata": {"topic": "t"}} | change for k in range(n)]


def test_choice_files(spark, tmp_path):
    path = lines(tmp_path / "a.jsonl", items())
    plain = {r["item_id"]: r for r in importers.load_choice_items(spark, path).collect()}
    mixed = {r["item_id"]: r for r in importers.load_choice_items(spark, path, True).collect()}
    assert all(plain[i]["choices"][plain[i]["answer"]] == mixed[i]["choices"][mixed[i]["answer"]] and sorted(mixed[i]["choices"].values()) == sorted(plain[i]["choices"].values()) for i in plain)
    assert any(plain[i]["choices"] != mixed[i]["choices"] for i in plain)
    for bad, why in ((items(answer="E"), "answer"), (items(metadata={"Gold": "A"}), "answer_not_told"), (items(item_id="same"), "repeated_item_id"), (items(choices={"A": "x", "B": "y"}), "labels")):
        with pytest.raises(ValueError, match=why):
            importers.load_choice_items(spark, lines(tmp_path / f"{why}.jsonl", bad))


def test_items_registry_and_manifest(spark, tmp_path):
    path = lines(tmp_path / "i.jsonl", [{"item_id": "1", "prompt": "p", "answer": "A"}])
    got = importers.load_items(spark, path)
    assert got.first()["answers"] == ["A"] and got.first()["choices"] is None
    importers.register_benchmark("tiny", lambda s: importers.load_items(s, path))
    assert importers.get_benchmark(spark, "tiny").count() == 1
    with pytest.raises(KeyError):
        importers.get_benchmark(spark, "none")
    same = got.select("item_id", F.sha2("prompt", 256).alias("digest"))
    assert importers.frozen_items(got, same).count() == 1
    with pytest.raises(ValueError, match="missing or changed"):
        importers.frozen_items(got, same.withColumn("digest", F.lit("x")))
    assert importers.load_outcomes(spark, lines(tmp_path / "c.jsonl", [{"model_id": "m", "criterion_score": 1}])).first()["criterion_score"] == 1.0
    assert importers.answer_keys(["Gold", "topic"]) == ["Gold"]


def test_blinded_labels_block_the_batch(spark):
    rows = spark.createDataFrame([(f"i{k}", f"t{k}") for k in range(6)], "item_id string, text string")
    packet, key = sampling.blinded_packet(rows, spark.createDataFrame([("i0", "y"), ("i1", "n")], "item_id string, expected string"), 3, 1)
    truth = {r["blinded_id"]: r["expected"] or "y" for r in key.collect()}
    good = spark.createDataFrame([(b, a, v) for b, v in truth.items() for a in ("p", "q")], "blinded_id string, annotator string, label string")
    assert importers.import_blinded_labels(good, packet, key).count() == 6
    for bad, why in ((good.withColumn("label", F.lit("z")), "control match"), (good.where("annotator = 'p'"), "too few"), (good.unionByName(good), "repeated"), (good.withColumn("blinded_id", F.lit("?")), "unknown")):
        with pytest.raises(ValueError, match=why):
            importers.import_blinded_labels(bad, packet, key)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("m", "i", 1.0)], "model_id string, item_id string, score double")
    importers.write_csv(df, str(tmp_path / "c"), ["score", "model_id"])
    importers.save_matrix(df, str(tmp_path / "p"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["score", "model_id"] and spark.read.parquet(str(tmp_path / "p")).count() == 1
