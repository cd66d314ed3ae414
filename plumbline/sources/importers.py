"""Importers of other tools' outputs, published details, item files, registries and blinded labels. All are plans over what
``readers.read_any`` gives; a batch with a broken row raises before anything is written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import truthy
from plumbline.operators.integrity import ANSWER_KEYS, choice_items
from plumbline.sources import readers

# The tools whose outputs are read, and their names for fields in the order of precedence.
ADAPTERS = ("generic-jsonl", "generic-csv", "lm-evaluation-harness", "helm", "huggingface", "openai-evals", "inspect-ai", "opencompass", "lighteval", "ragas", "deepeval")
OUTPUT_ALIASES = {
    "model_id": ("model_id", "model", "model_name", "system", "generator", "eval_model", "run_name"),
    "item_id": ("item_id", "doc_id", "sample_id", "example_id", "task_id", "input_id", "id"),
    "prediction": ("prediction", "pred", "output", "completion", "filtered_resps", "response", "answer", "model_output", "generation"),
    "score": ("score", "acc", "accuracy", "exact_match", "is_correct", "correct", "metric"),
    "raw_output": ("raw_output", "raw", "full_output", "completion", "output", "response", "generation"),
    "prompt_variant": ("prompt_variant", "variant", "prompt_name", "split"),
}
WRAPPERS = ("predictions", "outputs", "samples", "records", "results", "logs")
NESTED_SCORES = ("score", "acc", "exact_match", "value")


def _text(df: DataFrame, path: str, kind: T.DataType) -> Column:
    """A field as text: of a list its first element, of a struct the score in it, else nothing."""
    c = F.col(path)
    if isinstance(kind, T.ArrayType):
        return F.get(c, F.lit(0)).cast("string")
    if isinstance(kind, T.StructType):
        named = [n for n in NESTED_SCORES if n in kind.fieldNames()]
        return F.coalesce(*[c[n].cast("string") for n in named]) if named else F.to_json(c)
    return c.cast("string")


def field(df: DataFrame, name: str) -> Column:
    """The first field of a row that has one of the names; then the same within its metadata."""
    found = [_text(df, f"`{a}`", df.schema[a].dataType) for a in OUTPUT_ALIASES[name] if a in df.columns]
    if "metadata" in df.columns and isinstance(df.schema["metadata"].dataType, T.StructType):
        inner = df.schema["metadata"].dataType
        found += [_text(df, f"metadata.`{a}`", inner[a].dataType) for a in OUTPUT_ALIASES[name] if a in inner.fieldNames()]
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in found]) if found else F.lit(None).cast("string")


def unwrapped(df: DataFrame) -> DataFrame:
    """The records of an object that holds them under one of the known names."""
    for name in WRAPPERS:
        if name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType) and isinstance(df.schema[name].dataType.elementType, T.StructType):
            return df.select(F.explode(name).alias("r")).select("r.*")
    return df


def import_outputs(spark: SparkSession, path: str, adapter: str = "generic-jsonl", benchmark: str = "imported", variant: str = "full", require_scores: bool = True) -> DataFrame:
    """benchmark_id, model_id, item_id, prompt_variant, prediction, raw_output, score, is_correct of a tool's output file.
    Rows without a score are an error unless allowed; then the score is 0 and correctness unknown."""
    if adapter not in ADAPTERS:
        raise ValueError(f"unknown adapter {adapter!r}; known: {', '.join(ADAPTERS)}")
    df = unwrapped(readers.read_any(spark, path, "csv" if adapter == "generic-csv" else None))
    said, model = field(df, "score"), field(df, "model_id")
    score = F.coalesce(said.try_cast("double"), truthy(said).cast("double"))
    rows = df.select(
        F.lit(benchmark).alias("benchmark_id"), F.coalesce(model, F.lit("model")).alias("model_id"), F.coalesce(field(df, "item_id"), F.concat(F.lit("item_"), (F.monotonically_increasing_id() + 1).cast("string"))).alias("item_id"),
        F.coalesce(field(df, "prompt_variant"), F.lit(variant)).alias("prompt_variant"), F.coalesce(field(df, "prediction"), F.lit("")).alias("prediction"), F.coalesce(field(df, "raw_output"), field(df, "prediction"), F.lit("")).alias("raw_output"), score.alias("score"),
    )
    if require_scores and (missing := rows.where("score is null").count()):
        raise ValueError(f"{missing} records without a score")
    return rows.withColumn("is_correct", F.when(F.col("score").isin(0.0, 1.0), F.col("score") >= 1)).withColumn("score", F.coalesce("score", F.lit(0.0)))


def flatten_nested(df: DataFrame) -> DataFrame:
    """Records of a request state: fields of ``instance``, ``request`` and ``result`` lifted under their prefix; id, references
    and input of the instance become item_id, gold and prompt, the first completion's text the prediction."""
    out = df
    for part in ("instance", "request", "result"):
        if part in df.columns and isinstance(df.schema[part].dataType, T.StructType):
            out = out.withColumns({f"{part}_{n}": F.col(f"{part}.`{n}`") for n in df.schema[part].dataType.fieldNames()})
    lifted = {"item_id": "instance_id", "gold": "instance_references", "prompt": "instance_input"}
    out = out.withColumns({new: F.col(old) for new, old in lifted.items() if old in out.columns and new not in out.columns})
    if "result_completions" in out.columns and "prediction" not in out.columns:
        first = F.get(F.col("result_completions"), F.lit(0))
        kind = out.schema["result_completions"].dataType.elementType
        out = out.withColumn("prediction", first["text"] if isinstance(kind, T.StructType) and "text" in kind.fieldNames() else first.cast("string"))
    return out.drop("instance", "request", "result")


def import_published(spark: SparkSession, path: str, form: str, include_text: bool = False) -> DataFrame:
    """Rows of published details: harness samples, nested JSON (one document or lines), leaderboard CSV or lines."""
    if form == "harness":
        return readers.read_harness_samples(spark, path)
    if form in ("nested_json", "nested_jsonl"):
        rows = readers.normalize(flatten_nested(readers.read_any(spark, path, "json" if form == "nested_json" else "jsonl")), include_text)
    elif form in ("leaderboard_csv", "leaderboard_jsonl"):
        rows = readers.normalize(readers.read_any(spark, path, form.rsplit("_", 1)[1]), include_text)
    else:
        raise ValueError(f"unknown form {form!r}")
    if bad := readers.problems(rows):
        raise ValueError("; ".join(f"{k}: {n}" for k, n in sorted(bad.items())))
    return rows


def import_known_issues(spark: SparkSession, path: str) -> DataFrame:
    """Issues checked against the known types; unknown types stay, marked, and repeats of (subset, item, type) are counted."""
    rows = readers.import_issues(spark, path, readers.ISSUE_TYPES)
    n = rows.groupBy("subset", "item_id", "issue_type").agg(F.count("*").alias("repeats"))
    return rows.join(n, ["subset", "item_id", "issue_type"]) if not rows.where("subset is null").limit(1).count() else rows.fillna("default", ["subset"]).join(n.fillna("default", ["subset"]), ["subset", "item_id", "issue_type"])


def load_choice_items(spark: SparkSession, path: str, randomized: bool = False) -> DataFrame:
    """item_id, question, choices (A-D, as map), answer of a four-option file; any broken rule of ``choice_items`` raises.
    With ``randomized`` the options are dealt anew by a hash of item and option, and the answer moves along."""
    df = readers.read_any(spark, path)
    kind = df.schema["choices"].dataType
    pairs = [e for n in kind.fieldNames() for e in (F.lit(n), F.col(f"choices.`{n}`"))] if isinstance(kind, T.StructType) else None
    meta = df.schema["metadata"].dataType if "metadata" in df.columns else None
    keys = meta.fieldNames() if isinstance(meta, T.StructType) else []
    rows = df.select("item_id", "question", (F.create_map(*pairs) if pairs else F.col("choices")).alias("choices"), "answer", (F.create_map(*[e for k in keys for e in (F.lit(k), F.lit(""))]) if keys else F.create_map().cast("map<string,string>")).alias("metadata"))
    rows = rows.withColumn("choices", F.map_filter("choices", lambda k, v: v.isNotNull()))
    if bad := [r["check"] for r in choice_items(rows).where("not passed").collect()]:
        raise ValueError(f"broken items: {', '.join(sorted(bad))}")
    rows = rows.drop("metadata")
    if not randomized:
        return rows
    dealt = F.array_sort(F.transform(F.map_entries("choices"), lambda e: F.struct(F.md5(F.concat_ws("|", F.col("item_id").cast("string"), e["key"])).alias("h"), e["key"].alias("k"), e["value"].alias("v"))))
    rows = rows.withColumn("_d", dealt)
    at = F.array_position(F.transform("_d", lambda e: e["k"]), F.col("answer")).cast("int")
    return rows.select("item_id", "question", F.map_from_arrays(F.array(*map(F.lit, "ABCD")), F.transform("_d", lambda e: e["v"])).alias("choices"), F.element_at(F.array(*map(F.lit, "ABCD")), at).alias("answer"))


def load_items(spark: SparkSession, path: str) -> DataFrame:
    """item_id, prompt, answers (always a list), choices, construct_tags of an item file; fields that it lacks are null."""
    df = readers.read_any(spark, path)
    get = lambda *names: next((F.col(f"`{n}`") for n in names if n in df.columns), None)
    answer = get("answers", "answer")
    many = answer is not None and isinstance(df.select(answer).schema[0].dataType, T.ArrayType)
    none = F.lit(None).cast("array<string>")
    return df.select(get("item_id", "id").cast("string").alias("item_id"), get("prompt", "question").alias("prompt"), (none if answer is None else answer if many else F.array(answer)).alias("answers"), *[none.alias(c) if get(c) is None else get(c).alias(c) for c in ("choices", "construct_tags")])


def load_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """A criterion or intervention file (JSON list, records or lines) with its numbers as doubles."""
    df = unwrapped(readers.read_any(spark, path))
    return df.select(*[F.col(c).cast("double").alias(c) if isinstance(df.schema[c].dataType, T.NumericType) else F.col(c) for c in df.columns])


_LOADERS: dict[str, Callable[[SparkSession], DataFrame]] = {}


def register_benchmark(name: str, loader: Callable[[SparkSession], DataFrame]) -> None:
    if name in _LOADERS:
        raise ValueError(f"benchmark {name!r} is registered already")
    _LOADERS[name] = loader


def get_benchmark(spark: SparkSession, name: str) -> DataFrame:
    """The items of a registered benchmark."""
    if name not in _LOADERS:
        raise KeyError(f"unknown benchmark {name!r}; known: {', '.join(sorted(_LOADERS))}")
    return _LOADERS[name](spark)


def frozen_items(items: DataFrame, manifest: DataFrame, text: str = "prompt") -> DataFrame:
    """The items that a manifest (item_id, digest) names; a missing item or one whose text has another SHA-256 raises."""
    j = manifest.join(items, "item_id", "left").withColumn("_same", F.sha2(F.col(text), 256) == F.col("digest"))
    if bad := j.where(~F.coalesce(F.col("_same"), F.lit(False))).count():
        raise ValueError(f"{bad} items are missing or changed")
    return j.drop("_same", "digest")


def import_blinded_labels(labels: DataFrame, packet: DataFrame, key: DataFrame, least: float = 0.8, annotators: int = 2) -> DataFrame:
    """item_id, annotator, label of a blinded packet's labels (blinded_id, annotator, label). Unknown or repeated rows, fewer
    than ``annotators`` on an item, or an annotator who misses too many controls block the whole batch."""
    from plumbline.operators.sampling import control_match

    problems = {
        "unknown blinded ids": labels.join(packet, "blinded_id", "left_anti").count(), "missing labels": labels.where("label is null or annotator is null").count(),
        "repeated rows": labels.groupBy("blinded_id", "annotator").count().where("count > 1").count(),
        "items of too few annotators": packet.join(labels.groupBy("blinded_id").agg(F.count_distinct("annotator").alias("n")), "blinded_id", "left").where(F.coalesce("n", F.lit(0)) < annotators).count(),
        "annotators below the control match": control_match(labels, key, least).where("not accepted").count(),
    }
    if bad := [f"{k}: {n}" for k, n in problems.items() if n]:
        raise ValueError("; ".join(bad))
    return labels.join(key.where("expected is null").select("blinded_id", "item_id"), "blinded_id").select("item_id", "annotator", "label")


def answer_keys(names: list[str]) -> list[str]:
    """Those of the names under which an item would tell its answer."""
    return [n for n in names if n.lower() in ANSWER_KEYS]


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """One CSV file of the named columns in this order: for report tables, not facts."""
    df.select(*columns).coalesce(1).write.csv(path, header=True)


def save_matrix(matrix: DataFrame, path: str) -> None:
    """The long matrix as Parquet, models together."""
    matrix.repartition("model_id").sortWithinPartitions("model_id", "item_id").write.parquet(path)
