"""Agreement of annotators over (task_id, annotator, label), and reliability of judges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import percentile, ratio


def _pairs(labels: DataFrame) -> DataFrame:
    a, b = labels.alias("a"), labels.alias("b")
    return a.join(b, F.expr("a.task_id = b.task_id and a.annotator < b.annotator")).select(F.col("a.task_id").alias("task_id"), F.col("a.annotator").alias("rater_a"), F.col("b.annotator").alias("rater_b"), F.col("a.label").alias("label_a"), F.col("b.label").alias("label_b"))


def raw_agreement(labels: DataFrame) -> DataFrame:
    """pairs, agreement over all pairs of annotators of a task, from label counts: one row."""
    tasks = labels.groupBy("task_id", "label").agg(F.count("*").alias("c")).groupBy("task_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"))
    return tasks.where("n > 1").agg((F.sum(F.col("n") * (F.col("n") - 1)) / 2).cast("long").alias("pairs"), ratio(F.sum("same"), F.sum(F.col("n") * (F.col("n") - 1))).alias("agreement"))


def cohen(labels: DataFrame) -> DataFrame:
    """rater_a, rater_b, tasks, kappa of every pair of annotators; kappa is 1 where agreement by chance is certain."""
    pairs = _pairs(labels)
    n = pairs.groupBy("rater_a", "rater_b").agg(F.count("*").alias("tasks"), F.avg((F.col("label_a") == F.col("label_b")).cast("double")).alias("po"))
    ma = pairs.groupBy("rater_a", "rater_b", F.col("label_a").alias("label")).agg(F.count("*").alias("ca"))
    mb = pairs.groupBy("rater_a", "rater_b", F.col("label_b").alias("label")).agg(F.count("*").alias("cb"))
    chance = ma.join(mb, ["rater_a", "rater_b", "label"]).groupBy("rater_a", "rater_b").agg(F.sum(F.col("ca") * F.col("cb")).alias("e"))
    out = n.join(chance, ["rater_a", "rater_b"], "left").withColumn("pe", F.coalesce("e", F.lit(0)) / (F.col("tasks") * F.col("tasks")))
    return out.select("rater_a", "rater_b", "tasks", F.when(F.col("pe") >= 1.0, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def fleiss(labels: DataFrame, certain: float = 1.0) -> DataFrame:
    """Fleiss' kappa over tasks of at least two annotators, whose number may differ: one row. Where all labels are the
    same, agreement by chance is certain and kappa is 0 / 0: ``certain`` stands for it."""
    counts = labels.groupBy("task_id", "label").agg(F.count("*").alias("c"))
    tasks = counts.groupBy("task_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).where("n > 1")
    p = tasks.agg(F.avg(F.col("same") / (F.col("n") * (F.col("n") - 1))).alias("p"), F.sum("n").alias("total"), F.count("*").alias("tasks"))
    shares = counts.join(tasks.select("task_id"), "task_id", "left_semi").groupBy("label").agg(F.sum("c").alias("c"))
    e = shares.crossJoin(F.broadcast(p.select("total"))).agg(F.sum(F.pow(F.col("c") / F.col("total"), F.lit(2))).alias("e"))
    return p.crossJoin(e).select("tasks", F.when(F.col("e") >= 1.0, F.lit(certain)).otherwise((F.col("p") - F.col("e")) / (1 - F.col("e"))).alias("kappa"))


def krippendorff(labels: DataFrame, certain: float = 1.0) -> DataFrame:
    """Nominal alpha, from coincidences that weigh 1 / (annotators of a task - 1): one row. Where all labels are the same,
    no difference is expected and none found: ``certain`` stands for 1 - 0 / 0."""
    counts = labels.groupBy("task_id", "label").agg(F.count("*").alias("c"))
    tasks = counts.groupBy("task_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("cc")).where("n > 1")
    o = tasks.agg(F.sum((F.col("n") * F.col("n") - F.col("cc")) / (F.col("n") - 1)).alias("differ"), F.sum("n").alias("total"))
    m = counts.join(tasks.select("task_id"), "task_id", "left_semi").groupBy("label").agg(F.sum("c").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("cc"))
    expected = (F.col("total") * F.col("total") - F.col("cc")) / (F.col("total") - 1)
    return o.crossJoin(m).select("total", F.when(expected == 0, F.lit(certain)).otherwise(1 - F.col("differ") / expected).alias("alpha"))


def confusion(labels: DataFrame) -> DataFrame:
    """label_a, label_b (a <= b), pairs of annotators' labels of a task."""
    p = _pairs(labels)
    return p.groupBy(F.least("label_a", "label_b").alias("label_a"), F.greatest("label_a", "label_b").alias("label_b")).agg(F.count("*").alias("pairs"))


def ambiguity(labels: DataFrame) -> DataFrame:
    """Share of tasks of at least two annotators that have more than one label: one row."""
    t = labels.groupBy("task_id").agg(F.count("*").alias("n"), F.count_distinct("label").alias("d")).where("n > 1")
    return t.agg(F.count("*").alias("tasks"), F.avg((F.col("d") > 1).cast("double")).alias("ambiguity_rate"))


def majority(labels: DataFrame) -> DataFrame:
    """task_id, label of most annotators (ties: the smaller label), votes, annotators."""
    c = labels.groupBy("task_id", "label").agg(F.count("*").alias("c"))
    return c.groupBy("task_id").agg(F.min_by("label", F.struct(-F.col("c"), "label")).alias("label"), F.max("c").alias("votes"), F.sum("c").alias("annotators"))


def judge_reliability(judged: DataFrame) -> DataFrame:
    """judge, n, human agreement, length bias (longer half minus shorter half) and refusal bias of judge scores.

    ``judged``: judge, task_id, score, human, length, refused. The split is at the median length of the judge's tasks.
    """
    mid = judged.groupBy("judge").agg(percentile("length", 0.5).alias("mid"))
    j = judged.join(mid, "judge")
    long_, short = F.avg(F.when(F.col("length") > F.col("mid"), F.col("score"))), F.avg(F.when(F.col("length") <= F.col("mid"), F.col("score")))
    refused, answered = F.avg(F.when(F.col("refused"), F.col("score"))), F.avg(F.when(~F.col("refused"), F.col("score")))
    return j.groupBy("judge").agg(F.count("*").alias("n"), F.avg((F.col("score") == F.col("human")).cast("double")).alias("human_agreement"), F.var_pop("score").alias("variance"), (long_ - short).alias("length_bias"), (refused - answered).alias("refusal_bias"))


def adjudication_queue(labels: DataFrame, flags: DataFrame) -> DataFrame:
    """task_id, queue, priority: a task waits in a queue for each reason; most disagreement and invalid ones first."""
    t = labels.groupBy("task_id").agg(F.count("*").alias("n"), F.count_distinct("label").alias("d")).join(flags, "task_id", "left")
    why = F.array_compact(F.array(F.when(F.col("d") > 1, F.lit("disagreement")), F.when(F.col("invalid"), F.lit("invalid_item")), F.when(F.col("ambiguous"), F.lit("ambiguous")), F.when(F.col("n") < 2, F.lit("single_annotator"))))
    rank = F.when(F.col("queue") == "invalid_item", 0).when(F.col("queue") == "disagreement", 1).when(F.col("queue") == "ambiguous", 2).otherwise(3)
    return t.withColumn("queue", F.explode(why)).select("task_id", "queue", rank.alias("priority"))


def apply_decisions(labels: DataFrame, decisions: DataFrame) -> DataFrame:
    """task_id, label, invalid: the last decision of a task (by sequence) over the majority; invalid tasks stay, marked."""
    last = decisions.groupBy("task_id").agg(F.max_by(F.struct("label", "invalid"), "sequence").alias("d"))
    return majority(labels).join(last, "task_id", "left").select("task_id", F.coalesce("d.label", "label").alias("label"), F.coalesce("d.invalid", F.lit(False)).alias("invalid"))
