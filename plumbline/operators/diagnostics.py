"""Diagnostics of a benchmark: each a function of long tables that gives summary, per-model or per-item rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.ranks import place
from plumbline.functions.stats import pearson, percentile, ratio, spearman, with_pair_ranks
from plumbline.functions.text import logit
from plumbline.operators.matrix import accuracy, align

def shortcut(full: DataFrame, variants: DataFrame) -> DataFrame:
    """prompt_variant, full_score, ablated_score, retention, high: what is left of the score without the evidence."""
    names = variants.select("prompt_variant").distinct()
    cells = full.crossJoin(F.broadcast(names)).join(variants.select("model_id", "item_id", "prompt_variant", F.col("score").alias("a")), ["model_id", "item_id", "prompt_variant"], "left")
    out = cells.groupBy("prompt_variant").agg(F.avg("score").alias("full_score"), F.avg("a").alias("ablated_score"))
    return out.withColumn("retention", ratio(F.col("ablated_score"), F.col("full_score"))).withColumn("high", F.col("retention") >= 0.70)


def shortcut_models(full: DataFrame, variant: DataFrame) -> DataFrame:
    m = align(full, variant).groupBy("model_id").agg(F.avg("score").alias("full_score"), F.avg("variant_score").alias("ablated_score"))
    return m.withColumn("retention", ratio(F.col("ablated_score"), F.col("full_score")))


def shortcut_items(full: DataFrame, variant: DataFrame) -> DataFrame:
    """item_id, suspicion: how far the ablated mean lies above the full one."""
    m = align(full, variant).groupBy("item_id").agg(F.avg("score").alias("f"), F.avg("variant_score").alias("a"))
    return m.select("item_id", F.greatest(F.coalesce(F.col("a") - F.col("f"), F.lit(0.0)), F.lit(0.0)).alias("suspicion"))


def prompt_sensitivity(full: DataFrame, variant: DataFrame, least: int = 2) -> DataFrame:
    """mean_delta, spearman of model accuracies, flips of at least ``least`` places: one row."""
    both = align(full, variant).groupBy("model_id").agg(F.round(F.avg("score"), 12).alias("x"), F.round(F.avg("variant_score"), 12).alias("y"), F.avg(F.col("variant_score") - F.col("score")).alias("d"))
    r = with_pair_ranks(both, "x", "y", []).withColumns({"px": place("x", [], F.desc("model_id")), "py": place("y", [], F.desc("model_id"))})
    return r.agg(F.avg("d").alias("mean_delta"), pearson("_rx", "_ry").alias("spearman"), F.count_if(F.abs(F.col("px") - F.col("py")) >= least).alias("flips"))


def variant_variance(responses: DataFrame) -> DataFrame:
    """model_id, variants, variance (population) of its accuracy over prompt variants."""
    return accuracy(responses, "model_id", "prompt_variant").groupBy("model_id").agg(F.count("*").alias("variants"), F.var_pop("accuracy").alias("variance"))


def reliability(full: DataFrame, variant: DataFrame) -> DataFrame:
    """spearman of model accuracies, mean absolute difference, agreement at 0.5 (a missing cell counts as wrong): one row."""
    cells = align(full, variant)
    agree = cells.agg(F.avg((F.coalesce(F.col("score") >= 0.5, F.lit(False)) == F.coalesce(F.col("variant_score") >= 0.5, F.lit(False))).cast("double")).alias("agreement"), F.avg(F.abs(F.col("score") - F.col("variant_score"))).alias("mean_abs_delta"))
    acc = cells.groupBy("model_id").agg(F.round(F.avg("score"), 12).alias("x"), F.round(F.avg("variant_score"), 12).alias("y"))
    return with_pair_ranks(acc, "x", "y", []).agg(pearson("_rx", "_ry").alias("spearman")).crossJoin(agree)


def item_stability(full: DataFrame, variant: DataFrame) -> DataFrame:
    """item_id, stability: share of models on the same side of 0.5 with both prompts; a missing cell counts as wrong."""
    side = lambda c: F.coalesce(F.col(c) >= 0.5, F.lit(False))
    return align(full, variant).groupBy("item_id").agg(F.avg((side("score") == side("variant_score")).cast("double")).alias("stability"))


def _best(matrix: DataFrame, top: int) -> DataFrame:
    """model_id of the ``top`` best, ties by rising id: a row a model, of a panel."""
    return accuracy(matrix).withColumn("accuracy", F.round("accuracy", 12)).orderBy(F.desc("accuracy"), "model_id").limit(top)


def saturation(matrix: DataFrame, top: int = 3) -> DataFrame:
    """items, shares solved by the best models and failed by all, discriminating items, range of the best, ceiling,
    compression (1 - sample deviation / mean of accuracies) and category: one row."""
    best = _best(matrix, top)
    m = matrix.join(F.broadcast(best.select("model_id", F.lit(True).alias("best"))), "model_id", "left")
    items = m.groupBy("item_id").agg(F.avg(F.when(F.col("best"), F.col("score"))).alias("top"), F.avg("score").alias("p"), F.stddev_samp("score").alias("sd"))
    acc = accuracy(matrix).agg(F.max("accuracy").alias("ceiling"), (1 - F.stddev_samp("accuracy") / F.greatest(F.avg("accuracy"), F.lit(1e-8))).alias("compression"))
    span = best.agg((F.max("accuracy") - F.min("accuracy")).alias("top_range"))
    s = items.agg(F.count("*").alias("items"), F.avg((F.coalesce(F.col("top"), F.lit(0.0)) >= 0.999).cast("double")).alias("solved"), F.avg((F.col("p") <= 0.001).cast("double")).alias("failed"), F.count_if((F.col("p") > 0.05) & (F.col("p") < 0.95) & (F.col("sd") > 0.05)).alias("discriminating"))
    share = F.col("discriminating") / F.col("items")
    # The ladder of categories.
    category = F.when(F.col("items") < 10, "insufficient evidence").when((F.col("ceiling") >= 0.9) | (F.col("solved") >= 0.75) | (share < 0.15), "severe").when((F.col("ceiling") >= 0.8) | (F.col("solved") >= 0.5) | (share < 0.3), "moderate").when((F.col("ceiling") >= 0.7) | (F.col("solved") >= 0.25), "mild").otherwise("not saturated")
    return s.crossJoin(acc).crossJoin(span).withColumn("category", category)


def saturation_by_tag(matrix: DataFrame, tags: DataFrame, top: int = 3) -> DataFrame:
    """tag, items, mean score of all and of the best models, share solved by the best; ``tags``: item_id, tag."""
    m = matrix.join(F.broadcast(_best(matrix, top).select("model_id", F.lit(True).alias("best"))), "model_id", "left").join(tags, "item_id")
    items = m.groupBy("tag", "item_id").agg(F.avg(F.when(F.col("best"), F.col("score"))).alias("top"), F.avg("score").alias("p"))
    return items.groupBy("tag").agg(F.count("*").alias("items"), F.avg("p").alias("mean"), F.avg("top").alias("top_mean"), F.avg((F.coalesce(F.col("top"), F.lit(0.0)) >= 0.999).cast("double")).alias("solved"))


def dif(matrix: DataFrame, groups: DataFrame, least: float = 0.30) -> DataFrame:
    """item_id, group_a, group_b, effect, suspicious: difference of the groups' residuals, which are group mean less item
    mean; an effect of at least ``least`` either way is suspicious."""
    items = matrix.groupBy("item_id").agg(F.avg("score").alias("item_mean"))
    resid = matrix.join(groups, "model_id").groupBy("item_id", "family").agg(F.avg("score").alias("m")).join(items, "item_id").withColumn("r", F.col("m") - F.col("item_mean"))
    a, b = resid.alias("a"), resid.alias("b")
    effect = F.expr("a.r - b.r")
    return a.join(b, F.expr("a.item_id = b.item_id and a.family < b.family")).select(F.col("a.item_id").alias("item_id"), F.col("a.family").alias("group_a"), F.col("b.family").alias("group_b"), effect.alias("effect"), (F.abs(effect) >= least).alias("suspicious"))


def power(matrix: DataFrame, redundancy: float = 0.0) -> DataFrame:
    """model_id, accuracy, se, and of the panel's mean accuracy the least detectable difference and the items needed to
    tell differences of 1, 2 and 5 points; redundant items don't count."""
    acc = accuracy(matrix)
    panel = acc.agg(F.avg("accuracy").alias("mean")).crossJoin(matrix.agg(F.count_distinct("item_id").alias("items")))
    n = F.greatest(F.lit(1.0), F.col("items") * (1 - min(max(redundancy, 0.0), 0.95)))
    p = F.col("mean")
    need = {f"items_for_{d}": F.ceil((1.96 + 0.84) * (1.96 + 0.84) * F.greatest(p * (1 - p), F.lit(1e-6)) / (d / 100 * d / 100)).cast("long") for d in (1, 2, 5)}
    out = acc.crossJoin(F.broadcast(panel)).withColumn("n", n)  # one row
    return out.select("model_id", "accuracy", F.sqrt(F.greatest(F.col("accuracy") * (1 - F.col("accuracy")), F.lit(0.0)) / F.floor("n")).alias("se"), (1.96 * F.sqrt(2 * p * (1 - p) / F.col("n"))).alias("detectable"), *[e.alias(c) for c, e in need.items()])


def coverage(items: DataFrame, tag: str = "tag") -> DataFrame:
    """tags, entropy (bits), balance (entropy / log2 tags), singletons: one row."""
    c = items.groupBy(tag).agg(F.count("*").alias("c"))
    s = c.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy(F.lit(0))))
    e = -F.sum(F.col("p") * F.log2("p"))
    return s.agg(F.count("*").alias("tags"), e.alias("entropy"), F.when(F.count("*") > 1, e / F.log2(F.count("*").cast("double"))).otherwise(0.0).alias("balance"), F.count_if(F.col("c") == 1).alias("singletons"))


def predictive(matrix: DataFrame, criterion: DataFrame) -> DataFrame:
    """n, pearson of model accuracy with an outside criterion, its reading: one row."""
    both = accuracy(matrix).join(criterion, "model_id")
    r = pearson("accuracy", "criterion")
    return both.agg(F.count("*").alias("n"), r.alias("pearson")).withColumn("reading", F.when(F.col("pearson").isNull(), "undefined").when(F.abs("pearson") >= 0.7, "strong").when(F.abs("pearson") >= 0.4, "moderate").otherwise("weak"))


def goodhart(matrix: DataFrame, interventions: DataFrame) -> DataFrame:
    """model_id, accuracy, drift (post - pre), gap (accuracy - post), gaming (drift over 0.05 and accuracy over post + 0.1)."""
    j = accuracy(matrix).join(interventions, "model_id", "left").withColumns({"drift": F.col("post") - F.col("pre"), "gap": F.col("accuracy") - F.col("post")})
    return j.withColumn("gaming", F.coalesce((F.col("drift") > 0.05) & (F.col("accuracy") > F.col("post") + 0.1), F.lit(False)))


def irt_items(matrix: DataFrame) -> DataFrame:
    """item_id, n, p, difficulty, discrimination, information, label, too_easy, too_hard, anchor: closed forms, no fit.

    The rest score of a model is (its sum - x) / (items - 1); an item's Pearson correlation with it makes the item an
    anchor above 0.05 if 0.05 < p < 0.95, or above 0 if there would be too few anchors, or none. Discrimination is the
    item's Spearman correlation with the mean over the anchors (without the item itself), or with the rest score without
    anchors; then the Pearson one, then 0. Sums less a part: items never meet each other."""
    model = matrix.groupBy("model_id").agg(F.sum("score").alias("s"))
    size = matrix.agg(F.count_distinct("item_id").alias("items"), F.count_distinct("model_id").alias("models"))
    rows = matrix.join(model, "model_id").crossJoin(F.broadcast(size))  # one row
    rows = rows.withColumn("rest", F.round(F.when(F.col("items") > 1, (F.col("s") - F.col("score")) / F.greatest(F.col("items") - 1, F.lit(1))).otherwise(F.col("s")), 12))
    p = rows.groupBy("item_id").agg(F.count("score").alias("n"), F.avg("score").alias("p"), F.coalesce(F.round(pearson("score", "rest"), 12), F.lit(0.0)).alias("total_r"), F.first("items").alias("items"))
    strict, loose = (F.col("p") > 0.05) & (F.col("p") < 0.95) & (F.col("total_r") > 0.05), F.col("total_r") > 0
    least = F.least(F.lit(5), F.greatest(F.lit(2), F.floor(F.max("items") / 4)))
    kind = p.agg(F.count_if(strict).alias("strict"), F.count_if(loose).alias("loose"), least.alias("least")).select("least", F.when(F.col("strict") >= F.col("least"), "strict").when(F.col("loose") >= F.col("least"), "loose").otherwise("none").alias("kind"))
    p = p.crossJoin(F.broadcast(kind)).withColumn("anchor", F.when(F.col("kind") == "strict", strict).when(F.col("kind") == "loose", loose).otherwise(F.lit(False)))
    count = p.agg(F.count_if("anchor").alias("anchors"), F.first("least").alias("least"))
    rows = rows.join(p.select("item_id", "anchor"), "item_id")
    sums = rows.groupBy("model_id").agg(F.sum(F.when(F.col("anchor"), F.col("score"))).alias("as"))
    rows = rows.join(sums, "model_id").crossJoin(F.broadcast(count))
    proxy = F.when(F.col("anchor") & (F.col("anchors") - 1 >= F.col("least")), (F.col("as") - F.col("score")) / F.greatest(F.col("anchors") - 1, F.lit(1))).when(F.col("anchors") >= F.col("least"), F.col("as") / F.greatest(F.col("anchors"), F.lit(1))).otherwise(F.col("rest"))
    rows = rows.withColumn("proxy", F.round(proxy, 12))
    d = with_pair_ranks(rows, "score", "proxy", ["item_id"]).groupBy("item_id").agg(pearson("_rx", "_ry").alias("rho"), pearson("score", "proxy").alias("r"), F.first("anchors").alias("anchors"), F.first("models").alias("models"))
    out = p.join(d, "item_id", "left").withColumn("discrimination", F.coalesce("rho", "r", "total_r", F.lit(0.0))).withColumn("difficulty", -logit(F.col("p"), 1e-4))
    disc, mid = F.col("discrimination"), (F.col("p") > 0.05) & (F.col("p") < 0.95)
    label = F.when(F.col("models") < 5, "insufficient_panel").when((F.col("anchors") == 0) | ~mid, "unstable_estimate").when(disc < -0.05, "negative_discrimination").when(F.abs(disc) < 0.05, "low_discrimination").otherwise("positive_discrimination")
    return out.select("item_id", "n", "p", "difficulty", "discrimination", (F.greatest(disc, F.lit(0.0)) * F.col("p") * (1 - F.col("p"))).alias("information"), label.alias("label"), (F.col("p") >= 0.95).alias("too_easy"), (F.col("p") <= 0.05).alias("too_hard"), "anchor")


def irt_abilities(matrix: DataFrame) -> DataFrame:
    return accuracy(matrix).withColumn("ability", logit(F.col("accuracy"), 1e-4))


def high_information(items: DataFrame, k: int) -> DataFrame:
    return items.orderBy(F.desc("information"), F.desc_nulls_last("discrimination"), "item_id").limit(k)


def subset_fidelity(matrix: DataFrame, chosen: DataFrame, k: int = 3) -> DataFrame:
    """size, spearman, topk: how a subset of items ranks models against all items: one row."""
    sub = matrix.join(F.broadcast(chosen.select("item_id")), "item_id", "left_semi")
    x = accuracy(matrix).select("model_id", F.round("accuracy", 12).alias("x"))
    y = accuracy(sub).select("model_id", F.round("accuracy", 12).alias("y"))
    r = with_pair_ranks(x.join(y, "model_id"), "x", "y", []).withColumns({"px": place("x", [], F.desc("model_id")), "py": place("y", [], F.desc("model_id"))})
    size = chosen.agg(F.count("*").alias("size"))
    return r.agg(pearson("_rx", "_ry").alias("spearman"), (F.count_if((F.col("px") <= k) & (F.col("py") <= k)) / F.lit(float(k))).alias("topk")).crossJoin(size)


def hierarchical_logit(matrix: DataFrame, strength: float = 20.0) -> DataFrame:
    """model_id, subject, p: intercept, centred model and subject logits, and interaction shrunk by n / (n + strength)."""
    def lg(by: list[str]) -> Column:
        return logit((F.sum("score") + 0.5) / (F.count("score") + 1.0), 1e-8)

    cell = matrix.groupBy("model_id", "subject").agg(lg([]).alias("c"), F.count("score").alias("n"))
    m = matrix.groupBy("model_id").agg(lg([]).alias("m"))
    s = matrix.groupBy("subject").agg(lg([]).alias("s"))
    m = m.withColumn("m", F.col("m") - F.avg("m").over(Window.partitionBy(F.lit(0))))
    s = s.withColumn("s", F.col("s") - F.avg("s").over(Window.partitionBy(F.lit(0))))
    g = matrix.agg(lg([]).alias("g"))
    j = cell.join(m, "model_id").join(s, "subject").crossJoin(F.broadcast(g))
    main = F.col("g") + F.col("m") + F.col("s")
    eta = main + (F.col("c") - main) * F.col("n") / (F.col("n") + strength)
    return j.select("model_id", "subject", (1 / (1 + F.exp(-main))).alias("additive"), (1 / (1 + F.exp(-eta))).alias("p"))


def model_fit(matrix: DataFrame, probabilities: DataFrame, p: str) -> DataFrame:
    """brier and log loss of predicted shares over all cells: one row."""
    q = F.greatest(F.least(F.col(p), F.lit(1 - 1e-8)), F.lit(1e-8))
    return matrix.join(probabilities, ["model_id", "subject"]).agg(F.avg(F.pow(F.col(p) - F.col("score"), F.lit(2))).alias("brier"), F.avg(-(F.col("score") * F.log(q) + (1 - F.col("score")) * F.log(1 - q))).alias("log_loss"))


def interaction_variance(first: DataFrame, second: DataFrame) -> DataFrame:
    """Sample variance of x - grand - model - benchmark effects over models of both benchmarks: one row."""
    a = accuracy(first).withColumn("b", F.lit("a")).join(second.select("model_id").distinct(), "model_id", "left_semi")
    b = accuracy(second).withColumn("b", F.lit("b")).join(first.select("model_id").distinct(), "model_id", "left_semi")
    rows = a.unionByName(b)
    res = F.col("accuracy") - F.avg("accuracy").over(Window.partitionBy("model_id")) - F.avg("accuracy").over(Window.partitionBy("b")) + F.avg("accuracy").over(Window.partitionBy(F.lit(0)))
    return rows.select(res.alias("r")).agg(F.count("*").alias("n"), F.var_samp("r").alias("variance"))


def option_shape(choices: DataFrame) -> DataFrame:
    """item_id, n, entropy (normalised over four options), bimodal (share of the two most chosen), low_discrimination."""
    c = choices.groupBy("item_id", "choice").agg(F.count("*").alias("c"))
    w = Window.partitionBy("item_id")
    c = c.withColumns({"n": F.sum("c").over(w), "k": F.row_number().over(w.orderBy(F.desc("c"), "choice"))}).withColumn("p", F.col("c") / F.col("n"))
    return c.groupBy("item_id", "n").agg((-F.sum(F.col("p") * F.log("p")) / F.log(F.lit(4.0))).alias("entropy"), F.sum(F.when(F.col("k") <= 2, F.col("p"))).alias("bimodal"), F.max("p").alias("top_share"))


def answer_distribution(choices: DataFrame) -> DataFrame:
    """choice, n, share, imbalance: its share above an even one."""
    c = choices.groupBy("choice").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0))
    c = c.withColumn("share", F.col("n") / F.sum("n").over(w))
    return c.withColumn("imbalance", F.col("share") - 1 / F.count("*").over(w))


def distractors(choices: DataFrame, answers: DataFrame, models: DataFrame) -> DataFrame:
    """item_id, choice, total, strong, discrimination (strong - total), dead: options that aren't the answer.

    Strong models have at least the 75th percentile of accuracy."""
    cut = models.agg(percentile("accuracy", 0.75).alias("cut"))
    strong = models.crossJoin(F.broadcast(cut)).select("model_id", (F.col("accuracy") >= F.col("cut")).alias("strong"))
    c = choices.join(strong, "model_id").groupBy("item_id", "choice").agg(F.count("*").alias("total"), F.count_if("strong").alias("strong"))
    grid = answers.select("item_id", "answer", F.explode(F.array(*map(F.lit, "ABCD"))).alias("choice")).where("choice <> answer")
    return grid.join(c, ["item_id", "choice"], "left").select("item_id", "choice", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("strong", F.lit(0)).alias("strong")).withColumns({"discrimination": F.col("strong") - F.col("total"), "dead": F.col("total") == 0})


def extraction_robustness(outputs: DataFrame) -> DataFrame:
    """model_id, n, strict, lenient, stated, disagreement, refusals, invalid: shares over raw outputs."""
    from plumbline.functions import text as X

    t = F.col("raw_output")
    o = outputs.select("model_id", X.strict_letter(t).alias("a"), X.mcq_label(t).alias("b"), X.final_answer(t).alias("c"), X.refusal(t).alias("r"), X.invalid(t).alias("i"))
    kinds = F.size(F.array_distinct(F.array_compact(F.array("a", "b", "c"))))
    share = lambda c: F.avg(c.cast("double"))
    return o.groupBy("model_id").agg(F.count("*").alias("n"), share(F.col("a").isNotNull()).alias("strict"), share(F.col("b").isNotNull()).alias("lenient"), share(F.col("c").isNotNull()).alias("stated"), share(kinds > 1).alias("disagreement"), share(F.col("r")).alias("refusals"), share(F.col("i")).alias("invalid"))


def tag_profiles(matrix: DataFrame, tags: DataFrame) -> DataFrame:
    """tag, mean, variance (population) of models' means on the tag's items."""
    per = matrix.join(tags, "item_id").groupBy("tag", "model_id").agg(F.avg("score").alias("a"))
    return per.groupBy("tag").agg(F.avg("a").alias("mean"), F.var_pop("a").alias("variance"))


def cluster_weighted(matrix: DataFrame, clusters: DataFrame) -> DataFrame:
    """model_id, accuracy with items weighed by 1 / size of their cluster; items without one weigh 1."""
    size = clusters.withColumn("w", 1 / F.count("*").over(Window.partitionBy("cluster"))).select("item_id", "w")
    j = matrix.join(size, "item_id", "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    return j.groupBy("model_id").agg((F.sum(F.col("score") * F.col("w")) / F.sum("w")).alias("accuracy"))


def balanced_subset(items: DataFrame, k: int) -> DataFrame:
    """Round-robin over sorted tags, the best of each tag first; an item with several tags is taken at its first turn.

    A place in the draw is (round, tag); an item's first place decides, so no loop over items is needed."""
    w = Window.partitionBy("tag").orderBy(F.desc("value"), "item_id")
    turn = items.withColumn("round", F.row_number().over(w)).groupBy("item_id").agg(F.min(F.struct("round", "tag")).alias("t"))
    return turn.orderBy("t.round", "t.tag").limit(k).select("item_id", F.col("t.tag").alias("tag"))
