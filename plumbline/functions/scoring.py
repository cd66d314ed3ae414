"""Scores of raw answers against gold answers, by task family."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import text as X


def exact(prediction: Column, golds: Column) -> Column:
    """1 if the prediction equals one of the gold answers after normalisation."""
    return F.exists(golds, lambda g: X.normalize_answer(g) == X.normalize_answer(prediction)).cast("double")


def choice(raw: Column, golds: Column, choices: Column) -> Column:
    """Multiple choice: the extracted letter is accepted, or the text equals an accepted option's text."""
    label = X.extracted(raw)
    letters = F.transform(golds, lambda g: F.upper(F.trim(g)))
    texts = F.filter(F.transform(choices, lambda c, k: F.struct(F.element_at(F.array(*map(F.lit, "ABCDEFGH")), k + 1).alias("l"), X.squeeze(c).alias("t"))), lambda o: F.array_contains(letters, o["l"]))
    return F.coalesce(F.array_contains(letters, label), F.exists(texts, lambda o: o["t"] == X.squeeze(raw))).cast("double")


def unique_choice(raw: Column) -> Column:
    """The one letter A-D that an answer names, else why there is none: (label, failure)."""
    found = F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(raw, F.lit(""))), F.lit(r"(?:^|[^A-Z])([A-D])(?=[^A-Z]|$)"), F.lit(1)))
    why = F.when(X.invalid(raw), "empty").when(X.refusal(raw), "refusal").when(F.size(found) == 0, "no_choice").when(F.size(found) > 1, "ambiguous")
    return F.struct(F.when(why.isNull(), F.get(found, F.lit(0))).alias("label"), why.alias("failure"))


def numeric(raw: Column, gold: Column, tolerance: float = 0.0) -> Column:
    p, g = X.number(raw), X.number(gold)
    return F.when(p.isNull() | g.isNull(), 0.0).otherwise((F.abs(p - g) <= F.lit(tolerance)).cast("double"))


def boolean(raw: Column) -> Column:
    """The last yes/no or true/false of an answer."""
    found = F.regexp_extract_all(F.lower(F.coalesce(raw, F.lit(""))), F.lit(r"\b(yes|no|true|false|valid|invalid)\b"), F.lit(1))
    last = F.when(F.size(found) > 0, F.element_at(found, -1))
    return F.when(last.isin("yes", "true", "valid"), True).when(last.isin("no", "false", "invalid"), False)


def by_family(family: Column, raw: Column, gold: Column) -> Column:
    """Score by the item's family: choice, boolean, numeric, sequence or text."""
    sequence = X.squeeze(F.regexp_replace(raw, r"[,;\[\]()]", " ")) == X.squeeze(F.regexp_replace(gold, r"[,;\[\]()]", " "))
    return (
        F.when(family == "choice", F.coalesce(X.extracted(raw) == F.upper(F.trim(gold)), F.lit(False)).cast("double"))
        .when(family == "boolean", F.coalesce(boolean(raw) == boolean(gold), F.lit(False)).cast("double"))
        .when(family == "numeric", numeric(raw, gold))
        .when(family == "sequence", F.coalesce(sequence, F.lit(False)).cast("double"))
        .otherwise(F.coalesce(X.normalize_answer(raw) == X.normalize_answer(gold), F.lit(False)).cast("double"))
    )
