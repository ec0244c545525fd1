"""Scores and verdicts that models give: parsing with bounds and defaults, means, labels; tool calls in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORES = ("relevance", "hallucination_risk", "tone")
#: Fixed value: the score from which a reply passes.
PASSES = 0.7


def reference_list(best: Column, correct: Column) -> Column:
    """Correct answers with the best one in front, if it is set and not among them; null counts as empty."""
    c = F.coalesce(correct, F.array().cast("array<string>"))
    return F.when(F.coalesce(best != "", F.lit(False)) & ~F.coalesce(F.array_contains(c, F.coalesce(best, F.lit(""))), F.lit(False)), F.concat(F.array(best), c)).otherwise(c)


def bullets(items: Column) -> Column:
    """Lines "- item" of the items that are set."""
    return F.array_join(F.transform(F.filter(items, lambda x: F.coalesce(x != "", F.lit(False))), lambda x: F.concat(F.lit("- "), x)), "\n")


def scores(reply: Column) -> Column:
    """The three scores of a JSON reply; null unless it parses, has all three, and each lies between 0 and 1."""
    s = F.from_json(reply, ", ".join(f"{c} double" for c in SCORES))
    ok = s[SCORES[0]].between(0, 1) & s[SCORES[1]].between(0, 1) & s[SCORES[2]].between(0, 1)
    return F.when(F.coalesce(ok, F.lit(False)), s)


def overall(s: Column) -> Column:
    return (s["relevance"] + (1 - s["hallucination_risk"]) + s["tone"]) / 3


def score_rows(scored: DataFrame, key: str, score: str = "score") -> DataFrame:
    """(key, evaluator, value, label): a row for each score and the overall one; a missing score is 0 and fails."""
    s = F.col(score)
    values = {c: F.coalesce(s[c], F.lit(0.0)) for c in SCORES} | {"overall": F.coalesce(overall(s), F.lit(0.0))}
    long = scored.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("evaluator"), v.alias("value")) for n, v in values.items()])).alias("e")).select(key, "e.*")
    return long.withColumn("label", F.when(F.col("value") >= PASSES, "pass").otherwise("fail"))


def verdict(found: Column) -> Column:
    """(has_bug, n_bugs, parsed) of a reply's JSON; no bug, and none listed, where it doesn't parse or doesn't say."""
    v = F.from_json(found, "has_bug boolean, bugs array<string>")
    return F.struct(F.coalesce(v["has_bug"], F.lit(False)).alias("has_bug"), F.coalesce(F.size(v["bugs"]), F.lit(0)).alias("n_bugs"), found.isNotNull().alias("parsed"))


def object_or_list(found: Column, key: str) -> Column:
    """The objects of a JSON object's list under ``key``, or of a bare list, as texts; other items, and other JSON, give none."""
    bare = F.from_json(found, "array<string>")
    held = F.from_json(F.get_json_object(found, f"$.{key}"), "array<string>")
    items = F.when(F.ltrim(found).startswith("["), bare).otherwise(held)
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.startswith("{"))


def tool_calls(text: Column) -> Column:
    """Calls written as <tool_call>{...}</tool_call>: (call_id, name, arguments), of those whose JSON has a name; ids are hashes."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"), F.lit(1))
    calls = F.transform(found, lambda c, i: F.struct(F.concat(F.lit("call_"), F.substring(F.md5(F.concat(c, F.lit("#"), i.cast("string"))), 1, 12)).alias("call_id"), F.get_json_object(c, "$.name").alias("name"), F.get_json_object(c, "$.arguments").alias("arguments")))
    return F.filter(calls, lambda c: F.coalesce(c["name"] != "", F.lit(False)))
