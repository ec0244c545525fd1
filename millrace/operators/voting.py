"""Votes over repeated extractions and over several reviewers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.metrics import share


def field_votes(df: DataFrame, key: str, run: str, fields: dict[str, Column]) -> DataFrame:
    """(key, field, value, agreement, extraction_rate): the most frequent normalised value of each field over a record's runs.

    Of equally frequent values the one of the earliest run wins, then the least. agreement: its share of the values that are set;
    extraction_rate: the share of runs that have a value.
    """
    long = df.select(key, run, F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.cast("string").alias("value")) for n, c in fields.items()])).alias("f")).select(key, run, "f.*")
    counts = long.groupBy(key, "field", "value").agg(F.count("*").alias("n"), F.min(run).alias("first"))
    every, there = F.sum("n"), F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0))
    best = F.min_by(F.when(F.col("value").isNotNull(), F.struct("value", "n")), F.when(F.col("value").isNotNull(), F.struct(-F.col("n"), "first", "value")))
    x = counts.groupBy(key, "field").agg(best.alias("best"), every.alias("runs"), there.alias("there"))
    return x.select(key, "field", F.col("best.value").alias("value"), share(F.coalesce("best.n", F.lit(0)), F.col("there")).alias("agreement"), share(F.col("there"), F.col("runs")).alias("extraction_rate"))


def reviewer_votes(results: DataFrame) -> DataFrame:
    """(sample_id, prompt_id, has_bug, severity): the verdicts of a sample's latest row, one a reviewer."""
    rows = results.where("sample_id is not null").groupBy("sample_id").agg(F.max_by("prompt_results", F.struct("updated_at", "total_votes", F.size("prompt_results"))).alias("m"))
    return rows.select("sample_id", F.explode("m").alias("prompt_id", "v")).select("sample_id", "prompt_id", "v.has_bug", "v.severity")


def ensemble(votes: DataFrame, *by: str, threshold: float = 0.5) -> DataFrame:
    """Votes of all reviewers of a sample: counts, confidence (distance from an even vote) and label; null verdicts don't vote."""
    x = votes.groupBy(*by).agg(F.count_if(F.col("has_bug")).alias("votes_bug"), F.count_if(~F.col("has_bug")).alias("votes_no_bug"))
    total = F.col("votes_bug") + F.col("votes_no_bug")
    ratio = share(F.col("votes_bug"), total)
    sure = F.when(total > 0, F.abs(ratio - 0.5) * 2).otherwise(0.0)
    return x.select(*by, "votes_bug", "votes_no_bug", total.alias("total_votes"), ratio.alias("vote_ratio"), sure.alias("confidence"), ((total > 0) & (ratio >= threshold)).alias("predicted"), ((ratio > 0.3) & (ratio < 0.7)).alias("is_split"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share) of a column's values that are set."""
    x = df.where(F.coalesce(F.col(column) != "", F.lit(False))).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return x.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
