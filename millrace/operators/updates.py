"""Joining stage results back onto records: updates, statuses, canonical names, unions and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import truthy
from millrace.operators.requests import content, status


def update_from(records: DataFrame, results: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """records with columns (name in records: name in results) replaced where a result has a value; others keep what they have.

    results: at most one row a key. ``updated`` tells whether any column was replaced.
    """
    new = results.select(key, *(F.col(b).alias(f"_{a}") for a, b in columns.items()))
    x = records.join(new, key, "left")
    there = [truthy(F.col(f"_{a}").cast("string")) for a in columns]
    any_there = there[0]
    for t in there[1:]:
        any_there = any_there | t
    x = x.withColumn("updated", any_there)
    for a, t in zip(columns, there):
        x = x.withColumn(a, F.when(t, F.col(f"_{a}")).otherwise(F.col(a)))
    return x.drop(*(f"_{a}" for a in columns))


def joined_status(results: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """results with a status: unmatched where the key is not known, else that of the reply."""
    k = known.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_known", F.lit(True))
    return results.join(k, key, "left").withColumn("status", F.when(F.col("_known").isNull(), "unmatched").otherwise(status())).drop("_known")


def answers_for(questions: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Every question with its reply, '' where there is none, and whether it may be judged. results: at most one row a key."""
    x = questions.join(results.select(key, F.lit(True).alias("_there"), F.coalesce(content(), F.lit("")).alias("reply")), key, "left")
    outcome = F.when(F.col("_there").isNull(), "missing").when(F.col("reply") == "", "skipped").otherwise("valid")
    return x.withColumn("outcome", outcome).withColumn("reply", F.coalesce("reply", F.lit(""))).drop("_there")


def canonical_names(names: DataFrame, clusters: DataFrame, name: str = "name", order: str = "cluster") -> DataFrame:
    """names with ``canonical``: the cluster's name by its variants, the name itself without one. clusters: (order, canonical, variants).

    Of several clusters with one variant, the last by ``order`` counts.
    """
    v = clusters.select(F.explode("variants").alias(name), F.struct(order, "canonical").alias("c")).where(F.col(name).isNotNull())
    v = v.groupBy(name).agg(F.max("c").alias("c"))
    return names.join(v, name, "left").withColumn("canonical", F.coalesce("c.canonical", name)).drop("c")


def united(sources: dict[str, DataFrame], column: str = "name") -> DataFrame:
    """(source, name) of all sources one below the other; columns that a source lacks are null."""
    out = None
    for label, df in sources.items():
        x = df.withColumn("source", F.lit(label))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out.select("source", column)


def compared(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, outcome): every key of either side as same, changed, removed (only in a) or added (only in b). Keys are unique on each side."""
    x = a.select(key, F.struct(*columns).alias("_a")).join(b.select(key, F.struct(*columns).alias("_b")), key, "full")
    outcome = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return x.select(key, outcome.alias("outcome"))


def kept(matches: Column, confidence: Column) -> Column:
    """Keep what matches, unless its confidence is low; a missing confidence passes. Never null."""
    return F.coalesce(matches, F.lit(False)) & ~confidence.eqNullSafe(F.lit("low"))
