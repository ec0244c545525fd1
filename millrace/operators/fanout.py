"""One record into several requests: by prompt, by run, by a grid with allocated counts; and groups of records into one request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordinals import first_per_group

#: Most rows of a list of prompts or variants that each record is combined with.
MOST_VARIANTS = 1000


def with_variants(df: DataFrame, variants: DataFrame, key: str) -> DataFrame:
    """Each row of df once for every value of ``key`` in variants, a short list whose length is checked; it is exploded, not joined."""
    values = [r[0] for r in variants.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(MOST_VARIANTS + 1).collect()]
    if len(values) > MOST_VARIANTS:
        raise ValueError(f"more than {MOST_VARIANTS} variants")
    kind = variants.schema[key].dataType.simpleString()
    return df.withColumn(key, F.explode(F.array(*map(F.lit, values)).cast(f"array<{kind}>")))


def repeated(df: DataFrame, key: str, runs: int | Column, name: str = "request_id") -> DataFrame:
    """Each row so many times, with a run from 0 and an id "<key>__run_<run>"."""
    last = (F.lit(runs) if isinstance(runs, int) else runs) - 1
    x = df.withColumn("run", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last.cast("int")))))
    return x.withColumn(name, F.concat(F.col(key), F.lit("__run_"), F.col("run").cast("string")))


def allocated(topics: DataFrame, topic: str, shares: dict[str, float], count: int) -> DataFrame:
    """(topic, difficulty, n, begin): how many of ``count`` scenarios each topic and difficulty gets, in order, until the count is reached.

    A topic gets ceil(count / topics), a difficulty of it the share of that, rounded half to even, one at least; what exceeds the count is cut off.
    """
    per = F.ceil(F.lit(float(count)) / F.count("*").over(Window.partitionBy()))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(d).alias("difficulty"), F.lit(float(p)).alias("share")) for i, (d, p) in enumerate(shares.items())]))
    # topics are few: one row each
    x = topics.select(topic).where(F.col(topic).isNotNull()).distinct().withColumn("per", per).select(topic, "per", cells.alias("c")).select(topic, "per", "c.*")
    x = x.withColumn("n", F.greatest(F.lit(1), F.bround(F.col("per") * F.col("share"), 0).cast("int")))
    order = Window.orderBy(topic, "place").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("begin", F.coalesce(F.sum("n").over(order), F.lit(0))).withColumn("n", F.least("n", count - F.col("begin")).cast("int"))
    return x.where("n > 0").select(topic, "difficulty", "n", "begin")


def in_groups(numbered: DataFrame, size: int, key: str, ordinal: str = "ord", prefix: str = "group") -> DataFrame:
    """(group_id, members): so many consecutive rows a group, in order; the members are the mapping back."""
    number = F.floor(F.col(ordinal) / size).cast("long")
    x = numbered.groupBy(number.alias("_n")).agg(F.array_sort(F.collect_list(F.struct(ordinal, key))).alias("members"))
    return x.select(F.concat(F.lit(f"{prefix}-"), F.format_string("%05d", "_n")).alias("group_id"), F.col(f"members.{key}").alias("members"))


def ungrouped(groups: DataFrame, parts: Column) -> DataFrame:
    """(member, part): the members of each group with the group's parts by position; null where there are fewer parts."""
    x = groups.withColumn("_parts", parts).select("_parts", F.posexplode("members").alias("_pos", "member"))
    return x.select("member", F.get("_parts", F.col("_pos")).alias("part"))


def balanced(df: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """So many rows of each label, in key order: as many as the rarest label has, at most half of ``most``."""
    least = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] or 0
    return first_per_group(df, label, min(least, most // 2), F.col(key)).drop("rank")
