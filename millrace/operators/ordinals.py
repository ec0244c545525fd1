"""Row numbers, chunks and last-wins without a single-partition sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import stage


def with_ordinal(df: DataFrame, *keys: str, name: str = "ord") -> DataFrame:
    """df with 0-based numbers in the order of keys, which must be unique for the numbers to be determined.

    Rows are range-partitioned and numbered within their partition; only the partitions' sizes are gathered, one row each.
    """
    spread = stage(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return spread.withColumn("_row", within).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_row") - 1).drop("_part", "_row", "_before")


def in_chunks(df: DataFrame, size: int, *keys: str, name: str = "chunk") -> DataFrame:
    """df with ord and the number of the chunk of ``size`` rows in key order that a row belongs to."""
    return with_ordinal(df, *keys).withColumn(name, F.floor(F.col("ord") / size).cast("long"))


def last_wins(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The last row of each non-null key by ``order``. Aggregated with partial maxima, so a hot key never sits in one task."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])).alias("_row")).select("_row.*")


def first_per_group(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each group: the ranking filter lets Spark cut each task's rows to n before they are shuffled."""
    ranked = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= n)


def priority_sample(df: DataFrame, key: str, weight: str, n: int) -> DataFrame:
    """(key, frequent): the n / 2 rows of greatest weight, and as many of the others as make up n, drawn by a hash of the key."""
    top = df.orderBy(F.desc(weight), key).limit(n // 2).select(key, F.lit(True).alias("frequent"))
    rest = df.select(key).join(F.broadcast(top.select(key)), key, "left_anti")
    return top.unionByName(rest.orderBy(F.md5(F.col(key)), key).limit(n - n // 2).select(key, F.lit(False).alias("frequent")))
