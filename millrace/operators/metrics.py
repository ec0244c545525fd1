"""Metrics of labels against truth: binary, multiclass, calibration, triage, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def binary(df: DataFrame, predicted: str, actual: str, *by: str) -> DataFrame:
    """tp, fp, tn, fn, precision, recall, f1 and accuracy by group; a null counts as false."""
    p, a = (F.coalesce(F.col(c), F.lit(False)) for c in (predicted, actual))
    counts = df.groupBy(*by).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & ~a).alias("tn"), F.count_if(~p & a).alias("fn"))
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    return counts.select(*by, "tp", "fp", "tn", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(tp + tn, tp + fp + tn + fn).alias("accuracy"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n); no prediction is NONE."""
    return df.groupBy(F.col(actual).alias("actual"), F.coalesce(F.col(predicted), F.lit("NONE")).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(matrix: DataFrame, classes: DataFrame) -> DataFrame:
    """precision, recall, f1 and support of every class of ``classes`` (one column, name), of a confusion matrix; classes without rows stay."""
    hit = F.col("actual") == F.col("predicted")
    by_actual = matrix.groupBy(F.col("actual").alias("name")).agg(F.sum("n").alias("support"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"))
    by_predicted = matrix.groupBy(F.col("predicted").alias("name")).agg(F.sum("n").alias("said"))
    x = classes.join(by_actual, "name", "left").join(by_predicted, "name", "left").na.fill(0, ["support", "tp", "said"])
    p, r = share(F.col("tp"), F.col("said")), share(F.col("tp"), F.col("support"))
    return x.select("name", "support", p.alias("precision"), r.alias("recall"), share(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"))


def calibration(df: DataFrame, confidence: str, correct: str, bins: int = 5, closed: bool = True) -> DataFrame:
    """(bin, confidence_min, confidence_max, predictions, correct, accuracy) of equal-width bins, empty ones kept.

    closed: confidence 1 belongs to the last bin; otherwise to none. Null confidences belong to none.
    """
    number = F.floor(F.round(F.col(confidence) * bins, 9)).cast("int")
    number = F.least(number, F.lit(bins - 1)) if closed else number
    counts = df.where(F.col(confidence).between(0, 1)).groupBy(number.alias("bin")).agg(F.count("*").alias("predictions"), F.count_if(F.col(correct)).alias("correct"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    x = every.join(counts, "bin", "left").na.fill(0, ["predictions", "correct"])
    return x.select("bin", (F.col("bin") / bins).alias("confidence_min"), ((F.col("bin") + 1) / bins).alias("confidence_max"), "predictions", "correct", share(F.col("correct"), F.col("predictions")).alias("accuracy"))


def triage(df: DataFrame, confidence: str, predicted: str, actual: str, high: float = 0.7) -> DataFrame:
    """(bucket, n, accuracy, false_negatives, false_positives): sure and flagged, sure and approved, or left to a person."""
    sure = F.coalesce(F.col(confidence), F.lit(0.0)) >= high
    p, a = (F.coalesce(F.col(c), F.lit(False)) for c in (predicted, actual))
    bucket = F.when(~sure, "human_review").when(p, "auto_flag").otherwise("auto_approve")
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(p == a).alias("right"), F.count_if(a & ~p).alias("false_negatives"), F.count_if(~a & p).alias("false_positives"))
    every = df.sparkSession.createDataFrame([("auto_flag",), ("auto_approve",), ("human_review",)], "bucket string")
    x = every.join(counts, "bucket", "left").na.fill(0)
    return x.select("bucket", "n", share(F.col("right"), F.col("n")).alias("accuracy"), "false_negatives", "false_positives")


def by_label(df: DataFrame, label: str, correct: str) -> DataFrame:
    """(bucket, n, correct, accuracy) by a stated confidence in words: lower case, hyphens as underscores; only buckets with rows."""
    bucket = F.replace(F.lower(F.trim(label)), F.lit("-"), F.lit("_"))
    x = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col(correct)).alias("correct"))
    return x.withColumn("accuracy", F.round(share(F.col("correct"), F.col("n")), 6))


def grouped(matrix: DataFrame, groups: dict[str, str], other: str) -> DataFrame:
    """(name, support, answered, accuracy, accuracy_answered) of a confusion matrix by groups of classes; NONE is in no group.

    Two denominators: all rows of the group, and those that have a prediction.
    """
    names = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    group = lambda c: F.when(F.col(c) != "NONE", F.coalesce(F.try_element_at(names, F.lower(c)), F.lit(other)))
    x = matrix.withColumns({"name": group("actual"), "said": group("predicted")})
    right = F.sum(F.when(F.col("name") == F.col("said"), F.col("n")).otherwise(0))
    x = x.groupBy("name").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("said").isNotNull(), F.col("n")).otherwise(0)).alias("answered"), right.alias("right"))
    return x.select("name", "support", "answered", share(F.col("right"), F.col("support")).alias("accuracy"), share(F.col("right"), F.col("answered")).alias("accuracy_answered"))


def top_confusions(matrix: DataFrame, k: int) -> DataFrame:
    """The k most frequent wrong predictions, NONE left out; a report of the top k."""
    wrong = matrix.where((F.col("actual") != F.col("predicted")) & (F.col("predicted") != "NONE")).orderBy(F.desc("n"), "actual", "predicted").limit(k)
    return wrong.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "actual", "predicted")))


def elbow(subsets: DataFrame, metric: str, cost: str, name: str) -> DataFrame:
    """The subset with the best metric for its cost; of equal ones the least name."""
    return subsets.orderBy(F.desc(F.try_divide(F.col(metric), F.col(cost))), name).limit(1)


def quality(df: DataFrame, score: str, by: str, passes: float = 3.5) -> DataFrame:
    """(by, n, score, passed, pass_rate): mean score and share that passes; a missing score counts 0."""
    s = F.coalesce(F.col(score), F.lit(0.0))
    x = df.groupBy(by).agg(F.count("*").alias("n"), F.avg(s).alias(score), F.count_if(s >= passes).alias("passed"))
    return x.withColumn("pass_rate", share(F.col("passed"), F.col("n")))


def accuracy_by(df: DataFrame, correct: str, category: str, overall: str = "(all)") -> DataFrame:
    """(category, total, correct, accuracy) by category and over all, in one pass."""
    c = F.when(F.grouping(category) == 1, overall).otherwise(F.coalesce(F.col(category), F.lit("unknown")))
    x = df.rollup(category).agg(F.count("*").alias("total"), F.count_if(F.col(correct)).alias("right"), c.alias("label"))
    return x.select(F.col("label").alias("category"), "total", F.col("right").alias("correct"), share(F.col("right"), F.col("total")).alias("accuracy"))
