"""Consensus from several annotators' labels: iteratively reweighted voting.

A vote weighs as the log-odds that its annotator's accuracy gives it, kept apart for the two labels, since an annotator may
be careless with one label only, or be wrong more often than right. Accuracies are estimated against the consensus of the
*other* annotators (leave-one-out) and smoothed; weights and consensus alternate until no accuracy moves any more.

Votes are laid out by item once. A round is one pass: the annotators' weights join (a small table, broadcast only as its size
allows), a window over the item sums them, and partial sums by annotator are all that is shuffled. The laid out votes are held only
until the items' result is written; a lost executor's part is computed again.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import stage

#: Added right and wrong votes of an annotator on each label.
RIGHT, WRONG = 1.5, 1.0
TOLERANCE, MOST_ROUNDS = 1e-3, 40
#: Most annotators whose weights are sent to every task; with more, the votes are joined with them by shuffling.
MOST_BROADCAST_ROWS = 200_000


@dataclass
class Consensus:
    """items: (item, p_true, n_votes, agreement); annotators: (annotator, n_votes, hit_rate, reject_rate, reliability).

    converged: whether the accuracies came to rest within the rounds allowed; if not, a warning is given as well.
    """

    items: DataFrame
    annotators: DataFrame
    rounds: int
    converged: bool


def votes_of(results: DataFrame) -> DataFrame:
    """(item, annotator, vote) of ensemble_results: one vote of a reviewer on a sample, from its latest row.

    Null verdicts, null structs and null maps give none. Repeated rows count once; of rows with equal times, a bug verdict stays.
    """
    r = results.select(F.col("sample_id").alias("item"), "updated_at", "loaded_at", F.explode("prompt_results").alias("annotator", "verdict"))
    r = r.select("item", "annotator", F.col("verdict.has_bug").alias("vote"), F.struct(F.coalesce("updated_at", "loaded_at"), "loaded_at", F.col("verdict.has_bug")).alias("at"))
    return r.where("item is not null and vote is not null").groupBy("item", "annotator").agg(F.max_by("vote", "at").alias("vote"))


def reweighted_votes(votes: DataFrame, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> Consensus:
    """votes: (item, annotator, vote boolean), at most one row an item and annotator. No votes give empty tables."""
    spark = votes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = Window.partitionBy("item")
    laid = votes.select("item", "annotator", F.col("vote").cast("int").alias("v")).repartition(n, "item")
    laid = laid.withColumn("m", F.count("*").over(own)).withColumn("yes", F.sum("v").over(own)).persist(StorageLevel.MEMORY_AND_DISK)
    # at first, the share of the others' votes; an item with a single vote says nothing about it
    rest = F.when(F.col("m") > 1, (F.col("yes") - F.col("v")) / (F.col("m") - 1)).otherwise(0.5)

    def rates(rows: DataFrame) -> DataFrame:
        """rows: item, annotator, v, m, others (P(true) by the other votes), p (by all)."""
        sums = rows.groupBy("annotator").agg(
            F.count("*").alias("n_votes"),
            F.sum("others").alias("t"),
            F.sum(F.col("others") * F.col("v")).alias("tv"),
            F.sum((1 - F.col("others")) * (1 - F.col("v"))).alias("fv"),
            F.sum(F.col("p") / F.col("m")).alias("p_items"),
            F.sum(1 / F.col("m")).alias("items"),
        )
        f = F.col("n_votes") - F.col("t")
        every = Window.partitionBy()  # over the sums: one row an annotator
        return sums.select(
            "annotator",
            "n_votes",
            ((F.col("tv") + RIGHT) / (F.col("t") + RIGHT + WRONG)).alias("hit"),
            ((F.col("fv") + RIGHT) / (f + RIGHT + WRONG)).alias("reject"),
            ((F.sum("p_items").over(every) + 1) / (F.sum("items").over(every) + 2)).alias("prior"),
        )

    def scored(w: DataFrame) -> DataFrame:
        rows = laid.join(F.broadcast(w.drop("n_votes")) if few else w.drop("n_votes"), "annotator")
        c = F.when(F.col("v") == 1, F.log(F.col("hit") / (1 - F.col("reject")))).otherwise(F.log((1 - F.col("hit")) / F.col("reject")))
        rows = rows.withColumn("c", c).withColumn("all", F.sum("c").over(own) + F.log(F.col("prior") / (1 - F.col("prior"))))
        p = lambda x: 1 / (1 + F.exp(-x))
        return rows.select("item", "annotator", "v", "m", "yes", p(F.col("all") - F.col("c")).alias("others"), p(F.col("all")).alias("p"))

    w = stage(rates(laid.withColumn("others", rest).withColumn("p", F.col("yes") / F.col("m"))).coalesce(1), "weights")
    few = w.count() <= MOST_BROADCAST_ROWS
    rounds, converged = 0, False
    while rounds < most_rounds and not converged:
        rounds += 1
        new = stage(rates(scored(w)).coalesce(1), "weights")
        moved = new.join(w.select("annotator", F.col("hit").alias("h"), F.col("reject").alias("r")), "annotator").agg(F.max(F.greatest(F.abs(F.col("hit") - F.col("h")), F.abs(F.col("reject") - F.col("r"))))).first()[0]
        w = new
        converged = moved is None or moved < tolerance
    if not converged:
        warnings.warn(f"accuracies still moved by {moved} after {rounds} rounds", RuntimeWarning, stacklevel=2)
    m, yes = F.col("m"), F.col("yes")
    pairs = F.when(m > 1, (yes * (yes - 1) + (m - yes) * (m - yes - 1)) / (m * (m - 1)))
    items = scored(w).groupBy("item").agg(F.first("p").alias("p_true"), F.first("m").alias("m"), F.first("yes").alias("yes"))
    items = stage(items.select("item", "p_true", m.alias("n_votes"), pairs.alias("agreement")), "consensus")
    laid.unpersist()
    reliability = (F.col("hit") + F.col("reject")) / 2
    return Consensus(items, w.select("annotator", "n_votes", F.col("hit").alias("hit_rate"), F.col("reject").alias("reject_rate"), reliability.alias("reliability")), rounds, converged)


def agreement(votes: DataFrame) -> DataFrame:
    """One row: Krippendorff's alpha for two labels and missing ratings, over items with two votes or more.

    (n_items, n_votes, observed, expected, alpha); alpha is null if no item has two votes, or all votes are the same.
    """
    per = votes.groupBy("item").agg(F.count("*").alias("m"), F.sum(F.col("vote").cast("long")).alias("y")).where("m > 1")
    s = per.agg(F.count("*").alias("n_items"), F.sum("m").alias("n"), F.sum("y").alias("y"), F.sum(2 * F.col("y") * (F.col("m") - F.col("y")) / (F.col("m") - 1)).alias("o"))
    observed = F.try_divide("o", "n")
    expected = F.try_divide(2 * F.col("y") * (F.col("n") - F.col("y")), F.col("n") * (F.col("n") - 1))
    return s.select("n_items", F.coalesce("n", F.lit(0)).alias("n_votes"), F.round(observed, 9).alias("observed"), F.round(expected, 9).alias("expected"), F.round(1 - F.try_divide(observed, expected), 9).alias("alpha"))


def sample_labels(results: DataFrame, consensus: Consensus | None = None) -> DataFrame:
    """(sample_id, label): bug or no_bug for every distinct non-null sample_id.

    A sample without any verdict takes the majority of its latest counters; a tie, or none, is no_bug.
    """
    c = consensus or reweighted_votes(votes_of(results))
    counted = results.where("sample_id is not null").groupBy("sample_id").agg(F.max_by(F.coalesce("votes_bug", F.lit(0)) > F.coalesce("votes_no_bug", F.lit(0)), F.struct("updated_at", "loaded_at", "votes_bug", "votes_no_bug")).alias("more"))
    both = counted.join(c.items.select(F.col("item").alias("sample_id"), "p_true"), "sample_id", "left")
    return both.select("sample_id", F.when(F.coalesce(F.col("p_true") > 0.5, F.col("more"), F.lit(False)), "bug").otherwise("no_bug").alias("label"))


def sample_agreement(results: DataFrame, consensus: Consensus | None = None) -> DataFrame:
    """(sample_id, p_bug, n_votes, agreement, stated_confidence) of every sample with a verdict.

    agreement: the share of pairs of votes that agree, null for a single vote; stated_confidence: that of the sample's latest row that has one.
    """
    c = consensus or reweighted_votes(votes_of(results))
    there = F.when(F.col("confidence").isNotNull(), F.struct("updated_at", "loaded_at", "confidence"))
    stated = results.where("sample_id is not null").groupBy("sample_id").agg(F.max_by("confidence", there).alias("stated_confidence"))
    items = c.items.select(F.col("item").alias("sample_id"), F.round("p_true", 6).alias("p_bug"), "n_votes", F.round("agreement", 6).alias("agreement"))
    return items.join(stated, "sample_id", "left")
