"""Queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import addresses, bpe, consensus, groups, leak, names, pairs, stuffing
from millrace.storage import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "batch_results"), table(spark, d, "eval_questions"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.sample_labels(table(spark, d, "ensemble_results"))


def p2_annotators(spark: SparkSession, d: str) -> DataFrame:
    votes = consensus.votes_of(table(spark, d, "ensemble_results"))
    return consensus.reweighted_votes(votes).annotators.select("annotator", "n_votes", *(F.round(c, 6).alias(c) for c in ("hit_rate", "reject_rate", "reliability")))


def p2_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.agreement(consensus.votes_of(table(spark, d, "ensemble_results")))


def p2_samples(spark: SparkSession, d: str) -> DataFrame:
    return consensus.sample_agreement(table(spark, d, "ensemble_results"))


P2_AGREEMENT = """
with v as (
  select sample_id, prompt_id, arg_max(has_bug, (coalesce(updated_at, loaded_at), loaded_at, has_bug)) as vote
  from (select sample_id, updated_at, loaded_at, unnest(map_keys(prompt_results)) as prompt_id, unnest(map_values(prompt_results)).has_bug as has_bug from ensemble_results)
  where sample_id is not null and has_bug is not null group by 1, 2),
per as (select sample_id, count(*) as m, sum(vote::int) as y from v group by 1 having count(*) > 1),
s as (select count(*) as n_items, sum(m)::bigint as n, sum(y)::bigint as y, sum(2 * y * (m - y) / (m - 1)::double) as o from per)
select n_items, n as n_votes, round(o / n, 9) as observed, round(2 * y * (n - y) / (n * (n - 1))::double, 9) as expected,
  round(1 - (o / n) / (2 * y * (n - y) / (n * (n - 1))::double), 9) as alpha from s
"""


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.linked_records(table(spark, d, "company_records"), table(spark, d, "match_pairs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.match_groups(table(spark, d, "match_pairs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return addresses.same_place(table(spark, d, "receipt_extractions"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.token_ids(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(table(spark, d, "documents"), table(spark, d, "heldout_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p2_found": p2_found,
        "p2_annotators": p2_annotators,
        "p2_agreement": p2_agreement,
        "p2_samples": p2_samples,
        "p3_found": p3_found,
        "p4_found": p4_found,
        "p5_found": p5_found,
        "p6_ids": p6_ids,
        "p7_found": p7_found,
        "p8_found": p8_found,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p2_agreement": P2_AGREEMENT,
    }
