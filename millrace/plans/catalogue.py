"""Every query over the given tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import code
from millrace.functions import text as T
from millrace.operators import entities, metrics, ordinals, requests, trees, vectors, voting
from millrace.operators.metrics import share
from millrace.storage import table
from millrace.streaming import rounds

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(c):
    return F.round(c, 6)


# --- names and entities ---------------------------------------------------------------------------------------------------

#: White space as the engine's Unicode classes have it; Python writes the characters into the SQL.
_SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _sql_endings(c: str) -> str:
    c = f"trim(lower({c}), '{_SPACE}')"
    endings = ", ".join(f"'{e}'" for e in T.NAME_ENDINGS)
    cut = f"list_reduce(list_prepend({c}, [{endings}]), lambda n, e: case when ends_with(n, e) then left(n, length(n) - length(e)) else n end)"
    return f"trim(regexp_replace(translate({cut}, '-,.', ' '), '[{_SPACE}]+', ' ', 'g'))"


def _sql_tokens(c: str) -> str:
    stop = ", ".join(f"'{t}'" for t in T.STOP_TOKENS)
    return f"list_filter(regexp_split_to_array(lower({c}), '[\\s.,/&()-]+'), lambda t: t <> '' and not list_contains([{stop}], t))"


@query(
    f"""with n as (select distinct id, lower(trim(name, ' \t\n\r' || chr(160))) as name from company_records)
    select distinct id, name as lower_name from n"""
)
def company_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "company_records").select("id", F.lower(F.regexp_replace("name", "^[ \\t\\n\\r\\u00a0]+|[ \\t\\n\\r\\u00a0]+$", "")).alias("lower_name")).distinct()


def _pairs_sql(source: str) -> str:
    return f"""n as (select distinct name from {source} where name is not null),
t as (select name, {_sql_tokens("name")} as toks from n),
k as (select name, list_distinct(toks) as toks, list_aggregate(toks, 'string_agg', ' ') as clean from t where len(toks) > 0),
x as (select name, clean, unnest(toks) as tok from k),
p as (select distinct a.name as name_a, b.name as name_b from x a join x b on a.tok = b.tok and a.name < b.name),
j as (select name_a, name_b, a.clean as ca, b.clean as cb, len(list_intersect(a.toks, b.toks)) as s, len(a.toks) as m, len(b.toks) as n
      from p join k a on a.name = name_a join k b on b.name = name_b),
g as (select *, s / (m + n - s)::double as jac from j),
f as (select * from g where jac >= 0.25 and 60.0 * 2 * least(length(ca), length(cb)) / (length(ca) + length(cb)) + 40 * jac + 1 >= 70),
l as (select *, list_last(list_reduce(list_prepend([x * 0 for x in range(length(cb) + 1)], [[unicode(c)::bigint] for c in string_split(ca, '')]),
      lambda acc, c: list_reduce(list_prepend([0::bigint], [[i] for i in range(1, length(cb) + 1)]),
        lambda row, i: list_append(row, case when unicode(cb[i[1]]) = c[1] then acc[i[1]] + 1 else greatest(acc[i[1] + 1], list_last(row)) end)))) as lcs from f),
s2 as (select *, round(200.0 * lcs / (length(ca) + length(cb)))::int as fuzzy from l),
s3 as (select *, trunc(0.6::double * fuzzy + 0.4::double * 100 * jac)::int as score from s2),
scored as (select name_a, name_b, fuzzy, score, case when score >= 95 then 'auto' else 'candidate' end as band from s3 where score >= 70)"""


@query(f"with {_pairs_sql('company_records')} select * from scored")
def dedup_candidates(spark: SparkSession, d: str) -> DataFrame:
    return entities.scored_pairs(table(spark, d, "company_records"))


@query(
    """with r as (select distinct id, name, origin from company_records where id is not null),
    dup as (select distinct greatest(record_a, record_b) as id from match_pairs where lower(trim(confidence)) = 'auto' and record_a <> record_b)
    select origin, count(*) as records, count(distinct name) as names from r where id not in (select id from dup) group by origin"""
)
def dedup_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Records that no automatic pair names as its later end, by origin."""
    r = table(spark, d, "company_records").select("id", "name", "origin").where("id is not null").distinct()
    auto = table(spark, d, "match_pairs").where((F.lower(F.trim("confidence")) == "auto") & (F.col("record_a") != F.col("record_b")))
    dup = auto.select(F.greatest("record_a", "record_b").alias("id")).distinct()
    return r.join(dup, "id", "left_anti").groupBy("origin").agg(F.count("*").alias("records"), F.count_distinct("name").alias("names"))


@query(
    f"""with r as (select id, min(name) as name, min(origin) as origin from company_records where id is not null group by 1), {_pairs_sql('r')},
    c as (select origin as value, count(*) as n from r where origin <> '' and not exists (select 1 from scored where band = 'auto' and name_b = r.name) group by 1)
    select value, n, round(n / sum(n) over (), 6) as share from c"""
)
def company_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Names, scored pairs, later names of automatic pairs dropped, and the distribution of what is left over its origins.

    Only automatic pairs decide, so only these are looked for.
    """
    records = table(spark, d, "company_records").where("id is not null").groupBy("id").agg(F.min("name").alias("name"), F.min("origin").alias("origin"))
    dup = entities.scored_pairs(records, threshold=entities.AUTOMATIC).where("band = 'auto'").select(F.col("name_b").alias("name")).distinct()
    return voting.shares(records.join(dup, "name", "left_anti"), "origin").select("value", "n", r6("share").alias("share"))


@query(
    """with c as (select origin as value, count(*) as n from company_records where origin <> '' group by 1)
    select value, n, round(n / sum(n) over (), 6) as share from c"""
)
def origin_shares(spark: SparkSession, d: str) -> DataFrame:
    return voting.shares(table(spark, d, "company_records"), "origin").select("value", "n", r6("share").alias("share"))


@query(
    f"""with m as (select *, {_sql_endings("name")} as canonical from (select distinct * from company_records where name is not null))
    select canonical, list_sort(list(distinct name)) as variants, count(*) as mention_count,
      arg_min(ticker, (created_at, id, ticker)) filter (where ticker <> '') as ticker, arg_max(exchange, (created_at, id, exchange)) filter (where exchange <> '') as exchange,
      list_slice(list_sort(list(distinct origin) filter (where origin <> '')), 1, 10) as origins
    from m where canonical <> '' group by 1"""
)
def cluster_merge(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "company_records").where("name is not null").distinct().withColumn("at", F.struct("created_at", "id"))
    return entities.merged_clusters(r, "name", "at", {"ticker": "ticker"}, {"exchange": "exchange"}, {"origins": "origin"})


@query(
    f"""with w as (select distinct id, unnest(list_append(coalesce(aliases, []), name)) as form from ref_companies),
    f as (select distinct id, {_sql_endings("form")} as form from w),
    s as (select distinct {_sql_endings("name")} as seen from (select name_a as name from match_pairs union all select name_b from match_pairs) where name is not null),
    h as (select distinct id from f join s on form = seen or (length(form) >= 4 and length(seen) >= 4 and (contains(seen, form) or contains(form, seen))) where form <> '' and seen <> '')
    select id, id in (select id from h) as found from (select distinct id from ref_companies)"""
)
def reference_recall(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "match_pairs")
    names = p.select(F.explode(F.array("name_a", "name_b")).alias("name")).where("name is not null")
    return entities.found_in(table(spark, d, "ref_companies"), names)


@query(
    f"""with m as (select {_sql_endings("name")} as norm, count(distinct name) as spellings, count(distinct id) as records
      from company_records where name is not null group by 1)
    select norm, spellings, records from m where spellings > 1"""
)
def duplicate_clusters(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "company_records").where("name is not null")
    x = r.groupBy(T.strip_company_endings("name").alias("norm")).agg(F.count_distinct("name").alias("spellings"), F.count_distinct("id").alias("records"))
    return x.where("spellings > 1")


# --- requests and results -------------------------------------------------------------------------------------------------


@query(
    """with q as (select id, min(question) as question, min(category) as category from eval_questions group by id)
    select id, 'eval-' || id as custom_id, concat_ws(chr(10), case when category <> '' then 'Category: ' || category end, case when question <> '' then 'Question: ' || question end) as prompt,
      length(question) as n_chars from q"""
)
def request_lines(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "eval_questions").groupBy("id").agg(F.min("question").alias("question"), F.min("category").alias("category"))
    prompt = requests.labelled_lines(Category=F.col("category"), Question=F.col("question"))
    line = requests.chat_request(F.concat(F.lit("eval-"), "id"), prompt, "Answer the question.")
    body = F.from_json(line, "custom_id string, body struct<messages: array<struct<role: string, content: string>>>")
    return q.select("id", body["custom_id"].alias("custom_id"), F.get(body["body"]["messages"], F.lit(1))["content"].alias("prompt"), F.length("question").alias("n_chars"))


@query("select doc_id, row_number() over (order by doc_id) - 1 as ord, ((row_number() over (order by doc_id) - 1) // 500)::bigint as chunk from documents")
def request_chunks(spark: SparkSession, d: str) -> DataFrame:
    return ordinals.in_chunks(table(spark, d, "documents").select("doc_id"), 500, "doc_id")


@query(
    """select custom_id, arg_max(result_id, (finished_at, result_id)) as result_id, arg_max(model, (finished_at, result_id, model)) as model
    from batch_results where custom_id is not null group by 1"""
)
def results_last_wins(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "batch_results").select("custom_id", "result_id", "model", "finished_at")
    return ordinals.last_wins(r, "custom_id", "finished_at", "result_id", "model").select("custom_id", "result_id", "model")


@query(
    """select model, count(*) as requests, sum(coalesce(response.body.usage.prompt_tokens, 0))::bigint as prompt_tokens,
    sum(coalesce(response.body.usage.completion_tokens, 0))::bigint as completion_tokens from batch_results group by rollup (model)"""
)
def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    return requests.usage(table(spark, d, "batch_results"), "model")


_STATUS = "case when error is not null then 'error' when coalesce(len(response.body.choices), 0) < 1 then 'no_choices' when coalesce(response.body.choices[1].message.content, '') = '' then 'empty' else 'ok' end"


@query(f"select model, {_STATUS} as status, count(*) as n from batch_results group by 1, 2")
def response_status(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "batch_results").groupBy("model", requests.status().alias("status")).agg(F.count("*").alias("n"))


_N = r"-?\d+(?:,\d{3})*(?:\.\d+)?(?:[eE][+-]?\d+)?"


def _sql_clean(c: str) -> str:
    return rf"nullif(regexp_extract(replace(regexp_replace(trim(regexp_replace({c}, '[*$\\{{}}]', '', 'g'), chr(32)||chr(9)||chr(10)||chr(13)), '\.+$', ''), ',', ''), '-?\d+(?:\d{{3}})*(?:\.\d+)?(?:[eE][+-]?\d+)?'), '')"


_ANSWER = "coalesce(" + ", ".join(
    [
        _sql_clean(r"list_extract(regexp_extract_all(content, '(?i)ANSWER:\s*(.+?)(?:\n|$)', 1), -1)"),
        _sql_clean(r"regexp_extract(content, '\\boxed\{([^}]+)\}', 1)"),
        _sql_clean(rf"regexp_extract(content, '(?i)(?:the\s+)?answer\s+is\s*:?\s*({_N})', 1)"),
        _sql_clean(rf"regexp_extract(content, '(?i)(?:final\s+)?answer\s*[:=]\s*({_N})', 1)"),
        _sql_clean(rf"regexp_extract(content, '(?m)=\s*({_N})\s*$', 1)"),
    ]
) + ")"
_JOINED = """q as (select id, min(question) as question, min(answer) as answer, lower(min(category)) as category from eval_questions where id is not null group by id),
  r as (select result_id, custom_id, model, response.body.choices[1].message.content as content from (select distinct * from batch_results where error is null))"""


@query(f"with {_JOINED} select result_id, {_ANSWER} as answer from r")
def answer_extract(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "batch_results").where("error is null").distinct().withColumn("content", requests.content())
    return r.select("result_id", T.model_answer("content").alias("answer"))


@query(
    f"""with {_JOINED}, a as (select q.category, r.content is not null as there, {_ANSWER} as given, q.answer as gold from r join q on r.custom_id = q.id),
    s as (select category, coalesce(lower(replace(given, ',', '')) = lower(replace(gold, ',', '')) or coalesce(abs(try_cast(given as double) - try_cast(replace(gold, ',', '') as double)) < 1e-6, false), false) as ok from a where there)
    select case when grouping(category) = 1 then '(all)' else coalesce(category, 'unknown') end as category, count(*) as total, count(*) filter (where ok) as correct,
      round(count(*) filter (where ok) / count(*)::double, 6) as accuracy from s group by rollup (category)"""
)
def accuracy_by_category(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "eval_questions").where("id is not null").groupBy(F.col("id").alias("custom_id")).agg(F.min("answer").alias("gold"), F.lower(F.min("category")).alias("category"))
    r = table(spark, d, "batch_results").where("error is null").distinct().select("custom_id", requests.content().alias("content")).where("content is not null")
    x = r.join(q, "custom_id").select("category", T.same_answer(T.model_answer("content"), "gold").alias("ok"))
    return metrics.accuracy_by(x, "ok", "category").withColumn("accuracy", r6("accuracy"))


@query(
    r"""with c as (select result_id, trim(response.body.choices[1].message.content, chr(32)||chr(9)||chr(10)||chr(13)) as s from (select distinct * from batch_results) where response.body.choices[1].message.content is not null),
    f as (select result_id, [s, trim(regexp_extract(s, '(?s)```(?:json)?\s*\n?(.*?)```', 1), chr(32)||chr(9)||chr(10)||chr(13)), regexp_extract(s, '(?s)\{.*\}'), regexp_extract(s, '(?s)\[.*\]')] as forms from c),
    g as (select result_id, list_filter(forms, lambda x: (starts_with(x, '{') or starts_with(x, '[')) and json_valid(x))[1] as found from f)
    select result_id, json_extract_string(found, '$.answer') as answer, json_extract_string(found, '$.confidence') as confidence from g where found is not null"""
)
def json_cascade(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "batch_results").distinct().select("result_id", T.json_text(requests.content()).alias("found")).where("found is not null")
    return r.select("result_id", F.get_json_object("found", "$.answer").alias("answer"), F.get_json_object("found", "$.confidence").alias("confidence"))


@query(
    r"""with c as (select result_id, response.body.choices[1].message.content as s from (select distinct * from batch_results) where regexp_matches(response.body.choices[1].message.content, '^1\. ')),
    p as (select result_id, list_filter(list_transform(regexp_split_to_array(chr(10) || s, '\n\s*\d+\.\s+'), lambda x: trim(x, chr(32)||chr(9)||chr(10)||chr(13))), lambda x: x <> '') as parts from c)
    select result_id, list_slice(list_concat(parts, ['', '', '']), 1, 3) as parts from p"""
)
def numbered_split(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "batch_results").distinct().select("result_id", requests.content().alias("s")).where(F.col("s").rlike(r"^1\. "))
    return r.select("result_id", T.numbered_parts("s", 3).alias("parts"))


@query(
    f"""with {_JOINED}, x as (select min(content) as answer, custom_id, min(question) as question from r join q on r.custom_id = q.id where content <> '' and question <> '' group by custom_id)
    select custom_id, ['system: Answer the question.', 'user: ' || question, 'assistant: ' || answer] as messages from x"""
)
def training_export(spark: SparkSession, d: str) -> DataFrame:
    """Conversations for training: the least non-empty answer of each question, with a system row in front."""
    q = table(spark, d, "eval_questions").where("id is not null").groupBy(F.col("id").alias("custom_id")).agg(F.min("question").alias("question"))
    r = table(spark, d, "batch_results").where("error is null").select("custom_id", requests.content().alias("answer")).where("answer <> ''")
    x = r.groupBy("custom_id").agg(F.min("answer").alias("answer")).join(q.where("question <> ''"), "custom_id")
    row = lambda role, c: F.concat(F.lit(f"{role}: "), c)
    return x.select("custom_id", F.array(row("system", F.lit("Answer the question.")), row("user", F.col("question")), row("assistant", F.col("answer"))).alias("messages"))


# --- reviewers and metrics ------------------------------------------------------------------------------------------------

_VOTES = """l as (select sample_id, arg_max(prompt_results, (updated_at, total_votes, cardinality(prompt_results))) as m, max(updated_at) as at from ensemble_results where sample_id is not null group by 1),
  v as (select sample_id, prompt_id, s.has_bug as has_bug, s.severity as severity from (select sample_id, unnest(map_keys(m)) as prompt_id, unnest(map_values(m)) as s from l)),
  e as (select sample_id, count(*) filter (where has_bug) as votes_bug, count(*) filter (where not has_bug) as votes_no_bug from v group by 1),
  p as (select *, votes_bug + votes_no_bug as total_votes, coalesce(votes_bug / nullif(votes_bug + votes_no_bug, 0)::double, 0) as vote_ratio from e),
  z as (select *, case when total_votes > 0 then abs(vote_ratio - 0.5) * 2 else 0 end as confidence, total_votes > 0 and vote_ratio >= 0.5 as predicted, vote_ratio > 0.3 and vote_ratio < 0.7 as is_split from p),
  t as (select sample_id, arg_max(predicted_has_bug, (updated_at, total_votes, predicted_has_bug)) as actual from ensemble_results where sample_id is not null group by 1)"""


def _votes(spark: SparkSession, d: str) -> DataFrame:
    return voting.reviewer_votes(table(spark, d, "ensemble_results"))


def _stated(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "ensemble_results").where("sample_id is not null")
    return r.groupBy("sample_id").agg(F.max_by("predicted_has_bug", F.struct("updated_at", "total_votes", "predicted_has_bug")).alias("actual"))


@query(f"with {_VOTES} select sample_id, votes_bug, votes_no_bug, total_votes, round(vote_ratio, 6) as vote_ratio, round(confidence, 6) as confidence, predicted, is_split from z")
def ensemble_votes(spark: SparkSession, d: str) -> DataFrame:
    return voting.ensemble(_votes(spark, d), "sample_id").withColumns({"vote_ratio": r6("vote_ratio"), "confidence": r6("confidence")})


@query(
    f"with {_VOTES} select is_split, count(*) as n, round(count(*) filter (where predicted = coalesce(actual, false)) / count(*)::double, 6) as accuracy from z join t using (sample_id) group by 1"
)
def vote_splits(spark: SparkSession, d: str) -> DataFrame:
    x = voting.ensemble(_votes(spark, d), "sample_id").join(_stated(spark, d), "sample_id")
    ok = F.col("predicted") == F.coalesce("actual", F.lit(False))
    return x.groupBy("is_split").agg(F.count("*").alias("n"), r6(share(F.count_if(ok), F.count("*"))).alias("accuracy"))


_PRF = """round(coalesce(tp / nullif(tp + fp, 0)::double, 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0)::double, 0), 6) as recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0), 6) as f1, round(coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0)::double, 0), 6) as accuracy"""
_COUNTS = """count(*) filter (where coalesce(said, false) and coalesce(actual, false)) as tp, count(*) filter (where coalesce(said, false) and not coalesce(actual, false)) as fp,
  count(*) filter (where not coalesce(said, false) and not coalesce(actual, false)) as tn, count(*) filter (where not coalesce(said, false) and coalesce(actual, false)) as fn"""


@query(f"with {_VOTES}, c as (select prompt_id, {_COUNTS} from (select prompt_id, has_bug as said, actual from v join t using (sample_id)) group by 1) select prompt_id, tp, fp, tn, fn, {_PRF} from c")
def binary_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Each reviewer's verdicts against the stated label of the sample."""
    x = metrics.binary(_votes(spark, d).join(_stated(spark, d), "sample_id"), "has_bug", "actual", "prompt_id")
    return x.withColumns({c: r6(c) for c in ("precision", "recall", "f1", "accuracy")})


@query(
    f"""with {_VOTES}, w as (select category, sample_id, count(*) filter (where has_bug) as b, count(*) filter (where not has_bug) as n from v join review_prompts using (prompt_id) group by 1, 2),
    s as (select category, coalesce(b / nullif(b + n, 0)::double, 0) >= 0.5 and b + n > 0 as said, actual from w join t using (sample_id)),
    c as (select category, {_COUNTS} from s group by 1), k as (select category, count(*) as prompts from review_prompts group by 1)
    select category, prompts, round(prompts / sum(prompts) over (), 6) as cost_fraction, tp, fp, tn, fn, {_PRF} from c join k using (category)"""
)
def prompt_subsets(spark: SparkSession, d: str) -> DataFrame:
    """What each category of reviewers would say alone, and at which share of all reviewers."""
    prompts = table(spark, d, "review_prompts")
    x = voting.ensemble(_votes(spark, d).join(prompts, "prompt_id"), "category", "sample_id").join(_stated(spark, d), "sample_id")
    size = prompts.groupBy("category").agg(F.count("*").alias("prompts")).withColumn("cost_fraction", r6(F.col("prompts") / F.sum("prompts").over(Window.partitionBy())))
    out = metrics.binary(x, "predicted", "actual", "category").join(size, "category")
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "f1", "accuracy")})


@query(
    f"""with {_VOTES}, b as (select least(floor(round(confidence * 5, 9)), 4)::int as bin, count(*) as predictions, count(*) filter (where predicted = coalesce(actual, false)) as correct from z join t using (sample_id) group by 1)
    select i::int as bin, i / 5.0::double as confidence_min, (i + 1) / 5.0::double as confidence_max, coalesce(predictions, 0) as predictions, coalesce(correct, 0) as correct, round(coalesce(correct / nullif(predictions, 0)::double, 0), 6) as accuracy
    from range(5) r(i) left join b on b.bin = i"""
)
def calibration(spark: SparkSession, d: str) -> DataFrame:
    x = voting.ensemble(_votes(spark, d), "sample_id").join(_stated(spark, d), "sample_id").withColumn("ok", F.col("predicted") == F.coalesce("actual", F.lit(False)))
    return metrics.calibration(x, "confidence", "ok").withColumn("accuracy", r6("accuracy"))


@query(
    f"""with {_VOTES}, b as (select case when confidence < 0.7 then 'human_review' when predicted then 'auto_flag' else 'auto_approve' end as bucket, predicted as said, coalesce(actual, false) as actual from z join t using (sample_id))
    select k.bucket, count(said) as n, round(coalesce(count(*) filter (where said = actual) / nullif(count(said), 0)::double, 0), 6) as accuracy, count(*) filter (where actual and not said) as false_negatives, count(*) filter (where said and not actual) as false_positives
    from (values ('auto_flag'), ('auto_approve'), ('human_review')) k(bucket) left join b using (bucket) group by 1"""
)
def triage(spark: SparkSession, d: str) -> DataFrame:
    x = voting.ensemble(_votes(spark, d), "sample_id").join(_stated(spark, d), "sample_id")
    return metrics.triage(x, "confidence", "predicted", "actual").withColumn("accuracy", r6("accuracy"))


@query(
    """select f.bug_type as bug_type, count(*) as findings, count(distinct sample_id) as samples, count(distinct f.prompt_id) as reviewers
    from (select sample_id, unnest(findings) as f from (select distinct * from ensemble_results)) group by 1"""
)
def findings_by_type(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "ensemble_results").select("sample_id", "updated_at", "loaded_at", "votes_bug", "votes_no_bug", "total_votes", "confidence", "predicted_has_bug", "language", "findings").distinct()
    x = x.select("sample_id", F.explode("findings").alias("f"))
    return x.groupBy(F.col("f.bug_type").alias("bug_type")).agg(F.count("*").alias("findings"), F.count_distinct("sample_id").alias("samples"), F.count_distinct("f.prompt_id").alias("reviewers"))


_SEVERITY = """m as (select sample_id, arg_max(severity, (n, severity)) as actual from (select sample_id, severity, count(*) as n from v where severity is not null group by 1, 2) group by 1),
  k as (select actual, coalesce(severity, 'NONE') as predicted, count(*) as n from v join m using (sample_id) group by 1, 2)"""


def _severity(spark: SparkSession, d: str) -> DataFrame:
    v = _votes(spark, d)
    counts = v.where("severity is not null").groupBy("sample_id", "severity").agg(F.count("*").alias("n"))
    actual = counts.groupBy("sample_id").agg(F.max_by("severity", F.struct("n", "severity")).alias("actual"))
    return metrics.confusion(v.join(actual, "sample_id"), "actual", "severity")


@query(f"with {_VOTES}, {_SEVERITY} select * from k")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    """Severities that reviewers gave, against a sample's most frequent one."""
    return _severity(spark, d)


@query(
    f"""with {_VOTES}, {_SEVERITY}, a as (select actual as name, sum(n) as support, sum(case when actual = predicted then n else 0 end) as tp from k group by 1), b as (select predicted as name, sum(n) as said from k group by 1),
    c as (select distinct actual as name from k union select distinct predicted from k)
    select name, coalesce(support, 0)::bigint as support, round(coalesce(tp / nullif(said, 0)::double, 0), 6) as precision, round(coalesce(tp / nullif(support, 0)::double, 0), 6) as recall,
      round(coalesce(2 * tp / nullif(coalesce(said, 0) + support, 0)::double, 0), 6) as f1 from c left join a using (name) left join b using (name)"""
)
def multiclass_report(spark: SparkSession, d: str) -> DataFrame:
    k = _severity(spark, d)
    classes = k.select(F.explode(F.array("actual", "predicted")).alias("name")).distinct()
    return metrics.per_class(k, classes).withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


# --- extractions ----------------------------------------------------------------------------------------------------------

_DATE = r"""case when regexp_matches(s, '^\d{4}-\d{2}-\d{2}') then left(s, 10)
  when regexp_matches(s, '^\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}') then printf('%04d-%02d-%02d', case when length(y) = 2 then y::int + case when y::int < 50 then 2000 else 1900 end else y::int end,
    case when a <= 12 and b > 12 then a else b end, case when a <= 12 and b > 12 then b else a end) else lower(s) end"""
_DATES = rf"""(select *, {_DATE} as d from (select *, try_cast(regexp_extract(s, '^(\d{{1,2}})[/\-.](\d{{1,2}})[/\-.](\d{{2,4}})', 1) as int) as a, try_cast(regexp_extract(s, '^(\d{{1,2}})[/\-.](\d{{1,2}})[/\-.](\d{{2,4}})', 2) as int) as b,
  regexp_extract(s, '^(\d{{1,2}})[/\-.](\d{{1,2}})[/\-.](\d{{2,4}})', 3) as y from (select *, trim(date) as s from receipt_extractions)))"""


@query(f"select distinct date as raw, d as normalised from {_DATES} where date is not null")
def date_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "receipt_extractions").where("date is not null").select(F.col("date").alias("raw"), T.normalize_date("date").alias("normalised")).distinct()


_FIELDS = ("date", "total", "vendor_name")
_LONG = rf"""u as (select distinct receipt_id, run, model, d as date, round(total, 2) as total, trim(regexp_replace(lower(vendor_name), '[{_SPACE}]+', ' ', 'g')) as vendor_name from {_DATES}),
  x as (select receipt_id, run, model, 'date' as field, date as value from u union all select receipt_id, run, model, 'total', printf('%.2f', total) from u union all select receipt_id, run, model, 'vendor_name', vendor_name from u)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "receipt_extractions")
    fields = {"date": T.normalize_date("date"), "total": F.format_string("%.2f", F.round("total", 2)), "vendor_name": T.normalize_string("vendor_name")}
    return r.select("receipt_id", "run", "model", *[F.when(F.col(n).isNotNull(), c).alias(n) for n, c in fields.items()]).distinct()


@query(
    f"""with {_LONG}, c as (select receipt_id, field, value, count(*) as n, min(run) as first from x group by 1, 2, 3),
    b as (select receipt_id, field, arg_min(value, (-n, first, value)) filter (where value is not null) as value, max(n) filter (where value is not null) as best, sum(n) as runs, coalesce(sum(n) filter (where value is not null), 0) as there from c group by 1, 2)
    select receipt_id, field, value, round(coalesce(best / nullif(there, 0)::double, 0), 6) as agreement, round(there / runs::double, 6) as extraction_rate from b"""
)
def field_vote(spark: SparkSession, d: str) -> DataFrame:
    x = voting.field_votes(_runs(spark, d), "receipt_id", "run", {n: F.col(n) for n in _FIELDS})
    return x.withColumns({"agreement": r6("agreement"), "extraction_rate": r6("extraction_rate")})


@query(
    f"""with {_LONG}, c as (select receipt_id, field, value, count(*) as n, min(run) as first from x group by 1, 2, 3),
    b as (select receipt_id, field, arg_min(value, (-n, first, value)) filter (where value is not null) as voted from c group by 1, 2)
    select model, field, count(*) as n, round(count(*) filter (where value is not distinct from voted) / count(*)::double, 6) as accuracy from x join b using (receipt_id, field) group by 1, 2"""
)
def field_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Each model's fields against the value its receipt's runs vote for; two nulls agree."""
    runs = _runs(spark, d)
    voted = voting.field_votes(runs, "receipt_id", "run", {n: F.col(n) for n in _FIELDS}).select("receipt_id", "field", F.col("value").alias("voted"))
    long = runs.select("receipt_id", "model", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in _FIELDS])).alias("f")).select("receipt_id", "model", "f.*")
    x = long.join(voted, ["receipt_id", "field"])
    return x.groupBy("model", "field").agg(F.count("*").alias("n"), r6(share(F.count_if(F.col("value").eqNullSafe(F.col("voted"))), F.count("*"))).alias("accuracy"))


@query(
    """with u as (select distinct receipt_id, run, vendor_name, total from receipt_extractions),
    p as (select a.receipt_id, a.vendor_name as before_name, b.vendor_name as after_name, a.total as before_total, b.total as after_total from u a join u b on a.receipt_id = b.receipt_id and a.run = 0 and b.run = 1)
    select receipt_id, side, name, total from (select receipt_id, 'before' as side, before_name as name, before_total as total from p where trim(before_name) is distinct from trim(after_name)
      union all select receipt_id, 'after', after_name, after_total from p where trim(before_name) is distinct from trim(after_name))"""
)
def before_after_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Receipts whose vendor differs between the first two runs, one row a side."""
    u = table(spark, d, "receipt_extractions").select("receipt_id", "run", "vendor_name", "total").distinct()
    a = u.where("run = 0").select("receipt_id", F.struct(F.lit("before").alias("side"), F.col("vendor_name").alias("name"), "total").alias("a"))
    b = u.where("run = 1").select("receipt_id", F.struct(F.lit("after").alias("side"), F.col("vendor_name").alias("name"), "total").alias("b"))
    x = a.join(b, "receipt_id").where(~F.trim("a.name").eqNullSafe(F.trim("b.name")))
    return x.select("receipt_id", F.explode(F.array("a", "b")).alias("s")).select("receipt_id", "s.*")


@query(
    """with u as (select distinct receipt_id, run, model, total from receipt_extractions), p as (select a.total = b.total as agree, a.total is not null and b.total is not null as both_set from u a join u b on a.receipt_id = b.receipt_id and a.run = 0 and b.run = 1)
    select coalesce(agree, false) as agree, both_set, count(*) as n from p group by 1, 2"""
)
def run_agreement(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "receipt_extractions").select("receipt_id", "run", "model", "total").distinct()
    p = u.where("run = 0").alias("a").join(u.where("run = 1").alias("b"), "receipt_id")
    both = F.col("a.total").isNotNull() & F.col("b.total").isNotNull()
    return p.groupBy(F.coalesce(F.col("a.total") == F.col("b.total"), F.lit(False)).alias("agree"), both.alias("both_set")).agg(F.count("*").alias("n"))


# --- documents and vectors ------------------------------------------------------------------------------------------------

_WS = "chr(32)||chr(9)||chr(10)||chr(13)"


@query(
    f"""with p as (select doc_id, trim(case when contains(text, chr(10)||chr(10)) then split_part(text, chr(10)||chr(10), 1) else substr(text, 1, 500) end, '{_SPACE}') as paragraph from documents)
    select doc_id, paragraph from p where length(paragraph) >= 50"""
)
def first_paragraph(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", T.first_paragraph("text").alias("paragraph"))
    return x.where(F.length("paragraph") >= 50)


@query("select lang, doc_id, n_chars, rank from (select *, row_number() over (partition by lang order by n_chars desc, doc_id) as rank from (select * from documents where n_chars is not null)) where rank <= 5")
def topn_per_class(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("lang", "doc_id", "n_chars").where("n_chars is not null")
    return ordinals.first_per_group(x, "lang", 5, F.desc("n_chars"), F.col("doc_id"))


@query(
    """select count(*) as documents, count(distinct text) as texts, count(distinct source) as sources, count(*) filter (where text is null or text = '') as without_text from documents"""
)
def corpus_statistics(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents")
    return x.agg(F.count("*").alias("documents"), F.count_distinct("text").alias("texts"), F.count_distinct("source").alias("sources"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("without_text"))


@query()
def code_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Fenced code of all documents without comments and surplus white space."""
    x = table(spark, d, "documents").select("doc_id", F.posexplode(code.fenced("text")).alias("pos", "b"))
    return x.select("doc_id", "pos", "b.language", code.preprocess(F.col("b.code")).alias("code"))


@query(
    """with g as (select text, count(*) as n, min(doc_id) as kept from documents where text <> '' group by 1)
    select doc_id, kept from documents join g using (text) where n > 1 and doc_id <> kept"""
)
def exact_copies(spark: SparkSession, d: str) -> DataFrame:
    """Documents that repeat the text of an earlier one: texts meet by hash and are compared in full."""
    x = table(spark, d, "documents").select("doc_id", "text").where("text <> ''")
    g = x.groupBy("text").agg(F.count("*").alias("n"), F.min("doc_id").alias("kept")).where("n > 1")
    return x.join(g, "text").where("doc_id <> kept").select("doc_id", "kept")


@query(
    """with q as (select vec_id as query_id, embedding as e from embeddings where vec_id % 50 = 0),
    s as (select query_id, vec_id, round(list_cosine_similarity(e::double[], embedding::double[]), 6) as similarity from q, embeddings where vec_id <> query_id),
    r as (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from s)
    select query_id, vec_id, rank, similarity from r where rank <= 10"""
)
def knn_top10(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vectors.nearest(e, e.where("vec_id % 50 = 0"), 10)


@query(
    """with j as (select d.doc_id, e.vec_id is not null as found from documents d left join embeddings e on d.doc_id = e.vec_id)
    select found, count(*) as n, (count(*) * 64)::bigint as values_kept from j group by 1"""
)
def vectors_filled(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their vectors by key; a missing vector is zeros of the same length."""
    x = table(spark, d, "documents").select("doc_id").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    x = x.withColumn("found", F.col("embedding").isNotNull()).withColumn("embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), 64)))
    return x.groupBy("found").agg(F.count("*").alias("n"), F.sum(F.size("embedding")).alias("values_kept"))


# --- rounds and streams ---------------------------------------------------------------------------------------------------


@query(
    """select o_custkey, count(*) as children, count(*) filter (where o_orderstatus <> 'F') as open, count(*) filter (where o_orderstatus <> 'F') = 0 as ready from orders group by 1"""
)
def parents_ready(spark: SparkSession, d: str) -> DataFrame:
    return trees.ready_parents(table(spark, d, "orders"), "o_custkey", F.col("o_orderstatus") == "F")


def _places(spark: SparkSession, d: str) -> DataFrame:
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    n = table(spark, d, "nation").select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child"))
    c = table(spark, d, "customer").select(name("n", "c_nationkey").alias("parent"), name("c", "c_custkey").alias("child"))
    o = table(spark, d, "orders").select(name("c", "o_custkey").alias("parent"), name("o", "o_orderkey").alias("child"))
    return n.unionByName(c).unionByName(o)


_EDGES = """t as (select 'r' || n_regionkey as parent, 'n' || n_nationkey as child from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer union all select 'c' || o_custkey, 'o' || o_orderkey from orders)"""


@query(
    f"""with recursive {_EDGES}, p as (select parent as ancestor, child as descendant from t union all select p.ancestor, t.child from p join t on p.descendant = t.parent)
    select ancestor, count(distinct descendant) as descendants from p group by 1"""
)
def subtree_sizes(spark: SparkSession, d: str) -> DataFrame:
    return trees.descendant_counts(_places(spark, d))


@query(
    f"""with recursive {_EDGES}, k as (select parent, child from (select parent, child, row_number() over (partition by parent order by child) as i from (select distinct * from t)) where i <= 8),
    p as (select 'r' || r_regionkey as node, null::varchar as parent, 0 as depth from region union all select k.child, p.node, p.depth + 1 from p join k on k.parent = p.node where p.depth < 3)
    select node, parent, depth from p"""
)
def query_tree(spark: SparkSession, d: str) -> DataFrame:
    edges = _places(spark, d)
    roots = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    step = lambda f: f.join(edges.withColumnRenamed("parent", "node"), "node").select("node", "child")
    return trees.expand(roots, step, 3).select("node", "parent", "depth")


@query(f"""with recursive {_EDGES}, i as (select * from t where child[1] <> 'o'), p as (select parent as ancestor, child as descendant from i union all select p.ancestor, i.child from p join i on p.descendant = i.parent) select distinct ancestor, descendant from p""")
def place_paths(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of a region, nation or customer and what lies below it, without the orders."""
    return trees.closure(_places(spark, d).where(~F.col("child").startswith("o")))


_ACTIONS = """m as (select l_orderkey, arg_max(l_returnflag = 'N', (l_linenumber, l_returnflag = 'N')) as tool, count(*) as n from lineitem group by 1),
  a as (select o_orderkey, case o_orderstatus when 'P' then 'pending' when 'O' then 'in_progress' else 'done' end as status from orders)"""


@query(
    f"""with {_ACTIONS} select o_orderkey, case when not (status = 'pending' or status = 'in_progress' and coalesce(tool, false)) then 'wait' when coalesce(n, 0) >= 6 then 'complete' else 'ready' end as action
    from a left join m on l_orderkey = o_orderkey"""
)
def next_actions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as agents and their lines as messages: who is ready for the next round, who is over budget."""
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("done")
    a = table(spark, d, "orders").select("o_orderkey", status.alias("status"))
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("seq"), F.when(F.col("l_returnflag") == "N", "tool").otherwise("assistant").alias("role"))
    return trees.next_actions(a, m, 6, "o_orderkey")


@query(
    """with a as (select distinct id from eval_questions where id is not null), r as (select custom_id, max(coalesce(response.body.choices[1].message.content, '')) as said from batch_results where custom_id is not null group by 1)
    select id, case when r.custom_id is null then 'pending' when starts_with(said, '{') then 'waiting' when said <> '' then 'completed' else 'failed' end as status, (r.custom_id is not null)::int as iteration from a left join r on custom_id = id"""
)
def moved_on(spark: SparkSession, d: str) -> DataFrame:
    """Questions as agents after a round: structured replies count as calls, others as final texts."""
    a = table(spark, d, "eval_questions").select("id").where("id is not null").distinct().withColumns({"status": F.lit("pending"), "iteration": F.lit(0)})
    r = table(spark, d, "batch_results").where("custom_id is not null").groupBy(F.col("custom_id").alias("id")).agg(F.max(F.coalesce(requests.content(), F.lit(""))).alias("said"))
    return trees.moved_on(a, r.withColumn("n_calls", F.col("said").startswith("{").cast("int")), "id")


@query(
    f"""with recursive {_EDGES}, p as (select 'r' || r_regionkey as node, 0 as depth from region union all select t.child, p.depth + 1 from p join t on t.parent = p.node),
    s as (select node, depth, node[1] = 'o' and o_orderstatus = 'F' as done from p left join orders on node = 'o' || o_orderkey)
    select node, depth, case when not coalesce(done, false) then (select max(depth) from s where not coalesce(done, false)) - depth + 1 end as closes from s"""
)
def forced_closing(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that are still open and the round in which each is closed, from the deepest upwards."""
    at = {"n": 1, "c": 2, "o": 3}
    depth = F.coalesce(*[F.when(F.col("node").startswith(k), v) for k, v in at.items()])
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"), F.lit(True).alias("done"))
    below = _places(spark, d).select(F.col("child").alias("node")).distinct().withColumn("depth", depth)
    roots = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.lit(0).alias("depth"))
    return trees.forced_closing(roots.unionByName(below).join(done, "node", "left"), F.col("done")).select("node", "depth", "closes")


@query("select case o_orderstatus when 'F' then 'done' when 'P' then 'pending' else 'in_progress' end as status, count(*) as n, max(o_custkey)::bigint as greatest_parent from orders group by 1")
def agent_summary(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "pending").otherwise("in_progress")
    return table(spark, d, "orders").groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.max("o_custkey").alias("greatest_parent"))


@query("select o_custkey as parent, count(*) as children, list(o_orderkey order by o_orderkey)[1:20] as findings from orders group by 1 having count(*) filter (where o_orderstatus <> 'F') = 0")
def compiled_findings(spark: SparkSession, d: str) -> DataFrame:
    """Parents of which every child is done, with the first of their children's findings."""
    return trees.compiled(table(spark, d, "orders"), "o_custkey", F.col("o_orderstatus") == "F", "o_orderkey", 20)


@query("select start, event_type, n, total from (select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events where ts is not null group by 1, 2), (select max(ts) as last from events) where start + interval 1 hour <= last - interval 1 day")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """The windows that the watermark has closed, each written once."""
    return rounds.drain(rounds.event_windows(rounds.table_stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), late="1 day"), "windows")


@query("select distinct custom_id from batch_results where custom_id is not null and finished_at is not null")
def stream_first_results(spark: SparkSession, d: str) -> DataFrame:
    """Each key of a stream of results once, from the first row that arrives."""
    s = rounds.table_stream(spark, f"{d}/batch_results.parquet").where("custom_id is not null and finished_at is not null").select("custom_id", "finished_at")
    return rounds.drain(rounds.first_results(s), "first").select("custom_id")
