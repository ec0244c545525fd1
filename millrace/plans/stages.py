"""Queries of pipeline stages over the given tables, with their SQL: requests, joins back, judging, reports, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import code
from millrace.functions import text as T
from millrace.operators import fanout, judging, metrics, ordinals, requests, trees, updates, vectors, voting
from millrace.operators.metrics import share
from millrace.plans.catalogue import _COUNTS, _FIELDS, _JOINED, _LONG, _PRF, _SEVERITY, _VOTES, _WS, _runs, _severity, _stated, _votes, query, r6
from millrace.sources import files
from millrace.storage import shared_path, table
from millrace.streaming import rounds

# --- joins back ------------------------------------------------------------------------------------------------------------

_Q = "q as (select id, min(question) as question, min(answer) as answer, lower(min(category)) as category from eval_questions where id is not null group by id)"
_LAST = """l as (select custom_id, arg_max(coalesce(response.body.choices[1].message.content, ''), (finished_at, result_id)) as said from batch_results where custom_id is not null and finished_at is not null group by 1)"""


def _questions(spark: SparkSession, d: str, key: str = "id") -> DataFrame:
    q = table(spark, d, "eval_questions").where("id is not null")
    return q.groupBy(F.col("id").alias(key)).agg(F.min("question").alias("question"), F.min("answer").alias("answer"), F.lower(F.min("category")).alias("category"))


def _last(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "batch_results").where("finished_at is not null").select("custom_id", "result_id", "finished_at", "response")
    return ordinals.last_wins(r, "custom_id", "finished_at", "result_id")


@query(f"with {_Q}, {_LAST} select q.id, case when said <> '' then said else answer end as answer, coalesce(said <> '', false) as updated from q left join l on l.custom_id = q.id")
def stage_update(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose answer is replaced by the last result's text, where there is one."""
    r = _last(spark, d).select(F.col("custom_id").alias("id"), requests.content().alias("said"))
    return updates.update_from(_questions(spark, d), r, "id", {"answer": "said"}).select("id", "answer", "updated")


@query(
    f"""with {_Q}, s as (select model, case when q.id is null then 'unmatched' when error is not null then 'error' when coalesce(len(response.body.choices), 0) < 1 then 'no_choices'
      when coalesce(response.body.choices[1].message.content, '') = '' then 'empty' else 'ok' end as status from batch_results left join q on q.id = custom_id)
    select model, status, count(*) as n from s group by 1, 2"""
)
def joined_status(spark: SparkSession, d: str) -> DataFrame:
    x = updates.joined_status(table(spark, d, "batch_results"), _questions(spark, d, "custom_id"), "custom_id")
    return x.groupBy("model", "status").agg(F.count("*").alias("n"))


@query(f"with {_Q}, {_LAST} select category, case when l.custom_id is null then 'missing' when said = '' then 'skipped' else 'valid' end as outcome, count(*) as n, sum(length(coalesce(said, '')))::bigint as letters from q left join l on l.custom_id = q.id group by 1, 2")
def judge_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Questions by whether their last reply can be judged; every question stays."""
    x = updates.answers_for(_questions(spark, d, "custom_id"), _last(spark, d), "custom_id")
    return x.groupBy("category", "outcome").agg(F.count("*").alias("n"), F.sum(F.length("reply")).alias("letters"))


@query(
    """with v as (select unnest(list_append(coalesce(aliases, []), name)) as variant, id, name from ref_companies),
    c as (select variant, arg_max(name, (id, name)) as canonical from v where variant is not null group by 1),
    n as (select distinct name_a as name from match_pairs where name_a is not null)
    select n.name, coalesce(c.canonical, n.name) as canonical from n left join c on c.variant = n.name"""
)
def canonical_lookup(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "ref_companies").select(F.col("id").alias("cluster"), F.col("name").alias("canonical"), F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name")).alias("variants"))
    names = table(spark, d, "match_pairs").select(F.col("name_a").alias("name")).where("name is not null").distinct()
    return updates.canonical_names(names, r)


@query(
    """with u as (select 'records' as source, name from company_records union all select 'references', name from ref_companies union all select 'pairs', name_a from match_pairs union all select 'pairs', name_b from match_pairs)
    select source, count(*) as n, count(distinct name) as names, count(*) filter (where name is null or name = '') as without_name from u group by rollup (source)"""
)
def merged_sources(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "match_pairs").select(F.explode(F.array("name_a", "name_b")).alias("name"))
    u = updates.united({"records": table(spark, d, "company_records"), "references": table(spark, d, "ref_companies"), "pairs": p})
    return u.rollup("source").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.count_if(F.coalesce(F.col("name") == "", F.lit(True))).alias("without_name"))


@query(
    """with a as (select receipt_id, min(vendor_name) as v, min(total) as t from receipt_extractions where run = 0 group by 1), b as (select receipt_id, min(vendor_name) as v, min(total) as t from receipt_extractions where run = 1 group by 1)
    select receipt_id, case when a.receipt_id is null then 'added' when b.receipt_id is null then 'removed' when a.v is not distinct from b.v and a.t is not distinct from b.t then 'same' else 'changed' end as outcome
    from a full join b using (receipt_id) where receipt_id is not null"""
)
def compared_runs(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "receipt_extractions").where("receipt_id is not null")
    one = lambda n: r.where(F.col("run") == n).groupBy("receipt_id").agg(F.min("vendor_name").alias("v"), F.min("total").alias("t"))
    return updates.compared(one(0), one(1), "receipt_id", ["v", "t"])


_FOUND = r"""c as (select result_id, trim(response.body.choices[1].message.content, chr(32)||chr(9)||chr(10)||chr(13)) as s from (select distinct * from batch_results) where response.body.choices[1].message.content is not null),
  fm as (select result_id, s, trim(regexp_extract(s, '(?s)```(?:json)?\s*\n?(.*?)```', 1), chr(32)||chr(9)||chr(10)||chr(13)) as fence, regexp_extract(s, '(?s)\{.*\}') as braces, regexp_extract(s, '(?s)\[.*\]') as brackets from c),
  g as (select result_id, list_filter([s, fence, braces, brackets], lambda x: (starts_with(x, '{') or starts_with(x, '[')) and json_valid(x))[1] as found,
    list_filter([s, fence, braces], lambda x: (starts_with(x, '{') or starts_with(x, '[')) and json_valid(x))[1] as bare from fm)"""


def _found(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "batch_results").distinct().select("result_id", requests.content().alias("s")).where("s is not null")
    return r.select("result_id", "s", T.json_text("s").alias("found"))


@query(f"with {_FOUND}, k as (select result_id, coalesce(found->>'$.answer' <> '', false) and (found->>'$.confidence') is distinct from 'low' as keep from g where found is not null) select result_id, keep from k")
def kept_results(spark: SparkSession, d: str) -> DataFrame:
    """Structured replies, and whether they are kept: an answer is set and its confidence isn't low. What is not kept is the side output."""
    x = _found(spark, d).where("found is not null")
    keep = updates.kept(F.get_json_object("found", "$.answer") != "", F.get_json_object("found", "$.confidence"))
    return x.select("result_id", keep.alias("keep"))


@query("select custom_id, arg_max(model, (batch_id, result_id, model)) as model, count(distinct batch_id) as chunks from batch_results where custom_id is not null and batch_id is not null group by 1")
def merged_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Results of several chunks under one key: the later chunk's counts."""
    r = table(spark, d, "batch_results").where("custom_id is not null and batch_id is not null")
    return r.groupBy("custom_id").agg(F.max_by("model", F.struct("batch_id", "result_id", "model")).alias("model"), F.count_distinct("batch_id").alias("chunks"))


@query(
    """with f as (select question, min((created_at, id)) as first from eval_questions where question is not null and question <> '' and lower(question) is distinct from lower(category) group by 1)
    select question, row_number() over (order by first, question) as place from f"""
)
def distinct_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions without repeats in the order in which they first came; those that only name their topic are left out."""
    q = table(spark, d, "eval_questions").where("question <> ''").where(~F.lower("question").eqNullSafe(F.lower("category")))
    f = q.groupBy("question").agg(F.min(F.struct("created_at", "id")).alias("f")).select("question", "f.*")
    return ordinals.with_ordinal(f, "created_at", "id", "question", name="place").select("question", (F.col("place") + 1).alias("place"))


# --- requests --------------------------------------------------------------------------------------------------------------


@query(
    f"""with r as (select distinct id, nullif(trim(name, {_WS}), '') as name, nullif(trim(ticker, {_WS}), '') as ticker, nullif(trim(exchange, {_WS}), '') as exchange from company_records where id is not null),
    o as (select id, min(name) as name, min(ticker) as ticker, min(exchange) as exchange from r group by 1)
    select 'normalize-' || id as custom_id, concat_ws(chr(10), 'Name: ' || name, 'Ticker: ' || ticker, 'Exchange: ' || exchange) as prompt from o"""
)
def normalize_requests(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "company_records").where("id is not null")
    o = r.groupBy("id").agg(*[F.min(F.nullif(F.regexp_replace(c, r"^[ \t\n\r]+|[ \t\n\r]+$", ""), F.lit(""))).alias(c) for c in ("name", "ticker", "exchange")])
    return o.select(F.concat(F.lit("normalize-"), "id").alias("custom_id"), requests.labelled_lines(Name=F.col("name"), Ticker=F.col("ticker"), Exchange=F.col("exchange")).alias("prompt"))


@query(
    f"""with r as (select id, min(nullif(trim(name, {_WS}), '')) as name from company_records where id is not null group by 1),
    p as (select record_a as id, min(nullif(trim(name_a, {_WS}), '')) as typed from match_pairs group by 1)
    select 'enrich-' || r.id as custom_id, coalesce(typed, name) as name from r left join p on p.id = r.id"""
)
def enrich_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests by the name that a pair gives, else the record's own."""
    clean = lambda c: F.nullif(F.regexp_replace(c, r"^[ \t\n\r]+|[ \t\n\r]+$", ""), F.lit(""))
    r = table(spark, d, "company_records").where("id is not null").groupBy("id").agg(F.min(clean("name")).alias("name"))
    p = table(spark, d, "match_pairs").groupBy(F.col("record_a").alias("id")).agg(F.min(clean("name_a")).alias("typed"))
    return r.join(p, "id", "left").select(F.concat(F.lit("enrich-"), "id").alias("custom_id"), F.coalesce("typed", "name").alias("name"))


@query(
    """with p as (select record_a, record_b, min(name_a) as name_a, min(name_b) as name_b, max(fuzzy_score) as score from match_pairs where record_a is not null and record_b is not null and fuzzy_score between 70 and 94 group by 1, 2)
    select printf('dedup-%06d', row_number() over (order by record_a, record_b) - 1) as custom_id, concat_ws(chr(10), 'A: ' || name_a, 'B: ' || name_b, 'Score: ' || score::int) as prompt from p"""
)
def pair_requests(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that scoring leaves open, as requests numbered in the order of their ids."""
    p = table(spark, d, "match_pairs").where("record_a is not null and record_b is not null and fuzzy_score between 70 and 94")
    p = p.groupBy("record_a", "record_b").agg(F.min("name_a").alias("name_a"), F.min("name_b").alias("name_b"), F.max("fuzzy_score").cast("int").cast("string").alias("score"))
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in (("A", "name_a"), ("B", "name_b"), ("Score", "score"))])
    return ordinals.with_ordinal(p, "record_a", "record_b").select(T.padded_id("dedup-", "ord").alias("custom_id"), lines.alias("prompt"))


@query(
    """with n as (select distinct name from company_records where name is not null and name <> ''), o as (select name, row_number() over (order by name) - 1 as i from n)
    select printf('dedupe-%03d', i // 100) as custom_id, list(name order by i) as names from o group by i // 100"""
)
def name_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Distinct names, a hundred to a request."""
    n = table(spark, d, "company_records").select("name").where("name <> ''").distinct()
    x = ordinals.with_ordinal(n, "name").groupBy(F.floor(F.col("ord") / 100).cast("long").alias("i")).agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("m"))
    return x.select(T.padded_id("dedupe-", "i", 3).alias("custom_id"), F.col("m.name").alias("names"))


@query(
    """with s as (select sample_id, min(language) as language from ensemble_results where sample_id is not null group by 1), o as (select *, row_number() over (order by sample_id) - 1 as i from s)
    select printf('s%04d__', i) || prompt_id as custom_id, sample_id, prompt_id, coalesce(language, '') as language from o, (select distinct prompt_id from review_prompts)"""
)
def review_requests(spark: SparkSession, d: str) -> DataFrame:
    """Every sample with every reviewer; the short id's mapping to the sample is a column."""
    s = table(spark, d, "ensemble_results").where("sample_id is not null").groupBy("sample_id").agg(F.min("language").alias("language"))
    x = fanout.with_variants(ordinals.with_ordinal(s, "sample_id"), table(spark, d, "review_prompts"), "prompt_id")
    return x.select(F.concat(T.padded_id("s", "ord", 4), F.lit("__"), "prompt_id").alias("custom_id"), "sample_id", "prompt_id", F.coalesce("language", F.lit("")).alias("language"))


@query(
    f"""with {_VOTES}, m as (select sample_id, printf('s%04d', row_number() over (order by sample_id) - 1) as short from (select distinct sample_id from ensemble_results where sample_id is not null))
    select short || '__' || prompt_id as custom_id, sample_id, prompt_id, actual, has_bug from v join m using (sample_id) join t using (sample_id) where actual is not null"""
)
def two_hop_truth(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts under short ids, joined to their samples by the mapping, and to the samples' labels; samples without one are left out."""
    s = ordinals.with_ordinal(table(spark, d, "ensemble_results").select("sample_id").where("sample_id is not null").distinct(), "sample_id")
    m = s.select("sample_id", T.padded_id("s", "ord", 4).alias("short"))
    raw = _votes(spark, d).join(m, "sample_id").select(F.concat("short", F.lit("__"), "prompt_id").alias("custom_id"), "has_bug")
    part = F.split("custom_id", "__", 2)
    x = raw.select("custom_id", part[0].alias("short"), part[1].alias("prompt_id"), "has_bug").join(m, "short")
    return x.join(_stated(spark, d).where("actual is not null"), "sample_id").select("custom_id", "sample_id", "prompt_id", "actual", "has_bug")


@query("select r.receipt_id || '__run_' || i as custom_id, r.receipt_id, i::int as run from (select distinct receipt_id from receipt_extractions where receipt_id is not null) r, range(3) x(i)")
def run_requests(spark: SparkSession, d: str) -> DataFrame:
    """Each receipt three times; the id is taken apart again at its last mark."""
    r = table(spark, d, "receipt_extractions").select("receipt_id").where("receipt_id is not null").distinct()
    x = fanout.repeated(r, "receipt_id", 3, "custom_id")
    return x.select("custom_id", T.before_last("custom_id", "__run_").alias("receipt_id"), F.regexp_extract("custom_id", r"__run_(\d+)$", 1).cast("int").alias("run"))


@query(
    """with t as (select distinct lower(category) as topic from eval_questions where category is not null), p as (select ceil(1000.0 / count(*))::int as per from t),
    g as (select topic, i, difficulty, greatest(1, round_even(per * share, 0))::int as n from t, p, (values (0, 'easy', 0.4::double), (1, 'medium', 0.35::double), (2, 'hard', 0.25::double)) x(i, difficulty, share)),
    c as (select *, coalesce(sum(n) over (order by topic, i rows between unbounded preceding and 1 preceding), 0)::int as b from g)
    select topic, difficulty, least(n, 1000 - b)::int as n, b as begin from c where least(n, 1000 - b) > 0"""
)
def topic_grid(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "eval_questions").select(F.lower("category").alias("topic"))
    return fanout.allocated(t, "topic", {"easy": 0.4, "medium": 0.35, "hard": 0.25}, 1000)


@query(f"with {_Q} select id, 'Classify {{code}}:' || chr(10) || question as prompt from q where question is not null")
def templated_prompts(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).where("question is not null").select("id", T.filled("Classify {{code}}:\n{code}", code=F.col("question")).alias("prompt"))


@query(
    """with r as (select receipt_id, run, min(vendor_address) as a, min(vendor_name) as n from receipt_extractions where receipt_id is not null group by 1, 2)
    select case when a <> '' then 'image' when n <> '' then 'text' else 'error' end as kind, run, count(*) as n from r group by 1, 2"""
)
def message_parts(spark: SparkSession, d: str) -> DataFrame:
    """Requests by what they carry: an image part, a text, or neither, which is an error row and no request."""
    r = table(spark, d, "receipt_extractions").where("receipt_id is not null").groupBy("receipt_id", "run").agg(F.min("vendor_address").alias("image"), F.min("vendor_name").alias("text"))
    part = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value"))
    m = F.when(F.col("image") != "", part("image", "image")).when(F.col("text") != "", part("text", "text"))
    return r.select("run", F.coalesce(m["kind"], F.lit("error")).alias("kind")).groupBy("kind", "run").agg(F.count("*").alias("n"))


@query(
    """with r as (select distinct result_id, response.body.choices as c from batch_results where result_id is not null), x as (select result_id, unnest(c) as c, generate_subscripts(c, 1) as i from r),
    o as (select result_id, i, substring(c.message.content, 1, 200) as passage from x where c.message.content <> '')
    select printf('extract-%04d', row_number() over (order by result_id, i) - 1) as custom_id, result_id, passage from o"""
)
def extract_requests(spark: SparkSession, d: str) -> DataFrame:
    """Every choice of every result, cut to a length, as a request of its own."""
    r = table(spark, d, "batch_results").where("result_id is not null").select("result_id", F.col("response.body.choices").alias("c")).distinct()
    x = r.select("result_id", F.posexplode("c").alias("i", "c")).select("result_id", "i", F.substring("c.message.content", 1, 200).alias("passage")).where("passage <> ''")
    return ordinals.with_ordinal(x, "result_id", "i").select(T.padded_id("extract-", "ord", 4).alias("custom_id"), "result_id", "passage")


@query(
    """with o as (select doc_id, row_number() over (order by doc_id) - 1 as i from documents), g as (select i // 3 as g, list(doc_id order by i) as members from o group by 1)
    select printf('group-%05d', g) as group_id, members from g"""
)
def grouped_requests(spark: SparkSession, d: str) -> DataFrame:
    return fanout.in_groups(ordinals.with_ordinal(table(spark, d, "documents").select("doc_id"), "doc_id"), 3, "doc_id")


@query(
    r"""with o as (select doc_id, title, row_number() over (order by doc_id) - 1 as i from documents), s as (select i // 3 as g, list_transform(list_filter(list(title order by i), lambda x: x is not null), lambda x, k: x) as t from o group by 1)
    select o.doc_id, case when (o.i % 3) + 1 <= len(t) then t[(o.i % 3) + 1] end as part from o join s on s.g = o.i // 3"""
)
def ungrouped_replies(spark: SparkSession, d: str) -> DataFrame:
    """A group's reply, a list of the titles that are set, given back to the group's members by position."""
    x = ordinals.with_ordinal(table(spark, d, "documents").select("doc_id", "title"), "doc_id")
    replies = x.groupBy(F.concat(F.lit("group-"), F.format_string("%05d", F.floor(F.col("ord") / 3).cast("long"))).alias("group_id"))
    replies = replies.agg(F.array_sort(F.collect_list(F.when(F.col("title").isNotNull(), F.struct("ord", "title")))).alias("r"))
    groups = fanout.in_groups(x.select("doc_id", "ord"), 3, "doc_id").join(replies, "group_id")
    return fanout.ungrouped(groups, F.col("r.title")).withColumnRenamed("member", "doc_id")


@query("with o as (select doc_id, row_number() over (order by doc_id) - 1 as i, ceil(count(*) over () / 10.0)::bigint as each from documents) select (i // each)::bigint as file, count(*) as n, min(doc_id) as first, max(doc_id) as last from o group by 1")
def ten_files(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive documents in at most ten files of equal size."""
    docs = table(spark, d, "documents").select("doc_id")
    x = ordinals.in_chunks(docs, max(1, -(-docs.count() // 10)), "doc_id", name="file")
    return x.groupBy("file").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query(
    f"""with {_Q} select id, 'req-' || id as optional_id, 'json_object' as format, 4096 as most, 'auto' as choice, question as input, null::varchar as model from q where question is not null"""
)
def request_variants(spark: SparkSession, d: str) -> DataFrame:
    """Requests with a model left out, with tools, with a JSON format and with an embedding's input, written as JSON and read again."""
    q = _questions(spark, d).where("question is not null")
    tool = [{"type": "function", "function": {"name": "search"}}]
    plain = requests.chat_request(F.concat(F.lit("req-"), "id"), F.col("question"), json_format=True)
    tools = requests.chat_request(F.col("id"), F.col("question"), tools=tool, max_tokens=4096)
    embedding = requests.embedding_request(F.col("id"), F.col("question"))
    get = lambda c, p: F.get_json_object(c, p)
    x = q.select("id", plain.alias("p"), tools.alias("t"), embedding.alias("e"))
    return x.select("id", get("p", "$.custom_id").alias("optional_id"), get("p", "$.body.response_format.type").alias("format"), get("t", "$.body.max_tokens").cast("int").alias("most"), get("t", "$.body.tool_choice").alias("choice"), get("e", "$.body.input").alias("input"), get("p", "$.body.model").alias("model"))


# --- judging ---------------------------------------------------------------------------------------------------------------


@query(
    """with r as (select id, name, coalesce(aliases, []) as a from ref_companies), l as (select id, case when name <> '' and not list_contains(a, name) then list_prepend(name, a) else a end as reference from r)
    select id, reference, coalesce(list_aggregate(list_transform(list_filter(reference, lambda x: x <> ''), lambda x: '- ' || x), 'string_agg', chr(10)), '') as lines from l"""
)
def reference_lists(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "ref_companies").select("id", judging.reference_list(F.col("name"), F.col("aliases")).alias("reference"))
    return r.withColumn("lines", judging.bullets(F.col("reference")))


_SCORED = """e as (select sample_id, confidence as relevance, votes_no_bug / nullif(total_votes, 0)::double as hallucination_risk, votes_bug / nullif(total_votes, 0)::double as tone from (select distinct sample_id, confidence, votes_bug, votes_no_bug, total_votes from ensemble_results where sample_id is not null)),
  s as (select *, coalesce(relevance between 0 and 1 and hallucination_risk between 0 and 1 and tone between 0 and 1, false) as ok from e)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Replies of a judge as JSON, made of the samples' counts, and their scores."""
    e = table(spark, d, "ensemble_results").where("sample_id is not null").select("sample_id", "confidence", "votes_bug", "votes_no_bug", "total_votes").distinct()
    reply = F.to_json(F.struct(F.col("confidence").alias("relevance"), F.try_divide("votes_no_bug", "total_votes").alias("hallucination_risk"), F.try_divide("votes_bug", "total_votes").alias("tone")))
    return e.select("sample_id", reply.alias("reply")).withColumn("score", judging.scores(F.col("reply")))


@query(f"with {_SCORED} select sample_id, ok, case when ok then round((relevance + (1 - hallucination_risk) + tone) / 3, 6) end as overall from s")
def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("sample_id", F.col("score").isNotNull().alias("ok"), r6(judging.overall(F.col("score"))).alias("overall"))


@query(f"with {_SCORED} select count(*) as n, count(*) filter (where ok) as scored, round(avg(relevance) filter (where ok), 6) as relevance, round(avg(hallucination_risk) filter (where ok), 6) as hallucination_risk, round(avg(tone) filter (where ok), 6) as tone, round(avg((relevance + (1 - hallucination_risk) + tone) / 3) filter (where ok), 6) as overall from s")
def judge_means(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("score")
    x = _scored(spark, d)
    return x.agg(F.count("*").alias("n"), F.count("score").alias("scored"), *(r6(F.avg(s[c])).alias(c) for c in judging.SCORES), r6(F.avg(judging.overall(s))).alias("overall"))


@query(
    f"""with {_SCORED}, v as (select sample_id, unnest(['relevance', 'hallucination_risk', 'tone', 'overall']) as evaluator, unnest(case when ok then [relevance, hallucination_risk, tone, (relevance + (1 - hallucination_risk) + tone) / 3] else [0, 0, 0, 0] end) as value from s)
    select evaluator, case when value >= 0.7 then 'pass' else 'fail' end as label, count(*) as n from v group by 1, 2"""
)
def judge_labels(spark: SparkSession, d: str) -> DataFrame:
    return judging.score_rows(_scored(spark, d), "sample_id").groupBy("evaluator", "label").agg(F.count("*").alias("n"))


@query(f"with {_FOUND} select result_id, coalesce((case when starts_with(found, '{{') then found->>'$.has_bug' end) = 'true', false) as has_bug, found is not null as parsed from g")
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What each reply says of bugs; no bug where it is no JSON, or says nothing."""
    x = _found(spark, d).select("result_id", judging.verdict(F.col("found")).alias("v"))
    return x.select("result_id", "v.has_bug", "v.parsed")


@query(rf"with {_FOUND} select g.result_id, bare is not null as objects, found is not null as any_json, json_valid(trim(regexp_replace(s, '^```(?:json)?|```$', '', 'g'), {_WS})) and regexp_matches(trim(regexp_replace(s, '^```(?:json)?|```$', '', 'g'), {_WS}), '^[{{\[]') as whole from g join fm using (result_id)")
def json_variants(spark: SparkSession, d: str) -> DataFrame:
    """Which of the readings of a reply as JSON succeed: without lists, with them, and of the whole reply without its fence."""
    x = _found(spark, d)
    return x.select("result_id", T.json_text("s", lists=False).isNotNull().alias("objects"), F.col("found").isNotNull().alias("any_json"), (T.json_or_empty("s") != "{}").alias("whole"))


@query("select sample_id, len(coalesce(findings, []))::int as n, len(list_filter(coalesce(findings, []), lambda x: x is not null))::int as held from (select distinct sample_id, findings from ensemble_results where sample_id is not null)")
def object_lists(spark: SparkSession, d: str) -> DataFrame:
    """Findings as JSON, once as an object's list and once as a bare one: both forms give the same objects, and nothing else."""
    e = table(spark, d, "ensemble_results").where("sample_id is not null").select("sample_id", "findings").distinct()
    bare = F.coalesce(F.to_json("findings"), F.lit("[]"))
    x = e.select("sample_id", F.coalesce(F.size("findings"), F.lit(0)).alias("n"), judging.object_or_list(F.concat(F.lit('{"companies":'), bare, F.lit("}")), "companies").alias("a"), judging.object_or_list(bare, "companies").alias("b"))
    return x.select("sample_id", F.when(F.col("n") < 0, 0).otherwise(F.col("n")).alias("n"), F.when(F.col("a") == F.col("b"), F.size("a")).alias("held"))


@query("select name, count(*) as n, count(distinct call_id) as ids from (select event_id as call_id, event_type as name from events where event_type <> '') group by 1")
def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls written into text, one for each event, taken out again and counted by name."""
    e = table(spark, d, "events").where("event_type <> ''")
    call = F.concat(F.lit("On. <tool_call>\n"), F.to_json(F.struct(F.col("event_type").alias("name"), F.struct("event_id").alias("arguments"))), F.lit("\n</tool_call> Then <tool_call>{}</tool_call>"))
    c = e.select(F.explode(judging.tool_calls(call)).alias("c")).select("c.*")
    return c.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("call_id").alias("ids"))


# --- metrics ---------------------------------------------------------------------------------------------------------------


@query(
    f"""with {_VOTES}, c as (select prompt_id, {_COUNTS} from (select prompt_id, coalesce(has_bug, false) as said, actual from v join t using (sample_id) where actual is not null) group by 1), m as (select prompt_id, tp, fp, tn, fn, {_PRF} from c)
    select prompt_id, tp, fp, tn, fn, precision, recall, f1, accuracy, row_number() over (order by f1 desc, prompt_id) as place from m"""
)
def reviewer_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Reviewers by their F1, over samples with a known label only; no verdict is no bug."""
    known = _stated(spark, d).where("actual is not null")
    x = metrics.binary(_votes(spark, d).join(known, "sample_id"), "has_bug", "actual", "prompt_id")
    x = x.withColumns({c: r6(c) for c in ("precision", "recall", "f1", "accuracy")})
    # one row a reviewer
    return x.withColumn("place", F.row_number().over(Window.orderBy(F.desc("f1"), "prompt_id")))


@query(
    """with b as (select replace(lower(trim(confidence)), '-', '_') as bucket, fuzzy_score from match_pairs where trim(confidence) <> '')
    select bucket, count(*) as n, count(*) filter (where fuzzy_score >= 90) as correct, round(count(*) filter (where fuzzy_score >= 90) / count(*)::double, 6) as accuracy from b group by 1"""
)
def verbal_calibration(spark: SparkSession, d: str) -> DataFrame:
    """How often pairs of each stated confidence score high."""
    p = table(spark, d, "match_pairs").where(F.trim("confidence") != "")
    return metrics.by_label(p.withColumn("ok", F.coalesce(F.col("fuzzy_score") >= 90, F.lit(False))), "confidence", "ok")


_GROUPED = f"""with {_VOTES}, {_SEVERITY}, d as (select actual, predicted, n, case when actual in ('critical', 'high') then 'grave' else 'slight' end as ga, case when predicted in ('critical', 'high') then 'grave' when predicted <> 'NONE' then 'slight' end as gp from k)"""


@query(f"{_GROUPED} select ga as name, sum(n)::bigint as support, sum(case when gp is not null then n else 0 end)::bigint as answered, round(sum(case when ga = gp then n else 0 end) / sum(n)::double, 6) as accuracy, round(coalesce(sum(case when ga = gp then n else 0 end) / nullif(sum(case when gp is not null then n else 0 end), 0)::double, 0), 6) as accuracy_answered from d group by 1")
def grouped_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy by groups of classes, over all rows and over those with a prediction."""
    groups = {"critical": "grave", "high": "grave", "medium": "slight", "low": "slight", "none": "slight", "info": "slight"}
    return metrics.grouped(_severity(spark, d), groups, "slight").withColumns({c: r6(c) for c in ("accuracy", "accuracy_answered")})


@query(f"with {_VOTES}, {_SEVERITY} select actual, predicted, n, place from (select *, row_number() over (order by n desc, actual, predicted) as place from k where actual <> predicted and predicted <> 'NONE') where place <= 5")
def top_confusions(spark: SparkSession, d: str) -> DataFrame:
    return metrics.top_confusions(_severity(spark, d), 5)


_SUBSETS = f"""{_VOTES}, w as (select category, sample_id, count(*) filter (where has_bug) as b, count(*) filter (where not has_bug) as n from v join review_prompts using (prompt_id) group by 1, 2),
    s as (select category, coalesce(b / nullif(b + n, 0)::double, 0) >= 0.5 and b + n > 0 as said, actual from w join t using (sample_id)), c as (select category, {_COUNTS} from s group by 1),
    x as (select category, prompts, round(coalesce(tp / nullif(tp + fn, 0)::double, 0), 6) as recall from c join (select category, count(*) as prompts from review_prompts group by 1) using (category))"""


def _subsets(spark: SparkSession, d: str) -> DataFrame:
    prompts = table(spark, d, "review_prompts")
    x = voting.ensemble(_votes(spark, d).join(prompts, "prompt_id"), "category", "sample_id").join(_stated(spark, d), "sample_id")
    size = prompts.groupBy("category").agg(F.count("*").alias("prompts"))
    return metrics.binary(x, "predicted", "actual", "category").join(size, "category").select("category", "prompts", r6("recall").alias("recall"))


@query(f"with {_SUBSETS} select category, prompts, recall from (select *, row_number() over (order by recall / prompts desc, category) as i from x) where i = 1")
def best_subset(spark: SparkSession, d: str) -> DataFrame:
    """The subset of reviewers that finds most for its size."""
    return metrics.elbow(_subsets(spark, d), "recall", "prompts", "category")


@query(f"with {_SUBSETS} select list(category order by prompts, category) as names, list(prompts order by prompts, category) as sizes, list(recall order by prompts, category) as recalls from x")
def subset_curve(spark: SparkSession, d: str) -> DataFrame:
    """One row of columns for a plot, in the order of the subsets' sizes."""
    rows = F.array_sort(F.collect_list(F.struct("prompts", "category", "recall")))
    return _subsets(spark, d).agg(rows.alias("r")).select(F.col("r.category").alias("names"), F.col("r.prompts").alias("sizes"), F.col("r.recall").alias("recalls"))


@query(
    """with s as (select sample_id, max(predicted_has_bug) as label from ensemble_results where sample_id is not null and predicted_has_bug is not null and lower(language) in ('python', 'c', 'java') and length(sample_id) between 1 and 100 group by 1),
    k as (select least(min(n), 200) as each from (select count(*) as n from s group by label)) select sample_id, label from (select *, row_number() over (partition by label order by sample_id) as i from s), k where i <= each"""
)
def balanced_samples(spark: SparkSession, d: str) -> DataFrame:
    """As many samples of either label, in three languages."""
    e = table(spark, d, "ensemble_results").where("predicted_has_bug is not null").where(F.lower("language").isin("python", "c", "java") & F.length("sample_id").between(1, 100))
    return fanout.balanced(e.groupBy("sample_id").agg(F.max("predicted_has_bug").alias("label")), "label", "sample_id", 400)


@query(
    """with s as (select distinct sample_id, language, coalesce(confidence, 0) * 5 as overall from ensemble_results where sample_id is not null)
    select coalesce(language, 'unknown') as language, count(*) as n, round(avg(overall), 6) as overall, count(*) filter (where overall >= 3.5) as passed, round(count(*) filter (where overall >= 3.5) / count(*)::double, 6) as pass_rate from s group by 1"""
)
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    """Mean quality, a missing one counting 0, and the share that passes, by language."""
    s = table(spark, d, "ensemble_results").where("sample_id is not null").select("sample_id", "language", (F.coalesce("confidence", F.lit(0.0)) * 5).alias("overall")).distinct()
    return metrics.quality(s.withColumn("language", F.coalesce("language", F.lit("unknown"))), "overall", "language").withColumns({c: r6(c) for c in ("overall", "pass_rate")})


@query("select count(distinct id) as records, count(distinct id) filter (where name <> trim(name)) as untidy, count(distinct id) filter (where name <> '') as named, count(distinct id) filter (where ticker <> '') as listed from company_records")
def cleaning_counts(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "company_records")
    n = lambda c: F.count_distinct(F.when(c, F.col("id")))
    return r.agg(F.count_distinct("id").alias("records"), n(F.col("name") != F.trim("name")).alias("untidy"), n(F.col("name") != "").alias("named"), n(F.col("ticker") != "").alias("listed"))


@query(
    """with c as (select category as value, count(*) as n, min((created_at, id)) as first from eval_questions where category <> '' group by 1)
    select value, n, round(n / sum(n) over (), 6) as share, row_number() over (order by n desc, first) as place from c"""
)
def topic_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Topics by frequency; of equally frequent ones the one that came first."""
    q = table(spark, d, "eval_questions").where("category <> ''")
    c = q.groupBy(F.col("category").alias("value")).agg(F.count("*").alias("n"), F.min(F.struct("created_at", "id")).alias("first"))
    # one row a topic
    return c.select("value", "n", r6(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"), F.row_number().over(Window.orderBy(F.desc("n"), "first")).alias("place"))


@query("select language, n from (select coalesce(language, '?') as language, count(*) as n from (select distinct sample_id, language from ensemble_results where sample_id is not null) group by 1) order by language")
def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "ensemble_results").where("sample_id is not null").select("sample_id", F.coalesce("language", F.lit("?")).alias("language")).distinct()
    return s.groupBy("language").agg(F.count("*").alias("n")).orderBy("language")


@query("select lang, n, place from (select lang, n, row_number() over (order by n desc, lang) as place from (select lang, count(*) as n from documents where lang is not null group by 1)) where place <= 10")
def top_languages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"))
    top = c.orderBy(F.desc("n"), "lang").limit(10)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "lang")))


@query("select id, name from (select distinct id, name, row_number() over (order by id, name) as i from (select distinct id, name from company_records where id is not null)) where i <= 100")
def first_records(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred records in the order of their ids: a head of a load."""
    return table(spark, d, "company_records").select("id", "name").where("id is not null").distinct().orderBy("id", "name").limit(100)


_MENTIONS = "m as (select name, count(*) as n from (select name_a as name from match_pairs union all select name_b from match_pairs) where name <> '' group by 1)"


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "match_pairs").select(F.explode(F.array("name_a", "name_b")).alias("name")).where("name <> ''").groupBy("name").agg(F.count("*").alias("n"))


@query(f"with {_MENTIONS} select name, n, row_number() over (order by n desc, name) as place from m")
def mention_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ordinals.with_ordinal(_mentions(spark, d).withColumn("down", -F.col("n")), "down", "name", name="place").select("name", "n", (F.col("place") + 1).alias("place"))


@query(
    f"""with {_MENTIONS}, r as (select *, row_number() over (order by n desc, name) as i, md5(name) as h from m), t as (select name from r where i <= 10), o as (select name, row_number() over (order by h, name) as j from r where i > 10)
    select name, true as frequent from t union all select name, false from o where j <= 10"""
)
def priority_sample(spark: SparkSession, d: str) -> DataFrame:
    """Twenty names to expand: half are the most mentioned, the others are drawn by a hash. Drawing is the operator's purpose."""
    return ordinals.priority_sample(_mentions(spark, d), "name", "n", 20)


# --- texts -----------------------------------------------------------------------------------------------------------------

_URL = r"https?://[^\s<>\"'')\]]+"


@query(
    f"""with u as (select doc_id, title, unnest(regexp_extract_all(text, '{_URL}')) as url from documents)
    select url, arg_min(coalesce(title, ''), doc_id) as title, count(distinct doc_id) as documents from u group by 1"""
)
def distinct_urls(spark: SparkSession, d: str) -> DataFrame:
    """Web addresses in all documents, each with the title of the first document that has it."""
    u = table(spark, d, "documents").select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.explode(T.urls("text")).alias("url"))
    return u.groupBy("url").agg(F.min_by("title", "doc_id").alias("title"), F.count_distinct("doc_id").alias("documents"))


@query(
    f"""with u as (select distinct unnest(regexp_extract_all(text, '{_URL}')) as url from documents), e as (select url, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\\.([A-Za-z0-9]+)$', 1)) as s from u)
    select url, sha256(url) || '.' || case when s in ('jpg', 'jpeg', 'png', 'gif', 'webp') then s else 'jpg' end as file from e"""
)
def cache_names(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "documents").select(F.explode(T.urls("text")).alias("url")).distinct()
    return u.select("url", T.cache_name("url").alias("file"))


@query("select doc_id, split_part(substring(text, 1, 100), chr(10), 1) as line, substring(text, 1, 150) as head, lower(replace(substring(coalesce(title, ''), 1, 50), ' ', '-')) as slug from documents where text is not null")
def document_heads(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where("text is not null")
    return x.select("doc_id", T.title_line("text").alias("line"), F.substring("text", 1, 150).alias("head"), T.slug(F.coalesce("title", F.lit(""))).alias("slug"))


@query()
def query_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a reply that become queries, and whether it asks to stop."""
    x = table(spark, d, "documents").where("text is not null")
    return x.select("doc_id", T.query_lines("text").alias("lines"), T.stops_expansion("text").alias("stops"))


@query(
    """with t as (select source, doc_id, title, row_number() over (partition by source order by doc_id) as i from documents where title is not null), c as (select source, string_agg(i || '. ' || title, chr(10) order by i) as lines from t where i <= 5 group by 1)
    select s.source, coalesce(lines, 'No results found.') as lines from (select distinct source from documents where source is not null) s left join c on c.source = s.source"""
)
def search_context(spark: SparkSession, d: str) -> DataFrame:
    """The first five hits of each source as numbered lines; a source without any says so."""
    x = table(spark, d, "documents").select("source", "doc_id", "title").where("source is not null")
    top = ordinals.first_per_group(x.where("title is not null"), "source", 5, F.col("doc_id"))
    lines = top.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("t")).select("source", T.numbered_lines(F.col("t.title")).alias("lines"))
    return x.select("source").distinct().join(lines, "source", "left").withColumn("lines", F.coalesce("lines", F.lit("No results found.")))


@query(
    """with o as (select doc_id, text, row_number() over (order by doc_id) - 1 as i from documents), p as (select i, doc_id, case when contains(text, chr(10)||chr(10)) then split_part(text, chr(10)||chr(10), 1) else substring(text, 1, 500) end as p from o)
    select printf('emb-%06d', i) as custom_id, doc_id, length(p)::int as n from p where length(p) >= 50"""
)
def embedding_inputs(spark: SparkSession, d: str) -> DataFrame:
    """First paragraphs as inputs; the request's number is the document's place before short ones are left out."""
    x = ordinals.with_ordinal(table(spark, d, "documents").select("doc_id"), "doc_id").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    p = F.when(F.contains("text", F.lit("\n\n")), F.substring_index("text", "\n\n", 1)).otherwise(F.substring("text", 1, 500))
    return x.select(T.padded_id("emb-", "ord").alias("custom_id"), "doc_id", F.length(p).alias("n")).where("n >= 50")


@query(
    """with f as (select distinct sample_id, unnest(findings).bug_type as b from ensemble_results where sample_id is not null), c as (select *, 100 + length(b) * 5 as k from f where b is not null)
    select sample_id, b as bug_type, case when k in (20, 22, 77, 78, 79, 89, 94, 119, 120, 125, 190, 200, 269, 276, 287, 352, 362, 400, 416, 434, 476, 502, 787, 798) then 'CWE-' || k end as label from c"""
)
def weakness_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels as models write them, made of the findings' types, brought to one form; unknown classes are null."""
    f = table(spark, d, "ensemble_results").where("sample_id is not null").select("sample_id", F.explode("findings").alias("f")).select("sample_id", F.col("f.bug_type").alias("bug_type")).where("bug_type is not null").distinct()
    k = (F.length("bug_type") * 5 + 100).cast("string")
    said = F.when(F.length("sample_id") % 2 == 0, F.concat(F.lit(" cwe-"), k)).when(F.col("bug_type") < "m", F.concat(F.lit("CWE"), k, F.lit("\n"))).otherwise(k)
    return f.select("sample_id", "bug_type", T.weakness_label(said).alias("label"))


@query("select coalesce(nullif(case when lower(lang) in ('c++', 'cpp') then 'cpp' else lower(lang) end, ''), 'c') as language, count(*) as n from documents group by 1")
def language_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(T.language_name("lang").alias("language")).agg(F.count("*").alias("n"))


@query("select distinct o_orderkey, round(o_totalprice, 2) as amount, round(-o_totalprice, 2) as negative from orders")
def amounts_read(spark: SparkSession, d: str) -> DataFrame:
    """Amounts as people type them, made of the orders' prices, read as numbers again."""
    o = table(spark, d, "orders").select("o_orderkey", F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2).alias("s"))
    mark = F.element_at(F.array(*map(F.lit, ["$", "RM ", "usd ", "€", "", "MYR"])), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return o.select("o_orderkey", T.normalize_number(F.concat(mark, "s", F.lit("\t"))).alias("amount"), T.normalize_number(F.concat(F.lit(" -"), "s")).alias("negative")).distinct()


@query("select id, regexp_replace(coalesce(regexp_extract(answer, '####\\s*(.+)', 1), ''), ',', '', 'g') as mark, trim(answer) as gold, printf('gsm8k-%05d', row_number() over (order by id) - 1) as custom_id from (select id, min(answer) as answer from eval_questions where id is not null and answer is not null group by 1)")
def gold_answers(spark: SparkSession, d: str) -> DataFrame:
    """Gold answers behind their mark; the data's have none, so each is given one and read again."""
    q = table(spark, d, "eval_questions").where("id is not null and answer is not null").groupBy("id").agg(F.min("answer").alias("answer"))
    x = ordinals.with_ordinal(q, "id")
    return x.select("id", F.regexp_replace(F.regexp_extract("answer", r"####\s*(.+)", 1), ",", "").alias("mark"), T.gold_answer(F.concat(F.lit("So it is.\n#### "), F.trim("answer"), F.lit("\n"))).alias("gold"), T.padded_id("gsm8k-", "ord", 5).alias("custom_id"))


@query(f"with {_JOINED}, x as (select custom_id, min(content) as said from r where content <> '' group by 1) select q.id, ['system: Be helpful.', 'user: ' || question, 'assistant: ' || said] as messages from q join x on x.custom_id = q.id where question <> '' and length(said) * 0.05 >= 3.5")
def role_mapped_export(spark: SparkSession, d: str) -> DataFrame:
    """Conversations of customer, agent and notes with a score, as messages of user and assistant behind a system row; low scores and other roles are left out."""
    q = _questions(spark, d, "custom_id").where("question <> ''")
    r = table(spark, d, "batch_results").where("error is null").select("custom_id", requests.content().alias("said")).where("said <> ''").groupBy("custom_id").agg(F.min("said").alias("said"))
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    talks = q.join(r, "custom_id").select("custom_id", F.array(turn("note", "category"), turn("customer", "question"), turn("agent", "said")).alias("turns"), (F.length("said") * 0.05).alias("overall"))
    x = requests.training_messages(talks, "turns", "overall", "Be helpful.", {"customer": "user", "agent": "assistant"})
    return x.select(F.col("custom_id").alias("id"), F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])).alias("messages"))


# --- joins of several tables -----------------------------------------------------------------------------------------------


@query(
    """with j as (select distinct r_name, o_orderkey, o_totalprice from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
      where l_quantity between 10 and 40 and lower(l_returnflag) in ('r', 'a') and o_orderstatus = 'F')
    select r_name, o_orderkey, o_totalprice, rank from (select *, row_number() over (partition by r_name order by o_orderkey) as rank from j) where rank <= 5"""
)
def class_samples(spark: SparkSession, d: str) -> DataFrame:
    """A chain of five tables with its predicates, without repeats, and of each class the first rows."""
    t = lambda n: table(spark, d, n)
    lines = t("lineitem").where(F.col("l_quantity").between(10, 40) & F.lower("l_returnflag").isin("r", "a")).select(F.col("l_orderkey").alias("o_orderkey"))
    o = t("orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", F.col("o_custkey").alias("c_custkey"))
    c = t("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = t("nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    x = lines.join(o, "o_orderkey").join(c, "c_custkey").join(n, "n_nationkey").join(t("region"), "r_regionkey").select("r_name", "o_orderkey", "o_totalprice").distinct()
    return ordinals.first_per_group(x, "r_name", 5, F.col("o_orderkey"))


@query(
    """with i as (select 'img/' || receipt_id || '.jpg' as path, receipt_id from receipt_extractions where run = 0 and receipt_id is not null group by receipt_id), l as (select 'labels/' || receipt_id || '.json' as path, max(total) as total from receipt_extractions where run = 1 and receipt_id is not null group by receipt_id)
    select i.receipt_id as stem, total from i join l on regexp_extract(i.path, '([^/]+)\\.[a-z]+$', 1) = regexp_extract(l.path, '([^/]+)\\.[a-z]+$', 1)"""
)
def stem_join(spark: SparkSession, d: str) -> DataFrame:
    """Images and labels that share a file's stem; a label's total is a text that is read as a number."""
    r = table(spark, d, "receipt_extractions").where("receipt_id is not null")
    stem = lambda c: F.regexp_extract(c, r"([^/]+)\.[a-z]+$", 1).alias("stem")
    images = r.where("run = 0").select(F.concat(F.lit("img/"), "receipt_id", F.lit(".jpg")).alias("path")).distinct().select(stem("path"))
    labels = r.where("run = 1").groupBy("receipt_id").agg(F.max("total").cast("string").alias("total")).select(stem(F.concat(F.lit("labels/"), "receipt_id", F.lit(".json"))), "total")
    return images.join(labels, "stem").select("stem", F.replace("total", F.lit(","), F.lit("")).try_cast("double").alias("total"))


@query("select prompt_id, category, count(*) over (partition by category) as of_category from review_prompts where category in ('logic', 'memory')")
def prompts_of_categories(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "review_prompts").where(F.col("category").isin("logic", "memory"))
    return p.withColumn("of_category", F.count("*").over(Window.partitionBy("category")))


@query("select receipt_id as id, coalesce(nullif(vendor_name, ''), nullif(vendor_address, ''), 'unknown') as truth from (select receipt_id, min(vendor_name) as vendor_name, min(vendor_address) as vendor_address from receipt_extractions where receipt_id is not null group by 1)")
def first_of_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "receipt_extractions").where("receipt_id is not null").groupBy("receipt_id").agg(F.min("vendor_name").alias("n"), F.min("vendor_address").alias("a"))
    return r.select(F.col("receipt_id").alias("id"), F.coalesce(F.nullif("n", F.lit("")), F.nullif("a", F.lit("")), F.lit("unknown")).alias("truth"))


# --- agents ----------------------------------------------------------------------------------------------------------------


@query(
    """with t as (select n_regionkey as r, list(n_name order by n_nationkey) as q from nation group by 1), p as (select r, unnest(q) as query, generate_subscripts(q, 1) - 1 as pos from t),
    h as (select n_name as query, count(*) as n_hits from customer join nation on c_nationkey = n_nationkey where c_acctbal > 9000 group by 1)
    select 'r' || r || '-' || pos as agent_id, 'r' || r as parent, p.query, 1 as depth, n_hits from p join h on h.query = p.query"""
)
def spawned_agents(spark: SparkSession, d: str) -> DataFrame:
    """Regions that ask for their nations; a nation with customers of a high balance is answered, others spawn no child."""
    n = table(spark, d, "nation")
    p = n.groupBy(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("agent_id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("q")).select("agent_id", F.lit(0).alias("depth"), F.col("q.n_name").alias("queries"))
    hits = table(spark, d, "customer").where("c_acctbal > 9000").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("query"))
    return trees.spawned(p, hits)


@query("select event_type as name, case when event_type in ('purchase', 'error') then 'deferred' else 'immediate' end as route, count(*) as n from events where event_type <> '' group by 1, 2")
def routed_calls(spark: SparkSession, d: str) -> DataFrame:
    return trees.routed(table(spark, d, "events").where("event_type <> ''").select(F.col("event_type").alias("name")), ["purchase", "error"])


@query("select 'r' || n_regionkey as parent, string_agg('- [done] ' || n_name, chr(10) order by 'n' || (n_nationkey + 100)) as lines from nation group by 1")
def context_lines(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    a = n.select(F.concat(F.lit("n"), (F.col("n_nationkey") + 100).cast("string")).alias("agent_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.lit("done").alias("status"), F.concat(F.lit("Investigate: "), "n_name").alias("topic"))
    return trees.context_lines(a)


@query("select o_orderkey as agent_id, 'agent-' || o_orderkey || '-iter-' || (o_custkey % 5) as custom_id, 'in_progress' as status from orders where o_orderstatus = 'P'")
def round_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests of the agents that are ready, which are in progress from then on; the id is taken apart at its last mark."""
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("agent_id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("status"), (F.col("o_custkey") % 5).alias("iteration"))
    m = a.limit(0).select("agent_id", F.lit(0).alias("seq"), F.lit("").alias("role"))
    ready = trees.next_actions(a, m, 8).where("action = 'ready'").join(a, "agent_id")
    return ready.select("agent_id", F.concat(F.lit("agent-"), F.col("agent_id").cast("string"), F.lit("-iter-"), F.col("iteration").cast("string")).alias("custom_id"), F.lit("in_progress").alias("status"))


@query(
    """with f as (select s_suppkey, 'CWE' || s_nationkey || '_x/' || s_suppkey || '.c' as path from supplier)
    select s_suppkey, case when s_nationkey is not null then 'CWE-' || s_nationkey end as label, 'void x_bad() {' || chr(10) || 'int a = ' || s_suppkey || ';' || chr(10) || '}' as bad,
      case when s_suppkey % 3 > 0 then 'static void good1(int b) {' || chr(10) || 'if (b) { b = ' || s_nationkey || '; }' || chr(10) || '}' end as good from supplier"""
)
def bad_and_good_functions(spark: SparkSession, d: str) -> DataFrame:
    """The two functions in each source file of a suite, files being made of the suppliers, and the class in its path."""
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    good = F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("static void good1(int b) {\nif (b) { b = "), n, F.lit("; }\n}"))).otherwise("")
    text = F.concat(F.lit("#include <x.h>\nvoid x_bad() {\nint a = "), k, F.lit(";\n}\n"), good, F.lit("\nint main() {\n}\n"))
    f = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("CWE"), n, F.lit("_x/"), k, F.lit(".c")).alias("path"), text.alias("text"))
    return f.select("s_suppkey", code.weakness_of_path(F.col("path")).alias("label"), code.bad_function(F.col("text")).alias("bad"), code.good_function(F.col("text")).alias("good"))


@query(
    """with t as (select source, doc_id, title, text, row_number() over (partition by source order by doc_id) as i from documents where title is not null and text is not null),
    c as (select source, string_agg('- ' || title || ': ' || substring(text, 1, 40), chr(10) order by i) as lines from t where i <= 3 group by 1),
    s as (select source, bool_and(text is null) as failed from documents where source is not null group by 1)
    select s.source, coalesce(lines, case when failed then 'Search failed: no text' else 'No results found.' end) as lines from s left join c on c.source = s.source"""
)
def filter_context(spark: SparkSession, d: str) -> DataFrame:
    """Hits of each source as lines of title and text, or what stands for them where there are none, or the search failed."""
    x = table(spark, d, "documents").select("source", "doc_id", "title", F.substring("text", 1, 40).alias("t")).where("source is not null")
    top = ordinals.first_per_group(x.where("title is not null and t is not null"), "source", 3, F.col("doc_id"))
    line = F.concat("title", F.lit(": "), "t")
    lines = top.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l")).select("source", judging.bullets(F.col("l.line")).alias("lines"))
    s = x.groupBy("source").agg(F.bool_and(F.col("t").isNull()).alias("failed"))
    instead = F.when(F.col("failed"), "Search failed: no text").otherwise("No results found.")
    return s.join(lines, "source", "left").select("source", F.coalesce("lines", instead).alias("lines"))


@query(
    f"""with {_MENTIONS}, r as (select *, row_number() over (order by n desc, name) as i, md5(name) as h from m), t as (select name from r where i <= 10), o as (select name, row_number() over (order by h, name) as j from r where i > 10),
    s as (select name from t union all select name from o where j <= 10) select unnest(list_filter([name || ' competitors', 'SEARCH ' || name, 'x'], lambda x: length(x) > 5 and not starts_with(x, 'SEARCH'))) as query from s"""
)
def expanded_queries(spark: SparkSession, d: str) -> DataFrame:
    """One round of expansion from a sample of found entities: of each reply the lines that are queries."""
    s = ordinals.priority_sample(_mentions(spark, d), "name", "n", 20)
    reply = F.concat_ws("\n", F.concat("name", F.lit(" competitors")), F.concat(F.lit("SEARCH "), "name"), F.lit("x"))
    return s.select(F.explode(T.query_lines(reply)).alias("query"))


@query(
    f"""with {_Q}, {_LAST}, s1 as (select id, case when said <> '' then said else answer end as answer from q left join l on l.custom_id = q.id)
    select 'stage1_loaded' as stage, count(*) as n from q union all select 'stage2_updated', count(*) filter (where answer <> '') from s1 union all select 'stage3_kept', count(*) filter (where length(answer) >= 20) from s1"""
)
def stage_outputs(spark: SparkSession, d: str) -> DataFrame:
    """A pipeline of three stages, each written as JSON and read by the next, and a summary of their rows."""
    path = shared_path(spark, "stages")
    schema = "id string, question string, answer string"
    _questions(spark, d).select("id", "question", "answer").write.json(f"{path}/stage1_loaded")
    q = spark.read.schema(schema).json(f"{path}/stage1_loaded")
    r = _last(spark, d).select(F.col("custom_id").alias("id"), requests.content().alias("said"))
    updates.update_from(q, r, "id", {"answer": "said"}).drop("updated").where("answer <> ''").write.json(f"{path}/stage2_updated")
    spark.read.schema(schema).json(f"{path}/stage2_updated").where(F.length("answer") >= 20).write.json(f"{path}/stage3_kept")
    every = spark.read.schema(schema).option("recursiveFileLookup", True).json(path).select(F.regexp_extract("_metadata.file_path", r"/(stage\d_\w+)/", 1).alias("stage"))
    return every.groupBy("stage").agg(F.count("*").alias("n"))


@query("select 'write_report' as tool, 'r' || r_regionkey as agent_id from region union all select unnest(['search', 'read_pages', 'spawn_agents', 'reference_findings']), agent_id from (select 'r' || r_regionkey as agent_id from region union all select 'n' || n_nationkey from nation)")
def tools_by_role(spark: SparkSession, d: str) -> DataFrame:
    """The tools that each agent may call; roots may write the report as well."""
    a = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("agent_id"), F.lit(True).alias("root"))
    a = a.unionByName(table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("agent_id"), F.lit(False).alias("root")))
    every = F.array(*map(F.lit, ["search", "read_pages", "spawn_agents", "reference_findings"]))
    return a.select("agent_id", F.explode(F.when(F.col("root"), F.concat(F.array(F.lit("write_report")), every)).otherwise(every)).alias("tool"))


# --- vectors ---------------------------------------------------------------------------------------------------------------


@query()
def ann_top10(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every fiftieth vector by the index of cells, with as many probes as the recall asks for."""
    e = table(spark, d, "embeddings")
    index = vectors.build_index(e)
    return vectors.search(index, e.where("vec_id % 50 = 0"), 10, vectors.tuned_probes(index, e))


@query()
def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall and mean inverse rank of the index against the exact search."""
    e = table(spark, d, "embeddings")
    return vectors.recall(ann_top10(spark, d), vectors.nearest(e, e.where("vec_id % 50 = 0"), 10), 10)


@query("select count(*) as n_rows, count(*) filter (where list_sum(list_transform(embedding, lambda x: x * x)) > 0) as n_indexed, max(len(embedding))::int as dim from embeddings")
def index_facts(spark: SparkSession, d: str) -> DataFrame:
    """What a saved index was built of: rows, rows with a direction, and the vectors' length."""
    path = shared_path(spark, "index")
    vectors.save_index(vectors.build_index(table(spark, d, "embeddings")), path)
    return vectors.load_index(spark, path).about.drop("n_cells")


# --- files -----------------------------------------------------------------------------------------------------------------


@query("select id, min(question) as question, min(answer) as answer from eval_questions where id is not null group by 1")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Ground truth written as JSON lines, its rows counted, and read again by key."""
    path = shared_path(spark, "truth")
    q = _questions(spark, d).select("id", "question", "answer")
    if files.write_jsonl(q, path) != q.count():
        raise ValueError("rows were lost")
    return spark.read.schema("id string, question string, answer string").json(path)


@query("select nation as name, count(*) as n from (select n_name as nation from customer join nation on c_nationkey = n_nationkey) group by 1")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A table written as CSV with a header and read again by the first of its name columns that is there."""
    path = shared_path(spark, "csv")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("Company"))
    table(spark, d, "customer").join(n, "c_nationkey").select("c_custkey", "Company").write.option("header", True).csv(path)
    return files.read_names(spark, path).groupBy("name").agg(F.count("*").alias("n"))


@query("select event_id::varchar as event_id, event_type from events where event_type is not null")
def tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "tsv")
    table(spark, d, "events").select("event_id", "event_type").write.option("header", True).option("sep", "\t").csv(path)
    return files.read_tsv(spark, path, "event_type")


@query("select model, run::int as n, count(*) as rows from receipt_extractions where model is not null and run is not null group by 1, 2")
def results_by_file_name(spark: SparkSession, d: str) -> DataFrame:
    """Results in files named after their model and run: both are read from the names."""
    path = shared_path(spark, "named")
    r = table(spark, d, "receipt_extractions").where("model is not null and run is not null")
    r.select("receipt_id", F.concat(F.lit("results_"), "model", F.lit("_n"), F.col("run").cast("string")).alias("file")).write.partitionBy("file").json(path)
    return files.read_named_results(spark, path, "receipt_id string").groupBy("model", "n").agg(F.count("*").alias("rows"))


@query("select distinct lower(category) as topic from eval_questions where category <> ''")
def seed_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics to begin with, from a CSV or a JSON lines file with a topic column."""
    path = shared_path(spark, "topics")
    table(spark, d, "eval_questions").select(F.lower("category").alias("topic")).where("topic <> ''").distinct().write.option("header", True).csv(f"{path}.csv")
    return files.read_topics(spark, f"{path}.csv")


@query("select count(*) as n from (select distinct custom_id from batch_results where custom_id is not null)")
def results_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Results written as JSON lines and streamed from their folder; each key once."""
    path = shared_path(spark, "results")
    table(spark, d, "batch_results").select("custom_id", "response", "error").where("custom_id is not null").write.json(path)
    if files.read_results(spark, path).count() != files.read_results(spark, path).select("custom_id").distinct().count():
        raise ValueError("a key came twice")
    return files.read_results(spark, path).agg(F.count("*").alias("n"))


@query(f"with {_JOINED}, a as (select model, count(*) as n, count(*) filter (where content <> '') as answered from r group by 1) select list({{'model': model, 'n': n, 'answered': answered}} order by model) as models, sum(n)::bigint as n from a")
def score_report(spark: SparkSession, d: str) -> DataFrame:
    """A report in one row: metrics by model and over all, written as JSON and read again."""
    path = shared_path(spark, "report")
    r = table(spark, d, "batch_results").where("error is null").distinct().select("model", requests.content().alias("content"))
    a = r.groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("content") != "").alias("answered"))
    a.agg(F.array_sort(F.collect_list(F.struct("model", "n", "answered"))).alias("models"), F.sum("n").alias("n")).coalesce(1).write.json(path)
    return spark.read.schema("models array<struct<model: string, n: bigint, answered: bigint>>, n bigint").json(path)


@query("select printf('csv-%06d', i) as id, name from (select name, row_number() over (order by name) - 1 as i from (select distinct trim(p_name) as name from part where trim(p_name) <> '')) where i < 500")
def csv_records(spark: SparkSession, d: str) -> DataFrame:
    """The head of a load from CSV, with ids made of the order."""
    path = shared_path(spark, "records")
    table(spark, d, "part").select("p_partkey", F.col("p_name").alias("company_name")).write.option("header", True).csv(path)
    return files.numbered(files.read_names(spark, path), 500)


@query("select id, name from (select id, name, row_number() over (order by id) as i from (select id, min(name) as name from company_records where id is not null group by 1)) where i <= 5")
def prepared_records(spark: SparkSession, d: str) -> DataFrame:
    """Records loaded and saved as JSON lines, and a look at the first five."""
    path = shared_path(spark, "prepared")
    r = table(spark, d, "company_records").where("id is not null").groupBy("id").agg(F.min("name").alias("name"))
    files.write_jsonl(r, path)
    return spark.read.schema("id string, name string").json(path).orderBy("id").limit(5)


@query("select custom_id, count(*) as n, count(*) filter (where error is not null) as failed from batch_results where custom_id is not null group by 1")
def streamed_results(spark: SparkSession, d: str) -> DataFrame:
    """Partial results that arrive in a folder, read as a stream."""
    path = shared_path(spark, "arriving")
    table(spark, d, "batch_results").select("custom_id", "response", "error").where("custom_id is not null").repartition(4).write.json(path)
    x = rounds.drain(files.stream_results(spark, path), "arrived")
    return x.groupBy("custom_id").agg(F.count("*").alias("n"), F.count("error").alias("failed"))


@query(
    f"""with {_LONG}, c as (select receipt_id, field, value, count(*) as n, min(run) as first from x group by 1, 2, 3),
    b as (select receipt_id, field, arg_min(value, (-n, first, value)) filter (where value is not null) as voted, coalesce(max(n) filter (where value is not null) / nullif(sum(n) filter (where value is not null), 0)::double, 0) as agreement,
      coalesce(sum(n) filter (where value is not null), 0) / sum(n)::double as rate from c group by 1, 2),
    r as (select receipt_id, count(distinct run) as n_runs from x group by 1)
    select model, n_runs, coalesce(field, '(all)') as field, count(*) as n, round(count(*) filter (where value is not distinct from voted) / count(*)::double, 6) as accuracy, round(avg(agreement), 6) as agreement, round(avg(rate), 6) as extraction_rate
    from x join b using (receipt_id, field) join r using (receipt_id) group by grouping sets ((model, n_runs, field), (model, n_runs))"""
)
def field_summary(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy, agreement and extraction by model, number of runs and field, and over all fields."""
    runs = _runs(spark, d)
    voted = voting.field_votes(runs, "receipt_id", "run", {n: F.col(n) for n in _FIELDS}).withColumnRenamed("value", "voted")
    size = runs.groupBy("receipt_id").agg(F.count_distinct("run").alias("n_runs"))
    long = runs.select("receipt_id", "model", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in _FIELDS])).alias("f")).select("receipt_id", "model", "f.*")
    x = long.join(voted, ["receipt_id", "field"]).join(size, "receipt_id")
    total = F.when(F.grouping("field") == 1, "(all)").otherwise(F.col("field"))
    out = x.groupingSets([["model", "n_runs", "field"], ["model", "n_runs"]], "model", "n_runs", "field")
    out = out.agg(F.count("*").alias("n"), r6(share(F.count_if(F.col("value").eqNullSafe(F.col("voted"))), F.count("*"))).alias("accuracy"), r6(F.avg("agreement")).alias("agreement"), r6(F.avg("extraction_rate")).alias("extraction_rate"), total.alias("label"))
    return out.drop("field").withColumnRenamed("label", "field")


@query(
    """with u as (select receipt_id, run, min(vendor_name) as name, min(total) as total from receipt_extractions where receipt_id is not null and length(vendor_name) between 5 and 60 group by 1, 2),
    p as (select a.receipt_id, a.name as before_name, b.name as after_name, a.total as before_total, b.total as after_total from u a join u b on a.receipt_id = b.receipt_id and a.run = 0 and b.run = 1 where trim(a.name) <> trim(b.name)),
    s as (select receipt_id || '_before' as id, true as changed, before_name as name, before_total as total from p union all select receipt_id || '_after', false, after_name, after_total from p)
    select id, changed, name, total from (select *, row_number() over (partition by changed order by id) as i from s) where i <= least((select count(*) from p), 50)"""
)
def before_after_balanced(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of a receipt that differ, within a length, one row a side under ids of their own, as many of either."""
    u = table(spark, d, "receipt_extractions").where(F.col("receipt_id").isNotNull() & F.length("vendor_name").between(5, 60)).groupBy("receipt_id", "run").agg(F.min("vendor_name").alias("name"), F.min("total").alias("total"))
    side = lambda run, c: u.where(F.col("run") == run).select("receipt_id", F.struct("name", "total").alias(c))
    p = side(0, "a").join(side(1, "b"), "receipt_id").where(F.trim("a.name") != F.trim("b.name"))
    rows = F.array(F.struct(F.lit("_before").alias("mark"), F.lit(True).alias("changed"), F.col("a.name").alias("name"), F.col("a.total").alias("total")), F.struct(F.lit("_after").alias("mark"), F.lit(False).alias("changed"), F.col("b.name").alias("name"), F.col("b.total").alias("total")))
    s = p.select("receipt_id", F.explode(rows).alias("s")).select(F.concat("receipt_id", "s.mark").alias("id"), "s.changed", "s.name", "s.total")
    return fanout.balanced(s, "changed", "id", 100)


@query(f"with {_Q} select id, category as topic, question from q where question is not null")
def embedded_json_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests whose prompt holds a record as indented JSON, taken out of the prompt again."""
    q = _questions(spark, d).where("question is not null")
    prompt = F.concat(F.lit("Scenario:\n"), F.to_json(F.struct(F.col("category").alias("topic"), "question"), {"pretty": "true", "ignoreNullFields": "false"}))
    x = q.select("id", F.substring_index(prompt, "Scenario:\n", -1).alias("j"))
    return x.select("id", F.get_json_object("j", "$.topic").alias("topic"), F.get_json_object("j", "$.question").alias("question"))


@query("select receipt_id, printf('Receipt %s, %s:', receipt_id, coalesce(min(date), 'undated')) || chr(10) || coalesce(min(vendor_name), '') as prompt from receipt_extractions where receipt_id is not null group by 1")
def receipt_prompts(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "receipt_extractions").where("receipt_id is not null").groupBy("receipt_id").agg(F.min("date").alias("date"), F.min("vendor_name").alias("name"))
    return r.select("receipt_id", F.concat(F.format_string("Receipt %s, %s:\n", "receipt_id", F.coalesce("date", F.lit("undated"))), F.coalesce("name", F.lit(""))).alias("prompt"))


@query(rf"with {_LONG} select distinct field, value from x")
def normalised_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of all fields in one column, each brought to its field's form."""
    r = table(spark, d, "receipt_extractions")
    raw = {"date": F.col("date"), "total": F.when(F.col("total").isNotNull(), F.format_string("$%.2f", F.round("total", 2))), "vendor_name": F.col("vendor_name")}
    raw = [F.struct(F.lit(n).alias("field"), c.alias("value")) for n, c in raw.items()]
    x = r.select(F.explode(F.array(*raw)).alias("f")).select("f.*")
    return x.select("field", T.normalize_value("field", "value").alias("value")).distinct()


@query(
    """with f as (select distinct sample_id, unnest(findings) as f from ensemble_results where sample_id is not null), k as (select f.bug_type as name, f.line is not null as sure from f where f.bug_type <> ''),
    c as (select name, count(*) as mentions, count(*) filter (where sure) as kept from k group by 1) select name, mentions, kept, row_number() over (order by kept desc, name) as place from c"""
)
def extract_and_filter(spark: SparkSession, d: str) -> DataFrame:
    """Lists of objects parsed from replies, flattened with their source, kept or not by their confidence, and ranked."""
    e = table(spark, d, "ensemble_results").where("sample_id is not null").select("sample_id", F.to_json(F.struct(F.col("findings").alias("companies"))).alias("reply"))
    o = e.select("sample_id", F.explode(judging.object_or_list(F.col("reply"), "companies")).alias("o")).distinct()
    x = o.select("sample_id", F.get_json_object("o", "$.bug_type").alias("name"), F.when(F.get_json_object("o", "$.line").isNull(), "low").alias("confidence"))
    x = x.withColumn("keep", updates.kept(F.col("name") != "", F.col("confidence"))).where("name <> ''")
    c = x.groupBy("name").agg(F.count("*").alias("mentions"), F.count_if("keep").alias("kept"))
    # one row a name of a defect
    return c.withColumn("place", F.row_number().over(Window.orderBy(F.desc("kept"), "name")))
