"""Operators of pipeline stages on small tables: updates, fan-out, judging, trees."""

import pytest
from pyspark.sql import functions as F

from millrace import storage
from millrace.functions import text as T
from millrace.operators import fanout, judging, metrics, ordinals, requests, trees, updates
from millrace.plans import catalogue
from millrace.sources import files


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_updates_keep_what_has_no_new_value(spark):
    records = spark.createDataFrame([(1, "old", None), (2, "old", "x"), (3, None, None), (None, "n", None)], "id int, name string, note string")
    results = spark.createDataFrame([(1, "new", ""), (2, "", "y"), (9, "z", "z")], "id int, said string, more string")
    got = updates.update_from(records, results, "id", {"name": "said", "note": "more"})
    assert rows(got, "id") == [(None, "n", None, False), (1, "new", None, True), (2, "old", "y", True), (3, None, None, False)]
    assert updates.update_from(records.limit(0), results, "id", {"name": "said"}).count() == 0


def test_comparison_of_runs(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "x", None), (3, "x", 1)], "id int, v string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", None), (4, "x", 1)], "id int, v string, n int")
    assert rows(updates.compared(a, b, "id", ["v", "n"]), "id") == [(1, "same"), (2, "changed"), (3, "removed"), (4, "added")]


def test_canonical_names_take_the_last_cluster(spark):
    c = spark.createDataFrame([(1, "A Inc", ["a", "aa"]), (2, "B Inc", ["a", None])], "cluster int, canonical string, variants array<string>")
    n = spark.createDataFrame([("a",), ("aa",), ("c",)], "name string")
    assert rows(updates.canonical_names(n, c), "name") == [("a", "B Inc"), ("aa", "A Inc"), ("c", "c")]


def test_kept_unless_low(spark):
    df = spark.createDataFrame([(True, "low"), (True, "high"), (True, None), (False, "high"), (None, None)], "m boolean, c string")
    assert [r[0] for r in df.select(updates.kept(F.col("m"), F.col("c"))).collect()] == [False, True, True, False, False]


def test_variants_runs_and_groups(spark):
    s = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, ord int")
    v = spark.createDataFrame([("p",), ("q",), ("p",), (None,)], "prompt string")
    assert len(rows(fanout.with_variants(s, v, "prompt"), "id", "prompt")) == 6
    assert rows(fanout.repeated(s, "id", 2).select("request_id"), "request_id")[:3] == [("a__run_0",), ("a__run_1",), ("b__run_0",)]
    assert fanout.repeated(s, "id", 0).count() == 0
    g = fanout.in_groups(s, 2, "id")
    assert rows(g, "group_id") == [("group-00000", ["a", "b"]), ("group-00001", ["c"])]
    assert rows(fanout.ungrouped(g, F.array(F.lit("x"))), "member") == [("a", "x"), ("b", None), ("c", "x")]


def test_allocation_stops_at_the_count(spark):
    t = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "topic string")
    got = rows(fanout.allocated(t, "topic", {"easy": 0.5, "hard": 0.5}, 5), "begin")
    assert got == [("x", "easy", 2, 0), ("x", "hard", 2, 2), ("y", "easy", 1, 4)]  # 3 * 0.5 is 1.5, rounded to even


def test_balance(spark):
    df = spark.createDataFrame([(f"k{i}", i % 3 == 0) for i in range(9)], "k string, label boolean")
    assert [r[0] for r in rows(fanout.balanced(df, "label", "k", 100).select("k"), "k")] == ["k0", "k1", "k2", "k3", "k4", "k6"]
    assert fanout.balanced(df, "label", "k", 4).count() == 4


def test_reference_lists(spark):
    df = spark.createDataFrame([("b", ["a", "b"]), ("c", ["a", None, ""]), (None, ["a"]), ("d", None), ("", None)], "best string, correct array<string>")
    got = [(r[0], r[1]) for r in df.select(judging.reference_list(F.col("best"), F.col("correct")).alias("r")).select("r", judging.bullets(F.col("r"))).collect()]
    assert got == [(["a", "b"], "- a\n- b"), (["c", "a", None, ""], "- c\n- a"), (["a"], "- a"), (["d"], "- d"), ([], "")]


@pytest.mark.parametrize(
    ("reply", "overall"),
    [('{"relevance": 0.9, "hallucination_risk": 0.1, "tone": 0.6}', 0.8), ('{"relevance": 1.2, "hallucination_risk": 0, "tone": 0}', None), ('{"relevance": 1}', None), ("no", None), ("", None), (None, None)],
)
def test_scores_within_bounds(spark, reply, overall):
    got = spark.createDataFrame([(reply,)], "r string").select(judging.overall(judging.scores(F.col("r")))).first()[0]
    assert got == (pytest.approx(overall) if overall is not None else None)


def test_tool_calls_and_lists(spark):
    text = 'a <tool_call>{"name": "search", "arguments": {"q": 1}}</tool_call> b <tool_call>\n{"x": 1}\n</tool_call><tool_call>{"name": "report"}</tool_call>'
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(judging.tool_calls(F.col("t")).alias("c")).collect()
    assert [(c.name, c.arguments) for c in got[0].c] == [("search", '{"q":1}'), ("report", None)] and not got[1].c and got[2].c == []
    both = spark.createDataFrame([('{"companies": [{"a": 1}, 3, "x"]}',), ('[{"a": 1}]',), ('{"other": []}',), ("7",), (None,)], "t string").select(judging.object_or_list(F.col("t"), "companies").alias("c")).collect()
    assert [r.c for r in both] == [['{"a":1}'], ['{"a":1}'], [], [], []]


def test_verdicts_have_defaults(spark):
    said = ['{"has_bug": true, "bugs": ["x"]}', '{"bugs": null}', None]
    got = spark.createDataFrame([(s,) for s in said], "s string").select(judging.verdict(F.col("s")).alias("v")).select("v.*").collect()
    assert [tuple(r) for r in got] == [(True, 1, True), (False, 0, True), (False, 0, False)]


@pytest.mark.parametrize(
    ("make", "cases"),
    [
        (lambda: T.weakness_label("x"), {" cwe-79 ": "CWE-79", "CWE 79": "CWE-79", "79": "CWE-79", "CWE-1": None, "none": None, "": None, None: None}),
        (lambda: T.language_name("x"), {"C++": "cpp", " Rust": "rust", "": "c", None: "c"}),
        (lambda: F.array_join(T.query_lines("x"), "|"), {"first query\n\n  short\nSEARCH this now\n second one ": "first query|second one", "\n".join(f"query {i}" for i in range(10)): "|".join(f"query {i}" for i in range(8)), "": "", None: None}),
        (lambda: F.array_join(T.urls("x"), "|"), {"see https://a.b/c, http://d.e and https://a.b/c,": "https://a.b/c,|http://d.e", "none": "", None: None}),
        (lambda: F.right(T.cache_name("x"), F.lit(4)), {"http://a/b.PNG?x=1": ".png", "http://a/b.exe": ".jpg", "http://a": ".jpg"}),
        (lambda: T.filled("a {{x}} {code}!", code=F.col("x")), {"v": "a {x} v!", "": "a {x} !", None: None}),
        (lambda: T.title_line("x"), {"one\ntwo": "one", "": "", None: None}),
        (lambda: T.json_or_empty("x"), {"```json\n[1]\n```": "[1]", "{}": "{}", "no": "{}"}),
    ],
)
def test_functions(spark, make, cases):
    df = spark.createDataFrame([(k,) for k in cases], "x string").select("x", make().alias("y"))
    assert {r.x: r.y for r in df.collect()} == cases


def test_training_messages(spark):
    t = "array<struct<role: string, content: string>>"
    df = spark.createDataFrame([(1, [("note", "n"), ("customer", "q"), ("agent", "a")], 4.0), (2, [("note", "n")], 5.0), (3, [("agent", "a")], 1.0), (4, [("agent", "a")], None)], f"id int, turns {t}, score double")
    got = requests.training_messages(df, "turns", "score", "S", {"customer": "user", "agent": "assistant"}).select("id", "messages").collect()
    assert [(r.id, [tuple(m) for m in r.messages]) for r in got] == [(1, [("system", "S"), ("user", "q"), ("assistant", "a")])]


def test_closure_and_counts(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d"), ("d", "e"), ("d", "e"), (None, "x"), ("f", None)], "parent string, child string")
    want = {"a": 4, "b": 3, "d": 1}
    pairs = trees.closure(edges)
    assert {r[0]: r[1] for r in pairs.groupBy("ancestor").count().collect()} == want == {r[0]: r[1] for r in trees.descendant_counts(edges).collect()}
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(12)], "parent string, child string")
    assert trees.closure(chain).count() == 12 * 13 // 2
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string")
    assert rows(trees.closure(ring), "ancestor", "descendant") == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")]
    with pytest.raises(ValueError, match="after 3 rounds"):
        trees.descendant_counts(ring, 3)
    assert trees.closure(edges.limit(0)).count() == 0 == trees.descendant_counts(edges.limit(0)).count()


def test_actions_and_moves(spark):
    a = spark.createDataFrame([("p", "pending"), ("t", "in_progress"), ("m", "in_progress"), ("b", "pending"), ("d", "done")], "agent_id string, status string")
    m = spark.createDataFrame([("t", 1, "user"), ("t", 2, "tool"), ("m", 1, "tool"), ("m", 2, "assistant"), *(("b", i, "user") for i in range(3))], "agent_id string, seq int, role string")
    assert rows(trees.next_actions(a, m, 3), "agent_id") == [("b", "complete"), ("d", "wait"), ("m", "wait"), ("p", "ready"), ("t", "ready")]
    state = a.withColumn("iteration", F.lit(1))
    r = spark.createDataFrame([("p", None, 2), ("t", "text", 0), ("b", "", 0)], "agent_id string, said string, n_calls int")
    assert rows(trees.moved_on(state, r), "agent_id") == [("b", "failed", 2), ("d", "done", 1), ("m", "in_progress", 1), ("p", "waiting", 2), ("t", "completed", 2)]


def test_priority_sample_and_elbow(spark):
    df = spark.createDataFrame([(f"n{i}", i) for i in range(10)], "name string, n int")
    got = rows(ordinals.priority_sample(df, "name", "n", 4), "name")
    assert [x for x in got if x[1]] == [("n8", True), ("n9", True)] and len(got) == 4
    s = spark.createDataFrame([("a", 2, 0.5), ("b", 1, 0.25), ("c", 4, 0.9)], "name string, cost int, recall double")
    assert metrics.elbow(s, "recall", "cost", "name").first().name == "a"


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", "m_1", 2), ("b", "m_1", 2), ("c", "x", 10)], "id string, model string, n int")
    assert files.write_jsonl(df, f"{tmp_path}/j") == 3
    df.select("id", F.concat(F.lit("results_"), "model", F.lit("_n"), F.col("n").cast("string")).alias("file")).write.partitionBy("file").json(f"{tmp_path}/named")
    assert rows(files.read_named_results(spark, f"{tmp_path}/named", "id string"), "id") == [("a", "m_1", 2), ("b", "m_1", 2), ("c", "x", 10)]
    with pytest.raises(ValueError, match="no topic"):
        files.read_topics(spark, f"{tmp_path}/j")


def test_staged_tables_are_deleted(spark, tmp_path):
    with storage.staged_scope():
        x = storage.stage(spark.range(3).toDF("i"))
        assert x.count() == 3
        path = storage._STAGED[-1][1].removeprefix("file://").removeprefix("file:")
    assert not list(tmp_path.__class__(path).parent.glob(tmp_path.__class__(path).name))


def test_query_lines_by_brute_force(spark, tmp_path):
    texts = {1: "How are fees set?\n\nx\nSEARCH fees\nWho pays?", 2: None, 3: " SEARCH all", 4: ""}
    spark.createDataFrame(list(texts.items()), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    from millrace.plans import stages

    got = {r.doc_id: (r.lines, r.stops) for r in stages.query_lines(spark, str(tmp_path)).collect()}
    assert got == {1: (["How are fees set?", "Who pays?"], False), 3: ([], True), 4: ([], False)}
    assert "query_lines" in catalogue.queries()


def test_index_of_cells_finds_neighbours(spark):
    import numpy as np

    from millrace.operators import vectors

    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 16))
    rows_ = [(i, (middles[i % 12] + 0.2 * rng.normal(size=16)).tolist(), 1) for i in range(600)] + [(600, None, 1), (601, [], 1), (602, [0.0] * 16, 1)]
    e = spark.createDataFrame(rows_, "vec_id long, embedding array<double>, similarity int")
    index = vectors.build_index(e)
    assert tuple(index.about.first())[:3] == (603, 600, 16) and index.cells.agg(F.sum(F.size("ids"))).first()[0] == 600
    asked = e.where("vec_id % 50 = 0")
    probes = vectors.tuned_probes(index, e, target=0.95, asked=30)
    found = vectors.search(index, asked, 10, probes)
    assert vectors.recall(found, vectors.nearest(e, asked, 10), 10).first()["recall_at_k"] >= 0.9
    assert rows(vectors.search(index, asked, 10, len(index.centroids)), "query_id", "rank") == rows(vectors.nearest(e, asked, 10), "query_id", "rank")
    assert vectors.search(vectors.build_index(e.limit(0)), asked, 3).count() == 0


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    def fake(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master=master))

    assert storage.shared_dir(fake("spark://host:7077", "hdfs://x/y")) == "hdfs://x/y"
    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            storage.shared_dir(fake(master))


def test_values_by_their_fields(spark):
    df = spark.createDataFrame([("total", "RM 1,234.5"), ("total", "x"), ("date", "31/12/2024"), ("vendor_name", "  A  B "), ("other", " As Is "), ("date", None)], "f string, v string")
    assert [r[0] for r in df.select(T.normalize_value("f", "v")).collect()] == ["1234.50", None, "2024-12-31", "a b", " As Is ", None]


def test_small_inputs_are_spread(spark):
    assert storage.spread(spark.range(10).coalesce(1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    large = spark.range(10_000_000).coalesce(1)
    assert storage.spread(large, "id").rdd.getNumPartitions() == 1 == storage.spread(spark.range(10).coalesce(1), "id", large).rdd.getNumPartitions()
