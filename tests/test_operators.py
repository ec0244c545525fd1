import itertools
import math
import random
import re
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from millrace.functions.similarity import lcs_length
from millrace.functions.text import STOP_TOKENS
from millrace.operators import entities, metrics, ordinals, requests, trees, vectors, voting


def test_ordinals_and_chunks(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1000).repartition(6)
    rows = ordinals.in_chunks(df, 300, "k").collect()
    assert all(r.ord == r.k and r.chunk == r.k // 300 for r in rows) and len(rows) == 1000
    assert ordinals.in_chunks(df.limit(0), 300, "k").collect() == []


def test_last_wins(spark):
    rows = [("a", 1, "x"), ("a", 3, None), ("a", 2, "z"), (None, 9, "n"), ("b", None, "w")]
    got = {r.k: r.v for r in ordinals.last_wins(spark.createDataFrame(rows, "k string, t int, v string"), "k", "t").collect()}
    assert got == {"a": None, "b": "w"}


def test_binary_and_empty_denominators(spark):
    df = spark.createDataFrame([("m", True, True), ("m", True, None), ("m", None, True), ("n", False, False)], "m string, p boolean, a boolean")
    got = {r.m: r for r in metrics.binary(df, "p", "a", "m").collect()}
    assert (got["m"].tp, got["m"].fp, got["m"].fn, got["m"].precision) == (1, 1, 1, 0.5)
    assert got["n"].precision == 0 and got["n"].accuracy == 1


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0.0, True), (0.2, False), (0.6, True), (1.0, True), (None, True)], "c double, ok boolean")
    assert [(r.bin, r.predictions, r.correct) for r in metrics.calibration(df, "c", "ok").orderBy("bin").collect()] == [(0, 1, 1), (1, 1, 0), (2, 0, 0), (3, 1, 1), (4, 1, 1)]
    assert [r.predictions for r in metrics.calibration(df, "c", "ok", closed=False).orderBy("bin").collect()] == [1, 1, 0, 1, 0]


def test_field_votes_and_ties(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, None), (2, 0, None), (3, 0, "b"), (3, 1, "a"), (3, 2, "a")], "k int, run int, f string")
    got = {r.k: (r.value, round(r.agreement, 3), round(r.extraction_rate, 3)) for r in voting.field_votes(df, "k", "run", {"f": F.col("f")}).collect()}
    assert got == {1: ("a", 0.5, 0.667), 2: (None, 0.0, 0.0), 3: ("a", 0.667, 1.0)}


def test_ensemble(spark):
    df = spark.createDataFrame([("s", True), ("s", False), ("t", None), ("u", True), ("u", True), ("u", False)], "s string, has_bug boolean")
    got = {r.s: r for r in voting.ensemble(df, "s").collect()}
    assert got["s"].predicted and got["s"].confidence == 0 and got["s"].is_split
    assert not got["t"].predicted and got["t"].total_votes == 0 and got["t"].confidence == 0
    assert abs(got["u"].confidence - 1 / 3) < 1e-9


def brute_pairs(names):
    """Every pair by the definition: percent of letters in common order, and of tokens in common, weighed 6 to 4."""
    tokens = {n: [t for t in re.findall(r"[^\s.,/&()-]+", n.lower()) if t not in STOP_TOKENS] for n in names}

    def of_letters(x, y):
        return (Decimal(200 * lcs_length(x, y)) / (len(x) + len(y))).quantize(Decimal(1), ROUND_HALF_UP)

    def of_tokens(x, y):
        return 100 * len({*x} & {*y}) / len({*x, *y})

    pairs = [(a, b) for a, b in itertools.combinations(sorted(tokens), 2) if not set(tokens[a]).isdisjoint(tokens[b])]
    letters = {p: int(of_letters(*(" ".join(tokens[n]) for n in p))) for p in pairs}
    scores = {p: math.trunc(0.6 * letters[p] + 0.4 * of_tokens(*map(tokens.get, p))) for p in pairs}
    return {p: (letters[p], n) for p, n in scores.items() if n >= 70}


def test_scored_pairs_against_all_pairs(spark):
    rng = random.Random(6)
    words = ["acme", "acmes", "blue", "sky", "river", "rivers", "stone", "gold", "international", "services"]
    names = [" ".join(rng.sample(words, rng.randrange(1, 5))) + rng.choice(["", " Inc", ", LLC", " Group"]) for _ in range(150)] + ["", "Inc", "acme acme blue"]
    df = spark.createDataFrame([(n, 1) for n in names] + [(None, 1)], "name string, token int")
    got = {(r.name_a, r.name_b): (r.fuzzy, r.score) for r in entities.scored_pairs(df).collect()}
    assert got == brute_pairs(names)
    assert entities.scored_pairs(df.limit(0)).collect() == []


def test_scored_pairs_of_misspelt_and_long_names(spark):
    rng = random.Random(7)
    own = ["".join(rng.choice("aeioubdgklmnrst") for _ in range(rng.randrange(4, 10))) for _ in range(25)]

    def typed(word):
        i = rng.randrange(len(word))
        return word[:i] + rng.choice(["", "x", word[i] * 2]) + word[i + 1 :] if rng.random() < 0.3 else word

    names = [" ".join(typed(w) for w in rng.sample(own[:9], rng.randrange(1, 8))) + rng.choice(["", " financial services", " fund"]) for _ in range(220)]
    names += ["a" * 450 + " b c", "a" * 449 + " b c", "a" * 449 + " bc", " ".join(own), " ".join(own[1:])]
    got = {(r.name_a, r.name_b): (r.fuzzy, r.score) for r in entities.scored_pairs(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == brute_pairs(names) and len(got) > 50


def test_frequent_tokens_alone_make_no_pairs(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeiou") + rng.choice("bdfgklmnprstvz") for _ in range(4))
    names = sorted({f"{word()} {word()} financial services" for _ in range(400)})
    staged = {}

    def counted(df, name="stage", stage=entities.stage):
        out = stage(df, name)
        staged[name] = out.count()
        return out

    monkeypatch.setattr(entities, "stage", counted)
    assert entities.scored_pairs(spark.createDataFrame([(n,) for n in names], "name string")).count() == len(brute_pairs(names))
    assert staged["near-pairs"] < len(names)  # all pairs share two tokens of four: 79,800


def test_automatic_pairs_without_the_other_candidates(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("aeiou") + rng.choice("bdfgklmnprstvz") for _ in range(n))
    own, long, longer = [word(4) for _ in range(12)], [word(8) for _ in range(14)], [word(15) for _ in range(7)]
    names = sorted({f"{a} {b} financial services" for a, b in itertools.combinations(own, 2)})
    some = names[::6]
    names += [n.upper() for n in some] + [f"The {n}, Inc." for n in some] + [" ".join(n.split()[::-1]) for n in some] + [n + " services" for n in some]
    # one token of eight, fifteen or sixteen differs, which leaves just enough; and one of seven, which doesn't
    names += [" ".join(longer + x) for x in ([], ["a"])] + [" ".join(long + x) for x in ([], ["x"], ["y"], ["xy"])] + [" ".join(longer[:6] + x) for x in ([], ["a"])]
    staged = {}

    def counted(df, name="stage", stage=entities.stage):
        out = stage(df, name)
        staged[name] = out.count()
        return out

    monkeypatch.setattr(entities, "stage", counted)
    got = {(r.name_a, r.name_b): (r.fuzzy, r.score) for r in entities.scored_pairs(spark.createDataFrame([(n,) for n in names], "name string"), threshold=95).collect()}
    every = brute_pairs(names)
    assert got == {p: v for p, v in every.items() if v[1] >= 95}
    assert len(every) > 5 * len(got) and (" ".join(longer), " ".join(longer + ["a"])) in got and (" ".join(long + ["x"]), " ".join(long + ["y"])) in got
    assert staged["names"] == 5 * len(some) + 8  # others have no name that they may pair with


def test_found_in(spark):
    wanted = spark.createDataFrame([("1", "Acme Inc", None), ("2", "Zed", ["Zed Systems", "Blue"]), ("3", "abc", [])], "id string, name string, aliases array<string>")
    names = spark.createDataFrame([("The Acme of X",), ("blue, llc",), ("abcd",), (None,)], "name string")
    assert {r.id: r.found for r in entities.found_in(wanted, names).collect()} == {"1": True, "2": True, "3": False}


def test_merged_clusters(spark):
    rows = [(1, "Acme Inc", "", "x"), (2, "ACME", "d1", "y"), (3, "acme corp", "d2", None), (4, None, "d", "z")]
    r = entities.merged_clusters(spark.createDataFrame(rows, "ord int, name string, text string, tag string"), "name", "ord", {"first": "text"}, {"last": "text"}, {"tags": "tag"}).collect()
    assert [tuple(x) for x in r] == [("acme", ["ACME", "Acme Inc", "acme corp"], 3, "d1", "d2", ["x", "y"])]


def test_nearest_against_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectors, "ROWS_PER_BLOCK", 16)
    monkeypatch.setattr(vectors, "QUERIES_PER_BLOCK", 4)
    rng = np.random.default_rng(0)
    v = rng.normal(size=(120, 8))
    v[7] = v[3]
    v[9] = 0
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(500, None), (501, [])], "vec_id long, embedding array<float>")
    got = {}
    for r in vectors.nearest(df, df.where("vec_id % 10 = 0"), 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    u = v.astype(np.float32).astype(float)
    u = u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-30)
    for q in range(0, 120, 10):
        order = sorted((i for i in range(120) if i not in (q, 9)), key=lambda i: (-round(float(u[q] @ u[i]), 6), i))[:5]
        assert [got[q][k] for k in range(1, 6)] == order


def test_closure_and_expansion(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)] + [("n0", "m"), (None, "x")], "parent string, child string")
    got = {r.ancestor: r.n for r in trees.closure(chain).groupBy("ancestor").agg(F.count("*").alias("n")).collect()}
    assert got == {"n0": 10} | {f"n{i}": 9 - i for i in range(1, 9)}
    step = lambda f: f.join(chain.withColumnRenamed("parent", "node"), "node").select("node", "child")
    rows = trees.expand(spark.createDataFrame([("n0",)], "node string"), step, 2).collect()
    assert {(r.node, r.depth) for r in rows} == {("n0", 0), ("n1", 1), ("m", 1), ("n2", 2)}


def test_status_and_usage(spark):
    schema = "error struct<code: string>, response struct<body: struct<choices: array<struct<message: struct<content: string>>>, usage: struct<prompt_tokens: bigint, completion_tokens: bigint>>>, m string"
    ok = ([(("hi",),)], (3, 4))
    rows = [(None, (ok,), "a"), (None, (([], None),), "a"), (("x",), None, "b"), (None, (([(("",),)], (1, None)),), "b"), (None, None, "b")]
    df = spark.createDataFrame(rows, schema)
    assert sorted(r[0] for r in df.select(requests.status()).collect()) == ["empty", "error", "no_choices", "no_choices", "ok"]
    assert {r.m: (r.requests, r.prompt_tokens, r.completion_tokens) for r in requests.usage(df, "m").collect()} == {None: (5, 4, 4), "a": (2, 3, 4), "b": (3, 1, 0)}


@pytest.mark.parametrize("per_chunk", [2, 10])
def test_files(spark, tmp_path, per_chunk):
    from millrace.sources import files

    lines = spark.createDataFrame([(i, f'{{"custom_id": "q{i % 3}", "response_body": {{"choices": [{{"message": {{"content": "c{i}"}}}}]}}}}') for i in range(5)], "i int, line string")
    files.write_requests(lines, str(tmp_path / "out"), per_chunk, "i")
    chunks = spark.read.text(str(tmp_path / "out"))
    assert chunks.count() == 5 and chunks.select("chunk").distinct().count() == -(-5 // per_chunk)
    flat = tmp_path / "flat.jsonl"
    flat.write_text("\n\n".join(r.line for r in lines.orderBy("i").collect()) + "\n")
    got = {r.custom_id: r.c for r in files.read_results(spark, str(flat)).select("custom_id", requests.content().alias("c")).collect()}
    assert got == {"q0": "c3", "q1": "c4", "q2": "c2"}
    (tmp_path / "n.csv").write_text("company,Name\nA,\n,B\n ,\n")
    assert [r.name for r in files.read_names(spark, str(tmp_path / "n.csv")).collect()] == ["A", "B"]
    (tmp_path / "w.json").write_text('{"fields": ["cik", "name"], "data": [["1", "A"], ["2", null]]}')
    assert [(r.pos, r.cik, r.name) for r in files.read_wide_json(spark, str(tmp_path / "w.json")).collect()] == [(0, "1", "A"), (1, "2", None)]
