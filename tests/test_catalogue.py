"""Queries over small tables with names and texts beyond ASCII."""

from millrace.functions.text import NAME_ENDINGS
from millrace.plans import catalogue

NBSP = "\u00a0"


def run(spark, folder, query, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return catalogue.queries()[query](spark, str(folder)).collect()


def test_first_paragraph_in_any_script(spark, tmp_path):
    long = {"ru": "Это первый абзац. " * 4, "zh": "这是第一段。" * 12, "fr": "Voilà le début d’un texte assez long pour compter.", "astral": "\U0001f600" * 60, "ascii": "A plain paragraph that is long enough to be kept here."}
    texts = {k: f"{NBSP} {v}\u3000\n\nmore" for k, v in long.items()} | {"one": "é" * 700, "short": "é" * 49 + NBSP + "\n\n" + "x" * 99, "edge": "é" * 50 + "\n\n", "null": None}

    def brute(t):
        p = (t.split("\n\n", 1)[0] if "\n\n" in t else t[:500]).strip()
        return p if len(p) >= 50 else None

    want = {k: p for k, t in texts.items() if t is not None and (p := brute(t))}
    rows = run(spark, tmp_path, "first_paragraph", documents=(list(texts.items()), "doc_id string, text string"))
    assert {r.doc_id: r.paragraph for r in rows} == want and set(want) == {*long, "one", "edge"}


def normal(name):
    s = name.lower().strip()
    for e in NAME_ENDINGS:
        s = s.removesuffix(e)
    return " ".join(s.replace("-", " ").replace(",", "").replace(".", "").split())


NAMES = ["Café Olé Inc", "CAFÉ OLÉ", f"Café{NBSP}Olé, Inc.", f"{NBSP}café-olé{NBSP}", "Zürich Systems", "ZÜRICH", "Plain Corp", "plain", "株式会社", "Ёлка LLC", "ёлка", None]


def test_clusters_of_names_beyond_ascii(spark, tmp_path):
    rows = [(f"i{k:02d}", n, f"T{k:02d}", "X", "web", k) for k, n in enumerate(NAMES)]
    want = {}
    for n in filter(None, NAMES):
        want.setdefault(normal(n), set()).add(n)
    records = {"company_records": (rows, "id string, name string, ticker string, exchange string, origin string, created_at int")}
    got = run(spark, tmp_path, "cluster_merge", **records)
    assert {r.canonical: set(r.variants) for r in got} == want and len(want["café olé"]) == 4
    assert {r.canonical: r.mention_count for r in got} == {k: len(v) for k, v in want.items()}
    got = run(spark, tmp_path, "duplicate_clusters", **records)
    assert {(r.norm, r.spellings, r.records) for r in got} == {(k, len(v), len(v)) for k, v in want.items() if len(v) > 1}


def test_recall_of_names_beyond_ascii(spark, tmp_path):
    pairs = ([(f"Café{NBSP}Olé, Inc.", "ZÜRICH"), (None, "Plain Corp")], "name_a string, name_b string")
    refs = ([(1, "CAFÉ OLÉ", None), (2, "Other", ["Zürich Systems"]), (3, "plain", None), (4, "Cafe Ole", None)], "id int, name string, aliases array<string>")
    rows = run(spark, tmp_path, "reference_recall", match_pairs=pairs, ref_companies=refs)
    assert {r.id: r.found for r in rows} == {1: True, 2: True, 3: True, 4: False}


def test_field_votes_with_vendors_beyond_ascii(spark, tmp_path):
    rows = [(1, 0, "m", "2024-01-02", 3.5, f"Café{NBSP} Olé"), (1, 1, "n", "2024-01-02", 3.5, "CAFÉ OLÉ"), (1, 2, "n", "2024-01-03", 4.5, "Cafe"), (2, 0, "m", None, 1.0, None)]
    receipts = {"receipt_extractions": (rows, "receipt_id int, run int, model string, date string, total double, vendor_name string")}
    got = {(r.receipt_id, r.field): (r.value, r.agreement, r.extraction_rate) for r in run(spark, tmp_path, "field_vote", **receipts)}
    two = round(2 / 3, 6)
    assert got == {
        (1, "vendor_name"): ("café olé", two, 1.0), (1, "date"): ("2024-01-02", two, 1.0), (1, "total"): ("3.50", two, 1.0),
        (2, "vendor_name"): (None, 0.0, 0.0), (2, "date"): (None, 0.0, 0.0), (2, "total"): ("1.00", 1.0, 1.0),
    }
    got = {(r.model, r.field): (r.n, r.accuracy) for r in run(spark, tmp_path, "field_accuracy", **receipts)}
    assert got == {(m, f): (2, a) for m, a in (("m", 1.0), ("n", 0.5)) for f in ("vendor_name", "date", "total")}


def test_every_result_has_its_answer_or_null(spark, tmp_path):
    said = {1: "The answer is 12.", 2: "No number here.", 3: None, 4: "ANSWER: douze", 5: "Ответ: ANSWER: 7"}
    body = lambda t: ([({"content": t},)],) if t is not None else None
    rows = [(k, str(k), "m", None, body(t)) for k, t in said.items()] + [(6, "6", "m", "failed", body("ANSWER: 1"))]
    schema = "result_id int, custom_id string, model string, error string, response struct<body: struct<choices: array<struct<message: struct<content: string>>>>>"
    rows = [(*r[:4], (r[4],) if r[4] else None) for r in rows]
    got = run(spark, tmp_path, "answer_extract", batch_results=(rows, schema))
    assert {r.result_id: r.answer for r in got} == {1: "12", 2: None, 3: None, 4: None, 5: "7"} and len(got) == 5


def test_company_pipeline_where_frequent_tokens_are_shared(spark, tmp_path, monkeypatch):
    import itertools

    from millrace.operators import entities

    words = ["".join(x) for x in itertools.product(("bad", "kel", "gom", "tuf"), ("izor", "upan", "evih", "oluk"), ("ast", "eck"))]
    names = [f"{a} {b} Financial Services" for a, b in zip(words * 6, words[5:] + words[9:] + words[17:] + words[3:] + words[25:] + words[30:]) if a != b]
    rows = [(f"r{i}", n, "web") for i, n in enumerate(sorted(set(names)))] + [("late", f"{names[0].upper()} Inc", "web"), ("late2", f"The {names[0]}", "file")]
    staged = {}

    def counted(df, name="stage", stage=entities.stage):
        out = stage(df, name)
        staged[name] = out.count()
        return out

    monkeypatch.setattr(entities, "stage", counted)
    got = run(spark, tmp_path, "company_pipeline", company_records=(rows, "id string, name string, origin string"))
    # the upper-case spelling is the least of the three; both others are later names of automatic pairs
    assert [(r.value, r.n) for r in got] == [("web", len(rows) - 2)]
    assert staged["near-pairs"] < len(rows) ** 2 / 10  # two tokens of four are shared by all


def test_company_pipeline_looks_for_automatic_pairs_alone(spark, tmp_path, monkeypatch):
    import itertools

    from millrace.operators import entities

    words = ["".join(x) for x in itertools.product(("bad", "kel", "gom", "tuf"), ("izor", "upan", "evih"))]
    names = [f"{a} {b} Services" for a, b in itertools.combinations(words, 2)]
    rows = [(f"r{i}", n, "web") for i, n in enumerate(names)] + [("late", f"The {names[0]}", "file"), ("odd", "Inc", "file"), ("null", None, "file"), (None, names[1].upper(), "web")]
    staged = {}

    def counted(df, name="stage", stage=entities.stage):
        out = stage(df, name)
        staged[name] = out.count()
        return out

    monkeypatch.setattr(entities, "stage", counted)
    got = run(spark, tmp_path, "company_pipeline", company_records=(rows, "id string, name string, origin string"))
    # of the two spellings of names[0] the one without "The" is the later one
    assert sorted((r.value, r.n) for r in got) == [("file", 3), ("web", len(names) - 1)]
    assert (staged["names"], staged["near-pairs"]) == (2, 1)  # many others score 70 and more, which nothing here asks for
