import pytest

from millrace.llm import pairs

Q = "What does Vofehos Foods sell and where is it based?"
LONG = "Vofehos Foods is based in Arden and sells a label printer. The firm was started by Ann in 1983 with 60 people."


@pytest.mark.parametrize("text", [None, "", " \n\t", " ", "​", "...", "?", "—", "null", "N/A", "(no answer)", "{}", '""', "```\n```", "<answer></answer>", "Answer:", '{"answer": ""}'])
def test_empty(text):
    assert pairs.is_empty(text)


@pytest.mark.parametrize("text", ["Yes.", "42", "\\boxed{7}", "No", '{"answer": "x"}', "Sí."])
def test_not_empty(text):
    assert not pairs.is_empty(text)


@pytest.mark.parametrize(
    ("question", "text", "want"),
    [
        (Q, "I'm sorry, but I can't help with that, and I hope you understand.", pairs.REFUSAL),
        (Q, '{"answer": "You are asking about Arden. To be upfront, it would not be appropriate for me to comment."}', pairs.REFUSAL),
        ("Wie lautet die Summe?", "Leider: dabei kann ich nicht helfen. Fragen Sie mich gern etwas anderes.", pairs.REFUSAL),
        (Q, "I'm sorry to hear about the delay; the steps below usually settle it. " + LONG, None),
        (Q, Q.upper(), pairs.COPY),
        (Q, "**What does Vofehos Foods sell and where is it basde?**\n\nAnswer:", pairs.COPY),
        (Q, Q + "\n\n" + LONG, None),
        (Q, "Vofehos Foods vend du matériel de mesure et la société a son siège à Arden.", pairs.LANGUAGE),
        ("Translate into French: The firm is based in Arden.", "La société a son siège à Arden.", None),
        ("Translate into French: The firm is based in Arden.", "Die Firma hat ihren Sitz in Arden und verkauft Geräte für Werkstätten.", pairs.LANGUAGE),
        (Q, LONG[:-20], pairs.TRUNCATED),
        (Q, LONG + "\n\n```python\nx = 1\nfor i in", pairs.TRUNCATED),
        (Q, '{"reasoning": "Vofehos Foods is based in', pairs.TRUNCATED),
        (Q, "1. Vofehos Foods is based in Arden.\n2.", pairs.TRUNCATED),
        (Q, LONG, None),
        (Q, "A label printer", None),
        (Q, "First, the sum is 12. So we are done.\n\nANSWER: 12", None),
        (Q, '{"answer": "A label printer.", "confidence": "low"}', None),
        (None, None, pairs.EMPTY),
        (None, LONG, None),
    ],
)
def test_one_pair(spark, question, text, want):
    assert run(spark, [(1, "q", text, None)], [("q", question)]) == ({1: want} if want else {})


SCHEMA = "result_id long, custom_id string, content string, error struct<code: string, message: string>"


def run(spark, results, questions):
    r = spark.createDataFrame(results, SCHEMA).selectExpr("result_id", "custom_id", "struct(struct(array(struct(struct(content) as message)) as choices) as body) as response", "error", "1 as question", "2 as defect")
    q = spark.createDataFrame([(*x, 1) for x in questions], "id string, question string, w1 int")
    rows = pairs.defects(r, q).collect()
    assert len({x.result_id for x in rows}) == len(rows)
    return {x.result_id: x.defect for x in rows}


def test_tables(spark):
    terse = [(100 + i, "q", "Check the lease and the meters", None) for i in range(6)]
    inner = [(200 + i, "q", "Check the lease and the meters of each floor.", None) for i in range(40)]
    rows = [(1, "q", None, None), (1, "q", None, None), (2, "none", "", None), (3, "q", None, ("timeout", "")), (4, "q", LONG + " word" * 60_000 + ".", None), (5, "q", "Check the lease and the", None), (None, "q", "", None)]
    assert run(spark, rows + terse + inner, [("q", Q), ("q", Q), (None, Q)]) == {1: pairs.EMPTY, 2: pairs.EMPTY, 5: pairs.TRUNCATED}
    assert run(spark, [], []) == {}


def test_null_levels_of_the_response(spark):
    schema = "result_id long, custom_id string, response struct<body: struct<choices: array<struct<message: struct<content: string>>>>>, error struct<code: string>"
    rows = [(1, "q", None, None), (2, "q", (None,), None), (3, "q", ((None,),), None), (4, "q", (([],),), None), (5, "q", (([(None,)],),), None), (6, "q", (([((None,),)],),), None)]
    got = pairs.defects(spark.createDataFrame(rows, schema), spark.createDataFrame([("q", Q)], "id string, question string")).collect()
    assert sorted(tuple(r) for r in got) == [(i, pairs.EMPTY) for i in range(1, 7)]


EXPLAINED = "I understand why you ask. I can't help with that. My guidelines rule out this kind of advice, since a mistake could do harm to people who rely on it. This policy holds for every topic of this sort. Thank you for understanding. Please let me know if you need something else."


@pytest.mark.parametrize(
    ("question", "text", "want"),
    [
        (Q, "You are asking about Dunhollow. I apologize; answering would go against my guidelines. Is there anything else you would like to talk about?", True),
        (Q, EXPLAINED, True),
        (Q, f"{Q} That is what was asked here. I thought about it. I must decline this request.", True),
        (Q, "I can't help with that guess, but " + LONG, False),
        (Q, "I can't help with that. " + LONG, False),
        (Q, LONG + " I'm not able to answer this.", False),
    ],
)
def test_refusals_by_what_else_is_said(question, text, want):
    assert pairs.is_refusal(text, question) == want


@pytest.mark.parametrize(
    "text",
    ["I refuse to answer.", "I must respectfully decline.", "As an AI language model, I am not permitted to discuss this.", "Sorry, I won't do that.", "I'm sorry, but I don't have the ability to do that.", "Unfortunately I'm not in a position to assist here.",
     "Je ne peux malheureusement pas répondre à cela.", "Ich darf dazu leider nichts sagen und kann das nicht beantworten.", "Lo siento, no puedo comentar ese asunto."],
)
def test_refusals_of_other_wordings(text):
    assert pairs.is_refusal(text, Q)


@pytest.mark.parametrize("text", ["The tenant may refuse to pay.", "We cannot deliver before May.", "I think the firm is in Arden.", "The lessor must decline it in writing.", "No, the buyer cannot share the key."])
def test_answers_that_only_sound_like_refusals(text):
    assert not pairs.is_refusal(text, Q)
