import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T


def one(spark, f, *values, kind="string"):
    df = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)], f"i int, x {kind}" if not isinstance(values[0], tuple) else "i int, x string, y string")
    return [r.v for r in df.select("i", f.alias("v")).orderBy("i").collect()]


CASES = [
    (lambda: T.normalize_string("x"), {" A  b  C\n": "a b c", "": "", None: None}),
    (lambda: T.strip_company_endings("x"), {"Acme Technologies, Inc.": "acme", "Blue-Sky Systems Corp": "blue sky", "inc": "inc", None: None, "A, LLC": "a"}),
    (lambda: F.array_join(T.name_tokens("x"), " "), {"The Acme & Co. (Holdings) Ltd": "acme", "Foo-Bar/Baz": "foo bar baz", "": "", None: None}),
    (lambda: T.normalize_number("x"), {"RM 1,234.50": 1234.5, "$9.999": 10.0, "12 USD ": 12.0, "abc": None, "": None, None: None, "-3": -3.0}),
    (lambda: T.normalize_date("x"), {"2024-02-03T10": "2024-02-03", "05/04/24": "2024-04-05", "13.04.1999": "1999-04-13", "04-13-2024": "2024-04-13", "1/2/51": "1951-02-01", " May 3 ": "may 3", None: None}),
    (lambda: T.model_answer("x"), {"x ANSWER: 1\nANSWER: **1,234.0**\n": "1234.0", r"so \boxed{48}.": "48", "The answer is: 7e3 now": "7e3", "a = 5\nend": "5", "no number": None, "": None, None: None, "ANSWER: none\n\\boxed{3}": "3"}),
    (lambda: T.gold_answer("x"), {"why #### 1,200 ": "1200", "42": "42", None: None}),
    (lambda: F.array_join(T.numbered_parts("x", 2), "|"), {"1. a\n2. b\n3. c": "a|b", "1. a": "a|", "": "|", None: None}),
    (lambda: T.first_paragraph("x", 5), {"ab\n\ncd": "ab", "abcdefgh": "abcde", None: None}),
    (lambda: T.json_text("x"), {'{"a": 1}': '{"a": 1}', 'x ```json\n{"a": 2}\n``` y': '{"a": 2}', 'so {"a": 3} ok': '{"a": 3}', "list [1, 2]": "[1, 2]", "{bad": None, "": None, None: None}),
    (lambda: T.before_last("x", "__run_"), {"a__run_1__run_2": "a__run_1", "b": None, None: None}),
    (lambda: T.slug("x", 6), {"Ab Cd Ef": "ab-cd-", None: None}),
    (lambda: T.clean_whitespace("x"), {"\n\na  \n\n\n\nb\t\n": "a\n\nb", "": "", None: None}),
    (lambda: T.strip_marked_lines("x"), {"a\n#ifndef OMITBAD\nb\n#endif\nc": "a\nb\nc", None: None}),
    (lambda: T.truthy("x"), {"a": True, "": False, None: False}),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_functions(spark, case):
    f, table = CASES[case]
    assert one(spark, f(), *table) == list(table.values())


def test_same_answer(spark):
    rows = [("5.0", "5", True), ("1,000", "1000", True), ("Yes ", "yes", True), ("a", "b", False), (None, "5", False), ("5", None, False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean").withColumn("got", T.same_answer("a", "b"))
    assert df.where(~F.col("got").eqNullSafe(F.col("want"))).count() == 0


def test_padded_id_grows(spark):
    assert [r[0] for r in spark.range(2).select(T.padded_id("x-", F.when(F.col("id") == 0, 7).otherwise(1234567))).collect()] == ["x-000007", "x-1234567"]
