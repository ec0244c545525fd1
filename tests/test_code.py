import pytest
from pyspark.sql import functions as F

from millrace.functions import code


@pytest.mark.parametrize(
    ("text", "want"),
    [("a; // x\nb", "a; \nb"), ('s = "// no"; /* y\nz */ t', 's = "// no"; \n t'), ("'\\'' // q", "'\\'' "), ("/* open\nend", "\n"), ("", ""), ('"a\\"//b" /**/c', '"a\\"//b" c')],
)
def test_comments(text, want):
    assert code.without_comments(text) == want


def test_fenced_code(spark):
    df = spark.createDataFrame([(1, "x\n```c\nint a; // n\n\n\n\nb;\n```\ny\n```python\nz\n```"), (2, None), (3, "none")], "i int, t string")
    rows = df.select("i", F.posexplode(code.fenced("t")).alias("p", "b")).select("i", "p", "b.language", code.preprocess(F.col("b.code")).alias("c")).orderBy("p").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "c", "int a;\n\nb;"), (1, 1, "python", "z")]
