"""Source code as text: fenced blocks and comments."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions.text import clean_whitespace, strip_marked_lines

#: A string or character literal (kept), or a comment (only its line ends are kept).
_PART = re.compile(r"""("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|//[^\n]*|/\*.*?(?:\*/|\Z)""", re.S)


def without_comments(code: str) -> str:
    """C-like code without // and /* */ comments; literals and the number of lines stay as they are."""
    return _PART.sub(lambda m: m[1] if m[1] else "\n" * m[0].count("\n"), code)


@F.pandas_udf(StringType())
def strip_comments(code: pd.Series) -> pd.Series:
    return code.map(without_comments, na_action="ignore")


def preprocess(c: Column) -> Column:
    """Comments, marked lines and surplus white space gone."""
    return clean_whitespace(strip_marked_lines(strip_comments(c)))


def fenced(c: str | Column) -> Column:
    """The fenced blocks of a text: an array of (language, code)."""
    s = F.col(c) if isinstance(c, str) else c
    blocks = F.regexp_extract_all(s, F.lit(r"(?s)(```[A-Za-z+#]*\n.*?\n```)"), F.lit(1))
    return F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, "^```([A-Za-z+#]*)", 1).alias("language"), F.regexp_extract(b, r"(?s)^```[A-Za-z+#]*\n(.*)\n```$", 1).alias("code")))


def _function(c: Column, name: str) -> Column:
    """The first function whose name matches, from its signature to a brace at a line's start; null without one."""
    return F.nullif(F.regexp_extract(c, rf"(?s)((?:static\s+)?void\s+{name}\s*\([^)]*\)\s*\{{.*?\n\}})", 1), F.lit(""))


def bad_function(c: Column) -> Column:
    return _function(c, r"(?:\w+_)?bad")


def good_function(c: Column) -> Column:
    return _function(c, r"(?:good\w*|\w+_good\w*)")


def weakness_of_path(path: Column) -> Column:
    """CWE-n of a path that holds CWE<n>_; null without."""
    n = F.regexp_extract(path, r"CWE(\d+)_", 1)
    return F.when(n != "", F.concat(F.lit("CWE-"), n))
