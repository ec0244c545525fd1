"""Text, number, date and answer functions as Column builders; none needs Python in the tasks.

Null in, null out, unless said otherwise. White space is Unicode white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that name no company, and endings that are cut off a company's name, in this order.
STOP_TOKENS = ["inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "llp", "lp", "plc", "sa", "nv", "ag", "gmbh", "group", "holdings", "holding", "the", "of", "and", "&", "a", "an"]
NAME_ENDINGS = [", inc.", ", inc", " inc.", " inc", ", llc", " llc", ", ltd", " ltd", " corporation", " corp.", " corp", " technologies", " technology", " networks", " systems"]
#: Patterns of numbers, of the forms in which an answer is stated, of currency marks and of dates.
NUMBER = r"-?\d+(?:,\d{3})*(?:\.\d+)?(?:[eE][+-]?\d+)?"
BARE_NUMBER = r"-?\d+(?:\d{3})*(?:\.\d+)?(?:[eE][+-]?\d+)?"
ANSWER_LINE, BOXED, GOLD_MARK = r"(?i)ANSWER:\s*(.+?)(?:\n|$)", r"\\boxed\{([^}]+)\}", r"####\s*(.+)"
STATED = [rf"(?i)(?:the\s+)?answer\s+is\s*:?\s*({NUMBER})", rf"(?i)(?:final\s+)?answer\s*[:=]\s*({NUMBER})", rf"(?m)=\s*({NUMBER})\s*$"]
CURRENCY = r"(?i)^[$£€¥₹]|RM\s*|USD\s*|MYR\s*"
ISO_DATE, DAY_MONTH_YEAR = r"^\d{4}-\d{2}-\d{2}", r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def truthy(c: str | Column) -> Column:
    """Set and not empty; never null."""
    return F.coalesce(_col(c) != "", F.lit(False))


def normalize_string(c: str | Column) -> Column:
    """Lower case, outer white space gone, inner runs of it one space."""
    return F.regexp_replace(strip(F.lower(_col(c))), r"(?U)\s+", " ")


def name_tokens(c: str | Column) -> Column:
    """A name's lower-case tokens without company words, in order, repeats kept."""
    words = F.split(F.lower(_col(c)), r"[\s.,/&()-]+")
    stop = F.array(*map(F.lit, STOP_TOKENS))
    return F.filter(words, lambda t: (t != "") & ~F.array_contains(stop, t))


def strip_company_endings(c: str | Column) -> Column:
    """Each ending is cut once at most, one after another; then commas and full stops go, hyphens become spaces."""
    cut = lambda name, e: F.when(F.endswith(name, e), F.left(name, F.length(name) - F.length(e))).otherwise(name)
    name = F.aggregate(F.array(*map(F.lit, NAME_ENDINGS)), strip(F.lower(_col(c))), cut)
    return strip(F.regexp_replace(F.translate(name, "-,.", " "), r"(?U)\s+", " "))


def normalize_number(c: str | Column) -> Column:
    """A typed amount as a double of two places; currency marks go, what is no number is null."""
    s = F.regexp_replace(strip(_col(c)), CURRENCY, "")
    return F.round(strip(F.replace(s, F.lit(","), F.lit(""))).try_cast("double"), 2)


def normalize_date(c: str | Column) -> Column:
    """YYYY-MM-DD from a leading ISO date or day/month/year (month first only where it must be); else the text in lower case.

    Two-digit years below 50 are of this century. Dates aren't checked against a calendar.
    """
    s = strip(_col(c))
    part = lambda i: F.regexp_extract(s, DAY_MONTH_YEAR, i)
    a, b = (part(i).try_cast("int") for i in (1, 2))
    y = part(3)
    year = F.when(F.length(y) == 2, y.try_cast("int") + F.when(y.try_cast("int") < 50, 2000).otherwise(1900)).otherwise(y.try_cast("int"))
    month_first = (a <= 12) & (b > 12)
    day, month = F.when(month_first, b).otherwise(a), F.when(month_first, a).otherwise(b)
    iso = F.regexp_extract(s, ISO_DATE, 0)
    return F.when(iso != "", iso).when(part(3) != "", F.format_string("%04d-%02d-%02d", year, month, day)).otherwise(F.lower(s))


def normalize_value(field: str | Column, value: str | Column) -> Column:
    """A field's value as text in the form its name asks for: totals with two places, dates as ISO, names in lower case; others as they are."""
    f, v = _col(field), _col(value)
    amount = F.format_string("%.2f", normalize_number(v))
    return F.when(f.isin("total", "subtotal", "tax"), F.when(normalize_number(v).isNotNull(), amount)).when(f == "date", normalize_date(v)).when(f == "vendor_name", normalize_string(v)).otherwise(v)


def clean_number(c: str | Column) -> Column:
    """The first number in a text, without mark-up, grouping commas and final full stops; null if there is none."""
    s = F.regexp_replace(strip(F.regexp_replace(_col(c), r"[*$\\{}]", "")), r"\.+$", "")
    found = F.regexp_extract(F.replace(s, F.lit(","), F.lit("")), BARE_NUMBER, 0)
    return F.nullif(found, F.lit(""))


def model_answer(c: str | Column) -> Column:
    """The final answer a response states: its last ``ANSWER:``, a boxed number, "answer is", or "=" at a line's end."""
    s = _col(c)
    last = F.try_element_at(F.regexp_extract_all(s, F.lit(ANSWER_LINE), F.lit(1)), F.lit(-1))
    boxed = F.regexp_extract(s, BOXED, 1)
    return F.coalesce(clean_number(last), clean_number(boxed), *(clean_number(F.regexp_extract(s, f, 1)) for f in STATED))


def gold_answer(c: str | Column) -> Column:
    """What stands behind #### on its line, without commas; the whole text where there is no such mark."""
    s = _col(c)
    found = F.regexp_extract(s, GOLD_MARK, 1)
    return F.when(found != "", F.replace(strip(found), F.lit(","), F.lit(""))).otherwise(strip(s))


def same_answer(a: str | Column, b: str | Column) -> Column:
    """Equal as text without commas and case, or as numbers within 1e-6; false if either is null."""
    x, y = (F.lower(F.replace(strip(_col(c)), F.lit(","), F.lit(""))) for c in (a, b))
    return F.coalesce((x == y) | F.coalesce(F.abs(x.try_cast("double") - y.try_cast("double")) < 1e-6, F.lit(False)), F.lit(False))


def numbered_parts(c: str | Column, expected: int) -> Column:
    """The parts of a numbered list, filled up with '' or cut to the number expected."""
    parts = F.transform(F.split(F.concat(F.lit("\n"), _col(c)), r"\n\s*\d+\.\s+"), strip)
    return F.slice(F.concat(F.filter(parts, lambda x: x != ""), F.array_repeat(F.lit(""), expected)), 1, expected)


def padded_id(prefix: str, number: str | Column, width: int = 6) -> Column:
    """prefix and a zero-padded number, which grows past its width rather than being cut."""
    return F.concat(F.lit(prefix), F.format_string(f"%0{width}d", _col(number)))


def before_last(c: str | Column, mark: str) -> Column:
    return F.nullif(F.regexp_extract(_col(c), rf"(?s)^(.*){mark}", 1), F.lit(""))


def slug(c: str | Column, length: int = 50) -> Column:
    return F.substring(F.replace(F.lower(_col(c)), F.lit(" "), F.lit("-")), 1, length)


def first_paragraph(c: str | Column, most: int = 500) -> Column:
    """The text up to its first blank line, or its first characters where it has none."""
    s = _col(c)
    return strip(F.when(F.contains(s, F.lit("\n\n")), F.substring_index(s, "\n\n", 1)).otherwise(F.substring(s, 1, most)))


def json_text(c: str | Column, lists: bool = True) -> Column:
    """The JSON in a model's reply as text: the reply itself, a fenced block, the widest braces or, with lists, brackets; null if none parses."""
    s = strip(_col(c))
    fence = F.regexp_extract(s, r"(?s)```(?:json)?\s*\n?(.*?)```", 1)
    forms = [s, strip(fence), F.regexp_extract(s, r"(?s)\{.*\}", 0), *([F.regexp_extract(s, r"(?s)\[.*\]", 0)] if lists else [])]
    ok = lambda x: F.when((x.startswith("{") | x.startswith("[")) & F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(*map(ok, forms))


def json_or_empty(c: str | Column) -> Column:
    """A reply without its leading fence, if that is JSON; else an empty object."""
    s = strip(F.regexp_replace(strip(_col(c)), r"^```(?:json)?|```$", ""))
    return F.when(F.try_parse_json(s).isNotNull() & (s.startswith("{") | s.startswith("[")), s).otherwise("{}")


def clean_whitespace(c: str | Column) -> Column:
    """Lines without trailing white space, at most one blank line in a row, none at either end."""
    s = F.regexp_replace(_col(c), r"[ \t\r\x0b\f]+(\n|$)", "$1")
    return F.regexp_replace(F.regexp_replace(s, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def strip_marked_lines(c: str | Column) -> Column:
    """Code without the lines that switch its good or bad half on and off."""
    lines = F.filter(F.split(_col(c), "\n"), lambda x: ~x.rlike(r"^\s*#ifndef\s+OMIT|^\s*#endif|OMITBAD|OMITGOOD"))
    return F.array_join(lines, "\n")


#: The weakness classes that are told apart.
WEAKNESSES = [20, 22, 77, 78, 79, 89, 94, 119, 120, 125, 190, 200, 269, 276, 287, 352, 362, 400, 416, 434, 476, 502, 787, 798]
#: Suffixes of images.
IMAGES = ["jpg", "jpeg", "png", "gif", "webp"]


def weakness_label(c: str | Column, known: list[int] = WEAKNESSES) -> Column:
    """CWE-n of a reply that names a class, with or without its prefix, in any case; null if the class isn't known."""
    s = F.upper(strip(_col(c)))
    s = F.regexp_replace(F.when(s.startswith("CWE-"), F.substring(s, 5, 1_000_000)).when(s.startswith("CWE"), F.substring(s, 4, 1_000_000)).otherwise(s), r"^[\s:-]+", "")
    return F.when(s.isin([str(k) for k in known]), F.concat(F.lit("CWE-"), s))


def language_name(c: str | Column, default: str = "c") -> Column:
    """A language in lower case, c++ as cpp; the default where it is null or empty."""
    s = F.lower(strip(_col(c)))
    return F.when(s.isin("c++", "cpp"), "cpp").when(truthy(s), s).otherwise(default)


def cache_name(url: str | Column) -> Column:
    """A file name for what lies at a URL: its SHA-256 and its suffix, if that is an image's, else jpg."""
    u = _col(url)
    last = F.lower(F.regexp_extract(F.regexp_replace(u, r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    return F.concat(F.sha2(u, 256), F.lit("."), F.when(last.isin(IMAGES), last).otherwise("jpg"))


def urls(c: str | Column) -> Column:
    """The web addresses in a text, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(_col(c), F.lit(r"https?://[^\s<>\"')\]]+"), F.lit(0)))


def title_line(c: str | Column, most: int = 100) -> Column:
    """The first line of a text's first characters."""
    return F.split(F.substring(_col(c), 1, most), "\n", 2)[0]


def query_lines(c: str | Column, most: int = 8) -> Column:
    """The lines that are queries: longer than five characters and no SEARCH command; of more than ``most``, the first ones."""
    lines = F.transform(F.split(_col(c), "\n"), strip)
    return F.slice(F.filter(lines, lambda x: (F.length(x) > 5) & ~x.startswith("SEARCH")), 1, most)


def stops_expansion(c: str | Column) -> Column:
    """Whether a reply asks for a search instead of naming queries."""
    return F.coalesce(strip(_col(c)).startswith("SEARCH"), F.lit(False))


def filled(template: str, **values: Column) -> Column:
    """A template with {name} places filled; {{ and }} stand for braces. Null if a value is null."""
    out = F.lit(template.replace("{{", "\1").replace("}}", "\2"))
    for k, v in values.items():
        out = F.replace(out, F.lit("{%s}" % k), v)
    return F.translate(out, "\1\2", "{}")


def numbered_lines(items: Column) -> Column:
    """Lines "1. item" in order."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
