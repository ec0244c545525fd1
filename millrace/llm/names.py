"""Variant spellings of names typed by people: suffix blocking and longest-common-subsequence ratios.

A name is read into its own words (an organisation's names, a person's surname), what it is about, and what tells entities apart:
a fund's number, a branch's place, a generation. Equal readings are one class, however many records share it. Classes are indexed by
suffixes of their own words, of a minimum length, together with a letter or ending of the other word (and by the suffixes of the
reversed words, for words misspelt near their ends) and with what tells entities apart. Two words that nothing marks as an
organisation or a person may be either, and are indexed as both. A block of many
classes is compared in pieces; no pair in it is left out. Pairs of classes are compared where their block is, by
their words' longest common subsequences, bit-parallel over whole columns, and only links leave the task; pairs whose words
have too few letters in common, in any order, are dropped before. Links between classes are closed by the
partitioned union-find of ``groups``; pairs of records are made within entities only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.similarity import lcs_length, lcs_lengths, letter_bags
from millrace.llm.groups import components
from millrace.storage import stage

SUFFIX = 5
#: A block of more classes is compared in pieces, each of which repeats the block's rows.
COMMON = 60
#: Least LCS ratios: of both words together, of the weaker word, of a surname, of words written as one.
BOTH, WEAKER, SURNAME, JOINED = 0.84, 0.62, 0.78, 0.86
# What isn't a name's own word.
LEGAL = "inc incorporated llc ltd limited corp corporation corpn co company plc gmbh sa gesellschaft mbh societe anonyme liability lp llp ag nv bv".split()
NOISE = "the and of at us usa uk hq head office main accounts account dept department branch attn trustee esq md phd cpa mr mrs ms dr prof hon sir fbo dba".split()
SECTORS = """systems brothers medical center financial services foods properties chemical construction industries logistics associates engineering
distribution equipment management development insurance technologies laboratories enterprises international energy communications pharmaceuticals
consulting manufacturing holdings group partners trading""".split()
SHORT = """bros ins ctr cntr centre svc svcs sys syst syts mfg mgt mgmt mngmt eng engg engrg intl dev devel fin finl ind inds lab labs med chem equip eqpt eqp const constr comm
comms prop props log logist dist distr distn ent entpr entp assoc assocs assc pharm pharma tech techs tchnlgs fds enrgy energ cnslt consult manuf""".split()
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
GENERATIONS = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "ii", "iii": "iii", "iv": "iv", "2nd": "ii", "3rd": "iii"}
FIRST = {
    "theodore": "ted teddy theo", "leonard": "len lenny leo", "william": "will bill billy wm willy", "yevgenia": "zhenya evgenia", "elizabeth": "liz beth betsy betty lizzie eliza",
    "alexander": "alex sandy sasha al", "frederick": "fred freddie freddy", "deborah": "deb debbie debby", "nathaniel": "nat nate nathan", "humberto": "berto beto", "gregory": "greg",
    "penelope": "penny nell", "samantha": "sam sammie sammy", "robert": "rob bob bobby robbie bert", "michael": "mike mick mickey", "james": "jim jimmy jamie",
    "charles": "charlie chuck chas", "ophelia": "phelia", "zachary": "zack zach zak", "katherine": "kate kathy katie kat kay kitty", "victoria": "vicky tori vic vickie",
    "margaret": "maggie meg peggy", "richard": "rich rick dick", "thomas": "tom tommy", "edward": "ed eddie", "joseph": "joe joey", "patricia": "pat patty trish", "jennifer": "jen jenny",
    "anthony": "tony", "christopher": "chris", "daniel": "dan danny", "matthew": "matt", "susan": "sue susie", "catherine": "cathy",
}
_FIRST = {n: k for k, v in FIRST.items() for n in [k, *v.split()]}
_DROP = frozenset(LEGAL) | frozenset(NOISE)
_SHORT = frozenset(SECTORS) | frozenset(SHORT)
_DOTS = re.compile(r"\b(?:[a-z]\.\s?){2,}[a-z]?\b\.?")
_PAREN = re.compile(r"\([^)]*\)|#\s*\w+")
_AT = re.compile(r"\s(?:of|at)\s+([a-z' ]+)$|\s-\s+([a-z' ]+)$|,\s+([a-z' ]+)$")
_OFFICE = re.compile(r"[,\-]?\s*\b(?:head office|accounts dept|accts dept|main office)\b")
_FORM_AT_END = re.compile(r"[\s,]+(?:%s)$" % "|".join(LEGAL))
_FUND = re.compile(r"\bfunds?\s+(\w+)")
PLACEHOLDERS = ("", "-", "--", "n/a", "na", "none", "null", "unknown", "?", ".", "tbd")
READING = "kind string, apart string, one string, two string, first string, middle string"


def _ratio(a: str, b: str) -> float:
    return 2 * lcs_length(a, b) / max(1, len(a) + len(b))


_near: dict[str, str] = {}
_FULL: dict[str, list[str]] = {}
for _w in SECTORS + LEGAL:
    if len(_w) >= 5:
        _FULL.setdefault(_w[0], []).append(_w)


def _role(word: str) -> str:
    """drop, sector or own, by the fixed words, their abbreviations and near spellings."""
    if word in _near:
        return _near[word]
    role = "own"
    if word in _DROP:
        role = "drop"
    elif word in _SHORT:
        role = "sector"
    elif len(word) >= 4:
        for s in _FULL.get(word[0], ()):
            it = iter(s)
            if 0.45 * len(s) <= len(word) <= len(s) and all(c in it for c in word) or len(word) >= 5 and abs(len(word) - len(s)) <= 3 and _ratio(word, s) >= 0.82:
                role = "sector" if s in _SHORT else "drop"
                break
    if len(_near) > 300_000:
        _near.clear()
    _near[word] = role
    return role


def _first_name(word: str) -> str | None:
    if word in _FIRST:
        return _FIRST[word]
    if len(word) < 4:
        return None
    near = [n for n in FIRST if abs(len(n) - len(word)) <= 2]
    best = max(((_ratio(word, n), n) for n in near), default=(0.0, ""))
    return best[1] if best[0] >= 0.8 else None


def fold(word: str) -> str:
    """A word's sound, roughly: spellings by ear differ in these letters."""
    return word.replace("ow", "au").replace("ph", "f").replace("y", "i")


def read_name(name: str | None) -> tuple[str, str, str, str, str, str] | None:
    """(kind, apart, one, two, first, middle): org, person or either, what sets it apart, its own words in order, given names; None: no name."""
    if name is None:
        return None
    s = unicodedata.normalize("NFKD", name)
    s = "".join(c for c in s if not unicodedata.combining(c)).casefold().replace("’", "'")
    s = re.sub(r"\s+", " ", s).strip()
    if s in PLACEHOLDERS:
        return None
    s = _PAREN.sub(" ", s)
    s = _OFFICE.sub(" ", s)
    s = _DOTS.sub(lambda m: " " + m[0].replace(".", "").replace(" ", "") + " " if m[0].replace(".", "").replace(" ", "") in _DROP else m[0], s)
    s = s.replace("'", "").replace(".", " ")
    s = re.sub(r"\s+", " ", s).strip(" ,-")
    fund = _FUND.search(s)
    apart = ""
    if fund:
        n = ROMAN.get(fund[1]) or (int(fund[1]) if fund[1].isdecimal() and len(fund[1]) < 9 else None)
        apart = f"fund {n or fund[1]}"
        s = s[: fund.start()] + " " + s[fund.end() :]
    place = ""
    bare = s
    while True:  # legal forms at the end hide a branch's place
        cut = _FORM_AT_END.sub("", bare.rstrip(" ,-"))
        if cut == bare:
            break
        bare = cut
    m = _AT.search(bare)
    if m:
        after = next(x for x in m.groups() if x is not None).strip()
        before = re.findall(r"\w+", bare[: m.start()])
        roles = [_role(w) for w in re.findall(r"\w+", after)]
        own_before = [w for w in before if _role(w) == "own" and len(w) > 1]
        of = m[1] is not None
        if after and all(r == "own" for r in roles) and len(roles) <= 2 and all(len(w) > 1 and w not in GENERATIONS for w in after.split()) and (of or len(own_before) >= 2 or any(len(w) > 11 for w in own_before)):
            place, s = after, bare[: m.start()]
    apart = (apart + " " + ("at " + place if place else "")).strip()
    words = re.findall(r"\w+", s)
    roles = {w: _role(w) for w in words}
    has_form = bool(fund or place) or any(roles[w] == "sector" or w in LEGAL for w in words)
    generation = [GENERATIONS[w] for w in words if w in GENERATIONS]
    if not has_form:
        rest = [w for w in words if roles[w] == "own" and w not in GENERATIONS]
        letters = [w for w in rest if len(w) == 1]
        full = [w for w in rest if len(w) > 1]
        given = [(w, _FIRST[w]) for w in full if w in _FIRST]
        if not given and len(full) == 2 and "&" not in s and "+" not in s:
            given = [(w, f) for w in full if (f := _first_name(w))]
        if len(given) > 1:
            given = given[:1]
        if given and len(full) == 2:
            surname = next(w for w in full if w != given[0][0]) if full[0] != full[1] else full[1]
            return "person", " ".join(generation), fold(surname), "", given[0][1], letters[0] if letters else ""
        if len(full) == 1 and (letters or generation):
            return "person", " ".join(generation), fold(full[0]), "", letters[0] if letters else "", letters[1] if len(letters) > 1 else ""
        if given and len(full) > 2:
            surname = max((w for w in full if w != given[0][0]), key=len)
            return "person", " ".join(generation), fold(surname), "", given[0][1], letters[0] if letters else ""
    own = [w for w in words if roles[w] == "own" and (len(w) > 2 or not w.isalpha())] or words
    if len(own) > 2:  # the two longest are the names; what is left was cut off a word
        own = sorted(sorted(own, key=lambda w: (-len(w), w))[:2], key=own.index)
    own = [fold(w) for w in own]
    one, two = sorted((own + [""])[:2], reverse=True) if len(own) > 1 else (own[0] if own else s, "")
    either = not has_form and len(own) == 2 == len(words) and "&" not in s and "+" not in s and all(w.isalpha() for w in own)
    return "either" if either else "org", apart, one, two, "", ""


def readings(names: DataFrame, key: str = "id", name: str = "name") -> DataFrame:
    """(key, reading): the names that can be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [read_name(x) for x in b[name]]
            keep = [i for i, g in enumerate(got) if g]
            out = pd.DataFrame([got[i] for i in keep], columns=["kind", "apart", "one", "two", "first", "middle"])
            out.insert(0, key, b[key].to_numpy()[keep])
            yield out

    return names.select(key, name).mapInPandas(run, f"`{key}` {names.schema[key].dataType.simpleString()}, {READING}")


def _keys(c: DataFrame) -> DataFrame:
    """c with block: a suffix or beginning of each own word, with little of the rest, and what sets names apart. Short words are taken whole."""
    tail = lambda w, n: F.right(w, F.lit(n))
    head = lambda w, n: F.left(w, F.lit(n))
    one, two = F.col("one"), F.col("two")

    def org(t, o):
        joined = F.when(o == "", t).otherwise(o)
        return [F.concat_ws("|", F.lit("a"), tail(t, SUFFIX), head(joined, 2)), F.concat_ws("|", F.lit("b"), tail(t, SUFFIX), tail(o, 3))]

    letter = F.left("first", F.lit(1))
    person = [F.concat_ws("|", F.lit("p"), tail(one, SUFFIX), letter), F.concat_ws("|", F.lit("q"), head(one, 4), letter)]
    heads = F.concat_ws("|", F.lit("c"), head(F.least(one, two), 3), head(F.greatest(one, two), 3))
    named = [F.concat_ws("|", F.lit("p"), tail(t, SUFFIX), head(o, 1)) for t, o in ((one, two), (two, one))]
    both = [*org(one, two), *org(two, one), heads]
    keys = F.when(F.col("kind") == "person", F.array(*person)).when(two == "", F.array(*org(one, two))).when(F.col("kind") == "either", F.array(*both, *named)).otherwise(F.array(*both))
    return c.select("*", F.explode(F.array_distinct(keys)).alias("key")).withColumn("block", F.xxhash64(F.concat_ws("|", "key", "apart"))).drop("key")


def _bags(c: DataFrame) -> DataFrame:
    """c with the letter bags of its two words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{f"{w}_bag": letter_bags(b[w].tolist(), 21, 3)[:, 0] for w in ("one", "two")})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in c.schema.fields)
    return c.mapInPandas(run, f"{schema}, one_bag long, two_bag long")


def same_entity(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Whether readings a and b, row by row, are spellings of one name."""
    ok = np.zeros(len(a), bool)
    alike = a["apart"].to_numpy() == b["apart"].to_numpy()
    x, y = a["kind"].to_numpy(), b["kind"].to_numpy()
    person, org = (x == "person") & (y == "person"), (x != "person") & (y != "person")
    paired = (a["two"].to_numpy() != "") & (b["two"].to_numpy() != "")
    unsure = (x == "either") & (y == "person") | (x == "person") & (y == "either")
    for rows, compare in ((alike & person, _same_person), (alike & org & paired, _same_pair), (alike & org & ~paired, _same_joined), (alike & unsure, _perhaps_person)):
        if rows.any():
            ok[rows] = compare(a[rows], b[rows])
    return ok


def _comparable(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
    """What same_entity asks of readings x and y at least, by kinds, first letters, lengths and letters in common; what sets names apart is part of their block."""
    person = lambda r: r("kind") == "person"
    size = lambda u, v: F.length(x(u)) + F.length(y(v))
    uncommon = lambda u, v: F.greatest(F.bit_count(x(f"{u}_bag").bitwiseXOR(y(f"{v}_bag"))), F.abs(F.length(x(u)) - F.length(y(v))))
    alike = lambda u, v, ratio: uncommon(u, v) <= (1 - ratio) * size(u, v) + 1e-6
    begin = lambda a, b, n: F.left(a, F.lit(n)) == F.left(b, F.lit(n))
    given = (x("first") == "") | (y("first") == "") | begin(x("first"), y("first"), 1)
    one_person = given & alike("one", "one", SURNAME)
    pair = F.lit(False)
    for u, v, w, z in (("one", "one", "two", "two"), ("one", "two", "two", "one")):
        pair |= uncommon(u, v) + uncommon(w, z) <= (1 - BOTH) * (size(u, v) + size(w, z)) + 1e-6
        pair |= alike(u, v, 0.85) & begin(x(w), y(z), 3) | alike(w, z, 0.85) & begin(x(u), y(v), 3)
    total = lambda r: F.length(r("one")) + F.length(r("two"))
    joined = F.abs(total(x) - total(y)) <= (1 - JOINED) * (total(x) + total(y)) + 1e-6
    perhaps = alike("one", "one", SURNAME) | F.when(person(x), alike("one", "two", SURNAME)).otherwise(alike("two", "one", SURNAME))
    org = F.when((x("two") != "") & (y("two") != ""), pair).otherwise(joined)
    either = lambda r: r("kind") == "either"
    return F.when(person(x) & person(y), one_person).when(~person(x) & ~person(y), org).otherwise((either(x) | either(y)) & perhaps)


def _ratios(x: list[str], y: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """LCS lengths, the words' lengths together, and the ratio."""
    n, size = lcs_lengths(x, y), np.array([len(p) + len(q) for p, q in zip(x, y)])
    return n, size, 2 * n / np.maximum(1, size)


def _same_person(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    given = np.array([p == q or not p or not q or (len(p) == 1 or len(q) == 1) and p[0] == q[0] for p, q in zip(a["first"], b["first"])], bool)
    middle = np.array([p == q or not p or not q for p, q in zip(a["middle"], b["middle"])], bool)
    return given & middle & (_ratios(a["one"].tolist(), b["one"].tolist())[2] >= SURNAME)


def _perhaps_person(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """One of each two is a person, the other two words of which either may be the surname; the given name must begin alike, or be the same."""
    swap = a["kind"].to_numpy() == "person"
    p, q = ({f: np.where(swap, x[f], y[f]).tolist() for f in ("one", "two", "first")} for x, y in ((a, b), (b, a)))
    ok = np.zeros(len(a), bool)
    for surname, given in (("one", "two"), ("two", "one")):
        begins = np.array([bool(f) and (g == f or len(f) == 1 and g.startswith(f)) for f, g in zip(p["first"], q[given])], bool)
        ok |= begins & (_ratios(p["one"], q[surname])[2] >= SURNAME)
    return ok


def _same_pair(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    one, two, three, four = (x.tolist() for x in (a["one"], a["two"], b["one"], b["two"]))
    ok = np.zeros(len(a), bool)
    for w, x, y, z in ((one, three, two, four), (one, four, two, three)):
        (n, size, r), (n2, size2, r2) = _ratios(w, x), _ratios(y, z)
        ok |= (2 * (n + n2) / np.maximum(1, size + size2) >= BOTH) & (np.minimum(r, r2) >= WEAKER)
        # an abbreviation: the first letters of the other
        short = lambda u, v: np.array([min(len(p), len(q)) >= 3 and (p.startswith(q) or q.startswith(p)) for p, q in zip(u, v)], bool)
        ok |= (r >= 0.85) & short(y, z) | (r2 >= 0.85) & short(w, x)
    return ok


def _same_joined(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    one, two, three, four = (x.tolist() for x in (a["one"], a["two"], b["one"], b["two"]))
    ab, ba = [x + y for x, y in zip(one, two)], [y + x for x, y in zip(one, two)]
    cd, dc = [x + y for x, y in zip(three, four)], [y + x for x, y in zip(three, four)]
    best = np.maximum(np.maximum(_ratios(ab, cd)[2], _ratios(ba, cd)[2]), _ratios(ab, dc)[2])
    return (best >= JOINED) & np.array([min(len(x), len(y)) >= 8 for x, y in zip(ab, cd)], bool)


def entities(names: DataFrame, key: str = "id", name: str = "name", common: int = COMMON) -> DataFrame:
    """(key, entity): each record with a readable name, and its entity, for names: (key, name), one row a record.

    Null, blank and placeholder names have no entity; equal names always share one; repeated rows count once.
    """
    read = readings(names, key, name)
    fields = ["kind", "apart", "one", "two", "first", "middle"]
    read = stage(read.withColumn("class", F.xxhash64(*fields)), "readings")
    classes = stage(_bags(read.select("class", *fields).dropDuplicates(["class"])), "classes")
    # each class is shuffled once a block, with its reading; pairs are made and compared there
    sized = _keys(classes).withColumn("parts", F.ceil(F.count("*").over(Window.partitionBy("block")) / int(common)))
    kept = ["class", *fields, "one_bag", "two_bag"]
    x, y = (sized.select("block", "parts", *(F.col(c).alias(f"{p}_{c}") for c in kept)) for p in ("x", "y"))
    meet = (F.col("x_class") < F.col("y_class")) & _comparable(*(lambda c, p=p: F.col(f"{p}_{c}") for p in ("x", "y")))
    whole = x.where("parts = 1").join(y.where("parts = 1").drop("parts").hint("merge"), "block").where(meet)
    # a large block is compared in pieces, each of its parts of about `common` classes against the whole block
    piece = x.where("parts > 1").withColumn("part", F.pmod("x_class", "parts"))
    other = y.where("parts > 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    pieces = piece.join(other.hint("merge"), ["block", "part"]).where(meet)
    flat = [F.col(f"{p}_{c}") for p in ("x", "y") for c in ("class", *fields)]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                a, c = (b[[f"{p}_{f}" for f in fields]].set_axis(fields, axis=1) for p in ("x", "y"))
                yield b.loc[same_entity(a, c), ["x_class", "y_class"]].set_axis(["x", "y"], axis=1)

    links = whole.select(*flat).unionByName(pieces.select(*flat)).mapInPandas(compare, "x long, y long")
    groups = components(links, "x", "y").select(F.col("record_id").cast("long").alias("class"), F.col("group_id").cast("long").alias("entity"))
    return read.select(key, "class").distinct().join(groups, "class", "left").select(key, F.coalesce("entity", "class").alias("entity"))


def record_names(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, name): of each distinct non-null id of records its own name or, where that is missing, its most frequent name in pairs.

    Of several own names, or equally frequent ones, the least counts. A record without any name keeps a null one.
    """
    blank = F.lower(F.trim("name")).isin(*PLACEHOLDERS)
    own = records.where("id is not null").groupBy("id").agg(F.min(F.when(~blank, F.col("name"))).alias("name"))
    own = stage(own, "own-names")
    missing = own.where("name is null").select("id")
    other = pairs.select(F.explode(F.array(F.struct(F.col("record_a").alias("id"), F.col("name_a").alias("name")), F.struct(F.col("record_b").alias("id"), F.col("name_b").alias("name")))).alias("e")).select("e.*")
    other = other.where(F.col("name").isNotNull() & ~blank).join(missing, "id").groupBy("id", "name").agg(F.count("*").alias("n"))
    other = other.groupBy("id").agg(F.min_by("name", F.struct(-F.col("n"), "name")).alias("typed"))
    return own.join(other, "id", "left").select("id", F.coalesce("name", "typed").alias("name"))


def linked_records(records: DataFrame, pairs: DataFrame, common: int = COMMON) -> DataFrame:
    """(record_a, record_b): all pairs of different ids whose names denote one entity, smaller id first.

    The rows are as many as the entities' pairs are; all of them are asked for. Other columns are not read.
    """
    e = stage(entities(record_names(records, pairs), common=common), "entities")
    a, b = e.select("entity", F.col("id").alias("record_a")), e.select("entity", F.col("id").alias("record_b"))
    return a.join(b, "entity").where("record_a < record_b").select("record_a", "record_b")
