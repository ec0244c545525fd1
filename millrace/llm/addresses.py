"""Same postal address written differently: a self-built gazetteer and a beam search over it.

Addresses are read into number, direction, street, kind of street, town, state and postcode, in three national styles. The gazetteer
comes from the addresses themselves: localities (postcodes with their towns), and within them the street spellings, clustered by
their longest common subsequences; a cluster's identifier, with a number, is a place. Every distinct reading is then sought
among the gazetteer's places: by its postcode, by one that differs in a digit, by its town, or by its state alone, and there by the
street's ends and its number. What is found is scored by locality, street and number together, the best few are kept, with all that
tie with the last of them, and the best one is the reading's place; a reading's own postcode and street are one of the candidates.
So a missing direction or kind of street resolves to one fuller place, and never joins two. Spellings below the street ratio
need a vendor in common, or the postcode, the kind and more than one number. Units do not count.

All searches are equi-joins on postcode, number, town's or street's ends together; nothing compares all addresses of a locality.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.similarity import lcs_lengths
from millrace.llm.groups import components
from millrace.llm.names import fold
from millrace.storage import spread, stage

#: Places kept in the search, with all that tie with the last of them.
BEAM = 4
#: Least LCS ratios: spellings of a street, of one with a vendor or several numbers in common, of a town. Share of a postcode's addresses that makes a town one of its towns.
STREET, WEAK, TOWN, OF_TOWN = 0.8, 0.62, 0.7, 0.2
# Fixed values.
DIRECTIONS = {"n": "n", "no": "n", "north": "n", "s": "s", "so": "s", "south": "s", "e": "e", "ea": "e", "east": "e", "w": "w", "we": "w", "west": "w"}
KINDS = {
    "street": "street str st", "road": "road rd", "avenue": "avenue ave av aven", "boulevard": "boulevard blvd boul bd", "drive": "drive dr drv", "lane": "lane ln la", "highway": "highway hwy hway",
    "parkway": "parkway pkwy pky pkway", "square": "square sq sqr", "court": "court ct", "place": "place plc", "way": "way wy", "terrace": "terrace ter", "circle": "circle cir",
}
GERMAN = {"strasse": "strasse", "str": "strasse", "weg": "weg", "wg": "weg", "platz": "platz", "pl": "platz", "gasse": "gasse", "g": "gasse", "allee": "allee", "all": "allee"}
MALAY = {"jalan": "jalan", "jln": "jalan", "jl": "jalan", "lorong": "lorong", "lor": "lorong", "lrg": "lorong", "persiaran": "persiaran", "psn": "persiaran", "psrn": "persiaran"}
STATES = """alabama al|alaska ak|arizona az|arkansas ar|california ca calif|colorado co colo|connecticut ct conn|delaware de|florida fl fla|georgia ga|hawaii hi|idaho id|illinois il ill|indiana in ind|iowa ia|kansas ks|kentucky ky|louisiana la|maine me|maryland md
massachusetts ma mass|michigan mi mich|minnesota mn minn|mississippi ms|missouri mo|montana mt|nebraska ne|nevada nv|ohio oh|oklahoma ok|oregon or ore|pennsylvania pa|tennessee tn tenn|texas tx tex|utah ut|vermont vt|virginia va|washington wa wash|wisconsin wi|wyoming wy
north-carolina n-carolina nc|south-carolina s-carolina sc|north-dakota nd|south-dakota sd|new-york ny|new-jersey nj|new-mexico nm|new-hampshire nh|west-virginia wv|rhode-island ri"""
COUNTRIES = r"united states of america|united states|u\.?s\.?a\.?|usa|germany|deutschland|malaysia"
_KIND = {a: k for k, v in KINDS.items() for a in v.split()}
_STATE = {a.replace("-", " "): v.split()[-1] if len(v.split()[-1]) == 2 else v.split()[1] for v in re.split(r"[|\n]", STATES) for a in v.split()}
_STATE_RE = re.compile(r"(?<![a-z])(?:%s)(?![a-z])" % "|".join(sorted((re.escape(s).replace(r"\ ", r"[\s.]+") for s in _STATE), key=len, reverse=True)))
_ZIP = re.compile(r"(?<![\w-])(?:d\s?-\s?)?(\d{5})(?:-\d{4})?(?!\d)")
_COUNTRY = re.compile(rf"(?<![a-z])(?:{COUNTRIES})\.?(?![a-z])|,\s*(?:us|de|my)\s*$|\s(?:de|my)\s*$")
_UNIT = re.compile(r"\b(?:suite|ste|unit|apt|apartment|floor|fl|tingkat|level|lvl|blok|block|blk|aras|room|rm|hs|haus|geb|gebaude|wohnung|whg)\b\.?\s*#?\s*\d*\w*|(?<=\d)\s*/\s*\d+")
_MIXED = re.compile(r"(?<![a-z0-9])(?=[0-9lobisz]*\d)[0-9lobisz]{2,5}(?![a-z0-9])")
_PHONE = re.compile(r"\b(?:tel|phone|ph|fax)\b\.?:?\s*\+?[\d()]+(?:[-/][\d()]+)+|\bstore\s*#?\s*\d+\b")
_RUN = re.compile(r"((?:strasse|str|weg|wg|platz|pl|gasse|allee|all|g)\.?\s+)?(?<!\d)(\d{6,9})(?!\d)")
_US = re.compile(r"(?<![\d#])(\d{1,5})\s*,?\s+(?:(north|south|east|west|no|so|ea|we|n|s|e|w)\b\.?\s+)?([a-z']{2,}|\d{1,3}(?:st|nd|rd|th)\b)\.?(?:\s+(%s)\b\.?)?(?:\s+(north|south|east|west|n|s|e|w)\b\.?)?" % "|".join(sorted(_KIND, key=len, reverse=True)))
#: Streets of several words, which end in a kind of street that is no state.
_WORDY = re.compile(r"(?<![\d#])(\d{1,5})\s*,?\s+(?:(north|south|east|west|no|so|ea|we|n|s|e|w)\b\.?\s+)?((?:[a-z']{2,}|\d{1,3}(?:st|nd|rd|th))(?: [a-z']{2,}){1,3}?)\.? (%s)\b\.?(?:\s+(north|south|east|west|n|s|e|w)\b\.?)?" % "|".join(sorted(set(_KIND) - {"la", "ct", "st"} | {"street"}, key=len, reverse=True)))
_HOUSE = re.compile(r"\d{5}\s+(?:(?:north|south|east|west|n|s|e|w)\b\.?\s+)?(?:[a-z']{2,}|\d{1,3}(?:st|nd|rd|th))(?: [a-z']{2,}){0,3}?\.? (?:%s)\b" % "|".join(sorted(_KIND, key=len, reverse=True)))
_DE = re.compile(r"(?<![a-z])([a-z']{3,}?)\s?-?\s?(strasse|str|weg|wg|platz|pl|gasse|allee|all|g)\b\.?\s*,?\s*(\d{1,4})(?!\d)")
_MY = re.compile(r"(?<![a-z])(%s)\b\.?\s*([a-z']{2,})" % "|".join(sorted(MALAY, key=len, reverse=True)))
_MY_NUMBER = re.compile(r"(?:(?:no|lot)\b\.?\s*|#\s*)(\d{1,4})(?!\d)|(?<![\w#])(\d{1,4})(?!\d)")
_TOWN_WORDS = {"st": "saint", "ste": "saint", "snt": "saint", "hts": "heights", "hgts": "heights", "ft": "fort", "mt": "mount"}
PARSED = "number string, direction string, street string, kind string, town string, state string, zip string"
FIELDS = ["number", "direction", "street", "kind", "town", "state", "zip"]


def _postcode(s: str) -> re.Match | None:
    """The five digits that are a postcode: not a house number before its street, if there is another number for either."""
    found = list(_ZIP.finditer(s))
    house = [m for m in found if _HOUSE.match(s, m.start(1))]
    if house and (len(found) > 1 or not _US.search(s[: house[0].start()] + " , " + s[house[0].end() :])):
        return next((m for m in found if m is not house[0]), None)
    return found[0] if found else None


def read_address(text: str | None) -> dict[str, str] | None:
    """The parts of an address ('' where missing); None unless it has a house number and a street."""
    if not text:
        return None
    s = re.sub(r"(?<=[a-z]{2})(?=[A-Z])", " ", text)
    s = unicodedata.normalize("NFKD", s.casefold())
    s = _PHONE.sub(" ", "".join(c for c in s if not unicodedata.combining(c)))
    s = _RUN.sub(lambda m: f"{m[1]} {m[2][:-5]} {m[2][-5:]}" if m[1] else f"{m[2][:5]} {m[2][5:]}", s)
    s = re.sub(r"\b(no|lot)\.?(?=[lobisz]*\d)", r"\1 ", s)
    s = re.sub(r"^\s*(?:branch|address|addr|filiale|store)\s*:", " ", s)
    s = re.sub(r"[\n\r;|]+|\s+-\s+|\s[-–—]\s|:", ", ", s)
    s = re.sub(r"\s+", " ", s)
    s = _MIXED.sub(lambda m: m[0].translate(str.maketrans("lobisz", "108152")) if any(c.isdigit() for c in m[0]) and not m[0].isdigit() else m[0], s)
    for _ in range(2):
        s = _COUNTRY.sub(" ", s)
    code = ""
    found = _postcode(s)
    if found:
        code = found[1]
        s = s[: found.start()] + " , " + s[found.end() :]
    s = _UNIT.sub(" , ", s)
    number = direction = street = kind = state = ""
    my, de = _MY.search(s), None
    if my:
        kind, street = MALAY[my[1]], my[2]
        rest = s[: my.start()] + " , " + s[my.end() :]
        n = _MY_NUMBER.search(rest)
        if n:
            number = n[1] or n[2]
            rest = rest[: n.start()] + " , " + rest[n.end() :]
    else:
        de = _DE.search(s)
        us = _US.search(s)
        wordy = _WORDY.search(s)
        if wordy and us and us.start() == wordy.start() and not us[4]:
            us = wordy
        if de and not (us and us[4]):
            street, kind, number = de[1], GERMAN[de[2]], de[3]
            rest = s[: de.start()] + " , " + s[de.end() :]
        elif us:
            number, street = us[1], us[3]
            direction = DIRECTIONS.get(us[2] or us[5] or "", "")
            kind = _KIND.get(us[4] or "", "")
            rest = s[: us.start()] + " , " + s[us.end() :]
            last = None
            for last in _STATE_RE.finditer(rest):
                pass
            if last:
                state = _STATE[re.sub(r"[\s.]+", " ", last[0]).strip()]
                rest = rest[: last.start()] + " , " + rest[last.end() :]
        else:
            return None
    number = number.lstrip("0")
    if not number or not street:
        return None
    words = [_TOWN_WORDS.get(w, w) for w in re.findall(r"[a-z']+", rest)]
    words = [w for w in words if len(w) > 1 and w not in ("no", "lot", "the") and w not in KINDS]
    return dict(zip(FIELDS, (number, direction, fold(street.replace("'", "")), kind, fold(" ".join(words)), state, code)))


def parsed(receipts: DataFrame) -> DataFrame:
    """(address, its parts): each distinct address that can denote a place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(a, read_address(a)) for a in b["address"]]
            yield pd.DataFrame([(a, *(p[f] for f in FIELDS)) for a, p in got if p], columns=["address", *FIELDS])

    rows = receipts.select(F.col("vendor_address").alias("address")).where("address is not null").distinct()
    return spread(rows, "address", receipts).mapInPandas(run, "address string, " + PARSED)


def _with_ratio(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with the LCS ratio of two of its string columns, computed over whole batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            p, q = x[a].tolist(), x[b].tolist()
            x[name] = 2 * lcs_lengths(p, q) / [max(1, len(i) + len(j)) for i, j in zip(p, q)] if len(x) else pd.Series([], dtype=float)
            yield x

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {name} double"
    return df.mapInPandas(run, schema)


def _ends(word: str) -> Column:
    """Keys under which spellings of a word meet: its first and its last letters."""
    w = F.col(word)
    return F.explode(F.array_distinct(F.array(F.concat(F.lit("^"), F.left(w, F.lit(3))), F.concat(F.right(w, F.lit(4)), F.lit("$")))))


def _letters(word: str) -> Column:
    w = F.col(word)
    return F.explode(F.array(F.concat(F.lit("^"), F.left(w, F.lit(1))), F.concat(F.right(w, F.lit(1)), F.lit("$"))))


def _wildcards(code: str) -> Column:
    """A postcode with each digit left out in turn."""
    c = F.col(code)
    return F.explode(F.array(*[F.concat(F.substring(c, 1, i), F.lit("*"), F.substring(c, i + 2, 5)) for i in range(5)]))


def _fits(a: str, b: str) -> Column:
    x, y = F.col(a), F.col(b)
    return (x == y) | (x == "") | (y == "")


_PARTS = ["street", "direction", "kind"]


def _renamed(df: DataFrame, *columns: str) -> list[Column]:
    return [F.col(c).alias(f"{c}2") for c in columns]


def _street_ids(entries: DataFrame, numbered: DataFrame) -> DataFrame:
    """(entry, street_id): spellings of a street in one locality, clustered.

    Clustered are spellings of equal kind and direction which are alike, or fairly alike and share more than one number.
    """
    x = entries.select("zip", "entry", *_PARTS, _ends("street").alias("k"))
    y = x.select("zip", "k", "direction", "kind", *_renamed(x, "entry", "street"))
    alike = x.join(y, ["zip", "k", "direction", "kind"]).where("entry < entry2").select("entry", "entry2", "street", "street2").distinct()
    alike = _with_ratio(alike, "street", "street2", "r").where(F.col("r") >= STREET).select("entry", "entry2")
    at = numbered.select("zip", "number", "entry", *_PARTS, _letters("street").alias("k"))
    at2 = at.select("zip", "number", "k", "direction", "kind", *_renamed(at, "entry", "street"))
    shared = at.join(at2, ["zip", "number", "k", "direction", "kind"]).where("entry < entry2 and kind <> ''").select("entry", "entry2", "street", "street2", "number").distinct()
    shared = shared.groupBy("entry", "entry2", "street", "street2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    shared = _with_ratio(shared, "street", "street2", "r").where(F.col("r") >= WEAK).select("entry", "entry2")
    return components(alike.unionByName(shared), "entry", "entry2").select(F.col("record_id").alias("entry"), F.col("group_id").alias("street_id"))


def _score(r: str = "r") -> Column:
    """How well a candidate fits: its locality, its street's spelling, whether others have the number there, direction and kind."""
    same = lambda c: (F.col(c) == F.col(f"{c}2")).cast("int") * 0.1
    return F.col("local") + F.col(r) + F.when(F.col("known"), 0.5).otherwise(0.0) + same("direction") + same("kind")


def _best(found: DataFrame, beam: int) -> DataFrame:
    """Of each form's candidates the best few by score, with all that tie with the last of them, and of these the best supported one."""
    top = Window.partitionBy("form").orderBy(F.desc("score"))
    kept = found.withColumn("rank", F.rank().over(top)).where(F.col("rank") <= beam)
    kept = kept.groupBy("form", "street_id").agg(F.max("score").alias("score"), F.max("n").alias("n"), F.max("local").alias("local"))
    order = Window.partitionBy("form").orderBy(F.desc("score"), F.desc("n"), "street_id")
    return kept.withColumn("rival", F.lead("score").over(order)).withColumn("place", F.row_number().over(order)).where("place = 1")


def locations(receipts: DataFrame, beam: int = BEAM) -> DataFrame:
    """(address, location): each distinct address that denotes a place, and the place's identifier."""
    key = F.concat_ws("|", *FIELDS)
    rows = stage(parsed(receipts).withColumn("form", key), "addresses")
    forms = rows.groupBy("form", *FIELDS).agg(F.count("*").alias("n"))
    zipped = forms.where("zip <> ''").withColumn("entry", F.concat_ws("|", "zip", *_PARTS))
    towns = forms.where("zip <> '' and town <> ''").groupBy("zip", "town").agg(F.sum("n").alias("n"), F.max("state").alias("state"))
    share = Window.partitionBy("zip")
    towns = towns.withColumn("of", F.sum("n").over(share)).withColumn("most", F.max(F.struct("n", "town")).over(share)).withColumn("state", F.max("state").over(share))
    towns = stage(towns.where((F.col("n") >= OF_TOWN * F.col("of")) | (F.col("town") == F.col("most.town"))).select("zip", F.col("town").alias("town2"), F.col("state").alias("state2")), "towns")
    entries = zipped.groupBy("entry", "zip", *_PARTS).agg(F.sum("n").alias("n"))
    numbered = zipped.select("entry", "zip", "number", *_PARTS).distinct()
    street_ids = _street_ids(entries, numbered)
    entries = stage(entries.join(street_ids, "entry", "left").withColumn("street_id", F.coalesce("street_id", "entry")), "entries")
    own = stage(zipped.join(entries.select("entry", "street_id"), "entry"), "own")
    # a spelling at a number, with the support of its place: how many forms name it
    support = Window.partitionBy("street_id", "number")
    places = own.groupBy("street_id", "number", "zip", *_PARTS).agg(F.sum("n").alias("own_n"), F.count("*").alias("forms"))
    # and in how many forms its street is known at all
    places = places.withColumns({"n": F.sum("own_n").over(support), "of_street": F.sum("forms").over(Window.partitionBy("street_id")), "forms": F.sum("forms").over(support)})
    places = stage(places.drop("own_n"), "places")
    vendor = F.explode(F.filter(F.split(F.lower("vendor_name"), r"[^\p{L}\p{Nd}]+"), lambda w: F.length(w) > 2))
    vendors = receipts.select(F.col("vendor_address").alias("address"), vendor.alias("v")).where("address is not null").select("address", F.left("v", F.lit(4)).alias("v")).distinct()
    vendors = stage(rows.select("address", "form").join(vendors, "address").select("form", "v").distinct(), "vendors")

    # with a postcode: fuller or better supported places at the number, in the postcode or one that differs in a digit
    here = own.select("form", "street_id", "number", "zip", "town", "state", *_PARTS)
    there = places.select("street_id", "number", "zip", "n", "forms", *_PARTS)
    there2 = there.select("number", _letters("street").alias("k"), *_renamed(there, "street_id", "zip", *_PARTS), F.col("n").alias("n2"))
    fits = _fits("direction", "direction2") & _fits("kind", "kind2")
    mine = here.join(places.select("street_id", "number", "n", "forms", "of_street").distinct(), ["street_id", "number"])
    columns = ["form", "street_id", "street_id2", "number", "street", "street2", "direction", "direction2", "kind", "kind2", "n", "n2", "of_street", "local"]
    near = mine.withColumn("k", _letters("street")).join(there2.withColumn("zip", F.col("zip2")), ["zip", "number", "k"]).where(fits & (F.col("street_id") != F.col("street_id2"))).withColumn("local", F.lit(1.0)).select(columns).distinct()
    lone = mine.where("forms = 1 and town <> ''").withColumn("code", _wildcards("zip"))
    misread = lone.join(there2.where("n2 > 1").drop("k").distinct().withColumn("code", _wildcards("zip2")), ["code", "number"]).where(fits & (F.col("zip") != F.col("zip2")))
    misread = misread.join(towns.withColumnRenamed("zip", "zip2"), "zip2").where(_fits("state", "state2"))
    misread = _with_ratio(misread.select(*[c for c in columns if c != "local"], "town", "town2"), "town", "town2", "local").where(F.col("local") >= TOWN).select(columns).distinct()
    near = stage(_with_ratio(near.unionByName(misread), "street", "street2", "r").where(F.col("r") >= WEAK), "near")
    # only towards more parts, or from a place named once to one named more often; so no two places lead to each other
    fuller = lambda x: (F.col(f"direction{x}") != "").cast("int") + (F.col(f"kind{x}") != "").cast("int")
    fills = (fuller("2") > fuller("")) & (F.col("r") >= STREET)
    single = (fuller("2") == fuller("")) & (F.struct("n2", "street_id2") > F.struct("n", "street_id"))
    weak = near.where(single & (F.col("r") < STREET) & (F.col("local") == 1) & (F.col("of_street") == 1) & (F.col("n2") > 1))
    w = vendors.join(weak.select("form", F.col("street_id2"), "number").distinct(), "form")
    theirs = vendors.join(own.select("form", F.col("street_id").alias("street_id2"), "number"), "form").select("street_id2", "number", "v").distinct()
    same_vendor = w.join(theirs, ["street_id2", "number", "v"]).select("form", "street_id2").distinct()
    candidates = near.where(fills | single & (F.col("r") >= STREET)).unionByName(weak.join(same_vendor, ["form", "street_id2"], "left_semi"))
    candidates = candidates.withColumn("known", F.lit(True)).withColumn("score", _score()).select("form", F.concat_ws("#", "street_id", "number").alias("from"), F.col("street_id2").alias("street_id"), "number", F.col("n2").alias("n"), "score", "local")
    chosen = _best(candidates, beam).select("form", "street_id")
    edges = here.join(chosen.withColumnRenamed("street_id", "to"), "form").select("street_id", "number", "to").groupBy("street_id", "number").agg(F.min("to").alias("to"))
    merged = components(edges.select(F.concat_ws("#", "street_id", "number").alias("a"), F.concat_ws("#", "to", "number").alias("b")), "a", "b")
    merged = stage(merged.select(F.col("record_id").alias("at"), F.col("group_id").alias("location")), "merged")

    # without a postcode: by town and street, by town and number, or by state, number and street
    rest = forms.where("zip = ''").drop("zip", "n")
    known = places.select("street_id", "number").distinct()
    streets = entries.select("zip", "street_id", "n", *_renamed(entries, *_PARTS))
    in_town = streets.join(towns, "zip").withColumn("t", _ends("town2")).withColumn("k", _ends("street2"))
    sought = rest.where("town <> ''").withColumn("t", _ends("town"))
    out = ["form", "number", "street_id", "street", "street2", "direction", "direction2", "kind", "kind2", "n", "town", "town2"]
    ok = fits & _fits("state", "state2")
    by_town = sought.withColumn("k", _ends("street")).join(in_town, ["t", "k"]).where(ok).select(out)
    numbered_there = places.select("zip", "street_id", "number", "n", *_renamed(places, *_PARTS)).join(towns, "zip").withColumn("t", _ends("town2")).withColumn("k", _letters("street2"))
    by_house = sought.withColumn("k", _letters("street")).join(numbered_there, ["t", "number", "k"]).where(ok).select(out)
    found = _with_ratio(by_town.unionByName(by_house).distinct(), "town", "town2", "local").where(F.col("local") >= TOWN).drop("town", "town2")
    bare = rest.where("town = ''").withColumn("k", _ends("street"))
    of_state = F.explode(F.array_distinct(F.array(F.col("state2"), F.lit(""))))
    by_state = places.select("zip", "street_id", "number", "n", *_renamed(places, *_PARTS)).join(towns.groupBy("zip").agg(F.max("state2").alias("state2")), "zip", "left").na.fill("", ["state2"])
    by_state = bare.join(by_state.withColumn("state", of_state).withColumn("k", _ends("street2")), ["state", "number", "k"]).where(fits).withColumn("local", F.lit(0.0)).select(found.columns)
    found = _with_ratio(found.unionByName(by_state).distinct(), "street", "street2", "r").where(F.col("r") >= WEAK)
    found = found.join(known.withColumn("known", F.lit(True)), ["street_id", "number"], "left").na.fill(False, ["known"])
    found = stage(found, "found")
    unsure = vendors.join(found.where(F.col("known") & (F.col("r") < STREET)).select("form", F.col("street_id").alias("street_id2"), "number").distinct(), "form")
    vouched = unsure.join(theirs, ["street_id2", "number", "v"]).select("form", F.col("street_id2").alias("street_id")).distinct()
    found = found.where(F.col("r") >= STREET).unionByName(found.where(F.col("known") & (F.col("r") < STREET)).join(vouched, ["form", "street_id"], "left_semi").select(found.columns))
    ranked = _best(found.withColumn("score", _score()), beam)
    # without a town, two streets that fit alike leave the address unresolved
    ranked = ranked.where("local > 0 or rival is null or score > rival + 0.05")
    alone = F.concat_ws("#", F.lit("?"), "street", "town", "number")
    lost = rest.join(ranked.select("form", "street_id"), "form", "left").where(F.col("street_id").isNotNull() | (F.col("town") != ""))
    at = own.select("form", F.concat_ws("#", "street_id", "number").alias("at")).unionByName(lost.select("form", F.when(F.col("street_id").isNull(), alone).otherwise(F.concat_ws("#", "street_id", "number")).alias("at")))
    located = at.join(merged, "at", "left").select("form", F.coalesce("location", "at").alias("location"))
    return rows.select("address", "form").join(located, "form").select("address", "location")


def same_place(receipts: DataFrame, beam: int = BEAM) -> DataFrame:
    """(receipt_a, receipt_b): all pairs of different receipts of which any rows' addresses denote one location, smaller id first.

    Null, empty and placeholder addresses, and those without a house number and street, denote none; an address with neither
    postcode nor town denotes one only if the gazetteer knows one that fits. Repeated rows count once; of the other columns only the
    vendor's name is read.
    """
    receipts = receipts.select("receipt_id", "vendor_address", "vendor_name").distinct()
    places = stage(locations(receipts, beam), "locations")
    seen = receipts.where("receipt_id is not null").select("receipt_id", F.col("vendor_address").alias("address")).distinct().join(places, "address").select("receipt_id", "location").distinct()
    seen = stage(seen, "receipt-places")
    a, b = seen.select("location", F.col("receipt_id").alias("receipt_a")), seen.select("location", F.col("receipt_id").alias("receipt_b"))
    return a.join(b, "location").where("receipt_a < receipt_b").select("receipt_a", "receipt_b").distinct()
