import pytest

from millrace.llm import names


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("The Gorim Palunast Brothers of Oakenridge LLC", ("org", "at oakenridge", "palunast", "gorim", "", "")),
        ("PALUNAST, GORIM BROS - OAKENRIDGE L.L.C.", ("org", "at oakenridge", "palunast", "gorim", "", "")),
        ("Gorim & Palunast Energy Fund II Inc", ("org", "fund 2", "palunast", "gorim", "", "")),
        ("Enrgy Gorim + Pálunast Fund Two, Accounts Dept", ("org", "fund 2", "palunast", "gorim", "", "")),
        ("Tovuram, Bill J. Jr.", ("person", "jr", "tovuram", "", "william", "j")),
        ("Hon. William Tovuram III, Trustee", ("person", "iii", "tovuram", "", "william", "")),
        ("W  TOVURAM, SR.", ("person", "sr", "tovuram", "", "w", "")),
        ("Priya Raghunathan", ("either", "", "raghunathan", "priia", "", "")),
        (" n/a ", None),
        ("", None),
        (None, None),
    ],
)
def test_reading(name, want):
    assert names.read_name(name) == want


RECORDS = [
    ("r1", "The Gorim Palunast Brothers of Oakenridge LLC"),
    ("r2", "PALUNAST, GORIM BROS - OAKENRIDGE L.L.C."),
    ("r2", "PALUNAST, GORIM BROS - OAKENRIDGE L.L.C."),
    ("r3", "Gorim Palunast Brothers of Vexley LLC"),
    ("r4", "Goorimpalunast Brothers - Oakenridge"),
    ("r5", "Zubekir & Tohamand Energy Fund I"),
    ("r6", "Zubekir & Tohamand Energy Fund II"),
    ("r7", "Zubek. + Tohamamd Enrgy Fund 2"),
    ("r8", "William J Tovuram Jr"),
    ("r9", "Tovuram, Bill, Jr."),
    ("s1", "William J Tovuram Sr"),
    ("s2", None),
    ("s3", "-"),
    ("s4", ""),
    ("s5", "Deborah Tovuram Jr"),
    (None, "William J Tovuram Jr"),
]
PAIRS = [("s2", "x", "zubekir tohamand energy fund two", None), ("s2", "x", "zubekir tohamand energy fund two", None), ("y", "s2", None, "Other Name"), ("s4", "s2", None, None), (None, "s3", "A", " ")]


def found(spark, records, pairs, common=names.COMMON):
    r = spark.createDataFrame([(*x, "z") for x in records], "id string, name string, entity string")
    p = spark.createDataFrame([(*x, "z") for x in pairs], "record_a string, record_b string, name_a string, name_b string, class string")
    return sorted(tuple(x) for x in names.linked_records(r, p, common).collect())


def test_linked_records(spark):
    want = [("r1", "r2"), ("r1", "r4"), ("r2", "r4"), ("r6", "r7"), ("r6", "s2"), ("r7", "s2"), ("r8", "r9")]
    assert found(spark, RECORDS, PAIRS) == want
    assert found(spark, [], []) == []


def test_common_suffixes_are_refined_not_dropped(spark):
    crowd = [(f"c{i:03d}", f"{a}{b}kolum {c}nalunast Foods Inc") for i, (a, b, c) in enumerate((x, y, z) for x in ("Be", "Do", "Fu") for y in ("ra", "ti", "mo") for z in ("Ga", "Hipo", "Zu"))]
    twin = [("t001", "Gá­nalunast-Berakolum Foods"), ("t002", "BERAKOLUM GANALUNAST FDS")]
    assert {("c000", "t001"), ("c000", "t002"), ("t001", "t002")} <= set(found(spark, crowd + twin, [], common=3))


def test_large_blocks_compare_all_their_pairs(spark):
    crowd = [(f"c{i:02d}", f"Gregory {c} {x}ogaudibor") for i, (c, x) in enumerate((c, x) for c in "ABC" for x in ("Br", "Kl", "St"))]
    twins = [("t1", "Gregory Hogaudibor"), ("t2", "Gregory K Hogaudibor")]
    assert ("t1", "t2") in found(spark, crowd + twins, [], common=1)
    assert found(spark, crowd + twins, [], common=1) == found(spark, crowd + twins, [], common=1000)


def test_two_words_may_be_a_person(spark):
    rows = [("a", "Priya Raghunathan"), ("b", "P. Raghunathan"), ("c", "Raghunatan, Priya"), ("d", "Q. Raghunathan"), ("e", "Raghunathan Priya Ltd"), ("f", "Q Solomon")]
    assert found(spark, rows, []) == [("a", "b"), ("a", "c"), ("a", "e"), ("b", "c"), ("b", "e"), ("c", "e")]


def test_pairs_are_compared_where_their_block_is(spark, monkeypatch):
    plans = []

    def seen(links, *columns, components=names.components):
        plans.append(links._jdf.queryExecution().executedPlan().toString())
        return components(links, *columns)

    monkeypatch.setattr(names, "components", seen)
    assert len(found(spark, RECORDS, PAIRS)) == 7
    # only blocks are shuffled: pairs of classes, or their readings by class, are not
    shuffled = [x.split("Exchange ")[1] for x in plans[0].splitlines() if "Exchange " in x]
    assert shuffled and all(x.startswith("hashpartitioning(block#") for x in shuffled)


def test_what_is_compared_loses_no_entity(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(9)
    fields = ["kind", "apart", "one", "two", "first", "middle"]
    stems = ["palunast", "gorim", "tovuram", "kolumbreck", "za"]

    def typed(word):
        i = rng.randrange(len(word))
        return word[:i] + rng.choice(["", "x", word[i]]) + word[i + 1 :] if rng.random() < 0.6 else word[: rng.randrange(3, 12)]

    def reading():
        kind, one, two = rng.choice(["person", "org", "either"]), typed(rng.choice(stems)), typed(rng.choice(stems))
        given = rng.choice(["", "g", "gorim", "p", "palunast"]) if kind == "person" else ""
        return kind, "", one, "" if kind == "person" or kind == "org" and rng.random() < 0.2 else two, given, ""

    rows = [(i, *reading()) for i in range(250)]
    c = names._bags(spark.createDataFrame(rows, "class long, " + names.READING))
    x, y = (c.select(*(F.col(n).alias(f"{p}_{n}") for n in c.columns)) for p in ("x", "y"))
    kept = {tuple(r) for r in x.join(y, names._comparable(*(lambda n, p=p: F.col(f"{p}_{n}") for p in ("x", "y")))).select("x_class", "y_class").collect()}
    import pandas as pd

    every = [(a, b) for a in rows for b in rows]
    a, b = (pd.DataFrame([e[i][1:] for e in every], columns=fields) for i in (0, 1))
    same = names.same_entity(a, b)
    linked = {(p[0], q[0]) for (p, q), s in zip(every, same) if s}
    assert linked <= kept and len(linked) > 1000 and len(kept) < len(every) / 2
