import random

from millrace.llm import groups


def brute(rows):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b, c in rows:
        for x in (a, b):
            if x is not None:
                find(x)
        if a and b and (c or "").strip().lower() in groups.LINKING:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def found(spark, rows, parts=5, bound=500_000):
    df = spark.createDataFrame(rows, "record_a string, record_b string, confidence string").repartition(parts)
    out = groups.match_groups(df, bound).collect()
    assert len({r.record_id for r in out}) == len(out)
    return {r.record_id: r.group_id for r in out}


def test_random_graphs_in_many_small_tasks(spark):
    rng = random.Random(3)
    for bound in (10, 500_000):
        rows = [(f"r{rng.randrange(400):04d}", f"r{rng.randrange(400):04d}", rng.choice(["auto", " High", "low", None, "", "medium "])) for _ in range(260)]
        rows += [("hub", f"r{i:04d}", "auto") for i in range(0, 60, 3)] * 2 + [("x", None, "auto"), (None, "y", "high"), ("z", "z", "auto"), (None, None, "auto")]
        assert found(spark, rows, 7, bound) == brute(rows)


def test_long_chain_in_order(spark):
    rows = [(f"c{i:04d}", f"c{i + 1:04d}", "auto") for i in range(120)]
    assert set(found(spark, rows, 6, 20).values()) == {"c0000"}


def test_empty_and_extra_columns(spark):
    assert found(spark, []) == {}
    df = spark.createDataFrame([("b", "a", "HIGH", 1, 2)], "record_a string, record_b string, confidence string, node int, root int")
    assert sorted(tuple(r) for r in groups.match_groups(df).collect()) == [("a", "a"), ("b", "a")]
