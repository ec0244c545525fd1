import random

from millrace.functions import similarity


def brute(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_lcs_lengths():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdeé字") for _ in range(rng.randrange(n)))
    a, b = [word(20) for _ in range(400)] + [word(150) for _ in range(10)], [word(30) for _ in range(400)] + [word(150) for _ in range(10)]
    want = [brute(x, y) for x, y in zip(a, b)]
    assert similarity.lcs_lengths(a, b).tolist() == want
    assert [similarity.lcs_length(x, y) for x, y in zip(a, b)] == want
    assert similarity.lcs_lengths([], []).tolist() == [] and similarity.lcs_lengths(["", ""], ["", "a"]).tolist() == [0, 0]
    assert similarity.lcs_length("kitten", "sitting") == 4


def test_letter_bags_bound_subsequences():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdeé字 ") for _ in range(rng.randrange(n)))
    a, b = [word(30) for _ in range(400)] + [word(900) for _ in range(9)], [word(30) for _ in range(400)] + [word(900) for _ in range(9)]
    bags = [similarity.letter_bags(x).astype("uint64") for x in (a, b)]
    bits = [int(x).bit_count() + int(y).bit_count() for x, y in bags[0] ^ bags[1]]
    assert all(2 * brute(x, y) <= len(x) + len(y) - n for x, y, n in zip(a, b, bits))
    assert similarity.letter_bags([]).shape == (0, 2) and (similarity.letter_bags(["abca"]) == similarity.letter_bags(["caab"])).all()


def test_with_lcs(spark):
    df = spark.createDataFrame([("kitten", "sitting", 1), (None, "x", 2), ("", "", 3)], "a string, b string, n int")
    assert {r.n: r.lcs for r in similarity.with_lcs(df, "a", "b").collect()} == {1: 4, 2: None, 3: 0}
    assert similarity.with_lcs(df.limit(0), "a", "b").collect() == []
