import math
import random

import pytest

from millrace.llm import consensus

SCHEMA = "item string, annotator string, vote boolean"


def brute(votes, rounds=40):
    by, ann = {}, sorted({a for _, a, _ in votes})
    for i, a, v in votes:
        by.setdefault(i, {})[a] = int(v)
    first = True
    for _ in range(rounds):
        t, tv, fv, n = ({a: 0.0 for a in ann} for _ in range(4))
        prior = 0.0
        for vs in by.values():
            m, yes = len(vs), sum(vs.values())
            if first:
                p, others = yes / m, {a: (yes - v) / (m - 1) if m > 1 else 0.5 for a, v in vs.items()}
            else:
                c = {a: math.log(hit[a] / (1 - rej[a])) if v else math.log((1 - hit[a]) / rej[a]) for a, v in vs.items()}
                s = sum(c.values()) + math.log(pr / (1 - pr))
                p, others = 1 / (1 + math.exp(-s)), {a: 1 / (1 + math.exp(c[a] - s)) for a in vs}
            prior += p
            for a, v in vs.items():
                n[a] += 1
                t[a] += others[a]
                tv[a] += others[a] * v
                fv[a] += (1 - others[a]) * (1 - v)
        first = False
        hit = {a: (tv[a] + 1.5) / (t[a] + 2.5) for a in ann}
        rej = {a: (fv[a] + 1.5) / (n[a] - t[a] + 2.5) for a in ann}
        pr = (prior + 1) / (len(by) + 2)
    s = {i: math.log(pr / (1 - pr)) + sum(math.log(hit[a] / (1 - rej[a])) if v else math.log((1 - hit[a]) / rej[a]) for a, v in vs.items()) for i, vs in by.items()}
    return {i: x > 0 for i, x in s.items()}, hit, rej


def planted(seed, items=300):
    rng = random.Random(seed)
    quality = {f"a{k}": rng.choice([(0.95, 0.9), (0.6, 0.6), (0.2, 0.25), (0.9, 0.5), (0.99, 0.05)]) for k in range(12)}
    quality["a0"] = quality["a1"] = (0.93, 0.93)
    truth = {f"s{i}": rng.random() < 0.4 for i in range(items)}
    votes = []
    for i, t in truth.items():
        for a in rng.sample(sorted(quality), rng.randrange(3, 10)):
            hit, rej = quality[a]
            votes.append((i, a, rng.random() < hit if t else rng.random() >= rej))
    return truth, votes


def test_against_brute_force(spark):
    truth, votes = planted(5)
    c = consensus.reweighted_votes(spark.createDataFrame(votes, SCHEMA), tolerance=1e-6)
    want, hit, rej = brute(votes)
    got = {r.item: r.p_true for r in c.items.collect()}
    assert {i: p > 0.5 for i, p in got.items()} == want
    assert sum(want[i] != t for i, t in truth.items()) < 30
    for r in c.annotators.collect():
        assert abs(r.hit_rate - hit[r.annotator]) < 1e-3 and abs(r.reject_rate - rej[r.annotator]) < 1e-3


def test_alpha(spark):
    votes = [("i", "a", True), ("i", "b", True), ("j", "a", False), ("j", "b", True), ("k", "a", False), ("k", "b", False), ("l", "a", True)]
    r = consensus.agreement(spark.createDataFrame(votes, SCHEMA)).first()
    # of 6 pairable votes, 2 of 6 ordered pairs disagree; 3 are true
    assert (r.n_items, r.n_votes) == (3, 6) and abs(r.alpha - (1 - (2 / 6) / (2 * 3 * 3 / 30))) < 1e-8
    assert consensus.agreement(spark.createDataFrame([], SCHEMA)).first().alpha is None


def test_rows(spark):
    schema = "sample_id string, votes_bug int, votes_no_bug int, prompt_results map<string, struct<has_bug: boolean, severity: string, note: string>>, updated_at timestamp, loaded_at timestamp, vote int, p_true int"
    v = lambda **x: {k: (b, None, None) for k, b in x.items()}
    import datetime as dt

    at = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    rows = [
        ("a", 9, 0, v(x=True, y=True, z=None), at[0], at[0], 1, 1),
        ("a", 9, 0, v(x=True, y=True, z=None), at[0], at[0], 1, 1),
        ("b", 3, 1, None, at[0], None, 1, 1),
        ("b", 1, 3, {}, at[1], None, 1, 1),
        ("c", None, None, v(x=None), None, None, 1, 1),
        ("d", 0, 2, v(x=False, y=False), at[1], at[1], 1, 1),
        (None, 5, 0, v(x=True), at[0], at[0], 1, 1),
    ]
    got = {r.sample_id: r.label for r in consensus.sample_labels(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": "bug", "b": "no_bug", "c": "no_bug", "d": "no_bug"}
    assert consensus.sample_labels(spark.createDataFrame([], schema)).collect() == []


def test_rounds_that_do_not_suffice_are_reported(spark):
    votes = spark.createDataFrame([(f"s{i}", f"p{j}", (i * j) % 3 > 0) for i in range(12) for j in range(5)], "item string, annotator string, vote boolean")
    with pytest.warns(RuntimeWarning, match="after 1 rounds"):
        assert not consensus.reweighted_votes(votes, tolerance=0.0, most_rounds=1).converged
    assert consensus.reweighted_votes(votes).converged


def test_agreement_of_samples(spark):
    verdict = lambda *said: {f"p{i}": (b,) for i, b in enumerate(said)}
    rows = [("a", 1, 1, verdict(True, True, False), 0.4), ("a", 2, 2, None, None), ("b", 1, 1, verdict(True), 1.0), ("c", 1, 1, verdict(None), 0.5), (None, 1, 1, verdict(True), 0.1)]
    df = spark.createDataFrame(rows, "sample_id string, updated_at int, loaded_at int, prompt_results map<string, struct<has_bug: boolean>>, confidence double")
    got = {r.sample_id: (r.n_votes, r.agreement, r.stated_confidence) for r in consensus.sample_agreement(df).collect()}
    assert got == {"a": (3, 0.333333, 0.4), "b": (1, None, 1.0)}
