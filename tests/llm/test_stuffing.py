import random

import numpy as np

from millrace.llm import stuffing

NOUNS = "letter bridge owner kitchen harbour wagon teacher window river garden".split()


def prose(rng, n):
    one = lambda: f"The {rng.choice(NOUNS)} of the {rng.choice(NOUNS)} was found by a {rng.choice(NOUNS)} in {rng.randrange(1900, 2000)}, and the {rng.choice(NOUNS)} went to {rng.choice(['Arden', 'Vexley'])} with it."
    return " ".join(one() for _ in range(n))


def pages():
    rng = random.Random(2)
    goods = ["hair dryer", "sofa bed", "used tyres", "ski boots"]
    good = [prose(rng, rng.randrange(1, 12)) for _ in range(60)] + [
        prose(rng, 4) + "\n\nTags: harbour, river, garden",
        "```python\ndef f(x):\n    rows = []\n    for row in x:\n        rows.append(row)\n    return rows\n```",
        "id,vendor,item,total\n" + "\n".join(f"{i},Ann,hair dryer,{i * 7}.50" for i in range(20)),
        "\n".join(f"[{i}] https://a.example/p{i}.html - {prose(rng, 1)}" for i in range(5)),
        "9f8a7c " * 60,
        " ".join(str(rng.randrange(10**6)) for _ in range(80)),
        "",
        None,
        "Too short.",
        "\n \n",
    ]
    bad = [
        ", ".join(f"{rng.choice(['buy', 'cheap', 'best'])} {rng.choice(goods)}" for _ in range(40)),
        "Zumo sofa bed zumo Zumo sofa bed Zumos sofa bed " * 8,
        " ".join(f"#cheap{rng.choice(goods).replace(' ', '')}{i}" for i in range(30)),
        "\n".join(f"https://x{i}.example/shop/{rng.choice(goods).replace(' ', '-')}?id={i}" for i in range(30)),
        "\n".join(f'<a href="http://y{i}.test/p/{i}.html">{rng.choice(goods)}</a>' for i in range(20)),
        "Home > Shop > Sofa Bed\n" + " | ".join(g.title() for g in rng.choices(goods, k=40)),
        "\n".join(f"Arden Labs {rng.choice(goods).title()} K{i} black €{i + 3}.99 add to cart" for i in range(15)),
        "Looking for the best sofa bed? Our sofa bed is the sofa bed that sofa bed fans call the top sofa bed. Buy sofa bed today, because sofa bed deals make every sofa bed cheaper. " * 4,
        prose(rng, 1) + "\n\n" + " ".join(f"{rng.choice(['buy', 'cheap', 'best'])} {rng.choice(goods)}" for _ in range(60)),
        "sofa bed sale, " * 60_000,
    ]
    return good, bad


def test_kinds_of_pages(spark):
    good, bad = pages()
    rows = [(i, t, 1) for i, t in enumerate(good)] + [(1000 + i, t, 1) for i, t in enumerate(bad)] + [(1000, bad[0], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, stuffed int").repartition(3)
    got = sorted(r.doc_id for r in stuffing.stuffed_pages(df).collect())
    assert got == [1000, *range(1000, 1000 + len(bad))]


def test_the_model_decides(spark):
    """With a flat model, which finds every class equally surprising, pages are lost that the corpus' model finds."""
    good, bad = pages()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    model = stuffing.train(df)
    flat = stuffing.Model(model.grams[:0], model.counts[:0])
    flat.mean = float(-np.log(1 / stuffing.N_CLASSES))
    right = {len(good) + i for i in range(len(bad))}
    found = {r.doc_id for r in stuffing.stuffed_pages(df, flat).collect()}
    assert len(found ^ right) >= 3


def test_fitted_weights_separate_labelled_pages():
    good, bad = pages()
    texts, labels = [t for t in good + bad if t is None or len(t) < 10_000], [False] * len(good) + [True] * (len(bad) - 1)
    reader = stuffing.Reader()
    b = reader.read(texts)
    grams, s = stuffing._trigrams(b)
    model = stuffing.Model(*np.unique(grams[stuffing._prose(b, s, grams)[s]], return_counts=True))
    weights, bias = stuffing.fit(texts, labels, model)
    p = stuffing.measure(b, len(texts), model)
    found = p.measures @ np.array([weights[m] for m in stuffing.MEASURES]) + bias > 0
    assert (found == np.array(labels)).mean() > 0.95


def test_counts_do_not_depend_on_partitions(spark):
    good, bad = pages()
    df = spark.createDataFrame([(t,) for t in good + bad], "text string")
    one, many = stuffing.train(df.coalesce(1)), stuffing.train(df.repartition(5))
    assert (one.grams == many.grams).all() and (one.counts == many.counts).all()
    assert 0 < one.mean < 5 and abs(sum(one.one) - 1) < 1e-9


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert stuffing.stuffed_pages(df).collect() == []
    assert stuffing.scores(spark.createDataFrame([(1, None)], "doc_id long, text string")).first().perplexity is None
