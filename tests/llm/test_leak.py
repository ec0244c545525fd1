import random

from millrace.llm import leak

PLACES = ["Zuhovar", "Makitel", "Porusan", "Devalik", "Hoburen", "Talimor", "Senakir", "Volubrek"]


def item(rng):
    a, b, c = (rng.choice(PLACES) + rng.choice("abcdefgh") + rng.choice("klmnpr") + rng.choice("aeiou") for _ in range(3))
    n = [rng.randrange(11, 99) for _ in range(6)]
    return f"According to the charter of {a} the miller must deliver {n[0]} bundles of flax to {b} after {n[1]} days. Article {n[2]} lowers this to {n[3]} bundles if the bridge at {c} stays closed for {n[4]} weeks. How many bundles reached {b} from {c} in {n[5]} days?"


def make():
    rng = random.Random(8)
    items = [(i, item(rng) + (" Show your steps and give the answer on its own line." if i % 3 == 0 else "")) for i in range(20)]
    other = [item(rng) for _ in range(40)]
    return rng, items, other


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.doc_id, r.item_id) for r in leak.leaks(d, i).collect())


def test_whole_partial_reformatted_and_alike(spark):
    rng, items, other = make()
    text = dict(items)
    words = text[4].split()
    soft = "".join(c + "­" if k % 7 == 0 else c for k, c in enumerate(text[5]))
    docs = [
        (1, "Some words before. " + text[1] + " And after.", 0),
        (2, "x " + " ".join(words[3:24]) + " y", 0),
        (3, text[2].upper().replace(" ", "\n> "), 0),
        (4, soft, 0),
        (5, "<p>" + text[3].replace(". ", ".</p>\n<p>") + "</p>", 0),
        (6, text[6].replace("bundles", "bundels", 1).replace("must ", ""), 0),
        (7, text[7] + " " + text[8], 0),
        (8, None, 0),
        (9, "", 0),
        (10, "Show your steps and give the answer on its own line.", 0),
        (11, "word " * 50_000 + text[9] + " word" * 50_000, 0),
        (11, "word " * 50_000 + text[9] + " word" * 50_000, 0),
        (12, " ".join(words[3:9]), 0),
        *((100 + k, "Intro text. " + t, 0) for k, t in enumerate(other)),
    ]
    want = [(1, 1), (2, 4), (3, 2), (4, 5), (5, 3), (6, 6), (7, 7), (7, 8), (11, 9)]
    assert run(spark, docs, items) == want


def test_empty_tables(spark):
    _, items, other = make()
    assert run(spark, [], items) == []
    assert run(spark, [(1, other[0], 0)], []) == []
    assert run(spark, [(1, other[0], 0), (None, items[0][1], 0)], [(1, None), (None, other[0]), (2, " ")]) == []


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(1)

    def brute(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(1, 12))] for _ in range(2))
        pairs = leak._aligned(a, b)
        assert len(pairs) == brute(a, b) and all(a[j] == b[i] for j, i in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


PROSE = "Explain why the tide rises twice on most days although the moon passes over the harbour only once between noon and midnight"


def test_a_verbatim_item_is_found_whatever_the_other_items_are(spark):
    _, items, other = make()
    docs = [(1, "Before it. " + PROSE + ". After it.", 0), (2, "Some words about " + " ".join(PROSE.split()[4:17]) + " and so on.", 0), (3, other[0], 0)]
    for n in (0, 1, 2, 20):
        own = [(900, PROSE + "?"), *items[:n]]
        assert run(spark, docs, own) == [(1, 900), (2, 900)]


def test_a_tenth_of_the_items_gives_the_same_leaks(spark):
    _, items, other = make()
    text = dict(items)
    docs = [(1, text[10], 0), (2, "On. " + text[0] + " Off.", 0), *((9 + k, t, 0) for k, t in enumerate(other))]
    every = run(spark, docs, items)
    assert [x for x in every if x[1] % 10 == 0] == run(spark, docs, [x for x in items if x[0] % 10 == 0]) == [(1, 10), (2, 0)]


def test_reparameterised_questions_are_told_by_their_slots(spark):
    item = "Mill Kavo stores 23 tins of felt hats in a cellar below Depor, and the crew carries 61 of them upstairs each day. How many tins does Kavo hold after 96 days?"
    other = "Mill Sobu stores 48 tins of felt hats in a cellar below Lutan, and the crew carries 17 of them upstairs each day. How many tins does Sobu hold after 30 days?"
    edited = "Mill Kavo stores 23 tins of woollen hats in a cellar below Depor, and the crew carries 62 of them upstairs each day. How many tins does Kavo hold after 96 days?"
    assert run(spark, [(1, other, 0), (2, edited, 0)], [(5, item)]) == [(2, 5)]


def test_a_sentence_that_the_corpus_has_without_the_item_is_stock(spark):
    stock = "Read everything once more before writing down your own short answer in one plain sentence below."
    item = "Baker Zuhovar sold 47 loaves to Makitel and 92 to Porusan before noon. " + stock
    docs = [(k, f"Task {k}. " + stock, 0) for k in range(10)] + [(50, "Here: " + item, 0)]
    assert run(spark, docs, [(7, item)]) == [(50, 7)]


def test_repeated_documents_and_documents_without_key(spark):
    text = "the river runs along the old wall and then it turns slowly towards the wide green plain where sheep and goats graze all day long"
    other = "nothing of this is to be found in what the people of the town tell about the river and the old wall at night"
    docs = spark.createDataFrame([("d1", text), ("d1", text), ("d2", text), (None, text), ("d3", other), ("d3", text)], "doc_id string, text string")
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert sorted(tuple(r) for r in leak.leaks(docs, items).collect()) == [("d1", 1), ("d2", 1), ("d3", 1)]
