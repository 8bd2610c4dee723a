"""Benchmark items dense in numbers, names and units."""

from quillstream.llm import decontamination as dec

ITEMS = [
    (1, "What is 12 * 7 + 3?"),
    (2, "Compute 12 + 45 + 12 + 88 + 7 + 45 + 3 + 19 kg and 12 + 88"),
    (3, "11 22 33 44 55 66 77 88 99"),
]


def found(spark, make_docs, text):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = make_docs([(1, "Some words stand before it. " + text + " And some stand after it.", "en")])
    return sorted(r.item_id for r in dec.leaks(docs, benchmark).collect())


def test_items_of_few_ordinary_words_are_found(spark, make_docs):
    for item, text in ITEMS:
        assert found(spark, make_docs, text) == [item]


def test_items_of_few_ordinary_words_are_found_with_new_numbers(spark, make_docs):
    assert found(spark, make_docs, "What is 31 * 9 + 4?") == [1]
    assert found(spark, make_docs, "Compute 21 + 54 + 21 + 98 + 6 + 54 + 5 + 13 kg and 21 + 98") == [2]


def test_inconsistent_or_bare_numbers_are_no_leak(spark, make_docs):
    assert found(spark, make_docs, "What is 31 * 9 + 9?") == []
    assert found(spark, make_docs, "Compute 21 + 54 + 20 + 98 + 6 + 54 + 5 + 13 kg and 21 + 98") == []
    assert found(spark, make_docs, "10 20 30 40 50 60 70 80 90") == []


def test_short_items_are_found_as_sentences_of_their_own(spark, make_docs):
    benchmark = spark.createDataFrame([(1, "Who wrote Hamlet first"), (2, "42"), (3, "Yes. No."), (4, ""), (5, "?")], "item_id long, text string")
    texts = ["Here it is. who wrote hamlet first? An answer.", "Who wrote Hamlet first", "I know who wrote Hamlet first of all.", "x\n42\ny", "the 42 of them", "So: no. Yes. No. Maybe."]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    got = {(r.doc_id, r.item_id) for r in dec.leaks(make_docs(rows), benchmark).collect()}
    assert got == {(0, 1), (1, 1), (3, 2), (5, 3)}


def test_reparameterised_items_are_recalled(spark, make_docs):
    """Items with all numbers, names and units replaced consistently, and the same with two slots swapped."""
    import random

    rng = random.Random(4)
    verbs, things = "buys sells carries counts packs loads".split(), "apples boxes tickets stones bricks".split()
    items, docs = [], []
    for k in range(60):
        a, b, c = rng.sample(range(3, 99), 3)
        v, t = rng.choice(verbs), rng.choice(things)
        shape = "On day {a} " + f"{k} times the merchant called {{n}} {v} {{b}} {t} for {{c}} dollars each and then {{n}} {v} {{a}} more, how many {t} remain"
        items.append((k, shape.format(a=a, b=b, c=c, n="Alice")))
        x, y, z = rng.sample(range(200, 999), 3)
        docs.append((k, "Some prose goes first. " + shape.format(a=x, b=y, c=z, n="Robert") + ". More prose.", "en"))
        docs.append((1000 + k, shape.format(a=x, b=y, c=z, n="Robert").replace(f"{x} more", f"{y} more"), "en"))
    got = {(r.doc_id, r.item_id) for r in dec.leaks(make_docs(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    own = {d for d, i in got if d == i}
    assert len(own) >= 0.9 * len(items)
