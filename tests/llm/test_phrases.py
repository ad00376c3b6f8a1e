"""Repeated passages against a comparison of all windows."""

import random

import pytest

from airtally.llm import phrases


def by_definition(docs, window):
    """(id, words, removed, kept) of every document, by looking at each window of each other one."""
    split = [(i, [w.decode() for w in (t or "").encode().split()]) for i, t in docs]
    first = {}
    for i, words in split:
        for k in range(len(words) - window + 1):
            if i is not None:
                own = tuple(words[k : k + window])
                first[own] = min(first.get(own, i), i)
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if i is not None and first[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


def check(spark, docs, window, **options):
    frame = spark.createDataFrame([(i, t, "x", [1]) for i, t in docs], "doc_id long, text string, kept string, starts array<int>").repartition(3)
    got = sorted((tuple(r) for r in phrases.remove_repeated(frame, window, **options).collect()), key=str)
    assert got == by_definition(docs, window)


def corpus(seed, n, vocabulary, passages):
    rnd = random.Random(seed)
    shared = [" ".join(rnd.choices(vocabulary, k=rnd.randint(3, 60))) for _ in range(passages)]
    docs = []
    for i in range(n):
        parts = [rnd.choice(shared) if rnd.random() < 0.5 else " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 30))) for _ in range(rnd.randint(0, 5))]
        docs.append((i, rnd.choice([" ", "\n", " \t "]).join(parts)))
    return docs


@pytest.mark.parametrize("window", [13, 4])
@pytest.mark.parametrize("heavy, cell", [(phrases.HEAVY, phrases.CELL), (5, 40), (0, 7)])
def test_passages_of_many_documents(spark, window, heavy, cell):
    words = [f"w{i}" for i in range(400)]
    docs = corpus(1, 120, words, 6)
    docs += [(1000 + i, docs[7][1]) for i in range(20)]  # copies
    docs += [(2000 + i, "start " + docs[9][1] + f" end {i}") for i in range(20)]
    check(spark, docs, window, heavy=heavy, cell=cell)


def test_few_words_over_and_over(spark):
    docs = corpus(2, 40, ["a", "b"], 3) + [(500, "a " * 300), (501, "a " * 299 + "b"), (502, "b " + "a " * 301)]
    check(spark, docs, 13, heavy=10, cell=20)


def test_rows_of_all_kinds(spark):
    text = " ".join(f"x{i}" for i in range(30))
    other = "before " + text + " behind"
    docs = [(5, text), (5, text), (5, text.replace(" ", "\n")), (5, other), (3, other.replace(" ", "  ")), (None, text), (None, None), (9, None), (1, ""), (8, "few words"), (7, text), (6, "ä " * 40), (10, "ä\x0b" * 40 + "\u2003 z")]
    check(spark, [(i, t) for i, t in docs], 13)


def test_very_long_text_and_empty_table(spark):
    rnd = random.Random(3)
    long = " ".join(f"v{rnd.randrange(10**6)}" for _ in range(60_000))
    words = long.split()
    check(spark, [(1, " ".join(words[20_000:20_040])), (2, long), (3, " ".join(words[59_980:]))], 13)
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert phrases.remove_repeated(frame).count() == 0
