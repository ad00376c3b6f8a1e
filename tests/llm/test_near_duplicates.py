"""Near-duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest

from airtally.llm import near_duplicates as nd
from airtally.llm.components import components


def brute(rows, words, similarity):
    def shingles(text):
        own = (text or "").encode().lower().split()
        if not own:
            return frozenset()
        return frozenset(tuple(own[i : i + words]) for i in range(len(own) - words + 1)) if len(own) >= words else frozenset([tuple(own)])

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if rows[a][0] is not None and rows[b][0] is not None and (rows[a][0] == rows[b][0] and sets[a] and sets[b] or common and 100 * common >= similarity * len(sets[a] | sets[b])):
                parent[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((i, len(s), least.get(find(n)) if i is not None else None) for n, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def texts(seed, groups, copies, edits):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, doc_id = [], 0
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 90))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rnd.randint(0, edits)):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            rows.append((doc_id, " ".join(own).upper() if rnd.random() < 0.3 else " ".join(own)))
            doc_id += rnd.randint(1, 3)
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("listed, chunk, words, similarity", [(8, 512, 3, 85), (2, 5, 5, 80)])
def test_equals_all_pairs(spark, monkeypatch, listed, chunk, words, similarity):
    monkeypatch.setattr(nd, "LISTED", listed)
    monkeypatch.setattr(nd, "CHUNK", chunk)
    rows = texts(words, 8, 14, 6) + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "ONE  two"), (1005, "one"), (None, "one two"), (None, None), (1006, "one"), (1006, "one two"), (1005, "one")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, cls string").repartition(4)
    got = nd.near_duplicates(docs, words, similarity).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, words, similarity)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands_reach_the_promised_share():
    for similarity in (80, 85):
        assert (1 - (similarity / 100) ** nd.ROWS) ** nd.bands_for(similarity, 1e-7) <= 1e-7


def test_minima_estimate_similarity():
    rnd = np.random.default_rng(3)
    a = np.unique(rnd.integers(0, 2**64, 4000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:3000], rnd.integers(0, 2**64, 1000, dtype=np.uint64)]))
    left, right = (nd.minima(x, *nd.hashes(2000)) for x in (a, b))
    assert abs((left == right).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.04


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(500, i) for i in range(300, 330)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent) if find(x) != x}
