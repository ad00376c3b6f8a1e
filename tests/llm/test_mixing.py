"""Mixing: totals near the targets, disjoint shards, and the splitting tree."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from airtally.llm import mixing


def test_targets_share_what_the_full_leave():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 450, 2) == [200, 250 / 3, 500 / 3]
    assert mixing.targets([10, 1000], [1, 1], 1515, 2) == [20, 1495]
    assert mixing.targets([0, 10], [3, 1], 15, 2) == [0, 15]
    assert mixing.targets([], [], 0, 2) == []


@pytest.mark.parametrize("leaves", [1, 2, 7, 16])
def test_leaves_use_up_the_quota(leaves):
    quota = np.array([17, 0, 250, 3])
    taken = np.zeros(4, dtype=int)
    for leaf in range(leaves):
        before, own = mixing.leaf_counts(quota, leaves, leaf, 5)
        assert (before == taken).all() and (own >= 0).all()
        taken += own
    assert (taken == quota).all()


def test_spread_is_a_permutation():
    for n in (1, 2, 10, 97, 1000):
        factor, summand = mixing.spread(n, 3, 1)
        assert sorted((factor * i + summand) % n for i in range(n)) == list(range(n))


def documents(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, "s%d" % (i % 4) if i % 9 else None, " ".join(["w"] * int(rnd.integers(0, 60))), "en", 5) for i in range(400)]
    rows += [(900, "big", "word\tword\n" * 3000, "en", 5), (901, "s1", None, None, None), (902, "empty", "", "en", 0), (903, "s1", "a b c", "en", 5), (903, "s1", "a b c", "en", 5), (None, "s2", "x y", "en", 3)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, lang string, n_chars long").withColumn("draws", F.lit(1)).repartition(3)


def test_mix_meets_its_targets(spark):
    docs = documents(spark)
    got = mixing.mix(docs, shard_words=2000).collect()
    assert len(got) == docs.count()
    total, target, shards, longest = Counter(), {}, set(), Counter()
    for r in got:
        total[r.row.source] += r.taken
        target[r.row.source] = r.target
        longest[r.row.source] = max(longest[r.row.source], r.size)
        assert r.size == len((r.row.text or "").split()) and r.taken in (0, r.size, 2 * r.size) and r.taken == sum(d.words for d in r.draws)
        assert len({d.copy for d in r.draws}) == len(r.draws)
        shards |= {d.shard for d in r.draws}
    assert all(abs(total[s] - target[s]) <= longest[s] / 2 + 1 for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(r.size for r in got)) < 1e-6 and len(shards) > 3
    again = {(r.doc_id, r.row.text): (r.taken, sorted(map(tuple, r.draws))) for r in mixing.mix(docs.repartition(7), shard_words=2000).collect()}
    assert all(again[r.doc_id, r.row.text][0] == r.taken for r in got)


def test_mixed_texts_hold_what_is_taken(spark):
    docs = documents(spark)
    wanted = Counter()
    for r in mixing.mix(docs, shard_words=2000).collect():
        wanted[r.doc_id, r.row.text] += r.taken
    out = mixing.mixed(docs, shard_words=2000)
    assert out.columns == docs.columns
    words, texts = defaultdict(int), {(r.doc_id): r.text for r in docs.collect()}
    for r in out.collect():
        assert texts[r.doc_id] == r.text
        words[r.doc_id, texts[r.doc_id]] += len(r.text.split())
    assert words == {k: v for k, v in wanted.items() if v}


def test_empty_table(spark):
    docs = documents(spark).limit(0)
    assert mixing.mix(docs).count() == 0 and mixing.mixed(docs).count() == 0
