"""Runs of words against their definition, and the registered query against it."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from airtally.llm import periodic
from airtally.llm.queries import QUERIES


def runs_by_definition(words, least):
    """Every stretch of every period that cannot be extended, and has no smaller period."""
    found, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, 2 * q):
                own = words[i : i + length]
                if all(any(own[k] != own[k + p] for k in range(length - p)) for p in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def find(words, least):
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return periodic.find_runs(np.array([number[w] for w in words], dtype=np.int64), least)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60), st.sampled_from([2, 3, 4, 7, 12]))
def test_runs_of_few_words(words, least):
    assert find(words, least) == runs_by_definition(words, least)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=6), st.integers(1, 6)), max_size=8))
def test_runs_of_powers(parts):
    words = list("".join(text * times for text, times in parts))
    assert find(words, 4) == runs_by_definition(words, 4)


def test_one_word_over_and_over_is_one_run():
    assert find(["a"] * 5000, 12) == [(0, 5000, 1)]


def test_ordered_set_in_blocks():
    rnd = np.random.default_rng(3)
    values = rnd.permutation(5000).tolist()
    own, seen = periodic.Positions(values[0]), {values[0]}
    for v in values[1:]:
        if v % 7 == 0:
            assert own.around(v) == (max((x for x in seen if x < v), default=None), min((x for x in seen if x > v), default=None))
        own.add(v)
        seen.add(v)
    assert list(own) == sorted(values) and own.size == 5000


def test_rows_of_all_kinds(spark):
    line = "one two three four five six "
    texts = [(1, line * 3), (2, None), (3, ""), (4, "plain text"), (None, "x " * 13), (1, line * 3), (5, "\t".join(["y\x0bz"] * 6)), (6, "ä b " * 12), (7, ("w " * 11).strip())]
    docs = spark.createDataFrame([(i, t, "kept out", 5) for i, t in texts], "doc_id long, text string, collapsed string, runs int")
    got = {}
    for r in periodic.periodic_runs(docs.repartition(3)).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    assert got[1] == [(18, [(0, 18, 6)], line.strip())] * 2
    assert got[2] == got[3] == [(0, [], "")] and got[4] == [(2, [], "plain text")]
    assert got[None] == [(13, [(0, 13, 1)], "x")]
    assert got[5] == [(12, [(0, 12, 2)], "y z")]
    assert got[6] == [(12, [(0, 12, 1)], "ä b")] and got[7] == [(11, [], " ".join("w" * 11))]
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    rnd = np.random.default_rng(5)
    noise = " ".join(f"w{i}" for i in rnd.integers(0, 10**9, 60_000))
    text = f"{noise} {'again and ' * 30_000}"
    row = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(60_000, 60_000, 2)] and row.collapsed == f"{noise} again and"


def planted(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n > 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def digests(words, runs):
    dropped = set()
    for s, n, q in runs:
        dropped.update(range(s + q, s + n))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


@pytest.mark.parametrize("folder", ["sf0.001"])
def test_query_against_definition(spark, folder):
    """Periods up to a tenth of a text by their definition: stretches of equal words at a distance."""
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in QUERIES["op13_periodic_runs"](spark, f"/root/testdata/{folder}").collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        words = planted(doc_id, text)
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids, n, found = np.array([number[w] for w in words], dtype=np.int64), len(words), {}
        for q in range(1, n // 2 + 1):
            same = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
            begin, end = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:])
            for i, j in zip(begin.tolist(), end.tolist(), strict=True):
                if j - i + q >= max(12, 2 * q) and not any(i >= s and j + q <= s + m for s, m, p in found.values() if q % p == 0):
                    found[i, q] = (i, j - i + q, q)
        runs = sorted(found.values(), key=lambda r: (r[0], r[2]))
        assert got[doc_id] == digests(words, runs), doc_id
