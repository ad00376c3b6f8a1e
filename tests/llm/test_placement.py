"""The lookup table's properties, and placement of odd keys."""

from collections import Counter

import pytest

from airtally.llm import placement

NAMES = [f"s{i}" for i in range(7)]


def claimed(names, size):
    """Turn by turn, from the definition."""
    order = []
    for name in names:
        offset, step = placement.digest(name, 0) % size, placement.digest(name, 1) % (size - 1) + 1
        order.append([(offset + j * step) % size for j in range(size)])
    owner = {}
    while len(owner) < size:
        for s in range(len(names)):
            free = next((slot for slot in order[s] if slot not in owner), None)
            if free is not None:
                owner[free] = s
    return [owner[i] for i in range(size)]


@pytest.mark.parametrize("size", [7, 13, 251])
def test_table_is_what_turns_give(size):
    assert placement.lookup_table(NAMES, size) == claimed(NAMES, size)


def test_table_is_even_and_stable():
    full, less = placement.lookup_table(NAMES, 10007), placement.lookup_table(NAMES[:-1], 10007)
    sizes = Counter(full).values()
    assert max(sizes) - min(sizes) <= 1
    kept = sum(a == b for a, b in zip(full, less) if a != len(NAMES) - 1)
    assert kept > 0.8 * sum(a != len(NAMES) - 1 for a in full)
    double = Counter(placement.lookup_table(NAMES, 10007, {"s0": 2}))
    assert abs(double[0] / double[1] - 2) < 0.01
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            placement.lookup_table(bad, 13)
    with pytest.raises(ValueError):
        placement.lookup_table(NAMES, 12)


def test_placement(spark):
    rows = [(i % 50, f"t{i}") for i in range(200)] + [(None, f"n{i}") for i in range(300)]
    docs = spark.createDataFrame([(k, t, "old") for k, t in rows], "doc_id long, text string, shard string")
    out = placement.place(docs, NAMES, size=251)
    got = out.collect()
    table = placement.lookup_table(NAMES, 251)
    assert len(got) == 500 and out.columns == ["doc_id", "text", "slot", "shard"]
    assert all(r.shard == NAMES[table[r.slot]] for r in got)
    by_key = {}
    for r in got:
        if r.doc_id is not None:
            by_key.setdefault(r.doc_id, set()).add(r.shard)
            assert r.slot == int(__import__("hashlib").md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % 251
    assert all(len(s) == 1 for s in by_key.values())
    assert len({r.shard for r in got if r.doc_id is None}) == len(NAMES)
    assert placement.place(docs.limit(0), NAMES, size=251).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Python" not in plan
