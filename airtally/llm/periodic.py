"""Periodic runs of words in texts, by descending-LCP Kruskal.

A run is a stretch of words with smallest period q, at least ``2 * q`` and ``least`` words long,
that no neighbouring word extends keeping the period.

1. *Candidates.* A run repeats some ``least / 2`` words at the distance of its period, so only
   texts in which a gram of that many words occurs twice go on. Grams are compared by hash here,
   over all words of a slice of texts at once; a collision costs time only.
2. *Suffix order.* Suffixes are sorted by their first words, then by doubling the number of words
   compared, ties alone being sorted again. The ranks of each doubling give the longest common
   prefix (LCP) of neighbours in that order.
3. *Kruskal.* Neighbours are united by decreasing LCP, in a forest whose classes hold their
   positions in order. When classes meet at LCP l, two positions of different classes that are now
   next to each other, at a distance d of at most l, are the seed of a run: they agree on exactly l
   words, so the run has period d and ends l words behind the second one. No smaller period exists,
   or a position between them would have been in the class before. Every position of a run but its
   last 2q - 1 is in a seed, so the first one is where the run starts.

Each text is a row's own matter: there is no shuffle, and a lost task reads its rows again. A text is
held as a whole, at some 100 bytes for each word of those that go on.

Defined cases: a null or empty text has no runs and an empty collapsed text; a null id is kept;
repeated rows come out as often as they go in; an empty table gives an empty table; further columns
are ignored, whatever their names. Words of one text are compared as bytes, in full.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .words import Words, grams, hashes, words_of

LEAST_WORDS = 12
#: Bytes of text whose words are looked at together, besides a longer single text.
TOGETHER = 1_000_000
#: Positions in a block of an ordered set.
BLOCK = 512
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Positions:
    """An ordered set of positions, in blocks so that a large one grows in small steps."""

    __slots__ = ("blocks", "last", "size")

    def __init__(self, position: int) -> None:
        self.blocks, self.last, self.size = [[position]], [position], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, position: int) -> None:
        i = min(bisect_left(self.last, position), len(self.last) - 1)
        block = self.blocks[i]
        insort(block, position)
        self.last[i] = block[-1]
        self.size += 1
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks[i : i + 1] = [block[:half], block[half:]]
            self.last[i : i + 1] = [block[half - 1], block[-1]]

    def around(self, position: int) -> tuple[int | None, int | None]:
        """The nearest smaller and larger members; ``position`` is none."""
        i = bisect_left(self.last, position)
        if i == len(self.last):
            return self.last[-1], None
        block = self.blocks[i]
        j = bisect_left(block, position)
        before = block[j - 1] if j else self.last[i - 1] if i else None
        return before, block[j]


def ordered(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share their first ``least`` words with another one, so ordered that those with
    a common prefix are neighbours, and the LCP of each with the next (0 where it is shorter)."""
    n = len(ids)
    # a class is numbered by the place of its first member, so splitting it keeps the others'
    count = np.bincount(ids)
    rank, width, levels = (np.cumsum(count) - count)[ids], 1, []

    def second(rank: np.ndarray, at: np.ndarray, ahead: int) -> np.ndarray:
        """The rank so many words further on; before all others where the text ends."""
        there = at + ahead
        return np.where(there < n, rank[np.minimum(there, n - 1)], -1)

    while width < least:
        step = min(width, least - width)
        at = np.arange(n)
        pair = rank * (n + 1) + second(rank, at, step) + 1
        order = np.argsort(pair, kind="stable")
        new = np.ones(n, dtype=bool)
        new[1:] = pair[order[1:]] != pair[order[:-1]]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        width += step
    tied = in_company(rank)
    if not len(tied):
        return tied, tied
    place = rank.copy()
    found = tied
    while len(tied):
        levels.append((width, place.astype(np.int32)))
        pair = place[tied] * (n + 1) + second(place, tied, width) + 1
        order = np.argsort(pair, kind="stable")
        pair, tied = pair[order], tied[order]
        outer = pair // (n + 1)
        at = np.arange(len(tied))
        opens = np.ones(len(tied), dtype=bool)
        opens[1:] = outer[1:] != outer[:-1]
        new = np.ones(len(tied), dtype=bool)
        new[1:] = pair[1:] != pair[:-1]
        begin = np.maximum.accumulate(np.where(opens, at, 0))
        place = place.copy()
        place[tied] = outer + np.maximum.accumulate(np.where(new, at, 0)) - begin
        last = np.ones(len(tied), dtype=bool)
        last[:-1] = new[1:]
        tied = tied[~(new & last)]
        width *= 2
    found = found[np.argsort(place[found], kind="stable")]
    return found, common(ids, levels, found)


def in_company(rank: np.ndarray) -> np.ndarray:
    """Positions whose class has others."""
    count = np.bincount(rank, minlength=len(rank))
    return np.flatnonzero(count[rank] > 1)


def common(ids: np.ndarray, levels: list[tuple[int, np.ndarray]], order: np.ndarray) -> np.ndarray:
    """The LCP of each suffix with the next one of the order, 0 below the first level."""
    n, (a, b) = len(ids), (order[:-1], order[1:])
    out = np.zeros(len(a), dtype=np.int64)

    def agree(values: np.ndarray) -> np.ndarray:
        x, y = a + out, b + out
        inside = (x < n) & (y < n)
        return inside & (values[np.minimum(x, n - 1)] == values[np.minimum(y, n - 1)])

    for width, rank in reversed(levels):
        # ranks of words that reach behind the text's end are equal only for one and the same place
        out += np.where(agree(rank), width, 0)
    for _ in range(levels[0][0] - 1):
        out += np.where((out >= levels[0][0]) & agree(ids), 1, 0)
    return np.append(out, 0)


def find_runs(ids: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """``start``, ``length`` and ``period`` of every run, in this order; ``ids`` number the words."""
    order, lcp = ordered(ids, -(-least // 2))
    edges = np.flatnonzero(lcp)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    names, shared = order.tolist(), lcp.tolist()
    parent = list(range(len(names)))
    classes: list[Positions | None] = [Positions(p) for p in names]
    first: dict[tuple[int, int], int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def seed(before: int, behind: int, agree: int) -> None:
        period = behind - before
        if period <= agree:
            key = behind + agree, period
            first[key] = min(first.get(key, before), before)

    for edge in edges.tolist():
        a, b, agree = root(edge), root(edge + 1), shared[edge]
        if classes[a].size < classes[b].size:
            a, b = b, a
        large, small = classes[a], list(classes[b])
        around = [large.around(p) for p in small]
        for i, p in enumerate(small):
            before, behind = around[i]
            if before is not None and (i == 0 or small[i - 1] < before):
                seed(before, p, agree)
            if behind is not None and (i + 1 == len(small) or small[i + 1] > behind):
                seed(p, behind, agree)
        for p in small:
            large.add(p)
        parent[b], classes[b] = a, None
    found = ((start, end - start, period) for (end, period), start in first.items())
    return sorted((run for run in found if run[1] >= least), key=lambda run: (run[0], run[2]))


def candidates(words: Words, least: int) -> np.ndarray:
    """Numbers of the texts in which a gram of ``least / 2`` words seems to occur twice."""
    size = -(-least // 2)
    numbers, text = hashes(words), words.text()
    gram = grams(numbers, size)
    inside = text[: len(gram)] == text[size - 1 :] if len(gram) else np.zeros(0, dtype=bool)
    text, gram = text[: len(gram)][inside], gram[inside]
    # the number of the text is mixed in, so a gram of two texts is two grams
    key = gram ^ (text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    twice = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    return np.unique(text[order[twice]])


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without the repetitions: of each run, the first period stays."""
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return b" ".join(w for w, k in zip(words, kept.tolist(), strict=True) if k)


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (start, length and period in words, in the order of start and
    period) and ``collapsed``, the words that no run repeats joined by one space, for every row."""
    if least < 2:
        raise ValueError("a run has two words at least")
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text"), TOGETHER):
                part = batch.slice(a, b - a)
                words = words_of(part.column("text"))
                own, bounds = words.split(), words.first.tolist()
                texts: list[list[bytes]] = [own[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                for i in candidates(words, least).tolist():
                    number = {w: j for j, w in enumerate(dict.fromkeys(texts[i]))}
                    runs[i] = find_runs(np.fromiter(map(number.__getitem__, texts[i]), np.int64, len(texts[i])), least)
                left = [collapsed(t, r) if r else b" ".join(t) for t, r in zip(texts, runs, strict=True)]
                said = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
                columns = [part.column("doc_id"), pa.array(words.counts(), pa.int64()), pa.array(said, RUNS), pa.array(left, pa.binary()).cast(pa.string())]
                yield pa.record_batch(columns, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(look, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def longest(runs: Column) -> Column:
    """The longest run, of equal ones that with the smallest start, then period; null without runs."""
    by_length = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(F.size(runs) > 0, F.struct((-by_length["start"]).alias("start"), by_length["length"].alias("length"), (-by_length["period"]).alias("period")))


def listing(runs: Column) -> Column:
    """``start,length,period`` and a line feed for every run."""
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    return F.array_join(lines, "")
