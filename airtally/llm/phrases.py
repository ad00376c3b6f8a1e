"""Substring deduplication with automata of repeated phrases.

A window is ``window`` consecutive words of one document. Words are removed that a window covers
whose sequence of words also starts in a document with a smaller id.

1. *Copies.* Rows with the same id and text are one document from here on, and of documents with the
   same sequence of words, the one with the smallest id goes on. The others lose every word that a
   window covers, and have no window that the first one lacks. Texts are shuffled once, into buckets
   that all later joins use.
2. *Recurring seeds.* The seed of a window is its gram of five words with the least hash, so equal
   windows have equal seeds, and neighbouring windows mostly share one. Seeds are reduced to the
   smallest and largest document in each task before they are shuffled; those of one document drop out.
3. *Stretches.* A stretch is the text below consecutive windows that share a recurring seed. It goes
   to the shard that owns the seed. Of a seed with more than ``heavy`` occurrences, only the different
   stretches go there, each with its smallest and largest document, and what is found returns to the
   documents by the stretch's text.
4. *Automata.* A shard confirms its recurring windows on the words themselves and compiles them into
   an Aho-Corasick automaton, with the smallest document of each. Every stretch that was sent to the
   shard streams through it, which locates every occurrence of every window.
5. *Crowded seeds.* More than ``cell`` different stretches of one seed would overload a shard. Their
   windows are reduced to one row for each sequence of words, and recurring ones are joined back.
6. *Removal.* The places found go back to their documents.

Hashes only decide what is compared: equal windows always meet, and what meets is compared in full.
A shard holds some ``cell`` stretches, and at most ``heavy`` or ``cell`` more of its last seed.

Defined cases: a null or empty text has no words; fewer words than a window are all kept; rows with a
null id keep all words and take none from others; rows that repeat an id are documents of one id, so
neither takes words from the other; a table may be empty; further columns are ignored,
whatever their names; a very long text is one row in a task and otherwise in stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .shared import discard, materialize, materialize_buckets
from .words import Words, grams, hashes, words_of

WINDOW, GRAM = 13, 5
HEAVY, CELL = 8_192, 16_384
#: Bytes of text whose words are looked at together, besides a longer single text.
TOGETHER = 1_000_000
#: Code points that stand for words in an automaton: all but those of no character.
FIRST_CODE, NO_CODES = 0x100, range(0xD800, 0xE000)


def seeds(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each gram; the first words of all windows; the first word of the seed of each."""
    size = min(GRAM, window)
    gram = grams(hashes(words), size)
    text = words.text()
    starts = np.flatnonzero(text[: len(text) - window + 1] == text[window - 1 :]) if len(text) >= window else np.zeros(0, dtype=np.int64)
    least, at = gram[starts], starts.copy()
    for i in range(1, window - size + 1):
        other = gram[starts + i]
        less = other < least
        least[less] = other[less]
        at[less] = starts[less] + i
    return gram, starts, at


def distinct(at: np.ndarray) -> np.ndarray:
    """Ascending places without repeats."""
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def seed_ranges(firsts: DataFrame, window: int) -> DataFrame:
    """``seed``, smallest and largest document, number of occurrences, of each slice of texts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column("doc_id").to_numpy()
            for a, b in slices(batch.column("text"), TOGETHER):
                words = words_of(batch.column("text").slice(a, b - a))
                gram, _, at = seeds(words, window)
                at = distinct(at)
                if not len(at):
                    continue
                seed, doc = gram[at], doc_ids[a + words.text()[at]]
                order = np.argsort(seed)
                seed, doc = seed[order], doc[order]
                new = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
                columns = [signed(seed[new]), pa.array(np.minimum.reduceat(doc, new)), pa.array(np.maximum.reduceat(doc, new)), pa.array(np.diff(np.append(new, len(seed))))]
                yield pa.record_batch(columns, ["seed", "low", "high", "n"])

    found = firsts.select("doc_id", "text").mapInArrow(find, "seed long, low long, high long, n long")
    return found.groupBy("seed").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))


def seed_places(firsts: DataFrame, window: int) -> DataFrame:
    """``seed``, ``doc_id`` and ``key``, and the number ``at`` of the seed's first word."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, keys = batch.column("doc_id").to_numpy(), batch.column("key").to_numpy()
            for a, b in slices(batch.column("text"), TOGETHER):
                words = words_of(batch.column("text").slice(a, b - a))
                gram, _, at = seeds(words, window)
                at = distinct(at)
                text = words.text()[at]
                yield pa.record_batch([signed(gram[at]), pa.array(doc_ids[a + text]), pa.array(keys[a + text]), pa.array((at - words.first[text]).astype(np.int32))], ["seed", "doc_id", "key", "at"])

    return firsts.select("doc_id", "key", "text").mapInArrow(find, "seed long, doc_id long, key long, at int")


def stretches(found: DataFrame, window: int) -> DataFrame:
    """``seed``, ``heavy``, ``doc_id``, ``key`` and ``text`` of every different stretch of a document, with
    ``places``, the numbers of its first words.

    ``found`` has documents with ``hits``: places of recurring seeds, -1 - place of heavy ones.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, keys = batch.column("doc_id").to_numpy(), batch.column("key").to_numpy()
            for a, b in slices(batch.column("text"), TOGETHER):
                part = batch.slice(a, b - a)
                words = words_of(part.column("text"))
                gram, starts, at = seeds(words, window)
                hits = part.column("hits")
                place = hits.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                of = np.repeat(np.arange(b - a), hits.value_lengths().to_numpy(zero_copy_only=False))
                kind = np.zeros(len(words.starts) + 1, dtype=np.int8)
                kind[words.first[of] + np.where(place < 0, -1 - place, place)] = np.where(place < 0, 2, 1)
                # a stretch opens where the seed is another one
                opens = np.ones(len(at), dtype=bool)
                opens[1:] = at[1:] != at[:-1]
                opens = np.flatnonzero(opens)
                last = starts[np.append(opens[1:], len(at)) - 1] + window - 1 if len(at) else opens
                wanted = kind[at[opens]] > 0
                opens, last = opens[wanted], last[wanted]
                first, seed = starts[opens], gram[at[opens]].view(np.int64)
                text, data = words.text()[first], words.data.tobytes()
                places: dict[tuple[int, bytes], list[int]] = {}
                index = []
                for i, (t, p, x, y) in enumerate(zip(text.tolist(), (first - words.first[text]).tolist(), words.starts[first].tolist(), words.ends[last].tolist(), strict=True)):
                    own = places.setdefault((t, data[x:y]), [])
                    if not own:
                        index.append(i)
                    own.append(p)
                columns = [
                    pa.array(seed[index]), pa.array(kind[at[opens[index]]] == 2), pa.array(doc_ids[a + text[index]]), pa.array(keys[a + text[index]]),
                    pa.array([t for _, t in places], pa.binary()), pa.array(places.values(), pa.list_(pa.int32())),
                ]
                yield pa.record_batch(columns, ["seed", "heavy", "doc_id", "key", "text", "places"])

    return found.select("doc_id", "key", "text", "hits").mapInArrow(cut, "seed long, heavy boolean, doc_id long, key long, text binary, places array<int>")


class Codes(dict[bytes, str]):
    """A character for each word, found when it is first seen."""

    def __missing__(self, word: bytes) -> str:
        at = FIRST_CODE + len(self)
        self[word] = code = chr(at if at < NO_CODES.start else at + len(NO_CODES))
        return code


def spelled(texts: list[bytes]) -> list[str]:
    """Each text as a string with one character for each word, the same one for the same word."""
    code = Codes()
    return ["".join(map(code.__getitem__, text.split())) for text in texts]


def spread_out(windows: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """Numbers as lists of so many each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(windows))


def located(window: int):
    """Function for a shard: the windows of its stretches that a smaller document than ``high`` has."""

    def locate(rows: pa.Table) -> pa.Table:
        import ahocorasick

        own = spelled(rows["text"].to_pylist())
        low, high = rows["low"].to_numpy(), rows["high"].to_numpy()
        ranges: dict[str, tuple[int, int]] = {}
        for text, a, b in zip(own, low.tolist(), high.tolist(), strict=True):
            both = (a, b)
            for i in range(len(text) - window + 1):
                phrase = text[i : i + window]
                seen = ranges.setdefault(phrase, both)
                if seen is both:
                    continue
                if a < seen[0] or b > seen[1]:
                    ranges[phrase] = (min(a, seen[0]), max(b, seen[1]))
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for phrase, (a, b) in ranges.items():
            if a < b:
                automaton.add_word(phrase, a)
        if len(automaton):
            automaton.make_automaton()
        # all stretches stream through as one, with a character between them that no phrase has
        size = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) + 1
        begin = np.cumsum(size) - size
        pairs = list(automaton.iter("\0".join(own))) if len(automaton) else []
        found = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        of = np.searchsorted(begin, found[:, 0], "right") - 1
        taken = found[:, 1] < high[of]
        of, found = of[taken], found[taken]
        counts = np.bincount(of, minlength=len(own))
        offset = (found[:, 0] - begin[of] - window + 1).astype(np.int32)
        some = pa.array(counts > 0)
        out = rows.drop_columns(["low", "high", "shard"])
        out = out.append_column("offsets", spread_out(offset, counts)).append_column("firsts", spread_out(found[:, 1], counts))
        return out.filter(some)

    return locate


def each_window(rows: DataFrame, window: int) -> DataFrame:
    """``text``, ``low`` and ``high`` of stretches with the ``phrase`` and ``offset`` of each window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = text.split()
                n = len(words) - window + 1
                phrases = [b" ".join(words[k : k + window]) for k in range(n)]
                columns = [batch.column(c).slice(i, 1).take(pa.array(np.zeros(n, dtype=np.int64))) for c in ("text", "low", "high")]
                yield pa.record_batch([*columns, pa.array(phrases, pa.binary()), pa.array(range(n), pa.int32())], ["text", "low", "high", "phrase", "offset"])

    return rows.select("text", "low", "high").mapInArrow(cut, "text binary, low long, high long, phrase binary, offset int")


def digested(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``key``, number of words and digest of the words in their order."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text"), TOGETHER):
                part = batch.slice(a, b - a)
                own = [t.split() for t in part.column("text").cast(pa.binary()).to_pylist()]
                columns = [part.column("doc_id"), part.column("key"), pa.array(list(map(len, own)), pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).digest() for w in own], pa.binary())]
                yield pa.record_batch(columns, ["doc_id", "key", "n", "digest"])

    return rows.select("doc_id", "key", "text").mapInArrow(look, "doc_id long, key long, n long, digest binary")


def without(rows: DataFrame, window: int) -> DataFrame:
    """Apply ``copy`` and ``starts`` to every text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text"), TOGETHER):
                part = batch.slice(a, b - a)
                n, removed, kept = [], [], []
                for text, copy, starts in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("copy").to_pylist(), part.column("starts"), strict=True):
                    words = text.split()
                    n.append(len(words))
                    if copy:
                        words = []
                    elif starts.is_valid:
                        at, size = starts.values.to_numpy(), len(words) + 1
                        covered = np.cumsum(np.bincount(at, minlength=size) - np.bincount(at + window, minlength=size))[:-1]
                        words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                    removed.append(n[-1] - len(words))
                    kept.append(b" ".join(words))
                columns = [part.column("doc_id"), part.column("times"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.record_batch(columns, ["doc_id", "times", "n_words", "n_removed", "kept"])

    out = rows.select("doc_id", "times", "text", "copy", "starts").mapInArrow(cut, "doc_id long, times long, n_words long, n_removed long, kept string")
    # rows that repeat come out as often as they went in
    return out.withColumn("nth", F.explode(F.expr("sequence(1, times)"))).select("doc_id", "n_words", "n_removed", "kept")


def remove_repeated(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY, cell: int = CELL) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (the words that stay, joined by one space) of
    every row; see the module for what is removed."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    same = ["doc_id", "key"]
    known = materialize(digested(rows.where("doc_id IS NOT NULL")).where(F.col("n") >= window).distinct(), "digests")
    kinds = known.join(known.groupBy("digest").agg(F.min("doc_id").alias("first")), "digest")
    kinds = kinds.select(*same, (F.col("doc_id") == F.col("first")).alias("is_first"))
    whole = rows.groupBy(*same).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
    whole = materialize_buckets(whole.join(kinds, same, "left"), "texts", *same)
    firsts = whole.where("is_first")

    recurring = seed_ranges(firsts, window).where("low < high").select("seed", (F.col("n") > heavy).alias("heavy"))
    hits = seed_places(firsts, window).join(recurring, "seed")
    hits = hits.groupBy(*same).agg(F.collect_list(F.when(F.col("heavy"), -1 - F.col("at")).otherwise(F.col("at"))).alias("hits"))
    cuts = materialize(stretches(firsts.join(hits, same), window), "stretches")

    def found_in_shards(rows: DataFrame, n: int, columns: str) -> DataFrame:
        shard = F.pmod(F.xxhash64("seed"), F.lit(max(1, -(-n // cell)))).cast("int")
        return rows.withColumn("shard", shard).groupBy("shard").applyInArrow(located(window), f"{columns}, offsets array<int>, firsts array<long>")

    light = cuts.where("NOT heavy").select("seed", "text", *same, "places", F.col("doc_id").alias("low"), F.col("doc_id").alias("high"))
    of_light = found_in_shards(light, light.count(), "seed long, text binary, doc_id long, key long, places array<int>").select(*same, "places", "offsets")

    # the different stretches of heavy seeds
    of_heavy = cuts.where("heavy")
    different = materialize(of_heavy.groupBy("seed", "text").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "different")
    crowds = different.groupBy("seed").agg((F.count(F.lit(1)) > cell).alias("crowded"))
    dealt = different.join(crowds, "seed")
    shared = found_in_shards(dealt.where("NOT crowded").drop("crowded"), different.count(), "seed long, text binary").select("text", "offsets", "firsts")
    windows = each_window(dealt.where("crowded"), window)
    phrases = windows.groupBy("phrase").agg(F.min("low").alias("first"), F.max("high").alias("top")).where("first < top")
    alone = windows.join(phrases, "phrase").where("first < high").groupBy("text").agg(F.collect_list(F.struct("offset", "first")).alias("own"))
    alone = alone.select("text", F.col("own.offset").alias("offsets"), F.col("own.first").alias("firsts"))
    earlier = F.filter(F.arrays_zip("offsets", "firsts"), lambda x: x["firsts"] < F.col("doc_id"))
    back = of_heavy.join(shared.unionByName(alone), "text").select(*same, "places", earlier["offsets"].alias("offsets"))

    every = F.flatten(F.transform("places", lambda p: F.transform("offsets", lambda o: p + o)))
    covered = of_light.unionByName(back).where(F.size("offsets") > 0).groupBy(*same).agg(F.flatten(F.collect_list(every)).alias("starts"))
    covered = materialize(covered, "covered")
    for table in (known, cuts, different):
        discard(table)
    marked = whole.join(covered, same, "left").withColumn("copy", F.coalesce(~F.col("is_first"), F.lit(False)))
    return without(marked, window)
