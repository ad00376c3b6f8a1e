"""Binary files of token ids with a minimal perfect hash index.

A shard is two files. ``*.ids`` holds the ids of its documents one after the other and nothing
else, in two bytes each where the vocabulary allows it, else in four (little-endian, unsigned).
``*.index`` maps a document's key to its place among these ids: a minimal perfect hash gives the
key's slot, and the slot holds the 64-bit fingerprint of the key, its first document in the shard and
how many there are; these stand one after the other. A lookup reads one slot, whatever the size of
the shard; a fingerprint that differs means that the shard lacks the key.

Documents are in ascending order of ``doc_id`` over all shards (a range shuffle), each with an end
id behind it. A task writes files whose names carry the number of its attempt and returns their
manifest row, so files of attempts that were lost are never read.

Defined cases: a null ``doc_id`` comes before all others and can be looked up; a null text is
empty, so its document holds the end id alone; rows that repeat a ``doc_id`` are occurrences 0, 1,
2, ... of it over all shards, ordered by a hash of the text, then by text, and a lookup finds all of
them; an empty table has no shards; further columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, slices
from .memory import owned
from .shared import materialize, open_store, shared_folder

MANIFEST = "shard int, path string, docs long, ids long, width int, nulls long, first long, last long, last_docs long"
#: Bytes of ids that a reader fetches at a time, besides a longer single document.
READ_BYTES = 8_000_000


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15) * np.uint64(2 * seed + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(doc_ids: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """A 64-bit key for each id; ``doc_ids`` are any number where null."""
    with np.errstate(over="ignore"):
        own = mixed(np.where(nulls, 0, doc_ids).astype(np.int64).view(np.uint64), 0)
        return mixed(own + nulls.astype(np.uint64) * np.uint64(0xA0761D6478BD642F), 1)


@dataclass
class PerfectHash:
    """Levels of bit arrays: a key that is alone at its bit of a level owns it, the others go on
    to the next level. A key's slot is the number of bits set before its own."""

    sizes: np.ndarray
    words: np.ndarray
    before: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two documents of a shard have the same 64-bit key")
        sizes, bits, rest = [], [], keys
        while len(rest):
            size = -(-2 * len(rest) // 64) * 64
            at = (mixed(rest, len(sizes) + 2) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            rest = rest[~alone[at]]
        words = np.packbits(np.concatenate(bits), bitorder="little").view("<u8") if bits else np.zeros(0, "<u8")
        counts = np.bitwise_count(words).astype(np.int64)
        return cls(np.array(sizes, dtype=np.int64), words, np.cumsum(counts) - counts)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has its bit."""
        out = np.full(len(keys), -1, dtype=np.int64)
        rest, first = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = first + (mixed(keys[rest], level + 2) % np.uint64(size)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            own = (word >> bit) & np.uint64(1) == 1
            lower = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[rest[own]] = (self.before[at >> 6] + np.bitwise_count(lower))[own]
            rest, first = rest[~own], first + size
        return out


@dataclass
class Index:
    """The index file of a shard: for each slot its key, first document and number of documents, and
    where each document begins among the ids."""

    table: PerfectHash
    keys: np.ndarray
    rows: np.ndarray
    times: np.ndarray
    begins: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, times: np.ndarray | None = None) -> Index:
        """``keys`` in the order of documents, each of ``times`` documents (1 if not said); ``counts`` are
        the ids of every document."""
        times = np.ones(len(keys), dtype=np.int64) if times is None else times
        table = PerfectHash.build(keys)
        order = np.argsort(table.slots(keys))
        return cls(table, keys[order], (np.cumsum(times) - times)[order], times[order], np.concatenate([[0], np.cumsum(counts)]))

    def dump(self) -> bytes:
        file = io.BytesIO()
        np.savez(file, sizes=self.table.sizes, words=self.table.words, before=self.table.before, keys=self.keys, rows=self.rows, times=self.times, begins=self.begins)
        return file.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Index:
        with np.load(io.BytesIO(data)) as x:
            return cls(PerfectHash(x["sizes"], x["words"], x["before"]), x["keys"], x["rows"], x["times"], x["begins"])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key that the shard has, else -1."""
        slots = self.table.slots(keys)
        own = np.flatnonzero(slots >= 0)
        slots[own[self.keys[slots[own]] != keys[own]]] = -1
        return slots


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write all documents; returns the manifest, a row for each shard, with ``start``,
    the number of ids in all shards before it.

    The number of shards is the number of shuffle partitions, so that sets a shard's size.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "ids")

    def write_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        width = 2 if max(own.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4
        task = TaskContext.get()
        fs, root = open_store(folder)
        path = f"{root}/shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        ids_of, nulls, counts, out = [], [], [], None
        for batch in batches:
            for a, b in slices(batch.column("text")):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{path}.ids")
                found = own.encode(batch.column("text").slice(a, b - a))
                ends = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1, found.offset * 4) // 4
                ids = np.frombuffer(found.buffers()[2], "<u4")[ends[0] : ends[-1]]
                column = batch.column("doc_id").slice(a, b - a)
                ids_of.append(column.fill_null(0).to_numpy(zero_copy_only=False))
                nulls.append(column.is_null().to_numpy(zero_copy_only=False))
                counts.append(np.diff(ends).astype(np.int64) + 1)
                out.write(np.insert(ids, ends[1:] - ends[0], end_id).astype(f"<u{width}").tobytes())
                del found, ids
                pa.default_memory_pool().release_unused()
        if out is None:
            return
        out.close()
        doc_ids, null, n = np.concatenate(ids_of).astype(np.int64), np.concatenate(nulls), np.concatenate(counts)
        # rows are sorted, so those of an id stand together
        new = np.ones(len(n), dtype=bool)
        new[1:] = (doc_ids[1:] != doc_ids[:-1]) | (null[1:] != null[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(n)))
        with fs.open_output_stream(f"{path}.index") as file:
            file.write(Index.build(fingerprints(doc_ids[first], null[first]), n, times).dump())
        known = doc_ids[~null]
        row = [[task.partitionId()], [path], [len(n)], [int(n.sum())], [width], [int(null.sum())]]
        row += [[int(known[0])], [int(known[-1])], [int(times[-1])]] if len(known) else [[None], [None], [None]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, MANIFEST_TYPES, strict=True)], [c.split()[0] for c in MANIFEST.split(", ")])

    # the range shuffle samples its input, so texts are encoded behind it, not before
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by, "text").mapInArrow(write_shard, MANIFEST)
    return materialize(placed, "manifest")


MANIFEST_TYPES = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def index_of(folder_fs, path: str) -> Index:
    """The worker's copy of a shard's index; it keeps the last one."""
    held = owned("token index")
    if path not in held:
        held.clear()
        with folder_fs.open_input_stream(f"{path}.index") as file:
            held[path] = Index.load(file.read())
    return held[path]


def read(spark: SparkSession, manifest: DataFrame, keys: DataFrame, folder_uri: str = "file:///", id_col: str = "doc_id") -> DataFrame:
    """``doc_id``, ``occurrence``, ``start``, ``n_tokens`` and ``ids`` (packed unsigned 32-bit) of
    each distinct key that the shards have; ``start`` counts the ids of all documents before it.

    The driver gets the manifest, one row for each shard. Keys go to the shards whose range of
    ``doc_id`` covers them, and each is looked up there.
    """
    shards = sorted(manifest.collect(), key=lambda r: r["shard"])
    starts = dict(zip([r["shard"] for r in shards], np.cumsum([0, *(r["ids"] for r in shards)])[:-1].tolist(), strict=True))
    known = [r for r in shards if r["first"] is not None]
    firsts, lasts = np.array([r["first"] for r in known], dtype=np.int64), np.array([r["last"] for r in known], dtype=np.int64)
    numbers = np.array([r["shard"] for r in known], dtype=np.int32)
    with_null = [r["shard"] for r in shards if r["nulls"]]
    of_shard = {r["shard"]: (r["path"], r["width"]) for r in shards}
    # occurrences of a shard's first id, and of null, in the shards before it
    nulls_before = dict(zip([r["shard"] for r in shards], np.cumsum([0, *(r["nulls"] for r in shards)])[:-1].tolist(), strict=True))
    earlier: dict[int, tuple[int, int]] = {}
    for i, r in enumerate(known):
        last = known[i - 1] if i else None
        same = last is not None and last["last"] == r["first"]
        carried = earlier[last["shard"]][1] if same and last["first"] == last["last"] else 0
        earlier[r["shard"]] = (r["first"], carried + last["last_docs"] if same else 0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("doc_id")
            null = column.is_null().to_numpy(zero_copy_only=False)
            own = column.fill_null(0).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(lasts, own, "left"), np.searchsorted(firsts, own, "right")
            n = np.where(null, len(with_null), np.maximum(high - low, 0))
            row = np.repeat(np.arange(len(own)), n)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = np.where(null[row], np.array([*with_null, 0])[np.where(null[row], nth, 0)], np.append(numbers, 0)[np.where(null[row], 0, low[row] + nth)])
            yield pa.record_batch([pa.array(at.astype(np.int32)), column.take(pa.array(row))], ["shard", "doc_id"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_store(folder_uri)
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            for shard in np.unique(numbers).tolist():
                path, width = of_shard[shard]
                index = index_of(fs, path)
                column = batch.column("doc_id").filter(pa.array(numbers == shard))
                null = column.is_null().to_numpy(zero_copy_only=False)
                doc_ids = column.fill_null(0).to_numpy(zero_copy_only=False)
                slots = index.find(fingerprints(doc_ids, null))
                found = np.flatnonzero(slots >= 0)
                found = found[np.argsort(index.rows[slots[found]], kind="stable")]
                slot = slots[found]
                times = index.times[slot]
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                first, before = earlier.get(shard, (None, 0))
                base = np.where(null[found], nulls_before[shard], np.where(doc_ids[found] == first, before, 0) if first is not None else 0)
                of, row = np.repeat(found, times), np.repeat(index.rows[slot], times) + nth
                occurrence = nth + np.repeat(base, times)
                begin, count = index.begins[row], index.begins[row + 1] - index.begins[row]
                with fs.open_input_file(f"{path}.ids") as file:
                    for a, b in spans(begin, count, READ_BYTES // width):
                        low, high = int(begin[a]), int(begin[b - 1] + count[b - 1])
                        ids = np.frombuffer(file.read_at((high - low) * width, low * width), f"<u{width}").astype("<u4")
                        own = [ids[i - low : i - low + n].tobytes() for i, n in zip(begin[a:b].tolist(), count[a:b].tolist(), strict=True)]
                        columns = [column.take(pa.array(of[a:b])), pa.array(occurrence[a:b]), pa.array(begin[a:b] + starts[shard]), pa.array(count[a:b]), pa.array(own, pa.binary())]
                        yield pa.record_batch(columns, ["doc_id", "occurrence", "start", "n_tokens", "ids"])

    wanted = keys.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    placed = wanted.mapInArrow(place, "shard int, doc_id long")
    return placed.repartitionByRange(max(1, len(shards)), "shard").sortWithinPartitions("shard").mapInArrow(look_up, "doc_id long, occurrence long, start long, n_tokens long, ids binary")


def spans(begin: np.ndarray, count: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring documents, cut at gaps and after about ``most`` ids."""
    a, size = 0, 0
    for i in range(len(begin)):
        gap = i > a and begin[i] != begin[i - 1] + count[i - 1]
        if i > a and (gap or size + count[i] > most):
            yield a, i
            a, size = i, 0
        size += int(count[i])
    if a < len(begin):
        yield a, len(begin)
