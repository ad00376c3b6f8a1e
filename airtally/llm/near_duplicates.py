"""Near-duplicates of texts by MinHash, with links confirmed on full shingle sets.

1. *Signatures.* A task hashes the word shingles of a text and keeps the minima of many universal
   hashes. Bands of minima become keys. The number of bands follows from the similarity: two
   texts at the threshold fail to share a band with a probability of at most ``miss``.
2. *Classes.* Texts with the same shingle set are one class from here on.
3. *Best partners.* The smallest class of a bucket (a band's key) is its pivot. Each class is
   compared with the pivot whose signature agrees best, on full sets, and the links give first
   components. That settles most of a large group of copies with one comparison for each.
4. *Open buckets.* What is left are pairs that share a bucket but not a component. For buckets of
   a few classes they are listed; the classes of larger buckets meet in cells of a grid, a cell in
   a task, where a pair is compared in the first bucket it shares. Pairs within a component are
   never listed or compared. Every other pair that shares a bucket is, so there is no cap.
5. *Components* by alternating large-star and small-star over the confirmed links.

Before sets are compared, signatures must agree to within six standard deviations of what the
threshold makes likely.

Defined cases: a null or empty text, or one without words, has no shingles and no links; a text
with fewer words than a shingle is one shingle; rows with a null ``doc_id`` are returned with a
null component, kept, and link nothing; rows that repeat a ``doc_id`` belong to one component and
are all returned; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .memory import recall
from .shared import discard, materialize

ROWS = 5
#: Classes in a bucket up to which its pairs are listed, and in a chunk of a larger one.
LISTED, CHUNK = 8, 512
CHUNK_SHINGLES = 1_000_000
SEED = 20


def bands_for(similarity: int, miss: float, rows: int = ROWS) -> int:
    """Bands such that a pair at the threshold shares none with a probability of at most ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-((similarity / 100) ** rows)))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], dtype=np.uint64)
    different = list(set(words))
    known = dict(zip(different, recall("near-duplicates").values(different, lambda new: map(xxhash.xxh3_64_intdigest, new)), strict=True))
    own = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    out = np.zeros(len(own) - size + 1, dtype=np.uint64)
    for i in range(size):
        out = (out ^ own[i : len(own) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def class_of(shingles: np.ndarray) -> bytes | None:
    """A 128-bit name of a shingle set; none for an empty one."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of universal hashes modulo 2^32."""
    random = np.random.default_rng(SEED)
    return random.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), random.integers(0, 2**32, n, dtype=np.uint32)


def minima(shingles: np.ndarray, factors: np.ndarray, summands: np.ndarray) -> np.ndarray:
    """The least value of each hash over the set."""
    own = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(factors), np.iinfo(np.uint32).max, dtype=np.uint32)
    for start in range(0, len(own), 2048):
        part = own[start : start + 2048]
        np.minimum(out, (factors[:, None] * part + summands[:, None]).min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each band of minima."""
    out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for column in least.reshape(bands, -1).astype(np.uint64).T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def enough(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    """Whether two shingle sets are similar."""
    if 100 * min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= similarity * (len(a) + len(b) - common)


def least_agreement(n: int, similarity: int) -> int:
    """Equal minima out of ``n`` below which a pair is not similar."""
    s = similarity / 100
    return math.floor(n * s - 6 * math.sqrt(n * s * (1 - s)))


def signatures(docs: DataFrame, size: int, bands: int) -> DataFrame:
    """``doc_id``, number of shingles, class, band keys and a byte of each minimum."""
    n = bands * ROWS

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, summands = hashes(n)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                sets = [shingle_set(x.as_py(), size) for x in part.column("text")]
                least = [minima(s, factors, summands) if len(s) else None for s in sets]
                columns = [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([class_of(s) for s in sets], pa.binary()),
                    pa.array([None if x is None else band_keys(x, bands) for x in least], pa.list_(pa.int64())),
                    pa.array([None if x is None else x.astype(np.uint8).tobytes() for x in least], pa.binary()),
                ]
                yield pa.record_batch(columns, ["doc_id", "n", "cls", "bands", "sig"])

    return docs.mapInArrow(sign, "doc_id long, n long, cls binary, bands array<long>, sig binary")


def verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs ``a``, ``b`` of classes whose full sets are similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("set_a"), batch.column("set_b")
            same = [enough(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), similarity) for a, b in zip(left, right, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    one = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("set_a")), "a")
    both = one.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("set_b")), "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(compare, "a binary, b binary")


def agreeing(pairs: DataFrame, classes: DataFrame, similarity: int, n: int) -> DataFrame:
    """Add ``agreement``, the number of equal minima, to pairs where it leaves a chance."""
    least = least_agreement(n, similarity)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, n) for c in ("sig_a", "sig_b"))
            equal = (left == right).sum(axis=1)
            found = pa.record_batch([batch.column("a"), batch.column("b"), pa.array(equal.astype(np.int32))], ["a", "b", "agreement"])
            yield found.filter(pa.array(equal >= least))

    one = pairs.join(classes.select(F.col("cls").alias("a"), F.col("sig").alias("sig_a")), "a")
    both = one.join(classes.select(F.col("cls").alias("b"), F.col("sig").alias("sig_b")), "b")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(compare, "a binary, b binary, agreement int")


def cell_links(similarity: int, n: int):
    """Function for a cell: the links between its two chunks that lie in different components."""
    least = least_agreement(n, similarity)

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        sizes = np.array([len(s) for s in sets])
        sig = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(-1, n)
        bands = np.stack(rows["bands"].to_numpy())
        band = int(np.flatnonzero(bands[0] == rows["key"].iloc[0])[0])
        chunk, (i, j) = rows["chunk"].to_numpy(), rows[["i", "j"]].iloc[0]
        codes, _ = pd.factorize(rows["root"])
        parent = list(range(codes.max() + 1))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        found, names = [], rows["cls"].to_numpy()
        for u in range(len(rows)):
            roots = np.array([find(x) for x in range(len(parent))])[codes]
            ok = roots != roots[u]
            ok[: u + 1] = False
            if i != j:
                ok &= chunk != chunk[u]
            ok &= 100 * np.minimum(sizes, sizes[u]) >= similarity * np.maximum(sizes, sizes[u])
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            agreement = (sig[at] == sig[u]).sum(axis=1)
            first = (bands[at] == bands[u]).argmax(axis=1) == band
            keep = first & (agreement >= least)
            at, agreement = at[keep], agreement[keep]
            for w in at[np.argsort(-agreement, kind="stable")].tolist():
                a, b = find(codes[u]), find(codes[w])
                if a != b and enough(sets[u], sets[w], similarity):
                    parent[b] = a
                    found.append((names[u], names[w]))
        return pd.DataFrame(found, columns=["a", "b"])

    return links


def near_duplicates(docs: DataFrame, words: int = 5, similarity: int = 80, id_col: str = "doc_id", text_col: str = "text", miss: float = 1e-7) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row.

    Texts are linked whose sets of ``words``-word shingles have ``similarity`` percent in common;
    ``component_id`` is the smallest ``doc_id`` that links reach. Links are those of the full sets;
    a pair at the threshold itself is overlooked with a probability of at most ``miss``.
    """
    bands = bands_for(similarity, miss)
    n = bands * ROWS
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(signatures(rows, words, bands), "signatures")
    known = signed.where("cls IS NOT NULL AND doc_id IS NOT NULL")
    classes = known.groupBy("cls").agg(F.min("doc_id").alias("first"), F.max(F.struct("n", "bands", "sig")).alias("x")).select("cls", "first", "x.*")
    classes = materialize(classes, "classes")

    buckets = classes.select("cls", "n", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("cls").alias("members"), F.min("cls").alias("pivot")).where("members > 1")
    members = materialize(buckets.join(shared, "key").select("key", "cls", "n", "pivot", "members"), "members")
    candidates = members.select("cls").distinct()

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                sets = [shingle_set(x.as_py(), words) for x in batch.column("text").slice(start, 2000)]
                yield pa.record_batch([pa.array([class_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "shingles"])

    wanted = classes.join(candidates, "cls", "left_semi").select(F.col("first").alias("doc_id"))
    sets = rows.join(wanted, "doc_id", "left_semi").select("text").mapInArrow(full_sets, "cls binary, shingles binary")
    sets = materialize(sets.dropDuplicates(["cls"]).join(classes.select("cls", "bands", "sig"), "cls"), "sets")

    # the best of the pivots that a class shares a bucket with
    stars = members.where("cls != pivot").select(F.col("pivot").alias("a"), F.col("cls").alias("b")).distinct()
    best = agreeing(stars, classes, similarity, n).groupBy("b").agg(F.max_by("a", F.struct("agreement", "a")).alias("a"))
    links = verified(best.select("a", "b"), sets, similarity)
    # rows that repeat a doc_id with another text belong together
    spread = known.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).where("a != z")
    repeats = known.join(spread, "doc_id").select("a", F.col("cls").alias("b"))
    first = components(links.union(repeats))

    # buckets whose classes are in more than one component
    placed = members.join(first.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    several = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key")
    opened = materialize(placed.join(several, "key").select("key", "cls", "n", "root", "members"), "open")
    few = opened.where(F.col("members") <= LISTED).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("cls", "root"))).alias("own"))
    listed = (
        few.select("own", F.explode("own").alias("p"))
        .select("p", F.explode("own").alias("q"))
        .where("p.cls < q.cls AND p.root != q.root")
        .select(F.col("p.cls").alias("a"), F.col("q.cls").alias("b"))
        .distinct()
    )
    small = verified(agreeing(listed, classes, similarity, n).select("a", "b"), sets, similarity)
    # the classes of a bucket's largest component only meet the others, so they have chunks of their own
    crowded = opened.where(F.col("members") > LISTED)
    parts = crowded.groupBy("key", "root").agg(F.count("cls").alias("c"), F.sum("n").alias("s"))
    whole = parts.groupBy("key").agg(F.max(F.struct("c", "s", "root")).alias("main"), F.sum("c").alias("c"), F.sum("s").alias("s"))

    def chunks(classes: Column, shingles: Column) -> Column:
        return F.greatest(F.ceil(classes / CHUNK), F.ceil(shingles / CHUNK_SHINGLES)).cast("int")

    whole = whole.select("key", F.col("main.root").alias("main"), chunks(F.col("main.c"), F.col("main.s")).alias("own"), chunks(F.col("c") - F.col("main.c"), F.col("s") - F.col("main.s")).alias("rest"))
    is_main, deal, every = F.col("root") == F.col("main"), F.xxhash64("cls"), F.col("own") + F.col("rest") - 1
    # what a class is compared by is joined once for each bucket, before it is dealt to cells
    grid = (
        crowded.join(whole, "key")
        .join(sets, "cls")
        .withColumn("chunk", F.when(is_main, F.pmod(deal, "own")).otherwise(F.col("own") + F.pmod(deal, "rest")).cast("int"))
        .withColumn("other", F.explode(F.when(is_main, F.sequence("own", every)).otherwise(F.sequence(F.lit(0), every))))
        .select("key", "cls", "root", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "bands", "sig", "shingles")
    )
    large = grid.groupBy("key", "i", "j").applyInPandas(cell_links(similarity, n), "a binary, b binary")

    # components of components
    named = first.withColumnRenamed("node", "cls")
    more = small.union(large)
    more = more.join(named.select(F.col("cls").alias("a"), F.col("root").alias("ra")), "a", "left").join(named.select(F.col("cls").alias("b"), F.col("root").alias("rb")), "b", "left")
    second = components(more.select(F.coalesce("ra", "a").alias("u"), F.coalesce("rb", "b").alias("v")))
    roots = (
        classes.select("cls", "first")
        .join(named, "cls", "left")
        .withColumn("root", F.coalesce("root", "cls"))
        .join(second.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
        .select("cls", "first", F.coalesce("top", "root").alias("root"))
    )
    smallest = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = materialize(roots.join(smallest, "root").select("cls", "component_id"), "components")
    for table in (classes, members, sets, opened):
        discard(table)
    out = signed.select("doc_id", "n", "cls").join(of_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
