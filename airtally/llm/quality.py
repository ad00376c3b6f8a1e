"""Quality classifier by co-training.

Two classifiers look at different sides of a document: one at its text, one at its metadata
(language, source, length as recorded). Both are logistic regressions, first fitted on the same
labelled rows. In each round, each of them labels all unlabelled documents about which its
calibrated probability is confident, and the other one learns from these besides the labelled
rows; what a document was first labelled stays. In the end both are calibrated on labelled rows that
no fit has used, and a third regression on the two calibrated log-odds gives the score of every
document.

Labels are a bounded sample: at most ``labelled_rows`` labelled documents, those with the smallest
hash of ``doc_id``, whose features, some 2 kB a row, are fitted on the driver. All other rows are
the unlabelled documents. Their features are written to shared storage once; each step of Newton's
method adds up their gradient and Hessian in tasks, then over groups of tasks, so the driver gets
some 0.6 MB for each group. Scoring is one pass over all documents where they are read, without a
shuffle.

Defined cases: null texts are empty, a null language or source is a value of its own, a null
length is 0; labels that repeat a ``doc_id`` count by their mean, null ones not at all; of rows that
repeat a labelled ``doc_id``, the one with the smallest digest is fitted; rows that repeat a
``doc_id`` are scored each; without labels of both kinds nothing can be told apart, so
every document gets the mean label as score, 1 if there is none, and is kept; empty tables give
empty tables; other columns are kept as they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .memory import owned, release
from .shared import discard, materialize

LABELLED_ROWS = 6_000
ROUNDS, CONFIDENT = 3, 0.97
SHAPES, WORDS, STATS, META = 96, 256, 14, 160
SEED = 11
#: Rows and bytes of text whose features are found together, besides a longer single text.
TOGETHER, TOGETHER_BYTES = 2_000, 4_000_000

_CLASSES = {"A": range(65, 91), "a": range(97, 123), "0": range(48, 58), " ": (32, *range(9, 14)), "x": range(128, 256)}


class Kinds(dict[int, str]):
    """The kind of a character, found when it is first seen."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return kind


_KINDS, _RUNS = Kinds(), re.compile(r"(.)\1{2,}", re.DOTALL)
_ASCII_KINDS = bytes(ord(_KINDS[i]) if i < 128 else i for i in range(256))


def bucket(value: str | bytes, n: int) -> int:
    return xxhash.xxh3_64_intdigest(value, seed=SEED) % n


def shape(word: str) -> str:
    """Runs of upper case, lower case, digits and others as they are: ``Ab.`` becomes ``Aa.``."""
    return _RUNS.sub(r"\1\1", word.translate(_KINDS))


def altered(words: pa.StringArray, change: Callable[[bytes], bytes]) -> pa.DictionaryArray:
    """Words whose bytes were changed one by one."""
    _, offsets, data = words.buffers()
    bounds = np.frombuffer(offsets, np.int32, len(words) + 1, words.offset * 4)
    own = change(data[bounds[0] : bounds[-1]].to_pybytes() if data is not None else b"")
    return pa.BinaryArray.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(bounds - bounds[0]), pa.py_buffer(own)]).dictionary_encode()


def codes(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' shapes and of the words; ASCII is changed for all of them at once."""
    shapes, lower = altered(words, lambda data: data.translate(_ASCII_KINDS)), altered(words, bytes.lower)
    shape_of = np.array([bucket(shape(x.decode()), SHAPES) for x in shapes.dictionary.to_pylist()], dtype=np.int64)
    digest, names = xxhash.xxh3_64_intdigest, lower.dictionary.to_pylist()
    word_of = np.array([digest(x if x.isascii() else x.decode().lower(), SEED) for x in names], dtype=np.uint64) % np.uint64(WORDS)
    return shape_of[shapes.indices.to_numpy()], word_of.astype(np.int64)[lower.indices.to_numpy()]


def text_features(text: str | None) -> np.ndarray:
    """The features of one text."""
    return all_features(pa.array([text], pa.string()))[0]


def all_features(texts: pa.StringArray) -> np.ndarray:
    """Shares of word shapes and of hashed words, and counts of kinds of characters, a row for each text; null is empty."""
    texts = texts.fill_null("")
    rows = len(texts)
    split = pc.utf8_split_whitespace(texts)
    words = split.flatten().dictionary_encode()
    text = np.repeat(np.arange(rows), np.diff(split.offsets.to_numpy()))
    # white space at an end leaves an empty word
    word = words.indices.to_numpy()
    some = (pc.binary_length(words.dictionary).to_numpy() > 0)[word]
    text, word = text[some], word[some].astype(np.int64)
    shapes, hashed = codes(words.dictionary)
    n_words = np.bincount(text, minlength=rows)
    n = np.maximum(n_words, 1)
    # texts are in order, so sorting by text and word leaves each word's text where it is
    pair = np.sort(text * max(len(words.dictionary), 1) + word)
    different = np.bincount(text[1:][pair[1:] != pair[:-1]], minlength=rows) + np.bincount(text[:1], minlength=rows)
    counts, size, lines, own_lines = np.zeros((rows, 256), dtype=np.int64), np.ones(rows), np.ones(rows), np.ones(rows)
    for row, own in enumerate(texts.cast(pa.binary()).to_pylist()):
        data = np.frombuffer(own, dtype=np.uint8)
        for start in range(0, len(data), 1 << 20):
            counts[row] += np.bincount(data[start : start + (1 << 20)], minlength=256)
        size[row] = max(len(data), 1)
        parts = own.split(b"\n")
        lines[row], own_lines[row] = len(parts), len(set(parts))
    kinds = {k: counts[:, list(own)].sum(axis=1) for k, own in _CLASSES.items()}
    marks = size - sum(kinds.values())
    stats = [
        kinds["A"] / np.maximum(kinds["A"] + kinds["a"], 1), kinds["0"] / size, kinds["x"] / size, kinds[" "] / size, marks / size, marks / n,
        counts[:, 124] / n, counts[:, 33] / n, counts[:, 10] / n, (counts[:, 44] + counts[:, 46]) / n,
        different / n, own_lines / lines, np.log1p(n_words), counts.sum(axis=1) / n / 10,
    ]

    def shares(found: np.ndarray, width: int) -> np.ndarray:
        return np.sqrt(np.bincount(text * width + found[word], minlength=rows * width).reshape(rows, width) / n[:, None])

    return np.column_stack([shares(shapes, SHAPES), shares(hashed, WORDS), *stats]).astype(np.float32)


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed language, source and both, and the order of magnitude of the length."""
    out = np.zeros(META, dtype=np.float32)
    length = float(n_chars) if n_chars is not None and n_chars > 0 else 0.0
    out[bucket(f"lang {lang}", 16)] = 1
    out[16 + bucket(f"source {source}", 64)] = 1
    out[80 + bucket(f"both {lang} {source}", 64)] = 1
    out[144 + min(int(np.log2(length + 1)), 14)] = 1
    out[159] = np.log1p(length)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Logistic:
    """Weights on standardised features, the intercept last."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float) -> Logistic:
        """Penalised maximum likelihood by Newton's method."""
        x = x.astype(np.float64)
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-6] = np.inf  # constant features say nothing
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(12):
            p = sigmoid(z @ w)
            gradient = z.T @ (p - y) + penalty * w
            step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty), gradient)
            w -= step
            if np.abs(step).max() < 1e-4:
                break
        return cls(mean, scale, w)

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Gradient and upper triangle of the Hessian of some rows, without the penalty."""
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        p = sigmoid(z @ self.weights)
        gradient = z.T @ (p - y)
        z *= np.sqrt(p * (1 - p) + 1e-6)[:, None]
        return np.concatenate([gradient, (z.T @ z)[np.triu_indices(z.shape[1])]])

    def step(self, sums: np.ndarray, ridge: float) -> float:
        """Take the step of Newton's method that follows from added sums; how far it went."""
        n = len(self.weights)
        penalty = np.full(n, ridge)
        penalty[-1] = 1e-6
        hessian = np.zeros((n, n))
        hessian[np.triu_indices(n)] = sums[n:]
        hessian += np.triu(hessian, 1).T
        step = np.linalg.solve(hessian + np.diag(penalty), sums[:n] + penalty * self.weights)
        self.weights = self.weights - step
        return float(np.abs(step).max())

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality."""
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]


@dataclass
class Model:
    """Both views, their calibrations, and the combination."""

    views: list[Logistic]
    calibrations: list[Logistic]
    combined: Logistic

    def calibrated(self, view: int, x: np.ndarray) -> np.ndarray:
        return self.calibrations[view].odds(np.clip(self.views[view].odds(x), -30, 30)[:, None])

    def score(self, xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality by text, by metadata and by both."""
        both = [self.calibrated(i, x) for i, x in enumerate(xs)]
        return sigmoid(both[0]), sigmoid(both[1]), sigmoid(self.combined.odds(np.column_stack(both)))


def taught(models: list[Model], xs: list[np.ndarray], view: int, confident: float) -> np.ndarray:
    """What the other view tells this one of unlabelled documents: the first label of which it was sure, NaN if none."""
    out = np.full(len(xs[0]), np.nan)
    for model in models:
        p = sigmoid(model.calibrated(1 - view, xs[1 - view]))
        out[np.isnan(out) & (p >= confident)] = 1.0
        out[np.isnan(out) & (1 - p >= confident)] = 0.0
    return out


#: Adds up what a function gives for blocks of the features of unlabelled documents, 0 without any.
Total = Callable[[Callable[[list[np.ndarray]], np.ndarray]], np.ndarray]


def fit_views(xs: list[np.ndarray], y: np.ndarray, total: Total, models: list[Model], confident: float, ridge: list[float]) -> list[Logistic]:
    """Both views, from labelled rows and from all unlabelled documents of which the other one was sure."""
    xs = [x.astype(np.float64) for x in xs]
    if not models:
        return [Logistic.fit(x, y, r) for x, r in zip(xs, ridge, strict=True)]

    def own(block: list[np.ndarray], view: int) -> tuple[np.ndarray, np.ndarray]:
        labels = taught(models, block, view, confident)
        sure = ~np.isnan(labels)
        return block[view][sure].astype(np.float64), labels[sure]

    def moments(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], (x - centre).sum(axis=0), ((x - centre) ** 2).sum(axis=0)])

    centres = [x.mean(axis=0) for x in xs]
    added = np.concatenate([moments(*c) for c in zip(xs, centres, strict=True)])
    added = added + total(lambda block: np.concatenate([moments(own(block, i)[0], c) for i, c in enumerate(centres)]))
    views, start = [], 0
    for centre in centres:
        n, k = added[start], len(centre)
        shift, square = added[start + 1 : start + 1 + k] / n, added[start + 1 + k : start + 1 + 2 * k] / n
        scale = np.sqrt(np.maximum(square - shift**2, 0))
        scale[scale < 1e-6] = np.inf  # constant features say nothing
        views.append(Logistic(centre + shift, scale, np.zeros(k + 1)))
        start += 1 + 2 * k
    moving = [0, 1]
    for _ in range(12):
        added = np.concatenate([views[i].sums(xs[i], y) for i in moving])
        added = added + total(lambda block, at=tuple(moving): np.concatenate([views[i].sums(*own(block, i)) for i in at]))
        parts = np.split(added, np.cumsum([len(views[i].weights) * (len(views[i].weights) + 3) // 2 for i in moving])[:-1])
        moving = [i for i, part in zip(moving, parts, strict=True) if views[i].step(part, ridge[i]) >= 1e-3]
        if not moving:
            break
    return views


def co_train(xs: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray] | Total, rounds: int = ROUNDS, confident: float = CONFIDENT) -> Model:
    """Fit both views, each on the labels and on what the other one is sure of in the pool, which is
    the features of unlabelled documents or a function that adds up over them."""
    total = pool if callable(pool) else lambda f: f(pool)
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), dtype=bool)  # too few labels to keep some back
    fold = held if held.any() else ~held
    models: list[Model] = []
    while True:
        views = fit_views([x[~held] for x in xs], y[~held], total, models, confident, [3.0, 10.0])
        calibrations = [Logistic.fit(np.clip(v.odds(x[fold]), -30, 30)[:, None], y[fold], 1.0) for v, x in zip(views, xs, strict=True)]
        both = [c.odds(np.clip(v.odds(x[fold]), -30, 30)[:, None]) for c, v, x in zip(calibrations, views, xs, strict=True)]
        models.append(Model(views, calibrations, Logistic.fit(np.column_stack(both), y[fold], 1.0)))
        if len(models) > rounds:
            return models[-1]


def inputs(docs: DataFrame, text_col: str, lang_col: str, source_col: str, chars_col: str) -> list[Column]:
    """What both views look at."""
    return [docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"), docs[source_col].cast("string").alias("source"), docs[chars_col].cast("double").alias("n_chars")]


def featured(texts: pa.StringArray, langs: pa.StringArray, sources: pa.StringArray, n_chars: pa.DoubleArray) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Ranges of rows with the features of both views."""
    owned("quality")
    for first in range(0, len(texts), TOGETHER):
        for a, b in slices(texts.slice(first, TOGETHER), TOGETHER_BYTES):
            start, n = first + a, b - a
            chars = [None if x is None or x != x else x for x in n_chars.slice(start, n).to_pylist()]
            meta = [meta_features(*x) for x in zip(langs.slice(start, n).to_pylist(), sources.slice(start, n).to_pylist(), chars, strict=True)]
            yield start, start + n, [all_features(texts.slice(start, n)), np.stack(meta)]
            del meta
    release()


def packed(rows: np.ndarray) -> pa.Array:
    """Each row as one binary value."""
    return pa.array([x.tobytes() for x in rows], pa.binary())


def matrices(text: list[bytes], meta: list[bytes]) -> list[np.ndarray]:
    widths = ((text, SHAPES + WORDS + STATS), (meta, META))
    return [np.frombuffer(b"".join(packed), dtype=np.float32).reshape(-1, width) for packed, width in widths]


def summed(features: DataFrame) -> Total:
    """Sums over all rows of ``text`` and ``meta``: in each task, then over groups of tasks, in the order of tasks."""
    groups = math.isqrt(max(1, features.rdd.getNumPartitions()))
    schema = "part int, sums binary"

    def total(f: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
        def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            owned("quality")
            out = None
            for batch in batches:
                for start in range(0, batch.num_rows, 1000):
                    sums = f(matrices(*(batch.column(c).slice(start, 1000).to_pylist() for c in ("text", "meta"))))
                    out = sums if out is None else out + sums
                del batch  # the next one is read before the name is bound again
                release()
            if out is not None:
                yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["part", "sums"])

        def of_group(rows: pd.DataFrame) -> pd.DataFrame:
            owned("quality")
            rows = rows.sort_values("part")
            out = sum(np.frombuffer(x, dtype=np.float64) for x in rows["sums"])
            return pd.DataFrame({"part": rows["part"].iloc[:1], "sums": [out.tobytes()]})

        found = features.mapInArrow(of_task, schema).groupBy(F.pmod("part", F.lit(groups))).applyInPandas(of_group, schema).collect()
        return sum((np.frombuffer(r["sums"], dtype=np.float64) for r in sorted(found, key=lambda r: r["part"])), np.float64(0))

    return total


def fit(rows: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, rounds: int = ROUNDS) -> Model | float:
    """A model for rows of ``doc_id`` and :func:`inputs`, or the mean label where there is nothing to tell apart."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, (text, meta) in featured(*(batch.column(c) for c in ("text", "lang", "source", "n_chars"))):
                same = [batch.column(c).slice(a, b - a) for c in ("doc_id", "y")]
                yield pa.record_batch([*same, packed(text), packed(meta)], ["doc_id", "y", "text", "meta"])
                del text, meta, same
            del batch

    schema = "doc_id long, y double, text binary, meta binary"
    order = F.xxhash64("doc_id", F.lit(SEED))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q"))
    known = known.where("doc_id IS NOT NULL AND q IS NOT NULL").groupBy("doc_id").agg((F.avg("q") >= 0.5).cast("double").alias("y"))
    marked = known.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(order, "doc_id").limit(labelled_rows)
    spark = rows.sparkSession
    # limited, so the broadcasts are
    marked = F.broadcast(spark.createDataFrame(marked.collect() if labelled_rows else [], "doc_id long, y double"))
    content = [c for c in rows.columns if c != "doc_id"]
    # a row for each id, whatever the order of rows
    sample = rows.join(marked, "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min(F.struct(F.xxhash64(*content).alias("digest"), *content)).alias("row"))
    sample = sample.select("doc_id", "y", *(F.col("row")[c].alias(c) for c in content)).mapInArrow(features, schema)
    found = {r["doc_id"]: r for r in sample.collect()} if labelled_rows else {}
    own = [found[k] for k in sorted(found, key=lambda k: (xxhash.xxh3_64_intdigest(str(k)), k))]
    y = np.array([r["y"] for r in own])
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 1.0
    xs = matrices([r["text"] for r in own], [r["meta"] for r in own])
    if not rounds:
        return co_train(xs, y, [x[:0] for x in xs], 0)
    others = rows.join(marked, "doc_id", "left_anti").withColumn("y", F.lit(None).cast("double"))
    others = materialize(others.mapInArrow(features, schema).select("text", "meta"), "features")
    try:
        return co_train(xs, y, summed(others), rounds)
    finally:
        discard(others)


def scores_of(model: Model | float, threshold: float):
    """Column function of text, language, source and length: scores and the decision."""

    @F.arrow_udf("text_score double, meta_score double, score double, kept boolean")
    def scores(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        if isinstance(model, float):
            found = [np.full((len(text), 3), model)]
        else:
            found = [np.column_stack(model.score(xs)) for _, _, xs in featured(text, lang, source, n_chars)]
        own = np.concatenate([np.zeros((0, 3)), *found]).T
        kept = (own[2] >= threshold) | isinstance(model, float)
        return pa.StructArray.from_arrays([*map(pa.array, own), pa.array(kept)], ["text_score", "meta_score", "score", "kept"])

    return scores


def classify(
    docs: DataFrame, labels: DataFrame, name: str = "quality", threshold: float = 0.5, id_col: str = "doc_id",
    text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars", **sizes: int,
) -> DataFrame:
    """All rows and columns of ``docs`` and a struct column ``name`` with ``text_score``, ``meta_score``,
    ``score`` and ``kept``. ``sizes`` are the bound of the labelled sample and the number of rounds."""
    seen = inputs(docs, text_col, lang_col, source_col, chars_col)
    model = fit(docs.select(docs[id_col].cast("long").alias("doc_id"), *seen), labels, **sizes)
    return docs.withColumn(name, scores_of(model, threshold)(*seen))
