"""Files of ids: the perfect hash, and keyed reading against the library."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from airtally.llm import token_files as tf
from airtally.llm.queries import QUERIES, word_bpe


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 20000])
def test_hash_is_minimal_and_perfect(n):
    rnd = np.random.default_rng(n)
    keys = np.unique(rnd.integers(0, 2**64, n, dtype=np.uint64))
    index = tf.Index.load(tf.Index.build(keys, np.ones(len(keys), dtype=np.int64)).dump())
    assert sorted(index.table.slots(keys).tolist()) == list(range(len(keys)))
    assert (index.keys[index.find(keys)] == keys).all()
    others = np.setdiff1d(rnd.integers(0, 2**64, 500, dtype=np.uint64), keys)
    assert (index.find(others) == -1).all()


def test_written_ids_are_found_by_key(spark):
    library = Tokenizer.from_file(word_bpe())
    rows = [(7, "seven of them"), (3, None), (5, ""), (None, "no key"), (None, "none either"), (9, "nine " * 50), (7, "seven again"), (-4, "minus"), (7, "seven of them")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    manifest = tf.write(docs.repartition(3), word_bpe(), end_id=2)
    keys = docs.select("doc_id").union(spark.createDataFrame([(1000,)], "doc_id long"))
    got = sorted(tf.read(spark, manifest, keys).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, -4, 3, 5, 7, 7, 7, 9]
    start, texts = 0, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == start and r.n_tokens == len(ids) and ids[-1] == 2
        start += len(ids)
        texts.setdefault(r.doc_id, []).append(ids[:-1])
    for key in {i for i, _ in rows}:
        wanted = [library.encode(t or "", add_special_tokens=False).ids for i, t in rows if i == key]
        assert sorted(texts[key]) == sorted(wanted)
    assert sorted(r.occurrence for r in got if r.doc_id == 7) == [0, 1, 2]


def test_large_ids_beside_null_and_an_id_of_many_shards(spark):
    big = 1 << 60
    rows = [(big + 1, "a b"), (None, "c"), (big + 3, "d e f"), *((5, f"text {i}") for i in range(400)), *((None, f"none {i}") for i in range(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    manifest = tf.write(docs, word_bpe(), end_id=2)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() > 1
    got = tf.read(spark, manifest, docs.select("doc_id").coalesce(1)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    for key, n in ((5, 400), (None, 61)):
        assert sorted(r.occurrence for r in got if r.doc_id == key) == list(range(n))
        own = sorted((r for r in got if r.doc_id == key), key=lambda r: r.start)
        assert [r.occurrence for r in own] == list(range(n))


def test_checksums_of_the_query(spark):
    folder = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(word_bpe())
    start, wanted = 0, []
    for r in sorted(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        wanted.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = QUERIES["op8_token_files"](spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == wanted


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    manifest = tf.write(docs, word_bpe(), end_id=2)
    assert manifest.count() == 0 and tf.read(spark, manifest, docs).count() == 0


def test_spans_stop_at_gaps_and_size():
    assert list(tf.spans(np.array([0, 5, 10, 30]), np.array([5, 5, 5, 5]), 11)) == [(0, 2), (2, 3), (3, 4)]
    assert F.lit(1) is not None
