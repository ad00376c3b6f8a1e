"""The classifier: held-out accuracy, and what it does without labels."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from airtally.llm import memory, quality

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    shown = labels.where("pmod(xxhash64(doc_id), 3) > 0")
    got = {r.doc_id: r.quality for r in quality.classify(docs, shown).collect()}
    held = [(r.quality, got[r.doc_id].kept) for r in labels.where("pmod(xxhash64(doc_id), 3) = 0").collect()]
    assert len(got) == docs.count() and np.mean([bool(y) == k for y, k in held]) > 0.95
    good = [k for y, k in held if y]
    assert np.mean(good) > 0.98


def test_shapes_cover_the_whole_word():
    assert quality.shape("Abcd.") == "Aaa." and quality.shape("ABC--12345") == "AA--00"
    assert quality.shape("x" * 100 + "9" * 50 + "Y") == "aa00A"
    assert quality.shape("a1" * 300) == "a0" * 300
    assert (quality.text_features("q" * 64 + "!!!") != quality.text_features("q" * 67)).any()


def test_views_teach_each_other():
    """Few labels, two informative views: the pool helps."""
    rnd = np.random.default_rng(1)
    y = rnd.integers(0, 2, 3000).astype(float)
    views = [y[:, None] * 2.2 + rnd.normal(size=(3000, 1)) + rnd.normal(size=(3000, 6)) * [[0, 1, 1, 1, 1, 1]] for _ in range(2)]
    model = quality.co_train([v[:200] for v in views], y[:200], [v[200:1500] for v in views])
    scored = model.score([v[1500:] for v in views])
    accuracy = [((s >= 0.5) == y[1500:]).mean() for s in scored]
    assert accuracy[2] > 0.9 and accuracy[2] >= max(accuracy[:2]) - 0.01


def test_all_unlabelled_documents_teach(monkeypatch, spark):
    """Each round adds up over every row that is not in the labelled sample, null ids too."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet").limit(60)
    docs = docs.union(docs.where("doc_id % 7 = 0").withColumn("doc_id", F.lit(None).cast("long"))).union(docs.withColumn("doc_id", F.col("doc_id") + 10**9)).union(docs.withColumn("doc_id", F.col("doc_id") + 10**10))
    docs = docs.union(docs.where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id") + 10**11))
    seen = []

    def co_train(xs, y, pool, *rest):
        seen.append((len(y), int(pool(lambda block: np.array([float(len(block[0]))]))[0])))
        return quality_co_train(xs, y, pool, *rest)

    quality_co_train = quality.co_train
    monkeypatch.setattr(quality, "co_train", co_train)
    assert quality.classify(docs, labels).count() == docs.count()
    [(labelled, pool)] = seen
    assert labelled + pool == docs.count() and pool > 4000


def test_rows_of_one_id_are_one_sample_row(monkeypatch, spark):
    """Which text of a repeated id is fitted does not depend on the order of rows."""
    rows = [(i % 40, ("Good words here. " if i % 2 else "BAD!!! 0x0 ") * (1 + i // 40) + str(i), "en", "s", i) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    co_train = quality.co_train
    monkeypatch.setattr(quality, "co_train", lambda xs, *rest: seen.append(xs) or co_train(xs, *rest))
    for ordered in (rows, rows[::-1]):
        quality.classify(spark.createDataFrame(ordered, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1), labels, rounds=0)
    assert [len(x) for x in seen[0]] == [40, 40] and all((a == b).all() for a, b in zip(*seen, strict=True))


def test_sums_over_blocks_fit_like_one_block():
    """What is added up block by block gives the weights of a fit on all sure documents at once."""
    rnd = np.random.default_rng(3)
    y = rnd.integers(0, 2, 4000).astype(float)
    views = [y[:, None] * 3 + rnd.normal(size=(4000, 4)) * [[1, 1, 0.5, 0]] for _ in range(2)]
    pool = [v[300:] for v in views]
    total = lambda f: sum(f([p[a : a + 500] for p in pool]) for a in range(0, 3700, 500))
    labelled = [v[:300] for v in views]
    first = quality.co_train(labelled, y[:300], total, 0)
    got = quality.co_train(labelled, y[:300], total, 1)
    fitted = np.arange(300) % 4 != 3
    for i in (0, 1):
        given = quality.taught([first], pool, i, quality.CONFIDENT)
        sure = ~np.isnan(given)
        assert sure.sum() > 800
        wanted = quality.Logistic.fit(np.concatenate([labelled[i][fitted], pool[i][sure]]), np.concatenate([y[:300][fitted], given[sure]]), [3.0, 10.0][i])
        assert np.allclose(got.views[i].odds(pool[i]), wanted.odds(pool[i]), atol=1e-3)


def test_odd_rows_and_no_labels(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "word " * 30000, "en", None, -5), (3, "fine words here.", "xx", "t", 10**12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("mine"))
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == 5 and all(r.quality.kept and r.quality.score == 1 and r.kept == "mine" for r in out)
    one_kind = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, quality int")
    assert all(r.quality.kept and r.quality.score == 0 for r in quality.classify(docs, one_kind).collect())
    both = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, quality int")
    assert len(quality.classify(docs, both).collect()) == 5
    assert quality.classify(docs.limit(0), both).count() == 0


def test_features_of_many_texts_are_found_together(monkeypatch):
    """Words that texts share are hashed once for all of them, and each text's features are its own."""
    texts = [None, "", "One two.\nOne two.", "  TWO two One\x1fb\x85", "ΣΑΣ 1234 a|b!", "One two. " * 50]
    alone = [quality.text_features(t) for t in texts]
    counted, digest = [], quality.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(quality.xxhash, "xxh3_64_intdigest", lambda *x, **y: counted.append(x[0]) or digest(*x, **y))
    assert (quality.all_features(pa.array(texts * 20)) == np.stack(alone * 20)).all()
    assert len(counted) < 30


def test_features_are_not_found_beside_the_tables_of_another_operator():
    memory.owned("tokenizers")["x"] = 1
    texts = pa.array(["Some words here.", None])
    assert [(a, b) for a, b, _ in quality.featured(texts, texts, texts, pa.array([1.0, None]))] == [(0, 2)]
    assert not memory.owned("tokenizers")


def test_sums_over_tasks_are_not_added_beside_the_tables_of_another_operator(spark):
    """Every worker holds a table first; no block is summed beside it, and every row is."""
    n = quality.SHAPES + quality.WORDS + quality.STATS
    rows = [(np.full(n, i, np.float32).tobytes(), np.full(quality.META, i, np.float32).tobytes()) for i in range(8)]
    features = spark.createDataFrame(rows, "text binary, meta binary").repartition(2).localCheckpoint()

    def hold(batches):
        memory.owned("tokenizers")["x"] = 1
        yield from batches

    features.mapInArrow(hold, features.schema).collect()
    got = quality.summed(features)(lambda xs: np.array([len(xs[0]), xs[0].sum(dtype=np.float64), xs[1].sum(dtype=np.float64), "tokenizers" in memory._OWNED], dtype=np.float64))
    assert got.tolist() == [8, 28 * n, 28 * quality.META, 0]
