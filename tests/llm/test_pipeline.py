"""The pipeline and the registered queries on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from airtally.llm import near_duplicates
from airtally.llm.queries import ORACLES
from check import TABLES, compare

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_registered_sql(spark, db, name):
    ok, text = compare(spark, db, name, SMALL)
    assert ok, text


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    (_, classify), (_, dedup), (_, mix), (_, encode) = corpus_pipeline.STAGES
    good = classify(spark, docs, SMALL).cache()
    ids = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns and len(ids & {d for d, q in labels.items() if q == 0}) <= 2 and not {d for d, q in labels.items() if q == 1} - ids
    unique = dedup(spark, good, SMALL).cache()
    assert unique.columns == docs.columns
    assert {r.doc_id for r in unique.collect()} == {r.doc_id for r in near_duplicates.near_duplicates(good).where("kept").collect()}
    mixed = mix(spark, unique, SMALL).cache()
    words = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    longest = {}
    for r in unique.collect():
        longest[r.source] = max(longest.get(r.source, 0), len((r.text or "").split()))
    assert mixed.columns == docs.columns and abs(words(mixed) - 1.5 * words(unique)) <= sum(longest.values()) / 2 + len(longest)
    assert {(r.doc_id, r.text) for r in mixed.collect()} <= {(r.doc_id, r.text) for r in unique.collect()}
    assert encode(spark, mixed, SMALL).count() == mixed.count()


def test_run_and_contract(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    names = contract.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 14))


def odd_documents(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, text, "en", "a", 5, "kept as it is"), (1, text, "en", "a", 5, "kept as it is"), (1, " ".join(f"other{i}" for i in range(50)), "en", "b", 5, None),
        (None, text, "en", "a", 5, None), (None, f"{text} more", "fr", None, None, None), (0, f"{text} end", "en", "a", 5, "smallest"),
        (2, None, None, None, None, None), (3, "", "en", "a", 0, None), (3, "few", "en", "a", 0, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, verdict string").withColumn("row", F.lit(1)).repartition(3)


def test_stages_on_odd_rows(spark):
    docs = odd_documents(spark)
    (_, classify), (_, dedup), (_, mix), (_, encode) = corpus_pipeline.STAGES
    scored = classify(spark, docs, SMALL)
    assert scored.columns == docs.columns and {r.verdict for r in scored.collect()} <= {"kept as it is", "smallest", None}
    left = sorted((str(r.doc_id), (r.text or "-").split(" ")[0], r.verdict) for r in dedup(spark, docs, SMALL).collect())
    # one row of the group of copies, and every text that is like no other one
    assert left == [("0", "word0", "smallest"), ("1", "other0", None), ("2", "-", None), ("3", "-", None), ("3", "few", None)]
    assert {r.text for r in mix(spark, docs, SMALL).collect()} <= {r.text for r in docs.collect()}
    assert encode(spark, docs, SMALL).count() == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
