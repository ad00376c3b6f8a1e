"""Delivered sets and refreshed tables: readers see one whole run, whatever happens to the next."""

import json
import os
from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from airtally.plans import mapping as mp
from airtally.plans import run as rn
from airtally.sinks import reports as r
from airtally.sinks.commits import CommitConflict, Folder, read_delivered, replace_table

from .conftest import rows, ts
from .test_reports import CFG, lines, weekly_inputs  # noqa: F401  (a fixture)

DAY = date(2024, 1, 16)


def report(spark, n, shift=0, table="t"):
    return r.Report(table, spark.range(n).select((F.col("id") + shift).alias("id"), F.lit("a, b").alias("text")), ["id"], ["id", "text"])


def name(table, i):
    return f"{table}_{i:03d}.csv"


def commit(spark, folders, *reports, **arguments):
    return r.commit_reports(reports, folders, name, arguments, DAY, max_rows=4)


def test_a_run_is_seen_as_a_whole(spark, tmp_path):
    here, copy = str(tmp_path / "here"), str(tmp_path / "copy")
    first, copied = commit(spark, [here, copy], report(spark, 10), report(spark, 0, table="none"), week=3)
    assert [f["rows"] for f in first.files] == [4, 4, 2, 1] and first.number == copied.number == 1 and first.digest == copied.digest
    for root in (here, copy):
        assert rows(read_delivered(spark, root, "id long, text string", "t")) == [(i, "a, b") for i in range(10)]
        said = json.loads(open(f"{root}/_manifests/00000001.json").read())
        assert said["arguments"] == {"week": 3} and all(os.path.getsize(f["path"]) == f["bytes"] for f in said["files"])
    (again,) = commit(spark, [here], report(spark, 10).__class__("t", report(spark, 10).rows.repartition(5), ["id"], ["id", "text"]))
    assert again.number == 2 and again.digest == first.digest.split(";")[0]
    (other,) = commit(spark, [here], report(spark, 9))
    assert other.digest != again.digest and Folder(spark, here).numbers() == [1, 2, 3]
    assert rows(read_delivered(spark, here, "id long, text string", number=1, table="t")) == [(i, "a, b") for i in range(10)]


@pytest.mark.parametrize("where", ["second table", "copy", "manifest"])
def test_a_killed_run_leaves_the_last_one(spark, tmp_path, monkeypatch, where):
    here, copy = str(tmp_path / "here"), str(tmp_path / "copy")
    commit(spark, [here, copy], report(spark, 3), report(spark, 3, table="u"))

    def killed(*_, **__):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        if where == "second table":
            stage, done = r.stage_report, []
            m.setattr(r, "stage_report", lambda *a, **k: killed() if done else (done.append(1), stage(*a, **k))[1])
        elif where == "copy":
            m.setattr(Folder, "commit", killed)
        else:
            m.setattr(Folder, "rename", lambda self, source, target, overwrite, real=Folder.rename: killed() if "_manifests" in target else real(self, source, target, overwrite))
        with pytest.raises(RuntimeError, match="killed"):
            commit(spark, [here, copy], report(spark, 5, 100), report(spark, 5, 100, table="u"))
    for root in (here, copy):
        for table in ("t", "u"):
            assert rows(read_delivered(spark, root, "id long, text string", table), "id") == [(0,), (1,), (2,)]
        assert Folder(spark, root).manifest().number == 1
    assert len(Folder(spark, here).names("_runs")) == 2
    Folder(spark, here).clean()
    assert len(Folder(spark, here).names("_runs")) == 1
    # the next run goes through
    commit(spark, [here, copy], report(spark, 2), report(spark, 2, table="u"))
    assert read_delivered(spark, here, "id long, text string").count() == 4


def test_two_runs_do_not_take_one_number(spark, tmp_path):
    folder = Folder(spark, str(tmp_path))
    path = f"{folder.new_run()}/x.csv"
    folder.write_text(path, "id\n1\n")
    files = [{"table": "t", "path": path, "rows": 1}]
    folder.commit("a", files, {}, "", number=1)
    with pytest.raises(CommitConflict):
        folder.commit("b", files, {}, "", number=1)
    with pytest.raises(FileNotFoundError):
        folder.commit("c", [{"table": "t", "path": f"{path}.gone", "rows": 1}], {}, "")
    assert folder.manifest().run == "a" and folder.names("_manifests") == ["00000001.json"]


def test_empty_folder(spark, tmp_path):
    assert Folder(spark, str(tmp_path / "none")).manifest() is None
    assert read_delivered(spark, str(tmp_path / "none"), "id long").count() == 0


def test_old_runs_go(spark, tmp_path):
    root = str(tmp_path)
    for n in range(4):
        commit(spark, [root], report(spark, n + 1))
    assert len(Folder(spark, root).clean(keep=2)) == 2 and Folder(spark, root).numbers() == [3, 4]
    assert read_delivered(spark, root, "id long, text string", number=3).count() == 3
    assert read_delivered(spark, root, "id long, text string").count() == 4


def test_full_refresh_is_one_step(spark, tmp_path):
    root, table = str(tmp_path / "versions"), "refreshed_by_test"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    replace_table(spark.range(3), table, root)
    before = spark.table(table)
    seen = []

    def reader():
        seen.append(sorted(x.id for x in spark.table(table).collect()))

    # while new rows are written the old ones are read; a failure changes nothing
    reader()
    bad = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        replace_table(bad, table, root)
    reader()
    replace_table(spark.range(10, 12), table, root)
    reader()
    assert seen == [[0, 1, 2], [0, 1, 2], [10, 11]]
    assert rows(before) == [(0,), (1,), (2,)]  # a query that began before still has its files
    with pytest.raises(ValueError, match="columns"):
        replace_table(spark.range(2).select(F.col("id").cast("string")), table, root)
    replace_table(spark.range(20, 21), table, root)
    assert rows(spark.table(table)) == [(20,)] and len(os.listdir(root)) == 2
    spark.sql(f"DROP TABLE {table}")


@pytest.fixture
def inputs(spark, weekly_inputs):  # noqa: F811
    log, sessions, profiles = weekly_inputs
    mapping = lines(spark, ("US", 100, "Line, a", 0, "CPM", "2024-01-01 00:00:00", "2024-02-01 00:00:00"))
    mapping = mapping.drop("is_added_value").withColumns({"order_code": F.lit(1), "last_update_ts": F.lit(ts("2024-01-15 00:00:00")).cast("timestamp_ntz")})
    orders = spark.createDataFrame([(1, 100, 0)], "order_code int, line_item_id int, is_added_value int")
    apps = spark.createDataFrame([(7, "Stream"), (8, "Other")], "app_id int, app_name string")
    return rn.Inputs(log, sessions, mapping, orders, profiles, apps)


ARGS = replace(CFG, partner="P", receipts="Y", app_name="Stream", max_rows=1)


def test_a_report_from_arguments_to_files(spark, inputs, tmp_path):
    where = r.Destinations(*(str(tmp_path / d) for d in ("home", "abroad", "home_copy", "abroad_copy")))
    first, copy = rn.run_report(inputs, ARGS, where, "US")
    names = [os.path.basename(f["path"]) for f in first.files]
    assert names == ["p_us_weekly_campaign_2024-01-08_2024-01-14_001.csv", "p_us_weekly_campaign_2024-01-08_2024-01-14_002.csv"]
    assert first.arguments["app_name"] == "Stream" and first.arguments["as_of"] == "2024-01-16" and first.arguments["region"] == "US"
    assert copy.paths()[0].startswith(where.home_receipts) and not os.path.exists(where.international)
    text = open(first.paths()[0]).read().splitlines()
    assert text[0].split(",")[:2] == ["report_execution_date", "date_of_exposure"] and len(text) == 2
    only = rn.run_report(inputs, replace(ARGS, receipts="RO"), where, "FR")
    assert len(only) == 1 and only[0].paths()[0].startswith(where.international_receipts)


def test_a_run_that_must_not_deliver(spark, inputs, tmp_path):
    where = r.Destinations(*(str(tmp_path / d) for d in ("home", "abroad", "home_copy", "abroad_copy")))
    with pytest.raises(mp.StaleMapping):
        rn.run_report(inputs, replace(ARGS, as_of=date(2024, 1, 30)), where, "US")
    with pytest.raises(rn.UnknownApp):
        rn.run_report(inputs, replace(ARGS, app_name="Nothing"), where, "US")
    with pytest.raises(rn.UnknownApp):
        rn.run_report(replace(inputs, app_meta=None), ARGS, where, "US")
    with pytest.raises(ValueError, match="yearly"):
        rn.run_report(inputs, replace(ARGS, interval="yearly"), where, "US")
    assert not os.listdir(tmp_path)


def test_only_the_named_app_counts(spark, inputs):
    (report_,) = rn.report_tables(inputs, ARGS)
    (other,) = rn.report_tables(inputs, replace(ARGS, app_name="Other"))
    opens = lambda x: [v for (v,) in rows(x.rows, "total_exposed_app_opens")]
    assert opens(report_) != opens(other) == [None, None]


def test_monthly_run(spark, inputs, tmp_path):
    where = r.Destinations(*(str(tmp_path / d) for d in ("home", "abroad", "home_copy", "abroad_copy")))
    (done,) = rn.run_report(inputs, replace(ARGS, interval="monthly", receipts="N", max_rows=100), where, "US")
    assert sorted(f["table"] for f in done.files) == ["active_days", "day", "month"]
    assert "p_us_monthly_day_2024-01-08_2024-01-14_001.csv" in {os.path.basename(p) for p in done.paths("day")}
