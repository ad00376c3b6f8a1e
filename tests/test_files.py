"""Reading, numbering and delivering files."""

import os
import tempfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from airtally.operators.numbering import chunk_rows, number_rows
from airtally.sinks import reports as r
from airtally.sources import files as f

from .conftest import rows


def folder(files: dict[str, str]) -> str:
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for name, text in files.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w", encoding="utf-8") as out:
            out.write(text)
    return root


HEADER = "Country,Insertion Order ID,Line Item,Line Item Start,Line Item End,Campaign,Campaign ID,Flight,Flight ID,Creative,Creative ID,Country,Line Item ID,Impressions\n"
GOOD = 'FR,11,"Line, one",2/5/2024,12/31/2024,"A | B, it\'s",21,Flight,31,Creative,41,,51,\n'
BAD = "FR,eleven,Line,2/5/2024,3/1/2024,C,21,F,31,Cr,41,,51,\n"


def test_mapping_csv(spark):
    path = folder({"map.csv": HEADER + GOOD + BAD + GOOD})
    df = f.clean_mapping(f.read_mapping_csv(spark, path, max_errors=1))
    got = df.collect()
    assert len(got) == 2 and got[0].placement_name == "Line, one" and got[0].campaign_name == "A | B, it's"
    assert str(got[0].camp_start) == "2024-02-05 00:00:00" and "delete_country" not in df.columns
    with pytest.raises(f.TooManyErrors):
        f.read_mapping_csv(spark, path, max_errors=0)


def test_lists_and_parameters(spark):
    path = folder({"ids.csv": "id\n a1 \n\na2\n"})
    assert rows(f.read_id_list(spark, path)) == [("a1",), ("a2",)]
    assert rows(f.split_param(spark, "%A%, %B b%,,")) == [("%A%",), ("%B b%",)]
    assert rows(f.split_param(spark, "3, 4", "int")) == [(3,), (4,)]
    apps = spark.createDataFrame([(1, "Ring TV"), (2, "Other"), (3, "ring tv")], "app_id int, app_name string")
    assert rows(f.app_ids(apps, "Ring TV")) == [(1,)] and rows(f.app_ids(apps, like="RING")) == [(1,), (3,)]


def test_directory_load(spark):
    path = folder({"a/x.csv": "h\n1\n", "b/y.csv": "h\n2\n", "b/z.txt": "h\n3\n"})
    assert rows(f.read_csv_dir(spark, path, "v int")) == [(1,), (2,)]


def test_timesheets(spark):
    log = "category,task,d1,total\nPlan,One,None,1\nPlan,\"Two, b\",2,2\nTotal,,2,3\n"
    path = folder(
        {
            "log/ann.csv": log,
            "log/bob.csv": "category,task,d1,total\nPlan,One,x,1,9,9\nTotal,,1,1\n",
            "staff/ann.csv": "name,department\nAnn,Sales\n",
            "staff/bob.csv": "name,department\nBob,Sales\n",
            "groups/groups.csv": "sales_cycle\nPre Sales\nPost Sales\n",
        }
    )
    table, failed = f.load_timesheets(
        spark, f"{path}/log", f"{path}/staff", f"{path}/groups", "category string, task string, d1 string, total string", "name string, department string"
    )
    assert rows(table, "name", "task", "d1", "sales_cycle") == [("Ann", "One", "0", "Pre Sales"), ("Ann", "Two  b", "2", "Post Sales")]
    assert rows(failed, "file") == [("bob.csv",)]


def test_timesheets_of_two_folders(spark):
    """Files are told apart by their path, not by their base name."""
    sheet = "category,task,d1,total\n{0},One,1,1\n{0},Two,2,2\nTotal,,3,3\n"
    path = folder(
        {
            "log/t1/ann.csv": sheet.format("Plan"), "log/t2/ann.csv": sheet.format("Call"), "log/t3/odd.csv": sheet.format("Odd"),
            "staff/t1/ann.csv": "name,department\nAnn,Sales\n", "staff/t2/ann.csv": "name,department\nAnna,Care\n",
            "staff/t4/two.csv": "name,department\nTwo,Care\n", "groups/t1/ann.csv": "sales_cycle\nPre Sales\nPost Sales\n", "groups/t2/ann.csv": "sales_cycle\nPost Sales\nOther\n",
        }
    )
    schemas = "category string, task string, d1 string, total string", "name string, department string"
    table, failed = f.load_timesheets(spark, f"{path}/log", f"{path}/staff", f"{path}/groups", *schemas, own_groups=True)
    assert rows(table, "name", "category", "task", "sales_cycle") == [
        ("Ann", "Plan", "One", "Pre Sales"), ("Ann", "Plan", "Two", "Post Sales"), ("Anna", "Call", "One", "Post Sales"), ("Anna", "Call", "Two", "Other"),
    ]
    assert rows(failed, "file", "reason") == [("t3/odd.csv", "no staff file"), ("t4/two.csv", "no log file")]
    with pytest.raises(ValueError, match="more than one file of sales cycles"):
        f.load_timesheets(spark, f"{path}/log", f"{path}/staff", f"{path}/groups", *schemas)


def test_mapping_keeps_line_breaks_and_returns_rejects(spark):
    path = folder({"m.csv": 'id,name\n1,"x\ny"\n2,z\nno number,w\n'})
    good, bad = f.read_mapping_with_rejects(spark, path, "id int, name string", max_errors=1)
    assert rows(good) == [(1, "x\ny"), (2, "z")]
    assert [r.text for r in bad.collect()] == ["no number,w"]


def test_report_files_lose_nothing(spark):
    """A session that limits the size of files, and a rerun with fewer rows."""
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    name = lambda i: f"r_{i:03d}.csv"
    df = spark.range(100).select("id", F.lit("x").alias("text"))
    args = ("id",), ("id", "text"), date(2024, 1, 15)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 20)
    try:
        written = r.write_report(df, root, name, *args, max_rows=50)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert [len(read_lines(p)) - 1 for p in written] == [50, 50]
    assert sorted(x for p in written for x in read_lines(p)[1:]) == sorted(f"{i},x" for i in range(100))
    again = r.write_report(df.where("id < 40"), root, name, *args, max_rows=50)
    assert len(again) == 1 and sorted(x for x in os.listdir(root) if not x.startswith(".")) == ["r_001.csv"]


def test_delivery_copies_finished_files(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    where = r.Destinations(f"{root}/out", f"{root}/abroad", f"{root}/copies", f"{root}/abroad_copies", receipts="Y")
    df = spark.range(5).select("id")
    written = r.deliver(df, where, "US", lambda i: f"d_{i}.csv", ("id",), ("id",), date(2024, 1, 15), max_rows=3)
    assert [p.replace("file:", "").removeprefix(root) for p in written] == ["/out/d_1.csv", "/out/d_2.csv", "/copies/d_1.csv", "/copies/d_2.csv"]
    assert read_lines(written[1]) == read_lines(written[3])


def test_numbering_is_total_and_chunked(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit("x").alias("g")).repartition(5)
    got = {x.v: x.row_num for x in number_rows(df, ("g", "v")).collect()}
    assert got == {v: v + 1 for v in range(1000)}
    sizes = {x.row_partition: x["count"] for x in chunk_rows(df, ("g", "v"), 300).groupBy("row_partition").count().collect()}
    assert sizes == {1: 300, 2: 300, 3: 300, 4: 100}


def read_lines(path):
    with open(path.replace("file:", ""), encoding="utf-8") as src:
        return src.read().splitlines()


@pytest.mark.parametrize("n, expected", [(0, [1]), (4, [4]), (5, [4, 1])])
def test_report_files(spark, n, expected):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    name = lambda i: r.report_name("P", "US", "weekly", "campaign", date(2024, 1, 8), date(2024, 1, 14), i)
    df = spark.range(n).select(
        F.lit(date(2024, 1, 15)).alias("report_execution_date"), F.concat(F.lit('say "a, b" '), F.col("id").cast("string")).alias("text"), F.lit(None).cast("int").alias("nothing"), "id"
    )
    written = r.write_report(df, root, name, ("id",), ("report_execution_date", "text", "nothing"), date(2024, 1, 15), max_rows=4)
    assert [os.path.basename(p) for p in written] == [f"p_us_weekly_campaign_2024-01-08_2024-01-14_{i:03d}.csv" for i in range(1, len(expected) + 1)]
    texts = [read_lines(p) for p in written]
    assert [len(x) - 1 for x in texts] == expected
    assert texts[0][0] == "report_execution_date,text,nothing"
    if n:
        assert texts[0][1] == '2024-01-15,"say ""a, b"" 0",'
        back = f.read_mapping_csv(spark, written[0], "report_execution_date date, text string, nothing int", 0, escape='"')
        assert rows(back.where("text like '%3'"), "text") == [('say "a, b" 3',)]
    else:
        assert texts[0][1] == "2024-01-15,,"


def test_destinations():
    to = r.Destinations("home", "abroad", "home_copy", "abroad_copy", receipts="Y")
    assert to.folders("US") == ["home", "home_copy"] and to.folders("fr") == ["abroad", "abroad_copy"]
    assert r.Destinations("h", "a", "hc", "ac", receipts="RO").folders("us") == ["hc"]
    assert r.Destinations("h", "a").folders("us") == ["h"]


def test_tables_and_copies(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    paths = r.write_tables({"t": spark.range(2)}, root, date(2024, 1, 15))
    assert rows(f.read_csv_dir(spark, paths["t"], "d date, id int"), "id") == [(0,), (1,)]
    r.copy_csv(spark, paths["t"], f"{root}/copy", ("d", "id"))
    assert rows(f.read_csv_dir(spark, f"{root}/copy", "d string, id string"), "id") == [("0",), ("1",)]
    name = f"t_{os.path.basename(root).replace('-', '_').lower()}"
    spark.range(3).write.option("path", f"{root}/table").saveAsTable(name)
    r.overwrite_table(spark.range(5, 7), name)
    assert rows(spark.table(name)) == [(5,), (6,)]
    spark.sql(f"drop table {name}")


def test_partitioned_events_are_pruned(spark):
    from datetime import datetime

    from airtally.sources.events import scan_window, write_events

    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/events"
    start = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    df = spark.range(200).select("id", F.timestamp_add("HOUR", F.col("id"), start).alias("event_ts"), F.when(F.col("id") % 2 == 0, "US").otherwise("FR").alias("country"))
    write_events(df, path, files_per_day=2)
    got = scan_window(spark.read.parquet(path), "event_ts", datetime(2024, 1, 2), datetime(2024, 1, 3, 11), ("US",), date_partition="event_date")
    assert rows(got, "id") == sorted([(i,) for i in range(24, 60, 2)], key=lambda r: str(r[0]))
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert "event_date" in filters and "country" in filters
    keyed = df.withColumn("hour", F.date_format("event_ts", "yyyyMMddHH"))
    assert scan_window(keyed, "event_ts", datetime(2024, 1, 2), datetime(2024, 1, 2, 5), hour_partition="hour").count() == 6
