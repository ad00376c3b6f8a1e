"""CSV readers and parameter tables. Every schema is declared; nothing is inferred."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rows import keep

CORRUPT = "_corrupt_record"

# Column layouts of the exported files.
MAPPING_SCHEMA = (
    "country string, order_code int, placement_name string, camp_start string, camp_end string, "
    "campaign_name string, campaign_id int, flight_name string, flight_id int, creative_name string, "
    "creative_id int, delete_country string, placement_id int, delete_impressions int"
)
TIMESHEET_LABELS = (
    "name", "role", "region", "vts", "vertical", "team", "sales_group", "select_department", "category", "task",
)


class TooManyErrors(ValueError):
    """More unreadable rows than the error budget allows."""


def _struct(schema) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_mapping_csv(
    spark: SparkSession, path, schema=MAPPING_SCHEMA, max_errors: int = 250, escape: str = "\\", multi_line: bool = True
) -> DataFrame:
    """Quoted CSV with a header. Unreadable rows are dropped up to ``max_errors``; more
    of them fail the load. :func:`read_mapping_with_rejects` returns them as well.

    ``multi_line`` lets quoted cells hold line breaks; a file is then read by one task,
    so turn it off for files that are large and have none."""
    good, _ = read_mapping_with_rejects(spark, path, schema, max_errors, escape, multi_line)
    return good


def read_mapping_with_rejects(
    spark: SparkSession, path, schema=MAPPING_SCHEMA, max_errors: int = 250, escape: str = "\\", multi_line: bool = True
) -> tuple[DataFrame, DataFrame]:
    """The readable rows, and the text of the others with the path of their file."""
    declared = _struct(schema)
    full = T.StructType([*declared.fields, T.StructField(CORRUPT, T.StringType())])
    df = (
        spark.read.schema(full)
        .options(header=True, quote='"', escape=escape, multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, enforceSchema=True)
        .csv(path)
        .withColumn("_path", F.col("_metadata.file_path"))
    )
    # Spark converts only the columns a query asks for; held as a whole, a row is
    # unreadable whichever columns are read later
    df = keep(df)
    bad = df.where(F.col(CORRUPT).isNotNull()).select(F.col("_path").alias("path"), F.col(CORRUPT).alias("text"))
    found = bad.count()
    if found > max_errors:
        raise TooManyErrors(f"{found} unreadable rows, {max_errors} allowed")
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "_path"), bad


def read_id_list(spark: SparkSession, path, name: str = "profile_id", dtype: str = "string", header: bool = True) -> DataFrame:
    """First-party list: one id per line, blanks removed."""
    raw = spark.read.schema(f"{name} string").options(header=header, quote='"', enforceSchema=True).csv(path)
    return raw.select(F.trim(name).alias(name)).where(F.col(name) != "").select(F.col(name).cast(dtype))


def read_csv_dir(spark: SparkSession, path, schema, pattern: str = "*.csv") -> DataFrame:
    """All matching files below a folder."""
    return (
        spark.read.schema(_struct(schema))
        .options(header=True, quote='"', escape="\\", pathGlobFilter=pattern, recursiveFileLookup=True, enforceSchema=True)
        .csv(path)
    )


def clean_mapping(df: DataFrame, date_columns: Sequence[str] = ("camp_start", "camp_end"), pattern: str = "M/d/yyyy") -> DataFrame:
    """Dates typed, ``delete_*`` columns removed."""
    for c in date_columns:
        df = df.withColumn(c, F.to_timestamp_ntz(F.col(c), F.lit(pattern)))
    return df.drop(*[c for c in df.columns if c.startswith("delete_")])


def split_param(spark: SparkSession, text: str, dtype: str = "string", name: str = "value") -> DataFrame:
    """Comma list to a table. Every item is trimmed; empty items are dropped."""
    one = spark.range(1).select(F.explode(F.split(F.lit(text), ",")).alias(name))
    return one.select(F.trim(name).alias(name)).where(F.col(name) != "").select(F.col(name).cast(dtype)).distinct()


def app_ids(meta: DataFrame, name: str | None = None, like: str | None = None) -> DataFrame:
    """Ids of the apps with an exact name, or whose name contains a text in any case."""
    kept = meta.where(F.col("app_name") == name) if name is not None else meta.where(F.lower("app_name").contains(like.lower()))
    return kept.select("app_id").distinct()


def load_timesheets(
    spark: SparkSession, log_path, staff_path, groups_path, log_schema, staff_schema, pattern: str = "*.csv", own_groups: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Timesheet exports of many people as one table, and the files that failed.

    Log and staff files of a person have the same path below their folders. Commas inside
    cells become blanks, ``None`` becomes ``0``, the sales cycle is attached by row
    position, and the trailing total row of each file is dropped. A file is left out
    whole and listed in the second frame with the reason if it has an unreadable row, no
    partner on the other side, or not exactly one staff row.

    The list of sales cycles is that of the one file in ``groups_path``, or with
    ``own_groups`` the one with the path of the person's file.
    """

    def read(path, schema):
        declared = T.StructType([*_struct(schema).fields, T.StructField(CORRUPT, T.StringType())])
        raw = (
            spark.read.schema(declared)
            .options(header=True, quote='"', escape="\\", pathGlobFilter=pattern, recursiveFileLookup=True,
                     mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
            .csv(path)
        )
        inside = F.regexp_replace(F.col("_metadata.file_path"), "^[a-z0-9]*:?/*", "/")
        root = F.lit("/" + re.sub("^[a-z0-9]*:?/*", "", str(path)).rstrip("/") + "/")
        file = F.when(F.startswith(inside, root), F.substring(inside, F.length(root) + 1, F.length(inside))).otherwise(F.col("_metadata.file_name"))
        raw = keep(raw.select("*", file.alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_seq")))
        cells = [F.col(c) for c in _struct(schema).fieldNames()]
        tidy = [F.when(c == "None", "0").otherwise(F.regexp_replace(c, ",", " ")).alias(n) for c, n in zip(cells, _struct(schema).fieldNames())]
        return raw.select(*tidy, CORRUPT, "file", "_at", "_seq")

    logs, staff, groups = read(log_path, log_schema), read(staff_path, staff_schema), read(groups_path, "sales_cycle string")
    if not own_groups and groups.select("file").distinct().limit(2).count() > 1:
        raise ValueError("more than one file of sales cycles; own_groups attaches each to the file of its name")
    per_file = lambda df: df.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.count(CORRUPT).alias("bad"))
    both = per_file(logs).withColumnsRenamed({"rows": "log_rows", "bad": "log_bad"}).join(per_file(staff), "file", "full")
    bad = F.coalesce("log_bad", F.lit(0)) + F.coalesce("bad", F.lit(0))
    reason = (
        F.when(bad > 0, "unreadable rows")
        .when(F.col("log_rows").isNull(), "no log file")
        .when(F.col("rows").isNull(), "no staff file")
        .when(F.col("rows") != 1, "more than one staff row")
    )
    failures = both.select("file", bad.alias("bad_rows"), reason.alias("reason")).where(F.col("reason").isNotNull())
    # a file is one person's sheet, so its rows are few
    position = F.row_number().over(W.partitionBy("file").orderBy("_at", "_seq"))
    length = F.count(F.lit(1)).over(W.partitionBy("file"))
    placed = logs.withColumn("_pos", position).withColumn("_len", length).where(F.col("_pos") < F.col("_len"))
    cycles = groups.select("file", position.alias("_pos"), "sales_cycle")
    good = placed.join(failures, "file", "left_anti")
    joined = good.join(cycles, ["file", "_pos"], "left") if own_groups else good.join(cycles.drop("file"), "_pos", "left")
    joined = joined.join(staff.drop(CORRUPT, "_at", "_seq"), "file")
    return joined.drop("_pos", "_len", "_at", "_seq", CORRUPT), failures
