"""Delivery of finished reports as CSV files and tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import chunk_rows
from ..operators.rows import ensure_one_row
from .commits import Folder, Manifest, replace_table

# Text formats of delivered files.
CSV_FORMAT = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "nullValue": "",
    "emptyValue": "",
    "dateFormat": "yyyy-MM-dd",
    "timestampFormat": "yyyy-MM-dd HH:mm:ss",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss",
}


def report_name(partner: str, region: str, interval: str, table: str, start: date, end: date, sequence: int | None = None) -> str:
    """``partner_region_interval_table_start_end[_seq].csv`` in lower case."""
    parts = [partner, region, interval, table, f"{start:%Y-%m-%d}", f"{end:%Y-%m-%d}"]
    if sequence is not None:
        parts.append(f"{sequence:03d}")
    return "_".join(p.lower() for p in parts) + ".csv"


@dataclass(frozen=True)
class Destinations:
    """Folders by region. ``receipts``: N deliver only, Y deliver and keep a copy,
    RO keep the copy only."""

    home: str
    international: str
    home_receipts: str | None = None
    international_receipts: str | None = None
    home_region: str = "us"
    receipts: str = "N"

    def folders(self, region: str) -> list[str]:
        at_home = region.lower() == self.home_region
        deliver = self.home if at_home else self.international
        copy = self.home_receipts if at_home else self.international_receipts
        if self.receipts == "RO":
            return [copy]
        return [deliver, copy] if self.receipts == "Y" else [deliver]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


@dataclass(frozen=True)
class Staged:
    """Finished files that nobody reads yet: path and rows of each, and a digest of all rows."""

    files: tuple[tuple[str, int], ...]
    digest: str


def stage_report(df: DataFrame, staging: str, order: Sequence[str], columns: Sequence[str], as_of: date, max_rows: int = 999_999) -> Staged:
    """Write files of at most ``max_rows`` rows, each with a header, in the given order.

    An empty report still yields one file with a header and one row that holds only the
    execution date. The rows of a file are written by one task into one part, whatever
    the session says on the size of files; a missing part or row is an error. The digest
    is a sum over rows, so it does not depend on the files they are in.
    """
    spark = df.sparkSession
    chunks = chunk_rows(df, order, max_rows)
    spread = chunks.repartition("row_partition").sortWithinPartitions("row_partition", "row_num")
    seen = Observation()
    row_digest = F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))
    counted = spread.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.max("row_num").alias("last"), F.max("row_partition").alias("files"), row_digest.cast("string").alias("digest")
    )
    to_csv(counted.select("row_partition", *columns)).partitionBy("row_partition").csv(staging)
    rows, files = seen.get["rows"], seen.get["files"] or 0
    if rows != (seen.get["last"] or 0):
        raise ValueError(f"{rows} of {seen.get['last']} report rows were written")
    fs, Path = _fs(spark, staging)
    chunk_dirs = sorted(
        (s.getPath() for s in fs.listStatus(Path(staging)) if s.isDirectory()), key=lambda p: int(p.getName().split("=")[1])
    )
    if len(chunk_dirs) != files:
        raise ValueError(f"{len(chunk_dirs)} of {files} report files were written")
    if not chunk_dirs:
        blank = ensure_one_row(df.limit(0).select(*columns), report_execution_date=F.lit(as_of)).select(*columns)
        to_csv(blank.coalesce(1)).csv(f"{staging}/row_partition=1")
        chunk_dirs, rows = [Path(f"{staging}/row_partition=1")], 1
    parts = [[s.getPath() for s in fs.listStatus(chunk) if s.getPath().getName().startswith("part-")] for chunk in chunk_dirs]
    if any(len(found) != 1 for found in parts):
        raise ValueError("a report file was written in several parts")
    sizes = [min(max_rows, rows - i * max_rows) for i in range(len(parts))]
    return Staged(tuple((part.toString(), n) for (part,), n in zip(parts, sizes, strict=True)), seen.get["digest"] or "0")


def write_report(
    df: DataFrame,
    folder: str,
    name,
    order: Sequence[str],
    columns: Sequence[str],
    as_of: date,
    max_rows: int = 999_999,
) -> list[str]:
    """The files of :func:`stage_report` in a folder, named by ``name`` (sequence number to file name).

    Each file replaces its predecessor in one step, but the files of a report one by one:
    :func:`commit_reports` is for readers that must not see half of two runs. Files that
    an earlier run left beyond the last one are removed once the new ones are in place.
    """
    spark = df.sparkSession
    here = Folder(spark, folder)
    staging = f"{here.root}/_parts_{name(0)}"
    staged = stage_report(df, staging, order, columns, as_of, max_rows)
    written = []
    for i, (part, _) in enumerate(staged.files, 1):
        written.append(f"{here.root}/{name(i)}")
        here.rename(part, written[-1], overwrite=True)
    here.fs.delete(here.path(staging), True)
    remove_stale(spark, folder, name, len(written))
    return written


@dataclass(frozen=True)
class Report:
    """A finished report of a run: its rows, how they are ordered and which columns are delivered."""

    table: str
    rows: DataFrame
    order: Sequence[str]
    columns: Sequence[str]


def commit_reports(
    reports: Sequence[Report], folders: Sequence[str], name, arguments: Mapping, as_of: date, max_rows: int = 999_999
) -> list[Manifest]:
    """Deliver all reports of a run to every folder, each of which shows them at once.

    ``name`` maps a table and a sequence number to a file name. The files are written once
    and copied; then each folder gets its manifest. Until its manifest is there, a folder
    shows the run before, whatever fails.
    """
    spark = reports[0].rows.sparkSession
    first, *others = [Folder(spark, f) for f in folders]
    numbers = [max(f.numbers(), default=0) + 1 for f in (first, *others)]
    run, files, digests = first.new_run(), [], []
    for report in reports:
        staged = stage_report(report.rows, f"{run}/_parts_{report.table}", report.order, report.columns, as_of, max_rows)
        digests.append(f"{report.table}:{staged.digest}")
        for i, (part, n) in enumerate(staged.files, 1):
            path = f"{run}/{name(report.table, i)}"
            first.rename(part, path, overwrite=False)
            files.append({"table": report.table, "path": path, "rows": n, "bytes": first.fs.getFileStatus(first.path(path)).getLen()})
        first.fs.delete(first.path(f"{run}/_parts_{report.table}"), True)
    ready = [(first, run, files)]
    copy = spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy
    for folder in others:
        copied_run, copied = folder.new_run(), []
        folder.fs.mkdirs(folder.path(copied_run))
        for f in files:
            path = f"{copied_run}/{f['path'].rsplit('/', 1)[-1]}"
            copy(first.fs, first.path(f["path"]), folder.fs, folder.path(path), False, True, spark.sparkContext._jsc.hadoopConfiguration())
            copied.append({**f, "path": path})
        ready.append((folder, copied_run, copied))
    return [folder.commit(own, there, arguments, ";".join(digests), number) for (folder, own, there), number in zip(ready, numbers, strict=True)]


def to_csv(df: DataFrame):
    """Writer of delivered files: each task writes one file."""
    return df.write.mode("overwrite").options(**CSV_FORMAT).option("maxRecordsPerFile", 0)


def remove_stale(spark: SparkSession, folder: str, name, last: int) -> None:
    """Remove files of the report with a sequence number beyond the last one."""
    fs, Path = _fs(spark, folder)
    there = {s.getPath().getName() for s in fs.listStatus(Path(folder))}
    for i in range(last + 1, max(last + len(there), 1000) + 1):
        if name(i) in there:
            fs.delete(Path(f"{folder.rstrip('/')}/{name(i)}"), False)


def deliver(df: DataFrame, destinations: Destinations, region: str, name, order, columns, as_of: date, max_rows: int = 999_999) -> list[str]:
    """Write the report once and copy the finished files to every other folder that its
    region and the receipt option ask for."""
    spark = df.sparkSession
    first, *others = destinations.folders(region)
    out = write_report(df, first, name, order, columns, as_of, max_rows)
    source, Path = _fs(spark, first)
    files = list(out)
    for folder in others:
        target, _ = _fs(spark, folder)
        target.mkdirs(Path(folder))
        for i, path in enumerate(files, 1):
            copy = Path(f"{folder.rstrip('/')}/{name(i)}")
            spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(source, Path(path), target, copy, False, True, spark.sparkContext._jsc.hadoopConfiguration())
            out.append(copy.toString())
        remove_stale(spark, folder, name, len(files))
    return out


def overwrite_table(df: DataFrame, name: str, fmt: str = "parquet", root: str | None = None) -> None:
    """Full refresh of a table, whose versions are kept below ``root`` (by default beside the
    warehouse's tables); see :func:`replace_table`."""
    warehouse = df.sparkSession.conf.get("spark.sql.warehouse.dir")
    replace_table(df, name, root or f"{warehouse.rstrip('/')}/{name.rsplit('.', 1)[-1]}_versions", fmt)


def write_tables(tables: Mapping[str, DataFrame], folder: str, as_of: date) -> dict[str, str]:
    """One CSV folder per report table, each with the execution date in front."""
    out = {}
    for name, df in tables.items():
        path = f"{folder.rstrip('/')}/{name}"
        df.select(F.lit(as_of).alias("report_exec_date"), "*").write.mode("overwrite").options(**CSV_FORMAT).csv(path)
        out[name] = path
    return out


def copy_csv(spark: SparkSession, source: str, target: str, columns: Sequence[str]) -> None:
    """Untyped copy: every column is text."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = spark.read.schema(schema).options(header=True, quote='"', escape='"', enforceSchema=True).csv(source)
    df.write.mode("overwrite").options(**CSV_FORMAT).csv(target)
