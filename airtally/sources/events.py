"""Event facts: layout on disk and window scans that prune partitions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import between_ts, date_lit, day, hour_key, hour_key_range


def scan_window(
    df: DataFrame,
    ts: str,
    start: datetime,
    end: datetime,
    countries: Sequence[str] = (),
    date_partition: str | None = None,
    hour_partition: str | None = None,
) -> DataFrame:
    """Events of a closed window. The window is stated again on the partition column,
    so that only its folders are listed and read. Countries match in any case."""
    kept = df.where(between_ts(ts, start, end))
    if date_partition:
        kept = kept.where(F.col(date_partition).between(date_lit(start.date()), date_lit(end.date())))
    if hour_partition:
        kept = kept.where(hour_key_range(hour_partition, start, end))
    if countries:
        kept = kept.where(F.lower("country").isin(*[c.strip().lower() for c in countries]))
    return kept


@dataclass(frozen=True)
class Facts:
    """A fact log, its time column, and the columns its folders are named by, if any.

    Reports take a log as a plain frame or as facts, and read it through :meth:`window`
    alone, so every one of their scans states its days and countries.
    """

    rows: DataFrame
    ts: str = "event_ts"
    date_partition: str | None = None
    hour_partition: str | None = None

    @classmethod
    def of(cls, log: DataFrame | Facts, ts: str = "event_ts") -> Facts:
        return log if isinstance(log, Facts) else cls(log, ts)

    def window(self, start: datetime, end: datetime, countries: Sequence[str] = (), among: DataFrame | None = None) -> DataFrame:
        """Events of a closed window and of the listed countries.

        ``among`` has one row for each wanted country, so it is broadcast; with folders by
        country, Spark prunes these once it has the rows.
        """
        kept = scan_window(self.rows, self.ts, start, end, countries, self.date_partition, self.hour_partition)
        if among is not None:
            kept = kept.join(F.broadcast(among.select("country").distinct()), "country", "left_semi")
        return kept

    def where(self, condition) -> Facts:
        return replace(self, rows=self.rows.where(condition))


def write_events(df: DataFrame, path: str, ts: str = "event_ts", files_per_day: int = 1, mode: str = "append", hourly: bool = False) -> None:
    """Parquet partitioned by country and day, or hour, rows of a file sorted by time.

    A country's day is spread over ``files_per_day`` tasks by a hash of the row's time,
    so that the busiest country is not written by one task.
    """
    folders = ("country", "event_hour") if hourly else ("country", "event_date")
    dated = df.withColumn(folders[1], hour_key(ts) if hourly else day(ts))
    salt = F.pmod(F.xxhash64(ts), F.lit(files_per_day))
    spread = dated.repartition(*folders, salt).sortWithinPartitions(*folders, ts)
    spread.write.mode(mode).partitionBy(*folders).parquet(path)


def read_events(spark: SparkSession, path: str, schema: str, ts: str = "event_ts", hourly: bool = False) -> Facts:
    """Facts that :func:`write_events` wrote; ``schema`` declares the columns of the files."""
    folders = "country string, event_hour string" if hourly else "country string, event_date date"
    rows = spark.read.schema(f"{schema}, {folders}").parquet(path)
    return Facts(rows, ts, hour_partition="event_hour") if hourly else Facts(rows, ts, date_partition="event_date")
