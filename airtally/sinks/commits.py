"""Sets of files that readers see as a whole: a manifest written last names what counts.

A delivery folder holds ``_runs/<run>/`` with the files of each run, and ``_manifests/<n>.json``. A
run first writes its files, where nobody looks for them, then its manifest under the next
number, by a rename that fails if that number exists. Readers take the highest number. A run that
dies leaves files that no manifest names; :func:`clean` removes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class CommitConflict(RuntimeError):
    """Another run has committed under the same number."""


@dataclass(frozen=True)
class Manifest:
    """One committed run: its files with their rows, its arguments, and a digest of its rows."""

    number: int
    run: str
    files: tuple[dict, ...]
    arguments: dict = field(default_factory=dict)
    digest: str = ""

    def paths(self, table: str | None = None) -> list[str]:
        return [f["path"] for f in self.files if table is None or f["table"] == table]


class Folder:
    """A delivery folder on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(self.root).getFileSystem(self._conf)

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def new_run(self) -> str:
        return f"{self.root}/_runs/{uuid.uuid4().hex}"

    def names(self, below: str) -> list[str]:
        folder = self.path(f"{self.root}/{below}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(folder)) if self.fs.exists(folder) else []

    def rename(self, source: str, target: str, overwrite: bool) -> None:
        """Move a file in one step; without ``overwrite`` an existing target is an error."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(self.root).toUri(), self._conf)
        option = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.OVERWRITE if overwrite else option.NONE
        context.rename(self.path(source), self.path(target), options)

    def write_text(self, name: str, text: str) -> None:
        out = self.fs.create(self.path(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read_text(self, name: str) -> str:
        lines = self._jvm.org.apache.commons.io.IOUtils.toString(self.fs.open(self.path(name)), "UTF-8")
        return str(lines)

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.names("_manifests") if n.endswith(".json") and n[:-5].isdigit()]

    def manifest(self, number: int | None = None) -> Manifest | None:
        """A committed run, the last one by default."""
        known = self.numbers()
        number = max(known, default=None) if number is None else number
        if number is None or number not in known:
            return None
        said = json.loads(self.read_text(f"{self.root}/_manifests/{number:08d}.json"))
        return Manifest(number, said["run"], tuple(said["files"]), said["arguments"], said["digest"])

    def commit(self, run: str, files: Sequence[Mapping], arguments: Mapping, digest: str, number: int | None = None) -> Manifest:
        """Make the files of a run the current ones. ``number`` is the one that the run expects to
        be the next; another run that took it meanwhile is a conflict."""
        number = max(self.numbers(), default=0) + 1 if number is None else number
        for f in files:
            if not self.fs.exists(self.path(f["path"])):
                raise FileNotFoundError(f["path"])
        said = {"run": run, "files": [dict(f) for f in files], "arguments": dict(arguments), "digest": digest}
        self.fs.mkdirs(self.path(f"{self.root}/_manifests"))
        draft, target = f"{self.root}/_manifests/.{uuid.uuid4().hex}", f"{self.root}/_manifests/{number:08d}.json"
        self.write_text(draft, json.dumps(said, indent=1, sort_keys=True, default=str))
        try:
            self.rename(draft, target, overwrite=False)
        except Exception as e:
            self.fs.delete(self.path(draft), False)
            if self.fs.exists(self.path(target)):
                raise CommitConflict(f"run {number} of {self.root} is committed already") from e
            raise
        return Manifest(number, run, tuple(said["files"]), said["arguments"], digest)

    def clean(self, keep: int = 2) -> list[str]:
        """Remove runs other than the last ``keep`` committed ones, and what dead runs left. Not to be
        called while another run writes."""
        kept = sorted(self.numbers())[-keep:]
        live = {self.manifest(n).run.rsplit("/", 1)[-1] for n in kept}
        gone = [r for r in self.names("_runs") if r not in live]
        for run in gone:
            self.fs.delete(self.path(f"{self.root}/_runs/{run}"), True)
        for n in self.numbers():
            if n not in kept:
                self.fs.delete(self.path(f"{self.root}/_manifests/{n:08d}.json"), False)
        return gone


def read_delivered(spark: SparkSession, root: str, schema: str, table: str | None = None, number: int | None = None) -> DataFrame:
    """Rows of the files that a delivery folder's manifest names, the last one by default."""
    manifest = Folder(spark, root).manifest(number)
    paths = manifest.paths(table) if manifest else []
    reader = spark.read.schema(schema).options(header=True, quote='"', escape='"', nullValue="", emptyValue="", enforceSchema=True)
    return reader.csv(paths) if paths else spark.createDataFrame([], schema)


def replace_table(df: DataFrame, name: str, root: str, fmt: str = "parquet") -> str:
    """Full refresh of a table in one step: the rows go to a new version of its files, then the
    table's location is switched to it. Readers see the old rows or the new ones; if the
    write fails, the old ones stay. The version before is kept for queries that still read it.

    ``root`` is the folder of the table's versions; the columns must stay the same.
    """
    spark = df.sparkSession
    folder = Folder(spark, root)
    versions = [v for v in folder.names("") if v.startswith("v")]
    number = max((int(v[1:9]) for v in versions), default=0) + 1
    version = f"{folder.root}/v{number:08d}-{uuid.uuid4().hex[:8]}"
    exists = spark.catalog.tableExists(name)
    if exists:
        before = [(f.name, f.dataType) for f in spark.table(name).schema]
        if before != [(f.name, f.dataType) for f in df.schema]:
            raise ValueError(f"the columns of {name} have changed")
        current = spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"].rsplit("/", 1)[-1]
    df.write.format(fmt).save(version)
    if exists:
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{version}'")
        spark.catalog.refreshTable(name)
    else:
        spark.catalog.createTable(name, path=version, source=fmt, schema=df.schema)
    for stale in versions:
        # what was current stays for queries that began before; failed refreshes go
        if not exists or stale != current:
            folder.fs.delete(folder.path(f"{folder.root}/{stale}"), True)
    return version
