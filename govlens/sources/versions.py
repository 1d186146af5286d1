"""Partitioned tables that change by a switch, and the ledger that switches them.

A load writes its rows into a folder of its own, ``load=<id>``, beside what is there. Then one entry of the ledger names the partitions the load adds to or replaces. The
entry is written aside and appears whole, by a rename that fails where the entry's number
is taken. Readers take only folders that the ledger names, and of a partition none from
before its last replacement; to Spark they are a plain partitioned table. So a driver or executor that is lost at any point leaves the
table as it was; what it wrote is never read, and ``vacuum`` removes it.

The rename must be atomic in the file system, as it is for HDFS and local ones; object
stores need a committer that makes it so.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOAD = "load"
_ENTRY = re.compile(r"entry=(\d+)$")


class Conflict(RuntimeError):
    """Another writer has committed since the version that this one started from."""


class _Folders:
    """The few file system calls that Spark's readers and writers do not offer."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.root = self._path(path)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self.root.toUri(), spark._jsc.hadoopConfiguration()
        )

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def there(self, path: str) -> bool:
        return self.context.util().exists(self._path(path))

    def names(self, path: str) -> list[str]:
        folder = self._path(path)
        if not self.context.util().exists(folder):
            return []
        found = self.context.util().listStatus(folder)
        return [found[k].getPath().getName() for k in range(len(found))]

    def claim(self, source: str, target: str) -> None:
        """Rename, unless the target is there."""
        overwrite = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self.context.rename(self._path(source), self._path(target), overwrite)

    def make(self, path: str) -> None:
        permission = self.jvm.org.apache.hadoop.fs.permission.FsPermission.getDirDefault()
        self.context.mkdir(self._path(path), permission, True)

    def remove(self, path: str) -> None:
        self.context.delete(self._path(path), True)


class Ledger:
    """Numbered entries of rows; entry ``n`` is written once, after all of its rows."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.schema = spark, schema
        self.path = f"{path.rstrip('/')}/_ledger"
        self.folders = _Folders(spark, path)

    def version(self) -> int:
        """The number of the last entry; 0 before the first."""
        found = [_ENTRY.search(name) for name in self.folders.names(self.path)]
        return max((int(m[1]) for m in found if m), default=0)

    def rows(self) -> DataFrame:
        """Rows of all entries with the number of theirs, ``entry``."""
        schema = f"{self.schema}, entry BIGINT"
        if not self.version():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def commit(self, rows: DataFrame, expected: int) -> int:
        """Add an entry behind ``expected``, the version this writer started from."""
        aside = f"{self.path}/_aside-{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        version = expected + 1
        try:
            self.folders.claim(aside, f"{self.path}/entry={version:012d}")
        except Exception as error:
            self.folders.remove(aside)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {version} of {self.path} is taken") from None
            raise
        return version


class VersionedTable:
    """A Parquet table in folders of ``partitions`` and loads, with its ledger."""

    def __init__(self, spark: SparkSession, path: str, partitions: Sequence[str], schema: T.StructType):
        self.spark, self.path = spark, path.rstrip("/")
        self.partitions, self.schema = list(partitions), schema
        types = [f"{p} {schema[p].dataType.simpleString()}" for p in self.partitions]
        self.ledger = Ledger(spark, path, f"{', '.join(types)}, {LOAD} STRING, replaces BOOLEAN")

    def version(self) -> int:
        return self.ledger.version()

    def folders(self) -> DataFrame:
        """(partitions, load, live): a row per folder that was committed."""
        since = F.max(F.expr("CASE WHEN replaces THEN entry END")).over(
            Window.partitionBy(*self.partitions)
        )
        rows = self.ledger.rows().withColumn("_since", since)
        return rows.select(*self.partitions, LOAD, F.expr("entry >= coalesce(_since, 0)").alias("live"))

    def folder(self, load: str, values: Sequence) -> str:
        """The folder of a partition in a load."""
        parts = [f"{p}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for p, v in zip(self.partitions, values)]
        return "/".join([self.path, f"{LOAD}={load}", *parts])

    def _paths(self, rows: list) -> list[str]:
        return [self.folder(row[LOAD], [row[p] for p in self.partitions]) for row in rows]

    def _rows(self, paths: list[str], row_ids: bool) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(LOAD, T.StringType())])
        if not paths:
            empty = self.spark.createDataFrame([], schema).drop(LOAD)
            return empty.withColumn("_row", F.lit(0).cast("long")) if row_ids else empty
        rows = self.spark.read.schema(schema).option("basePath", self.path).parquet(*paths)
        return (rows.withColumn("_row", row_id()) if row_ids else rows).drop(LOAD)

    def read(self, row_ids: bool = False) -> DataFrame:
        """The table's rows; ``row_ids`` adds ``_row``, which names a row of a file.

        The driver learns the folders to read, which Spark's file index holds there anyway:
        the root of a load that is read whole, else its live partitions.
        """
        whole = F.min("live").over(Window.partitionBy(LOAD))
        known = self.folders().withColumn("_whole", whole).where("live")
        roots = [r[0] for r in known.where("_whole").select(LOAD).distinct().collect()] if self.version() else []
        parts = self._paths(known.where("NOT _whole").collect()) if self.version() else []
        return self._rows([f"{self.path}/{LOAD}={load}" for load in roots] + parts, row_ids)

    def read_partitions(self, values: set[tuple]) -> DataFrame:
        """The rows of some partitions, by their values, with ``_row``; no other folder is read."""
        live = self.folders().where("live").collect() if self.version() else []
        named = [r for r in live if tuple(r[p] for p in self.partitions) in values]
        return self._rows(self._paths(named), True)

    def read_load(self, load: str) -> DataFrame:
        """The rows of a load with ``_row``, committed or not."""
        return self._rows([f"{self.path}/{LOAD}={load}"], True)

    def write(
        self, rows: DataFrame, replaces: bool, touched: DataFrame | None = None, expected: int | None = None
    ) -> int:
        """Write a load and commit it; gives the table's new version.

        ``touched`` names the partitions that ``rows`` has rows in, if that is known.
        ``expected`` is the version that the rows were made from, by default the one at
        the time of the commit.
        """
        load = self.load(rows)
        if touched is None:
            fields = T.StructType([self.schema[p] for p in self.partitions])
            touched = self.spark.read.schema(fields).parquet(f"{self.path}/{LOAD}={load}")
        entry = touched.select(*self.partitions).distinct()
        entry = entry.select("*", F.lit(load).alias(LOAD), F.lit(replaces).alias("replaces"))
        return self.ledger.commit(entry.coalesce(1), self.version() if expected is None else expected)

    def load(self, rows: DataFrame) -> str:
        """Write rows into a load of their own, which no reader takes before an entry names it."""
        load = uuid.uuid4().hex
        files = rows.write.option("compression", "zstd").partitionBy(*self.partitions)
        files.parquet(f"{self.path}/{LOAD}={load}")
        return load

    def commit(self, named: list[tuple], expected: int) -> int:
        """Switch readers over to folders that were written: (partition values, load, replaces)."""
        entry = self.spark.createDataFrame([(*values, *rest) for values, *rest in named], self.ledger.schema)
        return self.ledger.commit(entry.coalesce(1), expected)

    def drop(self, load: str, values: Sequence | None = None) -> None:
        """Remove a partition of a load that no entry names, or the load as a whole."""
        path = f"{self.path}/{LOAD}={load}" if values is None else self.folder(load, values)
        self.ledger.folders.remove(path)

    def empty(self, load: str, values: Sequence) -> None:
        """A partition without rows, which may take the place of one that has lost all of its."""
        self.ledger.folders.make(self.folder(load, values))

    def vacuum(self) -> int:
        """Remove folders that no reader takes; gives their number.

        Only for times without writers: a load that is being written has no entry yet, and
        with readers that began after the last commit.
        """
        dead = self._paths(self.folders().where("NOT live").collect())
        known = {r[0] for r in self.folders().select(LOAD).distinct().collect()}
        names = self.ledger.folders.names(self.path)
        loads = [n for n in names if n.startswith(f"{LOAD}=") and n.split("=", 1)[1] not in known]
        gone = [path for path in dead if self.ledger.folders.there(path)]
        for path in [*gone, *(f"{self.path}/{n}" for n in loads)]:
            self.ledger.folders.remove(path)
        return len(gone) + len(loads)


def row_id() -> Column:
    """The identity of a row that is read from a file: the same in every scan."""
    return F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
