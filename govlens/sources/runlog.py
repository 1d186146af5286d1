"""The collection jobs' own log: what each cycle and each stream batch did, as rows.

The health reports read it. A row says when, how grave, which input, and in words what; a
cycle's rows carry its run time, so the log of a repeated cycle says the same again.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "ts TIMESTAMP, level STRING, source STRING, message STRING, rows BIGINT"
Row = tuple[datetime, str, str, str, int | None]


def append(spark: SparkSession, path: str, rows: Iterable[Row]) -> None:
    """A handful of rows, one per input of a cycle, as one file."""
    rows = list(rows)
    if rows:
        frame = spark.createDataFrame([(str(r[0]), *r[1:]) for r in rows], SCHEMA.replace("TIMESTAMP", "STRING"))
        frame = frame.withColumn("ts", F.to_timestamp("ts"))
        frame.coalesce(1).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def done(ts: datetime, source: str, count: int) -> Row:
    return ts, "INFO", source, f"{count} events loaded", count


def failed(ts: datetime, source: str, error: BaseException) -> Row:
    """One line of what went wrong; a throttled or refused request can be told from it."""
    text = " ".join(str(error).split())[:500]
    return ts, "ERROR", source, f"{type(error).__name__}: {text}", None


def _causes(trace: str) -> str:
    """The lines of a trace that name an error, the innermost first."""
    named = [line.strip() for line in trace.splitlines() if re.search(r"(Error|Exception)\b.*: ", line)]
    return "; ".join(dict.fromkeys(reversed(named))) or trace


class RunLog(StreamingQueryListener):
    """Writes a row for each batch of each stream, and one for a stream that fails.

    ``spark.streams.addListener(RunLog(spark, path))`` while the streams run; a query's
    name is its source.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        at = datetime.fromisoformat(progress.timestamp.replace("Z", "+00:00")).astimezone(timezone.utc)
        count = progress.numInputRows
        message = f"batch {progress.batchId}: {count} events read"
        self._write((at.replace(tzinfo=None), "INFO", progress.name or str(progress.id), message, count))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            source = self.names.get(str(event.id), str(event.id))
            now = datetime.now(timezone.utc).replace(tzinfo=None)
            self._write(failed(now, source, RuntimeError(_causes(event.exception))))

    def _write(self, row: Row) -> None:
        append(self.spark, self.path, [row])
