"""The event store: Parquet, one folder per day and record kind, changed by a switch."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govlens import contract
from govlens.functions import values as V
from govlens.plans.normalize import as_stored
from govlens.sources.versions import VersionedTable

PARTITIONS = ("event_date", "record")


# Spark's estimate of the size of a load, in bytes, from which its rows are not shuffled:
# the tasks' own pieces of a partition are files of a fair size then. What no statistics
# are known of has estimates beyond the second bound.
LARGE, UNKNOWN = 1 << 31, 1 << 50
LOOKED_UP = 200_000  # lost rows that tasks look up; more are joined


def _partitioned(events: DataFrame) -> DataFrame:
    """Rows of a partition meet in as few files as their size allows: rebalancing
    joins small pieces and splits a day or kind that holds much of the data. The rows of a
    large load stay where they are read, so it needs no more disk than its files."""
    rows = as_stored(events).withColumn("record", F.col("ai.record"))
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if LARGE < size < UNKNOWN:
        return rows
    return rows.hint("rebalance", *[F.col(p) for p in PARTITIONS])


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the query that made them ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


SCHEMA = T.StructType([*contract.EVENT_TYPE.fields, T.StructField("record", T.StringType())])

# What a report row measures, as against what it is about: the contract's sub-structs, and
# numbers in ``raw`` whose member has one of these names or endings (fixed wire names).
MEASURES = ("usage", "cost", "adoption")
_STRING = r'"(?:[^"\\]|\\.)*"'
_NUMBER = r'"[^"\\]*":-?[0-9.eE+-]+,?'
_MEASURED = (
    r'"[^"\\]*(?:count|counts|tokens|amount|usd|spend|rate|requests|total|minutes|seconds|score'
    r'|added|removed|accepted|rejected)":-?[0-9.eE+-]+,?'
)
# Current state, read again and again: each day's snapshot is an event of its own.
SNAPSHOTS = ("spend_limit", "spend_limit_request")


def _table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, PARTITIONS, SCHEMA)


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Append, or with ``overwrite`` replace the partitions that have rows here."""
    with _tidy(events.sparkSession):
        _table(events.sparkSession, path).write(_partitioned(events), replaces=mode == "overwrite")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Events of the store. Predicates on day and record skip whole folders."""
    return _table(spark, path).read()


def of_days(events: DataFrame, days: DataFrame) -> DataFrame:
    """Events of the days in ``days(event_date)``.

    The first and last of them bound the scan by literals, the join prunes between them.
    """
    days = days.select("event_date").distinct()
    first, last = days.selectExpr(
        "CAST(min(event_date) AS STRING)", "CAST(max(event_date) AS STRING)"
    ).first()
    if first is None:
        return events.where("false")
    within = events.where(f"event_date BETWEEN DATE '{first}' AND DATE '{last}'")
    return within.join(days, "event_date", "left_semi")


def export_json(events: DataFrame, path: str) -> None:
    """One JSON document per line, absent members left out, ``ai.time`` first."""
    ai = V.clean("ai", contract.AI_TYPE)
    as_stored(events).selectExpr(f"{ai} AS ai", "raw").write.mode("append").option(
        "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]'Z'"
    ).json(path)


def event_key(text: str = "to_json(raw)") -> Column:
    """For stored events, whose ``raw`` as JSON is ``text``. What makes two deliveries the same event: the provider's id, else
    everything that is not a measure.

    That is every contract field outside MEASURES and every other member of ``raw``, known
    to the contract or not; snapshots add the day on which they were collected.
    """
    about = ", ".join(
        f"'{f.name}', ai.{f.name}" for f in contract.AI_TYPE.fields if f.name not in MEASURES
    )
    # Strings are matched first, so that only real members are taken out. Every number of
    # a user's activity counts something.
    named, every = (V.quote(f"({_STRING}:{_STRING})|{m}") for m in (_MEASURED, _NUMBER))
    rest = (
        f"CASE WHEN ai.record = 'user_activity' THEN regexp_replace({text}, {every}, '$1')"
        f" ELSE regexp_replace({text}, {named}, '$1') END"
    )
    kinds = ", ".join(V.quote(k) for k in SNAPSHOTS)
    day = f"CASE WHEN ai.record IN ({kinds}) THEN CAST(CAST(collected_at AS DATE) AS STRING) END"
    dims = f"to_json(named_struct({about})), coalesce({rest}, ''), coalesce({day}, '')"
    return F.expr(
        f"coalesce(concat(ai.vendor, '/', ai.event_id), sha2(concat_ws('|', {dims}), 256))"
    )


_ID = ("_k1", "_k2")  # 128 bits of a key: two longs join and sort faster than its text


def keyed(events: DataFrame) -> DataFrame:
    """Events with their key (``_ID``); ``_content``, a hash of all they say; and ``_one``,
    whether the provider names them, so that copies within a delivery are one event."""
    # The JSON text, by far the dearest part, is a column, so that it is made once per row.
    rows = as_stored(events).withColumn("_text", F.to_json("raw"))
    rows = rows.withColumns(
        {
            "_key": event_key("_text"),
            "_content": F.xxhash64("ai", "_text"),
            "_one": F.col("ai.event_id").isNotNull(),
        }
    )
    return rows.withColumns(
        {_ID[0]: F.xxhash64("_key"), _ID[1]: F.xxhash64(F.lit("2"), "_key")}
    ).drop("_key", "_text")


def _contents(rows: DataFrame, *more: str) -> DataFrame:
    """A row per content of a key and delivery: how often the store (``_n0``) and the load
    (``_n1``) have it, and a row of each that does."""
    old, new = F.col("_load") == 0, F.col("_load") == 1
    return rows.groupBy(*_ID, "_content", "collected_at", "_one", *more).agg(
        F.count_if(old).alias("_n0"),
        F.count_if(new).alias("_n1"),
        F.min(F.when(old, F.col("_row"))).alias("_row0"),
        F.min(F.when(new, F.col("_row"))).alias("_row1"),
    )


_WINS = "collected_at <=> _newest.collected_at AND (NOT _one OR _content = _newest._content)"


def newest_deliveries(events: DataFrame) -> DataFrame:
    """The events of each key's last delivery.

    A named event is there once. Rows without an id that share a key are different rows of
    one delivery and all stay; what was loaded before (``_load``) and comes again with the
    same content is the same row, as often as the load that has it most often.

    Winners are found on hashes, in aggregates that combine where the rows are read; the
    events themselves are only joined to them, so copies of one event may be split.
    """
    columns = [c for c in as_stored(events).columns if not c.startswith("_") or c == "_time"]
    rows = events if _ID[0] in events.columns else keyed(events)
    if "_load" not in rows.columns:
        rows = rows.withColumns({"_load": F.lit(0), "_row": F.monotonically_increasing_id()})
    contents = _contents(rows)
    newest = contents.groupBy(*[F.col(c).alias(f"_n{c}") for c in _ID]).agg(
        F.max(F.struct("collected_at", "_content")).alias("_newest")
    )
    same = (F.col(_ID[0]) == F.col(f"_n{_ID[0]}")) & (F.col(_ID[1]) == F.col(f"_n{_ID[1]}"))
    winners = contents.join(newest, same).where(_WINS)
    winners = winners.selectExpr(
        *_ID,
        "_content",
        "collected_at AS _at",
        "IF(_n1 > _n0, 1, 0) AS _from",
        "CASE WHEN _one THEN IF(_n1 > _n0, _row1, _row0) END AS _only",
    )
    kept = rows.join(winners, [*_ID, "_content"]).where(
        "collected_at <=> _at AND _load = _from AND _row = coalesce(_only, _row)"
    )
    return kept.select(*columns)


def _verdicts(rows: DataFrame) -> DataFrame:
    """``_contents`` by partition, and how many of its rows stay in the store (``_kept0``)
    and in the load (``_kept1``), by the rules of ``newest_deliveries``.

    Only hashes are shuffled, after copies were combined where they are read.
    """
    newest = F.max(F.struct("collected_at", "_content")).over(Window.partitionBy(*_ID))
    found = _contents(rows, *PARTITIONS).withColumn("_newest", newest)
    return found.withColumns(
        {
            "_kept0": F.expr(f"CASE WHEN {_WINS} AND _n1 <= _n0 THEN IF(_one, 1L, _n0) ELSE 0L END"),
            "_kept1": F.expr(f"CASE WHEN {_WINS} AND _n1 > _n0 THEN IF(_one, 1L, _n1) ELSE 0L END"),
        }
    )


def _without_lost(rows: DataFrame, verdicts: DataFrame, chosen: DataFrame, count: int) -> DataFrame:
    """The rows of ``chosen`` days, kinds and sides that stay; ``count`` do not."""
    lost = [
        verdicts.where(f"_n{k} > _kept{k}").selectExpr(
            *[f"{c} AS _lost{c}" for c in (*_ID, "_content")],
            "collected_at AS _at",
            f"{k} AS _from",
            f"CASE WHEN _kept{k} > 0 THEN _row{k} END AS _only",
            *PARTITIONS,
        )
        for k in (0, 1)
    ]
    of_chosen = "event_date <=> _date AND record <=> _record AND {} = _side"
    gone = lost[0].unionByName(lost[1]).join(chosen, F.expr(of_chosen.format("_from")), "left_semi")
    gone = gone.drop(*PARTITIONS)
    same = [F.col(c) == F.col(f"_lost{c}") for c in (*_ID, "_content")]
    more = F.expr("_load = _from AND collected_at <=> _at AND NOT (_row <=> _only)")
    rows = rows.join(chosen, F.expr(of_chosen.format("_load")), "left_semi")
    return rows.join(F.broadcast(gone) if count <= LOOKED_UP else gone, [*same, more], "left_anti")


def upsert_events(batch: DataFrame, path: str) -> int:
    """Load a batch so that loading it again changes nothing; gives its number of rows.

    Only the days and kinds the batch touches are read, and only those that lose rows are
    replaced. The new rows lie beside the old ones until one ledger entry switches readers
    over (``versions``), so a driver that is lost before leaves the store as it was. The
    batch is computed once, into a load of its own; a day and kind of it is written again
    only where a part of its rows is lost to others. An event keeps its time, hence
    its partition.
    """
    with _tidy(batch.sparkSession):
        return _upsert(batch, path)


def _upsert(batch: DataFrame, path: str) -> int:
    table = _table(batch.sparkSession, path)
    version = table.version()
    load = table.load(_partitioned(batch))
    rows = table.read_load(load)
    touched = {tuple(r)[:-1]: r["count"] for r in rows.groupBy(*PARTITIONS).count().collect()}
    count = sum(touched.values())
    if not count:
        table.drop(load)
        return count
    rows = rows.withColumn("_load", F.lit(1))
    if version:
        rows = table.read_partitions(set(touched)).withColumn("_load", F.lit(0)).unionByName(rows)
    rows = keyed(rows)
    verdicts = _verdicts(rows)
    sums = [F.sum(f"_{what}{k}").alias(f"{what}{k}") for what in ("n", "kept") for k in (0, 1)]
    # a row per day and kind, of which the driver knows the folders anyway
    found = {(r.event_date, r.record): r for r in verdicts.groupBy(*PARTITIONS).agg(*sums).collect()}
    named, parts, dropped, lost = [], [], [], 0
    for values, r in found.items():
        # A folder of which a part stays is written again, without what is lost.
        some0, some1 = 0 < r.kept0 < r.n0, 0 < r.kept1 < r.n1
        for k, some in ((0, some0), (1, some1)):
            if some:
                parts.append((*values, k))
                lost += r[f"n{k}"] - r[f"kept{k}"]
        if r.kept1 and not some1:
            named.append((values, load, r.kept0 < r.n0))
        elif r.n1:
            dropped.append(values)
        if r.n0 and not r.kept0 and not r.kept1:
            table.empty(load, values)
            named.append((values, load, True))
    whole = not named
    if parts:
        chosen = batch.sparkSession.createDataFrame(parts, "_date DATE, _record STRING, _side INT")
        again = _without_lost(rows, verdicts, F.broadcast(chosen), lost)
        own = table.load(_partitioned(again.select(*contract.EVENT_TYPE.fieldNames())))
        for values in {p[:2] for p in parts}:
            named.append((values, own, found[values].kept0 < found[values].n0))
    for values in [None] if whole else dropped:
        table.drop(load, values)
    table.commit(named, version)
    return count


def stamp_run(events: DataFrame, run_id: str) -> DataFrame:
    return events.withColumn("run_id", F.lit(run_id))


def of_run(events: DataFrame, run_id: str) -> DataFrame:
    return events.where(F.col("run_id") == run_id)
