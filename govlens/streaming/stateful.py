"""Detections that keep keyed state of their own: silence, spikes, limits, top lists, sessions.

Each agrees with the scheduled run of the batch detection of its name: a run is answered
once the watermark has passed it, from state that no later row may change. State is small
by design: a time per vendor, nine daily sums per vendor, one record per user, measure and
interval between two runs. Rows shrink in the task that reads them before they reach a key, so a
vendor that sends everything costs its state one row per task and batch.

An operator is answered only when time moves on. All events move it: conditions stay above
the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from govlens.operators.filters import base
from govlens.plans.detections import DETECTIONS, _delta
from govlens.plans.reports.security import SIGN_IN
from govlens.streaming.ingest import ACTIVITY_DELAY, REPORT_DELAY

DAY = 86_400
_ALWAYS = "(_time >= TIMESTAMP '0001-01-01 00:00:00')"


def _stamps(values: list[int | None], unit: str = "s") -> pd.Series:
    moments = [pd.NaT if v is None else pd.Timestamp(int(v), unit=unit) for v in values]
    return pd.Series(moments, dtype="datetime64[us]")


def _texts(values: list[str]) -> pd.Series:
    return pd.Series(values, dtype=object)


def _combined(rows: DataFrame, keys: list[str], aggs: dict[str, str], schema: str) -> DataFrame:
    """Rows of a task aggregated by key, a batch of them at a time.

    ``aggs``: column -> Arrow's aggregate. The result is aggregated again behind it.
    """
    names = [*keys, *aggs]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                found = pa.Table.from_batches([batch]).group_by(keys).aggregate(list(aggs.items()))
                found = found.select([*keys, *(f"{c}_{how}" for c, how in aggs.items())])
                yield from found.rename_columns(names).to_batches()

    return rows.select(*names).mapInArrow(run, schema)


# --- ingestion stopped: a timer that runs without input ---------------------------


class Stopped(StatefulProcessor):
    """Fires when a vendor's newest event is older than the limit, again and again.

    The timer is one of processing time: it runs out while nothing comes in.
    """

    def __init__(self, limit: timedelta, again: timedelta):
        self.limit, self.again = (int(d.total_seconds() * 1000) for d in (limit, again))  # ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint")

    def _due(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """A vendor that is expected: it fires if it never sends anything."""
        self._due(timerValues.getCurrentProcessingTimeInMs() + self.limit)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        newest = max(int(part["us"].max()) for part in rows)
        if not self.last.exists() or newest > self.last.get()[0]:
            self.last.update((newest,))
            self._due(newest // 1000 + self.limit)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentProcessingTimeInMs()
        last = self.last.get()[0] if self.last.exists() else None
        self.handle.registerTimer(now + self.again)
        yield pd.DataFrame(
            {
                "vendor": _texts([key[0]]),
                "run_time": _stamps([now], "ms"),
                "last": _stamps([last], "us"),
                "lag_sec": [now / 1000 - (last or 0) / 1e6],
            }
        )

    def close(self) -> None:
        pass


def stopped(
    events: DataFrame,
    limit: timedelta = timedelta(hours=2),
    again: timedelta = DETECTIONS["d_stopped"].suppress,
    expected: DataFrame | None = None,
) -> DataFrame:
    """(vendor, run_time, last, lag_sec) as soon as a vendor has been silent for ``limit``.

    ``expected(vendor)`` names vendors to wait for that may not have sent anything yet.
    While it stays silent, a vendor fires again after each ``again``.
    """
    times = base(events, DETECTIONS["d_stopped"].record).selectExpr(
        "ai.vendor AS vendor", "unix_micros(_time) AS us"
    )
    newest = _combined(times.where("us IS NOT NULL"), ["vendor"], {"us": "max"}, "vendor string, us bigint")
    return newest.groupBy("vendor").transformWithStateInPandas(
        statefulProcessor=Stopped(limit, again),
        outputStructType="vendor string, run_time timestamp, last timestamp, lag_sec double",
        outputMode="Append",
        timeMode="ProcessingTime",
        initialState=None if expected is None else expected.groupBy("vendor"),
    )


# --- daily spend spike: the last days' sums -----------------------------------------


class Spike(StatefulProcessor):
    """Newest day against the days before it, at each scheduled run."""

    def __init__(self, offset: int, reach: int, n: int, factor: float):
        self.offset, self.reach, self.n, self.factor = offset, reach, n, factor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day bigint", "usd double, known bigint")
        self.next = handle.getValueState("next", "day bigint")

    def _run(self, day: int) -> int:
        """The run of a day, in seconds."""
        return day * DAY + self.offset

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        sums = pd.concat(list(rows)).groupby("day")[["usd", "known"]].sum()
        for day, usd, known in sums.itertuples():
            if self.days.containsKey((day,)):
                held = self.days.getValue((day,))
                usd, known = usd + held[0], known + held[1]
            self.days.updateValue((day,), (float(usd), int(known)))
        first = int(sums.index.min()) + 1
        if not self.next.exists() or first < self.next.get()[0]:
            self.next.update((first,))
            self.handle.registerTimer(self._run(first) * 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """All runs that the watermark has passed, however many became due at once."""
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        held = {day[0]: value for day, value in self.days.iterator()}
        day, found = self.next.get()[0] if self.next.exists() else None, []
        while day is not None and self._run(day) <= passed:
            seen = [held[d] for d in range(day - 1, day - 1 - self.reach, -1) if d in held]
            sums = [usd if known else None for usd, known in seen[: self.n + 1]]
            before = [usd for usd in sums[1:] if usd is not None]
            if before and sums[0] is not None:
                mean = sum(before) / len(before)
                if sums[0] > self.factor * mean:
                    found.append((key[0], self._run(day), sums[0], mean))
            # the next run that sees a day at all
            ahead = [d for d in held if d >= day - self.reach + 1]
            day = max(day + 1, min(ahead) + 1) if ahead else None
        for old in [d for d in held if day is None or d < day - self.reach]:
            self.days.removeKey((old,))
        if day is None:
            self.next.clear()
        else:
            self.next.update((day,))
            self.handle.registerTimer(self._run(day) * 1000)
        vendors, runs, usd, mean = zip(*found) if found else ((), (), (), ())
        yield pd.DataFrame(
            {
                "vendor": _texts(list(vendors)),
                "run_time": _stamps(list(runs)),
                "yesterday_usd": list(usd),
                "baseline_avg_usd": list(mean),
            }
        )

    def close(self) -> None:
        pass


def spend_spike(events: DataFrame, n: int = 7, factor: float = 1.5, delay: str = REPORT_DELAY) -> DataFrame:
    """(vendor, run_time, yesterday_usd, baseline_avg_usd) of runs that find a spike."""
    d = DETECTIONS["d_spike"]
    reach = int(d.earliest.removeprefix("-").removesuffix("d@d"))
    wanted = f"ai.record = '{d.record}' AND ai.vendor IS NOT NULL AND _time IS NOT NULL"
    daily = events.selectExpr(
        f"CASE WHEN {wanted} THEN ai.vendor END AS vendor",
        f"CASE WHEN {wanted} THEN unix_date(CAST(_time AS DATE)) END AS day",
        f"CASE WHEN {wanted} THEN coalesce(ai.cost.amount_usd, 0D) END AS usd",
        f"CASE WHEN {wanted} THEN CAST(ai.cost.amount_usd IS NOT NULL AS BIGINT) END AS known",
        "_time",
    )
    # Other events of a task become one row without a vendor, which only moves time.
    sums = _combined(
        daily,
        ["vendor", "day"],
        {"usd": "sum", "known": "sum", "_time": "max"},
        "vendor string, day int, usd double, known bigint, _time timestamp",
    )
    rows = sums.withWatermark("_time", delay).where(f"(vendor IS NOT NULL) = {_ALWAYS}")
    return rows.groupBy("vendor").transformWithStateInPandas(
        statefulProcessor=Spike(int(d.offset.total_seconds()), reach, n, factor),
        outputStructType="vendor string, run_time timestamp, yesterday_usd double, baseline_avg_usd double",
        outputMode="Append",
        timeMode="EventTime",
    )


# --- spend limit reached: the newest snapshot per user ------------------------------

_MEASURES = ("utilization_pct", "period_spend_usd", "spend_limit_usd")


# Users share keys of the state: what a key costs, it costs once for its part of all users.
BUCKETS = 1024
_RECORD = ["user", "measure", "run"]  # and the newest (collected, time, value) of it


class Limits(StatefulProcessor):
    """The newest snapshot of each user of a bucket at each scheduled run.

    Snapshots between two runs are in the same look-back windows, so they merge to one
    record: per measure the newest value there is, with its times. A bucket's records are
    one Arrow table, so users are worked on together.
    """

    def __init__(self, step: int, offset: int, reach: int, at_least: float):
        self.step, self.offset, self.reach, self.at_least = step, offset, reach, at_least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getValueState("slots", "records binary")
        self.next = handle.getValueState("next", "run bigint")

    def _held(self) -> list[pd.DataFrame]:
        if not self.slots.exists():
            return []
        with pa.ipc.open_stream(bytes(self.slots.get()[0])) as stream:
            return [stream.read_all().to_pandas()]

    def _hold(self, records: pd.DataFrame) -> None:
        table = pa.Table.from_pandas(records, preserve_index=False)
        sink = pa.BufferOutputStream()
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        with pa.ipc.new_stream(sink, table.schema, options=options) as stream:
            stream.write_table(table)
        self.slots.update((sink.getvalue().to_pybytes(),))

    @staticmethod
    def _newest(records: pd.DataFrame, by: list[str]) -> pd.DataFrame:
        """Per ``by`` the newest of (value, collected, time), ties to the greater value."""
        return records.sort_values(["collected", "time", "value"]).drop_duplicates(by, keep="last")

    def _records(self, rows: pd.DataFrame) -> pd.DataFrame:
        # the first run after the snapshot
        run = self.offset + (rows["collected"] // 1_000_000 - self.offset) // self.step * self.step + self.step
        wide = rows[["user", "collected", "time"]].assign(run=run)
        parts = [wide.assign(measure=k, value=rows[name].astype(float)) for k, name in enumerate(_MEASURES)]
        return self._newest(pd.concat(parts).dropna(subset="value"), _RECORD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        records = None
        for part in rows:
            new = self._records(part)
            records = new if records is None else self._newest(pd.concat([records, new]), _RECORD)
        if len(records):
            first = int(records["run"].min())
            self._hold(self._newest(pd.concat([*self._held(), records]), _RECORD))
            if not self.next.exists() or first < self.next.get()[0]:
                self.next.update((first,))
                self.handle.registerTimer(first * 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        run = self.next.get()[0] if self.next.exists() else None
        if run is None or run > passed:  # an earlier timer has answered it
            yield pd.DataFrame()
            return
        (held,) = self._held()
        found, oldest = [], self.reach - self.step  # a record's rows lie up to a step before its run
        while run is not None and run <= passed:
            seen = held[held["run"].between(run - oldest, run)]
            newest = self._newest(seen, ["user", "measure"]).pivot(index="user", columns="measure", values="value")
            newest = newest.reindex(columns=range(len(_MEASURES)))
            found.append(newest[newest[0] >= self.at_least].assign(run=run).reset_index())
            ahead = held.loc[held["run"] >= run + self.step - oldest, "run"]
            run = max(run + self.step, int(ahead.min())) if len(ahead) else None
        if run is None:
            self.next.clear()
            self.slots.clear()
        else:
            self.next.update((run,))
            self.handle.registerTimer(run * 1000)
            self._hold(held[held["run"] >= run - oldest])
        found = pd.concat(found)
        out = {"user": _texts(found["user"].tolist()), "run_time": _stamps(found["run"].tolist())}
        for k, name in enumerate(_MEASURES):
            out[name] = pd.Series(found[k].tolist(), dtype="float64")
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def limit_reached(events: DataFrame, at_least: float = 100, delay: str = ACTIVITY_DELAY) -> DataFrame:
    """(user, run_time, measures) of runs that find a user's newest snapshot at the limit.

    Time is the time of collection. A user's records go when no run can see them any more.
    Users are dealt over ``BUCKETS`` keys by hash; a task holds the records of one of them.
    """
    d = DETECTIONS["d_limit"]
    always = _ALWAYS.replace("_time", "collected_at")
    rows = events.withWatermark("collected_at", delay).where(
        f"(ai.record = '{d.record}' AND ai.actor.email IS NOT NULL) = {always}"
    )
    snapshots = rows.selectExpr(
        "ai.actor.email AS user",
        "ai.cost.utilization_pct AS utilization_pct",
        "ai.cost.spend_usd AS period_spend_usd",
        "ai.cost.limit_usd AS spend_limit_usd",
        "unix_micros(collected_at) AS collected",
        "coalesce(unix_micros(_time), 0L) AS time",
        "collected_at",
    )
    step, offset = (int(x.total_seconds()) for x in (d.period, d.offset))
    reach = int(_delta(d.earliest.removeprefix("-")).total_seconds())
    snapshots = snapshots.withColumn("bucket", F.pmod(F.xxhash64("user"), F.lit(BUCKETS)))
    return snapshots.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Limits(step, offset % step, reach, at_least),
        outputStructType="user string, run_time timestamp, "
        + ", ".join(f"{name} double" for name in _MEASURES),
        outputMode="Append",
        timeMode="EventTime",
    )


# --- top cost users: lists that merge -----------------------------------------------


def _best(rows: pd.DataFrame, size: int) -> pd.DataFrame:
    order = rows.sort_values(["run_time", "total_cost_usd", "user"], ascending=[True, False, True])
    return order.groupby("run_time", sort=False).head(size)


def top_cost(events: DataFrame, size: int = 20, delay: str = REPORT_DELAY) -> DataFrame:
    """(run_time, user, total_cost_usd): the ``size`` greatest of each closed window.

    Sums of a window are final when they are given out. Each task first keeps its own best
    of every window, so what meets per window are lists, not users.
    """
    d = DETECTIONS["d_topcost"]
    look_back = f"{int(_delta(d.earliest.removeprefix('-')).total_seconds())} seconds"
    step, offset = (int(x.total_seconds()) for x in (d.period, d.offset))
    rows = events.withWatermark("_time", delay).where(f"(ai.record = '{d.record}') = {_ALWAYS}")
    window = F.window("_time", look_back, f"{step} seconds", f"{offset % step} seconds").alias("window")
    sums = rows.groupBy(window, F.col("ai.actor.email").alias("user")).agg(
        F.sum("ai.cost.amount_usd").alias("total_cost_usd")
    )
    schema = "run_time timestamp, user string, total_cost_usd double"
    totals = sums.select(F.col("window.end").alias("run_time"), "user", "total_cost_usd")

    def shortened(parts: Iterator[pd.DataFrame]):
        kept = None
        for part in parts:
            known = part[part["user"].notna() & part["total_cost_usd"].notna()]
            kept = _best(known if kept is None else pd.concat([kept, known]), size)
        if kept is not None:
            yield kept

    lists = totals.mapInPandas(shortened, schema)
    return lists.groupBy("run_time").applyInPandas(lambda part: _best(part, size), schema)


# --- sign-in sessions -----------------------------------------------------------------


def sessions(events: DataFrame, gap: str = "2 hours", delay: str = ACTIVITY_DELAY) -> DataFrame:
    """Sign-in sessions per user, given out when the watermark has passed their end.

    State merges: a sign-in that lies between two open sessions joins them.
    """
    rows = base(events, "activity").withWatermark("_time", delay).where(f"({SIGN_IN}) = {_ALWAYS}")
    found = rows.groupBy(
        F.session_window("_time", gap).alias("session"), F.col("ai.actor.email").alias("user")
    ).agg(
        F.count("*").alias("count"),
        F.min("_time").alias("first_time"),
        F.max("_time").alias("last_time"),
    )
    return found.where("CASE WHEN count > 0 THEN user END IS NOT NULL").select(
        "user", "first_time", "last_time", "count"
    )
