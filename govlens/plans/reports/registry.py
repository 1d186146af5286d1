"""Report registry: a report is a name, the records it reads and one function."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from govlens.operators.filters import base, moment, time_range


@dataclass(frozen=True)
class Report:
    key: str
    title: str
    records: tuple[str, ...]  # empty: all of them
    earliest: str  # default range
    build: Callable[..., DataFrame]
    source: str = "events"
    chart: bool = False  # its axis is the range, not the data

    def __call__(
        self,
        events: DataFrame,
        as_of: datetime,
        earliest: str | datetime | None = "default",
        latest: str | datetime | None = "now",
        provider: str | None = None,
    ) -> DataFrame:
        """The report at ``as_of``; ``earliest=None`` and ``latest=None`` mean all time."""
        begin = self.earliest if earliest == "default" else earliest
        range_ = {"start": moment(begin, as_of), "end": moment(latest, as_of)}
        over = {"over": range_} if self.chart else {}
        if self.source != "events":
            return self.build(time_range(events, as_of, begin, latest, "ts"), as_of, **over)
        record = self.records[0] if len(self.records) == 1 else None
        return self.build(base(events, record, provider, as_of, begin, latest), as_of, **over)


REPORTS: dict[str, Report] = {}


def report(key: str, title: str, *records: str, earliest: str = "-14d@d", source: str = "events", chart: bool = False):
    """Register ``f(events, as_of)`` under ``key``; a chart's also takes ``over``, its range."""

    def add(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        REPORTS[key] = Report(key, title, records, earliest, build, source, chart)
        return build

    return add


def run(key: str, events: DataFrame, as_of: datetime, **kwargs) -> DataFrame:
    return REPORTS[key](events, as_of, **kwargs)
