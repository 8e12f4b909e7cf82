"""The incident life cycle as a stateful stream over run rows, in event time.

Rows of a check may come in any order and in any micro-batch: they wait in state until the watermark has passed them and
are then taken in the order of their runs. What a check keeps is three numbers and the rows that the watermark has not
reached. Those wait together by spans of hours, so that a call of the state API takes many; a span in which a check has
more than a block of rows waits by hour. Rows are released place by place, so memory holds a block or an hour of a check.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "check_id bigint, run_id bigint, started_at timestamp_ntz, run_status string, kind string, episode int, occurrence_count int"
STATE = "failing boolean, episode int, failures int"
#: The rows of a place, as JSON (the state API of this Spark version takes no nested values); empty: they wait by hour.
PLACE, WAITING = "first bigint, hours int", "rows string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Microseconds of an hour; hours of a span, and rows above which a span waits by hour.
HOUR, SPAN, BLOCK = 3_600_000_000, 1024, 10_000
#: Statuses that move an incident; runs of others only move the watermark.
FAILING, TOLD = ("fail", "error"), ("fail", "error", "pass")
#: Microseconds, run and status.
Row = tuple[int, int, str]
_NAMES = ["check_id", "run_id", "started_at", "run_status", "kind", "episode", "occurrence_count"]


class IncidentProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("incident", STATE)
        self._waiting = handle.getMapState("waiting", PLACE, WAITING)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        earliest = None
        for part in rows:
            spans: dict[int, list[Row]] = {}
            for at, run, status in zip(part["at"], part["run_id"], part["status"], strict=True):
                if status in TOLD and at == at:
                    spans.setdefault(int(at) // HOUR // SPAN * SPAN, []).append((int(at), int(run), status))
                    earliest = int(at) if earliest is None else min(earliest, int(at))
            for first, own in spans.items():
                self._wait(first, own)
        if earliest is not None:
            self._handle.registerTimer(earliest // 1000)
        yield from ()

    def _wait(self, first: int, rows: list[Row]) -> None:
        """Add rows of a span to those that wait."""
        found = self._waiting.getValue((first, SPAN))
        if found is None or found[0]:
            rows = rows if found is None else json.loads(found[0]) + rows
            if len(rows) <= BLOCK:
                self._waiting.updateValue((first, SPAN), (json.dumps(rows),))
                return
            self._waiting.updateValue((first, SPAN), ("",))
        hours: dict[int, list[Row]] = {}
        for row in rows:
            hours.setdefault(row[0] // HOUR, []).append(row)
        for hour, own in hours.items():
            found = self._waiting.getValue((hour, 1))
            self._waiting.updateValue((hour, 1), (json.dumps(own if found is None else json.loads(found[0]) + own),))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        split, end = [], None
        for first, hours in sorted(tuple(k) for k in self._waiting.keys()):  # noqa: SIM118
            text = self._waiting.getValue((first, hours))[0]
            if not text:
                split.append(first)
                continue
            held = [tuple(r) for r in json.loads(text)]
            ripe = sorted(r for r in held if r[0] // 1000 <= mark)
            later = [r for r in held if r[0] // 1000 > mark]
            if ripe:
                yield from self._fold(key[0], ripe)
            if not later:
                self._waiting.removeKey((first, hours))
                continue
            if ripe:
                self._waiting.updateValue((first, hours), (json.dumps(later),))
            # Places come in order, so this is the earliest row that still waits.
            self._handle.registerTimer(min(r[0] for r in later) // 1000)
            end = first
            break
        for first in split:
            if end is None or first + SPAN <= end:
                self._waiting.removeKey((first, SPAN))

    def _fold(self, check: int, rows: list[Row]) -> Iterator[pd.DataFrame]:
        failing, episode, failures = self._state.get() or (False, 0, 0)
        out = []
        for at, run_id, status in rows:
            if status in FAILING:
                kind, episode, failures = ("occurred", episode, failures + 1) if failing else ("opened", episode + 1, failures + 1)
                failing = True
            elif failing:
                kind, failing = "recovered", False
            else:
                continue
            out.append((check, run_id, pd.Timestamp(at, unit="us"), status, kind, episode, failures))
        if out:
            self._state.update((bool(failing), int(episode), int(failures)))
            yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


def incident_stream(runs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Incident events of a stream of ``(check_id, run_id, started_at, status)``, in the order of the runs.

    A run counts once the watermark (the latest start seen, less ``delay``) has passed it; one that comes later than that
    is dropped. Runs without a status that matters move the watermark, too. Needs the RocksDB state store.
    """
    started = F.col("started_at").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), started)
    timed = runs.select("check_id", "run_id", micros.alias("at"), F.timestamp_micros(micros).alias("event_time"), "status").withWatermark("event_time", delay)
    return timed.groupBy("check_id").transformWithStateInPandas(statefulProcessor=IncidentProcessor(), outputStructType=EVENTS, outputMode="Append", timeMode="EventTime")
