"""The step monitor: each executed step once, with what was detected in the window after it, or as a miss.

Steps and anomalies meet in a stateful processor that is keyed by host and time cell, so the events of a busy
host lie in many keys.  A step belongs to the cell of its time.  An anomaly goes to its own cell, and also to
the cell before it if a window from there can still reach it.  A step leaves the state when the watermark
has passed the end of its window, a cell when no window from it is open any more.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from embertrace import fixed_values as fv
from embertrace.operators.coverage import step_report
from embertrace.session import setting, ship_package
from embertrace.streaming.detections import new_steps

CELL_SECONDS = 6 * 3600
_MICROS = 1_000_000
_STEP_DDL = "link_id string, technique_id string, ability_name string, at bigint"
_HIT_DDL = "at bigint, score double, percentile double, alert_id string"
_FOUND_DDL = (
    "link_id string, technique_id string, ability_name string, host string, at bigint, "
    "n bigint, first_at bigint, best_at bigint, score double, percentile double, alert_id string"
)
_columns = lambda ddl: [part.split()[0] for part in ddl.split(", ")]
_FOUND_COLUMNS = _columns(_FOUND_DDL)


def _rows(frame: pd.DataFrame) -> tuple[list[tuple], list[tuple]]:
    """Steps and hits as rows of the state lists, in plain values."""
    lists = frame.to_dict("list")
    plain = lambda name: [None if v != v else v for v in lists[name]]
    rows = lambda ddl, chosen: [row for row, c in zip(zip(*[plain("micros" if n == "at" else n) for n in _columns(ddl)]), chosen) if c]
    asked = lists["is_step"]
    return rows(_STEP_DDL, asked), rows(_HIT_DDL, [not a for a in asked])


def _rank(hit: tuple) -> tuple:
    """Highest score first (none that is a number is above NaN), then the earliest; as the batch report ranks."""
    at, score, percentile, alert_id = hit
    return score is None, score or 0.0, -at, alert_id is not None, alert_id or "", percentile is not None, percentile or 0.0


class _RangeBest:
    """The best of any run of neighbours: for each power of two, the best of so many from each place on."""

    def __init__(self, ranks: np.ndarray):
        self.levels = [ranks]
        while (half := 1 << (len(self.levels) - 1)) * 2 <= len(ranks):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[:-half], last[half:]))

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The highest rank in ``first`` to ``end`` (exclusive), each of at least one place."""
        level = np.frexp((end - first).astype(float))[1] - 1
        best = np.empty(len(first), np.int64)
        for k in np.unique(level):
            here = level == k
            best[here] = np.maximum(self.levels[k][first[here]], self.levels[k][end[here] - (1 << k)])
        return best


class StepMonitor(StatefulProcessor):
    """Holds the open steps and the anomalies of one host and cell.

    A batch sets two timers, however many steps it brings, and a timer closes every step whose window the watermark
    has passed: the anomalies of a cell are read and put in order once per batch, not once per step.
    """

    def __init__(self, span_seconds: int, cell_seconds: int = CELL_SECONDS):
        self.span = span_seconds * _MICROS
        self.cell = cell_seconds * _MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getListState("steps", _STEP_DDL)
        self.hits = handle.getListState("hits", _HIT_DDL)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        steps, hits = [], []
        for frame in rows:
            more_steps, more_hits = _rows(frame)
            steps += more_steps
            hits += more_hits
        if hits:
            self.hits.appendList(hits)
        if steps:
            self.steps.appendList(steps)
            self.handle.registerTimer(self._closes(steps))
        self.handle.registerTimer(self._last(key))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        steps = [tuple(s) for s in self.steps.get()] if self.steps.exists() else []
        due = [s for s in steps if self._closes([s]) <= now]
        if due:
            hits = [tuple(h) for h in self.hits.get()] if self.hits.exists() else []
            left = [s for s in steps if self._closes([s]) > now]
            if left:
                self.steps.put(left)
                self.handle.registerTimer(self._closes(left))
            else:
                self.steps.clear()
            yield self._closed(key[0], due, hits)
        if now >= self._last(key):
            self.steps.clear()
            self.hits.clear()

    def close(self) -> None:
        pass

    def _timer(self, micros: int) -> int:
        """The first millisecond after an instant."""
        return micros // 1000 + 1

    def _closes(self, steps: list[tuple]) -> int:
        """When the first of the windows has closed."""
        return self._timer(min(at for *_, at in steps) + self.span)

    def _last(self, key: Any) -> int:
        return self._timer((int(key[1]) + 1) * self.cell + self.span)

    def _closed(self, host: str, steps: list[tuple], hits: list[tuple]) -> pd.DataFrame:
        """Each step with the number, the first and the best of the anomalies in its window."""
        ranked = sorted(hits, key=_rank)
        times = np.array([h[0] for h in ranked], np.int64)
        order = np.argsort(times, kind="stable")
        times = times[order]
        at = np.array([s[3] for s in steps], np.int64)
        first, end = np.searchsorted(times, at, "left"), np.searchsorted(times, at + self.span, "right")
        n, best = end - first, np.full(len(steps), -1)
        best[n > 0] = _RangeBest(order).of(first[n > 0], end[n > 0])
        rows = [
            (*s, int(k), int(times[f]) if k else None, *(ranked[b] if k else (None,) * 4))
            for s, k, f, b in zip(steps, n, first, best)
        ]
        found = pd.DataFrame(rows, columns=[c for c in _FOUND_COLUMNS if c != "host"]).assign(host=host)
        return found[_FOUND_COLUMNS].astype({c: "Int64" for c in ("at", "n", "first_at", "best_at")})


def monitored_steps(
    steps: DataFrame,
    anomalies: DataFrame,
    window_seconds: int = fv.DETECTION_WINDOW_SECONDS,
    late: str = "10 minutes",
    cell_seconds: int = CELL_SECONDS,
) -> DataFrame:
    """Streams of steps and anomalies -> one row per step, with the columns of the batch report.

    A link reported by several polls counts once.  A step comes out, detected or missed, when both streams have
    passed the end of its window by ``late``.  Needs the state store that ``stateful`` chooses.
    """
    ship_package(steps.sparkSession)
    cell = cell_seconds * _MICROS
    span = window_seconds * _MICROS
    cell_of = lambda micros: F.floor(micros / F.lit(cell)).cast("bigint")
    nothing = lambda kind: F.lit(None).cast(kind)
    micros = F.unix_micros("executed_at")
    asked = new_steps(steps, late).select(
        "host", cell_of(micros).alias("cell"), F.col("executed_at").alias("at"), F.lit(True).alias("is_step"), micros.alias("micros"),
        "link_id", "technique_id", "ability_name",
        nothing("double").alias("score"), nothing("double").alias("percentile"), nothing("string").alias("alert_id"),
    )
    micros = F.unix_micros("event_ts")
    found = (
        anomalies.filter(F.col("host").isNotNull() & F.col("event_ts").isNotNull())
        .withWatermark("event_ts", late)
        .select(
            "host", F.explode(F.array_distinct(F.array(cell_of(micros - span), cell_of(micros)))).alias("cell"),
            F.col("event_ts").alias("at"), F.lit(False).alias("is_step"), micros.alias("micros"),
            nothing("string").alias("link_id"), nothing("string").alias("technique_id"), nothing("string").alias("ability_name"),
            F.col("score").cast("double").alias("score"), F.col("percentile").cast("double").alias("percentile"), "alert_id",
        )
    )
    closed = (
        asked.unionByName(found)
        .groupBy("host", "cell")
        .transformWithStateInPandas(StepMonitor(window_seconds, cell_seconds), _FOUND_DDL, "Append", "EventTime")
    )
    best = F.struct("score", (-F.col("best_at")).alias("before"), "alert_id", "percentile").alias("best")
    return step_report(
        closed.select(
            "link_id", "technique_id", "ability_name", "host", F.timestamp_micros("at").alias("executed_at"),
            F.nullif("n", F.lit(0)).alias("n"), "first_at", best,
        )
    )


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Settings under which a stream with a stateful processor is started.

    A stream keeps its number of state partitions for life; more than cores only cost commits.
    """
    partitions = "spark.sql.shuffle.partitions"
    few = min(int(spark.conf.get(partitions)), spark.sparkContext.defaultParallelism)
    store = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    with setting(spark, partitions, str(few)), setting(spark, "spark.sql.streaming.stateStore.providerClass", store):
        yield
