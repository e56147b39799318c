"""Structured Streaming variants of the curation operators.

The batch operators are DataFrame functions, so the stateless ones (clean,
redact) run unchanged on a streaming DataFrame. Stateful ones use the
streaming primitives: watermarked dedup, update-mode aggregation with a
``foreachBatch`` alert sink, ``transformWithState`` with an event-time buffer for
sequential credit admission, and watermarked tumbling windows for usage cost.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from refinery.operators import clean as cl
from refinery.operators import ledger as lg
from refinery.operators import redact as rd
from refinery.constants import FREE_CREDITS
from refinery.session import ship_package


def clean_stream(stream: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """Stateless: identical expressions to batch ``clean``."""
    return cl.clean(stream, rules)


def redact_stream(stream: DataFrame, fields=None, replacement: str = "[REDACTED]", mode: str = "all") -> DataFrame:
    """Stateless: identical expressions to batch ``redact`` (mode 'all' by default
    for pipelines, so no second PII pattern survives in a value)."""
    return rd.redact(stream, fields, replacement, mode)


def _event_time(stream: DataFrame, col: str) -> DataFrame:
    """Watermarks need TIMESTAMP; wall-clock TIMESTAMP_NTZ columns are read as
    UTC instants (the session time zone is UTC)."""
    if stream.schema[col].dataType.simpleString() == "timestamp_ntz":
        return stream.withColumn(col, F.col(col).cast("timestamp"))
    return stream


def dedup_stream(stream: DataFrame, keys: list[str], event_time: str, delay: str = "1 hour") -> DataFrame:
    """Drop repeats of ``keys`` seen within the watermark delay. The first row
    to *arrive* survives (batch dedup keeps the smallest ordering key instead);
    state for a key is dropped once the watermark passes it."""
    return _event_time(stream, event_time).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def balances_stream(ledger_stream: DataFrame) -> DataFrame:
    """Running per-key balance (use output mode 'update')."""
    return ledger_stream.groupBy("api_key").agg(F.sum("delta").cast("bigint").alias("balance"))


def low_balance_sink(subscriptions: DataFrame, out_path: str, threshold: int = lg.LOW_BALANCE):
    """``foreachBatch`` handler: keys whose updated balance is <= threshold are
    joined to their low_balance subscriptions and appended to ``out_path``.
    Rows carry the batch id, so a batch replayed after a failure can be
    de-duplicated by readers on (batch_id, api_key)."""
    subs = subscriptions.where(F.array_contains(F.from_json("events_json", "array<string>"), "low_balance")) \
        .select("api_key", "url")

    def handle(batch: DataFrame, batch_id: int) -> None:
        low = batch.where(F.col("balance") <= threshold)
        alerts = low.join(subs, "api_key").select(
            F.concat(F.substring("api_key", 1, 8), F.lit("...")).alias("api_key_masked"), "balance", "url",
            F.lit(batch_id).alias("batch_id"))
        alerts.write.mode("append").parquet(out_path)

    return handle


STREAM_SCHEMA = lg.ADMISSION_SCHEMA.replace("timestamp_ntz", "timestamp") + ", late boolean"
_EVENT = "event_id long, ts long, kind string, cost int, credits int"
_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def _millis(delay: str) -> int:
    """Length of "<number> second|minute|hour|day(s)"."""
    number, unit = delay.split()
    return int(float(number) * 1000 * _SECONDS[unit.rstrip("s")])


class _Admission(StatefulProcessor):
    """One key's balance and the events that wait for the watermark.

    An event is folded, in (ts, event_id) order, once the event time horizon (the highest
    time seen less ``delay``) has passed it; a timer folds what waits when no more rows of
    the key arrive. An event that comes after the horizon has passed its time would change
    decisions already given: it is returned as late, unfolded.
    """

    def __init__(self, late_ms: int, opening: int):
        self.late_ms, self.opening = late_ms, opening

    def init(self, handle) -> None:
        self.handle = handle
        self.balance = handle.getValueState("balance", "balance long")
        self.until = handle.getValueState("until", "until long")  # microseconds
        self.waiting = handle.getListState("waiting", _EVENT)

    def _rows(self, key, events: list[tuple], admitted, after, late: bool) -> pd.DataFrame:
        ids, ts, kinds, costs, credits = zip(*events)
        return pd.DataFrame({"api_key": key[0], "event_id": ids, "ts": pd.to_datetime(pd.Series(ts), unit="us", utc=True),
                             "kind": kinds, "cost": costs, "credits": credits, "admitted": admitted,
                             "balance_after": after, "late": late})

    def _fold(self, key, horizon: int) -> Iterator[pd.DataFrame]:
        """Waiting events up to ``horizon`` (microseconds), in order; the others wait on."""
        events = sorted(map(tuple, self.waiting.get()), key=lambda e: (e[1], e[0])) if self.waiting.exists() else []
        cut = bisect.bisect_right([e[1] for e in events], horizon)
        self.until.update((max(horizon, self.until.get()[0] if self.until.exists() else horizon),))
        if cut:
            ready, rest = events[:cut], events[cut:]
            balance = self.balance.get()[0] if self.balance.exists() else self.opening
            _, _, kinds, costs, credits = zip(*ready)
            ok, after, balance = lg.fold_admission(np.array(kinds, object), np.array(costs), np.array(credits), balance)
            self.balance.update((balance,))
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
            yield self._rows(key, ready, ok, after, False)
            events = rest
        if events:
            self.handle.registerTimer(max(events[0][1] // 1000 - self.late_ms, 0) + 1)

    def _horizon(self, timers) -> int:
        return (timers.getCurrentWatermarkInMs() + self.late_ms) * 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        horizon = self._horizon(timerValues)
        until = max(horizon, self.until.get()[0]) if self.until.exists() else horizon
        if timerValues.getCurrentWatermarkInMs() <= 0:
            until = horizon = -(1 << 62)  # no watermark yet
        for pdf in rows:
            ts = pdf["ts"].astype("datetime64[us, UTC]" if pdf["ts"].dt.tz is not None else "datetime64[us]").astype("int64")
            events = list(zip(pdf["event_id"].tolist(), ts.tolist(), pdf["kind"].tolist(),
                              pdf["cost"].fillna(0).astype(int).tolist(), pdf["credits"].fillna(0).astype(int).tolist()))
            late = [e for e in events if e[1] <= until]
            if late:
                yield self._rows(key, late, None, None, True)
            fresh = [e for e in events if e[1] > until]
            if fresh:
                self.waiting.appendList(fresh)
        yield from self._fold(key, horizon)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._fold(key, self._horizon(timerValues))

    def close(self) -> None:
        pass


def admission_stream(usage_stream: DataFrame, delay: str = "10 minutes", late_for: str = "1 hour",
                     opening: int = FREE_CREDITS) -> DataFrame:
    """Sequential admission in event time (append mode): the batch operator's decisions for every
    event that arrives at most ``delay`` behind the highest time seen, whatever the order of
    arrival and the cut into micro-batches. Later events come out with ``late`` true and no
    decision for ``late_for`` more; still older ones are dropped by the watermark (and counted
    in the query's progress). Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``). State per key: the balance and the
    events of the last ``delay``."""
    ship_package(usage_stream.sparkSession)
    late_ms = _millis(late_for)
    cols = _event_time(usage_stream.select("api_key", "event_id", "ts", "kind", "cost", "credits"), "ts")
    timed = cols.withWatermark("ts", f"{_millis(delay) + late_ms} milliseconds")
    return timed.groupBy("api_key").transformWithStateInPandas(
        _Admission(late_ms, opening), STREAM_SCHEMA, "Append", "EventTime")


def usage_cost_windows(usage_stream: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Credits charged per (tumbling window, tool); a window is emitted once the
    watermark passes its end (append mode)."""
    calls = _event_time(usage_stream.where(F.col("kind") != "purchase"), "ts").withWatermark("ts", delay)
    return calls.groupBy(F.window("ts", window).alias("w"), "tool").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("cost").cast("bigint").alias("credits")) \
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "tool", "calls", "credits")
