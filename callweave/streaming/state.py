"""What streams remember of a key: processors over keyed state, with event-time timers that clear it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000_000  # microseconds, the unit of all times kept in state

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(groups, processor: StatefulProcessor, schema: str) -> DataFrame:
    """``processor`` over the groups of a stream with a watermark.  Keyed state with timers needs the RocksDB store, which the session is set to."""
    groups._df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return groups.transformWithStateInPandas(processor, schema, "Append", "eventTime")


def _micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


def _fires(micros: int) -> int:
    """The first whole millisecond at which the watermark has passed a time."""
    return -(-micros // 1000)


class OpenWindows(StatefulProcessor):
    """Lets through the first row of each window of ``hours`` that a row opens for its (route, key); rows (request_id, route, ts, key) by bucket.

    A bucket holds the starts of all its keys' open windows as one value, so the store is asked once a bucket and batch, not for every key.
    """

    def __init__(self, hours: int):
        self.life = hours * HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "routes array<string>, keys array<string>, starts array<bigint>")

    def _held(self) -> dict[tuple[str | None, str], int]:
        if not self.open.exists():
            return {}
        routes, keys, starts = self.open.get()
        return dict(zip(zip(routes, keys), starts))

    def _hold(self, starts: dict[tuple[str | None, str], int]) -> None:
        if starts:
            self.open.update(([route for route, _ in starts], [key for _, key in starts], list(starts.values())))
            self.handle.registerTimer(_fires(min(starts.values()) + self.life))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Within a batch only the earliest row of each instant can open a window.
        firsts: dict[tuple[str | None, str], dict[int, str]] = {}
        for frame in rows:
            routes = frame["route"].astype(object).where(frame["route"].notna(), None)
            for route, name, at, own in zip(routes, frame["key"], _micros(frame["ts"]), frame["request_id"]):
                seen = firsts.setdefault((route, name), {})
                if at not in seen or own < seen[at]:
                    seen[at] = own
        starts, opened = self._held(), []
        for whose, seen in firsts.items():
            start = starts.get(whose)
            for at in sorted(seen):
                if start is None or at >= start + self.life:
                    start = at
                    opened.append((seen[at], whose[0], at, whose[1]))
            starts[whose] = start
        if opened:
            self._hold(starts)
            names, routes, times, keys = zip(*opened)
            yield pd.DataFrame({"request_id": names, "route": routes, "ts": pd.to_datetime(times, unit="us"), "key": keys})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Rows still to come lie after the watermark, so they would open a window of their own.
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = self._held()
        left = {whose: start for whose, start in held.items() if start + self.life > now}
        if len(left) < len(held):
            self._hold(left)
        yield from ()

    def close(self) -> None:
        pass


class ExpiringEntries(StatefulProcessor):
    """Answers lookups from the newest entry before them, if younger than ``days``; rows (key, ts, id, is_put) by key.

    Rows wait until the watermark has passed them and are then taken in order of time, lookups first among equals, so the answers
    don't depend on the order of arrival.
    """

    def __init__(self, days: int):
        self.life = days * 24 * HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "put bigint")
        self.waiting = handle.getListState("waiting", "ts bigint, is_put boolean, id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            fresh = list(zip(_micros(frame["ts"]), frame["is_put"].tolist(), frame["id"].tolist()))
            self.waiting.appendList(fresh)
            first = min([at for at, _, _ in fresh] + ([first] if first is not None else []))
        self.handle.registerTimer(_fires(first))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((tuple(row) for row in self.waiting.get()), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        entry = self.entry.get()[0] if self.entry.exists() else None
        due, later = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        answers = []
        for at, is_put, name in due:
            if is_put:
                entry = at
            else:
                answers.append((name, entry is not None and entry > at - self.life))
        if due:
            if later:
                self.waiting.put(later)
                self.handle.registerTimer(_fires(later[0][0]))
            else:
                self.waiting.clear()
        if entry is not None and entry + self.life <= now:
            self.entry.clear()
        elif entry is not None and due:
            self.entry.update((entry,))
            self.handle.registerTimer(_fires(entry + self.life))
        if answers:
            yield pd.DataFrame({"id": [name for name, _ in answers], "key": key[0], "hit": [hit for _, hit in answers]})

    def close(self) -> None:
        pass
