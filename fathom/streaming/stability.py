"""Topic stability over a stream of snapshots, and sequence numbers of sessions, as keyed state with timers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Entropy and churn that are high, seconds of high entropy that call for consolidation, hours of churn that average, average below which topics are stable (fixed values).
HIGH_ENTROPY, HIGH_CHURN, HELD_SECONDS, AVERAGE_HOURS, STABLE = 0.7, 0.5, 300, 6, 0.2
#: The store that keyed state with timers needs; a session sets it before such a stream begins.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SNAPSHOT = "scope string, ts timestamp, churn double, average double, stable boolean, reason string"
_EPOCH = dt.datetime(1970, 1, 1)


def _ms(ts) -> int:
    ts = pd.Timestamp(ts)
    ts = ts.tz_convert("UTC").tz_localize(None) if ts.tzinfo else ts
    return int((ts.to_pydatetime() - _EPOCH) / dt.timedelta(milliseconds=1))


def _ts(ms: int) -> pd.Timestamp:
    return pd.Timestamp(_EPOCH + dt.timedelta(milliseconds=ms))


class Stability(StatefulProcessor):
    """For each scope the last snapshot's topics, the churns of the last hours, and since when entropy has been high.

    A snapshot gives its churn against the one before, and the average of AVERAGE_HOURS. It calls for consolidation (reason `churn`) if entropy
    and churn are high. A timer set when entropy gets high calls for it (reason `entropy`, once) when the watermark has passed HELD_SECONDS, or
    a snapshot that late comes first, unless entropy fell before: then the timer is deleted. Snapshots older than the last one are left out.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts long, topics array<string>")
        self.churns = handle.getListState("churns", "ts long, churn double")
        self.since = handle.getValueState("since", "ts long, told boolean")

    def _average(self, now: int) -> float:
        """The mean of what is within the hours; older churns leave the state."""
        held = [(t, c) for t, c in self.churns.get() if t >= now - AVERAGE_HOURS * 3_600_000]
        if held:
            self.churns.put(held)
        else:
            self.churns.clear()
        return sum(c for _, c in held) / len(held) if held else 0.0

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for row in pd.concat(rows).sort_values("ts").itertuples():
            now, topics = _ms(row.ts), sorted(set(() if row.topics is None else row.topics))
            before = self.last.get() if self.last.exists() else None
            if before is not None and now < before[0]:
                continue
            churn = None
            if before is not None:
                whole = set(topics) | set(before[1] or ())
                churn = len(set(topics) ^ set(before[1] or ())) / len(whole) if whole else 0.0
                self.churns.appendValue((now, churn))
            self.last.update((now, topics))
            average = self._average(now)
            high = row.entropy is not None and row.entropy > HIGH_ENTROPY
            since, told = self.since.get() if self.since.exists() else (None, False)
            due = None if since is None else since + HELD_SECONDS * 1000
            if due is not None and not told and now >= due:  # a snapshot says so before the watermark does
                out.append((key[0], _ts(due), None, average, average < STABLE, "entropy"))
                self.handle.deleteTimer(due)
                self.since.update((since, True))
            if high and since is None:
                self.since.update((now, False))
                self.handle.registerTimer(now + HELD_SECONDS * 1000)
            elif not high and since is not None:
                if not told and now < due:
                    self.handle.deleteTimer(due)
                self.since.clear()
            out.append((key[0], row.ts, churn, average, average < STABLE, "churn" if high and churn is not None and churn > HIGH_CHURN else None))
        yield pd.DataFrame(out, columns=["scope", "ts", "churn", "average", "stable", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        since, told = self.since.get() if self.since.exists() else (None, True)
        if not told and since + HELD_SECONDS * 1000 <= at:
            self.since.update((since, True))
            average = self._average(at)
            yield pd.DataFrame([(key[0], _ts(at), None, average, average < STABLE, "entropy")], columns=["scope", "ts", "churn", "average", "stable", "reason"])

    def close(self) -> None:
        pass


def stability(snapshots: DataFrame, late: str = "1 minute") -> DataFrame:
    """(scope, ts, churn, average, stable, reason) of a stream (scope, ts, entropy, topics); see Stability. The session's state store is STATE_STORE."""
    rows = snapshots.withWatermark("ts", late).groupBy("scope")
    return rows.transformWithStateInPandas(Stability(), SNAPSHOT, "append", "EventTime")


class Sequences(StatefulProcessor):
    """Numbers a session's memories from 1 on, in the order of (ts, id) within a batch; numbers go on over batches and restarts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.n = handle.getValueState("n", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(rows).sort_values(["ts", "id"])
        start = self.n.get()[0] if self.n.exists() else 0
        self.n.update((start + len(own),))
        yield pd.DataFrame({"session_id": key[0], "id": own["id"].to_numpy(), "ts": own["ts"].to_numpy(), "sequence": range(start + 1, start + 1 + len(own))})

    def close(self) -> None:
        pass


def sequences(memories: DataFrame) -> DataFrame:
    """(session_id, id, ts, sequence) of a stream (session_id, id, ts)."""
    return memories.groupBy("session_id").transformWithStateInPandas(Sequences(), "session_id string, id long, ts timestamp, sequence long", "append", "None")
