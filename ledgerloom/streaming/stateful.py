"""Keyed state in streams: following jobs live after their history, and a sliding log of each key's requests."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .jobs import TERMINAL

#: Parts of a followed stream's jobs that share their calls of state.
BUCKETS = 1024
FOLLOWED = "job_id long, seq long, occurred_at timestamp, state string, kind string"
DECISIONS = "event_id long, used long, allowed boolean, remaining long, retry_after_seconds long"


class JobFollower(StatefulProcessor):
    """Of each job: its new events in order, then done after a terminal one, or timeout when none came for so long.

    What a job has shown last is its state, so events that come again, after a restart or from a history that overlaps, are
    shown once. Jobs that are done show nothing more. A key is a bucket of jobs, whose state is read and written at once and whose
    events are swept together, since each call of Python's state costs more than a job's few events. A bucket has timers
    at the earliest end of its open jobs; when one runs out, the jobs that are due end and the next is set.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "jobs binary, timer_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        shown, timer = self._known()
        new = pd.concat(list(rows)).astype({"job_id": "Int64"}).sort_values(["job_id", "occurred_at", "seq"]).drop_duplicates(["job_id", "occurred_at"])
        new["us"] = new["occurred_at"].astype("datetime64[us]").astype("int64")
        new = new.merge(shown, "left", "job_id")
        new = new[new["at"].isna() | (new["us"] > new["at"]) & ~new["done"].eq(True)]
        new["ends"] = new["state"].isin(TERMINAL)
        ended = new.groupby("job_id", dropna=False)["ends"].cumsum() - new["ends"]
        new = new[ended == 0]
        if new.empty:
            return
        latest = new.drop_duplicates("job_id", keep="last")
        latest = pd.DataFrame({"job_id": latest["job_id"], "at": latest["us"].astype("Int64"), "done": latest["ends"]})
        self._keep(pd.concat([shown, latest]).drop_duplicates("job_id", keep="last"), timer)
        done = new[new["ends"]].assign(kind="done")
        yield _frame(pd.concat([new.assign(kind="event"), done]).sort_values(["job_id", "us", "kind"], ascending=[True, True, False]))

    def _known(self) -> tuple[pd.DataFrame, int | None]:
        """What the bucket's jobs have shown last (job_id, at in microseconds, done), and its earliest timer."""
        if not self.last.exists():
            return pd.DataFrame({"job_id": pd.array([], "Int64"), "at": pd.array([], "Int64"), "done": pd.array([], "bool")}), None
        jobs, timer = self.last.get()
        return pa.ipc.open_stream(jobs).read_pandas().astype({"job_id": "Int64", "at": "Int64"}), timer

    def _keep(self, shown: pd.DataFrame, timer: int | None) -> None:
        """Stores what was shown, with a timer at the earliest end of the open jobs where none is set so early."""
        due = self._due(shown["at"][~shown["done"].astype(bool)].min())
        if due is not None and (timer is None or due < timer):
            self.handle.registerTimer(due)
            timer = due
        table, sink = pa.Table.from_pandas(shown[["job_id", "at", "done"]].astype({"done": "bool"}), preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.last.update((sink.getvalue().to_pybytes(), timer))

    def _due(self, at) -> int | None:
        return None if pd.isna(at) else int(at) // 1000 + self.timeout_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        shown, timer = self._known()
        late = ~shown["done"].astype(bool) & (shown["at"] // 1000 + self.timeout_ms <= timerValues.getCurrentWatermarkInMs()).astype(bool)
        ran_out = timer is not None and timer <= expiredTimerInfo.getExpiryTimeInMs()
        if not late.any() and not ran_out:
            return
        shown["done"] = shown["done"].astype(bool) | late
        self._keep(shown, None if ran_out else timer)
        if late.any():
            ended = shown[late]
            yield _frame(pd.DataFrame({"job_id": ended["job_id"], "seq": None, "occurred_at": pd.to_datetime(ended["at"].astype("int64"), unit="us"), "state": None, "kind": "timeout"}))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        shown, timer = self._known()
        rows = initialState.astype({"job_id": "Int64"}).sort_values("occurred_at").drop_duplicates("job_id", keep="last")
        at = rows["occurred_at"].astype("datetime64[us]").astype("int64").astype("Int64")
        rows = pd.DataFrame({"job_id": rows["job_id"], "at": at, "done": rows["state"].isin(TERMINAL)})
        self._keep(pd.concat([shown, rows]), timer)

    def close(self) -> None:
        pass


def _frame(rows: pd.DataFrame) -> pd.DataFrame:
    return rows[["job_id", "seq", "occurred_at", "state", "kind"]].astype({"seq": "Int64"})


def last_shown(history: DataFrame) -> DataFrame:
    """job_id, occurred_at and state of each job's latest event, from which followed_jobs() goes on."""
    from pyspark.sql import functions as F

    latest = history.groupBy("job_id").agg(F.max(F.struct("occurred_at", "seq", "state")).alias("e"))
    return latest.select("job_id", "e.occurred_at", "e.state")


def followed_jobs(events: DataFrame, history: DataFrame | None = None, timeout_ms: int = 600_000, delay: str = "10 minutes") -> DataFrame:
    """A stream of events (job_id, seq, occurred_at, state) as JobFollower shows it; history: what was shown before the stream began.

    A job's timer runs in the time of the events: it ends when the watermark has passed its last event by timeout_ms. Jobs share
    the calls of state in BUCKETS parts by a hash, a number that belongs to the checkpoint.
    """
    from pyspark.sql import functions as F

    bucket = F.when(F.col("job_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS))).alias("bucket")
    first = last_shown(history).select(bucket, "*").groupBy("bucket") if history is not None else None
    keyed = events.withWatermark("occurred_at", delay).select(bucket, "job_id", "seq", "occurred_at", "state").groupBy("bucket")
    return keyed.transformWithStateInPandas(JobFollower(timeout_ms), FOLLOWED, "Append", "EventTime", first)


class SlidingLog(StatefulProcessor):
    """Decides each request of a key by the requests of the window before it, refused ones included."""

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("log", "at_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        log = sorted(x[0] for x in self.log.get())
        made, begin = [], 0
        for e in new.itertuples():
            at = e.ts.value // 1000
            bisect.insort(log, at)
            end = bisect.bisect_right(log, at)
            begin = bisect.bisect_right(log, at - self.window_us, 0, end)
            used = end - begin
            allowed = used <= self.limit
            made.append((e.event_id, used, allowed, max(self.limit - used, 0), 0 if allowed else self.window_us // 1_000_000))
        kept = log[bisect.bisect_right(log, log[-1] - self.window_us) :]
        self.log.put([(x,) for x in kept])
        yield pd.DataFrame(made, columns=[f.split(" ")[0] for f in DECISIONS.split(", ")])

    def close(self) -> None:
        pass


def rate_decisions(requests: DataFrame, key: str, limit: int = 30, window_seconds: int = 60) -> DataFrame:
    """A decision for each request (key, event_id, ts) of a stream: how many the key's window holds with it, whether it is allowed,
    how many are left, and how long to wait.

    Refused requests count too. Only the times within a window of a key's newest request are kept, so state is bounded by what
    a window holds; a request that is older than that is counted against what is kept.
    """
    return requests.select(key, "event_id", "ts").groupBy(key).transformWithStateInPandas(SlidingLog(limit, window_seconds * 1_000_000), DECISIONS, "Append", "None")
