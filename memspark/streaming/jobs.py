"""Background jobs as streaming queries: time spans, sweeps, ingest, buffers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SPAN = "user_id long, start double, end double, n long, late long"
STATE = "start double, last double, session string, n long, late long, closed double"


def time_spans(stream: DataFrame, seconds: float, settle: float, watermark: str = "1 hour") -> DataFrame:
    """Closed spans of a stream with user_id, session, ts (time) and unit_id.

    A span closes when the session changes, when a row lies more than `seconds`
    after its start, or when event time has passed its last row by `settle`.
    The state of a user is one open span. Rows at or before the last closed
    span's end are late: they are counted on the next span and change nothing.
    """
    rows = stream.select("user_id", F.col("session").cast("string").alias("session"), "ts", "unit_id", (F.unix_micros("ts") / 1e6).alias("at")).withWatermark("ts", watermark)

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, session, n, late, closed = state.get if state.exists else (None, None, None, 0, 0, None)
        out = []
        if state.hasTimedOut:
            if n:
                out.append((key[0], start, last, n, late))
            start, closed, n, late = None, last if n else closed, 0, 0
        else:
            pdf = pd.concat(list(batches)).sort_values(["at", "unit_id"])
            for at, s in zip(pdf["at"], pdf["session"], strict=True):
                if (closed is not None and at <= closed) or (n and at < start):
                    late += 1
                elif n and s == session and at - start <= seconds:
                    last, n = max(last, at), n + 1
                else:
                    if n:
                        out.append((key[0], start, last, n, late))
                        closed, late = last, 0
                    start, last, session, n = at, at, s, 1
        state.update((start if n else 0.0, last or 0.0, session or "", n, late, closed if closed is not None else -1e18))
        if n:
            due = int((last + settle) * 1000) + 1
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SPAN.split(", ")])

    return rows.groupBy("user_id").applyInPandasWithState(step, SPAN, STATE, "append", GroupStateTimeout.EventTimeTimeout)


SETTLED = "user_id long, start double, end double, n long, closed_by string"
#: Length of a slice of event time, and rows of one user that are kept together, in the state of settled_spans().
SLICE, PART = 600, 1000


def settled_spans(stream: DataFrame, seconds: float, settle: float, watermark: str = "1 hour") -> DataFrame:
    """Closed spans (SETTLED) of a stream with user_id, session, ts (time) and unit_id, in the order of event time whatever the order of arrival.

    A span closes when the session changes or a row lies more than ``seconds``
    after its start (closed_by next), or when no row comes within ``settle``
    seconds of its last one (closed_by settled). Rows wait in one value of
    their user, of PART rows at most; what is beyond it waits in slices of event
    time. A user has one timer, at the end of the first slice with rows, and
    folds the slices that the watermark has passed, so rows of a task or batch
    are never held together: the state of a user has the open span, and a
    worker reads that value and one slice of one user at a time. Rows
    older than the watermark are dropped by the engine and told of by
    late_rows(). What is folded does not depend on how rows fall into batches.
    Rows without a time wait for ever, so they are left out; the session sets
    the state store to the one that keeps timers.
    """
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    size = SLICE * 1000

    def slice_of(row: tuple) -> int:
        return int(row[0] * 1000 // size)

    class Spans(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.open = handle.getValueState("open", "start double, last double, session string, n long")
            # due: when the user's timer fires; sliced: whether rows wait in slices as well
            self.waiting = handle.getValueState("waiting", "due long, sliced boolean, ats array<double>, ids array<long>, sessions array<string>")
            self.parts = handle.getMapState("parts", "slice long", "n int")
            self.held = handle.getMapState("held", "slice long, part int", "ats array<double>, ids array<long>, sessions array<string>")

        def handleInputRows(self, key, rows, timerValues):
            due, sliced, own = self.read()
            first = None
            for r in rows:
                own.append((r.at, r.unit_id, r.session))
                k = slice_of(own[-1])
                first = k if first is None or k < first else first
                if len(own) > PART:
                    self.put(own)
                    sliced, own = True, []
            if first is not None:
                if due is None or (first + 1) * size < due:
                    due = (first + 1) * size
                    self.handle.registerTimer(due)
                self.keep(due, sliced, own)
            return iter(())

        def read(self) -> tuple[int | None, bool, list]:
            found = self.waiting.get()
            return (found[0], found[1], [*zip(*found[2:], strict=True)]) if found else (None, False, [])

        def keep(self, due: int, sliced: bool, rows: list) -> None:
            self.waiting.update((due, sliced, *(map(list, zip(*rows, strict=True)) if rows else ([], [], []))))

        def put(self, rows: list) -> None:
            by_slice: dict[int, list] = {}
            for r in rows:
                by_slice.setdefault(slice_of(r), []).append(r)
            for k, own in by_slice.items():
                n = self.parts.getValue((k,))[0] if self.parts.containsKey((k,)) else 0
                self.held.updateValue((k, n), tuple(map(list, zip(*own, strict=True))))
                self.parts.updateValue((k,), (n + 1,))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            due, sliced, waiting = self.read()
            if due is None or due > expiredTimerInfo.getExpiryTimeInMs():
                return  # a timer that an earlier one has stood in for
            past = timerValues.getCurrentWatermarkInMs() // size  # slices before this one are whole
            start, last, session, n = self.open.get() or (0.0, 0.0, None, 0)
            whole: dict[int, list] = {}
            for r in waiting:
                if slice_of(r) < past:
                    whole.setdefault(slice_of(r), []).append(r)
            waiting = [r for r in waiting if slice_of(r) >= past]
            slices = [k for (k,) in self.parts.keys()] if sliced else []
            for k in sorted({*whole, *(k for k in slices if k < past)}):
                rows = whole.pop(k, [])
                if k in slices:
                    for part in range(self.parts.getValue((k,))[0]):
                        rows += zip(*self.held.getValue((k, part)), strict=True)
                        self.held.removeKey((k, part))
                    self.parts.removeKey((k,))
                for at, _, own in sorted(rows, key=lambda r: r[:2]):
                    if n and at - last >= settle:
                        yield Row(user_id=key[0], start=start, end=last, n=n, closed_by="settled")
                        n = 0
                    elif n and (own != session or at - start > seconds):
                        yield Row(user_id=key[0], start=start, end=last, n=n, closed_by="next")
                        n = 0
                    start, last, session, n = start if n else at, at, own, n + 1
            if n and (last + settle) * 1000 <= past * size:
                yield Row(user_id=key[0], start=start, end=last, n=n, closed_by="settled")
                n = 0
            left = [k for k in slices if k >= past]
            ends = [(k + 1) * size for k in (*left, *map(slice_of, waiting))]
            if n:
                self.open.update((start, last, session, n))
                ends.append(int(-(-(last + settle) * 1000 // size)) * size)
            else:
                self.open.clear()
            if ends:
                self.handle.registerTimer(min(ends))
                self.keep(min(ends), bool(left), waiting)
            else:
                self.waiting.clear()

        def close(self) -> None:
            pass

    timed = stream.where("ts is not null").withWatermark("ts", watermark)
    rows = timed.select("user_id", F.col("session").cast("string").alias("session"), "ts", F.col("unit_id").cast("long").alias("unit_id"), (F.unix_micros("ts") / 1e6).alias("at"))
    return rows.groupBy("user_id").transformWithState(Spans(), SETTLED, "append", "eventTime")


def session_windows(stream: DataFrame, gap: str, watermark: str = "1 hour") -> DataFrame:
    """Sessions that end after a gap of inactivity, for jobs that need no more."""
    w = stream.withWatermark("ts", watermark).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def late_rows(units: DataFrame, parents: DataFrame, window_start: float | None = None) -> DataFrame:
    """state of each unit against its user's derived parents: late at or before their watermark, outside a window, else pending. units: user_id, at; parents: user_id, span_end."""
    mark = parents.groupBy("user_id").agg(F.max("span_end").alias("mark"))
    out = F.lit(False) if window_start is None else F.col("at") < window_start
    state = F.when(F.coalesce(F.col("at") <= F.col("mark"), F.lit(False)), "late").when(out, "out_of_window").otherwise("pending")
    return units.join(mark, "user_id", "left").withColumn("state", state).drop("mark")


def ingested(stream: DataFrame, key: str = "payload_id", watermark: str = "1 day") -> DataFrame:
    """Payloads once each, however often they are submitted within the watermark."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


def drained(stream: DataFrame, table: str, checkpoint: str, mode: str = "append") -> None:
    """Write all that is there now and stop; a restart goes on from the checkpoint."""
    q = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def each_batch(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> None:
    """Run a job on every micro-batch (conversion, sweeps); apply has to be idempotent by batch number."""
    q = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def middle_to_long(units: DataFrame, limit: int) -> DataFrame:
    """The oldest working units that wait for conversion."""
    return units.where("tier = 'working' AND lifecycle = 'active'").orderBy("t_ingest", "unit_id").limit(limit)


def unmarked(units: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """Units that a run has not settled yet: running twice does nothing twice."""
    return units.join(marks.select(key), key, "left_anti")


def recorded(events: DataFrame) -> DataFrame:
    """Events with a request_id once each; the same id with another fingerprint is a conflict. Adds conflict."""
    g = events.groupBy("request_id").agg(F.min_by(F.struct(*[c for c in events.columns if c != "request_id"]), "seq").alias("x"), (F.min("fingerprint") != F.max("fingerprint")).alias("conflict"))
    return g.select("request_id", "x.*", "conflict")
