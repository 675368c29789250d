"""The order timeline as a stateful stream: what is known of each order's six times, and their durations."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orderlake.operators.gold import DURATIONS, STAGES

OUT = "order_id string, " + ", ".join(f"{s} timestamp" for s in STAGES) + ", " + ", ".join(f"{d} int" for d in DURATIONS)
#: A bucket's orders and, in their order, what is known of them: arrays of 64 bits.
STATE = "orders array<string>, known binary, open binary, seen binary, ticks binary, woken binary"
SIXTY_DAYS = 60 * 86_400_000
#: What a timeout adds to the stages that are open.
STEP_SECONDS = 7200
#: The durations of which an open stage may grow.
OPEN = ["purchase_to_approval_days", "approval_to_carrier_days", "carrier_to_customer_days"]
#: Groups of orders that share a state, so that a call works on many orders at once.
BUCKETS = 1024
#: A time that isn't known, in microseconds: numpy's NaT.
NONE = np.iinfo(np.int64).min


def days(late, early):
    """Whole days of 24 hours, rounded down, of two times or of arrays of them."""
    return (late - early) // np.timedelta64(1, "D")


class Orders:
    """The orders of a bucket: known times in microseconds and seconds of open stages (a column for each stage), the clock's
    milliseconds of the last event, the timeouts since then, and when the order was last worked on."""

    def __init__(self, held: tuple | None):
        n = len(STAGES)
        orders, *arrays = held if held else ([], b"", b"", b"", b"", b"")
        self.at = {o: i for i, o in enumerate(orders)}
        self.known, self.seen, self.ticks, self.woken = (np.frombuffer(arrays[i], np.int64).copy() for i in (0, 2, 3, 4))
        self.known, self.open = self.known.reshape(-1, n), np.frombuffer(arrays[1], np.float64).reshape(-1, n).copy()

    def places(self, ids: pd.Series) -> np.ndarray:
        """The rows of orders; new ones are added."""
        rows = np.fromiter((self.at.setdefault(o, len(self.at)) for o in ids), np.int64, len(ids))
        more, n = len(self.at) - len(self.seen), len(STAGES)
        if more:
            self.known, self.open = np.vstack([self.known, np.full((more, n), NONE)]), np.vstack([self.open, np.zeros((more, n))])
            self.seen, self.ticks, self.woken = (np.append(a, np.zeros(more, np.int64)) for a in (self.seen, self.ticks, self.woken))
        return rows

    def packed(self, stay: np.ndarray) -> tuple:
        return ([o for o, s in zip(self.at, stay, strict=True) if s], *[np.ascontiguousarray(a[stay]).tobytes() for a in (self.known, self.open, self.seen, self.ticks, self.woken)])

    def rows(self, some: np.ndarray, seconds: bool) -> pd.DataFrame:
        known, open_, times = self.known[some], self.open[some], self.known[some].view("datetime64[us]")
        out = {"order_id": pd.Series([o for o, s in zip(self.at, some, strict=True) if s], dtype=object)} | {s: pd.Series(times[:, i]) for i, s in enumerate(STAGES)}
        for name, (a, b) in DURATIONS.items():
            i, j = STAGES.index(a), STAGES.index(b)
            both, grown = (known[:, i] != NONE) & (known[:, j] != NONE), (open_[:, i] // 86400).astype(np.int64)
            found = grown.copy()
            found[both] = days(times[both, i], times[both, j]).astype(np.int64)
            out[name] = pd.Series(found).astype("Int64").mask(~both & (open_[:, i] == 0))
        if seconds:
            out["open_seconds"] = pd.Series(np.where(known == NONE, open_, 0).sum(axis=1).astype(np.int64))
        return pd.DataFrame(out)


def timeline(events: DataFrame, keep: str = "max", open_stage_step_seconds: int = 0, timeout_ms: int = 1000, expire_ms: int | None = None, clock: str = "processing", seconds: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """A row per order and micro-batch that touched it (update mode). ``keep``: the latest time of a stage, as in batch, or
    the ``first``: the latest of the micro-batch that brought the first one. An order whose times are all known stays as it
    is, so that a repeated event changes nothing with ``first``.

    With a step, every timeout adds so many seconds to the stages that have begun and not ended, and emits the order again.
    An order without events for ``expire_ms`` (SIXTY_DAYS, say) is forgotten. The clock of both is the processing time, with
    which a stream doesn't end by itself, or the ``event`` time: the watermark on ``ingest_time``, so that state is bounded
    by it, timeouts are due every ``timeout_ms`` from the order's last event on, up to its expiry, however many fall into a
    micro-batch, and a stream over what there is ends. ``seconds`` adds the seconds of open stages, ``open_seconds``.

    Orders are dealt by hash into so many ``buckets``, each a group with one state: calls and state rows are bounded by the
    buckets, and a bucket's orders are worked on as arrays. A bucket's timer is its orders' earliest."""
    by_event, n = clock == "event", len(STAGES)
    ends = [(STAGES.index(end), STAGES.index(begin)) for end, begin in (DURATIONS[name] for name in OPEN)]
    if by_event:
        events = events.withColumn("ingest_ms", F.unix_millis("ingest_time"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        warnings.filterwarnings("ignore", "The behavior of DataFrame concatenation", FutureWarning)  # of empty rows, in Spark's serializer
        now = state.getCurrentWatermarkMs() if by_event else state.getCurrentProcessingTimeMs()
        o = Orders(state.get if state.exists else None)
        new, touched = np.full((len(o.at), n), NONE), np.zeros(len(o.at), bool)
        for frame in () if state.hasTimedOut else frames:
            rows = o.places(frame["order_id"])
            more = len(o.at) - len(touched)
            new, touched = np.vstack([new, np.full((more, n), NONE)]), np.append(touched, np.zeros(more, bool))
            touched[rows] = True
            if by_event:
                np.maximum.at(o.seen, rows, frame["ingest_ms"].to_numpy(np.int64))
            stage = frame["data_type"].map({s: i for i, s in enumerate(STAGES)}).fillna(-1).to_numpy(np.int64)
            np.maximum.at(new, (rows[stage >= 0], stage[stage >= 0]), frame["timestamp"].to_numpy("datetime64[us]").view(np.int64)[stage >= 0])
        if not by_event:
            o.seen[touched] = now
        o.ticks[touched] = 0
        better = (new != NONE) & ((o.known == NONE) | (new > o.known if keep == "max" else False))
        o.known[better], o.open[better] = new[better], 0.0

        waits = (o.known == NONE).any(axis=1) & bool(open_stage_step_seconds)
        over = ~touched & (now - o.seen >= expire_ms) if expire_ms is not None else np.zeros(len(touched), bool)
        said = touched.copy()
        if open_stage_step_seconds:
            if by_event:
                until = now if expire_ms is None else np.minimum(now, o.seen + expire_ms)
                times = np.where(~touched & waits, np.maximum(0, (until - o.seen) // timeout_ms - o.ticks), 0)
                said |= over
            else:
                times = (~touched & waits & ~over & (now - o.woken >= timeout_ms)).astype(np.int64)
            for end, begin in ends:
                o.open[:, end] += np.where((o.known[:, begin] != NONE) & (o.known[:, end] == NONE), times * open_stage_step_seconds, 0)
            o.ticks += times
            said |= times > 0
        o.woken[said] = now
        out = o.rows(said, seconds)

        stay = ~over
        if stay.any():
            state.update(o.packed(stay))
            due = [] if expire_ms is None else [o.seen[stay] + expire_ms]
            if open_stage_step_seconds and (stay & waits).any():
                ticking = stay & waits
                due.append(o.seen[ticking] + (o.ticks[ticking] + 1) * timeout_ms if by_event else o.woken[ticking] + timeout_ms)
            if due and by_event:  # it times out when the watermark is beyond what is set
                state.setTimeoutTimestamp(max(int(min(d.min() for d in due)) - 1, now + 1))
            elif due:
                state.setTimeoutDuration(max(1, int(min(d.min() for d in due)) - now))
        elif state.exists:
            state.remove()
        if len(out):
            yield out

    timed = open_stage_step_seconds or expire_ms is not None
    mode = GroupStateTimeout.NoTimeout if not timed else GroupStateTimeout.EventTimeTimeout if by_event else GroupStateTimeout.ProcessingTimeTimeout
    dealt = events.withColumn("bucket", F.pmod(F.xxhash64("order_id"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandasWithState(step, OUT + ", open_seconds long" * seconds, STATE, "update", mode)
