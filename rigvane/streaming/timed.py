"""Stream twins whose rows wait for the watermark: typed state and event-time timers (`transformWithStateInPandas`).

A row is given out by a timer once no row that could change it can arrive; rows that are later than the watermark are left out by the engine before they
get here.  State of a key is bounded by what arrives between a row and the watermark.  The session needs the RocksDB state store (`needs_rocksdb`)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def needs_rocksdb(spark: SparkSession) -> None:
    """Sets the session's state store, which typed state and timers ask for."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def settled(state, timer_values) -> int | None:
    """The watermark in microseconds, or None if a key's rows have been worked on up to it: of all timers that one step of the watermark
    passes, the first does the work."""
    upto = timer_values.getCurrentWatermarkInMs() * 1000
    if state.exists() and state.get()[0] >= upto:
        return None
    state.update((upto,))
    return upto


class AsOf(StatefulProcessor):
    """Left rows wait in a list until the watermark has passed them; of right rows those that one of them, or a later one, may need are kept."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.left = handle.getListState("left", "us long, row string")
        self.right = handle.getListState("right", "us long, info string")
        self.upto = handle.getValueState("upto", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        p = pd.concat(rows)
        for side, state in ((1, self.left), (0, self.right)):
            own = p[p["side"] == side]
            if len(own):
                state.appendList([(int(t), v) for t, v in zip(own["us"], own["value"])])
            for t in set(own["us"] // 1000) if side else ():
                self.handle.registerTimer(int(t) + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = settled(self.upto, timerValues)
        if upto is None:
            return
        waiting, known = sorted(map(tuple, self.left.get())), sorted(map(tuple, self.right.get()))
        due = [x for x in waiting if x[0] < upto]
        if not due:
            return
        out, k = [], 0
        for us, row in due:
            while k < len(known) and known[k][0] <= us:
                k += 1
            out.append((*key, us, row, known[k - 1][1] if k else None))
        self.left.put(waiting[len(due) :]) if len(due) < len(waiting) else self.left.clear()
        # The last right row before what is given out still counts for what comes.
        if k > 1:
            self.right.put(known[k - 1 :])
        yield pd.DataFrame(out, columns=[*self.names, "us", "row", "info"])

    def close(self) -> None:
        pass


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, late: str) -> DataFrame:
    """A-3, A-4, D-2, D-4 on streams: (key, us, row, info): each left row (as JSON) with the last right row (as JSON, null if there is none) at or before it.

    at and right_at are timestamps.  A left row is given out when the watermark (`late` behind the newest row of both sides) has passed it, so it meets
    every right row that is not itself too late.  Of several right rows of one time the one whose JSON is largest counts."""
    side = lambda df, t, n: df.select(F.col(key), F.col(t).alias("ts"), F.unix_micros(t).alias("us"), F.lit(n).alias("side"), F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("value"))
    both = side(left, at, 1).unionByName(side(right, right_at, 0)).withWatermark("ts", late)
    schema = T.StructType([left.schema[key], T.StructField("us", T.LongType()), T.StructField("row", T.StringType()), T.StructField("info", T.StringType())])
    return both.groupBy(key).transformWithStateInPandas(AsOf([key]), schema, "append", "EventTime")


class PairNearest(StatefulProcessor):
    """Stamps of both sides wait in one list; a stamp is decided when everything within the slop of it has arrived."""

    def __init__(self, names: list[str], slop: int):
        self.names, self.slop = names, slop

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "us long, side int, decided boolean")
        self.upto = handle.getValueState("upto", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        p = pd.concat(rows)[["us", "side"]].drop_duplicates()
        self.seen.appendList([(int(t), int(s), False) for t, s in zip(p["us"], p["side"])])
        for t in set((p["us"] + self.slop) // 1000):
            self.handle.registerTimer(int(t) + 1)
        return iter([])

    def _nearest(self, us: int, others: list[int]) -> int | None:
        """The nearest of others within the slop, the earlier one if two are as near."""
        return min((o for o in others if abs(o - us) <= self.slop), key=lambda o: (abs(o - us), o), default=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = settled(self.upto, timerValues)
        if upto is None:
            return
        done: dict[tuple[int, int], bool] = {}
        for us, side, decided in map(tuple, self.seen.get()):
            done[us, side] = done.get((us, side), False) or decided
        of = [sorted(us for us, side in done if side == s) for s in (0, 1)]
        out = []
        for us, side in sorted(k for k, decided in done.items() if not decided and k[0] + self.slop < upto):
            done[us, side] = True
            other = self._nearest(us, of[1 - side])
            # The later one of a pair gives it out, so each pair comes once.
            if other is not None and done[other, 1 - side] and self._nearest(other, of[side]) == us:
                out.append((*key, us, other, abs(us - other)) if side == 0 else (*key, other, us, abs(us - other)))
        # A stamp can still be a neighbour, or compete for one, up to three times the slop.
        left = [(us, side, decided) for (us, side), decided in done.items() if us >= upto - 3 * self.slop - 1000 or not decided]
        self.seen.put(left) if left else self.seen.clear()
        yield pd.DataFrame(out, columns=[*self.names, "us_a", "us_b", "skew"])

    def close(self) -> None:
        pass


def pair_nearest(a: DataFrame, b: DataFrame, key: str, ts: str, slop_us: int, late: str) -> DataFrame:
    """D-1 on streams: (key, us_a, us_b, skew): messages at most the slop apart that are each other's nearest, ties to the earlier stamp; each message is in one
    pair at most.  A pair is given out when the watermark (`late` behind the newest row) is the slop past its later message.  Repeated stamps count once."""
    side = lambda df, n: df.select(F.col(key), F.col(ts).alias("ts"), F.unix_micros(ts).alias("us"), F.lit(n).alias("side"))
    both = side(a, 0).unionByName(side(b, 1)).withWatermark("ts", late)
    schema = T.StructType([a.schema[key], *(T.StructField(c, T.LongType()) for c in ("us_a", "us_b", "skew"))])
    return both.groupBy(key).transformWithStateInPandas(PairNearest([key], slop_us), schema, "append", "EventTime")


class Ring(StatefulProcessor):
    """The last frames of a rig as list state."""

    def __init__(self, key: str, size: int):
        self.key, self.size = key, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "frame long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        p = pd.concat(rows)
        ring = [int(x[0]) for x in self.ring.get()] if self.ring.exists() else []
        before, out = list(ring), []
        # A processed frame comes before the requests that arrive with it.
        order = p.assign(asks=p["ref_frame"].notna()).sort_values(["frame", "asks"], kind="stable")
        for frame, ref, asks in zip(order["frame"], order["ref_frame"], order["asks"]):
            if asks:
                out.append((*key, int(frame), int(ref), int(ref) in ring))
            else:
                ring = [*ring, int(frame)][-self.size :]
        if ring != before:
            self.ring.put([(x,) for x in ring])
        yield pd.DataFrame(out, columns=[self.key, "frame", "ref_frame", "available"])

    def close(self) -> None:
        pass


def history_ring(events: DataFrame, key: str, history: int) -> DataFrame:
    """J-8: (key, frame, ref_frame, available) of each request; events (key, frame, ref_frame: null for a processed frame, else a request that is looked up
    after that frame).  Typed state in place of text."""
    schema = T.StructType([events.schema[key], T.StructField("frame", T.LongType()), T.StructField("ref_frame", T.LongType()), T.StructField("available", T.BooleanType())])
    rows = events.select(key, F.col("frame").cast("long").alias("frame"), F.col("ref_frame").cast("double").alias("ref_frame"))
    return rows.groupBy(key).transformWithStateInPandas(Ring(key, max(2, history)), schema, "append", "None")
