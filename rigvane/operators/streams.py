"""Message streams as tables: pairing, as-of joins, bundling, queues, late corrections, rates and slot life cycles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import rate
from ..plans.store import cut
from .ordered import in_order, numbered, previous, running_sum, states_before, with_carry
from .quantiles import with_quantiles

#: Width of the buckets that histories are cut into, unless said otherwise: a day in microseconds.
DAY_US = 86_400_000_000


def pair_nearest(a: DataFrame, b: DataFrame, keys: list[str], slop: int, stamp: str = "stamp_ns") -> DataFrame:
    """D-1: pairs of messages (a, b) at most `slop` apart that are each other's nearest; ties go to the earlier stamp.

    Times are cut into slots of slop length: a message looks into its own and the two next slots, so the join is one of equality."""
    slot = lambda c: F.expr(f"(`{c}` - pmod(`{c}`, {int(slop)}L)) div {int(slop)}L")  # noqa: E731  (whole numbers: stamps in ns are no doubles)
    left = a.select(*keys, F.col(stamp).alias("stamp_a")).withColumn("__s", F.explode(F.array(slot("stamp_a") - 1, slot("stamp_a"), slot("stamp_a") + 1)))
    right = b.select(*keys, F.col(stamp).alias("stamp_b")).withColumn("__s", slot("stamp_b"))
    near = left.join(right, [*keys, "__s"]).withColumn("__d", F.abs(F.col("stamp_a") - F.col("stamp_b"))).where(F.col("__d") <= slop)
    best = near.withColumn("__a", F.min(F.struct("__d", "stamp_b")).over(Window.partitionBy(*keys, "stamp_a")))
    best = best.withColumn("__b", F.min(F.struct("__d", "stamp_a")).over(Window.partitionBy(*keys, "stamp_b")))
    return best.where((F.col("__a.stamp_b") == F.col("stamp_b")) & (F.col("__b.stamp_a") == F.col("stamp_a"))).select(*keys, "stamp_a", "stamp_b", F.col("__d").alias("skew"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, cols: list[str], how: str = "left", width: float = DAY_US) -> DataFrame:
    """A-3, A-4, D-2, D-4: each left row with the columns of the last right row at or before it (by key).

    Both sides are unioned, cut into buckets of `width` and sorted once in each; a running last value carries the right side on,
    and one row for each bucket carries it to the next, so no pairs are made and no task sorts a key's whole history.
    Of several right rows of one time the one with the largest columns counts."""
    l_cols = left.columns
    l_ = left.select(*l_cols, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(T.StructType([right.schema[c] for c in cols])).alias("__r"))
    r_ = right.select(*[F.col(k) for k in keys], *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in l_cols if c not in keys], F.col(right_at).alias("__t"), F.lit(0).alias("__side"), F.struct(*cols).alias("__r"))
    last = F.max(F.when(F.col("__side") == 0, F.struct("__t", "__r")))
    both = with_carry(l_.unionByName(r_), keys, ["__t"], width, last, "__carry")
    w = Window.partitionBy(*keys, "__b").orderBy("__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__r", F.coalesce(F.last("__r", ignorenulls=True).over(w), F.col("__carry.__r"))).where("__side = 1")
    out = out.where(F.col("__r").isNotNull()) if how == "inner" else out
    return out.select(*l_cols, *[F.col(f"__r.{c}").alias(c) for c in cols])


def bundle(packets: list[tuple[int, str, int]], views: list[str], slop: int, held: dict[str, int] | None = None) -> tuple[list[dict[str, int]], dict[str, int]]:
    """D-3, J-2: packets (arrival, view, stamp) in order; the newest of each view waits; if all views have one, they are a
    bundle if at most slop apart, else the view(s) with the oldest stamp are dropped.  The bundles, and what waits then."""
    held = dict(held or {})
    out = []
    for _, view, stamp in packets:
        held[view] = stamp
        while len(held) == len(views):
            low = min(held.values())
            if max(held.values()) - low <= slop:
                out.append(dict(held))
                held = {}
            else:
                held = {v: s for v, s in held.items() if s != low}
    return out, held


def bundles(messages: DataFrame, rig: str, views: list[str], slop: int) -> DataFrame:
    """D-3 in batch: (rig, n, first_ns, last_ns) of every bundle; messages (rig, view, stamp_ns, arrival)."""

    def start() -> Callable[[pd.DataFrame], pd.DataFrame]:
        held, n = {}, 0

        def step(p: pd.DataFrame) -> pd.DataFrame:
            nonlocal held, n
            got, held = bundle(list(zip(p["arrival"], p["view"], p["stamp_ns"].astype(int))), views, slop, held)
            n += len(got)
            return pd.DataFrame({rig: [p[rig].iloc[0]] * len(got), "n": range(n - len(got) + 1, n + 1), "first_ns": [min(b.values()) for b in got], "last_ns": [max(b.values()) for b in got]}).astype({"n": "int64"})

        return step

    schema = T.StructType([messages.schema[rig], T.StructField("n", T.LongType()), T.StructField("first_ns", T.LongType()), T.StructField("last_ns", T.LongType())])
    return in_order(messages.where(F.col("view").isin(views)).select(rig, "view", "stamp_ns", "arrival"), [rig], ["arrival", "view", "stamp_ns"], start, schema)


class Server:
    """J-1: a queue of `size` in front of one server that takes `service` for each message."""

    def __init__(self, service: int, size: int = 1, drop_when_busy: bool = True):
        self.service, self.size, self.drop = service, size, drop_when_busy
        self.queue: list[tuple[int, int]] = []
        self.free: int | None = None

    def _begin(self) -> tuple[int, int, str]:
        t, i = self.queue.pop(0)
        begin = t if self.free is None else max(self.free, t)
        self.free = begin + self.service
        return begin, i, "processed"

    def arrive(self, t: int, i: int) -> list[tuple[int, int, str]]:
        """What happens until message i waits: (time, id, processed | evicted | rejected)."""
        out = []
        while self.queue and (self.free is None or self.free <= t):
            out.append(self._begin())
        if len(self.queue) >= self.size:
            if not self.drop:
                return [*out, (t, i, "rejected")]
            out.append((t, self.queue.pop(0)[1], "evicted"))
        self.queue.append((t, i))
        return out

    def finish(self) -> list[tuple[int, int, str]]:
        return [self._begin() for _ in range(len(self.queue))]


def latest_wins(arrivals: list[tuple[int, int]], service: int, size: int = 1, drop_when_busy: bool = True) -> list[tuple[int, int, str]]:
    """J-1: arrivals (time, id) in order -> (time, id, processed | evicted | rejected)."""
    server = Server(service, size, drop_when_busy)
    return [x for t, i in arrivals for x in server.arrive(t, i)] + server.finish()


def queue_outcomes(messages: DataFrame, key: str, service: int, size: int = 1, drop_when_busy: bool = True) -> DataFrame:
    """J-1 in batch: what becomes of every message (key, id, t)."""
    # A last row for each key says that nothing comes any more; its id is not null, as pandas turns longs with nulls into floats.
    ends = messages.groupBy(key).agg(F.max("t").alias("t")).select(key, F.lit(0).cast("long").alias("id"), "t", F.lit(1).alias("__end"))
    rows = messages.select(key, F.col("id").cast("long").alias("id"), "t", F.lit(0).alias("__end")).unionByName(ends)

    def start() -> Callable[[pd.DataFrame], pd.DataFrame]:
        server = Server(service, size, drop_when_busy)

        def step(p: pd.DataFrame) -> pd.DataFrame:
            got = [x for t, i, end in zip(p["t"], p["id"], p["__end"]) for x in (server.finish() if end else server.arrive(int(t), int(i)))]
            return pd.DataFrame({key: [p[key].iloc[0]] * len(got), "id": [i for _, i, _ in got], "at": [t for t, _, _ in got], "outcome": [o for _, _, o in got]})

        return step

    return in_order(rows, [key], ["__end", "t", "id"], start, T.StructType([messages.schema[key], T.StructField("id", T.LongType()), T.StructField("at", T.LongType()), T.StructField("outcome", T.StringType())]))


def admit_corrections(corrections: DataFrame, history: int) -> DataFrame:
    """D-19, J-7, J-8: reason is null for an admitted correction (ref_frame before arrival_frame, and still in the history ring)."""
    h = max(2, history)
    reason = F.when(F.col("ref_frame") >= F.col("arrival_frame"), "reference_not_older_than_current").when(F.col("ref_frame") < F.col("arrival_frame") - h, "reference_feature_expired")
    return corrections.withColumn("reason", reason).withColumn("admitted", F.col("reason").isNull())


def history_ring(frames: DataFrame, requests: DataFrame, rig: str, history: int, width: float) -> DataFrame:
    """J-8: whether the frame that a request (rig, ref_frame, arrival_frame) refers to is in the ring of the last max(2, history)
    processed frames when its arrival frame is processed.  frames (rig, frame) lists the processed frames; their numbers may have gaps."""
    n = numbered(frames.select(rig, "frame").distinct(), [rig], ["frame"], width, "__n")
    at = lambda c: n.select(rig, F.col("frame").alias(c), F.col("__n").alias(f"__n_{c}"))
    both = requests.join(at("ref_frame"), [rig, "ref_frame"], "left").join(at("arrival_frame"), [rig, "arrival_frame"], "left")
    age = F.col("__n_arrival_frame") - F.col("__n_ref_frame")
    return both.withColumn("available", F.coalesce((age >= 0) & (age < max(2, history)), F.lit(False))).select(*requests.columns, "available")


def gaps(messages: DataFrame, keys: list[str], stamp: str, order: list[str], width: float = DAY_US) -> DataFrame:
    """F-8: gap to the stamp before in arrival order, and whether stamps went back or stood still."""
    part = previous(messages, keys, order, stamp, width, "__p")
    return part.withColumn("gap", F.when(F.col(stamp) > F.col("__p"), F.col(stamp) - F.col("__p"))).withColumn("non_monotonic", F.coalesce(F.col(stamp) <= F.col("__p"), F.lit(False))).drop("__p")


def rates(with_gaps: DataFrame, keys: list[str], stamp: str, scale: float, digits: int = 6) -> DataFrame:
    """E-15, J-12: count, rate by stamps, gap statistics and steps back, of each key group."""
    stat = lambda c, n: F.round(c, digits).alias(n)
    plain = with_gaps.groupBy(*keys).agg(
        F.count("*").alias("n"), stat(rate(F.count("*"), F.min(stamp), F.max(stamp), scale), "rate"), stat(F.avg("gap"), "gap_mean"), F.max("gap").alias("gap_max"), F.count_if("non_monotonic").alias("n_non_monotonic")
    )
    out = with_quantiles(plain, with_gaps, keys, [("gap_median", "gap", 0.5), ("gap_p95", "gap", 0.95)], digits)
    return out.select(*keys, "n", "rate", "gap_mean", "gap_median", "gap_p95", "gap_max", "n_non_monotonic")


def _with_stats(rows: DataFrame, keys: list[str], first: list[Column], values: dict[str, Column], last: list[Column], digits: int) -> DataFrame:
    """(keys, first, mean, median, 95 % quantile and maximum of each value, last) of each group."""
    ends = [x for n, v in values.items() for x in (F.round(F.avg(v), digits).alias(f"{n}_mean"), F.round(F.max(v), digits).alias(f"{n}_max"))]
    lead = rows.groupBy(*keys).agg(*first).columns
    plain = rows.groupBy(*keys).agg(*first, *ends, *last)
    out = with_quantiles(plain, rows, keys, [x for n, v in values.items() for x in ((f"{n}_median", v, 0.5), (f"{n}_p95", v, 0.95))], digits)
    middle = [f"{n}_{x}" for n in values for x in ("mean", "median", "p95", "max")]
    return out.select(*lead, *middle, *plain.columns[len(lead) + len(ends) :])


def rate_report(messages: DataFrame, keys: list[str], wall: str, stamp: str, order: list[str], window: int, scale: float, digits: int = 6) -> DataFrame:
    """E-15, J-12: for each key and report window (of `window` wall time, following the clock): count, rate by wall clock (count over the window's
    length) and by stamps, gaps by both clocks in ms (gaps begin anew in each window; scale: units of time in a second), and steps back of
    stamps, which are told from the last stamp seen, also one of an earlier window.  order begins with `wall`."""
    part = previous(messages, keys, order, stamp, window, "__p").withColumn("window", F.floor(F.col(wall) / window) * window)
    w = Window.partitionBy(*keys, "window").orderBy(*order)
    gap = lambda c: (F.col(c) - F.lag(c).over(w)) * F.lit(1000.0 / scale)
    part = part.withColumn("__w", gap(wall)).withColumn("__s", gap(stamp)).withColumn("__back", F.coalesce(F.col(stamp) <= F.col("__p"), F.lit(False)))
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    first = [
        F.count("*").alias("n"),
        F.round(F.count("*") * F.lit(scale / window), digits).alias("wall_rate"),
        F.round(rate(F.count("*"), F.min_by(stamp, F.struct(*order)), F.max_by(stamp, F.struct(*order)), scale), digits).alias("stamp_rate"),
    ]
    return _with_stats(part, [*keys, "window"], first, {"wall_gap": positive("__w"), "stamp_gap": positive("__s")}, [F.count_if("__back").alias("n_non_monotonic")], digits)


def sync_report(tuples: DataFrame, raw: DataFrame, dropped: DataFrame, keys: list[str], scale: float, digits: int = 6) -> DataFrame:
    """E-15, J-12: by key (with the report window among them): synchronized tuples (colour, depth, info stamps), the four skews in ms, the share of raw
    colour and depth messages that became tuples, and the share of tuples that were dropped.  raw (keys, colour, depth) and dropped
    (keys, dropped) are counts."""
    ms = lambda c: c * F.lit(1000.0 / scale)
    a, b, c = F.col("colour"), F.col("depth"), F.col("info")
    skews = {"colour_depth": F.abs(a - b), "colour_info": F.abs(a - c), "depth_info": F.abs(b - c), "tuple_span": F.greatest(a, b, c) - F.least(a, b, c)}
    own = _with_stats(tuples, keys, [F.count("*").alias("n")], {k: ms(v) for k, v in skews.items()}, [], digits)
    counts = raw.select(*keys, F.col("colour").alias("__colour"), F.col("depth").alias("__depth"))
    out = own.join(counts, keys, "left").join(dropped.select(*keys, F.col("dropped").alias("__dropped")), keys, "left")
    share = lambda part, of: F.round(F.lit(100.0) * part / F.greatest(F.lit(1), F.coalesce(of, F.lit(0))), digits)
    return out.select(
        *own.columns, share(F.col("n"), F.col("__colour")).alias("sync_colour_pct"), share(F.col("n"), F.col("__depth")).alias("sync_depth_pct"), share(F.coalesce("__dropped", F.lit(0)), F.col("n")).alias("drop_pct")
    )


def report_windows(messages: DataFrame, keys: list[str], ts: str, interval: str) -> DataFrame:
    """F-13: aligned tumbling windows (the intervals follow the clock, not the calls)."""
    return messages.groupBy(*keys, F.window(ts, interval).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.unix_micros(F.col("w.start").cast("timestamp")).alias("start_us"), "n")


def call_windows(messages: DataFrame, keys: list[str], ts: str, interval: int, width: float = DAY_US) -> DataFrame:
    """F-13 with windows that follow the calls: (keys, start, end, n) of each report.

    A report is due with the first message at least `interval` after the last report (or the first message), counts the messages since then, those of its own
    time included, and starts the next window; the last window, which no report has closed, has no end.  The windows of a key are a chain in which each start
    follows from the one before.  Every time gets a pointer to the time of the report that would follow it; in each round the starts known so
    far are followed by one pointer, and pointers are doubled, so a chain of n windows takes log2(n) rounds of joins, whatever the number of keys."""
    t = F.col(ts).cast("long")
    times = cut(messages.select(*keys, t.alias("t")).groupBy(*keys, "t").agg(F.count("*").alias("n")))
    # The first time at or after t + interval: the last one at or before it on a reversed axis.
    ahead = times.select(*keys, "t", (-(F.col("t") + interval)).alias("__at"))
    pointers = as_of(ahead, times.select(*keys, (-F.col("t")).alias("__to")), keys, "__at", "__to", ["__to"], "inner", width).select(*keys, "t", (-F.col("__to")).alias("to"))
    spans = times.groupBy(*keys).agg((F.max("t") - F.min("t")).alias("s"))
    most = (spans.agg(F.max("s")).first()[0] or 0) // interval + 1
    starts = times.groupBy(*keys).agg(F.min("t").alias("t"))
    pointers = cut(pointers)
    for k in range(int(most).bit_length()):
        starts = starts.union(starts.join(pointers, [*keys, "t"]).select(*keys, F.col("to").alias("t"))).distinct()
        pointers = pointers.join(pointers.select(*keys, F.col("t").alias("to"), F.col("to").alias("__next")), [*keys, "to"]).select(*keys, "t", F.col("__next").alias("to"))
        if k % 4 == 3:
            starts, pointers = cut(starts), cut(pointers)
    starts = cut(starts)
    # A message belongs to the window that began before it, the first of all to the first one.
    found = as_of(times.withColumn("__at", F.col("t") - 1), starts.select(*keys, F.col("t").alias("start")), keys, "__at", "start", ["start"], "left", width)
    counted = found.groupBy(*keys, F.coalesce("start", "t").alias("start")).agg(F.sum("n").alias("n"))
    ends = starts.select(*keys, F.col("t").alias("start"), F.lead("t").over(Window.partitionBy(*keys).orderBy("t")).alias("end"))
    return ends.join(counted, [*keys, "start"], "left").select(*keys, "start", "end", F.coalesce("n", F.lit(0)).alias("n"))


def running_totals(rows: DataFrame, keys: list[str], order: list[str], value: str, width: float = DAY_US) -> DataFrame:
    """F-12."""
    return running_sum(rows, keys, order, value, width, "total")


def missing_runs(states: DataFrame, keys: list[str], order: str, release_after: int, width: float = DAY_US) -> DataFrame:
    """F-10: length of the running stretch of lost frames, and whether the slot is released at this frame.

    A stretch that goes on from one bucket to the next is found as the number of frames since the last one that was not lost."""
    n = numbered(states, keys, [order], width, "__n")
    seen = F.max(F.when(F.col("status") != "lost", F.col("__n")))
    part = with_carry(n, keys, [order], width, seen, "__carry")
    own = F.max(F.when(F.col("status") != "lost", F.col("__n"))).over(Window.partitionBy(*keys, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    run = F.col("__n") - F.coalesce(own, F.col("__carry"), F.lit(0))
    return part.withColumn("missing_frames", run).withColumn("released", F.col("missing_frames") >= release_after).drop("__n", "__b", "__carry")


class Refresh:
    """J-5, J-6: when a refresh is due, and whether the one worker takes it.

    Nothing is due before min_gap frames have passed since the last accepted one; then an anomaly (a view without presence scores, or
    one below `least`) makes it due, or `every` frames.  The worker has one job at a time and gives its result back at the first
    frame `service` frames after it took the job; the clock starts again only when a job is taken."""

    def __init__(self, every: int, min_gap: int, least: float | None, state: tuple | None = None):
        self.every, self.min_gap, self.least = every, min_gap, least
        self.last, self.job, self.ready = state or (None, None, None)

    @property
    def state(self) -> tuple:
        return self.last, self.job, self.ready

    def frame(self, number: int, presence: float | None, service: int) -> tuple[int | None, str | None, bool]:
        """(reference frame of a result that arrives, reason why a refresh is due or null, whether the worker takes it)."""
        got = None
        if self.job is not None and number >= self.ready:
            got, self.job, self.ready = self.job, None, None
        since = None if self.last is None else number - self.last
        reason = None
        if since is None or since >= self.min_gap:
            if self.least is not None and (presence is None or presence < self.least):
                reason = "tracking_anomaly"
            elif since is None or since >= self.every:
                reason = "periodic"
        taken = reason is not None and self.job is None
        if taken:
            self.last, self.job, self.ready = number, number, number + service
        return got, reason, taken


def _number(x) -> float | None:
    return None if x is None or x != x else float(x)


def refreshes(frames: DataFrame, key: str, every: int, min_gap: int, least: float | None) -> DataFrame:
    """J-5, J-6 in batch: frames (key, frame, presence: the lowest of all views or null if one has none, service) ->
    (key, frame, result_of, reason, accepted)."""

    def start() -> Callable[[pd.DataFrame], pd.DataFrame]:
        clock = Refresh(every, min_gap, least)

        def step(p: pd.DataFrame) -> pd.DataFrame:
            got = [clock.frame(int(f), _number(x), int(s)) for f, x, s in zip(p["frame"], p["presence"], p["service"])]
            return pd.DataFrame({key: p[key].to_numpy(), "frame": p["frame"].to_numpy(), "result_of": pd.array([a for a, _, _ in got], "Int64"), "reason": [b for _, b, _ in got], "accepted": [c for _, _, c in got]})

        return step

    schema = T.StructType([frames.schema[key], T.StructField("frame", T.LongType()), T.StructField("result_of", T.LongType()), T.StructField("reason", T.StringType()), T.StructField("accepted", T.BooleanType())])
    return in_order(frames.select(key, F.col("frame").cast("long").alias("frame"), "presence", "service"), [key], ["frame"], start, schema)


class SlotLife:
    """J-3: a slot frame by frame.  A correction that gives the slot a detection activates it and clears its count; the frame of release
    still says lost; an inactive slot emits nothing."""

    def __init__(self, release_after: int, active: bool = True, missing: int = 0):
        self.release_after, self.active, self.missing = release_after, active, missing

    def frame(self, seen: bool, corrected: bool) -> tuple[str | None, int, bool]:
        """(emitted status or null, missing frames, active after it)."""
        if corrected and not self.active:
            self.active, self.missing = True, 0
        if not self.active:
            return None, self.missing, False
        self.missing = 0 if seen else self.missing + 1
        self.active = self.missing < self.release_after
        return "visible" if seen else "lost", self.missing, self.active


def slot_life(visible: list[bool], active: bool, release_after: int, corrections: dict[int, bool], missing: int = 0) -> list[tuple[int, str | None, int, bool]]:
    """J-3: (frame, emitted status or null, missing frames, active after it) of each frame."""
    slot = SlotLife(release_after, active, missing)
    return [(f, *slot.frame(seen, bool(corrections.get(f)))) for f, seen in enumerate(visible)]


def slot_lives(states: DataFrame, key: str, release_after: int, width: int = 10_000) -> DataFrame:
    """J-3, J-13 in batch: (key, frame, status, missing_frames, active); states (key, frame 0.., visible, corrected).

    A slot is an automaton: 0 .. release_after - 1 frames missed, or released (release_after).  A long history is worked on in buckets of `width` frames, side by side."""
    free = max(1, release_after)

    def moves(p: pd.DataFrame) -> np.ndarray:
        seen, corrected = (p[c].to_numpy(dtype=bool)[:, None] for c in ("visible", "corrected"))
        s = np.arange(free + 1)
        s = np.where((s == free) & corrected, 0, s)
        return np.where(s == free, free, np.where(seen, 0, s + 1))

    plain = states.select(key, F.col("frame").cast("long").alias("frame"), F.coalesce("visible", F.lit(False)).alias("visible"), F.coalesce("corrected", F.lit(False)).alias("corrected"))
    met = states_before(plain, [key], ["frame"], width, free + 1, moves, "__s")
    before = F.when((F.col("__s") == free) & F.col("corrected"), 0).otherwise(F.col("__s"))
    held, missing = before < free, F.when(before == free, before).when(F.col("visible"), 0).otherwise(before + 1)
    status = F.when(held, F.when(F.col("visible"), "visible").otherwise("lost"))
    return met.select(key, "frame", status.alias("status"), missing.cast("long").alias("missing_frames"), (held & (missing < free)).alias("active"))
