"""Structured Streaming twins of the stateful operators; each calls the function that its batch twin calls.

State is kept for each key (rig, or camera and slot) and is small: stamps, counters and ids, no pixels or points."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.crossframe import Memory
from ..operators.streams import Refresh, SlotLife, _number, bundle


def _ordered(batches: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    """A key's new rows of this micro-batch, in order."""
    return pd.concat(batches).sort_values(by)


def bundles(messages: DataFrame, views: list[str], slop_ns: int) -> DataFrame:
    """D-3, J-2: (rig, n, first_ns, last_ns); messages (rig, view, stamp_ns, arrival).  State: the newest stamp of each view."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n = json.loads(state.get[0]) if state.exists else [{}, 0]
        p = _ordered(batches, "arrival")
        got, held = bundle([(a, v, int(t)) for a, v, t in zip(p["arrival"], p["view"], p["stamp_ns"])], views, slop_ns, held)
        state.update((json.dumps([held, n + len(got)]),))
        yield pd.DataFrame([(key[0], n + k, min(b.values()), max(b.values())) for k, b in enumerate(got, 1)], columns=["rig", "n", "first_ns", "last_ns"])

    kept = messages.where(F.col("view").isin(views)).groupBy("rig")
    return kept.applyInPandasWithState(step, "rig string, n long, first_ns long, last_ns long", "held string", "append", GroupStateTimeout.NoTimeout)


def global_ids(frames: DataFrame) -> DataFrame:
    """J-4, F-9: (rig, frame, group_id, global_id).  frames has a row for each processed frame: groups as a JSON list of [group_id, label] and
    costs as a JSON list of [a, b, cost].  State: the frame before and the next id."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, fresh = json.loads(state.get[0]) if state.exists else [[], 1]
        memory = Memory({g: (i, label) for g, i, label in known}, fresh)
        rows = []
        for frame, groups, costs in _ordered(batches, "frame")[["frame", "groups", "costs"]].itertuples(index=False):
            rows += [(key[0], frame, g, i) for g, i in memory.frame([tuple(g) for g in json.loads(groups)], {(a, b): c for a, b, c in json.loads(costs)})]
        state.update((json.dumps([[(g, i, label) for g, (i, label) in memory.before.items()], memory.fresh]),))
        yield pd.DataFrame(rows, columns=["rig", "frame", "group_id", "global_id"])

    return frames.groupBy("rig").applyInPandasWithState(step, "rig string, frame long, group_id long, global_id long", "memory string", "append", GroupStateTimeout.NoTimeout)


def slot_lives(states: DataFrame, release_after: int) -> DataFrame:
    """J-3: (slot, frame, status, missing_frames, active); states (slot, frame, visible, corrected).  State: active and the missing count."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        slot = SlotLife(release_after, *(state.get if state.exists else (True, 0)))
        p = _ordered(batches, "frame")
        got = [slot.frame(bool(v), bool(c)) for v, c in zip(p["visible"], p["corrected"])]
        state.update((slot.active, slot.missing))
        yield pd.DataFrame({"slot": key[0], "frame": p["frame"].to_numpy(), "status": [s for s, _, _ in got], "missing_frames": [m for _, m, _ in got], "active": [a for *_, a in got]})

    return states.groupBy("slot").applyInPandasWithState(step, "slot string, frame long, status string, missing_frames long, active boolean", "active boolean, missing int", "append", GroupStateTimeout.NoTimeout)


def refreshes(frames: DataFrame, every: int, min_gap: int, least: float | None) -> DataFrame:
    """J-5, J-6: (rig, frame, result_of, reason, accepted); frames (rig, frame, presence, service).  State: the last accepted frame and the job."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock = Refresh(every, min_gap, least, tuple(json.loads(state.get[0])) if state.exists else None)
        p = _ordered(batches, "frame")
        got = [clock.frame(int(f), _number(x), int(s)) for f, x, s in zip(p["frame"], p["presence"], p["service"])]
        state.update((json.dumps(clock.state),))
        yield pd.DataFrame({"rig": key[0], "frame": p["frame"].to_numpy(), "result_of": pd.array([a for a, _, _ in got], "Int64"), "reason": [b for _, b, _ in got], "accepted": [c for _, _, c in got]})

    return frames.groupBy("rig").applyInPandasWithState(step, "rig string, frame long, result_of long, reason string, accepted boolean", "clock string", "append", GroupStateTimeout.NoTimeout)


def history_ring(events: DataFrame, history: int) -> DataFrame:
    """J-8: (rig, frame, ref_frame, available) of each request; events (rig, frame, ref_frame: null for a processed frame, else a request that is
    looked up after that frame).  State: the numbers of the last max(2, history) processed frames."""
    size = max(2, history)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring = list(json.loads(state.get[0])) if state.exists else []
        out = []
        # A processed frame comes before the requests that arrive with it.
        for frame, ref in pd.concat(batches).sort_values(["frame", "ref_frame"], na_position="first")[["frame", "ref_frame"]].itertuples(index=False):
            if ref != ref or ref is None:
                ring = [*ring, int(frame)][-size:]
            else:
                out.append((key[0], int(frame), int(ref), int(ref) in ring))
        state.update((json.dumps(ring),))
        yield pd.DataFrame(out, columns=["rig", "frame", "ref_frame", "available"])

    return events.groupBy("rig").applyInPandasWithState(step, "rig string, frame long, ref_frame long, available boolean", "ring string", "append", GroupStateTimeout.NoTimeout)


def corrections(stream: DataFrame, history: int) -> DataFrame:
    """D-19, J-7, J-8 on a stream: stateless, the reason is in the row."""
    from ..operators.streams import admit_corrections

    return admit_corrections(stream, history)


def report(messages: DataFrame, ts: str, interval: str, late: str) -> DataFrame:
    """F-13, J-12: counts by aligned window and stream; later rows than `late` are dropped by the watermark."""
    return messages.withWatermark(ts, late).groupBy(F.window(ts, interval), "stream").agg(F.count("*").alias("n"))


def pair_within(colour: DataFrame, depth: DataFrame, slop: str, late: str) -> DataFrame:
    """D-1 on streams: all pairs of a rig and camera within the slop (ts is the event time); state is bounded by the watermarks."""
    a = colour.withWatermark("ts", late).withColumnsRenamed({"ts": "ts_a"})
    b = depth.withWatermark("ts", late).withColumnsRenamed({"ts": "ts_b", "rig": "rig_b", "camera": "camera_b"})
    near = F.expr(f"ts_b between ts_a - interval {slop} and ts_a + interval {slop}")
    return a.join(b, (F.col("rig") == F.col("rig_b")) & (F.col("camera") == F.col("camera_b")) & near).select("rig", "camera", "ts_a", "ts_b")
