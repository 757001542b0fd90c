"""Operators against small worked examples, brute force and the seeded geometry fixture."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import rigvane
from rigvane import __main__ as cli
from rigvane import tracker
from rigvane.operators import assign, crossframe, crossview, detect, geometry, masks, nearest, ordered, profile, streams, voxel
from rigvane.sources import frames


def test_optimal_assignment_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = rng.integers(1, 5, 2)
        cost = rng.random((n, m))
        cost[rng.random((n, m)) < 0.3] = assign.INVALID
        got = assign.optimal(cost)
        best = None
        wide = cost if n <= m else cost.T
        for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]):
            c = [wide[i, j] for i, j in enumerate(p)]
            key = (sum(x >= assign.INVALID for x in c), sum(x for x in c if x < assign.INVALID))
            best = min(best or key, key)
        assert len(got) == min(n, m) - best[0]
        assert sum(cost[i, j] for i, j in got) == pytest.approx(best[1])


def test_greedy_suppress_and_groups():
    assert assign.greedy([(0.9, 0, 1), (0.9, 1, 1), (0.5, 0, 2)]) == [(1, 1), (0, 2)]
    assert assign.suppress(4, {(0, 1): 0.9, (1, 2): 0.9}, 0.5, 2) == [0, 2]
    # Views conflict: 0 and 2 are in one view, so the weaker edge is refused.
    assert assign.constrained_groups([0, 1, 0], [(0.9, 0, 1), (0.8, 1, 2)]) == [1, 1, 2]


def test_capacity_bounds():
    assert [detect.capacity_pairs(2, [1, 1, 1]), detect.capacity_pairs(2, [3, 2, 1]), detect.capacity_pairs(1, [3, 2, 1])] == [12, 56, 14]
    with pytest.raises(ValueError):
        detect.parse_prompts(["a", ("a", 2)])
    with pytest.raises(ValueError):
        detect.parse_prompts([])


def test_components_are_eight_connected():
    y, x = np.array([0, 1, 1, 3, 4]), np.array([0, 1, 2, 0, 1])
    lab = masks.label_components(y, x)
    assert lab[0] == lab[1] == lab[2] != lab[3] and lab[3] == lab[4]
    rng = np.random.default_rng(1)
    grid = rng.random((12, 12)) < 0.4
    ys, xs = np.nonzero(grid)
    lab = masks.label_components(ys, xs)
    for i, j in itertools.combinations(range(len(ys)), 2):
        if max(abs(ys[i] - ys[j]), abs(xs[i] - xs[j])) == 1:
            assert lab[i] == lab[j]


def test_erosion_keeps_the_border_of_a_full_mask(spark):
    full = spark.range(20 * 20).select(F.lit(0).alias("k"), (F.col("id") % 20).cast("int").alias("x"), F.expr("cast(id div 20 as int)").alias("y"))
    assert masks.erode(full, ["k"], 2, 20, 20).count() == 400
    holed = full.where("not (x = 10 and y = 10)")
    assert masks.erode(holed, ["k"], 1, 20, 20).count() == 400 - 9
    assert masks.dilate(full.where("x = 0 and y = 0"), ["k"], 2, 20, 20).count() == 9


def test_depth_filter_edges(spark):
    rows = spark.createDataFrame([(float("nan"),), (float("inf"),), (0.0,), (0.0999,), (0.1,), (6.0,), (6.0001,), (None,)], "z double")
    assert sorted(r[0] for r in rows.where(geometry.valid_depth(F.col("z"))).collect()) == [0.1, 6.0]


def test_seeded_fixture_voxel_counts(spark):
    """Two cameras, three records each of 4,096 samples from a fixed seed; counts of distinct 1 cm voxels."""
    rng = np.random.default_rng(9)
    rows = []
    for view in range(2):
        for rec in range(3):
            xs, ys = rng.integers(40, 600, 4096), rng.integers(40, 440, 4096)
            z = rng.uniform(0.3, 1.8, 4096).astype(np.float32)
            rng.integers(0, 256, (4096, 3), dtype=np.uint8)
            rows += [(view * 3 + rec, view, i, int(a), int(b), float(c)) for i, (a, b, c) in enumerate(zip(xs, ys, z))]
    df = spark.createDataFrame(rows, "record int, view int, ord int, x int, y int, z double")
    p = geometry.back_project(F.col("x"), F.col("y"), F.col("z"), F.lit(615.3), F.lit(614.8), F.lit(319.5), F.lit(239.5))
    one, zero = F.lit(1.0), F.lit(0.0)
    w = geometry.rigid(p, [[one, zero, zero], [zero, one, zero], [zero, zero, one]], [F.col("view") * 0.15, F.col("view") * -0.03, F.lit(0.2)])
    v = df.select("record", "ord", *w).select("record", "ord", geometry.pack_key(*[geometry.quantize(F.col(f"w{a}"), 0.0, 0.01) for a in "xyz"]).alias("key"))
    got = voxel.first_wins(v, ["record", "key"], ["ord"], ["ord"]).groupBy("record").count()
    assert {r[0]: r[1] for r in got.collect()} == {0: 4077, 1: 4077, 2: 4079, 3: 4083, 4: 4082, 5: 4074}


def test_key_range_is_checked(spark):
    bad = spark.range(1).select(geometry.pack_key(F.lit(1 << 20).cast("bigint"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint")).alias("k"))
    with pytest.raises(Exception, match="out of range"):
        bad.collect()
    edge = spark.range(1).select(geometry.pack_key(F.lit((1 << 20) - 1).cast("bigint"), F.lit(-(1 << 20)).cast("bigint"), F.lit(0).cast("bigint")).alias("k"))
    x, y, z = geometry.unpack_key(F.col("k"))
    assert tuple(edge.select(x, y, z).first()) == ((1 << 20) - 1, -(1 << 20), 0)


def test_chamfer_and_ids():
    assert nearest.chamfer(np.array([[0, 0, 0]]), np.array([[3, 4, 0], [0, 0, 0]])) == pytest.approx(0.5 * (0 + 2.5))
    assert nearest.chamfer(np.zeros((0, 3)), np.array([[0, 0, 0]])) == float("inf") == nearest.chamfer(None, None)
    g = {0: [(1, "a"), (2, "a")], 1: [(1, "a")], 3: [(1, "a")]}
    got = crossframe.inherit_ids([0, 1, 2, 3], g, {1: {(2, 1): 0.1}})
    assert got == [(0, 1, 1), (0, 2, 2), (1, 1, 2), (3, 1, 3)]  # an empty frame forgets


@pytest.mark.parametrize("shape", ["cloud", "far", "lattice", "line", "repeats", "huge"])
def test_nearest_points_equal_brute_force(shape):
    rng = np.random.default_rng(3)
    for n, m in [(1, 1), (1, 90), (13, 12), (300, 500), (700, 26)]:
        a, b = rng.normal(size=(n, 3)), rng.normal(size=(m, 3))
        if shape == "far":
            a += 1e4
        elif shape == "lattice":
            a, b = a.round(), b.round()
        elif shape == "line":
            b[:, 1] = b[:, 2] = b[:, 0]
        elif shape == "repeats":
            b[:] = b[0]
        elif shape == "huge":
            a, b = a * 1e150, b * 1e-150
        d = a[:, None] - b[None]
        d = (d * d)[..., 0] + (d * d)[..., 1] + (d * d)[..., 2]
        assert np.array_equal(nearest.PointTree(b).squared(a), d.min(axis=1)) and np.array_equal(nearest.PointTree(a).squared(b), d.min(axis=0))


def test_nearest_points_of_large_sets_look_at_few(monkeypatch):
    """Work grows with n log n: of 100,000 points a side, a point is compared with a few leaves' points."""
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(100_000, 3)), rng.normal(size=(100_000, 3))
    seen = []
    to_leaf = nearest.PointTree._to_leaf
    monkeypatch.setattr(nearest.PointTree, "_to_leaf", lambda self, q, leaf: seen.append(len(q)) or to_leaf(self, q, leaf))
    nearest.PointTree(b).squared(a)
    assert sum(seen) < 12 * len(a)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 6])
def test_blocks_equal_single_voxels(spark, radius):
    """Dilation and coverage on blocks of bits, with repeated voxels and voxels at every border of the lattice."""
    rng = np.random.default_rng(radius)
    low, high = -(1 << 20), (1 << 20) - 1
    sets = {o: {tuple(v) for v in rng.integers(-5, 9, (25, 3)).tolist()} for o in range(3)}
    sets[3] = {(low, low, low), (high, high, high), (low, high, 0), (0, 0, low), (high, 1, -1)}
    key = lambda v: ((v[0] - low) << 42) | ((v[1] - low) << 21) | (v[2] - low)
    df = spark.createDataFrame([("f", o, key(v)) for o, vs in sets.items() for v in [*vs, *list(vs)[:3]]], "frame string, obs long, key long").repartition(3)
    r = range(-radius, radius + 1)
    near = {o: {(x + i, y + j, z + k) for x, y, z in vs for i in r for j in r for k in r if low <= min(x + i, y + j, z + k) and max(x + i, y + j, z + k) <= high} for o, vs in sets.items()}
    got = {}
    for row in voxel.neighbourhood(df, ["frame", "obs"], radius).collect():
        got.setdefault(row["obs"], []).append(row["key"])
    assert {o: sorted(k) for o, k in got.items()} == {o: sorted(map(key, v)) for o, v in near.items()}
    pairs = spark.createDataFrame([("f", a, b) for a in range(4) for b in range(a + 1, 4)], "frame string, a long, b long")
    for row in voxel.coverage(df, pairs, ["frame"], "a", "b", radius).collect():
        assert row["a_to_b"] == pytest.approx(len(sets[row["a"]] & near[row["b"]]) / len(sets[row["a"]])) and row["b_to_a"] == pytest.approx(len(sets[row["b"]] & near[row["a"]]) / len(sets[row["b"]]))


def test_tiles_equal_pixels(spark):
    """Overlap, OR, AND and owners by tiles of bits against sets of pixels, with repeated pixels and tiles that are full."""
    rng = np.random.default_rng(9)
    sets = {(f, t): {(int(y), int(x)) for y, x in rng.integers(0, [30, 20], (int(rng.integers(1, 300)), 2))} for f in range(2) for t in range(1, 4)}
    sets[1, 4] = {(y, x) for y in range(16) for x in range(8)}
    sets[1, 5] = {(479, 639), (0, 0)}
    df = spark.createDataFrame([(f, t, y, x) for (f, t), v in sets.items() for y, x in [*v, *list(v)[:2]]], "frame long, track_id long, y int, x int").repartition(3)
    back = {}
    for r in masks.from_tiles(masks.to_tiles(df, ["frame", "track_id"]), ["frame", "track_id"]).collect():
        back.setdefault((r["frame"], r["track_id"]), []).append((r["y"], r["x"]))
    assert {k: sorted(v) for k, v in back.items()} == {k: sorted(v) for k, v in sets.items()}
    got = {(r["frame"], r["a"], r["b"]): r["iou"] for r in masks.mask_iou(df, ["frame"], "track_id").collect()}
    want = {(f, a, b): round(len(sets[f, a] & sets[f, b]) / len(sets[f, a] | sets[f, b]), 6) for f, a in sets for g, b in sets if f == g and a < b and sets[f, a] & sets[f, b]}
    assert got == want
    rows = {(r["frame"], r["track_id"]): r for r in masks.packed(df, ["frame", "track_id"]).collect()}
    for (f, a, b), v in want.items():
        p, q = rows[f, a], rows[f, b]
        assert round(masks.packed_iou((p["tiles"], p["words"]), (q["tiles"], q["words"])), 6) == v and p["area"] == len(sets[f, a])
    for how, op in (("or", set.union), ("and", set.intersection)):
        out = masks.combine(df.where("track_id = 1"), df.where("track_id = 2"), ["frame"], how).collect()
        assert sorted((r["frame"], r["y"], r["x"]) for r in out) == sorted((f, y, x) for f in range(2) for y, x in op(sets[f, 1], sets[f, 2]))
    owners = {(r["frame"], r["y"], r["x"]): r["owner"] for r in masks.owner_map(df, ["frame"]).collect()}
    cover = {}
    for (f, t), v in sets.items():
        for y, x in v:
            cover.setdefault((f, y, x), []).append(t)
    assert owners == {k: v[0] if len(v) == 1 else 0 for k, v in cover.items()}


def test_bundles_queue_and_slots():
    assert streams.bundle([(0, "a", 10), (1, "b", 11), (2, "a", 20), (3, "b", 90), (4, "a", 91)], ["a", "b"], 2) == ([{"a": 10, "b": 11}, {"b": 90, "a": 91}], {})
    out = streams.latest_wins([(0, 1), (1, 2), (2, 3), (3, 4)], 10)
    assert {i: o for _, i, o in out} == {1: "processed", 2: "evicted", 3: "evicted", 4: "processed"}
    assert streams.slot_life([True, False, False, True], True, 2, {}) == [(0, "visible", 0, True), (1, "lost", 1, True), (2, "lost", 2, False), (3, None, 2, False)]
    assert streams.slot_life([False, False, True], True, 2, {2: True})[-1] == (2, "visible", 0, True)
    clock = streams.Refresh(10, 3, 0.5)
    got = [(f, *clock.frame(f, p, 4)) for f, p in [(0, 1.0), (1, 0.1), (3, 0.1), (4, 0.9), (6, None), (9, 0.1), (10, 0.9), (20, 0.9)]]
    assert got == [
        (0, None, "periodic", True), (1, None, None, False), (3, None, "tracking_anomaly", False), (4, 0, None, False), (6, None, "tracking_anomaly", True),
        (9, None, "tracking_anomaly", False), (10, 6, None, False), (20, None, "periodic", True),
    ]


def test_pieces_without_rows(spark):
    """Wherever Arrow's batches cut a key's history: a piece that settles no message, or ends no bundle, gives no rows."""
    rng = np.random.default_rng(1)
    big = 2**53 + 1  # not a float
    rows = [(f"rig{k}", big + 2 * i + k, int(t)) for k in range(3) for i, t in enumerate(np.sort(rng.integers(0, 200, 15 + k)))] + [("one", big, 7)]
    m = spark.createDataFrame(rows, "rig string, id long, t long")
    views = spark.createDataFrame([("rig", v, t, t) for v, t in [("a", 1), ("a", 5), ("b", 6), ("a", 30)]] + [("none", "a", 1, 1)], "rig string, view string, stamp_ns long, arrival long")
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    try:
        for n in (1, 2, 3, 10000):
            spark.conf.set(conf, n)
            for size, drop in [(1, True), (3, True), (2, False)]:
                want = [(k, i, t, o) for k in {r[0] for r in rows} for t, i, o in streams.latest_wins([(t, i) for r, i, t in sorted(rows, key=lambda r: (r[2], r[1])) if r == k], 20, size, drop)]
                assert sorted(tuple(r) for r in streams.queue_outcomes(m, "rig", 20, size, drop).collect()) == sorted(want)
            assert [tuple(r) for r in streams.bundles(views, "rig", ["a", "b"], 2).collect()] == [("rig", 1, 5, 6)]
    finally:
        spark.conf.set(conf, before)


def test_corrections_reasons(spark):
    k = spark.createDataFrame([(5, 5), (4, 5), (0, 32), (0, 33)], "ref_frame long, arrival_frame long")
    got = [r["reason"] for r in streams.admit_corrections(k, 32).orderBy("arrival_frame", F.desc("ref_frame")).collect()]
    assert got == ["reference_not_older_than_current", None, None, "reference_feature_expired"]


def test_even_cap_equals_linspace(spark):
    for n, most in [(7, 3), (100, 7), (1000, 333), (5, 5), (5, 1)]:
        df = spark.range(n).select(F.lit(0).alias("k"), "id")
        got = sorted(r["id"] for r in geometry.even_cap(df, ["k"], ["id"], most).collect())
        assert got == sorted(set(int(v) for v in np.linspace(0, n - 1, most).astype(int))) if n > most else list(range(n))


def test_warmup_is_of_frames_not_of_stages(spark):
    """A stage that starts late keeps all its frames."""
    rows = [(f, "track", 1.0) for f in range(10)] + [(f, "refine", 2.0) for f in range(6, 10)]
    sums = spark.createDataFrame(rows, "frame long, stage string, value_ms double")
    got = {r["stage"]: r["n"] for r in profile.summary(profile.after_warmup(sums, 3)).collect()}
    assert got == {"track": 7, "refine": 4}
    assert profile.after_warmup(sums, 0).count() == 14 and profile.after_warmup(sums, 99).count() == 0
    text = profile.report("p", profile.summary(sums), ["track"], 10, 0).split("\n")
    assert text[2].startswith("track") and text[3].startswith("refine")


def test_identities_outlive_skipped_frame_numbers(spark):
    """Frame 2 was dropped: 1 and 3 are neighbours.  Frame 5 was processed but empty: 4 and 6 are not."""
    groups = spark.createDataFrame([("r", f, "box", 1, 0.0, 0.0, 0.0) for f in (1, 3, 4, 6)], "rig string, frame long, label string, group_id long, cx double, cy double, cz double")
    frames = spark.createDataFrame([("r", f) for f in (1, 3, 4, 5, 6)], "rig string, frame long")
    near = crossframe.candidates(groups, ["rig"], frames=frames)
    assert sorted((r["before"], r["frame"]) for r in near.collect()) == [(1, 3), (3, 4)]
    got = crossframe.global_ids(frames, groups, near.withColumnRenamed("distance", "cost"), ["rig"]).collect()
    assert {r["frame"]: r["global_id"] for r in got} == {1: 1, 3: 1, 4: 1, 6: 2}


@pytest.mark.parametrize("width", [3, 7, 10_000])
def test_buckets_change_nothing(spark, width):
    """Running values that are carried from bucket to bucket are those of one window over all."""
    rng = np.random.default_rng(4)
    rows = [(int(k), int(t) * 2, int(v), ["lost", "visible"][int(s)]) for k, t, v, s in zip(rng.integers(0, 3, 60), rng.permutation(60), rng.integers(0, 50, 60), rng.integers(0, 2, 60) * rng.integers(0, 2, 60))]
    df = spark.createDataFrame(rows, "k long, t long, v long, status string")
    all_of = {}
    for k, t, v, s in sorted(rows):
        all_of.setdefault(k, []).append((t, v, s))
    total, gap, missing = {}, {}, {}
    for k, x in all_of.items():
        run = 0
        for i, (t, v, s) in enumerate(x):
            total[k, t] = sum(y for _, y, _ in x[: i + 1])
            gap[k, t] = (v - x[i - 1][1] if i and v > x[i - 1][1] else None, bool(i and v <= x[i - 1][1]))
            run = run + 1 if s == "lost" else 0
            missing[k, t] = run
    assert {(r["k"], r["t"]): r["total"] for r in streams.running_totals(df, ["k"], ["t"], "v", width).collect()} == total
    assert {(r["k"], r["t"]): (r["gap"], r["non_monotonic"]) for r in streams.gaps(df, ["k"], "v", ["t"], width).collect()} == gap
    assert {(r["k"], r["t"]): r["missing_frames"] for r in streams.missing_runs(df, ["k"], "t", 2, width).collect()} == missing
    infos = spark.createDataFrame([(int(k), int(t), int(t) * 10) for k, t in zip(rng.integers(0, 3, 12), rng.permutation(120)[:12])], "k long, at long, info long")
    known = sorted(tuple(r) for r in infos.collect())
    want = {(k, t): max([(a, i) for q, a, i in known if q == k and a <= t], default=(None, None))[1] for k, t, *_ in rows}
    assert {(r["k"], r["t"]): r["info"] for r in streams.as_of(df, infos, ["k"], "t", "at", ["info"], width=width).collect()} == want


@pytest.mark.parametrize("width", [1, 7, 10_000])
@pytest.mark.parametrize("release_after", [1, 2, 5])
def test_slot_lives_in_buckets_equal_the_sequential_ones(spark, width, release_after):
    """Wherever histories are cut, and however many pieces a bucket comes in: the rows are those of one slot gone through frame by frame."""
    rng = np.random.default_rng(width + release_after)
    rows = [(2**53 + k, int(f), bool(rng.random() < 0.4), [None, bool(rng.random() < 0.2)][int(rng.random() < 0.9)]) for k in range(3) for f in sorted(rng.choice(90, 60, replace=False))]
    df = spark.createDataFrame(rows, "slot long, frame long, visible boolean, corrected boolean").repartition(3)
    want = []
    for k in {r[0] for r in rows}:
        slot = streams.SlotLife(release_after)
        want += [(k, f, *slot.frame(v, bool(c))) for q, f, v, c in rows if q == k]
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    try:
        spark.conf.set(conf, 4)
        assert sorted(map(tuple, streams.slot_lives(df, "slot", release_after, width).collect())) == sorted(want, key=lambda r: r[:2])
    finally:
        spark.conf.set(conf, before)


@pytest.mark.parametrize("width", [9, 10_000])
def test_windows_that_follow_the_calls_equal_a_plain_loop(spark, width):
    rng = np.random.default_rng(11)
    rows = [(k, int(t)) for k, n, top in (("a", 200, 3000), ("b", 5, 4000), ("c", 1, 10), ("d", 300, 40)) for t in rng.integers(-50, top, n)]
    want = []
    for k in {r[0] for r in rows}:
        t = sorted(x for q, x in rows if q == k)
        start, n, first = t[0], 0, True
        for i, x in enumerate(t):
            n += 1
            if (i + 1 == len(t) or t[i + 1] > x) and x - start >= 7 and (x > start or not first):
                want.append((k, start, x, n))
                start, n, first = x, 0, False
        want.append((k, start, None, n))
    got = [tuple(r) for r in streams.call_windows(spark.createDataFrame(rows, "k string, t long"), ["k"], "t", 7, width).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) > 100


def test_detections_are_suppressed_in_one_pass(spark):
    rng = np.random.default_rng(6)
    masks_ = [sorted(rng.choice(40, size=int(rng.integers(1, 20)), replace=False).tolist()) for _ in range(60)]
    pixels = spark.createDataFrame([(i % 2, "box", i // 2, v // 20, v % 20) for i, m in enumerate(masks_) for v in m], "frame long, label string, rank long, y int, x int")
    got = {(r["frame"], r["rank"]) for r in detect.nms(masks.packed(pixels, ["frame", "label", "rank"]), ["frame"], ["tiles", "words"], masks.packed_iou, 0.3, 6).collect()}
    want = set()
    for f in (0, 1):
        kept = []
        for rank, m in enumerate(masks_[f::2]):
            if len(kept) < 6 and all(len(set(m) & set(k)) / len(set(m) | set(k)) < 0.3 for k in kept):
                kept.append(m)
                want.add((f, rank))
    assert got == want


def test_errors_are_raised(spark):
    """Arity of cameras and corrections."""
    e = spark.createDataFrame([("a", 1), ("b", 2)], "camera string, ts_ns long")
    with pytest.raises(ValueError, match="2 cameras, 3 views"):
        frames.make_frames(e, 3)
    views = spark.createDataFrame([(1, 0), (1, 1)], "frame long, view_id long")
    assert crossview.assert_arity(views, views, ["frame"]).first()["views"] == 2
    with pytest.raises(Exception, match="differ in number"):
        crossview.assert_arity(views, views.limit(1), ["frame"]).collect()


def test_settings_and_arguments(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("voxel: 0.05\nmode: sequential\n")
    assert frames.load_config(str(tmp_path / "c.yaml"))["voxel"] == 0.05
    assert frames.load_config(str(tmp_path / "c.yaml"), " Fixed_batch ")["mode"] == "fixed_batch"
    with pytest.raises(ValueError):
        frames.config({"mode": "other"})
    rows = [("r", "c", "color", i * 100_000_000, i * 100_000_000) for i in range(50)]
    spark.createDataFrame(rows, "rig string, camera string, stream string, wall_ns long, stamp_ns long").write.parquet(str(tmp_path / "m"))
    df, out = cli.plan(spark, ["--camera-only", "--messages", str(tmp_path / "m"), "--window-seconds", "1"])
    got = df.collect()
    assert out is None and len(got) == 5 and {r["wall_rate"] for r in got} == {10.0} == {round(r["stamp_rate"], 6) for r in got}


def test_external_detections_and_corrections(spark, tmp_path):
    spark.createDataFrame([("r", "c", 1, 0, 1, "box", 0.9), ("r", "c", 1, 1, 2, "hand", 0.9), ("r", "c", 1, 2, 3, "box", float("nan")), ("r", "c", 1, 3, 4, "box", None)], frames.DETECTIONS).write.parquet(str(tmp_path / "d"))
    assert [r["detection_id"] for r in frames.external_detections(spark, str(tmp_path / "d"), ["box"]).collect()] == [1]
    spark.createDataFrame([("r", 5, 6, 1.0), ("r", 1, 50, 1.0)], frames.CORRECTIONS).write.parquet(str(tmp_path / "k"))
    assert sorted(r["admitted"] for r in frames.external_corrections(spark, str(tmp_path / "k"), 32).collect()) == [False, True]


def test_tracker_interface():
    class Echo(tracker.Tracker):
        def initialize(self, frame, seeds):
            with self.stage("start"):
                return seeds

        def track(self, frame):
            return frame

    tracker.register("echo", lambda settings: Echo())
    t = rigvane.build({"tracker": "echo"})
    t.profile = rigvane.Profile()
    assert t.correct(None, 3) == 3 and t.track(4) == 4 and t.close() is None
    assert t.profile.table()["stage"].tolist() == ["start"]
    with pytest.raises(ValueError, match="no tracker"):
        rigvane.build({"tracker": "none"})
    assert set(rigvane.__all__) >= {"Engine", "Tracker", "Detector", "build", "load_config"}


def test_timing_files(spark, tmp_path):
    """Appended CSV files with a header: preferred stages first, other known ones sorted, unknown ones left out."""
    rows = [(1, "track", 1.5), (1, "fuse", 2.0), (2, "track", 3.0), (2, "other", 9.0)]
    wide = profile.wide(spark.createDataFrame(rows, "frame long, stage string, value_ms double"), ["track"], ["fuse", "align"])
    assert wide.columns == ["frame", "track", "align", "fuse"]
    for _ in range(2):
        frames.write_timings(wide, str(tmp_path / "t"))
    back = spark.read.option("header", True).csv(str(tmp_path / "t"))
    assert sorted(tuple(r) for r in back.select("frame", "track", "fuse").distinct().collect()) == [("1", "1.5", "2.0"), ("2", "3.0", None)] and back.count() == 4


@pytest.mark.parametrize("width", [1, 7, 10_000])
@pytest.mark.parametrize("batch", [3, 10_000])
def test_states_of_any_automaton_equal_the_sequential_ones(spark, width, batch):
    """Functions of random tables, keys of two columns, orders below zero and rows without a key: each row meets the state of a walk row by row."""
    rng = np.random.default_rng(width)
    table = rng.integers(0, 5, (4, 5))
    rows = [(a, b, int(t), int(rng.integers(0, 4))) for a, b, n in (("x", 1, 60), ("x", 2, 1), ("y", 1, 25), ("y", 2**53, 2), ("y", 2**53 + 1, 2)) for t in rng.choice(160, n, replace=False) - 80]
    want = []
    for key in {r[:2] for r in rows}:
        state = 3
        for r in sorted(r for r in rows if r[:2] == key):
            want.append((*r, state))
            state = int(table[r[3], state])
    df = spark.createDataFrame([*rows, (None, 1, 0, 0), ("x", None, 0, 0)], "a string, b long, t long, sign int").repartition(3)
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    try:
        spark.conf.set(conf, batch)
        got = ordered.states_before(df, ["a", "b"], ["t"], width, 5, lambda p: table[p["sign"].to_numpy()], "state", 3)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    finally:
        spark.conf.set(conf, before)


@pytest.mark.parametrize("piece", [1, 20, 2**20])
def test_pieces_of_any_size_give_the_same_functions(piece, monkeypatch):
    monkeypatch.setattr(ordered, "PIECE", piece)
    rng = np.random.default_rng(0)
    table = rng.integers(0, 4, (3, 4))
    rows = pd.DataFrame({"k": np.repeat([2**53, 2**53 + 1, 7], [30, 1, 19]), "sign": rng.integers(0, 3, 50)})
    want, at = [], None
    for k, sign in rows.itertuples(index=False):
        new = not want or k != rows["k"].iloc[len(want) - 1]
        at = np.arange(4) if new else at
        want.append((new, at.tolist(), table[sign][at].tolist()))
        at = table[sign][at]
    got = ordered._through(iter([rows.iloc[:11], rows.iloc[11:11], rows.iloc[11:]]), ["k"], 4, lambda p: table[p["sign"].to_numpy()])
    assert [(bool(n), b.tolist(), a.tolist()) for _, new, before, after in got for n, b, a in zip(new, before, after)] == want


def test_short_histories_are_gone_through_together(spark):
    """6,000 rows of 1,500 keys come as a few pieces of a few tasks, even if the session sends 10 rows at a time: moves() is called for pieces, not for rows, keys or batches."""
    calls = spark.sparkContext.accumulator(0)

    def moves(p, *_):
        calls.add(1)
        return np.tile([1, 0], (len(p), 1))

    rows = spark.range(6_000).select((F.col("id") % 1_500).alias("k"), F.floor(F.col("id") / 1_500).alias("t"))
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    try:
        spark.conf.set(conf, 10)
        got = ordered.states_before(rows, ["k"], ["t"], 10_000, 2, moves, "state").collect()
    finally:
        spark.conf.set(conf, before)
    assert len(got) == 6_000 and all(r["t"] % 2 == r["state"] for r in got) and calls.value <= 50


def test_a_model_is_a_function_of_batches(spark):
    def model(batches):
        for pdf in batches:
            yield pdf.assign(score=pdf["x"] * 0.5)[["frame", "score"]]

    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "frame long, x double")
    assert sorted(tuple(r) for r in masks.map_frames(df, model, "frame long, score double").collect()) == [(1, 1.0), (2, 1.5)]


@pytest.mark.parametrize("name", ["bundles", "queue_outcomes", "refreshes", "slot_lives", "nms", "global_ids"])
def test_neighbouring_large_keys_share_nothing(spark, name):
    """Keys that no double tells apart (as hashes are) give what small keys give, wherever their rows lie side by side."""
    big = [2**53, 2**53 + 1, 2**53 + 2, 2**62 + 1, 2**62 + 2, -(2**61) - 1, -(2**61)]

    def rows_of(keys):
        ends = [k for k in keys for _ in range(12)]
        at = list(range(12)) * len(keys)
        r = np.random.default_rng(5).random((len(ends), 3))
        if name == "bundles":
            m = spark.createDataFrame([(k, "ab"[int(x > 0.5)], i, i) for k, i, (x, _, _) in zip(ends, at, r)], "k long, view string, stamp_ns long, arrival long")
            return streams.bundles(m, "k", ["a", "b"], 2)
        if name == "queue_outcomes":
            return streams.queue_outcomes(spark.createDataFrame([(k, i, int(9 * x)) for k, i, (x, _, _) in zip(ends, at, r)], "k long, id long, t long"), "k", 3)
        if name == "refreshes":
            return streams.refreshes(spark.createDataFrame([(k, i, float(x), 2) for k, i, (x, _, _) in zip(ends, at, r)], "k long, frame long, presence double, service long"), "k", 6, 2, 0.3)
        if name == "slot_lives":
            return streams.slot_lives(spark.createDataFrame([(k, i, bool(x > 0.6), bool(y > 0.8)) for k, i, (x, y, _) in zip(ends, at, r)], "k long, frame long, visible boolean, corrected boolean"), "k", 2)
        if name == "nms":
            return detect.nms(spark.createDataFrame([(k, "box", i, sorted({int(20 * v) + 1 for v in z})) for k, i, z in zip(ends, at, r)], "k long, label string, rank long, tiles array<long>").withColumn("words", F.col("tiles")), ["k"], ["tiles", "words"], masks.packed_iou, 0.3, 5)
        groups = spark.createDataFrame([(k, i, g, "box") for k, i, (x, _, _) in zip(ends, at, r) for g in range(1, 2 + int(2 * x))], "k long, frame long, group_id long, label string")
        costs = spark.createDataFrame([(k, i, 1, 1, float(y)) for k, i, (_, y, z) in zip(ends, at, r) if i and z > 0.4], "k long, frame long, a long, b long, cost double")
        return crossframe.global_ids(groups.select("k", "frame").distinct(), groups, costs, ["k"])

    small = {k: i for i, k in enumerate(big)}
    got = sorted((tuple(small[v] if c == "k" else v for c, v in r.asDict().items()) for r in rows_of(big).coalesce(1).collect()), key=repr)
    want = sorted((tuple(r) for r in rows_of(list(range(len(big)))).collect()), key=repr)
    assert got == want and want
