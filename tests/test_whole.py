"""Queries that work on all rows of their tables, against brute force."""

from __future__ import annotations

import os

import numpy as np
import pytest

from rigvane.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_chamfer_of_all_points(spark):
    observed = catalog._observed(spark, SF)
    rows = observed.select("frame", "obs", "wx", "wy", "wz").distinct().collect()
    sets = {}
    for r in rows:
        sets.setdefault((r["frame"], r["obs"]), []).append((r["wx"], r["wy"], r["wz"]))
    assert catalog._points(observed).count() == len(rows)
    got = {(r["frame"], r["a"]): r["chamfer"] for r in catalog.QUERIES["d13_chamfer"](spark, SF).collect()}
    assert set(got) == {(f, o) for f, o in sets if (f - 1, o) in sets}
    for (f, o), value in got.items():
        d = np.sqrt(((np.array(sets[f - 1, o])[:, None] - np.array(sets[f, o])[None]) ** 2).sum(axis=2))
        assert value == pytest.approx(0.5 * (d.min(axis=1).mean() + d.min(axis=0).mean()), abs=1.1e-5)


def test_all_images_are_resized(spark):
    part = {r["p_partkey"]: r["p_retailprice"] / 1000 for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    got = {(r["image"], r["y"], r["x"]): r["logit"] for r in catalog.QUERIES["b20_resize_bilinear"](spark, SF).collect()}
    want = {}

    def sources(d, n, m):
        at = max((d + 0.5) * n / m - 0.5, 0.0)
        low = min(int(at), n - 1)
        return [(k, w) for k, w in ((low, 1 - (at - low)), (min(low + 1, n - 1), at - low)) if w > 0]

    for image in {k // 192 for k in part}:
        for y in range(18):
            for x in range(24):
                at = [(image * 192 + 16 * j + i, v * w) for j, v in sources(y, 12, 18) for i, w in sources(x, 16, 24)]
                if any(k in part for k, _ in at):
                    want[image, y, x] = sum(part.get(k, 0.0) * w for k, w in at)
    assert len({k[0] for k in want}) > 1 and set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want)


def test_whole_sets_slots_and_labels(spark):
    markers = catalog.QUERIES["a13_markers"](spark, SF).collect()
    assert len(markers) == 6 and all(r["action"] == "ADD" for r in markers)
    labels = {r["label"] for r in catalog._mask(spark, SF).select("label").distinct().collect()}
    assert {r["label"] for r in catalog.QUERIES["f04_dilate"](spark, SF).select("label").distinct().collect()} == labels
    read = lambda t, k: [r[0] for r in spark.read.parquet(f"{SF}/{t}.parquet").select(k).collect()]
    cu, su, na = read("customer", "c_nationkey"), read("supplier", "s_nationkey"), read("nation", "n_nationkey")
    got = {r["op"]: r["n"] for r in catalog.QUERIES["h01_h02_h05_sets"](spark, SF).collect()}
    assert got == {"shared": len(set(cu) & set(su)), "unmatched": len(set(na) - set(su)), "all": len(su) + len(na)}


def test_components_of_whole_masks(spark):
    pixels = {}
    for r in catalog._mask(spark, SF).select("frame", "label", "y", "x").collect():
        pixels.setdefault((r["frame"], r["label"]), set()).add((r["y"], r["x"]))
    areas, kept = {}, {}
    for key, left in pixels.items():
        left, found = set(left), []
        while left:
            todo, part = [left.pop()], []
            while todo:
                y, x = todo.pop()
                part.append((y, x))
                near = {(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)} & left
                left -= near
                todo += near
            ys, xs = zip(*part)
            found.append((len(part), min(xs), max(xs), min(ys), max(ys)))
        areas[key], kept[key] = sorted(found), sum(f[0] for f in found if f[0] >= 4)
    got = {}
    for r in catalog.QUERIES["e08_components"](spark, SF).collect():
        got.setdefault((r["frame"], r["label"]), []).append((r["area"], r["x0"], r["x1"], r["y0"], r["y1"]))
    assert {k: sorted(v) for k, v in got.items()} == areas
    small = {(r["frame"], r["label"]): r["n"] for r in catalog.QUERIES["c12_small_components"](spark, SF).collect()}
    assert small == {k: n for k, n in kept.items() if n}


def test_ids_of_whole_tables(spark):
    """Ids from frame to frame, each label's pairs being the cheapest of the largest sets of accepted pairs."""
    from itertools import permutations

    cents = {}
    for r in catalog._centroids(spark, SF).collect():
        cents.setdefault(r["frame"], {})[r["group_id"]] = (r["label"], np.array([r["cx"], r["cy"], r["cz"]]))
    want, before, ids, fresh = {}, {}, {}, 1
    for f in sorted(cents):
        now = {}
        for label in sorted({x for x, _ in cents[f].values()}):
            a, b = ([g for g in sorted(x) if x[g][0] == label] for x in (before, cents[f]))
            best = None
            for p in permutations([*b, *[None] * len(a)], len(a)):
                pairs = [(x, y) for x, y in zip(a, p) if y is not None and np.sqrt(((before[x][1] - cents[f][y][1]) ** 2).sum()) <= 2.0]
                key = (-len(pairs), sum(np.sqrt(((before[x][1] - cents[f][y][1]) ** 2).sum()) for x, y in pairs))
                best = min(best or (key, pairs), (key, pairs), key=lambda z: z[0])
            now |= {y: ids[x] for x, y in (best[1] if best else [])}
        for g in sorted(cents[f]):
            if g not in now:
                now[g], fresh = fresh, fresh + 1
            want[f, g] = now[g]
        before, ids = cents[f], now
    got = {(r["frame"], r["group_id"]): r["global_id"] for r in catalog.QUERIES["j04_global_ids"](spark, SF).collect()}
    assert got == want and len(set(want.values())) < len(want)
