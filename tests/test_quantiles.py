"""Quantiles by narrowing histograms against sorted lists."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rigvane.operators import quantiles

WANTED = [("p0", "x", 0.0), ("p1", "x", 0.01), ("p50", "x", 0.5), ("p95", "x", 0.95), ("p100", "x", 1.0), ("y50", "y", 0.5)]


def plain(values, q):
    v = sorted((x for x in values if x is not None), key=lambda x: (math.isnan(x), x))
    if not v:
        return None
    at = q * (len(v) - 1)
    low, high = v[math.floor(at)], v[math.ceil(at)]
    return low if low == high or math.isnan(low) else low * (1 - (at - math.floor(at))) + high * (at - math.floor(at))


@pytest.mark.parametrize("linear", [1, 7, 4096])
def test_quantiles_equal_sorted_lists(spark, monkeypatch, linear):
    """Ties, nulls, null keys, negative and huge values, infinities and NaN, values that share all bins, groups of one value or of none."""
    monkeypatch.setattr(quantiles, "LINEAR", linear)
    rng = np.random.default_rng(3)
    of = {
        ("a", 1): rng.normal(0, 1, 501).tolist(), ("a", 2): [0.5] * 40 + [0.25] * 3, ("a", None): (1.7e18 + rng.integers(0, 2000, 300) * 256.0).tolist(), (None, 1): [-0.0, 0.0, 1e-300, -1e-300, 5e-324, 2.0],
        ("b", 1): [7.0], ("b", 2): [None, None], ("b", 3): [1.0, math.inf, -math.inf, 2.0, 1e308, -1e308], ("c", 1): [1.0, math.nan, 2.0, math.nan, math.nan], ("c", 2): (1 + rng.integers(0, 50, 200) * 2.0**-52).tolist(), ("c", 3): rng.integers(-5, 6, 200).astype(float).tolist(),
    }
    rows = [(*k, v, i) for k, vs in of.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "k string, j int, x double, y long").withColumn("which", F.lit("clash")).withColumn("n", F.lit(0)).repartition(3)
    got = {(r["k"], r["j"]): r for r in quantiles.quantiles(df, ["k", "j"], WANTED).collect()}
    assert set(got) == set(of)  # ("b", 2) has values of y
    for k, vs in of.items():
        for name, c, q in WANTED:
            want = plain(vs if c == "x" else [float(i) for i in range(len(vs))], q)
            have = got[k][name]
            assert have == want or (want is not None and (math.isnan(want) and math.isnan(have) or have == pytest.approx(want, rel=1e-15))), (k, name, have, want)
    sizes = df.groupBy("k", "j").agg(F.count("*").alias("rows"))
    both = quantiles.with_quantiles(sizes, df.where("k = 'a'"), ["k", "j"], WANTED[:1], 3).collect()
    assert len(both) == len(of) and {r["p0"] for r in both if r["k"] != "a"} == {None}
    assert quantiles.quantiles(df.limit(0), ["k", "j"], WANTED).count() == 0


def test_no_buffer_of_a_group(spark):
    """The plan counts values and sorts them by bins; no aggregate keeps a group's values."""
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.rand(1).alias("x"))
    plan = quantiles.quantiles(df, ["k"], WANTED[:3])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect" not in plan and "ObjectHashAggregate" not in plan
