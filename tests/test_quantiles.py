"""Percentiles of large groups against numpy, by counts alone."""

import numpy as np
import pytest

from quarry.operators import analytics as A


@pytest.mark.parametrize("small", [50, 10**6])
def test_percentiles_of_every_shape_of_values(spark, small):
    rng = np.random.default_rng(4)
    groups = {
        "even": rng.random(5000) * 100,
        "skewed": np.exp(rng.standard_normal(5000) * 8),
        "two": np.repeat([1.0, 2.0], 2000),
        "one": np.full(3000, 7.5),
        "ends": np.concatenate([np.zeros(3000), rng.random(40), np.full(3000, 9.0)]),
        "few": np.array([1.0, 2.0, 3.0, 10.0]),
        None: rng.integers(-50, 50, 4000).astype(float),
    }
    rows = [(k, float(v), float(-v) if i % 3 else None) for k, vs in groups.items() for i, v in enumerate(vs)] + [("empty", None, None)] * 200
    df = spark.createDataFrame(rows, "mode string, v double, w double").repartition(5)
    got = {r["mode"]: r for r in A.latency_summary(df, ["mode"], ["v", "w"], small).collect()}
    assert set(got) == {*groups, "empty"} and got["empty"].n == 200 and got["empty"].v_p99 == 0
    for k, vs in groups.items():
        for name, values in (("v", vs), ("w", np.array([-v for i, v in enumerate(vs) if i % 3]))):
            for p in (50, 95, 99):
                assert abs(got[k][f"{name}_p{p}"] - np.percentile(values, p)) <= 0.0501 + 1e-12 * abs(np.percentile(values, p))
        assert got[k].n == len(vs)
    total = A.latency_summary(df, [], ["v"], small).first()
    assert total.n == len(rows) and abs(total.v_p95 - np.percentile(np.concatenate(list(groups.values())), 95)) <= 0.0501 * max(1, abs(total.v_p95) * 1e-9)
