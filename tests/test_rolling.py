"""Rolling aggregates across chunk borders."""

import numpy as np
import pytest

from faultspark.operators import proposals as P


@pytest.mark.parametrize("window", [1, 4, 7, 40])
def test_moving_average_over_chunk_borders(spark, tiny_chunks, window):
    rng = np.random.default_rng(3)
    series = {k: [float(x) for x in rng.normal(size=n).round(3)] for k, n in ((1, 75), (2, 3), (3, 1), (4, 33))}
    series[4][10] = None
    rows = [(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)]
    got = {(r["k"], r["idx"]): r["smooth"] for r in P.moving_average(spark.createDataFrame(rows, "k bigint, idx bigint, value double"), window, ["k"]).collect()}
    assert len(got) == len(rows)
    before, after = window // 2, window - window // 2 - 1
    for k, i, _ in rows:
        part = series[k][max(i - before, 0):i + after + 1]
        want = np.mean(part) if len(part) == window and None not in part else None
        assert got[k, i] == want if want is None else abs(got[k, i] - want) < 1e-9


def test_one_frame_whatever_its_length(spark):
    d = spark.createDataFrame([], "k bigint, idx bigint, value double")
    plan = P.moving_average(d, 50, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(" not in plan and "lead(" not in plan and P.moving_average(d, 50, ["k"]).count() == 0
