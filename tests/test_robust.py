"""The robust envelope: planted outliers don't move it."""

import numpy as np
import pytest

from estuarine.operators import novelty as N


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")


def test_far_rows_do_not_move_the_centre(spark):
    rng = np.random.default_rng(5)
    shape = np.array([[2.0, 0.5, 0.0], [0.5, 1.0, 0.2], [0.0, 0.2, 0.5]])
    good = rng.multivariate_normal([1, 2, 3], shape, size=1800)
    bad = rng.normal(size=(200, 3)) * 0.5 + [15, -10, 8]  # one tenth, all on one side
    df = frame(spark, np.vstack([good, bad]))
    rows = df.selectExpr("vec_id as id", "embedding as vec")
    mean, cov = N.robust_location(rows)
    assert np.abs(mean - good.mean(0)).max() < 0.1
    assert np.abs(cov - np.cov(good.T)).max() < 0.35
    _, plain, _ = N._moments(rows, 3)
    assert np.abs(plain - good.mean(0)).max() > 0.4
    scored = {r.vec_id: r for r in N.robust_envelope(df, df).collect()}
    assert sum(scored[i].label == -1 for i in range(1800, 2000)) == 200
    assert max(scored[i].score for i in range(1800, 2000)) < min(scored[i].score for i in range(1800))


def test_steps_end_at_a_fixed_point(spark):
    """No subset of half the rows found by plain steps from many starts is much tighter."""
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(300, 2)), rng.normal(size=(80, 2)) * 3 + 6])
    h = int(np.ceil((len(x) + 3) / 2))
    best = min(N._concentrated(x, h, rng.choice(len(x), 3, replace=False))[0] for _ in range(100))
    rows = frame(spark, x).selectExpr("vec_id as id", "embedding as vec")
    mean, cov = N.robust_location(rows)
    c = x - mean
    inside = np.argsort(np.einsum("ij,jk,ik->i", c, np.linalg.inv(cov), c))[:h]
    assert N._concentrated(x, h, inside)[0] == pytest.approx(best, abs=0.02)
