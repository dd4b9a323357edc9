"""Blocked searches against all products in double precision."""

import numpy as np
import pytest

from corpuslab.operators import align as AL


@pytest.mark.parametrize(("keep", "n", "m"), [(1, 7, 5), (11, 40, 300), (10, 30, 2000), (400, 5, 300)])
@pytest.mark.parametrize("tile", [(1024, 8192), (8, 64)])
def test_the_best_are_kept(monkeypatch, keep, n, m, tile):
    monkeypatch.setattr(AL, "TILE", tile)
    rng = np.random.default_rng(n)
    y = rng.normal(size=(m, 12))
    y[m // 2 :] = y[: m - m // 2] * (1 + 1e-9 * rng.integers(0, 2, size=(m - m // 2, 1)))  # ties, and what single precision can't tell apart
    x, ys = rng.normal(size=(n, 12)), rng.permutation(m)
    i, j, sims = AL._kept(x, y, ys, keep)
    want = (x @ y.T).round(9)
    for row in range(n):
        order = np.lexsort((ys, -want[row]))[:keep]
        assert j[i == row].tolist() == order.tolist() and np.allclose(sims[i == row], want[row, order], atol=2e-9)


def test_a_table_meets_itself_in_many_tasks(spark):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rng.normal(size=(9000, 4)))], "id long, vec array<double>")
    found = AL._searched(v, v, 1, AL.BLOCK)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2  # a given number of tasks
    assert found.select("id").distinct().count() == 9000
