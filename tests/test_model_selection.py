"""Linear models from sums against fits on the rows themselves."""

import numpy as np
import pytest

from marlstone.operators import model_selection as S

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.1]
    y = 3 + x @ [2.0, 0.01, 4.0] + rng.normal(size=300)
    rows = [(*map(float, r), float(t), i % 4) for i, (r, t) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "a double, b double, c double, y double, fold int").repartition(5)


def fit(x, y, ridge=0.0):
    z = np.column_stack([np.ones(len(x)), x])
    return np.linalg.solve(z.T @ z + ridge * np.diag([0, *[1] * x.shape[1]]), z.T @ y)


def test_grid_search_is_that_of_the_rows(data):
    x, y, df = data
    fold, got = np.arange(300) % 4, {(r["ridge"], r["fold"]): r for r in S.grid_search(df, COLUMNS, "y", "fold", [0.0, 50.0]).collect()}
    for ridge in (0.0, 50.0):
        for k in range(4):
            b, test = fit(x[fold != k], y[fold != k], ridge), fold == k
            e = y[test] - b[0] - x[test] @ b[1:]
            assert np.allclose([got[ridge, k]["mse"], got[ridge, k]["r2"]], [np.mean(e**2), 1 - e @ e / np.sum((y[test] - y[test].mean()) ** 2)])
    assert S.best_ridge(S.grid_search(df, COLUMNS, "y", "fold", [0.0, 1e6])).first()["ridge"] == 0.0


def test_weak_columns_go_first(data):
    x, y, df = data
    weight = lambda at: np.abs(fit(x[:, at], y)[1:]) * x[:, at].std(axis=0)
    left, gone = [0, 1, 2], []
    while len(left) > 1:
        gone.append(left.pop(int(np.argmin(weight(left)))))
    want = {COLUMNS[left[0]]: 1} | {COLUMNS[k]: 2 + i for i, k in enumerate(reversed(gone))}
    assert {r["feature"]: r["rank"] for r in S.recursive_elimination(df, COLUMNS, "y", 1).collect()} == want
    all_ = weight([0, 1, 2])
    assert {r["feature"] for r in S.select_from_model(df, COLUMNS, "y").collect()} == {c for c, v in zip(COLUMNS, all_) if v >= all_.mean()}


def test_samples_are_of_the_grid(spark):
    grid = {"a": [1, 2, 3], "b": ["x", "y"]}
    drawn = S.parameter_samples(spark, grid, 6, 1)
    assert len({tuple(d.values()) for d in drawn}) == 6 and drawn == S.parameter_samples(spark, grid, 6, 1)


def test_many_products_are_summed_in_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 25))
    rows = [(*map(float, r), i % 3) for i, r in enumerate(x)] + [(None, *[9.0] * 24, 0), (float("nan"), *[9.0] * 24, 1), (*[5.0] * 25, None)]
    names = [f"x{k}" for k in range(25)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", fold int").repartition(4)
    for width in (3, 25):  # as expressions, and in blocks
        got = S.fold_equations(df, names[: width - 1], names[width - 1], "fold")
        for k in range(3):
            z = np.column_stack([np.ones(30), x[np.arange(90) % 3 == k][:, :width]])
            assert np.allclose(got[k], z.T @ z) and len(got) == 3
    assert S.fold_equations(df.limit(0), names[:2], "x3", "fold") == {}
