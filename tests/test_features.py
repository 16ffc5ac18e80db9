import numpy as np
import pytest

from marlstone.functions.expressions import normal_quantile
from marlstone.operators import features as X
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(0)
    values = [(int(i), float(a), None if i % 11 == 0 else float(b)) for i, (a, b) in enumerate(rng.normal(5, 2, (200, 2)))]
    return spark.createDataFrame(values, "id int, a double, b double")


def column(df, name):
    return np.array([r[0] for r in df.orderBy("id").select(name).collect()], float)


@pytest.mark.parametrize("scaler", [X.StandardScaler, X.MinMaxScaler, X.MaxAbsScaler, X.RobustScaler])
def test_scalers_invert(frame, scaler):
    s = scaler(["a", "b"]).fit(frame)
    back = s.inverse_transform(s.transform(frame))
    assert np.allclose(column(back, "a"), column(frame, "a"))
    assert np.isnan(column(back, "b")).sum() == np.isnan(column(frame, "b")).sum()


def test_standard_scaler_uses_population_deviation(frame):
    out = column(X.StandardScaler(["a"]).fit_transform(frame), "a")
    assert abs(out.mean()) < 1e-9 and abs(out.std() - 1) < 1e-9


def test_constant_column_does_not_divide_by_zero(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 3.0)], "id int, a double")
    for scaler in (X.StandardScaler, X.MinMaxScaler, X.RobustScaler):
        assert np.isfinite(column(scaler(["a"]).fit_transform(df), "a")).all()


def test_quantile_transform_is_numpy_interp(frame):
    a = column(frame, "a")
    points = np.linspace(0, 1, 10)
    want = np.interp(a, np.percentile(a, 100 * points), points)
    assert np.allclose(column(X.QuantileTransformer(["a"], 10).fit_transform(frame), "a"), want)


def test_normal_quantile(spark):
    got = spark.range(1).select(normal_quantile(F.lit(0.975)), normal_quantile(F.lit(0.5)), normal_quantile(F.lit(0.001))).first()
    assert np.allclose(list(got), [1.959964, 0.0, -3.090232], atol=1e-5)


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 1.0), (4, 1.0), (5, None)], "id int, a double")
    assert column(X.SimpleImputer(["a"], "most_frequent").fit_transform(df), "a")[4] == 1.0


def test_column_without_values_becomes_zero(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, a double")
    assert column(X.SimpleImputer(["a"]).fit_transform(df), "a").tolist() == [0.0, 0.0]


def test_one_hot_rejects_unknown_values(spark):
    df = spark.createDataFrame([(1, "x"), (2, "z")], "id int, c string")
    with pytest.raises(Exception, match="unknown category"):
        X.one_hot(df, "c", ["x", "y"], unknown="error").collect()
    assert X.one_hot(df, "c", ["x", "y"]).filter("id = 2").select("c_x", "c_y").first()[:] == (0.0, 0.0)


def test_pipeline_fits_each_step_on_the_last(frame):
    out = column(X.standard_pipeline(["b"], outliers=True).fit_transform(frame), "b")
    assert not np.isnan(out).any() and abs(out.mean()) < 1e-9
