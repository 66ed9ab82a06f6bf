from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import prep
from factorloom.operators.schema import feature_columns

TARGET = "y"


def reference(data, features):
    """The documented steps on a small pandas table."""
    d = data.dropna(subset=[*features, TARGET])
    kept = [c for c in features if d[c].std() > 1e-8]
    x = d[kept].copy()
    for c in kept:
        q1, q3 = x[c].quantile(0.25), x[c].quantile(0.75)
        x[c] = x[c].clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    x = x[[c for c in kept if x[c].std() >= 1e-8]]
    spread = (x.quantile(0.75) - x.quantile(0.25)).replace(0, 1)
    x = (x - x.median()) / spread
    y = d[TARGET]
    iqr = y.quantile(0.75) - y.quantile(0.25)
    x[TARGET] = (y - y.median()) / iqr if iqr > 1e-8 else (y - y.mean()) / y.std()
    return x.assign(k=d["k"]).set_index("k").sort_index()


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 300
    data = pd.DataFrame(
        {
            "k": range(n),
            "a": rng.standard_t(2, n),
            "b": np.where(rng.random(n) < 0.1, np.nan, rng.normal(size=n)),
            "constant": np.full(n, 2.0),
            "mostly_constant": np.where(np.arange(n) < 30, 5.0, 1.0),
            "y": rng.standard_t(3, n),
        }
    )
    return data, spark.createDataFrame(data).repartition(4)


@pytest.mark.parametrize("exact_rows", [None, 0])
def test_steps_in_order(table, exact_rows):
    data, df = table
    features = ["a", "b", "constant", "mostly_constant"]
    fitted = prep.fit_prep(df, features, TARGET, exact_rows=exact_rows)
    assert list(fitted.features) == ["a", "b"]
    got = fitted.transform(df).toPandas().set_index("k").sort_index()
    want = reference(data, features)
    pd.testing.assert_frame_equal(got[["a", "b", "y"]], want[["a", "b", "y"]], check_names=False)


def test_target_without_iqr(table):
    data, df = table
    odd = df.withColumn("y", F.when(F.col("k") < 20, F.col("k").cast("double")).otherwise(1.0))
    scale = prep.fit_target_scale(odd, TARGET)
    y = pd.Series([float(k) if k < 20 else 1.0 for k in range(300)])
    assert (scale.center, scale.scale) == pytest.approx((y.mean(), y.std()))


def test_guards(table, frame):
    _, df = table
    with pytest.raises(ValueError, match="target hardly varies"):
        prep.fit_prep(df.withColumn("y", F.lit(1.0)), ["a"], TARGET)
    with pytest.raises(ValueError, match="no feature"):
        prep.fit_prep(df, ["constant"], TARGET)
    with pytest.raises(ValueError, match="no feature"):
        prep.drop_low_variance(df, ["constant"])
    with pytest.raises(ValueError, match="no complete row"):
        prep.fit_prep(frame([(None, 1.0)], "a double, y double"), ["a"], TARGET)
    with pytest.raises(ValueError, match="unknown scaling"):
        prep.fit_prep(df, ["a"], TARGET, "standard")


def test_minmax(table):
    data, df = table
    got = prep.minmax_scale(df, ["a", "constant"]).toPandas().sort_values("k")
    span = data["a"].max() - data["a"].min()
    np.testing.assert_allclose(got["a"], (data["a"] - data["a"].min()) / span)
    assert (got["constant"] == 0).all()
    fitted = prep.fit_prep(df, ["a"], TARGET, "minmax").transform(df).toPandas()
    assert fitted["a"].min() == 0 and fitted["a"].max() == 1


def test_infinite_rows_are_dropped_after_cleaning(frame):
    from factorloom.operators.filters import inf_to_null

    rows = [(float(i), float(i * i)) for i in range(10)] + [(math.inf, 1.0), (math.nan, 1.0)]
    df = inf_to_null(frame(rows, "a double, y double"))
    assert prep.fit_prep(df, ["a"], TARGET).transform(df).count() == 10


def test_split_is_stable_and_sized(spark):
    df = spark.range(20000).select(F.col("id").alias("order_book_id"), F.lit("2020-01-01").alias("date"))
    train, valid = prep.train_valid_split(df)
    again = prep.train_valid_split(df.repartition(13))[1]
    assert train.count() + valid.count() == 20000
    assert valid.count() == again.count() == again.intersect(valid).count()
    assert abs(valid.count() / 20000 - 0.2) < 0.01
    assert abs(prep.sample_rows(df).count() / 20000 - 0.9) < 0.01


def test_feature_columns(frame):
    df = frame(
        [], "order_book_id int, date date, open double, volume bigint, note string, "
        "prev_close double, num_trades int, y double"
    )
    assert feature_columns(df, "y") == ["open", "volume"]
    assert feature_columns(df, "y", ["note"]) == ["note"]
