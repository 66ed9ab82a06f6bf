from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from factorloom.operators import filters
from factorloom.operators import profile as pr
from factorloom.operators.joins import group_join

DAY = dt.date(2020, 1, 1)


def column(frame, values):
    return frame([(v,) for v in values], "x double")


def one(df):
    return df.first().asDict()


@pytest.fixture
def values():
    rng = np.random.default_rng(3)
    return [float(v) for v in np.round(rng.standard_t(3, 500), 2)] + [0.0] * 40


def test_profile_matches_pandas(frame, values):
    got = one(pr.profile_target(column(frame, values), "x"))
    x = pd.Series(values)
    assert got["skew"] == pytest.approx(x.skew())
    assert got["kurt"] == pytest.approx(x.kurtosis())
    assert got["std"] == pytest.approx(x.std())
    assert got["median"] == x.median()
    assert got["distinct_values"] == x.nunique()
    assert got["zero_count"] == (x == 0).sum()
    q1, q3 = x.quantile(0.25), x.quantile(0.75)
    outside = ((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))).sum()
    assert got["outlier_count"] == outside
    for p in pr.REPORT_QUANTILES:
        assert got[f"q{round(p * 100):02d}"] == pytest.approx(x.quantile(p))


def test_profile_is_the_same_when_large(frame, values):
    small = one(pr.profile_target(column(frame, values), "x"))
    large = one(pr.profile_target(column(frame, values), "x", exact_rows=0))
    assert large == pytest.approx(small)


@pytest.mark.parametrize("values", [[], [1.0], [1.0, 2.0], [1.0, 2.0, 4.0], [5.0] * 6])
def test_moments_of_short_and_constant_columns(frame, values):
    got = one(pr.skew_sample(column(frame, values), "x")) | one(
        pr.kurt_sample(column(frame, values), "x")
    )
    for name, want in (("skew", pd.Series(values).skew()), ("kurt", pd.Series(values).kurtosis())):
        if math.isnan(want):
            assert got[name] is None
        else:
            assert got[name] == pytest.approx(want)


def test_describe_by_group(frame):
    rows = [(g, float(v)) for g in ("a", "b", None) for v in range(len(g or "abc") + 3)]
    df = frame(rows, "g string, x double")
    got = {r["g"]: r for r in pr.describe_column(df, "x", by=["g"]).collect()}
    want = pd.DataFrame(rows, columns=["g", "x"]).groupby("g", dropna=False)["x"].describe()
    assert len(got) == 3
    assert got["a"]["q25"] == want.loc["a", "25%"]
    assert got[None]["q75"] == want.iloc[-1]["75%"]
    assert got["b"]["std"] == pytest.approx(want.loc["b", "std"])


def test_missing_and_infinite(frame):
    df = column(frame, [1.0, None, math.nan, math.inf, -math.inf])
    assert one(pr.missing_inf_counts(df, "x")) == {
        "missing_count": 2,
        "infinite_count": 2,
        "quality_ok": False,
    }
    clean = filters.inf_to_null(df)
    assert clean.filter("x IS NULL").count() == 4


def test_approximate_options(frame, values):
    got = one(pr.quantiles(column(frame, values), "x", (0.5,), exact=False))
    assert got["q50"] == pytest.approx(pd.Series(values).median(), abs=0.1)
    assert one(pr.row_and_distinct(column(frame, values), "x", exact=False))["rows"] == len(values)


def test_sigma_filter(frame):
    df = column(frame, [0.0] * 400 + [1.0, 100.0])
    assert filters.sigma_outlier_filter(df, "x").count() == 401
    assert filters.sigma_outlier_filter(column(frame, [5.0] * 4), "x").count() == 4
    assert filters.sigma_outlier_filter(column(frame, [5.0]), "x").count() == 1


def bars(frame, opens, book=1):
    rows = [(book, DAY + dt.timedelta(days=i), o) for i, o in enumerate(opens)]
    return frame(rows, "order_book_id int, date date, open double")


def verdict(frame, opens):
    checks = pr.validate_bars(bars(frame, opens), DAY, DAY + dt.timedelta(days=400)).collect()
    return {r["check"]: r for r in checks}


def test_validation(frame):
    good = verdict(frame, [100.0 + i % 7 for i in range(60)])
    assert good["verdict"]["ok"] and good["rows"]["value"] == 60
    assert good["target_missing"]["value"] == 20
    flat = verdict(frame, [5.0] * 60)
    assert not flat["verdict"]["ok"] and not flat["price_std"]["ok"]
    short = verdict(frame, [1.0, 2.0])
    assert not short["verdict"]["ok"]
    zero = verdict(frame, [0.0] + [float(i) for i in range(1, 60)])
    assert zero["target_infinite"]["value"] == 1 and not zero["target_infinite"]["ok"]


def test_null_profile(frame):
    df = frame([(1, None, 1.0), (2, "a", math.nan)], "a int, b string, c double")
    got = {r["column"]: (r["nulls"], r["percent"]) for r in pr.null_profile(df).collect()}
    assert got == {"b": (1, 50.0), "c": (1, 50.0)}


def test_incomplete_day(frame):
    def rows(last_hour):
        return frame(
            [
                (1, DAY, dt.datetime(2020, 1, 1, 15)),
                (1, DAY + dt.timedelta(days=1), dt.datetime(2020, 1, 2, 9)),
                (2, DAY + dt.timedelta(days=1), dt.datetime(2020, 1, 2, last_hour, 0)),
            ],
            "order_book_id int, date date, datetime timestamp_ntz",
        )

    assert filters.drop_incomplete_day(rows(14)).count() == 1
    assert filters.drop_incomplete_day(rows(15)).count() == 3


def test_safe_functions(frame):
    from pyspark.sql import functions as F

    from factorloom.functions import scalars as sc

    rows = [(v,) for v in (None, math.nan, math.inf, -math.inf, 0.0, -2.0, 1e-12, -1e-12, 1e300, 4.0)]
    x = F.col("x")
    made = {
        "num": sc.nan_to_num(x), "finite": sc.finite(x), "log": sc.safe_log(x), "sqrt": sc.safe_sqrt(x),
        "abs": sc.safe_abs(x), "inv": sc.safe_inv(x), "sq": sc.safe_mul(x, x), "div": sc.safe_div(x, x),
        "clip": sc.clip_bounds(x, -1.0, 3.0),
    }
    got = frame(rows, "x double", 1).select(*[c.alias(n) for n, c in made.items()]).collect()
    got = {n: [r[n] for r in got] for n in made}
    assert got["num"] == [0, 0, 0, 0, 0, -2.0, 1e-12, -1e-12, 1e300, 4.0]
    assert got["finite"] == [None] * 4 + [0.0, -2.0, 1e-12, -1e-12, 1e300, 4.0]
    assert got["log"][:6] == [0.0] * 6 and got["log"][9] == pytest.approx(math.log(4))
    assert got["sqrt"][:6] == [0.0] * 6 and got["sqrt"][9] == 2.0
    assert got["abs"][:5] == [0.0] * 5 and got["abs"][5] == 2.0
    assert got["inv"] == pytest.approx([0, 0, 0, 0, 0, -0.5, 1e10, -1e10, 1e-300, 0.25])
    assert got["sq"][8] == 0.0 and got["sq"][9] == 16.0
    assert got["div"] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 1]
    assert got["clip"][0] is None and got["clip"][5] == -1.0 and got["clip"][9] == 3.0


def test_rows_of_hot_groups_meet_their_marks_without_a_shuffle_by_group(frame):
    """Hot, small, missing and markless groups; only the rows of the others are shuffled."""
    groups = ["hot"] * 60 + [None] * 40 + ["a", "b", "b"]
    rows = frame([(g, float(i)) for i, g in enumerate(groups)], "g string, x double")
    marks = frame([("hot", 1), (None, 2), ("a", 3)], "g string, m int")
    got = group_join(rows, marks, ["g"], hot_keys=4, least=10)
    want = {"hot": 1, None: 2, "a": 3, "b": None}
    assert sorted((r["x"], r["m"]) for r in got.collect() if r["g"] != "b") == [
        (float(i), want[g]) for i, g in enumerate(groups) if g != "b"
    ]
    assert [r["m"] for r in got.collect() if r["g"] == "b"] == [None, None]
    assert "Union" in got._jdf.queryExecution().optimizedPlan().toString()
    plain = group_join(rows, marks, ["g"])
    assert sorted(map(str, plain.collect())) == sorted(map(str, got.collect()))


def test_grouped_profiles_of_hot_groups_equal_the_plain_ones(frame, values, monkeypatch):
    df = frame([("ab"[i % 7 == 0], v) for i, v in enumerate(values)] + [(None, 1.0)], "g string, x double")
    calls = [lambda: pr.profile_target(df, "x", by=["g"]), lambda: pr.iqr_outliers(df, "x", by=["g"])]
    plain = [sorted(map(str, call().collect())) for call in calls]
    used = []
    hot = lambda *a: used.append(1) or group_join(*a, least=5)
    monkeypatch.setattr(pr, "group_join", hot)
    assert [sorted(map(str, call().collect())) for call in calls] == plain and len(used) == 2
