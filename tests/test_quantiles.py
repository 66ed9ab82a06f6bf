"""Exact quantiles and ranks on awkward distributions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from factorloom.operators import quantiles as qu
from factorloom.operators.joins import split_join
from factorloom.operators.ranks import average_ranks, group_quantiles

PROBABILITIES = (0.0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)


@pytest.fixture(scope="module")
def awkward(spark):
    rng = np.random.default_rng(7)
    n = 12_000
    data = pd.DataFrame(
        {
            "normal": rng.normal(size=n),
            "mostly_zero": np.where(rng.random(n) < 0.7, 0.0, rng.exponential(size=n) * 1e9),
            "few_values": rng.integers(0, 4, n).astype(float),
            "constant": np.full(n, 3.5),
            "huge": np.concatenate([rng.normal(size=n - 3), [1e300, -1e300, 1e-300]]),
            "with_missing": np.where(rng.random(n) < 0.5, np.nan, rng.normal(size=n)),
            "group": rng.choice([0, 0, 0, 1, 2], n),
        }
    )
    return data, spark.createDataFrame(data).repartition(6)


@pytest.mark.parametrize("limits", [{}, {"exact_rows": 0}, {"exact_rows": 0, "fetch_rows": 20}])
def test_matches_pandas(awkward, limits):
    data, df = awkward
    columns = [c for c in data.columns if c != "group"]
    fitted = qu.fit_quantiles(df, columns, PROBABILITIES, **limits)
    for c in columns:
        for p in PROBABILITIES:
            want = data[c].quantile(p)
            assert fitted[c].at(p) == pytest.approx(want, rel=1e-9, abs=1e-9), (c, p)


def test_only_counts_and_values_of_regions_become_rows(awkward):
    """Values are placed in blocks: none is made a row to be counted, none outside of the regions is made one at all."""
    data, df = awkward
    rows = df.select("normal", "with_missing")
    cuts = {"normal": [-0.5, 0.0, 0.0001], "with_missing": [0.1]}
    counted = {(r["c"], r["g"]): (r["n"], r["low"], r["high"]) for r in qu._between_cuts(rows, cuts).collect()}
    for c, (name, own) in enumerate(cuts.items()):
        for g, part in data[name].dropna().groupby(np.searchsorted(own, data[name].dropna()) * 2):
            assert counted.pop((c, g)) == (len(part), part.min(), part.max())
    assert not counted
    regions = {"normal": [qu._Region("normal", [5], 0, 9, -0.3, -0.2), qu._Region("normal", [50], 30, 9, 0.1, 0.2)]}
    for frame in (qu._between_cuts(rows, cuts), qu._in_regions(rows, regions)):
        assert "Generate" not in frame._jdf.queryExecution().optimizedPlan().toString()
    found = sorted((r["g"], r["v"]) for r in qu._in_regions(rows, regions).collect())
    x = np.sort(data["normal"].to_numpy())
    assert found == [(0, v) for v in x[(x >= -0.3) & (x <= -0.2)]] + [(1, v) for v in x[(x >= 0.1) & (x <= 0.2)]]


def test_clamped_quantiles(awkward):
    data, df = awkward
    fitted = qu.fit_quantiles(df, ["normal"])["normal"]
    clipped = data["normal"].clip(-0.2, 0.3)
    for p in qu.QUARTILES:
        assert fitted.at(p, -0.2, 0.3) == pytest.approx(clipped.quantile(p))


def test_no_values(frame):
    fitted = qu.fit_quantiles(frame([(None,), (None,)], "x double"), ["x"])
    assert fitted["x"].n == 0 and fitted["x"].at(0.5) is None


def test_one_value(frame):
    fitted = qu.fit_quantiles(frame([(2.0,), (None,)], "x double"), ["x"], exact_rows=0)
    assert [fitted["x"].at(p) for p in (0, 0.3, 1)] == [2.0, 2.0, 2.0]


def test_group_quantiles(awkward):
    data, df = awkward
    got = group_quantiles(df, ["group"], "mostly_zero", PROBABILITIES).toPandas()
    want = data.groupby("group")["mostly_zero"].quantile(list(PROBABILITIES))
    assert len(got) == len(want)
    for row in got.itertuples():
        assert row.value == pytest.approx(want[row.group, row.p], rel=1e-9, abs=1e-9)


def test_average_ranks(frame):
    values = [3.0, 1.0, 1.0, 2.0, 3.0, 3.0, 9.0, -1.0]
    counts = frame([(v,) for v in values], "v double").groupBy("v").count()
    got = {
        r["v"]: r["rank"]
        for r in average_ranks(counts.withColumnRenamed("count", "n"), [], "v").collect()
    }
    assert got == dict(zip(values, pd.Series(values).rank(), strict=True))


def test_split_join_equals_join(frame):
    left = frame([(1 if i % 3 else i, i) for i in range(3000)], "k int, a int")
    right = frame([(i, -i) for i in range(1500)], "k int, b int")
    plain = sorted(map(tuple, left.join(right, "k").collect()))
    cut = split_join(left, right, ["k"], hot_keys=10, least=100)
    assert sorted(map(tuple, cut.collect())) == plain
