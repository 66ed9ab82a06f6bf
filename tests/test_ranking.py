"""Metrics, rows that count, orders of bars, and gap filling that stays linear."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from factorloom.functions import registry as reg
from factorloom.functions.timeseries import momentum_function
from factorloom.operators import profile, series
from factorloom.plans import scoring, search
from factorloom.sources import tables


@pytest.fixture
def moves(frame):
    rows = [("a", i, float((i * 37) % 11), float(-((i * 37) % 11)), float(i % 3)) for i in range(60)]
    return frame(rows, "order_book_id string, date int, y double, against double, other double")


def test_one_row_formula_is_not_ranked(moves):
    functions = reg.default_registry((3,)) | reg.registry([momentum_function(59)])
    exprs = [("ts_momentum_59", "other"), "other"]
    scores = scoring.score_expressions(moves, exprs, "y", functions)
    assert sorted(r["rows"] for r in scores.collect()) == [1, 60]  # the other window starts at 0
    assert [r["expression"] for r in scoring.rank_expressions(scores).collect()] == ["other"]
    assert len(scoring.rank_expressions(scores, least_rows=0.0).collect()) == 2


@pytest.mark.parametrize("metric", ["ic", "rank_ic"])
def test_metrics_take_either_sign(moves, metric):
    scores = scoring.score_on(
        series.lay_out(moves), ["other", "against"], "y", reg.default_registry((3,)), with_rank_ic=True
    )
    best = scoring.rank_expressions(scores, parsimony=0.0, metric=metric).first()
    assert best["expression"] == "against" and best["fitness"] == pytest.approx(-1.0)


def test_unknown_metric(moves):
    scores = scoring.score_expressions(moves, ["other"], "y", reg.default_registry((3,)))
    with pytest.raises(ValueError, match="unknown metric"):
        scoring.rank_expressions(scores, metric="sharpe")


def test_search_by_rank_ic_leaves_no_table(spark, moves):
    before = {t.name for t in spark.catalog.listTables()}
    settings = search.SearchSettings(
        population_size=5, generations=1, max_samples=1.0, metric="rank_ic", max_depth=2
    )
    functions = {n: f for n, f in reg.default_registry((3,)).items() if n in ("safe_abs", "ts_mean_3")}
    found = search.search_factors(moves, ["other", "against"], "y", functions, settings)
    assert found.best in ("against", ("safe_abs", "against"))
    assert {t.name for t in spark.catalog.listTables()} == before


def test_bar_orders(frame):
    ticks = frame([("a", "2024-01-01 10:00:00", 1), ("a", "2024-01-01 10:00:00", 2)],
                  "order_book_id string, datetime string, seq int")
    assert tables.bar_order(ticks, "tick") == ("datetime", "seq")
    with pytest.raises(ValueError, match="seq"):
        tables.bar_order(ticks.drop("seq"), "tick")
    with pytest.raises(ValueError, match="unknown bar source"):
        tables.bar_order(ticks, "week")
    keys = ["order_book_id"]
    assert tables.require_unique_order(ticks, keys, ("datetime", "seq")) is ticks
    with pytest.raises(ValueError, match="not unique"):
        tables.require_unique_order(ticks, keys, ("datetime",))


def test_gap_filling_is_linear(spark):
    """One instrument of 400,000 rows; a frame from each row to the end would take hours."""
    value = F.when(F.col("id") % 1000 == 999, F.col("id").cast("double"))
    rows = spark.range(400_000).select(F.lit("a").alias("order_book_id"), F.col("id").alias("date"), value.alias("v"))
    begun = time.perf_counter()
    filled = series.fill_gaps(rows, ["v"])
    row = filled.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n")).first()
    assert (row["low"], row["high"], row["n"]) == (999.0, 399_999.0, 400_000)
    assert time.perf_counter() - begun < 90


def test_profiles_per_group_equal_profiles_of_the_group(frame):
    rows = [(g, float(i * i % 17) if i % 5 else None) for g in "ab" for i in range(30 if g == "a" else 12)]
    data = frame(rows, "g string, v double")
    for row in profile.profile_target(data, "v", by=["g"]).collect():
        alone = profile.profile_target(data.filter(F.col("g") == row["g"]), "v").first().asDict()
        found = row.asDict()
        assert found.pop("g") in "ab" and found == pytest.approx(alone, nan_ok=True)
