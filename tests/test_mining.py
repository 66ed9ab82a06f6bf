"""Expressions, scores, search and the composed jobs, against brute force on small tables."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions import registry as reg
from factorloom.functions import timeseries as ts
from factorloom.plans import expressions as ex
from factorloom.plans import mining, scoring, search
from factorloom.plans.miner import FactorMiner

DAY = dt.date(2020, 1, 1)
DDL = "order_book_id int, date date, a double, b double, y double"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    n = 120
    rows = []
    for book in (1, 2, 3):
        a = rng.normal(size=n)
        b = np.round(rng.normal(size=n), 1)
        mean = pd.Series(a).rolling(3, min_periods=1).mean().to_numpy()
        y = 2 * mean + 0.01 * rng.normal(size=n)
        rows += [
            (book, DAY + dt.timedelta(days=i), float(a[i]), float(b[i]), float(y[i])) for i in range(n)
        ]
    return spark.createDataFrame(rows, DDL).repartition(4).cache()


def pandas_of(df):
    return df.toPandas().sort_values(["order_book_id", "date"]).reset_index(drop=True)


def rolling(data, column, size, call):
    return data.groupby("order_book_id")[column].transform(
        lambda s: getattr(s.rolling(size, min_periods=1), call)()
    )


def test_expression_shape():
    expr = ("safe_mul", ("ts_mean_5", "x0"), ("safe_log", ("ts_std_10", "x1")))
    functions = reg.default_registry()
    assert ex.text(expr) == "safe_mul(ts_mean_5(x0), safe_log(ts_std_10(x1)))"
    assert ex.size(expr) == 6 and ex.depth(expr) == 3 and ex.columns(expr) == {"x0", "x1"}
    assert ex.lookback(expr, functions) == 9
    assert ex.lookback(("ts_max_3", ("ts_min_5", "x")), functions) == 6
    with pytest.raises(ValueError, match="unknown function"):
        ex.check(("nope", "x"), functions)
    with pytest.raises(ValueError, match="takes 1"):
        ex.check(("ts_mean_5", "x", "y"), functions)


def test_registry_sizes():
    assert len(reg.default_registry((3, 5, 10, 20))) == 4 * 7 + 7
    assert list(reg.default_registry(use_custom_functions=False)) == list(reg.STANDARD)
    assert set(reg.custom_function_set()) == {f"ts_{f}_10" for f in ts.ROLLING}


@pytest.mark.parametrize("block_rows", [None, 50])
def test_nested_evaluation(table, block_rows):
    exprs = {
        "e": ("ts_sum_5", ("safe_sub", ("ts_max_3", "a"), "b")),
        "f": ("safe_div", ("ts_mean_10", ("ts_std_3", "b")), 0.0),
        "g": ("ts_mean_5", 2.0),
        "h": "a",
    }
    got = pandas_of(ex.evaluate(table, exprs, reg.default_registry(), block_rows=block_rows))
    got["inner"] = rolling(got, "a", 3, "max") - got["b"]
    np.testing.assert_allclose(got["e"], rolling(got, "inner", 5, "sum"), atol=1e-9)
    assert (got["f"] == 0).all() and (got["g"] == 2).all() and (got["h"] == got["a"]).all()


def test_deep_nesting_plans_quickly(table):
    expr = "a"
    for _ in range(12):
        expr = ("safe_sub", ("safe_abs", expr), 0.1)
    assert ex.evaluate(table, {"e": expr}, reg.default_registry()).filter("e IS NULL").count() == 0


def test_one_exchange_for_nested_windows(table):
    exprs = {"e": ("ts_sum_5", ("ts_max_3", ("ts_rank_10", "a")))}
    plan = ex.evaluate(table, exprs, reg.default_registry())._jdf.queryExecution().executedPlan()
    assert plan.toString().count("Exchange hashpartitioning(order_book_id") == 1
    assert plan.toString().count("Sort [order_book_id") == 1


def test_user_function(table):
    from factorloom.functions.windows import window_function

    spread = window_function(
        "spread", 4, lambda x, s: F.max(x).over(s.trailing(4)) - F.min(x).over(s.trailing(4))
    )
    functions = reg.default_registry() | reg.registry(
        [spread, reg.ScalarFunction("twice", 1, lambda x: x * 2)]
    )
    got = pandas_of(ex.evaluate(table, {"e": ("twice", ("spread", "a"))}, functions))
    want = 2 * (rolling(got, "a", 4, "max") - rolling(got, "a", 4, "min"))
    np.testing.assert_allclose(got["e"], want)


def test_scores_match_numpy(table):
    data = pandas_of(table)
    got = scoring.score_summary(table, "y", "b").first()
    y, p = data["y"], data["b"]
    assert got["mse"] == pytest.approx(((y - p) ** 2).mean())
    assert got["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got["ic"] == got["correlation"] == pytest.approx(np.corrcoef(y, p)[0, 1])
    assert got["rank_ic"] == pytest.approx(np.corrcoef(y.rank(), p.rank())[0, 1])


def test_scores_by_date(table):
    by_day = scoring.ic(table, "y", "a", by=["date"])
    assert by_day.count() == 120


def test_constant_prediction(table):
    flat = table.withColumn("p", F.lit(1.0))
    got = scoring.score_summary(flat, "y", "p").first()
    assert got["ic"] is None and got["rank_ic"] is None and got["mse"] > 0


def test_missing_pairs_are_ignored(frame):
    df = frame([(1.0, 1.0), (2.0, None), (None, 3.0), (4.0, 2.0), (math.nan, 1.0)], "y double, p double")
    assert scoring.mse(df, "y", "p").first()["mse"] == 2.0
    assert scoring.rank_ic(df, "y", "p").first()["rank_ic"] == pytest.approx(1.0)


def test_score_chunks_agree(table, monkeypatch):
    exprs = [("ts_mean_3", "a"), "b", ("safe_add", "a", "b"), ("ts_rank_5", "a"), 1.0]
    functions = reg.default_registry()
    whole = scoring.score_expressions(table, exprs, "y", functions).orderBy("id").collect()
    monkeypatch.setattr(scoring, "EXPRESSIONS_PER_JOB", 2)
    assert len(whole) == 5 and whole[0]["mse"] < 1.01 * min(r["mse"] for r in whole)
    for a, b in zip(whole, scoring.score_expressions(table, exprs, "y", functions).orderBy("id").collect(), strict=True):
        assert a["expression"] == b["expression"] and a["mse"] == pytest.approx(b["mse"])


SMALL = search.SearchSettings(
    population_size=60, generations=2, beam=5, max_depth=2, const_range=(-2.0, 2.0), max_samples=1.0
)


def test_search_equals_brute_force_in_its_first_round(table):
    """With room for every one-step formula the best of round 0 is the best of all of them."""
    functions = reg.default_registry((3, 5))
    settings = search.SearchSettings(
        population_size=10_000, generations=1, beam=3, max_depth=1, max_samples=1.0
    )
    found = search.search_factors(table, ["a", "b"], "y", functions, settings)
    everything = [
        "a", "b",
        *search.draw(["a", "b"], ["a", "b", *search.constant_table(settings)], functions, 1, 10**6, "any"),
    ]
    scores = scoring.score_expressions(table, everything, "y", functions).toPandas()
    best = (scores["mse"] + 0.01 * scores["size"]).min()
    assert found.mse + 0.01 * ex.size(found.best) == pytest.approx(best)


def test_search_finds_the_hidden_formula(table):
    functions = reg.registry([ts.rolling_function("mean", 3), *reg.math_functions()])
    settings = search.SearchSettings(
        population_size=400, generations=3, beam=6, max_depth=3, const_range=(-2.0, 2.0)
    )
    found = search.search_factors(table, ["a", "b"], "y", functions, settings)
    assert found.mse < 0.01 and "ts_mean_3" in found.expression
    again = search.search_factors(table, ["a", "b"], "y", functions, settings)
    assert again.expression == found.expression and again.history == found.history


def test_seeds_come_first_and_stop_early(table):
    seed = ("safe_mul", ("ts_mean_3", "a"), 2.0)
    settings = search.SearchSettings(
        population_size=1, generations=5, stopping_criteria=0.01, max_samples=1.0, max_depth=2
    )
    found = search.search_factors(table, ["a"], "y", reg.default_registry((3,)), settings, [seed])
    assert found.best == seed and found.rounds == 1
    with pytest.raises(ValueError, match="unknown function"):
        search.search_factors(table, ["a"], "y", reg.default_registry((3,)), settings, [("x", "a")])


def test_trials_skip_failures_and_keep_the_best(table):
    prepared = mining.prepare(table, ["a", "b"], "y")
    good = mining.MiningConfig(window_sizes=(3,), search=SMALL)
    plain = mining.MiningConfig(
        use_custom_functions=False, search=search.SearchSettings(population_size=2, generations=1)
    )
    broken = mining.MiningConfig(search=search.SearchSettings(generations=0))
    outcome = mining.trial_configs(prepared, [plain, broken, good])
    assert [h[0] for h in outcome.history] == [1, 3]
    assert outcome.best is good and outcome.best_mse == min(h[2] for h in outcome.history)


def test_workflow(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [
        (book, DAY + dt.timedelta(days=i), float(rng.uniform(5, 9)), float(rng.integers(1, 99)))
        for book in (1, 2)
        for i in range(150)
    ]
    bars = spark.createDataFrame(rows, "order_book_id int, date date, open double, volume double")
    factors = bars.selectExpr(
        "date", "order_book_id", "'f' as factor_name", "volume * 2 as factor_value"
    )
    config = mining.MiningConfig(window_sizes=(3,), search=SMALL)
    miner = FactorMiner(bars, config, factors, [("ts_mean_3", "open")])
    with pytest.raises(ValueError, match="train first"):
        _ = miner.expression
    miner.load("2020-01-01", "2020-05-29").prepare().train()
    assert set(miner.prepared.features) == {"open", "volume", "f"}
    path = str(tmp_path / "out")
    miner.save(path)
    values = spark.read.parquet(f"{path}/factor_values.parquet")
    assert values.columns == ["date", "order_book_id", "factor_value"]
    assert values.count() == miner.prepared.rows.count()
    stats = spark.read.json(f"{path}/factor_meta").first()
    assert stats["expression"] == miner.expression and stats["features"] == 3
    with pytest.raises(ValueError, match="is empty"):
        miner.load("2031-01-01", "2031-02-01")


def test_history_is_saved(table, spark, tmp_path):
    prepared = mining.prepare(table, ["a"], "y")
    model = mining.train(prepared, mining.MiningConfig(window_sizes=(3,), search=SMALL))
    model.history = [(1, "c, with comma", 0.5, 0.1, model.expression)]
    model.save(str(tmp_path / "m"))
    back = spark.read.option("header", True).csv(str(tmp_path / "m" / "training_history"))
    assert back.columns == ["trial", "config", "mse", "r2", "expression"]
    assert back.first()["config"] == "c, with comma"


def test_training_guard(table):
    prepared = mining.prepare(table, ["a"], "y")
    prepared.rows = prepared.rows.withColumn("y", F.lit(0.0))
    with pytest.raises(ValueError, match="hardly varies"):
        mining.train(prepared)
