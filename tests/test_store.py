"""The value store: the same scores as plain frames, one read for many searches, rounds that survive a stop."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from factorloom.functions import registry as reg
from factorloom.functions import timeseries as ts
from factorloom.operators.series import lay_out
from factorloom.plans import expressions as ex
from factorloom.plans import mining, moments, scoring, search, store

DAY = dt.date(2020, 1, 1)
FUNCTIONS = reg.default_registry((3, 7))
EXPRS = [
    "a", "gaps", ("ts_rank_3", "zero"), ("ts_rank_7", "late"), ("safe_add", "a", "b"), ("safe_sub", "a", ("safe_add", "b", 2.0)),
    ("safe_sub", "a", "a"), ("safe_add", "gaps", "a"), ("ts_median_7", ("safe_mul", "a", "b")), ("safe_div", "b", "zero"),
    ("safe_add", ("ts_std_7", "b"), ("safe_sub", "a", ("ts_std_7", "b"))), ("ts_max_3", ("ts_rank_7", ("safe_sub", "late", 0.0))),
    ("safe_log", ("safe_abs", "gaps")), ("safe_sqrt", "b"), ("ts_mean_7", 2.0), ("safe_sub", "y", ("safe_mul", "a", 1e-9)),
]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(21)
    rows = []
    for book, n in (("x", 260), (None, 90), ("z", 40)):
        a, b = rng.normal(size=n), np.round(rng.normal(size=n), 1)
        for i in range(n):
            gaps = None if rng.random() < 0.3 else float(rng.normal())
            late = 0.0 if book == "x" and i < 150 else float(rng.normal())  # zero for a while, not throughout
            y = None if i % 17 == 5 else float(a[i] + 0.1 * rng.normal())
            rows.append((book, DAY + dt.timedelta(days=i), float(a[i]), float(b[i]), gaps, 0.0, late, y))
    ddl = "order_book_id string, date date, a double, b double, gaps double, zero double, late double, y double"
    return spark.createDataFrame(rows, ddl).repartition(3).cache()


COLUMNS = ["a", "b", "gaps", "zero", "late", "y"]


def same(score, row):
    assert score.rows == row["rows"], row
    for name in ("mse", "r2", "ic"):
        got, want = getattr(score, name), row[name]
        assert (got is None) == (want is None), (name, score, row)
        assert got is None or got == pytest.approx(want, rel=1e-9, abs=1e-12), (name, score, row)


@pytest.mark.parametrize("block_rows", [None, 50])
def test_store_scores_equal_frames(table, block_rows):
    """On whole and on cut series, from plain columns and from kept formulas; NULL keys are a series too."""
    series = lay_out(table, before=20, block_rows=block_rows)
    where = F.col("a") > -1
    plain = store.ValueStore.build(series, COLUMNS, "y", [F.lit(True), where], FUNCTIONS, pack_rows=30)
    kept = plain.keep([("safe_mul", "a", "b"), ("ts_rank_7", ("safe_sub", "late", 0.0)), ("ts_std_7", "b")])
    assert plain.steps([EXPRS[8]]) == 2 and kept.steps([EXPRS[8]]) == 1
    for mask, condition in ((0, None), (1, where)):
        rows = {r["id"]: r for r in scoring.score_on(series, EXPRS, "y", FUNCTIONS, condition).collect()}
        for values in (plain, kept):
            scores, unknown = values.score({mask: EXPRS})
            assert {e for e in unknown if "ts_rank" not in ex.text(e)} == set()
            assert bool(unknown) == (block_rows is not None)
            for i, e in enumerate(EXPRS):
                if e not in unknown:
                    same(scores[mask, e], rows[i])


def test_packs_hold_whole_series(table):
    packs = store.ValueStore.build(lay_out(table), COLUMNS, "y", [F.lit(True)], FUNCTIONS, pack_rows=10).packs
    sizes = sorted(n for r in packs.collect() for n in np.frombuffer(r["sizes"], np.int64).tolist())
    assert sizes == [40, 90, 260]


def test_files_of_packs_have_small_row_groups(table, monkeypatch):
    """A file of large rows is not one row group, neither when packs are built nor when formulas are kept."""
    monkeypatch.setitem(store.PACK_FILES, "parquet.block.size", "256")
    spark, size = table.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, "10")
    series = lay_out(table.withColumn("order_book_id", F.pmod(F.hash("date"), F.lit(40)).cast("string")))
    plain = store.ValueStore.build(series, ["a", "b"], "y", [F.lit(True)], FUNCTIONS, pack_rows=1)
    spark.conf.unset(size)
    for values in (plain, plain.keep([("ts_mean_7", "a")])):
        files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in values.packs.inputFiles()]
        assert any(m.num_rows > 1 for m in files)
        assert all(m.num_row_groups == m.num_rows for m in files)


@pytest.mark.parametrize("reach", [0, 20])
def test_long_series_are_scored_in_pieces(spark, table, monkeypatch, reach):
    """Pieces of a long series give the scores of the whole one; what a piece of zeros does not tell is unknown."""
    monkeypatch.setattr(store, "PIECE_ROWS", 45)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "15")
    try:
        series, where = lay_out(table), F.col("a") > -1
        plain = store.ValueStore.build(series, COLUMNS, "y", [F.lit(True), where], FUNCTIONS, pack_rows=30, reach=reach)
        sizes = [n for r in plain.packs.collect() for n in np.frombuffer(r["sizes"], np.int64).tolist()]
        assert plain.split and max(sizes) <= 45 + 15 + reach and len(sizes) > 6
        exprs = [e for e in EXPRS if ex.lookback(e, FUNCTIONS) <= reach]
        kept = plain.keep([("safe_mul", "a", "b"), ("ts_std_7", "b")][: 1 + reach])
        for mask, condition in ((0, None), (1, where)):
            rows = {r["id"]: r for r in scoring.score_on(series, exprs, "y", FUNCTIONS, condition).collect()}
            for values in (plain, kept):
                scores, unknown = values.score({mask: exprs})
                assert {e for e in unknown if "ts_rank" not in ex.text(e)} == set()
                for i, e in enumerate(exprs):
                    if e not in unknown:
                        same(scores[mask, e], rows[i])
        small = {n: f for n, f in FUNCTIONS.items() if n in ("safe_add", "safe_mul", "ts_mean_3", "ts_rank_7")}
        found = search.search_on(series, ["a", "late"], "y", small, SETTINGS)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(store, "PIECE_ROWS", 10**6)
    whole = search.search_on(series, ["a", "late"], "y", small, SETTINGS)
    assert [h[:4] for h in found.history] == [h[:4] for h in whole.history]


OTHER_WORDS = [
    ("safe_add", "b", "a"), ("safe_sub", ("safe_add", "a", ("safe_add", 2.0, "b")), 0.0), ("safe_add", 0.0, "gaps"), "gaps",
    ("safe_add", ("safe_add", "gaps", 0.0), 0.0), ("safe_mul", "b", ("safe_mul", "gaps", 1.0)), ("safe_mul", "gaps", "b"),
    ("ts_rank_3", ("safe_sub", ("safe_mul", "a", "b"), 0.0)), ("ts_rank_3", ("safe_mul", "b", "a")), ("safe_mul", 0.0, "gaps"),
    ("safe_abs", ("safe_sqrt", "b")), ("safe_sqrt", "b"), ("safe_div", ("safe_log", "b"), 1.0), ("safe_div", 0.0, "b"), ("safe_div", "b", "b"),
    ("safe_sub", ("safe_log", "gaps"), ("safe_log", "gaps")), ("safe_add", ("safe_mul", 2.0, 3.0), "a"), ("safe_add", "late", ("ts_sum_3", "late")),
]


def test_formulas_of_the_same_values_are_scored_once(table, monkeypatch):
    series = lay_out(table)
    values = store.ValueStore.build(series, COLUMNS, "y", [F.lit(True)], FUNCTIONS)
    rows = {r["id"]: r for r in scoring.score_on(series, OTHER_WORDS, "y", FUNCTIONS).collect()}
    scores, _ = values.score({0: OTHER_WORDS})
    for i, e in enumerate(OTHER_WORDS):
        same(scores[0, e], rows[i])
    assert values.canonical(OTHER_WORDS[5]) != values.canonical(OTHER_WORDS[6])  # a missing value times 1 is 0
    assert values.canonical(OTHER_WORDS[2]) != "gaps"
    assert len({values.canonical(e) for e in OTHER_WORDS}) == 13
    monkeypatch.setattr(store.ValueStore, "_pass", lambda *a: pytest.fail("the rows were read again"))
    words = [("safe_add", "a", "b"), ("safe_add", ("ts_sum_3", "late"), "late"), ("ts_rank_3", ("safe_add", 0.0, ("safe_mul", "a", "b")))]
    told, _ = values.keep([("safe_mul", "a", "b")]).score({0: words})
    for e, old in zip(words, (0, 17, 8)):
        assert told[0, e] == scores[0, OTHER_WORDS[old]]


def test_a_pass_has_no_exchange_of_rows_and_a_plan_of_one_size(table):
    values = store.ValueStore.build(lay_out(table), COLUMNS, "y", [F.lit(True)], FUNCTIONS)
    again = values.keep([EXPRS[8], EXPRS[10]]).keep([EXPRS[11]])
    plans = [v.packs._jdf.queryExecution().executedPlan().toString() for v in (values, again)]
    assert all("Exchange" not in p and "Sort" not in p for p in plans)
    assert plans[0].count("\n") == plans[1].count("\n")


SETTINGS = search.SearchSettings(
    population_size=80, generations=4, beam=6, max_depth=4, const_range=(-2.0, 2.0), stopping_criteria=0.0
)


def columns_only(functions):
    """The same functions without kernels: the search falls back to frames."""
    from dataclasses import replace

    return {n: replace(f, kernel=None) for n, f in functions.items()}


@pytest.mark.parametrize("block_rows", [None, 60])
def test_searches_equal_a_replay_with_frames(table, block_rows):
    series = lay_out(table.fillna(0.0, ["gaps"]), before=40, block_rows=block_rows)
    small = {n: f for n, f in FUNCTIONS.items() if n in ("safe_add", "safe_mul", "safe_abs", "ts_mean_3", "ts_rank_7")}
    features = ["a", "b", "late"]
    found = search.search_on(series, features, "y", small, SETTINGS)
    replay = search.search_on(series, features, "y", columns_only(small), SETTINGS)
    assert found.expression == replay.expression and found.rounds == replay.rounds
    assert [h[:4] for h in found.history] == [h[:4] for h in replay.history]
    for one, two in zip(found.history, replay.history):
        assert one[4:] == pytest.approx(two[4:], rel=1e-8)


def test_all_settings_of_a_round_share_a_read(table, monkeypatch):
    prepared = mining.prepare(table, ["a", "b"], "y")
    configs = [
        mining.MiningConfig(window_sizes=w, search=search.SearchSettings(population_size=40, generations=g, beam=4, max_depth=3))
        for w, g in (((3,), 2), ((3, 5), 3), ((5,), 1))
    ]
    alone = [mining.trial_configs(prepared, [c]).history[0][2:] for c in configs]
    reads = []
    once = store.ValueStore.score
    monkeypatch.setattr(store.ValueStore, "score", lambda self, wanted: reads.append(1) or once(self, wanted))
    together = mining.trial_configs(prepared, configs)
    assert len(reads) == 3
    for one, two in zip(alone, together.history):
        assert one[2] == two[4] and one[:2] == pytest.approx(two[2:4])
    assert len(mining.trial_configs(prepared, configs, n_trials=1).history) == 1


def test_a_worker_gets_a_few_packs_at_a_time(spark, table, monkeypatch):
    """A pack is a row of megabytes: rows of a batch are limited while packs are read, and only then."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, merged = spark.conf.get(name), moments.merged
    monkeypatch.setattr(moments, "merged", lambda parts: seen.append(int(spark.conf.get(name))) or merged(parts))
    values = store.ValueStore.build(lay_out(table), COLUMNS, "y", [F.lit(True)], FUNCTIONS)
    written = store.materialize
    monkeypatch.setattr(store, "materialize", lambda *a, **k: seen.append(int(spark.conf.get(name))) or written(*a, **k))
    values.keep([EXPRS[8]]).score({0: [EXPRS[8]]})
    assert len(seen) == 2 and max(seen) <= 8 and spark.conf.get(name) == before


def test_survivors_of_several_searches_make_no_packs_of_their_own(table, monkeypatch):
    """Their parts are evaluated again from the plain columns: packs stay as small as they were built."""
    written, steps = [], []
    once, counted = store.materialize, store.ValueStore.steps
    monkeypatch.setattr(store, "materialize", lambda df, label, **k: written.append(len(df.columns)) or once(df, label, **k))
    monkeypatch.setattr(store.ValueStore, "steps", lambda self, exprs: steps.append(counted(self, exprs)) or steps[-1])
    settings = search.SearchSettings(population_size=150, generations=4, beam=120, max_depth=4, stopping_criteria=0.0, parsimony_coefficient=0.0)
    searches = [search.Search(["a", "b", "late"], FUNCTIONS, settings) for _ in range(2)]
    search.search_all(lay_out(table), "y", searches)
    assert max(steps) > 60 and written == [7]  # cut, sizes, mask, target and the columns


class Stopped(Exception):
    pass


@pytest.mark.parametrize("after", [1, 2])
def test_a_stopped_search_goes_on_where_it_was(table, tmp_path, monkeypatch, after):
    path, features = f"{tmp_path}/journal", ["a", "b"]
    whole = search.search_factors(table, features, "y", FUNCTIONS, SETTINGS)
    rounds = []
    once = search._Blocks.tops

    def stopping(self, searches):
        if len(rounds) == after:
            raise Stopped
        rounds.append(1)
        return once(self, searches)

    monkeypatch.setattr(search._Blocks, "tops", stopping)
    with pytest.raises(Stopped):
        search.search_factors(table, features, "y", FUNCTIONS, SETTINGS, journal=path)
    rest = []
    monkeypatch.setattr(search._Blocks, "tops", lambda self, searches: rest.append(1) or once(self, searches))
    resumed = search.search_factors(table, features, "y", FUNCTIONS, SETTINGS, journal=path)
    assert len(rest) == whole.rounds - after
    assert resumed.expression == whole.expression and resumed.history == whole.history
    again = search.search_factors(table, features, "y", FUNCTIONS, SETTINGS, journal=path)
    assert len(rest) == whole.rounds - after and again.history == whole.history
    with pytest.raises(ValueError, match="other settings"):
        search.search_factors(table, ["a"], "y", FUNCTIONS, SETTINGS, journal=path)


def test_searches_leave_no_table(spark, table):
    before = {t.name for t in spark.catalog.listTables()}
    prepared = mining.prepare(table, ["a", "b"], "y")
    mining.train(prepared, mining.MiningConfig(window_sizes=(3,), search=SETTINGS))
    with pytest.raises(ValueError, match="could be scored"):
        mining.train(prepared, mining.MiningConfig(search=search.SearchSettings(generations=0)))
    assert {t.name for t in spark.catalog.listTables()} == before


# ---- linear formulas from second moments -------------------------------------------------------


def test_linear_scores_equal_the_explode_path(table, monkeypatch):
    rng = random.Random(2)
    atoms = ["a", "b", "gaps", "late", "zero", 1.5, -3.0]

    def grown(depth):
        return rng.choice(atoms) if not depth else (rng.choice(["safe_add", "safe_sub"]), grown(depth - 1), grown(rng.randrange(depth)))

    exprs = [e for e in dict.fromkeys(grown(rng.randint(1, 4)) for _ in range(150)) if ex.columns(e)]
    exprs += [("ts_mean_3", "a"), "b", ("safe_sub", "a", "a"), ("safe_sub", "b", ("safe_add", "b", 1.0))]
    got = {r["id"]: r for r in scoring.score_expressions(table, exprs, "y", FUNCTIONS).collect()}
    monkeypatch.setattr(scoring, "LEAST_LINEAR", 10**9)
    want = {r["id"]: r for r in scoring.score_expressions(table, exprs, "y", FUNCTIONS).collect()}
    assert len(got) == len(want) == len(exprs)
    for i, row in want.items():
        assert got[i]["expression"] == row["expression"] and got[i]["size"] == row["size"]
        found = moments.Score(*(got[i][n] for n in ("rows", "mse", "r2", "ic")))
        weights = moments.linear_form(exprs[i], moments.signs(FUNCTIONS))[1]
        if found.ic is None and not any(w for part, w in weights.items() if part != "zero"):
            found = found._replace(ic=row["ic"])  # a constant: row by row its spread is what rounding leaves
        same(found, row)


def test_thousands_of_linear_formulas_cost_one_read(table, monkeypatch):
    whole = table.fillna(0.0, ["gaps"])
    columns = ["a", "b", "gaps", "late"]
    exprs = [(f, x, ("safe_add", z, float(c))) for f in ("safe_add", "safe_sub") for x in columns for z in columns if x != z for c in range(100)]
    reads = []
    once = moments.matrix_of
    monkeypatch.setattr(moments, "matrix_of", lambda *a: reads.append(1) or once(*a))
    monkeypatch.setattr(scoring, "score_on", lambda *a: pytest.fail("values were made row by row"))
    scores = scoring.score_expressions(whole, exprs, "y", FUNCTIONS)
    assert scores.count() == len(exprs) == 2400 and len(reads) == 1


def test_moments_merge_without_cancelling(spark):
    """Values of 1e9 apart by noise, over many tasks."""
    rng = np.random.default_rng(6)
    x = 1e9 + rng.normal(size=3000)
    y = 2e9 + 0.5 * (x - 1e9) + rng.normal(size=3000)
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(11)
    got = moments.score_linear(rows, ["x"], "y", FUNCTIONS)["x"]
    assert got.ic == pytest.approx(np.corrcoef(x, y)[0, 1], rel=1e-9)
    assert got.mse == pytest.approx(((x - y) ** 2).mean(), rel=1e-9)
    assert ts.rolling_function("mean", 3).kernel is not None
