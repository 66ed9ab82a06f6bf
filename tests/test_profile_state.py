"""A profile merged from stored periods equals the profile of the whole table."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from factorloom.operators import profile, profile_state
from factorloom.operators.profile_state import ProfileState
from factorloom.sources import market_views

FIRST = dt.date(2021, 1, 29)
DDL = "date date, x double, y double"


def rows_of(day: int, n: int, rng) -> list[tuple]:
    date = FIRST + dt.timedelta(days=day)
    x = np.round(rng.standard_t(3, n) * (day + 1) + 1e3 * (day % 3), 2)
    # zeros, ties, missing values and NaN
    x[::7] = 0.0
    x[::11] = -0.0
    y = [None if i % 5 == 0 else float("nan") if i % 9 == 0 else 2.5 for i in range(n)]
    return [(date, float(a), b) for a, b in zip(x, y, strict=True)]


def one(df):
    return df.first().asDict()


@pytest.fixture
def rows():
    rng = np.random.default_rng(5)
    return [r for day in range(8) for r in rows_of(day, 150, rng)]


@pytest.fixture
def state(spark, tmp_path):
    return lambda **kw: ProfileState(spark, str(tmp_path / "state"), ["x", "y"], **kw)


@pytest.mark.parametrize(("grain", "fetch", "bits"), [("day", 10_000, 12), ("month", 60, 3)])
def test_equals_the_whole_profile(frame, state, rows, monkeypatch, grain, fetch, bits):
    monkeypatch.setattr(profile_state, "FETCH_ROWS", fetch)
    monkeypatch.setattr(profile_state, "BLOCK_BITS", bits)
    table, kept = frame(rows, DDL), state(grain=grain)
    kept.refresh(table)
    for column in ("x", "y"):
        assert one(kept.profile(column)) == pytest.approx(one(profile.profile_target(table, column)))
    by_name = lambda df: sorted((r["column"], *r.asDict().values()) for r in df.collect())
    want = {r["column"]: r.asDict() for r in profile.feature_quality(table, ["x", "y"]).collect()}
    got = {r["column"]: r.asDict() for r in kept.feature_quality().collect()}
    assert {k: pytest.approx(v, abs=1e-9) for k, v in want.items()} == got
    assert by_name(kept.null_profile()) == by_name(profile.null_profile(table, ["x", "y"]))


def test_a_refresh_of_one_day_reads_that_day(spark, frame, state, rows, tmp_path):
    path = str(tmp_path / "table")
    frame(rows, DDL).write.partitionBy("date").parquet(path)
    kept = state()
    kept.refresh(spark.read.parquet(path))
    day = FIRST + dt.timedelta(days=4)
    changed = [r for r in rows if r[0] != day] + rows_of(4, 60, np.random.default_rng(9))
    frame(changed, DDL).write.partitionBy("date").mode("overwrite").parquet(path)
    # files of other days that cannot be read would end the refresh
    broken = [f for f in (tmp_path / "table").glob("date=*/*.parquet") if str(day) not in str(f)]
    held = {f: f.read_bytes() for f in broken}
    for f in broken:
        f.write_bytes(b"not a table")
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    kept.refresh(spark.read.schema(DDL).parquet(path), [day])
    for f, data in held.items():
        f.write_bytes(data)
    want = one(profile.profile_target(spark.read.schema(DDL).parquet(path), "x"))
    assert one(kept.profile("x")) == pytest.approx(want)


def test_a_touched_day_without_rows_is_emptied(frame, state, rows):
    kept = state()
    kept.refresh(frame(rows, DDL))
    day = FIRST + dt.timedelta(days=2)
    left = [r for r in rows if r[0] != day]
    kept.refresh(frame(left, DDL), [str(day)])
    assert one(kept.profile("x")) == pytest.approx(one(profile.profile_target(frame(left, DDL), "x")))


def test_empty_table_dateless_rows_and_infinities(frame, state):
    kept = state()
    kept.refresh(frame([], DDL))
    assert one(kept.profile("x")) == one(profile.profile_target(frame([], DDL), "x"))
    rows = [(None, 3.0, None), (FIRST, 1.0, float("inf")), (FIRST, 8.0, 1.0), (FIRST, 8.0, None)]
    kept.refresh(frame(rows, DDL))
    assert one(kept.profile("x")) == pytest.approx(one(profile.profile_target(frame(rows, DDL), "x")))
    got, want = one(kept.profile("y")), one(profile.profile_target(frame(rows, DDL), "y"))
    for name in ("rows", "count", "missing_count", "infinite_count", "quality_ok", "min", "max", "distinct_values"):
        assert got[name] == want[name]


def test_a_torn_refresh_is_found(spark, frame, state, rows):
    kept = state()
    kept.refresh(frame(rows, DDL))
    kept._write(profile_state._blocks(spark.createDataFrame([], "part date, c int, v double")), "blocks", [FIRST], "new", "c")
    with pytest.raises(ValueError, match="did not end"):
        kept.profile("x")


def test_distinct_values_by_sketch(frame, state, rows):
    kept = state()
    kept.refresh(frame(rows, DDL))
    exact = kept.distinct("x")
    assert exact == len({r[1] for r in rows})
    assert abs(kept.distinct("x", exact=False) - exact) <= 0.05 * exact


def test_tasks_of_a_refresh_follow_the_rows(spark, frame, state, rows, monkeypatch):
    """More values, more shuffle partitions; the session's number is put back, and the profile is the same."""
    name, table = "spark.sql.shuffle.partitions", frame(rows, DDL)
    before, seen = spark.conf.get(name), []
    write = ProfileState._write
    monkeypatch.setattr(ProfileState, "_write", lambda *a: seen.append(spark.conf.get(name)) or write(*a))
    kept = state()
    kept.refresh(table)
    want = one(kept.profile("x"))
    monkeypatch.setattr(profile_state, "TASK_ROWS", 200)
    kept.refresh(table)
    assert seen == [before] * 2 + ["12"] * 2 and spark.conf.get(name) == before
    assert one(kept.profile("x")) == pytest.approx(want)


def test_tasks_that_make_bars_follow_the_trades(spark, frame, tmp_path, monkeypatch):
    trades = [
        (i // 3, i % 3, i % 5, float(1 + i % 7), 10.0 * (i % 11 + 1), "RAN"[i % 3], dt.datetime(2020, 1, 1 + i % 4))
        for i in range(300)
    ]
    ddl = "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp"
    frame(trades, ddl).write.parquet(f"{tmp_path}/lineitem.parquet")
    plain = sorted(map(str, market_views.bars(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(market_views, "TASK_ROWS", 15)
    bars = market_views.bars(spark, str(tmp_path))
    assert bars.rdd.getNumPartitions() == 20 and sorted(map(str, bars.collect())) == plain
