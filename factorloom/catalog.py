"""Registered queries: each runs one operator over whole tables of a data folder."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factorloom.functions import registry as reg
from factorloom.functions import scalars, timeseries
from factorloom.operators import filters, prep, profile, reshape, schema, series
from factorloom.operators.profile_state import ProfileState
from factorloom.plans import expressions as ex
from factorloom.plans import mining, scoring, search
from factorloom.plans.loading import TARGET, load_training_table
from factorloom.session import materialize, scratch_path
from factorloom.sources import calendar, tables
from factorloom.sources import market_views as views
from factorloom.sources.aligned import AlignedStore
from factorloom.streaming.refresh import RefreshJob

Query = Callable[[SparkSession, str], DataFrame]

# The date range of the range scans, and how far targets look ahead.
RANGE = ("1996-01-01", "1998-12-31")
PAD_DAYS = 20

KEYS = ["order_book_id", "date"]
FEATURES = ["open", "high", "low", "close", "volume"]
BAR_SCHEMA = "order_book_id string, date date, open double, volume bigint, num_trades int"

QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        return run

    return add


def rounded(df: DataFrame, digits: int = 6, columns: Sequence[str] | None = None) -> DataFrame:
    """Round floating columns so that two engines agree; adding 0 removes a negative zero."""
    chosen = columns or [n for n, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in chosen})


def bars_schema() -> StructType:

    return StructType.fromDDL(BAR_SCHEMA)


def whole(spark: SparkSession, folder: str) -> tuple[dt.date, dt.date]:
    """The range whose padded end is the last stored day, so that target queries use every bar."""
    stored = views.calendar(spark, folder).agg(F.min("date"), F.max("date")).first()
    first, last = stored[0] or calendar.GLOBAL_START, stored[1] or calendar.GLOBAL_START
    return first, last - dt.timedelta(days=PAD_DAYS)


def as_of(days: DataFrame) -> dt.date:
    """The last day of a calendar."""
    return days.agg(F.max("date")).first()[0] or calendar.GLOBAL_START


def returns(spark: SparkSession, folder: str) -> DataFrame:
    # written once: rows per instrument are counted before the window
    data = tables.between_dates(views.bars(spark, folder), *whole(spark, folder), pad_days=PAD_DAYS)
    return series.forward_return(materialize(data, "bars"))


def clean(spark: SparkSession, folder: str) -> DataFrame:
    return load_training_table(views.bars(spark, folder), *whole(spark, folder))


def extreme_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Bars with an infinite or undefined ratio where no R trade happened."""
    missing = F.col("r_volume").isNull()
    ratio = F.when(missing & (F.col("num_trades") > 1), float("inf")).when(
        missing & (F.col("volume") < 5), float("nan")
    )
    ratio = ratio.when(missing, float("-inf")).otherwise(F.col("open"))
    return views.bars(spark, folder).withColumn("ratio", ratio)


# ---- scans, sources, sinks -------------------------------------------------------------------


def _config(name: str, strategy: tables.PartitionStrategy) -> tables.TableConfig:
    return tables.TableConfig(name, strategy)


def _read_back(
    spark: SparkSession, df: DataFrame, name: str, strategy: tables.PartitionStrategy
) -> DataFrame:
    path = tables.stock_path(scratch_path(spark, "db"), name)
    tables.write_table(df, _config(name, strategy), path)
    return tables.scan(spark, path, df.schema)


@query("scan_bars")
def _(spark, folder):
    root = scratch_path(spark, "db")
    config = _config("day_bar", tables.PartitionStrategy.DATE)
    tables.write_table(views.event_bars(spark, folder), config, tables.stock_path(root, "day_bar"))
    return tables.scan_bars(spark, root, "day")


@query("scan_factors")
def _(spark, folder):
    root = scratch_path(spark, "db")
    config = _config("events", tables.PartitionStrategy.FACTOR_AND_DATE)
    rows = views.event_factors(spark, folder)
    tables.write_table(rows, config, tables.factor_path(root, "events"))
    return tables.scan_factors(spark, root, "events", rows.schema)


@query("date_range_padded")
def _(spark, folder):
    return tables.between_dates(views.bars(spark, folder), *RANGE, pad_days=20)


@query("date_range")
def _(spark, folder):
    return tables.between_dates(views.factor_long(spark, folder), *RANGE)


@query("write_partitioned")
def _(spark, folder):
    rows = views.event_bars(spark, folder)
    return _read_back(spark, rows, "day_bar", tables.PartitionStrategy.DATE)


@query("write_partitioned_stock")
def _(spark, folder):
    rows = views.type_ticks(spark, folder)
    return _read_back(spark, rows, "tick", tables.PartitionStrategy.DATE_AND_STOCK)


@query("write_partitioned_index")
def _(spark, folder):
    rows = views.event_index_member(spark, folder)
    return _read_back(spark, rows, "index_member", tables.PartitionStrategy.DATE_AND_INDEX)


@query("write_partitioned_factor")
def _(spark, folder):
    rows = views.event_factors(spark, folder)
    return _read_back(spark, rows, "factors", tables.PartitionStrategy.FACTOR_AND_DATE)


@query("write_unpartitioned")
def _(spark, folder):
    rows = views.calendar(spark, folder)
    return _read_back(spark, rows, "trading_calendar.parquet", tables.PartitionStrategy.NONE)


@query("write_factor_values")
def _(spark, folder):
    path = scratch_path(spark, "values")
    tables.write_factor_values(clean(spark, folder), path, TARGET)
    return tables.scan(spark, path)


def known_model(spark: SparkSession, folder: str) -> mining.FactorModel:
    """A model with a given formula, on prepared data."""
    prepared = mining.prepare(clean(spark, folder), FEATURES)
    best = ("ts_mean_10", "close")
    config = mining.MiningConfig(window_sizes=(10,))
    return mining.FactorModel(search.SearchResult(best, 0.0, None, None, 0), prepared, config)


@query("write_factor_meta")
def _(spark, folder):
    path = scratch_path(spark, "meta")
    mining.write_factor_meta(known_model(spark, folder).training_stats(), path)
    kinds = "expression string, rows bigint, features int, score double, correlation double, r2 double"
    return rounded(spark.read.schema(kinds).json(path))


@query("write_trial_history")
def _(spark, folder):
    path = scratch_path(spark, "trials")
    mining.write_trial_history(mining.trial_table(spark, built_in_trials(spark, folder).history), path)
    return spark.read.option("header", True).schema(mining.TRIALS).csv(path)


@query("write_profile_report")
def _(spark, folder):
    path = scratch_path(spark, "report")
    profile.write_profile_report(profile.profile_target(clean(spark, folder), TARGET), path)
    return rounded(tables.scan(spark, path))


# ---- projection, filter, schema --------------------------------------------------------------


@query("cast_schema")
def _(spark, folder):
    return schema.cast_schema(
        views.bars(spark, folder).select(*bars_schema().names), bars_schema()
    )


@query("order_columns")
def _(spark, folder):
    return schema.order_columns(views.bars(spark, folder), bars_schema())


@query("canonical_sort")
def _(spark, folder):
    return schema.canonical_sort(views.index_member(spark, folder))


@query("format_table")
def _(spark, folder):
    return schema.format_table(views.bars(spark, folder), bars_schema())


@query("value_fields")
def _(spark, folder):
    return views.bars(spark, folder).select(*schema.value_fields(bars_schema()))


@query("select_features")
def _(spark, folder):
    return schema.select_features(returns(spark, folder), TARGET)


@query("drop_null_target")
def _(spark, folder):
    return filters.drop_null_target(returns(spark, folder), TARGET).select(*KEYS, TARGET)


@query("inf_to_null")
def _(spark, folder):
    return filters.inf_to_null(extreme_bars(spark, folder)).select(*KEYS, "ratio", "open", "r_volume")


@query("sigma_outlier_filter")
def _(spark, folder):
    valued = filters.drop_null_target(returns(spark, folder), TARGET)
    return filters.sigma_outlier_filter(valued, TARGET).select(*KEYS, TARGET)


@query("sigma_outlier_filter_narrow")
def _(spark, folder):
    valued = filters.drop_null_target(returns(spark, folder), TARGET)
    return filters.sigma_outlier_filter(valued, TARGET, sigmas=2.0).select(*KEYS, TARGET)


@query("drop_any_null")
def _(spark, folder):
    kept = filters.drop_any_null(returns(spark, folder), ["open", "r_volume", TARGET])
    return kept.select(*KEYS, "open", "r_volume", TARGET)


@query("drop_null_target_scaled")
def _(spark, folder):
    scaled = prep.scale_target(returns(spark, folder), TARGET)
    kept = filters.drop_null_target(scaled, TARGET).select(*KEYS, "open", TARGET)
    return rounded(kept, columns=[TARGET])


@query("drop_incomplete_day")
def _(spark, folder):
    """Ten hours to the west the last day ends before 15:00 and is dropped."""
    return filters.drop_incomplete_day(views.minute_bars(spark, folder, hours_west=10))


@query("drop_incomplete_day_full")
def _(spark, folder):
    return filters.drop_incomplete_day(views.minute_bars(spark, folder))


@query("describe_table")
def _(spark, folder):
    return schema.describe_table(views.bars(spark, folder).select(*KEYS, "num_trades"))


# ---- joins, reshape, set operations ----------------------------------------------------------


@query("pivot_factors")
def _(spark, folder):
    return rounded(reshape.pivot_factors(views.factor_long(spark, folder), ["A", "N", "R"]))


@query("attach_factors")
def _(spark, folder):
    wide = reshape.pivot_factors(views.factor_long(spark, folder))
    return rounded(
        reshape.attach_factors(views.bars(spark, folder).select(*KEYS, "open", "volume"), wide),
        columns=["A", "N", "R"],
    )


def aligned(spark: SparkSession, folder: str) -> AlignedStore:
    """Bars and long factors stored alike, two factors a column group."""
    bars = views.bars(spark, folder).select(*KEYS, "open", "volume")
    store = AlignedStore.create(materialize(bars, "bars"), scratch_path(spark, "aligned"), width=2)
    store.add_factors(views.factor_long(spark, folder))
    return store


@query("stored_pivot_factors")
def _(spark, folder):
    return rounded(aligned(spark, folder).wide(["A", "N", "R"]))


@query("stored_attach_factors")
def _(spark, folder):
    return rounded(aligned(spark, folder).attach(), columns=["A", "N", "R"])


@query("existing_dates")
def _(spark, folder):
    return calendar.existing_dates(views.bars(spark, folder))


@query("trading_dates")
def _(spark, folder):
    return calendar.trading_dates(views.calendar(spark, folder), *RANGE)


@query("missing_dates")
def _(spark, folder):
    stored = calendar.existing_dates(views.order_dates(spark, folder))
    days = views.calendar(spark, folder)
    return calendar.missing_dates(days, stored, as_of(days))


@query("missing_dates_global")
def _(spark, folder):
    stored = calendar.existing_dates(views.order_dates(spark, folder))
    days = views.calendar(spark, folder)
    return calendar.missing_dates(days, stored, as_of(days), use_global_start=True)


@query("new_dates")
def _(spark, folder):
    stored = calendar.existing_dates(views.order_dates(spark, folder))
    days = views.calendar(spark, folder)
    return calendar.new_dates(days, stored, as_of(days))


@query("score_with_keys")
def _(spark, folder):
    model = known_model(spark, folder)
    return rounded(model.values().select(*KEYS, mining.PREDICTION), 5)


# ---- table refresh ---------------------------------------------------------------------------


def event_job(spark: SparkSession, folder: str) -> RefreshJob:
    def fetch(start: dt.date, end: dt.date) -> DataFrame:
        return tables.between_dates(views.event_bars(spark, folder), start, end)

    config = _config("day_bar", tables.PartitionStrategy.DATE)
    path = tables.stock_path(scratch_path(spark, "db"), "day_bar")
    return RefreshJob(spark, config, path, views.event_calendar(spark, folder), fetch)


def _store(job: RefreshJob, start: str, end: str) -> None:
    tables.write_table(job.fetch_range(start, end, sort=False), job.config, job.path)


@query("fetch_range")
def _(spark, folder):
    return event_job(spark, folder).fetch_range("2024-01-05", "2024-01-20")


@query("refresh_full")
def _(spark, folder):
    job = event_job(spark, folder)
    job.full(as_of(job.calendar))
    return job.stored()


@query("refresh_missing")
def _(spark, folder):
    job = event_job(spark, folder)
    _store(job, "2024-01-01", "2024-01-07")
    _store(job, "2024-01-15", "2024-01-22")
    job.missing(as_of(job.calendar))
    return job.stored()


@query("refresh_latest")
def _(spark, folder):
    job = event_job(spark, folder)
    job.full("2024-01-12")
    job.latest(as_of(job.calendar))
    return job.stored()


# ---- windows ---------------------------------------------------------------------------------


@query("forward_return")
def _(spark, folder):
    return returns(spark, folder).select(*KEYS, "open", TARGET)


@query("forward_return_minute")
def _(spark, folder):
    """Targets two minutes ahead, ordered by minute."""
    data = views.minute_bars(spark, folder)
    keys = ["order_book_id", "datetime"]
    order = tables.bar_order(data, "minute")
    tables.require_unique_order(data, ["order_book_id"], order)
    return series.forward_return(data, horizon=2, order=order).select(*keys, "open", TARGET)


def _tick_data(spark: SparkSession, folder: str) -> tuple[DataFrame, tuple[str, ...]]:
    data = views.type_ticks(spark, folder)
    return data, tables.bar_order(data, "tick")


@query("forward_return_ticks")
def _(spark, folder):
    """Targets twenty ticks ahead; the sequence number decides between ticks of one moment."""
    data, order = _tick_data(spark, folder)
    return series.forward_return(data, order=order).select("order_book_id", *order, "open", TARGET)


@query("ts_rank_ticks")
def _(spark, folder):
    data, order = _tick_data(spark, folder)
    ranked = ex.evaluate(data, {"rank": ("ts_rank_10", "open")}, reg.default_registry(), order=order)
    return rounded(ranked.select("order_book_id", *order, "rank"), columns=["rank"])


def _rolling(fn: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        data = views.bars(spark, folder).select(*KEYS, "open", "volume", "r_volume")
        # values picked from the input are exact on prices too; sums are compared on volumes
        inputs = ["open", "r_volume"] if fn in ("rank", "max", "min") else ["volume", "r_volume"]
        exprs = {f"on_{x}": (f"ts_{fn}_10", x) for x in inputs}
        values = ex.evaluate(data, exprs, reg.custom_function_set()).select(*KEYS, *exprs)
        return values if fn in ("max", "min") else rounded(values, 4)

    return run


for _fn in timeseries.ROLLING:
    QUERIES[f"ts_{_fn}"] = _rolling(_fn)


@query("degenerate_guard")
def _(spark, folder):
    # an input that is zero throughout for some instruments, and varies for the rest
    idle = F.col("order_book_id") < 30
    data = views.bars(spark, folder).select(
        *KEYS, F.when(idle, 0.0).otherwise(F.col("volume")).alias("x")
    )
    return rounded(timeseries.add_rolling(data, "x", ["rank", "max"]))


@query("ts_family_windows")
def _(spark, folder):
    data = views.bars(spark, folder).select(*KEYS, "volume")
    return rounded(timeseries.add_rolling(data, "volume", sizes=timeseries.WINDOW_SIZES), 4)


@query("ts_momentum")
def _(spark, folder):
    data = views.bars(spark, folder).select(*KEYS, "open", "r_volume")
    first = timeseries.add_momentum(data, "open", [3, 10])
    first = first.withColumnsRenamed({"ts_momentum_3": "open_3", "ts_momentum_10": "open_10"})
    return timeseries.add_momentum(first, "r_volume", [3]).drop("r_volume")


@query("fill_gaps")
def _(spark, folder):
    data = views.bars(spark, folder).select(*KEYS, "r_volume", "volume")
    return series.fill_gaps(data, ["r_volume"])


# ---- scalar functions ------------------------------------------------------------------------


def _scalar(build: Callable[[Column, Column], Column]) -> Query:
    """``a`` is often missing; ``b`` is positive, zero or negative."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        a, b = F.col("r_volume"), F.col("volume") - 25
        return rounded(
            views.bars(spark, folder).select(*KEYS, build(a, b).alias("value")), columns=["value"]
        )

    return run


QUERIES |= {
    "safe_add": _scalar(scalars.safe_add),
    "safe_sub": _scalar(scalars.safe_sub),
    "safe_mul": _scalar(scalars.safe_mul),
    "safe_div": _scalar(scalars.safe_div),
    "safe_log": _scalar(lambda a, b: scalars.safe_log(b)),
    "safe_sqrt": _scalar(lambda a, b: scalars.safe_sqrt(b)),
    "safe_abs": _scalar(lambda a, b: scalars.safe_abs(b)),
    "safe_inv": _scalar(lambda a, b: scalars.safe_inv(b)),
    "clip_bounds": _scalar(lambda a, b: scalars.clip_bounds(a, 10.0, 30.0)),
}


@query("nan_to_num")
def _(spark, folder):
    return extreme_bars(spark, folder).select(*KEYS, scalars.nan_to_num(F.col("ratio")).alias("value"))


@query("std_function_set")
def _(spark, folder):
    functions = reg.default_registry(use_custom_functions=False)
    exprs = {
        f"v_{name}": (name, *["r_volume", "gap"][: f.arity]) if f.arity == 2 else (name, "gap")
        for name, f in functions.items()
    }
    data = views.bars(spark, folder).select(*KEYS, "r_volume", (F.col("volume") - 25).alias("gap"))
    return rounded(ex.evaluate(data, exprs, functions).select(*KEYS, *exprs), columns=[*exprs])


# ---- profiles --------------------------------------------------------------------------------


def _profile(run: Callable[[DataFrame], DataFrame], source: Query = clean, digits: int = 6) -> Query:
    return lambda spark, folder: rounded(run(source(spark, folder)), digits)


def validated(spark: SparkSession, folder: str, by: Sequence[str] = ()) -> DataFrame:
    bars = views.bars(spark, folder)
    return rounded(profile.validate_bars(bars, *whole(spark, folder), pad_days=PAD_DAYS, by=by), 4)


QUERIES |= {
    "describe_column": _profile(lambda df: profile.describe_column(df, TARGET)),
    "describe_column_by": _profile(
        lambda df: profile.describe_column(df, "volume", by=["order_book_id"]), views.bars
    ),
    "quantiles": _profile(lambda df: profile.quantiles(df, TARGET)),
    "quantiles_by": _profile(
        lambda df: profile.quantiles(df, "open", (0.1, 0.5, 0.9), by=["order_book_id"]), views.bars, 9
    ),
    "center_spread": _profile(lambda df: profile.center_spread(df, TARGET)),
    "skew_sample": _profile(lambda df: profile.skew_sample(df, TARGET)),
    "kurt_sample": _profile(lambda df: profile.kurt_sample(df, TARGET)),
    "extremes": _profile(lambda df: profile.extremes(df, TARGET)),
    "sign_counts": _profile(lambda df: profile.sign_counts(df, TARGET), returns),
    "iqr_outliers": _profile(lambda df: profile.iqr_outliers(df, TARGET)),
    "iqr_outliers_by": _profile(
        lambda df: profile.iqr_outliers(df, "volume", by=["order_book_id"]), views.bars
    ),
    "missing_inf_counts": _profile(
        lambda df: profile.missing_inf_counts(df, "ratio"), extreme_bars
    ),
    "row_and_distinct": _profile(lambda df: profile.row_and_distinct(df, TARGET), returns),
    "profile_target": _profile(lambda df: profile.profile_target(df, TARGET)),
    "null_profile": _profile(profile.null_profile, returns),
    "table_extent": _profile(profile.table_extent, views.bars),
    "feature_quality": _profile(
        lambda df: profile.feature_quality(df, [*FEATURES, "r_volume"]), views.bars, 4
    ),
    "low_variance_flag": _profile(
        lambda df: profile.low_variance_flag(
            df.withColumn("steady", F.lit(2.5)), ["open", "volume", "steady"]
        ),
        views.bars,
        4,
    ),
    "extreme_flag": _profile(lambda df: profile.extreme_flag(df, TARGET)),
    "target_missing_rate": _profile(lambda df: profile.target_missing_rate(df, TARGET), returns),
    "validate_bars": lambda spark, folder: validated(spark, folder),
    "profile_target_by": _profile(lambda df: profile.profile_target(df, TARGET, by=["num_trades"])),
    "null_profile_by": _profile(
        lambda df: profile.null_profile(df, ["open", "r_volume", TARGET], by=["order_book_id"]), returns
    ),
    "feature_quality_by": _profile(
        lambda df: profile.feature_quality(df, ["volume", "r_volume"], by=["order_book_id"]), views.bars, 4
    ),
    "low_variance_flag_by": _profile(
        lambda df: profile.low_variance_flag(df, ["open", "volume"], by=["order_book_id"]), views.bars, 4
    ),
    "validate_bars_by": lambda spark, folder: validated(spark, folder, ["order_book_id"]),
}


def refreshed(df: DataFrame, columns: Sequence[str]) -> ProfileState:
    """A profile kept by month: all months first, then the last one again."""
    state = ProfileState(df.sparkSession, scratch_path(df.sparkSession, "profile"), columns, grain="month")
    data = materialize(df.select("date", *columns), "profiled")
    state.refresh(data)
    state.refresh(data, [as_of(data)])
    return state


QUERIES |= {
    "kept_profile": _profile(lambda df: refreshed(df, [TARGET]).profile(TARGET)),
    "kept_null_profile": _profile(lambda df: refreshed(df, ["open", "r_volume", TARGET]).null_profile(), returns),
    "kept_feature_quality": _profile(
        lambda df: refreshed(df, [*FEATURES, "r_volume"]).feature_quality(), views.bars, 4
    ),
}


# ---- feature preparation ---------------------------------------------------------------------


def _prep(
    run: Callable[[DataFrame], DataFrame], columns: Sequence[str], digits: int = 6
) -> Query:
    return lambda spark, folder: rounded(run(clean(spark, folder)).select(*KEYS, *columns), digits)


QUERIES |= {
    "drop_low_variance": _prep(
        lambda df: prep.drop_low_variance(df.withColumn("steady", F.lit(2.5)), [*FEATURES, "steady"]),
        FEATURES,
        9,
    ),
    "iqr_clip": _prep(lambda df: prep.iqr_clip(df, FEATURES), FEATURES, 9),
    "robust_scale": _prep(lambda df: prep.robust_scale(df, FEATURES), FEATURES),
    "minmax_scale": _prep(lambda df: prep.minmax_scale(df, FEATURES), FEATURES),
    "scale_target": _prep(lambda df: prep.scale_target(df, TARGET), [TARGET]),
    "prepare_features": _prep(
        lambda df: prep.fit_prep(df, FEATURES, TARGET).transform(df), [*FEATURES, TARGET]
    ),
    "prepare_features_minmax": _prep(
        lambda df: prep.fit_prep(df, FEATURES, TARGET, "minmax").transform(df), FEATURES
    ),
}


@query("train_valid_split")
def _(spark, folder):
    train, valid = prep.train_valid_split(views.bars(spark, folder).select(*KEYS))
    return train.withColumn("part", F.lit("train")).unionByName(
        valid.withColumn("part", F.lit("valid"))
    )


@query("sample_rows")
def _(spark, folder):
    return prep.sample_rows(views.bars(spark, folder).select(*KEYS))


# ---- factor evaluation, scoring, search ------------------------------------------------------

EXAMPLE: ex.Expr = (
    "safe_add",
    ("safe_mul", ("ts_mean_5", "open"), ("safe_log", ("ts_std_10", "volume"))),
    ("ts_rank_3", "r_volume"),
)
NESTED: ex.Expr = ("ts_mean_3", ("safe_sub", ("ts_max_5", "volume"), "volume"))
SCORED: tuple[ex.Expr, ...] = (
    "open",
    ("ts_mean_10", "open"),
    ("safe_div", ("ts_sum_5", "volume"), 100.0),
    ("safe_log", "close"),
    NESTED,
    ("ts_rank_10", "r_volume"),
)


@query("eval_expression")
def _(spark, folder):
    values = ex.evaluate(
        views.bars(spark, folder), {"example": EXAMPLE, "nested": NESTED}, reg.default_registry()
    )
    return rounded(values.select(*KEYS, "example", "nested"), 4)


@query("function_registry")
def _(spark, folder):
    """The total of every offered function, and of one a user adds, over all bars."""
    functions = reg.default_registry((10,)) | reg.registry([timeseries.momentum_function(5)])
    exprs = {
        name: (name, "volume", "r_volume") if f.arity == 2 else (name, "volume")
        for name, f in functions.items()
    }
    values = ex.evaluate(views.bars(spark, folder), exprs, functions)
    totals = values.agg(*[F.sum(name).alias(name) for name in exprs])
    return rounded(totals.unpivot([], list(exprs), "function", "total"), 2)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return clean(spark, folder).select(*KEYS, F.col(TARGET).alias("y"), F.col("volume").alias("p"))


QUERIES |= {
    "mse": _profile(lambda df: scoring.mse(df, "y", "p"), scored, 4),
    "r2": _profile(lambda df: scoring.r2(df, "y", "p"), scored),
    "ic": _profile(lambda df: scoring.ic(df, "y", "p"), scored),
    "rank_ic": _profile(lambda df: scoring.rank_ic(df, "y", "p"), scored),
    "score_summary": _profile(lambda df: scoring.score_summary(df, "y", "p"), scored, 4),
    "rank_ic_by": _profile(lambda df: scoring.rank_ic(df, "y", "p", ["order_book_id"]), scored),
    "score_summary_by": _profile(
        lambda df: scoring.score_summary(df, "y", "p", ["order_book_id"]), scored, 4
    ),
}


@query("score_expressions")
def _(spark, folder):
    data = clean(spark, folder)
    return rounded(scoring.score_expressions(data, SCORED, TARGET, reg.default_registry()), 4)


@query("rank_expressions")
def _(spark, folder):
    data = clean(spark, folder)
    scores = scoring.score_expressions(data, SCORED, TARGET, reg.default_registry())
    return rounded(scoring.rank_expressions(scores, parsimony=0.01, top=3), 4)


@query("rank_expressions_ic")
def _(spark, folder):
    """The strongest linear correlation first, whatever its sign."""
    scores = scoring.score_expressions(clean(spark, folder), SCORED, TARGET, reg.default_registry())
    return rounded(scoring.rank_expressions(scores, parsimony=0.0, top=3, metric="ic"), 4)


@query("rank_expressions_missing")
def _(spark, folder):
    """A formula with values on too few rows is not ranked, however good its score."""
    functions = reg.default_registry() | reg.registry(
        [timeseries.momentum_function(3), timeseries.momentum_function(400)]
    )
    exprs = [("ts_momentum_400", "open"), ("ts_momentum_3", "open"), "open", "volume"]
    scores = scoring.score_expressions(clean(spark, folder), exprs, TARGET, functions)
    return rounded(scoring.rank_expressions(scores, parsimony=0.0, least_rows=0.5).drop("id"), 4)


ONE_STEP = ("safe_add", "safe_sub", "ts_mean_3")


def one_step_search(table: DataFrame, columns: Sequence[str], order: Sequence[str] = series.ORDER) -> DataFrame:
    """A search over every one-step formula of the columns, one constant and three functions."""
    functions = {n: f for n, f in reg.default_registry((3,)).items() if n in ONE_STEP}
    settings = search.SearchSettings(
        population_size=1000, generations=1, beam=1000, max_samples=1.0, max_depth=2, constants=1,
        stopping_criteria=0.0,
    )
    found = search.search_factors(table, columns, TARGET, functions, settings, order=order)
    history = search.history_table(table.sparkSession, found)
    return rounded(history.select("expression", "size", "mse", "ic", "fitness"), 3)


@query("search_one_step")
def _(spark, folder):
    return one_step_search(clean(spark, folder), ["open", "volume"])


def stored_training_table(
    spark: SparkSession, rows: DataFrame, source: str, strategy: tables.PartitionStrategy, horizon: int
) -> tuple[DataFrame, tuple[str, ...]]:
    """Write rows as a stored bar table of the source, and load it for training in the source's order."""
    root = scratch_path(spark, "db")
    name = tables.SOURCES[source]
    tables.write_table(rows, _config(name, strategy), tables.stock_path(root, name))
    stored = tables.scan_bars(spark, root, source, rows.schema)
    order = tables.bar_order(stored, source)
    days = calendar.folder_dates(spark, tables.stock_path(root, name), _config(name, strategy))
    first, last = days.agg(F.min("date"), F.max("date")).first()
    bounds = (first or calendar.GLOBAL_START, last or calendar.GLOBAL_START)
    return load_training_table(stored, *bounds, horizon=horizon, order=order), order


@query("search_minutes")
def _(spark, folder):
    """Minute bars from their stored table to a search: targets two minutes ahead, windows by minute."""
    rows = views.minute_bars(spark, folder)
    table, order = stored_training_table(spark, rows, "minute", tables.PartitionStrategy.DATE, 2)
    return one_step_search(table, ["open", "volume"], order)


@query("search_ticks")
def _(spark, folder):
    """Ticks from their stored table to a search: twenty ticks ahead, windows by moment and sequence number."""
    rows = views.type_ticks(spark, folder)
    table, order = stored_training_table(spark, rows, "tick", tables.PartitionStrategy.DATE_AND_STOCK, 20)
    return one_step_search(table, ["open"], order)


@query("seed_expressions")
def _(spark, folder):
    """Given formulas are scored first, whatever the population size."""
    settings = search.SearchSettings(
        population_size=0, generations=1, beam=len(SCORED), max_samples=1.0, max_depth=3
    )
    found = search.search_factors(
        clean(spark, folder), ["open"], TARGET, reg.default_registry(), settings, SCORED
    )
    table = search.history_table(spark, found)
    return rounded(table.select("expression", "size", "mse", "ic", "fitness"), 4)


@query("search_factors")
def _(spark, folder):
    """A search with the built-in final setting."""
    prepared = mining.prepare(clean(spark, folder), FEATURES)
    return rounded(search.history_table(spark, mining.train(prepared).result))


def built_in_trials(spark: SparkSession, folder: str) -> mining.TrialOutcome:
    return mining.trial_configs(mining.prepare(clean(spark, folder), FEATURES))


@query("trial_configs")
def _(spark, folder):
    return rounded(mining.trial_table(spark, built_in_trials(spark, folder).history))


@query("train_final")
def _(spark, folder):
    """Load, prepare, choose among the plain features, save; gives the saved factor values."""
    path = scratch_path(spark, "final")
    settings = search.SearchSettings(
        population_size=0, generations=1, max_samples=1.0, max_depth=1
    )
    config = mining.MiningConfig(window_sizes=(10,), search=settings)
    mining.train_final(views.bars(spark, folder), *whole(spark, folder), config, path, features=FEATURES)
    return rounded(tables.scan(spark, f"{path}/factor_values.parquet"))


@query("train_final_search")
def _(spark, folder):
    """The same with the built-in final setting: a search over rolling and math functions."""
    path = scratch_path(spark, "final")
    journal = scratch_path(spark, "journal")
    mining.train_final(views.bars(spark, folder), *whole(spark, folder), path=path, features=FEATURES, journal=journal)
    return rounded(tables.scan(spark, f"{path}/factor_values.parquet"))
