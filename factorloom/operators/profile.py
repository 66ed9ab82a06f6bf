"""Distribution profiles and data-quality checks.

Moments and counts are plain map-side-combined aggregates; quantiles come from
``quantiles`` (whole table) or ``ranks`` (per group), so no task holds a whole column.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.operators.joins import group_join, null_safe_join
from factorloom.operators.quantiles import fit_quantiles
from factorloom.operators.ranks import group_quantiles
from factorloom.operators.series import forward_return
from factorloom.operators.tall import named, number, tall
from factorloom.session import materialize
from factorloom.sources.tables import between_dates

# Reported quantiles and thresholds.
REPORT_QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
LOW_STD = 1e-6
EXTREME_RETURN = 10.0
IQR_REACH = 1.5


def _name(p: float) -> str:
    return f"q{round(p * 100):02d}"


def _missing(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def _double(column: str) -> Column:
    return F.col(column).cast("double")


def _stored(df: DataFrame, column: str) -> DataFrame:
    """The one column, written once: a profile reads it several times."""
    return materialize(df.select(column), "column")


def _summary(
    df: DataFrame,
    column: str,
    aggregates: Sequence[Column],
    quantiles: dict[str, float],
    by: Sequence[str] = (),
    exact_rows: int | None = None,
) -> DataFrame:
    """Aggregates plus quantile columns, for the table or per group."""
    if not by:
        data = _stored(df, column)
        fitted = fit_quantiles(data, [column], list(quantiles.values()), exact_rows, stored=True)
        fitted = fitted[column]
        values = {
            name: F.lit(fitted.at(p)).cast("double") for name, p in quantiles.items()
        }
        if not aggregates:
            return df.sparkSession.range(1).select(*[v.alias(k) for k, v in values.items()])
        return data.agg(*aggregates).withColumns(values)
    numbers = df.withColumn("__x", _double(column))
    tall = group_quantiles(numbers, by, "__x", sorted(set(quantiles.values())))
    wide = tall.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("p") == float(p), F.col("value"))).alias(name)
            for name, p in quantiles.items()
        ]
    )
    base = df.groupBy(*by).agg(*(aggregates or [F.count(F.lit(1)).alias("__rows")]))
    return null_safe_join(base, wide, by).drop("__rows")


def describe_column(
    df: DataFrame, column: str, by: Sequence[str] = (), exact_rows: int | None = None
) -> DataFrame:
    """count, mean, sample std, min, quartiles, max."""
    x = number(column)
    aggregates = [
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    ]
    table = _summary(
        df, column, aggregates, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, by, exact_rows
    )
    return table.select(*by, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def quantiles(
    df: DataFrame,
    column: str,
    probabilities: Sequence[float] = REPORT_QUANTILES,
    by: Sequence[str] = (),
    exact: bool = True,
) -> DataFrame:
    """Linear-interpolated quantiles, exact unless ``exact=False`` asks for a sketch."""
    names = {_name(p): p for p in probabilities}
    if exact:
        return _summary(df, column, [], names, by)
    rough = F.percentile_approx(number(column), list(names.values()))
    table = df.groupBy(*by).agg(rough.alias("__q"))
    return table.select(*by, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])


def center_spread(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    x = number(column)
    aggregates = [F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")]
    return _summary(df, column, aggregates, {"median": 0.5}, by).select(
        *by, "mean", "median", "std"
    )


def skew(x: Column) -> Column:
    """Bias-corrected skewness; NULL under 3 values, 0 for a constant."""
    n = F.count(x).cast("double")
    corrected = F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, F.coalesce(F.nanvl(corrected, F.lit(None)), F.lit(0.0)))


def kurt(x: Column) -> Column:
    """Bias-corrected excess kurtosis; NULL under 4 values, 0 for a constant."""
    n = F.count(x).cast("double")
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)
    found = F.skewness(x).isNotNull()
    return F.when(n >= 4, F.when(found, corrected).otherwise(0.0))


def skew_sample(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(skew(number(column)).alias("skew"))


def kurt_sample(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(kurt(number(column)).alias("kurt"))


def _extremes(x: Column) -> list[Column]:
    return [F.min(x).alias("min"), F.max(x).alias("max"), (F.max(x) - F.min(x)).alias("range")]


def extremes(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*_extremes(number(column)))


def _share(count: Column) -> Column:
    return F.try_divide(count, F.count(F.lit(1)))


def _signs(x: Column) -> list[Column]:
    counts = {
        "zero": F.count_if(x == 0),
        "positive": F.count_if(x > 0),
        "negative": F.count_if(x < 0),
    }
    return [c.alias(f"{n}_count") for n, c in counts.items()] + [
        _share(c).alias(f"{n}_ratio") for n, c in counts.items()
    ]


def sign_counts(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Zero, positive and negative rows, as counts and shares of all rows."""
    return df.groupBy(*by).agg(*_signs(number(column)))


def iqr_outliers(
    df: DataFrame, column: str, by: Sequence[str] = (), exact_rows: int | None = None
) -> DataFrame:
    """Quartiles, 1.5-IQR bounds, and rows strictly outside them."""
    if by:
        # the rows are read again beside their group's quartiles, so both are written once
        data = materialize(df.select(*by, column), "column")
        quartiles = _summary(data, column, [], {"__q1": 0.25, "__q3": 0.75}, by)
        rows = group_join(data, materialize(quartiles, "quartiles"), by)
        return rows.groupBy(*by).agg(*_outliers(number(column), F.col("__q1"), F.col("__q3")))
    data = _stored(df, column)
    fitted = fit_quantiles(data, [column], (0.25, 0.75), exact_rows, stored=True)[column]
    return data.agg(*_outliers(number(column), fitted.at(0.25), fitted.at(0.75)))


def _outliers(x: Column, q1: Column | float | None, q3: Column | float | None) -> list[Column]:
    low, high = F.lit(q1).cast("double"), F.lit(q3).cast("double")
    spread = high - low
    lower, upper = low - IQR_REACH * spread, high + IQR_REACH * spread
    outside = F.count_if((x < lower) | (x > upper))
    return [
        F.max(low).alias("q1"),
        F.max(high).alias("q3"),
        F.max(spread).alias("iqr"),
        F.max(lower).alias("lower_bound"),
        F.max(upper).alias("upper_bound"),
        outside.alias("outlier_count"),
        _share(outside).alias("outlier_ratio"),
    ]


def _quality(x: Column) -> list[Column]:
    missing, infinite = F.count_if(_missing(x)), F.count_if(F.abs(x) == float("inf"))
    return [
        missing.alias("missing_count"),
        infinite.alias("infinite_count"),
        ((missing == 0) & (infinite == 0)).alias("quality_ok"),
    ]


def missing_inf_counts(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*_quality(_double(column)))


def row_and_distinct(
    df: DataFrame, column: str, by: Sequence[str] = (), exact: bool = True
) -> DataFrame:
    x = number(column)
    distinct = F.count_distinct(x) if exact else F.approx_count_distinct(x)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), distinct.alias("distinct_values"))


def _profile_groups(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """The distribution profile of each group: exact quantiles, then one aggregate beside the quartiles."""
    names = {_name(p): p for p in REPORT_QUANTILES}
    # both are read several times, so they are written once
    df = materialize(df.select(*by, column), "column")
    marks = materialize(_summary(df, column, [], names | {"median": 0.5, "__q1": 0.25, "__q3": 0.75}, by), "marks")
    rows = group_join(df, marks.select(*by, "__q1", "__q3"), by)
    x = number(column)
    table = rows.groupBy(*by).agg(
        *_moments(x), *_outliers(x, F.col("__q1"), F.col("__q3")), *_quality(_double(column))
    )
    distinct = df.groupBy(*by).agg(F.count_distinct(x).alias("distinct_values"))
    found = null_safe_join(table, marks.drop("__q1", "__q3"), by)
    return null_safe_join(found, distinct, by)


def _moments(x: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        skew(x).alias("skew"),
        kurt(x).alias("kurt"),
        *_extremes(x),
        *_signs(x),
    ]


def profile_target(
    df: DataFrame, column: str, exact_rows: int | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """The whole distribution profile as one row, or one per group: quantiles, then one aggregate."""
    if by:
        return _profile_groups(df, column, list(by))
    data = _stored(df, column)
    fitted = fit_quantiles(data, [column], REPORT_QUANTILES, exact_rows, stored=True)[column]
    x = number(column)
    # the distinct count shuffles single values; kept apart so no other buffer travels along
    distinct = data.agg(F.count_distinct(x)).scalar()
    table = data.agg(
        *_moments(x),
        *_outliers(x, fitted.at(0.25), fitted.at(0.75)),
        *_quality(_double(column)),
    )
    marks = {_name(p): F.lit(fitted.at(p)).cast("double") for p in REPORT_QUANTILES}
    return table.withColumns(
        marks | {"median": F.lit(fitted.at(0.5)).cast("double"), "distinct_values": distinct}
    )


# Report sections and the metrics listed in each.
REPORT_SECTIONS = {
    "basic": ("count", "mean", "std", "min", "q25", "q50", "q75", "max"),
    "distribution": ("mean", "median", "std", "skew", "kurt"),
    "quantiles": tuple(_name(p) for p in REPORT_QUANTILES),
    "samples": (
        "rows",
        "distinct_values",
        "zero_count",
        "zero_ratio",
        "positive_count",
        "positive_ratio",
        "negative_count",
        "negative_ratio",
    ),
}


def profile_report(profile: DataFrame) -> DataFrame:
    """A one-row profile as (section, metric, value)."""
    entries = [
        F.struct(
            F.lit(section).alias("section"),
            F.lit(metric).alias("metric"),
            F.col(metric).cast("double").alias("value"),
        )
        for section, metrics in REPORT_SECTIONS.items()
        for metric in metrics
    ]
    return profile.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def write_profile_report(profile: DataFrame, path: str) -> None:
    profile_report(profile).write.mode("overwrite").parquet(path)


def _null(df: DataFrame, column: str) -> Column:
    floating = dict(df.dtypes)[column] in ("double", "float")
    return _missing(F.col(column)) if floating else F.col(column).isNull()


def null_profile(
    df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Missing count and percentage of the columns that have any."""
    columns = list(columns or [c for c in df.columns if c not in by])
    flags = F.array(*[_null(df, c) for c in columns])
    missing = F.count_if(F.col("v"))
    counted = (
        df.select(*by, F.posexplode(flags).alias("c", "v"))
        .groupBy(*by, "c")
        .agg(missing.alias("nulls"), (_share(missing) * 100).alias("percent"))
    )
    return named(counted.filter(F.col("nulls") > 0), columns)


def table_extent(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count_distinct("order_book_id").alias("instruments"),
        F.count(F.lit(1)).alias("rows"),
    )


def feature_quality(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per feature: missing percentage, zero percentage, sample std."""
    v = F.col("v")
    measured = (
        tall(df, features, by)
        .groupBy(*by, "c")
        .agg(
            (_share(F.count_if(v.isNull())) * 100).alias("missing_pct"),
            (_share(F.count_if(v == 0)) * 100).alias("zero_pct"),
            F.stddev_samp(v).alias("std"),
        )
    )
    return named(measured, features)


def low_variance_flag(
    df: DataFrame, columns: Sequence[str], limit: float = LOW_STD, by: Sequence[str] = ()
) -> DataFrame:
    stds = tall(df, columns, by).groupBy(*by, "c").agg(F.stddev_samp("v").alias("std"))
    return named(stds, columns).withColumn(
        "low_variance", F.coalesce(F.col("std") < limit, F.lit(False))
    )


def extreme_flag(
    df: DataFrame, column: str, limit: float = EXTREME_RETURN, by: Sequence[str] = ()
) -> DataFrame:
    largest = F.max(F.abs(number(column)))
    return df.groupBy(*by).agg(
        largest.alias("max_abs"), F.coalesce(largest > limit, F.lit(False)).alias("extreme")
    )


def target_missing_rate(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    missing = F.count_if(_missing(_double(column)))
    return df.groupBy(*by).agg(
        missing.alias("missing_count"),
        (_share(missing) * 100).alias("missing_pct"),
        (F.count(F.lit(1)) - missing).alias("rows_after"),
    )


def validate_bars(
    bars: DataFrame,
    start: str | dt.date,
    end: str | dt.date,
    price: str = "open",
    horizon: int = 20,
    pad_days: int = 20,
    block_rows: int | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Quality checks as (check, value, ok), ending in the verdict, for the table or per group.

    The verdict fails when the cleaned target hardly varies, or when no target is left.
    """
    data = between_dates(bars, start, end, pad_days)
    valued = forward_return(
        data, price, horizon, "target_feature", block_rows=block_rows, infinite=True
    )
    target, x = F.col("target_feature"), number(price)
    wide = valued.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(_null(data, c)).alias(f"null_{c}") for c in data.columns],
        F.stddev_samp(x).alias("price_std"),
        F.count_if(_missing(target)).alias("target_missing"),
        F.count_if(~_missing(target)).alias("target_rows"),
        F.stddev_samp(number("target_feature")).alias("target_std"),
        F.count_if(F.abs(target) == float("inf")).alias("target_infinite"),
        F.max(F.abs(number("target_feature"))).alias("target_max_abs"),
        F.count_distinct("order_book_id").alias("instruments"),
    )
    steady = lambda c: F.coalesce(~(F.col(c) < LOW_STD), F.lit(True))
    usable = (F.col("target_rows") > 0) & steady("target_std")
    rules = {
        "rows": F.col("rows") > 0,
        "instruments": F.col("instruments") > 0,
        **{f"null_{c}": F.col(f"null_{c}") == 0 for c in data.columns},
        "price_std": steady("price_std"),
        "target_missing": F.col("target_missing") == 0,
        "target_rows": F.col("target_rows") > 0,
        "target_std": steady("target_std"),
        "target_infinite": F.col("target_infinite") == 0,
        "target_max_abs": F.coalesce(F.col("target_max_abs") <= EXTREME_RETURN, F.lit(True)),
    }
    entries = [
        F.struct(
            F.lit(name).alias("check"),
            F.col(name).cast("double").alias("value"),
            rule.alias("ok"),
        )
        for name, rule in rules.items()
    ]
    verdict = F.struct(
        F.lit("verdict").alias("check"), usable.cast("double").alias("value"), usable.alias("ok")
    )
    return wide.select(*by, F.explode(F.array(*entries, verdict)).alias("e")).select(*by, "e.*")
