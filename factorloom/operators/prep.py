"""Feature preparation: fit small parameters on a table, apply them as one projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.scalars import clip_bounds
from factorloom.operators.filters import drop_any_null, drop_null_target
from factorloom.operators.profile import IQR_REACH, LOW_STD
from factorloom.operators.quantiles import QUARTILES, ColumnQuantiles, fit_quantiles
from factorloom.operators.tall import moments
from factorloom.session import materialize

# Variance floors for features and the smallest usable target IQR.
FEATURE_STD = 1e-8
TARGET_IQR = 1e-8
# Fixed value: scales this small are treated as zero and replaced by 1.
ZERO_SCALE = 10 * 2.220446049250313e-16


@dataclass(frozen=True)
class FeatureScale:
    low: float
    high: float
    center: float
    scale: float

    def apply(self, x: Column) -> Column:
        return (clip_bounds(x, self.low, self.high) - self.center) / self.scale


@dataclass(frozen=True)
class TargetScale:
    center: float
    scale: float

    def apply(self, y: Column) -> Column:
        return (y - self.center) / self.scale


@dataclass(frozen=True)
class FeaturePrep:
    """Fitted preparation; ``transform`` keeps every other column, keys included."""

    inputs: tuple[str, ...]
    features: dict[str, FeatureScale]
    target: str
    target_scale: TargetScale

    def transform(self, df: DataFrame) -> DataFrame:
        complete = drop_any_null(df, [*self.inputs, self.target])
        dropped = [c for c in self.inputs if c not in self.features]
        scaled = complete.drop(*dropped).withColumns(
            {c: s.apply(F.col(c).cast("double")) for c, s in self.features.items()}
            | {self.target: self.target_scale.apply(F.col(self.target))}
        )
        return drop_null_target(scaled, self.target)


def column_stds(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    found = moments(df, columns)
    return {c: found[c]["std"] if c in found else None for c in columns}


def varying(stds: dict[str, float | None], columns: Sequence[str]) -> list[str]:
    return [c for c in columns if stds[c] is not None and stds[c] > FEATURE_STD]


def iqr_bounds(q: ColumnQuantiles) -> tuple[float, float]:
    q1, q3 = q.at(0.25), q.at(0.75)
    return q1 - IQR_REACH * (q3 - q1), q3 + IQR_REACH * (q3 - q1)


def drop_low_variance(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Without features whose std is at most 1e-8; fails when none is left."""
    kept = _require(varying(column_stds(df, features), features))
    return df.drop(*[c for c in features if c not in kept])


def _require(features: list[str]) -> list[str]:
    if not features:
        raise ValueError("no feature varies enough to be used")
    return features


def iqr_clip(df: DataFrame, features: Sequence[str], exact_rows: int | None = None) -> DataFrame:
    fitted = fit_quantiles(df, features, QUARTILES, exact_rows)
    return df.withColumns(
        {
            c: clip_bounds(F.col(c).cast("double"), *(F.lit(b) for b in iqr_bounds(fitted[c])))
            for c in features
            if fitted[c].n
        }
    )


def _robust(q: ColumnQuantiles, low: float, high: float) -> FeatureScale:
    # clamping keeps the order, so the clamped quartiles follow from the fitted values
    q1, middle, q3 = (q.at(p, low, high) for p in QUARTILES)
    spread = q3 - q1
    return FeatureScale(low, high, middle, spread if abs(spread) >= ZERO_SCALE else 1.0)


def _minmax(low: float, high: float, least: float, most: float) -> FeatureScale:
    least, most = min(max(least, low), high), min(max(most, low), high)
    return FeatureScale(low, high, least, most - least if most > least else 1.0)


def fit_target_scale(df: DataFrame, target: str, exact_rows: int | None = None) -> TargetScale:
    data = materialize(df.select(target), "target")
    q = fit_quantiles(data, [target], QUARTILES, exact_rows, stored=True)[target]
    row = moments(data, [target]).get(target)
    return _target_scale(q, row and row["mean"], row and row["std"])


def _target_scale(q: ColumnQuantiles, mean: float | None, std: float | None) -> TargetScale:
    if std is None or std < LOW_STD:
        raise ValueError("the target hardly varies; check the data")
    spread = q.at(0.75) - q.at(0.25)
    return TargetScale(q.at(0.5), spread) if spread > TARGET_IQR else TargetScale(mean, std)


def fit_prep(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    method: str = "robust",
    exact_rows: int | None = None,
    stored: bool = False,
) -> FeaturePrep:
    """Fit from moments, ranks and clipped moments, each for all features at once.

    The columns are written first unless ``df`` is a stored table.
    """
    if method not in ("robust", "minmax"):
        raise ValueError(f"unknown scaling {method!r}")
    features = list(features)
    data = drop_any_null(df, [*features, target]).select(*features, target)
    if not stored:
        data = materialize(data, "features")
    found = moments(data, [*features, target])
    if not found:
        raise ValueError("no complete row is left; check the features and the target")
    valid = _require(varying({c: found[c]["std"] for c in features}, features))
    fitted = fit_quantiles(data, [*valid, target], QUARTILES, exact_rows, stored=True)
    bounds = {c: iqr_bounds(fitted[c]) for c in valid}
    clipped = data.select(
        *[clip_bounds(F.col(c).cast("double"), *bounds[c]).alias(c) for c in valid]
    )
    after = column_stds(clipped, valid)
    valid = _require([c for c in valid if after[c] is not None and after[c] >= FEATURE_STD])
    scales = {
        c: _robust(fitted[c], *bounds[c])
        if method == "robust"
        else _minmax(*bounds[c], found[c]["low"], found[c]["high"])
        for c in valid
    }
    target_scale = _target_scale(fitted[target], found[target]["mean"], found[target]["std"])
    return FeaturePrep(tuple(features), scales, target, target_scale)


def robust_scale(df: DataFrame, features: Sequence[str], exact_rows: int | None = None) -> DataFrame:
    """Clip, then (x - median) / IQR of the clipped values."""
    fitted = fit_quantiles(df, features, QUARTILES, exact_rows)
    scales = {c: _robust(q, *iqr_bounds(q)) for c, q in fitted.items() if q.n}
    return df.withColumns({c: s.apply(F.col(c).cast("double")) for c, s in scales.items()})


def minmax_scale(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min), 0 for a constant column."""
    found = moments(df, features)
    scaled = {}
    for c, row in found.items():
        low, high = row["low"], row["high"]
        if low is None:
            continue
        x = F.col(c).cast("double")
        scaled[c] = (x - low) / (high - low) if high > low else F.when(x.isNotNull(), 0.0)
    return df.withColumns(scaled)


def scale_target(df: DataFrame, target: str, exact_rows: int | None = None) -> DataFrame:
    scale = fit_target_scale(df, target, exact_rows)
    return df.withColumn(target, scale.apply(F.col(target)))


def key_share(keys: Sequence[str], seed: int) -> Column:
    """A number in [0, 1) fixed by the row's key and the seed, whatever the partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / float(2**32)


def train_valid_split(
    df: DataFrame, keys: Sequence[str] = ("order_book_id", "date"), share: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, validation); ``share`` of the keys go to validation."""
    bucket = key_share(keys, seed)
    return df.filter(bucket >= share), df.filter(bucket < share)


def sample_rows(
    df: DataFrame, keys: Sequence[str] = ("order_book_id", "date"), share: float = 0.9, seed: int = 42
) -> DataFrame:
    return df.filter(key_share(keys, seed) < share)
