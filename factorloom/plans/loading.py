"""From stored bars to a cleaned training table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame

from factorloom.operators.filters import (
    drop_null_target,
    inf_to_null,
    require_rows,
    sigma_outlier_filter,
)
from factorloom.operators.reshape import attach_factors, pivot_factors
from factorloom.operators.series import KEYS, ORDER, forward_return
from factorloom.session import materialize
from factorloom.sources.tables import between_dates

TARGET = "target_feature"


def load_training_table(
    bars: DataFrame,
    start: str | dt.date,
    end: str | dt.date,
    factors: DataFrame | None = None,
    factor_names: Sequence[str] | None = None,
    price: str = "open",
    horizon: int = 20,
    pad_days: int = 20,
    clip_to_end: bool = False,
    order: Sequence[str] = ORDER,
    block_rows: int | None = None,
) -> DataFrame:
    """Bars in the range with their forward return, factors beside them, cleaned.

    The look-ahead pad gives the last days their target; ``clip_to_end`` drops the padded days
    afterwards. The table may be empty here; ``require_rows`` checks it.

    The bars are written before rows per instrument are counted, and the targets before their spread is
    measured, so that neither the source nor the window is computed twice.
    """
    data = materialize(between_dates(inf_to_null(bars), start, end, pad_days), "bars")
    data = forward_return(data, price, horizon, TARGET, KEYS, order, block_rows)
    if clip_to_end:
        data = between_dates(data, start, end)
    data = materialize(drop_null_target(data, TARGET), "targets")
    data = sigma_outlier_filter(data, TARGET)
    if factors is not None:
        wide = pivot_factors(between_dates(factors, start, end), factor_names)
        data = attach_factors(data, wide)
    return data


def load_required(bars: DataFrame, start: str | dt.date, end: str | dt.date, **options) -> DataFrame:
    return require_rows(load_training_table(bars, start, end, **options), "the training table")
