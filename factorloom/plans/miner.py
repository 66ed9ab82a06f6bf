"""The mining workflow as one object: load, prepare, train, read and save."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from factorloom.operators.series import ORDER
from factorloom.plans import expressions as ex
from factorloom.plans.loading import TARGET, load_required
from factorloom.plans.mining import FactorModel, MiningConfig, Prepared, prepare, train
from factorloom.sources.tables import bar_order, scan_bars


class FactorMiner:
    """Steps are chained: ``FactorMiner(bars).load(a, b).prepare().train().save(path)``."""

    def __init__(
        self,
        bars: DataFrame,
        config: MiningConfig = MiningConfig(),
        factors: DataFrame | None = None,
        initial_expressions: Sequence[ex.Expr] = (),
        order: Sequence[str] = ORDER,
    ):
        self.bars = bars
        self.config = config
        self.factors = factors
        self.initial_expressions = tuple(initial_expressions)
        self.order = tuple(order)
        self.data: DataFrame | None = None
        self.prepared: Prepared | None = None
        self.model: FactorModel | None = None

    @classmethod
    def from_source(
        cls, spark: SparkSession, root: str, config: MiningConfig = MiningConfig(), **options
    ) -> FactorMiner:
        bars = scan_bars(spark, root, config.data_source)
        options.setdefault("order", bar_order(bars, config.data_source))
        return cls(bars, config, **options)

    def load(self, start: str | dt.date, end: str | dt.date, **options) -> FactorMiner:
        self.data = load_required(
            self.bars, start, end, factors=self.factors, order=self.order, **options
        )
        return self

    def prepare(
        self, target: str = TARGET, features: Sequence[str] | None = None, method: str = "robust"
    ) -> FactorMiner:
        if self.data is None:
            raise ValueError("load data first")
        self.prepared = prepare(self.data, features, target, method, order=self.order)
        return self

    def train(self) -> FactorMiner:
        if self.prepared is None:
            raise ValueError("prepare data first")
        self.model = train(self.prepared, self.config, self.initial_expressions)
        return self

    def trained(self) -> FactorModel:
        if self.model is None:
            raise ValueError("train first")
        return self.model

    @property
    def expression(self) -> str:
        return self.trained().expression

    def values(self, rows: DataFrame | None = None) -> DataFrame:
        return self.trained().values(rows)

    def save(self, path: str) -> None:
        self.trained().save(path)
