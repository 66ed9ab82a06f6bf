"""Factor mining end to end: load, prepare, search, score, save; and trials over settings."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions.registry import Registry, default_registry
from factorloom.functions.timeseries import WINDOW_SIZES
from factorloom.operators.prep import FeaturePrep, fit_prep, key_share
from factorloom.operators.schema import feature_columns
from factorloom.operators.series import KEYS, ORDER, Series, lay_out
from factorloom.plans import expressions as ex
from factorloom.plans.loading import TARGET, load_required
from factorloom.plans.scoring import agreement, score_on, score_summary
from factorloom.plans.search import Search, SearchResult, SearchSettings, reach_limit, search_all
from factorloom.session import materialize
from factorloom.sources.tables import bar_order, scan_bars, write_factor_values

log = logging.getLogger(__name__)

FEW_ROWS = 100
PREDICTION = "factor_value"


@dataclass(frozen=True)
class MiningConfig:
    data_source: str = "day"
    use_custom_functions: bool = True
    window_sizes: tuple[int, ...] = WINDOW_SIZES
    search: SearchSettings = SearchSettings()

    def functions(self) -> Registry:
        return default_registry(self.window_sizes, self.use_custom_functions)

    def label(self) -> str:
        s = self.search
        return (
            f"windows={list(self.window_sizes)} population={s.population_size} "
            f"generations={s.generations} parsimony={s.parsimony_coefficient}"
        )


# The three built-in trial settings and the default for the final run.
TRIAL_CONFIGS = (
    MiningConfig(
        window_sizes=(3, 5, 10),
        search=SearchSettings(population_size=300, generations=20, beam=15, parsimony_coefficient=0.01),
    ),
    MiningConfig(
        window_sizes=(5, 10, 20),
        search=SearchSettings(population_size=800, generations=40, beam=25, parsimony_coefficient=0.005),
    ),
    MiningConfig(
        window_sizes=(3, 5, 10, 15),
        search=SearchSettings(population_size=500, generations=30, beam=20, parsimony_coefficient=0.008),
    ),
)
FINAL_CONFIG = MiningConfig(
    window_sizes=(3, 5, 10, 15),
    search=SearchSettings(population_size=1000, generations=50, beam=25, parsimony_coefficient=0.01),
)


@dataclass
class Prepared:
    """Prepared rows, a plain projection of a stored table, with the fitted parameters."""

    rows: DataFrame
    prep: FeaturePrep
    keys: tuple[str, ...] = KEYS
    order: tuple[str, ...] = ORDER

    @property
    def features(self) -> list[str]:
        return list(self.prep.features)

    def lay_out(self, *configs: MiningConfig) -> Series:
        """The rows by instrument, with enough lookback for all the settings."""
        reach = max(reach_limit(c.functions(), c.search.max_depth) for c in configs)
        return lay_out(self.rows, self.keys, self.order, before=reach)


def prepare(
    table: DataFrame,
    features: Sequence[str] | None = None,
    target: str = TARGET,
    method: str = "robust",
    fit_where: Column | None = None,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
) -> Prepared:
    """Write keys, features and target once, and fit the preparation on them.

    ``fit_where`` fits on part of the rows only, for example the training split.
    """
    names = feature_columns(table, target, list(features) if features else None)
    dated = ["date"] if "date" in table.columns else []
    ids = list(dict.fromkeys([*dated, *keys, *order]))
    loaded = materialize(table.select(*ids, *names, target), "loaded")
    fitted = loaded if fit_where is None else loaded.filter(fit_where)
    prep = fit_prep(fitted, names, target, method, stored=True)
    return Prepared(prep.transform(loaded), prep, tuple(keys), tuple(order))


def guard_training(prepared: Prepared) -> int:
    """Fail when the target hardly varies, warn when rows are few; gives the row count."""
    target = prepared.prep.target
    row = prepared.rows.agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp(target).alias("std")
    ).first()
    if row["std"] is None or row["std"] < 1e-6:
        raise ValueError("the target hardly varies; training is pointless")
    if row["n"] < FEW_ROWS:
        log.warning("only %d training rows", row["n"])
    return row["n"]


@dataclass
class FactorModel:
    """A found formula with the table it was found on, and that table's layout."""

    result: SearchResult
    prepared: Prepared
    config: MiningConfig
    series: Series | None = None
    history: list[tuple] = field(default_factory=list)

    @property
    def expression(self) -> str:
        return self.result.expression

    def values(self, rows: DataFrame | None = None) -> DataFrame:
        """Factor value per row, by default on the training rows."""
        p, functions = self.prepared, self.config.functions()
        wanted = {PREDICTION: self.result.best}
        if rows is None and self.series is not None:
            return ex.evaluate_on(self.series, wanted, functions).own()
        return ex.evaluate(p.rows if rows is None else rows, wanted, functions, p.keys, p.order)

    def summary(self) -> DataFrame:
        return score_summary(self.values(), self.prepared.prep.target, PREDICTION)

    def training_stats(self) -> DataFrame:
        """One row: expression, rows, features, score, correlation, R2."""
        fit = agreement(self.values(), self.prepared.prep.target, PREDICTION)
        return fit.select(
            F.lit(self.expression).alias("expression"),
            "rows",
            F.lit(len(self.prepared.features)).alias("features"),
            F.col("r2").alias("score"),
            F.col("ic").alias("correlation"),
            "r2",
        )

    def save(self, path: str) -> None:
        spark = self.prepared.rows.sparkSession
        write_factor_values(
            self.values(), f"{path}/factor_values.parquet", PREDICTION, self._keys()
        )
        write_factor_meta(self.training_stats(), f"{path}/factor_meta")
        if self.history:
            write_trial_history(trial_table(spark, self.history), f"{path}/training_history")

    def _keys(self) -> list[str]:
        p = self.prepared
        dated = ["date"] if "date" in p.rows.columns else []
        return list(dict.fromkeys([*dated, *p.keys, *p.order]))


def write_factor_meta(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").json(path)


TRIALS = "trial int, config string, mse double, r2 double, expression string"


def trial_table(spark: SparkSession, history: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(history), TRIALS)


def write_trial_history(history: DataFrame, path: str) -> None:
    history.write.mode("overwrite").option("header", True).csv(path)


def train(
    prepared: Prepared,
    config: MiningConfig = FINAL_CONFIG,
    seeds: Sequence[ex.Expr] = (),
    where: Column | None = None,
    series: Series | None = None,
    journal: str | None = None,
) -> FactorModel:
    """Search with one setting. ``journal`` is a folder for finished rounds; a stopped search goes on from it."""
    guard_training(prepared)
    series = series or prepared.lay_out(config)
    searches = [Search(prepared.features, config.functions(), config.search, seeds)]
    (result,) = search_all(series, prepared.prep.target, searches, where, journal)
    if isinstance(result, ValueError):
        raise result
    return FactorModel(result, prepared, config, series)


@dataclass
class TrialOutcome:
    best: MiningConfig | None
    best_mse: float | None
    history: list[tuple]


def trial_configs(
    prepared: Prepared,
    configs: Sequence[MiningConfig] = TRIAL_CONFIGS,
    share: float = 0.2,
    seed: int = 42,
    n_trials: int | None = None,
    journal: str | None = None,
) -> TrialOutcome:
    """Search with each setting on the training rows and score on the held-out rows.

    Windows are computed on the whole table before the split. All settings go round by round together: one pass
    scores the candidates of every setting, and each keeps its own survivors. A setting that cannot be trained is skipped; failed
    cluster jobs are not swallowed. ``n_trials`` takes the first settings only.
    """
    configs = list(configs)[:n_trials]
    guard_training(prepared)
    series = prepared.lay_out(*configs)
    target = prepared.prep.target
    held_out = key_share([*prepared.keys, *prepared.order], seed) < share
    searches = [Search(prepared.features, c.functions(), c.search) for c in configs]
    found = search_all(series, target, searches, ~held_out, journal)
    outcome = TrialOutcome(None, None, [])
    best = list(dict.fromkeys(r.best for r in found if not isinstance(r, ValueError)))
    functions = {n: f for c in configs for n, f in c.functions().items()}
    scores = {best[r["id"]]: r for r in score_on(series, best, target, functions, held_out).collect()} if best else {}
    for number, (config, result) in enumerate(zip(configs, found), 1):
        if isinstance(result, ValueError):
            log.error("trial %d failed: %s", number, result)
            continue
        row = scores[result.best]
        outcome.history.append((number, config.label(), row["mse"], row["r2"], result.expression))
        if row["mse"] is not None and (outcome.best_mse is None or row["mse"] < outcome.best_mse):
            outcome.best, outcome.best_mse = config, row["mse"]
    if not outcome.history:
        raise ValueError("no setting could be tried")
    return outcome


def train_final(
    bars: DataFrame,
    start: str | dt.date,
    end: str | dt.date,
    config: MiningConfig | None = None,
    path: str | None = None,
    factors: DataFrame | None = None,
    features: Sequence[str] | None = None,
    history: Sequence[tuple] = (),
    seeds: Sequence[ex.Expr] = (),
    order: Sequence[str] = ORDER,
    journal: str | None = None,
) -> FactorModel:
    """Load, prepare, search and, with ``path``, save."""
    table = load_required(bars, start, end, factors=factors, order=order)
    model = train(prepare(table, features, order=order), config or FINAL_CONFIG, seeds, journal=journal)
    model = replace(model, history=list(history))
    if path:
        model.save(path)
    return model


def mine_source(
    spark: SparkSession,
    root: str,
    start: str | dt.date,
    end: str | dt.date,
    config: MiningConfig = FINAL_CONFIG,
    path: str | None = None,
    **options,
) -> FactorModel:
    """``train_final`` on a stored bar table: day, minute or tick."""
    bars = scan_bars(spark, root, config.data_source)
    order = options.pop("order", None) or bar_order(bars, config.data_source)
    return train_final(bars, start, end, config, path, order=order, **options)
