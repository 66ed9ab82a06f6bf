"""Iterative search for a factor formula: each round is one Spark scoring job.

The driver holds only formulas: a bounded list of candidates per round with their scores, and the best few that
breed the next one. The rows are packed once in a value store (``store``), so a round is one pass
without an exchange of rows, for any number of searches. A journal keeps finished rounds.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Container, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

from factorloom.functions.registry import Registry
from factorloom.operators.prep import key_share
from factorloom.operators.series import KEYS, ORDER, Series, lay_out
from factorloom.plans import expressions as ex
from factorloom.plans.moments import Score
from factorloom.plans.scoring import LEAST_ROWS, METRICS, score_on
from factorloom.plans.store import KEEP_STEPS, ValueStore, supports

HISTORY = "round int, id int, expression string, size int, mse double, r2 double, ic double, fitness double"


# The defaults up to ``random_state`` are fixed values, but for ``beam`` and ``constants``.
@dataclass(frozen=True)
class SearchSettings:
    """Sizes and limits of a search.

    ``population_size`` formulas are scored in each of ``generations`` rounds (in the first, beside seeds and
    plain columns), and the best ``beam`` breed the next round. They are drawn uniformly by seed and round from
    all one-step extensions; in later rounds up to half of them from those of survivors with each other. ``max_samples`` is the share of rows scored, so figures of the search are figures of that
    share. ``metric`` is ``mse``, ``ic`` or ``rank_ic``; formulas with values on less than ``least_rows``
    of the rows are not ranked. ``stopping_criteria`` concerns mse.
    """

    population_size: int = 1000
    generations: int = 50
    beam: int = 20
    stopping_criteria: float = 0.001
    const_range: tuple[float, float] = (-10.0, 10.0)
    constants: int = 5
    max_depth: int = 8
    parsimony_coefficient: float = 0.01
    max_samples: float = 0.9
    random_state: int = 42
    metric: str = "mse"
    least_rows: float = LEAST_ROWS


@dataclass
class SearchResult:
    best: ex.Expr
    mse: float
    r2: float | None
    ic: float | None
    rounds: int
    history: list[tuple] = field(default_factory=list)

    @property
    def expression(self) -> str:
        return ex.text(self.best)


def constant_table(settings: SearchSettings) -> list[float]:
    low, high = settings.const_range
    steps = max(settings.constants - 1, 1)
    return [low + (high - low) * i / steps for i in range(settings.constants)]


def _extensions(
    parents: Sequence[ex.Expr], partners: Sequence[ex.Expr], functions: Registry, max_depth: int
) -> tuple[int, Callable[[int], ex.Expr | None]]:
    """The number of places of (function, parent, partner, side), and what gives the formula of a place.

    A place gives None if its formula has no column or has another place too.
    """
    parents = [p for p in dict.fromkeys(parents) if ex.depth(p) < max_depth]
    partners = [p for p in dict.fromkeys(partners) if ex.depth(p) < max_depth]
    among_parents, among_partners = set(parents), set(partners)
    single = [n for n, f in functions.items() if f.arity == 1]
    double = [n for n, f in functions.items() if f.arity == 2]
    alone = len(single) * len(parents)

    def at(place: int) -> ex.Expr | None:
        if place < alone:
            name, parent = divmod(place, len(parents))
            grown = (single[name], parents[parent])
        else:
            rest, side = divmod(place - alone, 2)
            rest, other = divmod(rest, len(partners))
            name, parent = divmod(rest, len(parents))
            one, two = parents[parent], partners[other]
            if side and two in among_parents and one in among_partners:
                return None
            grown = (double[name], two, one) if side else (double[name], one, two)
        return grown if ex.columns(grown) else None

    return alone + len(double) * len(parents) * len(partners) * 2, at


def draw(
    parents: Sequence[ex.Expr],
    partners: Sequence[ex.Expr],
    functions: Registry,
    max_depth: int,
    limit: int,
    salt: str,
    seen: Container[ex.Expr] = (),
) -> list[ex.Expr]:
    """At most ``limit`` of all one-step extensions not seen yet, uniformly; a salt repeats its choice.

    Places are shuffled as they are drawn, so only the places drawn are held and every formula has its chance.
    """
    places, at = _extensions(parents, partners, functions, max_depth)
    chance = random.Random(salt)
    moved: dict[int, int] = {}
    found: list[ex.Expr] = []
    for place in range(places):
        if len(found) >= limit:
            break
        other = chance.randrange(place, places)
        first = moved.pop(place, place)
        taken = first if other == place else moved.get(other, other)
        if other != place:
            moved[other] = first
        e = at(taken)
        if e is not None and e not in seen:
            found.append(e)
    return found


def reach_limit(functions: Registry, max_depth: int) -> int:
    """The longest lookback any formula of the allowed depth can have."""
    longest = max((getattr(f, "size", 1) - 1 for f in functions.values()), default=0)
    return longest * max_depth


def scored_share(series: Series, settings: SearchSettings) -> Column:
    """The rows a search scores. It has a seed of its own: the sample must not follow the train and validation split."""
    return key_share([*series.keys, *series.order], settings.random_state + 1) < settings.max_samples


def _level(fitness: float) -> float:
    """Fitness to ten digits: equal formulas in different words are equally good, whatever their last digits."""
    return float(f"{fitness:.10g}")


class Search:
    """The state of one search between rounds: formulas to score next, the best so far, and all seen."""

    def __init__(
        self, features: Sequence[str], functions: Registry, settings: SearchSettings, seeds: Sequence[ex.Expr] = ()
    ):
        for seed in seeds:
            ex.check(seed, functions)
        self.features, self.functions, self.settings, self.seeds = list(features), functions, settings, list(seeds)
        self.partners: list[ex.Expr] = [*self.features, *constant_table(settings)]
        self.seen: set[ex.Expr] = set()
        self.survivors: list[tuple[float, ex.Expr, tuple]] = []
        self.history: list[tuple] = []
        self.rounds = 0
        self.candidates: list[ex.Expr] = []
        if settings.generations > 0:
            first = [*self.seeds, *self.features]
            first += draw(
                self.features, self.partners, functions, settings.max_depth, settings.population_size,
                f"{settings.random_state}|0",
            )
            self.candidates = list(dict.fromkeys(first))

    @property
    def parents(self) -> list[ex.Expr]:
        return [s[1] for s in self.survivors]

    def accept(self, top: Sequence[tuple[float, int, Score]]) -> None:
        """End a round with its best candidates (fitness, number, score), and draw the next ones."""
        settings = self.settings
        self.seen.update(self.candidates)
        for fitness, i, s in top:
            e = self.candidates[i]
            self.history.append((self.rounds, i, ex.text(e), ex.size(e), s.mse, s.r2, s.ic, fitness))
            self.survivors.append((fitness, e, (s.mse, s.r2, s.ic)))
        self.survivors = sorted(self.survivors, key=lambda s: (_level(s[0]), ex.text(s[1])))[: settings.beam]
        self.rounds += 1
        reached = settings.metric == "mse" and self.survivors and self.survivors[0][2][0] <= settings.stopping_criteria
        if reached or self.rounds >= settings.generations:
            self.candidates = []
            return
        parents, salt, room = self.parents, f"{settings.random_state}|{self.rounds}", settings.population_size
        # survivors with each other first: among many columns they would hardly ever be drawn
        among = draw(parents, parents, self.functions, settings.max_depth, room // 2, f"{salt}|among", self.seen)
        rest = self.seen.union(among)
        self.candidates = among + draw(
            parents, [*parents, *self.partners], self.functions, settings.max_depth, room - len(among), salt, rest
        )

    def best(self, scores: Sequence[Score]) -> list[tuple[float, int, Score]]:
        """The ``beam`` best candidates; those with values on few rows are left out, as ``rank_expressions`` does."""
        name, worth = self.settings.metric, self.settings.parsimony_coefficient
        if name not in METRICS:
            raise ValueError(f"unknown metric {name}; choose one of {', '.join(METRICS)}")
        fullest = max((s.rows for s in scores), default=0)
        found = []
        for i, (e, s) in enumerate(zip(self.candidates, scores, strict=True)):
            value = getattr(s, name)
            if value is not None and s.rows >= self.settings.least_rows * fullest:
                fitness = (value if name == "mse" else -abs(value)) + worth * ex.size(e)
                found.append((fitness, i, s))
        return sorted(found, key=lambda f: (_level(f[0]), f[1]))[: self.settings.beam]

    def result(self) -> SearchResult:
        if not self.survivors:
            raise ValueError("no expression could be scored")
        _, best, (best_mse, best_r2, best_ic) = self.survivors[0]
        return SearchResult(best, best_mse, best_r2, best_ic, self.rounds, self.history)


class _Blocks:
    """Scores rounds of several searches by one pass over a value store."""

    def __init__(self, series: Series, target: str, searches: Sequence[Search], where: Column | None):
        functions = {n: f for s in searches for n, f in s.functions.items()}
        features = list(dict.fromkeys(c for s in searches for e in [*s.features, *s.seeds] for c in sorted(ex.columns(e))))
        samples = {(s.settings.random_state, s.settings.max_samples): s.settings for s in searches}
        self.mask = {k: i for i, k in enumerate(samples)}
        self.masks = [scored_share(series, s) for s in samples.values()]
        self.masks = self.masks if where is None else [m & where for m in self.masks]
        self.series, self.target, self.functions = series, target, functions
        reach = max(
            max([reach_limit(s.functions, s.settings.max_depth), *[ex.lookback(e, s.functions) for e in s.seeds]])
            for s in searches
        )
        self.store = ValueStore.build(series, features, target, self.masks, functions, reach=reach)

    def _mask(self, search: Search) -> int:
        return self.mask[search.settings.random_state, search.settings.max_samples]

    def tops(self, searches: Sequence[Search]) -> list[list[tuple[float, int, Score]]]:
        wanted: dict[int, dict[ex.Expr, None]] = {}
        for s in searches:
            wanted.setdefault(self._mask(s), {}).update(dict.fromkeys(s.candidates))
        scores, unknown = self.store.score({m: list(exprs) for m, exprs in wanted.items()})
        for m, exprs in wanted.items() if unknown else ():
            odd = [e for e in exprs if e in unknown]
            rows = score_on(self.series, odd, self.target, self.functions, self.masks[m]).collect() if odd else []
            scores |= {(m, odd[r["id"]]): Score(r["rows"] or 0, r["mse"], r["r2"], r["ic"]) for r in rows}
        return [s.best([scores[self._mask(s), e] for e in s.candidates]) for s in searches]

    def keep(self, searches: Sequence[Search]) -> None:
        parents = list(dict.fromkeys(e for s in searches for e in s.parents))
        if self.store.steps(parents) > KEEP_STEPS:
            self.store = self.store.keep(parents)

    def close(self) -> None:
        """Nothing is in the catalog; files stay with the scratch folder."""


class _Frames:
    """Scores rounds one search after the other with Columns: for functions without a kernel, and for rank IC."""

    def __init__(self, series: Series, target: str, searches: Sequence[Search], where: Column | None):
        self.series, self.target, self.where = series.store(), target, where

    def tops(self, searches: Sequence[Search]) -> list[list[tuple[float, int, Score]]]:
        return [self._top(s) for s in searches]

    def _top(self, search: Search) -> list[tuple[float, int, Score]]:
        s = search.settings
        share = scored_share(self.series, s)
        scored = share if self.where is None else share & self.where
        rows = score_on(
            self.series, search.candidates, self.target, search.functions, scored, with_rank_ic=s.metric == "rank_ic"
        ).collect()
        of = {r["id"]: Score(r["rows"] or 0, r["mse"], r["r2"], r["ic"], r.asDict().get("rank_ic")) for r in rows}
        return search.best([of[i] for i in range(len(search.candidates))])

    def keep(self, searches: Sequence[Search]) -> None:
        """Every round evaluates whole formulas."""

    def close(self) -> None:
        self.series.drop()


class Journal:
    """Rounds of a series of searches in a folder every node can reach; a search that was stopped goes on after the last one.

    A round is a folder with one row per search: the numbers and scores of its best candidates. Everything else follows from
    these, as candidates are drawn by seed and round.
    """

    SCHEMA = "search int, round int, settings string, top array<struct<fitness: double, id: int, rows: bigint, mse: double, r2: double, ic: double>>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.next = spark, path.rstrip("/"), 0

    def _folder(self, number: int) -> str:
        return f"{self.path}/round={number}"

    def _is_whole(self, number: int) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder(number)}/_SUCCESS")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    @staticmethod
    def _label(search: Search) -> str:
        return f"{search.settings} {search.features} {[ex.text(s) for s in search.seeds]} {sorted(search.functions)}"

    def replay(self, searches: Sequence[Search]) -> None:
        """Bring the searches to where the journal ends."""
        while self._is_whole(self.next):
            rows = self.spark.read.schema(self.SCHEMA.replace("round int, ", "")).json(self._folder(self.next)).collect()
            for r in sorted(rows, key=lambda r: r["search"]):
                search = searches[r["search"]]
                if r["settings"] != self._label(search):
                    raise ValueError("the journal belongs to a search with other settings")
                search.accept([(t["fitness"], t["id"], Score(t["rows"], t["mse"], t["r2"], t["ic"])) for t in r["top"]])
            self.next += 1

    def append(self, searches: Sequence[Search], tops: Mapping[int, Sequence[tuple[float, int, Score]]]) -> None:
        rows = [(i, self.next, self._label(searches[i]), [(f, n, *s[:4]) for f, n, s in top]) for i, top in tops.items()]
        table = self.spark.createDataFrame(rows, self.SCHEMA).drop("round").coalesce(1)
        table.write.mode("overwrite").json(self._folder(self.next))
        self.next += 1


def search_all(
    series: Series,
    target: str,
    searches: Sequence[Search],
    where: Column | None = None,
    journal: str | None = None,
) -> list[SearchResult | ValueError]:
    """Run searches together over laid-out rows: a round of all of them reads the rows once.

    ``where`` limits the rows that are scored. A search that ends without a formula gives its error.
    With ``journal``, a folder, finished rounds are written down and not run again.
    """
    notes = Journal(series.rows.sparkSession, journal) if journal else None
    if notes:
        notes.replay(searches)
    number = {id(s): i for i, s in enumerate(searches)}
    if any(s.candidates for s in searches):
        blocks = all(supports(s.functions) and s.settings.metric != "rank_ic" for s in searches)
        scorer = (_Blocks if blocks else _Frames)(series, target, searches, where)
        try:
            while active := [s for s in searches if s.candidates]:
                tops = scorer.tops(active)
                if notes:
                    notes.append(searches, {number[id(s)]: top for s, top in zip(active, tops)})
                for s, top in zip(active, tops):
                    s.accept(top)
                scorer.keep([s for s in active if s.candidates])
        finally:
            scorer.close()
    return [_outcome(s) for s in searches]


def _outcome(search: Search) -> SearchResult | ValueError:
    try:
        return search.result()
    except ValueError as error:
        return error


def search_on(
    series: Series,
    features: Sequence[str],
    target: str,
    functions: Registry,
    settings: SearchSettings = SearchSettings(),
    seeds: Sequence[ex.Expr] = (),
    where: Column | None = None,
    journal: str | None = None,
) -> SearchResult:
    """Search formulas over laid-out rows; ``where`` limits the rows that are scored."""
    (found,) = search_all(series, target, [Search(features, functions, settings, seeds)], where, journal)
    if isinstance(found, ValueError):
        raise found
    return found


def search_factors(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    functions: Registry,
    settings: SearchSettings = SearchSettings(),
    seeds: Sequence[ex.Expr] = (),
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    journal: str | None = None,
) -> SearchResult:
    series = lay_out(df, keys, order, before=reach_limit(functions, settings.max_depth))
    return search_on(series, features, target, functions, settings, seeds, journal=journal)


def history_table(spark: SparkSession, result: SearchResult) -> DataFrame:
    return spark.createDataFrame(result.history, HISTORY).orderBy("round", "fitness")
