"""How well a value predicts the target: MSE, R2, IC and rank IC."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.registry import Registry
from factorloom.operators.joins import null_safe_join, split_join
from factorloom.operators.ranks import average_ranks
from factorloom.operators.series import KEYS, ORDER, Series, lay_out
from factorloom.plans import expressions as ex
from factorloom.plans import moments
from factorloom.session import materialize

EXPRESSIONS_PER_JOB = 200
LEAST_LINEAR = 20  # sums and differences that make a read of their own worth while
SCORES = "id int, expression string, size int, rows bigint, mse double, r2 double, ic double"


def _pairs(df: DataFrame, y: str, p: str) -> DataFrame:
    """Rows with both values."""
    a, b = F.col(y), F.col(p)
    return df.filter(a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b))


def _mse(y: str, p: str) -> Column:
    gap = F.col(y) - F.col(p)
    return F.avg(gap * gap)


def _r2(y: str, p: str) -> Column:
    return 1 - F.try_divide(_mse(y, p), F.var_pop(y))


def _ic(y: str, p: str) -> Column:
    # the plain corr() raises on a constant column under ANSI rules
    return F.try_divide(F.covar_pop(y, p), F.stddev_pop(y) * F.stddev_pop(p))


def mse(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    return _pairs(df, y, p).groupBy(*by).agg(_mse(y, p).alias("mse"))


def r2(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    return _pairs(df, y, p).groupBy(*by).agg(_r2(y, p).alias("r2"))


def ic(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    return _pairs(df, y, p).groupBy(*by).agg(_ic(y, p).alias("ic"))


def rank_ic(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of average ranks over all rows, or per group.

    Works on counts of distinct pairs, so repeated values shrink before any shuffle; both
    columns are ranked in one pass and hot values are joined by broadcast.
    """
    by = list(by)
    joint = materialize(
        _pairs(df, y, p)
        .groupBy(
            *by, (F.col(y).cast("double") + 0.0).alias("y"), (F.col(p).cast("double") + 0.0).alias("p")
        )
        .agg(F.count(F.lit(1)).alias("n")),
        "pairs",
    )
    # both sides come from one read of the pairs
    each = F.explode(
        F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("v")) for s in ("y", "p")])
    )
    sides = joint.select(*by, each.alias("e"), "n").select(*by, "e.*", "n")
    counts = sides.groupBy(*by, "side", "v").agg(F.sum("n").alias("n"))
    ranked = materialize(average_ranks(counts, [*by, "side"], "v"), "ranks")
    # ranks are measured from their known mean, which keeps the sums small
    centred = ranked.withColumn("r", F.col("rank") - (F.col("total") + 1) / 2)
    joined = joint
    for side in ("y", "p"):
        lookup = centred.filter(F.col("side") == side).select(
            *by, F.col("v").alias(side), F.col("r").alias(f"r{side}")
        )
        if by:
            joined = null_safe_join(joined, lookup, [*by, side])
        else:
            joined = split_join(joined, lookup, [side], measured=joint)
    weighted = lambda a, b: F.sum(F.col("n") * F.col(a) * F.col(b))
    spread = F.sqrt(weighted("ry", "ry")) * F.sqrt(weighted("rp", "rp"))
    return joined.groupBy(*by).agg(F.try_divide(weighted("ry", "rp"), spread).alias("rank_ic"))


def agreement(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, mse, r2 and ic in one pass."""
    return _pairs(df, y, p).groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        _mse(y, p).alias("mse"),
        _r2(y, p).alias("r2"),
        _ic(y, p).alias("ic"),
    )


def score_summary(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """mse, r2, correlation, ic and rank_ic in one row, or one row per group."""
    # read twice, so the columns are written once
    pairs = materialize(_pairs(df, y, p).select(*by, y, p), "scored")
    if by:
        table = null_safe_join(agreement(pairs, y, p, by), rank_ic(pairs, y, p, by), list(by))
        return table.select(*by, "mse", "r2", F.col("ic").alias("correlation"), "ic", "rank_ic")
    return (
        agreement(pairs, y, p)
        .withColumn("correlation", F.col("ic"))
        .withColumn("rank_ic", rank_ic(pairs, y, p).scalar())
        .select("mse", "r2", "correlation", "ic", "rank_ic")
    )


def score_on(
    series: Series,
    exprs: Sequence[ex.Expr],
    y: str,
    functions: Registry,
    where: Column | None = None,
    with_rank_ic: bool = False,
) -> DataFrame:
    """Score expressions on laid-out rows: id, expression, size, rows, mse, r2, ic, and rank_ic if asked for.

    Values are turned to (id, value) rows inside the scan stage and combined on the map side;
    one wide aggregate of hundreds of columns is far slower.
    """
    spark = series.rows.sparkSession
    parts = []
    for start in range(0, len(exprs), EXPRESSIONS_PER_JOB):
        chunk = exprs[start : start + EXPRESSIONS_PER_JOB]
        names = {f"__e{i}": e for i, e in enumerate(chunk)}
        valued = ex.evaluate_on(series, names, functions).own()
        if where is not None:
            valued = valued.filter(where)
        tall = valued.select(
            F.col(y).cast("double").alias("y"), F.posexplode(F.array(*names)).alias("i", "p")
        )
        tall = tall.withColumn("id", F.col("i") + start).drop("i")
        scored = agreement(tall, "y", "p", ["id"])
        if with_rank_ic:
            scored = scored.join(rank_ic(tall, "y", "p", ["id"]), "id", "left")
        parts.append(scored)
    labels = spark.createDataFrame(
        [(i, ex.text(e), ex.size(e)) for i, e in enumerate(exprs)],
        "id int, expression string, size int",
    )
    scores = reduce(DataFrame.unionByName, parts)
    return labels.join(scores, "id", "left")


def score_expressions(
    df: DataFrame,
    exprs: Sequence[ex.Expr],
    y: str,
    functions: Registry,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ORDER,
    block_rows: int | None = None,
) -> DataFrame:
    """Score a list of expressions over a table, one row each.

    Many sums and differences of columns are scored by one read for the second moments of these columns; where
    moments do not tell (missing or huge values, parts that cancel), and for all other expressions, values are made row by row.
    """
    known: dict[ex.Expr, moments.Score] = {}
    sign = moments.signs(functions)
    if sum(isinstance(e, tuple) and e[0] in sign for e in exprs) >= LEAST_LINEAR:
        known = moments.score_linear(df, exprs, y, functions)
    left = [e for e in exprs if e not in known]
    spark = df.sparkSession
    rows = [(i, ex.text(e), ex.size(e), *known[e][:4]) for i, e in enumerate(exprs) if e in known]
    told = spark.createDataFrame(rows, SCORES)
    if not left:
        return told
    reach = max(ex.lookback(e, functions) for e in left)
    series = lay_out(df, keys, order, before=reach, block_rows=block_rows)
    scores = score_on(series, left, y, functions)
    if not known:
        return scores
    places = spark.createDataFrame([(n, i) for n, i in enumerate(i for i, e in enumerate(exprs) if e not in known)], "id int, place int")
    scores = scores.join(places, "id").withColumn("id", F.col("place")).drop("place")
    return scores.select(*told.columns).unionByName(told)


# Each metric as something to make small; a strong negative correlation is as useful as a positive one.
METRICS = {
    "mse": lambda: F.col("mse"),
    "ic": lambda: -F.abs(F.col("ic")),
    "rank_ic": lambda: -F.abs(F.col("rank_ic")),
}
LEAST_ROWS = 0.9


def rank_expressions(
    scores: DataFrame,
    parsimony: float = 0.01,
    top: int = 10,
    metric: str = "mse",
    least_rows: float = LEAST_ROWS,
) -> DataFrame:
    """The ``top`` expressions by the metric plus a penalty per function, column and constant.

    An expression with values on fewer than ``least_rows`` of the rows of the fullest one is left
    out: a score on a few rows cannot be compared.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}; choose one of {', '.join(METRICS)}")
    fitness = METRICS[metric]() + parsimony * F.col("size")
    fullest = scores.agg(F.max("rows")).scalar()
    return (
        scores.filter(METRICS[metric]().isNotNull() & (F.col("rows") >= least_rows * fullest))
        .withColumn("fitness", fitness)
        .orderBy("fitness", "id")
        .limit(top)
    )
