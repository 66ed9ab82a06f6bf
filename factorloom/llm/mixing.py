"""Mix sources to target weights, with whole epochs and an exact cut.

Every row gets a hash-random key. Within a source the keys are cut into ranges, the words of
each range are summed, prefix sums of those few numbers give each range its start, and only
then are rows summed inside their range. A source that holds a third of all rows is therefore
spread over as many tasks as it has ranges. What remains global is one row per source.

Cases: a null text has size 0; a null source is a source of its own and comes last; rows of size 0
take nothing; a source without words has target 0; repeated rows are mixed one by one; equal keys are ordered
by doc_id and size; an empty table gives an empty result. Other columns are carried along
untouched when ``keep`` is set, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
LIMIT = 2.0
RANGE_ROWS = 2_000
RANGES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_key(doc_id: Column, seed: str = "") -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))


def source_targets(
    sized: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
) -> DataFrame:
    """One row per source: ``__source, source_size, target`` and the ranges its rows are cut into.

    Targets are proportional to the weights until they reach ``limit`` times the source; what is above
    goes to the others. Sorted by limit over weight, sources before the first one that
    stays below its limit are full, so one pass of sums gives the common level.
    """
    if share > limit:
        raise ValueError("the share of all words cannot exceed the limit of each source")
    totals = sized.groupBy("__source").agg(
        F.sum("__size").alias("source_size"),
        F.ceil(F.count(F.lit(1)) / RANGE_ROWS).alias("__n"),
    )
    place = F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place % len(weights) + 1)
    totals = totals.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * float(limit))
    totals = totals.withColumn("__ratio", F.col("__cap") / F.col("__w"))
    order = Window.orderBy("__ratio", F.col("__source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("__cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("__w").over(order.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(whole) * float(share)
    totals = totals.withColumns({"__i": F.row_number().over(order), "__level": (budget - before) / rest})
    open_one = F.when(F.col("__level") < F.col("__ratio"), F.struct("__i", "__level"))
    totals = totals.withColumn("__first", F.min(open_one).over(whole))
    target = F.when(
        F.col("__first").isNull() | (F.col("__i") < F.col("__first.__i")), F.col("__cap")
    ).otherwise(F.col("__w") * F.col("__first.__level"))
    return totals.select(
        "__source",
        "source_size",
        target.alias("target"),
        F.least(F.greatest("__n", F.lit(1)), F.lit(RANGES)).alias("__ranges"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
    seed: str = "",
    keep: bool = False,
) -> DataFrame:
    """What the mix takes of every row of ``docs`` (doc_id, text, source).

    Returns doc_id, size, source_size, target, taken, copies: ``taken`` counts words, the last row before a
    source's budget gives only the words that are left; ``copies`` counts whole epochs
    and counts that last row whole. With ``keep``, the columns of ``docs`` and ``__copies`` instead.
    """
    own = {
        "__id": F.col("doc_id"),
        "__source": F.col("source"),
        "__size": word_count(F.col("text")),
        "__key": mix_key(F.col("doc_id"), seed),
    }
    if keep:
        rows = docs.withColumns(own)
    else:
        rows = materialize(docs.select(*[c.alias(n) for n, c in own.items()]), "sized")
    sources = materialize(source_targets(rows.select(*own), weights, share, limit), "sources")
    rows = rows.join(
        sources.withColumnsRenamed(
            {"__source": "__s", "source_size": "__total", "target": "__target"}
        ),
        F.col("__source").eqNullSafe(F.col("__s")),
    ).drop("__s")
    place = F.conv(F.substring("__key", 1, 4), 16, 10).cast("long")
    rows = rows.withColumn("__range", F.floor(place * F.col("__ranges") / 65536))

    sums = rows.groupBy("__source", "__range").agg(F.sum("__size").alias("__n"))
    past = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("__source").alias("__s"),
        F.col("__range").alias("__r"),
        F.coalesce(F.sum("__n").over(past), F.lit(0)).alias("__start"),
    )
    same = F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r"))
    rows = rows.join(starts, same).drop("__s", "__r")
    inside = (
        Window.partitionBy("__source", "__range")
        .orderBy("__key", F.col("__id"), F.col("__size"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.col("__start") + F.coalesce(F.sum("__size").over(inside), F.lit(0))
    epochs = F.when(F.col("__total") > 0, F.floor(F.col("__target") / F.col("__total"))).otherwise(0)
    rows = rows.withColumns({"__before": before, "__epochs": epochs})
    left = F.floor(F.col("__target") - F.col("__epochs") * F.col("__total")) - F.col("__before")
    rows = rows.withColumn("__part", F.greatest(F.lit(0), F.least(F.col("__size"), left)).cast("long"))
    copies = F.col("__epochs") + F.when(F.col("__part") > 0, 1).otherwise(0)
    if keep:
        return rows.select(*docs.columns, copies.cast("int").alias("__copies"))
    return rows.select(
        F.col("__id").alias("doc_id"),
        F.col("__size").alias("size"),
        F.col("__total").alias("source_size"),
        F.round("__target", 6).alias("target"),
        (F.col("__epochs") * F.col("__size") + F.col("__part")).cast("long").alias("taken"),
        copies.cast("long").alias("copies"),
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it."""
    chosen = mix(docs, keep=True, **settings).filter(F.col("__copies") > 0)
    again = F.explode(F.sequence(F.lit(1), F.col("__copies")))
    return chosen.withColumn("__copy", again).select(*docs.columns)


def sql(
    table: str = "documents",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
) -> str:
    """The rows of ``mix`` in SQL."""
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return f"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM {table}),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {cases} END::DOUBLE AS w
  FROM sized GROUP BY source),
caps AS (SELECT *, source_size * {float(limit)}::DOUBLE AS cap FROM totals),
levels AS (
  SELECT *, row_number() OVER o AS i,
         (sum(source_size) OVER () * {float(share)}::DOUBLE
          - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM caps WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
first_open AS (SELECT min(i) AS f, arg_min(level, i) AS level FROM levels WHERE level < cap / w),
targets AS (
  SELECT l.source, l.source_size,
         CASE WHEN f IS NULL OR i < f THEN cap ELSE w * o.level END AS target
  FROM levels l, first_open o),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
parts AS (
  SELECT *, greatest(0, least(size, floor(target - epochs * source_size) - before)) AS part FROM placed)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (epochs * size + part)::BIGINT AS taken,
       (epochs + CASE WHEN part > 0 THEN 1 ELSE 0 END)::BIGINT AS copies
FROM parts
"""
