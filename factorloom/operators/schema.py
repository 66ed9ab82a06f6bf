"""Bring rows into a table's schema: types, column order, row order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

# Row order of stored tables, and key columns that carry no measured value.
SORT_COLUMNS = ("date", "index_code", "order_book_id", "datetime")
KEY_FIELDS = ("date", "datetime", "order_book_id")
# Columns never offered as features.
NOT_FEATURES = (
    "date",
    "order_book_id",
    "prev_close",
    "limit_up",
    "limit_down",
    "total_turnover",
    "num_trades",
)


def cast_schema(df: DataFrame, schema: StructType, strict: bool = True) -> DataFrame:
    """Cast to the schema's types; malformed values raise, or become NULL if not strict."""
    casts = {
        f.name: F.col(f.name).cast(f.dataType) if strict else F.col(f.name).try_cast(f.dataType)
        for f in schema
        if f.name in df.columns
    }
    return df.withColumns(casts)


def order_columns(df: DataFrame, schema: StructType) -> DataFrame:
    """Schema columns first, in schema order; other columns keep their order after them."""
    named = [f.name for f in schema if f.name in df.columns]
    return df.select(*named, *[c for c in df.columns if c not in named])


def canonical_sort(df: DataFrame, within_partitions: bool = False) -> DataFrame:
    columns = [c for c in SORT_COLUMNS if c in df.columns]
    if not columns:
        return df
    return df.sortWithinPartitions(*columns) if within_partitions else df.orderBy(*columns)


def format_table(
    df: DataFrame, schema: StructType | None, strict: bool = True, sort: bool = True
) -> DataFrame:
    """Types, column order, row order. Writers pass ``sort=False``: they sort per folder."""
    if schema is not None:
        df = order_columns(cast_schema(df, schema, strict), schema)
    return canonical_sort(df) if sort else df


def value_fields(schema: StructType | None) -> list[str]:
    """Field names to request from a source: the schema without its keys."""
    return [f.name for f in schema or [] if f.name not in KEY_FIELDS]


def feature_columns(
    df: DataFrame, target: str, features: list[str] | None = None
) -> list[str]:
    """The given features, or every numeric column that is not a key, limit or the target."""
    if features is not None:
        return list(features)
    skipped = {*NOT_FEATURES, target}
    return [
        f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in skipped
    ]


def select_features(
    df: DataFrame, target: str, features: list[str] | None = None, keys: tuple[str, ...] = ()
) -> DataFrame:
    return df.select(*keys, *feature_columns(df, target, features))


def describe_table(df: DataFrame, head: int = 5) -> DataFrame:
    """Row count, column types and the first rows as (section, name, value)."""
    spark = df.sparkSession
    columns = spark.createDataFrame(
        [("column", name, kind) for name, kind in df.dtypes],
        "section string, name string, value string",
    )
    rows = df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(
        F.lit("rows").alias("section"), F.lit("").alias("name"), "value"
    )
    order = [c for c in SORT_COLUMNS if c in df.columns]
    first = df.orderBy(*order).limit(head) if order else df.limit(head)
    numbered = first.select(F.to_json(F.struct(*df.columns)).alias("value"))
    top = numbered.select(F.lit("head").alias("section"), F.lit("").alias("name"), "value")
    return rows.unionByName(columns).unionByName(top)
