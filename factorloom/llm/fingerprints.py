"""Document fingerprints: bottom-k sketches of shingle hashes, from built-in functions only.

A sketch is the sorted array of the ``k`` smallest distinct hashes of a text's word shingles. Sketches of
parts merge into the sketch of the whole, and estimate resemblance, containment and the
number of distinct shingles. Everything here is a Column, so it runs inside a scan.

Cases: a null text is empty; a text without words has an empty sketch, an empty fingerprint and
likeness 0 to anything but another empty one, where it is 1; fewer words than a shingle make one shingle;
a sketch with fewer than ``k`` values is the whole set and its estimates are exact.
Other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP = r"[\x20\x09-\x0D]+"
K = 128
WORDS = 5
LEAST_ID = -(2**63)
RANGE_ROWS = 200
RANGES = 4096  # at most; bounds are literals in the plan


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """One hash for each run of ``words`` words, repeats included."""
    found = F.filter(F.split(text, GAP), lambda w: w != "")

    def over(own: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(own) - (words - 1), F.lit(1)))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(own, i, words)))
        return F.when(F.size(own) > 0, hashes).otherwise(F.array().cast("array<bigint>"))

    # the lambda binds the array of words once
    return F.element_at(F.transform(F.array(found), over), 1)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    return bottom(shingle_hashes(F.coalesce(text, F.lit("")), words), k)


def merge(one: Column, other: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(one, other)), 1, k)


def merge_parts(parts: DataFrame, key: str, column: str, k: int = K) -> DataFrame:
    """Sketches of the parts of each key merged; a task keeps at most ``k`` values per key it has seen."""
    values = parts.select(key, F.explode_outer(column).alias("__h")).distinct()
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("__h").asc_nulls_last()))
    least = values.withColumn("__i", place).filter(F.col("__i") <= k)
    return least.groupBy(key).agg(F.sort_array(F.collect_list("__h")).alias(column))


def resemblance(one: Column, other: Column, k: int = K) -> Column:
    """Jaccard similarity of the two shingle sets: the share of the union's sketch found in both."""
    both = F.array_intersect(one, other)

    def over(union: Column) -> Column:
        shared = F.size(F.array_intersect(union, both))
        return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(shared / F.size(union))

    return F.element_at(F.transform(F.array(merge(one, other, k)), over), 1)


def distinct_shingles(values: Column, k: int = K) -> Column:
    """Number of distinct shingles: the size itself below ``k``, else from the k-th value's place."""
    share = (F.element_at(values, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(values) < k, F.size(values).cast("double")).otherwise((k - 1) / share)


def containment(one: Column, other: Column, k: int = K) -> Column:
    """Share of the first set that lies in the second."""
    union = distinct_shingles(merge(one, other, k), k)
    shared = resemblance(one, other, k) * union
    own = distinct_shingles(one, k)
    return F.when(own > 0, F.least(F.lit(1.0), shared / own)).otherwise(F.lit(0.0))


def as_text(values: Column) -> Column:
    """The sketch as a string: its values in hexadecimal."""
    return F.array_join(F.transform(values, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def _bounds(docs: DataFrame) -> list[int]:
    """Ascending ids that cut the documents into ranges; the last one is the largest id."""
    ids = docs.select(F.coalesce("doc_id", F.lit(LEAST_ID)).alias("id"))
    rows, most = ids.agg(F.count("*"), F.max("id")).first()
    if not rows:
        return []
    ranges = max(1, min(RANGES, math.ceil(rows / RANGE_ROWS)))
    steps = [i / ranges for i in range(1, ranges)]
    cuts = ids.agg(F.percentile_approx("id", steps, 20 * ranges)).first()[0] if steps else []
    return sorted({*(cuts or []), most})


def _range_of(value: Column, bounds: list[int]) -> Column:
    """How many bounds lie below the value, looked up in two steps."""
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(g[-1]).cast("long") for g in groups])
    coarse = F.size(F.filter(heads, lambda b: b < value))
    table = F.array(*[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups])
    within = F.get(table, coarse)
    return coarse * step + F.size(F.filter(within, lambda b: b < value))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Each row with the ``columns`` of the next document by descending doc_id, as ``next_*``.

    After the last document comes the first; equal ids are ordered by text, null ids come
    last. Ids are cut into ranges; the first document of each range is also sent to the range
    that ends before it, so that one shuffle of the rows is enough.
    """
    bounds = _bounds(docs)
    place = F.coalesce(F.col("doc_id"), F.lit(LEAST_ID))
    rows = docs.withColumn("__place", place)
    if bounds:
        own = F.struct(_range_of(F.col("__place"), bounds).alias("r"), F.lit(False).alias("guest"))
        above = F.struct(((own["r"] + 1) % len(bounds)).alias("r"), F.lit(True).alias("guest"))
        first = F.get(F.array(*[F.lit(b).cast("long") for b in bounds]), own["r"]) == F.col("__place")
        homes = F.when(first, F.array(own, above)).otherwise(F.array(own))
    else:
        homes = F.array(F.struct(F.lit(0).alias("r"), F.lit(False).alias("guest")))
    rows = rows.withColumn("__home", F.explode(homes))
    order = Window.partitionBy("__home.r").orderBy(
        F.col("__home.guest"), F.col("__place").desc(), F.col("text").asc_nulls_first()
    )
    ahead = {f"next_{c}": F.lead(c).over(order) for c in columns}
    return rows.withColumns(ahead).filter(~F.col("__home.guest")).drop("__place", "__home")


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n/2) code points replaced by as many first ones of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_documents(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("sketch", sketch(F.col("text"), k, words))
    rows = with_next(rows, ["text", "sketch"])
    rows = rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        "sketch",
        "next_sketch",
        edited(F.col("text"), F.col("next_text")).alias("edited"),
    )
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), k, words))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("n_shingles"),
        containment(F.col("edited_sketch"), F.col("sketch"), k).alias("edited_within"),
    )
