"""Secret scans with a trigram inverted index, from built-in functions only.

Each rule's pattern is turned into a Boolean query of trigrams every match must contain. One
scan writes the postings of those trigrams; queries are answered from the postings alone, and
only candidate texts are read again and verified. A rule without mandatory trigrams scans
every text. Matches come from one pass of the pattern, so they are leftmost and do not overlap.

Cases: a null text is empty; rows with equal doc_id and text share one posting and one verification, and
every such row is returned; rows with equal doc_id but other texts are kept apart; an empty table
gives an empty result; very long texts are one row each, their matches are placed by running
sums. Other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as node
from re import _parser as parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_WORDS = 16  # alternatives followed at once when a query is derived


@dataclass(frozen=True)
class Rule:
    """``measure`` of a match is the length of its ``group``; shorter ones than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# fixed values: the base rules
RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
        True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

# ---- trigram queries -------------------------------------------------------------------------
# A query is True (anything), a trigram, or a tuple ("and" | "or", query, ...).


def _all(parts: list) -> object:
    kept = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not kept else kept[0] if len(kept) == 1 else ("and", *kept)


def _any(parts: list) -> object:
    kept = list(dict.fromkeys(parts))
    return True if True in kept or not kept else kept[0] if len(kept) == 1 else ("or", *kept)


def _of_words(words: set[str]) -> object:
    """What a text with one of the words must contain."""
    return _any([_all([w[i : i + 3] for i in range(len(w) - 2)]) for w in sorted(words)])


def _words(item) -> set[str] | None:
    """The few words an element can stand for, or None."""
    kind, value = item
    if kind is node.LITERAL:
        return {chr(value).lower()}
    if kind is node.IN:
        if any(k is not node.LITERAL for k, _ in value):
            return None
        return {chr(v).lower() for _, v in value}
    if kind is node.SUBPATTERN:
        return _sequence_words(value[3])
    if kind is node.BRANCH:
        found = [_sequence_words(b) for b in value[1]]
        return None if None in found else set().union(*found)
    if kind is node.MAX_REPEAT and value[1] == 1:
        inner = _sequence_words(value[2])
        return inner if inner is None or value[0] else inner | {""}
    return None


def _sequence_words(items) -> set[str] | None:
    words = {""}
    for item in items:
        more = _words(item)
        if more is None or len(words) * len(more) > MOST_WORDS:
            return None
        words = {a + b for a in words for b in more}
    return words


def _of_sequence(items) -> object:
    parts, words = [], {""}
    for item in items:
        more = _words(item)
        if more is not None and len(words) * len(more) <= MOST_WORDS:
            words = {a + b for a in words for b in more}
            continue
        parts.append(_of_words(words))
        words = {""}
        kind, value = item
        if kind is node.SUBPATTERN:
            parts.append(_of_sequence(value[3]))
        elif kind is node.BRANCH:
            parts.append(_any([_of_sequence(b) for b in value[1]]))
        elif kind is node.MAX_REPEAT and value[0] >= 1:
            parts.append(_of_sequence(value[2]))
    return _all([*parts, _of_words(words)])


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query of a pattern over lower-case text; True when nothing is mandatory."""
    return _of_sequence(parser.parse(pattern))


def trigrams(query: object) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set().union(*(trigrams(q) for q in query[1:])) if isinstance(query, tuple) else set()


def _holds(query: object, found: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(found, query)
    joined = Column.__and__ if query[0] == "and" else Column.__or__
    return reduce(joined, [_holds(q, found) for q in query[1:]])


# ---- index, candidates, verification ---------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("__h", F.xxhash64("text"))


def build_index(keyed: DataFrame, wanted: set[str]) -> DataFrame:
    """Postings (trigram, doc_id, __h) of the ``wanted`` trigrams, over lower-case text."""
    low = keyed.select("doc_id", "__h", F.lower("text").alias("__low"))
    found = [F.when(F.contains("__low", F.lit(t)), F.lit(t)) for t in sorted(wanted)]
    return low.select(F.explode(F.array_compact(F.array(*found))).alias("trigram"), "doc_id", "__h")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Postings intersected: the texts (doc_id, __h) that each rule has to look at, as ``kinds``."""
    found = index.groupBy("doc_id", "__h").agg(F.collect_set("trigram").alias("__t"))
    kinds = [
        F.when(_holds(trigram_query(r.pattern), F.col("__t")), F.lit(r.kind)) for r in rules
    ]
    found = found.withColumn("kinds", F.array_compact(F.array(*kinds)))
    return found.filter(F.size("kinds") > 0).drop("__t")


def _matches(rows: DataFrame, rule: Rule) -> DataFrame:
    """Every match of a rule: its place in the text's list, text before it, length and measure."""
    pattern, text = F.lit(rule.pattern), F.col("text")
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"),
    )
    found = rows.select("doc_id", "__h", F.posexplode(parts).alias("place", "m"))
    return found.filter(F.col("m.match").isNotNull()).select(
        "doc_id",
        "__h",
        F.lit(rule.kind).alias("kind"),
        "place",
        F.length("m.gap").cast("long").alias("gap"),
        F.length("m.match").cast("long").alias("size"),
        (F.length("m.part") >= rule.least).alias("good"),
    )


def _shortcut(rule: Rule) -> Rule:
    """A rule for a plain run of one class can ask for its least length in the pattern itself."""
    items = list(parser.parse(rule.pattern))
    if len(items) == 1 and items[0][0] is node.MAX_REPEAT and rule.pattern.endswith("]+") and not rule.group:
        return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least},}}", 0, rule.least, rule.base)
    return rule


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All spans of all rules: doc_id, __h, kind, start, end (code points, end exclusive)."""
    keyed = _keyed(docs)
    indexed = tuple(r for r in rules if trigram_query(r.pattern) is not True)
    wanted = set().union(*(trigrams(trigram_query(r.pattern)) for r in indexed))
    found = []
    if indexed:
        chosen = candidates(build_index(keyed, wanted), indexed).withColumnsRenamed(
            {"doc_id": "__d", "__h": "__k"}
        )
        same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__k"))
        texts = keyed.join(chosen, same).drop("__d", "__k")
        found += [_matches(texts.filter(F.array_contains("kinds", r.kind)), r) for r in indexed]
    for rule in map(_shortcut, (r for r in rules if r not in indexed)):
        found.append(_matches(keyed.filter(F.col("text").rlike(rule.pattern)), rule))
    rows = reduce(DataFrame.unionByName, found).distinct()
    # a text's matches are placed by running sums of what lies before them
    before = Window.partitionBy("doc_id", "__h", "kind").orderBy("place")
    end = F.sum(F.col("gap") + F.col("size")).over(before.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    return rows.filter("good").select("doc_id", "__h", "kind", "start", "end")


def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: counts of the base rules, a digest of their spans, and all spans."""
    order = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)]), F.col("kind"))
    label = F.concat_ws(":", "kind", "start", "end")
    span = F.struct(F.col("start"), order.alias("o"), F.col("end"), label.alias("label"))
    base = F.col("kind").isin([r.kind for r in rules if r.base])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(F.sort_array(spans), lambda s: s["label"]), ",")

    counts = {f"n_{r.kind}": F.count(F.when(F.col("kind") == r.kind, 1)) for r in rules if r.base}
    spans = (
        find_secrets(docs, rules)
        .groupBy("doc_id", "__h")
        .agg(
            *[c.alias(n) for n, c in counts.items()],
            joined(F.collect_list(F.when(base, span))).alias("__base"),
            joined(F.collect_list(span)).alias("spans"),
        )
        .withColumnsRenamed({"doc_id": "__d", "__h": "__k"})
    )
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__k"))
    rows = _keyed(docs).drop("text").join(spans, same, "left")
    return rows.select(
        "doc_id",
        *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in counts],
        F.sha2(F.coalesce("__base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def sql(table: str = "documents", rules: tuple[Rule, ...] = RULES) -> str:
    """The rows of ``scan_documents`` in SQL."""

    def found(i: int, rule: Rule) -> str:
        pattern = rule.pattern.replace("'", "''")
        return f"""
  SELECT k, {i} AS o, '{rule.kind}' AS kind, unnest(regexp_split_to_array(text, '{pattern}')) AS gap,
         unnest(regexp_extract_all(text, '{pattern}', 0)) AS match,
         unnest(regexp_extract_all(text, '{pattern}', {rule.group})) AS part,
         unnest(range(len(regexp_split_to_array(text, '{pattern}')))) AS place
  FROM keyed"""

    least = " ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in rules)
    base = ", ".join(f"'{r.kind}'" for r in rules if r.base)
    counts = ", ".join(
        f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in rules if r.base
    )
    names = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules if r.base)
    return f"""
WITH keyed AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM {table}),
found AS ({" UNION ALL ".join(found(i, r) for i, r in enumerate(rules))}),
placed AS (
  SELECT *, sum(length(gap) + length(match)) OVER (PARTITION BY k, o ORDER BY place) AS stop
  FROM found WHERE match IS NOT NULL),
spans AS (
  SELECT k, o, kind, stop - length(match) AS start,
         kind || ':' || CAST(stop - length(match) AS BIGINT) || ':' || CAST(stop AS BIGINT) AS label
  FROM placed WHERE length(part) >= CASE kind {least} END),
grouped AS (
  SELECT k, {counts},
         string_agg(label, ',' ORDER BY start, o) FILTER (WHERE kind IN ({base})) AS base,
         string_agg(label, ',' ORDER BY start, o) AS spans
  FROM spans GROUP BY k)
SELECT doc_id, {names}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM keyed LEFT JOIN grouped USING (k)
"""
