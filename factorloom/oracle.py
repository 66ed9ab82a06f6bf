"""The same results in plain SQL over the supplied tables, for side-by-side checks."""

from __future__ import annotations

from collections.abc import Sequence

FEATURES = ("open", "high", "low", "close", "volume")
NAMES = ("rank", "max", "min", "mean", "median", "std", "sum")

# ---- shared tables ---------------------------------------------------------------------------

TABLES = {
    "bars": """
        SELECT l_suppkey AS order_book_id, CAST(l_shipdate AS DATE) AS date,
               min_by(p, k) AS open, max(p) AS high, min(p) AS low, max_by(p, k) AS close,
               sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS total_turnover,
               count(*) AS num_trades,
               sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS r_volume
        FROM (SELECT *, l_extendedprice / l_quantity AS p,
                     l_orderkey * 10 + l_linenumber + l_extendedprice / l_quantity / 1e6 AS k
              FROM lineitem) t
        GROUP BY 1, 2""",
    "ticks": """
        SELECT user_id AS order_book_id, CAST(ts AS DATE) AS date, ts AS datetime,
               event_id AS seq, value AS open
        FROM events""",
    "minute_bars": """
        SELECT order_book_id, date, date_trunc('minute', datetime) AS datetime,
               min_by(open, seq) AS open, round(sum(open), 2) AS volume
        FROM ticks GROUP BY 1, 2, 3""",
    "event_bars": """
        SELECT date, order_book_id, min_by(open, seq) AS open, max(open) AS high,
               count(*) AS num_trades
        FROM ticks GROUP BY 1, 2""",
    "factor_long": """
        SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS order_book_id,
               l_returnflag AS factor_name, l_discount AS factor_value
        FROM lineitem""",
    "calendar": "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem",
    "stored": "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders",
    "fr": """
        SELECT *, (lead(open, 20) OVER (PARTITION BY order_book_id ORDER BY date) - open) / open
                  AS target_feature
        FROM bars""",
    "cleaned": """
        SELECT * FROM fr WHERE target_feature IS NOT NULL
          AND abs(target_feature) <= 10 * (SELECT stddev_samp(target_feature) FROM fr)""",
    # the same rows as "cleaned", by a join with one row
    "steady": """
        SELECT fr.* FROM fr, (SELECT 10 * stddev_samp(target_feature) AS reach FROM fr) AS spread
        WHERE target_feature IS NOT NULL AND abs(target_feature) <= reach""",
    "odd": """
        SELECT *, CASE WHEN r_volume IS NOT NULL THEN open
                       WHEN num_trades > 1 THEN 'Infinity'::DOUBLE
                       WHEN volume < 5 THEN 'NaN'::DOUBLE
                       ELSE '-Infinity'::DOUBLE END AS ratio
        FROM bars""",
    "type_ticks": """
        SELECT event_type AS order_book_id, CAST(ts AS DATE) AS date, ts AS datetime,
               event_id AS seq, value AS open
        FROM events""",
    "scored": "SELECT *, target_feature AS y, volume AS p FROM cleaned",
    "minute_fr": """
        SELECT *, (lead(open, 2) OVER (PARTITION BY order_book_id ORDER BY datetime) - open)
                  / nullif(open, 0) AS target_feature
        FROM minute_bars""",
    "minute_cleaned": """
        SELECT minute_fr.* FROM minute_fr, (SELECT 10 * stddev_samp(target_feature) AS reach FROM minute_fr) AS spread
        WHERE target_feature IS NOT NULL AND abs(target_feature) <= reach""",
    "tick_fr": """
        SELECT *, (lead(open, 20) OVER (PARTITION BY order_book_id ORDER BY datetime, seq) - open)
                  / nullif(open, 0) AS target_feature
        FROM type_ticks""",
    "tick_cleaned": """
        SELECT tick_fr.* FROM tick_fr, (SELECT 10 * stddev_samp(target_feature) AS reach FROM tick_fr) AS spread
        WHERE target_feature IS NOT NULL AND abs(target_feature) <= reach""",
}
NEEDS = {
    "minute_bars": ["ticks"],
    "event_bars": ["ticks"],
    "fr": ["bars"],
    "cleaned": ["fr"],
    "steady": ["fr"],
    "odd": ["bars"],
    "scored": ["cleaned"],
    "minute_fr": ["minute_bars"],
    "minute_cleaned": ["minute_fr"],
    "tick_fr": ["type_ticks"],
    "tick_cleaned": ["tick_fr"],
}


def _needed(names: Sequence[str]) -> list[str]:
    found: list[str] = []
    for name in names:
        for n in [*_needed(NEEDS.get(name, [])), name]:
            if n not in found:
                found.append(n)
    return found


def using(names: str, body: str, **more: str) -> str:
    """``body`` with the named shared tables, then ``more`` tables, in front."""
    parts = [f"{n} AS ({TABLES[n]})" for n in _needed(names.split())]
    parts += [f"{n} AS ({sql})" for n, sql in more.items()]
    return f"WITH {', '.join(parts)} {body}"


def rnd(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def rnds(names: Sequence[str], digits: int = 6) -> str:
    return ", ".join(rnd(n, n, digits) for n in names)


# ---- windows ---------------------------------------------------------------------------------

SERIES = "PARTITION BY order_book_id ORDER BY date"
SERIES_MINUTE = "PARTITION BY order_book_id ORDER BY datetime"
SERIES_TICK = "PARTITION BY order_book_id ORDER BY datetime, seq"


def frame(size: int) -> str:
    return f"OVER ({SERIES} ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"


def rolling(fn: str, x: str, size: int) -> str:
    over = frame(size)
    if fn == "rank":
        held = f"len(list_filter(list({x}) {over}, lambda v: v <= {x}))"
        return (
            f"CASE WHEN bool_and(coalesce({x} = 0, false)) OVER (PARTITION BY order_book_id) "
            f"OR {x} IS NULL OR count(*) {over} < 2 THEN 0.0 "
            f"ELSE ({held} - 1.0) / (count(*) {over} - 1) END"
        )
    call = {
        "max": "max({})",
        "min": "min({})",
        "mean": "avg({})",
        "median": "quantile_cont({}, 0.5)",
        "std": "stddev_pop({})",
        "sum": "sum({})",
    }[fn].format(x)
    return f"coalesce({call} {over}, 0.0)"


def momentum(x: str, size: int) -> str:
    first = f"lag({x}, {size - 1}) OVER ({SERIES})"
    return (
        f"CASE WHEN count({x}) {frame(size)} = {size} THEN ({x} - {first}) / nullif({first}, 0) END"
    )


# ---- profiles --------------------------------------------------------------------------------

MARKS = (1, 5, 10, 25, 50, 75, 90, 95, 99)


def quantile(x: str, p: float) -> str:
    return f"quantile_cont({x}, {p})"


T = "target_feature"
DESCRIBED = {
    "count": f"count({T})",
    "mean": f"avg({T})",
    "std": f"stddev_samp({T})",
    "min": f"min({T})",
    "q25": quantile(T, 0.25),
    "q50": quantile(T, 0.5),
    "q75": quantile(T, 0.75),
    "max": f"max({T})",
}
SHAPE = {"skew": f"skewness({T})", "kurt": f"kurtosis({T})"}
# undefined for few or equal values
GROUP_SHAPE = {
    "skew": f"CASE WHEN count({T}) > 2 AND min({T}) < max({T}) THEN skewness({T}) END",
    "kurt": f"CASE WHEN count({T}) > 3 AND min({T}) < max({T}) THEN kurtosis({T}) END",
}
EXTREMES = {"min": f"min({T})", "max": f"max({T})", "range": f"max({T}) - min({T})"}
SIGNS = {
    f"{name}_count": f"count(*) FILTER (WHERE {T} {op} 0)"
    for name, op in (("zero", "="), ("positive", ">"), ("negative", "<"))
}
SIGN_SHARES = {n.replace("count", "ratio"): f"{e} / count(*)" for n, e in SIGNS.items()}
DISTINCT = {"rows": "count(*)", "distinct_values": f"count(DISTINCT {T})"}
QUALITY = {
    "missing_count": f"count(*) FILTER (WHERE {T} IS NULL OR isnan({T}))",
    "infinite_count": f"count(*) FILTER (WHERE isinf({T}))",
    "quality_ok": f"count(*) FILTER (WHERE {T} IS NULL OR isnan({T}) OR isinf({T})) = 0",
}
QS = (
    f"SELECT {quantile(T, 0.25)} AS q1, {quantile(T, 0.75)} AS q3 FROM cleaned"
)
OUTSIDE = (
    f"count(*) FILTER (WHERE {T} < q1 - 1.5 * (q3 - q1) OR {T} > q3 + 1.5 * (q3 - q1))"
)
OUTLIERS = {
    "q1": "max(q1)",
    "q3": "max(q3)",
    "iqr": "max(q3 - q1)",
    "lower_bound": "max(q1 - 1.5 * (q3 - q1))",
    "upper_bound": "max(q3 + 1.5 * (q3 - q1))",
    "outlier_count": OUTSIDE,
    "outlier_ratio": f"{OUTSIDE} / count(*)",
}
WHOLE_NUMBERS = ("rows", "distinct_values")


def listed(metrics: dict[str, str], digits: int = 6) -> str:
    """Metrics as columns; counts and flags stay as they are."""
    plain = lambda n: n.endswith(("count", "_ok")) or n in WHOLE_NUMBERS
    return ", ".join(
        f'{e} AS "{n}"' if plain(n) else rnd(e, f'"{n}"', digits) for n, e in metrics.items()
    )


def profiled(metrics: dict[str, str], source: str = "cleaned") -> str:
    return using(source, f"SELECT {listed(metrics)} FROM {source}")


PERCENTILES = {f"q{m:02d}": quantile(T, m / 100) for m in MARKS}
ALL_METRICS = (
    DISTINCT
    | DESCRIBED
    | {"median": quantile(T, 0.5)}
    | SHAPE
    | EXTREMES
    | SIGNS
    | SIGN_SHARES
    | OUTLIERS
    | QUALITY
    | PERCENTILES
)
SECTIONS = {
    "basic": tuple(DESCRIBED),
    "distribution": ("mean", "median", "std", "skew", "kurt"),
    "quantiles": tuple(PERCENTILES),
    "samples": (*DISTINCT, *SIGNS, *SIGN_SHARES),
}


def report() -> str:
    parts = [
        f"SELECT '{section}' AS section, '{m}' AS metric, "
        f"{rnd(f'CAST(({ALL_METRICS[m]}) AS DOUBLE)', 'value')} FROM cleaned, qs"
        for section, metrics in SECTIONS.items()
        for m in metrics
    ]
    return using("cleaned", " UNION ALL ".join(parts), qs=QS)


def tall(rows: Sequence[str]) -> str:
    return " UNION ALL ".join(rows)


BAR_COLUMNS = (
    "order_book_id", "date", "open", "high", "low", "close", "volume", "total_turnover",
    "num_trades", "r_volume",
)


CHECKS = {
    "rows": ("count(*)", "> 0"),
    "instruments": ("count(DISTINCT order_book_id)", "> 0"),
    **{f"null_{c}": (f"count(*) - count({c})", "= 0") for c in BAR_COLUMNS},
    "price_std": ("stddev_samp(open)", ">= 1e-6"),
    "target_missing": (f"count(*) - count({T})", "= 0"),
    "target_rows": (f"count({T})", "> 0"),
    "target_std": (f"stddev_samp({T})", ">= 1e-6"),
    "target_infinite": (f"count(*) FILTER (WHERE isinf({T}))", "= 0"),
    "target_max_abs": (f"max(abs({T}))", "<= 10"),
}
USABLE = f"count({T}) > 0 AND coalesce(stddev_samp({T}) >= 1e-6, true)"


def validation(by: str = "") -> str:
    """All checks and the verdict, of the table or of each group."""
    keys, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    rows = [
        f"SELECT {keys}'{name}' AS \"check\", {rnd(f'CAST({e} AS DOUBLE)', 'value', 4)}, "
        f"coalesce(({e}) {rule}, true) AS ok FROM fr{group}"
        for name, (e, rule) in CHECKS.items()
    ]
    rows.append(f"SELECT {keys}'verdict', CAST({USABLE} AS DOUBLE), {USABLE} FROM fr{group}")
    return using("fr", tall(rows))


# ---- feature preparation ---------------------------------------------------------------------


def bounds(source: str = "cleaned", names: Sequence[str] = FEATURES) -> str:
    q = ", ".join(
        f"{quantile(c, 0.25)} AS a_{c}, {quantile(c, 0.75)} AS b_{c}" for c in names
    )
    return f"SELECT {q} FROM {source}"


def clipped(c: str) -> str:
    spread = f"1.5 * (b_{c} - a_{c})"
    return f"least(greatest({c}, a_{c} - {spread}), b_{c} + {spread})"


CLIPPED = (
    "SELECT order_book_id, date, target_feature, "
    + ", ".join(f"{clipped(c)} AS {c}" for c in FEATURES)
    + " FROM cleaned, bounds"
)
MIDDLES = "SELECT " + ", ".join(
    f"{quantile(c, 0.5)} AS m_{c}, {quantile(c, 0.75)} - {quantile(c, 0.25)} AS s_{c}"
    for c in FEATURES
) + " FROM clipped"
ROBUST = (
    "SELECT order_book_id, date, target_feature, "
    + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in FEATURES)
    + " FROM clipped, middles"
)
SPANS = "SELECT " + ", ".join(f"min({c}) AS l_{c}, max({c}) AS h_{c}" for c in FEATURES)
MINMAX = ", ".join(rnd(f"({c} - l_{c}) / (h_{c} - l_{c})", c) for c in FEATURES)
SCALED_T = f"({T} - (SELECT {quantile(T, 0.5)} FROM {{0}})) / (SELECT {quantile(T, 0.75)} - {quantile(T, 0.25)} FROM {{0}})"
FITTED = {"bounds": bounds(), "clipped": CLIPPED, "middles": MIDDLES, "scaled": ROBUST}


def share(seed: int = 42) -> str:
    text = f"concat_ws('|', '{seed}', CAST(order_book_id AS VARCHAR), CAST(date AS VARCHAR))"
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) / 4294967296.0"


# ---- scoring ---------------------------------------------------------------------------------


def ranks(v: str) -> str:
    return f"rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0"


RANKED = f"SELECT {ranks('y')} AS ry, {ranks('p')} AS rp FROM scored"
MSE = "avg((y - p) * (y - p))"
R2 = f"1 - {MSE} / var_pop(y)"

RANKED_BY = (
    "SELECT *, rank() OVER (PARTITION BY order_book_id ORDER BY y) "
    "+ (count(*) OVER (PARTITION BY order_book_id, y) - 1) / 2.0 AS ry, "
    "rank() OVER (PARTITION BY order_book_id ORDER BY p) "
    "+ (count(*) OVER (PARTITION BY order_book_id, p) - 1) / 2.0 AS rp FROM scored"
)


def one_step(
    source: str = "cleaned", columns: Sequence[str] = ("open", "volume"), order: str = SERIES
) -> str:
    """Every one-step formula of the columns, the constant -10 and three functions, with its scores."""
    constant = "-10"
    formulas = {c: (1, c) for c in columns}
    formulas |= {f"ts_mean_3({c})": (2, rolling("mean", c, 3)) for c in columns}
    for name, sign in (("safe_add", "+"), ("safe_sub", "-")):
        for a in (*columns, constant):
            for b in (*columns, constant):
                if (a, b) != (constant, constant):
                    formulas[f"{name}({a}, {b})"] = (3, f"({a}) {sign} ({b})")
    values = ", ".join(f"{e} AS e{i}" for i, (_, e) in enumerate(formulas.values()))
    rows = [
        f"SELECT '{name}' AS expression, {size} AS size, avg(({T} - e{i}) * ({T} - e{i})) AS mse, "
        f"corr({T}, e{i}) AS ic FROM vals"
        for i, (name, (size, _)) in enumerate(formulas.items())
    ]
    return using(
        source,
        f"SELECT expression, size, {rnds(('mse', 'ic'), 3)}, {rnd('mse + 0.01 * size', 'fitness', 3)} "
        f"FROM ({tall(rows)})",
        vals=f"SELECT {T}, {values.replace(SERIES, order)} FROM {source}",
    )


NESTED_IN = f"{rolling('max', 'volume', 5)} - volume"
SCORES = (
    ("open", 1, "open"),
    ("ts_mean_10(open)", 2, rolling("mean", "open", 10)),
    ("safe_div(ts_sum_5(volume), 100)", 4, f"{rolling('sum', 'volume', 5)} / 100.0"),
    ("safe_log(close)", 2, "ln(close)"),
    ("ts_mean_3(safe_sub(ts_max_5(volume), volume))", 5, rolling("mean", "dip", 3)),
    ("ts_rank_10(r_volume)", 2, rolling("rank", "r_volume", 10)),
)


def scores() -> dict[str, str]:
    values = ", ".join(f"{e} AS e{i}" for i, (_, _, e) in enumerate(SCORES))
    rows = [
        f"SELECT {i} AS id, '{name}' AS expression, {size} AS size, count(*) AS rows, "
        f"avg(({T} - e{i}) * ({T} - e{i})) AS mse, "
        f"1 - avg(({T} - e{i}) * ({T} - e{i})) / var_pop({T}) AS r2, corr({T}, e{i}) AS ic "
        "FROM vals"
        for i, (name, size, _) in enumerate(SCORES)
    ]
    return {
        "dips": f"SELECT *, {NESTED_IN} AS dip FROM cleaned",
        "vals": f"SELECT {T}, {values} FROM dips",
        "scores": tall(rows),
    }


def registry_totals() -> str:
    calls = {f"ts_{fn}_10": rolling(fn, "volume", 10) for fn in NAMES} | {
        "safe_add": "coalesce(volume + r_volume, 0.0)",
        "safe_sub": "coalesce(volume - r_volume, 0.0)",
        "safe_mul": "coalesce(volume * r_volume, 0.0)",
        "safe_div": "coalesce(volume / r_volume, 0.0)",
        "safe_log": "ln(volume)",
        "safe_sqrt": "sqrt(volume)",
        "safe_abs": "abs(volume)",
        "ts_momentum_5": momentum("volume", 5),
    }
    values = ", ".join(f"{e} AS {n}" for n, e in calls.items())
    rows = [f"SELECT '{n}' AS function, {rnd(f'sum({n})', 'total', 2)} FROM vals" for n in calls]
    return using("bars", tall(rows), vals=f"SELECT {values} FROM bars")


# ---- one statement per query -----------------------------------------------------------------

A, B = "r_volume", "(volume - 25)"
SCALARS = {
    "safe_add": f"coalesce({A} + {B}, 0.0)",
    "safe_sub": f"coalesce({A} - {B}, 0.0)",
    "safe_mul": f"coalesce({A} * {B}, 0.0)",
    "safe_div": f"coalesce({A} / nullif({B}, 0), 0.0)",
    "safe_log": f"CASE WHEN {B} > 0 THEN ln({B}) ELSE 0.0 END",
    "safe_sqrt": f"CASE WHEN {B} >= 0 THEN sqrt({B}) ELSE 0.0 END",
    "safe_abs": f"abs({B})",
    "safe_inv": f"coalesce(1.0 / nullif({B}, 0), 0.0)",
    "clip_bounds": f"CASE WHEN {A} IS NOT NULL THEN least(greatest({A}, 10.0), 30.0) END",
}


def statements() -> dict[str, str]:
    k = "order_book_id, date"
    target = f"SELECT {k}, {T} FROM"
    type_ticks = """SELECT event_type AS order_book_id, CAST(ts AS DATE) AS date, ts AS datetime,
        event_id AS seq, value AS open FROM events"""
    event_rows = using("event_bars", "SELECT * FROM event_bars")
    event_factors = """SELECT CAST(ts AS DATE) AS date, user_id AS order_book_id,
        event_type AS factor_name, value AS factor_value FROM events"""
    cast = """SELECT CAST(order_book_id AS VARCHAR) AS order_book_id, date, open,
        CAST(volume AS BIGINT) AS volume, CAST(num_trades AS INTEGER) AS num_trades"""
    rest = "high, low, close, total_turnover, r_volume"
    members = """SELECT b.date, concat('R', CAST(n.n_regionkey AS VARCHAR)) AS index_code,
        b.order_book_id FROM bars b JOIN supplier s ON b.order_book_id = s.s_suppkey
        JOIN nation n ON s.s_nationkey = n.n_nationkey"""
    event_members = """SELECT DISTINCT CAST(e.ts AS DATE) AS date,
        concat('R', CAST(n.n_regionkey AS VARCHAR)) AS index_code, e.user_id AS order_book_id
        FROM events e JOIN customer c ON e.user_id = c.c_custkey
        JOIN nation n ON c.c_nationkey = n.n_nationkey"""
    wide = """SELECT date, order_book_id,
        round(avg(factor_value) FILTER (WHERE factor_name = 'A'), 6) AS "A",
        round(avg(factor_value) FILTER (WHERE factor_name = 'N'), 6) AS "N",
        round(avg(factor_value) FILTER (WHERE factor_name = 'R'), 6) AS "R"
        FROM factor_long GROUP BY 1, 2"""
    span = "date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"
    due = "date <= (SELECT max(date) FROM calendar)"
    quality = [
        f"SELECT '{c}' AS \"column\", "
        f"{rnd(f'100.0 * (count(*) - count({c})) / count(*)', 'missing_pct', 4)}, "
        f"{rnd(f'100.0 * count(*) FILTER (WHERE {c} = 0) / count(*)', 'zero_pct', 4)}, "
        f"{rnd(f'stddev_samp({c})', 'std', 4)} FROM bars"
        for c in (*FEATURES, "r_volume")
    ]
    nulls = [
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, "
        f"{rnd(f'100.0 * (count(*) - count({c})) / count(*)', 'percent')} FROM fr"
        for c in (*BAR_COLUMNS, T)
    ]
    flags = [
        f"SELECT '{c}' AS \"column\", {rnd(f'stddev_samp({e})', 'std', 4)}, "
        f"stddev_samp({e}) < 1e-6 AS low_variance FROM bars"
        for c, e in (("open", "open"), ("volume", "volume"), ("steady", "2.5"))
    ]
    by_volume = listed(
        {n: e.replace(T, "volume") for n, e in DESCRIBED.items()}
    )
    summary = (
        f"{rnd(MSE, 'mse', 4)}, {rnd(R2, 'r2', 4)}, {rnd('corr(y, p)', 'correlation', 4)}, "
        f"{rnd('corr(y, p)', 'ic', 4)}, {rnd('(SELECT corr(ry, rp) FROM ranked)', 'rank_ic', 4)}"
    )
    example = (
        f"{rolling('mean', 'open', 5)} * CASE WHEN {rolling('std', 'volume', 10)} > 0 "
        f"THEN ln({rolling('std', 'volume', 10)}) ELSE 0.0 END + {rolling('rank', 'r_volume', 3)}"
    )
    sets = {
        "v_add": SCALARS["safe_add"],
        "v_sub": SCALARS["safe_sub"],
        "v_mul": SCALARS["safe_mul"],
        "v_div": SCALARS["safe_div"],
        "v_log": SCALARS["safe_log"],
        "v_sqrt": SCALARS["safe_sqrt"],
        "v_abs": SCALARS["safe_abs"],
    }
    fitness = "mse + 0.01 * size"
    filled = f"""coalesce(
        last_value(r_volume IGNORE NULLS) OVER ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(r_volume IGNORE NULLS) OVER ({SERIES} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
        0.0)"""
    close10 = (
        "avg(close) OVER (PARTITION BY order_book_id ORDER BY date "
        "ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
    )
    out = {
        "scan_bars": event_rows,
        "scan_factors": event_factors,
        "date_range_padded": using(
            "bars", "SELECT * FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-01-20'"
        ),
        "date_range": using("factor_long", f"SELECT * FROM factor_long WHERE {span}"),
        "write_partitioned": event_rows,
        "write_partitioned_stock": type_ticks,
        "write_partitioned_index": event_members,
        "write_partitioned_factor": event_factors,
        "write_unpartitioned": using("calendar", "SELECT * FROM calendar"),
        "write_factor_values": using("steady", f"SELECT {k}, {T} AS factor_value FROM steady"),
        "write_profile_report": report(),
        "cast_schema": using("bars", f"{cast} FROM bars"),
        "order_columns": using("bars", "SELECT * FROM bars"),
        "canonical_sort": using("bars", members),
        "format_table": using("bars", f"{cast}, {rest} FROM bars"),
        "value_fields": using("bars", "SELECT open, volume, num_trades FROM bars"),
        "select_features": using("fr", "SELECT open, high, low, close, volume, r_volume FROM fr"),
        "drop_null_target": using("fr", f"{target} fr WHERE {T} IS NOT NULL"),
        "inf_to_null": using(
            "odd",
            f"SELECT {k}, CASE WHEN isnan(ratio) OR isinf(ratio) THEN NULL ELSE ratio END AS ratio,"
            " open, r_volume FROM odd",
        ),
        "sigma_outlier_filter": using("steady", f"{target} steady"),
        "sigma_outlier_filter_narrow": using(
            "fr", f"{target} fr, spread WHERE abs({T}) <= reach", spread=f"SELECT 2 * stddev_samp({T}) AS reach FROM fr"
        ),
        "drop_any_null": using(
            "fr",
            f"SELECT {k}, open, r_volume, {T} FROM fr "
            f"WHERE open IS NOT NULL AND r_volume IS NOT NULL AND {T} IS NOT NULL",
        ),
        "drop_null_target_scaled": using(
            "fr",
            f"SELECT {k}, open, {rnd(SCALED_T.format('fr'), T)} FROM fr "
            f"WHERE {T} IS NOT NULL",
        ),
        "drop_incomplete_day": using(
            "ticks",
            "SELECT * FROM west WHERE date < (SELECT max(date) FROM west)",
            west="""SELECT order_book_id,
                CAST(date_trunc('minute', datetime - INTERVAL 10 HOUR) AS DATE) AS date,
                date_trunc('minute', datetime - INTERVAL 10 HOUR) AS datetime,
                min_by(open, seq) AS open, round(sum(open), 2) AS volume
                FROM ticks GROUP BY 1, 2, 3""",
        ),
        "drop_incomplete_day_full": using("minute_bars", "SELECT * FROM minute_bars"),
        "describe_table": using(
            "bars",
            """SELECT 'rows' AS section, '' AS name, CAST(count(*) AS VARCHAR) AS value FROM bars
            UNION ALL VALUES ('column', 'order_book_id', 'bigint'), ('column', 'date', 'date'),
                             ('column', 'num_trades', 'bigint')
            UNION ALL SELECT 'head', '', concat('{"order_book_id":', order_book_id, ',"date":"',
                CAST(date AS VARCHAR), '","num_trades":', num_trades, '}')
            FROM (SELECT * FROM bars ORDER BY date, order_book_id LIMIT 5)""",
        ),
        "pivot_factors": using("factor_long", wide),
        "attach_factors": using(
            "bars factor_long",
            f"SELECT {k}, open, volume, \"A\", \"N\", \"R\" "
            "FROM bars LEFT JOIN wide USING (order_book_id, date)",
            wide=wide,
        ),
        "existing_dates": using("bars", "SELECT DISTINCT date FROM bars"),
        "trading_dates": using("calendar", f"SELECT date FROM calendar WHERE {span}"),
        "missing_dates": using(
            "calendar stored",
            f"SELECT date FROM calendar WHERE {due} AND date NOT IN (SELECT date FROM stored) "
            "AND date >= (SELECT min(date) FROM stored)",
        ),
        "missing_dates_global": using(
            "calendar stored",
            f"SELECT date FROM calendar WHERE {due} AND date NOT IN (SELECT date FROM stored)",
        ),
        "new_dates": using(
            "calendar stored",
            f"SELECT date FROM calendar WHERE {due} AND date > (SELECT max(date) FROM stored)",
        ),
        "score_with_keys": using(
            "cleaned", f"SELECT {k}, {rnd(close10, 'factor_value', 5)} FROM scaled", **FITTED
        ),
        "fetch_range": using(
            "event_bars",
            "SELECT * FROM event_bars WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'",
        ),
        "refresh_full": event_rows,
        "refresh_missing": event_rows,
        "refresh_latest": event_rows,
        "forward_return": using("fr", f"SELECT {k}, open, {T} FROM fr"),
        "forward_return_minute": using(
            "minute_bars",
            f"""SELECT order_book_id, datetime, open, (lead(open, 2) OVER w - open) / nullif(open, 0) AS {T}
            FROM minute_bars WINDOW w AS (PARTITION BY order_book_id ORDER BY datetime)""",
        ),
        "forward_return_ticks": using(
            "type_ticks",
            f"""SELECT order_book_id, datetime, seq, open,
            (lead(open, 20) OVER w - open) / nullif(open, 0) AS {T}
            FROM type_ticks WINDOW w AS (PARTITION BY order_book_id ORDER BY datetime, seq)""",
        ),
        "ts_rank_ticks": using(
            "type_ticks",
            f"SELECT order_book_id, datetime, seq, "
            f"{rnd(rolling('rank', 'open', 10).replace(SERIES, SERIES_TICK), 'rank')} FROM type_ticks",
        ),
        "degenerate_guard": using(
            "bars",
            f"SELECT {k}, x, {rnd(rolling('rank', 'x', 10), 'ts_rank_10')}, "
            f"{rnd(rolling('max', 'x', 10), 'ts_max_10')} FROM idle",
            idle=f"SELECT {k}, CASE WHEN order_book_id < 30 THEN 0.0 ELSE volume END AS x FROM bars",
        ),
        "ts_family_windows": using(
            "bars",
            f"SELECT {k}, volume, "
            + ", ".join(
                rnd(rolling(fn, "volume", n), f"ts_{fn}_{n}", 4) for n in (3, 5, 10, 20) for fn in NAMES
            )
            + " FROM bars",
        ),
        "ts_momentum": using(
            "bars",
            f"SELECT {k}, open, {momentum('open', 3)} AS open_3, {momentum('open', 10)} AS open_10, "
            f"{momentum('r_volume', 3)} AS ts_momentum_3 FROM bars",
        ),
        "fill_gaps": using("bars", f"SELECT {k}, {filled} AS r_volume, volume FROM bars"),
        "nan_to_num": using(
            "odd",
            f"SELECT {k}, CASE WHEN isnan(ratio) OR isinf(ratio) THEN 0.0 ELSE ratio END AS value FROM odd",
        ),
        "std_function_set": using(
            "bars", f"SELECT {k}, {', '.join(rnd(e, n) for n, e in sets.items())} FROM bars"
        ),
        "describe_column": profiled(DESCRIBED),
        "describe_column_by": using(
            "bars", f"SELECT order_book_id, {by_volume} FROM bars GROUP BY 1"
        ),
        "quantiles": profiled(PERCENTILES),
        "quantiles_by": using(
            "bars",
            "SELECT order_book_id, "
            + ", ".join(rnd(quantile("open", p), n, 9) for n, p in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9)))
            + " FROM bars GROUP BY 1",
        ),
        "center_spread": profiled(
            {"mean": f"avg({T})", "median": quantile(T, 0.5), "std": f"stddev_samp({T})"}
        ),
        "skew_sample": profiled({"skew": SHAPE["skew"]}),
        "kurt_sample": profiled({"kurt": SHAPE["kurt"]}),
        "extremes": profiled(EXTREMES),
        "sign_counts": profiled(SIGNS | SIGN_SHARES, "fr"),
        "iqr_outliers": using("cleaned", f"SELECT {listed(OUTLIERS)} FROM cleaned, qs", qs=QS),
        "iqr_outliers_by": using(
            "bars",
            "SELECT order_book_id, "
            + listed({n: e.replace(T, "volume") for n, e in OUTLIERS.items()})
            + " FROM bars JOIN qs USING (order_book_id) GROUP BY 1",
            qs=f"SELECT order_book_id, {quantile('volume', 0.25)} AS q1, "
            f"{quantile('volume', 0.75)} AS q3 FROM bars GROUP BY 1",
        ),
        "missing_inf_counts": using(
            "odd", f"SELECT {listed({n: e.replace(T, 'ratio') for n, e in QUALITY.items()})} FROM odd"
        ),
        "row_and_distinct": profiled(DISTINCT, "fr"),
        "profile_target": using("cleaned", f"SELECT {listed(ALL_METRICS)} FROM cleaned, qs", qs=QS),
        "null_profile": using("fr", f"SELECT * FROM ({tall(nulls)}) WHERE nulls > 0"),
        "table_extent": using(
            "bars",
            "SELECT min(date) AS first_date, max(date) AS last_date, "
            "count(DISTINCT order_book_id) AS instruments, count(*) AS rows FROM bars",
        ),
        "feature_quality": using("bars", tall(quality)),
        "low_variance_flag": using("bars", tall(flags)),
        "extreme_flag": using(
            "cleaned",
            f"SELECT {rnd(f'max(abs({T}))', 'max_abs')}, max(abs({T})) > 10 AS extreme FROM cleaned",
        ),
        "target_missing_rate": using(
            "fr",
            f"SELECT count(*) - count({T}) AS missing_count, "
            f"{rnd(f'100.0 * (count(*) - count({T})) / count(*)', 'missing_pct')}, "
            f"count({T}) AS rows_after FROM fr",
        ),
        "validate_bars": validation(),
        "profile_target_by": using(
            "cleaned",
            "SELECT num_trades, "
            + listed(ALL_METRICS | GROUP_SHAPE)
            + " FROM cleaned JOIN qs USING (num_trades) GROUP BY 1",
            qs=f"SELECT num_trades, {quantile(T, 0.25)} AS q1, {quantile(T, 0.75)} AS q3 "
            "FROM cleaned GROUP BY 1",
        ),
        "null_profile_by": using(
            "fr",
            "SELECT * FROM ("
            + tall([
                f"SELECT order_book_id, '{c}' AS \"column\", count(*) - count({c}) AS nulls, "
                f"{rnd(f'100.0 * (count(*) - count({c})) / count(*)', 'percent')} FROM fr GROUP BY 1"
                for c in ("open", "r_volume", T)
            ])
            + ") WHERE nulls > 0",
        ),
        "feature_quality_by": using(
            "bars",
            tall([
                f"SELECT order_book_id, '{c}' AS \"column\", "
                f"{rnd(f'100.0 * (count(*) - count({c})) / count(*)', 'missing_pct', 4)}, "
                f"{rnd(f'100.0 * count(*) FILTER (WHERE {c} = 0) / count(*)', 'zero_pct', 4)}, "
                f"{rnd(f'stddev_samp({c})', 'std', 4)} FROM bars GROUP BY 1"
                for c in ("volume", "r_volume")
            ]),
        ),
        "low_variance_flag_by": using(
            "bars",
            tall([
                f"SELECT order_book_id, '{c}' AS \"column\", {rnd(f'stddev_samp({c})', 'std', 4)}, "
                f"coalesce(stddev_samp({c}) < 1e-6, false) AS low_variance FROM bars GROUP BY 1"
                for c in ("open", "volume")
            ]),
        ),
        "validate_bars_by": validation("order_book_id"),
        "drop_low_variance": using("steady", f"SELECT {k}, {rnds(FEATURES, 9)} FROM steady"),
        "iqr_clip": using(
            "cleaned",
            f"SELECT {k}, {', '.join(rnd(clipped(c), c, 9) for c in FEATURES)} FROM cleaned, bounds",
            bounds=bounds(),
        ),
        "robust_scale": using("cleaned", f"SELECT {k}, {rnds(FEATURES)} FROM scaled", **FITTED),
        "minmax_scale": using(
            "cleaned",
            f"SELECT {k}, {MINMAX} FROM cleaned, spans",
            spans=f"{SPANS} FROM cleaned",
        ),
        "scale_target": using(
            "cleaned", f"SELECT {k}, {rnd(SCALED_T.format('cleaned'), T)} FROM cleaned"
        ),
        "prepare_features": using(
            "cleaned",
            f"SELECT {k}, {rnds(FEATURES)}, {rnd(SCALED_T.format('cleaned'), T)} FROM scaled",
            **FITTED,
        ),
        "prepare_features_minmax": using(
            "cleaned",
            f"SELECT {k}, {MINMAX} FROM clipped, spans",
            bounds=bounds(),
            clipped=CLIPPED,
            spans=f"{SPANS} FROM clipped",
        ),
        "train_valid_split": using(
            "bars",
            f"SELECT {k}, CASE WHEN {share()} < 0.2 THEN 'valid' ELSE 'train' END AS part FROM bars",
        ),
        "sample_rows": using("bars", f"SELECT {k} FROM bars WHERE {share()} < 0.9"),
        "eval_expression": using(
            "bars",
            f"SELECT {k}, {rnd(example, 'example', 4)}, {rnd(rolling('mean', 'dip', 3), 'nested', 4)} "
            "FROM dips",
            dips=f"SELECT *, {NESTED_IN} AS dip FROM bars",
        ),
        "function_registry": registry_totals(),
        "mse": using("scored", f"SELECT {rnd(MSE, 'mse', 4)} FROM scored"),
        "r2": using("scored", f"SELECT {rnd(R2, 'r2')} FROM scored"),
        "ic": using("scored", f"SELECT {rnd('corr(y, p)', 'ic')} FROM scored"),
        "rank_ic": using(
            "scored", f"SELECT {rnd('corr(ry, rp)', 'rank_ic')} FROM ranked", ranked=RANKED
        ),
        "score_summary": using("scored", f"SELECT {summary} FROM scored", ranked=RANKED),
        "rank_ic_by": using(
            "scored",
            f"SELECT order_book_id, {rnd('corr(ry, rp)', 'rank_ic')} FROM ranked GROUP BY 1",
            ranked=RANKED_BY,
        ),
        "score_summary_by": using(
            "scored",
            f"SELECT order_book_id, {rnd(MSE, 'mse', 4)}, {rnd(R2, 'r2', 4)}, "
            f"{rnd('corr(y, p)', 'correlation', 4)}, {rnd('corr(y, p)', 'ic', 4)}, "
            f"{rnd('corr(ry, rp)', 'rank_ic', 4)} FROM ranked GROUP BY 1",
            ranked=RANKED_BY,
        ),
        "rank_expressions_ic": using(
            "cleaned",
            f"SELECT id, expression, size, rows, {rnds(('mse', 'r2', 'ic'), 4)}, "
            f"{rnd('-abs(ic)', 'fitness', 4)} FROM scores ORDER BY -abs(ic), id LIMIT 3",
            **scores(),
        ),
        "rank_expressions_missing": using(
            "cleaned",
            f"SELECT expression, size, rows, {rnds(('mse', 'r2', 'ic'), 4)}, {rnd('mse', 'fitness', 4)} "
            "FROM scores WHERE rows >= 0.5 * (SELECT max(rows) FROM scores)",
            vals=f"SELECT {T}, {momentum('open', 400)} AS e0, {momentum('open', 3)} AS e1, open AS e2, "
            "volume AS e3 FROM cleaned",
            scores=tall([
                f"SELECT '{name}' AS expression, {size} AS size, count(e{i}) AS rows, "
                f"avg(({T} - e{i}) * ({T} - e{i})) AS mse, "
                f"1 - avg(({T} - e{i}) * ({T} - e{i})) / (var_pop({T}) FILTER (WHERE e{i} IS NOT NULL)) AS r2, "
                f"corr({T}, e{i}) AS ic FROM vals"
                for i, (name, size) in enumerate((
                    ("ts_momentum_400(open)", 2), ("ts_momentum_3(open)", 2), ("open", 1), ("volume", 1),
                ))
            ]),
        ),
        "search_one_step": one_step(),
        "search_minutes": one_step("minute_cleaned", order=SERIES_MINUTE),
        "search_ticks": one_step("tick_cleaned", ["open"], SERIES_TICK),
        "score_expressions": using(
            "cleaned",
            f"SELECT id, expression, size, rows, {rnds(('mse', 'r2', 'ic'), 4)} FROM scores",
            **scores(),
        ),
        "rank_expressions": using(
            "cleaned",
            f"SELECT id, expression, size, rows, {rnds(('mse', 'r2', 'ic'), 4)}, "
            f"{rnd(fitness, 'fitness', 4)} FROM scores ORDER BY {fitness}, id LIMIT 3",
            **scores(),
        ),
        "seed_expressions": using(
            "cleaned",
            f"SELECT expression, size, {rnds(('mse', 'ic'), 4)}, {rnd(fitness, 'fitness', 4)} FROM scores",
            **scores(),
        ),
    }
    fit = f"SELECT *, {SCALED_T.format('cleaned')} AS y FROM scaled"
    feature_scores = tall(
        [f"SELECT '{c}' AS name, avg((y - {c}) * (y - {c})) AS mse FROM fit" for c in FEATURES]
    )
    chosen = " ".join(f"WHEN '{c}' THEN {c}" for c in FEATURES)
    out["train_final"] = using(
        "cleaned",
        f"SELECT {k}, {rnd(f'CASE name {chosen} END', 'factor_value')} FROM fit, best",
        **FITTED,
        fit=fit,
        tried=feature_scores,
        best="SELECT name FROM tried ORDER BY mse, name LIMIT 1",
    )
    out["write_factor_meta"] = using(
        "cleaned",
        "SELECT 'ts_mean_10(close)' AS expression, count(*) AS rows, 5 AS features, "
        f"{rnd(R2, 'score')}, {rnd('corr(y, p)', 'correlation')}, {rnd(R2, 'r2')} FROM valued",
        **FITTED,
        fit=fit,
        valued=f"SELECT y, {close10} AS p FROM fit",
    )
    for fn in NAMES:
        x = "open" if fn in ("rank", "max", "min") else "volume"
        pair = [(rolling(fn, c, 10), f"on_{c}") for c in (x, "r_volume")]
        exact = fn in ("max", "min")
        shown = ", ".join(f"{e} AS {n}" if exact else rnd(e, n, 4) for e, n in pair)
        out[f"ts_{fn}"] = using("bars", f"SELECT {k}, {shown} FROM bars")
    # tables stored alike give what a pivot and a join give
    out["stored_pivot_factors"] = out["pivot_factors"]
    out["stored_attach_factors"] = out["attach_factors"]
    # a profile merged from periods is that of the whole table
    out["kept_profile"] = out["profile_target"]
    out["kept_null_profile"] = out["null_profile"]
    out["kept_feature_quality"] = out["feature_quality"]
    for name, expr in SCALARS.items():
        out[name] = using("bars", f"SELECT {k}, {rnd(expr, 'value')} FROM bars")
    return out
