"""DuckDB SQL that gives the same rows as the registered queries, assembled from shared common table expressions."""

from __future__ import annotations

from driftglass.operators.features import OTHER_STALE_DAYS, Feature, default_spec
from driftglass.operators.quality import MESSAGES

ALTS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")
DAY = "strftime(ts, '%Y-%m-%d') AS day"
AT = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS at"


def without_negative_zero(select: str) -> str:
    """Add 0.0 to every rounded value: DuckDB rounds small negative numbers to -0.0, Spark to 0.0."""
    out, at = [], 0
    while (start := select.find("round(", at)) >= 0:
        depth, end = 1, start + len("round(")
        while depth:
            depth += {"(": 1, ")": -1}.get(select[end], 0)
            end += 1
        inner = select[start + len("round(") : end - 1]
        out += [select[at:start], f"(round({without_negative_zero(inner)}) + 0.0)"]
        at = end
    return "".join([*out, select[at:]])


def _ohlcv(symbol: str) -> str:
    return (
        f"SELECT {symbol} AS symbol, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, "
        "min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2"
    )


BARS = f"bars AS ({_ohlcv('o_orderpriority')})"
CAL = f"cal AS ({_ohlcv(chr(39) + 'ALL' + chr(39))})"
FUNDING = (
    "funding AS (SELECT l_linestatus AS symbol, CAST(l_shipdate AS TIMESTAMP) + INTERVAL 1 HOUR * (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 8 ELSE 16 END) AS ts, "
    "avg(l_discount - l_tax) AS close FROM lineitem GROUP BY 1, 2)"
)
CONTEXT = (
    "levels AS (SELECT CAST(l_shipdate AS TIMESTAMP) + INTERVAL 14 HOUR + INTERVAL 30 MINUTE AS ts, avg(l_extendedprice) AS a, avg(l_quantity) AS b, avg(l_discount) AS c FROM lineitem GROUP BY 1), "
    "context AS (SELECT 'DXY' AS symbol, ts, a AS close FROM levels UNION ALL SELECT 'VIX', ts, b FROM levels UNION ALL SELECT 'US10Y', ts, c FROM levels)"
)


def with_bars(select: str) -> str:
    return f"WITH {BARS}, {CAL} " + select.replace("{day}", DAY).replace("{at}", AT)


def with_series(select: str) -> str:
    return f"WITH {BARS}, {CAL}, {FUNDING}, {CONTEXT} " + select.replace("{day}", DAY).replace("{at}", AT)


OHLCV_HOURLY = (
    "SELECT event_type AS symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS at, round(arg_min(value, (ts, event_id)), 6) AS open, round(max(value), 6) AS high, "
    "round(min(value), 6) AS low, round(arg_max(value, (ts, event_id)), 6) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY event_type, date_trunc('hour', ts)"
)


def over(n: int, part: str = "symbol") -> str:
    by = f"PARTITION BY {part} " if part else ""
    return f"OVER ({by}ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def sma(v: str, n: int, part: str = "symbol") -> str:
    return f"CASE WHEN count({v}) {over(n, part)} = {n} THEN avg({v}) {over(n, part)} END"


def std(v: str, n: int, part: str = "symbol") -> str:
    return f"CASE WHEN count({v}) {over(n, part)} = {n} THEN stddev_pop({v}) {over(n, part)} END"


def log_return(v: str, n: int) -> str:
    ratio = f"{v} / nullif(lag({v}, {n}) OVER w, 0)"
    return f"CASE WHEN {ratio} > 0 THEN ln({ratio}) END"


def expanding_z(v: str, least: int, part: str = "symbol") -> str:
    by = f"PARTITION BY {part} " if part else ""
    o = f"OVER ({by}ORDER BY ts ROWS UNBOUNDED PRECEDING)"
    return f"CASE WHEN count({v}) {o} >= {least} AND stddev_pop({v}) {o} > 0 THEN ({v} - avg({v}) {o}) / stddev_pop({v}) {o} END"


WINDOW = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


def stack(rel: str, expression: str, *inner: str, window: str = WINDOW, keep: str = "*", name: str = "v") -> str:
    """A select over ``rel`` whose inner columns are computed one level below each other."""
    for x in inner:
        rel = f"(SELECT *, {x} FROM {rel} {window})"
    return f"SELECT {keep}, {expression} AS {name} FROM {rel} {window}"


def indicator(expression: str, *inner: str) -> str:
    return with_bars(f"SELECT symbol, {{day}}, round(v, 6) AS v FROM ({stack('bars', expression, *inner)})")


#: Events as series: the place in the series stands for the time.
TICKS = "ticks AS (SELECT event_type AS symbol, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS ts, event_id, value AS close FROM events)"


def _ticks(columns: dict[str, str], *inner: str) -> str:
    rel = "ticks"
    for x in inner:
        rel = f"(SELECT *, {x} FROM {rel} {WINDOW})"
    return f"WITH {TICKS} SELECT symbol, event_id, {', '.join(f'round({e}, 6) AS {n}' for n, e in columns.items())} FROM {rel} {WINDOW}"


TICK_INDICATORS = _ticks(
    {"sma_20": "a", "std_20": "b", "vol_21": "c * sqrt(365)", "ratio_21_90": "CASE WHEN e > 0 THEN c / e END", "pct_200": "(close - f) / nullif(f, 0)", "return_63": log_return("close", 63), "diff_63": "close - lag(close, 63) OVER w",
     "z_90": "CASE WHEN h > 0 THEN (close - g) / h END", "return_1": "close / nullif(lag(close) OVER w, 0) - 1"},
    f"{log_return('close', 1)} AS r", f"{sma('close', 20)} AS a, {std('close', 20)} AS b, {std('r', 21)} AS c, {std('r', 90)} AS e, {sma('close', 200)} AS f, {sma('close', 90)} AS g, {std('close', 90)} AS h",
)
TICK_FORWARD = _ticks({f"fwd_{h}": f"lead(close, {h}) OVER w / nullif(close, 0) - 1" for h in (1, 3, 7, 21)})
TICK_FLAGS = (
    f"WITH o AS (SELECT event_type AS symbol, event_id, ts, lag(ts) OVER v AS before, value / nullif(lag(value) OVER v, 0) AS ratio FROM events WINDOW v AS (PARTITION BY event_type ORDER BY event_id)) "
    "SELECT symbol, event_id, coalesce(ts = before, FALSE) AS duplicate, coalesce(ts < before, FALSE) AS unsorted, round(CASE WHEN ratio > 0 THEN ln(ratio) END, 6) AS r FROM o"
)
_SO_FAR = "OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"
TICK_RUNNING = (
    f"WITH {TICKS} SELECT symbol, event_id, CAST(count(close) {_SO_FAR} AS BIGINT) AS n, round(stddev_pop(close) {_SO_FAR}, 6) AS deviation, round({expanding_z('close', 180)}, 6) AS z_180, "
    f"round(close / nullif(max(close) {_SO_FAR}, 0) - 1, 6) AS drawdown FROM ticks"
)


def aged(max_days: int, hit: str = "s.ts", row: str = "c.ts") -> str:
    return f"floor((epoch({row}) - epoch({hit})) / 86400) <= {max_days}"


REL_STRENGTH = with_bars(
    f"SELECT symbol, {{day}}, round(a - b, 6) AS v FROM (SELECT symbol, ts, {log_return('close', 63)} AS a, {log_return('vs', 63)} AS b FROM "
    f"(SELECT c.symbol, c.ts, c.close, CASE WHEN {aged(5)} THEN s.close END AS vs FROM bars c ASOF LEFT JOIN cal s ON c.ts >= s.ts WHERE c.symbol IN {ALTS}) {WINDOW})"
)

ASOF_STALENESS = with_bars(
    f"SELECT symbol, {{day}}, round(CASE WHEN {aged(2, 'hit', 'ts')} THEN value END, 6) AS within_2d, round(CASE WHEN {aged(5, 'hit', 'ts')} THEN value END, 6) AS within_5d FROM "
    "(SELECT c.symbol, c.ts, s.ts AS hit, s.close AS value FROM (SELECT cal.ts, k.symbol FROM cal CROSS JOIN (SELECT DISTINCT symbol FROM bars) k) c ASOF LEFT JOIN bars s ON c.symbol = s.symbol AND c.ts >= s.ts)"
)

DOWNSAMPLE = with_bars(
    "SELECT symbol, {day}, round(close,6) AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars) x "
    "WHERE n <= 100 OR i IN (SELECT (j * (x.n - 1)) // 99 FROM range(100) t(j))"
)

CALENDAR_SYNC = with_bars(
    "SELECT CAST(pos AS BIGINT) AS pos, strftime(a.ts, '%Y-%m-%d') AS calendar_day, strftime(b.ts, '%Y-%m-%d') AS symbol_day FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS pos FROM cal) a "
    "FULL JOIN (SELECT ts, row_number() OVER (ORDER BY ts) AS pos FROM bars WHERE symbol = '2-HIGH') b USING (pos) WHERE a.ts IS DISTINCT FROM b.ts"
)

# --- quality ---------------------------------------------------------------------------------------------------

BROKEN = (
    f"{BARS}, b0 AS (SELECT *, dayofyear(ts) AS k, row_number() OVER (PARTITION BY symbol ORDER BY ts) * 2 AS seq FROM bars), "
    "b1 AS (SELECT symbol, ts, open, CASE WHEN symbol = '3-MEDIUM' AND k % 83 = 0 THEN low - 1 ELSE high END AS high, low, "
    "CASE WHEN symbol = '1-URGENT' AND k % 97 = 0 THEN CAST('nan' AS DOUBLE) WHEN symbol = '2-HIGH' AND k % 89 = 0 THEN -close ELSE close END AS close, "
    "CASE WHEN symbol = '3-MEDIUM' AND k % 101 = 0 THEN -volume ELSE volume END AS volume, k, seq FROM b0), "
    "broken AS (SELECT * FROM b1 UNION ALL SELECT symbol, ts, open, high, low, close, volume, k, seq + 1 FROM b1 WHERE symbol = '5-LOW' AND k % 79 = 0)"
)
FINITE = "(isfinite(open) AND isfinite(high) AND isfinite(low) AND isfinite(close))"
BAD_RANGE = "(low > least(open, close) OR high < greatest(open, close) OR high < low)"
COHERENT = f"WITH {BROKEN} SELECT symbol, {DAY}, round(close,6) AS close, volume FROM broken WHERE {FINITE} AND NOT {BAD_RANGE} AND volume >= 0"
CHECKS = ("duplicate_timestamps", "unsorted", "non_finite_close", "non_positive_price", "ohlc_violation", "negative_volume")
_REASON = "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} > 0 THEN '{c}(' || {0 if c == 'unsorted' else c} || ')' END" for c in CHECKS) + ")"
VERDICT = (
    f"{BROKEN}, f0 AS (SELECT *, lag(ts) OVER w AS before, CASE WHEN isfinite(close) THEN close END AS c0 FROM broken WINDOW w AS (PARTITION BY symbol ORDER BY seq)), "
    "f1 AS (SELECT *, c0 / nullif(lag(c0) OVER w, 0) AS ratio FROM f0 WINDOW w AS (PARTITION BY symbol ORDER BY seq)), "
    "f2 AS (SELECT *, CASE WHEN ratio > 0 THEN ln(ratio) END AS r FROM f1), "
    "ce AS (SELECT symbol, quantile_cont(r, 0.5) AS centre, stddev_pop(r) AS sd, count(r) AS n_r FROM f2 GROUP BY 1), "
    "md AS (SELECT symbol, quantile_cont(abs(r - centre), 0.5) AS mad FROM f2 JOIN ce USING (symbol) GROUP BY 1), "
    "f3 AS (SELECT *, CASE WHEN mad > 0 THEN mad * 1.4826 ELSE sd END AS sigma FROM f2 JOIN ce USING (symbol) JOIN md USING (symbol)), "
    "v0 AS (SELECT symbol, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (ts = before) AS BIGINT) AS duplicate_timestamps, CAST(count(*) FILTER (ts < before) AS BIGINT) AS unsorted, "
    "CAST(count(*) FILTER (NOT isfinite(close)) AS BIGINT) AS non_finite_close, CAST(count(*) FILTER (isfinite(close) AND close <= 0) AS BIGINT) AS non_positive_price, "
    f"CAST(count(*) FILTER ({FINITE} AND {BAD_RANGE}) AS BIGINT) AS ohlc_violation, CAST(count(*) FILTER (volume < 0) AS BIGINT) AS negative_volume, "
    "CAST(count(*) FILTER (n_r > 30 AND sigma > 0 AND abs(r) > 12 * sigma) AS BIGINT) AS extreme_move, max(sigma) AS sigma, "
    "max(n_r) AS n_r, CAST(count(*) FILTER (abs(r) < 1e-12) AS BIGINT) AS still, count(*) FILTER (abs(r) < 1e-12) / nullif(count(before), 0) AS flat_share FROM f3 GROUP BY 1), "
    f"verdict AS (SELECT *, CAST(CASE WHEN n_r > 30 AND flat_share > 0.30 THEN 1 ELSE 0 END AS BIGINT) AS stale_series, ({' AND '.join(f'{c} = 0' for c in CHECKS)}) AS passed, {_REASON} AS reason FROM v0)"
)
QUALITY_REPORT = f"WITH {VERDICT} SELECT symbol, n_rows, {', '.join(CHECKS)}, extreme_move, stale_series, round(sigma,6) AS sigma, round(flat_share,6) AS flat_share, passed, reason FROM verdict"
QUARANTINE = f"WITH {VERDICT} SELECT symbol, CAST(count(*) AS BIGINT) AS n_rows, round(sum(volume),6) AS volume FROM broken WHERE symbol IN (SELECT symbol FROM verdict WHERE passed) GROUP BY 1"
INGEST_COUNTERS = (
    f"WITH {VERDICT}, asked AS (SELECT DISTINCT o_orderpriority AS symbol FROM orders UNION SELECT r_name FROM region), j AS (SELECT * FROM asked FULL JOIN verdict USING (symbol)) "
    "SELECT CAST(count(*) AS BIGINT) AS requested, CAST(count(*) FILTER (passed) AS BIGINT) AS succeeded, CAST(count(*) FILTER (n_rows IS NULL) AS BIGINT) AS failed, "
    "CAST(count(*) FILTER (NOT passed) AS BIGINT) AS quarantined, CAST(coalesce(sum(n_rows) FILTER (passed), 0) AS BIGINT) AS rows_written FROM j"
)
#: The verdict over events in order of their ids, with planted faults.
_TICK_BARS = (
    "e0 AS (SELECT event_type AS symbol, event_id AS seq, CASE WHEN event_type = 'view' THEN date_trunc('day', ts) ELSE ts END AS ts, "
    "CASE WHEN event_id % 997 = 0 THEN -value WHEN event_id % 991 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END AS close FROM events), "
    "broken AS (SELECT *, abs(close) AS open, abs(close) AS high, close AS low, 1.0 AS volume FROM e0)"
)
TICK_QUALITY = (
    f"WITH {_TICK_BARS}{VERDICT[len(BROKEN):]} SELECT symbol, n_rows, {', '.join(CHECKS)}, extreme_move, stale_series, round(sigma,6) AS sigma, round(flat_share,6) AS flat_share, passed FROM verdict"
)
#: The forgetting average as a list folded step by step.
TICK_FOLD = (
    "WITH RECURSIVE t AS (SELECT event_type AS symbol, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, value AS v FROM events), "
    "f(symbol, i, m, up) AS (SELECT symbol, i, v, v > v FROM t WHERE i = 1 UNION ALL SELECT t.symbol, t.i, 0.9::DOUBLE * f.m + 0.1::DOUBLE * t.v, t.v > 0.9::DOUBLE * f.m + 0.1::DOUBLE * t.v FROM f JOIN t ON t.symbol = f.symbol AND t.i = f.i + 1) "
    "SELECT symbol, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (up) AS BIGINT) AS n_long FROM f GROUP BY 1"
)
_STILL = "SELECT 'STILL' AS symbol, ts, 5.0 AS open, 5.0 AS high, 5.0 AS low, 5.0 AS close, volume, 0 AS k, epoch(ts) AS seq FROM bars WHERE symbol = '1-URGENT'"
_FLAGS = {
    "duplicate_timestamps": "ts = before", "unsorted": "ts < before", "non_finite_close": "NOT isfinite(close)", "non_positive_price": "isfinite(close) AND close <= 0",
    "ohlc_violation": f"{FINITE} AND {BAD_RANGE}", "negative_volume": "volume < 0", "extreme_move": "n_r > 30 AND sigma > 0 AND abs(r) > 12 * sigma",
}
_FLAGGED = " UNION ALL ".join(f"SELECT symbol, seq, ts, '{c}' AS \"check\" FROM f3 WHERE {e}" for c, e in _FLAGS.items())
_SAYS = " ".join(f"WHEN \"check\" = '{c}' THEN '{m}'" for c, m in MESSAGES.items() if c not in ("empty", "stale_series")) + " WHEN \"check\" = 'stale_series' THEN share || ' % of the steps don''t move'"
QUALITY_FINDINGS = (
    "WITH " + VERDICT.replace("f0 AS (SELECT *, lag(ts) OVER w AS before, CASE WHEN isfinite(close) THEN close END AS c0 FROM broken", f"all_bars AS (SELECT * FROM broken UNION ALL {_STILL}), "
    "f0 AS (SELECT *, lag(ts) OVER w AS before, CASE WHEN isfinite(close) THEN close END AS c0 FROM all_bars")
    + f", flagged AS ({_FLAGGED}), numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol, \"check\" ORDER BY seq) AS k FROM flagged), "
    "found AS (SELECT symbol, \"check\", CASE WHEN \"check\" = 'extreme_move' THEN 'WARNING' ELSE 'ERROR' END AS severity, CAST(CASE WHEN \"check\" = 'unsorted' THEN 0 ELSE count(*) END AS BIGINT) AS \"count\", "
    "CASE WHEN \"check\" = 'unsorted' THEN '' ELSE string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S'), ',' ORDER BY seq) FILTER (k <= 3) END AS samples, NULL AS share FROM numbered GROUP BY 1, 2 "
    "UNION ALL SELECT symbol, 'stale_series', 'WARNING', still, '', CAST(floor(flat_share * 100 + 0.5) AS BIGINT) FROM verdict WHERE stale_series = 1), "
    "asked AS (SELECT DISTINCT o_orderpriority AS symbol FROM orders UNION SELECT r_name FROM region), every AS (SELECT symbol, coalesce(passed, FALSE) AS passed, n_rows FROM asked FULL JOIN verdict USING (symbol)) "
    "SELECT symbol, passed, CASE WHEN n_rows IS NULL THEN 'empty' ELSE \"check\" END AS \"check\", CASE WHEN n_rows IS NULL THEN 'ERROR' ELSE severity END AS severity, "
    f"CASE WHEN n_rows IS NULL THEN 'no rows came' {_SAYS} END AS message, "
    "CASE WHEN n_rows IS NULL THEN 0 ELSE \"count\" END AS \"count\", CASE WHEN n_rows IS NULL THEN '' ELSE samples END AS samples FROM every LEFT JOIN found USING (symbol)"
)
UPSERT = with_bars(
    "SELECT symbol, {day}, round(close,6) AS close, source FROM (SELECT symbol, ts, close, 'first' AS source, TIMESTAMP '2002-01-01' AS f, 0 AS new FROM bars UNION ALL SELECT symbol, ts, close + 1, 'second', "
    "CASE WHEN month(ts) % 4 = 0 THEN TIMESTAMP '2002-02-01' WHEN month(ts) % 3 = 0 THEN TIMESTAMP '2002-01-01' ELSE TIMESTAMP '2001-12-01' END, 1 FROM bars WHERE month(ts) % 2 = 0) "
    "QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY f DESC, new) = 1"
)
COVERAGE = with_bars(
    "SELECT ticker, CAST(count(b.ts) AS BIGINT) AS n_rows, strftime(min(b.ts),'%Y-%m-%d') AS start_day, strftime(max(b.ts),'%Y-%m-%d') AS end_day, CASE WHEN count(b.ts) > 0 THEN 'EOD' ELSE 'UNAVAILABLE' END AS latency "
    "FROM (SELECT DISTINCT o_orderpriority AS ticker FROM orders UNION ALL SELECT r_name FROM region) LEFT JOIN bars b ON b.symbol = ticker GROUP BY 1"
)
_LATENCY = "['LIVE','DELAYED','EOD','HISTORICAL','SIMULATED','UNAVAILABLE']"
PROVENANCE = (
    f"SELECT event_type, {_LATENCY}[CAST(max(user_id % 6) AS INTEGER) + 1] AS latency, strftime(min(date_trunc('day', ts)),'%Y-%m-%d %H:%M:%S') AS as_of, strftime(min(ts),'%Y-%m-%d %H:%M:%S') AS fetched_at, "
    "array_to_string(list_sort(list_distinct(list('p' || (user_id % 4)))), ',') AS sources, bool_or(event_id % 1000 = 0) AS is_cached, "
    "coalesce(array_to_string(list_sort(list_distinct(list('n' || (event_id % 3)) FILTER (event_id % 500 = 0))), '; '), '') AS note FROM events GROUP BY 1"
)
AVAILABILITY = "SELECT event_type, max(user_id % 6) < 5 AS available FROM events WHERE user_id % 6 < 5 OR event_type = 'click' GROUP BY 1"

# --- state vector ----------------------------------------------------------------------------------------------

SPEC = default_spec(ALTS)
PLAIN = "WINDOW w AS (ORDER BY ts)"


def _source(f: Feature) -> str:
    if f.kind == "funding":
        return f"(SELECT ts, close FROM funding WHERE symbol = '{f.source}')"
    if f.source == SPEC.calendar:
        return "(SELECT ts, close FROM cal)"
    return f"(SELECT ts, close FROM {'context' if f.source in ('DXY', 'VIX', 'US10Y') else 'bars'} WHERE symbol = '{f.source}')"


def transformed(f: Feature) -> str:
    """``ts``, ``v``: the feature on its source's own rows."""
    rel, n = _source(f), f.window
    make = lambda e, *inner: stack(rel, e, *inner, window=PLAIN, keep="ts")
    if f.transform == "level":
        return make("close")
    if f.transform == "expanding_z":
        return make(expanding_z("close", 30, ""))
    if f.transform == "sma":
        return make(sma("close", n, ""))
    if f.transform == "pct_from_sma":
        return make("(close - m) / nullif(m, 0)", f"{sma('close', n, '')} AS m")
    if f.transform == "log_return":
        return make(log_return("close", n))
    if f.transform == "diff":
        return make(f"close - lag(close, {n}) OVER w")
    if f.transform == "realized_vol":
        return make(f"{std('r', n, '')} * sqrt(365)", f"{log_return('close', 1)} AS r")
    if f.transform == "vol_ratio":
        return make("CASE WHEN b > 0 THEN a / b END", f"{log_return('close', 1)} AS r", f"{std('r', n, '')} AS a, {std('r', f.slow_window, '')} AS b")
    vs = f"(SELECT c.ts, c.close, CASE WHEN {aged(OTHER_STALE_DAYS)} THEN s.close END AS vs FROM {rel} c ASOF LEFT JOIN cal s ON c.ts >= s.ts)"
    return stack(vs, f"({log_return('close', n)}) - ({log_return('vs', n)})", window=PLAIN, keep="ts")


def _matrix() -> str:
    parts = [f"{BARS}, {CAL}, {FUNDING}, {CONTEXT}"]
    for f in SPEC.features:
        parts.append(f"t_{f.name} AS ({transformed(f)})")
        parts.append(f"a_{f.name} AS (SELECT c.ts, CASE WHEN {aged(f.max_days)} THEN s.v END AS {f.name} FROM cal c ASOF LEFT JOIN t_{f.name} s ON c.ts >= s.ts)")
    joins = " ".join(f"JOIN a_{n} USING (ts)" for n in SPEC.names)
    parts.append(f"raw AS (SELECT ts, {', '.join(SPEC.names)} FROM (SELECT ts FROM cal) {joins})")
    parts.append("scored AS (SELECT *, " + ", ".join(f"{expanding_z(n, SPEC.min_history, '')} AS {n}__z" for n in SPEC.names) + " FROM raw)")
    complete = " AND ".join(f"{n} IS NOT NULL" for n in SPEC.names)
    scores = " AND ".join(f"{n}__z IS NOT NULL" for n in SPEC.names)
    parts.append(f"m AS (SELECT *, ({complete}) AS complete, ({complete} AND {scores}) AS usable FROM scored)")
    return "WITH " + ", ".join(parts)


MATRIX = _matrix()
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for n in SPEC.names for c in (n, f"{n}__z"))


def matrix(select: str) -> str:
    return f"{MATRIX} " + select.replace("{day}", DAY).replace("{rounded}", ROUNDED)


_RANK = "CASE WHEN symbol IN ('DXY', 'VIX', 'US10Y') THEN 1 WHEN symbol = '2-HIGH' AND dayofyear(ts) % 50 = 0 AND year(ts) >= 1996 THEN 3 WHEN kind = 'funding' THEN 0 ELSE 2 END"
_ORIGIN = "CASE WHEN symbol IN ('DXY', 'VIX', 'US10Y') THEN 'context' WHEN kind = 'funding' THEN 'venue' WHEN dayofyear(ts) % 2 = 0 THEN 'exchange' ELSE 'archive' END"
TRACKED = (
    "every AS (SELECT 'bars' AS kind, symbol, ts FROM bars UNION ALL SELECT 'bars', symbol, ts FROM cal UNION ALL SELECT 'bars', symbol, ts FROM context UNION ALL SELECT 'funding', symbol, ts FROM funding), "
    f"origin AS (SELECT kind, symbol, ts, {_RANK} AS rank, {_ORIGIN} AS source, ts + INTERVAL 1 DAY AS fetched FROM every)"
)
_TRACKED_SPEC = default_spec(("1-URGENT", "2-HIGH", "3-MEDIUM", "NOWHERE"))
_ASKED = ", ".join(f"('{f.name}', '{f.kind}', '{s}')" for f in _TRACKED_SPEC.features for s in (f.source, f.vs) if s)
_STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"
FEATURE_PROVENANCE = (
    f"WITH {BARS}, {CAL}, {FUNDING}, {CONTEXT}, {TRACKED}, asked(feature, kind, symbol) AS (VALUES {_ASKED}), "
    "each AS (SELECT a.feature, coalesce(o.rank, 5) AS rank, o.ts, o.fetched, coalesce(o.source, 'none') AS source, o.ts IS NOT NULL AS is_cached, CASE WHEN o.ts IS NULL THEN a.symbol || ' has no ' || a.kind END AS note, "
    "max(o.ts) OVER (PARTITION BY a.feature, a.symbol) AS last FROM asked a LEFT JOIN origin o ON o.kind = a.kind AND o.symbol = a.symbol), "
    "f AS (SELECT feature, max(rank) AS rank, min(last) AS as_of, min(fetched) AS fetched_at, list_sort(list_distinct(list(source))) AS sources, bool_or(is_cached) AS is_cached, coalesce(string_agg(DISTINCT note, '; ' ORDER BY note), '') AS note FROM each GROUP BY 1), "
    "u AS (SELECT * FROM f UNION ALL SELECT 'state_vector', greatest(max(rank), 2), min(as_of), min(fetched_at), list_sort(list_distinct(flatten(list(sources)))), TRUE, 'version 1' FROM f) "
    f"SELECT feature, {_LATENCY}[CAST(rank AS INTEGER) + 1] AS latency, {_STAMP.format('as_of')}, {_STAMP.format('fetched_at')}, array_to_string(sources, ',') AS sources, is_cached, note FROM u"
)


def provenance_by_day(select: str) -> str:
    so_far = "ORDER BY ts ROWS UNBOUNDED PRECEDING"
    parts = [f"{MATRIX}", TRACKED, f"known AS (SELECT *, max(rank) OVER (PARTITION BY kind, symbol {so_far}) AS worst, min(fetched) OVER (PARTITION BY kind, symbol {so_far}) AS first_fetch FROM origin)"]
    rows = []
    for f in SPEC.features:
        own = f"(SELECT * FROM known WHERE kind = '{f.kind}' AND symbol = '{f.source}')"
        other = f"(SELECT * FROM known WHERE kind = 'bars' AND symbol = '{f.vs}')"
        source = f"(SELECT o.ts, greatest(o.worst, coalesce(v.worst, 5)) AS worst, o.first_fetch FROM {own} o ASOF LEFT JOIN {other} v ON o.ts >= v.ts)" if f.vs else own
        rows.append(f"SELECT m.ts, '{f.name}' AS feature, CASE WHEN m.{f.name} IS NULL THEN 5 ELSE s.worst END AS rank, s.ts AS hit, s.first_fetch AS got FROM m ASOF LEFT JOIN {source} s ON m.ts >= s.ts")
    parts.append(f"per AS ({' UNION ALL '.join(rows)})")
    parts.append("whole AS (SELECT * FROM per UNION ALL SELECT ts, 'state_vector', greatest(max(rank), 2), min(hit), min(got) FROM per GROUP BY ts)")
    parts.append(f"tracked AS (SELECT {DAY}, feature, {_LATENCY}[CAST(rank AS INTEGER) + 1] AS latency, strftime(hit, '%Y-%m-%d %H:%M:%S') AS as_of, strftime(got, '%Y-%m-%d %H:%M:%S') AS fetched_at FROM whole)")
    return ", ".join(parts) + " " + select


_ALT_Z = [f"{a}_vs_btc_63d__z" for a in ("eth", "sol", "bnb", "xrp")]
_VOL = "round(btc_vol_ratio, 6)"


def _mean_present(values: list[str]) -> str:
    return f"(({' + '.join(f'coalesce({v}, 0)' for v in values)}) / nullif({' + '.join(f'CASE WHEN {v} IS NULL THEN 0 ELSE 1 END' for v in values)}, 0))"


_STRENGTH = _mean_present(["abs(tz)", "(CASE WHEN vr = 0 THEN 0 ELSE abs((vr - 1) / 0.3) END)"])
CALLS = (
    "k AS (SELECT *, round(btc_trend_200d__z, 6) AS tz, round(btc_mom_63d, 6) AS mr, round(btc_mom_63d__z, 6) AS mz, round(btc_funding_z__z, 6) AS fz, " + f"{_VOL} AS vr, round({_mean_present(_ALT_Z)}, 6) AS breadth FROM m), "
    "calls AS (SELECT ts, usable, breadth, CASE WHEN mz IS NOT NULL AND tz > 0.3 AND mr > 0 THEN 'UP' WHEN mz IS NOT NULL AND tz < -0.3 AND mr < 0 THEN 'DOWN' ELSE 'SIDEWAYS' END AS trend, "
    "CASE WHEN vr > 1.25 THEN 'HIGH' WHEN vr < 0.80 THEN 'LOW' ELSE 'NORMAL' END AS volatility, CASE WHEN fz > 1 THEN 'CROWDED_LONG' WHEN fz < -1 THEN 'CROWDED_SHORT' ELSE 'NEUTRAL' END AS positioning, "
    "CASE WHEN breadth > 0.3 THEN 'ALT_SEASON' WHEN breadth < -0.3 THEN 'BTC_DOMINANCE' ELSE 'NEUTRAL' END AS alt_rotation, "
    f"round(coalesce(CASE WHEN {_STRENGTH} > 1.5 THEN 1.0 ELSE {_STRENGTH} / 1.5 END, 0), 4) AS confidence, "
    "trend || '_' || volatility AS label, CAST(8 AS BIGINT) AS n_evidence FROM k)"
)


def regime(select: str) -> str:
    return f"{MATRIX}, {CALLS} " + select.replace("{day}", DAY)


_ITEMS = {
    "btc_trend_200d": "CASE WHEN coalesce(btc_trend_200d, 0) > 0 THEN 'above' ELSE 'below' END || ' its 200d average' || CASE WHEN btc_trend_200d__z IS NULL THEN '' ELSE printf(', z=%+.2f', btc_trend_200d__z) END",
    "btc_mom_63d": "CASE WHEN btc_mom_63d IS NULL THEN 'unavailable' ELSE printf('63d return %+.1f%%', btc_mom_63d * 100) END",
    "btc_vol_ratio": "CASE WHEN btc_vol_ratio IS NULL THEN 'unavailable' ELSE printf('21d/90d realized vol ratio = %.2f', btc_vol_ratio) END",
    "btc_funding_z": "CASE WHEN round(btc_funding_z__z, 6) > 1 THEN 'funding unusually elevated (crowded longs)' WHEN round(btc_funding_z__z, 6) < -1 THEN 'funding unusually negative (crowded shorts)' ELSE 'funding within normal range' END",
    "dxy_mom_63d": "'macro context'", "vix_level": "'macro context'", "us10y_chg_63d": "'macro context'",
}
_PLACES = {n: i + (i > 3) for i, n in enumerate(_ITEMS)}
_N_ALTS = " + ".join(f"CASE WHEN {v} IS NULL THEN 0 ELSE 1 END" for v in _ALT_Z)
REGIME_EVIDENCE = f"{MATRIX} " + " UNION ALL ".join([
    *[f"SELECT {DAY}, {_PLACES[n]} AS pos, '{n}' AS feature, round({n}, 6) AS raw, round({n}__z, 6) AS z, {e} AS reads_as FROM m" for n, e in _ITEMS.items()],
    f"SELECT {DAY}, 4, 'alt_breadth_avg_z', NULL, round({_mean_present(_ALT_Z)}, 6), 'average of ' || ({_N_ALTS}) || '/4 altcoins'' relative strength vs BTC' FROM m",
])

# --- analogues -------------------------------------------------------------------------------------------------

AS_OF = "TIMESTAMP '2001-01-15'"
TWO = (
    "rows2 AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS row_idx, btc_trend_200d__z AS a, btc_mom_63d__z AS b FROM m), ready AS (SELECT * FROM rows2 WHERE a IS NOT NULL AND b IS NOT NULL), "
    f"q AS (SELECT row_idx AS qi, a AS qa, b AS qb FROM ready WHERE ts <= {AS_OF} ORDER BY ts DESC LIMIT 1), pool AS (SELECT ready.*, qa, qb FROM ready, q WHERE row_idx < qi - 21), "
    "cv AS (SELECT covar_samp(a,a) AS x, covar_samp(a,b) AS y, covar_samp(b,b) AS z FROM pool), rd AS (SELECT x + 0.1 * (x + z) / 2 AS x, y, z + 0.1 * (x + z) / 2 AS z FROM cv), "
    "dist AS (SELECT ts, row_idx, sqrt(greatest(((a-qa)*(a-qa)*z - 2*(a-qa)*(b-qb)*y + (b-qb)*(b-qb)*x) / (x*z - y*y), 0)) AS distance FROM pool, rd)"
)


def two(select: str) -> str:
    return f"{MATRIX}, {TWO} " + select.replace("{day}", DAY)


KEPT = (
    "ord AS (SELECT list([CAST(row_idx AS BIGINT)] ORDER BY distance, row_idx) AS xs FROM dist WHERE distance IS NOT NULL), "
    "acc AS (SELECT list_reduce(xs, lambda s, x: CASE WHEN len(list_filter(s, lambda e: abs(e - x[1]) <= 21)) > 0 THEN s ELSE list_concat(s, x) END) AS kept FROM ord WHERE len(xs) > 0), "
    "flat AS (SELECT unnest(kept) AS row_idx, generate_subscripts(kept, 1) AS rank FROM acc), kept AS (SELECT d.ts, f.row_idx, d.distance, f.rank FROM flat f JOIN dist d USING (row_idx))"
)


def episodes(select: str) -> str:
    return f"{MATRIX}, {TWO}, {KEPT} " + select.replace("{day}", DAY)


_POOL = "OVER (ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 22 PRECEDING)"
WALK_FORWARD = (
    f"{MATRIX}, r0 AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS row_idx, CASE WHEN btc_mom_63d__z IS NOT NULL THEN btc_trend_200d__z END AS a, CASE WHEN btc_trend_200d__z IS NOT NULL THEN btc_mom_63d__z END AS b FROM m), "
    f"r1 AS (SELECT *, covar_samp(a,a) {_POOL} AS x, covar_samp(a,b) {_POOL} AS y, covar_samp(b,b) {_POOL} AS z, count(a) {_POOL} AS n FROM r0), "
    "q AS (SELECT row_idx AS qi, a AS qa, b AS qb, n, x + 0.1 * (x + z) / 2 AS x, y, z + 0.1 * (x + z) / 2 AS z FROM r1 WHERE a IS NOT NULL AND n >= 2), "
    "d AS (SELECT qi, p.row_idx, q.n, sqrt(greatest(((a-qa)*(a-qa)*z - 2*(a-qa)*(b-qb)*y + (b-qb)*(b-qb)*x) / (x*z - y*y), 0)) AS distance FROM q JOIN (SELECT row_idx, a, b FROM r0 WHERE a IS NOT NULL) p ON p.row_idx < qi - 21), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY qi ORDER BY distance, row_idx) AS rank FROM d QUALIFY rank <= 5) "
    "SELECT CAST(qi AS BIGINT) AS query_idx, CAST(rank AS INTEGER) AS rank, CAST(row_idx AS BIGINT) AS row_idx, round(distance, 6) AS distance, CAST(n AS BIGINT) AS n FROM k"
)
HORIZON_QUANTILES = (
    f"{MATRIX}, {TWO}, {KEPT}, nb AS (SELECT ts, close, row_number() OVER (ORDER BY ts) - 1 AS row_idx FROM cal), fw AS (SELECT row_idx, "
    + ", ".join(f"lead(close, {h}) OVER (ORDER BY ts) / close - 1 AS f{h}" for h in (1, 3, 7, 21))
    + " FROM nb), lg AS (SELECT h.horizon, CASE h.horizon WHEN 1 THEN f1 WHEN 3 THEN f3 WHEN 7 THEN f7 ELSE f21 END AS r FROM kept JOIN fw USING (row_idx), (VALUES (1), (3), (7), (21)) h(horizon)) "
    "SELECT horizon, CAST(count(r) AS BIGINT) AS n, round(quantile_cont(r, 0.25), 6) AS p25, round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.75), 6) AS p75 FROM lg GROUP BY 1"
)

_N = len(SPEC.names)
_SCORES = ", ".join(f"{n}__z" for n in SPEC.names)
#: The inverse by Gauss-Jordan elimination, one column a step; the ridge keeps all pivots positive.
MAHALANOBIS_16 = (
    MATRIX.replace("WITH ", "WITH RECURSIVE ", 1)
    + f", rows16 AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS row_idx, [{_SCORES}] AS v, usable FROM m), "
    f"q16 AS (SELECT * FROM (SELECT row_idx AS qi, v AS qv, usable FROM rows16 WHERE ts <= {AS_OF} ORDER BY ts DESC LIMIT 1) WHERE usable), "
    "pool AS (SELECT rows16.ts, row_idx, v, qv FROM rows16, q16 WHERE rows16.usable AND row_idx < qi - 21), "
    f"cv AS (SELECT i, j, covar_samp(v[i], v[j]) AS c FROM pool, range(1, {_N + 1}) a(i), range(1, {_N + 1}) b(j) GROUP BY i, j), "
    f"rd AS (SELECT i, j, c + CASE WHEN i = j THEN 0.1 * (SELECT sum(c) FROM cv WHERE i = j) / {_N} ELSE 0 END AS c FROM cv), "
    f"line AS (SELECT i, list_concat(list(c ORDER BY j), list_transform(range(1, {_N + 1}), lambda p: CASE WHEN p = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS r FROM rd GROUP BY i), "
    "g(k, m) AS (SELECT 0, list(r ORDER BY i) FROM line UNION ALL SELECT k + 1, list_transform(m, lambda r, n: "
    f"list_transform(r, lambda x, p: CASE WHEN n = k + 1 THEN x / r[k + 1] ELSE x - r[k + 1] * m[k + 1][p] / m[k + 1][k + 1] END)) FROM g WHERE k < {_N}), "
    f"inv AS (SELECT list_transform(m, lambda r: r[{_N + 1}:{2 * _N}]) AS x FROM g WHERE k = {_N}), "
    "away AS (SELECT ts, row_idx, list_transform(v, lambda a, n: a - qv[n]) AS d FROM pool), "
    "dist AS (SELECT ts, row_idx, sqrt(greatest(list_sum(list_transform(x, lambda r, n: d[n] * list_dot_product(r, d))), 0)) AS distance FROM away, inv), "
    + KEPT
    + ", fw AS (SELECT ts, " + ", ".join(f"lead(close, {h}) OVER (ORDER BY ts) / close - 1 AS fwd_{h}" for h in (1, 3, 7, 21)) + " FROM cal) "
    f"SELECT strftime(kept.ts, '%Y-%m-%d') AS day, CAST(row_idx AS BIGINT) AS row_idx, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank, "
    + ", ".join(f"round(fwd_{h}, 6) AS fwd_{h}" for h in (1, 3, 7, 21)) + " FROM kept LEFT JOIN fw USING (ts)"
)

# --- backtests -------------------------------------------------------------------------------------------------

_W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
SIGNALS = (
    f"{BARS}, {CAL}, {FUNDING}, "
    f"fm AS (SELECT symbol, ts, {sma('close', 21)} AS m, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM funding), "
    f"fq AS (SELECT symbol, ts, m, k, {sma('m', 180)} AS zm, {std('m', 180)} AS zs FROM fm), fz AS (SELECT symbol AS paid, ts, CASE WHEN k >= 202 AND zs > 0 THEN (m - zm) / zs END AS z FROM fq), "
    f"s0 AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, {log_return('close', 63)} AS mom, {log_return('close', 10)} AS r10, {log_return('close', 1)} AS r1 FROM bars {_W}), "
    f"s1 AS (SELECT *, {sma('r10', 90)} AS m10, {std('r10', 90)} AS d10, {std('r1', 21)} * sqrt(365) AS vol FROM s0), "
    "s2 AS (SELECT c.*, s.z AS fund FROM (SELECT *, CASE WHEN symbol IN ('1-URGENT', '2-HIGH') THEN 'O' WHEN symbol IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 'F' END AS funding_of FROM s1) c ASOF LEFT JOIN fz s ON c.funding_of = s.paid AND c.ts >= s.ts), "
    "sig AS (SELECT *, CASE WHEN vol > 0 THEN least(0.40 / vol, 1.0) ELSE 0.0 END AS size, TRUE AS long_buy_and_hold, coalesce(mom > 0, FALSE) AS long_momentum, "
    "coalesce(d10 > 0 AND (r10 - m10) / nullif(d10, 0) < -1.5 AND i >= 100, FALSE) AS long_mean_reversion, coalesce(fund < -1.0, FALSE) AS long_funding_contrarian FROM s2)"
)
_ALL = " UNION ALL ".join(f"SELECT symbol, ts, i, n, open, '{s}' AS strategy, CASE WHEN long_{s} THEN size ELSE 0.0 END AS weight FROM sig" for s in ("buy_and_hold", "momentum", "mean_reversion", "funding_contrarian"))
_K = "WINDOW w AS (PARTITION BY symbol, strategy ORDER BY ts)"
_BEFORE = "PARTITION BY symbol, strategy ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
EQUITY = (
    f"{SIGNALS}, dec AS ({_ALL}), e0 AS (SELECT *, lead(open, 1) OVER w AS entry, lead(open, 2) OVER w AS exit, lead(ts, 1) OVER w AS fill_ts FROM dec {_K}), "
    "e1 AS (SELECT *, CASE WHEN i >= 200 AND i <= n - 3 AND entry IS NOT NULL AND exit IS NOT NULL THEN weight END AS held FROM e0 WHERE n >= 203), "
    f"e2 AS (SELECT *, coalesce(last_value(held IGNORE NULLS) OVER ({_BEFORE}), 0.0) AS before FROM e1), "
    "e3 AS (SELECT *, CASE WHEN held IS NULL THEN 1.0 ELSE (1 - abs(held - before) * 10 / 1e4) * (1 + held * (exit / entry - 1)) END AS factor FROM e2), "
    "e4 AS (SELECT *, product(factor) OVER (PARTITION BY symbol, strategy ORDER BY ts ROWS UNBOUNDED PRECEDING) AS grown FROM e3), "
    f"eq AS (SELECT * FROM (SELECT *, coalesce(lag(grown, 2) OVER w, 1.0) AS equity FROM e4 {_K}) WHERE i >= 200), "
    "l0 AS (SELECT *, sum(CASE WHEN before <= 0 AND held > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, strategy ORDER BY ts ROWS UNBOUNDED PRECEDING) AS trade_id FROM eq WHERE held IS NOT NULL), "
    "l1 AS (SELECT symbol, strategy, trade_id, max(fill_ts) FILTER (before <= 0 AND held > 0) AS entry_ts, max(entry) FILTER (before <= 0 AND held > 0) AS entry_price, max(held) FILTER (before <= 0 AND held > 0) AS weight, "
    "max(fill_ts) FILTER (before > 0 AND held <= 0) AS exit_ts, max(entry) FILTER (before > 0 AND held <= 0) AS exit_price FROM l0 WHERE (before <= 0 AND held > 0) OR (before > 0 AND held <= 0) GROUP BY 1, 2, 3), "
    "ledger AS (SELECT *, (exit_price / entry_price - 1) * weight AS pnl FROM l1)"
)


def backtest(select: str) -> str:
    return f"WITH {EQUITY} " + select.replace("{day}", DAY)


#: The same over events: the price is both opening and close, and nothing is funded.
TICK_EQUITY = (
    f"WITH {TICKS}, s0 AS (SELECT *, close AS open, ts - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, {log_return('close', 63)} AS mom, {log_return('close', 10)} AS r10, {log_return('close', 1)} AS r1 FROM ticks {_W}), "
    f"s1 AS (SELECT *, {sma('r10', 90)} AS m10, {std('r10', 90)} AS d10, {std('r1', 21)} * sqrt(365) AS vol FROM s0), "
    "sig AS (SELECT *, CASE WHEN vol > 0 THEN least(0.40 / vol, 1.0) ELSE 0.0 END AS size, TRUE AS long_buy_and_hold, coalesce(mom > 0, FALSE) AS long_momentum, "
    "coalesce(d10 > 0 AND (r10 - m10) / nullif(d10, 0) < -1.5 AND i >= 100, FALSE) AS long_mean_reversion, FALSE AS long_funding_contrarian FROM s1), "
    + EQUITY[EQUITY.index("dec AS (") :].replace("SELECT symbol, ts, i, n, open,", "SELECT symbol, event_id, ts, i, n, CASE WHEN open > 0 THEN open END AS open,")
    + " SELECT symbol, strategy, event_id, round(before, 6) AS before, round(ln(equity), 6) AS log_equity FROM eq"
)

BACKTEST_METRICS = (
    f"WITH {EQUITY}, p AS (SELECT *, equity / lag(equity) OVER w - 1 AS r, equity / max(equity) OVER (PARTITION BY symbol, strategy ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM eq {_K}), "
    "g AS (SELECT symbol, strategy, arg_min(equity, i) AS first, arg_max(equity, i) AS last, max(n) - 1 - 200 AS n_days, stddev_samp(r) AS sd, avg(r) AS mean, count(r) AS n_r, count(*) FILTER (r < -1e-12) AS n_neg, "
    "avg(r * r) FILTER (r < -1e-12) AS neg2, min(dd) AS mdd FROM p GROUP BY 1, 2), "
    "c AS (SELECT symbol, strategy, count(*) AS n_closed, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win, sum(pnl) FILTER (pnl > 0) AS gain, -sum(pnl) FILTER (pnl < 0) AS loss FROM ledger WHERE pnl IS NOT NULL GROUP BY 1, 2), "
    "j AS (SELECT *, CASE WHEN n_days > 0 AND last / first > 0 THEN pow(last / first, 365.0 / n_days) - 1 ELSE 0 END AS cagr_x FROM g LEFT JOIN c USING (symbol, strategy)) "
    "SELECT symbol, strategy, round(ln(round(last / first - 1, 4) + 1), 6) AS log_growth, round(cagr_x, 4) AS cagr, round(CASE WHEN n_r >= 2 THEN sd * sqrt(365) ELSE 0 END, 4) AS annualized_vol, "
    "round(CASE WHEN sd > 0 THEN mean / sd * sqrt(365) ELSE 0 END, 3) AS sharpe, round(CASE WHEN n_neg >= 2 AND neg2 > 0 THEN mean / sqrt(neg2) * sqrt(365) ELSE 0 END, 3) AS sortino, round(coalesce(mdd, 0), 4) AS max_drawdown, "
    "round(CASE WHEN mdd < 0 THEN cagr_x / abs(mdd) ELSE 0 END, 3) AS calmar, round(coalesce(win, 0), 4) AS win_rate, "
    "round(CASE WHEN coalesce(n_closed, 0) = 0 THEN 0 WHEN coalesce(loss, 0) > 0 THEN coalesce(gain, 0) / loss WHEN coalesce(gain, 0) > 0 THEN NULL ELSE 0 END, 3) AS profit_factor, CAST(coalesce(n_closed, 0) AS BIGINT) AS n_closed FROM j"
)
