"""The same queries in plain SQL, with their own calendar arithmetic."""

from __future__ import annotations

from tickloom.schema import CALENDARS, GREGORIAN, JALALI, TIMEFRAMES

# First day of the Jalali years the supplied tables fall in.
NOWRUZ = {
    1373: "1994-03-21", 1374: "1995-03-21", 1375: "1996-03-20", 1376: "1997-03-21",
    1377: "1998-03-21", 1378: "1999-03-21", 1379: "2000-03-20", 1380: "2001-03-21",
    1381: "2002-03-21", 1402: "2023-03-21", 1403: "2024-03-20", 1404: "2025-03-21",
}

_TABLES = {
    "nz": "SELECT * FROM (VALUES "
    + ", ".join(f"({year}, DATE '{day}')" for year, day in NOWRUZ.items())
    + ") AS v(jy, ys)",
    "li": """
        SELECT 'S' || l_suppkey || '-' || l_linestatus AS symbol, 'S' || l_suppkey AS supplier,
               CASE WHEN l_linestatus = 'F' THEN 'jalali' ELSE 'gregorian' END AS calendar,
               CAST(l_extendedprice AS DECIMAL(18,8)) AS value,
               CAST(l_quantity AS DECIMAL(18,8)) AS volume,
               l_shipdate + to_seconds(l_orderkey % 86400) AS ts, l_linenumber AS batch_id
        FROM lineitem""",
    "od": """
        SELECT o_orderpriority AS symbol, 'gregorian' AS calendar,
               CAST(o_totalprice AS DECIMAL(18,8)) AS value, CAST(1 AS DECIMAL(18,8)) AS volume,
               o_orderdate AS ts, o_orderkey // 1000 AS batch_id
        FROM orders""",
    "ei": """
        SELECT CAST(event_id // 20 AS VARCHAR) AS request_id, event_id // 20 AS turn,
               CAST(event_id % 20 AS INT) AS pos, event_type, 'U' || user_id AS user_symbol,
               CASE WHEN event_type IN ('purchase', 'signup') THEN 'jalali' ELSE 'gregorian' END AS calendar,
               CAST(value AS DECIMAL(18,8)) AS value, CAST(props ->> '$.k' AS INT) AS k,
               date_trunc('millisecond', ts) AS ts, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp
        FROM events""",
    "ev": """
        SELECT event_type AS symbol, calendar, value, CAST(k + 1 AS DECIMAL(18,8)) AS volume, ts FROM ei""",
    "debtors": """
        SELECT 'S' || s_suppkey || '-' || status AS symbol
        FROM supplier, (VALUES ('F'), ('O')) AS v(status) WHERE s_acctbal < 0""",
}


def _tehran(ts: str) -> str:
    return f"CAST(({ts} AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tehran' AS DATE)"


def _with(*names: str, **more: str) -> str:
    parts = {name: _TABLES[name] for name in names} | more
    return "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in parts.items()) + " "


def _day(source: str) -> str:
    """Ticks with their local day ``d`` in the zone of their calendar."""
    return (
        f"SELECT *, CASE WHEN calendar = 'gregorian' THEN CAST(ts AS DATE) ELSE {_tehran('ts')} END AS d "
        f"FROM {source}"
    )


def _placed(source: str) -> str:
    """Adds the start ``ys`` of the Jalali year of ``d`` and the day number ``n`` in it."""
    return f"SELECT t.*, nz.jy, nz.ys, t.d - nz.ys AS n FROM ({_day(source)}) t ASOF JOIN nz ON t.d >= nz.ys"


_SATURDAY = "d - CAST((dayofweek(d) + 1) % 7 AS INT)"
_MONTH_START = "CASE WHEN n < 186 THEN d - CAST(n % 31 AS INT) ELSE d - CAST((n - 186) % 30 AS INT) END"
_JALALI = {"1d": "d", "1w": _SATURDAY, "1m": _MONTH_START, "1y": "ys"}
_GREGORIAN = {
    "1d": "d",
    "1w": "CAST(date_trunc('week', d) AS DATE)",
    "1m": "CAST(date_trunc('month', d) AS DATE)",
    "1y": "CAST(date_trunc('year', d) AS DATE)",
}


def _bucket(timeframe: str) -> str:
    return f"CASE WHEN calendar = 'gregorian' THEN {_GREGORIAN[timeframe]} ELSE {_JALALI[timeframe]} END"


_BUCKET_TEXT = (
    "CASE WHEN calendar = 'gregorian' THEN CAST(b AS VARCHAR) || ' 00:00:00' ELSE CAST(b AS VARCHAR) END"
)
_MEASURES = """
    CAST(arg_min(value, (ts, value)) AS VARCHAR) AS open, CAST(max(value) AS VARCHAR) AS high,
    CAST(min(value) AS VARCHAR) AS low, CAST(arg_max(value, (ts, value)) AS VARCHAR) AS close,
    CAST(CAST(sum(volume) AS DECIMAL(38,8)) AS VARCHAR) AS volume, count(*) AS tick_count"""


def _labels(date: str, when: str) -> str:
    """Jalali year, month and day of a date column, by its own year lookup."""
    jy = f"(SELECT max(jy) FROM nz WHERE ys <= {date})"
    n = f"({date} - (SELECT max(ys) FROM nz WHERE ys <= {date}))"
    month = f"CASE WHEN {n} < 186 THEN {n} // 31 + 1 ELSE ({n} - 186) // 30 + 7 END"
    day = f"CASE WHEN {n} < 186 THEN {n} % 31 + 1 ELSE ({n} - 186) % 30 + 1 END"
    return ", ".join(
        f"CASE WHEN {when} THEN CAST({sql} AS INT) END AS jalali_{name}"
        for name, sql in (("year", jy), ("month", month), ("day", day))
    )


def _candles(source: str, timeframe: str, where: str = "true", extra: str = "") -> str:
    """Candles of both calendars, grouped by symbol and bucket."""
    return f"""
        SELECT symbol, calendar, '{timeframe}' AS timeframe, {_bucket(timeframe)} AS b, {_MEASURES}{extra}
        FROM ({_placed(source)}) WHERE {where} GROUP BY ALL"""


_PLAIN = "symbol, open, high, low, close, volume, tick_count"


def _single(calendar: str, timeframe: str) -> str:
    labels = f", {_labels('b', 'true')}" if calendar == JALALI else ""
    rows = _candles("li", timeframe, f"calendar = '{calendar}'")
    return _with("nz", "li") + f"SELECT {_PLAIN}, {_BUCKET_TEXT} AS bucket_start{labels} FROM ({rows})"


def _all(source: str, timeframe: str, keep: str = "true") -> str:
    rows = _candles(source, timeframe)
    return f"SELECT {_PLAIN}, calendar, timeframe, {_BUCKET_TEXT} AS bucket_start FROM ({rows}) WHERE {keep}"


_RANGE = "BETWEEN DATE '1996-03-20' AND DATE '1998-09-30'"
_TICK_TEXT = """CAST(value AS VARCHAR) AS value, CAST(volume AS VARCHAR) AS volume,
    strftime(ts, '%Y-%m-%d %H:%M:%S.') || lpad(CAST(date_part('millisecond', ts) % 1000 AS VARCHAR), 3, '0') AS "timestamp" """
_MILLIS = "strftime({0}, '%Y-%m-%d %H:%M:%S.') || lpad(CAST(date_part('millisecond', {0}) % 1000 AS VARCHAR), 3, '0')"

# --- ingest -------------------------------------------------------------------

_MIXED = {
    "mixed": r"""
        SELECT 'events:' || request_id AS request_id, pos, event_type AS symbol, CAST(value AS VARCHAR) AS value,
               CAST(k AS VARCHAR) AS volume, calendar, timestamp, ts FROM ei
        UNION ALL
        SELECT 'customer:' || c_custkey, 0, c_name, ' ' || CAST(CAST(c_acctbal AS DECIMAL(18,8)) AS VARCHAR) || chr(9),
               '1', 'gregorian', '2024-01-01T12:00:00+03:30', TIMESTAMP '2024-01-01 08:30:00' FROM customer
        UNION ALL
        SELECT 'orders:' || o_orderkey, 0, o_orderpriority, CAST(CAST(o_totalprice AS DECIMAL(18,8)) AS VARCHAR), '1',
               CASE WHEN o_orderstatus = 'P' THEN 'jalali' ELSE o_orderstatus END,
               strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'), o_orderdate FROM orders
        UNION ALL
        SELECT 'conversations:' || conv_id, CAST(turn AS INT), CASE WHEN role = 'user' THEN '   ' ELSE role END,
               text, CAST(turn AS VARCHAR), 'jalali', CASE WHEN role = 'assistant' THEN text END, NULL
        FROM conversations""",
    "checked": r"""
        SELECT *, timestamp IS NOT NULL AND NOT regexp_matches(timestamp,
                   '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$') AS malformed,
               CASE WHEN trim(symbol) = '' THEN 'symbol must not be empty'
                    WHEN calendar NOT IN ('gregorian', 'jalali') THEN 'calendar must be gregorian or jalali'
                    WHEN coalesce(TRY_CAST(trim(value, chr(9) || ' ') AS DECIMAL(18,8)), 0) <= 0
                        THEN 'value must be a positive decimal'
                    WHEN coalesce(TRY_CAST(volume AS DECIMAL(18,8)), 0) <= 0 THEN 'volume must be a positive decimal'
                    WHEN ts IS NULL THEN 'timestamp must be a valid RFC3339 value' END AS reason
        FROM mixed""",
}
_COLLIDED = {
    "clash": """
        SELECT a.request_id, arg_min(a.user_symbol, a.pos) AS symbol, arg_min(a.first, a.pos) AS calendar,
               arg_min(a.calendar, a.pos) AS other, min(a.pos) AS pos
        FROM (SELECT *, first_value(calendar) OVER (PARTITION BY request_id, user_symbol ORDER BY pos) AS first
              FROM ei) a
        WHERE a.calendar <> a.first GROUP BY a.request_id""",
    "sound": """
        SELECT * FROM ei WHERE request_id NOT IN (SELECT request_id FROM ei WHERE k <= 0 OR value <= 0)""",
}

_RESOLVE = (
    "WITH RECURSIVE "
    + ", ".join(f"{n} AS ({s})" for n, s in {"ei": _TABLES["ei"], **_COLLIDED}.items())
    + """,
    claims AS (
        SELECT row_number() OVER (ORDER BY turn) AS n, request_id,
               map_from_entries(list((user_symbol, calendar) ORDER BY pos)) AS claim
        FROM (SELECT request_id, turn, user_symbol, min(calendar) AS calendar, min(pos) AS pos FROM sound
              WHERE request_id NOT IN (SELECT request_id FROM clash) GROUP BY ALL)
        GROUP BY request_id, turn),
    -- one request after another, carrying the registry along
    steps AS (
        SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS request_id, CAST(NULL AS VARCHAR) AS reason,
               CAST(MAP {} AS MAP(VARCHAR, VARCHAR)) AS reg
        UNION ALL
        SELECT n, request_id, reason, CASE WHEN reason IS NULL THEN map_concat(reg, claim) ELSE reg END
        FROM (SELECT c.n, c.request_id, c.claim, s.reg,
                     list_filter(map_entries(c.claim), lambda e: s.reg[e.key] <> e.value)[1] AS bad,
                     'symbol ' || (bad).key || ' is registered as ' || s.reg[(bad).key]
                         || ' but received ' || (bad).value AS reason
              FROM steps s JOIN claims c ON c.n = s.n + 1))
    SELECT 'rejected' AS outcome, request_id AS name, reason AS detail FROM steps WHERE reason IS NOT NULL
    UNION ALL
    SELECT 'registered', e.key, e.value FROM (
        SELECT unnest(map_entries(reg)) AS e FROM (SELECT reg FROM steps ORDER BY n DESC LIMIT 1))"""
)

_FAULTS = """
    SELECT request_id, 'invalid_request' AS code,
           CASE WHEN bool_or(malformed) THEN 'malformed JSON body'
                ELSE 'ticks[' || min(pos) FILTER (reason IS NOT NULL) || ']: ' ||
                     arg_min(reason, pos) FILTER (reason IS NOT NULL) END AS reason
    FROM checked GROUP BY request_id HAVING bool_or(malformed) OR bool_or(reason IS NOT NULL)"""

_REGISTRY = "SELECT supplier AS symbol, arg_min(calendar, (ts, calendar)) AS calendar, min(ts) AS created_at FROM li GROUP BY 1"

# requests with a zero value or volume are refused whole, so the stored ticks are the others
_STORED = {
    "stored": """
        SELECT event_type AS symbol, calendar, value, CAST(k AS DECIMAL(18,8)) AS volume, ts FROM ei
        WHERE request_id NOT IN (SELECT request_id FROM ei WHERE k <= 0 OR value <= 0)"""
}


def _every_timeframe(source: str) -> str:
    return " UNION ALL ".join(_all(source, tf) for tf in TIMEFRAMES)


def all_oracles() -> dict[str, str]:
    sql = {f"candles_{tf}_{c}": _single(c, tf) for c in CALENDARS for tf in TIMEFRAMES}
    jalali_only = "calendar = 'jalali'"
    sql["candles_all_calendars"] = _with("nz", "li") + (
        f"SELECT {_PLAIN}, calendar, {_BUCKET_TEXT} AS bucket_start, {_labels('b', jalali_only)} "
        f"FROM ({_candles('li', '1m')})"
    )
    sql["candles_formatted"] = _with("nz", "ei", "ev") + (
        f"SELECT {_PLAIN}, calendar, timeframe, {_BUCKET_TEXT} AS bucket_start, {_labels('b', jalali_only)} "
        f"FROM ({_candles('ev', '1d')})"
    )
    sql["ohlcv_open_close"] = _with("od") + f"""
        SELECT symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
               CAST(arg_min(value, (ts, value)) AS VARCHAR) AS open,
               CAST(arg_max(value, (ts, value)) AS VARCHAR) AS close,
               {_MILLIS.format('min(ts)')} AS open_ts, {_MILLIS.format('max(ts)')} AS close_ts
        FROM od GROUP BY symbol, CAST(ts AS DATE)"""
    sql["ohlcv_high_low"] = _with("ei", "ev") + """
        SELECT symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(max(value) AS VARCHAR) AS high,
               CAST(min(value) AS VARCHAR) AS low FROM ev GROUP BY 1, 2"""
    sql["ohlcv_volume_count"] = _with("ei", "ev") + """
        SELECT symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
               CAST(CAST(sum(volume) AS DECIMAL(38,8)) AS VARCHAR) AS volume, count(*) AS ticks FROM ev GROUP BY 1, 2"""
    sql["merge_candle_states"] = _with("nz", "li") + _all("li", "1d")
    sql["rollup_from_days"] = _with("nz", "li") + _every_timeframe("li")
    sql["late_ticks"] = _with("nz", "od") + (
        f"SELECT {_PLAIN}, calendar, timeframe, {_BUCKET_TEXT} AS bucket_start, batches "
        f"FROM ({_candles('od', '1w', extra=', count(DISTINCT batch_id) AS batches')})"
    )

    placed_orders = "SELECT d, orders, jy, ys, d - ys AS n FROM days ASOF JOIN every_year ON d >= ys"
    # fixed value: 8 of 33 Jalali years are leap years, counted by one division
    every_year = "SELECT jy, DATE '2024-03-20' + CAST(365 * (jy - 1403) + (8 * jy + 21) // 33 - (8 * 1403 + 21) // 33 AS INT) AS ys FROM range(1287, 1481) AS r(jy)"
    days = {
        "every_year": every_year,
        "days": """SELECT CAST(r.d AS DATE) AS d, coalesce(c, 0) AS orders FROM range(DATE '1910-01-01', DATE '2100-01-02', INTERVAL 1 DAY) AS r(d)
            LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS o, count(*) AS c FROM orders GROUP BY 1) ON o = CAST(r.d AS DATE)""",
    }
    month = "CAST(CASE WHEN n < 186 THEN n // 31 + 1 ELSE (n - 186) // 30 + 7 END AS INT)"
    dom = "CAST(CASE WHEN n < 186 THEN n % 31 + 1 ELSE (n - 186) % 30 + 1 END AS INT)"
    sql["jalali_calendar"] = _with(**days) + f"""
        SELECT orders, CAST(d AS VARCHAR) AS gregorian_date, CAST(jy AS INT) AS jalali_year, {month} AS jalali_month,
               {dom} AS jalali_day, CAST({_SATURDAY} AS VARCHAR) AS jalali_week_start_date,
               CAST({_MONTH_START} AS VARCHAR) AS jalali_month_start_date, CAST(ys AS VARCHAR) AS jalali_year_start_date
        FROM ({placed_orders})"""
    sql["gregorian_to_jalali"] = _with("nz") + f"""
        SELECT CAST(jy AS INT) AS jalali_year, {month} AS jalali_month, {dom} AS jalali_day, sum(lines)::BIGINT AS lines
        FROM (SELECT *, d - ys AS n FROM (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS lines FROM lineitem
              GROUP BY 1) ASOF JOIN nz ON d >= ys) GROUP BY 1, 2, 3"""
    sql["jalali_buckets"] = _with("nz", "li") + f"""
        SELECT CAST(d AS VARCHAR) AS local_date, CAST({_SATURDAY} AS VARCHAR) AS jalali_week_start_date,
               CAST({_MONTH_START} AS VARCHAR) AS jalali_month_start_date, CAST(ys AS VARCHAR) AS jalali_year_start_date,
               ticks
        FROM (SELECT *, d - ys AS n FROM (SELECT {_tehran('ts')} AS d, count(*) AS ticks FROM li GROUP BY 1)
              ASOF JOIN nz ON d >= ys)"""
    both = "SELECT ts FROM ev UNION ALL SELECT ts FROM li"
    sql["bucket_functions"] = _with("ei", "ev", "li", every=both) + """
        SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS start_1d,
               CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS start_1w,
               CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR) AS start_1m,
               CAST(CAST(date_trunc('year', ts) AS DATE) AS VARCHAR) AS start_1y, count(*) AS ticks
        FROM every GROUP BY ALL"""
    sql["tehran_local_date"] = _with("ei", "ev", "li", every=both) + (
        f"SELECT CAST({_tehran('ts')} AS VARCHAR) AS local_date, count(*) AS ticks FROM every GROUP BY 1"
    )
    sql["saturday_week"] = _with(**days) + f"""
        SELECT CAST(d AS VARCHAR) AS day, CAST({_SATURDAY} AS VARCHAR) AS week_start, orders FROM days WHERE orders > 0"""

    ticks = f"SELECT symbol, {_TICK_TEXT} FROM "
    sql["ticks_by_symbol"] = _with("ei", "ev") + ticks + "ev WHERE symbol = 'purchase'"
    sql["symbols_in_list"] = _with("ei", "ev") + ticks + "ev WHERE symbol IN ('click', 'signup', 'unknown')"
    sql["ticks_formatted"] = _with("ei", "ev") + ticks + "ev"
    sql["ticks_range_gregorian"] = (
        _with("li") + ticks + f"li WHERE calendar = 'gregorian' AND CAST(ts AS DATE) {_RANGE}"
    )
    sql["ticks_range_jalali"] = (
        _with("li") + ticks + f"li WHERE calendar = 'jalali' AND {_tehran('ts')} {_RANGE}"
    )
    for calendar in CALENDARS:
        sql[f"candles_range_{calendar}"] = _with("nz", "li") + _all(
            "li", "1w", f"b {_RANGE} AND calendar = '{calendar}'"
        )
    sql["read_candles"] = _with("nz", "li", "debtors") + (
        f"SELECT {_PLAIN}, calendar, {_BUCKET_TEXT} AS bucket_start, {_labels('b', jalali_only)} "
        f"FROM ({_candles('li', '1m')}) WHERE b {_RANGE} AND symbol IN (SELECT symbol FROM debtors)"
    )
    sql["ticks_page"] = (
        _with("ei", "ev")
        + ticks
        + "(SELECT * FROM ev ORDER BY ts, value, volume, symbol LIMIT 500 OFFSET 1000)"
    )
    event_days = _candles("ev", "1d")
    served = f"SELECT {_PLAIN}, calendar, timeframe, {_BUCKET_TEXT} AS bucket_start FROM "
    sql["candles_page"] = (
        _with("nz", "ei", "ev") + served + f"({event_days} ORDER BY symbol, b LIMIT 40 OFFSET 40)"
    )
    sql["latest_candles"] = (
        _with("nz", "ei", "ev") + served + f"({event_days} ORDER BY b DESC, symbol LIMIT 50)"
    )
    sql["page_has_more"] = _with("nz", "ei", "ev", total=f"SELECT count(*) AS t FROM ({event_days})") + """
        SELECT CAST(page AS INT) AS page, 50 AS "limit", t > page * 50 AS has_more,
               greatest(0, least(50, t - (page - 1) * 50)) AS count
        FROM total, (VALUES (1), (2), (4), (99)) AS v(page)"""

    sql["validate_ticks"] = _with("ei", **_MIXED) + (
        "SELECT request_id, pos, malformed, reason FROM checked"
    )
    sql["normalize_ticks"] = _with("ei", **_MIXED, bad=_FAULTS) + f"""
        SELECT symbol, {_TICK_TEXT} FROM (
            SELECT calendar || '/' || symbol AS symbol, CAST(trim(value, chr(9) || ' ') AS DECIMAL(18,8)) AS value,
                   CAST(volume AS DECIMAL(18,8)) AS volume, ts
            FROM checked WHERE request_id NOT IN (SELECT request_id FROM bad))"""
    sql["reject_batches"] = _with("ei", **_MIXED, **_COLLIDED) + f"""{_FAULTS}
        UNION ALL
        SELECT request_id, 'invalid_request', 'ticks[' || min(pos) || ']: ' ||
               arg_min(CASE WHEN value <= 0 THEN 'value' ELSE 'volume' END, pos) || ' must be a positive decimal'
        FROM ei WHERE k <= 0 OR value <= 0 GROUP BY request_id
        UNION ALL
        SELECT request_id, 'calendar_mismatch',
               'symbol ' || symbol || ' has conflicting calendars in batch: ' || calendar || ' and ' || other
        FROM clash WHERE request_id IN (SELECT request_id FROM sound)"""
    sql["accepted_counts"] = _with("ei", **_COLLIDED) + """
        SELECT request_id, count(*) AS accepted FROM sound
        WHERE request_id NOT IN (SELECT request_id FROM clash) GROUP BY 1"""
    sql["batch_conflicts"] = _with("ei", **_COLLIDED) + (
        "SELECT request_id, pos, symbol, calendar, other FROM clash"
    )
    sql["first_calendar"] = _with("ei") + """
        SELECT request_id, user_symbol AS symbol, arg_min(calendar, pos) AS calendar, min(pos) AS pos
        FROM ei GROUP BY 1, 2"""
    sql["distinct_symbols"] = "SELECT DISTINCT 'U' || user_id AS symbol FROM events"
    sql["parse_tick_json"] = _with("ei") + """
        SELECT request_id, false AS malformed, pos, event_type AS symbol, CAST(value AS VARCHAR) AS value,
               CAST(k AS VARCHAR) AS volume, calendar, timestamp FROM ei
        UNION ALL
        SELECT 'props:' || event_id, true, NULL, NULL, NULL, NULL, NULL, NULL FROM events
        UNION ALL
        SELECT 'text:' || conv_id || ':' || turn, true, NULL, NULL, NULL, NULL, NULL, NULL FROM conversations"""

    registry = {"reg": _REGISTRY}
    sql["registry_resolve"] = _with("li", **registry) + (
        f"SELECT symbol, calendar, {_MILLIS.format('created_at')} AS created_at FROM reg"
    )
    sql["calendar_mismatches"] = _with("li", **registry) + """
        SELECT reg.symbol, reg.calendar AS registered, li.calendar AS received, count(*) AS ticks
        FROM li JOIN reg ON reg.symbol = li.supplier WHERE li.calendar <> reg.calendar GROUP BY ALL"""
    sql["new_symbols"] = """
        SELECT DISTINCT 'S' || l_suppkey AS symbol FROM lineitem
        WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)"""
    sql["symbol_lookup"] = _with("li", **registry) + """
        SELECT 'S' || c_custkey AS symbol, calendar, calendar IS NOT NULL AS found
        FROM customer LEFT JOIN reg ON symbol = 'S' || c_custkey"""
    sql["resolve_registrations"] = _RESOLVE

    stored = _with("nz", "ei", **_STORED) + _every_timeframe("stored")
    sql["stream_candles"] = stored
    sql["ingest_then_stream"] = stored
    sql["stored_reads"] = _with("nz", "ei", **_STORED) + (
        f"SELECT {_PLAIN}, calendar, {_BUCKET_TEXT} AS bucket_start, {_labels('b', jalali_only)} "
        f"FROM ({_candles('stored', '1w')}) WHERE b BETWEEN DATE '2023-01-01' AND DATE '2024-12-31'"
    )
    kept = {"kept": "SELECT * FROM stored WHERE ts >= TIMESTAMP '2024-01-09'"}
    parts = {
        "page": f"(SELECT * FROM ({_day('kept')}) WHERE symbol IN ('click', 'purchase', 'signup', 'view') "
        "AND d BETWEEN DATE '2024-01-05' AND DATE '2024-01-28' ORDER BY symbol, ts, value, volume LIMIT 90 OFFSET 270)",
        "latest": "(SELECT * FROM kept ORDER BY ts DESC, symbol, value, volume LIMIT 70)",
        "latest views": "(SELECT * FROM kept WHERE symbol = 'view' ORDER BY ts DESC, value, volume LIMIT 40)",
    }
    sql["stored_tick_pages"] = _with("ei", **_STORED, **kept) + " UNION ALL ".join(
        f"SELECT '{part}' AS part, symbol, {_TICK_TEXT} FROM {rows}" for part, rows in parts.items()
    )
    parts = {
        "page": f"(SELECT * FROM ({_candles('stored', '1d')}) WHERE symbol IN ('click', 'purchase', 'view') ORDER BY symbol, b LIMIT 20 OFFSET 20)",
        "latest": f"({_candles('stored', '1w')} ORDER BY b DESC, symbol LIMIT 9)",
        "latest jalali": f"(SELECT * FROM ({_candles('stored', '1d')}) WHERE calendar = 'jalali' ORDER BY b DESC, symbol LIMIT 3)",
    }
    sql["stored_candle_pages"] = _with("nz", "ei", **_STORED) + " UNION ALL ".join(
        f"SELECT '{part}' AS part, {_PLAIN}, calendar, {_BUCKET_TEXT} AS bucket_start, {_labels('b', jalali_only)} FROM {rows}"
        for part, rows in parts.items()
    )
    sql["expired_ticks"] = _with("ei", "ev") + f"""
        SELECT symbol, count(*) AS ticks, {_MILLIS.format('min(ts)')} AS oldest FROM ev
        WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY symbol"""
    sql["old_tick_count"] = "SELECT count(*) AS old_ticks FROM events WHERE ts < TIMESTAMP '2024-01-25'"
    sql["delete_symbols"] = _with(
        "nz", "li", "debtors",
        kept="SELECT * FROM li WHERE batch_id > 3 OR symbol NOT IN (SELECT symbol FROM debtors)",
    ) + _all("kept", "1y")
    gone = "SELECT * FROM li WHERE symbol IN (SELECT symbol FROM debtors)"
    suffix = {GREGORIAN: "greg", JALALI: "jalali"}
    tables = {"ticks": "SELECT count(*) AS c FROM gone", "symbols": "SELECT count(DISTINCT symbol) FROM gone"}
    for calendar in CALENDARS:
        only = f"calendar = '{calendar}'"
        for tf in TIMEFRAMES:
            tables[f"candles_{tf}_{suffix[calendar]}"] = f"SELECT count(*) FROM ({_candles('gone', tf, only)})"
    counts = " UNION ALL ".join(f"SELECT '{name}' AS name, ({sub}) AS rows" for name, sub in tables.items())
    sql["delete_summary"] = _with("nz", "li", "debtors", gone=gone) + f"""
        SELECT name, rows, CASE WHEN rows = 0 THEN 'no-op' WHEN name = 'symbols' THEN 'deleted' ELSE 'dropped' END
            AS outcome FROM ({counts})"""
    return sql
