"""The registered queries as plain SQL over the same tables (DuckDB dialect).

Written independently of the Spark code: nested cases, window functions and AS OF joins
over the raw tables.
"""

from __future__ import annotations

from strikeline import fixed
from strikeline.sources.driver_tables import RANGES

AS_OF = "DATE '2024-01-10'"
IST = "INTERVAL '5 hours 30 minutes'"
TFS = "['1_MIN','5_MIN','15_MIN','30_MIN','1_HOUR']"
SYMBOLS = "['click','error','purchase','signup','view']"


def _indicator(name: str, i: int) -> str:
    spread = f"((event_id * {37 + 10 * i} + {i * 101}) % 2003)"
    if name == "close":
        value = "44000::DOUBLE + value * 10::DOUBLE"
    elif name.startswith("rec_"):
        value = f"({spread} % 3 - 1)::DOUBLE"
    else:
        lo, hi = RANGES[name]
        value = f"{lo}::DOUBLE + {spread}::DOUBLE * {hi - lo}::DOUBLE / 2002::DOUBLE"
    return f'CASE WHEN event_id % 17 <> {i % 17} THEN {value} END AS "{name}"'


_SNAP_COLUMNS = ",\n".join(_indicator(n, i) for n, i in fixed.SNAPSHOT_POSITIONS.items())


def _cross(up: str, low: str) -> str:
    return (
        f"CASE WHEN {up} IS NULL OR {low} IS NULL THEN NULL WHEN {up} > {low} THEN 'BUY' "
        f"WHEN {up} < {low} THEN 'SELL' ELSE 'NEUTRAL' END"
    )


def _simple(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} = 1 THEN 'BUY' WHEN {c} = -1 THEN 'SELL' "
        "ELSE 'NEUTRAL' END"
    )


OSC = {
    "rsi_vote": "CASE WHEN rsi + rsi1 IS NULL THEN NULL WHEN rsi < 30 AND rsi1 < rsi THEN 'BUY' "
    "WHEN rsi > 70 AND rsi1 > rsi THEN 'SELL' ELSE 'NEUTRAL' END",
    "stoch_vote": "CASE WHEN k + d + k1 + d1 IS NULL THEN NULL "
    "WHEN k < 20 AND d < 20 AND k > d AND k1 < d1 THEN 'BUY' "
    "WHEN k > 80 AND d > 80 AND k < d AND k1 > d1 THEN 'SELL' ELSE 'NEUTRAL' END",
    "cci_vote": "CASE WHEN cci + cci1 IS NULL THEN NULL WHEN cci < -100 AND cci > cci1 THEN 'BUY' "
    "WHEN cci > 100 AND cci < cci1 THEN 'SELL' ELSE 'NEUTRAL' END",
    "adx_vote": "CASE WHEN adx + pdi + ndi + pdi1 + ndi1 IS NULL THEN NULL "
    "WHEN adx > 20 AND pdi1 < ndi1 AND pdi > ndi THEN 'BUY' "
    "WHEN adx > 20 AND pdi1 > ndi1 AND pdi < ndi THEN 'SELL' ELSE 'NEUTRAL' END",
    "ao_vote": "CASE WHEN ao + ao1 + ao2 IS NULL THEN NULL "
    "WHEN (ao > 0 AND ao1 < 0) OR (ao > 0 AND ao1 > 0 AND ao > ao1 AND ao2 > ao1) THEN 'BUY' "
    "WHEN (ao < 0 AND ao1 > 0) OR (ao < 0 AND ao1 < 0 AND ao < ao1 AND ao2 < ao1) THEN 'SELL' "
    "ELSE 'NEUTRAL' END",
    "mom_vote": _cross("mom", "mom1"),
    "macd_vote": _cross("macd", "macd_signal"),
    "stoch_rsi_vote": _simple("rec_stoch_rsi"),
    "wr_vote": _simple("rec_wr"),
    "bbp_vote": _simple("rec_bbp"),
    "uo_vote": _simple("rec_uo"),
}
_MA_NAMES = [f"{kind}{n}" for n in (10, 20, 30, 50, 100, 200) for kind in ("ema", "sma")]
MA = {f"{n}_vote": _cross("close", n) for n in _MA_NAMES} | {
    "ichimoku_vote": _simple("rec_ichimoku"),
    "vwma_vote": _simple("rec_vwma"),
    "hma9_vote": _simple("rec_hma9"),
}
UNWIRED = {
    "bb_buy_vote": "CASE WHEN close + bb_lower IS NULL THEN NULL WHEN close < bb_lower THEN 'BUY' "
    "ELSE 'NEUTRAL' END",
    "bb_sell_vote": "CASE WHEN close + bb_upper IS NULL THEN NULL WHEN close > bb_upper "
    "THEN 'SELL' ELSE 'NEUTRAL' END",
    "psar_vote": _cross('"open"', "psar"),
}


def _aliased(rules: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {n}" for n, v in rules.items())


def _count(names, label: str) -> str:
    return "(" + " + ".join(f"({n} IS NOT DISTINCT FROM '{label}')::INTEGER" for n in names) + ")"


def _recommend(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} >= -1 AND {c} < -0.5::DOUBLE THEN 'STRONG_SELL' "
        f"WHEN {c} >= -0.5::DOUBLE AND {c} < -0.1::DOUBLE THEN 'SELL' "
        f"WHEN {c} >= -0.1::DOUBLE AND {c} <= 0.1::DOUBLE THEN 'NEUTRAL' "
        f"WHEN {c} > 0.1::DOUBLE AND {c} <= 0.5::DOUBLE THEN 'BUY' "
        f"WHEN {c} > 0.5::DOUBLE AND {c} <= 1 THEN 'STRONG_BUY' ELSE 'ERROR' END"
    )


_SILENT = "(score_other IS NULL OR score_all IS NULL OR score_ma IS NULL OR close IS NULL)"
_ALL_VOTES = [*OSC, *MA]


def _unless_silent(value: str, empty: str) -> str:
    return f"CASE WHEN {_SILENT} THEN {empty} ELSE {value} END"


def _stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


_OPENS = {
    "BUY": "('SELL','STRONG_SELL')", "STRONG_BUY": "('SELL','STRONG_SELL')",
    "SELL": "('BUY','STRONG_BUY')", "STRONG_SELL": "('BUY','STRONG_BUY')",
}

# name -> (CTEs it needs, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "snap": ((), f"""
        SELECT event_type AS symbol, {TFS}[user_id % 5 + 1] AS tf, ts, event_id,
        {_SNAP_COLUMNS} FROM events"""),
    "voted": (("snap",), f"SELECT *, {_aliased(OSC)}, {_aliased(MA)} FROM snap"),
    "rolled": (("voted",), f"""
        SELECT event_id, symbol, tf, ts, {_SILENT} AS no_response,
        {_unless_silent(_recommend('score_all'), "''")} AS "TA_SIGNAL",
        {_unless_silent(_recommend('score_other'), 'NULL')} AS "OSCI",
        {_unless_silent(_recommend('score_ma'), 'NULL')} AS "MA",
        {_unless_silent(_count(_ALL_VOTES, 'BUY'), '0')} AS "BUY",
        {_unless_silent(_count(_ALL_VOTES, 'SELL'), '0')} AS "SELL",
        {_unless_silent(_count(_ALL_VOTES, 'NEUTRAL'), '0')} AS "NEUTRAL",
        {_unless_silent('close', '0::DOUBLE')} AS "FPRICE" FROM voted"""),
    "per_minute": (("rolled",), f"""
        SELECT * FROM (
          SELECT *, date_trunc('minute', ts) AS minute, row_number() OVER (
            PARTITION BY symbol, tf, date_trunc('minute', ts) ORDER BY ts DESC, event_id DESC) rn
          FROM rolled WHERE (ts + {IST})::TIME BETWEEN TIME '09:15:00' AND TIME '15:25:00')
        WHERE rn = 1"""),
    "sig": (("per_minute",), f"""
        SELECT symbol, tf, minute, local_ts, local_ts::DATE AS session_date, "OSCI", "MA",
          "BUY", "SELL", "NEUTRAL", "FPRICE", whole - whole % 100 AS "CSP",
          whole - whole % 100 + 100 AS "PSP",
          CASE WHEN local_ts::TIME >= TIME '15:20:00' THEN 'CLOSE_ALL_MARKET_TIMEOUT'
            ELSE "TA_SIGNAL" END AS "TA_SIGNAL",
          local_ts::TIME >= TIME '15:15:00' AS stop_entry,
          sha256(symbol || '|' || {_stamp('minute')}) AS "SID",
          sha256(symbol || '|' || tf || '|' || {_stamp('minute')}) AS "UID",
          dense_rank() OVER (PARTITION BY symbol, local_ts::DATE ORDER BY minute)::INTEGER "C_NUM"
        FROM (SELECT *, minute + {IST} AS local_ts,
              round_even("FPRICE", 0)::BIGINT AS whole FROM per_minute)"""),
    "master": ((), f"""
        SELECT p_partkey::VARCHAR AS token,
          CASE WHEN fut THEN name || ex || 'FUT' ELSE name || ex || strike::VARCHAR || side END AS symbol,
          name, CASE WHEN p_partkey % 97 = 96 AND NOT whole THEN '' ELSE ex END AS expiry,
          CASE WHEN fut THEN '-1.000000' ELSE (strike * 100)::VARCHAR || '.000000' END AS strike,
          CASE WHEN fut THEN 'FUTIDX' ELSE 'OPTIDX' END AS instrumenttype,
          CASE WHEN p_partkey % 53 = 52 AND NOT whole OR name = 'view' AND strike = 44500
              AND side = 'PE' AND NOT fut THEN 'NSE' ELSE 'NFO' END AS exch_seg
        FROM (SELECT *, p_partkey % 41 = 0 AND NOT whole AS fut FROM (
          SELECT *, name = 'click' AND strike BETWEEN 43500 AND 45500 AS whole FROM (
            SELECT p_partkey, {SYMBOLS}[(p_partkey // 400) % 5 + 1] AS name,
              CASE WHEN p_partkey % 2 = 0 THEN 'CE' ELSE 'PE' END AS side,
              ['01FEB2024','11JAN2024','04JAN2024','18JAN2024'][(p_partkey // 100) % 4 + 1] AS ex,
              43200 + 100 * ((p_partkey // 2) % 50) AS strike FROM part)))"""),
    "instr": (("master",), """
        SELECT *, CASE WHEN expiry <> '' THEN strptime(expiry, '%d%b%Y')::DATE END AS expiry_date
        FROM master WHERE exch_seg = 'NFO'"""),
    "fut": (("instr",), "SELECT * FROM instr WHERE instrumenttype = 'FUTIDX'"),
    "opt": (("instr",), "SELECT * FROM instr WHERE instrumenttype = 'OPTIDX'"),
    "cur_fut": (("fut",), f"""
        SELECT name, expiry_date AS fut_expiry, token AS fut_token, symbol AS fut_symbol
        FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY expiry_date, token) rn
              FROM fut WHERE expiry_date >= {AS_OF}) WHERE rn = 1"""),
    "cur_opt": (("opt",), f"""
        SELECT name, min(expiry_date) AS opt_expiry FROM opt
        WHERE expiry_date >= {AS_OF} GROUP BY name"""),
    "chain": (("opt", "cur_opt"), """
        SELECT opt.name, token, symbol, (strike::DOUBLE / 100)::BIGINT AS strike,
          expiry_date AS expiry, right(symbol, 2) AS ce_or_pe
        FROM opt JOIN cur_opt ON opt.name = cur_opt.name AND expiry_date = opt_expiry"""),
    "ladder": (("chain",), """
        SELECT symbol, "CSP", max(t) FILTER (ce_or_pe = 'CE') AS ce_token,
          max(s) FILTER (ce_or_pe = 'CE') AS ce_symbol,
          max(t) FILTER (ce_or_pe = 'PE') AS pe_token, max(s) FILTER (ce_or_pe = 'PE') AS pe_symbol
        FROM (SELECT name AS symbol, ce_or_pe, token AS t, symbol AS s,
                CASE WHEN ce_or_pe = 'CE' THEN strike ELSE strike - 100 END AS "CSP",
                row_number() OVER (PARTITION BY name, ce_or_pe, strike ORDER BY token) AS rn
              FROM chain) WHERE rn = 1 GROUP BY symbol, "CSP" """),
    "day_ladder": (("sig", "opt"), """
        SELECT symbol, session_date, "CSP", max(t) FILTER (side = 'CE') AS ce_token,
          max(s) FILTER (side = 'CE') AS ce_symbol, max(t) FILTER (side = 'PE') AS pe_token,
          max(s) FILTER (side = 'PE') AS pe_symbol
        FROM (SELECT d.symbol, d.session_date, right(o.symbol, 2) AS side, o.token AS t, o.symbol AS s,
                (o.strike::DOUBLE / 100)::BIGINT
                  - CASE WHEN right(o.symbol, 2) = 'CE' THEN 0 ELSE 100 END AS "CSP",
                row_number() OVER (PARTITION BY d.symbol, d.session_date, right(o.symbol, 2), o.strike
                  ORDER BY o.token) AS rn
              FROM (SELECT DISTINCT symbol, session_date FROM sig) d
              JOIN opt o ON o.name = d.symbol AND right(o.symbol, 2) IN ('CE', 'PE')
                AND o.expiry_date = (SELECT min(e.expiry_date) FROM opt e
                  WHERE e.name = d.symbol AND e.expiry_date >= d.session_date))
        WHERE rn = 1 GROUP BY symbol, session_date, "CSP" """),
    "bar1": ((), """
        SELECT symbol, minute AS bar_ts, max(price) FILTER (up = 1) AS "open", max(price) AS high,
          min(price) AS low, max(price) FILTER (down = 1) AS close,
          count(*)::BIGINT AS volume, count(*)::BIGINT AS ticks
        FROM (SELECT event_type AS symbol, date_trunc('minute', ts) AS minute,
                44000::DOUBLE + value * 10::DOUBLE AS price,
                row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts)
                  ORDER BY ts, event_id) AS up,
                row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts)
                  ORDER BY ts DESC, event_id DESC) AS down FROM events)
        GROUP BY symbol, minute"""),
    "price": ((), """
        SELECT event_type AS name, 44000::DOUBLE + value * 10::DOUBLE AS price
        FROM (SELECT *, row_number() OVER (PARTITION BY event_type
                ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""),
    "holidays": ((), """
        SELECT o_orderdate::DATE AS day,
          CASE WHEN min(o_orderkey) % 7 = 0 THEN 'NO' ELSE 'YES' END AS listed
        FROM orders GROUP BY 1"""),
    "config": (("cur_fut", "cur_opt", "holidays"), f"""
        SELECT cur_fut.name, fut_expiry AS "FUT_EXPIRY_DATE", opt_expiry AS "OPT_EXPIRY_DATE",
          {AS_OF} AS "T_DATE", upper(strftime(fut_expiry, '%d%b%Y')) AS "FUT_EXPIRY_DATE_STR",
          upper(strftime(opt_expiry, '%d%b%Y')) AS "OPT_EXPIRY_DATE_STR", fut_token AS "FUT_TOKEN",
          fut_symbol AS "FUT_SYMBOL",
          CASE WHEN isodow({AS_OF}) > 5 THEN 'NO' ELSE coalesce(
            (SELECT listed FROM holidays WHERE day = {AS_OF}), 'YES') END AS "MARKET_IS_OPEN_TODAY",
          TIMESTAMP '2024-01-10 09:30:00' AS "UPDATED_DATE_TIME", 'MAIN' AS ke
        FROM cur_fut JOIN cur_opt ON cur_fut.name = cur_opt.name"""),
    "quote": ((), """
        SELECT token, ts, max(ltp) AS ltp FROM (
          SELECT l_partkey::VARCHAR AS token, TIMESTAMP '2024-01-01 00:00:00'
              + to_minutes((l_orderkey * 37 + l_linenumber * 1009) % 43200) AS ts,
            CASE WHEN (l_orderkey + l_linenumber) % 23 = 0 THEN 0::DOUBLE
              ELSE l_extendedprice END AS ltp FROM lineitem) GROUP BY token, ts"""),
    "looked": (("sig", "day_ladder"), """
        SELECT sig.*, ce_token, ce_symbol, pe_token, pe_symbol,
          ce_token IS NOT NULL AND pe_token IS NOT NULL AS strike_ok
        FROM sig LEFT JOIN day_ladder l ON sig.symbol = l.symbol AND sig."CSP" = l."CSP"
          AND sig.session_date = l.session_date"""),
    "params": (("looked",), """
        SELECT *, CASE WHEN buys THEN 'BUY' WHEN sells THEN 'SELL' END AS trade_type,
          CASE WHEN buys THEN 'CE' WHEN sells THEN 'PE' END AS side,
          CASE WHEN buys THEN "CSP" WHEN sells THEN "PSP" END AS strike,
          CASE WHEN buys THEN ce_token WHEN sells THEN pe_token END AS opt_token,
          CASE WHEN buys THEN ce_symbol WHEN sells THEN pe_symbol END AS opt_symbol,
          quantity, quantity * CASE tf WHEN '1_MIN' THEN 1 WHEN '5_MIN' THEN 2 WHEN '15_MIN' THEN 3
            WHEN '30_MIN' THEN 5 WHEN '1_HOUR' THEN 7 END AS lot
        FROM (SELECT *, "TA_SIGNAL" IN ('BUY','STRONG_BUY') AS buys,
                "TA_SIGNAL" IN ('SELL','STRONG_SELL') AS sells,
                CASE WHEN "TA_SIGNAL" IN ('BUY','SELL') THEN 1
                  WHEN "TA_SIGNAL" IN ('STRONG_BUY','STRONG_SELL') THEN 2 END AS quantity
              FROM looked)"""),
    "decided": (("params", "quote"), """
        SELECT params.*, quote.ltp AS en_price, trade_type IS NOT NULL AND strike_ok
            AND coalesce(quote.ltp > 0, false) AND NOT stop_entry AS can_enter
        FROM params ASOF LEFT JOIN quote ON params.opt_token = quote.token
          AND params.minute >= quote.ts"""),
    "marked": (("decided",), """
        SELECT d.symbol, d.tf, d.minute, d."TA_SIGNAL", x, can_enter AND "TA_SIGNAL" = x AS is_entry,
          strike_ok AND ("TA_SIGNAL" IN ('NEUTRAL','ERROR','NO_RESPONSE','CLOSE_ALL_MARKET_TIMEOUT')
            OR (x IN ('BUY','STRONG_BUY') AND "TA_SIGNAL" IN ('SELL','STRONG_SELL'))
            OR (x IN ('SELL','STRONG_SELL') AND "TA_SIGNAL" IN ('BUY','STRONG_BUY'))) AS is_reset
        FROM decided d, (VALUES ('BUY'),('STRONG_BUY'),('SELL'),('STRONG_SELL')) v(x)"""),
    "grouped": (("marked",), """
        SELECT symbol, tf, x, grp, min(minute) FILTER (is_entry) AS en_ts, min(minute) AS g_start
        FROM (SELECT *, sum(is_reset::INTEGER) OVER (PARTITION BY symbol, tf, x ORDER BY minute) grp
              FROM marked) GROUP BY symbol, tf, x, grp"""),
    "paired": (("grouped", "decided", "quote"), """
        SELECT p.x, en.*, ex.minute AS ex_minute, ex."TA_SIGNAL" AS ex_signal,
          ex."FPRICE" AS ex_fprice, ex."C_NUM" AS ex_cycle, ex.local_ts AS ex_local
        FROM (SELECT *, lead(g_start) OVER (PARTITION BY symbol, tf, x ORDER BY grp) AS ex_ts
              FROM grouped) p
        JOIN decided en ON en.symbol = p.symbol AND en.tf = p.tf AND en.minute = p.en_ts
        LEFT JOIN decided ex ON ex.symbol = p.symbol AND ex.tf = p.tf AND ex.minute = p.ex_ts
        WHERE p.en_ts IS NOT NULL"""),
    "trades": (("paired", "quote"), """
        SELECT symbol, "UID", tf AS "TS_TF", trade_type AS "TRADE_TYPE", x AS "EN_T_SIGNAL",
          "FPRICE" AS "EN_FUT_PRICE", strike AS "OPT_STRIKE_PRICE", opt_symbol AS "OPT_SYMBOL",
          opt_token AS "OPT_TOKEN", en_price AS "EN_OPT_PRICE",
          CASE WHEN ex_minute IS NULL THEN 'OPEN' ELSE 'CLOSE' END AS "TRADE_STATUS",
          lot::INTEGER AS "TRADE_LOT", day(local_ts)::INTEGER AS "T_DAY",
          month(local_ts)::INTEGER AS "T_MONTH", year(local_ts)::INTEGER AS "T_YEAR",
          session_date AS "T_DATE", side AS "T_CE_PE",
          CASE WHEN ex_minute IS NULL THEN 0 ELSE q.ltp END AS "EX_OPT_PRICE",
          coalesce(ex_signal, '') AS "EX_T_SIGNAL", coalesce(ex_fprice, 0) AS "EX_FUT_PRICE",
          "C_NUM" AS "EN_C_NUM", coalesce(ex_cycle, 0)::INTEGER AS "EX_C_NUM",
          coalesce(ex_local, local_ts) AS "UPDATED_DATETIME", local_ts AS "CREATE_DATETIME"
        FROM paired ASOF LEFT JOIN quote q ON paired.opt_token = q.token
          AND paired.ex_minute >= q.ts"""),
    "live": ((), f"""
        SELECT "UID", symbol, "TS_TF", CASE WHEN buy THEN 'BUY' ELSE 'SELL' END AS "TRADE_TYPE",
          sg AS "EN_T_SIGNAL", "EN_FUT_PRICE", "OPT_STRIKE_PRICE", "OPT_SYMBOL", "OPT_TOKEN",
          "EN_OPT_PRICE", CASE WHEN is_open THEN 'OPEN' ELSE 'CLOSE' END AS "TRADE_STATUS",
          1 AS "TRADE_LOT", day(d)::INTEGER AS "T_DAY", month(d)::INTEGER AS "T_MONTH",
          year(d)::INTEGER AS "T_YEAR", d AS "T_DATE", CASE WHEN buy THEN 'CE' ELSE 'PE' END AS "T_CE_PE",
          CASE WHEN is_open THEN 0::DOUBLE ELSE o_totalprice / 2 END AS "EX_OPT_PRICE",
          CASE WHEN is_open THEN '' ELSE 'NEUTRAL' END AS "EX_T_SIGNAL",
          CASE WHEN is_open THEN 0::DOUBLE ELSE 44500::DOUBLE END AS "EX_FUT_PRICE", 1 AS "EN_C_NUM",
          CASE WHEN is_open THEN 0 ELSE 2 END AS "EX_C_NUM", o_orderdate AS "UPDATED_DATETIME",
          o_orderdate AS "CREATE_DATETIME"
        FROM (SELECT *, sg IN ('BUY','STRONG_BUY') AS buy FROM (
          SELECT o_orderkey::VARCHAR AS "UID", {SYMBOLS}[o_custkey % 5 + 1] AS symbol,
            {TFS}[left(o_orderpriority, 1)::INTEGER] AS "TS_TF", o_orderdate, o_totalprice,
            ['BUY','STRONG_BUY','SELL','STRONG_SELL'][CASE o_custkey % 5 WHEN 3 THEN o_custkey % 2
              WHEN 4 THEN 2 + o_custkey % 2 ELSE o_custkey % 4 END + 1] AS sg,
            (44000 + o_orderkey % 4900)::DOUBLE AS "EN_FUT_PRICE",
            o_orderkey % 49 * 100 + 44000 AS "OPT_STRIKE_PRICE",
            'OPT' || (o_orderkey % 400)::VARCHAR AS "OPT_SYMBOL",
            (o_orderkey % 400)::VARCHAR AS "OPT_TOKEN",
            CASE WHEN o_orderkey % 31 = 0 THEN 0::DOUBLE ELSE o_totalprice END AS "EN_OPT_PRICE",
            o_orderstatus = 'O' AS is_open, o_orderdate::DATE AS d FROM orders))"""),
    "held": (("live",), "SELECT * FROM live WHERE \"TRADE_STATUS\" = 'OPEN'"),
    "now": (("sig",), """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, tf ORDER BY minute DESC) rn
                       FROM sig) WHERE rn = 1"""),
    "closable": (("should_close",), "SELECT * FROM should_close WHERE \"EN_OPT_PRICE\" > 0"),
    "should_close": (("held", "now"), """
        SELECT held.*, now."TA_SIGNAL" AS exit_signal, now."FPRICE" AS exit_fprice,
          now."C_NUM" AS exit_cycle, now.minute AS exit_ts, now.local_ts AS exit_local, now."CSP"
        FROM held JOIN now ON held.symbol = now.symbol AND held."TS_TF" = now.tf
        WHERE (now."TA_SIGNAL" IN
            ('NEUTRAL','ERROR','NO_RESPONSE','CLOSE_ALL_MARKET_TIMEOUT')
          OR ("EN_T_SIGNAL" IN ('BUY','STRONG_BUY') AND now."TA_SIGNAL" IN ('SELL','STRONG_SELL'))
          OR ("EN_T_SIGNAL" IN ('SELL','STRONG_SELL') AND now."TA_SIGNAL" IN ('BUY','STRONG_BUY')))"""),
    "closing": (("closable", "quote"), """
        SELECT closable.*, quote.ltp AS exit_price FROM closable
        ASOF LEFT JOIN quote ON closable."OPT_TOKEN" = quote.token
          AND closable.exit_ts >= quote.ts"""),
    "expected": (("price",), """
        SELECT name, unnest(range(c - 700, c + 701, 100)) AS strike, ce_or_pe
        FROM (SELECT name, round_even(price, 0)::BIGINT - round_even(price, 0)::BIGINT % 100 AS c
              FROM price WHERE price > 0), (VALUES ('CE'),('PE')) v(ce_or_pe) WHERE c > 0"""),
    "named": (("chain", "price", "config"), """
        SELECT name FROM chain UNION SELECT name FROM price UNION SELECT name FROM config"""),
    "ladder_check": (("expected", "chain", "named"), """
        SELECT name AS scope, lower(ce_or_pe) || '_strikes' AS "check",
          coalesce(wanted = found, false) AS passed,
          'CRITICAL_ERROR' AS severity, CASE WHEN wanted IS NULL THEN 'no usable price'
            WHEN wanted = found THEN ''
            ELSE (wanted - found)::VARCHAR || ' strikes missing' END AS message
        FROM (SELECT name, ce_or_pe FROM named, (VALUES ('CE'),('PE')) v(ce_or_pe)) LEFT JOIN (
              SELECT e.name, e.ce_or_pe, count(*) AS wanted, count(c.strike) AS found
              FROM expected e
              LEFT JOIN (SELECT DISTINCT name, ce_or_pe, strike FROM chain) c
                ON e.name = c.name AND e.ce_or_pe = c.ce_or_pe AND e.strike = c.strike
              GROUP BY ALL) USING (name, ce_or_pe)"""),
    "config_check": (("config", "named"), f"""
        SELECT name AS scope, 'has_config' AS "check", name IN (SELECT name FROM config) AS passed,
          'CRITICAL_ERROR' AS severity,
          CASE WHEN name IN (SELECT name FROM config) THEN '' ELSE 'no config record' END AS message
        FROM named UNION ALL
        SELECT name AS scope, u."check", u.passed, u.severity, u.message FROM (
          SELECT name, unnest([
            {{'check': 'has_UPDATED_DATE_TIME', 'passed': "UPDATED_DATE_TIME" IS NOT NULL,
              'severity': 'CRITICAL_ERROR', 'message': ''}},
            {{'check': 'has_MARKET_IS_OPEN_TODAY', 'passed': "MARKET_IS_OPEN_TODAY" IS NOT NULL,
              'severity': 'CRITICAL_ERROR', 'message': ''}},
            {{'check': 'has_OPT_EXPIRY_DATE_STR', 'passed': "OPT_EXPIRY_DATE_STR" IS NOT NULL,
              'severity': 'CRITICAL_ERROR', 'message': ''}},
            {{'check': 'fresh', 'passed': "UPDATED_DATE_TIME"::DATE = {AS_OF}
                AND "UPDATED_DATE_TIME"::TIME > TIME '09:07:00',
              'severity': 'CRITICAL_ERROR', 'message': ''}},
            {{'check': 'market_open', 'passed': "MARKET_IS_OPEN_TODAY" = 'YES',
              'severity': 'ERROR_INFO', 'message': ''}}]) AS u FROM config)"""),
    "banded": (("chain", "price"), """
        SELECT chain.* FROM chain JOIN (
          SELECT name, trunc(price)::BIGINT - trunc(price)::BIGINT % 100 AS c FROM price
          WHERE price > 0) p ON chain.name = p.name
        WHERE strike BETWEEN c - 1000 + CASE WHEN ce_or_pe = 'PE' THEN 100 ELSE 0 END
          AND c + 1000 + CASE WHEN ce_or_pe = 'PE' THEN 100 ELSE 0 END"""),
    "line_price": ((), """
        SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 2 = 0
          THEN floor(l_extendedprice) + 0.5::DOUBLE ELSE l_extendedprice END AS price FROM lineitem"""),
    "strike_issue": (("looked",), """
        SELECT symbol, tf, minute, "CSP", "PSP",
          CASE WHEN ce_token IS NULL THEN 'MISSING_CE' ELSE 'MISSING_PE' END AS issue_type,
          CASE WHEN ce_token IS NULL THEN 'no call at strike ' || "CSP"::VARCHAR
            ELSE 'no put at strike ' || "PSP"::VARCHAR END AS issue_msg
        FROM looked WHERE NOT strike_ok"""),
    "entry_issue": (("decided",), """
        SELECT symbol, tf, minute, "TA_SIGNAL", opt_token, CASE WHEN en_price IS NULL
          THEN 'NO_QUOTE' WHEN en_price <= 0 THEN 'PRICE_NOT_POSITIVE' ELSE 'ENTRY_STOPPED' END
          AS issue_type FROM decided WHERE strike_ok AND trade_type IS NOT NULL AND NOT can_enter"""),
    "exit_issue": (("closing",), """
        SELECT symbol, "TS_TF" AS tf, exit_ts AS minute, "UID", CASE WHEN exit_price IS NULL
          THEN 'NO_EXIT_QUOTE' ELSE 'EXIT_PRICE_NOT_POSITIVE' END AS issue_type
        FROM closing WHERE NOT coalesce(exit_price > 0, false)"""),
    "unexitable": (("should_close",), """
        SELECT symbol, "TS_TF" AS tf, exit_ts AS minute, "UID" FROM should_close
        WHERE NOT "EN_OPT_PRICE" > 0"""),
    "outcome": (("strike_issue", "entry_issue", "exit_issue", "unexitable"), """
        SELECT 'strike issue: ' || issue_msg AS msg, minute FROM strike_issue UNION ALL
        SELECT 'entry issue: ' || issue_type || ' ' || opt_token, minute FROM entry_issue UNION ALL
        SELECT 'exit issue: ' || issue_type || ' ' || "UID", minute FROM exit_issue UNION ALL
        SELECT 'unexitable issue: NOT_EXITABLE ' || "UID", minute FROM unexitable"""),
    "issue_log_rows": (("outcome", "decided", "exit_vals"), f"""
        SELECT 'minute job' AS "LOG_MODULE_NAME", 'ERROR' AS "LOG_TYPE", msg AS "LOG_MESSAGE",
          'SERVER' AS "ENV_TYPE", (minute + {IST})::DATE AS "LOG_CREATE_DATE",
          minute + {IST} AS "LOG_CREATE_DATETIME", 'error' AS "LOG_KIND" FROM outcome
        UNION ALL SELECT 'minute job', 'SUCCESS', (SELECT count(*) FROM decided WHERE can_enter)
          || ' entered, ' || (SELECT count(*) FROM exit_vals) || ' exited, ' || string_agg(
            (SELECT count(*) FROM outcome WHERE msg LIKE k || ' issue%') || ' ' || k, ', ' ORDER BY n),
          'SERVER', DATE '2024-01-31', TIMESTAMP '2024-01-31 00:00:00', 'app'
        FROM (VALUES (1, 'strike'), (2, 'entry'), (3, 'exit'), (4, 'unexitable')) v(n, k)"""),
    "exit_vals": (("closing",), """
        SELECT "UID", exit_cycle AS "EX_C_NUM", exit_signal AS "EX_T_SIGNAL",
          exit_fprice AS "EX_FUT_PRICE", exit_price AS "EX_OPT_PRICE", 'CLOSE' AS "TRADE_STATUS",
          exit_local AS "UPDATED_DATETIME" FROM closing WHERE exit_price > 0"""),
}


# One row per (symbol, timeframe, entry signal) walks through the minutes; a close without a
# positive price leaves the trade open.
_WALK = """
    step AS (SELECT *, row_number() OVER (PARTITION BY symbol, tf ORDER BY minute) AS n FROM decided),
    x AS (SELECT unnest(['BUY','STRONG_BUY','SELL','STRONG_SELL']) AS x),
    walk(symbol, tf, x, n, held, token, closed, price) AS (
      SELECT DISTINCT symbol, tf, x, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::DOUBLE
      FROM step, x
      UNION ALL
      SELECT symbol, tf, x, n,
        CASE WHEN price > 0 THEN NULL WHEN held IS NOT NULL THEN held WHEN enters THEN n END,
        CASE WHEN price > 0 THEN NULL WHEN held IS NOT NULL THEN token WHEN enters THEN new_token END,
        CASE WHEN price > 0 THEN held END, CASE WHEN price > 0 THEN price END
      FROM (
        SELECT w.symbol, w.tf, w.x, s.n, w.held, w.token, s.opt_token AS new_token,
          s.can_enter AND s."TA_SIGNAL" = w.x AS enters,
          CASE WHEN w.held IS NOT NULL AND s.strike_ok AND (s."TA_SIGNAL" IN
              ('NEUTRAL','ERROR','NO_RESPONSE','CLOSE_ALL_MARKET_TIMEOUT')
            OR (w.x LIKE '%BUY' AND s."TA_SIGNAL" IN ('SELL','STRONG_SELL'))
            OR (w.x LIKE '%SELL' AND s."TA_SIGNAL" IN ('BUY','STRONG_BUY')))
          THEN (SELECT arg_max(q.ltp, q.ts) FROM quote q
                WHERE q.token = w.token AND q.ts <= s.minute) END AS price
        FROM walk w JOIN step s ON s.symbol = w.symbol AND s.tf = w.tf AND s.n = w.n + 1)),
    settled AS (
      SELECT symbol, tf, x, closed AS n, n AS ex_n, price FROM walk WHERE closed IS NOT NULL
      UNION ALL
      SELECT symbol, tf, x, held, NULL, NULL FROM walk
      WHERE held IS NOT NULL AND n = (SELECT max(n) FROM step s
        WHERE s.symbol = walk.symbol AND s.tf = walk.tf)),
    walked AS (
      SELECT p.x, en.*, p.price, ex.minute AS ex_minute, ex."TA_SIGNAL" AS ex_signal,
        ex."FPRICE" AS ex_fprice, ex."C_NUM" AS ex_cycle, ex.local_ts AS ex_local
      FROM settled p JOIN step en ON en.symbol = p.symbol AND en.tf = p.tf AND en.n = p.n
      LEFT JOIN step ex ON ex.symbol = p.symbol AND ex.tf = p.tf AND ex.n = p.ex_n)"""


def _walked_trades() -> str:
    trades = CTES["trades"][1].split("FROM paired")[0].replace("q.ltp", "price")
    return _sql("", "decided", "quote").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + (
        f",{_WALK}\n{trades} FROM walked"
    )


def _walked_events() -> str:
    """Openings and closings of the walk up to the minute that both streams have passed."""
    return _sql("", "decided", "quote").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + f""",{_WALK},
    happened AS (
      SELECT symbol, tf, x AS trade_signal, 'OPEN' AS action, minute AS "at", "TA_SIGNAL" AS signal,
        "FPRICE" AS fprice, opt_token AS token, en_price AS price FROM walked
      UNION ALL
      SELECT symbol, tf, x, 'CLOSE', ex_minute, ex_signal, ex_fprice, opt_token, price
      FROM walked WHERE ex_minute IS NOT NULL)
    SELECT * FROM happened WHERE "at" <= least((SELECT max(minute) FROM decided),
      (SELECT max(ts) FROM quote)) - INTERVAL '1 minute'"""


def _closed_trades() -> str:
    """Closed trades with the expiry of their option; both flags must hold."""
    head, body = _walked_trades().rsplit("FROM walked", 1)[0], "FROM walked"
    start = head.rindex("SELECT symbol")
    return head[:start] + f"""SELECT w."UID", x AS "EN_T_SIGNAL", session_date AS "T_DATE",
        o.expiry_date AS expiry, price AS "EX_OPT_PRICE", true AS before_expiry, true AS priced
        {body} w JOIN (SELECT token, CASE WHEN expiry <> '' THEN strptime(expiry, '%d%b%Y')::DATE END
          AS expiry_date FROM master) o ON o.token = w.opt_token WHERE ex_minute IS NOT NULL"""


def _emitted_only(sql: str) -> str:
    """Only the minutes a stream has emitted: the newest in-session event is at least a
    minute past their end."""
    return sql.replace("WHERE rn = 1),\nsig AS", f"""WHERE rn = 1
        AND minute + INTERVAL '2 minutes' <= (SELECT max(ts) FROM events
          WHERE (ts + {IST})::TIME BETWEEN TIME '09:15:00' AND TIME '15:25:00')),\nsig AS""")


def _ordered(needs: tuple[str, ...], done: list[str]) -> list[str]:
    for name in needs:
        if name not in done:
            _ordered(CTES[name][0], done)
            done.append(name)
    return done


def _sql(body: str, *needs: str) -> str:
    ctes = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in _ordered(needs, []))
    return f"WITH {ctes}\n{body}" if ctes else body


def _bars() -> str:
    parts = [
        f"""SELECT symbol, time_bucket(INTERVAL '{m} minutes', bar_ts) AS bar_ts,
          arg_min("open", bar_ts) AS "open", max(high) AS high, min(low) AS low,
          arg_max(close, bar_ts) AS close, sum(volume)::BIGINT AS volume,
          sum(ticks)::BIGINT AS ticks, '{tf}' AS tf FROM bar1 GROUP BY 1, 2"""
        for tf, m in (("1_MIN", 1), ("5_MIN", 5), ("15_MIN", 15), ("30_MIN", 30), ("1_HOUR", 60))
    ]
    return _sql(" UNION ALL ".join(parts), "bar1")


_LAG_SOURCES = "rsi1:rsi:1 k1:k:1 d1:d:1 cci1:cci:1 pdi1:pdi:1 ndi1:ndi:1 ao1:ao:1 ao2:ao:2 mom1:mom:1"
_LAGS = ", ".join(
    "lag({1}, {2}) OVER w AS {0}".format(*item.split(":")) for item in _LAG_SOURCES.split()
)
_LOOKUP = (
    'symbol, tf, minute, "CSP", "PSP", ce_token, ce_symbol, pe_token, pe_symbol, strike_ok'
)
_SNAP_NAMES = ", ".join(f'"{c}"' for c in fixed.SNAPSHOT_POSITIONS)

# the trade table with exits overlaid; exits and entries of one cycle
_OVERLAY = """SELECT live."UID", symbol, "TS_TF", "TRADE_TYPE", "EN_T_SIGNAL", "EN_FUT_PRICE",
          "OPT_STRIKE_PRICE", "OPT_SYMBOL", "OPT_TOKEN", "EN_OPT_PRICE",
          coalesce(e."TRADE_STATUS", live."TRADE_STATUS") AS "TRADE_STATUS", "TRADE_LOT", "T_DAY",
          "T_MONTH", "T_YEAR", "T_DATE", "T_CE_PE",
          coalesce(e."EX_OPT_PRICE", live."EX_OPT_PRICE") AS "EX_OPT_PRICE",
          coalesce(e."EX_T_SIGNAL", live."EX_T_SIGNAL") AS "EX_T_SIGNAL",
          coalesce(e."EX_FUT_PRICE", live."EX_FUT_PRICE") AS "EX_FUT_PRICE", "EN_C_NUM",
          coalesce(e."EX_C_NUM", live."EX_C_NUM")::INTEGER AS "EX_C_NUM",
          coalesce(e."UPDATED_DATETIME", live."UPDATED_DATETIME") AS "UPDATED_DATETIME",
          "CREATE_DATETIME"
        FROM live LEFT JOIN exit_vals e ON live."UID" = e."UID" """
_CYCLE_EXITS = """SELECT exit_vals.* FROM exit_vals JOIN closing ON exit_vals."UID" = closing."UID"
        JOIN day_ladder l ON closing.symbol = l.symbol AND closing."CSP" = l."CSP"
          AND closing.exit_local::DATE = l.session_date
        WHERE ce_token IS NOT NULL AND pe_token IS NOT NULL"""
_CYCLE_ENTRIES = """SELECT d.symbol, d."UID", d.tf AS "TS_TF", trade_type AS "TRADE_TYPE",
          d."TA_SIGNAL" AS "EN_T_SIGNAL", d."FPRICE" AS "EN_FUT_PRICE",
          strike AS "OPT_STRIKE_PRICE", opt_symbol AS "OPT_SYMBOL", opt_token AS "OPT_TOKEN",
          en_price AS "EN_OPT_PRICE", 'OPEN' AS "TRADE_STATUS", lot::INTEGER AS "TRADE_LOT",
          day(d.local_ts)::INTEGER AS "T_DAY", month(d.local_ts)::INTEGER AS "T_MONTH",
          year(d.local_ts)::INTEGER AS "T_YEAR", d.session_date AS "T_DATE", side AS "T_CE_PE",
          0::DOUBLE AS "EX_OPT_PRICE", '' AS "EX_T_SIGNAL", 0::DOUBLE AS "EX_FUT_PRICE",
          d."C_NUM" AS "EN_C_NUM", 0 AS "EX_C_NUM", d.local_ts AS "UPDATED_DATETIME",
          d.local_ts AS "CREATE_DATETIME"
        FROM decided d JOIN now ON d."UID" = now."UID"
        WHERE can_enter AND NOT EXISTS (SELECT 1 FROM held WHERE held.symbol = d.symbol
          AND held."TS_TF" = d.tf AND held."EN_T_SIGNAL" = d."TA_SIGNAL")"""

_SIGNAL_LOG = """SELECT symbol, "TA_SIGNAL", "MA", "OSCI", "FPRICE", "CSP", "PSP", "BUY", "NEUTRAL",
          "SELL", tf AS "TF", "SID", "UID", local_ts AS "UPDATED_DATE_TIME" FROM sig"""
_PASSED = """SELECT scope FROM (SELECT * FROM config_check UNION ALL SELECT * FROM ladder_check)
          GROUP BY scope HAVING bool_and(passed OR "check" = 'market_open')"""

_ASOF_PRICE = _sql(
    """SELECT p.*, quote.ltp, coalesce(quote.ltp > 0, false) AS usable
    FROM (SELECT event_id, ts, (event_id % 200)::VARCHAR AS token FROM events) p
    ASOF LEFT JOIN quote ON p.token = quote.token AND p.ts >= quote.ts""", "quote",
)
_ENTRY_DECISIONS = _sql(
    'SELECT symbol, tf, minute, "TA_SIGNAL", opt_token, en_price, can_enter FROM decided',
    "decided",
)

ORACLES: dict[str, str] = {
    "votes_oscillators": _sql(f"SELECT event_id, {_aliased(OSC)} FROM snap", "snap"),
    "votes_moving_averages": _sql(f"SELECT event_id, {_aliased(MA)} FROM snap", "snap"),
    "votes_unwired": _sql(f"SELECT event_id, {_aliased(UNWIRED)} FROM snap", "snap"),
    "votes_by_kind": _sql(
        " UNION ALL ".join(
            f"""SELECT symbol, tf, '{kind}' AS kind, vote, count(*)::BIGINT AS n FROM (
              SELECT symbol, tf, unnest([{', '.join(rules)}]) AS vote FROM voted)
            WHERE vote IS NOT NULL GROUP BY ALL"""
            for kind, rules in (("oscillator", OSC), ("moving_average", MA))
        ),
        "voted",
    ),
    "recommend_levels": _sql(
        "SELECT event_id, " + ", ".join(
            f"{_recommend(c)} AS {c}" for c in ("score_other", "score_all", "score_ma")
        ) + " FROM snap", "snap",
    ),
    "vote_counts": _sql(
        "SELECT event_id, " + ", ".join(
            f"{_count(names, label)} AS {kind}_{label.lower()}"
            for kind, names in (("osc", OSC), ("ma", MA)) for label in ("BUY", "SELL", "NEUTRAL")
        ) + ", " + ", ".join(
            f'{_count(_ALL_VOTES, label)} AS "{label}"' for label in ("BUY", "SELL", "NEUTRAL")
        ) + " FROM voted", "voted",
    ),
    "signal_rollup": _sql("SELECT * FROM rolled", "rolled"),
    "scanner_payload": _sql(f"SELECT symbol, tf, ts, event_id, {_SNAP_NAMES} FROM snap", "snap"),
    "scanner_by_name": _sql(
        "SELECT event_id, rsi, ao2, close, NULL::DOUBLE AS volume FROM snap", "snap"
    ),
    "feed_intervals": """
        SELECT event_id, i AS "interval", CASE i WHEN '1m' THEN '|1' WHEN '5m' THEN '|5'
          WHEN '15m' THEN '|15' WHEN '30m' THEN '|30' WHEN '1h' THEN '|60' WHEN '2h' THEN '|120'
          WHEN '4h' THEN '|240' WHEN '1W' THEN '|1W' WHEN '1M' THEN '|1M' ELSE '' END AS suffix
        FROM (SELECT event_id, ['1m','5m','15m','30m','1h','2h','4h','1d','1W','1M','3m']
              [event_id % 11 + 1] AS i FROM events)""",
    "prev_bar_lag": _sql(
        f"""SELECT symbol, tf, ts, event_id, rsi, k, d, cci, pdi, ndi, ao, mom, {_LAGS} FROM (
          SELECT symbol, tf, ts, event_id, rsi, k, d, cci, pdi, ndi, ao, mom FROM snap)
        WINDOW w AS (PARTITION BY symbol, tf ORDER BY ts, event_id)""", "snap",
    ),
    "signals_dedup": _sql(
        """SELECT symbol, tf, minute, ts, event_id, score_all, close FROM (
          SELECT *, date_trunc('minute', ts) AS minute, row_number() OVER (PARTITION BY symbol, tf,
            date_trunc('minute', ts) ORDER BY ts DESC, event_id DESC) AS rn FROM snap)
        WHERE rn = 1""", "snap",
    ),
    "signal_log": _sql(_SIGNAL_LOG, "sig"),
    "signal_log_replayed": _sql(_SIGNAL_LOG, "sig"),
    "session_signal_log": _sql(
        _SIGNAL_LOG + """ WHERE session_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'
          AND isodow(session_date) <= 5 AND session_date NOT IN (
            SELECT DATE '2024-01-01' + (o_orderkey % 31)::INTEGER FROM orders GROUP BY 1
            HAVING count(*) % 3 = 0)""", "sig",
    ),
    "cycle_number": _sql('SELECT symbol, tf, minute, session_date, "C_NUM" FROM sig', "sig"),
    "timeframe_fan_out": f"""
        SELECT symbol, minute, tf, ticks, sha256(symbol || '|' || {_stamp('minute')}) AS "SID",
          sha256(symbol || '|' || tf || '|' || {_stamp('minute')}) AS "UID"
        FROM (SELECT event_type AS symbol, date_trunc('minute', ts) AS minute,
                count(*)::BIGINT AS ticks FROM events GROUP BY 1, 2),
          (SELECT unnest({TFS}) AS tf)""",
    "atm_strikes_round": _sql(
        """SELECT l_orderkey, l_linenumber, price, c AS "CSP", c + 100 AS "PSP", c - 700 AS low,
          c + 700 AS high FROM (SELECT *, (round_even(price, 0)::BIGINT // 100) * 100 AS c
          FROM line_price)""", "line_price",
    ),
    "atm_strikes_trunc": _sql(
        """SELECT l_orderkey, l_linenumber, price, c AS "CSP", c + 100 AS "PSP",
          c - 1000 AS ce_low, c + 1000 AS ce_high, c - 900 AS pe_low, c + 1100 AS pe_high
        FROM (SELECT *, (trunc(price)::BIGINT // 100) * 100 AS c FROM line_price)""", "line_price",
    ),
    "atm_strikes_text": """
        SELECT o_orderkey, price, coalesce(c, 0) AS "CSP", coalesce(c + 100, 0) AS "PSP"
        FROM (SELECT *, CASE WHEN regexp_full_match(price, '[+-]?[0-9]+')
                THEN (price::BIGINT // 100) * 100 END AS c
          FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN floor(o_totalprice)::BIGINT::VARCHAR
            WHEN 1 THEN o_orderpriority ELSE floor(o_totalprice)::BIGINT::VARCHAR || '.5' END AS price
            FROM orders))""",
    "instrument_filter": _sql("SELECT * FROM opt", "opt"),
    "instrument_issues": _sql(
        """SELECT name, token, symbol, instrumenttype, 'UNREADABLE_EXPIRY' AS issue_type,
          'expiry text: ' || expiry AS issue_msg FROM instr WHERE expiry_date IS NULL""", "instr",
    ),
    "not_expired": _sql(
        f"SELECT token, symbol, expiry_date FROM fut WHERE expiry_date >= {AS_OF}", "fut"
    ),
    "distinct_expiries": _sql("SELECT DISTINCT name, expiry_date FROM opt", "opt"),
    "current_future": _sql("SELECT * FROM cur_fut", "cur_fut"),
    "current_option_expiry": _sql("SELECT * FROM cur_opt", "cur_opt"),
    "option_chain": _sql("SELECT * FROM chain", "chain"),
    "chain_calls": _sql(
        "SELECT name, token, symbol, strike FROM chain WHERE ce_or_pe = 'CE'", "chain"
    ),
    "strike_band": _sql("SELECT * FROM banded", "banded"),
    "strike_ladder": _sql("SELECT * FROM ladder", "ladder"),
    "trading_config": _sql("SELECT * FROM config", "config"),
    "trading_config_json": _sql("SELECT * FROM config", "config"),
    "config_key_touched": _sql(
        f"""SELECT name, CASE WHEN name IN ('click','view') THEN DATE '2024-01-12' ELSE {AS_OF} END
          AS "T_DATE", CASE WHEN name IN ('click','view') THEN 'MAIN' ELSE 'SPARE' END AS ke
        FROM config""", "config"
    ),
    "expiry_valid": _sql(
        """SELECT name, DATE '2024-01-12' <= "FUT_EXPIRY_DATE" AS fut_valid,
          DATE '2024-01-12' <= "OPT_EXPIRY_DATE" AS opt_valid FROM config""", "config",
    ),
    "market_open": _sql(
        """SELECT d.day, CASE WHEN isodow(d.day) > 5 THEN 'NO' ELSE coalesce(listed, 'YES') END
          AS market_is_open
        FROM (SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem) d
        LEFT JOIN holidays ON d.day = holidays.day""", "holidays",
    ),
    "session_flags": f"""
        SELECT event_id, l AS local_ts,
          l::TIME BETWEEN TIME '09:15:00' AND TIME '15:25:00' AS in_session,
          l::TIME >= TIME '15:15:00' AS stop_entry, l::TIME >= TIME '15:20:00' AS close_all
        FROM (SELECT event_id, ts + {IST} AS l FROM events)""",
    "freshness": f"""
        SELECT event_id, ts::DATE = {AS_OF} AND ts::TIME > TIME '09:07:00' AS fresh FROM events""",
    "timestamp_digest": """
        SELECT event_id, md5(strftime(ts, '%Y-%m-%d %H:%M:%S.%f')) AS digest FROM events""",
    "tick_bars": _bars(),
    "last_price": _sql("SELECT * FROM price", "price"),
    "asof_price": _ASOF_PRICE,
    "stored_asof_price": _ASOF_PRICE,
    "strike_lookup": _sql(f"SELECT {_LOOKUP} FROM looked", "looked"),
    "strike_lookup_issues": _sql("SELECT * FROM strike_issue", "strike_issue"),
    "trade_params": _sql(
        """SELECT symbol, tf, minute, "TA_SIGNAL", trade_type, side, strike, opt_token, opt_symbol,
          quantity, lot FROM params""", "params",
    ),
    "entry_decisions": _ENTRY_DECISIONS,
    "stored_entry_decisions": _ENTRY_DECISIONS,
    "entry_issues": _sql("SELECT * FROM entry_issue", "entry_issue"),
    "close_rules": _sql(
        f"""SELECT n.seen AS "TA_SIGNAL", h."TA_SIGNAL" AS held, count(*)::BIGINT AS n,
          h."TA_SIGNAL" IN ('BUY','STRONG_BUY','SELL','STRONG_SELL') AND (n.seen IN
            ('NEUTRAL','ERROR','NO_RESPONSE','CLOSE_ALL_MARKET_TIMEOUT')
          OR (h."TA_SIGNAL" LIKE '%BUY' AND n.seen LIKE '%SELL')
          OR (h."TA_SIGNAL" LIKE '%SELL' AND n.seen LIKE '%BUY')) AS closed
        FROM (SELECT event_id, CASE WHEN (ts + {IST})::TIME >= TIME '15:20:00'
              THEN 'CLOSE_ALL_MARKET_TIMEOUT' WHEN no_response THEN 'NO_RESPONSE'
              ELSE "TA_SIGNAL" END AS seen FROM rolled) n
        JOIN rolled h ON n.event_id = h.event_id + 1 GROUP BY ALL""", "rolled",
    ),
    "close_rule_join": _sql(
        """SELECT "UID", symbol, "TS_TF", "EN_T_SIGNAL", exit_signal, exit_fprice, exit_cycle,
          exit_ts FROM closable""", "closable",
    ),
    "no_duplicate_entry": _sql(
        """SELECT symbol, tf, minute, "TA_SIGNAL" FROM sig
        WHERE "TA_SIGNAL" IN ('BUY','STRONG_BUY','SELL','STRONG_SELL') AND NOT EXISTS (
          SELECT 1 FROM held WHERE held.symbol = sig.symbol AND held."TS_TF" = sig.tf
            AND held."EN_T_SIGNAL" = sig."TA_SIGNAL")""", "sig", "held",
    ),
    "trade_lifecycle": _walked_trades(),
    "price_guard": """SELECT l_orderkey, l_linenumber, k >= 4 AS usable,
        CASE WHEN k > 1 THEN round_even(p, 0)::BIGINT - round_even(p, 0)::BIGINT % 100 END AS "CSP",
        CASE WHEN k > 1 THEN trunc(p)::BIGINT - trunc(p)::BIGINT % 100 END AS "CSP_trunc"
        FROM (SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 7 AS k,
          CASE (l_orderkey + l_linenumber) % 7 WHEN 2 THEN 0 WHEN 3 THEN -l_extendedprice
            ELSE l_extendedprice END::DOUBLE AS p FROM lineitem)""",
    "open_positions": _sql("SELECT * FROM held", "held"),
    "exit_overlay": _sql(_OVERLAY, "live", "exit_vals"),
    "exit_issues": _sql("SELECT * FROM exit_issue", "exit_issue"),
    "unexitable_trades": _sql(
        """SELECT *, 'NOT_EXITABLE' AS issue_type FROM unexitable""", "unexitable"
    ),
    "minute_cycle_exits": _sql(_CYCLE_EXITS, "exit_vals", "closing", "day_ladder"),
    "minute_cycle": _sql(_CYCLE_ENTRIES, "decided", "now", "held"),
    "trade_versions": _sql(
        f"""SELECT *, 'first' AS version FROM live UNION ALL BY NAME
        SELECT *, 'newest' AS version FROM (
          {_OVERLAY.replace("JOIN exit_vals e", "JOIN (" + _CYCLE_EXITS + ") e")}) UNION ALL BY NAME
        SELECT *, 'newest' AS version FROM ({_CYCLE_ENTRIES})""",
        "live", "exit_vals", "closing", "day_ladder", "decided", "now", "held",
    ),
    "ladder_coverage": _sql(
        """SELECT name, ce_or_pe, strike FROM expected e WHERE NOT EXISTS (SELECT 1 FROM chain c
          WHERE c.name = e.name AND c.ce_or_pe = e.ce_or_pe AND c.strike = e.strike)""",
        "expected", "chain",
    ),
    "dq_checks": _sql(
        "SELECT * FROM config_check UNION ALL SELECT * FROM ladder_check",
        "config_check", "ladder_check",
    ),
    "dq_verdict": _sql(
        """SELECT scope, bool_and(passed) AS passed, count(*) FILTER (NOT passed)::BIGINT
          AS failed_checks FROM (SELECT * FROM config_check UNION ALL SELECT * FROM ladder_check)
        GROUP BY scope""", "config_check", "ladder_check",
    ),
    "generation_checks": _sql(
        """SELECT name AS scope, lower(s) || '_generated' AS "check", n > 0 AS passed,
          'CRITICAL_ERROR' AS severity, CASE WHEN n > 0 THEN '' ELSE 'no rows' END AS message
        FROM (SELECT config.name, s, (SELECT count(*) FROM banded b WHERE b.name = config.name
                AND b.ce_or_pe = s) AS n FROM config, (VALUES ('CE'),('PE')) v(s))
        UNION ALL SELECT name, 'has_' || k, true, 'CRITICAL_ERROR', ''
        FROM config, (VALUES ('FUT_TOKEN'), ('FUT_EXPIRY_DATE_STR')) v(k)""",
        "config", "banded",
    ),
    "partition_presence": _sql(
        """SELECT name, expiry, ce_or_pe FROM (SELECT DISTINCT name, expiry_date AS expiry FROM fut),
          (VALUES ('CE'),('PE')) v(ce_or_pe)
        WHERE (name, expiry, ce_or_pe) NOT IN (SELECT (name, expiry, ce_or_pe) FROM chain)
          OR expiry IS NULL""", "fut", "chain",
    ),
    "issue_log": _sql("SELECT * FROM issue_log_rows", "issue_log_rows"),
    "log_history": _sql(
        f"""SELECT *, TIMESTAMP '2024-01-31 00:00:00' AS "LOAD_CREATE_DATETIME"
        FROM issue_log_rows WHERE "LOG_CREATE_DATE" < {AS_OF}""", "issue_log_rows",
    ),
    "log_current": _sql(
        f'SELECT * FROM issue_log_rows WHERE "LOG_CREATE_DATE" >= {AS_OF}', "issue_log_rows"
    ),
    "chain_snapshot": _sql(
        "SELECT name, token, symbol, strike, expiry, ce_or_pe FROM banded WHERE ce_or_pe = 'PE'",
        "banded",
    ),
    "csv_copy": _sql('SELECT name, "FUT_TOKEN", "FUT_EXPIRY_DATE_STR" FROM config', "config"),
    "master_json": _sql(
        "SELECT token, symbol, name, expiry, strike, instrumenttype, exch_seg FROM master", "master"
    ),
    "calendar_csv": _sql("SELECT day, listed AS market_open_status FROM holidays", "holidays"),
    "matching_columns": _sql(
        """SELECT "UID", "EN_T_SIGNAL", "T_CE_PE" FROM held WHERE "TRADE_TYPE" = 'SELL'""", "held"
    ),
    "appended_rows": _sql(
        """SELECT day, listed AS market_open_status, load
        FROM holidays, (VALUES ('first'), ('second')) v(load)""", "holidays",
    ),
    "wide_snapshots": """SELECT upper(event_type) AS symbol, ts, '5_MIN' AS tf, value::DOUBLE AS rsi,
        value::DOUBLE + 1 AS close FROM events
      UNION ALL SELECT upper(event_type), ts, '1_HOUR', NULL, value::DOUBLE * 2 FROM events""",
    "json_copy": _sql("SELECT * EXCLUDE (name) FROM config", "config"),
    "promoted_chain": _sql(
        f"""SELECT name, token, symbol, strike, expiry, ce_or_pe FROM banded
        WHERE name IN ({_PASSED})""", "banded", "config_check", "ladder_check",
    ),
    "promoted_config": _sql(
        f"""SELECT name, "FUT_TOKEN", "OPT_EXPIRY_DATE_STR", "T_DATE",
          (SELECT count(*) FROM banded b WHERE b.name = config.name) AS options
        FROM config WHERE name IN ({_PASSED})""", "config", "banded", "config_check", "ladder_check",
    ),
    "required_inputs": _sql(
        """SELECT name AS scope, k AS "check", ok AS passed, 'CRITICAL_ERROR' AS severity,
          CASE WHEN ok THEN '' WHEN k LIKE 'has%' THEN 'key ' || substr(k, 5) || ' not found'
            ELSE 'no stored options' END AS message
        FROM (SELECT name, 'has_T_DATE' AS k, true AS ok FROM config
          UNION ALL SELECT name, 'has_OPT_EXPIRY_DATE_STR', name <> 'error' FROM config
          UNION ALL SELECT config.name, lower(s) || '_stored', config.name <> 'error'
            AND NOT (config.name = 'view' AND s = 'PE') AND EXISTS (SELECT 1 FROM banded b
              WHERE b.name = config.name AND b.ce_or_pe = s AND b.expiry = "OPT_EXPIRY_DATE")
          FROM config, (VALUES ('CE'),('PE')) v(s))""", "config", "banded",
    ),
    "config_by_expiry": _sql(
        """SELECT "FUT_EXPIRY_DATE_STR" AS filed_under, name, "FUT_EXPIRY_DATE",
          "UPDATED_DATE_TIME" FROM config""", "config",
    ),
    "stream_signals": _emitted_only(_sql(
        """SELECT symbol, tf, minute, local_ts, session_date, "OSCI", "MA", "BUY", "SELL",
          "NEUTRAL", "FPRICE", "TA_SIGNAL", "CSP", stop_entry, "SID", "UID", "PSP" FROM sig""",
        "sig",
    )),
    "stream_trades": _emitted_only(_walked_trades() + " WHERE ex_minute IS NOT NULL"),
    "trade_lifecycle_priced_exits": _closed_trades(),
    "stream_trade_events": _walked_events(),
}
