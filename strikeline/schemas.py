"""Schemas of the input and output tables."""

from __future__ import annotations

from pyspark.sql import types as T

from strikeline import fixed

S, D, L, I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()
DATE, TS = T.DateType(), T.TimestampNTZType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


INSTRUMENT_MASTER = _table(
    token=S, symbol=S, name=S, expiry=S, strike=S, instrumenttype=S, exch_seg=S
)
CALENDAR = _table(date=S, market_open_status=S)
TRADING_CONFIG = _table(
    FUT_EXPIRY_DATE=DATE, OPT_EXPIRY_DATE=DATE, T_DATE=DATE,
    FUT_EXPIRY_DATE_STR=S, OPT_EXPIRY_DATE_STR=S, FUT_TOKEN=S, FUT_SYMBOL=S,
    MARKET_IS_OPEN_TODAY=S, UPDATED_DATE_TIME=TS, ke=S,
)
NAMED_CONFIG = T.StructType([T.StructField("name", S), *TRADING_CONFIG.fields])
OPTION_CHAIN = _table(name=S, token=S, symbol=S, strike=L, expiry=DATE, ce_or_pe=S)
SCANNER_ARRAYS = _table(symbol=S, tf=S, ts=TS, d=T.ArrayType(D))
SNAPSHOTS = _table(symbol=S, tf=S, ts=TS, **{c: D for c in fixed.SNAPSHOT_POSITIONS})
QUOTES = _table(token=S, ts=TS, ltp=D)
SIGNALS = _table(
    TA_SIGNAL=S, MA=S, OSCI=S, FPRICE=D, CSP=L, PSP=L, BUY=I, NEUTRAL=I, SELL=I,
    TF=S, SID=S, UID=S, UPDATED_DATE_TIME=TS,
)
SIGNAL_LOG = T.StructType([
    T.StructField("symbol", S), *SIGNALS.fields, T.StructField("batch_id", L)
])
TRADES = _table(
    UID=S, TS_TF=S, TRADE_TYPE=S, EN_T_SIGNAL=S, EN_FUT_PRICE=D, OPT_STRIKE_PRICE=L,
    OPT_SYMBOL=S, OPT_TOKEN=S, EN_OPT_PRICE=D, TRADE_STATUS=S, TRADE_LOT=I,
    T_DAY=I, T_MONTH=I, T_YEAR=I, T_DATE=DATE, T_CE_PE=S, EX_OPT_PRICE=D,
    EX_T_SIGNAL=S, EX_FUT_PRICE=D, EN_C_NUM=I, EX_C_NUM=I,
    UPDATED_DATETIME=TS, CREATE_DATETIME=TS,
)
TRADES_BY_SYMBOL = T.StructType([T.StructField("symbol", S), *TRADES.fields])
LOG = _table(
    LOG_MODULE_NAME=S, LOG_TYPE=S, LOG_MESSAGE=S, ENV_TYPE=S,
    LOG_CREATE_DATE=DATE, LOG_CREATE_DATETIME=TS,
)
LOG_HISTORY = T.StructType([*LOG.fields, T.StructField("LOAD_CREATE_DATETIME", TS)])
