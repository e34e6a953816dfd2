"""Names, tables and thresholds the results depend on."""

from __future__ import annotations

# --- signals -------------------------------------------------------------
STRONG_BUY, BUY, NEUTRAL, SELL, STRONG_SELL = (
    "STRONG_BUY", "BUY", "NEUTRAL", "SELL", "STRONG_SELL",
)
ERROR = "ERROR"
NO_RESPONSE = "NO_RESPONSE"
CLOSE_ALL = "CLOSE_ALL_MARKET_TIMEOUT"

BUY_FAMILY = (BUY, STRONG_BUY)
SELL_FAMILY = (SELL, STRONG_SELL)
TRADABLE = BUY_FAMILY + SELL_FAMILY
EXIT_ONLY = (NEUTRAL, ERROR, NO_RESPONSE, CLOSE_ALL)

# --- timeframes: name, feed interval, feed column suffix, lot multiplier ---
# The first five are traded; the others are only valid feed intervals.
TIMEFRAMES = (
    ("1_MIN", "1m", "|1", 1),
    ("5_MIN", "5m", "|5", 2),
    ("15_MIN", "15m", "|15", 3),
    ("30_MIN", "30m", "|30", 5),
    ("1_HOUR", "1h", "|60", 7),
    ("2_HOUR", "2h", "|120", None),
    ("4_HOUR", "4h", "|240", None),
    ("1_DAY", "1d", "", None),
    ("1_WEEK", "1W", "|1W", None),
    ("1_MONTH", "1M", "|1M", None),
)
TRADED_TIMEFRAMES = tuple(t[0] for t in TIMEFRAMES if t[3] is not None)
TIMEFRAME_MINUTES = {"1_MIN": 1, "5_MIN": 5, "15_MIN": 15, "30_MIN": 30, "1_HOUR": 60}

# --- market clock ----------------------------------------------------------
MARKET_ZONE = "Asia/Kolkata"
SESSION_OPEN, SESSION_CLOSE = "09:15:00", "15:25:00"
STOP_ENTRY_AT, CLOSE_ALL_AT = "15:15:00", "15:20:00"
CONFIG_FRESH_AFTER = "09:07:00"

# --- instruments -------------------------------------------------------------
EXCHANGE_SEGMENT = "NFO"
FUTURE_TYPE, OPTION_TYPE = "FUTIDX", "OPTIDX"
CALL, PUT = "CE", "PE"

# --- strikes -----------------------------------------------------------------
STRIKE_STEP = 100
BUILD_BAND, CHECK_BAND = 1000, 700

# --- scanner columns, in payload order ---------------------------------------
SCANNER_COLUMNS = (
    "Recommend.Other", "Recommend.All", "Recommend.MA",
    "RSI", "RSI[1]", "Stoch.K", "Stoch.D", "Stoch.K[1]", "Stoch.D[1]",
    "CCI20", "CCI20[1]", "ADX", "ADX+DI", "ADX-DI", "ADX+DI[1]", "ADX-DI[1]",
    "AO", "AO[1]", "Mom", "Mom[1]", "MACD.macd", "MACD.signal",
    "Rec.Stoch.RSI", "Stoch.RSI.K", "Rec.WR", "W.R", "Rec.BBPower", "BBPower",
    "Rec.UO", "UO", "close",
    "EMA5", "SMA5", "EMA10", "SMA10", "EMA20", "SMA20", "EMA30", "SMA30",
    "EMA50", "SMA50", "EMA100", "SMA100", "EMA200", "SMA200",
    "Rec.Ichimoku", "Ichimoku.BLine", "Rec.VWMA", "VWMA", "Rec.HullMA9", "HullMA9",
    "Pivot.M.Classic.S3", "Pivot.M.Classic.S2", "Pivot.M.Classic.S1",
    "Pivot.M.Classic.Middle", "Pivot.M.Classic.R1", "Pivot.M.Classic.R2",
    "Pivot.M.Classic.R3",
    "Pivot.M.Fibonacci.S3", "Pivot.M.Fibonacci.S2", "Pivot.M.Fibonacci.S1",
    "Pivot.M.Fibonacci.Middle", "Pivot.M.Fibonacci.R1", "Pivot.M.Fibonacci.R2",
    "Pivot.M.Fibonacci.R3",
    "Pivot.M.Camarilla.S3", "Pivot.M.Camarilla.S2", "Pivot.M.Camarilla.S1",
    "Pivot.M.Camarilla.Middle", "Pivot.M.Camarilla.R1", "Pivot.M.Camarilla.R2",
    "Pivot.M.Camarilla.R3",
    "Pivot.M.Woodie.S3", "Pivot.M.Woodie.S2", "Pivot.M.Woodie.S1",
    "Pivot.M.Woodie.Middle", "Pivot.M.Woodie.R1", "Pivot.M.Woodie.R2",
    "Pivot.M.Woodie.R3",
    "Pivot.M.Demark.S1", "Pivot.M.Demark.Middle", "Pivot.M.Demark.R1",
    "open", "P.SAR", "BB.lower", "BB.upper", "AO[2]",
    "volume", "change", "low", "high",
)

# --- engine column name -> position in the scanner payload -------------------
SNAPSHOT_POSITIONS = {
    "score_other": 0, "score_all": 1, "score_ma": 2,
    "rsi": 3, "rsi1": 4,
    "k": 5, "d": 6, "k1": 7, "d1": 8,
    "cci": 9, "cci1": 10,
    "adx": 11, "pdi": 12, "ndi": 13, "pdi1": 14, "ndi1": 15,
    "ao": 16, "ao1": 17, "ao2": 86,
    "mom": 18, "mom1": 19,
    "macd": 20, "macd_signal": 21,
    "rec_stoch_rsi": 22, "rec_wr": 24, "rec_bbp": 26, "rec_uo": 28,
    "close": 30,
    "ema10": 33, "sma10": 34, "ema20": 35, "sma20": 36, "ema30": 37, "sma30": 38,
    "ema50": 39, "sma50": 40, "ema100": 41, "sma100": 42, "ema200": 43, "sma200": 44,
    "rec_ichimoku": 45, "rec_vwma": 47, "rec_hma9": 49,
    "open": 82, "psar": 83, "bb_lower": 84, "bb_upper": 85,
}
