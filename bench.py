"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES
(comma-separated names, default all headline queries). Every query is run in full into a
no-op sink, once, after one small warm-up of the session.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strikeline.queries import REGISTRY  # noqa: E402
from strikeline.session import build_session  # noqa: E402

HEADLINE = (
    "signal_rollup", "votes_by_kind", "vote_counts", "scanner_payload", "prev_bar_lag",
    "signals_dedup", "signal_log", "timeframe_fan_out", "atm_strikes_round", "atm_strikes_text",
    "option_chain", "strike_band", "trading_config", "market_open", "session_flags",
    "tick_bars", "asof_price", "strike_lookup", "entry_decisions", "close_rules",
    "close_rule_join", "no_duplicate_entry", "trade_lifecycle", "exit_overlay", "minute_cycle",
    "trade_lifecycle_priced_exits", "ladder_coverage", "dq_checks", "log_history",
    "chain_snapshot", "stream_signals", "stream_trades", "stream_trade_events",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        f"local[{cpus}]", "strikeline-bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="strikeline-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").groupBy("r_name").count().collect()

    seconds = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
