"""Paper trades from a stream, set-based per micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strikeline.operators import decisions as dec
from strikeline.operators import indicators as ind
from strikeline.operators import trades as tr
from strikeline.operators.ordered import Slices, slices_of
from strikeline.schemas import TRADES_BY_SYMBOL
from strikeline.sources import files
from strikeline.sources.versions import VersionedTable, trade_part

#: A table, or a function that reads it anew: a file table lists its files once only.
Source = DataFrame | Callable[[], DataFrame]


def _now(source: Source) -> DataFrame:
    return source() if callable(source) else source


# --- micro-batches over stored tables ------------------------------------------


#: Tables that hand a batch's state on to the next.
STATE = ("signals", "progress", "last_quotes", "cycles", "decisions", "settled", "open")


def trade_table(spark: SparkSession, root: str) -> VersionedTable:
    """The trades of a stream with the root ``root``, open and closed."""
    return VersionedTable(spark, f"{root}/trades", TRADES_BY_SYMBOL, "UID", trade_part())


def _batch_path(root: str, table: str, batch_id: int) -> str:
    return f"{root}/{table}/batch_id={batch_id}"


def _open_schema(decided: DataFrame) -> StructType:
    keys = [StructField(k, StringType()) for k in tr.KEY]
    return StructType([*keys, StructField("entry", decided.schema)])


def _process(
    batch: DataFrame, batch_id: int, root: str, options: Source, quotes: Source,
) -> None:
    spark = batch.sparkSession
    options, quotes = _now(options), _now(quotes)

    def store(df: DataFrame, table: str) -> DataFrame:
        path = _batch_path(root, table, batch_id)
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def before(table: str, schema) -> DataFrame:
        """The table as the previous batch left it."""
        if batch_id == 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(_batch_path(root, table, batch_id - 1))

    for name in STATE:  # the batch before this one may be needed again, older ones are not
        files.remove(spark, _batch_path(root, name, batch_id - 2))
    fresh = store(batch, "signals")
    offered = quotes.select("token", "ts", "ltp")
    numbered = ind.number_cycles(fresh)
    counted = numbered.select("symbol", "session_date", "C_NUM").schema
    last_numbers = before("cycles", counted)
    last_quotes = before("last_quotes", offered.schema)
    progress = before("progress", "upto timestamp_ntz")

    seen = progress.agg(F.max("upto")).first()[0]
    upto = fresh.agg(F.max("minute")).first()[0]
    if upto is None:  # nothing new: hand the state on
        store(progress, "progress")
        store(last_quotes, "last_quotes")
        store(last_numbers, "cycles")
        plan = dec.entry_decisions(dec.attach_daily_strikes(numbered, options), offered, Slices())
        store(before("open", _open_schema(plan)), "open")
        return
    store(spark.createDataFrame([(upto,)], "upto timestamp_ntz"), "progress")

    # of the quotes only those since the previous batch, and each token's last one before
    since = offered.where(F.col("ts") <= F.lit(upto))
    if seen is not None:
        since = since.where(F.col("ts") > F.lit(seen))
    recent = last_quotes.unionByName(since)
    slices = slices_of(recent, ["token"], "ts")
    newest_quote = F.max(F.struct("ts", "ltp")).alias("q")
    store(
        recent.where(F.col("token").isNotNull()).groupBy("token").agg(newest_quote)
        .select("token", "q.*"),
        "last_quotes",
    )

    # cycle numbers go on where the symbol's session stopped
    before_batch = last_numbers.withColumnRenamed("C_NUM", "counted")
    numbered = numbered.join(before_batch, ["symbol", "session_date"], "left").withColumn(
        "C_NUM", F.col("C_NUM") + F.coalesce("counted", F.lit(0))
    ).drop("counted")
    decided = store(
        dec.entry_decisions(dec.attach_daily_strikes(numbered, options), recent, slices), "decisions"
    )
    newest = F.max(F.struct("session_date", "C_NUM")).alias("n")
    store(
        last_numbers.unionByName(decided.select(*last_numbers.columns)).groupBy("symbol")
        .agg(newest).select("symbol", "n.*"),
        "cycles",
    )

    pairs = tr.pair_trades(decided, carried=before("open", _open_schema(decided)))
    settled = store(tr.settle_exits(pairs, decided, recent, slices), "settled")
    store(settled.where(F.col("exit_ts").isNull()).select(*tr.KEY, "entry"), "open")
    table = trade_table(spark, root)
    table.commit(tr.trade_rows(settled), batch=("trades", batch_id))
    table.prune()


def trade_stream(
    signals: DataFrame, options: Source, quotes: Source, root: str, checkpoint: str,
    trigger: dict | None = None,
):
    """Keep the trade table below ``root`` up to date with a stream of signals.

    ``options`` and ``quotes`` are tables or, so that a running stream sees what was added
    since it started, functions that read them; each batch calls them once. Strikes are those
    of each signal's day, and a trade closes at its first closing signal with a usable price.
    ``quotes`` must be complete up to the newest signal of a batch. A micro-batch reads the
    quotes since the one before, so its work does not grow with the history; keep the table
    partitioned or sorted by time for the filter to skip files.

    What a batch hands on lies in folders named after it, of which the last two batches' are
    kept. The trades it opened and closed go to ``trade_table(root)`` in one commit, which a
    repeated batch does not make again. The table rewrites only the entry days it touches.
    """
    run = partial(_process, root=root, options=options, quotes=quotes)
    return (
        signals.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
