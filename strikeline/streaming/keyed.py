"""Paper trades in keyed streaming state, priced by a stream of quotes."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strikeline.operators import trades as tr

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

EVENT_SCHEMA = (
    "symbol string, tf string, trade_signal string, action string, at timestamp, "
    "signal string, fprice double, token string, price double"
)
_EVENT_COLUMNS = ["tf", "trade_signal", "action", "at", "signal", "fprice", "token", "price"]
#: State keeps quotes and decisions by spans of this length.
SPAN_MS = 24 * 3_600_000
#: Quotes that a task packs together.
PACKED_ROWS = 500_000

_QUOTES = pa.schema([("token", pa.string()), ("time", pa.int64()), ("price", pa.float64())])
_DECISIONS = pa.schema([
    ("tf", pa.string()), ("at", pa.int64()), ("signal", pa.string()), ("fprice", pa.float64()),
    ("strike_ok", pa.bool_()), ("can_enter", pa.bool_()), ("token", pa.string()),
    ("price", pa.float64()),
])


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


def pack_quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over (symbol, token, time in microseconds, price): a row for each
    symbol and span of up to ``PACKED_ROWS`` rows and a batch, with its newest time and its
    quotes in one value."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= PACKED_ROWS:
            yield from _pack(waiting)
            waiting = []
    if waiting:
        yield from _pack(waiting)


def _pack(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(batches).combine_chunks()
    if not rows.num_rows:
        return
    spans = rows["time"].to_numpy() // (1000 * SPAN_MS)
    symbols = rows["symbol"].combine_chunks().dictionary_encode("encode")
    codes = symbols.indices.to_numpy()
    order = np.lexsort((spans, codes))
    quotes = rows.select(_QUOTES.names).take(pa.array(order)).cast(_QUOTES)
    codes, spans = codes[order], spans[order]
    cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(spans) != 0)) + 1
    edges = [0, *cuts.tolist(), len(order)]
    for a, b in zip(edges, edges[1:], strict=False):
        own = quotes.slice(a, b - a)
        yield pa.RecordBatch.from_pydict(
            {
                "symbol": [symbols.dictionary[int(codes[a])].as_py()],
                "time": [int(own["time"].to_numpy().max())],
                "rows": [_packed(own)],
            },
            schema=pa.schema(
                [("symbol", pa.string()), ("time", pa.int64()), ("rows", pa.binary())]
            ),
        )


class SpanQuotes:
    """Quotes of one span by token and time."""

    def __init__(self, rows: pa.Table) -> None:
        tokens = rows["token"].combine_chunks().dictionary_encode()
        codes = tokens.indices.to_numpy()
        times, prices = rows["time"].to_numpy(), rows["price"].to_numpy()
        order = np.lexsort((prices, times, codes))  # of equal times the largest price counts
        self._times, self._prices = times[order], prices[order]
        ends = np.searchsorted(codes[order], np.arange(len(tokens.dictionary) + 1))
        self._of = {
            n: (ends[i], ends[i + 1]) for i, n in enumerate(tokens.dictionary.to_pylist())
        }

    def last(self, token: str, after: int, upto: int) -> float | None:
        """Price of the token's last quote in (after, upto], None if there is none."""
        first, end = self._of.get(token, (0, 0))
        own = self._times[first:end]
        place = int(np.searchsorted(own, upto, "right")) - 1
        return float(self._prices[first + place]) if place >= 0 and own[place] > after else None


class TradeKeeper(StatefulProcessor):
    """Open trades of one symbol by timeframe, and the quotes and decisions not yet worked on.

    Rows come in any order and chunk by chunk, and wait in state by spans of time; a chunk's
    quotes of a span are a part of their own, which is written once and read once. A timer at
    the earliest waiting decision or span's end fires once the watermark has passed it; then all
    decisions up to the watermark are worked on in order, span by span, as all quotes up to there
    have come.
    A decision first closes the trades its signal closes, each at the last price of its token,
    then enters against the trades that were open before it. A trade without a usable price
    stays open for the next closing decision.

    At the end of a span the open trades take over their last prices, and its quotes are
    forgotten: state holds what is newer than the watermark and four open trades a timeframe at
    most. In memory are a chunk, a part, and of one span the quotes of tokens that are held or
    entered in it.
    """

    def __init__(self, closes: dict[str, tuple[str, ...]]) -> None:
        self._closes = closes
        self._done: tuple | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getMapState(
            "open", "tf string, signal string", "token string, entered long, price double"
        )
        self._due = handle.getMapState("due", "span long", "rows binary")
        self._parts = handle.getMapState("parts", "span long", "parts long")
        self._quotes = handle.getMapState("quotes", "span long, part long", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        self._done = None
        wake = []
        for chunk in rows:
            is_quote = chunk["rows"].notna().to_numpy()
            quotes, asked = chunk[is_quote], chunk[~is_quote]
            for span, packed in quotes["rows"].groupby(_millis(quotes["at"]) // SPAN_MS):
                self._add_quotes(int(span), pa.concat_tables([_unpacked(p) for p in packed]))
                wake.append((span + 1) * SPAN_MS)
            if len(asked):
                wake.append(self._add_decisions(asked))
        if wake:
            self._handle.registerTimer(int(min(wake)))
        return iter(())

    def _add_quotes(self, span: int, rows: pa.Table) -> None:
        part = self._parts.getValue((span,))[0] if self._parts.containsKey((span,)) else 0
        self._quotes.updateValue((span, part), (_packed(rows),))
        self._parts.updateValue((span,), (part + 1,))

    def _add_decisions(self, asked: pd.DataFrame) -> int:
        at = _millis(asked["at"])
        columns = {
            n: pa.array(asked[n], _DECISIONS.field(n).type, from_pandas=_DECISIONS.field(n).type
                        != pa.float64()) for n in _DECISIONS.names if n != "at"
        }
        table = pa.table(columns | {"at": at}).select(_DECISIONS.names).cast(_DECISIONS)
        for span in np.unique(at // SPAN_MS).tolist():
            rows = table.filter(pa.array(at // SPAN_MS == span))
            if self._due.containsKey((span,)):
                rows = pa.concat_tables([_unpacked(self._due.getValue((span,))[0]), rows])
            self._due.updateValue((span,), (_packed(rows),))
        return int(at.min())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        upto = timerValues.getCurrentWatermarkInMs()
        if self._done == (key, upto):  # an earlier timer of this batch has done it all
            return iter(())
        self._done = key, upto
        events = self._advance(upto)
        out = pd.DataFrame(events, columns=_EVENT_COLUMNS)
        out.insert(0, "symbol", key[0])
        return iter([out] if events else [])

    def _advance(self, upto: int) -> list[tuple]:
        """Work on everything up to the watermark."""
        before = {tuple(k): tuple(v) for k, v in self._open.iterator()}
        held: dict[str, dict] = {}
        for (tf, signal), trade in before.items():
            held.setdefault(tf, {})[signal] = trade
        events = []
        due = {k[0] for k in self._due.keys()}
        parts = {k[0]: v[0] for k, v in self._parts.iterator()}
        wake = [s * SPAN_MS for s in due if s * SPAN_MS > upto]
        wake += [(s + 1) * SPAN_MS for s in parts if (s + 1) * SPAN_MS > upto]
        for span in sorted(s for s in due | parts.keys() if s * SPAN_MS <= upto):
            now = None
            if span in due:
                rows = _unpacked(self._due.getValue((span,))[0])
                at = rows["at"].to_numpy()
                now = rows.filter(pa.array(at <= upto)).sort_by("at").to_pylist()
                later = rows.filter(pa.array(at > upto))
                if later.num_rows:
                    self._due.updateValue((span,), (_packed(later),))
                    wake.append(int(at[at > upto].min()))
                else:
                    self._due.removeKey((span,))
            tokens = {trade[0] for trades in held.values() for trade in trades.values()}
            tokens |= {row["token"] for row in now or () if row["can_enter"]}
            quotes = self._quotes_of(span, parts.get(span, 0), tokens - {None})
            for row in now or ():
                events += self._decide(row, held.setdefault(row["tf"], {}), quotes)
            end = (span + 1) * SPAN_MS
            if end <= upto and span in parts:
                for trades in held.values() if quotes else ():
                    for signal, (token, entered, price) in trades.items():
                        last = quotes.last(token, entered * 1000, end * 1000 - 1)
                        trades[signal] = token, entered, price if last is None else last
                for part in range(parts[span]):
                    self._quotes.removeKey((span, part))
                self._parts.removeKey((span,))
        if wake:
            self._handle.registerTimer(min(wake))
        after = {(tf, s): trade for tf, trades in held.items() for s, trade in trades.items()}
        for trade in before.keys() - after.keys():
            self._open.removeKey(trade)
        for trade, values in after.items():
            if before.get(trade) != values:
                self._open.updateValue(trade, values)
        return events

    def _quotes_of(self, span: int, parts: int, tokens: set[str]) -> SpanQuotes | None:
        """The waiting quotes of some tokens in a span."""
        if not parts or not tokens:
            return None
        wanted = pa.array(sorted(tokens), pa.string())
        found = []
        for part in range(parts):
            rows = _unpacked(self._quotes.getValue((span, part))[0])
            found.append(rows.filter(pc.is_in(rows["token"], value_set=wanted)))
        return SpanQuotes(pa.concat_tables(found))

    def _decide(self, row: dict, held: dict, quotes: SpanQuotes | None) -> list[tuple]:
        tf, at, signal = row["tf"], row["at"], row["signal"]
        when, open_before, events = pd.Timestamp(at, unit="ms"), set(held), []
        for entered_on in self._closes.get(signal, ()) if row["strike_ok"] else ():
            if entered_on not in open_before:
                continue
            token, entered, known = held[entered_on]
            # what it was at the entry or at the last span's end if it was not quoted since
            last = quotes.last(token, entered * 1000, at * 1000) if quotes else None
            price = known if last is None else last
            if price > 0:  # not for NaN
                del held[entered_on]
                events.append((tf, entered_on, "CLOSE", when, signal, row["fprice"], token, price))
        if row["can_enter"] and signal not in open_before:
            held[signal] = row["token"], at, row["price"]
            events.append(
                (tf, signal, "OPEN", when, signal, row["fprice"], row["token"], row["price"])
            )
        return events

    def close(self) -> None:
        pass


def _millis(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[ns]").astype("int64").to_numpy() // 1_000_000


def trade_events(
    decisions: DataFrame, quotes: DataFrame, options: DataFrame, lateness: str = "1 minute"
) -> DataFrame:
    """OPEN and CLOSE events, with prices, from streams of decisions and quotes.

    ``decisions``: one row per symbol, timeframe and minute, with the price at which it would
    enter; ``quotes``: token, ts, ltp; ``options``: a table with token and name, which says whose
    quotes they are. Both streams may be late by ``lateness`` and out of order; a minute is
    decided when the watermarks of both have passed it. Rows without a time are left out. Quotes
    are packed within their tasks before they are handed, once, to their symbol.
    """
    # send the processor itself, so that workers need not have this package installed
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    decisions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    asked = (
        decisions.where(F.col("minute").isNotNull())
        .withColumn("at", F.col("minute").cast("timestamp")).withWatermark("at", lateness)
        .select(
            "symbol", "tf", "at", F.lit(None).cast("binary").alias("rows"),
            F.col("TA_SIGNAL").alias("signal"), F.col("FPRICE").alias("fprice"), "strike_ok",
            "can_enter", F.col("opt_token").alias("token"), F.col("en_price").alias("price"),
        )
    )
    listed = options.groupBy("token").agg(F.min("name").alias("symbol"))
    packed = (
        quotes.where(F.col("ts").isNotNull())
        .withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
        .join(listed, "token")
        .select(
            "symbol", "token", F.unix_micros("at").alias("time"),
            F.coalesce("ltp", F.lit(float("-inf"))).alias("price"),  # never usable, as null
        )
        .mapInArrow(pack_quotes, "symbol string, time long, rows binary")
    )
    offered = packed.select("symbol", F.timestamp_micros("time").alias("at"), "rows")
    return (
        asked.unionByName(offered, allowMissingColumns=True).groupBy("symbol")
        .transformWithStateInPandas(
            statefulProcessor=TradeKeeper(tr.CLOSES), outputStructType=EVENT_SCHEMA,
            outputMode="Append", timeMode="EventTime",
        )
    )
