"""Ordered per-key work that stays balanced when one key holds most of the rows.

Keys with a large share of the rows are cut in time, at quantiles of the whole data set:
a (key, time slice) group then holds at most about 1/slices of all rows however many of
them share a key. Each slice is grouped by itself; what it needs from other slices is a few
boundary rows per slice. Other keys stay in one piece. Which keys are cut, and where, only
balances the work: any choice gives the same result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeline.session import cut_lineage

SLICE = "time_slice"
_AT = "slice_position"
_SAMPLE_PER_SLICE = 1000
_SLICES_PER_PARTITION = 4
#: So many distinct keys are sent to every task.
_MOST_ASKED = 200_000


@dataclass(frozen=True)
class Slices:
    """Where to cut time, and the hashes of the keys to cut (``None``: every key)."""

    cuts: tuple[float, ...] = ()
    hot: frozenset[int] | None = None

    def is_cut(self, keys: Sequence[str]) -> Column:
        if self.hot is None:
            return F.lit(True)
        # rows without a key match nothing; they are spread like those of a hot key
        keyless = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        return keyless | _key_hash(keys).isin(*self.hot)


def _key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k).cast("string") for k in keys])


def _position(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")).cast("double")


def slices_of(
    df: DataFrame, keys: Sequence[str], ts: str, count: int | None = None
) -> Slices:
    """Slices for ``df`` from a sample: ``count`` time slices (default: four per shuffle
    partition) of the keys with more than half a partition's share; none without such keys.

    What reaches the driver is bounded by the number of shuffle partitions: the cut points
    and the hashes of at most two hot keys per partition.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.count()
    if rows == 0:
        return Slices()
    count = count or _SLICES_PER_PARTITION * partitions
    if count < 2:
        return Slices()
    share = min(1.0, count * _SAMPLE_PER_SLICE / rows)
    sample = df.select(_position(F.col(ts)).alias(_AT), _key_hash(keys).alias("key")).sample(
        share, seed=1
    )
    cuts = sample.approxQuantile(
        _AT, [i / count for i in range(1, count)], relativeError=1 / (10 * count)
    )
    heavy = F.col("count") > rows * share / (2 * partitions)
    hot = sample.groupBy("key").count().where(heavy).select("key").collect()
    keys_to_cut = frozenset(r.key for r in hot)
    return Slices(tuple(sorted(set(cuts))), keys_to_cut) if keys_to_cut else Slices()


def with_slice(df: DataFrame, keys: Sequence[str], ts: str, slices: Slices) -> DataFrame:
    """Add the time slice number: how many cut points are at or before ``ts``; 0 for keys
    that are not cut."""
    if not slices.cuts:
        return df.withColumn(SLICE, F.lit(0))
    placed = df.withColumn(_AT, F.coalesce(_position(F.col(ts)), F.lit(float("-inf"))))
    slicer = Bucketizer(
        splits=[float("-inf"), *slices.cuts, float("inf")], inputCol=_AT, outputCol=SLICE,
    )
    number = F.when(slices.is_cut(keys), F.col(SLICE).cast("int")).otherwise(0)
    return slicer.transform(placed).drop(_AT).withColumn(SLICE, number)


def previous_values(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    wanted: dict[str, tuple[str, int]],
    slices: Slices,
) -> DataFrame:
    """Add ``{new: (column, k)}``: the value of ``column`` k rows earlier in its key.

    ``order`` starts with the time column and is unique within a key. Rows deep inside a
    slice read their own slice; the first rows of a slice read the few rows at the ends
    of the slices, which is all that is ever gathered per key.
    """
    reach = max(k for _, k in wanted.values())
    if not slices.cuts:
        in_key = Window.partitionBy(*keys).orderBy(*order)
        return df.select(
            "*", *[F.lag(c, k).over(in_key).alias(n) for n, (c, k) in wanted.items()]
        )
    in_slice = Window.partitionBy(*keys, SLICE).orderBy(*order)
    placed = with_slice(df, keys, order[0], slices).select(
        "*",
        *[F.lag(c, k).over(in_slice).alias(f"_near_{n}") for n, (c, k) in wanted.items()],
        F.row_number().over(in_slice).alias("_place"),
        F.lead(F.lit(False), reach, True).over(in_slice).alias("_at_end"),
    )
    # rows at slice ends meet in one small group per key, all others stay by themselves
    at_start = F.col("_place") <= reach
    together = F.when(at_start | F.col("_at_end"), F.lit(-1)).otherwise(F.col(SLICE))
    at_ends = Window.partitionBy(*keys, together).orderBy(*order)
    return placed.select(
        *df.columns,
        *[
            F.when(at_start, F.lag(c, k).over(at_ends)).otherwise(F.col(f"_near_{n}")).alias(n)
            for n, (c, k) in wanted.items()
        ],
    )


def asked_keys(probes: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The distinct keys of ``probes``, stored; None if they are too many to be sent to every
    task. Reads ``probes`` once more."""
    asked = cut_lineage(probes.select(*keys).dropna().distinct())
    return asked if asked.count() <= _MOST_ASKED else None


def of_asked(rows: DataFrame, asked: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """``rows`` without those whose keys no probe has, where they lie. The others answer nothing."""
    return rows if asked is None else rows.join(F.broadcast(asked), [*keys], "left_semi")


def asof_join(
    probes: DataFrame,
    quotes: DataFrame,
    keys: Sequence[str],
    ts: str,
    values: Sequence[str],
    slices: Slices | None = None,
    forward: bool = False,
) -> DataFrame:
    """Left as-of join: each probe gets ``values`` of its key's last quote at or before
    ``ts``; with ``forward`` of the first quote at or after it. ``quotes`` has the same
    key and time column names; of quotes with equal key and time the one with the
    largest ``values`` counts (``forward``: the smallest).

    One shuffle on (key, time slice). Every slice is handed a copy of the nearest quote
    outside it, so no slice has to look into another.
    """
    if slices is None:
        both = quotes.select(*keys, ts).unionByName(probes.select(*keys, ts))
        slices = slices_of(both, keys, ts)

    known = quotes.select(*keys, ts, *values).dropna(subset=[*keys, ts])
    sliced = with_slice(known, keys, ts, slices).select(*keys, SLICE, ts, *values)
    asked = with_slice(probes, keys, ts, slices).select(
        *keys, SLICE, ts, F.struct(*probes.columns).alias("probe")
    )
    rows = sliced.unionByName(asked, allowMissingColumns=True)
    if slices.cuts and slices.hot != frozenset():
        carried = _carried(sliced, keys, ts, values, slices, forward)
        rows = rows.unionByName(carried, allowMissingColumns=True)
    is_probe = F.col("probe").isNotNull()
    order = (
        [F.desc(ts), is_probe, *[F.desc(v) for v in values]] if forward
        else [F.asc(ts), is_probe, *values]
    )
    so_far = (
        Window.partitionBy(*keys, SLICE).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    latest = F.last(F.when(~is_probe, F.struct(*values)), ignorenulls=True).over(so_far)
    return (
        rows.select("probe", ts, latest.alias("quote")).where(is_probe)
        .select(
            "probe.*",
            *[F.when(F.col(ts).isNotNull(), F.col(f"quote.{v}")).alias(v) for v in values],
        )
    )


def _carried(
    sliced: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], slices: Slices,
    forward: bool,
) -> DataFrame:
    """Copies of each slice's outermost quote for the slices up to and including the next
    one (``forward``: the one before) of that key that has quotes of its own."""
    outermost = (F.min if forward else F.max)(F.struct(ts, *values)).alias("quote")
    ends = sliced.where(slices.is_cut(keys)).groupBy(*keys, SLICE).agg(outermost)
    by_slice = Window.partitionBy(*keys).orderBy(SLICE)
    if forward:
        first = F.coalesce(F.lag(SLICE).over(by_slice), F.lit(0))
        last = F.col(SLICE) - 1
    else:
        first = F.col(SLICE) + 1
        last = F.coalesce(F.lead(SLICE).over(by_slice), F.lit(len(slices.cuts)))
    return (
        ends.withColumns({"first": first, "last": last}).where(F.col("first") <= F.col("last"))
        .withColumn(SLICE, F.explode(F.sequence("first", "last")))
        .select(*keys, SLICE, "quote.*")
    )
