"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows with equal texts form a group that stays together. Each group is placed in the shard
where the dot product of its (bytes, tokens, rows) with the shard's residual capacity is
highest, large groups first. Groups of more than a small share of all data are placed first
and by the driver; their number is bounded by the number of cells, see ``_LARGE``. Only a group
that has more than a shard's share of the bytes, tokens or rows is cut, by a hash of the row and
into as many parts as there are shards: in fewer, the shards that have them would be full of rows
but not of bytes, or the other way round, and the rest could not make up for both. The parts are
placed by the same rule. All other groups are dealt to cells by hash;
every cell packs its own groups, streaming them in order of size, into the shards' residual
capacity in proportion to the cell's size. No task holds more than the residual vectors.

Rules for odd input: a null text has 0 bytes (size 1) and equals only null and empty texts;
repeated rows are placed like any others; null ids are allowed; an empty table gives an empty
result. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strikeline.llm.common import filled, partitions_of, ship, union_all
from strikeline.session import cut_lineage

#: A group is large if it has more than 1/16 of a cell's mean share in any dimension: there
#: are at most 48 such groups for each cell.
_LARGE = 16
#: Groups a cell should have at least, so that it can balance them.
_GROUPS_PER_CELL = 256
_DIMS = ("bytes", "tokens", "rows")


def _best(residual: list[list[float]], demand: tuple[float, ...]) -> int:
    """Shard with the highest dot product of demand and residual capacity; takes it."""
    b, t, r = demand
    best, at = -float("inf"), 0
    for i, (rb, rt, rr) in enumerate(residual):
        dot = b * rb + t * rt + r * rr
        if dot > best:
            best, at = dot, i
    left = residual[at]
    left[0] -= b
    left[1] -= t
    left[2] -= r
    return at


def measured(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, tokens (words), text_crc32, key (hash of the text); the text itself is
    read once and goes no further."""
    t = filled(text)
    return docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.regexp_count(t, F.lit(r"\S+")).cast("long").alias("tokens"),
        F.crc32(t).alias("text_crc32"),
        F.xxhash64(t).alias("key"),
    )


def shard(
    docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Adds to doc_id, size, tokens, text_crc32: shard (from 0), slot (gapless from 0 in each
    shard) and part (of a text that was cut, else null)."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    rows = cut_lineage(measured(docs, id_column, text).withColumn(
        "salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(2**30)).cast("int")
    ))
    groups = cut_lineage(rows.groupBy("key").agg(
        F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")
    ))
    totals = groups.agg(*[F.sum(d).alias(d) for d in _DIMS], F.count("*").alias("groups")).first()
    if not totals.groups:
        return rows.select(
            "doc_id", "size", "tokens", "text_crc32", F.lit(0).alias("shard"),
            F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("part"),
        )
    cells = max(1, min(partitions_of(spark), totals.groups // _GROUPS_PER_CELL))
    # demands as shares of all data, so that the dimensions weigh the same
    share = [F.col(d) / F.lit(float(max(totals[d], 1))) for d in _DIMS]
    is_large = F.greatest(*share) > 1.0 / (_LARGE * cells)
    residual = [[1.0 / shards] * 3 for _ in range(shards)]

    # at most 3 * _LARGE rows for each cell; those that fit a shard stay whole
    large = F.broadcast(groups.where(is_large).select(
        "key", F.lit(True).alias("is_large"),
        F.when(F.greatest(*share) > 1.0 / shards, shards).otherwise(1).alias("parts"),
    ))
    is_cut = F.col("parts") > 1
    marked = rows.join(large, "key", "left").withColumn(
        "part", F.when(is_cut, F.col("salt") % F.col("parts"))
    )
    parts = marked.where("is_large").groupBy("key", "part").agg(
        F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")
    )
    placed = []
    demands = [
        (p.key, p.part, tuple(p[d] / max(totals[d], 1) for d in _DIMS)) for p in parts.collect()
    ]
    for key, part, demand in sorted(demands, key=lambda x: (-max(x[2]), x[0], x[1] or 0)):
        placed.append((key, part, _best(residual, demand)))
    placed = spark.createDataFrame(placed, "key long, part int, shard int")

    small = groups.where(~is_large).select(
        "key", F.pmod(F.xxhash64("key"), F.lit(cells)).cast("int").alias("cell"),
        *[s.alias(d) for s, d in zip(share, _DIMS, strict=True)],
    )
    shares = {
        c.cell: tuple(c[d] for d in _DIMS)
        for c in small.groupBy("cell").agg(*[F.sum(d).alias(d) for d in _DIMS]).collect()
    }
    rest = [max(sum(s[d] for s in shares.values()), 1e-300) for d in range(3)]
    left = [tuple(x) for x in residual]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, own = None, []
        for batch in batches:
            chosen = []
            for c, b, t, r in zip(
                batch.cell.tolist(), batch.bytes.tolist(), batch.tokens.tolist(),
                batch.rows.tolist(), strict=True,
            ):
                if c != cell:
                    cell = c
                    own = [[x[d] * shares[c][d] / rest[d] for d in range(3)] for x in left]
                chosen.append(_best(own, (b, t, r)))
            yield pd.DataFrame({"key": batch.key, "shard": chosen})

    packed = (
        small.repartition(cells, "cell")
        .sortWithinPartitions("cell", F.greatest(*_DIMS).desc(), "key")
        .mapInPandas(pack, "key long, shard int")
    )
    whole = F.broadcast(placed.where("part is null").drop("part"))
    cut = F.broadcast(placed.where("part is not null"))
    kept = ["doc_id", "size", "tokens", "text_crc32", "shard", "part"]
    assigned = cut_lineage(union_all([
        marked.where("is_large is null").join(packed, "key").select(*kept),
        marked.where("is_large").where(~is_cut).join(whole, "key").select(*kept),
        marked.where(is_cut).join(cut, ["key", "part"]).select(*kept),
    ]))
    return with_slots(assigned)


def with_slots(assigned: DataFrame) -> DataFrame:
    """Adds ``slot``: a number from 0 without gaps in each shard.

    Rows are numbered within (shard, block) and blocks get their first number from the counts
    of those before; a shard is never gathered in one task.
    """
    blocks = partitions_of(assigned.sparkSession)
    spread = assigned.withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("block")), F.lit(blocks))
    )
    counts = spread.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    firsts = counts.select(  # one row for each shard and block
        "shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32")
    return (
        spread.withColumn("place", F.row_number().over(within) - 1)
        .join(F.broadcast(firsts), ["shard", "block"])
        .select(*assigned.columns, (F.col("first") + F.col("place")).cast("long").alias("slot"))
    )
