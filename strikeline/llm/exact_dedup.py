"""Exact duplicates by two passes over a Bloom filter, in DataFrame operations only.

The first pass sets, for each text, a few bits of a blocked Bloom filter and keeps those bits
that were set more than once. A text whose bits are not all among them is certainly the only
one of its kind: the second pass lets such rows straight through. Only the rest is shuffled
and grouped exactly, by SHA-256 of the normalised text.

The filter has 16 bits a row up to ``MAX_BITS`` (32 MB), which bounds what is broadcast. With
far more rows than it is made for, it lets more rows through to the exact grouping, which then
does more work; the result is the same.

Rules for odd input: null texts count as empty, so they equal empty ones; null ids are smaller
than all others; of rows that repeat both id and text just one is kept; an empty table gives
an empty result. Columns that the operator does not need may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeline.llm.common import ascii_lower, filled, partitions_of, union_all
from strikeline.session import cut_lineage

#: Bits in a block of the filter: what Spark's bitmap functions keep in one binary value.
BLOCK_BITS = 32768
BITS_PER_ROW = 16
BITS_PER_TEXT = 3
MAX_BITS = 2**28


def normalised(text: str) -> Column:
    return ascii_lower(filled(text))


def digest_of(text: str) -> Column:
    """SHA-256 of the normalised text as 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(blocks))


def _bit(i: int) -> Column:
    """Place of the text's i-th bit in its block."""
    return F.pmod(F.xxhash64("digest", F.lit(i)), F.lit(BLOCK_BITS)).cast("int")


def blocks_for(rows: int) -> int:
    """Number of filter blocks for so many rows: a power of two within the bound."""
    bits = min(MAX_BITS, max(BLOCK_BITS, BITS_PER_ROW * rows))
    return max(1, 2 ** (bits - 1).bit_length() // BLOCK_BITS)


def repeated_bits(digests: DataFrame, blocks: int) -> DataFrame:
    """First pass: block, bitmap of the bits that were set more than once.

    ``digests`` has a column ``digest``. Bits are counted per task before they are shuffled,
    so a text that has a third of the rows sends a few rows per task.
    """
    places = F.array(*[
        _block(blocks) * BLOCK_BITS + _bit(i) + 1 for i in range(BITS_PER_TEXT)
    ])
    return (
        digests.select(F.explode(places).alias("place"))
        .groupBy("place").agg(F.count("*").alias("hits")).where("hits > 1")
        .groupBy((F.bitmap_bucket_number("place") - 1).alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))
    )


def with_possibly_repeated(digests: DataFrame, bits: DataFrame, blocks: int) -> DataFrame:
    """Second pass: adds ``possibly_repeated``, which is true for every repeated text."""
    def is_set(i: int) -> Column:
        byte = F.expr(f"substring(bitmap, {_sql_bit(i)} div 8 + 1, 1)")
        number = F.conv(F.hex(byte), 16, 10).cast("int")
        return F.expr("1").bitwiseAND(F.call_function("shiftright", number, _bit(i) % 8)) == 1

    all_set = is_set(0)
    for i in range(1, BITS_PER_TEXT):
        all_set = all_set & is_set(i)
    found = digests.withColumn("block", _block(blocks)).join(
        F.broadcast(bits), "block", "left"  # at most MAX_BITS / 8 bytes
    )
    return found.withColumn(
        "possibly_repeated", F.col("bitmap").isNotNull() & F.coalesce(all_set, F.lit(False))
    ).drop("block", "bitmap")


def _sql_bit(i: int) -> str:
    return f"cast(pmod(xxhash64(digest, {i}), {BLOCK_BITS}) as int)"


def report(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest id of each group of equal texts is kept. Texts are read and
    hashed once; what is shuffled holds ids and digests of possibly repeated texts. Groups
    with more than a quarter of a partition's share of the rows (at most four per partition)
    are broadcast, the others joined by a shuffle, so no group gathers in a task.
    """
    slim = cut_lineage(docs.select(
        F.col(id_column).alias("doc_id"), digest_of(text).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    ))
    rows = slim.count()
    blocks = blocks_for(rows)
    flagged = with_possibly_repeated(slim, repeated_bits(slim, blocks), blocks)
    flagged = cut_lineage(flagged)
    once, again = flagged.where("not possibly_repeated"), flagged.where("possibly_repeated")

    groups = cut_lineage(
        again.groupBy("digest").agg(
            F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size")
        )
    )
    many = F.col("group_size") > max(1, rows // (4 * partitions_of(docs.sparkSession)))
    tried = again.join(F.broadcast(groups.where(many)), "digest", "left")
    in_large = tried.where("group_size is not null")
    in_small = tried.where("group_size is null").drop("keep", "group_size").join(
        groups.where(~many), "digest"
    )
    alone = once.select("*", F.struct("doc_id", "row").alias("keep"),
                        F.lit(1).cast("long").alias("group_size"))
    return union_all([alone, in_large.select(*alone.columns), in_small.select(*alone.columns)]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("keep.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that the filter shows to be alone pass without a shuffle. Of the rest each task
    first keeps its own best row per text, and only these meet. Of rows with equal text and
    id the one with the largest hash of all columns stays.
    """
    hashed = docs.select(digest_of(text).alias("digest"))
    blocks = blocks_for(docs.count())
    bits = repeated_bits(hashed, blocks)
    carried = docs.select(
        digest_of(text).alias("digest"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")
    )
    flagged = with_possibly_repeated(carried, bits, blocks)
    order = F.struct(F.col(f"doc.`{id_column}`"), F.xxhash64("doc"))
    best = (
        flagged.where("possibly_repeated").groupBy("digest")
        .agg(F.max_by("doc", order).alias("doc"))
    )
    return flagged.where("not possibly_repeated").select("doc.*").unionAll(best.select("doc.*"))


REPORT_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
