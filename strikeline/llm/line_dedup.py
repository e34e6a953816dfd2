"""Lines that many documents share, by two Bloom filters.

A first pass hashes the lines of every document, each key once a document, and sets two bits of
a blocked Bloom filter for each: one filter holds the bits seen at least once, the other those
seen at least twice. Tasks send only the places of their bits, two bytes each, by block; the
blocks are put together in a stream. A second pass tests the lines again: a key with a bit that
was not seen twice is in one document only and goes nowhere. The suspected ones are counted by
SHA-256 of the key, within the task first, and those found in ``at_least`` documents are the
repeated keys, exactly; with each comes its first occurrence. A third pass drops the lines.

The filter has ``BITS_PER_LINE`` bits a line up to ``MAX_BLOCKS`` blocks (64 MB), which bounds
what the driver holds and broadcasts. With far more lines than that it suspects more of them, up
to all, and more keys are counted by the shuffle; the result is the same. The repeated keys are
broadcast while they are counted to be few, else they are joined to the texts they occur in.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of less
than ``least_chars`` code points are never repeated. Rules for odd input: a null text is one
empty line; every row counts as a document, also rows with equal or null ids; with
``keep_first`` a repeated key keeps its first line in the document with the smallest (id, SHA-256
of the text), null ids first, and in every row equal to it; an empty table gives an empty
result. Other columns are not read. A task holds the texts of 256 rows and a million hashes.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeline.llm.arrow_rows import sliced
from strikeline.llm.common import SMALL_ROWS, filled, partitions_of, ship
from strikeline.session import cut_lineage

#: Bits in a block, so that a place is two bytes, and bytes of its bitmap.
BLOCK_BITS = 2**16
BLOCK_BYTES = BLOCK_BITS // 8
BITS_PER_LINE = 16
MAX_BLOCKS = 2**13
#: Hashes a task gathers before it sends them.
_HELD = 2**20
_BLANK = b" \t\n\v\f\r"


def keys_of(text: bytes, least_chars: int = 1) -> list[bytes | None]:
    """The key of every line, None for one too short to be repeated."""
    keys = [line.strip(_BLANK).lower() for line in text.split(b"\n")]  # bytes: A-Z only
    if least_chars <= 1:
        return [k or None for k in keys]
    return [k if len(k.decode()) >= least_chars else None for k in keys]


def blocks_for(lines: int) -> int:
    """Blocks of the filter for so many lines: a power of two within the bound."""
    wanted = max(1, -(-lines * BITS_PER_LINE // BLOCK_BITS))
    return min(MAX_BLOCKS, 2 ** (wanted - 1).bit_length())


def places_of(keys: list[bytes], blocks: int) -> np.ndarray:
    """Two places for each key, in one block: shape (keys, 2)."""
    hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
    block = (hashes >> np.uint64(32)) & np.uint64(blocks - 1)
    low = np.uint64(BLOCK_BITS - 1)
    bits = np.stack([hashes & low, (hashes >> np.uint64(16)) & low], axis=1)
    return (block[:, None] * np.uint64(BLOCK_BITS) + bits).astype(np.int64)


def _packed(places: np.ndarray) -> bytes:
    """Sorted places in a block: two bytes each, or the bitmap if that is shorter."""
    if 2 * len(places) < BLOCK_BYTES:
        return places.astype("<u2").tobytes()
    bits = np.zeros(BLOCK_BITS, bool)
    bits[places] = True
    return np.packbits(bits).tobytes()


def _bits(packed: bytes) -> np.ndarray:
    if len(packed) == BLOCK_BYTES:
        return np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
    bits = np.zeros(BLOCK_BITS, bool)
    bits[np.frombuffer(packed, "<u2")] = True
    return bits


_PART = pa.schema([("block", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def _parts(places: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a task has seen, by block."""
    seen, hits = np.unique(places, return_counts=True)
    block, place = np.divmod(seen, BLOCK_BITS)
    cuts = np.flatnonzero(np.diff(block)) + 1
    rows: dict[str, list] = {"block": [], "once": [], "twice": []}
    for own, places_here, hits_here in zip(
        np.split(block, cuts), np.split(place, cuts), np.split(hits, cuts), strict=True
    ):
        rows["block"].append(int(own[0]))
        rows["once"].append(_packed(places_here))
        rows["twice"].append(_packed(places_here[hits_here > 1]))
    yield pa.RecordBatch.from_pydict(rows, schema=_PART)


def _distinct_keys(batches: Iterator[pa.RecordBatch], least_chars: int):
    """id, text and distinct keys of every row."""
    for part in sliced(batches):
        for row_id, text in zip(part[0].to_pylist(), part[1].to_pylist(), strict=True):
            keys = dict.fromkeys(keys_of(text, least_chars))
            keys.pop(None, None)
            yield row_id, text, list(keys)


def seen_twice(docs: DataFrame, blocks: int, least_chars: int) -> DataFrame:
    """First pass over (id, text as bytes): block, bitmap of the bits seen at least twice."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, _, keys in _distinct_keys(batches, least_chars):
            if not keys:
                continue
            held.append(places_of(keys, blocks).ravel())
            n += len(keys)
            if n >= _HELD:
                yield from _parts(np.concatenate(held))
                held, n = [], 0
        if held:
            yield from _parts(np.concatenate(held))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts come in order of block; at any time the bits of one block are held."""
        block, once, twice = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if block is not None and twice.any():
                yield pa.RecordBatch.from_pydict(
                    {"block": [block], "bits": [np.packbits(twice).tobytes()]},
                    schema=pa.schema([("block", pa.int32()), ("bits", pa.binary())]),
                )

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[0] != block:
                    yield from done()
                    block, once, twice = row[0], np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
                own = _bits(row[1])
                twice |= (once & own) | _bits(row[2])
                once |= own
        yield from done()

    parts = docs.mapInArrow(gather, "block int, once binary, twice binary")
    return (
        parts.repartition(partitions_of(docs.sparkSession), "block").sortWithinPartitions("block")
        .mapInArrow(merge, "block int, bits binary")
    )


def repeated_keys(
    docs: DataFrame, at_least: int = 10, least_chars: int = 1
) -> DataFrame:
    """key (SHA-256), documents, first (id and SHA-256 of the text) of every key found in
    ``at_least`` (2 or more) rows of ``docs`` (id, text as bytes). Stored in the shared folder."""
    if at_least < 2:
        raise ValueError("a key is repeated from its second document on")
    spark = docs.sparkSession
    text = F.col(docs.columns[1]).cast("string")
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    lines = docs.agg(F.sum(breaks + 1)).first()[0] or 0
    blocks = blocks_for(lines)
    twice = np.zeros((blocks, BLOCK_BYTES), np.uint8)
    for row in seen_twice(docs, blocks, least_chars).collect():
        twice[row.block] = np.frombuffer(bytes(row.bits), np.uint8)
    shared = spark.sparkContext.broadcast(twice)  # at most MAX_BLOCKS * BLOCK_BYTES = 64 MB
    id_type = docs.schema[0].dataType.simpleString()

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value.ravel()
        counts: dict[bytes, int] = defaultdict(int)
        first: dict[bytes, tuple] = {}

        def send() -> pa.RecordBatch:
            keys = list(counts)
            return pa.RecordBatch.from_arrays([
                pa.array(keys, pa.binary()), pa.array([counts[k] for k in keys], pa.int64()),
                pa.array([first[k][1] for k in keys], id_arrow),
                pa.array([first[k][2] for k in keys], pa.binary()),
            ], ["key", "n", "id", "text_hash"])

        id_arrow = None
        for batch in batches:
            id_arrow = batch.schema[0].type
            for row_id, whole, keys in _distinct_keys(iter([batch]), least_chars):
                if not keys:
                    continue
                places = places_of(keys, blocks)
                both = ((bits[places >> 3] >> (7 - (places & 7))) & 1).all(axis=1)
                if not both.any():
                    continue
                order = (row_id is not None, row_id, hashlib.sha256(whole).digest())
                for i in np.flatnonzero(both).tolist():
                    key = hashlib.sha256(keys[i]).digest()
                    counts[key] += 1
                    if key not in first or order < first[key]:
                        first[key] = order
            if len(counts) >= _HELD // 8:
                yield send()
                counts.clear()
                first.clear()
        if counts:
            yield send()

    found = docs.mapInArrow(suspects, f"key binary, n long, id {id_type}, text_hash binary")
    return cut_lineage(
        found.groupBy("key").agg(
            F.sum("n").alias("documents"),
            F.min(F.struct("id", "text_hash")).alias("first"),
        ).where(F.col("documents") >= at_least)
    )


_OUT = "text binary, n_lines long, n_dropped long"


def _dropper(keep_first: bool, least_chars: int, shared=None):
    """For ``mapInArrow`` over (id, text[, repeated keys of the text]): rows without the lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            columns = [c.to_pylist() for c in part.columns]
            texts, sizes, dropped = [], [], []
            for i, (row_id, text) in enumerate(zip(columns[0], columns[1], strict=True)):
                repeated = shared.value if shared else {
                    bytes(r["key"]): (r["first"]["id"], bytes(r["first"]["text_hash"]))
                    for r in columns[2][i] or []
                }
                lines, whole, kept, given = text.split(b"\n"), None, [], set()
                for line, key in zip(lines, keys_of(text, least_chars), strict=True):
                    digest = hashlib.sha256(key).digest() if key and repeated else None
                    if digest not in repeated:
                        kept.append(line)
                    elif keep_first and digest not in given:
                        whole = whole or hashlib.sha256(text).digest()
                        if repeated[digest] == (row_id, whole):
                            kept.append(line)
                        given.add(digest)
                texts.append(b"\n".join(kept))
                sizes.append(len(lines))
                dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(texts, pa.binary()), pa.array(sizes, pa.int64()),
                pa.array(dropped, pa.int64()),
            ], [part.schema[0].name, "text", "n_lines", "n_dropped"])

    return run


def without_repeated_lines(
    docs: DataFrame, at_least: int = 10, least_chars: int = 1, keep_first: bool = False,
    id_column: str = "doc_id", text: str = "text", few: int = SMALL_ROWS,
) -> DataFrame:
    """doc_id, text without the lines whose key is in ``at_least`` documents, n_lines (before),
    n_dropped; one row per row. Up to ``few`` repeated keys are broadcast."""
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(F.col(id_column).alias("doc_id"), filled(text).cast("binary").alias("text"))
    id_type = slim.schema[0].dataType.simpleString()
    common = repeated_keys(slim, at_least, least_chars)
    out = f"doc_id {id_type}, {_OUT}"
    if common.count() <= few:
        table = {
            bytes(r.key): (r["first"].id, bytes(r["first"].text_hash)) for r in common.collect()
        }
        drop = _dropper(keep_first, least_chars, spark.sparkContext.broadcast(table))
        done = slim.mapInArrow(drop, out)
    else:
        done = _joined(slim, common, least_chars).mapInArrow(_dropper(keep_first, least_chars), out)
    return done.select("doc_id", F.col("text").cast("string").alias("text"), "n_lines", "n_dropped")


def _joined(slim: DataFrame, common: DataFrame, least_chars: int) -> DataFrame:
    """id, text and the repeated keys of the text. What is grouped are the keys of one text;
    equal texts are one group in it, and AQE splits the join where many rows share a text."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            rows: list[tuple[bytes, bytes]] = []
            for _, whole, own in _distinct_keys(iter([part]), least_chars):
                name = hashlib.sha256(whole).digest()
                rows += [(name, hashlib.sha256(k).digest()) for k in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.binary()) for i in range(2)],
                ["text_hash", "key"],
            )

    of_texts = (
        slim.mapInArrow(keys, "text_hash binary, key binary").distinct()
        .join(common, "key").groupBy("text_hash")
        .agg(F.collect_list(F.struct("key", "first")).alias("repeated"))
    )
    hashed = slim.withColumn("text_hash", F.unhex(F.sha2("text", 256)))
    return hashed.join(of_texts, "text_hash", "left").select("doc_id", "text", "repeated")


#: The rows of the query in SQL.
LINES_SQL = r"""
WITH lines AS (
  SELECT rowid AS row, doc_id, i, lines[i] AS line,
         translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (
    SELECT row_number() OVER () AS rowid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines
    FROM documents
  ), unnest(range(1, len(lines) + 1)) AS t(i)
), repeated AS (
  SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (r.key IS NOT NULL))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (r.key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN repeated r USING (key)
GROUP BY row, doc_id
"""
