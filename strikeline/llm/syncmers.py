"""Document fingerprints from closed syncmers.

A run of ``K`` characters is an anchor if, of the ``S``-character runs inside it, one with the
smallest hash lies at its start or end. That depends on nothing around it, so a passage has
the same anchors wherever it stands. A fingerprint holds all of them, in the order of the
text, each with its place. The likeness of two fingerprints is that of two sequences of
anchors: the longest common subsequence, as a share of the anchors of either that are not
matched and those that are.

Rules for odd input: null texts count as empty; an empty text has the empty fingerprint, which
is like another empty one (1) and unlike all others (0); a text without anchors, as it is too
short, has one for the whole text; equal texts have equal fingerprints. Long texts are worked
through in blocks, which changes nothing since anchors need no context. Rows that repeat an id
follow each other by text, null ids come last; an empty table gives an empty result. Only id
and text are read.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeline.llm.arrow_rows import sliced
from strikeline.llm.common import filled, partitions_of, ship

K, S = 12, 5
_BITS = 40
#: Characters worked on at once.
_BLOCK = 1 << 20
#: Equal pairs for each anchor of the shorter sequence up to which they are gone through.
_MATCHES = 64
_BITS_AT_ONCE = 1 << 14
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread the hash over all bits, in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(31)
    return h


def _anchors(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each closed syncmer among the characters."""
    n = len(codes)
    if n < K:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    wide = codes.astype(np.uint64)
    wide += np.uint64(1)
    h = wide[: n - S + 1].copy()
    for j in range(1, S):
        h *= _FACTOR
        h += wide[j : n - S + 1 + j]
    _mixed(h)
    width = K - S + 1
    least, span = h, 1
    while span < width:  # smallest of runs of 1, 2, 4, ... and then of the whole width
        step = min(span, width - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    count = len(least)
    at = np.flatnonzero((least == h[:count]) | (least == h[width - 1 : width - 1 + count]))
    k = wide[at]
    for j in range(1, K):
        k *= _FACTOR
        k += wide[at + j]
    return at, _mixed(k) >> np.uint64(64 - _BITS)


Sketch = tuple[np.ndarray, np.ndarray]


def _long(codes: np.ndarray) -> Sketch:
    ids, places = [], []
    for start in range(0, max(1, len(codes) - K + 1), _BLOCK):
        at, h = _anchors(codes[start : start + _BLOCK + K - 1])
        ids.append(h)
        places.append(at + start)
    return np.concatenate(ids), np.concatenate(places)


def sketches(texts: list[str]) -> list[Sketch]:
    """Ids and places of each text's anchors, in order. Short texts are worked on together."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    out: list[Sketch] = [None] * len(texts)  # type: ignore[list-item]
    group: list[int] = []

    def finish() -> None:
        if not group:
            return
        lengths = np.array([len(codes[i]) for i in group])
        ends = np.cumsum(lengths)
        at, h = _anchors(np.concatenate([codes[i] for i in group]))
        owner = np.searchsorted(ends, at, side="right")
        inside = at + K <= ends[owner]  # not across two texts
        at, h, owner = at[inside], h[inside], owner[inside]
        bounds = np.searchsorted(owner, np.arange(len(group) + 1))
        for k, i in enumerate(group):
            a, b = bounds[k], bounds[k + 1]
            out[i] = h[a:b], at[a:b] - (ends[k] - lengths[k])
        group.clear()

    held = 0
    for i, c in enumerate(codes):
        if len(c) > _BLOCK:
            out[i] = _long(c)
            continue
        if held + len(c) > _BLOCK:
            finish()
            held = 0
        group.append(i)
        held += len(c)
    finish()
    for i, t in enumerate(texts):
        if t and not len(out[i][0]):
            digest = hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()
            whole = int.from_bytes(digest[:8], "little") >> (64 - _BITS)
            out[i] = np.array([whole], np.uint64), np.array([0], np.int64)
    return out


def fingerprint(sketch: Sketch) -> str:
    """The sketch as text: base64 of six bytes for each anchor, five for its id (most
    significant first) and one for the characters since the last one or the start, which are
    at most K - S."""
    ids, places = sketch
    packed = np.empty((len(ids), 6), np.uint8)
    packed[:, :5] = ids.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    packed[:, 5] = np.diff(places, prepend=0)
    return base64.b64encode(packed.tobytes()).decode()


def unpacked(mark: str) -> Sketch:
    """The sketch that a fingerprint holds."""
    packed = np.frombuffer(base64.b64decode(mark), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(packed), 8), np.uint8)
    wide[:, 3:] = packed[:, :5]
    return wide.view(">u8")[:, 0].astype(np.uint64), np.cumsum(packed[:, 5], dtype=np.int64)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; exact, whatever repeats."""
    least = min(len(a), len(b))
    differ = np.flatnonzero(a[:least] != b[:least])
    start = int(differ[0]) if len(differ) else least
    a, b = a[start:], b[start:]
    least = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - least :][::-1] != b[len(b) - least :][::-1])
    end = int(differ[0]) if len(differ) else least
    a, b = a[: len(a) - end], b[: len(b) - end]
    both = np.intersect1d(a, b)
    if not len(both):
        return start + end
    a, b = (x[np.isin(x, both)] for x in (a, b))
    a, b = np.searchsorted(both, a), np.searchsorted(both, b)
    if len(a) < len(b):
        a, b = b, a
    matches = int(np.bincount(a) @ np.bincount(b))
    if matches <= _MATCHES * len(b):
        where: list[list[int]] = [[] for _ in both]
        for k in range(len(a) - 1, -1, -1):
            where[a[k]].append(k)
        ends: list[int] = []  # longest run of rising places
        for i in b.tolist():
            for p in where[i]:  # falling, so that an anchor is matched once
                k = bisect_left(ends, p)
                ends[k : k + 1] = [p]
        return start + end + len(ends)
    # many repeats: one bit for each place of the longer sequence, in blocks that hand on carries
    found, carries, shorter = 0, [0] * len(b), b.tolist()
    for at in range(0, len(a), _BITS_AT_ONCE):
        bits: dict[int, int] = {}
        block = a[at : at + _BITS_AT_ONCE].tolist()
        for k, i in enumerate(block):
            bits[i] = bits.get(i, 0) | 1 << k
        width = len(block)
        whole = row = (1 << width) - 1
        for j, i in enumerate(shorter):
            met = row & bits.get(i, 0)
            total = row + met + carries[j]
            carries[j] = total >> width
            row = (total | (row - met)) & whole
        found += width - row.bit_count()
    return start + end + found


def likeness(a: Sketch, b: Sketch) -> float:
    """Share of the anchors of both that both have, in the same order."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    common = _common(a[0], b[0])
    return common / (len(a[0]) + len(b[0]) - common)


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
_DDL = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of every document; no shuffle."""
    ship(docs.sparkSession)
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, texts = (c.to_pylist() for c in batch.columns)
            marks = [fingerprint(s) for s in sketches(texts)]
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "fingerprint": marks})

    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"), filled(text).alias("text")
    ).mapInArrow(work, "doc_id long, fingerprint string")


_PARTS_PER_PARTITION = 4
_ROWS = 256


def with_next(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """Rows by falling id, dealt to ranges: part, ahead, doc_id, text.

    Each range also gets, with ``ahead`` = 1, the row that follows its last one: the first
    of the next range, after the last the first of all. The driver sees the cut points and
    the largest id of each range.
    """
    lowest = -(2**63)
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), filled(text).alias("text"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(lowest)).alias("rank"),
    ).withColumn("position", F.col("rank").cast("double"))
    parts = _PARTS_PER_PARTITION * partitions_of(docs.sparkSession)
    cuts = rows.approxQuantile("position", [i / parts for i in range(1, parts)], 1 / (10 * parts))
    # a bound below all positions, since there must be one cut
    splits = [float("-inf"), *sorted({-1e300, *cuts}), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="position", outputCol="part").transform(
        rows
    ).select("doc_id", "text", "rank", F.col("part").cast("int").alias("part"))
    heads = sorted(
        (h.part, h.first) for h in ranged.groupBy("part").agg(F.max("rank").alias("first")).collect()
    )
    if not heads:
        return ranged.withColumn("ahead", F.lit(0)).select("part", "ahead", "rank", "doc_id", "text")
    before = [(first, heads[(i + 1) % len(heads)][0]) for i, (_, first) in enumerate(heads)]
    targets = docs.sparkSession.createDataFrame(before, "rank long, target int")
    ahead = (
        ranged.drop("part").where(F.col("rank").isin([r for r, _ in before]))
        .join(F.broadcast(targets), "rank")
        .select(F.col("target").alias("part"), F.lit(1).alias("ahead"), "rank", "doc_id", "text")
    )
    own = ranged.select("part", F.lit(0).alias("ahead"), "rank", "doc_id", "text")
    return own.unionByName(ahead)


def edit_test(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited one, with what they are like.

    One shuffle of the texts by ranges of ids; a task then streams its rows in order and
    holds a slice of them.
    """
    ship(docs.sparkSession)
    def emit(rows: list[tuple[int | None, str]], following: str) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        nexts = [*texts[1:], following]
        changed = [edited(t, n) for t, n in zip(texts, nexts, strict=True)]
        own = sketches([*texts, following])
        after = sketches(changed)
        return pa.RecordBatch.from_arrays([
            pa.array([i for i, _ in rows], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array([fingerprint(s) for s in own[:-1]], pa.string()),
            pa.array([fingerprint(s) for s in after], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, after, strict=False)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
        ], schema=_SCHEMA)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        size = 0
        for batch in sliced(batches):
            for is_ahead, doc_id, value in zip(
                *[batch.column(c).to_pylist() for c in ("ahead", "doc_id", "text")], strict=True
            ):
                if is_ahead:
                    if held:  # of rows that repeat the id the first follows
                        yield emit(held, value)
                    held, size = [], 0
                    continue
                if len(held) >= _ROWS or held and size >= _BLOCK:
                    yield emit(held, value)
                    held, size = [], 0
                held.append((doc_id, value))
                size += len(value)

    rows = with_next(docs, id_column, text)
    return (
        rows.repartition(partitions_of(docs.sparkSession), "part")
        .sortWithinPartitions("part", "ahead", F.desc("rank"), "text")
        .select("ahead", "doc_id", "text").mapInArrow(stream, _DDL)
    )
