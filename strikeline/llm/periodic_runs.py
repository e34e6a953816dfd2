"""Periodic runs of words in documents, and documents without their repeats.

A run is a stretch of words with smallest period q that no neighbouring word extends keeping
the period. Wanted are those of at least ``least_length`` words and ``least_exponent`` (4 or
more) periods. They are found by internal pattern matching:

* The suffixes of each document are sorted by prefix doubling. After the round for 2^k words,
  suffixes that begin with the same 2^k words are one range of the suffix array.
* Dyadic blocks, of 2^k words at every 2^(k-1)-th word, ask for their next occurrence in the
  neighbouring window, which is up to 2^k words ahead. It is the successor of the block's place
  among the places in its range: two descents of a wavelet tree over the suffix array.
* A block and its next occurrence at distance d <= 2^k start a progression with difference d,
  so d is a candidate period there. Let 2^(k-1) < q <= 2^k. The first block of that size in a
  run of 4 q words begins in its first 2^(k-1) words, so it and the occurrence q words on end
  inside the run; and as the block is no shorter than q there is none in between. So every
  wanted run is found with its smallest period.
* Candidates are extended as far as words d apart are the same.

Blocks that occur once in their document ask nothing. Documents of an Arrow batch are worked on
some hundred thousand words at a time, those of like length together; memory follows the longest
document (some 200 bytes a word). There is no shuffle.

Words are separated by ASCII white space. Rules for odd input: a null text has no words; rows
are taken one by one, so ids may be null or repeated; an empty table gives an empty result.
Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeline.llm.common import filled, ship

#: Words worked on together, more only for a longer document.
CHUNK = 2**18
_RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class WaveletTree:
    """Successor queries on ranges of an array of whole numbers below 2^bits."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self._levels: list[tuple[int, np.ndarray, int]] = []
        for shift in reversed(range(bits)):
            ones = (values >> shift) & 1 == 1
            zeros_before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~ones, out=zeros_before[1:])
            self._levels.append((shift, zeros_before, int(zeros_before[-1])))
            values = np.concatenate([values[~ones], values[ones]])

    def count_below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many numbers in each [low, high) are less than x."""
        count = np.zeros(len(x), np.int32)
        for shift, zeros, n_zeros in self._levels:
            low0, high0 = zeros[low], zeros[high]
            one = (x >> shift) & 1 == 1
            count += np.where(one, high0 - low0, 0).astype(np.int32)
            low = np.where(one, n_zeros + low - low0, low0)
            high = np.where(one, n_zeros + high - high0, high0)
        return count

    def smallest(self, low: np.ndarray, high: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The nth smallest number (from 0) of each [low, high)."""
        found = np.zeros(len(nth), np.int32)
        for shift, zeros, n_zeros in self._levels:
            low0, high0 = zeros[low], zeros[high]
            one = nth >= high0 - low0
            nth = np.where(one, nth - (high0 - low0), nth)
            found |= one.astype(np.int32) << shift
            low = np.where(one, n_zeros + low - low0, low0)
            high = np.where(one, n_zeros + high - high0, high0)
        return found

    def successor(
        self, low: np.ndarray, high: np.ndarray, x: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Which ranges hold a number of at least x, and the least such number of those."""
        below = self.count_below(low, high, x)
        there = np.flatnonzero(below < high - low)
        return there, self.smallest(low[there], high[there], below[there])


def _sorted_with(first: np.ndarray, second: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Order of (first, second, at), all below n + 1."""
    bits = int(n + 1).bit_length()
    if 3 * bits > 63:
        return np.lexsort((at, second, first))
    # one number each, so that plain sorting does; ``at`` rises already
    places = np.arange(len(at))
    packed = (((first.astype(np.int64) << bits) | second) << bits) | places
    packed.sort()
    return packed & ((1 << bits) - 1)


def _group_starts(new: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """For each member the slot of the first of its group; ``new`` marks these."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return slots[first]


def candidates(
    codes: np.ndarray, local: np.ndarray, sizes: np.ndarray, doc: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of dyadic blocks and their next occurrences.

    ``codes``: words as numbers, documents one after the other; for each word its place in the
    document, the document's number of words, and the document's number.
    """
    n = len(codes)
    order = _sorted_with(doc, codes, np.arange(n), max(n, int(doc.max(initial=0)) + 1))
    key_doc, key_code = doc[order], codes[order]
    new = np.ones(n, bool)
    new[1:] = (key_doc[1:] != key_doc[:-1]) | (key_code[1:] != key_code[:-1])
    suffixes = order.astype(np.int64)
    rank = np.empty(n, np.int64)
    slots = np.arange(n)
    rank[order] = _group_starts(new, slots)

    asked: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    length = 1
    while True:
        # members of groups of two and more, in documents that can hold a run of this size
        bounds = np.append(np.flatnonzero(new), len(new))
        group_size = np.repeat(np.diff(bounds), np.diff(bounds))
        members = suffixes[slots]
        keep = (group_size > 1) & (2 * length <= sizes[members])
        # a group is of one document, so it stays whole or goes
        slots, members, group_size, new = slots[keep], members[keep], group_size[keep], new[keep]
        if not len(slots):
            break
        at = local[members]
        step = max(1, length // 2)
        block = (at % step == 0) & (at + length <= sizes[members])
        low = rank[members[block]]
        asked.append((members[block], low, low + group_size[block], np.full(len(low), length)))

        after = members + length
        inside = at + length < sizes[members]
        second = np.zeros(len(members), np.int64)
        second[inside] = rank[after[inside]] + 1
        first = rank[members]
        order = _sorted_with(first, second, members, n)
        members, first, second = members[order], first[order], second[order]
        suffixes[slots] = members
        new = np.ones(len(members), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank[members] = _group_starts(new, slots)
        length *= 2

    if not asked:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place, low, high, window = (np.concatenate(x) for x in zip(*asked, strict=True))
    tree = WaveletTree(local[suffixes].astype(np.int32), max(1, int(sizes.max()).bit_length()))
    there, following = tree.successor(
        low.astype(np.int32), high.astype(np.int32), (local[place] + 1).astype(np.int32)
    )
    place, window = place[there], window[there]
    distance = following - local[place]
    near = distance <= window
    return place[near], distance[near].astype(np.int64)


def runs_in(
    codes: np.ndarray, offsets: np.ndarray, least_length: int, least_exponent: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """document, start, length and period of the runs, by document, start and period."""
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    local = np.arange(len(codes)) - offsets[doc]
    place, distance = candidates(codes, local, sizes[doc], doc)
    if not len(place):
        return (np.empty(0, np.int64),) * 4
    found: list[tuple[int, np.ndarray, np.ndarray, int]] = []
    # one look at a document for each of its candidate periods
    order = np.lexsort((place, distance, doc[place]))
    place, distance = place[order], distance[order]
    in_doc = doc[place]
    change = np.flatnonzero((np.diff(in_doc) != 0) | (np.diff(distance) != 0)) + 1
    edges = [0, *change.tolist(), len(place)]
    for a, b in zip(edges, edges[1:], strict=False):
        d, q = int(in_doc[a]), int(distance[a])
        words = codes[offsets[d]: offsets[d + 1]]
        differs = np.flatnonzero(words[:-q] != words[q:])
        stops = np.concatenate([[-1], differs, [len(words) - q]])
        right = np.unique(np.searchsorted(stops, place[a:b] - offsets[d], "right"))
        start = stops[right - 1] + 1
        length = stops[right] - start + q
        long = length >= max(least_length, least_exponent * q)
        if long.any():
            found.append((d, start[long], length[long], q))
    if not found:
        return (np.empty(0, np.int64),) * 4
    counts = [len(s) for _, s, _, _ in found]
    documents = np.repeat([f[0] for f in found], counts)
    starts = np.concatenate([f[1] for f in found])
    lengths = np.concatenate([f[2] for f in found])
    periods = np.repeat([f[3] for f in found], counts)
    order = np.lexsort((periods, starts, documents))
    return documents[order], starts[order], lengths[order], periods[order]


def _kept(n: int, starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Words that no run holds after its first period. Starts count from the first word of all."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts + periods, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.cumsum(edges[:-1]) == 0


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, and where each text's begin."""
    split = pc.ascii_split_whitespace(texts)
    words, offsets = split.flatten(), split.offsets.to_numpy()
    offsets = offsets - offsets[0]
    some = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(some)])
    return words.filter(pa.array(some)), before[offsets]


def _chunks(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of like size, of ``CHUNK`` words together or a single longer one."""
    order = np.argsort(sizes, kind="stable")
    first, total = 0, 0
    for at, row in enumerate(order):
        if total and total + sizes[row] > CHUNK:
            yield order[first:at]
            first, total = at, 0
        total += sizes[row]
    yield order[first:]


def _worker(least_length: int, least_exponent: int):
    def work(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        words, offsets = _words(texts)
        codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        d, start, length, period = runs_in(codes, offsets, least_length, least_exponent)
        keep = _kept(len(codes), offsets[d] + start, length, period)
        kept_before = np.concatenate([[0], np.cumsum(keep)])
        kept = pa.ListArray.from_arrays(
            pa.array(kept_before[offsets], pa.int32()), words.filter(pa.array(keep))
        )
        runs = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(d, np.arange(len(texts) + 1)), pa.int32()),
            pa.StructArray.from_arrays(
                [pa.array(x, pa.int64()) for x in (start, length, period)],
                ["start", "length", "period"],
            ),
        )
        return pa.RecordBatch.from_arrays(
            [ids, runs, pc.binary_join(kept, " ")], ["doc_id", "runs", "collapsed"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(1)
            sizes = pc.binary_length(texts).to_numpy() // 2 + 1  # words at most
            for rows in _chunks(sizes):
                rows = pa.array(rows)
                yield work(batch.column(0).take(rows), texts.take(rows))

    return run


def find_runs(
    docs: DataFrame, least_length: int = 6, least_exponent: int = 4, id_column: str = "doc_id",
    text: str | Column = "text",
) -> DataFrame:
    """doc_id, runs (start, length, period in words, by start and period), collapsed: the words
    that no run holds after its first period, joined by one space."""
    if least_exponent < 4:
        raise ValueError("runs of less than four periods may be missed")
    ship(docs.sparkSession)
    slim = docs.select(F.col(id_column).alias("doc_id"), filled(text).alias("text"))
    id_type = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(
        _worker(least_length, least_exponent),
        f"doc_id {id_type}, runs {_RUNS}, collapsed string",
    )


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length/period; the first of those, null if there is none."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")

    def better(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    return F.aggregate(runs, none, better)


def digests(found: DataFrame) -> DataFrame:
    """Count, strongest run and digests of what ``find_runs`` returns."""
    line = lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")
    )
    best = F.col("best")
    return found.withColumn("best", strongest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text; in every tenth document (by the CRC-32 of its id) the words from some
    place on are those of the first few from there, again and again. Documents without id stay."""
    h = F.crc32(F.col(id_column).cast("string"))
    g = F.floor(h / 10)
    words = F.filter(
        F.split(filled(text), r"[\x20\x09-\x0D]+"), lambda w: w != F.lit("")
    )
    n = F.size(F.col("words")).cast("long")
    picked = docs.select(
        F.col(id_column).alias("doc_id"), F.col(text).alias("text"), g.alias("g"),
        F.when(h % 10 == 0, words).alias("words"),
    ).withColumn("a", F.when(n > 0, F.col("g") % n))
    period = 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))
    planted = F.expr(
        "array_join(transform(words, (w, i) -> "
        "if(i < a, w, element_at(words, cast(a + (i - a) % p as int) + 1))), ' ')"
    )
    return picked.withColumn("p", period).select(
        "doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text")
    )
