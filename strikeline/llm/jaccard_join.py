"""Size-aware heavy-light join of documents whose shingle sets have Jaccard 0.8 or more.

Equal sets are one class, and classes are what is joined. All shingles have one order, rare
ones first: by an exact count for those that occur often, by hash for the rest. Two sets of
the wanted likeness share a shingle among the first ``n - ceil(0.8 n) + 1`` of each, and two
among the first one more. Small sets (light) therefore list each pair of their first shingles,
large ones (heavy) each single one; heavy sets also meet light ones of a size near the
boundary in the single lists. The boundary is where listing pairs stops to cost less than
scanning longer lists, by the histogram of set sizes and the share of frequent shingles.

Within a list sets are not all paired. Each is compared with the most central one, whose
shingle stands earliest; what then is in the same component needs no other comparison. Sets of
a list that stay apart are compared in a few more such rounds and at last with all of the list
that they are not connected to, so no link between different components is missed. A pair is
compared only if, from its place in the list on, both sets have enough shingles left, and if
512 parity bits of each do not differ in more places than linked sets can. Lists of
frequent shingles are cut into parts by hash, whose centres meet in a list of their own.
Comparisons read the two texts; links are never gathered anywhere.

Rules for odd input: null texts and texts without words have an empty set and no link; equal
texts and equal sets are linked; rows that repeat an id are one document; rows without an id
link nothing, and get the component of an equal set, else null; an empty table gives an empty
result. Texts are read whole. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeline.llm.arrow_rows import sliced
from strikeline.llm.common import filled, if_small, join_groups, partitions_of, ship, union_all
from strikeline.llm.components import components
from strikeline.llm.exact_dedup import BLOCK_BITS, MAX_BITS
from strikeline.llm.shingles import digest, mixed, parity, shingle_sets
from strikeline.session import cut_lineage

#: Frequent shingles that are ordered by count, the most frequent ones.
_MOST_FREQUENT = 1 << 20
_LEAST_FREQUENT = 8
#: Occurrences within a chunk of a task's texts from which a shingle is counted.
_IN_CHUNK = 2
_CHUNK = 1 << 21
_STAR_ROUNDS = 4
#: Pairs left for each entry up to which all are looked at instead of choosing more centres.
_PAIRS_PER_ENTRY = 2000
_HEAVY, _NEAR, _SUBSET = 0, 1, 2
_MARKS = [f"m{i}" for i in range(8)]
_ENTRY = (
    "sig long, salt int, parts int, id long, size int, place int, kind int, eq long"
)


def linked(overlap: int, a: int, b: int) -> bool:
    """Jaccard of at least 0.8, in whole numbers."""
    return 180 * overlap >= 80 * (a + b)


def first_shingles(n: int, together: int) -> int:
    """How many of a set's first shingles hold ``together`` of those it shares with a linked one."""
    return n - -(-4 * n // 5) + together


@dataclass(frozen=True)
class Order:
    """Frequent shingles by hash with their counts; size up to which sets are light; rows that
    a part of a list should have."""

    hashes: np.ndarray
    counts: np.ndarray
    light: int
    part: int

    def sorted(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The set in its order, and the count of each (0: rare)."""
        if not len(self.hashes):
            return shingles, np.zeros(len(shingles), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, shingles), len(self.hashes) - 1)
        count = np.where(self.hashes[at] == shingles, self.counts[at], 0)
        order = np.argsort(count, kind="stable")
        return shingles[order], count[order]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    for part in sliced(batches):
        yield part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist())


def _features(docs: DataFrame) -> DataFrame:
    """From (id, text), rows of two sorts: id, n, digest and parity bits of a document; or
    hash, count of a shingle that is frequent in a chunk of a task's texts."""
    schema = pa.schema([
        ("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()),
        ("hash", pa.int64()), ("count", pa.int64()), *[(m, pa.int64()) for m in _MARKS],
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            found, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= _IN_CHUNK
            own = {"hash": pa.array(found[often].view(np.int64)), "count": pa.array(count[often])}
            rows = int(often.sum())
            return pa.RecordBatch.from_arrays(
                [own.get(f.name, pa.nulls(rows, f.type)) for f in schema], schema=schema
            )

        for ids, sets in _sets(batches):
            marks = np.array([parity(s) for s in sets])
            own = {
                "id": pa.array(ids, pa.int64()), "n": pa.array([len(s) for s in sets]),
                "digest": pa.array([digest(s) for s in sets]),
                **{m: pa.array(marks[:, i]) for i, m in enumerate(_MARKS)},
            }
            yield pa.RecordBatch.from_arrays(
                [own.get(f.name, pa.nulls(len(ids), f.type)) for f in schema], schema=schema
            )
            held += sets
            size += sum(map(len, sets))
            if size >= _CHUNK:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    return docs.mapInArrow(
        run,
        "id long, n long, digest binary, hash long, count long, "
        + ", ".join(f"{m} long" for m in _MARKS),
    )


def _boundary(sizes: dict[int, int], frequent: float) -> int:
    """Largest size of light sets, at which the cost of all lists is least.

    ``sizes``: number of sets by bucketed size; ``frequent``: share of frequent shingles among
    all. A listed shingle or pair costs 1; a frequent shingle in a single list leads to
    comparisons, which cost as much as the set is large.
    """
    pairs = single = near = 0.0
    scan = {}
    for n, sets in sizes.items():
        p = first_shingles(n, 1)
        scan[n] = sets * p * (1 + frequent * (1 + n / 8))
        single += scan[n]
    best, cost = 1, single
    for n in sorted(sizes):
        q = first_shingles(n, 2)
        pairs += sizes[n] * q * (q - 1) / 2
        single -= scan[n]
        near = sum(scan[m] for m in sizes if m <= n and 5 * m >= 4 * (n + 1))
        if pairs > cost:
            break
        if pairs + single + near < cost:
            best, cost = n, pairs + single + near
    return best


def _entries(docs: DataFrame, order: Order, representatives: dict[bytes, int]) -> DataFrame:
    """List entries of every document (id, text) but copies of a set that has many.

    ``eq`` is the same for equal sets. Of those without a representative all are listed, and
    the one with the smallest id is kept where the list is read.
    """
    schema = pa.schema([
        ("sig", pa.int64()), ("salt", pa.int32()), ("parts", pa.int32()), ("id", pa.int64()),
        ("size", pa.int32()), ("place", pa.int32()), ("kind", pa.int32()), ("eq", pa.int64()),
    ])

    def listed(doc_id: int, shingles: np.ndarray, own: bytes) -> Iterator[tuple]:
        n = len(shingles)
        eq = int.from_bytes(own[:8], "little", signed=True)
        tokens, counts = order.sorted(shingles)
        if n <= order.light:
            q = min(n, first_shingles(n, 2))
            i, j = np.triu_indices(q, 1)
            # the second shingle of a first shared pair leaves one more than a single one would
            yield doc_id, n, eq, _SUBSET, tokens[i] * _A + tokens[j] * _B, j - 1, counts[i]
        if n > order.light or 5 * n >= 4 * (order.light + 1):
            p = first_shingles(n, 1)
            kind = _HEAVY if n > order.light else _NEAR
            yield doc_id, n, eq, kind, tokens[:p] * _C, np.arange(p), counts[:p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches):
            rows = []
            for doc_id, s in zip(ids, sets, strict=True):
                if len(s) and doc_id is not None:
                    own = digest(s)
                    if representatives.get(own, doc_id) == doc_id:
                        rows.extend(listed(doc_id, s, own))
            if not rows:
                continue
            length = [len(r[4]) for r in rows]
            wide = lambda k, kind: np.repeat(np.array([r[k] for r in rows], kind), length)  # noqa: E731, B023
            eq = wide(2, np.int64)
            counts = np.concatenate([r[6] for r in rows])
            parts = (1 + counts // order.part).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(mixed(np.concatenate([r[4] for r in rows])).view(np.int64)),
                pa.array((eq % parts).astype(np.int32)), pa.array(parts),
                pa.array(wide(0, np.int64)), pa.array(wide(1, np.int32)),
                pa.array(np.concatenate([r[5] for r in rows]).astype(np.int32)),
                pa.array(wide(3, np.int32)), pa.array(eq),
            ], schema=schema)

    return docs.mapInArrow(run, _ENTRY)


_A, _B, _C = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def _with_centres(entries: DataFrame) -> DataFrame:
    """Entries of lists (sig, salt) of two sets or more, each with the list's centre (hub,
    hub_size, hub_place) and the number of entries. Single lists without a heavy set are left
    out, and so are sets that have too little left for the smallest; but not of lists in parts."""
    ddl = (
        "sig long, salt int, parts int, id long, size int, place int, kind int, "
        "hub long, hub_size int, hub_place int, entries int"
    )
    names = ["sig", "salt", "parts", "id", "size", "place", "kind", "eq"]

    def lists(c: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        """Whole lists only, in order."""
        sig, salt = c["sig"], c["salt"]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (salt[1:] != salt[:-1])
        copy = np.zeros(len(sig), bool)
        copy[1:] = ~new[1:] & (c["eq"][1:] == c["eq"][:-1]) & (c["place"][1:] == c["place"][:-1])
        run = np.cumsum(new) - 1
        rows = np.flatnonzero(~copy)
        size = c["size"][rows].astype(np.int64)
        least = np.minimum.reduceat(size, np.flatnonzero(new[rows]))[run[rows]]
        hopeful = 9 * (size - c["place"][rows]) >= 4 * (size + least)
        rows = rows[hopeful | (c["parts"][rows] > 1)]
        if not len(rows):
            return None
        run = run[rows]
        count = np.bincount(run)
        hub = np.full(len(count), -1, np.int64)
        # a part of a list may go on elsewhere: it stays if it has one set, or no heavy one
        for able in (c["parts"][rows] > 1, c["kind"][rows] != _NEAR):
            able_run, first = np.unique(run[able], return_index=True)
            hub[able_run] = rows[able][first]
        keep = ((count[run] > 1) | (c["parts"][rows] > 1)) & (hub[run] >= 0)
        rows, of, count = rows[keep], hub[run[keep]], count[run[keep]]
        if not len(rows):
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(c[n][rows]) for n in names[:-1]]
            + [pa.array(c[n][of]) for n in ("id", "size", "place")]
            + [pa.array(count.astype(np.int32))],
            names=[*names[:-1], "hub", "hub_size", "hub_place", "entries"],
        )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
            if held is not None:
                c = {n: np.concatenate([held[n], c[n]]) for n in names}
            # the last list may go on in the next batch
            last = np.flatnonzero((c["sig"] != c["sig"][-1]) | (c["salt"] != c["salt"][-1]))
            stop = int(last[-1]) + 1 if len(last) else 0
            if stop and (out := lists({n: v[:stop] for n, v in c.items()})) is not None:
                yield out
            held = {n: v[stop:] for n, v in c.items()}
        if held is not None and (out := lists(held)) is not None:
            yield out

    return (
        entries.repartition(partitions_of(entries.sparkSession), "sig", "salt")
        .sortWithinPartitions("sig", "salt", "place", "eq", "id").mapInArrow(stream, ddl)
    )


def _enough(size_a: str, place_a: str, size_b: str, place_b: str) -> Column:
    """Whether sets that share no earlier shingle can still share enough."""
    left = F.least(F.col(size_a) - F.col(place_a), F.col(size_b) - F.col(place_b))
    return 9 * left >= 4 * (F.col(size_a) + F.col(size_b))


def _alike(size_a: str, size_b: str, a: str, b: str) -> Column:
    """Whether parity bits of two sets differ in no more places than linked sets may; rows
    without bits pass. ``a`` and ``b``: prefixes of the bits' columns."""
    apart = sum(
        (F.bit_count(F.col(f"{a}{m}").bitwiseXOR(F.col(f"{b}{m}"))) for m in _MARKS), F.lit(0)
    )
    both = F.col(size_a) + F.col(size_b)
    shared = F.floor((4 * both + 8) / 9)
    return F.coalesce(apart <= both - 2 * shared, F.lit(True))


def _prefixed(marks: DataFrame, prefix: str, *keep: tuple[str, str]) -> DataFrame:
    return marks.select(
        *[F.col(old).alias(new) for old, new in keep],
        *[F.col(m).alias(f"{prefix}{m}") for m in _MARKS],
    )


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b")


def _bits(ids: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """A table of bitmaps with one bit for each id, of at most MAX_BITS bits."""
    bits = min(MAX_BITS, max(BLOCK_BITS, 2 ** (16 * max(rows, 1) - 1).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(bits)) + 1
    return ids.select(place.alias("place")).groupBy(
        F.bitmap_bucket_number("place").alias("bucket")
    ).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap")), bits


def _asked_for(docs: DataFrame, ids: DataFrame, rows: int) -> DataFrame:
    """Rows of ``docs`` (id, text) whose id is among ``ids``, and a few others: a filter that
    keeps most texts out of the shuffle. Its bitmap, 32 MB at most, is broadcast."""
    table, bits = _bits(ids, rows)
    place = F.pmod(F.xxhash64("id"), F.lit(bits)) + 1
    byte = F.expr("substring(bitmap, cast(bit div 8 as int) + 1, 1)")
    is_set = F.call_function(
        "shiftright", F.conv(F.hex(byte), 16, 10).cast("int"), (F.col("bit") % 8).cast("int")
    ) % 2 == 1
    return (
        docs.where("id is not null")
        .withColumns({"bucket": F.bitmap_bucket_number(place), "bit": F.bitmap_bit_position(place)})
        .join(F.broadcast(table), "bucket").where(is_set).select("id", "text")
    )


def _verified(pairs: DataFrame, docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are linked, by comparing the two texts. Pairs
    whose parity bits tell that they are not linked are left out before."""
    pairs = cut_lineage(pairs)
    with_a = if_small(pairs).join(_prefixed(marks, "a_", ("id", "a"), ("n", "a_n")), "a")
    pairs = cut_lineage(
        with_a.join(_prefixed(marks, "b_", ("id", "b"), ("n", "b_n")), "b")
        .where(_alike("a_n", "b_n", "a_", "b_")).select("a", "b")
    )
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()
    texts = _asked_for(docs, ids, 2 * pairs.count())
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, np.ndarray] = {}
        for batch in sliced(batches):
            a, b, text_a, text_b = (c.to_pylist() for c in batch.columns)
            good = []
            for k in range(len(a)):
                own = shingle_sets([text_a[k]])[0]
                if (text := text_b[k]) not in last:
                    last = {text: shingle_sets([text])[0]}
                other = last[text]
                both = len(np.intersect1d(own, other, assume_unique=True))
                if linked(both, len(own), len(other)):
                    good.append(k)
            yield batch.select([0, 1]).take(pa.array(good, pa.int64()))

    return cut_lineage(
        if_small(pairs).join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        .mapInArrow(run, "a long, b long")
    )


def _apart(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries with ``label`` of lists (sig) whose sets are not all in one component, and
    ``hub_label`` of the list's centre."""
    columns = ["sig", "salt", "parts", "id", "size", "place", "kind", "centre"]
    labelled = cut_lineage(
        lists.select(*columns)
        .join(if_small(labels).withColumnRenamed("node", "id"), "id", "left")
        .withColumn("label", F.coalesce("label", "id"))
    )
    state = labelled.groupBy("sig").agg(
        F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("entries"),
        F.max(F.when(F.col("id") == F.col("centre"), F.col("label"))).alias("hub_label"),
    )
    split = cut_lineage(state.where("least <> most").drop("least", "most"))
    return cut_lineage(join_groups(labelled, split, "sig", "entries", labelled.count()))


def _all_apart(apart: DataFrame, marks: DataFrame) -> DataFrame:
    """Pairs of a list in different components, one of them not in that of the centre.

    The sets outside the centre's component are repeated for each part of the list. Parity
    bits tell most pairs of the same list apart.
    """
    apart = cut_lineage(if_small(apart).join(_prefixed(marks, "", ("id", "id")), "id"))
    members = _prefixed(apart, "other_", ("sig", "sig"), ("salt", "salt"), ("id", "other"),
                        ("size", "other_size"), ("place", "other_place"), ("kind", "other_kind"),
                        ("label", "other_label"))
    outside = apart.where("label <> hub_label").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    return _ordered(
        outside.join(members, ["sig", "salt"]).where(
            (F.col("label") != F.col("other_label"))
            & ((F.col("kind") != _NEAR) | (F.col("other_kind") != _NEAR))
            & _enough("size", "place", "other_size", "other_place")
            & _alike("size", "other_size", "", "other_")
        ), "id", "other",
    ).distinct()


def _next_centres(apart: DataFrame) -> DataFrame:
    """Pairs of the sets outside the centre's component with the most central among them."""
    outside = apart.where("label <> hub_label")
    able = F.when(F.col("kind") != _NEAR, F.struct("place", "id", "size"))
    centres = cut_lineage(
        outside.groupBy("sig").agg(F.min(able).alias("next"), F.count("*").alias("left"))
        .where("next is not null and left > 1")
        .select("sig", "left", F.col("next.id").alias("next"), F.col("next.size").alias("next_size"),
                F.col("next.place").alias("next_place"))
    )
    met = join_groups(outside, centres, "sig", "left", max(1, outside.count()))
    return _ordered(
        met.where(_enough("size", "place", "next_size", "next_place")), "id", "next"
    ).distinct()


def report(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id that links reach)."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).cast("long").alias("id"), filled(text).alias("text"))
    features = cut_lineage(_features(docs))
    own = features.where("digest is not null").select("id", "n", "digest", *_MARKS)
    groups = cut_lineage(
        own.groupBy("digest").agg(
            F.min("id").alias("class"), F.count("*").alias("copies"), F.max("n").alias("n")
        )
    )
    # sizes in steps of an eighth, so that the histogram has a few hundred rows at most
    step = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.floor(F.log2(F.greatest("n", F.lit(1)))) - 3))
    histogram = {
        int(r.at): r["count"]
        for r in groups.where("n > 0").withColumn("at", F.floor(F.col("n") / step) * step)
        .groupBy("at").count().collect()
    }
    rows, shingles = own.agg(F.count("*"), F.sum("n")).first()
    shingles = shingles or 0
    frequent = (
        features.where("hash is not null").groupBy("hash").agg(F.sum("count").alias("count"))
        .where(F.col("count") >= _LEAST_FREQUENT)
        .orderBy(F.desc("count"), "hash").limit(_MOST_FREQUENT).toPandas().sort_values("hash", key=lambda h: h.to_numpy(np.int64).view(np.uint64))
    )
    share = float(frequent["count"].sum()) / max(shingles, 1)
    spread = 4 * partitions_of(spark)
    order = Order(
        frequent["hash"].to_numpy(np.int64).view(np.uint64), frequent["count"].to_numpy(np.int64),
        _boundary(histogram, share), max(64, shingles // (5 * spread)),
    )
    # sets with more copies than a quarter of a partition's rows: at most four a partition
    many = groups.where(F.col("copies") > max(1, rows // spread)).where("class is not null")
    representatives = {bytes(r.digest): r["class"] for r in many.select("digest", "class").collect()}

    # of rows that repeat an id none has bits to go by
    marks = cut_lineage(
        own.where("id is not null and n > 0").groupBy("id").agg(
            F.max("n").alias("n"),
            *[F.when(F.count("*") == 1, F.max(m)).alias(m) for m in _MARKS],
        )
    )
    found = cut_lineage(_with_centres(_entries(docs, order, representatives)))
    # centres of the parts of long lists meet once more
    parts = found.where("parts > 1 and id = hub").select(  # a few for each long list
        "sig", F.lit(0).alias("salt"), F.lit(1).alias("parts"), "id", "size", "place", "kind",
        F.col("id").alias("eq"),
    )
    above = cut_lineage(_with_centres(parts))
    top = above.groupBy("sig").agg(F.first("hub").alias("top"))  # one row per list cut in parts
    central = union_all([found.select("id", "hub", "size", "place", "hub_size", "hub_place"),
                         above.select("id", "hub", "size", "place", "hub_size", "hub_place")])
    tested = _ordered(
        central.where(_enough("size", "place", "hub_size", "hub_place")), "id", "hub"
    ).distinct()
    links = _verified(tested, docs, marks)
    labels = components(links)
    # lists of two sets are done
    apart = (
        found.where("entries > 2 or parts > 1").join(F.broadcast(top), "sig", "left")
        .withColumn("centre", F.coalesce("top", "hub"))
        .select("sig", "salt", "parts", "id", "size", "place", "kind", "centre")
    )
    for k in range(_STAR_ROUNDS):
        apart = _apart(apart, labels)
        counts = apart.groupBy("sig").agg(
            F.count("*").alias("n"), F.count(F.when(F.col("label") != F.col("hub_label"), 1)).alias("out")
        ).agg(F.sum(F.col("n") * F.col("out")).alias("pairs"), F.sum("n").alias("n")).first()
        if not counts.n:
            return _finished(own, groups, labels, rows)
        # a pair is a few comparisons of numbers, so more centres only pay if very many are left
        if counts.pairs <= _PAIRS_PER_ENTRY * counts.n or k == _STAR_ROUNDS - 1:
            break
        links = cut_lineage(links.unionByName(_verified(_next_centres(apart), docs, marks)))
        labels = components(links)
    more = _verified(_all_apart(apart, marks), docs, marks)
    return _finished(own, groups, components(links.unionByName(more)), rows)


def _finished(own: DataFrame, groups: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """Every document with the label of its class; classes meet labels once each."""
    labelled = cut_lineage(
        groups.select("digest", "copies", "class", F.col("n").alias("class_n")).join(
            if_small(labels).withColumnRenamed("node", "class"), "class", "left"
        ).withColumn("component", F.coalesce("label", "class"))
        .select("digest", "copies", "component", "class_n")
    )
    joined = join_groups(own.drop(*_MARKS), labelled, "digest", "copies", rows)
    return joined.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` but those linked to a row that comes before them.

    Rows are joined by a key of their own, written once with them, so each is judged by its
    own text. Of linked rows the one with the smallest id stays, null ids last, and with it
    rows that repeat its id and text.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    keyed = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    moved = cut_lineage(
        report(keyed, row, text).where("doc_id <> component_id")
        .select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    )
    linked = moved.unionByName(
        moved.select(F.col("component").alias("row"), "component").distinct()
    )
    slim = keyed.select(
        F.col(row).alias("row"), F.col(id_column).alias("id"),
        F.sha2(filled(text), 256).alias("digest"),
    )
    members = cut_lineage(slim.join(if_small(linked), "row"))
    groups = cut_lineage(
        members.groupBy("component").agg(
            F.min(F.struct(F.col("id").isNull().alias("last"), "id", "digest", "row")).alias("kept"),
            F.count("*").alias("copies"),
        )
    )
    repeats = (F.col("id") == F.col("kept.id")) & (F.col("digest") == F.col("kept.digest"))
    dropped = cut_lineage(
        join_groups(members, groups, "component", "copies", members.count())
        .where((F.col("row") != F.col("kept.row")) & ~F.coalesce(repeats, F.lit(False)))
        .select(F.col("row").alias(row))
    )
    return keyed.join(dropped, row, "left_anti").select(*docs.columns)
