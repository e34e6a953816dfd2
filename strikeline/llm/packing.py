"""Packing by power-of-two decomposition.

The ids of a document are cut into pieces of the longest allowed length and then into pieces
of falling powers of two, as its binary length says. Every piece is a sequence of its own:
no sequence crosses documents, none is padded, and sequences of equal length form a bucket.

Ids come from a ``tokenizers`` file. Its vocabulary is one of pretokens with marked ends, so
plain Latin texts are cut into pretokens, of which each distinct one is encoded once per worker
and kept in a cache of bounded size. Other texts are cut at spaces and line ends only, where
every pretoken ends, and the chunks are left to the library.

Rules for odd input: a null text counts as empty, and an empty text has just the end id;
repeated rows and null ids are packed like others; an empty table gives an empty result.
Texts are read whole, a slice of rows at a time. Only id and text are read.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeline.llm.arrow_rows import mapped
from strikeline.llm.common import ship

#: Pretokens a worker keeps before it starts anew: as many of some 200 bytes, fewer of longer
#: ones. Those of more than so many characters are not kept beyond the rows they are in.
CACHE_ENTRIES = 1_000_000
_ENTRY_BYTES = 200
LONGEST_KEPT = 64
LONGEST = 2048
END_ID = 1

_PLAIN = re.compile(r"[\n -~À-ÖØ-öø-ÿ]*")
_PRETOKEN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\n a-z0-9ß-öø-ÿ]+"
)
_WORD_END = "</w>"
#: Pretokens given to the library as one text.
_JOINED = 500


def cut(text: str) -> list[str]:
    """Parts of a text that the tokenizer encodes independently of each other.

    A text that may hold a special token is cut at white space only: the library looks for
    these before anything else.
    """
    if _PLAIN.fullmatch(text) and "<|" not in text:
        return _PRETOKEN.findall(text.lower())
    return text.replace("\n", " ").split(" ")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.entries = entries
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith(_WORD_END)]] = True
        self.known: dict[str, bytes] = {}
        self.held = 0  # bytes, about

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4") for x in found]

    def _learn(self, parts: list[str]) -> None:
        """Encode parts that the cache lacks. Pretokens go together in one text, whose ids
        are cut where a pretoken ends."""
        words = [p for p in parts if _PRETOKEN.fullmatch(p) and p.isascii() and p.islower()]
        for at in range(0, len(words), _JOINED):
            some = words[at : at + _JOINED]
            ids = self._encode([" ".join(some)])[0]
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                raw, to = ids.tobytes(), [0, *(4 * stops).tolist()]
                for word, a, b in zip(some, to[:-1], to[1:], strict=True):
                    self.known[word] = raw[a:b]
        rest = [p for p in parts if p not in self.known]
        for part, ids in zip(rest, self._encode(rest), strict=True):
            self.known[part] = ids.tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.held > self.entries * _ENTRY_BYTES:
            self.known.clear()
            self.held = 0
        known = self.known
        found, gaps, new = [], [], set()
        for parts in map(cut, texts):
            ids = list(map(known.get, parts))  # each part is looked up once
            found.append(ids)
            unknown = [k for k, x in enumerate(ids) if x is None]
            if unknown:
                gaps.append((ids, parts, unknown))
                new.update([parts[k] for k in unknown])
        if new:
            self._learn(list(new))
        for ids, parts, unknown in gaps:
            for k in unknown:
                ids[k] = known[parts[k]]
        for part in new:
            if len(part) > LONGEST_KEPT:
                del known[part]
            else:  # the text, its ids and what the two objects and their entry take
                self.held += len(part) + len(known[part]) + 150
        return [b"".join(ids) for ids in found]


@lru_cache(maxsize=2)
def encoder(path: str, entries: int) -> Encoder:
    return Encoder(path, entries)


def lengths_of(n: int, longest: int = LONGEST) -> list[int]:
    """Piece lengths of a document of n ids: whole ones, then its binary digits."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(
    docs: DataFrame, tokenizer: str, longest: int = LONGEST, end_id: int = END_ID,
    with_ids: bool = False, id_column: str = "doc_id", text: str = "text",
    entries: int = CACHE_ENTRIES,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and ``ids`` on request. No shuffle; ``longest`` is a power of two.

    ``entries`` bounds a worker's cache: more memory for less work, the same result.
    A sequence id is made of the partition and the row's place in it, so a task that runs
    again gives the same ids.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    fields = [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
    end = np.array([end_id], "<u4").tobytes()

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {name: [] for name, _ in fields}
        own = encoder(tokenizer, entries).ids([t or "" for t in rows["text"]])
        for doc_id, ids in zip(rows["doc_id"], own, strict=True):
            ids += end
            start, total = 0, len(ids) // 4
            for length in lengths_of(total, longest):
                piece = ids[4 * start : 4 * (start + length)]
                out["doc_id"].append(doc_id)
                out["start"].append(start)
                out["length"].append(length)
                out["ids_crc32"].append(zlib.crc32(piece))
                out["doc_tokens"].append(total)
                if with_ids:
                    out["ids"].append(np.frombuffer(piece, "<u4"))
                start += length
        return out

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    ship(docs.sparkSession)
    pieces = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return pieces.mapInArrow(
        mapped(work, pa.schema(fields)), ddl + ", ids array<int>" * with_ids
    ).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids,
    )


def store_buckets(pieces: DataFrame, path: str) -> None:
    """Write sequences with their ids by length, so that a batch has one length."""
    pieces.write.partitionBy("length").parquet(path)
