"""Encoding and decoding with merge-type SentencePiece vocabularies.

A text is encoded by an agenda of adjacent symbol pairs: the pair whose piece has the highest
score is merged first, of equal ones the leftmost, and each merge offers its new neighbours.
No piece of such a vocabulary has a space sign after another character, so each run of space
signs starts a new segment which is merged by itself. Each distinct segment goes through the
agenda once per worker and stays in a cache of bounded size; with each Arrow batch its new
segments are also encoded by the library and compared. Whole texts are decoded by the library,
and must give the text again. ``agrees`` tells whether both held.

Rules for odd input: null texts count as empty, and an empty text has only the begin and end
ids; a character outside the vocabulary becomes its UTF-8 bytes' ids; repeated rows and null
ids are encoded like others; an empty table gives an empty result. Texts are never cut short.
Only id and text are read. Models whose normaliser changes more than spaces are refused.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeline.llm.arrow_rows import mapped
from strikeline.llm.common import ship

SPACE = "▁"
#: Segments, and parts of them, that a worker keeps before it starts anew: as many of some 200
#: bytes, fewer of longer ones. Those of more than so many characters are not kept beyond the
#: rows they are in.
CACHE_ENTRIES = 600_000
_ENTRY_BYTES = 200
LONGEST_KEPT = 64
#: Characters that a normaliser would change if it did more than mark spaces.
_PROBE = "a  B\tＡﬁ　é\n"


class Agenda:
    """A model's vocabulary, and segments encoded so far.

    Ids are kept as unsigned 32-bit integers in the machine's order, which is little-endian on
    every machine that Spark's native Arrow and compression libraries are built for.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        from sentencepiece import SentencePieceProcessor

        lib = SentencePieceProcessor(model_file=path)
        self.library, self.entries = lib, entries
        if lib.normalize(_PROBE) != SPACE + _PROBE.replace(" ", SPACE):
            raise ValueError("this model's normaliser changes texts")
        every = range(lib.get_piece_size())
        plain = [
            i for i in every
            if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))
        ]
        self.id_of = {lib.id_to_piece(i): i for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("this model has pieces that cross a word's end")
        self.cost_of = {lib.id_to_piece(i): -lib.get_score(i) for i in plain}
        self.byte_id = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # two characters that stand side by side in no piece never end up in one symbol
        self.meeting = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}
        self.begin, self.end = (array("I", [i]).tobytes() for i in (lib.bos_id(), lib.eos_id()))
        self.known: dict[str, bytes] = {}
        self.merged: dict[str, bytes] = {}
        self.fresh: list[str] = []  # parts merged for the rows at hand
        self.held = 0  # bytes, about
        self.differing: set[str] = set()

    def merge(self, part: str) -> list[int]:
        """Ids of ``part``, whose characters may all merge with each other."""
        symbols: list[str] = list(part)
        n = len(symbols)
        cost_of = self.cost_of.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            piece = symbols[i] + symbols[i + 1]
            cost = cost_of(piece)
            if cost is not None:
                agenda.append((cost, i, piece))
        heapify(agenda)
        while agenda:
            _, i, piece = heappop(agenda)
            j = after[i]
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != piece:
                continue  # one of the two has merged elsewhere
            symbols[i], symbols[j] = piece, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                cost = cost_of(right := piece + symbols[k])
                if cost is not None:
                    heappush(agenda, (cost, i, right))
            h = before[i]
            if h >= 0:
                cost = cost_of(left := symbols[h] + piece)
                if cost is not None:
                    heappush(agenda, (cost, h, left))
        ids: list[int] = []
        for s in symbols:
            if s:
                known = self.id_of.get(s)
                ids.extend([known] if known is not None else [self.byte_id[b] for b in s.encode()])
        return ids

    def segment_ids(self, segment: str) -> bytes:
        """The segment is cut where no merge can reach across; each part is merged once."""
        meeting, merged, start, parts = self.meeting, self.merged, 0, []
        for k in range(1, len(segment)):
            if segment[k - 1 : k + 1] not in meeting:
                parts.append(segment[start:k])
                start = k
        parts.append(segment[start:] if start else segment)
        for part in parts:
            if part not in merged:
                merged[part] = array("I", self.merge(part)).tobytes()
                self.fresh.append(part)
        return merged[parts[0]] if len(parts) == 1 else b"".join([merged[p] for p in parts])

    def _learn(self, words: list[str]) -> None:
        """Encode words (segments without their first space sign) and compare with what the
        library makes of them in one text."""
        known = self.known
        for word in words:
            known[word] = self.segment_ids(SPACE + word)
        shown = [w for w in words if w]  # a lone space sign shows only inside a text
        together = array("I", self.library.encode(" ".join(shown))).tobytes()
        if together != b"".join([known[w] for w in shown]):
            for word in shown:
                if array("I", self.library.encode(word)).tobytes() != known[word]:
                    self.differing.add(word)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """For each text its ids without begin and end, and if its segments agreed."""
        if self.held > 2 * self.entries * _ENTRY_BYTES:
            self.known.clear()
            self.merged.clear()
            self.held = 0
        split = [words_of(t) for t in texts]
        known = self.known
        new = {w for s in split for w in s if w not in known}
        if new:
            self._learn(list(new))
        found = [
            (b"".join([known[w] for w in s]),
             not self.differing or self.differing.isdisjoint(s)) for s in split
        ]
        self._forget_long(known, new)
        self._forget_long(self.merged, self.fresh)
        self.fresh = []
        return found

    def _forget_long(self, cache: dict[str, bytes], added: Iterable[str]) -> None:
        """Drop long new entries and count the bytes of the others."""
        for text in added:
            if len(text) > LONGEST_KEPT:
                del cache[text]
            else:  # the text, its ids and what the two objects and their entry take
                self.held += len(text) + len(cache[text]) + 150

    def decode(self, ids: list[int]) -> str:
        """Text of ``ids``: pieces joined, byte ids as UTF-8, space signs as spaces."""
        lib, parts, raw = self.library, [], b""
        for i in ids:
            if lib.is_byte(i):
                raw += bytes([int(lib.id_to_piece(i)[3:5], 16)])
                continue
            parts.append(raw.decode(errors="replace"))
            raw = b""
            if not lib.is_control(i):
                parts.append(lib.id_to_piece(i))
        text = "".join(parts) + raw.decode(errors="replace")
        return text.replace(SPACE, " ")[text.startswith(SPACE) :]


def words_of(text: str) -> list[str]:
    """Segments of a text, each without its first space sign."""
    if not text:
        return []
    words = text.replace(SPACE, " ").split(" ")
    if "" not in words:
        return words
    joined, spaces = [], 0
    for w in words:
        if w:
            joined.append(SPACE * spaces + w)
            spaces = 0
        else:
            spaces += 1
    if spaces:
        joined.append(SPACE * (spaces - 1))
    return joined


@lru_cache(maxsize=2)
def agenda(path: str) -> Agenda:
    return Agenda(path)


def encode(
    docs: DataFrame, model: str, with_ids: bool = False,
    id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, agrees, and on
    request ``ids`` and ``decoded``. No shuffle."""
    fields = [
        ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
        ("decoded_sha256", pa.string()), ("agrees", pa.bool_()),
    ]
    if with_ids:
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {name: [] for name, _ in fields}
        own = agenda(model)
        texts = [t or "" for t in rows["text"]]
        for doc_id, t, (inner, agreed) in zip(
            rows["doc_id"], texts, own.encode(texts), strict=True
        ):
            ids = own.begin + inner + own.end
            numbers = array("I", ids).tolist()
            decoded = own.library.decode(numbers)
            out["doc_id"].append(doc_id)
            out["n_tokens"].append(len(numbers))
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            out["agrees"].append(agreed and decoded == t.replace(SPACE, " "))
            if with_ids:
                out["ids"].append(numbers)
                out["decoded"].append(decoded)
        return out

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean"
    ship(docs.sparkSession)
    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(
        mapped(work, pa.schema(fields)), ddl + ", ids array<int>, decoded string" * with_ids
    )
