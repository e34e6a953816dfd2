"""Hashed word shingles of whole texts, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
#: Bytes hashed at once; longer texts are cut between words.
_BLOCK = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the hash over all bits, in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(31)
    return h


# one random number for each byte value, the same for A-Z as for a-z
_OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
_OF_BYTE[65:91] = _OF_BYTE[97:123]
_OF_BYTE[_SPACE] = 0
_PLACE = mixed(np.arange(1001, 1001 + WORDS, dtype=np.uint64) * _ODD) | np.uint64(1)


def _pieces(raw: bytes) -> list[bytes]:
    """``raw`` cut between words into pieces of about a block; a longer word stays whole."""
    pieces, at = [], 0
    while len(raw) - at > _BLOCK:
        window = np.frombuffer(raw, np.uint8, _BLOCK, at)
        spaces = np.flatnonzero(_SPACE[window[1:]])
        if len(spaces):
            stop = at + 1 + int(spaces[-1])
        else:
            later = np.flatnonzero(_SPACE[np.frombuffer(raw, np.uint8, offset=at + _BLOCK)])
            if not len(later):
                break
            stop = at + _BLOCK + int(later[0])
        pieces.append(raw[at:stop])
        at = stop
    pieces.append(raw[at:])
    return pieces


def _word_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word in the bytes."""
    codes = np.frombuffer(blob, np.uint8)
    inside = ~_SPACE[codes]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    number = np.cumsum(first) - 1
    place = np.arange(len(codes)) - starts[np.maximum(number, 0)]
    longest = int(place[inside].max()) + 1
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest, _ODD, np.uint64)]))
    values = _OF_BYTE[codes]
    values *= power[np.where(inside, place, 0)]
    return starts, mixed(np.add.reduceat(values, starts))


def _of_words(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles of one text, given its words."""
    n = len(words)
    if n == 0:
        return words
    if n < WORDS:
        whole = (words * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)
        return mixed(np.array([whole], np.uint64))
    h = words[: n - WORDS + 1] * _PLACE[0]
    for j in range(1, WORDS):
        h += words[j : n - WORDS + 1 + j] * _PLACE[j]
    return np.unique(mixed(h))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of five words; of all
    its words if there are fewer; none without words. A-Z count as lower case."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(raw)
    group: list[int] = []

    def finish() -> None:
        starts, words = _word_hashes(b"\n".join([raw[i] for i in group]))
        ends = np.cumsum([len(raw[i]) + 1 for i in group])
        bounds = np.searchsorted(starts, ends).tolist()
        a = 0
        for i, b in zip(group, bounds, strict=True):
            out[i] = _of_words(words[a:b])
            a = b

    held = 0
    for i, r in enumerate(raw):
        if len(r) > _BLOCK:
            out[i] = _of_words(np.concatenate([_word_hashes(p)[1] for p in _pieces(r)]))
            continue
        if group and held + len(r) > _BLOCK:
            finish()
            group, held = [], 0
        group.append(i)
        held += len(r) + 1
    if group:
        finish()
    return out


def parity(shingles: np.ndarray) -> np.ndarray:
    """512 bits as eight whole numbers: bit k tells if an odd number of shingles hash to k.
    The bits in which two sets differ are at most as many as the shingles in which they do."""
    odd = np.bincount((shingles & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def digest(shingles: np.ndarray) -> bytes:
    """Sixteen bytes that stand for the set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
