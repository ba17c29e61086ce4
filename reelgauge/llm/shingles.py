"""Word shingles of whole texts as sets of 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np

#: Bytes of a text whose words are hashed at once.
BLOCK = 1 << 22

_POWERS = np.cumprod(np.full(256, 0x100000001B3 * 2 + 1, np.uint64))
_U = np.uint64
_NONE = np.zeros(0, np.uint64)
_BLANK = re.compile(rb"[ \t-\r]")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every word; words are runs without ASCII white space."""
    data = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(~((data == 32) | ((data >= 9) & (data <= 13))))
    if not len(at):
        return _NONE, np.zeros(0, np.int64)
    new = np.ones(len(at), bool)
    new[1:] = np.diff(at) > 1
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, sizes)
    # beyond 256 bytes the number of the block of 256 is mixed in
    letters = (data[at].astype(np.uint64) + _U(1)) * _POWERS[place & 255] ^ ((place >> 8).astype(np.uint64) << _U(40))
    return mix(np.add.reduceat(letters, first) + sizes.astype(np.uint64)), at[first]


def _long(data: bytes) -> np.ndarray:
    """Hashes of the words of a long text, block by block; blocks end at white space."""
    out, start = [], 0
    while start < len(data):
        blank = _BLANK.search(data, start + BLOCK)
        end = blank.start() if blank else len(data)
        out.append(_words(data[start:end])[0])
        start = end
    return np.concatenate(out) if out else _NONE


def _shingles(word: np.ndarray, size: int) -> np.ndarray:
    joined = np.zeros(max(len(word) - size + 1, 0), np.uint64)
    for k in range(size):
        joined = joined * _U(0x9E3779B97F4A7C15) + word[k : k + len(joined)]
    return mix(joined)


def _whole(word: np.ndarray) -> np.ndarray:
    whole = np.full(1, len(word), np.uint64)
    for k in range(len(word)):
        whole = mix(whole * _U(0xD6E8FEB86659FD93) + word[k : k + 1])
    return whole


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; empty without words.

    A-Z count as lower case.  A text of fewer than ``size`` words is one shingle.  Long
    texts are hashed in blocks, the others together.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    short = [p + b" " if len(p) <= BLOCK else b" " for p in parts]
    word, place = _words(b"".join(short))
    bounds = np.searchsorted(place, np.cumsum([0] + [len(p) for p in short]))
    joined = _shingles(word, size)
    out = []
    for part, begin, end in zip(parts, bounds[:-1], bounds[1:], strict=True):
        if len(part) > BLOCK:
            own = _long(part)
            out.append(np.unique(_shingles(own, size)) if len(own) >= size else _whole(own) if len(own) else _NONE)
        elif end - begin >= size:
            out.append(np.unique(joined[begin : end - size + 1]))
        else:
            out.append(_whole(word[begin:end]) if end > begin else _NONE)
    return out


def signature(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs; equal sets have equal ones."""
    with np.errstate(over="ignore"):
        a = mix(shingles ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
        b = mix(shingles * _U(0xDA942042E4DD58B5)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))
