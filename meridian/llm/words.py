"""Hashes of the words of many texts at once. A word is a run of bytes other than space and \\t..\\r; A-Z count as a-z."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64, a bijection of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of ordered pairs."""
    return mix(mix(a + U(0x9E3779B97F4A7C15)) + b * U(0xD6E8FEB86659FD93))


#: A random-looking 64-bit number for each byte.
BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_B, _INV = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), U(base))
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=U)
    return have[:n]


def rolling(a: np.ndarray, base: int = _B) -> np.ndarray:
    """Prefix sums p with p[j] - p[i] = base**i times the polynomial hash of a[i:j]."""
    p = np.zeros(len(a) + 1, U)
    np.cumsum(BYTE[a] * powers(base, len(a)), out=p[1:])
    return p


def spans(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes a."""
    gap = np.ones(len(a) + 2, bool)
    gap[1:-1] = _SPACE[a]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word in data: its hash, and where it starts and ends."""
    a = _LOWER[np.frombuffer(data, np.uint8)]
    start, end = spans(a)
    p = rolling(a)
    return mix((p[end] - p[start]) * powers(_INV, len(a) + 1)[start] + (end - start).astype(U)), start, end


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of each word in data: its hash and the place where it starts."""
    return word_spans(data)[:2]


def encoded(values) -> list[bytes]:
    """UTF-8 of an Arrow column of strings; null is empty."""
    return [b"" if x is None else x for x in values.cast("binary").to_pylist()]


PIECE = 1 << 18


def pieces(text: bytes, most: int = PIECE) -> Iterator[bytes]:
    """Cut a long text between words, so that work on it needs bounded memory (a single longer word stays whole)."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(c, at, at + most) for c in (b" ", b"\n", b"\t"))
        if cut <= at:
            found = [x for x in (text.find(c, at + most) for c in (b" ", b"\n", b"\t")) if x >= 0]
            cut = min(found, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def docs_words(texts: list[bytes], most: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """In blocks of about `most` bytes: the number of the block's first text, hashes and bytes of its words, and the words in each text."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < most):
            size += len(texts[to]) + 1
            to += 1
        if to == at + 1 and size > most:
            h, start, end = (np.concatenate(x) for x in zip(*(word_spans(x) for x in pieces(texts[at], most))))
            yield at, h, end - start, np.array([len(h)])
        else:
            h, start, end = word_spans(b"\n".join(texts[at:to]))
            ends = np.cumsum([len(x) + 1 for x in texts[at:to]])
            yield at, h, end - start, np.diff(np.searchsorted(start, ends), prepend=0)
        at = to


def docs_hashes(texts: list[bytes], most: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """docs_words without the words' bytes."""
    return ((at, h, n) for at, h, _, n in docs_words(texts, most))


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of their values."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return (keys[first], *(np.add.reduceat(v[order], first) for v in values))


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Equal ranges of the hash space: rises with h."""
    return (((h >> U(32)) * U(n)) >> U(32)).astype(np.int64)


def majority(ones: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """64-bit numbers: a bit is 1 if over half of the votes are."""
    return np.packbits(2 * ones > votes[:, None], axis=1, bitorder="little").view(U).reshape(-1)


_LANES = U(0x0101010101010101)


def lane_votes(h: np.ndarray, cell: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each cell: set bits by place, number of votes. Eight bits of a hash at a time are summed in the bytes of one number."""
    n = np.bincount(cell, minlength=cells)
    ones = np.zeros((cells, 64), np.int32)
    if len(h):
        order = np.argsort(cell, kind="stable")
        cell, h = cell[order], h[order]
        rank = np.arange(len(h)) - (np.cumsum(n) - n)[cell]
        start = np.flatnonzero((rank % 255 == 0) | (np.diff(cell, prepend=-1) != 0))  # a byte holds up to 255 votes
        sums = np.stack([np.add.reduceat((h >> U(i)) & _LANES, start) for i in range(8)], axis=1)
        part = sums.view(np.uint8).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 64)
        ones[cell[start]] = part
        again = np.flatnonzero(rank[start] > 0)
        if len(again):
            whole = np.flatnonzero(np.isin(cell[start], cell[start[again]]))
            ones[cell[start[whole]]] = 0
            np.add.at(ones, cell[start[whole]], part[whole])
    return ones, n
