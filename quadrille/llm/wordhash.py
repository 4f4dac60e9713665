"""Words of UTF-8 text as 64-bit hashes, computed over whole byte arrays.

A word is a run of ``[^\\x20\\x09-\\x0D]``; A-Z are lower-cased first. Both rules act on single
bytes, so no text is decoded. Equal words have equal hashes on every machine. Two different
words collide with a chance of about 2**-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np

U = np.uint64
SEGMENT = 1 << 18  # bytes hashed at once


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each value over all 64 bits (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD_BYTES = np.where(SPACE, U(0), BYTES)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(SEGMENT + 1, base, U)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, for hashes of runs by prefix sums."""
    if n <= SEGMENT:
        return tuple(x[:n] for x in _powers())
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(n, base, U)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _segment(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = np.ones(len(buf) + 2, np.int8)
    space[1:-1] = SPACE[buf]
    edge = np.diff(space)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _powers()
    if len(buf) > SEGMENT:  # one word longer than a segment
        digest = hashlib.blake2b(buf.tobytes().strip(b" \t\n\r\x0b\x0c"), digest_size=8).digest()
        return np.frombuffer(digest, U).copy(), starts, ends
    if not len(starts):
        return np.zeros(0, U), starts, ends
    total = np.add.reduceat(_WORD_BYTES[buf] * power[: len(buf)], starts)  # spaces add nothing
    return mix(total * inverse[starts]), starts, ends


def words(text: bytes | None, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the text's words, and where each begins and ends, in bytes."""
    buf = np.frombuffer(text or b"", np.uint8)
    if lower:
        buf = LOWER[buf]
    if len(buf) <= SEGMENT:
        return _segment(buf)
    parts, at = [], 0
    while at < len(buf):
        to = min(len(buf), at + SEGMENT)
        if to < len(buf):
            gaps = np.flatnonzero(SPACE[buf[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:
                while to < len(buf) and not SPACE[buf[to]]:
                    to += 1
        h, s, e = _segment(buf[at:to])
        parts.append((h, s + at, e + at))
        at = to
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def many(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Word hashes of each text; short texts are hashed together."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or b"") < SEGMENT // 2):
            size += len(texts[to] or b"") + 1
            to += 1
        if to == at + 1:
            yield words(texts[at])[0]
        else:
            h, starts, _ = words(b" ".join(t or b"" for t in texts[at:to]))
            yield from np.split(h, np.searchsorted(starts, np.cumsum([len(t or b"") + 1 for t in texts[at : to - 1]])))
        at = to


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words, one for each first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    total = np.zeros(m, U)
    factor = 0x8EBC6AF09C88C6E3
    for i in range(n):
        total += h[i : i + m] * U(factor)
        factor = factor * 0x589965CC75374CC3 & (1 << 64) - 1
    return mix(total ^ U(n))


def ngrams_at(h: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """Those of the runs that begin at these words."""
    total = np.zeros(len(at), U)
    factor = 0x8EBC6AF09C88C6E3
    for i in range(n):
        total += h[at + i] * U(factor)
        factor = factor * 0x589965CC75374CC3 & (1 << 64) - 1
    return mix(total ^ U(n))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """The distinct runs of ``n`` words, sorted; with fewer words, the whole sequence as one."""
    if not len(h):
        return h
    return np.unique(ngrams(h, min(n, len(h))))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
