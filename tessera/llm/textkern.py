"""NumPy kernels on the words of a batch of whole texts.

A batch is one byte buffer; every step (finding words, hashing words, shingles and
windows) is a handful of array operations over the buffer, with no loop over words.
Words are maximal runs without the ASCII white space ``\\x20 \\x09-\\x0D``.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For :func:`alnum_words`: every ASCII byte that is neither letter nor digit.
_NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])

_P1, _P2, _P3 = U(0x9E3779B185EBCA87), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
_P4, _P5 = U(0x85EBCA77C2B2AE63), U(0x27D4EB2F165667C5)


def encode(texts: list[str | None], lower: bool = False) -> list[bytes]:
    """UTF-8; null counts as empty; ``lower`` maps A-Z only."""
    out = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    return [t.lower() for t in out] if lower else out


class Words:
    """The words of a batch of texts.

    ``buf`` holds every word followed by one space; word ``w`` is
    ``buf[start[w]:end[w]]`` and text ``d`` has the words ``first[d]`` up to
    ``first[d + 1]``."""

    __slots__ = ("buf", "start", "end", "first")

    def __init__(self, texts: list[bytes], breaks: np.ndarray = _SPACE):
        raw = np.frombuffer(b"\n".join([*texts, b""]) or b"\n", np.uint8)
        stops = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        gap = breaks[raw]
        last = gap.copy()
        last[1:] &= ~gap[:-1]
        last[0] = False
        at = np.flatnonzero(last)
        keep = ~gap
        keep[at] = True
        self.buf = raw[keep]
        self.end = np.flatnonzero(last[keep])
        self.buf[self.end] = 32
        self.start = np.concatenate(([0], self.end[:-1] + 1)) if len(self.end) else self.end
        self.first = np.concatenate(([0], np.searchsorted(at, stops, "left"))).astype(np.int64)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The number of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def alnum_words(texts: list[bytes]) -> Words:
    """Words cut at every ASCII character that is neither letter nor digit."""
    return Words(texts, _NOT_ALNUM)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of every ``buf[start:end]``, all spans of one length at a time."""
    out = np.empty(len(start), U)
    if not len(start):
        return out
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    lane8 = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    lane4 = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
    length = end - start
    order = np.argsort(length, kind="stable")
    sizes, begin = np.unique(length[order], return_index=True)
    s = U(seed)
    with np.errstate(over="ignore"):
        for n, lo, hi in zip(sizes.tolist(), begin, [*begin[1:], len(order)], strict=True):
            ids = order[lo:hi]
            at = start[ids].copy()
            if n > 256 or (n >= 64 and len(ids) < 8):
                whole = memoryview(padded)
                out[ids] = [xxhash.xxh64_intdigest(whole[a : a + n], seed) for a in at.tolist()]
                continue
            left = n
            if n >= 32:
                v = [np.full(len(ids), x, U) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
                while left >= 32:
                    for j in range(4):
                        v[j] = _rotl(v[j] + lane8[at + 8 * j] * _P2, 31) * _P1
                    at += 32
                    left -= 32
                h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
                for x in v:
                    h = (h ^ (_rotl(x * _P2, 31) * _P1)) * _P1 + _P4
            else:
                h = np.full(len(ids), s + _P5, U)
            h += U(n)
            while left >= 8:
                h = _rotl(h ^ (_rotl(lane8[at] * _P2, 31) * _P1), 27) * _P1 + _P4
                at += 8
                left -= 8
            if left >= 4:
                h = _rotl(h ^ (lane4[at].astype(U) * _P1), 23) * _P2 + _P3
                at += 4
                left -= 4
            for _ in range(left):
                h = _rotl(h ^ (padded[at].astype(U) * _P5), 11) * _P1
                at += 1
            h ^= h >> U(33)
            h *= _P2
            h ^= h >> U(29)
            h *= _P3
            h ^= h >> U(32)
            out[ids] = h
    return out


_R = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
#: Values that are summed at once; a longer span is a piece of its own.
_PIECE = 1 << 20
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    out = []
    for base in (_R, pow(_R, -1, 1 << 64)):
        x = np.full(n + 1, base, U)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out


def _pow(n: int) -> list[np.ndarray]:
    """``_R**i`` and ``_R**-i`` modulo 2**64 for i up to n; tables of a piece's length are kept."""
    if n > _PIECE:
        return _power_tables(n)
    if not _powers:
        _powers.extend(_power_tables(_PIECE))
    return _powers


def _spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Mixed polynomial hashes of ``values[start:end]`` (or of what ``table`` holds for them), by
    differences of prefix sums, a piece at a time; starts and ends ascend."""
    out = np.empty(len(start), U)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + _PIECE, "right")))
        base = start[lo]
        part = values[base : end[hi - 1]]
        if table is not None:
            part = table[part]
        up, down = _pow(len(part))
        total = np.zeros(len(part) + 1, U)
        np.cumsum(part * up[: len(part)], out=total[1:])
        a, b = start[lo:hi] - base, end[lo:hi] - base
        out[lo:hi] = mix((total[b] - total[a]) * down[a])
        lo = hi
    return out


def _table(key: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93) + U(key))


def word_hashes(w: Words, key: int = 1) -> np.ndarray:
    """A 64-bit hash of every word, the same in every batch."""
    return _spans(w.buf, w.start, w.end, _table(key))


def window_starts(w: Words, n: int) -> np.ndarray:
    """The words at which a window of ``n`` words of one text starts."""
    if len(w.start) < n:
        return np.empty(0, np.int64)
    inside = np.zeros(len(w.start) + 1, np.int64)
    stops = w.first[1:]
    # every start in the last n-1 words of its text is out
    lo = np.maximum(stops - (n - 1), w.first[:-1])
    np.add.at(inside, lo, 1)
    np.add.at(inside, stops, -1)
    return np.flatnonzero(np.cumsum(inside[:-1]) == 0)


def window_hashes(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every window of ``n`` words."""
    return _spans(hashes, starts, starts + n)
