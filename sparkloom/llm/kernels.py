"""Vectorised byte and token kernels shared by the operators (numpy on Arrow buffers, no per-row Python).

A batch of texts is one UTF-8 byte array plus offsets. Work that needs 8 bytes per byte or word goes
through pieces of about ``PIECE`` elements, so memory follows the batch, not the hash width.
All hashes are fixed functions of the content: equal content has equal hashes on every executor.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 17
#: Elements of a winnowed piece, which fit a core's cache.
SCAN = 1 << 16
WORD64 = (1 << 64) - 1
#: Odd multipliers of the polynomial hashes; different ones give independent hashes.
MULTS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def splitmix(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit values from splitmix64."""
    z = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(seed)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values (murmur finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


#: One 64-bit value for each byte, so that bytes can serve as tokens.
BYTE_VALUES = splitmix(256, 7) | np.uint64(1)


def bytes_table(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry mask that is true in the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Separators of words `[^\x20\x09-\x0D]+`.
SPACE = bytes_table((0x20, 0x20), (0x09, 0x0D))
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@cache
def _powers(mult: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    def row(m: int) -> np.ndarray:
        out = np.full(n, m, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return row(mult), row(pow(mult, -1, 1 << 64))


def powers(mult: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n (or more) powers of mult and of its inverse, modulo 2^64."""
    return _powers(mult, max(PIECE + 4096, 1 << (max(n, 1) - 1).bit_length()) if n > PIECE + 4096 else PIECE + 4096)


def prefix(values: np.ndarray, mult: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(mult, len(values))[0][: len(values)], out=out[1:])
    return out


def hash_ranges(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, mult: int = MULTS[0], table: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of tokens[start:end] for each range. ``table`` turns byte tokens into values.

    Ranges may be in any order if they are short; sorted starts cost one pass.
    """
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    order = None
    if np.any(starts[1:] < starts[:-1]):
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, low + PIECE, "left")))
        high = int(ends[i:j].max())
        part = tokens[low:high]
        sums = prefix(part if table is None else table[part], mult)
        s, e = starts[i:j] - low, ends[i:j] - low
        got = mix((sums[e] - sums[s]) * powers(mult, len(part) + 1)[1][s] + (e - s).astype(np.uint64))
        if order is None:
            out[i:j] = got
        else:
            out[order[i:j]] = got
        i = j
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and n + 1 offsets; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, (_, offsets, data) = len(column), column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and n + 1 offsets into them by text."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, mult: int = MULTS[0]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the words, their offsets by text and a 64-bit hash of each."""
    starts, ends, by_text = word_spans(data, offsets, separators)
    return starts, ends, by_text, hash_ranges(data, starts, ends, mult, BYTE_VALUES)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values: minima of runs of a power of two, doubled, then two that overlap."""
    if len(values) < width:
        return values[:0]
    run = 1
    while 2 * run <= width:
        values = np.minimum(values[:-run], values[run:])
        run *= 2
    rest = width - run
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def segments(tokens: np.ndarray, offsets: np.ndarray, q: int, window: int, table: np.ndarray | None = None):
    """Runs of windows that agree on their winnowed anchor.

    Each window of ``window`` tokens inside one text selects the q-gram of least hash in it (the last
    one of equals), which depends on nothing but the window's content. Returned, for each run of
    neighbouring windows with the same selection: text index, first window's start in the text,
    number of windows, the anchor's hash, and how far the anchor starts from the first window. Long texts are cut into pieces of windows; nothing is left out.
    """
    texts, firsts, counts, anchors, offs = [], [], [], [], []
    n, width = len(tokens), window - q + 1
    mask = np.uint64((1 << 22) - 1)
    for p0 in range(0, n, SCAN):
        p1 = min(n, p0 + SCAN)
        part = tokens[p0 : min(n, p1 + window - 1)]
        if len(part) < window:
            break
        sums = prefix(part if table is None else table[part], MULTS[1])
        grams = sums[q:] - sums[:-q]
        grams *= powers(MULTS[1], len(part) + 1)[1][: len(part) - q + 1]
        grams ^= grams >> np.uint64(32)
        grams *= np.uint64(MULTS[0])
        at = np.arange(len(grams), dtype=np.uint64)
        least = sliding_min((grams & ~mask) | (mask - at), width)[: p1 - p0]
        chosen = (mask - (least & mask)).astype(np.int64)
        # no window reaches over the end of its text
        inside = np.ones(len(chosen), bool)
        ends = offsets[np.searchsorted(offsets, p0, "right") : np.searchsorted(offsets, p1 + window)] - p0
        over = (ends[:, None] - np.arange(1, window)).ravel()
        inside[over[(over >= 0) & (over < len(chosen))]] = False
        starts = np.flatnonzero(inside)
        if not len(starts):
            continue
        sel = chosen[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (sel[1:] != sel[:-1]) | (starts[1:] != starts[:-1] + 1)
        new = np.flatnonzero(new)
        first = starts[new] + p0
        text = np.searchsorted(offsets, first, "right") - 1
        texts.append(text)
        firsts.append(first - offsets[text])
        counts.append(np.diff(np.append(new, len(starts))))
        anchors.append(grams[sel[new]])
        offs.append(sel[new] - starts[new])
    if not texts:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), none
    return tuple(np.concatenate(x) for x in (texts, firsts, counts, anchors, offs))


def cover(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mask of the positions inside any of the ranges."""
    steps = np.zeros(length + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, one after the other."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)
