"""Whole-batch numpy helpers over the texts of an Arrow batch.

Every function here sees one Arrow batch (or a slice of about a megabyte of
it); Spark deals the batches out and shuffles what they produce.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))
POSITION_BITS = 21
_powers = [np.ones(1, U), np.ones(1, U)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    return h


SYMBOLS = mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F))
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SYMBOLS_LOWER = SYMBOLS[LOWER]
#: The bytes 0x09-0x0D and 0x20.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse for i < n, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, b in enumerate((BASE, BASE_INVERSE)):
            p = np.full(size, b, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column without nulls, and the n + 1 offsets into them."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive rows, as (first, end), of about ``size`` bytes; a longer row comes alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums S with S[e] - S[s] = the polynomial of values[s:e], shifted by s."""
    out = np.empty(len(values) + 1, U)
    out[0] = 0
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] that depends on the values and their order only."""
    inverse = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U) * SYMBOLS[7])


def grams_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """spans_hash of every run of ``width`` values."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, U)
    return mix((sums[width:] - sums[:n]) * powers(n)[1])


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by doubling."""
    done = 1
    while done * 2 <= width:
        a = np.minimum(a[:-done], a[done:])
        done *= 2
    return np.minimum(a[: len(a) - (width - done)], a[width - done :]) if done < width else a


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run of non-space bytes within a row; row offsets into the words."""
    full = ~space[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty(len(full), bool)
    before[0] = False
    before[1:] = full[:-1]
    inside = offsets[:-1][(offsets[:-1] < len(data))]
    before[inside] = False  # a word never spans rows
    starts = np.flatnonzero(full & ~before)
    after = np.empty(len(full), bool)
    after[-1] = False
    after[:-1] = full[1:]
    ends_at = offsets[1:][offsets[1:] > 0] - 1
    after[ends_at] = False
    ends = np.flatnonzero(full & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, symbols: np.ndarray = SYMBOLS) -> np.ndarray:
    """A 64-bit value for each word, equal for equal words."""
    return spans_hash(prefix_sums(symbols[data]), starts, ends)


def minimiser_runs(values: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """Consecutive windows of one row that share their least gram hash, as runs.

    A window is ``window`` values; its minimiser is the least hash among its
    grams of ``gram`` values, so equal windows have equal minimisers. Per run:
    row, start and n (the windows' first place and count), anchor (the
    minimiser), rhash (of all values the run covers) and inner (the minimiser
    stands at two places, so that a window may repeat inside the run).
    """
    empty = {k: np.zeros(0, np.int64) for k in ("row", "start", "n", "anchor", "rhash")} | {"inner": np.zeros(0, bool)}
    lengths = np.diff(offsets)
    if len(values) < window or lengths.max(initial=0) < window:
        return empty
    sums = prefix_sums(values)
    low = U((1 << POSITION_BITS) - 1)
    high = grams_hash(sums, gram) & ~low
    long = len(high) > int(low)  # one very long row: its places don't fit, so every run counts as inner
    at = np.zeros(1, U) if long else np.arange(len(high), dtype=U)
    span = window - gram + 1
    left = sliding_min(high | at, span)
    right = sliding_min(high | (low - at), span)
    row = np.flatnonzero(lengths >= window)
    counts = lengths[row] - window + 1
    row = np.repeat(row, counts)
    start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[row]
    least = left[start] & ~low
    new = np.empty(len(start), bool)
    new[0] = True
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    begin, end = start[first], start[last]
    return {
        "row": row[first],
        "start": begin - offsets[row[first]],
        "n": last - first + 1,
        "anchor": (least[first] >> U(POSITION_BITS)).astype(np.int64),
        "rhash": spans_hash(sums, begin, end + window).view(np.int64),
        "inner": np.full(len(first), True) if long else (left[begin] & low) != (low - (right[end] & low)),
    }


def covered(runs: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """The union of [first, last + width) over runs of window starts, as sorted disjoint spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + width))
        else:
            out.append((a, b + width))
    return out


def flag_runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true values."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
