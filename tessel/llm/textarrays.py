"""Texts as flat numpy arrays: byte buffers, word bounds and substring hashes.

All hashes here are polynomial over random 64-bit byte or word values modulo 2**64, finished by a mixer, so the hash of
any substring comes from two prefix sums. Nothing is seeded by the process: the same text has the same hash everywhere.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)

#: Bytes that separate words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Lower-cases A-Z and turns every ASCII byte but 0-9 and a-z into a space; bytes of other characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FOLD_TABLE = np.frombuffer(FOLD, dtype=np.uint8)

_powers = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2**64; the longest table so far is kept."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(n + 1, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 16_000_000:
            _powers[base] = have
    return have[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def prefix_sums(values: np.ndarray, base: int = BASE) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values), base)[:-1], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hashes of the items start..end-1; spans of different length differ by the caller's salt, not here."""
    inverse = powers(len(sums) - 1, pow(base, -1, 1 << 64))
    return mix((sums[end] - sums[start]) * inverse[start])


def byte_sums(data: np.ndarray) -> np.ndarray:
    return prefix_sums(BYTE_VALUES[data])


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts (one more entry than rows). A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def word_bounds(data: np.ndarray, rows: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and where each row's words start (one more entry than rows)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(rows), np.int64)
    solid = ~space[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = solid[:-1]
    edges = rows[:-1][rows[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = solid[1:]
    last = rows[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, rows)


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name for each word, by its bytes alone. Works through the bytes in pieces of whole words."""
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + 1_000_000, side="right")))
        a, b = starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo]
        out[lo:hi] = span_hash(byte_sums(data[starts[lo] : ends[hi - 1]]), a, b) + (b - a).astype(np.uint64) * U64(0xA24BAED4963EE407)
        lo = hi
    return mix(out)


def between(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n items lie in [starts[i], ends[i]) for some i. Counts in place, in 32 bits."""
    steps = np.zeros(n + 1, dtype=np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    np.cumsum(steps, out=steps)
    return steps[:-1] > 0


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n items lie in [s, s + length) for some start."""
    return between(starts, starts + length, n)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
