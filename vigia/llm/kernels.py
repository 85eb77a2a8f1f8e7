"""Array helpers shared by the text operators: words, shingles and hashes of an Arrow text column.

Everything here works on one Arrow slice at a time inside a Spark task.  A slice
holds at most ``SLICE_BYTES`` of text (one longer text makes a slice of its own),
so a task's memory follows the longest text and not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U64 = np.uint64

#: ASCII white space: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: All bytes but 0-9, A-Z, a-z and those of characters outside ASCII.
SIGNS = np.ones(256, dtype=bool)
SIGNS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_STEP = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


with np.errstate(over="ignore"):
    #: One random 64-bit number a byte value, made by rule.
    BYTE_CODE = mix((np.arange(256, dtype=np.uint64) + U64(1)) * _STEP)

_ODD = 0xD6E8FEB86659FD93
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """odd**i and odd**-i modulo 2**64 for i in 0..n."""
    if len(_powers[0]) <= n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_ODD, _ODD_INVERSE)):
                steps = np.full(n + 1, base, dtype=np.uint64)
                steps[0] = 1
                _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches into pieces of at most ``limit`` bytes of text: (piece, bytes, offsets)."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(name))
        row, rows = 0, batch.num_rows
        while row < rows:
            stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
            stop = min(rows, max(stop, row + 1))
            yield batch.slice(row, stop - row), data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
            row = stop


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes outside ``apart`` (by default, ASCII white space)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    ink = ~apart[data]
    first = np.zeros(len(data), dtype=bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    before = np.concatenate(([False], ink[:-1]))
    starts = np.flatnonzero(ink & (first | ~before))
    last = np.concatenate((first[1:], [True]))
    after = np.concatenate((ink[1:], [False]))
    ends = np.flatnonzero(ink & (last | ~after)) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same in every task and on every machine."""
    powers, inverse = _power_tables(len(data))
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, U64), np.cumsum(BYTE_CODE[data] * powers[: len(data)], dtype=np.uint64)))
        return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _STEP)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Each row's set of ``width``-word shingles as a sorted array of 63-bit hashes.

    A-Z is lower-cased.  A row of fewer words has one shingle, its whole sequence; a row
    without words has none.
    """
    starts, ends, rows = words(data, offsets)
    code = span_hashes(LOWER[data], starts, ends)
    count = np.bincount(rows, minlength=len(offsets) - 1)
    at = np.concatenate(([0], np.cumsum(count)))
    odd = U64(0xC2B2AE3D27D4EB4F)
    out = []
    with np.errstate(over="ignore"):
        folded = np.zeros(max(0, len(code) - width + 1), U64)
        for k in range(width):
            folded = folded * odd + code[k : k + len(folded)]
        folded = mix(folded) >> U64(1)
        for row, n in enumerate(count):
            if n >= width:
                out.append(np.unique(folded[at[row] : at[row + 1] - width + 1]).view(np.int64))
            elif n:
                one = np.uint64(n)
                for x in code[at[row] : at[row + 1]]:
                    one = one * odd + x
                out.append((mix(np.array([one + _STEP])) >> U64(1)).view(np.int64))
            else:
                out.append(np.zeros(0, np.int64))
    return out


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """One Arrow list a part."""
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))
