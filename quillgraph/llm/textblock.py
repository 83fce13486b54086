"""Columnar text kernels over Arrow string columns.

Every operator of this subpackage that has to look at each word or byte works on
the UTF-8 buffer of a whole Arrow batch instead of on Python strings: one pass of
numpy finds the tokens of all rows and hashes them. A block is cut to about
``BLOCK_BYTES`` so that memory follows the block and not the batch; a single text
that is longer than that makes a block of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
#: Keeps the first 0..8 bytes of a little-endian word.
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def text_blocks(column, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of slices of a string column.

    Nulls count as empty texts. ``offsets`` has one entry more than there are rows and
    starts at 0.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def lowered(column) -> pa.Array:
    """Unicode lower case, nulls kept."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return pc.utf8_lower(column)


def _word_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[ord("0") : ord("9") + 1] = True
    table[ord("a") : ord("z") + 1] = True
    table[ord("A") : ord("Z") + 1] = True
    table[ord("_")] = True
    table[128:] = True
    return table


_WORD = _word_table()


def word_mask(data: np.ndarray) -> np.ndarray:
    """True for bytes of words: ASCII letters, digits, ``_`` and every letter beyond ASCII.

    The Latin-1 and general punctuation signs (C2 80..BF, E2 80..81 xx, E3 80 xx) part words.
    """
    mask = _WORD[data]
    if len(data) and int(data.max()) >= 0xC2:
        lead = np.flatnonzero(data == 0xC2)
        mask[lead] = False
        mask[np.minimum(lead + 1, len(data) - 1)] = False
        for first, seconds in ((0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
            lead = np.flatnonzero(data == first)
            lead = lead[lead + 2 < len(data)]
            lead = lead[np.isin(data[lead + 1], seconds)]
            for k in range(3):
                mask[lead + k] = False
    return mask


def spans(mask: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run also ends at each of ``cuts``."""
    n = len(mask)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    inner = cuts[(cuts > 0) & (cuts < n)]
    before[inner] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, element by element."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for every span; equal bytes have equal hashes.

    Spans are read eight bytes at a time, through a view of the bytes at every offset.
    """
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    windows = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    size = ends - starts
    with np.errstate(over="ignore"):
        value = mix((windows[starts] & _TAIL[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(_BASE))
        going = np.flatnonzero(size > 8)
        at = 8
        while len(going):
            part = windows[starts[going] + at] & _TAIL[np.minimum(size[going] - at, 8)]
            value[going] = mix(value[going] * np.uint64(_BASE) + part)
            at += 8
            going = going[size[going] > at]
    return value


def hash_bytes(word: bytes) -> int:
    """The hash that ``hash_spans`` gives for one word."""
    data = np.frombuffer(word, np.uint8)
    return int(hash_spans(data, np.array([0]), np.array([len(data)]))[0]) if len(data) else 0


def row_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that holds each byte position."""
    return np.searchsorted(offsets, positions, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words of a block."""
    starts, ends = spans(word_mask(data), offsets)
    return starts, ends, row_of(starts, offsets)


def unique_per_row(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) in order of row and hash, with how often each occurs: rows, hashes, counts."""
    if len(hashes) == 0:
        return rows[:0], hashes[:0], rows[:0]
    order = np.lexsort((hashes, rows)) if len(rows) < 64 else _row_sort(hashes, rows)
    h, r = hashes[order], rows[order]
    new = np.empty(len(h), bool)
    new[0] = True
    np.not_equal(h[1:], h[:-1], out=new[1:])
    new[1:] |= r[1:] != r[:-1]
    at = np.flatnonzero(new)
    return r[at], h[at], np.diff(np.append(at, len(h)))


def _row_sort(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Order by row, then hash: one unstable sort by hash and a stable radix sort by row."""
    first = np.argsort(hashes)
    low = rows[first]
    top = int(rows[-1] if len(rows) else 0)
    if top < 1 << 16:
        return first[np.argsort(low.astype(np.uint16), kind="stable")]
    return first[np.argsort(low, kind="stable")]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def filled_rows(rows: np.ndarray) -> int:
    """How many different rows a sorted array of rows has."""
    return int(1 + (rows[1:] != rows[:-1]).sum()) if len(rows) else 0


def distinct_words(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, first 48 bits of the hash), sorted; the other bits of the hashes are 0."""
    low = np.uint64(0xFFFF)
    if len(rows) and int(rows[-1]) > 0xFFFF:
        rows, hashes, _ = unique_per_row(hashes & ~low, rows)
        return rows, hashes
    both = distinct((rows.astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16)))
    return (both >> np.uint64(48)).astype(np.int64), both << np.uint64(16)
