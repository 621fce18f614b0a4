"""Vectorised text helpers for Arrow batches: word spans, 64-bit word hashes and window hashes.

Everything works on the UTF-8 bytes of a batch. All delimiters of the word
definitions here are ASCII, so a byte table decides what belongs to a word.
Temporary arrays are bounded by CHUNK bytes of text, whatever a document's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once; a longer document is a piece of its own.
PIECE = 4 << 20
CHUNK = 1 << 20
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
_BASE = 0x9E3779B97F4A7C15
_WINDOW = np.uint64(0xD6E8FEB86659FD93)


def byte_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: `[^\x20\x09-\x0D]+`
NOT_WHITE = ~byte_table(WHITE)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z: digits, a-z and all non-ASCII.
ALNUM = byte_table(bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets (rows + 1); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most limit bytes of text, or one row."""
    for batch in batches:
        offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))[1]
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and bounds: row i has the words bounds[i]:bounds[i+1]."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = table[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[edges] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64."""
    size = 1 << max(CHUNK.bit_length(), n.bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = (np.full(size, v, np.uint64) for v in (_BASE, pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit Rabin-Karp hash of each span's content, never 0, equal for equal bytes.

    Prefix sums of byte times power give every span's polynomial by one
    subtraction; the inverse power takes its place in the text out again.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, "right")))
        low, high = int(starts[at]), int(ends[to - 1])
        up, down = _power_tables(high - low)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        at = to
    out[out == 0] = 1
    return out


def rolling(words: np.ndarray, lengths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """For each length n in ascending order, the Rabin-Karp hash of every n consecutive words (mixed)."""
    value, reach = np.zeros(len(words), np.uint64), 0
    for n in lengths:
        while reach < n:
            value = value[: max(0, len(words) - reach)] * _WINDOW + words[reach:] if reach < len(words) else value[:0]
            reach += 1
        yield n, mix(value)


def row_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def covered(n_words: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which words lie in a window of that length beginning at one of the starts."""
    edge = np.zeros(n_words + 1, np.int32)
    edge[starts] += 1
    np.subtract.at(edge, starts + length, 1)
    return np.cumsum(edge[:-1]) > 0


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over each row's words."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def code_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points of each span."""
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=sums[1:])
    return sums[ends] - sums[starts]
