"""Arrow text columns as byte arrays, handed out in bounded pieces."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one piece holds at most.
PIECE_BYTES = 2 << 20

#: Bytes of one text that are split into words at a time.
WORD_BYTES = 4 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def release_memory() -> None:
    """Give freed memory back to the system; a worker that is kept for other tasks would hold on to it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(offsets: np.ndarray, limit: int, overlap: int) -> Iterator[tuple[int, int, int, int]]:
    """Cut rows into pieces ``(first row, last row + 1, from byte, to byte)``.

    A piece has whole rows of at most ``limit`` bytes together, or a part of one
    longer row that reaches ``overlap`` bytes into the next part.
    """
    rows, at = len(offsets) - 1, 0
    while at < rows:
        if offsets[at + 1] - offsets[at] > limit:
            for start in range(int(offsets[at]), int(offsets[at + 1]), limit):
                yield at, at + 1, start, min(start + limit + overlap, int(offsets[at + 1]))
            at += 1
            continue
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        # Stop before a row that is cut by itself.
        yield at, end, int(offsets[at]), int(offsets[end])
        at = end


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, in place."""
    values ^= values >> np.uint64(32)
    values *= _MIX
    values ^= values >> np.uint64(29)
    values *= _MIX2
    values ^= values >> np.uint64(32)
    return values


def words_at_every_byte(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number each."""
    data = np.ascontiguousarray(data)
    if len(data) < 8:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(data) - 7,), np.dtype("<u8"), buffer=data, strides=(1,))


def gram_words(data: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string of ``length`` bytes (8 at least), the 8-byte numbers that cover it."""
    n = max(0, len(data) - length + 1)
    every = words_at_every_byte(data)
    starts = [*range(0, length - 7, 8)]
    if starts[-1] != length - 8:
        starts.append(length - 8)
    return [every[s : s + n] for s in starts]


def gram_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes from each position on."""
    return hashed(gram_words(data, length))


def hashed(words: Iterable[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of the numbers at each place."""
    out = None
    for word in words:
        out = mix(word ^ _MIX2 if out is None else np.bitwise_xor(out, word, out=out))
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges ``starts[i] .. starts[i] + lengths[i]``, one after the other."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts.astype(np.int64) - (ends - lengths), lengths) + np.arange(total)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values."""
    out, done = values, 1
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    if done < width:
        rest = width - done
        out = np.minimum(out[:-rest], out[rest:])
    return out


def field_names(ddl: str) -> list[str]:
    """Names of the flat columns of a DDL string."""
    return [field.split()[0] for field in ddl.split(",")]


def parts_between_words(data: bytes) -> Iterator[bytes]:
    """A long text in parts that end between words."""
    at = 0
    while len(data) - at > WORD_BYTES:
        end = at + WORD_BYTES
        ends = [e for e in (data.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) if e > at]
        if not ends:  # one word fills the part
            ends = [e for e in (data.find(c, end) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) if e >= 0]
            ends = [min(ends)] if ends else [len(data)]
        yield data[at : max(ends)]
        at = max(ends)
    yield data[at:]
