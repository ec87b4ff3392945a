"""Words of whole Arrow batches, found and hashed by array operations on the bytes of the texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from pulselake.llm.common import slices

LONG_WORD = 256
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)  # of the first bytes of eight
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts, and where each text begins and ends among them; null is empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    flat = np.frombuffer(data, np.uint8, int(bounds[-1] - bounds[0]), int(bounds[0])) if data is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    return flat, bounds[:-1], bounds[1:]


def byte_spans(column: pa.Array, limit: int, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of at most so many bytes; a longer text comes alone."""
    _, begins, ends = text_bytes(column)
    yield from slices((ends - begins).tolist(), limit, rows)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def spans(inside: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marked bytes, none of which goes beyond its text: their starts, stops and texts."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    starts, stops = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    full = ends > begins
    starts[begins[full]] = inside[begins[full]]
    stops[ends[full] - 1] = inside[ends[full] - 1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(stops) + 1, np.searchsorted(begins, first, side="right") - 1


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs, of which a fixed ``a`` makes a bijection of ``b``."""
    x = a ^ (b * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number; zeros stand beyond the end."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of stretches of bytes, taken eight bytes at a time; words of equal length up to eight never collide."""
    lengths = stops - starts
    eight = eight_bytes(data)
    out = mix(np.full(len(starts), seed, np.uint64), lengths.astype(np.uint64))
    short = np.flatnonzero(lengths <= LONG_WORD)
    at = 0
    while len(short):
        size = np.minimum(lengths[short] - at, 8)
        out[short] = mix(out[short], eight[starts[short] + at] & MASKS[size])
        at += 8
        short = short[lengths[short] > at]
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : stops[i]].tobytes(), seed)
    return out
