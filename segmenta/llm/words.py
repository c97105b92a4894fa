"""Words of many texts at once: boundaries and 64-bit hashes in numpy, over the bytes of an Arrow string column."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes looked at together; a longer text is taken alone.
PIECE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1


def per_process(name, make: Callable):
    """What make() gives, made once in a worker and kept for its later tasks (their code is unpickled anew each time)."""
    kept = sys.__dict__.setdefault("_segmenta_per_process", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n at least."""
    def make(size):
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        return both[0], both[1]

    # what a longer text needs is not kept
    return per_process("powers", lambda: make(PIECE_BYTES + 1)) if n <= PIECE_BYTES + 1 else make(n)


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each (n + 1); NULL counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and off[-1] > off[0] else np.empty(0, np.uint8)
    return raw, off - off[0]


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about `limit` bytes."""
    raw, off = byte_view(texts)
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, to, raw[off[at]:off[to]], off[at:to + 1] - off[at]
        at = to


def mixed(h: np.ndarray) -> np.ndarray:
    """Finish a hash so that all its bits depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for every span."""
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, never across two texts."""
    before = np.empty(len(inside), bool)
    after = np.empty(len(inside), bool)
    if len(inside):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        edges = off[1:-1]
        before[edges[edges < len(inside)]] = False
        after[edges[edges > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def owner(off: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The row each span lies in."""
    return np.searchsorted(off, starts, "right") - 1


def byte_table(pattern) -> np.ndarray:
    """A lookup table of the bytes for which pattern(byte) holds."""
    return np.fromiter((bool(pattern(b)) for b in range(256)), bool, 256)


#: Everything but blank and \x09-\x0D; and the lower-casing of A-Z alone.
NOT_BLANK = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
LOWER = np.fromiter((b + 32 if 65 <= b <= 90 else b for b in range(256)), np.uint8, 256)
#: Letters and digits of ASCII and every byte of a longer character.
ALNUM = byte_table(lambda b: b >= 128 or chr(b).isalnum())
LETTER = byte_table(lambda b: b >= 128 or chr(b).isalpha())
