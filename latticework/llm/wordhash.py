"""Vectorised word and shingle hashing over Arrow string columns.

Words are the contracts' ``[^\x20\x09-\x0D]+`` after lower-casing A-Z.  A word's hash is a 64-bit
polynomial over per-byte random values, finished by a multiply-xorshift mix; it is computed for all
words of a block at once from prefix sums, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at a time: bounds the scratch arrays to some tens of MB.
BLOCK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    buffers = column.buffers()
    if not n or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    data = np.frombuffer(buffers[2], np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Blocks of about BLOCK bytes that end at a text's end or at white space."""
    at, total = 0, len(data)
    while at < total:
        end = min(at + BLOCK, total)
        if end < total:
            k = int(np.searchsorted(offsets, end, "right")) - 1
            if offsets[k] > at:
                end = int(offsets[k])
            else:
                reach = end
                while True:  # one long text: back to the last blank, or on to the next
                    blanks = np.flatnonzero(_BLANK[data[at:reach]])
                    if len(blanks):
                        end = at + int(blanks[-1]) + 1
                        break
                    if reach >= int(offsets[k + 1]):
                        end = int(offsets[k + 1])
                        break
                    reach = min(reach + BLOCK, int(offsets[k + 1]))
        yield at, end
        at = end


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, bounds): text i has the words ``bounds[i]:bounds[i + 1]``."""
    data, offsets = text_bytes(column)
    hashes, starts = [], []
    for a, z in _cuts(data, offsets):
        part = _LOWER[data[a:z]]
        n = z - a
        full = ~_BLANK[part]
        first, last = full.copy(), full.copy()
        first[1:] &= ~full[:-1]
        last[:-1] &= ~full[1:]
        edges = offsets[(offsets > a) & (offsets < z)] - a  # texts meet here: a word ends and another begins
        first[edges] |= full[edges]
        last[edges - 1] |= full[edges - 1]
        s = np.flatnonzero(first)
        e = np.flatnonzero(last) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[part] * _power(_BASE, n, "base"), out=sums[1:])
        h = (sums[e] - sums[s]) * _power(_INV, n, "inverse")[s]
        hashes.append(mix(h + (e - s).astype(np.uint64)))
        starts.append(s + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(start, offsets, "left").astype(np.int64)


def shingles(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle of n words, bounds).  A text of fewer words, but one at least, is one shingle as a whole."""
    count = np.diff(bounds)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    rolled = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - n + 1 + k] if len(rolled) else rolled
    rolled = mix(rolled)
    out = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    to = np.zeros(len(bounds), np.int64)
    np.cumsum(out, out=to[1:])
    text = np.repeat(np.arange(len(count)), out)
    at = np.arange(to[-1]) - to[text] + bounds[text]
    short = count[text] < n
    result = np.zeros(to[-1], np.uint64)
    result[~short] = rolled[at[~short]]
    for i in np.flatnonzero(short):
        t = text[i]
        value = np.uint64(0)
        with np.errstate(over="ignore"):
            for x in h[bounds[t] : bounds[t + 1]]:
                value = value * np.uint64(0xA0761D6478BD642F) + x
        result[i] = mix(np.array([value + np.uint64(count[t])]))[0]
    return result, to


def slices(batch: pa.RecordBatch, column: int, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``size`` bytes of text, so that what is computed for a run stays small."""
    if not len(batch):
        return
    _, offsets = text_bytes(batch.column(column))
    first = 0
    while first < len(batch):
        last = int(np.searchsorted(offsets, offsets[first] + size, "left"))
        last = min(max(last, first + 1), len(batch))
        yield batch.slice(first, last - first)
        first = last


def sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, bounds = shingles(*words(column), n)
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        yield np.unique(h[a:z])


#: Counters of a set's histogram.
CELLS = 256


def histogram(h: np.ndarray) -> bytes:
    """How many of a set's hashes fall in each of CELLS cells; empty where a cell overflows a byte.

    Two sets share at most the sum of their cells' minima, so histograms rule pairs out exactly.
    """
    cells = np.bincount((h >> np.uint64(20)).astype(np.int64) & (CELLS - 1), minlength=CELLS)
    return cells.astype(np.uint8).tobytes() if len(h) and cells.max() < 256 else b""


def set_digest(h: np.ndarray) -> tuple[int, int]:
    """128 bits that two sets share only when equal, but for chance."""
    with np.errstate(over="ignore"):
        a, b = mix(h).sum(dtype=np.uint64), mix(h * np.uint64(0xA0761D6478BD642F) + np.uint64(1)).sum(dtype=np.uint64)
    return int(np.int64(a.astype(np.int64))), int(np.int64(b.astype(np.int64)))
