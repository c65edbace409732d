"""Texts as one array of folded code points, for vectorised character features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = 32
#: No letter has a code point from here on.
_LIMIT = 0x33500
_fold: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Code point -> lower-case letter, or SPACE for anything that is not a letter (combining marks and apostrophes included)."""
    global _fold
    if _fold is None:
        table = np.full(_LIMIT, SPACE, np.uint32)
        for c in range(_LIMIT):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _fold = table
    return _fold


def _kept(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters and spaces of all texts joined, which of them stay, where one text ends and the next begins)."""
    joined = " " + " \x00 ".join(t or "" for t in texts) + " "
    raw = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    ends = np.flatnonzero(raw == 0)
    stray = len(ends) != len(texts) - 1
    if stray:  # some text holds NUL itself
        return _kept([(t or "").replace("\x00", " ") for t in texts])
    letters = fold_table()[np.minimum(raw, _LIMIT - 1)]
    keep = np.ones(len(raw), bool)
    keep[1:] = (letters[1:] != SPACE) | (letters[:-1] != SPACE)
    keep[ends] = True
    keep[ends + 1] = True
    return letters, keep, ends


def folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, bounds): text i, led and followed by a space, is ``bounds[i]:bounds[i + 1]``; runs of non-letters are one space."""
    letters, keep, ends = _kept(texts)
    keep[ends] = False  # what parts two texts belongs to neither
    at = np.cumsum(keep) - 1
    bounds = np.concatenate([[0], at[ends] + 1, [at[-1] + 1]]) if len(texts) else np.zeros(1, np.int64)
    return letters[keep], bounds


def folded_parts(text: str, size: int) -> Iterator[np.ndarray]:
    """The code points of ``folded([text])``, from ``size`` characters at a time."""
    before = 0
    for at in range(0, max(len(text), 1), size):
        raw = np.frombuffer(text[at : at + size].encode("utf-32-le", "replace"), np.uint32)
        edges = np.full(1, SPACE, np.uint32)
        letters = np.concatenate([edges[at:], fold_table()[np.minimum(raw, _LIMIT - 1)], edges[: at + size >= len(text)]])
        keep = letters != SPACE
        keep[1:] |= letters[:-1] != SPACE
        keep[0] |= before != SPACE
        before = letters[-1]
        yield letters[keep]


def folded_at(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``folded`` of one text or more, and the place of each code point in its own text (-1 and len(text): what leads and follows it)."""
    letters, keep, ends = _kept(texts)
    source = np.flatnonzero(keep)
    begins = np.r_[1, ends + 2]  # where each text begins in what was joined
    bounds = np.concatenate([[0], np.searchsorted(source, ends) + 1, [len(source)]])
    return letters[keep], bounds, source - begins[np.searchsorted(ends, source, "left")]


def blocks(column: pa.Array, size: int = 500_000):
    """(first row, texts) of row blocks of about ``size`` characters, so that scratch arrays stay small."""
    texts, first, n = [], 0, 0
    for i, text in enumerate(column.to_pylist()):
        texts.append(text)
        n += len(text or "")
        if n >= size:
            yield first, texts
            texts, first, n = [], i + 1, 0
    if texts:
        yield first, texts
