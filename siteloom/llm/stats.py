"""Statistics of byte classes and words, for texts or lines, by whole arrays."""

from __future__ import annotations

import numpy as np

#: Byte classes: lower case, upper case, digit, space, sentence mark, other ASCII mark, beyond ASCII, line end.
CLASSES = 8
_LOWER, _UPPER, _DIGIT, _SPACE, _SENTENCE, _MARK, _BEYOND, _LINE = range(CLASSES)
CLASS = np.full(256, _MARK, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[[9, 11, 12, 13, 32]] = _LOWER, _UPPER, _DIGIT, _SPACE
CLASS[[33, 34, 39, 44, 45, 46, 58, 59, 63]], CLASS[128:], CLASS[10] = _SENTENCE, _BEYOND, _LINE


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(n, CLASSES) bytes of each class in each row."""
    kinds, n = CLASS[data], len(offsets) - 1
    out = np.zeros((n, CLASSES), np.int64)
    for k in range(CLASSES):
        total = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int64)])
        out[:, k] = np.diff(total[offsets])
    return out


def distinct(rows: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Distinct ids of each row."""
    if not len(ids):
        return np.zeros(n, np.int64)
    width = int(ids.max()) + 1
    return np.bincount(np.unique(rows * width + ids) // width, minlength=n)
