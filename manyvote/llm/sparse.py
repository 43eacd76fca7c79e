"""Hashed sparse features of texts, computed for a whole batch in numpy."""

from __future__ import annotations

import numpy as np

from .shingles import mix, split_words
from .words import _ALNUM, utf8

# Classes of bytes: letters, capitals and digits stand for all of their kind, white space parts, other signs stay.
_SHAPE = bytes(
    97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else 32 if b in (9, 10, 11, 12, 13, 32) else b
    for b in range(256)
)


def alnum_parts(texts: list[str], prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the words of letters and digits and of the first bytes of longer words, ordered by neither."""
    words = split_words([utf8(t).translate(_ALNUM) for t in texts])
    owner = words.owners()
    owners, hashes = [owner], [words.hashes]
    for size in prefixes:
        longer, found = words.prefixes(size)
        owners.append(owner[longer])
        hashes.append(found)
    return np.concatenate(owners), np.concatenate(hashes)


def alnum_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of letters and digits of all texts, and the number of words of each."""
    words = split_words([utf8(t).translate(_ALNUM) for t in texts])
    return words.hashes, words.counts


def shape_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shapes of all tokens: runs of one class of characters count as one."""
    shapes = []
    for text in texts:
        data = np.frombuffer(utf8(text).translate(_SHAPE), np.uint8)
        shapes.append(data[np.r_[True, data[1:] != data[:-1]]].tobytes().replace(b"A", b"\x01") if len(data) else b"")
    words = split_words(shapes)
    return words.hashes, words.counts


def counted(owner: np.ndarray, column: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and count of each distinct pair, ordered."""
    code, count = np.unique(owner * width + column, return_counts=True)
    return code // width, code % width, count


def buckets(hashes: np.ndarray, size: int) -> np.ndarray:
    return (mix(hashes) % np.uint64(size)).astype(np.int64)
