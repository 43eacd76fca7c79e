"""Word shingles of texts as 64-bit hashes, and signatures over them, in numpy."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

from .words import utf8

WORDS = 5
#: Bytes of words hashed at a time; a single longer word goes alone.
HASHED_BYTES = 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_random = np.random.default_rng(20240501)
_BYTE = _random.integers(0, 2**64, 256, dtype=np.uint64)
_STEP, _TURN, _SHORT = (int(x) | 1 for x in _random.integers(0, 2**64, 3, dtype=np.uint64))
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input changes every bit of the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """All words of some texts: ``data`` bytes, where each word starts, its length, its hash, and words per text."""

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words are longer than ``size`` bytes, and the hashes of their first ``size`` bytes."""
        longer = np.flatnonzero(self.lengths > size)
        at, total = self.starts[longer], np.zeros(len(longer), np.uint64)
        turn = _powers(_STEP, size)
        for k in range(size):
            total += _BYTE[self.data[at + k]] * turn[k]
        return longer, mix(total + np.uint64(size << 40))


def split_words(texts: list[str] | list[bytes]) -> Words:
    """Words are runs of bytes other than ASCII white space, A-Z lowered."""
    raw = [(t if isinstance(t, bytes) else utf8(t)).lower() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    solid = ~_SPACE[data]
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if solid[0]:
        edge = np.r_[0, edge]
    starts, ends = edge[::2], edge[1::2]
    text_ends = np.cumsum([len(r) + 1 for r in raw])
    counts = np.diff(np.r_[0, np.searchsorted(starts, text_ends)])
    lengths = ends - starts
    if not len(starts):
        return Words(data, starts, lengths, np.zeros(0, np.uint64), counts)
    powers, letters = _powers(_STEP, int(lengths.max())), data[solid]
    ends = np.cumsum(lengths)
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # by parts, so that eight bytes for each letter are held for a part only
        done = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + HASHED_BYTES, "right")))
        size = lengths[at:end]
        first = ends[at:end] - size - done
        place = np.arange(int(ends[end - 1]) - done) - np.repeat(first, size)
        hashes[at:end] = np.add.reduceat(_BYTE[letters[done : ends[end - 1]]] * powers[place], first)
        at = end
    return Words(data, starts, lengths, mix(hashes + lengths.astype(np.uint64)), counts)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text."""
    words = split_words(texts)
    return words.hashes, words.counts


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Distinct shingles of five words of each text, sorted; fewer words are one shingle, no words none."""
    hashes, counts = word_hashes(texts)
    turn = _powers(_TURN, WORDS)
    whole = np.zeros(max(0, len(hashes) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        whole += hashes[k : k + len(whole)] * turn[k]
    whole = mix(whole)
    sets, at = [], 0
    for n in counts.tolist():
        if n >= WORDS:
            sets.append(np.unique(whole[at : at + n - WORDS + 1]))
        elif n:
            few = hashes[at : at + n] * turn[:n]
            sets.append(mix(few.sum(keepdims=True) + np.uint64((_SHORT * n) & _MASK)))
        else:
            sets.append(np.zeros(0, np.uint64))
        at += n
    return sets


def digest(shingles: np.ndarray) -> bytes | None:
    """128 bits that stand for a set; None for the empty one."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def minhashes(sets: list[np.ndarray], size: int, chunk: int = 1 << 15) -> np.ndarray:
    """Row per set: ``size`` min-wise hashes (32 bits). Empty sets get the largest value throughout."""
    random = np.random.default_rng(7)
    factors = random.integers(0, 2**64, size, dtype=np.uint64) | np.uint64(1)
    shifts = random.integers(0, 2**64, size, dtype=np.uint64)
    out = np.full((len(sets), size), 0xFFFFFFFF, np.uint32)
    filled = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(filled):
        end, total = at, 0
        while end < len(filled) and (end == at or total + len(sets[filled[end]]) <= chunk):
            total += len(sets[filled[end]])
            end += 1
        rows = filled[at:end]
        flat = np.concatenate([sets[i] for i in rows])
        offsets = np.cumsum([0] + [len(sets[i]) for i in rows[:-1]])
        for k in range(size):
            out[rows, k] = np.minimum.reduceat(flat * factors[k] + shifts[k], offsets) >> np.uint64(32)
        at = end
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Number of common elements of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())
