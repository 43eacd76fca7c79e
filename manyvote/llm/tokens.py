"""Token counts by rank-synchronous merging: the pre-tokens of a batch lie in one ragged numpy array; in each
step every sequence applies its own lowest-ranked pair at all its places, and what survives is counted.

Cases: null and empty texts have no bytes and no tokens; a special token's string inside a text is one token
and parts the text, as the tokenizer's file says; every row gives one row; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import json

import numpy as np
import regex
from pyspark.sql import DataFrame

from .rows import map_texts
from .words import utf8

#: Pre-tokens whose counts a worker keeps; it starts anew beyond that.
KEPT = 400_000
#: Characters of pre-tokens that are merged at a time; a single longer one goes alone.
MERGE_BYTES = 1 << 16
_NONE = np.int64(1 << 40)


class ByteLevelBpe:
    """Byte-level BPE from a tokenizers file: ranks of pairs in sorted arrays, special tokens, pre-token pattern.

    Only files of this form are accepted: byte-level pre-tokens by the usual pattern without prefix space,
    no normaliser, no affixes, dropout or byte fallback.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not (plain and spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]):
            raise ValueError(f"{path} is no plain byte-level BPE")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has special tokens that take in their surroundings")
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        self.of_byte = np.array([vocab[c] for c in _byte_letters()], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        codes = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, self.ranks = codes[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.words = regex.compile(self.PATTERN)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left * self.size + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], _NONE)

    def merged_lengths(self, tokens: list[bytes]) -> np.ndarray:
        """Number of symbols that survive in each of the pre-tokens."""
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        symbol = self.of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), sizes)
        counts = sizes.copy()
        # rank[i] belongs to the pair of i and i + 1; across two sequences there is none.
        rank = np.full(len(symbol), _NONE)
        rank[:-1] = np.where(owner[:-1] == owner[1:], self._rank(symbol[:-1], symbol[1:]), _NONE)
        while len(symbol):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, first)
            lengths = np.diff(np.r_[first, len(owner)])
            hit = (rank < _NONE) & (rank == np.repeat(best, lengths))
            # In a run of one symbol the pairs overlap: every other one counts, from the left.
            run = hit & np.r_[False, hit[:-1]]
            if run.any():
                place = np.arange(len(hit))
                start = np.maximum.accumulate(np.where(hit & ~run, place, 0))
                hit &= (place - start) % 2 == 0
            at = np.flatnonzero(hit)
            symbol[at] = self.made[rank[at]]
            counts -= np.bincount(owner[at], minlength=len(tokens))
            keep = np.repeat(best < _NONE, lengths)  # sequences without a pair are whole and leave the arrays
            keep[at + 1] = False
            rank[at] = rank[at + 1]
            place = np.cumsum(keep) - 1
            changed = place[at]
            symbol, owner, rank = symbol[keep], owner[keep], rank[keep]
            # Only the pairs around a merged symbol are new.
            left = np.concatenate([changed, changed[changed > 0] - 1])
            left = left[left + 1 < len(symbol)]
            left = left[owner[left] == owner[left + 1]]
            rank[left] = self._rank(symbol[left], symbol[left + 1])
        return counts


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is printable, else the next free one from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Counter(dict):
    """Pre-token to its number of tokens; unknown ones are gathered and merged together."""

    def __init__(self, bpe: ByteLevelBpe):
        super().__init__()
        self.bpe = bpe

    def learn(self, tokens: list[str]) -> None:
        fresh = [(t, utf8(t)) for t in set(tokens).difference(self)]
        at = 0
        while at < len(fresh):
            end, size = at, 0
            while end < len(fresh) and (end == at or size + len(fresh[end][1]) <= MERGE_BYTES):
                size += len(fresh[end][1])
                end += 1
            lengths = self.bpe.merged_lengths([b for _, b in fresh[at:end]])
            self.update(zip((t for t, _ in fresh[at:end]), lengths.tolist()))
            at = end

    def count(self, texts: list[str]) -> list[int]:
        if len(self) > KEPT:
            self.clear()
        special = self.bpe.special
        parts = [(special.split(t), len(special.findall(t))) if special else ([t], 0) for t in texts]
        split = [[w for p in ps for w in self.bpe.words.findall(p)] for ps, _ in parts]
        self.learn([w for words in split for w in words])
        return [n + sum(map(self.__getitem__, words)) for (_, n), words in zip(parts, split)]


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``n_bytes`` (UTF-8) and ``n_tokens`` by the byte-level BPE in the file ``tokenizer``, a path
    every executor has."""

    def make():
        counter = Counter(ByteLevelBpe(tokenizer))

        def compute(texts):
            return {"n_bytes": [len(utf8(t)) for t in texts], "n_tokens": counter.count(texts)}

        return compute

    return map_texts(docs, key, text, "n_bytes bigint, n_tokens bigint", make)
