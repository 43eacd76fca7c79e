"""Token ids of documents by a tokenizers file, cut into pieces.

Cases: null and empty texts have the end id alone; repeated rows and rows that share an id have their pieces each; very long texts are
encoded one at a time; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import slices

#: Chunks whose ids a worker keeps; it starts anew beyond that.
KEPT = 400_000
_END = " "  # no chunk holds white space, so this key is free for the end of a document
# Signs that, for such a tokenizer, stand apart from letters; without the apostrophe, which can start a suffix.
_SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")  # white space to Python alone


@dataclass
class Form:
    """What the tokenizer's file says: whether texts must be encoded whole, which tokens end a word, and the special strings, lowered.

    Chunks can be encoded apart if the normaliser lowers letters and the pre-tokenizer never joins characters over white space.
    """

    whole_texts: bool
    ends_word: np.ndarray
    specials: tuple[str, ...]


def read_form(path: str) -> Form:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    first = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
    pattern = first.get("pattern", {}).get("Regex", "")
    apart = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    chunks = "Lowercase" in steps and apart and re.search(r"\[\^\\s", pattern) and " " not in pattern
    vocab = spec["model"]["vocab"]
    suffix = spec["model"].get("end_of_word_suffix")
    highest = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
    ends = np.zeros(highest + 1, bool)
    if suffix:
        ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
    return Form(not chunks, ends, tuple(sorted({t["content"].lower() for t in spec["added_tokens"]})))


def _letters_only(core: str) -> bool:
    """Whether a word stays letters when the tokenizer normalises it: some letters become a letter and a mark, which joins a sign after it."""
    return core.isalpha() and (core.isascii() or unicodedata.normalize("NFC", core).lower().isalpha())


class IdStore:
    """Ids of numbered entries in one array."""

    def __init__(self):
        self.ids = np.zeros(0, np.uint32)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(sizes) - sizes]
        self.ids, self.sizes = np.r_[self.ids, ids], np.r_[self.sizes, sizes]

    def take(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the entries one after another, and where each one's end."""
        sizes = self.sizes[entries]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.starts[entries] - ends + sizes, sizes) + np.arange(total)], ends


class ChunkIds(dict):
    """Ids of chunks between white space, each encoded once by the library and looked up from then on.

    Right for a tokenizer that drops white space and lowers letters, so that a text's ids are those of its
    chunks in order; ``whole_texts`` says whether the file is of that form. A chunk of letters between signs is, to such
    a tokenizer, three words. Words of letters only are encoded many at a time and told apart by the tokens
    that end a word. Texts that may hold special tokens or separators on which Python and the library
    differ are encoded whole.
    """

    def __init__(self, path: str, end_id: int, form: Form | None = None, kept: int | None = None):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.kept = Tokenizer.from_file(path), end_id, kept or KEPT
        form = form or read_form(path)
        self.whole_texts, self.ends_word, self.specials = form.whole_texts, form.ends_word, form.specials
        self._restart()

    def _restart(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self[_END] = 0
        self.store, self.words, self.known = IdStore(), IdStore(), {}
        self.store.add(np.array([self.end_id], np.uint32), np.ones(1, np.int64))

    def __missing__(self, chunk: str) -> int:
        self[chunk] = at = len(self)
        self.fresh.append(chunk)
        return at

    def _odd(self, lowered: str) -> bool:
        if any(o in lowered for o in _ODD) or any(s in lowered for s in self.specials):
            return True
        if lowered.isascii() or not any(s[:1] in lowered for s in self.specials):
            return False
        normal = unicodedata.normalize("NFC", lowered).lower()
        return any(s in normal for s in self.specials)

    def _learn(self) -> None:
        if not self.fresh:
            return
        parts, counts = [], []
        for chunk in self.fresh:
            core = chunk.strip(_SIGNS)
            if core is chunk or not _letters_only(core):
                parts.append(chunk)
                counts.append(1)
                continue
            at = chunk.index(core)
            own = [p for p in (chunk[:at], core, chunk[at + len(core) :]) if p]
            parts += own
            counts.append(len(own))
        new = list(dict.fromkeys(p for p in parts if p not in self.known))
        letters = [p for p in new if p.isalpha()]
        for words, encoded in ((letters, self._encode_words), ([p for p in new if not p.isalpha()], self._encode_each)):
            for a in range(0, len(words), 20_000):
                group = words[a : a + 20_000]
                self.known.update(zip(group, range(len(self.known), len(self.known) + len(group))))
                self.words.add(*encoded(group))
        flat, ends = self.words.take(np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts)))
        at = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        self.store.add(flat, np.diff(at))
        self.fresh = []

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, encoded as texts of many; if they don't end one by one, each by itself."""
        texts = [" ".join(words[a : a + 200]) for a in range(0, len(words), 200)]
        ids = np.array([i for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.uint32)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) == len(words) and ends[-1] == len(ids):
            return ids, np.diff(np.r_[0, ends])
        return self._encode_each(words)

    def _encode_each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum())), sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with the end id after them."""
        if len(self) > self.kept:
            self._restart()
        chunks, counts = [], []
        odd: dict[int, np.ndarray] = {}
        for i, text in enumerate(texts):
            # Only A-Z are lowered here, so that chunks that differ in them share an entry; the library lowers the rest.
            lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
            if self.whole_texts or self._odd(lowered):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                odd[i] = np.array([*ids, self.end_id], np.uint32)
                counts.append(0)
                continue
            words = lowered.split()
            words.append(_END)
            chunks += words
            counts.append(len(words))
        index = np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))
        self._learn()
        flat, ends = self.store.take(index)
        cuts = np.r_[0, ends][np.cumsum([0] + counts)]
        return [odd[i] if i in odd else flat[a:b] for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()))]


def token_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = 2048, end_id: int = 0, kept: int = KEPT) -> DataFrame:
    """Pieces of at most ``length`` ids: (key, piece, start, length, ids), ``ids`` as little-endian unsigned 32-bit numbers.

    A null text is empty and so one piece with the end id. ``tokenizer`` is a path every executor has.
    ``kept``: chunks whose ids a worker keeps at most, some 300 bytes each.
    """
    form = read_form(tokenizer)
    kind = docs.select(key).schema[0].dataType.simpleString()
    most = length

    def run(batches):
        chunks = ChunkIds(tokenizer, end_id, form, kept)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                encoded = chunks.encode([t or "" for t in part.column(1).to_pylist()])
                rows, piece, start, size, ids = [], [], [], [], []
                for i, e in enumerate(encoded):
                    raw = e.astype("<u4").tobytes()
                    for k, at in enumerate(range(0, len(e), most)):
                        n = min(most, len(e) - at)
                        rows.append(i)
                        piece.append(k)
                        start.append(at)
                        size.append(n)
                        ids.append(raw[4 * at : 4 * (at + n)])
                columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32())]
                columns += [pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids"])
        pa.default_memory_pool().release_unused()

    source = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids binary")
