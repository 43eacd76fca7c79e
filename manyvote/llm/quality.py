"""Quality by nearest-neighbour voting in a latent-semantic space.

Features of a text are hashed words, hashed shapes of tokens, and tokens that repeat one of the tokens just before
them. A bounded sample of labelled texts gives inverse document frequencies and, by a truncated singular
value decomposition, a projection; the sample's projected vectors and labels are broadcast. Every text is
projected, compared with all of them by blocked products, and its nearest neighbours vote with weights
that grow with their cosine.

Cases: null and empty texts, and all texts if there is no label, get the sample's mean label (0.5 without labels);
labels that are null and ids that are null teach nothing; of several labels of one id the mean counts; every row gives one row;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import map_texts, text_column
from .shingles import word_hashes
from .sparse import alnum_hashes, buckets, counted, shape_hashes


@dataclass(frozen=True)
class Quality:
    """``sample``: labelled texts to learn from at most, those with the smallest hashes of their ids."""

    sample: int = 4096
    word_buckets: int = 3072
    shape_buckets: int = 1020
    rank: int = 64
    neighbours: int = 31
    sharpness: float = 12.0
    seed: int = 1

    @property
    def width(self) -> int:
        return self.word_buckets + self.shape_buckets + 4


def text_features(texts: list[str], config: Quality) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and weight of the features, ordered by row; counts are damped and relative to the text's length."""
    parts = []
    for hashes, counts, size, at in (
        (*alnum_hashes(texts), config.word_buckets, 0),
        (*shape_hashes(texts), config.shape_buckets, config.word_buckets),
    ):
        owner = np.repeat(np.arange(len(texts)), counts)
        parts.append((owner, buckets(hashes, size) + at, 1.0 / np.maximum(counts, 1)))
    hashes, counts = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    for lag in range(1, 4):
        again = np.flatnonzero((hashes[lag:] == hashes[:-lag]) & (owner[lag:] == owner[:-lag])) + lag
        parts.append((owner[again], np.full(len(again), config.width - 5 + lag), 1.0 / np.maximum(counts, 1)))
    out = []
    for owner, column, share in parts:
        row, col, count = counted(owner, column, config.width)
        out.append((row, col, np.sqrt(count * share[row])))
    row, col, weight = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(row, kind="stable")
    return row[order], col[order], weight[order]


@dataclass
class Space:
    """What the sample taught: column weights, projection, vectors of length one and labels of the sample."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def project(self, row, col, weight, n: int) -> np.ndarray:
        """Vectors of length one, zero for texts without features."""
        out = np.zeros((n, self.projection.shape[1]), np.float32)
        for a in range(0, len(row), 1 << 15):
            r, c, w = row[a : a + (1 << 15)], col[a : a + (1 << 15)], weight[a : a + (1 << 15)]
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            out[r[first]] += np.add.reduceat(self.projection[c] * (w * self.idf[c])[:, None].astype(np.float32), first, axis=0)
        return _unit(out)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, length, out=np.zeros_like(x), where=length > 1e-12)


def learn_space(features: list[tuple], labels: np.ndarray, config: Quality) -> Space:
    """Space from the sample's features, one (columns, weights) per text."""
    n = len(features)
    if not n:
        return Space(np.ones(config.width), np.zeros((config.width, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    row = np.repeat(np.arange(n), [len(c) for c, _ in features])
    col = np.concatenate([c for c, _ in features]).astype(np.int64)
    weight = np.concatenate([w for _, w in features])
    idf = np.log((1 + n) / (1 + np.bincount(col, minlength=config.width))) + 1
    dense = np.zeros((n, config.width), np.float32)
    dense[row, col] = weight * idf[col]
    dense = _unit(dense)
    # Truncated decomposition by random projection with power steps.
    rank = min(config.rank, n)
    random = np.random.default_rng(config.seed)
    basis = np.linalg.qr(dense @ random.normal(size=(config.width, rank + 16)).astype(np.float32))[0]
    for _ in range(4):
        basis = np.linalg.qr(dense.T @ basis)[0]
        basis = np.linalg.qr(dense @ basis)[0]
    _, _, right = np.linalg.svd(basis.T @ dense, full_matrices=False)
    projection = np.ascontiguousarray(right[:rank].T.astype(np.float32))
    space = Space(idf, projection, np.zeros((0, rank), np.float32), np.asarray(labels, np.float32))
    space.vectors = space.project(row, col, weight, n)
    return space


def vote(space: Space, vectors: np.ndarray, config: Quality, block: int = 512) -> np.ndarray:
    """Weighted mean label of the nearest sample vectors, from exact products with all of them."""
    scores = np.full(len(vectors), space.prior)
    if not len(space.labels):
        return scores
    k = min(config.neighbours, len(space.labels))
    for a in range(0, len(vectors), block):
        part = vectors[a : a + block]
        cosine = part @ space.vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < cosine.shape[1] else np.tile(np.arange(k), (len(part), 1))
        c = np.take_along_axis(cosine, near, 1).astype(np.float64)
        w = np.exp(config.sharpness * (c - c.max(axis=1, keepdims=True)))
        found = (w * space.labels[near]).sum(axis=1) / w.sum(axis=1)
        filled = (part != 0).any(axis=1)
        scores[a : a + block][filled] = found[filled]
    return np.clip(scores, 0.0, 1.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int) -> DataFrame:
    """(id, y, text) of at most ``most`` labelled documents, those whose ids have the smallest hashes.

    At most ``most`` ids are broadcast, so texts are not shuffled; of several rows of one id one text counts.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(key).alias("_id")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    texts = docs.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("text"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(most)
    return texts.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.first("y").alias("y"), F.min("text").alias("text"))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", config: Quality = Quality()) -> Space:
    """Space from the labelled rows; only the sample's features, not its texts, come to the driver."""
    sample = labelled_sample(docs, labels, key, text, label, config.sample)

    def make():
        def compute(texts):
            row, col, weight = text_features(texts, config)
            cuts = np.searchsorted(row, np.arange(len(texts) + 1))
            pairs = list(zip(cuts[:-1], cuts[1:]))
            return {
                "cols": [col[a:b].astype("<i2").tobytes() for a, b in pairs],
                "weights": [weight[a:b].astype("<f4").tobytes() for a, b in pairs],
            }

        return compute

    keyed = sample.select(F.struct("_id", "y").alias("k"), "text")
    found = map_texts(keyed.select(F.col("k.y").alias("y"), "text"), "y", "text", "cols binary, weights binary", make).collect()
    found.sort(key=lambda r: (r["y"], r["cols"], r["weights"]))
    features = [(np.frombuffer(r["cols"], "<i2"), np.frombuffer(r["weights"], "<f4")) for r in found]
    return learn_space(features, np.array([r["y"] for r in found]), config)


def score(docs: DataFrame, space: Space, key: str = "doc_id", text: str = "text", config: Quality = Quality()) -> DataFrame:
    """Per row: ``score``, the likelihood of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(space)
    return map_texts(docs, key, text, "score double", lambda: _scorer(shared, config))


def _scorer(shared, config: Quality):
    return lambda texts: {"score": score_texts(texts, shared.value, config)}


def score_texts(texts: list[str], space: Space, config: Quality = Quality()) -> np.ndarray:
    return vote(space, space.project(*text_features(texts, config), len(texts)), config)


def keep_good(docs: DataFrame, space: Space, text: str = "text", threshold: float = 0.5, config: Quality = Quality()) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(space)
    return docs.where(text_column(text, "double", lambda: lambda texts: score_texts(texts, shared.value, config)) >= threshold)
