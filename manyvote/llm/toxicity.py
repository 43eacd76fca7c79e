"""Toxicity by non-negative positive-unlabelled learning.

Positives are texts confirmed as toxic; the unlabelled side is a sample of all documents, whatever their label and
whether they have one. No label but the positive one teaches. With the class prior p, the risk is
p * R(positive as 1) + max(0, R(unlabelled as 0) - p * R(positive as 0)): the second part
cannot be negative in truth, so where it is, its gradient is reversed to undo overfitting. Linear classifiers over
the presence of words and of word beginnings are trained in numpy from several starts and averaged.

Cases: null and empty texts have no words and get the score of a text without any known word; without positives
or without unlabelled texts every score is the prior, which is 0.5 where none is given; null labels and null ids teach
nothing; every row gives one row; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..workspace import Workspace
from .rows import map_texts, slices
from .sparse import alnum_parts


@dataclass(frozen=True)
class Toxicity:
    """``positives`` and ``unlabelled``: texts to learn from at most, those with the smallest hashes of their ids.
    The vocabulary is all words in ``least`` positives or more whose shares among positives and unlabelled texts differ by ``level`` standard
    errors. ``decay``: weight decay over the number of positives."""

    positives: int = 2048
    unlabelled: int = 4096
    least: int = 3
    level: float = 2.58
    members: int = 3
    steps: int = 400
    rate: float = 0.05
    decay: float = 0.1
    seed: int = 2


#: Bytes of the beginnings of words that are features beside whole words.
PREFIXES = (4, 5, 6, 7)


def word_sets(texts: list[str]) -> list[np.ndarray]:
    """Distinct hashes of the words and word beginnings of each text, sorted."""
    owner, hashes = alnum_parts(texts, PREFIXES)
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(len(texts) + 1))
    return [np.unique(hashes[order[a:b]]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


@dataclass
class Model:
    """Sorted word hashes, one weight each, and a bias."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        if len(self.words):
            owner, hashes = alnum_parts(texts, PREFIXES)
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            known = self.words[at] == hashes
            pairs = np.unique(owner[known] * len(self.words) + at[known])
            out += np.bincount(pairs // len(self.words), weights=self.weights[pairs % len(self.words)], minlength=len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))


def _logit(p: float) -> float:
    p = min(max(p, 1e-3), 1 - 1e-3)
    return float(np.log(p / (1 - p)))


def _word_counts(positive: list[np.ndarray], unlabelled: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted words in ``least`` positives or more, and in how many positives and unlabelled texts each is."""
    words, n_pos = np.unique(np.concatenate(positive), return_counts=True)
    words, n_pos = words[n_pos >= least], n_pos[n_pos >= least]
    if not len(words):
        return words, n_pos, n_pos
    flat = np.concatenate(unlabelled)
    at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
    return words, n_pos, np.bincount(at[words[at] == flat], minlength=len(words))


def distance(n_pos, n_unl, positives: int, unlabelled: int):
    """How far the shares of a word differ, in standard errors if they were the same; of numbers, arrays or columns."""
    p = (n_pos + n_unl) / (positives + unlabelled)
    return (n_pos / positives - n_unl / unlabelled) / (p * (1 - p) * (1 / positives + 1 / unlabelled) + 1e-12) ** 0.5


def estimated_prior(n_pos: np.ndarray, n_unl: np.ndarray, positives: int, unlabelled: int) -> float:
    """Share of positives among unlabelled texts, from the texts that each word is in.

    A word is in at least the prior times as many unlabelled texts as positives, and in just as many if only positives
    have it: the prior is the ratio of the shares of the word that bounds it best, with shares two standard errors to the safe side.
    """
    if not len(n_pos):
        return 0.5
    p, u = (n_pos + 1) / (positives + 2), (n_unl + 1) / (unlabelled + 2)
    low, high = p - 2 * np.sqrt(p * (1 - p) / positives), u + 2 * np.sqrt(u * (1 - u) / unlabelled)
    best = np.argmin(high / np.maximum(low, 1e-9))
    return min(1.0, float(u[best] / p[best]))


@dataclass
class Held:
    """Which words of the vocabulary each text holds: pairs of a text and a word."""

    text: np.ndarray
    word: np.ndarray
    texts: int

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Per text, of its words' weights."""
        return np.bincount(self.text, weights=weights[self.word], minlength=self.texts)

    def spread(self, values: np.ndarray, width: int) -> np.ndarray:
        """Per word, the sum of its texts' values."""
        return np.bincount(self.word, weights=values[self.text], minlength=width)


def _held(places: list[np.ndarray]) -> Held:
    return Held(np.repeat(np.arange(len(places)), [len(x) for x in places]), np.concatenate(places), len(places))


def _places(words: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Where in the vocabulary the words are that it has."""
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    return at[vocabulary[at] == words]


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float | None, config: Toxicity) -> Model:
    """Classifier from word sets of positives and of unlabelled texts and the share of positives among the latter; None estimates it."""
    if not positive or not unlabelled:
        return Model(np.zeros(0, np.uint64), np.zeros(0), _logit(0.5 if prior is None else prior))
    words, n_pos, n_unl = _word_counts(positive, unlabelled, config.least)
    if prior is None:
        prior = estimated_prior(n_pos, n_unl, len(positive), len(unlabelled))
    words = words[np.abs(distance(n_pos, n_unl, len(positive), len(unlabelled))) >= config.level]
    if not len(words):
        return Model(words, np.zeros(0), _logit(prior))
    return fit(words, _held([_places(s, words) for s in positive]), _held([_places(s, words) for s in unlabelled]), prior, config)


def fit(words: np.ndarray, positive: Held, unlabelled: Held, prior: float, config: Toxicity) -> Model:
    found = []
    for member in range(config.members):
        random = np.random.default_rng([config.seed, member])
        found.append(_descend(positive, unlabelled, len(words), prior, config, random))
    weights = np.mean([w for w, _ in found], axis=0)
    return Model(words, weights, float(np.mean([b for _, b in found])))


def _descend(pos: Held, unl: Held, width: int, prior: float, config: Toxicity, random) -> tuple[np.ndarray, float]:
    """One member: logistic loss, Adam on random halves of the sample."""
    theta = np.r_[random.normal(scale=0.01, size=width), _logit(prior)]
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, config.steps + 1):
        p = random.random(pos.texts) < 0.5 if pos.texts > 20 else np.ones(pos.texts, bool)
        u = random.random(unl.texts) < 0.5 if unl.texts > 20 else np.ones(unl.texts, bool)
        n_p, n_u = int(p.sum()), int(u.sum())
        if not n_p or not n_u:
            continue
        fp, fu = pos.sums(theta[:-1]) + theta[-1], unl.sums(theta[:-1]) + theta[-1]
        sp, su = 1 / (1 + np.exp(-np.clip(fp, -500, 500))), 1 / (1 + np.exp(-np.clip(fu, -500, 500)))
        negative = np.logaddexp(0, fu[u]).mean() - prior * np.logaddexp(0, fp[p]).mean()
        gp_one, gp_zero, gu_zero = p * (sp - 1) / n_p, p * sp / n_p, u * su / n_u
        if negative >= 0:
            gp, gu = prior * (gp_one - gp_zero), gu_zero
        else:
            gp, gu = prior * gp_zero, -gu_zero
        grad = np.r_[pos.spread(gp, width) + unl.spread(gu, width), gp.sum() + gu.sum()]
        grad[:-1] += config.decay / pos.texts * theta[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta - config.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", prior: float | None = None, config: Toxicity = Toxicity()) -> Model:
    """Classifier from confirmed positives (label 1) and a sample of all of ``docs`` taken as unlabelled.

    ``prior``: share of positives among ``docs``; None estimates it from both samples. Ids are broadcast, at most as many as
    the two bounds say. Words are counted on Spark; those counts that tell the sides apart, and where in the vocabulary the words
    of each text are, come to the driver.
    """
    order = [F.xxhash64("_id"), F.col("_id")]
    texts = docs.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("text"))
    known = labels.where(F.col(key).isNotNull() & (F.col(label) == 1)).select(F.col(key).alias("_id")).distinct()
    positive = known.orderBy(*order).limit(config.positives).select("_id", F.lit(True).alias("positive"))
    mixed = texts.where("_id is not null").select("_id").distinct().orderBy(*order).limit(config.unlabelled).select("_id", F.lit(True).alias("mixed"))
    chosen = positive.join(mixed, "_id", "full").select("_id", F.struct(F.coalesce("positive", F.lit(False)).alias("p"), F.coalesce("mixed", F.lit(False)).alias("u")).alias("use"))
    sample = texts.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.first("use").alias("use"), F.min("text").alias("text"))

    workspace = Workspace(docs.sparkSession)
    sample = workspace.save(sample, "toxicity-sample")
    n_pos, n_unl = sample.agg(F.count_if("use.p"), F.count_if("use.u")).head()
    if not n_pos or not n_unl:
        workspace.close()
        return Model(np.zeros(0, np.uint64), np.zeros(0), _logit(0.5 if prior is None else prior))
    counts = word_counts(sample, config.least, n_pos, n_unl).toArrow()
    words, with_pos, with_unl = (counts.column(i).to_numpy() for i in range(3))
    words = words.astype(np.int64).view(np.uint64)
    order = np.argsort(words)
    words, with_pos, with_unl = words[order], with_pos[order], with_unl[order]
    if prior is None:
        prior = estimated_prior(with_pos, with_unl, n_pos, n_unl)
    words = words[np.abs(distance(with_pos, with_unl, n_pos, n_unl)) >= config.level]
    if not len(words):
        workspace.close()
        return Model(words, np.zeros(0), _logit(prior))
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def make():
        return lambda batch: {"places": [_places(s, shared.value).astype("<i4").tobytes() for s in word_sets(batch)]}

    rows = map_texts(sample, "use", "text", "places binary", make).collect()
    workspace.close()
    rows.sort(key=lambda r: (r["use"]["p"], r["use"]["u"], r["places"]))
    places = [(r["use"], np.frombuffer(r["places"], "<i4")) for r in rows]
    return fit(words, _held([x for use, x in places if use["p"]]), _held([x for use, x in places if use["u"]]), prior, config)


def word_counts(sample: DataFrame, least: int, n_pos: int, n_unl: int) -> DataFrame:
    """(word, n_pos, n_unl): in how many of the positives and of the unlabelled texts each word is, for words in ``least`` positives
    or more whose shares differ by one standard error. Others neither get into a vocabulary nor bound the prior."""
    schema = StructType.fromDDL("word bigint, n_pos bigint, n_unl bigint")
    arrow = to_arrow_schema(schema)

    def count(batches):
        for batch in batches:
            for part in slices(batch, 2):
                sides = [part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
                sets = word_sets([t or "" for t in part.column(2).to_pylist()])
                flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                words, at = np.unique(flat, return_inverse=True)
                found = [np.bincount(at, weights=side[owner], minlength=len(words)).astype(np.int64) for side in sides]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (words.view(np.int64), *found)], schema=arrow)
        pa.default_memory_pool().release_unused()

    counted = sample.select("use.p", "use.u", "text").mapInArrow(count, schema)
    counted = counted.groupBy("word").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_unl").alias("n_unl"))
    return counted.where((F.col("n_pos") >= least) & (F.abs(distance(F.col("n_pos"), F.col("n_unl"), n_pos, n_unl)) >= 1))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``score``, the likelihood that the text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, key, text, "score double", lambda: _scorer(shared))


def _scorer(shared):
    return lambda texts: {"score": shared.value.score(texts)}
