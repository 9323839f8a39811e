"""Toxicity: subword-bag embeddings, averaged and classified by a linear softmax, trained jointly in numpy.

A word's subwords are its character n-grams with word ends marked, hashed into buckets that each have an embedding, so
a misspelling shares most of its vectors with the word it hides. A bag is a window of a few words; a text scores as its
worst window, however long it is, so one insult is not averaged away. With two classes the softmax over an average is
the sigmoid of an average of per-bucket numbers: after training, embeddings and output layer are folded into those.

Defined results: a null or empty text has no window and scores as the model does on no evidence. Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from .labelled import labelled_sample
from .shipped import ship

# Labelled documents to fit on, by class, and the longest text among them.
SAMPLE = {0: 1800, 1: 900}
SAMPLE_CHARS = 6_000

BUCKETS = 1 << 17
DIMENSIONS = 8
WINDOW = 8
GRAMS = (3, 4, 5)
# Distinct words a worker keeps the sums of, and characters scored at a time.
CACHE_WORDS = 300_000
CHUNK_CHARS = 1_000_000


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of the words, in order, and how many each word has."""
    marked = "".join(f"<{w}>" for w in words)
    chars = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], dtype=np.int64)
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    room = ends[word] - np.arange(len(chars))  # characters up to the word's end
    where, found = [], []
    rolling = np.zeros(len(chars), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        rolling = rolling[: len(chars) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1 :] + np.uint64(1)
        if n in GRAMS:
            fits = np.flatnonzero(room[: len(rolling)] >= n)
            mixed = rolling[fits] ^ (rolling[fits] >> np.uint64(29))
            mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
            found.append((mixed >> np.uint64(32)) % np.uint64(BUCKETS))
            where.append(word[fits])
    owner = np.concatenate(where)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order].astype(np.int64), np.bincount(owner, minlength=len(words))


def split(text: str | None) -> list[str]:
    """Words of a text; a word said again and again counts once, so a run of it is no window of its own."""
    return [word for word, _ in groupby((text or "").lower().split())]


def window_means(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Average over the subwords of each window of consecutive words of one text."""
    size = min(WINDOW, len(sums))
    s, c = np.concatenate([[0.0], np.cumsum(sums)]), np.concatenate([[0], np.cumsum(counts)])
    return (s[size:] - s[:-size]) / np.maximum(c[size:] - c[:-size], 1)


@dataclass
class Folded:
    """A trained model: the number each bucket adds, and the number without any."""

    buckets: np.ndarray
    bias: float


def fit(texts: list[str], labels: np.ndarray, steps: int = 150, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> Folded:
    """Train embeddings and softmax together on the worst window of each text; first steps take all its words as one bag."""
    bags = [split(t) for t in texts]
    keep = [i for i, b in enumerate(bags) if b]
    bags, y = [bags[i] for i in keep], np.asarray(labels, dtype=float)[keep]
    if not bags or len(set(y.tolist())) < 2:
        return Folded(np.zeros(BUCKETS, dtype=np.float32), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 9))))
    number: dict[str, int] = {}
    tokens = np.array([number.setdefault(w, len(number)) for b in bags for w in b], dtype=np.int32)
    starts = np.cumsum([0] + [len(b) for b in bags])
    grams, per_word = subwords(list(number))
    gram_starts = np.concatenate([[0], np.cumsum(per_word)])
    grams, gram_word = grams.astype(np.int32), np.repeat(np.arange(len(number), dtype=np.int32), per_word)
    sizes = per_word[tokens]
    size_sum = np.concatenate([[0], np.cumsum(sizes)])
    text_of = np.repeat(np.arange(len(bags), dtype=np.int32), np.diff(starts))
    first = np.arange(len(tokens), dtype=np.int32)
    last = np.minimum(first + WINDOW, starts[text_of + 1]).astype(np.int32)
    short = np.diff(starts) < WINDOW
    valid = (last - first == WINDOW) | (short[text_of] & (first == starts[text_of]))
    first, last, text_of = first[valid], last[valid], text_of[valid]
    firsts = np.searchsorted(text_of, np.arange(len(bags)))
    window_size = (size_sum[last] - size_sum[first]).astype(np.int32)

    rng = np.random.default_rng(seed)
    embeddings = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    # output[0] and output[1] are the two classes' rows; only their difference matters
    output = rng.normal(0, 0.5, (2, DIMENSIONS))
    bias = np.array([float(np.log(y.mean() / (1 - y.mean())))])
    state = [[p, np.zeros_like(p), np.zeros_like(p)] for p in (embeddings, output, bias)]
    for step in range(1, steps + 1):
        direction = output[1] - output[0]
        bucket = embeddings @ direction
        word = np.add.reduceat(bucket[grams], gram_starts[:-1])
        total = np.concatenate([[0.0], np.cumsum(word[tokens])])
        if step <= steps // 5:
            low, high = starts[:-1], starts[1:]
            size = size_sum[high] - size_sum[low]
        else:
            means = (total[last] - total[first]) / window_size
            best = np.maximum.reduceat(means, firsts)
            hits = np.flatnonzero(means == best[text_of])
            hits = hits[np.unique(text_of[hits], return_index=True)[1]]
            low, high, size = first[hits], last[hits], window_size[hits]
        p = 1 / (1 + np.exp(-((total[high] - total[low]) / size + bias[0])))
        error = (p - y) / len(y)
        slope = np.zeros(len(tokens) + 1)
        np.add.at(slope, low, error / size)
        np.add.at(slope, high, -error / size)
        by_word = np.bincount(tokens, np.cumsum(slope)[:-1], len(number))
        by_bucket = np.bincount(grams, by_word[gram_word], BUCKETS)
        pull = by_bucket @ embeddings
        gradients = (np.outer(by_bucket, direction) + decay * embeddings, np.stack([-pull, pull]), np.array([error.sum()]))
        for (value, mean, square), gradient in zip(state, gradients, strict=True):
            mean += 0.1 * (gradient - mean)
            square += 0.01 * (gradient**2 - square)
            value -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Folded((embeddings @ (output[1] - output[0])).astype(np.float32), float(bias[0]))


class Scorer:
    """Scores texts; keeps the sums of words it has seen, up to a bound."""

    def __init__(self, model: Folded) -> None:
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.sums = np.zeros(0)
        self.counts = np.zeros(0, dtype=np.int64)

    def _learn(self, words: list[str]) -> None:
        new = list(set(words).difference(self.number))
        if not new:
            return
        if len(self.number) + len(new) > CACHE_WORDS:
            self._clear()
            new = list(set(words))
        grams, counts = subwords(new)
        starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.sums = np.concatenate([self.sums, np.add.reduceat(self.model.buckets[grams].astype(float), starts)])
        self.counts = np.concatenate([self.counts, counts])

    def _some(self, bags: list[list[str]]) -> list[float]:
        self._learn([w for b in bags for w in b])
        out = []
        for bag in bags:
            margin = self.model.bias
            if bag:
                at = np.fromiter(map(self.number.__getitem__, bag), dtype=np.int64, count=len(bag))
                margin += float(window_means(self.sums[at], self.counts[at]).max())
            out.append(1 / (1 + float(np.exp(-margin))))
        return out

    def scores(self, texts: Iterator[str | None]) -> list[float]:
        out: list[float] = []
        bags, size = [], 0
        for text in texts:
            bags.append(split(text))
            size += len(text or "")
            if size >= CHUNK_CHARS:
                out += self._some(bags)
                bags, size = [], 0
        return out + self._some(bags)


def fit_toxicity(documents: DataFrame, labels: DataFrame, where: Column | None = None, sample: dict[int, int] | None = None) -> Folded:
    """A model for ``toxic`` from a bounded sample of the labelled documents for whose ``doc_id`` ``where`` holds."""
    texts = labelled_sample(documents, labels, "toxic", sample or SAMPLE, where, SAMPLE_CHARS)
    got = texts.toPandas().sort_values("doc_id")
    return fit(got["text"].tolist(), got["toxic"].to_numpy())


def score(documents: DataFrame, model: Folded, text: Column) -> Column:
    """Score of each text, 0 to 1. The model (half a megabyte, whatever the data) is sent to the executors once."""
    ship(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(DoubleType())
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(sent.value)
        for texts in batches:
            yield pa.array(scorer.scores(t.as_py() for t in texts), type=pa.float64())

    return scored(text)
