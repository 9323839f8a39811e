"""Quality rules: base rules over document statistics, then gradient-boosted trees over ratios of them.

The trees are fitted with numpy on a bounded sample of labelled documents and flattened into node arrays; all rows
of a batch walk all trees at once. On chosen features the score may only fall as the feature grows (monotonic
constraints: a split that would break the order is not taken, and children inherit value bounds).

Defined results: a null or empty text has no words and fails the base rules. Repeated rows are judged each on their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .labelled import labelled_sample
from .shipped import ship

# Labelled documents to fit on, by class.
SAMPLE = {0: 3000, 1: 3000}

STATISTICS = "n_words n_chars word_chars n_symbols n_lines n_dup_lines n_repeat_words n_distinct_words n_upper n_marks n_exclamations n_digits longest_word longest_run".split()

_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(chars)] = 1
    return out


_CLASSES = np.stack([_mask(bytes(set(range(256)) - set(range(0x80, 0xC0)))), _mask(_SPACES), _mask(_SYMBOLS), _mask(bytes(range(65, 91))), _mask(b".,;:?"), _mask(b"!"), _mask(b"0123456789")], axis=1)


def repeat_words(codes: np.ndarray, distinct: int) -> int:
    """Words inside windows of three words that occur twice or more; ``codes`` number the words from 0."""
    n = len(codes)
    if n < 4 or distinct == n:
        return 0
    pairs, size = codes[:-1] * distinct + codes[1:], distinct
    if distinct >= 1 << 21:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, where, counts = np.unique(pairs[:-1] * size + codes[2:], return_inverse=True, return_counts=True)
    again = counts[where] > 1
    hit = np.zeros(n, dtype=bool)
    for shift in range(3):
        hit[shift : n - 2 + shift] |= again
    return int(hit.sum())


def statistics_of(text: str | None) -> list[int]:
    """The statistics of one text, in the order of ``STATISTICS``."""
    data = (text or "").encode()
    chars, spaces, symbols, upper, marks, exclamations, digits = (np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) @ _CLASSES).tolist()
    words = data.split()
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    lines = [line for line in data.split(b"\n") if line.strip(_SPACES)]
    turns = np.flatnonzero(np.diff(codes)) + 1
    run = int(np.diff(turns, prepend=0, append=len(words)).max()) if words else 0
    longest = max(map(len, number), default=0)
    return [len(words), chars, chars - spaces, symbols, len(lines), len(lines) - len(set(lines)), repeat_words(codes, len(number)), len(number), upper, marks, exclamations, digits, longest, run]


def _measured(texts: pa.Array) -> np.ndarray:
    """A row of ``STATISTICS`` per text."""
    return np.array([statistics_of(t.as_py()) for t in texts], dtype=np.int64).reshape(-1, len(STATISTICS))


@F.arrow_udf(StructType([StructField(name, LongType()) for name in STATISTICS]))
def _statistics(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(column)) for column in _measured(texts).T], names=STATISTICS)


def statistics(text: Column) -> Column:
    """A struct of all ``STATISTICS`` of a text."""
    return _statistics(text)


def base_failed(stats: Column) -> Column:
    """Too short, or more than half of the words are in repeated windows."""
    n = stats["n_words"]
    return (n < 50) | (100 * stats["n_repeat_words"] > 50 * n)


# Ratios the trees see, and the direction the score may take as each grows (0: any).
FEATURES: list[tuple[str, str, str, int]] = [
    ("symbols", "n_symbols", "word_chars", -1),
    ("duplicate_lines", "n_dup_lines", "n_lines", -1),
    ("repeats", "n_repeat_words", "n_words", -1),
    ("capitals", "n_upper", "word_chars", -1),
    ("exclamations", "n_exclamations", "n_words", -1),
    ("digits", "n_digits", "word_chars", -1),
    ("run", "longest_run", "n_words", -1),
    ("marks", "n_marks", "n_words", 0),
    ("word_length", "word_chars", "n_words", 0),
    ("distinct", "n_distinct_words", "n_words", 0),
    ("line_length", "n_words", "n_lines", 0),
    ("longest_word", "longest_word", "", 0),
    ("words", "n_words", "", 0),
]
DIRECTIONS = np.array([d for _, _, _, d in FEATURES])


def features(stats: np.ndarray) -> np.ndarray:
    """The trees' inputs from rows of ``STATISTICS``."""
    column = dict(zip(STATISTICS, stats.T.astype(float), strict=True))
    return np.stack([column[top] / np.maximum(column[bottom], 1) if bottom else column[top] for _, top, bottom, _ in FEATURES], axis=1)


@dataclass
class Trees:
    """Nodes of all trees: feature (-1: leaf), threshold, children, value; and the root of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        at = np.broadcast_to(self.roots, (len(rows), len(self.roots))).copy()
        which = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            feature = self.feature[at]
            low = rows[which, np.maximum(feature, 0)] <= self.threshold[at]
            at = np.where(feature < 0, at, np.where(low, self.left[at], self.right[at]))
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(rows: np.ndarray, labels: np.ndarray, directions: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 64, smooth: float = 1.0, least: int = 20) -> Trees:
    """Boost trees on the logistic loss, by second-order gains over binned features."""
    n, d = rows.shape
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3) if n else 0.5
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)] if n else [np.zeros(0)] * d
    binned = np.stack([np.searchsorted(cuts[j], rows[:, j], side="left") for j in range(d)]) if n else np.zeros((d, 0), dtype=np.int64)
    nodes: list[list[float]] = []
    roots = []
    margin = np.full(n, base)

    def grow(index: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        g, h = gradient[index], hessian[index]
        total_g, total_h = g.sum(), h.sum()
        value = float(np.clip(-total_g / (total_h + smooth), low, high))
        nodes.append([-1, 0.0, -1, -1, value * rate])
        if level == depth or len(index) < 2 * least:
            return me
        best = (1e-6, -1, 0, 0.0, 0.0)
        for j in range(d):
            if not len(cuts[j]):
                continue
            own = binned[j, index]
            size = len(cuts[j]) + 1
            left_g, left_h, left_n = (np.cumsum(np.bincount(own, w, size))[:-1] for w in (g, h, None))
            right_g, right_h = total_g - left_g, total_h - left_h
            left_v, right_v = np.clip(-left_g / (left_h + smooth), low, high), np.clip(-right_g / (right_h + smooth), low, high)
            gain = left_g**2 / (left_h + smooth) + right_g**2 / (right_h + smooth) - total_g**2 / (total_h + smooth)
            good = (left_n >= least) & (len(index) - left_n >= least)
            if directions[j]:
                good &= directions[j] * (right_v - left_v) >= 0
            gain = np.where(good, gain, -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k, float(left_v[k]), float(right_v[k]))
        _, j, k, left_v, right_v = best
        if j < 0:
            return me
        middle = (left_v + right_v) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(directions[j])]
        goes_left = binned[j, index] <= k
        left = grow(index[goes_left], level + 1, *bounds[0])
        right = grow(index[~goes_left], level + 1, *bounds[1])
        nodes[me] = [j, float(cuts[j][k]), left, right, 0.0]
        return me

    def packed() -> Trees:
        table = np.array(nodes, dtype=float).reshape(-1, 5)
        return Trees(table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4], np.array(roots, dtype=np.int64), base, depth)

    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - labels, p * (1 - p)
        start = len(nodes)
        roots.append(start)
        grow(np.arange(n), 0, -np.inf, np.inf)
        one = packed()
        one.roots, one.base = np.array([start]), 0.0
        s = one.score(rows)
        margin += np.log(s / (1 - s))
    return packed()


def fit_quality(documents: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> Trees:
    """Trees for ``quality`` from a bounded sample of labelled documents; without any, all documents score 0.5."""
    ship(documents.sparkSession)
    texts = labelled_sample(documents, labels, "quality", sample or SAMPLE)
    got = texts.select(statistics(F.col("text")).alias("s"), "quality", "doc_id").select("s.*", "quality", "doc_id").toPandas().sort_values("doc_id")
    return fit(features(got[STATISTICS].to_numpy(dtype=np.int64)), got["quality"].to_numpy(dtype=float), DIRECTIONS)


def judged(trees: Trees, text: Column) -> Column:
    """A struct of all ``STATISTICS`` of a text and the ``score`` of the trees, in one pass of one Python worker per task."""
    fields = [StructField(name, LongType()) for name in STATISTICS] + [StructField("score", DoubleType())]

    @F.arrow_udf(StructType(fields))
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            stats = _measured(texts)
            columns = [pa.array(np.ascontiguousarray(column)) for column in stats.T] + [pa.array(trees.score(features(stats)), type=pa.float64())]
            yield pa.StructArray.from_arrays(columns, names=[f.name for f in fields])

    return both(text)


def assess(documents: DataFrame, trees: Trees, at_least: float = 0.5) -> DataFrame:
    """``documents`` with ``_stats``, ``base_failed``, ``quality_score`` and ``kept``."""
    ship(documents.sparkSession)
    out = documents.withColumn("_stats", judged(trees, F.col("text")))
    out = out.withColumns({"base_failed": base_failed(F.col("_stats")), "quality_score": F.col("_stats.score")})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality_score") >= at_least))
