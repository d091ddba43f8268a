"""Quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text is cut into runs of word characters and runs of marks. Its features are single tokens, pairs of neighbours, and pairs
of token shapes (case, digits, length, kind of mark); a pair of equal neighbours is one feature whatever the token. Features are hashed
into ``2**BITS`` weights; each counts with its share of the text's features, so that a score is a sparse dot product of shares
and weights.

The weights are fitted on the driver on at most ``max_rows`` labelled rows of either kind, the first in order of a hash of their id,
with at most ``max_chars`` characters each. Scoring reads all documents in one pass without a shuffle.

Defined results: null and empty texts have no features and score by the bias alone. Labels without a text, and null labels, teach nothing;
without any labelled row every score is 0.5. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tokens import NOT_SPACE, SAME, Words, byte_class, mix, words
from .training import training_rows

BITS = 20
MAX_ROWS, MAX_CHARS, ROUNDS = 2000, 20_000, 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1

# Bytes of words; everything else but space is a mark.
_WORD = byte_class(lambda i: 48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122 or i >= 128)
_UPPER, _DIGIT = byte_class(lambda i: 65 <= i <= 90), byte_class(lambda i: 48 <= i <= 57)


def _shapes(part: Words) -> np.ndarray:
    """A small number per token: what it looks like, not what it says."""
    length = part.end - part.start
    counts = lambda kind: np.concatenate([[0], np.cumsum(kind[part.data])])
    inside = lambda kind: (c := counts(kind))[part.end] - c[part.start]
    first = part.data[part.start]
    word, upper = _WORD[first], inside(_UPPER)
    case = np.where(upper == 0, 0, np.where((upper == 1) & _UPPER[first], 1, np.where(2 * upper >= length, 2, 3)))
    shape = case + 4 * (inside(_DIGIT) > 0) + 8 * np.minimum(length, 15)
    return np.where(word, shape, 256 + first.astype(np.int64) + 256 * np.minimum(length, 7))


def features(part: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, weight place) of every feature of some documents, in no order."""
    n = len(part.code)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pair = np.flatnonzero(part.row[1:] == part.row[:-1])
    left, right = part.code[:-1][pair], part.code[1:][pair]
    both = mix(left * np.uint64(0x9E3779B97F4A7C15) + right)
    both[left == right] = np.uint64(0x5EED << 40)
    shape = _shapes(part).astype(np.uint64)
    shapes = mix((shape[:-1][pair] << np.uint64(20)) + shape[1:][pair] + np.uint64(1 << 60))
    place = np.concatenate([part.code, both, shapes]) >> np.uint64(64 - BITS)
    return np.concatenate([part.row, part.row[pair], part.row[pair]]), place.astype(np.int64)


def _tokens(column: pa.Array) -> Iterator[Words]:
    return words(column, NOT_SPACE, SAME, kinds=_WORD)


class Leader:
    """Follow the regularised leader, one coordinate at a time with its own rate; the last place is the bias."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-float(w @ x))) - label) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g


#: Shares are small; this brings the dot products to the size of the bias.
SCALE = 20.0


def fit(texts: list[str], labels: np.ndarray, seed: int = 3, rounds: int = ROUNDS) -> np.ndarray:
    leader = Leader()
    rows = []
    for part in _tokens(pa.array(texts, pa.string())):
        row, place = features(part)
        order = np.lexsort((place, row))
        row, place = row[order], place[order]
        cuts = np.searchsorted(row, np.arange(part.first_row, part.first_row + part.rows + 1))
        for i in range(part.rows):
            at, times = np.unique(place[cuts[i] : cuts[i + 1]], return_counts=True)
            rows.append((np.append(at, 1 << BITS), np.append(SCALE * times / max(1, times.sum()), 1.0)))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            leader.learn(*rows[i], float(labels[i]))
    return leader.weights().astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> np.ndarray:
    return fit(*training_rows(docs, labels, learn_from, id_col, text_col, label_col, {1: max_rows, 0: max_rows}, max_chars))


def _scores(model):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            out = [np.empty(0)]
            for part in _tokens(batch.column("text")):
                row, place = features(part)
                row = row - part.first_row
                total = np.bincount(row, w[place], part.rows) / np.maximum(1, np.bincount(row, minlength=part.rows))
                out.append(1 / (1 + np.exp(-np.clip(SCALE * total + w[-1], -500, 500))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out), pa.float64())], names=[*batch.schema.names, "score"])

    return scan


def score(docs: DataFrame, model: np.ndarray, text_col: str = "text") -> DataFrame:
    """(row, text, score) per document: ``row`` holds the other columns."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(None).cast("int").alias("none")]
    state = docs.select(F.struct(*others).alias("row"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return state.mapInArrow(_scores(sent), StructType([*state.schema.fields]).add("score", "double"))


