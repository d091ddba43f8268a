"""Language identification by prediction by partial matching.

Each language has byte contexts of every length up to ``ORDER`` with counts of what followed. A byte costs its exact code length:
the escapes from the contexts that have not seen it, then its share in the longest one that has (method C: an escape has the
share ``distinct / (total + distinct)``; ``1/256`` after the last one; no exclusions). The statistics are frozen, so what a byte costs
after a context is a number, worked out once for all languages together. Scoring looks each byte up in the longest contexts, and only
what no language has seen there goes on to shorter ones.

Spark counts the contexts in the first ``max_rows`` texts of each language in order of a hash of their id, those of at most ``max_chars``
characters. The language of a text is the one with the shortest code. Its score is its share among the languages when
code lengths count as evidence for ``EVIDENCE`` bytes at most.

Defined results: a null text, or one without a letter, is ``und`` with score 0. If nothing was learned, every text is ``und``. Ties go
to the smaller language name. Repeated rows get equal results, extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .tokens import CHUNK, mix, text_bytes

ORDER = 4
MAX_ROWS, MAX_CHARS = 300, 20_000
EVIDENCE = 64


def histories(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with the ``ORDER`` bytes before it as one number; what stands before a text counts as 0."""
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = data.astype(np.uint64)
    for k in range(1, ORDER + 1):
        before = np.zeros(len(data), dtype=np.uint64)
        before[k:] = data[:-k]
        before[place < k] = 0
        out |= before << np.uint64(8 * k)
    return out


def _cut(history: np.ndarray, order: int) -> np.ndarray:
    return history & np.uint64((1 << 8 * (order + 1)) - 1)


def text_parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of some whole texts at a time."""
    offsets, data = text_bytes(column)
    row = 0
    while row < len(offsets) - 1:
        upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        yield row, offsets[row : upto + 1] - offsets[row], data[offsets[row] : offsets[upto]]
        row = upto


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = np.array(batch.column("lang").to_pylist(), dtype=object)
        for first, offsets, data in text_parts(batch.column("text")):
            history = histories(data, offsets)
            lang = np.repeat(names[first : first + len(offsets) - 1], np.diff(offsets))
            for name in sorted(set(lang)):
                for order in range(ORDER + 1):
                    gram, times = np.unique(_cut(history[lang == name], order), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(gram), pa.string()), pa.array(np.full(len(gram), order), pa.int32()), pa.array(gram.astype(np.int64)), pa.array(times.astype(np.int64))],
                        names=["lang", "order", "gram", "times"],
                    )


class Places:
    """Where a number stands in an array of distinct ones: a hash table with linear probing."""

    def __init__(self, numbers: np.ndarray):
        self.numbers = numbers
        self.bits = max(4, (4 * len(numbers)).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        left, at = np.arange(len(numbers)), self._first(numbers)
        while len(left):
            open_slots, chosen = np.unique(at, return_index=True)
            free = self.slots[open_slots] < 0
            self.slots[open_slots[free]] = left[chosen[free]]
            rest = np.ones(len(left), dtype=bool)
            rest[chosen[free]] = False
            left, at = left[rest], (at[rest] + 1) & (len(self.slots) - 1)

    def _first(self, numbers: np.ndarray) -> np.ndarray:
        return (mix(numbers) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted number, or -1."""
        at = self._first(wanted)
        out = self.slots[at]
        left = np.flatnonzero(out >= 0)
        while len(left):
            left = left[self.numbers[out[left]] != wanted[left]]
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
            out[left] = self.slots[at[left]]
            left = left[out[left] >= 0]
        return out


class Coder:
    """Code lengths in bits of bytes after their histories, for all languages at once."""

    def __init__(self, counts: pa.Table):
        lang = np.array(counts.column("lang").to_pylist(), dtype=object)
        self.languages = sorted(set(lang))
        number = {name: i for i, name in enumerate(self.languages)}
        lang = np.array([number[x] for x in lang], dtype=np.int64)
        order, gram, times = (counts.column(c).to_numpy() for c in ("order", "gram", "times"))
        gram = gram.astype(np.int64).view(np.uint64)
        self.levels = []
        shorter = None
        for k in range(ORDER + 1):
            own = order == k
            grams, place = np.unique(gram[own], return_inverse=True)
            seen = np.zeros((len(grams), len(self.languages)))
            seen[place, lang[own]] = times[own]
            contexts, context = np.unique(grams >> np.uint64(8), return_inverse=True)
            total, distinct = np.zeros((len(contexts), len(self.languages))), np.zeros((len(contexts), len(self.languages)))
            np.add.at(total, context, seen)
            np.add.at(distinct, context, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(distinct > 0, np.log2(total + distinct) - np.log2(distinct), 0)
                hit = np.log2(total + distinct)[context] - np.log2(seen)
            below = 8.0 if shorter is None else shorter[1][shorter[0].find(_cut(grams, k - 1))]
            cost = np.where(seen > 0, hit, escape[context] + below)
            shorter = (Places(grams), cost)
            self.levels.append((shorter[0], cost.astype(np.float32), Places(contexts), escape.astype(np.float32)))

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text in each language."""
        rows, n = len(offsets) - 1, len(self.languages)
        bits = np.zeros((rows, n))
        history = histories(data, offsets)
        row = np.repeat(np.arange(rows), np.diff(offsets))

        def add(where: np.ndarray, cost: np.ndarray) -> None:
            for i in range(n):
                bits[:, i] += np.bincount(where, cost[:, i], rows)

        for k in range(ORDER, -1, -1):
            known, cost, contexts, escape = self.levels[k]
            own = _cut(history, k)
            place = known.find(own)
            hit = place >= 0
            add(row[hit], cost[place[hit]])
            history, row, own = history[~hit], row[~hit], own[~hit]
            context = contexts.find(own >> np.uint64(8))
            some = context >= 0
            add(row[some], escape[context[some]])
        return bits + 8.0 * np.bincount(row, minlength=rows)[:, None]


def train(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Coder:
    known = docs.filter(learn_from & F.col(lang_col).isNotNull() & F.char_length(text_col).between(1, max_chars))
    ids = known.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("lang"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("_id"), "_id"))
    picked = ids.withColumn("_rank", rank).filter(F.col("_rank") <= max_rows).select("_id", "lang").distinct()
    texts = known.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(picked), ["_id", "lang"]).select("lang", "text")
    counts = sample.mapInArrow(_counts, "lang string, order int, gram long, times long").groupBy("lang", "order", "gram").agg(F.sum("times").alias("times"))
    return Coder(counts.toArrow())


def _predictions(model):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model.value
        names = np.array([*coder.languages, "und"], dtype=object)
        for batch in batches:
            best, score = [np.empty(0, np.int64)], [np.empty(0)]
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            for first, offsets, data in text_parts(batch.column("text")):
                rows = len(offsets) - 1
                sure = lettered[first : first + rows]
                if not coder.languages:
                    best.append(np.full(rows, -1))
                    score.append(np.zeros(rows))
                    continue
                bits = coder.lengths(data, offsets)
                bits -= bits.min(axis=1, keepdims=True)
                weight = 2.0 ** -(bits * np.minimum(1, EVIDENCE / np.maximum(1, np.diff(offsets)))[:, None])
                best.append(np.where(sure, np.argmin(bits, axis=1), -1))
                score.append(np.where(sure, 1 / weight.sum(axis=1), 0.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("text"), pa.array(names[np.concatenate(best)], pa.string()), pa.array(np.concatenate(score), pa.float64())],
                names=["row", "text", "lang_pred", "score"],
            )

    return scan


def predict(docs: DataFrame, model: Coder, text_col: str = "text") -> DataFrame:
    """(row, text, lang_pred, score) per document: ``row`` holds the other columns."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(None).cast("int").alias("none")]
    state = docs.select(F.struct(*others).alias("row"), F.col(text_col).alias("text"))
    asked = state.withColumn("lettered", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return asked.mapInArrow(_predictions(sent), StructType([*state.schema.fields]).add("lang_pred", "string").add("score", "double"))
