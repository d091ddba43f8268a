"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Each word enters as a learned vector of its own and the mean of learned vectors of its character trigrams. A document is
read in windows of ``WINDOW`` words that overlap by half; all of them are scored and the highest score is the document's.
Training sees labels of whole documents: in every round the window of each toxic document that looks worst counts as positive, those
of clean documents count as negative. Word vectors start from the words' shares in both and are drawn back to that start, so that words
of few documents stay near it unless they are of use.

The network is fitted on the driver on at most ``max_rows`` toxic and twice as many other labelled rows, the first in order of
a hash of their id, with at most ``max_chars`` characters each. Scoring reads all documents in one pass without a shuffle.

Defined results: null and empty texts have one empty window and get the score of that. Labels without a text, and null labels, teach
nothing; without any labelled row the network stays at its start and every score is the same. Extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tokens import ALNUM, Codes, Words, mix, words
from .training import give_back, training_rows, trim, trimmed

WINDOW, STEP = 32, 16
GRAM_BITS, WIDTH, HIDDEN = 12, 8, 8
# Words of fewer training documents have no vector of their own, only their trigrams'.
MIN_DOCUMENTS = 3
MAX_ROWS, MAX_CHARS = 1000, 6_000
ROUNDS, PER_ROUND, BATCH, RATE, DECAY = 10, 3000, 256, 0.01, 5e-3
# Windows that go through the network together, and words whose trigrams are looked up together.
TOGETHER = 1024
WORDS_TOGETHER = 1 << 14


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Windows:
    """Overlapping windows of some documents as places in a table of their distinct words."""

    def __init__(self, part: Words, known: Codes):
        code, first, place = np.unique(part.code, return_index=True, return_inverse=True)
        place = place.astype(np.int32)
        self.word = np.zeros(len(code), dtype=np.int64)
        found, rank = known.find(code)
        self.word[found] = rank + 1
        start = part.start[first]
        self.lengths = (part.end[first] - start).astype(np.int64)
        self.gram_from = np.cumsum(self.lengths) - self.lengths
        data = np.concatenate([np.zeros(1, np.uint8), part.data, np.zeros(1, np.uint8)])
        self.gram = np.empty(self.lengths.sum(), dtype=np.int16)
        for i in range(0, len(code), WORDS_TOGETHER):
            length = self.lengths[i : i + WORDS_TOGETHER]
            begin = np.cumsum(length) - length
            at = np.repeat(start[i : i + WORDS_TOGETHER] - begin, length) + np.arange(length.sum())
            left, here, right = (data[at + k].astype(np.uint64) for k in range(3))
            left[begin], right[begin + length - 1] = 0, 0
            gram = mix((left << np.uint64(16)) | (here << np.uint64(8)) | right) >> np.uint64(64 - GRAM_BITS)
            self.gram[self.gram_from[i] : self.gram_from[i] + len(gram)] = gram
        bounds = part.bounds()
        n = np.diff(bounds)
        count = np.maximum(1, -(-(n - STEP) // STEP))
        self.row = np.repeat(np.arange(part.rows), count)
        self.window_from = np.cumsum(count) - count
        offset = (np.arange(len(self.row)) - self.window_from[self.row]) * STEP
        self.mask = np.arange(WINDOW) < (n[self.row] - offset)[:, None]
        # 32 bits: this and the mask are all that the training holds of the texts.
        self.token = np.full(self.mask.shape, len(code), dtype=np.int32)
        begin = bounds[:-1][self.row] + offset
        for i in range(0, len(begin), TOGETHER):
            mask = self.mask[i : i + TOGETHER]
            self.token[i : i + TOGETHER][mask] = place[(begin[i : i + TOGETHER, None] + np.arange(WINDOW))[mask]]


class Network:
    def __init__(self, known_words: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "word": np.zeros((len(known_words) + 1, WIDTH), np.float32),
            "gram": normal(1 << GRAM_BITS, WIDTH, scale=0.1),
            "into": normal(2 * WIDTH, 6 * HIDDEN, scale=0.3),
            "bias": np.zeros(6 * HIDDEN, np.float32),
            "ahead": normal(HIDDEN, 3 * HIDDEN, scale=0.3),
            "back": normal(HIDDEN, 3 * HIDDEN, scale=0.3),
            "look": normal(2 * HIDDEN, scale=0.3),
            "out": normal(2 * HIDDEN, scale=0.3),
            "base": np.zeros(1, np.float32),
        }
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.steps = 0
        self.start = 0  # where word vectors are drawn to

    def inputs(self, w: Windows) -> np.ndarray:
        """A vector per distinct word: its own and the mean of its trigrams'."""
        out = np.empty((len(w.word), 2 * WIDTH), self.p["gram"].dtype)
        out[:, :WIDTH] = self.p["word"][w.word]
        for i in range(0, len(w.word), WORDS_TOGETHER):
            own = slice(i, i + WORDS_TOGETHER)
            begin, length = w.gram_from[own], w.lengths[own]
            grams = self.p["gram"][w.gram[begin[0] : begin[-1] + length[-1]]]
            out[own, WIDTH:] = np.add.reduceat(grams, begin - begin[0], axis=0) / length[:, None].astype(np.float32)
        return out

    def _run(self, gates: np.ndarray, mask: np.ndarray, u: np.ndarray, steps, keep: list | None) -> np.ndarray:
        h = np.zeros((len(gates), HIDDEN), np.float32)
        states = np.empty((len(gates), WINDOW, HIDDEN), np.float32)
        for t in steps:
            hu, g = h @ u, gates[:, t]
            zr = sigmoid(g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(g[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            m = mask[:, t, None]
            if keep is not None:
                keep.append((t, h, z, r, c, hu[:, 2 * HIDDEN :], m))
            h = h + m * (1 - z) * (c - h)
            states[:, t] = h
        return states

    def forward(self, table: np.ndarray, token: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit per window; ``table`` has the gate inputs of each distinct word and a last row for none."""
        m = mask.astype(np.float32)
        gates = table[token]
        kept_ahead, kept_back = ([], []) if keep is not None else (None, None)
        h = np.concatenate(
            [
                self._run(gates[:, :, : 3 * HIDDEN], m, self.p["ahead"], range(WINDOW), kept_ahead),
                self._run(gates[:, :, 3 * HIDDEN :], m, self.p["back"], range(WINDOW - 1, -1, -1), kept_back),
            ],
            axis=2,
        )
        a = np.where(mask, h @ self.p["look"], -1e9)
        weight = np.exp(a - a.max(axis=1, keepdims=True)) * m
        weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,nth->nh", weight, h)
        if keep is not None:
            keep.update(h=h, weight=weight, pooled=pooled, ahead=kept_ahead, back=kept_back)
        return pooled @ self.p["out"] + self.p["base"][0]

    def gate_table(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x) + 1, 6 * HIDDEN), np.result_type(x, self.p["into"]))
        np.matmul(x, self.p["into"], out=out[:-1])
        out[:-1] += self.p["bias"]
        return out

    def logits(self, w: Windows) -> np.ndarray:
        table = self.gate_table(self.inputs(w))
        parts = [self.forward(table, w.token[i : i + TOGETHER], w.mask[i : i + TOGETHER]) for i in range(0, len(w.token), TOGETHER)]
        return np.concatenate(parts) if parts else np.empty(0, np.float32)

    def _back_run(self, kept: list, dstates: np.ndarray, u: np.ndarray, dgates: np.ndarray) -> np.ndarray:
        du, dh = np.zeros_like(u), np.zeros((len(dstates), HIDDEN), np.float32)
        for t, h, z, r, c, uc, m in reversed(kept):
            dh = dh + dstates[:, t]
            new = m * dh
            dc = new * (1 - z) * (1 - c * c)
            dz = new * (h - c) * z * (1 - z)
            dr = dc * uc * r * (1 - r)
            dgates[:, t] = np.concatenate([dz, dr, dc], axis=1)
            dhu = np.concatenate([dz, dr, dc * r], axis=1)
            du += h.T @ dhu
            dh = dh - new * (1 - z) + dhu @ u.T
        return du

    def learn(self, w: Windows, chosen: np.ndarray, wanted: np.ndarray) -> None:
        """One step of Adam on some windows of ``w``."""
        token, mask = w.token[chosen], w.mask[chosen]
        used, local = np.unique(token, return_inverse=True)
        local = local.reshape(token.shape)
        real = used < len(w.word)
        some = used[real]
        length = w.lengths[some]
        gram_at = np.repeat(w.gram_from[some] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        gram = w.gram[gram_at]
        begin = np.cumsum(length) - length
        vectors = np.add.reduceat(self.p["gram"][gram], begin, axis=0) / length[:, None].astype(np.float32) if len(some) else np.zeros((0, WIDTH), np.float32)
        x = np.concatenate([self.p["word"][w.word[some]], vectors], axis=1)
        table = np.concatenate([x @ self.p["into"] + self.p["bias"], np.zeros((len(used) - len(some), 6 * HIDDEN), np.float32)])
        keep: dict = {}
        logit = self.forward(table, local, mask, keep)
        d = ((sigmoid(logit) - wanted) / len(wanted)).astype(np.float32)
        h, weight = keep["h"], keep["weight"]
        grad = {"base": d.sum(keepdims=True), "out": d @ keep["pooled"]}
        dpooled = d[:, None] * self.p["out"]
        dweight = np.einsum("nth,nh->nt", h, dpooled)
        da = weight * (dweight - (weight * dweight).sum(axis=1, keepdims=True))
        grad["look"] = np.einsum("nt,nth->h", da, h)
        dstates = weight[:, :, None] * dpooled[:, None, :] + da[:, :, None] * self.p["look"]
        dgates = np.empty((*token.shape, 6 * HIDDEN), np.float32)
        grad["ahead"] = self._back_run(keep["ahead"], dstates[:, :, :HIDDEN], self.p["ahead"], dgates[:, :, : 3 * HIDDEN])
        grad["back"] = self._back_run(keep["back"], dstates[:, :, HIDDEN:], self.p["back"], dgates[:, :, 3 * HIDDEN :])
        flat = local.ravel()
        order = np.argsort(flat, kind="stable")
        per_word = np.add.reduceat(dgates.reshape(-1, 6 * HIDDEN)[order], np.searchsorted(flat[order], np.arange(len(used))), axis=0)[: len(some)]
        grad["into"], grad["bias"] = x.T @ per_word, per_word.sum(axis=0)
        dx = per_word @ self.p["into"].T
        grad["word"] = np.zeros_like(self.p["word"])
        np.add.at(grad["word"], w.word[some], dx[:, :WIDTH])
        grad["gram"] = np.zeros_like(self.p["gram"])
        np.add.at(grad["gram"], gram, np.repeat(dx[:, WIDTH:] / length[:, None].astype(np.float32), length, axis=0))
        self.steps += 1
        grad["word"] += DECAY * (self.p["word"] - self.start)
        grad["gram"] += DECAY * self.p["gram"]
        grad["word"][0] = 0
        for k, g in grad.items():
            first, second = self.moments[k]
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            scale = RATE * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
            self.p[k] -= (scale * first / (np.sqrt(second) + 1e-8)).astype(np.float32)


def _one(texts: list[str]) -> Words:
    """All texts as one batch of words (they are bounded)."""
    kind = np.int32 if 4 * sum(map(len, texts)) < 1 << 31 else np.int64
    data, row, start, end, code, offsets = [], [], [], [], [], [np.zeros(1, np.int64)]
    for p in words(pa.array(texts, pa.string()), ALNUM):
        shift = offsets[-1][-1]
        data.append(p.data)
        offsets.append(p.offsets[1:] + shift)
        row.append(p.row.astype(kind))
        start.append((p.start + shift).astype(kind))
        end.append((p.end + shift).astype(kind))
        code.append(p.code)

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        out = np.concatenate(parts)
        parts.clear()
        return out

    return Words(joined(data), joined(offsets), 0, *map(joined, (row, start, end, code)))


def _word_sets(part: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of the distinct words of each document, sorted by both."""
    rows, codes, bounds = [np.empty(0, np.int32)], [np.empty(0, np.uint64)], part.bounds()
    for i in range(part.rows):
        codes.append(np.unique(part.code[bounds[i] : bounds[i + 1]]))
        rows.append(np.full(len(codes[-1]), part.first_row + i, np.int32))
    return np.concatenate(rows), np.concatenate(codes)


def _leaning(row: np.ndarray, code: np.ndarray, known: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Where the training of word vectors starts: how far the toxic documents with a word exceed what chance gives, in deviations."""
    found, rank = Codes(known).find(code)
    toxic = labels[row[found]]
    n, bad, share = np.bincount(rank, minlength=len(known)), np.bincount(rank, toxic, len(known)), labels.mean()
    return np.clip((bad - n * share) / np.sqrt(n * share * (1 - share) + 1), -4, 12) / 6


def fit(texts: list[str], labels: np.ndarray, seed: int = 7, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Parameters of the network after training on whole labelled texts."""
    if not len(texts):
        return {**Network(np.empty(0, np.uint64), seed).p, "known": np.empty(0, np.uint64)}
    rng = np.random.default_rng(seed)
    part = _one(texts)
    trim()
    row, code = _word_sets(part)
    distinct, times = np.unique(code, return_counts=True)
    known = distinct[times >= MIN_DOCUMENTS]
    net = Network(known, seed)
    net.p["word"][1:, 0] = _leaning(row, code, known, np.asarray(labels))
    net.start = net.p["word"].copy()
    del row, code, distinct, times
    w = Windows(part, Codes(known))
    del part
    trim()
    label = np.asarray(labels)[w.row]
    net.p["base"][0] = np.log((label.mean() + 1e-3) / (1 - label.mean() + 1e-3))
    good, bad = np.flatnonzero(label == 0), np.flatnonzero(label == 1)
    score = np.append(net.p["word"][w.word, 0], 0)[w.token].max(axis=1)
    for turn in range(rounds if len(bad) and len(good) else 0):
        score = net.logits(w) if turn else score
        best = score == np.maximum.reduceat(score, w.window_from)[w.row]
        hard = good[best[good]]
        # One window of every toxic document before any has a second turn.
        worst = rng.permutation(bad[best[bad]])
        worst = worst[np.unique(w.row[worst], return_index=True)[1]]
        positive = np.concatenate([rng.permutation(worst) for _ in range(-(-PER_ROUND // len(worst)))])[: max(PER_ROUND, len(worst))]
        negative = np.concatenate([rng.choice(hard, PER_ROUND), rng.choice(good, PER_ROUND)])
        chosen = rng.permutation(np.concatenate([positive, negative]))
        for i in range(0, len(chosen), BATCH):
            own = chosen[i : i + BATCH]
            net.learn(w, own, label[own].astype(np.float32))
    return {**net.p, "known": known}


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> dict[str, np.ndarray]:
    texts, known = training_rows(docs, labels, learn_from, id_col, text_col, label_col, {1: max_rows, 0: 2 * max_rows}, max_chars)
    # What the JVM took to find the rows and what the training takes need not stand in memory together.
    give_back(docs.sparkSession)
    model = fit(texts, known)
    give_back(docs.sparkSession)
    return model


def _scores(model):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.__new__(Network)
        net.p = model.value
        known = Codes(net.p["known"])
        for batch in batches:
            out = [np.empty(0, np.float32)]
            for part in words(batch.column("text"), ALNUM):
                w = Windows(part, known)
                out.append(np.maximum.reduceat(net.logits(w), w.window_from))
            score = sigmoid(np.concatenate(out).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, "score"])

    return scan


def score(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """(row, text, score) per document: ``row`` holds the other columns, ``score`` the highest of all its windows."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(None).cast("int").alias("none")]
    state = docs.select(F.struct(*others).alias("row"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return state.mapInArrow(trimmed(_scores(sent)), StructType([*state.schema.fields]).add("score", "double"))


def remove_toxic(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", least: float = 0.7) -> DataFrame:
    """``docs`` without those that score ``least`` or more, columns unchanged."""
    clean = score(docs, model, text_col).filter(F.col("score") < least)
    return clean.select(*[F.col("text" if c == text_col else f"row.`{c}`").alias(c) for c in docs.columns])
