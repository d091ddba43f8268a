"""Spelling variants by PartEnum signatures: words one edit apart, and the form each of them is a variant of.

1. *Words.* One pass over whole texts counts the runs of letters; counts are summed per batch before they move.
2. *Signatures.* A word's letters are a multiset: a binary vector with one dimension per (letter, how often so far). Replacing a
   letter changes two dimensions, inserting or deleting one changes one. The dimensions are dealt over ``PARTS`` parts, balanced by
   how often they occur. Two vectors at most two dimensions apart agree on all parts but two at most, so they have the signature of
   those other parts in common, whichever they are: every word enumerates the signatures of all choices of parts. One dimension apart needs
   all parts but one. Words of one length meet under all parts but two, a word and one that is a letter longer under all parts but
   one, so the length belongs to the signature. So does a half of the word: one edit leaves the first or the second half as it is,
   hence a signature is enumerated with either. Nothing is lost, and nothing is capped.
3. *Join and verify.* An equi-join of the signatures with the edit distance as its condition, so only near pairs come out of it.
4. *Forms.* The near word met most often, if it is met ``FACTOR`` times as often; the root is found by pointer jumping.

Defined results: a null text has no words. Rows that share an id are counted one by one. A null id counts as the empty text in
the hash. Extra columns are ignored, clashing names included. An empty table gives an empty table. A word of any length is one word.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Kept
from .tokens import mix

# Latin-1 bytes: A to Z lower-cased, a to z and 0xC0 to 0xFF as they are, all else a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
MIN_LENGTH, MIN_COUNT, FACTOR = 5, 3, 2
DROP_ONE_IN = 97
# Parts of the dimensions: words of one length enumerate PARTS * (PARTS - 1) / 2 signatures a half, the others PARTS.
PARTS = 4
# Distinct words counted in one task before they are handed on.
MAX_COUNTED = 500_000
_CHARS, _TIMES = 256, 64


def runs(text: str | None) -> Counter:
    """How often each run of letters occurs, lower-cased, as Latin-1 bytes: one byte a letter."""
    # A character beyond Latin-1 becomes a question mark, which is no letter either.
    return Counter((text or "").encode("latin-1", "replace").translate(LETTERS).split())


def spoiled(prefix: int, run: bytes) -> bytes:
    """``run`` as it counts in a document whose id and colon have the crc32 ``prefix``: one run in ``DROP_ONE_IN`` loses a letter."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % DROP_ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(min_length: int, spoil: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: defaultdict = defaultdict(int)

        def counted() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in found]
            return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": pa.array(list(found.values()), pa.int64())})

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in runs(text).items():
                    word = spoiled(prefix, run) if spoil else run
                    if len(word) >= min_length:
                        found[word] += n
                if len(found) >= MAX_COUNTED:
                    yield counted()
                    found.clear()
        yield counted()

    return scan


def count_words(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, spoil: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(word, n): runs of letters of at least ``min_length`` that occur ``min_count`` times; ``spoil`` drops letters as the contract says."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counted = narrow.mapInArrow(_count(min_length, spoil), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, letter, how often so far) of all letters of some words, each word's letters in order."""
    chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    place = np.lexsort((chars, row))
    row, chars = row[place], chars[place]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (chars[1:] != chars[:-1])
    at = np.arange(len(row))
    return row, chars, at - at[new][np.cumsum(new) - 1]


def _dimension(chars: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Dimensions share a place in the balance from ``_TIMES`` repeats on; the signature still tells them apart."""
    return np.minimum(chars, _CHARS - 1) * _TIMES + np.minimum(times, _TIMES - 1)


def _dimensions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, chars, times = _letters(batch.column("word").to_pylist())
        dims, n = np.unique(_dimension(chars, times), return_counts=True)
        yield pa.RecordBatch.from_pydict({"dim": pa.array(dims, pa.int32()), "n": pa.array(n, pa.int64())})


def balanced_parts(dims: np.ndarray, counts: np.ndarray, parts: int) -> np.ndarray:
    """Part of each dimension: from frequent to rare, each goes to the part with the least so far."""
    out, load = np.arange(_CHARS * _TIMES) % parts, np.zeros(parts, np.int64)
    for i in np.lexsort((dims, -counts)):
        out[dims[i]] = part = int(np.argmin(load))
        load[part] += counts[i]
    return out.astype(np.int8)


def _halves(words: list[str], shorter: bool) -> np.ndarray:
    """(word, half): a code of what stands before and behind the middle. ``shorter``: without the letter in the middle.

    Letters count from their own end of the word, so halves of words of different lengths compare.
    """
    size = np.array([len(w) for w in words])
    chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    starts = np.cumsum(size) - size
    at = np.arange(len(chars)) - np.repeat(starts, size)
    left, middle = np.repeat(size, size) - at, np.repeat((size - shorter) // 2, size)
    code = lambda place: mix((chars << np.uint64(32)) + place.astype(np.uint64))
    first = np.where(at < middle, code(at), np.uint64(0))
    second = np.where(at >= middle + shorter, code(left), np.uint64(0))
    return np.stack([np.add.reduceat(first, starts), mix(np.add.reduceat(second, starts) + np.uint64(1))], axis=1)


def _signatures(part_of: np.ndarray, parts: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.array(list(combinations(range(parts), 2)))
        for batch in batches:
            words = batch.column("word").to_pylist()
            if not words:
                continue
            row, chars, times = _letters(words)
            value = mix((chars.astype(np.uint64) << np.uint64(32)) + times.astype(np.uint64))
            own = np.zeros((len(words), parts), np.uint64)
            np.add.at(own, (row, part_of[_dimension(chars, times)]), value)
            total, size = own.sum(axis=1, dtype=np.uint64)[:, None], np.array([len(w) for w in words], dtype=np.uint64)[:, None]
            whole, cut = _halves(words, False), _halves(words, True)
            without_two = total - own[:, pairs[:, 0]] - own[:, pairs[:, 1]]
            shapes = ((0, without_two, size, whole), (1, total - own, size + np.uint64(1), whole), (2, total - own, size, cut))
            for role, content, length, halves in shapes:
                choice = mix((np.arange(content.shape[1], dtype=np.uint64) << np.uint64(32)) + (length << np.uint64(1)) + np.uint64(role > 0))
                signature = mix(mix(content) ^ choice)[:, :, None] ^ halves[:, None, :]
                each = signature[0].size
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signature.ravel().view(np.int64)), pa.array(np.full(signature.size, role), pa.int8()),
                        batch.column("word").take(pa.array(np.repeat(np.arange(len(words)), each))),
                    ],
                    names=["signature", "role", "word"],
                )

    return scan


def near_pairs(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(word, near): the words exactly one edit apart, both ways. ``words`` should be a stored table of distinct words.

    Role 0 meets words of its own length, role 1 (shorter) meets role 2 (longer).
    """
    # At most _CHARS * _TIMES rows.
    table = words.select("word").mapInArrow(_dimensions, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).toArrow()
    part_of = balanced_parts(table.column("dim").to_numpy(), table.column("n").to_numpy(), parts)
    found = words.select("word").mapInArrow(_signatures(part_of, parts), "signature long, role byte, word string")
    left = found.filter("role < 2").select("signature", "role", "word")
    right = found.filter("role <> 1").select("signature", F.col("role").alias("near_role"), F.col("word").alias("near"))
    met = (
        (left["signature"] == right["signature"])
        & (((F.col("role") == 0) & (F.col("near_role") == 0) & (F.col("word") < F.col("near"))) | ((F.col("role") == 1) & (F.col("near_role") == 2)))
        & (F.levenshtein("word", "near", 1) == 1)
    )
    # The planner sizes signatures by the words they come from, many times too low: they would be broadcast.
    once = left.join(right.hint("merge"), met).select("word", "near").distinct()
    both = F.explode(F.array(F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"))))
    return once.select(both.alias("p")).select("p.word", "p.near")


def variants(words: DataFrame, factor: int = FACTOR, parts: int = PARTS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words (word, n): what each is a variant of, directly and in the end."""
    kept = Kept(words.sparkSession)
    words = kept(words.select("word", "n"), "words")
    pairs = kept(near_pairs(words, parts), "near-words")
    # The same holds for tables of words, which take many times their stored size on the driver.
    others = words.select(F.col("word").alias("near"), F.col("n").alias("near_n")).hint("merge")
    best = (
        pairs.join(others, "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("best"))
    )
    chosen = words.join(best.hint("merge"), "word", "left").withColumn("picks", F.coalesce(-F.col("best.least") >= factor * F.col("n"), F.lit(False)))
    forms = kept(
        chosen.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("picks"), F.col("best.near")).alias("form"),
            F.when(F.col("picks"), -F.col("best.least")).cast("long").alias("form_n"),
        ),
        "forms",
    )
    # Each step to a form at least multiplies the count, so a few jumps reach every root.
    state, further, turn = forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), True, 0
    while further:
        state = kept(state, f"roots-{turn}")
        next_of = state.select(F.col("word").alias("root"), F.col("root").alias("next")).hint("merge")
        jumped = state.join(next_of, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        turn += 1
        jumped = kept(jumped, f"jumps-{turn}")
        further = not jumped.filter("moved").isEmpty()
        state = jumped.select("word", "root")
    return forms.join(state.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
