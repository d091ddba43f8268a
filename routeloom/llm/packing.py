"""Best-fit packing by sums of squares: whole documents into sequences of bounded length.

Tokenizing is one pass over the texts and leaves narrow pieces. Pieces are dealt by hash into parts of about
``part_pieces``; each part packs its own on its own, so that no task sees all of them. A piece goes where the sum of
squares of the numbers of open bins per residual gap becomes smallest. With ten thousands of pieces in a part a
few bins stay open, which is the whole loss against one global packing.

Defined results: a null text is an empty one and has the end id alone. Rows that share an id are packed one by one.
Extra columns are ignored. An empty table gives an empty table. The order inside a part is fixed by the rows, so a repeated task
gives the same bins.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept

LENGTH = 2048
PART_PIECES = 20_000

# The splitting rule of the vocabulary file for characters that its normalizer at most lower-cases. Fixed values.
LETTERS, NUMBERS = "a-zªµºß-öø-ſ", "0-9²³¹¼½¾"
SPLIT = re.compile(rf"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
PLAIN = re.compile(r"[\t\n\r\x20-\x7E¡-įı-ſ]*\Z")
# About 250 bytes each, in every Python worker.
CACHED_CHUNKS = 120_000
CACHED_CHARS = 48


class _Chunks(dict):
    """Ids of what stands between spaces, worked out when first met; bounded."""

    def __init__(self, tokenizer):
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenize = tokenizer.model.tokenize
        split = ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {c: "".join(p for p, _ in split.pre_tokenize_str(chr(c))) for c in range(0xA1, 0x180)}

    def __missing__(self, chunk: str) -> bytes:
        words = SPLIT.findall(chunk)
        if len(words) > 1:
            ids = b"".join(map(self.__getitem__, words))
        else:
            spelled = chunk if chunk.isascii() else chunk.translate(self.as_bytes)
            ids = array("I", [t.id for t in self.tokenize(spelled)]).tobytes()
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHED_CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """Token ids of a text as little-endian 32-bit bytes.

    Texts of plain characters are cut at spaces and then by the tokenizer's splitting rule, and each word goes through its merges
    once; words never influence each other beyond that rule. All other texts, and those that name a special token, take the tokenizer as it is.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Chunks(self.tokenizer)
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        lower = text.lower()
        if not PLAIN.match(text) or any(s in lower for s in self.special):
            return self.whole(text)
        return b"".join(map(self.known.__getitem__, lower.split()))


@functools.cache
def encoder(path: str) -> Encoder:
    """One per Python worker: its words stay known from task to task."""
    return Encoder(path)


def _pieces(path: str, length: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = np.uint32(end_id).tobytes()
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            doc, k, start, size, crc = zip(*out) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, batch.schema.field("doc_id").type), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return cut


def pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and one end id, cut only if longer than ``length``."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(_pieces(tokenizer_path, length, end_id), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, placed one by one in the given order.

    ``open_bins[g]`` counts the bins with a gap of ``g``. A size moves a bin from gap ``g`` to ``g - size``, which changes the
    sum of squares by ``2 * (open_bins[g - size] - open_bins[g] + 1)``, or ``1 - 2 * open_bins[g]`` if the bin becomes full;
    a new bin changes it by ``2 * open_bins[length - size] + 1``. Full and empty bins do not count. Ties go to the smallest gap.
    """
    open_bins = np.zeros(length + 1, dtype=np.int64)
    bins_of_gap: list[list[int]] = [[] for _ in range(length + 1)]
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    made = 0
    for i, size in enumerate(sizes.tolist()):
        gap = length
        if size < length:
            now = open_bins[size:length]
            change = 2 * (open_bins[: length - size] - now + 1)
            change[0] -= 1
            change[now == 0] = np.iinfo(np.int64).max
            best = int(np.argmin(change))
            if change[best] <= 2 * open_bins[length - size] + 1:
                gap = size + best
        if gap < length:
            target = bins_of_gap[gap].pop()
            open_bins[gap] -= 1
        else:
            target, made = made, made + 1
        bins[i], offsets[i] = target, length - gap
        if gap > size:
            open_bins[gap - size] += 1
            bins_of_gap[gap - size].append(target)
    return bins, offsets


def pack(found: DataFrame, length: int = LENGTH, part_pieces: int = PART_PIECES) -> DataFrame:
    """``found`` (stored :func:`pieces`) with ``sequence_id`` and ``offset``: gapless from 0 in sequences of at most ``length``."""
    parts = max(1, ceil(found.count() / part_pieces))
    order = ["length", "doc_id", "piece", "start", "ids_crc32"]
    dealt = found.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"

    def each(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="part").sort_values(order, ascending=[False, True, True, True, True], kind="stable")
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), length)
        return rows.assign(sequence_id=(np.int64(key[0]) << 32) + bins, offset=offsets)

    return dealt.groupBy("part").applyInPandas(each, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = 0, part_pieces: int = PART_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(kept(pieces(docs, tokenizer_path, length, end_id, id_col, text_col), "pieces"), length, part_pieces)
