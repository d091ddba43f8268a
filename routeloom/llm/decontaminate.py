"""Benchmark decontamination: hash windows of test items, scan token windows of documents, verify, remove.

The windows of the benchmark are broadcast as a sorted array of hashes with the items' words. A benchmark
larger than ``slice_chars`` is cut by a hash of its items into slices of about that size, and the documents pass one
slice after the other: what is broadcast at a time is bounded, nothing is skipped. The text never enters a shuffle.

Defined results: null and empty texts have no words and no hits. A null ``item_id`` hits but is not listed. Repeated
items and repeated documents give the same result each. Extra columns are left alone. An empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from .tokens import ALNUM, words

WINDOW = 13
# Characters of benchmark text in one broadcast.
SLICE_CHARS = 16_000_000
_SLOTS = 1 << 22


class Windows:
    """Hash set of the word windows of some items, with the words to verify a hit."""

    def __init__(self, items: pa.Table, window: int):
        self.ids = items.column("item_id").to_pylist()
        self.lists: list[list[bytes]] = []
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for part in words(items.column("text"), ALNUM):
            edges, data = part.bounds(), part.data.tobytes()
            lengths = np.diff(edges)
            self.lists += [[data[part.start[k] : part.end[k]] for k in range(edges[i], edges[i + 1])] for i in range(part.rows)]
            for n in set(np.minimum(lengths[lengths > 0], window).tolist()):
                place, code = part.grams(n)
                item = part.row[place]
                own = np.minimum(lengths[item - part.first_row], window) == n
                found.setdefault(n, []).append((code[own], item[own], (place - edges[item - part.first_row])[own]))
        self.by_length = {}
        for n, parts in found.items():
            code, item, at = map(np.concatenate, zip(*parts))
            order = np.argsort(code, kind="stable")
            slots = np.zeros(_SLOTS // 8, dtype=np.uint8)
            slot = code >> np.uint64(42)
            np.bitwise_or.at(slots, (slot >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (slot & np.uint64(7)).astype(np.uint8)))
            self.by_length[n] = (slots, code[order], item[order], at[order])

    def scan(self, part) -> Iterator[tuple[int, int, int]]:
        """(place of a document word, window length, item) for each verified occurrence."""
        data = None
        for n, (slots, codes, items, ats) in self.by_length.items():
            place, code = part.grams(n)
            slot = code >> np.uint64(42)
            near = np.flatnonzero((slots[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
            low, high = np.searchsorted(codes, code[near], "left"), np.searchsorted(codes, code[near], "right")
            for k in np.flatnonzero(high > low):
                p = int(place[near[k]])
                data = part.data.tobytes() if data is None else data
                seen = [data[s:e] for s, e in zip(part.start[p : p + n], part.end[p : p + n])]
                for j in range(low[k], high[k]):
                    if self.lists[items[j]][ats[j] : ats[j] + n] == seen:
                        yield p, n, int(items[j])


def _scan_slice(windows, first: bool):
    """Adds to ``hit_words`` (places of hit words) and ``items`` of each row what one slice of the benchmark hits."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = windows.value
        for batch in batches:
            counts: list[int] = []
            hits: list[np.ndarray] = []
            items: list[set] = []
            before_hits, before_items = (None, None) if first else (batch.column("hit_words"), batch.column("items"))
            for part in words(batch.column("text"), ALNUM):
                hit = np.zeros(len(part.code), dtype=bool)
                found: dict[int, set] = {}
                edges = part.bounds()
                for place, n, item in known.scan(part):
                    hit[place : place + n] = True
                    if known.ids[item] is not None:
                        found.setdefault(int(part.row[place]), set()).add(str(known.ids[item]))
                for i in range(part.rows):
                    row = part.first_row + i
                    own = np.flatnonzero(hit[edges[i] : edges[i + 1]])
                    names = found.get(row, set())
                    if before_hits is not None:
                        own = np.union1d(own, np.array(before_hits[row].as_py(), dtype=np.int64))
                        names = names | set(before_items[row].as_py())
                    hits.append(own)
                    items.append(names)
                counts += np.diff(edges).tolist()
            offsets = np.concatenate([[0], np.cumsum([len(h) for h in hits])]).astype(np.int32)
            flat = np.concatenate(hits) if hits else np.empty(0, np.int64)
            columns = {
                **{c: batch.column(c) for c in ("row", "text")},
                "n_words": pa.array(counts, pa.int64()),
                "hit_words": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32))),
                "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return scan


def contamination(
    docs: DataFrame, bench: DataFrame, text_col: str = "text", window: int = WINDOW, slice_chars: int = SLICE_CHARS
) -> DataFrame:
    """(row, text, n_words, hit_words, items) per document.

    ``row`` holds the other columns of ``docs``, ``hit_words`` the sorted places of the words inside any occurrence of a
    window, ``items`` the sorted ids of the items with occurring windows. An item of fewer than ``window`` words is one window.
    """
    spark = docs.sparkSession
    items = bench.select(F.col("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    slices = max(1, ceil(chars / slice_chars))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(None).cast("int").alias("none")]
    state = docs.select(F.struct(*others).alias("row"), F.col(text_col).alias("text"))
    schema = StructType([*state.schema.fields]).add("n_words", "long").add("hit_words", ArrayType(IntegerType())).add("items", ArrayType(StringType()))
    for k in range(slices):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).toArrow()
        state = state.mapInArrow(_scan_slice(spark.sparkContext.broadcast(Windows(own, window)), k == 0), schema)
    return state


def is_contaminated(least_share: int = 20):
    """At least one hit word, and at least one of ``least_share`` words hit."""
    n_hit = F.size("hit_words")
    return (n_hit > 0) & (n_hit * F.lit(least_share).cast("long") >= F.col("n_words"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(
        F.col(f"row.`{id_col}`").alias("doc_id"),
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def remove_documents(docs: DataFrame, bench: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the contaminated ones, columns unchanged."""
    found = contamination(docs, bench, text_col, **how).filter(~is_contaminated())
    return found.select(*[F.col("text" if c == text_col else f"row.`{c}`").alias(c) for c in docs.columns])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for part in words(batch.column("text"), ALNUM):
            edges = part.bounds()
            for i in range(part.rows):
                row = part.first_row + i
                hit = np.array(batch.column("hit_words")[row].as_py(), dtype=np.int64)
                if texts[row] is None or not len(hit):
                    continue
                raw = texts[row].encode()
                base = int(part.offsets[i])
                runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
                cuts = [(int(part.start[edges[i] + r[0]]) - base, int(part.end[edges[i] + r[-1]]) - base) for r in runs]
                left = [0, *[e for _, e in cuts]], [*[s for s, _ in cuts], len(raw)]
                texts[row] = b"".join(raw[s:e] for s, e in zip(*left)).decode()
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])


def remove_spans(docs: DataFrame, bench: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``docs`` with the hit words, and what stands between neighbouring ones, cut out of the text."""
    found = contamination(docs, bench, text_col, **how)
    cut = found.select("row", "text", "hit_words").mapInArrow(_cut, found.select("row", "text").schema)
    return cut.select(*[F.col("text" if c == text_col else f"row.`{c}`").alias(c) for c in docs.columns])


def sha256_of(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()
