"""Bounded samples of labelled texts for the classifiers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def training_rows(
    docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str, text_col: str, label_col: str, most: dict[int, int], max_chars: int
) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``most[label]`` documents of each label, the first in order of a hash of their id.

    ``learn_from`` says which ids may teach. Texts that are null, empty or longer than ``max_chars`` teach nothing. An id
    with several labels or texts counts once, with the largest label and the smallest text.
    """
    known = labels.filter(learn_from & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    order = [F.xxhash64("_id"), F.col("_id")]
    parts = [known.filter(F.col("_label") == label).orderBy(*order).limit(n) for label, n in most.items()]
    picked = reduce(DataFrame.unionByName, parts)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.char_length("_text").between(1, max_chars))
    found = texts.join(F.broadcast(picked), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text")).toArrow().sort_by("_id")
    return found.column("_text").to_pylist(), found.column("_label").to_numpy().astype(np.int64)


def give_back(spark: SparkSession) -> None:
    """Returns the memory that finished work has freed on the driver to the system; later stages share the driver.

    Plans and broadcasts that nothing refers to any more keep their blocks until the driver's JVM collects garbage, so it is asked to.
    """
    gc.collect()
    spark._jvm.java.lang.System.gc()
    trim()


def trim() -> None:
    """Returns what this process's allocator holds of freed arrays to the system."""
    trimmed = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trimmed is not None:
        trimmed(0)


def trimmed(scan: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``scan`` over Arrow batches; when a task is through, its worker, which waits for others, keeps no freed arrays."""

    def run(batches: Iterator) -> Iterator:
        yield from scan(batches)
        trim()

    return run
