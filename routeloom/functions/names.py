"""Best fuzzy match of names against a directory, block by block."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _letter_counts(names: list[str], letters: list[str]) -> np.ndarray:
    place = {ch: i for i, ch in enumerate(letters)}
    table = np.zeros((len(names), len(letters)), dtype=np.int32)
    for row, name in enumerate(names):
        for ch, n in Counter(name).items():
            table[row, place[ch]] = n
    return table


def best_matches(names: list[str], directory: list[str], cutoff: float) -> list[tuple[float, str] | None]:
    """For each name the best directory entry by similarity ratio, then by largest text.

    The shared letters of two names bound the ratio from above, so only pairs whose bound reaches
    the cutoff are compared in full.
    """
    letters = sorted(set("".join(names)) | set("".join(directory)))
    a, b = _letter_counts(names, letters), _letter_counts(directory, letters)
    size_a, size_b = a.sum(1), b.sum(1)
    found: list[tuple[float, str] | None] = []
    for i, name in enumerate(names):
        total = size_b + size_a[i]
        bound = np.where(total > 0, 2.0 * np.minimum(b, a[i]).sum(1) / np.maximum(total, 1), 1.0)
        matcher = SequenceMatcher()
        matcher.set_seq2(name)
        best = None
        for j in np.flatnonzero(bound >= cutoff - 1e-12):
            if best is not None and bound[j] < best[0] - 1e-12:
                continue
            matcher.set_seq1(directory[j])
            score = matcher.ratio()
            if score >= cutoff and (best is None or (score, directory[j]) > best):
                best = (score, directory[j])
        found.append(best)
    return found


def match_blocks(cutoff: float):
    """Pandas UDF: (names, directory names) blocks to an array of (name, score, match)."""

    @F.pandas_udf("array<struct<name:string,score:double,match:string>>")
    def run(names: pd.Series, directory: pd.Series) -> pd.Series:
        out = []
        for left, right in zip(names, directory):
            left, right = list(left), list(right)
            hits = best_matches(left, right, cutoff)
            out.append([
                {"name": n, "score": h[0], "match": h[1]} for n, h in zip(left, hits) if h is not None
            ])
        return pd.Series(out)

    return run
