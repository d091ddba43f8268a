"""Exact top-k search by inner product with a three-phase uniform threshold.

Vectors are cut into ``SLICES`` groups of components. A slice sees only its own components, so it knows a partial score of each
pair of query and candidate; a score is the sum of its slices'. Queries and candidates come in blocks of bounded size.

1. Each slice lists the best partial scores of a block. The other slices are asked for the listed candidates, which gives lists of safe
   scores with their ids; the ``k``-th best of different ids over all blocks is a first cutoff.
2. The cutoff goes back to all slices, shared out uniformly: a candidate that stays below its share in every slice cannot
   reach the cutoff. The slices send all entries that do reach theirs. Summed up, these give better safe scores, a second cutoff,
   and the most that each candidate can still have.
3. Candidates that can still reach the second cutoff are resolved exactly.

Copies of one vector are one candidate with their ``k + 1`` smallest ids (no more of them can be among the best), and queries with one vector
are searched once; a search keeps one more than ``k``, from which each query drops itself.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id, take no part. Shorter vectors count as
filled with zeros. Rows repeated with one id count once; an id with several vectors has the best score of any of them, as query and as candidate, and
takes one place in every list; a query never finds its own id. Ties go to the smaller id. Scores are 64-bit
integers. Extra columns are ignored; without queries or candidates the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import kept, partitions

SLICES = 2
CANDIDATES_PER_BLOCK, QUERIES_PER_BLOCK = 8192, 512
# Lists merged in one task.
FAN_IN = 128
NOTHING = -(2**62)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 64) -> DataFrame:
    """(id, vec): floor(factor * component) of all usable vectors."""
    x = F.col(vector_col)
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & x.isNotNull()).filter(usable)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * factor)).alias("vec")).distinct()


def _packed(rows: DataFrame, per_block: int, count: int, dim: int, stored: type) -> DataFrame:
    """(block, slice, ids, part): blocks of about ``per_block`` rows, one row per slice of their components, as ``stored`` numbers."""
    blocks = max(1, ceil(count / per_block))
    edges = np.linspace(0, dim, SLICES + 1).astype(int)

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        whole = np.zeros((len(frame), dim), dtype=stored)
        for i, v in enumerate(frame["vec"]):
            whole[i, : len(v)] = v
        ids = frame["id"].to_numpy().tobytes()
        return pd.DataFrame({"block": key[0], "slice": range(SLICES), "ids": ids, "part": [np.ascontiguousarray(whole[:, a:b]).tobytes() for a, b in zip(edges, edges[1:])]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)).cast("int"))
    return kept(dealt.groupBy("block").applyInPandas(pack, "block int, slice int, ids binary, part binary"), "vector-blocks")


def _products(row: dict, kind: type, stored: type) -> np.ndarray:
    """Partial scores of all queries (rows) and candidates (columns) of a node."""
    n, m = len(row["q_ids"]) // 8, len(row["c_ids"]) // 8
    q = np.frombuffer(row["q_part"], stored).reshape(n, -1).astype(kind)
    c = np.frombuffer(row["c_part"], stored).reshape(m, -1).astype(kind)
    return (q @ c.T).astype(np.int64)


def _array(raw: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(*shape)


def _tops(query: np.ndarray, value: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's ``k`` best values of different ids; of one id the highest, ties to the smaller id. In order of query and value."""
    order = np.lexsort((-value, ids, query))
    same = (query[order][1:] == query[order][:-1]) & (ids[order][1:] == ids[order][:-1])
    order = order[np.concatenate([[True], ~same])] if len(order) else order
    order = order[np.lexsort((ids[order], -value[order], query[order]))]
    rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    return order[rank < k]


def _best_of(query: np.ndarray, value: np.ndarray, ids: np.ndarray, n: int, k: int) -> np.ndarray:
    """(n, 2, k): the values and ids of :func:`_tops` for each of ``n`` queries, filled up with NOTHING."""
    top = _tops(query, value, ids, k)
    own = query[top]
    rank = np.arange(len(top)) - np.searchsorted(own, own)
    out = np.full((n, 2, k), NOTHING, dtype=np.int64)
    out[own, 0, rank], out[own, 1, rank] = value[top], ids[top]
    return out


_NODE = [("q_block", pa.int32()), ("c_block", pa.int32()), ("slice", pa.int32()), ("q_ids", pa.binary()), ("q_part", pa.binary()), ("c_ids", pa.binary()), ("c_part", pa.binary())]
_NODE_COLUMNS = "q_block int, c_block int, slice int, q_ids binary, q_part binary, c_ids binary, c_part binary"


def _rows(batches: Iterator[pa.RecordBatch], work, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield pa.RecordBatch.from_pylist([work({name: batch.column(name)[i].as_py() for name in batch.schema.names})], schema)


def _local_lists(k: int, kind: type, stored: type):
    """Phase 1 at one slice: places of each query's best partial scores, and its smallest one."""
    schema = pa.schema([*_NODE, ("place", pa.binary()), ("least", pa.binary())])

    def work(row: dict) -> dict:
        p = _products(row, kind, stored)
        place = np.argpartition(-p, k - 1, axis=1)[:, :k] if p.shape[1] > k else np.tile(np.arange(p.shape[1]), (len(p), 1))
        return row | {"place": place.astype(np.int64).tobytes(), "least": p.min(axis=1).tobytes()}

    return lambda batches: _rows(batches, work, schema)


def _scores(frame: pd.DataFrame, query: np.ndarray, place: np.ndarray, stored: type) -> np.ndarray:
    """Scores of some pairs of one block, summed over its slices."""
    first = frame.iloc[0]
    n, m = len(first["q_ids"]) // 8, len(first["c_ids"]) // 8
    score = np.zeros(len(query), dtype=np.int64)
    for q, c in zip(frame["q_part"], frame["c_part"]):
        q, c = np.frombuffer(q, stored).reshape(n, -1), np.frombuffer(c, stored).reshape(m, -1)
        for i in range(0, len(query), 100_000):
            own = slice(i, i + 100_000)
            score[own] += np.einsum("ij,ij->i", q[query[own]].astype(np.int64), c[place[own]].astype(np.int64))
    return score


def _first_safe(k: int, stored: type):
    """Phase 1 at one block: the scores of the listed candidates, the best of each query, and the smallest partial score per slice."""

    def combine(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("slice")
        n, m = len(frame["q_ids"].iloc[0]) // 8, len(frame["c_ids"].iloc[0]) // 8
        least = np.stack([_array(raw, n) for raw in frame["least"]], axis=1)
        listed = np.concatenate([_array(raw, n, -1) for raw in frame["place"]], axis=1)
        query, place = np.divmod(np.unique(np.arange(n)[:, None] * m + listed), m)
        ids = _array(frame["c_ids"].iloc[0], m)
        safe = _best_of(query, _scores(frame, query, place, stored), ids[place], n, k)
        return pd.DataFrame({"q_block": [key[0]], "c_block": [key[1]], "safe": [safe.tobytes()], "least": [least.tobytes()]})

    return combine


def _cutoffs(lists: DataFrame, blocks: int, k: int, name: str) -> DataFrame:
    """(q_block, cut): the ``k`` best safe scores of different ids of each query over all blocks, merged ``FAN_IN`` lists at a time."""

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        both = np.concatenate([_array(raw, len(raw) // 16 // k, 2, k) for raw in frame["safe"]], axis=2)
        query, at = np.nonzero(both[:, 0] > NOTHING)
        best = _best_of(query, both[query, 0, at], both[query, 1, at], len(both), k)
        return pd.DataFrame({"q_block": [key[0]], "c_block": [key[1]], "safe": [best.tobytes()]})

    lists = lists.select("q_block", "c_block", "safe")
    while blocks > 1:
        blocks = ceil(blocks / FAN_IN)
        lists = lists.withColumn("c_block", F.floor(F.col("c_block") / FAN_IN).cast("int")).groupBy("q_block", "c_block").applyInPandas(merge, "q_block int, c_block int, safe binary")
    return kept(lists.select("q_block", F.col("safe").alias("cut")), name)


def _shares(least: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """What each slice must reach for its candidates to be sent: together not more than the cutoff."""
    room = (np.maximum(cut, NOTHING // 2) - least.sum(axis=1)) // SLICES
    return least + room[:, None]


def _sufficient(k: int, kind: type, small: type, stored: type):
    """Phase 2 at one slice: all entries that reach its share of the cutoff."""
    schema = pa.schema([*_NODE[:3], ("n", pa.int32()), ("c_ids", pa.binary()), ("pair", pa.binary()), ("partial", pa.binary())])

    def work(row: dict) -> dict:
        p = _products(row, kind, stored)
        share = _shares(_array(row["least"], len(p), SLICES), _array(row["cut"], len(p), 2, k)[:, 0, -1])[:, row["slice"]]
        pair = np.flatnonzero(p >= share[:, None])
        return {c: row[c] for c in ("q_block", "c_block", "slice", "c_ids")} | {
            "n": len(p), "pair": pair.astype(np.int32).tobytes(), "partial": p.ravel()[pair].astype(small).tobytes()
        }

    return lambda batches: _rows(batches, work, schema)


def _second_safe(k: int, small: type):
    """Phase 2 at one block: better safe scores, and for each candidate sent the most that it can have."""

    def combine(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        n, ids = int(frame["n"].iloc[0]), np.frombuffer(frame["c_ids"].iloc[0], np.int64)
        m = len(ids)
        least = _array(frame["least"].iloc[0], n, SLICES)
        share = _shares(least, _array(frame["cut"].iloc[0], n, 2, k)[:, 0, -1])
        pair, back = np.unique(np.concatenate([np.frombuffer(raw, np.int32) for raw in frame["pair"]]), return_inverse=True)
        query = pair // m
        low, high = least.sum(axis=1)[query], (share - 1).sum(axis=1)[query]
        at = 0
        for s, raw in zip(frame["slice"], frame["partial"]):
            partial = np.frombuffer(raw, small).astype(np.int64)
            own = back[at : at + len(partial)]
            low[own] += partial - least[query[own], s]
            high[own] += partial - (share[query[own], s] - 1)
            at += len(partial)
        return pd.DataFrame({"q_block": [key[0]], "c_block": [key[1]], "safe": [_best_of(query, low, ids[pair % m], n, k).tobytes()], "pair": [pair.tobytes()], "most": [high.tobytes()]})

    return combine


def _resolved(k: int, stored: type):
    """Phase 3 at one block: exact scores of what can still reach the cutoff; the best of each query."""

    def combine(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("slice")
        first = frame.iloc[0]
        q_ids, c_ids = np.frombuffer(first["q_ids"], np.int64), np.frombuffer(first["c_ids"], np.int64)
        cut = _array(first["cut"], len(q_ids), 2, k)[:, 0, -1]
        pair = np.frombuffer(first["pair"], np.int32)
        query, place = np.divmod(pair, len(c_ids))
        still = _array(first["most"], -1) >= cut[query]
        query, place = query[still], place[still]
        score = _scores(frame, query, place, stored)
        top = _tops(query, score, c_ids[place], k)
        return pd.DataFrame({"q": q_ids[query[top]], "id": c_ids[place[top]], "score": score[top]})

    return combine


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 64) -> DataFrame:
    """(query_id, rank, id, score) of the ``k`` best candidates of each query; ``is_query`` is a condition on ``id``."""
    spark = vectors.sparkSession
    rows = kept(quantised(vectors, id_col, vector_col, factor), "quantised")
    dim, largest = rows.agg(F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", F.abs)))).first()
    dim, largest = dim or 0, largest or 0
    reach = max(1, dim) * largest * largest
    kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else np.int64
    stored = next(t for t in (np.int8, np.int16, np.int32, np.int64) if t is np.int64 or largest <= np.iinfo(t).max)
    best = k + 1
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    candidates = kept(rows.withColumn("_place", place).filter(F.col("_place") <= best).select("id", "vec"), "candidates")
    asked = kept(rows.filter(is_query), "queries")
    # Numbered once, in the stored table: one search per vector, also where an id asks with several.
    searches = kept(asked.select("vec").distinct().select(F.monotonically_increasing_id().alias("id"), "vec"), "searches")
    n_c, n_q = candidates.count(), searches.count()
    c_blocks, q_blocks = max(1, ceil(n_c / CANDIDATES_PER_BLOCK)), max(1, ceil(n_q / QUERIES_PER_BLOCK))
    c = _packed(candidates, CANDIDATES_PER_BLOCK, n_c, dim, stored).select(F.col("block").alias("c_block"), "slice", F.col("ids").alias("c_ids"), F.col("part").alias("c_part"))
    q = _packed(searches, QUERIES_PER_BLOCK, n_q, dim, stored).select(F.col("block").alias("q_block"), "slice", F.col("ids").alias("q_ids"), F.col("part").alias("q_part"))
    # The stated queries against all candidates, block by block.
    asked_blocks = c.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    nodes = asked_blocks.join(q, ["q_block", "slice"]).repartition(partitions(spark), "q_block", "c_block", "slice")
    pair = ["q_block", "c_block"]
    nodes = nodes.select(*[name for name, _ in _NODE])
    lists = nodes.mapInArrow(_local_lists(best, kind, stored), f"{_NODE_COLUMNS}, place binary, least binary")
    first = kept(lists.groupBy(*pair).applyInPandas(_first_safe(best, stored), "q_block int, c_block int, safe binary, least binary"), "first-lists")
    first_cut = _cutoffs(first, c_blocks, best, "first-cutoffs")
    bounds = kept(first.select(*pair, "least").join(first_cut, "q_block"), "bounds")
    small = np.int32 if reach < 2**31 else np.int64
    sent = nodes.join(bounds, pair).select(*nodes.columns, "least", "cut").mapInArrow(_sufficient(best, kind, small, stored), "q_block int, c_block int, slice int, n int, c_ids binary, pair binary, partial binary")
    second = sent.join(bounds, pair).groupBy(*pair).applyInPandas(_second_safe(best, small), "q_block int, c_block int, safe binary, pair binary, most binary")
    second = kept(second, "sufficient")
    second_cut = _cutoffs(second, c_blocks, best, "second-cutoffs")
    open_pairs = nodes.join(second.select(*pair, "pair", "most").join(second_cut, "q_block"), pair)
    exact = kept(open_pairs.groupBy(*pair).applyInPandas(_resolved(best, stored), "q long, id long, score long"), "exact")
    order = [F.desc("score"), F.col("id")]
    winners = exact.groupBy("q", "id").agg(F.max("score").alias("score")).withColumn("_place", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("_place") <= best)
    named = asked.select(F.col("id").alias("query_id"), "vec").join(searches.select(F.col("id").alias("q"), "vec"), "vec").select("query_id", "q").distinct()
    found = named.join(winners, "q").filter(F.col("query_id") != F.col("id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    # A query id with several vectors has the best of their scores.
    found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
