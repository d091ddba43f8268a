"""Shortest-path measures: closeness and betweenness."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash_order
from ..session import Workspace
from .components import giant
from .network import Network, Prepared, kept, prepare
from .ranks import row_numbers

# Sources that share a cell of the search from all nodes: one bit each, and the nodes of such a cell.
WORDS = 32
SEARCH_NODES = 65_536
# Pivots that share a cell of the path counts.
PIVOTS_PER_ROW = 32
# Groups of sources advanced together, times the nodes or edges that each of them holds; bounds the stored state.
STATE_ROWS = 250_000_000


def closeness(network: Network, state_rows: int | None = None) -> DataFrame:
    """(id, closeness) from incoming distances inside the largest component, 0 outside of it.

    With r nodes (itself included) reaching a node at summed distance s among n nodes of the
    component, the value is (r-1)/s * (r-1)/(n-1).

    Breadth-first search from all sources at once, in cells as in :func:`betweenness`: a cell holds a block of the nodes for a
    group of sources, one bit for each source that has reached a node, and the edges into these nodes. A round sends the new bits
    of a node once to every block that it has an edge into, merges them there with a bitwise or, and counts them. Neither a
    (source, node) pair nor a row per edge is ever written; the work is nodes times edges, in words of 64 sources, spread by cell.
    """
    core = giant(network)
    g = prepare(core, "closeness")
    n, m = g.n, g.table.count()
    sources = 64 * WORDS
    groups = -(-n // sources)
    blocks = max(MIN_BLOCKS, -(-m // EDGES_PER_BLOCK), -(-n // SEARCH_NODES))
    batch = max(1, (state_rows or STATE_ROWS) // max(n, m, 1))
    ends = _ends(g, blocks)
    step = partial(_search, n=n, blocks=blocks)
    none = F.lit(None).cast("binary")
    results = []
    for first in range(0, groups, batch):
        last = min(first + batch, groups)
        cells = _Cells(g.workspace, ends, range(first, last), blocks, m)
        rows = g.vertices.filter(F.col("id").between(first * sources, last * sources - 1)).select(
            F.expr(f"cast(id div {sources} as int)").alias("grp"), F.expr(f"cast(id % {blocks} as int)").alias("block"),
            F.lit(_SEED).alias("kind"), F.expr(f"cast(id % {sources} as int)").alias("other"), F.expr(f"id div {blocks}").alias("at"),
            none.alias("ids"), none.alias("vals"),
        )
        depth, sent = 0, 1
        while sent:
            rows, sent = cells.turn(rows, partial(step, depth=depth), f"b{first}-{depth % 2}", _SENT)
            depth += 1
        cells.release()
        sums = rows.filter(F.col("kind") == _DELTA).select("block", "at", "vals").mapInArrow(partial(_reached, blocks=blocks), "id bigint, reach bigint, total bigint")
        results.append(g.workspace.save(sums.groupBy("id").agg(F.sum("reach").alias("reach"), F.sum("total").alias("total")), f"b{first}-sum"))
    if not results:
        return network.vertices.select("id", F.lit(0.0).alias("closeness"))
    sums = reduce(DataFrame.unionByName, results).groupBy("id").agg(F.sum("reach").alias("r"), F.sum("total").alias("s"))
    value = F.try_divide(F.col("r"), F.col("s")) * F.try_divide(F.col("r"), F.lit(n - 1))
    scored = g.named(sums.select("id", value.alias("closeness")))
    return network.vertices.select("id").join(scored, "id", "left").fillna(0.0, ["closeness"])


def pivot_nodes(vertices: DataFrame, k: int, seed: int) -> DataFrame:
    """``k`` nodes in the order of a seeded hash."""
    return vertices.select("id").orderBy(hash_order("id", seed), "id").limit(k)


def betweenness(network: Network, pivots: int = 500, seed: int = 42) -> DataFrame:
    """(id, betweenness): Brandes' dependencies from sampled pivots, normalised.

    Exact when there are at least as many pivots as nodes. All pivots advance together, level by level, in cells: a cell holds
    a block of the nodes for a group of pivots, and the edges into these nodes. Each node sends its path counts once to every
    block that it has an edge into, and on the way back each block sums what it owes a node before it sends it, so that nothing
    moves per edge. Every round is a stored table; the way back reads the levels that the way out wrote. The work is pivots
    times edges, spread by cell.
    """
    g = prepare(network, "betweenness")
    n = g.n
    k = min(pivots, n)
    if n < 3:
        return network.vertices.select("id", F.lit(0.0).alias("betweenness"))
    work = g.workspace
    chosen, seen = work.save_counted(
        row_numbers(pivot_nodes(g.names, k, seed).join(g.names, "id").select(F.col("idx").alias("id")), ["id"], "rn"), "pivots", n=F.count(F.lit(1))
    )
    groups = -(-seen["n"] // PIVOTS_PER_ROW)
    blocks = max(MIN_BLOCKS, -(-g.table.count() // EDGES_PER_BLOCK), -(-n // NODES_PER_BLOCK))
    cells = _Cells(work, _ends(g, blocks), range(groups), blocks, g.table.count())
    none = F.lit(None).cast("binary")
    rows = chosen.select(
        F.expr(f"cast((rn - 1) div {PIVOTS_PER_ROW} as int)").alias("grp"), F.expr(f"cast(id % {blocks} as int)").alias("block"),
        F.lit(_SEED).alias("kind"), F.expr(f"cast((rn - 1) % {PIVOTS_PER_ROW} as int)").alias("other"),
        F.expr(f"id div {blocks}").alias("at"), none.alias("ids"), none.alias("vals"),
    )
    out, back = partial(_way_out, n=n, blocks=blocks), []
    levels = []
    while True:
        table, found = cells.turn(rows, out, f"out-{len(levels)}", _LEVEL)
        if not found:
            break
        levels.append(table.filter(F.col("kind") == _LEVEL))
        rows = table.filter(F.col("kind").isin(_SEEN, _SENT))
    # Walk back: a node passes (1 + delta) / sigma to its predecessors. Level 0 holds only the pivots themselves, whose
    # dependencies do not count.
    for depth in range(len(levels) - 1, 0, -1):
        rows = levels[depth] if not back else levels[depth].unionByName(back[-1].filter(F.col("kind") == _SENT))
        back.append(cells.turn(rows, partial(_way_back, n=n, blocks=blocks, last=depth == 1), f"back-{depth}", _LEVEL)[0])
    cells.release()
    if not back:
        return network.vertices.select("id", F.lit(0.0).alias("betweenness"))
    scale = (1.0 / ((n - 1) * (n - 2))) * (n / k)
    deltas = reduce(DataFrame.unionByName, back).filter(F.col("kind") == _DELTA).select("block", "at", "ids", "vals")
    deltas = deltas.mapInArrow(partial(_deltas, blocks=blocks), "id bigint, delta double")
    sums = deltas.groupBy("id").agg((F.sum("delta") * scale).alias("betweenness"))
    return g.named(g.vertices.select("id").join(sums, "id", "left").fillna(0.0, ["betweenness"]))


# Bounds of a cell: the nodes of a block, which two bytes tell apart, and the edges into them on average. No more different nodes than
# these edges send to a cell in a round, with 256 bytes each at most.
NODES_PER_BLOCK = 65_536
EDGES_PER_BLOCK = 250_000
MIN_BLOCKS = 2
# Edges that share a partition of the cells, about.
EDGES_PER_PART = 4_000_000
# Nodes in a row of a stored round, and edges summed in one step.
_CHUNK = 65_536
_STEP = 100_000
_WIDTHS = {1: "u1", 2: "<u2", 4: "<u4", 8: "<f8"}
# Nodes of a block, and one bit for each pivot.
_PLACE, _MASK = "<u2", "<u4"
# What a row of a cell is.
_SEEN, _SENT, _LEVEL, _SEED, _DELTA = range(5)
_CELL = "grp int, block int, kind int, other int, at bigint, ids binary, vals binary"
_TILE = "a int, b int, members binary, size int, places binary, targets binary"


def _ends(g: Prepared, blocks: int) -> DataFrame:
    """The edges between every two blocks, once for the block that they lead to, and their sources for the block that they come from."""
    tiles = g.workspace.save(
        g.table.select(
            F.expr(f"cast(src % {blocks} as int)").alias("a"), F.expr(f"cast(dst % {blocks} as int)").alias("b"),
            F.expr(f"cast(src div {blocks} as int)").alias("src"), F.expr(f"cast(dst div {blocks} as int)").alias("dst"),
        ).groupBy("a", "b").applyInArrow(_tile, _TILE),
        "tiles",
    )
    none = F.lit(None).cast("binary")
    return tiles.select(
        F.explode(F.array(
            F.struct(F.col("b").alias("block"), F.lit(True).alias("inward"), F.col("a").alias("other"), F.lit(None).cast("binary").alias("members"), "size", "places", "targets"),
            F.struct(F.col("a").alias("block"), F.lit(False).alias("inward"), F.col("b").alias("other"), "members", "size", none.alias("places"), none.alias("targets")),
        )).alias("e")
    )


class _Cells:
    """One cell per block and group, each with the edges of its block, kept in the layout that the rounds meet them in."""

    def __init__(self, work: Workspace, ends: DataFrame, groups: range, blocks: int, edges: int):
        self.work = work
        parts = max(int(work.spark.conf.get("spark.sql.shuffle.partitions")), min(len(groups) * blocks, -(-len(groups) * edges // EDGES_PER_PART)))
        grp = F.explode(F.sequence(F.lit(groups[0]), F.lit(groups[-1]))).alias("grp")
        self.fixed = kept(ends.select(grp, "e.*").repartition(parts, "grp", "block"))

    def turn(self, rows: DataFrame, step, name: str, kind: int) -> tuple[DataFrame, int]:
        """A round over all cells as a stored table, and how many of its rows are of ``kind``."""
        cells = self.fixed.groupBy("grp", "block").cogroup(rows.groupBy("grp", "block"))
        table, seen = self.work.save_counted(cells.applyInArrow(step, _CELL), name, n=F.count_if(F.col("kind") == kind))
        return table, seen["n"]

    def release(self) -> None:
        self.fixed.unpersist()


def _tile(key: tuple, edges: pa.Table) -> pa.Table:
    """The edges between two blocks by target, their sources as places in the list of different sources."""
    src, dst = (edges.column(c).to_numpy() for c in ("src", "dst"))
    members, places = np.unique(src, return_inverse=True)
    order = np.argsort(dst, kind="stable")
    blobs = [x.astype(_PLACE).tobytes() for x in (members, places[order], dst[order])]
    return pa.table({
        "a": pa.array([key[0].as_py()], pa.int32()), "b": pa.array([key[1].as_py()], pa.int32()), "members": pa.array(blobs[:1], pa.binary()),
        "size": pa.array([len(members)], pa.int32()), "places": pa.array(blobs[1:2], pa.binary()), "targets": pa.array(blobs[2:], pa.binary()),
    })


def _rows(table: pa.Table) -> Iterator[dict]:
    """Rows whose binary values are the memory of ``table`` itself."""
    for batch in table.to_batches():
        yield from (dict(zip(batch.schema.names, row)) for row in zip(*(_cells_of(c) for c in batch.columns)))


def _cells_of(column: pa.Array) -> list:
    if not pa.types.is_binary(column.type):
        return column.to_pylist()
    _, places, blob = column.buffers()
    at = np.frombuffer(places, "<i4")[column.offset : column.offset + len(column) + 1].tolist()
    return [blob.slice(first, last - first) if there else None for first, last, there in zip(at, at[1:], column.is_valid().to_pylist())]


def _whole(blob: pa.Buffer) -> np.ndarray:
    return np.frombuffer(blob, _PLACE)


def _ids(row: dict) -> np.ndarray:
    return np.frombuffer(row["ids"], "<i4")


def _values(row: dict) -> np.ndarray:
    return np.frombuffer(row["vals"], _WIDTHS[row["at"]]).astype(float)


def _counts(row: dict) -> np.ndarray:
    return _values(row).reshape(-1, PIVOTS_PER_ROW)


def _pieces(kind: int, block: int, other: int, ids: np.ndarray, vals: np.ndarray) -> list[tuple]:
    """(block, kind, other, at, ids, vals): rows of bounded size; whole numbers take as many bytes as they need, told by ``at``."""
    rows = []
    for i in range(0, len(ids), _CHUNK):
        some, width = vals[i : i + _CHUNK], 8
        top = some.max(initial=0.0)
        if top < 1 << 32 and (some == np.floor(some)).all():
            width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
        rows.append((block, kind, other, width, ids[i : i + _CHUNK].astype("<i4").tobytes(), some.astype(_WIDTHS[width]).tobytes()))
    return rows


def _cell(grp: int, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * 6
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    arrays = [pa.array(c, t) for c, t in zip(columns, types)]
    return pa.Table.from_arrays([pa.array([grp] * len(rows), pa.int32()), *arrays], ["grp", "block", "kind", "other", "at", "ids", "vals"])


def _starts(at: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    return np.flatnonzero(new)


def _add(into: np.ndarray, rows: np.ndarray, values: np.ndarray, places: np.ndarray) -> None:
    """``into[rows] += values[places]``; ``rows`` are sorted."""
    for i in range(0, len(rows), _STEP):
        at = rows[i : i + _STEP]
        starts = _starts(at)
        into[at[starts]] += np.add.reduceat(values[places[i : i + _STEP]], starts, axis=0)


def _search(key: tuple, fixed: pa.Table, moving: pa.Table, n: int, blocks: int, depth: int) -> pa.Table:
    """One round of one cell of the search: the bits that are new at its nodes, their counts, and what the nodes send on."""
    grp, block = (k.as_py() for k in key)
    own = max(0, -(-(n - block) // blocks))
    seen, new, sums = np.zeros((own, WORDS), "<u8"), np.zeros((own, WORDS), "<u8"), np.zeros((own, 2), "<i8")
    sent: dict[int, list] = {}
    for row in _rows(moving):
        if row["kind"] == _SEEN:
            some = _bits(row)
            seen[row["at"] : row["at"] + len(some)] = some
        elif row["kind"] == _DELTA:
            some = np.frombuffer(row["vals"], "<i8").reshape(-1, 2)
            sums[row["at"] : row["at"] + len(some)] = some
        elif row["kind"] == _SEED:
            new[row["at"], row["other"] // 64] |= np.uint64(1 << row["other"] % 64)
        else:
            sent.setdefault(row["other"], []).append(row)
    ends = list(_rows(fixed))
    for tile in ends:
        if tile["inward"] and tile["other"] in sent:
            values, there = np.zeros((tile["size"], WORDS), "<u8"), np.zeros(tile["size"], bool)
            for row in sent.pop(tile["other"]):
                places = _ids(row)
                values[places], there[places] = _bits(row), True
            places, targets = _whole(tile["places"]), _whole(tile["targets"])
            some = there[places]
            _merge(new, targets[some], values, places[some])
    new &= ~seen
    seen |= new
    arrived = np.bitwise_count(new).sum(1, dtype="<i8")
    if depth:
        sums += arrived[:, None] * np.array([1, depth])
    rows = []
    for i in range(0, own, _CHUNK):
        rows.append((block, _SEEN, 0, i, None, seen[i : i + _CHUNK].tobytes()))
        rows.append((block, _DELTA, 0, i, None, sums[i : i + _CHUNK].tobytes()))
    for tile in ends:
        if not tile["inward"]:
            members = _whole(tile["members"])
            places = np.flatnonzero(arrived[members])
            for i in range(0, len(places), _CHUNK):
                some = places[i : i + _CHUNK]
                rows.append((tile["other"], _SENT, block, None, some.astype("<i4").tobytes(), new[members[some]].tobytes()))
    return _cell(grp, rows)


def _bits(row: dict) -> np.ndarray:
    return np.frombuffer(row["vals"], "<u8").reshape(-1, WORDS)


def _merge(into: np.ndarray, rows: np.ndarray, values: np.ndarray, places: np.ndarray) -> None:
    """``into[rows] |= values[places]``; ``rows`` are sorted."""
    step = max(1, _STEP // WORDS)
    for i in range(0, len(rows), step):
        at = rows[i : i + step]
        starts = _starts(at)
        into[at[starts]] |= np.bitwise_or.reduceat(values[places[i : i + step]], starts, axis=0)


def _reached(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            sums = np.frombuffer(row["vals"], "<i8").reshape(-1, 2)
            ids = (row["at"] + np.arange(len(sums), dtype=np.int64)) * blocks + row["block"]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["id", "reach", "total"])


def _way_out(key: tuple, fixed: pa.Table, moving: pa.Table, n: int, blocks: int) -> pa.Table:
    """One level for one cell: path counts of its nodes that are met for the first time, and what they send on."""
    grp, block = (k.as_py() for k in key)
    own = -(-(n - block) // blocks)
    bit = np.arange(PIVOTS_PER_ROW)
    seen, counts, sent = np.zeros(own, _MASK), np.zeros((own, PIVOTS_PER_ROW)), {}
    for row in _rows(moving):
        if row["kind"] == _SEEN:
            seen = np.frombuffer(row["ids"], _MASK).copy()
        elif row["kind"] == _SEED:
            counts[row["at"], row["other"]] = 1.0
        else:
            sent.setdefault(row["other"], []).append(row)
    ends = list(_rows(fixed))
    for tile in ends:
        if tile["inward"] and tile["other"] in sent:
            values, there = _received(tile["size"], sent.pop(tile["other"]))
            places, targets = _whole(tile["places"]), _whole(tile["targets"])
            some = there[places]
            _add(counts, targets[some], values, places[some])
    counts[(seen[:, None] >> bit) & 1 == 1] = 0.0
    fresh = ((counts > 0).astype("<i8") << bit).sum(1).astype(_MASK)
    seen |= fresh
    rows = [(block, _SEEN, 0, None, seen.tobytes(), None)] if seen.any() else []
    met = np.flatnonzero(fresh)
    rows += _pieces(_LEVEL, block, 0, met, counts[met])
    for tile in ends:
        if not tile["inward"]:
            members = _whole(tile["members"])
            places = np.flatnonzero(fresh[members])
            rows += _pieces(_SENT, tile["other"], block, places, counts[members[places]])
    return _cell(grp, rows)


def _received(size: int, rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Values by place, and which places have any."""
    values, there = np.zeros((size, PIVOTS_PER_ROW)), np.zeros(size, bool)
    for row in rows:
        places = _ids(row)
        values[places], there[places] = _counts(row), True
    return values, there


def _way_back(key: tuple, fixed: pa.Table, moving: pa.Table, n: int, blocks: int, last: bool) -> pa.Table:
    """Dependencies of the nodes of one level in one cell, and the shares of those before them."""
    grp, block = (k.as_py() for k in key)
    own = -(-(n - block) // blocks)
    paths, credit = np.zeros((own, PIVOTS_PER_ROW)), np.zeros((own, PIVOTS_PER_ROW))
    ends = list(_rows(fixed))
    members = {tile["other"]: _whole(tile["members"]) for tile in ends if not tile["inward"]}
    for row in _rows(moving):
        ids = _ids(row)
        if row["kind"] == _LEVEL:
            paths[ids] = _counts(row)
        else:
            credit[members[row["other"]][ids]] += _counts(row)
    delta = paths * credit
    sums = delta.sum(1)
    met = np.flatnonzero(sums)
    rows = _pieces(_DELTA, block, 0, met, sums[met])
    if not last:
        share = np.divide(delta + 1, paths, out=np.zeros_like(paths), where=paths > 0)
        there = (paths > 0).any(1)
        for tile in ends:
            if tile["inward"]:
                places, targets = _whole(tile["places"]), _whole(tile["targets"])
                some = there[targets]
                places, targets = places[some], targets[some]
                order = np.argsort(places, kind="stable")
                owed = np.zeros((tile["size"], PIVOTS_PER_ROW))
                _add(owed, places[order], share, targets[order])
                due = np.unique(places)
                rows += _pieces(_SENT, tile["other"], block, due, owed[due])
    return _cell(grp, rows)


def _deltas(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = _ids(row).astype(np.int64) * blocks + row["block"]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(_values(row))], ["id", "delta"])
