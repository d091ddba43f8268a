"""Prefix trie of conversations: which beginnings are shared, by how many, and what sharing them saves.

A node is a distinct sequence of first turns; its members are the conversations that begin with it.

1. *Turns* become 128-bit codes and are numbered per conversation by one range sort with offsets, so a conversation of any length
   spreads over the partitions it needs. Conversations are cut into blocks of ``WIDTH`` turns; a block knows the code of all
   turns before it. Blocks of one beginning and one depth are rows of a matrix of turn ids, padded with zeros.
2. *Shards.* Blocks are range-partitioned in the order of their beginning and their turns, ties by conversation, so copies spread as well. A
   shard is sorted with numpy's lexsort; where a row differs from the one above, OR-accumulated along the columns, is where nodes
   start, and reduceat over those starts gives members, children, leaves and savings of every depth.
3. *Boundaries.* A node on the path of a shard's first or last row may go on in the next shard, and one that leads to a deeper block
   goes on there. Such open nodes leave the shard as parts, which are combined by their codes; what lies below them is summed up by
   pointer jumping over the open nodes alone. All other nodes are final in their shard.

Defined results: a null role or text is an empty one. Rows without an id belong to no conversation. Turns are in order of ``turn``
(null first), ties in order of a SHA-256 of role and text; repeated rows are repeated turns. Extra columns are ignored, clashing names included. A
conversation without turns ends at the root. An empty table gives an empty table. Turns are told apart by 128 bits of their hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Kept, partitions

# Turns in a row of the matrix; longer conversations have several rows.
WIDTH = 32
SHARD_ROWS = 200_000
EMPTY_HASH = hashlib.sha256(b"").hexdigest()
KEY = ["k1", "k2"]
NODE = "k1 long, k2 long, p1 long, p2 long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, words long, ends string, first_end long, open boolean"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int")


def turn_codes(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, code, words) of every row that has an id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    code = F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    named = conversations.filter(F.col(id_col).isNotNull())
    return named.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), code.alias("code"), n_words(text).alias("words"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place of each row among those of its conversation in this range of the sort order."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column("conv_id").to_numpy()
        if not len(conv):
            continue
        new = np.ones(len(conv), dtype=bool)
        new[1:] = conv[1:] != conv[:-1]
        at = np.arange(len(conv))
        place = at - at[new][np.cumsum(new) - 1]
        if conv[0] == last:
            place[conv == last] += seen
        last, seen = conv[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("code"), batch.column("words"), pa.array(place, pa.int64()), pa.array(np.full(len(conv), part), pa.int32())],
            names=["conv_id", "code", "words", "place", "part"],
        )


def numbered_turns(codes: DataFrame, kept: Kept) -> DataFrame:
    """(conv_id, pos, code, words): turns of each conversation from 0 on. ``codes`` should be a stored table."""
    order = ["conv_id", "turn", "code"]
    ranged = codes.repartitionByRange(partitions(codes.sparkSession), *order).sortWithinPartitions(*order)
    rows = kept(ranged.mapInArrow(_numbered, "conv_id long, code binary, words int, place long, part int"), "numbered-turns")
    counts = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A range goes on with one conversation of the range before it at most: no more rows than ranges.
    carried = counts.select("conv_id", "part", F.sum("n").over(before).alias("before")).filter("before > 0")
    placed = rows.join(F.broadcast(carried), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "code", "words")


def rebuilt(turns: DataFrame, kept: Kept, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after each conversation's first turns gave way to those of another.

    Conversation c begins with the first h turns of c - c % every (all if fewer, none if absent) and goes on with its own behind its first h;
    h is the crc32 of its id modulo ``most``. ``conversations``: (conv_id, total).
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    turns = kept(turns, "placed-turns")
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", h)
    heads = turns.filter((F.col("conv_id") % every == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv_id", "giver")
    asked = convs.select("conv_id", "h", (F.col("conv_id") - F.col("conv_id") % every).alias("giver")).filter("h > 0")
    given = kept(asked.join(heads, "giver").filter("pos < h").select("conv_id", "pos", "code", "words"), "given-turns")
    n_given = given.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_given"))
    convs = convs.join(n_given, "conv_id", "left").withColumn("n_given", F.coalesce("n_given", F.lit(0)))
    convs = kept(convs.select("conv_id", (F.col("n_given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"), (F.col("n_given") - F.col("h")).alias("shift")), "rebuilt-conversations")
    own = turns.filter(F.col("pos") >= h).join(convs.filter("shift <> 0").select("conv_id", "shift"), "conv_id", "left")
    own = own.select("conv_id", (F.col("pos") + F.coalesce("shift", F.lit(0))).alias("pos"), "code", "words")
    return given.unionByName(own), convs.select("conv_id", "total")


def blocks(turns: DataFrame, convs: DataFrame, kept: Kept, width: int = WIDTH) -> DataFrame:
    """(conv_id, block, k1, k2, ends, ids, words): ``width`` turns a row; (k1, k2) is the code of all turns before it."""
    code = lambda salt: F.xxhash64(F.lit(salt), "code", "pos")
    coded = turns.select("conv_id", "pos", F.floor(F.col("pos") / width).cast("int").alias("block"), code(1).alias("t1"), code(2).alias("t2"), "words")
    grouped = coded.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("pos", "t1", "t2", "words"))).alias("turns"), F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2")
    )
    grouped = kept(
        grouped.select("conv_id", "block", "x1", "x2", F.flatten(F.transform("turns", lambda t: F.array(t["t1"], t["t2"]))).alias("ids"), F.transform("turns", lambda t: t["words"]).alias("words")),
        "blocks",
    )
    own = Window.partitionBy("conv_id").orderBy("block")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    long = grouped.select("conv_id", "block", "x1", "x2").join(convs.filter(F.col("total") > width).select("conv_id"), "conv_id", "left_semi")
    keys = long.select("conv_id", "block", *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(k) for x, k in (("x1", "k1"), ("x2", "k2"))], F.lead("block").over(own).isNull().alias("ends"))
    zero = F.lit(0).cast("long")
    full = grouped.join(keys, ["conv_id", "block"], "left").select(
        "conv_id", "block", F.coalesce("k1", zero).alias("k1"), F.coalesce("k2", zero).alias("k2"), F.coalesce("ends", F.lit(True)).alias("ends"), "ids", "words"
    )
    none = convs.filter("total = 0").select(
        "conv_id", F.lit(0).alias("block"), zero.alias("k1"), zero.alias("k2"), F.lit(True).alias("ends"),
        F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<int>").alias("words"),
    )
    return full.unionByName(none)


def _ids(text_of: np.ndarray) -> bytes:
    return ",".join(map(str, text_of.tolist())).encode()


class Shard:
    """One range of blocks as a sorted matrix of turn ids; column 0 is the beginning, zeros are padding."""

    def __init__(self, table: pa.Table, width: int):
        column = lambda name: table.column(name).to_numpy()
        ids, words = table.column("ids").combine_chunks(), table.column("words").combine_chunks()
        conv, block, k1, k2, ends = column("conv_id"), column("block"), column("k1"), column("k2"), column("ends")
        size = np.diff(ids.offsets.to_numpy()) // 2
        flat = ids.flatten().to_numpy().reshape(-1, 2)
        row = np.repeat(np.arange(len(conv)), size)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        self.width = width
        self.deepest = int(size.max(initial=0))
        shape = (len(conv), self.deepest + 1)
        matrix = np.zeros(shape, np.int32)
        matrix[:, 0] = _ranks(block, k1, k2)
        matrix[row, col + 1] = _ranks(flat[:, 0], flat[:, 1])
        self.words = np.zeros(shape, np.int32)
        self.words[row, col + 1] = words.flatten().to_numpy()
        codes = np.zeros((2, *shape), np.int64)
        for part, first, turn in zip(codes, (k1, k2), flat.T):
            part[:, 0] = first
            part[row, col + 1] = turn
        order = np.lexsort((conv, *matrix.T[::-1]))
        matrix, self.words = matrix[order], self.words[order]
        self.conv, self.block, self.ends, self.size = conv[order], block[order].astype(np.int64), ends[order].astype(bool), size[order]
        self.codes = np.bitwise_xor.accumulate(codes[:, order], axis=2)
        changed = np.ones(shape, dtype=bool)
        changed[1:] = matrix[1:] != matrix[:-1]
        self.starts = np.logical_or.accumulate(changed, axis=1)

    def nodes(self) -> Iterator[dict]:
        """Columns of all nodes, depth by depth from the deepest; see NODE."""
        below = None
        for depth in range(self.deepest, -1, -1):
            rows = np.flatnonzero(self.size >= depth)
            first = np.flatnonzero(self.starts[rows, depth])
            head = rows[first]
            n = np.diff(np.append(first, len(rows)))
            conv = np.minimum.reduceat(self.conv[rows], first)
            goes_on = (self.size[rows] == self.width) & ~self.ends[rows] & (depth == self.width)
            is_open = np.logical_or.reduceat(goes_on, first)
            # The paths of the first and the last row may go on in other shards.
            is_open |= (head == 0) | (np.append(head[1:], len(self.conv)) == len(self.conv)) if depth else True
            children, leaves, saved = (np.zeros(len(first), np.int64) for _ in range(3))
            if below is not None:
                parent = np.searchsorted(head, below["head"], side="right") - 1
                edge = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
                at = parent[edge]
                closed = ~below["open"]
                children[at] = np.add.reduceat(closed.astype(np.int64), edge)
                leaves[at] = np.add.reduceat(np.where(closed, below["n_leaves"], 0), edge)
                saved[at] = np.add.reduceat(np.where(closed, below["saved"], 0), edge)
                is_open[at] |= np.logical_or.reduceat(below["open"], edge)
                known = np.where(is_open, -1, conv)[parent]
                yield from self._columns(below, known, is_open[parent])
            words = self.words[head, depth].astype(np.int64)
            leaves = np.where(~is_open & (children == 0), 1, leaves)
            saved = np.where(is_open, saved, saved + (n - 1) * words)
            below = {"head": head, "depth": depth, "open": is_open, "n": n, "conv": conv, "children": children, "n_leaves": leaves, "saved": saved, "words": words}
            ending = np.flatnonzero((self.size[rows] == depth) & self.ends[rows])
            node = np.searchsorted(first, ending, side="right") - 1
            cut = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.empty(0, np.int64)
            below["ends"] = {int(node[i]): self.conv[rows[own]] for i, own in zip(cut, np.split(ending, cut[1:]))} if len(cut) else {}
        yield from self._columns(below, np.full(len(below["head"]), -1), np.ones(len(below["head"]), bool))

    def _columns(self, found: dict, parent_conv: np.ndarray, parent_open: np.ndarray) -> Iterator[dict]:
        head, depth, count = found["head"], found["depth"], len(found["head"])
        if not count:
            return
        ends, first_end = [None] * count, [None] * count
        for i, members in found["ends"].items():
            text = _ids(members)
            ends[i] = text.decode() if found["open"][i] else hashlib.sha256(text).hexdigest()
            first_end[i] = int(members[0])
        # The beginning of a later block is a node of the block before: only what lies below it counts here.
        again = (depth == 0) & (self.block[head] > 0)
        top = np.full(count, depth == 0)
        masked = lambda values, none: pa.array(np.asarray(values, dtype=np.int64), pa.int64(), mask=np.array(np.broadcast_to(none, count)))
        yield {
            "k1": masked(self.codes[0][head, depth], False), "k2": masked(self.codes[1][head, depth], False),
            "p1": masked(self.codes[0][head, max(depth - 1, 0)], top), "p2": masked(self.codes[1][head, max(depth - 1, 0)], top),
            "depth": masked(self.block[head] * self.width + depth, False),
            "conv_id": masked(found["conv"], again), "parent_conv_id": masked(parent_conv, parent_open | top),
            "n_convs": masked(np.where(again, 0, found["n"]), False), "n_children": masked(found["children"], False),
            "n_leaves": masked(found["n_leaves"], False), "saved": masked(found["saved"], False), "words": masked(found["words"], again),
            "ends": pa.array(ends, pa.string()), "first_end": pa.array(first_end, pa.int64()), "open": pa.array(found["open"]),
        }


def _ranks(*columns: np.ndarray) -> np.ndarray:
    """1, 2, ... for the distinct rows of the columns, in their order."""
    if not len(columns[0]):
        return np.empty(0, np.int32)
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(new)
    return out


def _shards(width: int, names: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if own:
            for columns in Shard(pa.Table.from_batches(own), width).nodes():
                yield pa.RecordBatch.from_pydict({name: columns[name] for name in names})

    return scan


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of the joined parts of each key; the parts of a key follow each other."""
    last, state = None, None
    for batch in batches:
        out = []
        for key, text in zip(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist()), batch.column("ends").to_pylist()):
            if key == last:
                state.update(b"," + text.encode())
            else:
                if last is not None:
                    out.append((*last, state.hexdigest()))
                last, state = key, hashlib.sha256(text.encode())
        yield _hashes(out)
    if last is not None:
        yield _hashes([(*last, state.hexdigest())])


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    k1, k2, text = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_pydict({"k1": pa.array(k1, pa.int64()), "k2": pa.array(k2, pa.int64()), "ends_sha256": pa.array(text, pa.string())})


def trie(block_rows: DataFrame, kept: Kept, width: int = WIDTH) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node of the stored :func:`blocks`."""
    spark = block_rows.sparkSession
    parts = max(partitions(spark), ceil(block_rows.count() / SHARD_ROWS))
    names = [field.strip().split(" ")[0] for field in NODE.split(",")]
    ranged = block_rows.repartitionByRange(parts, "block", *KEY, "ids", "conv_id")
    found = kept(ranged.mapInArrow(_shards(width, names), NODE), "trie-nodes")
    parts_of_open = found.filter("open")
    ends = parts_of_open.filter("ends IS NOT NULL").select(*KEY, "first_end", "ends").repartition(partitions(spark), *KEY).sortWithinPartitions(*KEY, "first_end")
    ends = ends.mapInArrow(_hashed, "k1 long, k2 long, ends_sha256 string")
    merged = parts_of_open.groupBy(*KEY).agg(
        *[F.max(c).alias(c) for c in ("p1", "p2", "depth", "words")], F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
    )
    opened = kept(merged.join(ends, KEY, "left"), "open-nodes")
    under = opened.filter("p1 IS NOT NULL").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("open_children"))
    opened = opened.join(under, KEY, "left").withColumn("n_children", F.col("n_children") + F.coalesce("open_children", F.lit(0))).drop("open_children")
    opened = opened.withColumns({
        "n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")),
        "saved": F.col("saved") + (F.col("n_convs") - 1) * F.col("words"),
    })
    opened = kept(opened, "open-nodes-own")
    totals = _summed_up(opened.select(*KEY, "p1", "p2", "n_leaves", "saved"), kept)
    opened = kept(opened.drop("n_leaves", "saved").join(totals, KEY), "open-nodes-whole")
    tops = opened.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("top"))
    result = lambda df, parent: df.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_HASH)).alias("ends_sha256"),
    )
    closed = found.filter("NOT open").withColumnRenamed("ends", "ends_sha256")
    inner = result(closed.filter("parent_conv_id IS NOT NULL"), F.col("parent_conv_id"))
    outer = result(closed.filter("parent_conv_id IS NULL").join(tops, ["p1", "p2"]), F.col("top"))
    return inner.unionByName(outer).unionByName(result(opened.join(tops, ["p1", "p2"], "left"), F.col("top")))


def _summed_up(opened: DataFrame, kept: Kept) -> DataFrame:
    """(k1, k2, n_leaves, saved) with all that lies below added, by pointer jumping.

    After round r a node holds what lies less than 2**r steps below it, and points 2**r steps up.
    """
    state, turn = opened, 0
    while True:
        up = state.filter("p1 IS NOT NULL")
        if up.isEmpty():
            return state.select(*KEY, "n_leaves", "saved")
        more = up.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        next_of = up.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
        jumped = state.join(next_of, ["p1", "p2"], "left").join(more, KEY, "left")
        state = kept(
            jumped.select(
                *KEY, F.col("q1").alias("p1"), F.col("q2").alias("p2"), (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            ),
            f"jumps-{turn}",
        )
        turn += 1


def prefix_trie(conversations: DataFrame, every: int = 20, most: int = 4, width: int = WIDTH) -> DataFrame:
    """The trie of the rebuilt conversations."""
    kept = Kept(conversations.sparkSession)
    codes = kept(turn_codes(conversations), "turn-codes")
    turns, convs = rebuilt(numbered_turns(codes, kept), kept, every, most)
    return trie(kept(blocks(turns, convs, kept, width), "block-rows"), kept, width)
