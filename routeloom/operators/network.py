"""A directed network as two tables, and its preparation for iterative operators."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Workspace
from ..skew import hot_keys, lookup, settled
from .clean import clean_graph, dedup
from .ranks import row_numbers
from .reconcile import augment

# Edges of one vertex that may share a task before they are cut into slots.
SLOT_EDGES = 100_000
EDGES_PER_PARTITION = 1_000_000


@dataclass
class Network:
    """``vertices`` (id, attributes...) and ``edges`` (src, dst), both without duplicates."""

    vertices: DataFrame
    edges: DataFrame

    @classmethod
    def build(cls, vertices: DataFrame, edges: DataFrame) -> "Network":
        """Network of the given tables; duplicate ids are an error, duplicate edges are merged."""
        twice = vertices.groupBy("id").count().filter("count > 1").limit(1).count()
        if twice:
            raise ValueError("vertex ids are not unique")
        return cls(vertices, dedup(edges.select("src", "dst")))

    @classmethod
    def cleaned(cls, vertices: DataFrame, edges: DataFrame) -> "Network":
        return cls(*clean_graph(vertices, edges))

    def augmented(self, observed: DataFrame, allow_loops: bool = True) -> "Network":
        return Network(self.vertices, augment(self.vertices, self.edges, observed, allow_loops))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree); 0 without edges, a loop counts in both directions.

    One pass: each edge yields a mark for either end, and the marks are summed with the vertices.
    """
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
                F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
            )
        ).alias("e")
    ).groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    return (
        vertices.select("id")
        .join(ends, "id", "left")
        .fillna(0, ["in_degree", "out_degree"])
        .withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    )


def number_nodes(vertices: DataFrame) -> DataFrame:
    """(id, idx): dense whole numbers from 0 in the order of the ids."""
    return row_numbers(vertices.select("id"), ["id"], "_rn").select("id", (F.col("_rn") - 1).alias("idx"))


def encode_edges(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """``edges`` with both ends as numbers; edges with an unknown end are dropped.

    Loops shuffle and compare the ends many times, so eight bytes instead of text pay off.
    """
    total = edges.count()
    for end in ("src", "dst"):
        names = numbers.select(F.col("id").alias(end), F.col("idx").alias("_idx"))
        edges = lookup(edges, names, [end], "inner", hot_keys(edges, [end], total=total)).withColumn(end, F.col("_idx")).drop("_idx")
    return edges


@dataclass
class Prepared:
    """Stored tables for loops over a network, with nodes numbered from 0.

    A vertex with very many edges is cut into slots: its edges carry a slot number, and whatever
    the vertex sends is repeated once per slot, so that no task gets all edges of a hub. The edges
    are kept in the layout the rounds of a loop join on, forward or backward; a lost piece is
    rebuilt from the stored table. Partitions hold a bounded number of edges, which lets the joins
    hash the edges instead of sorting what flows along them.
    """

    workspace: Workspace
    names: DataFrame  # id, idx
    vertices: DataFrame  # id (the number), in_degree, out_degree, in_slots, out_slots
    table: DataFrame  # src, dst, out_slot, in_slot
    n: int
    parts: int

    @cached_property
    def edges(self) -> DataFrame:
        return kept(self.table.select("src", "dst", "out_slot").repartition(self.parts, "src", "out_slot"))

    @cached_property
    def reversed_edges(self) -> DataFrame:
        return kept(self.table.select("src", "dst", "in_slot").repartition(self.parts, "dst", "in_slot"))

    def forward(self, sent: DataFrame) -> DataFrame:
        """What the sources in ``sent`` (src, out_slot, ...) send along their edges."""
        return sent.join(self.edges.hint("shuffle_hash"), ["src", "out_slot"])

    def backward(self, sent: DataFrame) -> DataFrame:
        """What the targets in ``sent`` (dst, in_slot, ...) send against their edges."""
        return sent.join(self.reversed_edges.hint("shuffle_hash"), ["dst", "in_slot"])

    def named(self, values: DataFrame) -> DataFrame:
        """``values`` per node number, by node id again."""
        return self.names.join(values.withColumnRenamed("id", "idx"), "idx").drop("idx")

    def release(self) -> None:
        for side in ("edges", "reversed_edges"):
            if side in self.__dict__:
                self.__dict__[side].unpersist()


def kept(df: DataFrame) -> DataFrame:
    """Persisted and filled: only a filled cache shows its layout to the planner."""
    df = df.persist()
    df.count()
    return df


def _slots(degree: str, slot_edges: int) -> Column:
    return F.greatest(F.ceil(F.col(degree) / slot_edges), F.lit(1)).cast("int")


def prepare(network: Network, label: str, slot_edges: int | None = None) -> Prepared:
    slot_edges = slot_edges or SLOT_EDGES
    spark = network.vertices.sparkSession
    workspace = Workspace(spark, label)
    names = workspace.save(number_nodes(network.vertices), "names")
    edges = workspace.save(network.edges.select("src", "dst"), "listed")
    # Stored slot columns, not constants: the planner must see the layout the joins ask for.
    slots = {"out_slot": F.lit(0), "in_slot": F.lit(0)}
    edges = workspace.save(encode_edges(edges, names).withColumns(slots), "edges")
    vertices, facts = workspace.save_counted(
        degrees(names.select(F.col("idx").alias("id")), edges)
        .withColumn("in_slots", _slots("in_degree", slot_edges))
        .withColumn("out_slots", _slots("out_degree", slot_edges)),
        "vertices",
        n=F.count(F.lit(1)), m=F.sum("out_degree"), i=F.max("in_slots"), o=F.max("out_slots"),
    )
    for end, other, most in (("src", "dst", facts["o"]), ("dst", "src", facts["i"])):
        slot = "out_slot" if end == "src" else "in_slot"
        if (most or 1) == 1:
            continue
        many = vertices.filter(F.col(f"{slot}s") > 1).select(F.col("id").alias(end), F.col(f"{slot}s").alias("_s"))
        cut = lookup(edges, many, [end], "left", hot_keys(edges, [end], total=facts["m"])).withColumn(
            slot, F.expr(f"cast(pmod(xxhash64({other}), coalesce(_s, 1)) as int)")
        )
        edges = workspace.save(cut.select("src", "dst", "out_slot", "in_slot"), f"edges-{slot}")
    parts = max(spark.sparkContext.defaultParallelism, ceil((facts["m"] or 0) / EDGES_PER_PARTITION))
    return Prepared(workspace, names, vertices, edges, facts["n"], parts)


def per_slot(state: DataFrame, slots: str, slot: str) -> DataFrame:
    """``state`` repeated once per slot of its vertex."""
    return state.withColumn(slot, F.explode(F.sequence(F.lit(0), F.col(slots) - 1))).drop(slots)


def successors(edges: DataFrame) -> DataFrame:
    """Out-neighbour sets in long form: (id, member, set_size).

    Kept as rows, because the set of a hub need not fit into one task.
    """
    rows, total = settled(edges.select(F.col("src").alias("id"), F.col("dst").alias("member")).distinct())
    sizes = rows.groupBy("id").agg(F.count(F.lit(1)).alias("set_size"))
    return lookup(rows, sizes, ["id"], "inner", hot_keys(rows, ["id"], total=total))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in the node set."""
    from .clean import referential

    return referential(edges, nodes)
