"""Exact Jaccard join of documents on word n-grams by vertical partitioning, as connected components.

The n-grams have one global order: those met often come last, by powers of two of how often, the rest in order of their
codes. The order is cut into fragments, the same for all documents.

1. *Statistics.* One pass gives each document the size and a code of its set, and counts the n-grams that repeat; the frequent
   ones (a bounded list) are placed at the end of the order. Documents of one set are one vertex from here on.
2. *Candidates.* Two sets that link share at least ``k`` n-grams among the first ``n - ceil(threshold * n) + k`` of both, where ``k``
   grows with the smaller set. Prefixes are packed by ranges of codes (n-grams that could fill a range alone go as single rows
   that are aggregated before they move), and n-grams of one vertex alone drop out. A vertex that has fewer shared n-grams
   than it needs cannot link and drops out too. The hub of an n-gram is the vertex that shares most of its prefix; in a round each
   vertex proposes one pair, with the best hub of its n-grams that it has not tried and may link with, so a round has no more pairs than vertices.
3. *Partial overlaps.* For the proposed pairs, the order is cut where the first half of either set ends: up to there the halves tell the overlap, and
   a pair goes on only if the rest could still reach the threshold. Then each fragment of the order is compared on its own and yields a partial
   overlap; the partial overlaps are summed per pair and compared exactly.
4. *Components* of the links. N-grams whose vertices are all in one component are done. The others go into further rounds, and what
   then still joins different components is compared pair by pair, as far as what the prefixes share allows a link. So no link
   between different components is lost, and the pairs inside a group of near copies are never listed.

Defined results: null, empty or blank texts have no n-grams and are components of their own. With fewer than ``size`` words the whole
sequence is the one n-gram. Equal sets link whatever their ids; rows that share an id are joined by their texts alone. Extra columns
are ignored. An empty table gives an empty table. Sets are told apart by 64-bit codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import Workspace
from .shared import Kept, kept
from .tokens import NOT_SPACE, Codes, Words, mix, words
from .training import give_back, trimmed

SIZE = 5
PERCENT = 80
# At most this many n-grams are marked as frequent (9 bytes each, broadcast).
MAX_FREQUENT = 1 << 22
# An n-gram counts as frequent from this many documents on, or from the share that MAX_FREQUENT implies.
MIN_FREQUENT = 16
# Counts are gathered for n-grams met so often among the documents of one Arrow batch.
MIN_IN_BATCH = 3
# The codes of infrequent n-grams are cut into 2**FRAGMENT_BITS fragments; the frequent ones are one more.
FRAGMENT_BITS = 3
# One more shared n-gram is asked for, and one more looked at, for each so many of a set.
PER_SHARED = 32
# Prefix n-grams in one range of the order.
PER_BUCKET = 500_000
# The first half of a set is stored beside its fragments under this number.
HALF = -1
MAX_MAP_BITS = 28
HUB_ROUNDS = 2
# N-grams met about so often could fill a range of their own: they go as single rows.
HOT_RANK = (PER_BUCKET // 32).bit_length() - 1
# Sets are matched by size in steps of this factor.
SIZE_STEP = 1.04
# Where more than so many vertices answer for one n-gram and size, they are compared by their parities before they are a pair.
FEW = 32
# Numbers of 64 parities each. They tell sets of up to about a thousand n-grams apart.
PARITIES = [f"p{i}" for i in range(16)]
# Of those who answer for one n-gram and size, so many at most meet in one place.
PER_SLOT = 4096


def gram_sets(part: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of the distinct n-grams of each document, sorted by both."""
    place, code = part.grams(size)
    rows, codes = [part.row[place]], [code]
    lengths = np.diff(part.bounds())
    for n in range(1, size):
        if (lengths == n).any():
            place, code = part.grams(n)
            own = lengths[part.row[place] - part.first_row] == n
            rows.append(part.row[place][own])
            codes.append(code[own])
    row, code = np.concatenate(rows), np.concatenate(codes)
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    return row[new], code[new]


def _cuts(row: np.ndarray, part: Words) -> np.ndarray:
    return np.searchsorted(row, np.arange(part.first_row, part.first_row + part.rows + 1))


def _set_codes(code: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One code per set, whatever the order of its members."""
    total = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum(mix(code + np.uint64(0x51ED270B)), out=total[1:])
    return mix(total[cuts[1:]] - total[cuts[:-1]] + np.diff(cuts).astype(np.uint64))


def _statistics(size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, vertices, codes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for part in words(batch.column("text"), NOT_SPACE):
                row, code = gram_sets(part, size)
                cuts = _cuts(row, part)
                counts.append(np.diff(cuts))
                vertices.append(_set_codes(code, cuts))
                codes.append(code)
            code = np.sort(np.concatenate(codes))
            edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.empty(0, np.int64)
            times = np.diff(np.append(edge, len(code)))
            often = times >= MIN_IN_BATCH
            n, extra = batch.num_rows, int(often.sum())
            none = pa.nulls(extra, pa.int64())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.concat_arrays([batch.column("doc_id"), pa.nulls(extra, batch.schema.field("doc_id").type)]),
                    "body": pa.concat_arrays([batch.column("body"), none]),
                    "n": pa.concat_arrays([pa.array(np.concatenate(counts), pa.int64()), none]),
                    "vertex": pa.concat_arrays([pa.array(np.concatenate(vertices).view(np.int64)), none]),
                    "gram": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(code[edge][often].view(np.int64))]),
                    "times": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(times[often], pa.int64())]),
                }
            )

    return scan


class Order:
    """The global order: an n-gram's code becomes a key; smaller keys come first."""

    def __init__(self, grams: np.ndarray, times: np.ndarray):
        place = np.argsort(grams.view(np.uint64))
        self.frequent = Codes(grams.view(np.uint64))
        self.rank = np.clip(np.log2(np.maximum(times[place], 2)).astype(np.int64), 1, 30).astype(np.uint8)

    def keys(self, code: np.ndarray) -> np.ndarray:
        out = code >> np.uint64(6)
        known, rank = self.frequent.find(code)
        out[known] |= self.rank[rank].astype(np.uint64) << np.uint64(58)
        return out


def ordered_sets(part: Words, size: int, order: Order) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of all documents one after the other, each document's in order; where they begin; a code per set)."""
    row, code = gram_sets(part, size)
    cuts = _cuts(row, part)
    vertex = _set_codes(code, cuts)
    key = order.keys(code)
    return key[np.lexsort((key, row))], cuts, vertex


def _prefixes(order, size: int, percent: int, bucket_bits: int):
    """Rows (bucket, grams, vertices): all prefixes of a batch in order, cut into ranges.

    Bucket -1 has the n-grams from ``HOT_RANK`` on, bucket -2 the last n-gram of each prefix.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = order.value
        for batch in batches:
            grams, vertices = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            lasts, owners = [], []
            for part in words(batch.column("text"), NOT_SPACE):
                key, cuts, vertex = ordered_sets(part, size, known)
                n = np.diff(cuts)
                length = np.where(n > 0, n + (-percent * n) // 100 + 1 + n // PER_SHARED, 0)
                first = np.repeat(cuts[:-1] - (np.cumsum(length) - length), length) + np.arange(length.sum())
                grams.append(key[first])
                vertices.append(np.repeat(vertex, length))
                some = length > 0
                lasts.append(key[(cuts[:-1] + length - 1)[some]].tobytes())
                owners.append(vertex[some].tobytes())
            key, vertex = np.concatenate(grams), np.concatenate(vertices)
            buckets = 1 << bucket_bits
            bucket = ((key & np.uint64((1 << 58) - 1)) >> np.uint64(58 - bucket_bits)).astype(np.int64)
            bucket[key >> np.uint64(58) >= HOT_RANK] = buckets
            place = np.argsort(bucket, kind="stable")
            key, vertex, bucket = key[place], vertex[place], bucket[place]
            edges = np.searchsorted(bucket, np.arange(buckets + 2))
            full = np.flatnonzero(np.diff(edges))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*np.where(full == buckets, -1, full).tolist(), -2], pa.int32()),
                    pa.array([*[key[edges[i] : edges[i + 1]].tobytes() for i in full], b"".join(lasts)], pa.binary()),
                    pa.array([*[vertex[edges[i] : edges[i + 1]].tobytes() for i in full], b"".join(owners)], pa.binary()),
                ],
                names=["bucket", "grams", "vertices"],
            )

    return scan


def _unpacked(table) -> tuple[np.ndarray, np.ndarray]:
    join = lambda name: np.frombuffer(b"".join(table.column(name).to_pylist()), np.int64)
    return join("grams"), join("vertices")


def _several(table: pa.Table) -> pa.Table:
    """(gram, vertex), once each, of the n-grams of one range that more than one vertex has."""
    gram, vertex = _unpacked(table)
    place = np.lexsort((vertex, gram))
    gram, vertex = gram[place], vertex[place]
    new = np.ones(len(gram), dtype=bool)
    new[1:] = (gram[1:] != gram[:-1]) | (vertex[1:] != vertex[:-1])
    gram, vertex = gram[new], vertex[new]
    same = gram[1:] == gram[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    return pa.table({"gram": gram[shared], "vertex": vertex[shared]})


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gram, vertex = _unpacked(batch)
        yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(vertex)], names=["gram", "vertex"])


def _fragments(order, wanted, bits: int, size: int):
    """Rows (vertex, copy, n, fragment, keys) of the sets whose vertex and id are marked in the bit map ``wanted``, with their first half as fragment ``HALF``.

    ``copy`` tells the documents of one set apart, should several be marked.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, marks = order.value, wanted.value
        for batch in batches:
            ids = batch.column("id_code").to_numpy(zero_copy_only=False).view(np.uint64)
            copies = batch.column("copy").to_numpy(zero_copy_only=False)
            for part in words(batch.column("text"), NOT_SPACE):
                row, code = gram_sets(part, size)
                cuts = _cuts(row, part)
                vertex = _set_codes(code, cuts)
                marked = _is_marked(marks, bits, vertex ^ ids[part.first_row : part.first_row + part.rows])
                out: tuple[list, list, list, list, list] = ([], [], [], [], [])
                for i in np.flatnonzero(marked & (np.diff(cuts) > 0)):
                    own = np.sort(known.keys(code[cuts[i] : cuts[i + 1]]))
                    fragment = np.minimum(own >> np.uint64(58 - FRAGMENT_BITS), np.uint64(1 << FRAGMENT_BITS))
                    edges = np.searchsorted(fragment, np.arange((1 << FRAGMENT_BITS) + 2))
                    parts = [(HALF, own[: (len(own) + 1) // 2]), *[(f, own[edges[f] : edges[f + 1]]) for f in range(len(edges) - 1)]]
                    for f, keys in parts:
                        for column, value in zip(out, (vertex[i].view(np.int64), copies[part.first_row + i], len(own), f, keys.tobytes())):
                            column.append(value)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["vertex", "copy", "n", "fragment", "keys"])

    return scan


def _is_marked(marks: np.ndarray, bits: int, code: np.ndarray) -> np.ndarray:
    slot = code >> np.uint64(64 - bits)
    return ((marks[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)) == 1


def _of_marked(wanted, bits: int):
    """The rows whose vertex is marked in the bit map ``wanted``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = wanted.value
        for batch in batches:
            vertex = batch.column("vertex").to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(_is_marked(marks, bits, vertex)))

    return scan


def _parities(wanted, bits: int):
    """Rows (vertex, copy, parities) of marked vertices: for each class of keys, by their hash, whether a fragment has an odd number of them."""
    classes = 64 * len(PARITIES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _of_marked(wanted, bits)(batches):
            out = np.zeros((batch.num_rows, classes), dtype=bool)
            for row, keys in zip(out, batch.column("keys").to_pylist()):
                own = (mix(np.frombuffer(keys, np.uint64)) >> np.uint64(32)).astype(np.int64) % classes
                row[:] = np.bincount(own, minlength=classes) & 1
            packed = np.packbits(out, axis=1).view(np.int64)
            columns = [batch.column("vertex"), batch.column("copy"), *[pa.array(np.ascontiguousarray(c)) for c in packed.T]]
            yield pa.RecordBatch.from_arrays(columns, names=["vertex", "copy", *PARITIES])

    return scan


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _key_pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for x, y in zip(batch.column("keys_a").to_pylist(), batch.column("keys_b").to_pylist()):
        yield np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial overlap of each pair in one fragment."""
    for batch in batches:
        overlap = [_common(x, y) for x, y in _key_pairs(batch)]
        yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("a", "b", "n_a", "n_b")} | {"overlap": pa.array(overlap, pa.int64())})


def _most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each pair can have in common at most: what both halves share up to the end of the first, and the smaller rest."""
    for batch in batches:
        most = []
        for x, y, n_a, n_b in zip(*zip(*_key_pairs(batch)), batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist()) if batch.num_rows else ():
            end = min(x[-1], y[-1])
            x, y = x[: np.searchsorted(x, end, "right")], y[: np.searchsorted(y, end, "right")]
            most.append(_common(x, y) + min(n_a - len(x), n_b - len(y)))
        yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("a", "b", "copy_a", "copy_b", "n_a", "n_b")} | {"most": pa.array(most, pa.int64())})


def _met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b, copy_a, copy_b, fragment) with the keys of both sides.

    Both sides ask for the same layout of ``sets``, so that these move once.
    """
    side = lambda s: sets.select(
        F.col("vertex").alias(s), F.col("copy").alias(f"copy_{s}"), "fragment", F.col("n").alias(f"n_{s}"), F.col("keys").alias(f"keys_{s}")
    )
    return pairs.join(side("a"), ["a", "copy_a", "fragment"]).join(side("b"), ["b", "copy_b", "fragment"])


def _in(fragments: list[int]) -> Column:
    return F.explode(F.array(*[F.lit(f) for f in fragments])).alias("fragment")


def _partial_overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, overlap) summed over the fragments in ``sets``."""
    counted = _met(pairs, sets).mapInArrow(_shared, "a long, b long, n_a long, n_b long, overlap long")
    return counted.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))


class NgramJoin:
    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT):
        self.spark = docs.sparkSession
        self.kept = Kept(self.spark)
        self.size, self.percent = size, percent
        self.docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        self.members, self.order, self.total = self._statistics()
        self.grams = self._shared_grams()
        give_back(self.spark)
        self.marks: list = []
        self.sets = self._sets()
        # A document beside the one asked for may be marked by chance or share its id; pairs meet one copy of a set.
        halves = self.sets.filter(F.col("fragment") == HALF)
        self.copies = self.kept(halves.groupBy("vertex").agg(F.min("copy").alias("copy")), "copies")

    def _statistics(self):
        kind = self.docs.schema["doc_id"].dataType.simpleString()
        seen = self.docs.withColumn("body", F.xxhash64("text")).mapInArrow(trimmed(_statistics(self.size)), f"doc_id {kind}, body long, n long, vertex long, gram long, times long")
        seen = self.kept(seen, "gram-statistics")
        members = seen.filter(F.col("n").isNotNull()).select("doc_id", "body", "n", "vertex")
        total = members.agg(F.sum("n")).first()[0] or 0
        # Each counted n-gram takes at least this many of the total, so at most MAX_FREQUENT of them exist.
        least = max(MIN_FREQUENT, -(-total // MAX_FREQUENT))
        frequent = seen.filter(F.col("n").isNull()).groupBy("gram").agg(F.sum("times").alias("times")).filter(F.col("times") >= least)
        table = frequent.select("gram", "times").toArrow()
        order = Order(table.column("gram").to_numpy().astype(np.int64), table.column("times").to_numpy().astype(np.int64))
        return members, self.spark.sparkContext.broadcast(order), total

    def _shared_grams(self) -> DataFrame:
        """Rows (gram, vertex, ...) of the n-grams that stand in several prefixes, for the vertices that share enough of theirs.

        Of two sets, the one whose prefix ends first has met all n-grams up to there that both have. So their overlap
        is at most its ``rest`` (what lies beyond its prefix) and what it shares with the other, or with anyone: ``cap``.
        """
        bits = max(1, (self.total * (100 - self.percent) // 100 // PER_BUCKET).bit_length())
        scan = trimmed(_prefixes(self.order, self.size, self.percent, bits))
        packed = self.kept(self.docs.select("text").mapInArrow(scan, "bucket int, grams binary, vertices binary"), "prefixes")
        shared = packed.filter("bucket >= 0").groupBy("bucket").applyInArrow(_several, "gram long, vertex long")
        # Those of one vertex alone stay: they only make its bound less sharp, and the first round drops them.
        hot = packed.filter("bucket = -1").mapInArrow(_single, "gram long, vertex long").distinct()
        shared = self.kept(shared.unionByName(hot), "shared-grams")
        tails = packed.filter("bucket = -2").mapInArrow(_single, "gram long, vertex long").groupBy("vertex").agg(F.max("gram").alias("last"))
        counted = shared.groupBy("vertex").agg(F.count(F.lit(1)).alias("shared"))
        sizes = self.members.groupBy("vertex").agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id"))
        must = F.ceil(F.lit(self.percent) * F.col("n") / 100)
        able = counted.join(sizes, "vertex").filter(F.col("shared") >= 1 + F.floor(must / PER_SHARED)).join(tails, "vertex")
        self.able = self.kept(
            able.select(
                "vertex", F.col("vertex").bitwiseXOR(F.xxhash64("doc_id")).alias("mark"), "n", "last",
                (self._rest(F.col("n")) + F.col("shared")).alias("cap"),
            ),
            "able",
        )
        self.kept.release("prefixes")
        grams = self.kept(shared.join(self.able.drop("mark"), "vertex"), "able-grams")
        self.kept.release("shared-grams")
        return grams

    def _rest(self, n: Column) -> Column:
        """How much of a set of this size lies beyond its prefix."""
        return F.ceil(F.lit(self.percent) * n / 100) - 1 - F.floor(n / PER_SHARED)

    def _marked(self, codes: DataFrame):
        """A broadcast bit map of the column ``mark``, and its bits; other codes are marked by chance, about one in 16."""
        bits = min(MAX_MAP_BITS, max(16, (16 * codes.count()).bit_length()))
        slot = F.shiftrightunsigned("mark", 64 - bits)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
        table = codes.groupBy(F.shiftrightunsigned(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        marks = np.zeros(1 << (bits - 6), dtype=np.uint64)
        marks[table.column("word").to_numpy()] = table.column("bits").to_numpy().astype(np.int64).view(np.uint64)
        self.marks.append(self.spark.sparkContext.broadcast(marks))
        return self.marks[-1], bits

    def _sets(self) -> DataFrame:
        """(vertex, copy, n, fragment, keys): the whole sets of the vertices that may link, of one document each or of a few."""
        marks, bits = self._marked(self.able)
        scan = trimmed(_fragments(self.order, marks, bits, self.size))
        coded = self.docs.select("text", F.xxhash64("doc_id").alias("id_code"), F.monotonically_increasing_id().alias("copy"))
        return self.kept(coded.mapInArrow(scan, "vertex long, copy long, n long, fragment int, keys binary"), "fragments")

    def _sets_of(self, pairs: DataFrame, part: Column) -> DataFrame:
        """Those of the stored sets that the ``pairs`` need, before they move; a few others by chance."""
        marks, bits = self._marked(pairs.select(F.col("a").alias("mark")).union(pairs.select("b")).distinct())
        return self.sets.filter(part).mapInArrow(_of_marked(marks, bits), self.sets.schema)

    def _reach(self, overlap: Column, n_a: Column, n_b: Column) -> Column:
        """Whether an overlap reaches the threshold; it grows with the overlap."""
        return F.lit(100) * overlap >= F.lit(self.percent) * (n_a + n_b - overlap)

    def _links(self, pairs: DataFrame) -> DataFrame:
        """Those of the ``pairs`` (a, b) whose sets reach the threshold."""
        reach = lambda overlap: self._reach(F.col(overlap), F.col("n_a"), F.col("n_b"))
        one = lambda s: self.copies.select(F.col("vertex").alias(s), F.col("copy").alias(f"copy_{s}"))
        placed = pairs.select("a", "b").join(one("a"), "a").join(one("b"), "b")
        halves = _met(placed.select("*", _in([HALF])), self._sets_of(pairs, F.col("fragment") == HALF))
        bounds = halves.mapInArrow(_most, "a long, b long, copy_a long, copy_b long, n_a long, n_b long, most long")
        going_on = self.kept(bounds.filter(reach("most")).select("a", "b", "copy_a", "copy_b"), "going-on")
        parts = going_on.select("*", _in(list(range((1 << FRAGMENT_BITS) + 1))))
        return _partial_overlaps(parts, self._sets_of(going_on, F.col("fragment") != HALF)).filter(reach("overlap")).select("a", "b")

    def components(self) -> DataFrame:
        """(vertex, label) of the linked vertices: one label per component."""
        named = self.grams.withColumn("label", F.col("vertex"))
        pairs = links = labels = None
        held = "able-grams"
        for turn in range(HUB_ROUNDS + 1):
            give_back(self.spark)
            last = turn == HUB_ROUNDS
            new = self._apart_pairs(named, pairs) if last else self._hub_pairs(named, pairs)
            new = self.kept(new, f"pairs-{turn}")
            pairs = new if pairs is None else pairs.unionByName(new)
            found = self.kept(self._links(new), f"links-{turn}")
            if labels is not None and found.isEmpty():
                continue
            links = found if links is None else links.unionByName(found)
            labels = connected(links)
            if not last:
                named = named.drop("label").join(labels, "vertex", "left").withColumn("label", F.coalesce("label", "vertex"))
                ends = named.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high"))
                apart = ends.filter(F.col("low") != F.col("high")).select("gram")
                named = self.kept(named.join(apart, "gram", "left_semi"), f"apart-{turn}")
                self.kept.release(held)
                held = f"apart-{turn}"
                if named.isEmpty():
                    break
        return labels

    def _possible(self, a: str, b: str) -> Column:
        """Whether two vertices with these column prefixes can link, by what the prefix that ends first has met."""
        col = lambda side, name: F.col(f"{side}{name}")
        first = F.when(col(a, "last") < col(b, "last"), col(a, "cap")).when(col(b, "last") < col(a, "last"), col(b, "cap"))
        return self._reach(F.least(F.coalesce(first, F.least(col(a, "cap"), col(b, "cap"))), col(a, "n"), col(b, "n")), col(a, "n"), col(b, "n"))

    def _hub_pairs(self, named: DataFrame, tried: DataFrame | None) -> DataFrame:
        """(a, b): each vertex with the best hub of its n-grams that it has not tried, of another component.

        The hub of an n-gram is the vertex that shares most of its prefix: in a group of near copies the original, or what is closest to it.
        """
        rest = self._rest(F.col("n"))
        named = named.withColumn("rank", (-F.floor(1000 * (F.col("cap") - rest) / (F.col("n") - rest))).cast("int"))
        columns = ["rank", "vertex", "label", "n", "last", "cap"]
        hubs = named.groupBy("gram").agg(F.min(F.struct(*columns)).alias("hub"))
        met = named.join(hubs.select("gram", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in columns]), "gram")
        apart = met.filter((F.col("label") != F.col("hub_label")) & self._possible("", "hub_"))
        found = apart.select("vertex", "hub_rank", F.greatest("vertex", "hub_vertex").alias("a"), F.least("vertex", "hub_vertex").alias("b"))
        if tried is not None:
            found = found.distinct().join(tried, ["a", "b"], "left_anti")
        best = found.groupBy("vertex").agg(F.min(F.struct("hub_rank", "a", "b")).alias("best"))
        return best.select("best.a", "best.b").distinct()

    def _apart_pairs(self, named: DataFrame, tried: DataFrame) -> DataFrame:
        """Pairs of different components that the n-grams of their prefixes allow to link, without those ``tried``.

        Every n-gram that joins different components is here. The side whose prefix ends first looks for partners, by steps of size: to link with a set of
        that size it must share so many of its ``held`` n-grams here that one is among the first ``held - must + 1``. Only with
        those it asks, so near copies that cannot link with others of their size ask little or nothing. Where many answer, only those pairs are
        written that may link by their parities: two sets differ in as many n-grams at least as in parities.
        """
        size = lambda n: F.floor(F.log(n) / float(np.log(SIZE_STEP))).cast("int")
        side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("vertex", "label", "n", "last", "cap")]
        place = ["gram", "size"]
        answering = named.select("gram", size(F.col("n")).alias("size"), *side("y"))
        slots = F.ceil(F.count(F.lit(1)) / PER_SLOT)
        crowded = self.kept(answering.groupBy(*place).agg(F.count(F.lit(1)).alias("answers"), slots.alias("slots")).filter(F.col("answers") > FEW), "crowded")
        before = (F.col("x_last") < F.col("y_last")) | ((F.col("x_last") == F.col("y_last")) & (F.col("x_vertex") < F.col("y_vertex")))
        able = before & (F.col("x_label") != F.col("y_label")) & self._possible("x_", "y_")

        def asking(named: DataFrame) -> DataFrame:
            own = Window.partitionBy("vertex")
            named = named.withColumns({"held": F.count(F.lit(1)).over(own), "place": F.row_number().over(own.orderBy("gram"))})
            low = F.greatest(F.lit(1), F.floor(F.lit(self.percent) * F.col("n") / 100))
            # 100 * cap >= percent * (n + partner - cap)
            high = F.floor((100 + self.percent) * F.col("cap") / self.percent) - F.col("n")
            smallest = F.greatest(low, F.floor(F.pow(F.lit(SIZE_STEP), F.col("size"))))
            must = F.ceil(F.lit(self.percent) * (F.col("n") + smallest) / (100 + self.percent)) - self._rest(F.col("n"))
            asking = named.filter(high >= low).withColumn("size", F.explode(F.sequence(size(low), size(high))))
            return asking.filter(F.col("place") <= F.col("held") - F.greatest(must, F.lit(1)) + 1).select("gram", "size", *side("x"))

        if crowded.isEmpty():
            met = asking(named).join(answering, place).filter(able).select("x_vertex", "y_vertex")
        else:
            met = asking(named).join(crowded, place, "left_anti").join(answering, place).filter(able).select("x_vertex", "y_vertex")
            # Vertices that have a crowded n-gram, in any size, with all their n-grams.
            some = named.join(crowded.select("gram").distinct(), "gram", "left_semi").select("vertex").distinct()
            asks = self.kept(asking(named.join(some, "vertex", "left_semi")).join(crowded, place), "asks")
            answers = self.kept(answering.join(crowded, place).withColumn("slot", F.pmod(F.xxhash64("y_vertex"), "slots")), "answers")
            parities = self._parities(asks.select(F.col("x_vertex").alias("vertex")).union(answers.select("y_vertex")).distinct())
            of = lambda s: parities.select(F.col("vertex").alias(f"{s}_vertex"), *[F.col(p).alias(f"{s}_{p}") for p in PARITIES])
            differ = sum((F.bit_count(F.col(f"x_{p}").bitwiseXOR(F.col(f"y_{p}"))) for p in PARITIES), F.lit(0))
            near = self._reach(F.floor((F.col("x_n") + F.col("y_n") - differ) / 2), F.col("x_n"), F.col("y_n"))
            dealt = asks.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1))).drop("slots", "answers")
            many = dealt.join(of("x"), "x_vertex").join(answers.drop("slots", "answers").join(of("y"), "y_vertex"), [*place, "slot"])
            met = met.union(many.filter(able & near).select("x_vertex", "y_vertex"))
        pairs = met.select(F.greatest("x_vertex", "y_vertex").alias("a"), F.least("x_vertex", "y_vertex").alias("b")).distinct()
        return pairs.join(tried, ["a", "b"], "left_anti")

    def _parities(self, vertices: DataFrame) -> DataFrame:
        """(vertex, parities) of the sets of some vertices, stored."""
        marks, bits = self._marked(vertices.select(F.col("vertex").alias("mark")))
        sets = self.sets.filter(F.col("fragment") != HALF)
        parts = sets.mapInArrow(_parities(marks, bits), ", ".join(f"{c} long" for c in ("vertex", "copy", *PARITIES)))
        whole = parts.groupBy("vertex", "copy").agg(*[F.bit_xor(p).alias(p) for p in PARITIES])
        return self.kept(whole.join(self.copies, ["vertex", "copy"]).drop("copy"), "parities")

    def labelled(self) -> DataFrame:
        """(doc_id, body, n, vertex, label) per row of the documents; ``body`` tells the texts of one id apart."""
        return self.members.join(self.components(), "vertex", "left").withColumn("label", F.coalesce("label", "vertex"))

    def rows(self) -> DataFrame:
        """(doc_id, n, component) per row of the documents; component is the smallest id in it."""
        named = self.labelled().select("doc_id", "n", "label")
        some = named.filter(F.col("n") > 0)
        least = some.groupBy("label").agg(F.min("doc_id").alias("component"))
        none = named.filter(F.col("n") == 0).select("doc_id", "n", F.col("doc_id").alias("component"))
        return some.join(least, "label").select("doc_id", "n", "component").unionByName(none)

    def release(self) -> None:
        """Frees what the executors hold for this join. Its results must be stored before."""
        for held in (self.order, *self.marks):
            held.destroy()


def connected(links: DataFrame) -> DataFrame:
    """(vertex, label) of the components of ``links`` (a, b), both long; label is the smallest vertex.

    Each round a vertex takes the smallest label among itself and its neighbours, then the label of its label.
    """
    work = Workspace(links.sparkSession, "llm-connected")
    both = work.save(
        links.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*"),
        "links",
    )
    state = work.save(both.groupBy(F.col("src").alias("vertex")).agg(F.least(F.min("dst"), F.first("src")).alias("label")), "state-0")
    turn, moved = 0, 1
    while moved:
        turn += 1
        seen = both.join(state.select(F.col("vertex").alias("src"), "label"), "src").groupBy(F.col("dst").alias("vertex")).agg(F.min("label").alias("near"))
        nearer = work.save(
            state.join(seen, "vertex").select("vertex", F.col("label").alias("before"), F.least("label", "near").alias("label")), f"near-{turn % 2}"
        )
        jump = nearer.select(F.col("vertex").alias("label"), F.col("label").alias("further"))
        state, counts = work.save_counted(
            nearer.join(jump, "label").select("vertex", F.least("label", "further").alias("label"), "before"),
            f"state-{turn % 2 + 1}",
            moved=F.count_if(F.col("label") != F.col("before")),
        )
        moved = counts["moved"]
        state = state.select("vertex", "label")
    return state


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, component) per document: size of its n-gram set and the smallest id reachable by links."""
    return NgramJoin(docs, id_col, text_col, size, percent).rows()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group: the one of the smallest id (null last), and of its texts the first by their hash.

    Rows that share an id are judged by their texts, each on its own. Of rows alike in id and text one stays, whichever ids the others
    have. Documents without n-grams belong to no group and all stay.
    """
    join = NgramJoin(docs, id_col, text_col, size, percent)
    named = join.labelled().filter("n > 0")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "body")
    first = named.groupBy("label").agg(F.min(order).alias("first"))
    place = ["doc_id", "body"]
    judged = named.select("label", *place).join(first, "label").groupBy(*place).agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.struct(*place).eqNullSafe(F.struct("first.doc_id", "first.body"))).alias("stays")
    )
    judged = kept(judged.filter("NOT stays OR rows > 1"), "judged")
    join.release()

    def matched(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
        some = some.select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"))
        return rows.join(some, rows[id_col].eqNullSafe(some["_id"]) & (F.xxhash64(rows[text_col]) == some["_body"]), how)

    rest = matched(docs, judged.filter("NOT stays"), "left_anti")
    again = judged.filter("stays")
    if again.isEmpty():
        return rest
    return matched(rest, again, "left_anti").unionByName(matched(rest, again, "left_semi").dropDuplicates([id_col, text_col]))


def overlap(x: str, y: str, size: int = SIZE) -> tuple[int, int]:
    """Sizes of intersection and union of two texts' n-gram sets, for tests and single pairs."""
    sets = []
    for part in words(pa.array([x, y]), NOT_SPACE):
        row, code = gram_sets(part, size)
        sets += [set(code[row == i].tolist()) for i in range(part.first_row, part.first_row + part.rows)]
    return len(sets[0] & sets[1]), len(sets[0] | sets[1])


