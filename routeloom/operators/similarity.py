"""Set similarity: exact Jaccard, MinHash signatures, banding, and their comparison.

Sets are tables (id, member, ...) in long form, as given by ``network.successors``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash_order
from ..session import stage
from ..skew import hot_keys, lookup, salted_join, settled
from . import banding, overlap
from .ranks import row_numbers

PRIME = 2_147_483_647
STEP = 48_271
BANDS, ROWS = 64, 2
# Sizes of one class differ by less than this factor.
SIZE_CLASS = 1.5
THRESHOLD = (1 / BANDS) ** (1 / ROWS)
# Rows of queries that are broadcast.
FEW_ROWS = 100_000
# Members of a set that travel as one row, about.
CHUNK = 1_024
# Below this threshold prefixes are most of a set: overlaps are counted outright instead of candidates being checked.
COUNTED_BELOW = 0.5


def permutations(count: int, seed: int = 1) -> list[tuple[int, int]]:
    """(a, b) of the hash functions (a * h + b) mod 2^31-1, from the minimal-standard generator."""
    state = seed
    for _ in range(16):
        state = state * STEP % PRIME
    pairs = []
    for _ in range(count):
        a = state = state * STEP % PRIME
        b = state = state * STEP % PRIME
        pairs.append((a, b))
    return pairs


def member_hash(member: Column | str) -> Column:
    """First 32 bits of SHA-1, reduced to the range of the hash functions."""
    member = F.col(member) if isinstance(member, str) else member
    return F.conv(F.substring(F.sha1(member.cast("string")), 1, 8), 16, 10).cast("bigint") % PRIME


def minhash(sets: DataFrame, perms: int = BANDS * ROWS, seed: int = 1) -> DataFrame:
    """(id, signature): for each hash function the smallest value over the members.

    Minima combine before the shuffle, so a very large set costs one row per task.
    """
    hashed = sets.select("id", member_hash("member").alias("h"))
    minima = [F.min((F.col("h") * a + b) % PRIME).alias(f"m{i}") for i, (a, b) in enumerate(permutations(perms, seed))]
    return hashed.groupBy("id").agg(*minima).select("id", F.array(*[f"m{i}" for i in range(perms)]).alias("signature"))


def bands(signatures: DataFrame, b: int = BANDS, r: int = ROWS) -> DataFrame:
    """(id, band, bucket): ``r`` neighbouring minima make the bucket of a band."""
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(b - 1)),
        lambda i: F.struct(i.alias("band"), F.concat_ws("-", F.slice("signature", i * r + 1, r).cast("array<string>")).alias("bucket")),
    )
    return signatures.select("id", F.explode(keys).alias("k")).select("id", "k.band", "k.bucket")


def band_codes(signatures: DataFrame) -> DataFrame:
    """:func:`bands` of two rows each with the bucket as one whole number, for joins that move every band."""
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.struct(i.alias("band"), F.shiftleft(F.get("signature", i * ROWS), 31).bitwiseOR(F.get("signature", i * ROWS + 1)).alias("bucket")),
    )
    others = [c for c in signatures.columns if c != "signature"]
    return signatures.select(*others, F.explode(keys).alias("k")).select(*others, "k.band", "k.bucket")


def _meet(asked: DataFrame, rows: int, there: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the queries with those of the index. A few queries go to where the index is, which then does not move."""
    if rows <= FEW_ROWS:
        return there.join(F.broadcast(asked), on)
    return salted_join(asked, there, on, "other", hot_keys(there, on), "id", hot_keys(asked, on, total=rows))


def lsh_candidates(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(id, other): nodes of the index that share a band bucket with a query node, without itself.

    ``queries`` holds the ids to look up; ``index`` should be a stored table. Hot buckets of the index are cut into slots.
    """
    asked, rows = settled(index.join(queries.select("id"), "id", "left_semi"))
    there = index.select(F.col("id").alias("other"), "band", "bucket")
    return (
        _meet(asked, rows, there, ["band", "bucket"])
        .filter(F.col("id") != F.col("other"))
        .select("id", "other")
        .distinct()
    )


def jaccard_estimate(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """(id, other, estimate): share of equal minima. They fit four bytes, which is what every pair moves of each."""
    short = signatures.select("id", F.col("signature").cast("array<int>").alias("signature"))
    other = short.select(F.col("id").alias("other"), F.col("signature").alias("other_signature"))
    same = F.zip_with("signature", "other_signature", lambda x, y: (x == y).cast("int"))
    share = F.aggregate(same, F.lit(0), lambda a, x: a + x) / F.size("signature")
    return pairs.join(short, "id").join(other, "other").select("id", "other", share.alias("estimate"))


def packed_sets(sets: DataFrame, *facts: str) -> DataFrame:
    """(id, n, facts..., chunk, chunks, keys): sets (id, member) of n members in rows of about ``CHUNK`` numbered members, stored.

    A set has a power of two of chunks, by the hash of the member, so chunks of two sets can share a member only if their numbers agree modulo
    the smaller number of chunks. Members that one set alone holds can be in no overlap and get no number.
    """
    rows, total = settled(sets.select("id", "member", *facts))
    frequency = rows.groupBy("member").agg(F.count(F.lit(1)).alias("freq")).filter("freq > 1")
    codes = row_numbers(frequency.select("member"), ["member"], "key")
    sizes = rows.groupBy("id", *facts).agg(F.count(F.lit(1)).alias("n"))
    coded = lookup(rows.select("id", "member"), codes, ["member"], "inner", hot_keys(rows, ["member"], total=total)).select("id", "key")
    # A power of two, so that the numbers of chunks divide each other.
    chunks = F.expr(f"shiftleft(1, cast(ceil(log2(greatest(n / {CHUNK}, 1))) as int))")
    cut = sizes.withColumn("chunks", chunks).join(coded, "id", "left").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    return stage(cut.groupBy("id", "n", *facts, "chunks", "chunk").agg(F.collect_list("key").alias("keys")), "packed")


def overlaps(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """(id, other, common, n, m) of given pairs of :func:`packed_sets`, which meet chunk by chunk."""
    side = packed.select("id", "n", "chunk", "chunks", "keys")
    there = packed.select(F.col("id").alias("other"), F.col("n").alias("m"), F.col("chunk").alias("o_chunk"), F.col("chunks").alias("o_chunks"), F.col("keys").alias("o_keys"))
    fewer = F.least("chunks", "o_chunks")
    meet = F.when(F.pmod("chunk", fewer) == F.pmod("o_chunk", fewer), F.size(F.array_intersect("keys", "o_keys"))).otherwise(0)
    met = pairs.select("id", "other").join(side, "id").join(there, "other").select("id", "other", "n", "m", meet.alias("common"))
    return met.groupBy("id", "other").agg(F.sum("common").alias("common"), F.first("n").alias("n"), F.first("m").alias("m"))


def jaccard(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, other, common, jaccard) of given pairs, exactly. ``pairs`` are different pairs, in a stored table."""
    similarity = F.col("common") / (F.col("n") + F.col("m") - F.col("common"))
    return overlaps(pairs, packed_sets(sets)).select("id", "other", "common", similarity.alias("jaccard"))


def jaccard_against(queries: DataFrame, sets: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """(id, other, common, jaccard >= t) of the query nodes against all sets, by shared members.

    ``sets`` should be a stored table. Members of the queries meet the inverted index; hot members of the index are cut into slots
    and the overlap of a pair is summed before the shuffle. Pairs without a shared member have
    similarity 0 and never appear.
    """
    sizes = sets.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    asked, rows = settled(sets.join(queries.select("id"), "id", "left_semi").select("id", "member"))
    index = sets.select(F.col("id").alias("other"), "member")
    shared = (
        _meet(asked, rows, index, ["member"])
        .filter(F.col("id") != F.col("other"))
        .groupBy("id", "other")
        .agg(F.count(F.lit(1)).alias("common"))
    )
    similarity = F.col("common") / (F.col("n") + F.col("m") - F.col("common"))
    return (
        shared.join(sizes, "id")
        .join(sizes.select(F.col("id").alias("other"), F.col("n").alias("m")), "other")
        .select("id", "other", "common", similarity.alias("jaccard"))
        .filter(F.col("jaccard") >= t)
    )


def set_profiles(sets: DataFrame) -> DataFrame:
    """(id, profile): nodes with the same set share a profile, named by its smallest id.

    Sets are told apart by size and two independent 64-bit hash sums over their members, so a set
    of any size folds into one row before the shuffle.
    """
    prints, total = settled(sets.groupBy("id").agg(
        F.count(F.lit(1)).alias("size"),
        F.bit_xor(F.xxhash64("member")).alias("p1"),
        F.bit_xor(F.xxhash64(F.concat(F.lit("~"), F.col("member").cast("string"), F.lit("~")))).alias("p2"),
    ))
    on = ["size", "p1", "p2"]
    names = prints.groupBy(*on).agg(F.min("id").alias("profile"))
    return lookup(prints, names, on, "inner", hot_keys(prints, on, total=total)).select("id", "profile")


def numbered_profiles(sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(names, members, profiles) of the distinct sets: (id, name, held) and (id, member, n, held), the sets numbered in order of their names,
    and (id, profile) of every node."""
    rows = stage(sets.select("id", "member").distinct(), "sets")
    profiles = stage(set_profiles(rows), "profiles")
    holders = profiles.groupBy(F.col("profile").alias("name")).agg(F.count(F.lit(1)).alias("held"))
    names = stage(row_numbers(holders, ["name"], "id").select("id", "name", "held"), "names")
    kept, total = settled(rows.withColumnRenamed("id", "name").join(names.select("name"), "name", "left_semi"))
    sizes = kept.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    known = names.join(sizes, "name")
    members = lookup(kept, known, ["name"], "inner", hot_keys(kept, ["name"], total=total)).select("id", "member", "n", "held")
    return names, stage(members, "members"), profiles


def _named_pairs(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Names and holders for the numbers of both sides; a set with several holders is paired with itself."""
    side = lambda s: names.select(F.col("id").alias(s), F.col("name").alias(f"name_{s}"), F.col("held").alias(f"members_{s}"))
    found = pairs.join(side("a"), "a").join(side("b"), "b")
    return found.select(F.col("name_a").alias("a"), F.col("name_b").alias("b"), "members_a", "members_b", "common", "jaccard")


def _own_pairs(names: DataFrame) -> DataFrame:
    several = names.filter("held > 1")
    return several.select(
        F.col("name").alias("a"), F.col("name").alias("b"), F.col("held").alias("members_a"), F.col("held").alias("members_b"), F.lit(1.0).alias("jaccard")
    )


def _numbered(signatures: DataFrame) -> tuple[DataFrame, int]:
    """(id, name, signature) of (id, signature), numbered in the order of the names and stored, and how many there are. Minima fit four bytes."""
    rows = row_numbers(signatures.select(F.col("id").alias("name"), F.col("signature").cast("array<int>").alias("signature")).filter("name IS NOT NULL"), ["name"], "id")
    return settled(rows.select("id", F.col("name").cast("string").alias("name"), "signature"))


def _wide(rows: DataFrame) -> DataFrame:
    return band_codes(rows.select("id", F.col("signature").cast("array<bigint>").alias("signature")))


def _named_as(found: DataFrame, like: DataFrame, column: str, *names: str) -> DataFrame:
    """Names, which travel as text, in the type they had."""
    return found.withColumns({n: F.col(n).cast(like.schema[column].dataType) for n in names})


def _both_ways(ids: pa.Array, others: pa.Array, *columns: np.ndarray) -> pa.Table:
    """Pairs in both orders; what was computed for a pair holds for either."""
    found = [pa.concat_arrays([ids, others]), pa.concat_arrays([others, ids]), *[pa.array(np.concatenate([c, c])) for c in columns]]
    return pa.table(found, names=["id", "other", "estimate"][: len(found)])


def node_candidates(signatures: DataFrame) -> DataFrame:
    """(id, other): all ordered pairs of different nodes that share a band bucket."""
    rows, count = _numbered(signatures)
    width = banding.tile_width(count)

    def compare(left: pa.Table, right: pa.Table, pairs) -> Iterator[pa.Table]:
        a, b = banding.names(left, width), banding.names(right, width)
        for i, j in pairs:
            yield _both_ways(a(i), b(j))

    found = banding.banded(_wide(rows), rows.select("id", "name"), width, compare, "id string, other string")
    return _named_as(found, signatures, "id", "id", "other")


def node_estimates(signatures: DataFrame) -> DataFrame:
    """(id, other, estimate): share of equal minima of all ordered pairs of :func:`node_candidates`."""
    rows, count = _numbered(signatures)
    width = banding.tile_width(count)

    def compare(left: pa.Table, right: pa.Table, pairs) -> Iterator[pa.Table]:
        a, b, share = banding.names(left, width), banding.names(right, width), banding.equal_minima(left, right, width)
        for i, j in pairs:
            yield _both_ways(a(i), b(j), share(i, j))

    found = banding.banded(_wide(rows), rows, width, compare, "id string, other string, estimate double")
    return _named_as(found, signatures, "id", "id", "other")


def _width(packed: DataFrame) -> int:
    seen = packed.agg(F.max("id").alias("count"), F.count_distinct("id").alias("sets"), F.sum(F.size("keys")).alias("members")).first()
    return banding.tile_width(seen["count"] or 1, (seen["members"] or 0) / max(seen["sets"], 1))


def _candidates(members: DataFrame, packed: DataFrame, names: DataFrame) -> DataFrame:
    """(a, b, members_a, members_b, common, jaccard) with a before b of the distinct sets that share a band bucket."""
    width = _width(packed)

    def compare(left: pa.Table, right: pa.Table, pairs) -> Iterator[pa.Table]:
        a, b = banding.names(left, width), banding.names(right, width)
        common = banding.common_members(left, right, width)
        (n, held), (m, o_held) = ([banding.column(side, c, width) for c in ("n", "held")] for side in (left, right))
        for i, j in pairs:
            met = common(i, j)
            columns = a(i), b(j), held[i], o_held[j], met, met / (n[i] + m[j] - met)
            yield pa.table(list(columns), names=["a", "b", "members_a", "members_b", "common", "jaccard"])

    facts = packed.select("id", "n", "keys").join(names.select("id", F.col("name").cast("string").alias("name"), "held"), "id")
    layout = "a string, b string, members_a long, members_b long, common long, jaccard double"
    return _named_as(banding.banded(band_codes(minhash(members)), facts, width, compare, layout), names, "name", "a", "b")


def similar_between(signatures: DataFrame, sets: DataFrame, ends: DataFrame, wanted: Callable) -> DataFrame:
    """(id, other, jaccard) of ordered pairs of nodes that share a band bucket, exactly.

    ``ends`` has one row (id, numbers...) per node that may take part. ``wanted`` gets the numbers of both nodes, as arrays by name, and tells which pairs are.
    """
    values = [c for c in ends.columns if c != "id"]
    known = signatures.select(F.col("id").alias("name"), "signature").join(ends.withColumnRenamed("id", "name"), "name")
    rows = stage(row_numbers(known, ["name"], "id"), "ends")
    asked, total = settled(sets.select(F.col("id").alias("name"), "member"))
    members = lookup(asked, rows.select("name", "id"), ["name"], "inner", hot_keys(asked, ["name"], total=total)).select("id", "member")
    packed = packed_sets(members)
    width = _width(packed)

    def compare(left: pa.Table, right: pa.Table, pairs) -> Iterator[pa.Table]:
        sides = [(banding.names(s, width), {c: banding.column(s, c, width) for c in ["n", *values]}) for s in (left, right)]
        common = banding.common_members(left, right, width)
        for i, j in pairs:
            here, there = ({c: v[at] for c, v in facts.items()} for at, (_, facts) in zip((i, j), sides))
            ways = [(0, 1, wanted(here, there)), (1, 0, wanted(there, here))]
            some = ways[0][2] | ways[1][2]
            met = np.zeros(len(i), np.int64)
            met[some] = common(i[some], j[some])
            similar = met / (here["n"] + there["n"] - met)
            for a, b, way in ways:
                yield pa.table([sides[a][0]((i, j)[a][way]), sides[b][0]((i, j)[b][way]), similar[way]], names=["id", "other", "jaccard"])

    facts = packed.select("id", "n", "keys").join(rows.select("id", F.col("name").cast("string").alias("name"), *values), "id")
    found = banding.banded(band_codes(rows.select("id", "signature")), facts, width, compare, "id string, other string, jaccard double")
    return _named_as(found, signatures, "id", "id", "other")


def _caught(members: DataFrame, packed: DataFrame, bins: int) -> DataFrame:
    """(bin, hits): pairs of nodes with different sets that share a band bucket, by similarity; without a common member in bin -1."""
    width = _width(packed)

    def compare(left: pa.Table, right: pa.Table, pairs) -> Iterator[pa.Table]:
        common, hits = banding.common_members(left, right, width), np.zeros(bins + 1, np.int64)
        (n, held), (m, o_held) = ([banding.column(side, c, width) for c in ("n", "held")] for side in (left, right))
        for i, j in pairs:
            met = common(i, j)
            place = np.where(met > 0, np.minimum(np.floor(met / (n[i] + m[j] - met) * bins), bins - 1), -1).astype(np.int64)
            np.add.at(hits, place, held[i] * o_held[j])
        place = np.flatnonzero(hits)
        yield pa.table([np.where(place == bins, -1, place).astype(np.int32), hits[place]], names=["bin", "hits"])

    found = banding.banded(band_codes(minhash(members)), packed.select("id", "n", "held", "keys"), width, compare, "bin int, hits long")
    return found.groupBy("bin").agg(F.sum("hits").alias("hits"))


def profile_candidates(sets: DataFrame) -> DataFrame:
    """(a, b, members_a, members_b, common, jaccard): distinct sets that share a band bucket, with their exact similarity, and the membership.

    Nodes with equal sets are one profile, named by its smallest node. A profile of several nodes has a row of Jaccard 1 with each of them,
    itself included; different sets never have that, so both together give every pair of nodes.
    """
    names, members, profiles = numbered_profiles(sets)
    packed = packed_sets(members)
    pairs = _candidates(members, packed, names)
    several = names.filter("held > 1").join(packed.select("id", F.col("n").alias("common")).distinct(), "id")
    held = F.col("held").alias("members_a"), F.col("held").alias("members_b")
    own = profiles.join(several.withColumnRenamed("name", "profile").drop("id"), "profile")
    return pairs.unionByName(own.select(F.col("profile").alias("a"), F.col("id").alias("b"), *held, "common", F.lit(1.0).alias("jaccard")))


def similarity_curve(sets: DataFrame, b: int = BANDS, r: int = ROWS, bins: int = 20) -> DataFrame:
    """Per similarity bin of all ordered pairs of nodes: pairs, the share that became candidates, their mean similarity, 1 - (1 - s^r)^b.

    No pair of sets is written but the candidates: similarities are counted where the sets meet. Pairs without a common member are all others.
    """
    names, members, _ = numbered_profiles(sets)
    packed = packed_sets(members, "held")
    counted = overlap.similarity_histogram(packed, names.count(), bins).withColumn("hits", F.lit(0).cast("bigint"))
    # Candidates without a common member are in bin -1.
    caught = _caught(members, packed, bins)
    caught = caught.select("bin", F.lit(0).cast("bigint").alias("pairs"), F.lit(0.0).alias("total"), "hits")
    equal = names.agg(F.sum(F.col("held") * (F.col("held") - 1) / 2).cast("bigint").alias("pairs"))
    equal = equal.select(F.lit(bins - 1).alias("bin"), "pairs", F.col("pairs").alias("hits"), F.col("pairs").cast("double").alias("total"))
    met = stage(counted.unionByName(caught).unionByName(equal), "met")
    nodes = names.agg(F.sum("held").alias("n"))
    apart = met.agg(F.coalesce(F.sum(F.when(F.col("bin") >= 0, F.col("pairs"))), F.lit(0)).alias("met"), F.coalesce(F.sum(F.when(F.col("bin") < 0, F.col("hits"))), F.lit(0)).alias("hits"))
    n = nodes.scalar()
    rest = apart.select(F.lit(0).alias("bin"), (n * (n - 1) / 2 - F.col("met")).cast("bigint").alias("pairs"), "hits", F.lit(0.0).alias("total"))
    whole = met.filter("bin >= 0").unionByName(rest).groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("pairs", "hits", "total")]).filter("pairs > 0")
    curve = whole.select("bin", (2 * F.col("pairs")).alias("pairs"), (F.col("hits") / F.col("pairs")).alias("observed"), (F.col("total") / F.col("pairs")).alias("s"))
    return curve.withColumn("expected", 1 - F.pow(1 - F.pow("s", F.lit(float(r))), F.lit(float(b))))


def _overlap(m: Column, n: Column, t: float) -> Column:
    """Smallest overlap that lifts two sets of sizes ``m`` and ``n`` to Jaccard ``t``."""
    return F.ceil((m + n) * t / (1 + t) - 1e-9)


def jaccard_pairs(sets: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """All pairs of distinct sets with Jaccard >= ``t``: (a, b, members_a, members_b, jaccard).

    Nodes with equal sets are one profile, so any number of copies costs one row; a profile held
    by several nodes is paired with itself. Low thresholds count all overlaps (:mod:`overlap`). For higher ones candidates come from length-aware prefixes: with sizes
    m and n a pair needs an overlap of o = ceil(t (m + n) / (1 + t)), so it must share one of the
    m - o + 1 rarest members of one and the n - o + 1 rarest of the other. The join key holds the
    classes of both sizes, which keeps frequent members out of the index unless sharing one nearly
    decides already.
    """
    if not 0 < t <= 1:
        raise ValueError("the threshold lies in (0, 1]")
    if t < COUNTED_BELOW:
        names, members, _ = numbered_profiles(sets)
        found = overlap.shared_pairs(packed_sets(members, "held"), names.count(), t)
        return _named_pairs(found, names).drop("common").unionByName(_own_pairs(names))
    rows = stage(sets.select("id", "member").distinct(), "sets")
    profiles = stage(set_profiles(rows), "profiles")
    holders = profiles.groupBy("profile").agg(F.count(F.lit(1)).alias("held"))
    kept, total = settled(rows.join(holders.select(F.col("profile").alias("id")), "id", "left_semi"))
    # Members are numbered from rare to frequent and profiles by name, so that the long tables
    # below hold whole numbers only.
    frequency = kept.groupBy("member").agg(F.count(F.lit(1)).alias("freq"))
    codes = row_numbers(frequency, ["freq", "member"], "code").select("member", "code")
    numbers = stage(row_numbers(holders.select(F.col("profile").alias("name")), ["name"], "id"), "numbers")
    coded = lookup(kept, codes, ["member"], "inner", hot_keys(kept, ["member"], total=total)).select(F.col("id").alias("name"), F.col("code").alias("member"))
    coded = stage(coded, "coded")
    coded = lookup(coded, numbers, ["name"], "inner", hot_keys(coded, ["name"], total=total)).select("id", "member")
    # The place of a member in its set comes from one global sort, so no set is gathered in a task.
    sorted_rows = row_numbers(coded, ["id", "member"], "_rn")
    starts = sorted_rows.groupBy("id").agg(F.min("_rn").alias("_start"), F.count(F.lit(1)).alias("n"))
    placed = stage(
        lookup(sorted_rows, starts, ["id"], "inner", hot_keys(sorted_rows, ["id"], total=total)).select(
            "id", "member", "n", (F.col("_rn") - F.col("_start") + 1).alias("place")
        ),
        "placed",
    )
    size_class = F.floor(F.log(F.col("n").cast("double")) / log(SIZE_CLASS)).cast("int")
    classed = placed.withColumn("cls", size_class)
    # A few dozen classes at most, since they grow geometrically.
    spans = classed.filter("place = 1").groupBy("cls").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    all_classes = spans.agg(F.collect_list(F.struct("cls", "lo", "hi")).alias("k")).scalar()
    least = F.greatest(F.col("p.lo"), F.ceil(F.col("n") * t - 1e-9))
    reachable = (F.col("p.hi") >= F.col("n") * t - 1e-9) & (F.col("p.lo") <= F.col("n") / t + 1e-9)
    tokens = stage(
        classed.select("*", F.explode(all_classes).alias("p"))
        .filter(reachable & (F.col("place") <= F.col("n") - _overlap(F.col("n"), least, t) + 1))
        .select("id", "member", "n", "place", "cls", F.col("p.cls").alias("partner")),
        "tokens",
    )
    left = tokens.select(F.col("id").alias("a"), "member", F.col("n").alias("na"), F.col("place").alias("pa"), F.col("cls").alias("ca"), F.col("partner").alias("cb"))
    right = tokens.select(F.col("id").alias("b"), "member", F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("partner").alias("ca"), F.col("cls").alias("cb"))
    on = ["member", "ca", "cb"]
    need = _overlap(F.col("na"), F.col("nb"), t)
    decisive = (F.col("a") < F.col("b")) & (F.col("pa") <= F.col("na") - need + 1) & (F.col("pb") <= F.col("nb") - need + 1)
    found = salted_join(left, right, on, "b", hot_keys(right, on), "a", hot_keys(left, on)).filter(decisive).select("a", "b").distinct()
    found = stage(found.select(F.col("a").alias("id"), F.col("b").alias("other")), "found")
    exact = jaccard(found, placed.select("id", "member")).filter(F.col("jaccard") >= t)
    counts = numbers.join(holders.withColumnRenamed("profile", "name"), "name")
    first = counts.select("id", F.col("name").alias("a"), F.col("held").alias("members_a"))
    second = counts.select(F.col("id").alias("other"), F.col("name").alias("b"), F.col("held").alias("members_b"))
    pairs = exact.join(first, "id").join(second, "other")
    same = holders.filter("held > 1").select(
        F.col("profile").alias("a"), F.col("profile").alias("b"), F.col("held").alias("members_a"), F.col("held").alias("members_b"),
        F.lit(1.0).alias("jaccard"),
    )
    return pairs.select("a", "b", "members_a", "members_b", "jaccard").unionByName(same)


def sample_nodes(nodes: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    """Evaluation sample: the first ``n`` nodes in the order of a seeded hash."""
    return nodes.select("id").orderBy(hash_order("id", seed), "id").limit(n)


def pair_quality(exact: DataFrame, approx: DataFrame, universe: int | Column) -> DataFrame:
    """Confusion counts of two pair tables among ``universe`` possible pairs, and their rates."""
    both = exact.select("id", "other", F.lit(1).alias("e")).join(
        approx.select("id", "other", F.lit(1).alias("a")), ["id", "other"], "full"
    )
    total = F.lit(universe) if isinstance(universe, int) else universe
    counts = both.agg(
        F.count_if(F.col("e").isNotNull() & F.col("a").isNotNull()).alias("tp"),
        F.count_if(F.col("e").isNull()).alias("fp"),
        F.count_if(F.col("a").isNull()).alias("fn"),
    ).withColumn("tn", total - F.col("tp") - F.col("fp") - F.col("fn"))

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "tp", "fp", "fn", "tn",
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def lsh_quality(sets: DataFrame, t: float = THRESHOLD, sample: int = 50, seed: int = 42, count_self: bool = False) -> DataFrame:
    """Banding against exact similarity on sampled nodes, each compared with all others.

    ``count_self`` adds the hit of every query on itself as a false positive, as an index that
    returns the query node does.
    """
    nodes = stage(sets.select("id").distinct(), "nodes")
    queries = stage(sample_nodes(nodes, sample, seed), "queries")
    exact = jaccard_against(queries, sets, t).select("id", "other")
    approx = lsh_candidates(queries, band_codes(stage(minhash(sets), "signatures")))
    asked, indexed = queries.count(), nodes.count()
    universe = asked * max(indexed - 1, 0)
    if count_self:
        approx = approx.unionByName(queries.select("id", F.col("id").alias("other")))
        universe += asked
    return pair_quality(exact, approx, universe)


def s_curve(exact: DataFrame, candidates: DataFrame, b: int = BANDS, r: int = ROWS, bins: int = 20) -> DataFrame:
    """Per similarity bin the share of pairs that became candidates, next to 1 - (1 - s^r)^b.

    ``s`` is the mean similarity of the bin.
    """
    hit = candidates.select("id", "other", F.lit(1).alias("hit"))
    place = F.least(F.floor(F.col("jaccard") * bins), F.lit(bins - 1)).cast("int")
    grouped = (
        exact.join(hit, ["id", "other"], "left")
        .groupBy(place.alias("bin"))
        .agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.coalesce("hit", F.lit(0))).alias("observed"), F.avg("jaccard").alias("s"))
    )
    theory = 1 - F.pow(1 - F.pow("s", F.lit(float(r))), F.lit(float(b)))
    return grouped.withColumn("expected", theory)
