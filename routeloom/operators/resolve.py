"""Free-text names to codes: manual table, exact name, most similar name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import before_bracket, normal_name, query_name
from ..functions.names import match_blocks
from ..session import stage
from .blocks import block_pairs
from .ranks import row_numbers

NAME_BLOCK = 512

# Reporting names whose code no spelling rule finds.
UK_OVERRIDES = {
    "GATWICK": "LGW",
    "HEATHROW": "LHR",
    "LUTON": "LTN",
    "STANSTED": "STN",
    "MANCHESTER": "MAN",
    "BIRMINGHAM": "BHX",
    "GLASGOW": "GLA",
    "EDINBURGH": "EDI",
    "BELFAST CITY (GEORGE BEST)": "BHD",
    "BELFAST INTERNATIONAL": "BFS",
    "EAST MIDLANDS INTERNATIONAL": "EMA",
    "NEWCASTLE": "NCL",
    "BRISTOL": "BRS",
    "LIVERPOOL (JOHN LENNON)": "LPL",
    "LEEDS BRADFORD": "LBA",
    "LONDON CITY": "LCY",
    "ABERDEEN": "ABZ",
    "SOUTHAMPTON": "SOU",
    "CARDIFF WALES": "CWL",
    "SOUTHEND": "SEN",
    "EXETER": "EXT",
    "ISLE OF MAN": "IOM",
    "JERSEY": "JER",
    "BOURNEMOUTH": "BOH",
    "TEESSIDE INTERNATIONAL AIRPORT": "MME",
}


def directory_of(nodes: DataFrame, name: str = "name", code: str = "code", order: str = "row_order") -> DataFrame:
    """One code per normalised name; the last row of a name wins, even without a code."""
    return (
        nodes.withColumn("name", normal_name(name))
        .filter(F.col("name").isNotNull())
        .groupBy("name")
        .agg(F.max_by(F.struct(F.col(code).alias("code")), order).alias("_last"))
        .select("name", F.col("_last.code").alias("code"))
    )


def _name_blocks(names: DataFrame) -> DataFrame:
    """Names sorted by length, in bounded blocks that know their shortest and longest."""
    numbered = row_numbers(names.withColumn("_len", F.length("name")), ["_len", "name"], "_rn")
    return stage(
        numbered.withColumn("block", F.expr(f"(_rn - 1) div {NAME_BLOCK}").cast("bigint"))
        .groupBy("block")
        .agg(F.collect_list("name").alias("names"), F.min("_len").alias("shortest"), F.max("_len").alias("longest")),
        "names",
    )


def similar_names(names: DataFrame, directory: DataFrame, cutoff: float = 0.7) -> DataFrame:
    """(name, match, score): most similar directory name of each distinct name.

    Lengths bound the similarity (2 * shorter / (shorter + longer)), so block pairs whose lengths
    are too far apart are dropped before any name is compared.
    """
    left = _name_blocks(names.select("name").distinct())
    right = _name_blocks(directory.select("name").distinct())
    heads = ["block", "shortest", "longest"]
    pairs = block_pairs(left.select(heads), right.select(heads), right.count())
    longer = F.greatest("l_longest", "r_longest")
    gap = F.greatest(F.col("l_shortest") - F.col("r_longest"), F.col("r_shortest") - F.col("l_longest"), F.lit(0))
    reachable = 2 * (longer - gap) >= F.lit(cutoff) * (2 * longer - gap)
    work = (
        pairs.filter(reachable)
        .select("l_block", "r_block")
        .join(left.select(F.col("block").alias("l_block"), F.col("names").alias("l_names")), "l_block")
        .join(right.select(F.col("block").alias("r_block"), F.col("names").alias("r_names")), "r_block")
        .repartition("l_block", "r_block")
    )
    hits = work.select(F.explode(match_blocks(cutoff)("l_names", "r_names")).alias("h"))
    return (
        hits.groupBy(F.col("h.name").alias("name"))
        .agg(F.max(F.struct("h.score", "h.match")).alias("best"))
        .select("name", F.col("best.match").alias("match"), F.col("best.score").alias("score"))
    )


def resolve_names(names: DataFrame, directory: DataFrame, overrides: dict[str, str] | None = None, cutoff: float = 0.7, name_col: str = "name") -> DataFrame:
    """(name, code, tier) per distinct name; the code is NULL where no tier finds one."""
    overrides = UK_OVERRIDES if overrides is None else overrides
    spark = names.sparkSession
    manual = spark.createDataFrame(list(overrides.items()) or [(None, None)], "full string, manual string")
    asked = names.select(F.col(name_col).alias("asked")).distinct().select(
        "asked", F.coalesce(query_name("asked"), F.lit("NAN")).alias("full")
    ).withColumn("simple", before_bracket("full"))
    exact = directory.select(F.col("name").alias("simple"), F.col("code").alias("exact"), F.lit(True).alias("_exact"))
    tiers = stage(asked.join(manual, "full", "left").join(exact, "simple", "left"), "tiers")
    open_names = tiers.filter(F.col("manual").isNull() & F.col("_exact").isNull()).select(F.col("simple").alias("name"))
    fuzzy = (
        similar_names(open_names, directory, cutoff)
        .join(directory.select(F.col("name").alias("match"), F.col("code").alias("fuzzy")), "match")
        .select(F.col("name").alias("simple"), "fuzzy")
    )
    return tiers.join(fuzzy, "simple", "left").select(
        F.col("asked").alias("name"),
        F.when(F.col("manual").isNotNull(), F.col("manual")).when(F.col("_exact"), F.col("exact")).otherwise(F.col("fuzzy")).alias("code"),
        F.when(F.col("manual").isNotNull(), F.lit("manual"))
        .when(F.col("_exact"), F.lit("exact"))
        .when(F.col("fuzzy").isNotNull(), F.lit("similar"))
        .otherwise(F.lit("none"))
        .alias("tier"),
    )
