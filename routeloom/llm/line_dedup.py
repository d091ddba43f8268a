"""Line dedup across documents, in DataFrame functions only.

Long lines become 128-bit hashes with their document and position. The hashes are range-partitioned by hash and document,
so that a hash of any size spreads over as many partitions as it needs, and sorted within by hash, document and position. A window
over that order streams the rows and marks the first occurrence in each document; one row per hash and task
then says how many documents hold a line and which of them keeps it. What comes back is a compressed bitmap per document, never text: 64
lines per number, and only the numbers in which some line goes.

Defined results: a null or empty text is one empty line. ``min_chars`` counts code points of the stripped, lower-cased
line. Rows that share an ``doc_id`` count as one document for ``min_docs`` and keep or lose a line together; each row gets
its own bitmap. A null ``doc_id`` is a document of its own, smaller than all others. Extra columns are ignored here and kept by
:func:`apply_bitmaps`, clashing names included. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import kept, kept_counted, partitions

# A line with more than this share of all long lines is looked up without a shuffle.
HOT_SHARE = 0.001
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), position % 64)


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, body, n_dropped, gone): the lines each document loses; documents that lose none have no row.

    ``doc`` is the id, ``body`` the 64-bit hash of the text (it tells rows of one id apart), ``gone`` a map from
    ``position div 64`` to a number whose bit ``position mod 64`` is set for each lost line.
    """
    spark = docs.sparkSession
    key = F.col("key")
    hashed = (
        docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("body"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
        .select("doc", "body", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.char_length(key) >= min_chars)
        .select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"), "doc", "body", "pos")
    )
    hashed, total = kept_counted(hashed, "line-hashes")
    # Sorted by hash, document and position; the range partitioning already holds all rows of (h1, h2, doc) together, so
    # that the window streams over that order without a further exchange.
    ranged = hashed.repartitionByRange(partitions(spark), "h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "pos")
    nth = F.row_number().over(Window.partitionBy("h1", "h2", "doc").orderBy("pos"))
    streamed = ranged.select("h1", "h2", "doc", (nth == 1).alias("is_first"))
    repeated = (
        streamed.groupBy("h1", "h2")
        .agg(F.count_if("is_first").alias("n_docs"), F.max("doc").alias("keeper"), F.count(F.lit(1)).alias("n_rows"))
        .filter(F.col("n_docs") >= min_docs)
    )
    repeated = kept(repeated.select("h1", "h2", "keeper", "n_rows"), "repeated-lines")
    # Lines with more than this share of all rows, by counting 1 / HOT_SHARE at most, meet their keeper where they stand.
    hot = F.broadcast(repeated.filter(F.col("n_rows") > total * HOT_SHARE).select("h1", "h2", F.struct("keeper").alias("hot")))
    marked = hashed.join(hot, ["h1", "h2"], "left")
    rest = marked.filter(F.col("hot").isNull()).join(repeated.select("h1", "h2", "keeper"), ["h1", "h2"])
    there = marked.filter(F.col("hot").isNotNull()).withColumn("keeper", F.col("hot.keeper"))
    lost = there.unionByName(rest).filter(~F.col("doc").eqNullSafe(F.col("keeper")))
    words = lost.groupBy("doc", "body", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(
        F.bit_or(_bit(F.col("pos"))).alias("bits")
    )
    return words.groupBy("doc", "body").agg(
        F.sum(F.bit_count("bits")).alias("n_dropped"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "bits")))).alias("gone"),
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` as (row, n_lines, n_dropped, kept): ``row`` holds its columns unchanged, ``kept`` the text without lost lines."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    left = docs.select(row, F.col(id_col).alias("_doc"), F.xxhash64(text_col).alias("_body"))
    joined = left.join(bitmaps, left["_doc"].eqNullSafe(bitmaps["doc"]) & (left["_body"] == bitmaps["body"]), "left")
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    lines = lines_of(F.col(f"row.`{text_col}`"))
    n_words = F.floor((F.size(lines) + 63) / 64).cast("int")
    unpacked = F.transform(F.sequence(F.lit(0), n_words - 1), lambda w: F.coalesce(F.try_element_at("gone", w), F.lit(0).cast("long")))
    flagged = joined.select("row", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.size(lines).cast("long").alias("n_lines"), F.when(F.col("gone").isNotNull(), unpacked).alias("flags"))
    stays = F.filter(lines, lambda line, i: F.get("flags", F.floor(i / 64).cast("int")).bitwiseAND(_bit(i)) == 0)
    return flagged.select("row", "n_lines", "n_dropped", F.when(F.col("flags").isNull(), text).otherwise(F.array_join(stays, "\n")).alias("kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with the text cut to the kept lines. A null text stays null."""
    done = apply_bitmaps(docs, line_bitmaps(docs, id_col, text_col, min_chars, min_docs), id_col, text_col)
    text = F.when(F.col("row")[text_col].isNotNull(), F.col("kept"))
    return done.select(*[(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
