"""One query per operator over its whole table, with production parameters, and the SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, html_text, language, line_dedup, ngram_join, packing, prefix_trie, quality, secrets, spelling, topk, toxicity
from .shared import documents, fold_of

# Upper and lower letters A to Z for SQL's translate().
_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    done = line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs))
    return done.select(F.col("row.doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_FOLD}) AS key
  FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN repeated USING (key) GROUP BY doc_id
"""


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select(F.col("row.page_id"), F.col("row.url"), F.col("main").alias("text"), F.char_length("main").cast("long").alias("n_chars"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(documents(spark, sf_dir).select("doc_id", "text")))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, F.col("id") % 20 == 0, 20).withColumnRenamed("id", "vec_id")


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.digest(decontaminate.contamination(documents(spark, sf_dir), bench))


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = rf"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) AS n FROM item WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS gram
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM sized)),
lengths AS (SELECT DISTINCT n FROM windows),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
grams AS (
  SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM doc, lengths WHERE len(w) >= n)),
found AS (SELECT doc_id, grams.n, k, item_id FROM grams JOIN windows ON grams.n = windows.n AND grams.gram = windows.gram),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, fold_of("doc_id", 3) != 1)
    return _scored(toxicity.score(docs.select("doc_id", "text"), model), fold_of("row.doc_id", 3) == 1)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language.predict(docs.select("doc_id", "text"), language.train(docs, fold_of("doc_id", 4) != 2))
    return found.select(F.col("row.doc_id"), (fold_of("row.doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, fold_of("doc_id", 4) != 2)
    return _scored(quality.score(docs.select("doc_id", "text"), model), fold_of("row.doc_id", 4) == 2)


def _scored(found: DataFrame, held_out) -> DataFrame:
    return found.select(
        F.col("row.doc_id"), held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ngram_join.similar_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


OP9_SQL = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '[^\x20\x09-\x0D]+') AS w FROM documents),
gram AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM doc WHERE len(w) > 0)),
sized AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM met JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
edge AS (SELECT a AS src, b AS dst FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT DISTINCT src AS doc_id, src AS other FROM edge
  UNION
  SELECT reach.doc_id, edge.dst FROM reach JOIN edge ON reach.other = edge.src)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(doc_id, smallest), doc_id) AS component_id
FROM doc LEFT JOIN sized USING (doc_id)
LEFT JOIN (SELECT doc_id, min(other) AS smallest FROM reach GROUP BY doc_id) USING (doc_id)
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# crc32 of a short ASCII text, bit by bit.
_CRC32 = """xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length({0}) + 1), lambda i: ord({0}[i])::UBIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)))"""
OP11_SQL = rf"""
WITH turns AS (
  SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS giver, {_CRC32.format("(conv_id::VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
given AS (SELECT convs.conv_id, pos, t, w FROM convs JOIN turns ON turns.conv_id = giver AND pos < h),
heads AS (SELECT conv_id, count(*) AS g FROM given GROUP BY conv_id),
rebuilt AS (
  SELECT * FROM given UNION ALL
  SELECT conv_id, pos - h::BIGINT + coalesce(g, 0), t, w FROM turns JOIN convs USING (conv_id) LEFT JOIN heads USING (conv_id) WHERE pos >= h),
paths AS (
  SELECT conv_id, coalesce(list(t ORDER BY pos) FILTER (t IS NOT NULL), []) AS p, coalesce(list(w ORDER BY pos) FILTER (t IS NOT NULL), []) AS ws
  FROM convs LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id),
member AS (
  SELECT conv_id, d AS depth, array_to_string(list_slice(p, 1, d), ',') AS path, array_to_string(list_slice(p, 1, d - 1), ',') AS up,
         coalesce(ws[d], 0) AS w, len(p) = d AS ends
  FROM (SELECT *, unnest(range(0, len(p) + 1)) AS d FROM paths)),
node AS (
  SELECT depth, path, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM member GROUP BY depth, path),
kids AS (SELECT up AS path, depth - 1 AS depth, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1, 2),
known AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (path, depth)),
under AS (
  SELECT member.depth, member.path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * known.w)::BIGINT AS saved_tokens
  FROM known JOIN member ON member.conv_id = known.conv_id AND member.depth <= known.depth GROUP BY 1, 2)
SELECT known.conv_id, known.depth, parent.conv_id AS parent_conv_id, known.n_convs, known.n_children, n_leaves, saved_tokens, known.ends_sha256
FROM known JOIN under USING (depth, path) LEFT JOIN node parent ON parent.path = known.up AND parent.depth = known.depth - 1
"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(documents(spark, sf_dir), spoil=True))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, chat_format.REPLY, said)], "conv_id long, turn long, role string, text string")
    return chat_format.digest(chat_format.examples(conversations.select(own.columns).unionByName(own)))


_ESCAPE = "'([<\\[])(~*(?:/?s>|/?INST\\]|\\|(?:im_start|im_sep|im_end|endoftext)\\|>))', '\\1~\\2', 'g'"
OP13_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
  SELECT *, row_number() OVER own AS place, count(*) OVER (PARTITION BY conv_id) AS n,
         32 + length(regexp_replace(role, {_ESCAPE})) + length(regexp_replace(text, {_ESCAPE})) AS chars
  FROM said WINDOW own AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
grown AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM placed)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (role = 'assistant' OR place = n))::BIGINT AS formatted_chars
FROM grown GROUP BY conv_id
"""


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_html_text": op2_html_text,
    "op3_secrets": op3_secrets,
    "op4_topk": op4_topk,
    "op5_decontaminate": op5_decontaminate,
    "op6_toxicity": op6_toxicity,
    "op7_language": op7_language,
    "op8_packing": op8_packing,
    "op9_ngram_join": op9_ngram_join,
    "op10_quality": op10_quality,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_spelling": op12_spelling,
    "op13_chat_format": op13_chat_format,
}
ORACLES = {"op1_line_dedup": OP1_SQL, "op4_topk": OP4_SQL, "op5_decontaminate": OP5_SQL, "op9_ngram_join": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op13_chat_format": OP13_SQL}
