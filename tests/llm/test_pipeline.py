from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from routeloom.llm.shared import documents, kept

from . import plain

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    """Each stage on what the one before has kept; all but the last return the columns of documents."""
    docs = documents(spark, SF)
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = kept(stage(spark, docs, SF), "test")
        if name == "toxicity":
            left = {r.doc_id for r in docs.collect()}
            assert left < set(rows)
            rows = {i: t for i, t in rows.items() if i in left}
        elif name == "line dedup":
            rows = {i: out[2] for (i, _), out in zip(rows.items(), plain.dedup(list(rows.items())))}
            assert docs.filter(F.col("n_chars") != F.char_length("text")).count() == 0
        elif name == "n-gram Jaccard join":
            rows = {i: t for (i, t), (_, c) in zip(rows.items(), plain.groups(list(rows.items()))) if c == i}
        elif name == "benchmark decontamination":
            keep = {}
            for i, t in rows.items():
                n, hit, _ = plain.contamination(t, bench)
                if not (hit and 20 * len(hit) >= n):
                    keep[i] = t
            rows = keep
        if name != "best-fit packing":
            assert docs.columns == columns
            assert {r.doc_id: r.text for r in docs.collect()} == rows, name
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {r.doc_id: r.n for r in docs.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert lengths == {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows.items()}
    bins = docs.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert bins.filter("n <> end OR n > 2048").count() == 0


def test_stages_take_odd_and_empty_tables(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long, row string, score double"
    line = "A line that many documents have in common, long enough to go."
    odd = [(i, f"own words number {i}\n{line}", "en", "s", 1, "r", 0.5) for i in range(8)]
    odd += [(8, None, None, None, None, None, None), (9, "", "en", "s", 0, "r", 0.5), (None, "no id here", "en", "s", 1, "r", 0.5), (3, odd[3][1], "en", "s", 1, "r", 0.5)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, columns)
        for name, stage in corpus_pipeline.STAGES[1:]:
            before, docs = docs, kept(stage(spark, docs, SF), "test")
            if name != "best-fit packing":
                assert docs.columns == before.columns and docs.count() <= before.count()
        assert (docs.count() > 0) == bool(rows)
