from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from routeloom.llm import decontaminate, line_dedup, ngram_join, packing
from routeloom.llm.tokens import ALNUM, NOT_SPACE, Codes, words

from . import plain

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = "doc_id long, text string, lang string, row string, score double, n long, path string, key int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "r", 0.5, 1, "p", 2) for i, t in rows], COLUMNS)


def odd_rows():
    """Null and empty texts, a missing id, repeated rows, one id with two texts, one very long text."""
    rng = random.Random(5)
    common = ["This line is long enough to count as boilerplate here.", "  THIS line is long enough to count as BOILERPLATE here.\t", "short", "", "Zeile mit Umläuten, die lang genug ist: äöüß ÄÖÜ éè"]
    rows = [(i, "\n".join(rng.choice(common) if rng.random() < 0.5 else "own " + str(rng.random()) * 3 for _ in range(rng.randint(1, 9)))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "\n\n"), (None, common[0]), (7, rows[7][1]), (8, common[0] + "\nanother text of one id, long enough to be looked at"), (43, common[4])]
    long = "\n".join(common[0] if i % 70 == 3 else f"line {i} of the long document, which repeats nothing at all" for i in range(700))
    return rows + [(44, long), (45, "word " * 60_000)]


def test_line_dedup_against_plain(spark):
    rows = odd_rows()
    docs = table(spark, rows)
    done = line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs)).select("row.doc_id", "row.text", "n_lines", "n_dropped", "kept").collect()
    want = sorted(((i, t, *r) for (i, t), r in zip(rows, plain.dedup(rows))), key=repr)
    assert sorted(map(tuple, done), key=repr) == want
    assert sum(r[3] for r in want) > 20


def test_line_dedup_keeps_columns_and_null_texts(spark):
    docs = table(spark, odd_rows())
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.filter("text IS NULL").count() == 1
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_uses_no_python(spark):
    docs = table(spark, odd_rows())
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_line_dedup_streams_a_sorted_range_layout(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(line_dedup, "kept", lambda df, name: (plans.__setitem__(name, df._jdf.queryExecution().executedPlan().toString()), df)[1])
    line_dedup.dedup_lines(table(spark, odd_rows())).count()
    plan = [row.strip(" +-:") for row in plans["repeated-lines"].splitlines()]
    start = next(i for i, row in enumerate(plan) if row.startswith("Window"))
    assert "row_number()" in plan[start] and "is_first" in plans["repeated-lines"].split("Window")[0]
    below = plan[start + 1 :]
    sort = next(i for i, row in enumerate(below) if row.startswith("Sort"))
    exchange = next(i for i, row in enumerate(below) if row.startswith("Exchange"))
    assert sort < exchange and below[exchange].startswith("Exchange rangepartitioning(h1")
    assert all(name in below[sort] for name in ("h1#", "h2#", "doc#", "pos#"))


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_line_dedup_with_and_without_hot_lines(spark, monkeypatch, share):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
    rows = odd_rows()
    docs = table(spark, rows)
    done = line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs)).select("row.doc_id", "row.text", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, done), key=repr) == sorted(((i, t, *r) for (i, t), r in zip(rows, plain.dedup(rows))), key=repr)


def items():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["Äpfel", "naïve", "x1"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    return [(i, text(rng.choice([3, 7, 13, 20, 40]))) for i in range(30)] + [(90, None), (91, "!!"), (None, text(15)), (5, text(30))]


def bench_rows():
    rng = random.Random(4)
    out = []
    for i in range(60):
        parts = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 60)))]
        if i % 3 == 0:
            parts.insert(0, (items()[rng.randrange(30)][1] or "").upper().replace(" ", " -- "))
        out.append((i, "\n".join(parts)))
    return out + [(60, None), (61, ""), (3, out[3][1]), (None, items()[4][1])]


@pytest.mark.parametrize("slice_chars", [10**9, 900])
def test_contamination_against_plain(spark, slice_chars):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    rows = bench_rows()
    found = decontaminate.contamination(table(spark, rows), bench, slice_chars=slice_chars).select("row.doc_id", "text", "n_words", "hit_words", "items").collect()
    want = [(i, t, *plain.contamination(t, items())) for i, t in rows]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert sum(bool(w[3]) for w in want) > 15


def test_contamination_digest_and_removal(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    docs = table(spark, bench_rows())
    want = {}
    for i, t in bench_rows():
        n, hit, found = plain.contamination(t, items())
        want[(i, n, len(hit), len(found), decontaminate.sha256_of(found), len(hit) > 0 and 20 * len(hit) >= n)] = t
    got = decontaminate.digest(decontaminate.contamination(docs, bench)).distinct().collect()
    assert {tuple(r) for r in got} == set(want)
    left = decontaminate.remove_documents(docs, bench)
    assert left.columns == docs.columns
    assert {r.text for r in left.collect()} == {t for k, t in want.items() if not k[5]}
    cut = decontaminate.remove_spans(docs, bench)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    for before, after in zip(sorted(bench_rows(), key=repr), sorted(((r.doc_id, r.text) for r in cut.collect()), key=repr)):
        if before[1] is not None and before[0] != 3:
            _, hit, _ = plain.contamination(before[1], items())
            assert plain.bench_words(after[1]) == [w for k, w in enumerate(plain.bench_words(before[1])) if k not in hit] or after[0] != before[0]


def test_contamination_of_empty_tables(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    docs = table(spark, bench_rows())
    assert decontaminate.remove_documents(docs.limit(0), bench).count() == 0
    assert decontaminate.digest(decontaminate.contamination(docs, bench.limit(0))).filter("n_hit > 0 OR contaminated").count() == 0


def test_words_match_the_pattern():
    texts = ["", "a", "Ab1-c ÄÖ_x\n\n 9", None, "x" * 3_000_000 + " y", "ééé é"] + [f"t{i} u{i % 3}" for i in range(1000)]
    got = []
    for part in words(pa.array(texts), ALNUM):
        raw = part.data.tobytes()
        edges = part.bounds()
        got += [[raw[part.start[k] : part.end[k]].decode() for k in range(edges[i], edges[i + 1])] for i in range(part.rows)]
    assert got == [plain.bench_words(t) for t in texts]


def test_equal_words_have_equal_codes_and_others_do_not():
    part = next(words(pa.array(["a b a", "b ab a", "aa"]), NOT_SPACE))
    a, b, a2, b2, ab, a3, aa = part.code
    assert a == a2 == a3 and b == b2 and len({int(x) for x in (a, b, ab, aa)}) == 4
    place, code = part.grams(2)
    assert place.tolist() == [0, 1, 3, 4] and len(set(code.tolist())) == 4
    known = Codes(part.code[[0, 3]])
    assert known.find(part.code)[0].tolist() == [0, 1, 2, 3, 5]
    assert Codes(np.empty(0, np.uint64)).find(part.code)[0].tolist() == []


def near_rows():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for g in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 120, 400]))]
        rows.append((g * 20, " ".join(base)))
        for k in range(1, rng.choice([2, 4, 12])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 30))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                own = own[: max(5, int(len(own) * 0.9))]
            rows.append((g * 20 + k, " ".join(own).upper() if rng.random() < 0.2 else "\n ".join(own)))
    rows += [(500 + i, " ".join(passage + [rng.choice(vocabulary) for _ in range(40 + i)])) for i in range(30)]
    chain = [rng.choice(vocabulary) for _ in range(104)]
    rows += [(600 + i, " ".join(chain[: 60 + 8 * i])) for i in range(6)]
    rows += [(700, "one two"), (701, "ONE  two"), (702, "one"), (703, None), (704, ""), (705, " \t"), (700, "one two"), (None, "one two"), (706, "a " * 50_000), (707, "a " * 40_000)]
    return rows


def test_ngram_join_against_plain(spark):
    rows = near_rows()
    got = ngram_join.similar_groups(table(spark, rows)).collect()
    want = [(i, n, c) for (i, _), (n, c) in zip(rows, plain.groups(rows))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert len({c for _, _, c in want}) < len(rows) - 30


def test_ngram_join_with_frequent_grams_and_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "MIN_FREQUENT", 2)
    monkeypatch.setattr(ngram_join, "MIN_IN_BATCH", 2)
    monkeypatch.setattr(ngram_join, "PER_BUCKET", 50)
    monkeypatch.setattr(ngram_join, "HOT_RANK", 2)
    monkeypatch.setattr(ngram_join, "HUB_ROUNDS", 1)
    rows = near_rows()
    got = ngram_join.similar_groups(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, n, c) for (i, _), (n, c) in zip(rows, plain.groups(rows))), key=repr)


def test_ngram_join_keeps_one_of_each_group(spark):
    rows = [r for r in near_rows() if r[0] is not None]
    docs = table(spark, rows)
    left = ngram_join.keep_one(docs)
    want = {i for (i, _), (_, c) in zip(rows, plain.groups(rows)) if i == c}
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == want
    assert ngram_join.keep_one(docs.limit(0)).count() == 0


def test_ngram_join_of_a_large_group_of_near_copies(spark):
    """Copies with none to many edits: a chain of links, members beyond the threshold, few pairs proposed."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(i % 7):
            own[rng.randrange(len(own))] = rng.choice(["x", "y", f"z{i}"])
        rows.append((i, " ".join(own)))
    got = ngram_join.similar_groups(table(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted((i, n, c) for (i, _), (n, c) in zip(rows, plain.groups(rows)))
    join = ngram_join.NgramJoin(table(spark, rows))
    named = join.grams.withColumn("label", F.col("vertex"))
    assert join._hub_pairs(named, None).count() <= named.select("vertex").distinct().count()


def near_misses(n: int) -> list[tuple[int, str]]:
    """Texts that share most with all others, but link with few: each has three words of its own in one base."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(n):
        own = list(base)
        for k, at in enumerate(rng.sample(range(29), 3)):
            own[5 * at + 2] = f"z{i}-{k}"
        rows.append((i, " ".join(own)))
    return rows


def test_ngram_join_of_a_large_group_just_below_the_threshold(spark):
    rows = near_misses(150)
    join = ngram_join.NgramJoin(table(spark, rows))
    asked, plainly = [], join._links
    join._links = lambda pairs: (asked.append(pairs.count()), plainly(pairs))[1]
    got = sorted(map(tuple, join.rows().collect()))
    assert got == sorted((i, n, c) for (i, _), (n, c) in zip(rows, plain.groups(rows)))
    assert len({c for _, _, c in got}) > 100 and sum(asked) < 10 * len(rows)


def test_ngram_join_by_parities_in_small_slots(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW", 0)
    monkeypatch.setattr(ngram_join, "PER_SLOT", 2)
    monkeypatch.setattr(ngram_join, "HUB_ROUNDS", 1)
    rows = near_rows() + [(1000 + i, text) for i, text in near_misses(20)]
    got = ngram_join.similar_groups(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, n, c) for (i, _), (n, c) in zip(rows, plain.groups(rows))), key=repr)


def test_parities_differ_no_more_than_the_sets(spark):
    rows = near_misses(12) + [(50 + i, " ".join(f"v{j}" for j in range(3 + 40 * i))) for i in range(6)]
    join = ngram_join.NgramJoin(table(spark, rows + [(90 + i, text + f" end{i}") for i, (_, text) in enumerate(rows)]))
    sets = {}
    for r in join.sets.filter(F.col("fragment") != ngram_join.HALF).collect():
        sets.setdefault(r.vertex, set()).update(np.frombuffer(r.keys, np.uint64).tolist())
    found = {r.vertex: r[1:] for r in join._parities(join.able.select("vertex")).collect()}
    assert len(found) == join.able.count() > 20
    for a in found:
        for b in found:
            differ = sum(((x ^ y) % 2**64).bit_count() for x, y in zip(found[a], found[b]))
            assert differ <= len(sets[a] ^ sets[b]) and differ % 2 == len(sets[a] ^ sets[b]) % 2


def test_ngram_join_meets_one_copy_of_a_set_and_moves_the_sets_of_pairs_only(spark, monkeypatch):
    """Copies without an id are all stored; each pair meets one of them, and sets without a pair stay where they are."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    rows = [(None, " ".join(base))] * 12
    for i in range(12):
        own = list(base)
        for _ in range(1 + i % 6):
            own[rng.randrange(len(own))] = f"z{i}"
        rows.append((i, " ".join(own)))
    seen, plainly = [], ngram_join._met

    def met(pairs, sets):
        found = plainly(pairs, sets)
        ends = {v for r in pairs.collect() for v in (r.a, r.b)}
        seen.append((found.count(), found.select("a", "b", "fragment").distinct().count(), {r.vertex for r in sets.collect()} - ends))
        return found

    monkeypatch.setattr(ngram_join, "_met", met)
    join = ngram_join.NgramJoin(table(spark, rows))
    assert join.sets.filter(F.col("fragment") == ngram_join.HALF).count() >= 12
    got = {r.doc_id: r.component for r in join.rows().collect() if r.doc_id is not None}
    assert got == {i: c for (i, _), (_, c) in zip(rows, plain.groups([(99 if i is None else i, t) for i, t in rows])) if i is not None}
    assert any(n for n, _, _ in seen) and all(n == once and not other for n, once, other in seen)


def test_keep_one_judges_the_texts_of_one_id_and_repeated_rows(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(60))
    text = lambda rows: sorted(((r.doc_id, r.text) for r in ngram_join.keep_one(table(spark, rows)).collect()), key=repr)
    assert text([(1, b), (2, a), (2, b + " extra")]) == [(1, b), (2, a)]
    assert text([(None, a), (None, a), (None, b), (3, b)]) == [(3, b), (None, a)]
    assert text([(4, a), (4, a), (5, a.upper()), (6, None), (6, None), (7, "")]) == [(4, a), (6, None), (6, None), (7, "")]
    assert text([(8, a), (8, a + "  ")]) in ([(8, a)], [(8, a + "  ")])


def test_overlap_of_two_texts():
    a, b = "a b c d e f g", "b c d e f g h"
    assert ngram_join.overlap(a, b) == (2, 4)


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 8)]
    got = {r.vertex: r.label for r in ngram_join.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


ODD_TEXTS = [
    "Plain words, it's o'clock'll 12 x1y2 -- ?!...", "ÄÖÜ straße ÇA l'été déjà-vu ¿qué?", "naïve café", "Ελληνικά και Σίγμα τέλοΣ", "中文 text 和 words",
    "emoji 🙂🙂 and ​ zero", "<|startoftext|> special <|ENDOFTEXT|>", "a b\x1cc\x85d", "x" * 500 + " " + "é" * 100, "İstanbul ŉ ſ ŒUVRE ½ ²3", "", "\n\t \r\n", "''s 's'T'D",
]


def test_encoder_equals_the_tokenizer():
    whole = Tokenizer.from_file(VOCABULARY)
    encode = packing.Encoder(VOCABULARY)
    rng = random.Random(2)
    letters = "abcXYZ ''st.,!?12é Üßñ²\n\t-_$*"
    texts = ODD_TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    for text in texts:
        assert np.frombuffer(encode(text), np.uint32).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_packing_round_trip(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "Gamma", "x9", "straße"]) for _ in range(rng.choice([1, 5, 30, 90, 200])))) for i in range(400)]
    rows += [(400, None), (401, ""), (5, rows[5][1]), (None, "no id"), (402, "long " * 3000)] + [(500 + i, t) for i, t in enumerate(ODD_TEXTS)]
    docs = table(spark, rows)
    got = packing.pack_documents(docs, VOCABULARY, length=128, part_pieces=200).toPandas()
    whole = Tokenizer.from_file(VOCABULARY)
    want = []
    for i, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 128)):
            part = np.array(ids[at : at + 128], "<u4")
            want.append((i, k, at, len(part), __import__("zlib").crc32(part.tobytes())))
    missing = lambda x: None if x != x else int(x)
    assert sorted(((missing(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()), key=repr) == sorted(want, key=repr)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() <= 128
    assert got["length"].sum() / 128 / got["sequence_id"].nunique() > 0.97
    assert packing.pack_documents(docs.limit(0), VOCABULARY).count() == 0


def test_sum_of_squares_takes_the_smallest_sum():
    rng = np.random.default_rng(1)
    length, sizes = 20, np.random.default_rng(2).integers(1, 21, 300)
    bins, offsets = packing.sum_of_squares(sizes, length)
    fill = {}
    for size, b, at in zip(sizes, bins, offsets):
        assert fill.get(b, 0) == at and at + size <= length

        def squares(target):
            gaps = np.bincount([length - v for v in ({**fill, target: fill.get(target, 0) + size}).values()], minlength=length + 1)
            return int((gaps[1:length] ** 2).sum())

        fits = [b for b, v in fill.items() if v + size <= length] + [-1]
        assert squares(b) == min(map(squares, fits))
        fill[b] = at + size
    del rng


def test_operators_import_nothing_from_elsewhere_in_the_library():
    package = Path(packing.__file__).parents[1]
    for path in package.rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path


@pytest.fixture(autouse=True)
def _few_tasks(spark):
    assert spark.range(1).select(F.lit(1)).count() == 1
