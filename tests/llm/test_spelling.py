from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from routeloom.llm import spelling
from routeloom.session import stage

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, word string, n long, near string, signature int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, "z", 0) for i, t in rows], COLUMNS)


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_variants(words):
    form, out = {}, []
    for w, n in words.items():
        around = [v for v in words if v != w and near(w, v)]
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
        out.append((w, n, len(around)))
    rows = []
    for w, n, count in out:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w] or "", root, n, count, words[form[w]] if form[w] else -1))
    return sorted(rows)


def edited(rng, word):
    at, letter = rng.randrange(len(word)), rng.choice("abcdeéü")
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]])


def odd_rows():
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaab", "baaaa", "×÷ñÿÀ", "a" * 300, "a" * 299 + "b"]
    pool = stems * 6 + [edited(rng, s) for s in stems for _ in range(6)] * 3 + [edited(rng, edited(rng, s)) for s in stems] * 3
    rows = [(i, " ".join(rng.choice(pool) for _ in range(60)).capitalize()) for i in range(80)]
    return rows + [(100, None), (101, ""), (102, "Ünïcodé，中文 STRASSE straße 中straße"), (None, "no identity here"), (5, rows[5][1]), (5, rows[6][1]), (103, "long " * 20_000)]


def test_words_and_variants_against_plain(spark):
    rows = odd_rows()
    words = spelling.count_words(table(spark, rows), spoil=True)
    want = plain_counts(rows)
    assert {r.word: r.n for r in words.collect()} == want and len(want) > 200
    got = spelling.variants(words)
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    found = sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in got.collect())
    assert found == plain_variants(want)
    assert sum(r[4] for r in found) > 200 and sum(bool(r[1]) for r in found) > 50


@pytest.mark.parametrize("parts", [3, 4, 7])
def test_signatures_lose_no_near_pair(spark, parts):
    rng = random.Random(parts)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(250)}
    frame = spark.createDataFrame([(w, 3) for w in sorted(words)], "word string, n long")
    got = sorted(map(tuple, spelling.near_pairs(frame, parts).collect()))
    assert got == sorted((a, b) for a in words for b in words if a != b and near(a, b))


def test_chains_of_forms_reach_their_root(spark):
    words = {("abcdefgh"[:5] + "x" * i): 2**i for i in range(12)}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {r.root for r in got.collect()} == {"abcde" + "x" * 11}


def test_no_words(spark):
    assert spelling.variants(spelling.count_words(table(spark, odd_rows()).limit(0))).count() == 0
    assert spelling.variants(spelling.count_words(table(spark, [(1, None), (2, "1 2 3")]))).count() == 0


def test_no_table_of_words_or_signatures_is_broadcast(spark, monkeypatch, capsys):
    """A stored table of words looks small enough, its signatures are not."""
    plans, plain = [], spelling.Kept.__call__

    def kept(self, df, name):
        df.explain()
        plans.append((name, capsys.readouterr().out))
        return plain(self, df, name)

    monkeypatch.setattr(spelling.Kept, "__call__", kept)
    words = stage(spark.createDataFrame([("abcde" + c + "f" * i, 9 + i) for i in range(6) for c in "xyz"], "word string, n long"), "words")
    spelling.variants(words).explain()
    plans.append(("result", capsys.readouterr().out))
    assert "SortMergeJoin" in dict(plans)["near-words"]
    assert not [name for name, plan in plans if "BroadcastHashJoin" in plan]
