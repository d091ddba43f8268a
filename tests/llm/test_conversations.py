from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from routeloom.llm import chat_format, prefix_trie
from routeloom.llm.shared import Kept

COLUMNS = "conv_id long, turn long, role string, text string, code string, block int, part double, h long, ends boolean"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 0.5, 2, True) for r in rows], COLUMNS)


def odd_rows():
    """Shared beginnings, a group of equal conversations, nulls, empty and long texts, repeated rows, ties, a long conversation."""
    rng = random.Random(3)
    texts = ["", "one", "two words", "  spaced\tout \n", "é ü", "a much longer text " * 40]
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(c, t, "user", "the same") for c in range(100, 130) for t in range(3)]
    rows += [(200, t, "assistant" if t % 2 else "user", f"turn {t // 30}") for t in range(70)]
    rows += [(220, t, "assistant" if t % 2 else "user", f"turn {t // 30}") for t in range(95)]
    rows += [(61, None, "user", "first"), (61, 0, None, None), (61, 1, "assistant", None), (61, 1, "assistant", "tie"), (61, 1, "assistant", "tie")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "reply"), (-7, 0, "user", "negative id"), (301, 0, "user", "template is absent")]
    return rows


def turn_key(row):
    role, text = row[2] or "", row[3] or ""
    return row[1] is not None, row[1] or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def plain_trie(rows):
    own = defaultdict(list)
    for row in sorted((r for r in rows if r[0] is not None), key=turn_key):
        own[row[0]].append((row[2] or "", row[3] or ""))
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        giver = c - int(abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(giver, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    own_saved = {p: (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0) for p, m in members.items()}
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = own_saved[p] + sum(saved[k] for k in kids[p])
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -99, len(m), len(kids[p]), leaves[p], saved[p], digest([c for c in m if whole[c] == p]))
        for p, m in members.items()
    )


def collected(trie):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-99 if v is None else v for v in row) for row in trie.select(columns).collect())


@pytest.mark.parametrize(("width", "shard_rows"), [(32, 200_000), (3, 7), (1, 40)])
def test_prefix_trie_against_plain(spark, monkeypatch, width, shard_rows):
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", shard_rows)
    rows = odd_rows()
    assert collected(prefix_trie.prefix_trie(table(spark, rows), width=width)) == plain_trie(rows)


def test_prefix_trie_of_odd_tables(spark):
    assert prefix_trie.prefix_trie(table(spark, []).limit(0)).count() == 0
    assert prefix_trie.prefix_trie(table(spark, [(None, 0, "user", "x")])).count() == 0
    # The first turn gives way to none: conversations without turns end at the root.
    gone = [c for c in range(1, 19) if zlib.crc32(str(c).encode()) % 4 > 0][:3]
    rows = [(c, 0, "user", "x") for c in gone]
    assert collected(prefix_trie.prefix_trie(table(spark, rows))) == plain_trie(rows)


def test_turns_are_numbered_across_ranges(spark):
    rows = [(5, t, "user", str(t)) for t in range(500)] + [(4, 0, "user", "a"), (6, 0, "user", "b"), (6, 1, "user", "c")]
    kept = Kept(spark)
    turns = prefix_trie.numbered_turns(kept(prefix_trie.turn_codes(table(spark, rows)), "codes"), kept)
    assert sorted(map(tuple, turns.select("conv_id", "pos").collect())) == sorted((c, t) for c, t, *_ in rows)


def plain_chat(rows):
    """{conv_id: (turns, replies)}"""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: ([t[2:] for t in sorted(v)], [t[3] for t in sorted(v) if t[2] == "assistant"]) for c, v in own.items()}


CONTROL = ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "</s>", "<s>", "[INST]", "[/INST]", "<~s>", "[~~/INST]", "<|endoftext|>", "<|im_end", "|>", "<", "~", "[", "s>", "$1", "\\"]


def chat_rows():
    rng = random.Random(8)
    mixed = lambda: "".join(rng.choice(CONTROL) for _ in range(rng.randint(0, 9)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", mixed()]), mixed()) for c in range(40) for t in range(rng.randint(1, 5))]
    return rows + odd_rows() + [(401, 0, "user", "no reply"), (402, 0, "assistant", ""), (403, 0, "assistant", "<" * 20_000 + "~" * 20_000), (403, 1, "user", "end")]


def test_chat_examples_are_reversible(spark):
    want = plain_chat(chat_rows())
    found = chat_format.examples(table(spark, chat_rows()))
    read = found.select(
        "conv_id", "example", "text", "loss_start", "loss_end", "whole", chat_format.read_turns(F.col("text")).alias("turns"),
        chat_format.target(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("target"),
    ).collect()
    by_conv = defaultdict(list)
    for row in read:
        by_conv[row.conv_id].append(row)
    assert by_conv.keys() == want.keys()
    for c, (turns, replies) in want.items():
        own = sorted(by_conv[c], key=lambda r: r.example)
        assert [tuple(t) for t in own[-1].turns] == turns and [r.whole for r in own] == [False] * (len(own) - 1) + [True]
        taught = [r for r, last in zip(own, [False] * len(replies) + [True] * len(own)) if not last]
        assert [r.target for r in taught] == replies and all(r.loss_start == r.loss_end for r in own[len(replies):])
        for row in own:
            # All preceding turns are the context, and the mask ends where the text does, but for the end mark.
            assert [tuple(t) for t in row.turns] == turns[: len(row.turns)] and own[-1].text.startswith(row.text)


def test_chat_digest_against_plain(spark):
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    rows = chat_rows()
    want = {c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), sum(map(len, a)), sha("".join(a))) for c, (t, a) in plain_chat(rows).items()}
    got = chat_format.digest(chat_format.examples(table(spark, rows)))
    assert got.dtypes == [("conv_id", "bigint"), ("n_turns", "bigint"), ("turns_sha256", "string"), ("loss_chars", "bigint"), ("loss_sha256", "string"), ("formatted_chars", "bigint")]
    assert {r[0]: tuple(r[1:5]) for r in got.collect()} == want
    assert chat_format.digest(chat_format.examples(table(spark, rows).limit(0))).count() == 0


def test_chat_format_uses_no_python(spark):
    plan = chat_format.digest(chat_format.examples(table(spark, odd_rows())))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
