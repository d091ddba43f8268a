"""Plain versions of the operators, for tests on small tables."""

from __future__ import annotations

import re
from collections import defaultdict

SPACES = " \t\n\v\f\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def dedup(rows, min_chars=40, min_docs=5):
    """[(n_lines, n_dropped, kept)] of [(id, text)]; a missing id is smaller than all others."""
    order = lambda i: (i is not None, i or 0)
    holders = defaultdict(set)
    lines = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda line: line.strip(SPACES).translate(FOLD)
    for i, own in lines:
        for line in own:
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    gone = {k: max(v, key=order) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, own in lines:
        stay = [x for x in own if key(x) not in gone or gone[key(x)] == i]
        out.append((len(own), len(own) - len(stay), "\n".join(stay)))
    return out


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def contamination(text, items, window=13):
    """(n_words, places of hit words, ids of items) of one text; items: [(id, text)]."""
    words = bench_words(text)
    hit, found = set(), set()
    for item, content in items:
        own = bench_words(content)
        n = min(window, len(own))
        if not n:
            continue
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    return len(words), sorted(hit), sorted(found)


def shingles(text, size=5):
    words = [w for w in re.split(r"[ \t\n\v\f\r]+", (text or "").translate(FOLD)) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def groups(rows, percent=80):
    """[(n, component)] of [(id, text)]."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return [(len(s), least.get(find(i)) if s else rows[i][0]) for i, s in enumerate(sets)]
