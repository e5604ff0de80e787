"""Spelling variants against brute force, over all pairs of a small vocabulary."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from dwell.llm import spelling
from dwell.llm.spelling import Tree, Words, count_words, near_words, roots, spelling_groups

SCHEMA = "doc_id long, text string, word string, n string, h int, run string"


def apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def vocabulary():
    rnd = random.Random(9)
    letters = "abcdeéßÿ×"
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(150)}
    for w in sorted(words):
        for _ in range(3):
            i = rnd.randrange(len(w) + 1)
            words.add(rnd.choice([w[:i] + rnd.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[: i - 1] + rnd.choice(letters) + w[i:] if i else w]))
    words |= {"".join(p) for p in ("aabb", "abab", "abba", "baab", "baba", "bbaa")}  # one vector
    words |= {"x" * 5000, "x" * 4999, "x" * 2500 + "y" + "x" * 2499}
    return {w: rnd.choice([3, 4, 8, 9, 20, 45, 100]) for w in sorted(words) if w}


@pytest.mark.parametrize(("cell", "sample"), [(16_384, 65_536), (20, 65_536), (3, 60)])
def test_near_words_equal_brute_force(spark, cell, sample):
    words = vocabulary()
    want = {(a, b, words[b]) for a in words for b in words if apart(a, b)}
    got = [tuple(r) for r in near_words(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3), cell, sample).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_cell_that_counts_cannot_part_is_dealt(spark):
    """Hundreds of words of the same letters, and as many with one letter more."""
    rnd = random.Random(2)
    words = set()
    while len(words) < 300:
        w = list("aaaabbbbcc")
        rnd.shuffle(w)
        words.add("".join(w))
    words |= {w[:3] + "d" + w[3:] for w in words} | {w[:3] + "d" + w[4:] for w in words}
    want = {(a, b) for a in words for b in words if apart(a, b)}
    got = [(r[0], r[1]) for r in near_words(spark.createDataFrame([(w, 3) for w in words], "word string, n long"), 40).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_search_opens_every_box_in_reach():
    words = sorted(vocabulary())
    w = Words.of(words)
    tree, rows = Tree.grow(w, 5)
    assert sorted(np.concatenate(rows).tolist()) == list(range(len(words))) and all((tree.leaf_of(w)[r] == k).all() for k, r in enumerate(rows))
    leaf = tree.leaf_of(w)
    for longer in (0, 1):
        open_ = collections.defaultdict(set)
        for k, asked in tree.search(w, np.arange(len(words)), longer):
            for q in asked.tolist():
                open_[q].add(k)
        assert all(leaf[j] in open_[i] for i, a in enumerate(words) for j, b in enumerate(words) if len(b) == len(a) + longer and apart(a, b))
        assert sum(map(len, open_.values())) < len(words) * tree.leaves / 2


def grouped(words):
    near = {w: [x for x in words if apart(w, x)] for w in words}
    out = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        out[w] = best if best is not None and words[best] >= 2 * n else None
    rows = set()
    for w, n in words.items():
        root = w
        while out[root]:
            root = out[root]
        rows.add((w, out[w], root, n, len(near[w]), words[out[w]] if out[w] else None))
    return rows


def test_groups_equal_brute_force_over_texts(spark):
    rnd = random.Random(4)
    base = ["colour", "color", "colours", "gréyé", "Straße", "Étions", "ab", "abcd"] + ["w" + c * k for c in "abcé" for k in (4, 5, 6)]
    texts = [(i, " ".join(rnd.choice(base).upper() if rnd.random() < 0.2 else rnd.choice(base) for _ in range(60)) + "x-y_z 12 日本 ") for i in range(120)]
    texts += [(3, texts[3][1]), (None, texts[4][1] + " colour"), (200, None), (201, ""), (202, "1 2 3"), (203, "longest " * 30_000)]
    counts = collections.Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = None if i is None else zlib.crc32(f"{i}:{run}".encode())
            counts[run if h is None or h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    docs = spark.createDataFrame([(i, t, "w", "n", 1, "r") for i, t in texts], SCHEMA).repartition(3)
    got = count_words(docs, 5, 3, 97)
    assert {r["word"]: r["n"] for r in got.collect()} == words
    assert {tuple(r) for r in spelling_groups(got).collect()} == grouped(words)
    assert count_words(docs.limit(0)).count() == 0 and spelling_groups(got.limit(0)).count() == 0


def test_groups_equal_brute_force_and_odd_words_take_no_part(spark):
    words = vocabulary()
    rows = [(w, n - 1, "a") for w, n in words.items()] + [(w, 1, "b") for w in words] + [(None, 9, "c"), ("", 9, "c"), ("two words", 9, "c")]
    assert {tuple(r) for r in spelling_groups(spark.createDataFrame(rows, "word string, n long, form string")).collect()} == grouped(words)
    with pytest.raises(ValueError):
        spelling_groups(spark.createDataFrame(rows, "word string, n long, form string"), ratio=1)


def test_roots_of_long_chains(spark):
    chain = [(str(i), str(i + 1)) for i in range(13)] + [("b" + str(i), "5") for i in range(20)]
    got = dict(map(tuple, roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert got == {w: "13" for w, _ in chain}
    assert spelling.hash_of("é".encode("latin-1")) == 0xE9
