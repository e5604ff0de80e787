"""Operators that SQL cannot express, and the pipeline, against plain loops over whole small tables."""

import collections
import math
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from dwell.llm import bpe, langid, mixing
from dwell.llm.queries import QUERIES
from test_text_operators import WORD, components, corpus, lower

DIR = "/root/testdata/sf0.001"
WS = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "source").collect()]


def chained(*parts):
    """Hash of several strings, each seeded by the one before; nulls change nothing."""
    h = 42
    for p in parts:
        if p is not None:
            h = xxhash.xxh64_intdigest(p.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def targets(rows, weights=(5, 2, 1)):
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted(s for s in size if s is not None) + [s for s in size if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] > 2 * size[s]}
        if not full:
            target |= {s: share * weight[s] for s in free}
            break
        target |= {s: 2.0 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        free -= full
    return size, order, target


def mixed(rows, block=512):
    """(row, pass, from word, words, slot) for every piece of the mix; rows are (doc_id, text, source)."""
    size, order, target = targets(rows)
    whole = {s: math.floor(target[s] + 0.5) for s in order}
    total, upto, edges = sum(target.values()), 0.0, []
    if not total:
        return []
    for s in order:
        upto += target[s]
        edges.append(math.floor(upto / total * 2**31 + 0.5))
    slots, had, at = math.ceil(total / block), collections.Counter(), {}
    for j in range(slots):
        x = j % 2**31 * mixing.GOLDEN_31 % 2**31
        s = next(s for s, e in zip(order, edges) if x < e)
        at[s, had[s]] = j
        had[s] += 1
    for s in order:
        for r in range(had[s], math.ceil(whole[s] / block)):
            at[s, r] = slots + r
    out = []
    for s in order:
        own = []
        for i, (d, t, src) in enumerate(rows):
            n = len(WORD.findall(t or ""))
            if src == s and n:
                d = None if d is None else str(d)
                h = chained(d, t)
                own.append(((h % 16, h, rows[i][0] is not None, rows[i][0] or 0, chained("second half", d, t), n), i, n))
        begin = 0
        for p in (0, 1):
            for _, i, n in sorted(own):
                a, b = begin, min(begin + n, whole[s])
                begin += n
                while a < b:
                    upto = min(b, (a // block + 1) * block)
                    out.append((i, p, n - (begin - a), upto - a, at[s, a // block]))
                    a = upto
    return out


def test_mix_query_equals_plain_loops(spark, documents):
    size, _, target = targets(documents)
    want = collections.Counter()
    pieces = collections.defaultdict(list)
    for i, _, _, n, slot in mixed(documents):
        pieces[i].append((n, slot))
    for i, (d, t, s) in enumerate(documents):
        p = pieces[i]
        want[d, len(WORD.findall(t or "")), size[s], round(target[s], 6), sum(n for n, _ in p), min((x for _, x in p), default=None), len({x for _, x in p})] += 1
    got = QUERIES["op6_mix_sources"](spark, DIR).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"], r["first_slot"], r["n_slots"]) for r in got) == want


def test_every_first_part_of_the_mix_keeps_the_shares(spark, documents):
    block = 64
    _, _, target = targets(documents)
    share = {s: t / sum(target.values()) for s, t in target.items()}
    _, mix = mixing.mix_sources(spark.read.parquet(f"{DIR}/documents.parquet"), block=block)
    source = {d: s for d, _, s in documents}
    words, total = collections.Counter(), 0
    for r in mix.orderBy("slot").collect():
        words[source[r["doc_id"]]] += r["n_words"]
        total += r["n_words"]
        assert all(abs(words[s] - x * total) <= 5 * block for s, x in share.items())


def copies(rows, block=512):
    """(text, row) for every row of the mix, in its order."""
    each = collections.defaultdict(lambda: [math.inf, 0])
    for i, p, _, n, slot in mixed(rows, block):
        x = each[i, p]
        x[0], x[1] = min(x[0], slot), x[1] + n
    out = []
    for (i, p), (slot, n) in each.items():
        d, t, _ = rows[i]
        ends = [m.end() for m in WORD.finditer(t)]
        out.append((slot, chained(None if d is None else str(d), t), p, t if n == len(ends) else t[: ends[n - 1]], i))
    return [(t, i) for _, _, _, t, i in sorted(out)]


def test_mix_keeps_order_and_white_space(spark):
    rows = [r for r in dict.fromkeys(corpus())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.lit(0).cast("long"))
    got = [(r["text"], r["doc_id"]) for r in mixing.apply_mix(docs, block=64).collect()]
    assert got == [(t, rows[i][0]) for t, i in copies(rows, 64)]


def test_language_query_equals_plain_encoding(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang")
    learned = langid.fit_dictionaries(docs.filter(~langid.held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull()))
    models = {}
    for lang, d in learned.items():
        models[lang] = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in QUERIES["op2_language_id"](spark, DIR).collect():
        t = text[r["doc_id"]]
        if not any(c.isalpha() for c in t or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        data = t.lower().encode()
        sizes = sorted((sum(len(m.compress(data[i : i + 2048])) for i in range(0, len(data), 2048)), lang) for lang, m in models.items())
        assert r["lang_pred"] == sizes[0][1] and abs(r["score"] - (sizes[1][0] - sizes[0][0]) / sizes[1][0]) < 1e-12


def units(text):
    """(start, stop, normal form) of lines and of sentences of six words, for texts of Latin letters."""
    at, out = 0, []
    for line in text.split("\n"):
        words = line.lower().split()
        if words:
            out.append((at, min(at + len(line) + 1, len(text)), " ".join(words)))
            for m in re.finditer(r"[^.!?]+(?:[.!?]+\s*)*", line):
                own = m.group().lower().split()
                if len(own) >= 6 and len(m.group()) < len(line) and len(words) >= 6:
                    out.append((at + m.start(), at + m.end(), " ".join(own)))
        at += len(line) + 1
    return out


def test_substring_query_equals_plain_loops(spark, documents):
    seen, want = set(), {}
    assert all(ord(c) < 0x500 or not c.isalpha() for _, t, _ in documents for c in t or "")
    first = {}
    for d, t, _ in sorted(documents, key=lambda r: r[0]):
        for a, _, u in sorted(units(t or "")):
            first.setdefault(u, (d, a))
    for d, t, _ in documents:
        gone = sorted((a, b) for a, b, u in units(t or "") if first[u] != (d, a))
        left, at = [], 0
        for a, b in gone:
            left.append((t or "")[at:a])
            at = max(at, b)
        want[d] = xxhash.xxh64(("".join(left) + (t or "")[at:]).encode()).hexdigest(), bool(gone)
        seen.add(d)
    from dwell.llm.substring_dedup import substring_dedup

    got = substring_dedup(spark.read.parquet(f"{DIR}/documents.parquet")).collect()
    assert {r["doc_id"]: (xxhash.xxh64((r["text"] or "").encode()).hexdigest(), bool(r["spans"])) for r in got} == want


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_neighbour_query_recall_on_the_given_vectors(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{d}/embeddings.parquet").collect() if r["embedding"] is not None}
    rows = {i: np.array(v, float) for i, v in rows.items() if all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids, x = np.array(sorted(rows)), np.array([rows[i] for i in sorted(rows)])
    found = collections.defaultdict(list)
    for r in QUERIES["op7_nearest_neighbours"](spark, d).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"]))
        assert abs(r["score"] - rows[r["query_id"]] @ rows[r["vec_id"]]) < 1e-9
    hits = total = 0
    for i in ids[ids % 20 == 0].tolist():
        s = x @ rows[i]
        s[ids == i] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[: min(20, len(ids) - 1)]].tolist())
        hits, total = hits + len(best & {v for _, v in found[i]}), total + len(best)
        assert [k for k, _ in sorted(found[i])] == list(range(1, len(best) + 1))
    assert hits >= 0.9 * total


def quality_and_lines(rows):
    """What quality rules and line dedup leave of (doc_id, text, source) rows."""
    key = lambda line: lower(line.strip(WS))
    hosts, docs_of = collections.Counter(s for _, _, s in rows), collections.Counter()
    for _, t, s in rows:
        docs_of.update((s, k) for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for d, t, s in rows:
        words, lines = WORD.findall(t or ""), (t or "").split("\n")
        grams = collections.defaultdict(list)
        for i in range(len(words) - 4):
            grams[tuple(words[i : i + 5])].append(i)
        again = {i + j for at in grams.values() if len(at) > 1 for i in at for j in range(5)}
        n = {k: docs_of[s, k] for k in map(key, lines) if k}
        over = {k for k, c in n.items() if c > 20 and (c > 0.01 * hosts[s] or c > 1000)}
        chars = sum(len(key(x)) for x in lines)
        lost = sum(len(key(x)) for x in lines if key(x) in over)
        if len(words) < 10 or 100 * len(again) > 20 * len(words) or (lost and chars - lost < 0.3 * chars):
            continue
        out.append((d, t if not lost else "\n".join(x for x in lines if key(x) not in over), s))
    often = collections.Counter(k for _, t, _ in out for k in {key(x) for x in t.split("\n")} if k)
    return [(d, "\n".join(x for x in t.split("\n") if often[key(x)] < 10), s) for d, t, s in out]


def test_pipeline_equals_plain_loops(spark, documents):
    rows = quality_and_lines(documents)
    groups = components(rows, 5, 4, 5)
    assert len({d for d, _, _ in rows}) == len(rows)
    rows = [r for r, (d, n, c) in zip(rows, groups) if not n or d == c]
    v = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    want = [(rows[i][0], tuple(library.encode_ordinary(t))) for t, i in copies(rows)]
    got = [(r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, DIR).collect()]
    assert collections.Counter(got) == collections.Counter(want)
