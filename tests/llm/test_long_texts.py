"""Texts of very many lines, the helpers that they rest on, and license scans against plain loops."""

import random
import re

from pyspark.sql import functions as F

from dwell.llm import licenses, line_dedup, quality
from dwell.llm.common import distinct_structs, sums_before, without

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_array_helpers(spark):
    rnd = random.Random(1)
    arrays = [[rnd.randrange(9) for _ in range(n)] for n in (1, 2, 3, 4, 10, 101)]
    drops = [sorted(rnd.sample(range(len(a)), rnd.randrange(len(a) + 1))) for a in arrays]
    d = spark.createDataFrame([(i, a, [str(x) for x in a], g) for i, (a, g) in enumerate(zip(arrays, drops, strict=True))], "i int, a array<long>, s array<string>, g array<int>")
    pairs = F.transform("a", lambda x: F.struct(x.alias("x"), (x % 2).alias("y")))
    for r in d.select("i", sums_before(F.col("a")).alias("sums"), without(F.col("s"), F.col("g")).alias("left"), distinct_structs(pairs).alias("d")).collect():
        a, g = arrays[r["i"]], drops[r["i"]]
        assert r["sums"] == [sum(a[:k]) for k in range(len(a) + 1)]
        assert r["left"] == [str(x) for k, x in enumerate(a) if k not in g]
        assert [tuple(x) for x in r["d"]] == sorted({(x, x % 2) for x in a})


def test_texts_of_a_hundred_thousand_lines(spark):
    text = "\n".join(f"line {i} of this text has ten words in it or so" if i % 50 else "All rights reserved" for i in range(100_000))
    docs = spark.createDataFrame([(1, text, "en", "s", 0), (2, text, "en", "s", 0), (3, "own\nwords", "en", "s", 0)], SCHEMA)
    got = {r["doc_id"]: tuple(r) for r in line_dedup.line_dedup(docs, min_docs=2).select("doc_id", "n_lines", "n_dropped", "text").collect()}
    assert got == {1: (1, 100_000, 100_000, ""), 2: (2, 100_000, 100_000, ""), 3: (3, 2, 0, "own\nwords")}
    rows = quality.quality_rules(docs, min_docs=1, max_share=0.1).select("doc_id", F.char_length("text").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in rows} == {1: 0, 2: 0, 3: 9}


def shares(text):
    w = [x for x in re.split(r"[^\w]+|_", text.lower()) if x]
    return {" ".join(w[i : i + 2]) for i in range(len(w) - 1)} | {" ".join(w[i : i + 3]) for i in range(len(w) - 2)}


def plain_scan(text, least=0.6):
    """(paragraph, start, family, similarity) of every family that a template confirms, without the classifier."""
    known = [(f, shares(t)) for f, ts in licenses.TEMPLATES.items() for t in ts]
    reach = 2 * max(len(t.split()) for ts in licenses.TEMPLATES.values() for t in ts)
    lines, out = text.split("\n"), set()
    words = [[x for x in re.split(r"[^\w]+|_", x) if x] for x in lines]
    wide = {}
    for i, line in enumerate(lines):
        more = []
        for w in words[i + 1 :]:
            if not w or len(more) >= reach:
                break
            more += w
        wide[i] = shares(" ".join([line, *more[:reach]])) if words[i] else set()
    for i, line in enumerate(lines):
        own, best = shares(line), {}
        for f, t in known:
            share = lambda g, t=t: len(t & g) / len(t)
            a, b = share(own), share(wide[i])
            first = a < least <= b and b > share(wide.get(i + 1, set())) and share(wide.get(i - 1, set())) <= b
            best[f] = max(best.get(f, (0, ())), (b if first else a, tuple(sorted(t & (wide[i] if first else own)))))
        sure = {f: x for f, x in best.items() if x[0] >= least}
        for f, (s, g) in sure.items():
            if set(g) - {y for o, h in sure.values() if o > s for y in h}:
                out.add((i, sum(len(x) + 1 for x in lines[:i]), f, round(s, 9)))
    return out


def test_license_model_is_of_all_paragraphs(spark):
    """Neither ids nor copies of the whole table change it: nothing is drawn."""
    lines = ["this work is under the terms of the house", "you may obtain a copy of the book", "any person to any purpose", "the terms of the lease"]
    texts = [(i, lines[(i * i) % 7 % 4] + f" {i}") for i in range(1500)]
    fitted = [licenses.fit(spark.createDataFrame([(i + k, t) for i, t in texts], "doc_id long, text string")) for k in (0, 7919)]
    a, b = ({g: m.pipeline.stages[1].coefficientMatrix.toArray()[:, i].round(6).tolist() for i, g in enumerate(m.pipeline.stages[0].vocabulary)} for m in fitted)
    assert a == b and fitted[0].threshold == fitted[1].threshold


def test_license_scan_equals_plain_loops(spark):
    """Whole, cut, wrapped and repeated notices of all families between other lines."""
    rnd = random.Random(8)
    filler = ["the first of the month", "", "under the terms of the contract", "# -----", "of the text of the law, and of the rest", "A driving licence is valid for ten years."]
    texts = []
    for ts in licenses.TEMPLATES.values():
        for t in ts:
            w = t.split(" ")
            k = rnd.randrange(1, len(w))
            shapes = [t, " ".join(w[:k]) + "\n" + " ".join(w[k:]), "\n# ".join(" ".join(w[i : i + 3]) for i in range(0, len(w), 3)), " ".join(w[: max(2, len(w) // 2)]), "x " + t + " y"]
            texts.append("\n".join(y for s in shapes for y in (rnd.choice(filler), s, rnd.choice(filler))))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(900, None, "en", "s", 0), (901, "", "en", "s", 0)], SCHEMA).repartition(4)
    model = licenses.fit(docs.limit(0))
    model.threshold = 2.0  # no line is likely: templates alone speak
    got = {(r["doc_id"], r["paragraph"], r["start"], r["family"], round(r["similarity"], 9)) for r in licenses.scan(docs, model).collect()}
    want = {(i, *x) for i, t in enumerate(texts) for x in plain_scan(t)}
    assert got == want and {x[3] for x in want} == set(licenses.TEMPLATES)
