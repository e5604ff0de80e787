"""The text operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from dwell.llm import ann, bpe, langid, licenses, line_dedup, mixing, quality, similarity_join, substring_dedup, suffix_dedup
from dwell.llm.oracles import LINE_DEDUP, quality as quality_sql
from dwell.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _r1 string, size string, keys int, node string, batch int, features int, comp int, n_words string, start string"
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def corpus():
    """(doc_id, text, source) rows with every odd case: ties, repeats, nulls, empty and long texts."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeéßAB") for _ in range(rnd.randint(1, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    common, passage = line(12) + ".", line(60) + "."
    base = "\n".join(line(20) + "." for _ in range(4))
    out = [(0, None, "a"), (1, "", "a"), (2, " \t\n\x0b ", None), (3, "one two", "b"), (3, "one two", "b"), (4, "One  TWO", None), (None, "x " * 30, "a"), (None, None, None), (5, "\n\n", "c")]
    out += [(i, base, "a") for i in range(10, 40)]
    for i in range(40, 70):
        words = base.split(" ")
        for _ in range(rnd.randint(1, 9)):
            words[rnd.randrange(len(words))] = word()
        out.append((i, " ".join(words), "b"))
    out += [(i, "\n".join([common.upper() if i % 2 else "  " + common, line(30) + ".", line(25)]), rnd.choice("abc")) for i in range(70, 100)]
    out += [(i, line(15) + ". " + passage + " " + line(15) + ".", "c") for i in (100, 101, 102)]
    out += [(200, line(20_000), "d"), (201, "ab " * 9000, "d"), (202, "#$%! " * 40 + "\n" + "#$%! " * 40, "é"), (203, "🎉漢字   x y " * 20, "é")]
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    d = [(i, t, "en", s, 0, "r", "s", 1, "n", 2, 3, 4, "w", "z") for i, t, s in rows]
    return spark.createDataFrame(d, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def table(df):
    return collections.Counter(map(tuple, df.collect()))


def duck(rows, sql):
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    c.executemany("insert into documents values (?, ?, ?)", rows)
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    return names, collections.Counter(r.fetchall())


def test_line_dedup_equals_sql(docs, none, rows):
    names, want = duck(rows, LINE_DEDUP)
    got = line_dedup.line_dedup(docs).withColumn("kept_sha256", F.sha2("text", 256))
    assert table(got.select(*names)) == want and sum(n for r, n in want.items() if r[names.index("n_dropped")]) > 50
    assert line_dedup.line_dedup(none).count() == 0


def test_line_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, 3, fanout=2)
    for _ in range(5):
        runs.add(spark.range(4).select(F.col("id").alias("h1"), F.lit(0).cast("long").alias("h2")))
    assert sum(map(len, runs.levels)) <= 3 and sorted(r["h1"] for r in runs.frequent().collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("limits", [{}, {"min_docs": 3, "max_share": 0.05, "min_kept": 0.5}])
def test_quality_equals_sql(docs, none, rows, limits):
    names, want = duck(rows, quality_sql(**limits))
    assert table(quality.quality_rules(docs, **limits).select(*names)) == want
    kept = quality.pass_quality(docs, **limits)
    assert kept.columns == docs.columns and kept.count() == sum(n for r, n in want.items() if r[names.index("kept")])
    assert quality.quality_rules(none).count() == quality.pass_quality(none).count() == 0


def cover(texts, at=50):
    first = {}
    for i, t in texts:
        for p in range(len(t) - at + 1):
            k = t[p : p + at]
            first[k] = min(first.get(k, i), i)
    return first


@pytest.mark.parametrize("size", [2000, 6 << 20])
def test_suffix_dedup_equals_brute_force(docs, none, rows, size):
    data = [(i, (t or "").encode()) for i, t, _ in rows]
    first = cover([(i, t) for i, t in data if i is not None])
    want = collections.Counter()
    for i, t in data:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49 if i is not None else 0):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        edge = np.flatnonzero(np.diff(gone.astype(int), prepend=0, append=0)).tolist()
        want[i, len(t), bytes(np.frombuffer(t, np.uint8)[~gone]), tuple(zip(edge[::2], edge[1::2]))] += 1
    got = collections.Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"]), tuple(map(tuple, r["spans"]))) for r in suffix_dedup.suffix_dedup(docs, batch_bytes=size).collect())
    assert got == want
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_substring_dedup_finds_passages(docs, none, rows):
    out = {}
    for r in substring_dedup.substring_dedup(docs).collect():
        out.setdefault(r["doc_id"], []).append(r)
    texts = {i: t for i, t, _ in rows}
    for i in (101, 102):
        (r,) = out[i]
        gone = sum(s["stop"] - s["start"] for s in r["spans"])
        assert 200 < gone < len(texts[i]) - 60 and len(r["text"]) == len(texts[i]) - gone
    assert out[100][0]["spans"] == [] and out[10][0]["spans"] == [] and out[11][0]["text"] == ""
    assert [r["text"] for r in out[0]] == [None] and [r["text"] for r in out[3]] == ["one two"] * 2
    for i, rs in out.items():
        for r in rs:
            if r["text"] is not None and i is not None and i != 3:
                kept, at = "", 0
                for s in r["spans"]:
                    kept, at = kept + texts[i][at : s["start"]], s["stop"]
                assert kept + texts[i][at:] == r["text"]
    assert sum(map(len, out.values())) == len(rows) and substring_dedup.substring_dedup(none).count() == 0


def shingles(t, n):
    w = WORD.findall(lower(t or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(rows, n, num, den):
    sets = [shingles(t, n) for _, t, _ in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [(d, len(s), least.get(top(i)) if s else d) for i, ((d, _, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("n, num, den", [(4, 85, 100), (5, 4, 5), (2, 1, 2)])
def test_jaccard_components_equal_brute_force(docs, rows, n, num, den):
    got = table(similarity_join.jaccard_components(docs, n, num, den))
    assert got == collections.Counter(components(rows, n, num, den))


def test_sets_with_equal_first_digests_stay_apart(docs, rows):
    assert table(similarity_join.jaccard_components(docs, 4, 85, 100, bits=3)) == collections.Counter(components(rows, 4, 85, 100))


def test_one_of_each(docs, none, rows):
    kept = similarity_join.one_of_each(docs, 4, 85, 100)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    want = {c for _, n, c in components(rows, 4, 85, 100) if n} | {d for d, n, _ in components(rows, 4, 85, 100) if not n}
    assert set(ids) == want and ids.count(3) == 1 and kept.columns == docs.columns
    assert similarity_join.one_of_each(none).count() == similarity_join.jaccard_components(none).count() == 0


def test_linked_sets_share_tokens():
    rnd = np.random.default_rng(3)
    for size in (4, 6, 7, 12, 20, 55, 130, 600):
        classes = similarity_join.Classes(85, 100, 2000)
        for _ in range(30):
            a = np.unique(rnd.integers(0, 1 << 63, size, dtype=np.uint64))
            lost = rnd.integers(0, int(size * 0.15) + 1)
            b = np.unique(np.append(rnd.permutation(a)[lost:], rnd.integers(0, 1 << 63, rnd.integers(0, int(size * 0.15) + 1), dtype=np.uint64)))
            both = len(np.intersect1d(a, b))
            if 100 * both < 85 * (len(a) + len(b) - both) or both == len(a) == len(b):
                continue
            doc, gram = np.repeat([0, 1], [len(a), len(b)]), np.append(a, b)
            c = classes.of(np.array([len(a), len(b)]))
            found = collections.Counter()
            for up in ((0, 0), (0, 1), (1, 0), (1, 1)):
                if c[0] + up[0] == c[1] + up[1]:
                    d, t = similarity_join.tokens_of(doc, gram, c + np.array(up), classes)
                    same = np.intersect1d(t[d == 0], t[d == 1])
                    found["all"] += len(same)
                    grams = int((same & np.uint64(1)).sum())
                    need = similarity_join.pieces_of(doc, gram, c + np.array(up), classes)[3]
                    size_of = np.array([len(a), len(b)])
                    assert (len(same) - grams >= need).all() or (100 * grams >= 85 * size_of).all()
            assert found["all"] >= similarity_join.SLACK


def test_mix_reaches_targets(docs, none, rows):
    taken, mix = mixing.mix_sources(docs, block=64)
    got = taken.collect()
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
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
    assert len(got) == len(rows)
    by_size = {(size[s], round(target[s], 6)): s for s in size}
    sums = collections.Counter()
    for r in got:
        s = by_size[r["source_size"], round(r["target"], 6)]
        sums[s] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(sums[s] - target[s]) <= 1 for s in size)
    assert table(mixing.mix_sources(docs.repartition(5), block=64)[0]) == table(taken)
    pieces = mix.collect()
    assert max(p["n_words"] for p in pieces) <= 64 and len({(p["ord"], p["rank"]) for p in pieces}) == len({p["slot"] for p in pieces})
    assert sum(p["n_words"] for p in pieces) == sum(sums.values())
    mixed = mixing.apply_mix(docs, block=64)
    assert mixed.columns == docs.columns and sum(len(WORD.findall(r["text"])) for r in mixed.select("text").collect()) == sum(sums.values())
    assert mixing.mix_sources(none)[0].count() == mixing.apply_mix(none).count() == 0


def test_schedule_stays_close_to_the_weights(spark):
    t = spark.createDataFrame([("a", 100, 0, 1.0, 50_000.0), ("b", 100, 1, 1.0, 30_000.0), ("c", 100, 2, 1.0, 20_000.0)], "source string, source_size long, ord long, weight double, target double")
    s = [r["ord"] for r in mixing.slot_schedule(t, 10).orderBy("slot").collect()]
    assert len(s) == 10_000
    for n in range(500, 10_001, 500):
        assert [abs(s[:n].count(k) - n * w) < 12 for k, w in enumerate((0.5, 0.3, 0.2))] == [True] * 3


def test_bpe_equals_the_library(docs, none, rows):
    v = bpe.vocabulary(VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    got = collections.Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in bpe.bpe_round_trip(docs, VOCABULARY, public_tokenizers.PATTERN).collect())
    assert got == collections.Counter((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t, _ in rows)
    assert bpe.bpe_round_trip(none, VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_prefix_tables_take_appends_and_edits():
    v, rnd = bpe.vocabulary(VOCABULARY), random.Random(4)
    for _ in range(100):
        s = bytes(rnd.choice(b"abcdehlotins \xc3\xa9") for _ in range(150))
        t = bpe.PrefixTable(v, s[:70])
        t.append(s[70:])
        assert t.last == bpe.PrefixTable(v, s).last and v.decode(t.ids()) == s
        i = rnd.randint(0, 60)
        j, x = i + rnd.randint(0, 20), bytes(rnd.choice(b"xyzeth") for _ in range(rnd.randint(0, 9)))
        made = t.replace(i, j, x)
        assert t.last == bpe.PrefixTable(v, s[:i] + x + s[j:]).last and made <= len(t.data) - i


def test_language_id(spark, docs, none):
    got = QUERIES["op2_language_id"](spark, DIR).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    held = [r for r in got if r["held_out"]]
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.9 and all(0 <= r["score"] <= 1 for r in got)
    d = {"x": b"hello world this is a text", "y": "grün ist die farbe".encode()}
    out = langid.identify_languages(docs.select("doc_id", "text"), d).collect()
    und = {r["doc_id"] for r in out if r["lang_pred"] == langid.UNDETERMINED}
    assert und >= {0, 1, 2, 5, 202} and 3 not in und and 203 not in und and len(out) == docs.count()
    assert {r["lang_pred"] for r in langid.identify_languages(docs.select("doc_id", "text"), {}).collect()} == {"und"}
    assert langid.fit_dictionaries(none.select("doc_id", "text", "lang")) == {} and langid.identify_languages(none.select("doc_id", "text"), d).count() == 0


def test_held_out_follows_the_remainder(spark):
    import zlib

    got = {r["doc_id"]: r["h"] for r in spark.range(300).withColumnRenamed("id", "doc_id").withColumn("h", langid.held_out()).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(300)}


def vectors(spark, n, copies=0, seed=1):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(8, 16))
    x = centres[rnd.integers(0, 8, n)] + rnd.normal(size=(n, 16))
    x[:copies] = x[0]
    data = [(i, [float(np.float32(c)) for c in v], 0, "c") for i, v in enumerate(x)]
    return data, spark.createDataFrame(data, "vec_id long, embedding array<float>, rows int, leaf string")


def exact(data, q, k):
    ok = {i: np.array(v, float) for i, v, *_ in data if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    return sorted(((-float(ok[q] @ v), i) for i, v in ok.items() if i != q))[:k] if q in ok else []


def test_neighbours_reach_the_recall(spark):
    data, v = vectors(spark, 4000, copies=1300)
    got = collections.defaultdict(list)
    for r in ann.nearest(v, v.filter("vec_id % 20 = 0"), k=10, leaf=64).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for q in range(0, 4000, 20):
        want = exact(data, q, 10)
        assert len(got[q]) == 10 and [(-s, i) for i, s in got[q]] == sorted((-s, i) for i, s in got[q])
        hits += len({i for _, i in want} & {i for i, _ in got[q]})
        total += 10
    assert hits / total >= 0.95


def test_neighbours_of_few_and_odd_vectors(spark):
    data, _ = vectors(spark, 6)
    data += [(6, None, 0, ""), (7, [0.0] * 16, 0, ""), (8, [float("nan")] * 16, 0, ""), (9, [None] * 16, 0, ""), (20, [float("inf")] * 16, 0, ""), (None, [1.0] * 16, 0, ""), (1, data[1][1], 0, "")]
    v = spark.createDataFrame(data, "vec_id long, embedding array<float>, rows int, leaf string")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(v, v.filter("vec_id % 20 = 0"), k=20).orderBy("rank").collect()]
    assert got == [(0, n + 1, i) for n, (_, i) in enumerate(exact(data, 0, 20))] and len(got) == 5
    assert ann.nearest(v.limit(0), v.limit(0)).count() == 0


def test_queries_are_compared_as_they_come(spark):
    rng = np.random.default_rng(4)
    x, leaf = rng.normal(size=(90, 4)), np.repeat([0, 1, 2], 30)
    x[40:60] = x[40]

    def batch(kind, ids, vectors, leaves=None, opened=None):
        n = len(ids)
        lists = pa.array([v.tolist() for v in vectors], pa.list_(pa.float64()))
        cols = [pa.array([3] * n, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array(ids, pa.int64()), lists, pa.array(leaves or [None] * n, pa.int32()), pa.array([float("-inf")] * n if kind else [None] * n, pa.float64()), pa.array(opened or [None] * n, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(cols, ["part", "kind", "id", "x", "leaf", "floor", "open"])

    read = []

    def came():
        for at in range(0, 90, 25):  # rows first, over several batches
            ids = list(range(at, min(at + 25, 90)))
            yield batch(0, ids, x[ids], leaf[ids].tolist())
        for i in range(0, 90, 3):
            read.append(i)
            yield batch(1, [i], x[[i]], None, [[0, 1] if i % 2 else [1, 2]])

    for n, got in enumerate(ann._compare(5)(came())):
        i = 3 * n
        assert read[-1] == i  # no query waits for those after it, so their number takes no memory
        rows = [j for j in range(90) if j != i and leaf[j] in ([0, 1] if i % 2 else [1, 2])]
        want = sorted((-float(np.einsum("id,jd->ij", x[[i]], x[[j]])[0, 0]), j) for j in rows)[:5]
        assert got.column("query_id").to_pylist() == [i] * 5 and got.column("vec_id").to_pylist() == [j for _, j in want]
    assert n == 29
    first, of, parts = ann.parts_of([np.array([3, 4, 0, 2]), np.array([25]), np.array([1, 9, 30, 1])], 10)
    assert (first.tolist(), of.tolist(), parts) == ([0, 0, 0, 0, 1, 4, 4, 5, 8], [1, 1, 0, 1, 3, 1, 1, 3, 1], 9)


def test_neighbours_by_small_parts(spark, monkeypatch):
    _, v = vectors(spark, 1500, copies=500)
    find = lambda: [tuple(r) for r in ann.nearest(v, v.filter("vec_id % 50 = 0"), k=10, leaf=64).orderBy("query_id", "rank").collect()]
    want = find()
    monkeypatch.setattr(ann, "HELD", 16 * 200)  # leaves of copies have several parts
    assert find() == want and len(want) == 300


def test_compare_all_equals_brute_force(spark):
    data, v = vectors(spark, 300)
    u = ann.usable(v)
    got = ann.compare_all(u, u.filter("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 7, 300).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(q, n + 1, i) for q in range(5) for n, (_, i) in enumerate(exact(data, q, 7))]


def test_license_scan(spark, docs, none):
    real = spark.read.parquet(f"{DIR}/documents.parquet")
    model = licenses.fit(real)
    notice = {t[0]: f for f, t in licenses.TEMPLATES.items()}
    found = collections.Counter(r["doc_id"] for r in licenses.scan(real, model).filter("confirmed").collect())
    texts = {r["doc_id"]: r["text"] for r in real.collect()}
    assert found == collections.Counter({i: n for i, t in texts.items() if (n := sum(bool(re.search("licen[sc]e", x, re.I)) for x in t.split("\n")))})
    extra = spark.createDataFrame([(1, "some text\n" + t) for t in notice] + [(2, None), (3, ""), (4, "a licence to print money"), (None, next(iter(notice)))], "doc_id long, text string")
    got = licenses.scan(extra, model).filter("confirmed").collect()
    right = [r for r in got if r["doc_id"] == 1]
    assert len(right) == len(notice) and all(r["paragraph"] == 1 and r["start"] == 10 for r in right)
    assert collections.Counter(r["family"] for r in right) == collections.Counter(notice.values())
    assert {r["doc_id"] for r in got} == {1, None}
    assert licenses.scan(none, model).count() == 0 and licenses.fit(none).threshold >= 0.5


def test_queries_have_the_contract_columns(spark):
    want = {
        "op2": "doc_id held_out lang_pred score", "op3": "doc_id n_bytes n_removed n_spans kept_sha256", "op4": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op5": "doc_id n_tokens ids_sha256 decoded_sha256", "op6": "doc_id size source_size target taken", "op7": "query_id rank vec_id score", "op9": "doc_id n_lines n_dropped kept_sha256", "op10": "doc_id n_shingles component_id",
    }
    for name, f in QUERIES.items():
        if name.split("_")[0] in want:
            assert set(want[name.split("_")[0]].split()) <= set(f(spark, DIR).columns), name


def test_bpe_query_digests(spark):
    v = bpe.vocabulary(VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    for r in QUERIES["op5_byte_bpe"](spark, DIR).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(texts[r["doc_id"]].encode()))
