"""Approximate nearest neighbours by a forest of random-projection trees."""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dwell.llm.common import cut

FOUND = "query_id long, vec_id long, score double"
MET = "part int, kind int, id long, x array<double>, leaf int, floor double, open array<int>"  # kind 0: a row, 1: a query
BLOCK = 8192  # rows that queries meet at a time where all are compared
HELD = 2**22  # components of the rows that a task holds at a time
SCORES = 2**20  # scores, distances of leaves and finds that are laid out at once


@dataclass
class Tree:
    """Inner nodes in an array: a hyperplane, its offset and two children; a leaf is ~number."""

    planes: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaves: int

    @staticmethod
    def grow(x: np.ndarray, leaf: int, rng: np.random.Generator) -> "Tree":
        planes, offsets, children, todo, leaves = [], [], [], [(np.arange(len(x)), -1, 0)], 0
        while todo:
            rows, parent, side = todo.pop()
            cut = None
            if len(rows) > leaf:
                for _ in range(5):
                    a, b = x[rng.choice(rows, 2, replace=False)]
                    plane = (a / (np.linalg.norm(a) or 1)) - (b / (np.linalg.norm(b) or 1))
                    if (norm := np.linalg.norm(plane)) > 1e-9:
                        at = x[rows] @ (plane / norm)
                        offset = float(np.median(at))
                        if 0.2 < (at > offset).mean() < 0.8:
                            cut = (plane / norm, offset, at > offset)
                            break
            if cut is None:
                me, leaves = ~leaves, leaves + 1
            else:
                me = len(planes)
                planes.append(cut[0])
                offsets.append(cut[1])
                children.append([0, 0])
                todo += [(rows[~cut[2]], me, 0), (rows[cut[2]], me, 1)]
            if parent >= 0:
                children[parent][side] = me
        width = x.shape[1] if x.ndim == 2 else 0
        return Tree(np.array(planes).reshape(-1, width), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), leaves)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        if not len(self.planes):
            return np.zeros(len(x), np.int64)
        at = np.zeros(len(x), np.int64)
        while len(go := np.flatnonzero(at >= 0)):
            n = at[go]
            up = np.einsum("ij,ij->i", x[go], self.planes[n]) > self.offsets[n]
            at[go] = self.children[n, up.astype(np.int64)]
        return ~at

    def wrong(self, q: np.ndarray) -> np.ndarray:
        """For each leaf and row of q the sum of squares of the margins by which it lies on the wrong side on the leaf's path."""
        out = np.zeros((self.leaves, len(q)))
        if not len(self.planes):
            return out
        margin = np.einsum("jd,id->ji", self.planes, q) - self.offsets[:, None]
        to, level = np.zeros_like(margin), np.zeros(1, np.int64)
        while len(level):
            below = []
            for side in (0, 1):
                c = self.children[level, side]
                far = to[level] + np.maximum(0.0, -margin[level] if side else margin[level]) ** 2
                to[c[c >= 0]], out[~c[c < 0]] = far[c >= 0], far[c < 0]
                below.append(c[c >= 0])
            level = np.concatenate(below)
        return out


def nearest_leaves(trees: list[Tree], q: np.ndarray, upto: int) -> np.ndarray:
    """The ``upto`` leaves of the whole forest that each row of q is nearest to, in order; leaves are numbered tree after tree.

    A leaf's distance is the sum of squares of the margins by which q lies on the wrong side on its path.
    """
    wrong = np.vstack([t.wrong(q) for t in trees])
    return np.argsort(np.ascontiguousarray(wrong.T), axis=1, kind="stable")[:, :upto]


def parts_of(rows: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The first part of each leaf and how many parts it has, tree after tree, and the number of parts; rows are those of each tree's leaves.

    Leaves that follow each other in a tree share a part of up to ``most`` rows; a leaf of more has parts of its own, an empty one none.
    """
    first, of, at = [], [], 0
    for tree in rows:
        held = 0
        for n in tree.tolist():
            if held and held + n > most:
                at, held = at + 1, 0
            own = math.ceil(n / most)
            first.append(at)
            of.append(own)
            at, held = (at + own, 0) if own > 1 else (at, held + n)
        at += held > 0
    return np.array(first, np.int64), np.array(of, np.int64), at


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of vectors that are not null or zero and hold finite numbers alone."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) if len(c) else np.zeros((0, 0))


def fit_forest(vectors: DataFrame, trees: int, leaf: int, sample: int, seed: int = 7) -> tuple[list[Tree], float, int]:
    """Trees over a hash sample of about ``sample`` rows, the largest norm of it, and the row count.

    Leaves are made for ``leaf`` rows of all rows, down to four of the sample. For inner
    products rows get one more component that makes all norms equal.
    """
    n = vectors.count()
    if not n:
        return [], 0.0, 0
    one = 1 << 30
    drawn = vectors.filter(F.pmod(F.xxhash64(F.lit("forest"), "vec_id"), F.lit(one)) < int(one * min(1.0, sample / n)) + 1)
    rows = drawn.select("vec_id", "embedding").limit(2 * sample).toArrow().sort_by("vec_id")
    x = _matrix(rows.column("embedding"))
    top = float(np.linalg.norm(x, axis=1).max()) if len(x) else 1.0
    x = lifted(x, top)
    rng = np.random.default_rng(seed)
    size = max(4, math.ceil(leaf * len(x) / n))
    return [Tree.grow(x, size, rng) for _ in range(trees)], top, n


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    if not len(x):
        return x
    return np.hstack([x, np.sqrt(np.maximum(0.0, top * top - (x * x).sum(1)))[:, None]])


Held = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # leaves, where each begins and the last ends, ids, vectors


def _held(pieces: list[pa.RecordBatch]) -> Held | None:
    """The rows of a part by leaf and id."""
    if not pieces:
        return None
    t = pa.Table.from_batches(pieces)
    ids, leaf = t["id"].to_numpy(), t["leaf"].to_numpy()
    order = np.lexsort((ids, leaf))
    leaves, at = np.unique(leaf[order], return_index=True)
    return leaves, np.append(at, len(ids)), ids[order], _matrix(t["x"])[order]


Found = tuple[np.ndarray, np.ndarray, np.ndarray]  # place of the query, vec_id, score


def _top(found: list[Found], k: int) -> Found:
    row, vid, score = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((vid, -score, row))
    row = row[order]
    ok = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[ok], vid[order][ok], score[order][ok]


def _best(queries: pa.RecordBatch, held: Held, k: int) -> pa.RecordBatch:
    """The k best rows of this part's leaves for each query that opens them, if they reach its floor."""
    leaves, bounds, ids, x = held
    qid, q, floor = queries.column("id").to_numpy(), _matrix(queries.column("x")), queries.column("floor").to_numpy()
    floor = np.maximum(floor, np.finfo(float).min)
    row, leaf = np.repeat(np.arange(len(qid)), queries.column("open").value_lengths().to_numpy()), queries.column("open").flatten().to_numpy()
    order = np.argsort(leaf, kind="stable")
    row, leaf = row[order], leaf[order]
    found, n = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
    for name, lo, hi in zip(leaves.tolist(), bounds, bounds[1:]):
        who, of = row[np.searchsorted(leaf, name) : np.searchsorted(leaf, name, "right")], ids[lo:hi]
        some = max(1, SCORES // (hi - lo))
        for asked in (who[i : i + some] for i in range(0, len(who), some)):
            s = np.einsum("id,jd->ij", q[asked], x[lo:hi])  # equal rows get equal scores, which BLAS does not promise
            own = np.minimum(np.searchsorted(of, qid[asked]), len(of) - 1)
            me = np.flatnonzero(of[own] == qid[asked])
            s[me, own[me]] = -np.inf
            keep = s >= floor[asked][:, None]
            many = np.flatnonzero(keep.sum(1) > 4 * k)
            if len(many):
                keep[many] &= s[many] >= np.partition(np.where(keep[many], s[many], -np.inf), -k, axis=1)[:, -k, None]
            i, j = np.nonzero(keep)
            found.append((asked[i], of[j], s[i, j]))
            n += len(i)
            if n > SCORES:
                found = [_top(found, k)]
                n = len(found[0][0])
    row, vid, score = _top(found, k)
    return pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(vid), pa.array(score)], ["query_id", "vec_id", "score"])


def _compare(k: int):
    """Over parts that come one after another, of each its rows first: these are held, and queries are compared as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, got, held = None, [], None
        for b in batches:
            mark = np.stack([b.column(c).to_numpy() for c in ("part", "kind")])
            cuts = [0, *(np.flatnonzero((mark[:, 1:] != mark[:, :-1]).any(axis=0)) + 1).tolist(), mark.shape[1]]
            for at, to in zip(cuts, cuts[1:]):
                if at == to:
                    continue
                part, kind = mark[:, at].tolist()
                if part != of:
                    of, got, held = part, [], None
                if kind == 0:
                    got.append(b.slice(at, to - at))
                    continue
                if held is None:
                    held, got = _held(got), []
                if held is not None:
                    yield _best(b.slice(at, to - at), held, k)

    return run


def met(rows: DataFrame, queries: DataFrame, parts: int, k: int) -> DataFrame:
    """The k best of each part for each query in it. Both sides have the columns MET; a task holds the rows of one part, whatever the queries."""
    d = rows.unionByName(queries).repartitionById(parts, "part").sortWithinPartitions("part", "kind")
    return d.mapInArrow(_compare(k), FOUND)


def enough_probes(v: DataFrame, q: DataFrame, forest: list[Tree], top: float, n: int, k: int, recall: float, sample: int = 96) -> int:
    """The leaves that a query must open to find ``recall`` of its true neighbours, from a bounded sample of queries.

    The sampled queries are compared with all rows. Each of their neighbours is in one leaf of
    each tree; where the first of these stands in the query's order is when it would be found.
    """
    drawn = cut(q.orderBy(F.xxhash64(F.lit("recall"), "query_id")).limit(sample))
    best = compare_all(v, drawn, k, n).join(drawn, "query_id").join(v, "vec_id").select("query_id", "q", "embedding").toArrow().sort_by("query_id")
    if not best.num_rows:
        return len(forest)
    ids, ask, found = best.column("query_id").to_numpy(), _matrix(best.column("q")), lifted(_matrix(best.column("embedding")), top)
    first = np.cumsum([0, *(t.leaves for t in forest)])
    leaves = np.array([first[i] + t.leaf_of(found) for i, t in enumerate(forest)])
    opened, order, last = [], np.zeros(first[-1], np.int64), None
    for row, i in enumerate(ids.tolist()):
        if i != last:
            order[nearest_leaves(forest, np.append(ask[row], 0.0)[None], len(order))[0]] = np.arange(len(order))
            last = i
        opened.append(int(order[leaves[:, row]].min()) + 1)
    return max(len(forest), int(np.sort(opened)[math.ceil(recall * len(opened)) - 1]))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = 12, leaf: int = 512, recall: float = 0.98, sample: int = 32_768) -> DataFrame:
    """The k rows of ``vectors`` with the largest inner product found for each query.

    Both have vec_id (long) and embedding (array); queries are rows of vectors. Trees are fitted
    on a sample of about ``sample`` rows; every row is in a leaf of every tree. A query opens
    the leaves that one queue over all trees puts first, as many as a bounded sample of queries
    needs for ``recall`` against all rows, and the rows in them are scored exactly in double
    precision: first a leaf for each tree, then, with the score that a row must reach by now, the
    others. Leaves are dealt over parts of a bounded number of rows, and a query goes once to each
    part in which it opens leaves. A task holds one part's rows and compares queries as they come.
    A leaf of more rows has several parts, so a vector that a third of all rows share is compared
    by many tasks and none is left out.

    Returns query_id, rank (from 1), vec_id, score, nearest first, ties to the smaller vec_id;
    fewer than k rows where there are no more. A query that finds fewer than k rows in its leaves
    is compared with all rows instead. Vectors that are null, zero or hold a null or non-finite
    component take no part, nor do null ids, nor those of another length than most (of two as
    frequent, the greater holds); an empty table gives an empty result; of rows that repeat a
    vec_id the one with the smallest vector counts; other columns are ignored.

    As many leaves are opened as the data need for the recall: for vectors without structure
    that is a share of all leaves, and work then grows with the queries times the rows.
    """
    spark = vectors.sparkSession
    v = cut(usable(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    sizes = v.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows"))
    usual = sizes.agg(F.max_by("n", F.struct("rows", "n"))).first()[0] or 0
    v = v.filter(F.size("embedding") == usual)
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("q")).filter(F.size("q") == usual)
    q = cut(asked.select(F.col("vec_id").alias("query_id"), "q"))
    forest, top, n = fit_forest(v, trees, leaf, sample)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(forest)
    probes = enough_probes(v, q, forest, top, n, k, recall)
    start_of = np.cumsum([0, *(t.leaves for t in forest)])  # leaves are numbered tree after tree

    def leaves_of(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        x = lifted(_matrix(b.column("embedding")), top)
        return (start_of[t] + tree.leaf_of(x) for t, tree in enumerate(shared.value if len(x) else []))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros(start_of[-1], np.int64)
        for b in batches:
            for leaf in leaves_of(b):
                rows += np.bincount(leaf, minlength=len(rows))
        found = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(rows[found])], ["leaf", "rows"])

    sizes = v.mapInArrow(count, "leaf long, rows long").groupBy("leaf").agg(F.sum("rows").alias("rows")).toArrow()
    rows = np.zeros(start_of[-1], np.int64)
    rows[sizes.column("leaf").to_numpy()] = sizes.column("rows").to_numpy()
    first, of, parts = parts_of(np.split(rows, start_of[1:-1]), max(1, min(HELD // usual, max(2 * BLOCK, n // 4))))
    dealt = spark.sparkContext.broadcast((first.astype(np.int32), of.astype(np.int32)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, of = dealt.value
        for b in batches:
            n, mixed = b.num_rows, b.column("vec_id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            for leaf in leaves_of(b):
                part = first[leaf] + (mixed % of[leaf].astype(np.uint64)).astype(np.int32)
                cols = [pa.array(part, pa.int32()), pa.array(np.zeros(n, np.int32)), b.column("vec_id"), b.column("embedding"), pa.array(leaf, pa.int32()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, ["part", "kind", "id", "x", "leaf", "floor", "open"])

    def ask(begin: int, upto: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (first, of), some = dealt.value, max(1, SCORES // start_of[-1])
            for b in (b.slice(i, some) for b in batches for i in range(0, b.num_rows, some)):
                leaf = nearest_leaves(shared.value, np.hstack([_matrix(b.column("q")), np.zeros((b.num_rows, 1))]), upto)[:, begin:]
                row, leaf = np.repeat(np.arange(len(leaf)), leaf.shape[1]), leaf.ravel()
                own = of[leaf]
                row, leaf = np.repeat(row, own), np.repeat(leaf, own)
                part = first[leaf] + np.arange(len(leaf)) - np.repeat(np.cumsum(own) - own, own)
                order = np.lexsort((part, row))
                row, leaf, part = row[order], leaf[order], part[order]
                starts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (part[1:] != part[:-1]))[: len(row)])
                ends = np.append(starts[1:], len(row))
                step = max(1, HELD // 16 // usual)
                for s, e in ((starts[i : i + step], ends[i : i + step]) for i in range(0, len(starts), step)):
                    c, n = b.take(pa.array(row[s])), len(s)
                    open_ = pa.ListArray.from_arrays(pa.array(np.append(s, e[-1]) - s[0], pa.int32()), pa.array(leaf[s[0] : e[-1]], pa.int32()))
                    cols = [pa.array(part[s], pa.int32()), pa.array(np.ones(n, np.int32)), c.column("query_id"), c.column("q"), pa.nulls(n, pa.int32()), c.column("floor"), open_]
                    yield pa.RecordBatch.from_arrays(cols, ["part", "kind", "id", "x", "leaf", "floor", "open"])

        return run

    spread = max(1, min(4096, math.ceil(q.count() / 512)))

    def opened(q: DataFrame, begin: int, upto: int) -> DataFrame:
        return met(v.mapInArrow(place, MET), q.repartition(spread).mapInArrow(ask(begin, upto), MET), parts, k)

    lowest = F.lit(float("-inf"))
    start = cut(ranked(opened(q.withColumn("floor", lowest), 0, trees), k))
    floor = start.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n"))
    again = q.join(floor, "query_id", "left").select("query_id", "q", F.when(F.col("n") == k, F.col("low")).otherwise(lowest).alias("floor"))
    more = opened(again, trees, probes).unionByName(start.select("query_id", "vec_id", "score"))
    found = cut(ranked(more, k))
    few = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min(k, n - 1)).select("query_id")
    few = cut(q.join(few, "query_id", "left_anti"))
    if few.isEmpty():
        return found
    return found.join(few.select("query_id"), "query_id", "left_anti").unionByName(compare_all(v, few, k, n))


def compare_all(rows: DataFrame, queries: DataFrame, k: int, n: int) -> DataFrame:
    """The k nearest of all n rows, block by block: rows has vec_id and embedding, queries query_id and q."""
    blocks, no = max(1, math.ceil(n / BLOCK)), lambda kind: F.lit(None).cast(kind)
    part = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    dealt = rows.select(part.alias("part"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), F.col("embedding").alias("x"), F.lit(0).alias("leaf"), no("double").alias("floor"), no("array<int>").alias("open"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = queries.select(every.alias("part"), F.lit(1).alias("kind"), F.col("query_id").alias("id"), F.col("q").alias("x"), no("int").alias("leaf"), F.lit(float("-inf")).alias("floor"), F.array(F.lit(0)).alias("open"))
    return ranked(met(dealt, asked, blocks, k), k)


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each query; a row that several leaves found counts once. No query's finds are gathered."""
    place = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = pairs.select("query_id", place.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
    return best.dropDuplicates(["query_id", "rank"])
