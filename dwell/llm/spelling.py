"""Spelling variants: words one edit apart, found by k-d trees over their letter counts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.llm.common import ascii_lower, cut, forget

#: Letters of a run: [A-Za-zÀ-ÿ], a fixed value of the contract.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LETTERS = 26 + 64
LENGTH = LETTERS  # the dimension by which a tree splits lengths
CAP = 4  # letters counted beyond this make no difference to the bound, only to the check after it
PLACE = np.array([c - 97 if 97 <= c <= 122 else c - 0xC0 + 26 if c >= 0xC0 else 0 for c in range(256)])


def count_words(docs: DataFrame, min_chars: int = 5, min_count: int = 3, slip: int | None = None) -> DataFrame:
    """word and n (occurrences over all documents) of words of ``min_chars`` letters and ``min_count`` occurrences.

    A word is a maximal run of letters with A-Z lower-cased. With ``slip``, let h be the crc32 of
    ``<doc_id>:<word>``; where slip divides it, the word loses its letter h % length (from 0)
    before it is counted. Null and empty texts have no words; texts may be of any length; every
    row counts, also one that repeats another; without a doc_id no letter is lost; other
    columns are ignored; an empty table gives an empty one.
    """
    runs = F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(RUN), F.lit(0)))
    if slip is None:
        found = docs.select(runs.alias("word"))
    else:
        each = docs.select(F.col("doc_id").cast("string").alias("doc_id"), runs.alias("run"))
        h = F.crc32(F.concat("doc_id", F.lit(":"), "run"))
        at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
        less = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
        found = each.withColumn("h", h).select(F.when(F.col("h") % slip == 0, less).otherwise(F.col("run")).alias("word"))
    n = found.filter(F.char_length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n"))
    return n.filter(F.col("n") >= min_count)


@dataclass
class Words:
    """Words as rows of bytes (every letter has one in Latin-1), with their lengths and letter counts."""

    text: list[bytes]
    size: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(words: list[str]) -> Words:
        text = [w.encode("latin-1") for w in words]
        size = np.array([len(t) for t in text], np.int64)
        row = np.repeat(np.arange(len(text)), size) * LETTERS
        at = row + PLACE[np.frombuffer(b"".join(text), np.uint8)]
        return Words(text, size, np.bincount(at, minlength=len(text) * LETTERS).reshape(-1, LETTERS).astype(np.int32))

    def spelled(self, rows: np.ndarray, size: int) -> np.ndarray:
        """The letters of words that all have ``size`` of them, as a matrix."""
        return np.frombuffer(b"".join([self.text[i] for i in rows]), np.uint8).reshape(len(rows), size)


@dataclass
class Tree:
    """Inner nodes in arrays: a dimension, the largest value of the lower side and two children; a leaf is ~number."""

    dims: list[int]
    limits: list[int]
    children: list[list[int]]
    leaves: int

    @staticmethod
    def grow(w: Words, leaf: int) -> tuple[Tree, list[np.ndarray]]:
        """A tree with leaves of at most ``leaf`` rows where counts differ, and the rows of each."""
        tree, todo, rows_of = Tree([], [], [], 0), [(np.arange(len(w.size)), -1, 0)], []
        while todo:
            rows, parent, side = todo.pop()
            split = _best_split(w, rows) if len(rows) > leaf else None
            if split is None:
                me, tree.leaves = ~tree.leaves, tree.leaves + 1
                rows_of.append(rows)
            else:
                dim, limit, high = split
                me = len(tree.dims)
                tree.dims.append(dim)
                tree.limits.append(limit)
                tree.children.append([0, 0])
                todo += [(rows[~high], me, 0), (rows[high], me, 1)]
            if parent >= 0:
                tree.children[parent][side] = me
        return tree, rows_of

    def leaf_of(self, w: Words) -> np.ndarray:
        out = np.zeros(len(w.size), np.int64)
        todo = [(0 if self.dims else -1, np.arange(len(w.size)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
            elif len(rows):
                high = (w.size[rows] if self.dims[node] == LENGTH else w.counts[rows, self.dims[node]]) > self.limits[node]
                todo += [(self.children[node][0], rows[~high]), (self.children[node][1], rows[high])]
        return out

    def search(self, w: Words, rows: np.ndarray, longer: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves and those of ``rows`` that may have a word there one replaced (longer = 0) or one added letter (1) away.

        A replaced letter takes one count down and another up, an added one takes one up; a box
        that needs more of either is left out. ``up`` and ``down`` hold what the box of a node
        needs, summed over its dimensions.
        """
        none = np.zeros(len(rows), np.int32)
        todo = [(0 if self.dims else -1, rows, none, none, {})]
        while todo:
            node, rows, up, down, box = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield ~node, rows
                continue
            dim, limit = self.dims[node], self.limits[node]
            low_child, high_child = self.children[node]
            if dim == LENGTH:
                high = w.size[rows] + longer > limit
                todo += [(low_child, rows[~high], up[~high], down[~high], box), (high_child, rows[high], up[high], down[high], box)]
                continue
            x = w.counts[rows, dim]
            lo, hi = box.get(dim, (0, None))
            down_here = np.maximum(0, x - limit) - (0 if hi is None else np.maximum(0, x - hi))
            up_here = np.maximum(0, limit + 1 - x) - np.maximum(0, lo - x)
            keep = (down + down_here <= 1 - longer) & (up <= 1)
            todo.append((low_child, rows[keep], up[keep], (down + down_here)[keep], box | {dim: (lo, limit)}))
            keep = (up + up_here <= 1) & (down <= 1 - longer)
            todo.append((high_child, rows[keep], (up + up_here)[keep], down[keep], box | {dim: (limit + 1, hi)}))


def _best_split(w: Words, rows: np.ndarray) -> tuple[int, int, np.ndarray] | None:
    """The dimension and limit that part rows best, lengths first; none where all counts are the same."""
    size = w.size[rows]
    if size.min() < size.max():
        limit = min(int(np.median(size)), int(size.max()) - 1)
        return LENGTH, limit, size > limit
    x = w.counts[rows]
    middle = np.minimum(np.median(x, axis=0).astype(np.int32), x.max(axis=0) - 1)
    best = None
    for limit in (middle, middle - 1):
        off = np.abs((x > limit).mean(axis=0) - 0.5)
        dim = int(off.argmin())
        if off[dim] < 0.5 and (best is None or off[dim] < best[0]):
            best = (off[dim], dim, int(limit[dim]))
    return best and (best[1], best[2], x[:, best[1]] > best[2])


class Cell:
    """The words of one length in one cell, in a k-d tree of their own."""

    def __init__(self, words: list[str], n: np.ndarray, leaf: int = 128):
        self.words, self.n, self.w = np.array(words, object), n, Words.of(words)
        self.size = int(self.w.size[0])
        self.tree, self.rows = Tree.grow(self.w, leaf)
        self.spelled = self.w.spelled(np.arange(len(words)), self.size)
        self.capped = [_capped(self.w, r) for r in self.rows]

    def pairs(self, q: Words, rows: np.ndarray, longer: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of q and words of the cell that are one replaced or one added letter apart."""
        spelled = q.spelled(rows, self.size - longer)
        thermo, total = _capped(q, rows)
        place = np.zeros(len(q.size), np.int64)
        place[rows] = np.arange(len(rows))
        out = [], []
        for leaf, found in self.tree.search(q, rows, longer):
            mine, (points, sums) = place[found], self.capped[leaf]
            used = np.flatnonzero(points.any(axis=0))
            shared = thermo[np.ix_(mine, used)] @ points[:, used].T
            apart = total[mine][:, None] + sums[None, :] - 2 * shared  # no more than their L1 distance
            i, j = np.nonzero(apart <= 2 - longer)
            i, j = mine[i], self.rows[leaf][j]
            ok = _one_added(spelled[i], self.spelled[j]) if longer else (spelled[i] != self.spelled[j]).sum(axis=1) == 1
            out[0].append(rows[i[ok]])
            out[1].append(j[ok])
        return tuple(np.concatenate([np.zeros(0, np.int64), *o]) for o in out)


def _capped(w: Words, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter counts up to CAP as marks in a row, so that a product of rows sums the smaller counts; and their sums."""
    marks = (w.counts[rows][:, :, None] > np.arange(CAP)).reshape(len(rows), -1).astype(np.float32)
    return marks, marks.sum(axis=1)


def _one_added(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether each row of long is that of short with one more letter."""
    head = np.minimum.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    tail = np.minimum.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= short.shape[1]


def near_words(words: DataFrame, cell: int = 16_384, sample: int = 65_536) -> DataFrame:
    """word, near and near_n for every ordered pair of words with exactly one inserted, deleted or replaced letter.

    words: word (distinct, not empty, letters of RUN alone) and n. A k-d tree over lengths and letter counts,
    fitted on a hash sample of about ``sample`` words, deals all words over cells of about
    ``cell`` words. A word goes to its own cell and asks those whose box is within one replaced
    letter in its length and one added letter in the next. Cells that counts can't part
    (anagrams) are dealt over blocks of both words and askers. In a block the cell's words go into a tree of
    their own, and askers stream past it.
    """
    n = words.count()
    share = int((1 << 30) * min(1.0, sample / max(1, n))) + 1
    drawn = words.filter(F.pmod(F.xxhash64(F.lit("spelling"), "word"), F.lit(1 << 30)) < share).select("word").limit(2 * sample)
    drawn = sorted(r[0] for r in drawn.toLocalIterator())
    tree, _ = Tree.grow(Words.of(drawn), max(4, math.ceil(cell * len(drawn) / max(1, n))))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tree.leaf_of(Words.of(b.column("word").to_pylist())))], ["cell"])

    # No more rows than the tree has leaves, and those are bounded by the sample.
    held = words.select("word").mapInArrow(own, "cell long").groupBy("cell").count().filter(F.col("count") > 2 * cell)
    blocks = {r["cell"]: math.ceil(r["count"] / cell) for r in held.collect()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = Words.of(b.column("word").to_pylist())
            mine = np.array([hash_of(t) for t in w.text], np.int64)
            every = np.arange(len(w.size))
            asked = [(0, tree.leaf_of(w), every)]
            asked += [(1 + longer, np.full(len(rows), leaf), rows) for longer in (0, 1) for leaf, rows in tree.search(w, every, longer)]
            for kind, leaves, rows in asked:
                k = np.array([blocks.get(x, 1) for x in leaves.tolist()], np.int64)
                # Of k * k blocks of a cell a word takes a row and an asker a column.
                turn = np.concatenate([np.arange(x) for x in k]) if len(k) else np.zeros(0, np.int64)
                leaves, rows, k = np.repeat(leaves, k), np.repeat(rows, k), np.repeat(k, k)
                block = (mine[rows] % k) * k + turn if kind == 0 else turn * k + mine[rows] % k
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(leaves), pa.array(block), pa.array(np.full(len(rows), kind, np.int8)), b.column("word").take(take), b.column("n").take(take)], ["cell", "block", "kind", "word", "n"])

    dealt = words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(place, "cell long, block long, kind byte, word string, n long")
    dealt = dealt.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind")
    return dealt.mapInArrow(_compare, "word string, near string, near_n long")


def hash_of(text: bytes) -> int:
    """A hash of a word that is the same in every process."""
    h = 0
    for c in text:
        h = (h * 1_000_003 + c) & 0x7FFFFFFF
    return h


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sorted (cell, block, kind) rows: words of a block come first and are kept, then those that ask."""
    at, held, cells = None, [], {}
    for b in batches:
        key = np.stack([b.column(c).to_numpy() for c in ("cell", "block", "kind")])
        starts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for i, j in zip(starts, starts[1:], strict=False):
            if i == j:
                continue
            c, k, kind = key[:, i].tolist()
            words, n = b.column("word").slice(i, j - i).to_pylist(), b.column("n").slice(i, j - i).to_numpy()
            if (c, k) != at:
                at, held, cells = (c, k), [], {}
            if kind == 0:
                held.append((words, n))
                continue
            if held:
                size = np.array([len(w) for ws, _ in held for w in ws])
                every, counts = np.array([w for ws, _ in held for w in ws], object), np.concatenate([x for _, x in held])
                cells = {s: Cell(every[size == s].tolist(), counts[size == s]) for s in np.unique(size).tolist()}
                held = []
            yield from _ask(cells, words, n, kind - 1)


def _ask(cells: dict[int, Cell], words: list[str], n: np.ndarray, longer: int) -> Iterator[pa.RecordBatch]:
    q = Words.of(words)
    for s in np.unique(q.size).tolist():
        if cell := cells.get(s + longer):
            i, j = cell.pairs(q, np.flatnonzero(q.size == s), longer)
            a, b, na, nb = [words[x] for x in i], cell.words[j].tolist(), n[i], cell.n[j]
            if longer:  # a longer word doesn't ask for shorter ones
                a, b, na, nb = a + b, b + a, np.concatenate([na, nb]), np.concatenate([nb, na])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(nb)], ["word", "near", "near_n"])


def roots(forms: DataFrame) -> DataFrame:
    """word and root of every word that has a form, from forms: word and form (not null), without cycles.

    Each round a word takes over where its form points to by then, so rounds grow with the
    logarithm of the longest chain; a word whose target has no form is done.
    """
    done, todo = [], cut(forms.select("word", F.col("form").alias("to")))
    while True:
        every = todo
        for d in done:
            every = every.unionByName(d)
        ahead = every.select(F.col("word").alias("_at"), F.col("to").alias("_next"))
        step = cut(todo.join(ahead, F.col("to") == F.col("_at"), "left").select("word", F.coalesce("_next", "to").alias("to"), F.col("_next").isNull().alias("last")))
        forget(todo)
        done.append(step.filter("last").select("word", "to"))
        todo = step.filter("not last").select("word", "to")
        if todo.isEmpty():
            break
        todo = cut(todo)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumnRenamed("to", "root")


def spelling_groups(words: DataFrame, ratio: int = 2) -> DataFrame:
    """Each word with the more frequent word that it is likely a variant of.

    words: word and n; words that are null, empty or hold other characters than RUN's take no
    part, and rows that repeat a word are added up. Returns word, form (its near word of largest n, ties to
    the smallest in code-point order, if that n is ``ratio`` (2 or more) times the word's n or more; else null),
    root (follow forms to the last; the word itself without one), n, n_near and form_n. An empty
    table gives an empty one; words may be of any length; other columns are ignored.
    """
    if ratio < 2:
        raise ValueError("under a ratio of 2 forms could go in circles")
    w = words.filter(F.col("word").rlike(f"^{RUN}$")).groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    w = cut(w)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(w).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    taken = -F.col("best.less") >= ratio * F.col("n")
    each = w.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"))
    each = cut(each)
    forget(w)
    out = each.join(roots(each.filter("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
