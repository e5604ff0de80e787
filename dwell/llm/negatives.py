"""Hard negatives by rotated one-bit codes, whose intervals decide which rows get an exact score."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwell.llm.common import cut, few, forget

BLOCK = 4096  # rows, and anchors, that one task compares at a time
PLANES = 6  # bits of each component of an anchor in the estimate
CODED = "id long, label long, code binary, align double, norm double, vector binary"


@lru_cache(2)
def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same in every process (each makes its own)."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words, filled up with zeros."""
    out = np.packbits(bits, axis=1)
    return np.pad(out, ((0, 0), (0, -out.shape[1] % 8))).view(np.uint64)


@dataclass
class Coded:
    """Rows with one bit for each rotated component, how well code and vector align, the norm, and the vector of integers."""

    id: np.ndarray
    label: np.ndarray
    code: np.ndarray
    align: np.ndarray
    norm: np.ndarray
    vector: np.ndarray

    @staticmethod
    def read(t: pa.Table) -> Coded:
        t = t.combine_chunks()
        whole = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind).reshape(len(t), -1)
        flat = [t.column(c).to_numpy() for c in ("id", "label", "align", "norm")]
        return Coded(*flat[:2], whole("code", np.uint64), *flat[2:], whole("vector", np.float64))

    def at(self, rows: np.ndarray) -> Coded:
        return Coded(*(getattr(self, f)[rows] for f in ("id", "label", "code", "align", "norm", "vector")))


def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        v = np.ascontiguousarray(b.column("v").flatten().to_numpy().reshape(b.num_rows, -1))
        norm = np.linalg.norm(v, axis=1)
        unit = (v / np.where(norm > 0, norm, 1)[:, None]) @ rotation(v.shape[1])
        code = unit > 0
        align = np.abs(unit).sum(axis=1) / math.sqrt(v.shape[1])  # inner product of the unit vector and the unit code vector
        raw = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (packed(code), v)]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), raw[0], pa.array(align), pa.array(norm), raw[1]], ["id", "label", "code", "align", "norm", "vector"])


def interval(anchors: Coded, rows: Coded) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of anchors and rows, from the rows' codes, alignments and norms alone.

    With c the code vector, x the row's and q the anchor's unit vector: <q,x> = align * <q,c> + <q,r>, where
    r is what is left of x beside c. r is orthogonal to c and has norm sqrt(1 - align^2), so by Cauchy
    and Schwarz |<q,r>| <= sqrt(1 - <q,c>^2) * sqrt(1 - align^2). <q,c> comes from popcounts of the code with bit planes of q,
    which is off by no more than the norm of what the planes leave out of q.
    """
    dim = anchors.vector.shape[1]
    q = (anchors.vector / np.where(anchors.norm > 0, anchors.norm, 1)[:, None]) @ rotation(dim)
    low = q.min(axis=1, keepdims=True)
    step = np.maximum(q.max(axis=1, keepdims=True) - low, 1e-12) / ((1 << PLANES) - 1)
    level = np.rint((q - low) / step).astype(np.int64)
    off = np.linalg.norm(q - (low + step * level), axis=1)[:, None]
    count = lambda code: np.bitwise_count(code).sum(axis=-1, dtype=np.int64)
    weighted = np.zeros((len(q), len(rows.id)), np.int64)
    for p in range(PLANES):
        plane = packed((level >> p) & 1 > 0)
        weighted += count(plane[:, None, :] & rows.code[None, :, :]) << p
    ones = count(rows.code)[None, :]
    total = low * dim + step * level.sum(axis=1, keepdims=True)
    seen = (2 * (low * ones + step * weighted) - total) / math.sqrt(dim)  # <q,c>, within off
    rest = np.sqrt(np.maximum(0.0, 1 - np.maximum(0.0, np.abs(seen) - off) ** 2)) * np.sqrt(np.maximum(0.0, 1 - rows.align**2))[None, :]
    middle, half = rows.align[None, :] * seen, rows.align[None, :] * off + rest + 1e-9
    scale = anchors.norm[:, None] * rows.norm[None, :]
    return (middle - half) * scale, (middle + half) * scale


def exact(anchors: Coded, rows: Coded) -> np.ndarray:
    """Integer inner products; in doubles, where these hold all sums exactly, and else by integers of any size, clipped to 64 bits."""
    if not len(rows.id) or anchors.norm.max() * rows.norm.max() < 2.0**52:
        return (anchors.vector @ rows.vector.T).astype(np.int64)
    big = lambda x: np.array([[int(y) for y in r] for r in x.tolist()], object)
    return np.clip(big(anchors.vector) @ big(rows.vector).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def integer_vectors(vectors: DataFrame, label: Column) -> DataFrame:
    """id, label and v (each component x as floor(256 * x), in double precision) of the rows that take part.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component
    take no part, nor do those whose length differs from most (of two as frequent, the greater
    holds), nor components that 256 times are beyond a double. Of rows that repeat an id the one with the smallest label and vector counts.
    """
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.lit(256.0) * x)
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), scaled.alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = v.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & sound)
    v = v.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.*")
    # A double that is whole is its own floor; rounding by parts keeps values beyond 64 bits.
    whole = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
    return v.select("id", "label", F.transform("v", whole).alias("v"))




def _compare(k: int, same: bool):
    """For each want of each anchor of a block, its k best rows of the other block between its low and high score."""

    def run(asks: pa.Table, rows: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] for _ in range(4)]
        if len(asks) and len(rows):
            a, r = Coded.read(asks), Coded.read(rows)
            r = r.at(np.argsort(r.id))
            wants = [asks.column(c).combine_chunks() for c in ("keys", "lows", "highs")]
            sizes = wants[0].value_lengths().to_numpy()
            flat, ends = [w.flatten().to_numpy() for w in wants], np.cumsum(sizes)
            for i in range(0, len(a.id), 256):
                c = a.at(np.arange(i, min(i + 256, len(a.id))))
                fits = (c.label[:, None] == r.label[None, :]) == same
                fits &= c.id[:, None] != r.id[None, :]
                here = range(i, i + len(c.id))
                least = np.array([flat[1][ends[x] - sizes[x] : ends[x]].min() for x in here], np.float64)
                most = np.array([flat[2][ends[x] - sizes[x] : ends[x]].max() for x in here], np.float64)
                low, high = interval(c, r)
                fits &= (high >= least[:, None]) & (low <= most[:, None])
                used = np.flatnonzero(fits.any(axis=0))
                score, fits, ids = exact(c, r.at(used)), fits[:, used], r.id[used]
                for w in range(int(sizes[i : i + len(c.id)].max())):
                    with_one = np.flatnonzero(sizes[i : i + len(c.id)] > w)
                    at = (ends - sizes)[with_one + i] + w
                    s = score[with_one]
                    x, y = np.nonzero(fits[with_one] & (s >= flat[1][at][:, None]) & (s <= flat[2][at][:, None]))
                    order = np.lexsort((y, -s[x, y], x))
                    x, y = x[order], y[order]
                    place = np.arange(len(x)) - np.searchsorted(x, x)
                    x, y = x[place < k], y[place < k]
                    for o, v in zip(out, (c.id[with_one][x], flat[0][at][x], ids[y], s[x, y]), strict=True):
                        o.append(v)
        return pa.table([pa.array(np.concatenate(o)) for o in out], names=["id", "key", "row", "score"])

    return run


def best_rows(rows: DataFrame, asks: DataFrame, k: int, same: bool) -> DataFrame:
    """For each anchor and key the k best other rows of the same (or of another) label with a score from low to high.

    rows: CODED columns; asks: those and arrays keys, lows and highs (never empty). Returns id, key,
    row, score and rank: higher scores first, ties to the smaller id. Both sides are dealt in
    blocks of at most about BLOCK, of a label where that has to be the same, and each block of
    anchors meets each of rows in a task of its own. The square root of the blocks go first;
    what the others find must reach the k-th score so far.
    """
    part = F.col("label") if same else F.lit(0).cast("long")
    rows, asks = rows.withColumn("part", part), asks.withColumn("part", part)
    held = rows.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).alias("rb")).join(asks.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).alias("ab")), "part")
    held = few(held.withColumn("first", F.ceil(F.sqrt("rb"))))
    key = ["part", "ablock", "rblock"]
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    copies = lambda a, b: F.explode(F.when(a <= b, F.sequence(a, b)))
    none = F.lit(0).cast("long")
    dealt = rows.join(held, "part").withColumn("rblock", block("rb"))
    asked = asks.join(held, "part").withColumn("ablock", block("ab"))

    def met(asked: DataFrame, first: bool) -> DataFrame:
        r = dealt.filter((F.col("rblock") < F.col("first")) if first else (F.col("rblock") >= F.col("first")))
        r = r.withColumn("ablock", copies(none, F.col("ab") - 1)).select(*key, "id", "label", "code", "align", "norm", "vector")
        a = asked.withColumn("rblock", copies(none, F.col("first") - 1) if first else copies(F.col("first"), F.col("rb") - 1))
        # New names of the same columns, as anchors are rows of the other side.
        a = a.select(*[F.col(c).alias(c) for c in (*key, "id", "label", "code", "align", "norm", "vector", "keys", "lows", "highs")])
        return a.groupBy(*key).cogroup(r.groupBy(*key)).applyInArrow(_compare(k, same), "id long, key long, row long, score long")

    begun = cut(_ranked(met(asked, True), k).drop("rank"))
    reached = begun.groupBy("id", "key").agg(F.count("*").alias("n"), F.min("score").alias("low")).filter(F.col("n") == k)
    reached = reached.groupBy(F.col("id").alias("_id")).agg(F.map_from_entries(F.collect_list(F.struct("key", "low"))).alias("reached"))
    raised = F.zip_with("keys", "lows", lambda x, low: F.greatest(low, F.element_at("reached", x)))
    again = asked.join(reached, F.col("id") == F.col("_id"), "left").withColumn("lows", F.when(F.col("reached").isNull(), F.col("lows")).otherwise(raised))
    return _ranked(met(again, False).unionByName(begun), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("id", "key").orderBy(F.desc("score"), "row"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def share_of(p: Column, percent: int, up: bool) -> Column:
    """percent hundredths of a whole number, rounded down or up, without a product that 64 bits can't hold."""
    r = F.pmod(p, F.lit(100))
    rest = (r * percent + (99 if up else 0) - F.pmod(r * percent + (99 if up else 0), F.lit(100))) / 100
    return F.call_function("div", p - r, F.lit(100)) * percent + rest.cast("long")


def hard_negatives(vectors: DataFrame, anchors: Column, label: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """For each anchor and each of its positives, rows of other labels that are close, but not as close.

    vectors: vec_id, embedding and label. ``anchors`` says which rows are anchors. A row's score is its inner product with
    the anchor, over components floor(256 * x), exactly; higher scores come first, ties by smaller
    vec_id. An anchor's positives are its first ``positives`` other rows of its label. Negatives
    are the first ``negatives`` rows of other labels with low * positive_score <= 100 * score <= high *
    positive_score. Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score and
    negative_score.

    Rows are kept as one bit for each component of a rotation, and how well code and vector align. An
    anchor's bounds of its scores come from these; rows whose bounds miss what is wanted are
    left out, all others get their exact integer score, so that no result depends on the bounds'
    width. For vectors without structure in few dimensions, bounds are wide and leave little out.

    Rows with a null vec_id, label or vector, or a null or non-finite component take no part, nor do
    those of another length than most; of rows that repeat a vec_id the one with the smallest label and
    vector counts. An empty table gives no rows; other columns are ignored. Scores beyond 64 bits are clipped.
    """
    label = F.col("label") if label is None else label
    v = cut(integer_vectors(vectors, label))
    sizes = v.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"))
    usual = sizes.agg(F.max_by("n", F.struct("rows", "n"))).first()[0] or 0
    rows = cut(v.filter(F.size("v") == usual).mapInArrow(encode, CODED))
    forget(v)
    chosen = rows.join(vectors.filter(anchors).select(F.col("vec_id").cast("long").alias("id")).distinct(), "id", "left_semi")
    bound = lambda b: F.array(F.lit(b).cast("long"))
    asks = chosen.withColumn("keys", bound(0)).withColumn("lows", bound(-(1 << 63))).withColumn("highs", bound((1 << 63) - 1))
    near = best_rows(rows, asks, positives, same=True).select("id", F.col("row").alias("positive_id"), F.col("score").alias("positive_score"))
    near = near.withColumn("low", share_of(F.col("positive_score"), low, True)).withColumn("high", share_of(F.col("positive_score"), high, False))
    near = cut(near.filter("low <= high"))
    wants = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("positive_id", "low", "high"))).alias("w"))
    wants = wants.select("id", F.col("w.positive_id").alias("keys"), F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    found = best_rows(rows, chosen.join(wants, "id"), negatives, same=False)
    out = found.select(F.col("id").alias("anchor_id"), F.col("key").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("row").alias("negative_id"), F.col("score").alias("negative_score"))
    score = near.select(F.col("id").alias("anchor_id"), "positive_id", "positive_score")
    return out.join(score, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
