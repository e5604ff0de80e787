"""Exact substring dedup over range-partitioned, sampled suffixes.

Every window of WIDTH bytes picks one suffix to stand for it: the one, among those that begin in
the window and have a whole leading token there, whose token has the smallest hash (the
leftmost of equals). Equal windows pick the same one, so it is enough to sort these suffixes,
about one in twenty, each with the stretch of text over which windows picked it (its context).

Documents are dealt into batches by hash. A batch sends each distinct context once, with the
smallest doc_id that has it, however many documents repeat it; so a passage that a third of all
documents share reaches a bucket at most once per batch. Contexts travel as one compressed block
for each batch and bucket. Splitters sampled from the leading tokens range-partition them. Equal
windows have equal tokens, and equal tokens never straddle a boundary, so the last suffix of a
bucket and the first of the next have no window in common and needn't be compared. A bucket sorts
its suffixes by multikey quicksort: word after word up to WIDTH bytes, each time only within ranges
that are equal so far; and in the same way by what stands before them, read backwards. The bytes
that neighbours have in common cut both orders into runs for every depth, and windows are equal
where they are in one run of each. What comes back to a batch is the smallest doc_id of the
windows that an earlier document has; the batch then cuts its documents.
"""

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, TOKEN = 50, 12
PLACES = WIDTH - TOKEN + 1  # where in a window the token can begin
LEFT = PLACES - 1
FULL = LEFT + WIDTH  # bytes of the longest context
WORDS = -(-FULL // 8)
PIECE = 1 << 20
_MIX = np.random.default_rng(50).integers(1, 1 << 62, WORDS + 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TAIL = np.uint64((1 << 8 * (TOKEN - 8)) - 1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[-1]
    return x ^ (x >> np.uint64(29))


class Batch:
    """Documents of one batch as one buffer, with their suffixes, contexts and distinct contexts."""

    def __init__(self, ids: list[int | None], sizes: list[int], data: bytes):
        self.ids = ids
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        pad = b"\0" * (FULL + 8)
        self.padded = np.frombuffer(b"".join([pad, data, pad]), np.uint8)
        self.buffer = self.padded[len(pad) : len(self.padded) - len(pad)]
        self.pad = len(pad)
        self._runs()
        self._contexts()

    @staticmethod
    def of(table: pa.Table) -> "Batch":
        """From packed documents: columns ids, sizes and data."""
        unzip = zstandard.ZstdDecompressor().decompress
        flat = lambda name: [x for part in table.column(name).to_pylist() for x in part]
        return Batch(flat("ids"), flat("sizes"), b"".join(unzip(d) for d in table.column("data").to_pylist()))

    def _runs(self) -> None:
        n = len(self.buffer)
        inside = np.zeros(n, bool)
        for i, s, e in zip(self.ids, self.starts.tolist(), self.ends.tolist()):
            if i is not None and e - s >= WIDTH:
                inside[s : e - WIDTH + 1] = True
        out = []
        for base in range(0, n, PIECE):
            here = np.flatnonzero(inside[base : base + PIECE])
            if not len(here):
                continue
            part = self.padded[self.pad + base : self.pad + base + PIECE + WIDTH + 8]
            words = np.empty(len(part) - 7, np.uint64)
            for k in range(8):
                w = part[k:]
                words[k::8] = w[: len(w) // 8 * 8].view("<u8")[: len(words[k::8])]
            key = _mixed(words[:-8] * _MIX[0] + (words[8:] & TAIL) * _MIX[1])
            key &= np.uint64(0xFFFFFFFF00000000)
            key |= np.arange(len(key), dtype=np.uint64)
            for step in (1, 2, 4, 8, 16, PLACES - 32):  # at last the smallest of PLACES
                key = np.minimum(key[:-step], key[step:])
            at = (key[here] & np.uint64(0xFFFFFFFF)).astype(np.int64) + base
            out.append((here + base, at))
        window = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64)
        anchor = np.concatenate([x for _, x in out]) if out else np.zeros(0, np.int64)
        new = np.ones(len(window), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(window)) - 1 if len(first) else first
        self.anchor, self.lo, self.hi = anchor[first], window[first], window[last]
        ids = np.array([-1 if i is None else i for i in self.ids], np.int64)
        self.doc = ids[np.searchsorted(self.ends, self.lo, side="right")]

    def context(self, runs: np.ndarray) -> np.ndarray:
        a = self.anchor[runs]
        rows = np.lib.stride_tricks.sliding_window_view(self.padded, FULL)[a - LEFT + self.pad]
        c, first = np.arange(FULL), (a - LEFT)[:, None]
        rows = rows * ((c >= self.lo[runs][:, None] - first) & (c < self.hi[runs][:, None] + WIDTH - first))
        return np.pad(rows, ((0, 0), (0, WORDS * 8 - FULL)))

    def _contexts(self) -> None:
        n = len(self.anchor)
        s_lo, s_hi = self.lo - self.anchor + LEFT, self.hi - self.anchor + LEFT
        h = np.empty(n, np.uint64)
        for i in range(0, n, 1 << 16):
            r = slice(i, i + (1 << 16))
            h[r] = context_hash(self.context(np.arange(n)[r]), s_lo[r], s_hi[r])
        self.first, self.index = distinct(h, s_lo, s_hi, self.context)
        self.s_lo, self.s_hi = s_lo[self.first], s_hi[self.first]
        self.least = np.full(len(self.first), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.index, self.doc)


def context_hash(rows: np.ndarray, s_lo: np.ndarray, s_hi: np.ndarray) -> np.ndarray:
    w = np.ascontiguousarray(rows).view("<u8")
    h = (s_lo * 64 + s_hi).astype(np.uint64) * _MIX[-2]
    for k in range(WORDS):
        h = h + _mixed(w[:, k] + _MIX[-3]) * _MIX[k]
    return _mixed(h)


def distinct(h: np.ndarray, s_lo: np.ndarray, s_hi: np.ndarray, context) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each distinct context, the context of each row), by hashes that are checked
    byte by byte; a row that shares its hash with another context is one of its own."""
    _, first, index = np.unique(h, return_index=True, return_inverse=True)
    apart = []
    for i in range(0, len(h), 1 << 16):
        r = np.arange(i, min(len(h), i + (1 << 16)))
        f = first[index[r]]
        apart.append(r[(s_lo[r] != s_lo[f]) | (s_hi[r] != s_hi[f]) | (context(r) != context(f)).any(1)])
    own = np.concatenate(apart) if apart else np.zeros(0, np.int64)
    index[own] = len(first) + np.arange(len(own))
    return np.append(first, own), index


def leading(rows: np.ndarray) -> np.ndarray:
    """The leading token of each context's suffix as two big-endian words."""
    token = np.ascontiguousarray(rows[:, LEFT : LEFT + 16])
    token[:, TOKEN:] = 0
    return token.view(">u8").astype(np.uint64)


def bucket_of(tokens: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """Bucket of each token: how many splitters are not above it. Splitters are sorted pairs of words."""
    lo = np.zeros(len(tokens), np.int64)
    hi = np.full(len(tokens), len(splitters))
    while (open_ := lo < hi).any():
        mid = np.where(open_, (lo + hi) // 2, 0)
        s = splitters[np.minimum(mid, len(splitters) - 1)]
        up = open_ & ((s[:, 0] < tokens[:, 0]) | ((s[:, 0] == tokens[:, 0]) & (s[:, 1] <= tokens[:, 1])))
        lo, hi = np.where(up, mid + 1, lo), np.where(open_ & ~up, mid, hi)
    return lo


def packed(*arrays: np.ndarray, level: int = 9) -> bytes:
    """One compressed block; numbers go byte by byte, so that their leading zeros cost nothing."""
    planes = [np.ascontiguousarray(a).view("u1").reshape(len(a), -1) for a in arrays]
    return zstandard.ZstdCompressor(level=level).compress(b"".join((x if x.shape[1] > 8 else x.T).tobytes() for x in planes))


def unpacked(data: bytes, n: int, kinds: list[tuple[str, int]]) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind, width in kinds:
        each = np.dtype(kind).itemsize * width
        x = np.frombuffer(raw, "u1", n * each, at)
        at += n * each
        out.append(x.reshape(n, each) if each > 8 else np.ascontiguousarray(x.reshape(each, n).T).view(kind).reshape(n))
    return out


SENT = [("<u4", 1), ("<i8", 1), ("u1", 1), ("u1", 1), ("u1", WORDS * 8)]
BACK = [("<u4", 1), ("<i8", 1), ("u1", 1), ("u1", 1)]


def _deal(batches):
    """Packs the documents that go to the same batch."""
    for x in batches:
        batch = x.column("batch").to_numpy()
        order = np.argsort(batch, kind="stable")
        x = x.take(pa.array(order))
        texts = [t or b"" for t in x.column("bytes").to_pylist()]
        ids, batch = x.column("doc_id").to_pylist(), batch[order]
        cut = np.append(np.flatnonzero(np.diff(batch, prepend=-1)), len(batch)).tolist()
        zip_ = zstandard.ZstdCompressor(level=6).compress
        parts = list(zip(cut[:-1], cut[1:]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(batch[i]) for i, _ in parts], pa.int64()),
                pa.array([ids[i:j] for i, j in parts], pa.list_(pa.int64())),
                pa.array([[len(t) for t in texts[i:j]] for i, j in parts], pa.list_(pa.int64())),
                pa.array([zip_(b"".join(texts[i:j])) for i, j in parts], pa.binary()),
            ],
            ["batch", "ids", "sizes", "data"],
        )


def _send(splitters: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        b, batch = Batch.of(table), table.column("batch")[0].as_py()
        rows = b.context(b.first)
        bucket = bucket_of(leading(rows), splitters)
        order = np.argsort(bucket, kind="stable")
        at = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
        out = []
        for i, j in zip(at[:-1], at[1:]):
            o = order[i:j]
            out.append((int(bucket[o[0]]), batch, len(o), packed(np.diff(o, prepend=0).astype("<u4"), b.least[o], b.s_lo[o].astype("u1"), b.s_hi[o].astype("u1"), rows[o])))
        return pa.table(list(map(list, zip(*out))) or [[]] * 4, schema=pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("n", pa.int64()), ("data", pa.binary())]))

    return run


def refine(order: np.ndarray, group: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass of the multikey sort: rows in groups of two or more, sorted by their next token.

    order: rows, group by group; group: their groups. Rows alone in their group leave.
    """
    o = np.lexsort((token[order], group))
    order, group = order[o], group[o]
    new = np.ones(len(order), bool)
    new[1:] = (group[1:] != group[:-1]) | (token[order[1:]] != token[order[:-1]])
    group = np.cumsum(new) - 1
    several = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
    return order[several], group[several]


def multikey(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Rows, which come group by group, sorted within their groups by the columns of words.

    Each pass sorts by one word, and only ranges of several rows that are equal so far.
    """
    order = np.arange(len(group))
    live, g = order.copy(), group
    for k in range(words.shape[1]):
        several = np.bincount(g)[g] > 1 if len(g) else np.zeros(0, bool)
        live, g = live[several], g[several]
        if not len(live):
            break
        t = words[order[live], k]
        o = np.lexsort((t, g))
        order[live] = order[live][o]
        t = t[o]
        g = np.cumsum(np.append(0, (g[1:] != g[:-1]) | (t[1:] != t[:-1])))
    return order


def _common(order: np.ndarray, group: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Bytes that each row of an order has in common with the row before; -1 for the first of a group."""
    other = side[order[1:]] != side[order[:-1]]
    same = np.where(other.any(1), other.argmax(1), side.shape[1])
    return np.append(-1, np.where(group[1:] != group[:-1], -1, same))


def _words(side: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.pad(side, ((0, 0), (0, -side.shape[1] % 8)))).view(">u8").astype(np.uint64)


def earliest(rows: np.ndarray, least: np.ndarray, s_lo: np.ndarray, s_hi: np.ndarray) -> list[np.ndarray]:
    """Stretches of windows of distinct contexts that a smaller doc_id has: (context, doc_id, first, last)."""
    tokens = leading(rows)
    order, group = refine(np.arange(len(rows)), np.zeros(len(rows), np.int64), tokens[:, 0])
    order, group = refine(order, group, tokens[:, 1])
    out = []
    at = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(order))
    i = 0
    while i < len(at) - 1:  # whole groups, about 40,000 contexts at a time
        j = max(i + 1, int(np.searchsorted(at, at[i] + 40_000, side="right")) - 1)
        out.append(_windows(order[at[i] : at[j]], group[at[i] : at[j]], rows, least, s_lo, s_hi))
        i = j
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4


def _windows(take: np.ndarray, group: np.ndarray, rows: np.ndarray, least: np.ndarray, s_lo: np.ndarray, s_hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """As earliest, for whole groups of one leading token."""
    group, r = group - group[0], rows[take]
    runs = np.zeros((2, PLACES, len(take)), np.int32)
    for which, side, depth in ((0, r[:, LEFT : LEFT + WIDTH], WIDTH - np.arange(PLACES)), (1, r[:, LEFT - 1 :: -1], np.arange(PLACES))):
        order = multikey(group, _words(side))
        same = _common(order, group, side)
        for p, d in enumerate(depth.tolist()):
            runs[which, p, order] = np.cumsum(same < d)
    s = np.arange(PLACES)
    row, place = np.nonzero((s >= s_lo[take][:, None]) & (s <= s_hi[take][:, None]))
    before = LEFT - place  # bytes of the window that stand before the suffix
    key = before.astype(np.uint64) << np.uint64(58) | runs[0, before, row].astype(np.uint64) << np.uint64(29) | runs[1, before, row].astype(np.uint64)
    o = np.argsort(key, kind="stable")
    new = np.ones(len(o), bool)
    new[1:] = key[o[1:]] != key[o[:-1]]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(o)))
    keep = np.repeat(size > 1, size)
    o, size = o[keep], size[size > 1]
    if not len(o):
        return (np.zeros(0, np.int64),) * 4
    first = np.cumsum(size) - size
    low = np.repeat(np.minimum.reduceat(least[take[row[o]]], first), size)
    better = low < least[take[row[o]]]
    o, low = o[better], low[better]
    by = np.lexsort((place[o], row[o]))
    o, low = o[by], low[by]
    ro, pl = row[o], place[o]
    new = np.ones(len(o), bool)
    new[1:] = (ro[1:] != ro[:-1]) | (pl[1:] != pl[:-1] + 1) | (low[1:] != low[:-1])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(o)) - 1 if len(a) else a
    return take[ro[a]], low[a], pl[a], pl[b]


def _bucket(table: pa.Table) -> pa.Table:
    """Compares the contexts of one bucket and answers every batch."""
    batches = table.column("batch").to_pylist()
    parts = [unpacked(d, n, SENT) for d, n in zip(table.column("data").to_pylist(), table.column("n").to_pylist())]
    parts = [[np.cumsum(p[0].astype(np.int64)), *p[1:]] for p in parts]
    owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    index, least, s_lo, s_hi, rows = (np.concatenate(x) for x in zip(*parts))
    del parts
    s_lo, s_hi = s_lo.astype(np.int64), s_hi.astype(np.int64)
    first, same = distinct(context_hash(rows, s_lo, s_hi), s_lo, s_hi, lambda r: rows[r])
    low = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(low, same, least)
    rows = rows[first]
    where, doc, a, b = earliest(rows, low, s_lo[first], s_hi[first])
    # A context that several batches have: its own smallest doc_id holds for all its windows.
    own = np.flatnonzero(low[same] < least)
    order = np.argsort(same, kind="stable")
    begin = np.searchsorted(same[order], np.arange(len(first)))
    count = np.bincount(same, minlength=len(first))
    rep = count[where]
    member = order[np.repeat(begin[where], rep) + np.arange(rep.sum()) - np.repeat(np.cumsum(rep) - rep, rep)]
    m = np.concatenate([own, member])
    docs = np.concatenate([low[same[own]], np.repeat(doc, rep)])
    lo = np.concatenate([s_lo[own], np.repeat(a, rep)])
    hi = np.concatenate([s_hi[own], np.repeat(b, rep)])
    o = np.argsort(owner[m], kind="stable")
    cut = np.append(np.flatnonzero(np.diff(owner[m][o], prepend=-1)), len(o))
    out = []
    for i, j in zip(cut[:-1], cut[1:]):
        x = o[i:j]
        out.append((batches[int(owner[m[x[0]]])], len(x), packed(index[m[x]].astype("<u4"), docs[x].astype("<i8"), lo[x].astype("u1"), hi[x].astype("u1"))))
    return pa.table(list(map(list, zip(*out))) or [[]] * 3, schema=pa.schema([("batch", pa.int64()), ("n", pa.int64()), ("data", pa.binary())]))


OUT = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def _cut(docs: pa.Table, answers: pa.Table) -> pa.Table:
    b = Batch.of(docs)
    parts = [unpacked(d, n, BACK) for d, n in zip(answers.column("data").to_pylist(), answers.column("n").to_pylist())]
    begin, end = [], []
    whole = b.least[b.index] < b.doc if len(b.doc) else np.zeros(0, bool)
    begin.append(b.lo[whole])
    end.append(b.hi[whole] + WIDTH)
    if parts:
        index, low, lo, hi = (np.concatenate(x) for x in zip(*parts))
        o = np.argsort(index, kind="stable")
        index, low, lo, hi = index[o], low[o], lo[o].astype(np.int64), hi[o].astype(np.int64)
        run = np.flatnonzero(~whole)
        i, j = np.searchsorted(index, b.index[run]), np.searchsorted(index, b.index[run], side="right")
        rep = j - i
        e = np.repeat(i, rep) + np.arange(rep.sum()) - np.repeat(np.cumsum(rep) - rep, rep)
        r = np.repeat(run, rep)
        hit = low[e] < b.doc[r]
        e, r = e[hit], r[hit]
        begin.append(b.anchor[r] - LEFT + lo[e])
        end.append(b.anchor[r] - LEFT + hi[e] + WIDTH)
    n = len(b.buffer)
    step = np.bincount(np.concatenate(begin), minlength=n + 1) - np.bincount(np.concatenate(end), minlength=n + 1)
    gone = np.cumsum(step)[:n] > 0
    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    # Windows end with their document, but the last of one may meet the first of the next.
    kept, spans = [], []
    for s, t in zip(b.starts.tolist(), b.ends.tolist()):
        i, j = np.searchsorted(edge, s, side="right"), np.searchsorted(edge, t)
        cuts = edge[i:j].tolist()
        if s < t and gone[s]:
            cuts.insert(0, s)
        if len(cuts) % 2:
            cuts.append(t)
        spans.append([{"start": x - s, "stop": y - s} for x, y in zip(cuts[::2], cuts[1::2])])
        kept.append(b.buffer[s:t][~gone[s:t]].tobytes())
    return pa.table([pa.array(b.ids, pa.int64()), pa.array(kept, pa.binary()), pa.array(b.sizes), pa.array(spans, OUT.field("spans").type)], schema=OUT)


def suffix_dedup(docs: DataFrame, batch_bytes: int = 6 << 20, sample_docs: int = 2000) -> DataFrame:
    """Removes each byte under a string of WIDTH bytes that also starts in a smaller doc_id.

    Texts are taken as UTF-8 bytes, null as none; strings stay within a document, overlap
    freely, and are judged on the input. Returns for each row of docs: doc_id, kept (binary),
    n_bytes and spans, array<struct<start, stop>>, the maximal removed stretches in bytes.
    Documents with a null doc_id have no rank: they lose nothing and cost others nothing. Rows
    that share a doc_id aren't smaller than each other, so they lose nothing to each other. An
    empty table gives an empty table; other columns are ignored.

    batch_bytes is what a task holds of the input at a time; there are as many buckets as
    batches. The sample of sample_docs documents, or two for each bucket, only balances the
    buckets; it has no influence on the result. The driver gets about twenty tokens of 12 bytes
    for each sampled document, and sends one for each bucket to the tasks.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("bytes"))
    total, n = d.agg(F.sum(F.octet_length("bytes")), F.count("*")).first()
    batches = max(1, math.ceil((total or 0) / batch_bytes))
    sample_docs = max(sample_docs, 2 * batches)
    share = int((1 << 30) * min(1.0, sample_docs / max(1, n))) + 1
    sample = d.filter(F.pmod(F.xxhash64(F.lit("splitters"), "doc_id"), F.lit(1 << 30)) < share)

    def tokens(parts):
        for x in parts:
            if x.num_rows:
                texts = [t or b"" for t in x.column("bytes").to_pylist()]
                b = Batch(x.column("doc_id").to_pylist(), list(map(len, texts)), b"".join(texts))
                t = leading(b.context(b.first[:: max(1, -(-len(b.first) // (20 * x.num_rows)))]))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in t.astype(">u8")], pa.binary())], ["token"])

    drawn = sorted(bytes(r["token"]) for r in sample.mapInArrow(tokens, "token binary").collect())
    chosen = sorted({drawn[len(drawn) * k // batches] for k in range(1, batches)}) if drawn else []
    splitters = np.frombuffer(b"".join(chosen), ">u8").astype(np.uint64).reshape(-1, 2)
    d = d.withColumn("batch", F.pmod(F.xxhash64("doc_id", "bytes"), F.lit(batches)))
    dealt = d.mapInArrow(_deal, "batch long, ids array<long>, sizes array<long>, data binary")
    blocks = dealt.groupBy("batch").applyInArrow(_send(splitters), "bucket long, batch long, n long, data binary")
    answers = blocks.groupBy("bucket").applyInArrow(_bucket, "batch long, n long, data binary")
    done = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_cut, "doc_id long, kept binary, n_bytes long, spans array<struct<start: bigint, stop: bigint>>")
    return done
