"""Exact similarity join of word n-gram sets by a token-group matrix.

Documents with the same set are one node. Sizes are cut into classes whose bounds grow by
1 / threshold, so linked nodes are in the same class or in neighbours, and each node takes part
in its own class and in the next. Within a class the hash range is cut into ``k`` pieces, more
than the elements by which two linked sets of the class can differ, so linked nodes have equal
pieces: at least ``k`` minus that difference. A piece with its content is a token of the matrix.
A very common n-gram alone makes no token: the other n-grams of its piece are part of it. Each
node knows how many tokens it needs to share with a linked one in each of its classes. Small sets
that leave many pieces empty have their n-grams as tokens too.

The tokens first partition similar nodes into groups: every node is compared with the hubs with
which it shares enough tokens, and what links is one group. Most tokens then lie within one group
and are done, and so are nodes with too few others. The rest are dealt into blocks of similar nodes.
The matrix of tokens by blocks (the union of each block's tokens) bounds the overlap between a node
and a block; a block that reaches the needed count is asked, bounds the overlap again by the union
of its members' n-grams and smallest size, and only then compares them. As groups merge when a
link is found, no pairs within a group are ever made.

Only ids travel until it is known which sets are compared; those alone are fetched. What is
written to the shared folder is deleted once its last reader has been written.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dwell.llm.common import cut, few, forget, keyed, row_key

_R = np.random.default_rng(10).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SLACK = 2
BLOCK = 1024  # nodes of one block of the matrix
ITEMS = 1 << 21  # elements of all sets of a block, about
QUERIES = 4096  # nodes that ask one block in one task
CODE_BITS = 9  # of a token, for its size class and kind: code 2c for pieces, 2c + 1 for n-grams
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _R[0]
    x = (x ^ (x >> np.uint64(29))) * _R[1]
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each text, ascending, as (document, hash), documents in order.

    A text of fewer than n words has its whole sequence as one; without words, none.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    buffer = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    gap = _SPACE[buffer]
    begin = np.flatnonzero(~gap & np.append(True, gap[:-1]))
    if not len(begin):
        return none
    stop = np.flatnonzero(gap & np.append(False, ~gap[:-1]))
    power = np.ones(int((stop - begin).max()) + 1, np.uint64)
    power[1:] = np.cumprod(np.full(len(power) - 1, _R[2]))
    of = np.cumsum(np.bincount(begin, minlength=len(buffer))) - 1
    place = np.arange(len(buffer)) - begin[np.maximum(of, 0)]
    value = np.where(gap, np.uint64(0), (buffer.astype(np.uint64) + np.uint64(1)) * power[np.where(gap, 0, place)])
    word = _mix(np.add.reduceat(value, begin) + (stop - begin).astype(np.uint64) * _R[3])
    doc = np.searchsorted(ends, begin, side="right")
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    gram, rest = np.zeros(len(word), np.uint64), count[doc] - (np.arange(len(word)) - first[doc])
    for k in range(n):
        moved = np.zeros(len(word), np.uint64)
        moved[: len(word) - k] = word[k:]
        gram = np.where(rest > k, _mix(gram * _R[4] + moved), gram)
    own = (rest >= n) | ((count[doc] < n) & (rest == count[doc]))
    doc, gram = doc[own], gram[own]
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    return doc[new], gram[new]


class Classes:
    """Size classes of a threshold num / den, with the pieces of each."""

    def __init__(self, num: int, den: int, largest: int = 1 << 40):
        self.num, self.den = num, den
        bounds = [1]
        while bounds[-1] <= largest:
            bounds.append(max(bounds[-1] + 1, bounds[-1] * den // num + 1))
        self.bounds = np.array([*bounds, max(bounds[-1] + 1, bounds[-1] * den // num + 1)], np.int64)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, size, side="right") - 1

    def most_apart(self, c: np.ndarray) -> np.ndarray:
        """Elements by which linked sets below the upper bound of class c differ at most."""
        upper = 2 * (self.bounds[c + 1] - 1)
        return upper * (self.den - self.num) // (self.den + self.num)

    def pieces(self, c: np.ndarray) -> np.ndarray:
        return self.most_apart(c) + np.maximum(SLACK + 2, self.most_apart(c) // 8)

    def equal(self, c: np.ndarray) -> np.ndarray:
        """Equal pieces that linked sets of class c have at least."""
        return self.pieces(c) - self.most_apart(c)


def pieces_of(doc: np.ndarray, gram: np.ndarray, c: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each piece that isn't empty begins and its number, whether a document has few of them,
    and how many tokens each document shares with a linked one in class c at least.

    Empty pieces say nothing and are no tokens. A document with so many of them that a linked one
    could share fewer than SLACK others is sparse: two of these are told by their n-grams, which are
    tokens of their own kind; with any other document a linked one shares SLACK pieces.
    """
    k = classes.pieces(c)
    piece = ((gram >> np.uint64(32)) * k[doc].astype(np.uint64)) >> np.uint64(32)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (piece[1:] != piece[:-1])
    at = np.flatnonzero(new)
    full = np.bincount(doc[at], minlength=len(c))
    sparse = (k - full > classes.equal(c) - SLACK) & (full > 0)
    return at, piece[at].astype(np.int64), sparse, np.where(sparse, SLACK, classes.equal(c) - (k - full))


def tokens_of(doc: np.ndarray, gram: np.ndarray, c: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """(document, token) in the class c of each document; doc and gram as shingle_sets gives them.

    A token is a hash of the class, a piece's number and its content, or for sparse documents also
    of the class and an n-gram; its last bits are its code.
    """
    at, p, sparse, _ = pieces_of(doc, gram, c, classes)
    low = np.uint64((1 << CODE_BITS) - 1)
    code = (2 * c).astype(np.uint64) & low
    d = doc[at]
    whole = np.add.reduceat(_mix(gram + _R[5]), at) if len(at) else np.zeros(0, np.uint64)
    salt = (c * 1_000_003).astype(np.uint64) * _R[6]
    token = (_mix(whole * _R[7] + p.astype(np.uint64) * _R[8] + salt[d]) & ~low) | code[d]
    few = sparse[doc]
    return np.append(d, doc[few]), np.append(token, (_mix(gram[few] * _R[9] + salt[doc[few]]) & ~low) | code[doc[few]] | np.uint64(1))


def _nodes_of(doc: np.ndarray, gram: np.ndarray, docs: int, clash: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each document's set, its id as a long, and a second digest of it.

    Sets in ``clash`` are different ones with the same first digest: their id is the second.
    """
    size = np.bincount(doc, minlength=docs)
    node, other = np.zeros(docs, np.uint64), np.zeros(docs, np.uint64)
    at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    if len(at):
        n = size[doc[at]].astype(np.uint64) * _R[11]
        node[doc[at]] = _mix(np.add.reduceat(_mix(gram + _R[10]), at) + n) >> np.uint64(64 - bits)
        other[doc[at]] = _mix(np.add.reduceat(_mix(gram * _R[12] + _R[13]), at) + n)
    node, other = node.view(np.int64), other.view(np.int64)
    return size, np.where(np.isin(node, clash), other, node), other


def _batches(batches: Iterator[pa.RecordBatch], n: int, most: int = 4 << 20):
    """(batch, document, hash) for slices of about ``most`` bytes."""
    for batch in batches:
        texts = [t or b"" for t in batch.column("bytes").to_pylist()]
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= most):
                size += len(texts[j])
                j += 1
            yield batch.slice(i, j - i), *shingle_sets(texts[i:j], n)
            i = j


NODE_ROWS = "doc_id long, _r1 long, _r2 long, n_shingles long, node long, other long, class int, need long, need_up long"


def _node_rows(n: int, classes: Classes, clash: np.ndarray, bits: int):
    def run(batches):
        for batch, doc, gram in _batches(batches, n):
            size, node, other = _nodes_of(doc, gram, batch.num_rows, clash, bits)
            c = np.maximum(classes.of(np.maximum(size, 1)), 0)
            need = [pieces_of(doc, gram, c + up, classes)[3] for up in (0, 1)]
            keys = [batch.column(k) for k in ("doc_id", "_r1", "_r2")]
            cols = [size, node, other, c.astype(np.int32), *need]
            yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, cols)], [x.split()[0] for x in NODE_ROWS.split(", ")])

    return run


def _token_rows(n: int, classes: Classes, clash: np.ndarray, bits: int):
    def run(batches):
        for batch, doc, gram in _batches(batches, n):
            size, node, _ = _nodes_of(doc, gram, batch.num_rows, clash, bits)
            _, one = np.unique(node, return_index=True)
            fresh = np.zeros(len(node), bool)
            fresh[one] = True
            # Smaller sets have no other within the threshold.
            fresh &= (size > 0) & (size * classes.den >= (size + 1) * classes.num)
            keep = fresh[doc] if len(doc) else np.zeros(0, bool)
            doc, gram = doc[keep], gram[keep]
            c = np.maximum(classes.of(np.maximum(size, 1)), 0)
            for up in (0, 1):
                d, token = tokens_of(doc, gram, c + up, classes)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(node[d])], ["token", "node"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by token and node: those of tokens that several nodes have, once each."""
    held, known = None, False  # the first row of the last token, and whether it is out already
    for batch in batches:
        token, node = (batch.column(k).to_numpy() for k in ("token", "node"))
        if held is not None:
            token, node = np.append(held[0], token), np.append(held[1], node)
        if not len(token):
            continue
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(token))))
        again = np.append(False, (token[1:] == token[:-1]) & (node[1:] == node[:-1]))
        other = (node != node[first][run]) & ~again
        several = np.bincount(run[other], minlength=len(first)) > 0
        out = other.copy()
        out[first[several]] = True
        if known:
            out[0] = False
        known = bool(several[-1]) or (known and len(first) == 1)
        held = (token[first[-1] :][:1], node[first[-1] :][:1])
        yield pa.RecordBatch.from_arrays([pa.array(token[out]), pa.array(node[out])], ["token", "node"])


def _set_rows(n: int, clash: np.ndarray, bits: int):
    def run(batches):
        for batch, doc, gram in _batches(batches, n):
            _, node, _ = _nodes_of(doc, gram, batch.num_rows, clash, bits)
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            sets = [gram[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(sets, pa.binary())], ["node", "items"])

    return run


def _linked(num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = 0
                if min(len(a), len(b)) * den >= max(len(a), len(b)) * num:
                    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                    both = int((b[at] == a).sum())
                keep.append(den * both >= num * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, comp: the smallest node that each node of the edges reaches.

    Edges are alternately hung onto the smallest neighbour, which halves path lengths, until
    nothing changes; every round is written to the shared folder, and the one before deleted.
    """
    state = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    now, before = state(e), None
    while now[0] and now != before:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Each neighbour above u, and u itself, hangs onto u's smallest neighbour.
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = cut(small.filter("u <> v").distinct())
        forget(e)
        e, before, now = new, now, state(new)
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v"), F.col("v")).distinct())


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, bits: int = 64) -> DataFrame:
    """Components of the documents whose word n-gram sets have a Jaccard index of num / den or more.

    Words are runs of other than [\\x20\\x09-\\x0D], with A-Z lower-cased; texts of fewer than
    ``words`` words have their whole sequence as one n-gram. Returns for each row of docs: doc_id,
    n_shingles (size of the set), component_id (the smallest doc_id that links reach, itself
    included). Documents without words, null texts among them, link with nothing and keep their
    own id; rows with the same set are linked; a null doc_id keeps null unless linked rows have
    an id. An empty table gives an empty table; texts may be of any length; other columns are
    ignored. N-grams are compared by 64-bit hashes. Sets are told apart by 128 bits: where two
    have the same first half, as is found by grouping, their second half is their id. ``bits``
    shortens the first half, so that tests see this happen.
    """
    return _labelled(docs, words, num, den, bits).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of docs without all but the first (smallest doc_id, null last) of each component.

    Documents without words all stay; of rows with the same doc_id and text one stays. All
    columns are kept. An empty table gives an empty table.
    """
    rows = _labelled(docs, words, num, den)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_r1", "_r2"))
    stay = rows.filter("n_shingles > 0").groupBy("comp").agg(first.alias("f")).select(F.col("f._r1").alias("_k1"), F.col("f._r2").alias("_k2"))
    each = rows.groupBy(F.col("_r1").alias("_k1"), F.col("_r2").alias("_k2")).agg(F.count("*").alias("n"), F.max("n_shingles").alias("size"))
    # Few rows go or are repeated; the others needn't be dealt anew.
    marked = each.join(stay.withColumn("_first", F.lit(True)), ["_k1", "_k2"], "left")
    marked = cut(marked.select("_k1", "_k2", (F.col("_first").isNotNull() | (F.col("size") == 0)).alias("stays"), (F.col("n") > 1).alias("again")).filter("again or not stays"))
    out = keyed(docs).drop("_source")
    plain = out.join(few(marked.select("_k1", "_k2")), ["_k1", "_k2"], "left_anti").select("_row.*")
    again = out.join(few(marked.filter("stays and again").select("_k1", "_k2")), ["_k1", "_k2"], "left_semi")
    rn = F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy("_k1"))
    return plain.unionByName(again.withColumn("_rn", rn).filter("_rn = 1").select("_row.*"))


def _labelled(docs: DataFrame, words: int, num: int, den: int, bits: int = 64) -> DataFrame:
    """doc_id, _r1, _r2, n_shingles, comp (null without words) and component_id for each row."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("bytes"), *row_key())
    classes, clash = Classes(num, den), np.zeros(0, np.int64)
    while True:
        rows = cut(d.mapInArrow(_node_rows(words, classes, clash, bits), NODE_ROWS))
        nodes = rows.filter("n_shingles > 0").groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.min("other").alias("lo"), F.max("other").alias("hi"), *[F.min(c).alias(c) for c in ("n_shingles", "class", "need", "need_up")]
        )
        nodes = cut(nodes)
        found = [r["node"] for r in nodes.filter("lo <> hi").select("node").collect()]
        if not found:
            break
        clash = np.append(clash, np.array(found, np.int64))
        forget(rows, nodes)
    comp = _node_components(d.select("doc_id", "bytes"), nodes, words, classes, num, den, clash, bits)
    named = nodes.select("node", "doc_id").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    by_node = cut(named.join(least, "comp").select("node", "comp", "component_id"))
    forget(nodes)
    linked = rows.filter("n_shingles > 0").join(by_node, "node")
    alone = rows.filter("n_shingles = 0").withColumn("comp", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id"))
    return linked.unionByName(alone).select("doc_id", "_r1", "_r2", "n_shingles", "comp", "component_id")


def _open(num: int, den: int):
    """Compares queries with the members of one block, if the bound of the block's union lets them."""

    def run(queries: pa.Table, members: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        sets = [np.frombuffer(x, np.uint64) for x in members.column("items").to_pylist()]
        if sets and queries.num_rows:
            size = np.array(list(map(len, sets)))
            item, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            order = np.argsort(item, kind="stable")
            item, of = item[order], of[order]
            node, comp = (members.column(k).to_numpy() for k in ("node", "comp"))
            for q, own, x in zip(*(queries.column(k).to_pylist() for k in ("node", "comp", "items"))):
                x = np.frombuffer(x, np.uint64)
                lo, hi = np.searchsorted(item, x), np.searchsorted(item, x, side="right")
                bound = int((hi > lo).sum())
                if den * bound < num * (len(x) + int(size.min()) - bound):
                    continue
                n = hi - lo
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                both = np.bincount(of[at], minlength=len(sets))
                link = np.flatnonzero((den * both >= num * (len(x) + size - both)) & (comp != own))
                _, one = np.unique(comp[link], return_index=True)  # one link for each group is enough
                out += [(q, int(node[i])) for i in link[one]]
        return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return run


def _node_components(d: DataFrame, nodes: DataFrame, words: int, classes: Classes, num: int, den: int, clash: np.ndarray, bits: int) -> DataFrame:
    """node, comp for the nodes that link with others."""
    tokens = d.mapInArrow(_token_rows(words, classes, clash, bits), "token long, node long")
    shared = cut(tokens.repartition("token").sortWithinPartitions("token", "node").mapInArrow(_shared, "token long, node long"))
    of_code = F.col("token").bitwiseAND((1 << CODE_BITS) - 1).cast("int").alias("code")
    grams = F.ceil(F.col("n_shingles") * num / den)
    entry = lambda code, need: F.struct(code.alias("code"), need.cast("long").alias("need"))
    own = 2 * F.col("class")
    needs = nodes.select("node", F.inline(F.array(entry(own, F.col("need")), entry(own + 2, F.col("need_up")), entry(own + 1, grams), entry(own + 3, grams))))

    def enough(counted: DataFrame, n: str) -> DataFrame:
        """Rows of counted (node, code, n) with as many tokens as a link of the node by this code needs."""
        return counted.join(needs, ["node", "code"]).filter(F.col(n) >= F.col("need")).drop("need", "code", n)

    def sets_of(wanted: DataFrame) -> DataFrame:
        ids = cut(nodes.join(wanted, "node").select("doc_id").distinct())
        chosen = d.join(few(ids), "doc_id", "left_semi").unionByName(d.filter("doc_id is null"))
        sets = chosen.mapInArrow(_set_rows(words, clash, bits), "node long, items binary")
        out = cut(sets.join(few(wanted), "node", "left_semi").dropDuplicates(["node"]))
        forget(ids)
        return out

    # The hub of a token is the node whose tokens have the most nodes: the original of many copies.
    counts = shared.groupBy("token").agg(F.count("*").alias("n"))
    central = shared.join(counts, "token").groupBy("node").agg(F.sum("n").alias("central"))
    hubs = cut(shared.join(central, "node").groupBy("token").agg(F.max_by("node", F.struct("central", "node")).alias("hub")))
    pairs = shared.join(hubs, "token").filter("node <> hub").groupBy("node", "hub", of_code).agg(F.count("*").alias("n"))
    pairs = cut(enough(pairs, "n").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = sets_of(wanted)
    x = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    found = cut(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_linked(num, den), "a long, b long"))
    forget(sets, wanted, pairs)
    comp = cut(components(found))
    forget(found)
    # Tokens that more than one group has, and of their nodes those with as many as a link needs.
    each = shared.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = each.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    rest = cut(each.join(mixed, "token"))
    forget(shared)
    able = enough(rest.groupBy("node", of_code).agg(F.count("*").alias("n")), "n").distinct()
    able = cut(able)
    at = cut(rest.join(able, "node", "left_semi"))
    forget(rest)
    # They are dealt into blocks of one hub and size class. A hub has more central tokens than what hangs on it.
    hub = at.join(hubs, "token").groupBy("node", "hub").agg(F.count("*").alias("n"))
    hub = cut(hub.groupBy("node").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub")))
    for _ in range(3):  # the hub of the hub, and so on: similar nodes come into few blocks
        up = hub.select(F.col("node").alias("hub"), F.col("hub").alias("up"))
        new = cut(hub.join(up, "hub", "left").select("node", F.coalesce("up", "hub").alias("hub")))
        forget(hub)
        hub = new
    many = at.select("node", "comp").distinct().join(hub, "node").join(nodes.select("node", F.col("n_shingles").alias("size"), "class"), "node")
    many = cut(many)
    forget(hubs, able, hub)
    weight = many.groupBy("comp").agg(F.count("*").alias("weight"))
    parts = many.groupBy("hub", "class").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / ITEMS)).alias("parts"))
    block = F.xxhash64("hub", "class", F.pmod(F.xxhash64("node"), "parts")).alias("block")
    placed = cut(many.join(parts, ["hub", "class"]).join(weight, "comp").select("node", "comp", "weight", block))
    forget(many)
    dealt = at.select("token", "node").join(placed, "node")
    rank = F.struct("weight", "comp")
    matrix = dealt.groupBy("token", "block").agg(F.max(rank).alias("most"))
    # A group is asked by nodes of smaller groups, or of groups as large with a smaller name.
    asked = dealt.select("token", "node", rank.alias("own")).join(matrix, "token").filter("own < most")
    asked = asked.groupBy("node", "block", of_code).agg(F.count("*").alias("overlap"))
    asked = cut(enough(asked, "overlap").distinct())
    forget(at)
    members = cut(placed.join(asked.select("block").distinct(), "block", "left_semi").select("node", "comp", "block"))
    wanted = cut(members.select("node").union(asked.select("node")).distinct())
    sets = sets_of(wanted)
    loads = asked.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).alias("tasks"))
    queries = asked.join(loads, "block").withColumn("task", F.pmod(F.xxhash64("node"), "tasks")).drop("tasks")
    columns = ["node", "block", "task", "comp", "items"]
    queries = queries.join(placed.select("node", "comp"), "node").join(sets, "node").select(*columns).toDF(*columns)
    members = members.join(loads, "block").withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1))).drop("tasks")
    members = members.join(sets, "node").select(*columns)
    more = queries.groupBy("block", "task").cogroup(members.groupBy("block", "task")).applyInArrow(_open(num, den), "a long, b long")
    more = cut(more)
    forget(asked, wanted, sets, placed)
    # Links between groups merge them.
    name = lambda k: comp.select(F.col("node").alias(k), F.col("comp").alias(f"c{k}"))
    links = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = cut(components(links)).toDF("comp", "into")
    of_group = comp.join(merged, "comp", "left").select("node", F.coalesce("into", "comp").alias("comp"))
    singles = merged.join(comp.select(F.col("node").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("node"), F.col("into").alias("comp"))
    return of_group.unionByName(singles)
