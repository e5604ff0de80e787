"""Byte-level BPE by dynamic programming over byte prefixes."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame


class Vocabulary:
    """Ranks of a tiktoken file and what decides whether two tokens may stand side by side.

    Each token of two bytes or more is made by one last merge of a left and a right part. Seen
    from a boundary between tokens a and b, the pieces next to it while merging runs are the
    right edge of a (a, its right part, that one's right part, ...) and the left edge of b. A
    piece is there until the merge that consumes it. A merge across the boundary happens if its
    rank comes before both pieces are consumed; at equal rank the leftmost goes first, so it
    must be strictly before on the left side. If no such merge exists, the pair is valid.
    """

    NEVER = 1 << 60

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {r: b for b, r in self.ranks.items()}
        self.text_of = {r: str(r) for r in self.bytes_of}
        self.longest = max(map(len, self.ranks))
        self.parts: dict[int, tuple[int, int]] = {}
        self.reachable: dict[bytes, int] = {b: r for b, r in self.ranks.items() if len(b) == 1}
        for b, r in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(b) > 1 and (p := self._merge(b, r)) is not None:
                self.parts[r] = p
                self.reachable[b] = r
        self.right = {r: self._edge(r, 1) for r in self.reachable.values()}
        self.left = {r: self._edge(r, 0) for r in self.reachable.values()}
        self.valid_pairs: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        # All tokens that end at a byte, longest first, come from one walk over the bytes (as Latin-1).
        self.ending = ahocorasick.Automaton()
        for b, r in self.reachable.items():
            self.ending.add_word(b.decode("latin-1"), (len(b), r))
        self.ending.make_automaton()

    def _merge(self, data: bytes, below: int) -> tuple[int, int] | None:
        """The two tokens that merges of lower rank leave of a token's bytes; None if not two."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            best = min(((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1)))
            if best[0] >= below:
                return None
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        known = [self.reachable.get(p) for p in parts]
        return None if None in known else (known[0], known[1])

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """(bytes, rank of the merge that consumes it) for each piece on one edge of a token."""
        out, until = [], self.NEVER
        while True:
            out.append((self.bytes_of[token], until))
            if token not in self.parts:
                return out
            until, token = token, self.parts[token][side]

    def valid(self, a: int, b: int) -> bool:
        k = a << 20 | b
        known = self.valid_pairs.get(k)
        if known is None:
            known = self.valid_pairs[k] = self._apart(a, b)
            if len(self.valid_pairs) > 2_000_000:
                self.valid_pairs.clear()
        return known

    def _apart(self, a: int, b: int) -> bool:
        get = self.ranks.get
        for x, p in self.right[a]:
            for y, q in self.left[b]:
                m = get(x + y)
                if m is not None and m < p and m <= q:
                    return False
        return True

    def encode_text(self, text: str, pattern: regex.Pattern) -> list[int]:
        """Ids of all matches of the pattern; matches met before are looked up.

        When the table of matches is full it becomes the older one, and matches that are met
        again come over from there, so frequent ones are never made anew.
        """
        out: list[int] = []
        known = self.pieces.get
        for p in pattern.findall(text):
            ids = known(p)
            if ids is None:
                ids = self.older.get(p)
                if ids is None:
                    ids = self.encode_piece(p.encode())
                if len(self.pieces) >= 150_000:
                    self.older, self.pieces = self.pieces, {}
                    known = self.pieces.get
                self.pieces[p] = ids
            out += ids
        return out

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else tuple(PrefixTable(self, data).ids())

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PrefixTable:
    """The last token of the encoding of every prefix of some bytes.

    A prefix has exactly one valid encoding. Its last token t is that for which the encoding of
    the prefix before t ends in a token that may stand left of t. Appended bytes leave all
    earlier entries as they are. After an edit, entries from there on are made anew until a
    token's greatest length of them agree with the old ones.
    """

    def __init__(self, vocab: Vocabulary, data: bytes = b""):
        self.vocab, self.data, self.last = vocab, b"", []
        self.append(data)

    def _fill(self, upto: int, stop_when=None) -> int:
        """Makes the entries up to ``upto`` bytes; stops early where stop_when(end) says so."""
        v, last, done = self.vocab, self.last, len(self.last)
        valid, known = v.valid, v.valid_pairs.get
        # A token that ends at the first missing entry begins at most ``longest`` bytes before its end.
        first = max(0, done + 1 - v.longest)
        for end, (n, t) in v.ending.iter(self.data[first:upto].decode("latin-1")):
            end += first
            if end < done:
                continue
            if end > done:
                break
            start = end + 1 - n
            if start:
                a = last[start - 1]
                ok = known(a << 20 | t)
                if not (valid(a, t) if ok is None else ok):
                    continue
            last.append(t)
            done += 1
            if stop_when is not None and stop_when(done):
                return done
        if done < upto:
            raise ValueError(f"byte {self.data[done]} is not in the vocabulary")
        return upto

    def append(self, data: bytes) -> None:
        self.data += data
        self._fill(len(self.data))

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Puts data in place of bytes start to end; returns how many entries were made anew."""
        old, shift = self.last, len(data) - (end - start)
        self.data = self.data[:start] + data + self.data[end:]
        self.last, agree = old[:start], 0

        def settled(at: int) -> bool:
            nonlocal agree
            agree = agree + 1 if at > start + len(data) and old[at - shift - 1] == self.last[-1] else 0
            return agree >= self.vocab.longest

        at = self._fill(len(self.data), settled)
        self.last += old[at - shift :]
        return at - start

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocab.bytes_of[out[-1]])
        return out[::-1]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def bpe_round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    path: a rank file that is found under the same path on every machine; pattern: splits a
    text before the merges. Returns doc_id, ids array<int> and decoded binary for each row. A
    null or empty text has no ids and decodes to no bytes. Each row is encoded alone: null or
    repeated ids and repeated rows do no harm; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, split = vocabulary(path), regex.compile(pattern)
        for batch in batches:
            ids = [v.encode_text(t, split) if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(map(v.decode, ids), pa.binary())],
                ["doc_id", "ids", "decoded"],
            )

    d = docs.select("doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")
