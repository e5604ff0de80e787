"""Line dedup over levelled sorted runs of line digests (DataFrame functions only)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.llm.common import ascii_lower, cut, delete, digest, distinct_structs, few, forget, row_key, shared_dir, strip_ws, without

H = ["h1", "h2"]


class LineRuns:
    """Document counts of line digests, as runs sorted by digest that are merged level by level.

    A batch is first anti-joined with the digests that a run already holds as frequent: those
    need no more counting. The rest is written as a run of its own, so a batch never rewrites
    older runs. When a level has ``fanout`` runs, they are merged into one run of the next
    level. Runs are Parquet in the shared folder, so a lost executor costs no state.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 3):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.root = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h1 long, h2 long, n_docs long").parquet(*paths)

    def _write(self, run: DataFrame, level: int) -> None:
        path = f"{self.root}/{level}-{uuid.uuid4().hex}"
        run.sortWithinPartitions(*H).write.parquet(path)
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(path)

    def add(self, keys: DataFrame) -> None:
        """keys: columns h1 and h2, one row for each document that has the line."""
        batch = keys.groupBy(*H).agg(F.count("*").alias("n_docs"))
        if paths := [p for level in self.levels for p in level]:
            known = self._read(paths).filter(F.col("n_docs") >= self.min_docs).select(*H)
            batch = batch.hint("merge").join(known, H, "left_anti")
        self._write(batch, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self._write(self._read(merged).groupBy(*H).agg(F.sum("n_docs").alias("n_docs")), level + 1)
            level += 1

    def drop(self) -> None:
        """Deletes the runs; for when nothing reads them any more."""
        delete(self.spark, self.root)

    def frequent(self) -> DataFrame:
        """Digests found in min_docs documents or more, over all runs."""
        paths = [p for level in self.levels for p in level]
        if not paths:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        total = self._read(paths).groupBy(*H).agg(F.sum("n_docs").alias("n_docs"))
        return total.filter(F.col("n_docs") >= self.min_docs).select(*H)


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """Drops every line whose key is found in at least ``min_docs`` documents.

    A line's key is the line without white space at both ends and with A-Z lower-cased; keys
    under ``min_chars`` code points are always kept. Every row is a document, also one that
    repeats another. Returns doc_id, text (what is left), n_lines and n_dropped for every row.
    A null or empty text is one empty line. A null doc_id stays null and counts like any
    other. An empty table gives an empty table; texts may be of any length. Other columns are left
    out, but for those named in ``carry``. Digests have 128 bits; two different keys with the same
    digest are not expected in any real corpus.
    """
    spark = docs.sparkSession
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *carry)
    lines = F.split("text", "\n", -1)
    key = lambda line: ascii_lower(strip_ws(line))
    hashed = F.transform(
        F.transform(lines, key),
        lambda k: F.when(F.char_length(k) >= min_chars, F.struct(*[h.alias(n) for h, n in zip(digest(k), H)])),
    )
    narrow = cut(d.select(*row_key(), hashed.alias("keys")))
    runs = LineRuns(spark, min_docs)
    for b in range(batches):
        part = narrow.filter(F.pmod("_r1", F.lit(batches)) == b)
        distinct = part.select(F.explode(distinct_structs(F.col("keys"))).alias("k")).filter("k is not null")
        runs.add(distinct.select("k.h1", "k.h2"))
    # Frequent digests are few, by count: then each line is looked up where it is.
    frequent = cut(runs.frequent())
    each = narrow.select("_r1", "_r2", F.posexplode("keys").alias("pos", "k")).filter("k is not null").select("_r1", "_r2", "pos", "k.h1", "k.h2")
    gone = cut(each.join(few(frequent), H).groupBy("_r1", "_r2").agg(F.sort_array(F.collect_set("pos")).alias("gone")))
    forget(narrow, frequent)
    runs.drop()
    held = gone.agg(F.sum(F.lit(1) + F.size("gone"))).first()[0] or 0
    side = F.broadcast(gone) if held <= 500_000 else gone
    joined = d.select("*", *row_key()).join(side, ["_r1", "_r2"], "left").withColumn("lines", lines)
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(without(F.col("lines"), F.col("gone")))
    return (
        joined.withColumn("kept", kept)
        .select(
            "doc_id",
            F.array_join("kept", "\n").alias("text"),
            *carry,
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        )
    )
