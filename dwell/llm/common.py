"""Expressions and session helpers that the text operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: [\x20\x09-\x0D].
WS = " \t\n\x0b\x0c\r"
WS_RUN = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def strip_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone; lower() is faster and the same where every character is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def words(c: Column) -> Column:
    """The words of a text in order; none for null."""
    inner = strip_ws(F.coalesce(c, F.lit("")))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WS_RUN))


def n_words(c: Column) -> Column:
    inner = strip_ws(F.coalesce(c, F.lit("")))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, WS_RUN))).cast("long")


def digest(*cols: Column) -> list[Column]:
    """128 bits as two longs with independent seeds (the second hash starts from another state)."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit("second half"), *cols)]


def row_key(names: tuple[str, str] = ("_r1", "_r2")) -> list[Column]:
    """Key of a row by its doc_id and text: never null, and the same for rows that repeat each other."""
    cols = [F.col("doc_id").cast("string"), F.col("text"), F.col("text").isNull(), F.col("doc_id").isNull()]
    return [h.alias(n) for h, n in zip(digest(*cols), names)]


def keyed(docs: DataFrame) -> DataFrame:
    """_row, all columns of docs in a struct that no other name can clash with, and the row key, source too."""
    source = [F.col("source").alias("_source")] if "source" in docs.columns else []
    return docs.select(F.struct("*").alias("_row"), *row_key(("_k1", "_k2")), *source)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset, a session that runs in one machine (as in tests) takes a temporary one;
    any other has to name one, as its machines wouldn't find each other's files.
    """
    sc = spark.sparkContext
    where = sc.getCheckpointDir()
    if where is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            where = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(where)
        where = sc.getCheckpointDir()
    return where


_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back, which ends its lineage and keeps its statistics.

    Shuffle files of the lineage, which nothing needs any more, are deleted by Spark when the
    driver's JVM collects what refers to them; it is told to do so now.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(*frames: DataFrame) -> None:
    """Deletes what cut has written for these frames; to be called once their last readers are written."""
    for f in frames:
        delete(f.sparkSession, _WRITTEN.pop(f))


def bind(c: Column, f) -> Column:
    """f of c, with c computed once however often f uses it, also within lambdas."""
    return F.transform(F.array(c), f)[0]


def without(lines: Column, drop: Column) -> Column:
    """An array without the places in drop (from 0), by one sort of both together, so that long texts cost no more a line."""
    marks = F.transform(drop, lambda g: F.struct(g.cast("int").alias("i"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("line")))
    each = F.transform(lines, lambda x, i: F.struct(i.cast("int").alias("i"), F.lit(1).alias("kind"), x.alias("line")))
    gone = lambda s, x, j: F.coalesce((F.get(s, j - 1)["kind"] == 0) & (F.get(s, j - 1)["i"] == x["i"]), F.lit(False))
    left = bind(F.sort_array(F.concat(marks, each)), lambda s: F.filter(s, lambda x, j: (x["kind"] == 1) & ~gone(s, x, j)))
    return F.transform(left, lambda x: x["line"])


def distinct_structs(c: Column) -> Column:
    """The distinct structs of an array, sorted; array_distinct compares each struct with all others."""
    return bind(F.sort_array(c), lambda s: F.filter(s, lambda x, j: (j == 0) | ~x.eqNullSafe(F.get(s, j - 1))))


def sums_before(sizes: Column) -> Column:
    """For each element of an array of longs the sum of those before it, and the sum of all at the end.

    Sums run over stretches of about the square root of the elements, as each step of a running sum copies it.
    """
    run = lambda a: F.aggregate(a, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    stretch = lambda a, c, j: F.filter(F.transform(F.sequence(j * c, j * c + c - 1), lambda i: F.get(a, i)), lambda x: x.isNotNull())

    def over(a: Column, c: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), c), lambda j: run(stretch(a, c, j)))
        whole = lambda r: run(F.transform(r, lambda x: F.element_at(x, -1)))
        shifted = lambda r, base: F.flatten(F.transform(r, lambda x, j: F.transform(F.slice(x, 1, F.size(x) - 1), lambda y: y + F.get(base, j))))
        return bind(runs, lambda r: bind(whole(r), lambda base: F.concat(shifted(r, base), F.slice(base, -1, 1))))

    return bind(sizes, lambda a: bind(F.ceil(F.sqrt(F.size(a))).cast("int"), lambda c: over(a, c)))


def few(keys: DataFrame, most: int = 500_000) -> DataFrame:
    """keys, to be broadcast if they are a few longs a row and no more than ``most`` rows by count."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys
