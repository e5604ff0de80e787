"""Query texts: normal form and key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Of the normal form: what stands without spaces around it, and words that are literals. Fixed values.
TIGHT = ",()[]=<>+-*/%^;:."
KEYWORDS = "null|true|false"
VERSION = "normal form 2"

#: A word that is no keyword and no literal's prefix. Runs of these with single spaces are their own normal form, and so one token.
PLAIN = rf"(?! (?i: {KEYWORDS} ) (?![\w$]) | [eEbBxX]' | [uU]&' ) [^\W\d][\w$]*+"
#: Tokens of a query text, tried in this order; comments nest.
TOKEN = regex.compile(
    rf"""
    (?P<words> {PLAIN} (?: \x20 {PLAIN} )*+ )
    | (?P<space> (?: \s | --[^\n\r]* | (?P<comment> /\* (?: [^/*] | /(?!\*) | \*(?!/) | (?&comment) )*+ \*/ ) )+ )
    | (?P<literal> (?: [eEbBxX] | [uU]& )? ' (?: [^'\\] | '' | \\. )* (?: ' | \Z )
        | \$ (?P<tag> (?: [^\W\d]\w* )? ) \$ .*? \$ (?i: (?P=tag) ) \$
        | 0[xX][\da-fA-F_]*
        | (?: \d[\d_]* (?: \.(?!\.)[\d_]* )? | (?<![\w.])\.\d[\d_]* ) (?: [eE][+-]?\d[\d_]* )?
        | (?i: {KEYWORDS} ) (?![\w$]) )
    | (?P<whole> " (?: [^"] | "" )* " | [^\W\d][\w$]* | \$\d+ )
    | (?P<open> /\* | " | \$ (?: [^\W\d]\w* )? \$ )
    | (?P<other> . )
    """,
    regex.VERBOSE | regex.DOTALL,
)


def normalise(text: str) -> str | None:
    """Comments off, literals as ?, one space between words and none around punctuation.

    Quoted names and numbered parameters stay as they are. A text that ends within a comment, a
    quoted name or a dollar-quoted literal is incomplete and has no normal form.
    """
    out, gap = [], False
    for m in TOKEN.finditer(text):
        kind, token = m.lastgroup, m[0]
        if kind in ("comment", "tag"):
            kind = "space" if m["space"] else "literal"
        if kind == "open":
            return None
        if kind == "space":
            gap = True
            continue
        if kind == "literal":
            token = "?"
        if gap and out and out[-1][-1] not in TIGHT and token[0] not in TIGHT:
            out.append(" ")
        out.append(token)
        gap = False
    return "".join(out)


@pandas_udf(StringType())
def normalised(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(normalise, na_action="ignore")


def text_keys(texts: DataFrame, context: list[str] | None = None) -> DataFrame:
    """Per normal form (and columns of context, such as database and user) its key, how many texts and
    rows it has, and the smallest text. Distinct texts are normalised once.

    The key is a hash of the form's version, the context and the normal form; 0 is kept for no
    key, which texts without a normal form have.
    """
    context = context or []
    one = texts.filter("text is not null").groupBy(*context, "text").agg(F.count("*").alias("n_rows"))
    n = one.withColumn("normal", normalised("text")).groupBy(*context, "normal").agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_texts"), F.min("text").alias("sample"))
    h = F.xxhash64(F.lit(VERSION), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in context], "normal")
    return n.withColumn("key", F.when(F.col("normal").isNull(), 0).when(h == 0, 1).otherwise(h))
