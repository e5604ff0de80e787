"""License scans: a trained paragraph classifier confirmed by templates (DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.llm.common import bind, cut, sums_before

UNKNOWN = "unknown"

#: Notices by which works declare a licence, by family.
TEMPLATES = {
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the 2-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "cc0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL version 2.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "lgpl": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "mpl": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}

#: Sentences about licences that declare none.
MENTIONS = [
    "A driving licence is valid for ten years from the day on which it was issued.",
    "The club applied for a licence to sell alcohol and paid the fee to the city.",
    "The licence fee of the broadcaster rises again next year.",
    "It was a licence to print money, as he said of the new television station.",
    "See the file named LICENSE for what applies to this work.",
    "The authors discuss how courts have read open source licenses in recent years.",
    "Some packages are licensed differently, and their terms have to be checked one by one.",
    "This license agreement is made between the customer and the vendor of the service.",
    "Students wrote about the history of the free software movement and of public licences.",
    "No license, express or implied, is granted by this statement of the company.",
    "He lost his fishing license after the second offence on the lake.",
    "The foundation published a draft of the next version of its public license for comment.",
]


def grams(text: Column) -> Column:
    """Distinct word bigrams and trigrams of a paragraph."""
    w = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    # Bound once for each paragraph, not for each n-gram.
    return bind(
        w,
        lambda a: F.array_distinct(
            F.flatten(
                F.transform(
                    F.when(F.size(a) > 1, F.sequence(F.lit(0), F.size(a) - 2)).otherwise(F.array().cast("array<int>")),
                    lambda i: F.filter(
                        F.array(F.concat_ws(" ", a[i], a[i + 1]), F.when(i + 2 < F.size(a), F.concat_ws(" ", a[i], a[i + 1], F.get(a, i + 2)))),
                        lambda g: g.isNotNull(),
                    ),
                )
            )
        ),
    )


def templates(spark: SparkSession) -> DataFrame:
    """family, template (number) and text of each notice."""
    rows = [(f, i, t) for f, ts in TEMPLATES.items() for i, t in enumerate(ts)]
    array = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(i).alias("template"), F.lit(t).alias("text")) for f, i, t in rows])
    return spark.range(1).select(F.explode(array).alias("t")).select("t.*")


@dataclass
class LicenseModel:
    pipeline: PipelineModel
    families: list[str]
    threshold: float


def fit(docs: DataFrame, weight: int = 1000, contexts: int = 8) -> LicenseModel:
    """Trains on the templates and all paragraphs of the corpus.

    Features are the n-grams that templates have, so paragraphs with the same ones are one row with their count. Paragraphs
    that hold half of a template or more are no examples of ``unknown`` and are
    left out. Each template is learned alone and set among the n-grams that most paragraphs hold, so that a
    notice in running text is known too. One half of the paragraphs trains the class
    ``unknown``, with ``weight`` for all of them together, and one half of MENTIONS; on the other halves the threshold is calibrated: no
    more than one in a thousand of the paragraphs (by probabilities rounded up to four digits) and none of the sentences may get a family with
    that probability. A text of any length gives its lines; null and empty ones give none, and an
    empty table leaves the templates and MENTIONS to learn from.
    """
    spark = docs.sparkSession
    known = templates(spark).withColumn("tg", grams(F.col("text")))
    marked = F.broadcast(known.agg(F.collect_list("tg").alias("each")))
    listed = _listed(spark)
    # An outer explode of one array: a plain one would have Spark make the lines twice more.
    lines = docs.select("text").filter("text is not null").select(F.explode_outer(F.split("text", "\n", -1)).alias("text")).filter("trim(text) <> ''")
    half = F.pmod(F.xxhash64(F.lit("half"), "text"), F.lit(2)).alias("half")
    held = lines.select(half, F.sort_array(bind(_words(F.col("text")), lambda w: _known(w, listed))).alias("grams")).groupBy("half", "grams").agg(F.count("*").alias("n"))
    held = held.join(marked).filter(~F.exists("each", lambda t: F.size(F.array_intersect(t, F.col("grams"))) * 2 >= F.size(t))).select("half", "grams", "n")
    held = cut(held)
    train = held.filter("half = 0")
    around = train.filter("size(grams) > 0").orderBy(F.desc("n"), "grams").limit(contexts).select(F.col("grams").alias("around"))
    told = train.agg(F.sum("n").alias("of"))
    families = sorted(TEMPLATES)
    label = F.coalesce(F.array_position(F.array(*map(F.lit, families)), F.col("family")), F.lit(0)).cast("double")
    mention = lambda half: spark.range(1).select(F.explode(F.array(*map(F.lit, MENTIONS[half::2]))).alias("text")).select(_known(_words(F.col("text")), listed).alias("grams"))
    one = F.lit(1.0).alias("weight")
    rows = known.select("family", F.col("tg").alias("grams"), one).union(known.join(F.broadcast(around)).select("family", F.array_union("tg", "around"), one))
    rows = rows.union(train.join(F.broadcast(told)).select(F.lit(UNKNOWN), "grams", F.col("n") * F.least(F.lit(1.0), weight / F.col("of")))).union(mention(0).select(F.lit(UNKNOWN), "grams", one))
    rows = cut(rows.select(label.alias("label"), "grams", "weight"))
    counter = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=1.0, vocabSize=1 << 24).fit(rows.filter("label > 0"))
    learner = LogisticRegression(family="multinomial", regParam=0.001, elasticNetParam=0.5, maxIter=60, standardization=False, weightCol="weight")
    model = PipelineModel([counter, learner.fit(counter.transform(rows))])
    best = F.array_max(F.slice(vector_to_array("probability"), 2, len(families)))
    tried = model.transform(held.filter("half = 1")).groupBy(F.least(F.lit(1.0), F.ceil(best * 10000) / 10000).alias("best")).agg(F.sum("n").alias("n"))
    high = tried.agg(F.percentile("best", 0.999, F.col("n"))).first()[0]
    told = model.transform(mention(1)).agg(F.max(best)).first()[0]
    return LicenseModel(model, families, max(0.5, high or 0.0, told))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _listed(spark: SparkSession) -> list[str]:
    """The n-grams of all templates: literals, so that Spark looks each up in one set that it makes once."""
    return sorted({g for r in templates(spark).select(grams(F.col("text")).alias("tg")).collect() for g in r["tg"]})


def _known(w: Column, listed: list[str]) -> Column:
    """Of words in order the distinct bigrams and trigrams that are ``listed``. Both bigrams of a listed trigram are, so
    trigrams are made only of words with two listed bigrams or more, and bigrams only of words that begin one."""
    two, three = [g for g in listed if g.count(" ") == 1], [g for g in listed if g.count(" ") == 2]
    heads = sorted({g.split(" ")[0] for g in two})
    chosen = lambda a, of: F.filter(a, lambda g: g.isin(of))
    pairs = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda x, y: F.when(x.isin(heads), F.concat(x, F.lit(" "), y)))
    longer = lambda p: F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(w, 3, F.size(w)), lambda x, y: F.concat(x, F.lit(" "), y))
    both = lambda p: bind(chosen(p, two), lambda q: F.when(F.size(q) < 2, q).otherwise(F.array_distinct(F.concat(q, chosen(longer(p), three)))))
    return F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(bind(pairs, both))


def _parts(text: Column, listed: list[str]) -> Column:
    """Each line of a text: size, words in lower case (an empty one for a blank line), and own, the n-grams that are ``listed``."""
    each = lambda x: bind(_words(x), lambda w: F.struct(F.char_length(x).cast("long").alias("size"), _known(w, listed).alias("own"), F.when(F.size(w) > 0, w).otherwise(F.array(F.lit(""))).alias("words")))
    return F.transform(F.split(text, "\n", -1), each)


def _places(parts: Column, listed: list[str], reach: int, least: Column) -> Column:
    """Each line of a text by its _parts: paragraph (from 0), start, own, and near: wide of the line before, its own and that of the one after.

    own are the line's n-grams that are ``listed``; wide are those of the line with the first ``reach``
    words of the lines after it up to a blank one (null where it is blank itself). wide is made only where the n-grams found in
    these lines, and across their ends, are ``least`` or more; else it holds none. Words of all lines are in one array, in
    which a blank line has an empty word, and sums tell where a line begins there and what is found up to it, so that a line
    costs the same in texts of any length.
    """
    def across(base: Column, x: Column, i: Column) -> Column:
        """How many listed n-grams may stand across the end of a line: 3, if its last and the next line's first word are one."""
        following = F.get(F.get(base, i + 1)["words"], F.lit(0))
        pair = F.concat_ws(" ", F.element_at(x["words"], -1), following)
        return F.when(pair.isin([g for g in listed if g.count(" ") == 1]), 3).otherwise(0)

    def each(base: Column, starts: Column, flat: Column, firsts: Column, lines_of: Column, hits: Column) -> Column:
        def place(x: Column, i: Column) -> Column:
            first = F.get(firsts, i + 1)
            last = F.get(lines_of, F.least(first + reach, F.size(flat).cast("long")).cast("int") - 1)
            enough = F.get(hits, last + 1) - F.get(hits, i) >= least
            after = F.filter(F.transform(F.sequence(first, first + reach - 1), lambda k: F.get(flat, k.cast("int"))), lambda w: w.isNotNull())
            more = bind(after, lambda a: F.when(F.array_contains(a, ""), F.slice(a, 1, F.array_position(a, "").cast("int") - 1)).otherwise(a))
            none = F.array().cast("array<string>")
            wide = F.when(F.get(x["words"], F.lit(0)) != "", F.when(enough, bind(F.concat(x["words"], more), lambda w: _known(w, listed))).otherwise(none))
            return F.struct(i.cast("int").alias("paragraph"), F.get(starts, i).cast("int").alias("start"), wide.alias("wide"), x["own"].alias("own"))

        return F.transform(base, place)

    def over(base: Column) -> Column:
        sums = lambda f: sums_before(F.transform(base, f))
        starts = sums(lambda x: x["size"] + 1)
        firsts = sums(lambda x: F.size(x["words"]).cast("long"))
        hits = sums(lambda x, i: (F.size(x["own"]) + across(base, x, i)).cast("long"))
        flat = F.flatten(F.transform(base, lambda x: x["words"]))
        lines_of = F.flatten(F.transform(base, lambda x, j: F.array_repeat(j, F.size(x["words"]))))
        return bind(starts, lambda s: bind(firsts, lambda f: bind(hits, lambda h: bind(flat, lambda w: bind(lines_of, lambda n: each(base, s, w, f, n, h))))))

    places = bind(parts, over)
    beside = lambda p, x, i: F.array(F.get(p, i - 1)["wide"], x["wide"], F.get(p, i + 1)["wide"])
    fields = ["paragraph", "start", "own"]
    return bind(places, lambda p: F.transform(p, lambda x, i: F.struct(*[x[f].alias(f) for f in fields], beside(p, x, i).alias("near"))))


def scan(docs: DataFrame, model: LicenseModel, min_similarity: float = 0.6) -> DataFrame:
    """Places that declare a licence.

    A place is a line of a text, or a line with those that follow it up to a blank one, where a
    notice is wrapped over several; lines of comment marks alone are blank, and marks don't
    count. A wrapped notice is reported at its first line, and reaches twice the words of the
    longest template. Returns doc_id, paragraph (number of the line, from 0), start (offset of
    the line in code points), family, probability, similarity (share of the nearest template's
    n-grams that the place holds) and confirmed (similarity is ``min_similarity`` or more), for
    each family that a template confirms, unless better confirmed families of the place have
    all the n-grams found of it, and for the best family of a line where it is above
    ``unknown`` and above the calibrated threshold. Null and empty texts and an empty table
    give no rows; texts may be of any length; rows that repeat give their rows again; a null
    doc_id stays null; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    texts = [t for ts in TEMPLATES.values() for t in ts]
    reach = 2 * max(len(t.split()) for t in texts)
    known = templates(spark).select("family", grams(F.col("text")).alias("tg"))
    known = F.broadcast(known.agg(F.collect_list(F.struct("family", "tg")).alias("known"), F.min(F.size("tg")).alias("least")))
    # Every text has a line; a plain explode would have Spark make the lines twice more, to ask whether there are any.
    texts = docs.select("doc_id", "text").filter("text is not null").join(known.select("least"))
    listed = _listed(spark)
    texts = texts.select("doc_id", "least", _parts(F.col("text"), listed).alias("parts"))
    lines = texts.select("doc_id", "least", F.explode_outer(_places(F.col("parts"), listed, reach, min_similarity * F.col("least"))).alias("l")).select("doc_id", "least", "l.*")
    # A place without the n-grams that even the shortest template needs can't be confirmed; and none is likely to be a notice without any.
    most = F.greatest(F.size("own"), F.size(F.coalesce(F.get("near", F.lit(1)), F.array().cast("array<string>"))))
    lines = lines.filter((F.size("own") > 0) | (most >= min_similarity * F.col("least")))
    some = model.pipeline.transform(lines.withColumn("grams", F.col("own"))).withColumn("p", vector_to_array("probability"))
    some = some.withColumn("likely", (F.array_max("p") > model.threshold) & (F.col("prediction") > 0) & (F.size("own") > 0))
    some = some.filter(F.col("likely") | (most >= min_similarity * F.col("least"))).select("doc_id", "paragraph", "start", "p", "likely", "prediction", "own", "near")
    at = F.col("paragraph")
    some = cut(some)

    def item(k: Column) -> Column:
        share = lambda g: F.coalesce(F.size(F.array_intersect(k["tg"], g)) / F.size(k["tg"]), F.lit(0.0))
        own, wide = share(F.col("own")), share(F.get("near", F.lit(1)))
        before, after = F.when(at > 0, share(F.get("near", F.lit(0)))).otherwise(0.0), share(F.get("near", F.lit(2)))
        first = (own < min_similarity) & (wide >= min_similarity) & (wide > after) & (before <= wide)
        found = F.array_intersect(k["tg"], F.when(first, F.get("near", F.lit(1))).otherwise(F.col("own")))
        return F.struct(F.when(first, wide).otherwise(own).alias("similarity"), k["family"].alias("family"), found.alias("found"))

    # Items are bound once for each place, not for each family.
    best = lambda items: F.transform(F.array(*map(F.lit, model.families)), lambda f: F.array_max(F.filter(items, lambda x: x["family"] == f)))
    items = some.join(known).select("doc_id", "paragraph", "start", "p", "likely", "prediction", bind(F.transform("known", item), best).alias("best"))
    each = items.withColumn("sure", F.filter("best", lambda x: x["similarity"] >= min_similarity))
    better = lambda x: F.flatten(F.transform(F.filter("sure", lambda y: (y["similarity"] > x["similarity"])), lambda y: y["found"]))
    sure = F.filter("sure", lambda x: F.size(F.array_except(x["found"], better(x))) > 0)
    each = each.withColumn("sure", sure)
    guess = F.when(F.col("likely"), F.filter("best", lambda x: x["family"] == F.element_at(F.array(*map(F.lit, model.families)), F.greatest(F.col("prediction").cast("int"), F.lit(1)))))
    out = each.select("doc_id", "paragraph", "start", "p", F.explode(F.array_distinct(F.concat("sure", F.coalesce(guess, F.slice("best", 1, 0))))).alias("x"))
    probability = F.get("p", F.array_position(F.array(*map(F.lit, model.families)), F.col("x.family")).cast("int"))
    return out.select("doc_id", "paragraph", "start", "x.family", probability.alias("probability"), "x.similarity", (F.col("x.similarity") >= min_similarity).alias("confirmed"))
