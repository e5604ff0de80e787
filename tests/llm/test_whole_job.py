"""Cases of the whole job that the text operators once left out."""

from dwell.llm import langid, licenses, quality, substring_dedup


def deduped(spark, texts, **limits):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in substring_dedup.substring_dedup(d, **limits).orderBy("doc_id").collect()]


def test_whole_line_and_sentence_are_one_group(spark):
    passage = "A passage of one sentence that has " + "many words " * 25 + "and ends."
    around = "Some words that stand before it here. {} Other words that stand after it here."
    assert deduped(spark, [passage, around.format(passage)]) == [passage, around.format("").replace("  ", " ")]
    assert deduped(spark, [around.format(passage), "own line of some other words\n" + passage + "\nlast"]) == [around.format(passage), "own line of some other words\nlast"]
    assert deduped(spark, ["... " + passage, passage]) == ["... " + passage, ""]


def test_short_lines_and_other_scripts_are_units(spark):
    assert deduped(spark, ["first text\nAll rights reserved.\nend", "second\n all rights  RESERVED."]) == ["first text\nAll rights reserved.\nend", "second\n"]
    assert deduped(spark, ["No. He said no to all of them again.", "Yes. No. They were never there at all."]) == ["No. He said no to all of them again.", "Yes. No. They were never there at all."]
    chinese = "这一段话在两个文件里都出现所以应该去掉一次。"
    assert deduped(spark, [chinese, "前面的话说的是另外一件事情。" + chinese + "后面的话也不一样而且更长一些。"]) == [chinese, "前面的话说的是另外一件事情。后面的话也不一样而且更长一些。"]
    quoted = "他对大家说这件事情已经完全结束了。」"
    assert deduped(spark, [quoted + "一。", "第二个文件的开头在这里写着。" + quoted])[1] == "第二个文件的开头在这里写着。"
    thai = "ข้อความนี้ปรากฏอยู่ในเอกสารสองฉบับ "
    assert deduped(spark, [thai + "ตอนท้ายของฉบับแรกต่างออกไป", "ตอนต้นของฉบับที่สองไม่เหมือนกัน " + thai + "จบ"])[1] == "ตอนต้นของฉบับที่สองไม่เหมือนกัน จบ"
    hindi = "यह वाक्य दोनों दस्तावेज़ों में एक ही रूप में आता है। "
    assert deduped(spark, [hindi + "अंत", "शुरुआत अलग है। " + hindi + "और कुछ"])[1] == "शुरुआत अलग है। और कुछ"


def test_quality_removes_lines(spark):
    own = lambda i: "\n".join(f"line {k} of document {i} says w{i}x{k} and y{k}z{i} here" for k in range(3))
    texts = {i: own(i) + "\n \n  Subscribe to OUR letter\n\nlast line " + str(i) for i in range(30)} | {30: own(30), 31: None}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    rows += [rows[4], (40, "Subscribe to our letter\n" * 9 + "one two three four five six seven eight nine ten", "en", "s", 266)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {i: own(i) + "\n \n\nlast line " + str(i) for i in range(30)} | {30: own(30)}
    got = quality.quality_rules(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["doc_id"] in (31, 40) or (r["text"], r["kept"], r["removed_chars"]) == (want[r["doc_id"]], True, 23 if r["doc_id"] < 30 else 0)
    passed = quality.pass_quality(docs).collect()
    assert sorted(r["doc_id"] for r in passed) == sorted([*range(31), 4])
    assert all(r["text"] == want[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in passed)


def test_quality_counts_documents_at_every_size(spark):
    text = "concat('w', id, ' one two three four five six seven eight nine ten', if(id < 30, '\\nin a few documents', ''))"
    docs = spark.range(4000).selectExpr("id as doc_id", f"{text} as text", "'en' as lang", "'s' as source", "0L as n_chars")
    assert quality.quality_rules(docs).filter("removed_chars > 0").count() == 0
    assert quality.quality_rules(docs, max_docs=25).filter("removed_chars > 0").count() == 30
    assert quality.quality_rules(docs, max_docs=30).filter("removed_chars > 0").count() == 0


def test_every_language_is_learned(spark):
    letter = lambda i, k: chr(0x4E00 + 40 * i + k)
    rows = [(1000 * i + n, "".join(letter(i, (7 * n + k * k) % 37) for k in range(40)), f"l{i:03}") for i in range(230) for n in range(1 + (i < 200))]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    learned = langid.fit_dictionaries(labelled)
    assert len(learned) == 230
    small = langid.fit_dictionaries(labelled, max_chars=2300)
    assert len(small) == 230 and sum(len(d.decode().strip()) for d in small.values()) <= 2300 + 230
    rare = labelled.filter("lang >= 'l200'")
    got = langid.identify_languages(rare, learned).collect()
    assert len(got) == 30 and all(r["lang"] == r["lang_pred"] for r in got)


def test_wrapped_and_double_licences(spark):
    gpl = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n"
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:\n"
    lgpl = gpl.replace("GNU General", "GNU Lesser General")
    both = "Licensed under the Apache License, Version 2.0. Licensed under the MIT License."
    texts = ["/*\n * A program.\n *\n" + gpl + " */\nint main", "words before\n\n" + bsd, lgpl, "first line\n" + both, "Released under the MIT License.\nReleased under the MIT License."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = licenses.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    got = sorted((r["doc_id"], r["paragraph"], r["start"], r["family"]) for r in licenses.scan(docs, model).filter("confirmed").collect())
    assert got == [(0, 3, len("/*\n * A program.\n *\n"), "gpl"), (1, 2, 14, "bsd"), (2, 0, 0, "lgpl"), (3, 1, 11, "apache"), (3, 1, 11, "mit"), (4, 0, 0, "mit"), (4, 1, 32, "mit")]


def test_other_wordings_are_told_and_mentions_are_not(spark):
    """Notices in words that no template has, and sentences about licences that declare none."""
    other = {
        "mit": "The code of this project is distributed under the MIT License.",
        "apache": "All files are made available under the Apache License, Version 2.0 unless noted.",
        "gpl": "This program is covered by the GNU General Public License, version 3 or later.",
        "lgpl": "The library may be used under the GNU Lesser General Public License, version 3.",
        "agpl": "The server falls under the GNU Affero General Public License, version 3.",
        "bsd": "You may use it under the BSD 3-Clause License.",
        "isc": "It comes under the ISC License.",
        "mpl": "Parts are under the Mozilla Public License, version 2.0 as well.",
        "cc-by-sa": "The pictures are under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "cc0": "The data come under CC0 1.0 Universal, so use them freely.",
    }
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = licenses.fit(real)
    names = list(other)
    docs = spark.createDataFrame([(i, other[f], 1, 2.0) for i, f in enumerate(names)], "doc_id long, text string, family int, probability double")
    got = {r["doc_id"]: r["family"] for r in licenses.scan(docs, model).orderBy("probability").collect()}
    right = sum(got.get(i) == f for i, f in enumerate(names))
    assert right >= 8 and all(got[i] == names[i] for i in got)
    told = spark.createDataFrame(list(enumerate(licenses.MENTIONS[1::2])), "doc_id long, text string")
    assert licenses.scan(told, model).count() == 0
