"""Chat formatting against plain loops, and the round trip of texts that look like markers."""

import collections
import hashlib
import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from dwell.llm.chat import HEADINGS, ChatTemplate, Reader, format_chat, read_chat
from dwell.llm.oracles import CHAT

SCHEMA = "conv_id long, turn long, role string, text string, state string, fault string, start int, n_turns int"


def turns():
    rnd = random.Random(3)
    bits = ["### System: ", "### User: ", "### Assistant: ", "### Role ", "</role> ", "</turn>\n", "\\", "#", "<", "/", "\n", " ", "a", "é", "🎉", "\\\\", "</turn>", "### User"]
    odd = lambda: "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))
    out = [(0, 0, "user", None), (0, 1, "assistant", ""), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "assistant", "y"), (2, None, None, "no role"), (2, 5, "", "empty role"), (None, 0, "user", "no id"), (None, 1, "assistant", "long " * 50_000)]
    out += [(3, 0, "assistant", "first"), (3, 1, "system", "late"), (3, 2, "user", "end"), (4, 0, "### User: </role> \\", odd())]
    for c in range(10, 40):
        out += [(c, k, r, odd()) for k, r in enumerate((["system"] if c % 3 else []) + ["user", "assistant"] * rnd.randint(1, 4))]
    out += [(50, k, "user" if k % 2 == 0 else "assistant", odd()) for k in range(500)]
    return out


def loops(rows):
    """conv_id -> n_turns, digests and counts by the rule itself."""
    groups = collections.defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((-1 if t is None else t, (r or "").encode(), (x or "").encode()))
    out = {}
    for c, g in groups.items():
        g = [(r.decode(), x.decode()) for _, r, x in sorted(g)]
        loss = "".join(x for r, x in g if r == "assistant")
        before, faults = "start", 0
        for r, _ in g:
            faults += r not in {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]}[before]
            before = r if r in ("system", "user", "assistant") else before
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out[c] = (len(g), sha("".join(f"{r}\n{x}\n" for r, x in g)), len(loss), sha(loss), faults, not faults and before == "assistant")
    return out


@pytest.fixture(scope="module")
def conversations(spark):
    rows = turns()
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([(*r, "s", "f", 1, 2) for r in rows], SCHEMA).repartition(5)


def test_conversations_are_read_back_whole(conversations):
    segments = format_chat(conversations)
    got = {r[0]: r for r in read_chat(segments).collect()}
    want = loops(turns())
    assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["n_faults"], r["whole"]) for c, r in got.items()} == want
    text = collections.defaultdict(str)
    for r in sorted(segments.collect(), key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["start"])):
        assert r["start"] == len(text[r["conv_id"]]) and r["stop"] - r["start"] == len(r["text"])
        assert r["loss"] == (r["kind"] == "text" and r["role"] == "assistant")
        if r["kind"] == "text":
            assert not any(m in r["text"] for m in HEADINGS.markers)
        text[r["conv_id"]] += r["text"]
    assert {c: r["formatted_chars"] for c, r in got.items()} == {c: len(t) for c, t in text.items()}
    # A reader finds the turns wherever pieces of the text begin and end.
    for c, size in itertools.product((0, 2, 4, 12, 50), (1, 3, 1000)):
        reader = Reader(HEADINGS)
        for k in range(0, len(text[c]), size):
            reader.feed(text[c][k : k + size], False)
        assert reader.result()[:2] == want[c][:2]


def test_faults_name_the_turn_and_state(conversations):
    rows = format_chat(conversations).filter("conv_id in (3, 2) and kind = 'text'").orderBy("conv_id", "turn").collect()
    assert [(r["role"], r["fault"]) for r in rows] == [("", "unknown role"), ("", "unknown role"), ("assistant", "assistant after start"), ("system", "system after assistant"), ("user", None)]


def test_empty_table_and_sql(spark, conversations):
    assert format_chat(conversations.limit(0)).count() == 0 and read_chat(format_chat(conversations.limit(0))).count() == 0
    rows = [r for r in turns() if r[0] is not None and None not in r[1:3]]
    c = duckdb.connect()
    c.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    c.executemany("insert into conversations values (?, ?, ?, ?)", [r for r in rows if r[0] != 4])
    r = c.execute(CHAT)
    names = [d[0] for d in r.description]
    more = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    got = read_chat(format_chat(spark.createDataFrame([r for r in rows if r[0] != 4] + more, "conv_id long, turn long, role string, text string")))
    # Conversation 1 repeats a turn and 2 has an unknown role, of which the SQL's pairwise rule doesn't speak.
    keep = lambda t: collections.Counter(x for x in t if x[names.index("conv_id")] not in (1, 2))
    assert keep(map(tuple, got.select(*names).collect())) == keep(r.fetchall())


def test_a_template_of_ones_own(spark):
    mine = ChatTemplate({"q": "<Q>", "a": "<A>"}, ("<O>", "<I>"), "<E>", frozenset({"q", "a"}), "s", {"s": {"q": "q"}, "q": {"a": "s"}}, {}, frozenset({"s"}))
    rows = spark.createDataFrame([(1, 0, "q", "<E> <\\E>"), (1, 1, "a", "<A><Q>")], "conv_id int, turn int, role string, text string")
    segments = format_chat(rows, mine)
    assert "".join(r["text"] for r in segments.orderBy("start").collect()) == "<Q><\\E> <\\\\E><E><A><\\A><\\Q><E>"
    (r,) = read_chat(segments, mine).collect()
    assert (r["loss_chars"], r["whole"], r["n_turns"]) == (14, True, 2) and segments.agg(F.sum(F.col("loss").cast("int"))).first()[0] == 2
    with pytest.raises(ValueError):
        ChatTemplate({"q": "<Q ", "a": "<A "}, ("<O>", "<I>"), " <E>", frozenset(), "s", {}, {}, frozenset())
