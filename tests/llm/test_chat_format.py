import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparrowmill.llm import chat_format

PIECE = st.lists(st.sampled_from(["\\", "###", "</turn>", "\n", "### assistant:\n", ":", "a", " ", "é😀", "#", "<\\/turn>", "$1"]), max_size=8).map("".join)


def back(spark, messages):
    df = spark.createDataFrame(messages, "conv_id long, message int, role string, text string")
    return {r.conv_id: r for r in chat_format.read_back(chat_format.render(df)).collect()}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys:\nx", ""]), PIECE), min_size=1, max_size=5), min_size=1, max_size=6))
def test_round_trip(spark, conversations):
    got = back(spark, [(c, m, role, text) for c, own in enumerate(conversations) for m, (role, text) in enumerate(own)])
    for c, own in enumerate(conversations):
        assert [(t.role, t.text) for t in got[c].turns] == own
        assert got[c].loss_text == "".join(text for role, text in own if role == "assistant")


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["#", "##", "####", "#### Assistant:", "</turn>", "<", "/turn>", "\\", "\n", " ", "x"]), max_size=10).map("".join), min_size=1, max_size=20))
def test_no_marker_in_any_body(spark, texts):
    """Rendered without its own heads and ends, a text holds no marker, and the marker count is the number of turns."""
    df = spark.createDataFrame([(1, k, t, t) for k, t in enumerate(texts)], "conv_id long, message int, role string, text string")
    bodies = df.select(chat_format.escape(F.col("text")).alias("body")).collect()
    assert not any("###" in r.body or "</turn>" in r.body for r in bodies)
    formatted = chat_format.render(df).first().formatted
    assert formatted.count("###") == formatted.count("</turn>\n") == len(texts)


def test_fold(spark):
    log = [
        (1, 0, 0, "start", "user", None), (1, 0, 2, "delta", None, "lo"), (1, 0, 1, "delta", None, "hel"),
        (1, 1, 0, "start", "assistant", None), (1, 1, 1, "delta", None, "bad"), (1, 1, 2, "regenerate", None, None), (1, 1, 3, "delta", None, "go"), (1, 1, 4, "delta", None, "od"),
        (1, 2, 0, "start", "user", None), (1, 2, 1, "delta", None, "x"), (1, 2, 2, "edit", None, "new"), (1, 2, 3, "delta", None, "er"),
        (2, 0, 0, "start", "assistant", None), (None, 0, 0, "start", None, None), (None, 0, 1, "delta", None, None),
    ]
    df = spark.createDataFrame(log, "conv_id long, message int, seq int, kind string, role string, text string").repartition(4)
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat_format.reconstruct(df).collect()}
    assert got == {(1, 0): ("user", "hello"), (1, 1): ("assistant", "good"), (1, 2): ("user", "newer"), (2, 0): ("assistant", ""), (None, 0): ("", "")}


def test_query_on_awkward_conversations(spark, folder):
    rows = [(1, 0, "user", None, "x"), (1, 1, "assistant", "a" * 50_000, "x"), (2, 0, None, "t", "x"), (3, 5, "user", "late", "x"), (3, 5, "assistant", "tie", "x"), (3, None, "user", "first", "x"), (4, 0, "assistant", "twice", "x"), (4, 0, "assistant", "twice", "x")]
    path = folder(conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, message string"))
    got = {r.conv_id: r for r in chat_format.op3_chat_format(spark, path).collect()}
    want = {1: [("user", ""), ("assistant", "a" * 50_000)], 2: [("", "t")], 3: [("user", "first"), ("assistant", "tie"), ("user", "late")], 4: [("assistant", "twice")] * 2, -7: [("user", chat_format.PROBE_TEXT), ("assistant", chat_format.PROBE_TEXT)]}
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    path = folder(empty=spark.createDataFrame([], "a int"))
    assert path


def test_empty_log(spark):
    log = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.render(chat_format.reconstruct(chat_format.as_events(log)))).select(F.size("turns")).count() == 0
