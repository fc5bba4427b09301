import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelscope.llm import chat
from labelscope.llm.queries import queries
from labelscope.llm.sql import oracle_sql
from tests.compare import connect, duck_rows, spark_rows

TURNS = "conv_id bigint, turn bigint, role string, text string, kind string, start int, nth int, piece string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "clash", 0, 0, "clash") for r in rows], TURNS)


def test_query(spark, sf_dir):
    got = spark_rows(queries()["op9_chat"](spark, sf_dir))
    assert got == duck_rows(connect(sf_dir), oracle_sql()["op9_chat"])
    assert any(-7 in row for row in got[1])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a|>", "<|end|>", ""]), st.text(alphabet="\\|<>bp end:#é\n👍", max_size=12)), min_size=1, max_size=6))
def test_anything_comes_back(spark, said):
    rows = [(1, i, role, text) for i, (role, text) in enumerate(said)]
    made = chat.format_turns(turns(spark, rows)).withColumns({
        "back": chat.read_turns(F.col("formatted")), "loss": chat.masked_text(F.col("formatted"), F.col("loss_spans")),
    }).first()
    assert [tuple(t) for t in made.back] == said
    assert made.loss == "".join(t for r, t in said if r == "assistant")


def test_parts(spark):
    rows = spark.createDataFrame([
        (1, 0, "user", [("text", "look: ", None, None, None, None, None), ("image", None, "a.png", 28, 15, None, None), ("audio", None, "b.wav", None, None, 2.5, None)]),
        (1, 1, "assistant", [("text", "a|b", None, None, None, None, None), ("document", None, "c.pdf", None, None, None, 2), (None, "!", None, None, None, None, None)]),
        (1, 2, "user", None), (1, 3, "user", [("video", None, "d.mp4", None, None, None, None), ("image", None, None, None, None, None, None)]),
    ], f"conv_id int, turn int, role string, parts array<{chat.PART}>")
    made = chat.format_turns(rows, parts=F.col("parts")).first()
    assert made.formatted == (
        "<|user|>look: <|image|><|audio|><|end|><|assistant|>a\\pb<|document|>!<|end|><|user|><|end|><|user|><|attachment|><|image|><|end|>")
    assert [(a.type, a.ref, a.tokens) for a in made.attachments] == [
        ("image", "a.png", 4), ("audio", "b.wav", 63), ("document", "c.pdf", 1152), ("video", "d.mp4", 0), ("image", None, 256)]
    names = {"video": "attachment"}
    assert all(made.formatted[a.place:].startswith(f"<|{names.get(a.type, a.type)}|>") for a in made.attachments)
    assert [made.formatted[s.start:s.start + s.length] for s in made.loss_spans] == ["a\\pb", "!"]
    assert made.expanded_tokens == 4 + 63 + 1152 + 256 and made.n_turns == 4


def test_edges(spark):
    rows = [(1, 1, "user", "b"), (1, None, "user", "first"), (1, 1, "assistant", None), (1, 1, "user", "b"), (2, 0, None, None), (None, 0, "assistant", "x" * 300_000)]
    got = {r.conv_id: r for r in chat.format_turns(turns(spark, rows)).withColumn("back", chat.read_turns(F.col("formatted"))).collect()}
    assert [tuple(t) for t in got[1].back] == [("user", "first"), ("assistant", ""), ("user", "b"), ("user", "b")]
    assert [tuple(t) for t in got[2].back] == [("", "")]
    assert got[None].loss_spans[0].length == 300_000
    assert chat.format_turns(turns(spark, [])).collect() == []
    assert hashlib.sha256(b"").hexdigest()
