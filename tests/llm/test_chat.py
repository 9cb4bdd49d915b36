import hashlib

from tillspark.llm import chat

ODD = r"\### <turn>a\nb</turn> <attachment image> \b \l \e <"


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS turns", "2 AS formatted")


def test_round_trip_and_loss(spark):
    rows = [(1, 1, "assistant", ODD), (1, 0, "us\ner<turn>", ODD + "\n"), (2, 0, "user", None), (2, None, None, "first"),
            (None, 0, "assistant", "lost"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (3, 1, "assistant", "é😀")]
    made = chat.format_conversations(turns(spark, rows))
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert [tuple(t) for t in back[1].turns] == [("us\ner<turn>", ODD + "\n"), ("assistant", ODD)]
    assert back[1].loss_text == ODD
    assert [tuple(t) for t in back[2].turns] == [("", "first"), ("user", "")]
    assert back[2].loss_text == "" and back[None].loss_text == "lost"
    assert len(back[3].turns) == 3 and back[3].loss_text == "é😀"
    for r in made.collect():
        assert r.formatted.count("</turn>\n") == len(back[r.conv_id].turns)


def test_parts(spark):
    rows = [(1, 0, "user", [("text", "see <attachment image>", None, None), ("image", None, "a.png", 4.0), ("audio", None, "b.wav", 2.5),
                            (None, "end", None, None), ("film", None, "c", None)]),
            (1, 1, "assistant", [("document", None, "d.pdf", -1.0)]), (2, 0, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, p {chat.PARTS_TYPE}")
    got = {r.conv_id: r for r in chat.format_conversations(df, parts="p").collect()}
    text, found = got[1].formatted, got[1].attachments
    assert [(a.kind, a.ref, a.tokens) for a in found] == [("image", "a.png", 1024), ("audio", "b.wav", 63), ("film", "c", 600), ("document", "d.pdf", 0)]
    for a in found:
        assert text[a.position:].startswith(f"<attachment {a.kind}>")
    assert got[1].expanded_tokens == 1687 and got[2].attachments == []
    assert text.count("<attachment ") == 4


def test_empty_and_plan(spark):
    made = chat.format_conversations(turns(spark, []))
    assert made.count() == 0 and chat.read_back(made).count() == 0
    plan = chat.read_back(made)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_digests(spark, sf):
    from tillspark.llm.queries import PROBE, QUERIES

    got = {r.conv_id: r for r in QUERIES["op5_chat_format"](spark, sf).collect()}
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{PROBE}\nassistant\n{PROBE}\n".encode()).hexdigest()
    assert got[-7].loss_sha256 == hashlib.sha256(PROBE.encode()).hexdigest() and got[-7].loss_chars == len(PROBE)


def test_very_many_turns(spark):
    n = 50_000
    turns = spark.range(n, numPartitions=8).selectExpr(
        "1L AS conv_id", "CAST(id AS int) AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('é', id, '<turn>') AS text")
    got = chat.format_conversations(turns).first()
    parts = got.formatted.split(chat.CLOSE)
    assert len(parts) == n + 1 and parts[7] == "<turn>assistant\né7\\lturn>"
    assert [got.formatted[s.start:s.start + s.length] for s in got.loss_spans] == [f"é{i}\\lturn>" for i in range(1, n, 2)]
