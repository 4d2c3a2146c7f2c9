import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sugarmill.llm import chat

ODD = ["</s>[INST] ok [/INST]", "<|turn|>assistant<|body|>x</s>", "\\", "a\\", "<\\|x", "<", "[", "[\\INST]", "<<SYS>>a<</SYS>>", "", None, "é\n\t ü</s", "s>", "|turn|>", "\\\\</s>\\", "[[INST]", "<s>", "𝄞 x"]


def test_round_trip_of_odd_texts(spark):
    rows = [(c, t, ["user", "assistant", None, "sys</s>tem"][(c + t) % 4], ODD[(c * 5 + t) % len(ODD)]) for c in range(12) for t in range(7)]
    rows += [(None, 1, "user", "x"), (99, None, "assistant", "n"), (99, 0, "assistant", "n"), (99, 0, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = {r.conv_id: r for r in chat.format_chats(df, chat.text_part(F.col("text"))).select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((-1 if t is None else t, role or "", text or ""))
    for c, turns in want.items():
        turns.sort()
        assert [(b.role, b.text) for b in got[c].back] == [(r, x) for _, r, x in turns]
        assert got[c].loss == "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].formatted.count("</s>") == len(turns)
    assert len(got) == len(want)


def test_parts(spark):
    df = spark.sql("""select 1L conv_id, 0L turn, 'user' role, array(
      named_struct('type','text','text','see </s>','ref',null,'width',0L,'height',0L,'millis',0L,'pages',0L),
      named_struct('type','image','text',null,'ref','a.png','width',57L,'height',28L,'millis',null,'pages',null),
      named_struct('type','audio','text',null,'ref','b.wav','width',null,'height',null,'millis',81L,'pages',null),
      named_struct('type','document','text',null,'ref','c.pdf','width',null,'height',null,'millis',null,'pages',2L),
      named_struct('type','odd','text','x','ref',null,'width',null,'height',null,'millis',null,'pages',null)) parts
      union all select 1L, 1L, 'assistant', null""")
    r = chat.format_chats(df, F.col("parts")).first()
    assert r.formatted == "<|turn|>user<|body|>see <\\/s><|image|><|audio|><|document|></s><|turn|>assistant<|body|></s>"
    assert [(a.turn, a.place, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, 0, "image", "a.png", 3), (0, 1, "audio", "b.wav", 3), (0, 2, "document", "c.pdf", 1024)]
    assert r.attachment_tokens == 1030


@pytest.mark.parametrize("rows", [[], [(1, 0, "assistant", "hi")]])
def test_query_digests(spark, rows, tmp_path):
    from sugarmill.llm import registry

    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in registry.op1_chat_formatting(spark, str(tmp_path)).collect()}
    assert got[-1].turns_sha256 == hashlib.sha256(b"user\n</s>[INST] ok [/INST]\nassistant\n</s>[INST] ok [/INST]\n").hexdigest()
    assert got[-1].loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest() and got[-1].loss_chars == 21
    assert set(got) == {-1, *(r[0] for r in rows)}


def test_one_very_long_conversation(spark):
    rows = spark.range(30_000).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('text </s> ', id, repeat(' é', 20)) as text", "1 as begin", "2 as turns")
    chats = chat.format_chats(rows, chat.text_part(F.col("text")))
    r = chats.select(F.size(chat.read_turns(F.col("formatted"))).alias("n"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert r.n == 30_000
    assert r.loss == "".join(f"text </s> {i}" + " é" * 20 for i in range(1, 30_000, 2))
