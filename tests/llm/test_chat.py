"""Exact round trips of conversations."""

import random

from pyspark.sql import functions as F

from wristwave.llm import chat

ROWS = "conv_id long, turn long, role string, text string"


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(2)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "[TURN]", "\\", "[\\TURN]", "<\\/s>", "[ROLE]", "[/ROLE]", "[END]", "[ANSWER]", "\n", "é🙂", "$1", "<", "[", "text "]
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(1, 12)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "a]b[/ROLE]\n"]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randrange(9)))])))
    df = spark.createDataFrame(rows, ROWS).repartition(4)
    made = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    for conv in range(150):
        mine = [(r[2], r[3] or "") for r in rows if r[0] == conv]
        assert [tuple(t) for t in got[conv].turns] == mine
        assert got[conv].loss_text == "".join(t for role, t in mine if role == "assistant")
    for r in made.collect():
        mine = [q[2] for q in rows if q[0] == r.conv_id]
        merged = sum(i == 0 or mine[i - 1] != role for i, role in enumerate(mine))
        marks = sum(r.formatted.count(m) for m in ("[SYS]", "[INST]", "[ANSWER]", "[ROLE]"))
        assert marks == merged  # adjacent turns of one role share a block, and no text poses as a marker


def test_odd_rows(spark):
    rows = [(1, 0, None, "x"), (1, None, "user", "first"), (None, 3, "assistant", "y"), (None, 3, "assistant", "y"), (2, 1, "assistant", None), (3, 0, "assistant", "z" * 200_000)]
    df = spark.createDataFrame(rows, ROWS).withColumn("turns", F.lit(1)).withColumn("c", F.lit(2))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "first"), ("", "x")]
    assert [tuple(t) for t in got[None].turns] == [("assistant", "y")] * 2 and got[None].loss_text == "yy"
    assert got[2].loss_text == "" and len(got[3].loss_text) == 200_000
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_conversation(spark):
    df = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    r = chat.read_back(chat.format_chats(df)).first()
    assert len(r.turns) == 3000 and r.loss_text == "".join(str(i) for i in range(1, 3000, 2))
