"""Event logs folded in Spark against a plain fold, and messages of megabytes."""

import random

from pyspark.sql import functions as F

from fleetpulse.llm import chat

LOG = "conv_id long, turn int, tie int, seq int, kind string, body string, at int, n int"


def plain(events):
    role, text = "", ""
    for _, kind, body, at, n in sorted(events):
        if kind == "open":
            role = body
        elif kind == "delta":
            text += body
        elif kind == "edit":
            text = text[:at] + body + text[at + n:]
        elif kind == "regenerate":
            text = ""
    return role, text


def test_any_log_folds_as_plainly(spark):
    rnd, rows, want = random.Random(5), [], {}
    for conv in range(120):
        events, size = [], 0
        for seq in range(rnd.choice([0, 1, 3, 20])):
            kind = rnd.choice(["open", "delta", "delta", "delta", "edit", "regenerate", "other"])
            body = "".join(rnd.choice("ab é\U0001F600\n") for _ in range(rnd.randint(0, 5)))
            at = rnd.randint(0, size)
            events.append((seq, kind, body, at, rnd.randint(0, size - at)))
            size = len(plain(events)[1])
        if events:
            want[conv] = plain(events)
            rows += [(conv, 0, 1, *e) for e in events]
    rnd.shuffle(rows)
    got = chat.fold(spark.createDataFrame(rows, LOG).repartition(3))
    assert {r.conv_id: (r.role, r.text) for r in got.collect()} == want


def test_messages_of_megabytes(spark):
    text = "aé\U0001F600 \n</s>\\x" * 200_000  # 2 million characters, 16,667 deltas
    rows = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text + "z")], "conv_id long, turn int, role string, text string")
    out = chat.format_chats(chat.events_of(rows)).withColumn("turns", chat.read_back(F.col("formatted")))
    loss = chat.under_loss(F.col("formatted"), F.col("loss_spans"))
    r = out.select(F.col("turns")[0]["text"].alias("user"), F.col("turns")[1]["text"].alias("said"), loss.alias("loss")).first()
    assert (r.user, r.said, r.loss) == (text, text + "z", text + "z")
