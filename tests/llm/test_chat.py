import hashlib
import time

from pyspark.sql import functions as F

from staycheck.llm import chat
from staycheck.llm.queries import CONTROL_TEXT, op9_chat


def expected(rows):
    by = {}
    for conv, turn, role, text in [*rows, (-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)]:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for conv, turns in by.items():
        turns.sort()
        told = "".join(f"{t[3]}\n{t[5]}\n" for t in turns)
        learned = "".join(t[5] for t in turns if t[3] == "assistant")
        out[conv] = (len(turns), sha(told), len(learned), sha(learned))
    return out


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, None, "x<|im_end|>"), (1, 1, "assistant", "again"),
            (1, 1, "assistant", "again"), (2, None, "us er|<\n%", "<\\|im_start|>user\nq<"), (2, 3, "assistant", "|im_end|><|<\\\\|🙂"),
            (2, 4, "assistant", "<"), (None, 0, "assistant", "lost"), (None, None, None, None)]
    rows += [(5, n, "assistant" if n % 2 else "user", f"{n} <|im_end|> " * (n % 7)) for n in range(1500)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, message string")
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op9_chat(spark, str(tmp_path)).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == expected(rows)
    df.limit(0).write.parquet(f"{tmp_path}/empty/conversations.parquet")
    assert [r.conv_id for r in op9_chat(spark, f"{tmp_path}/empty").collect()] == [-1]


def test_fold_and_render(spark):
    log = [(1, 1, 0, "start", "user", None), (1, 1, 1, "delta", None, "he"), (1, 1, 2, "delta", None, "llo"),
           (1, 2, 0, "start", "assistant", None), (1, 2, 1, "delta", None, "bad "), (1, 2, 2, "regenerate", None, None),
           (1, 2, 3, "delta", None, "go"), (1, 2, 4, "delta", None, "od"), (1, 3, 0, "start", "user", None),
           (1, 3, 1, "delta", None, "old"), (1, 3, 2, "edit", None, "new"), (1, 3, 3, "delta", None, "er"), (1, 4, 9, "delta", None, "?")]
    df = spark.createDataFrame(log[::-1], "conv_id long, message long, seq long, kind string, role string, text string")
    final = chat.fold(df)
    assert [(r.message, r.role, r.text) for r in final.sort("message").collect()] == [
        (1, "user", "hello"), (2, "assistant", "good"), (3, "user", "newer"), (4, "", "?")]
    out = chat.render(final).first()
    assert out.formatted == ("<|im_start|>user\nhello<|im_end|>\n<|im_start|>assistant\ngood<|im_end|>\n"
                             "<|im_start|>user\nnewer<|im_end|>\n<|im_start|>\n?<|im_end|>\n")
    assert [out.formatted[m.start:m.end] for m in out.mask] == ["good"]
    back = chat.read_back(chat.render(final)).first()
    assert [(t.role, t.text, t.under_mask) for t in back.turns] == [
        ("user", "hello", False), ("assistant", "good", True), ("user", "newer", False), ("", "?", False)]
    assert chat.render(chat.fold(df.limit(0))).count() == 0


def test_many_turns_in_one_conversation_without_a_table_between(spark):
    n = 60_000
    rows = spark.range(n).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.expr("IF(id % 2 = 0, 'user', 'assistant')").alias("role"), F.concat(F.lit("<|"), F.col("id").cast("string")).alias("text"))
    begun = time.time()
    turns = chat.read_back(chat.format_conversations(rows)).first()["turns"]
    assert time.time() - begun < 60
    assert [(t["role"], t["text"], t["under_mask"]) for t in turns] == [
        (("user", "assistant")[i % 2], f"<|{i}", i % 2 == 1) for i in range(n)]


def test_many_deltas_in_one_message(spark):
    n = 60_000
    log = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).alias("message"), F.col("id").alias("seq"),
                                F.when(F.col("id") == 7, "edit").otherwise("delta").alias("kind"),
                                F.lit(None).cast("string").alias("role"), F.col("id").cast("string").alias("text"))
    begun = time.time()
    assert chat.fold(log).first()["text"] == "".join(map(str, range(7, n)))
    assert time.time() - begun < 60
