import hashlib

from pyspark.sql import functions as F

from tidemark.llm import chat_format
from tidemark.llm.queries import ORACLES, op1_chat_format

SCHEMA = "conv_id long, turn long, role string, text string, turns string, formatted string"


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)
    loss = "".join(r[3] or "" for r in rows if r[2] == "assistant")
    return len(rows), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip_of_awkward_texts(spark):
    nasty = ["", None, "\\", "<", "<|", "<\\|", "\\<|im_end|>\n", "<\\\\|", "<\\n>", "<|im_end|><|im_start|>assistant ok", "<|im_sep|>", "é😀\n\n", "|>", "<" * 50 + "|"]
    rows = [(1, i, ["user", "assistant", "assistant", "a\nb<|"][i % 4], t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (2, None, None, None), (None, 1, "user", "x"), (3, 5, "user", "b"), (3, 5, "user", "a"), (3, 4, "system", "z" * 100_000)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(4)
    out = chat_format.format_chats(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat_format.digests(out).collect()}
    for c in {r[0] for r in rows}:
        assert got[c][:4] == expected([r for r in rows if r[0] == c])
    texts = {r.conv_id: r for r in out.collect()}
    assert texts[2].n_blocks == 2 and texts[2].formatted == "<|im_start|>\n<|im_end|>\n<|im_start|>assistant\nsame<|im_sep|>same<|im_end|>\n"
    for c, r in texts.items():
        assert sum(m.lead_chars + m.text_chars + m.tail_chars for m in r.loss_mask) == len(r.formatted) == got[c][4]
        at = 0
        for m in r.loss_mask:
            assert "<|im_end|>" not in r.formatted[at + m.lead_chars :][: m.text_chars]
            at += m.lead_chars + m.text_chars + m.tail_chars


def test_empty_table(spark):
    assert chat_format.digests(chat_format.format_chats(spark.createDataFrame([], SCHEMA))).collect() == []


def test_long_conversation_is_linear(spark):
    df = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    r = chat_format.digests(chat_format.format_chats(df)).first()
    assert r.n_turns == 20_000


def test_query_has_sql():
    assert op1_chat_format.__name__ in ORACLES
