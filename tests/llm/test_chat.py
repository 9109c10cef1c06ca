"""Chat formatting: the round trip and its query against SQL."""

import hashlib

import pytest

from tidemark.llm import chat

HARD = ["<|", "|>", "<|end|>", "<|user|>", "\\<|", "<\\|", "<\\\\|x|\\>", "|", "<", "a<", ">", "<|end|><|assistant|>x<|end|>", "\\", "</s>[INST] ok [/INST]", "line\nline", "", None, "é😀<|end|>"]


@pytest.mark.parametrize("role", ["user", "assistant", "a|", ">", "|>", "<|", None])
def test_round_trip(spark, role):
    df = spark.createDataFrame([(k, t, role, x) for k, x in enumerate(HARD) for t in (0, 1)], "conv_id long, turn long, role string, text string")
    for r in chat.format_conversations(df).collect():
        assert r["is_identical"], r
        assert [(t["role"], t["text"]) for t in r["parsed"]] == [(role or "", HARD[r["conv_id"]] or "")] * 2


def test_order_ties_and_repeats(spark):
    df = spark.createDataFrame([(1, 1, "b", "x"), (1, None, "z", "first"), (1, 1, "a", "y"), (1, 1, "a", "y"), (None, 0, "u", "lost")], "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: [(t["role"], t["text"]) for t in r["parsed"]] for r in chat.format_conversations(df).collect()}
    assert out == {1: [("z", "first"), ("a", "y"), ("a", "y"), ("b", "x")], None: [("u", "lost")]}
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_query(spark, tmp_path):
    rows = [(k, t, "user" if t % 2 == 0 else "assistant", x) for k, x in enumerate(HARD) for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r["conv_id"]: r for r in chat.op8_chat(spark, str(tmp_path)).collect()}
    assert len(out) == len(HARD) + 1
    for k, x in enumerate(HARD):
        whole = "".join(f"{role}\n{x or ''}\n" for role in ("user", "assistant", "user"))
        assert out[k]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert out[k]["loss_chars"] == len(x or "") and out[k]["n_turns"] == 3
        assert out[k]["loss_sha256"] == hashlib.sha256((x or "").encode()).hexdigest()
    text = "</s>[INST] ok [/INST]"
    assert out[-1]["loss_chars"] == len(text) and out[-1]["is_identical"]


def test_no_python_on_the_executors(spark, tmp_path, capsys):
    spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    chat.op8_chat(spark, str(tmp_path)).explain()
    assert "Python" not in capsys.readouterr().out
