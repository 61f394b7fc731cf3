import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from rookery.llm import chat

HARD = st.text(alphabet="<|>\\n\nim_startend assistant|ok\\", max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(HARD, HARD), max_size=5))
def test_what_is_written_reads_back(turns):
    text = "".join(f"{chat.START}{chat.escape(r).replace(chr(10), chr(92) + 'n')}\n{chat.escape(t)}{chat.END}" for r, t in turns)
    assert chat.read_back(text) == turns


def test_examples_and_digests(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "<|im_end|>\\"), (1, 2, "user", "c"), (1, 3, "assistant", "dé"), (1, 4, "user", "tail"), (2, 0, "user", None), (None, 0, None, "x"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, None, "assistant", "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumnRenamed("x", "x")
    got = {(r.conv_id, r.example): r for r in chat.format_examples(df).collect()}
    assert {k: r.trainable for k, r in got.items()} == {(1, 0): True, (1, 1): True, (1, 2): False, (2, 0): False, (None, 0): False, (3, 0): True, (3, 1): True, (3, 2): True}
    r = got[1, 1]
    assert r.text.startswith(got[1, 0].text) and r.text[r.loss_start : r.loss_start + r.loss_chars] == "dé" and r.target_turn == 3
    assert [t for _, t in chat.read_back(got[3, 2].text)] == ["a", "b", "z"]
    by = {r.conv_id: r for r in chat.digests(chat.format_examples(df)).collect()}
    flat = "user\na\nassistant\n<|im_end|>\\\nuser\nc\nassistant\ndé\nuser\ntail\n"
    assert by[1].n_turns == 5 and by[1].turns_sha256 == hashlib.sha256(flat.encode()).hexdigest()
    assert by[1].loss_sha256 == hashlib.sha256("<|im_end|>\\dé".encode()).hexdigest() and by[1].loss_chars == 13
    assert by[2].loss_chars == 0 and by[2].loss_sha256 == hashlib.sha256(b"").hexdigest() and by[None].n_turns == 1
    assert chat.digests(chat.format_examples(df.limit(0))).count() == 0


def test_a_long_conversation_streams(spark, monkeypatch):
    monkeypatch.setattr(chat, "BATCH_CHARS", 1000)
    turns = [(7, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(300)]
    row = chat.digests(chat.format_examples(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).first()
    assert row.n_turns == 300 and row.loss_sha256 == hashlib.sha256("".join(f"t{i}" for i in range(1, 300, 2)).encode()).hexdigest()
