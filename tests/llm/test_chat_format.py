import hashlib
import random

from pyspark.sql import functions as F

from quillgraph.llm.chat_format import INSTRUCT, chat_digests, format_chats, read_turns

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, valid int"
BITS = [*INSTRUCT.control, "\\", "\\\\", "[", "<", "|", " ", "\n", "INST]", "/s>", "é中🙂", "ok", "$0"]


def chat(spark, rows):
    return format_chats(spark.createDataFrame([(*r, "clash", 0) for r in rows], SCHEMA))


def test_any_text_and_role_come_back(spark):
    rng = random.Random(1)
    rows = [
        (c, t, rng.choice(["user", "assistant", "system", "tool", "a<|b|>", "user<s>", None]), "".join(rng.choices(BITS, k=rng.randint(0, 12))) or None)
        for c in range(120)
        for t in range(rng.randint(1, 6))
    ]
    got = {r.conv_id: r for r in chat_digests(chat(spark, rows)).collect()}
    back = {r.conv_id: r.t for r in chat(spark, rows).select("conv_id", read_turns(F.col("formatted")).alias("t")).collect()}
    for c in range(120):
        turns = [(r or "", x or "") for k, _, r, x in rows if k == c]
        assert [(t.role, t.text) for t in back[c]] == turns
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_control_strings_are_only_markers(spark):
    text = "".join(INSTRUCT.control) * 2
    r = chat(spark, [(1, 0, "user", text), (1, 1, "assistant", text)]).first()
    assert r.formatted.count("[INST]") == r.formatted.count("</s>") == 1 and "<<SYS>>" not in r.formatted
    assert "".join(s.text for s in r.segments) == r.formatted


def test_turn_order(spark):
    orders = {1: "su a", 2: "ua", 3: "uaua", 4: "u", 5: "au", 6: "uua", 7: "usa", 8: "sua", 9: "s", 10: "uax"}
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    rows = [(c, i, names[x], "t") for c, o in orders.items() for i, x in enumerate(o.replace(" ", ""))]
    got = {r.conv_id for r in chat(spark, rows).where("valid").collect()}
    assert got == {1, 2, 3, 8}


def test_nulls_ties_repeats_long_and_no_rows(spark):
    rows = [(None, 0, "user", "x"), (None, None, "user", "w"), (7, 1, "assistant", "b"), (7, 1, "assistant", "a"), (7, 1, "assistant", "a"), (8, 0, "assistant", "z [INST] " * 200_000)]
    got = {r.conv_id: r for r in chat_digests(chat(spark, rows)).collect()}
    assert got[None].turns_sha256 == hashlib.sha256(b"user\nw\nuser\nx\n").hexdigest()
    assert got[7].loss_sha256 == hashlib.sha256(b"aab").hexdigest()
    assert got[8].loss_chars == 1_800_000
    assert chat_digests(chat(spark, [])).count() == 0
