import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from staylens.llm import chat_format as C
from staylens.llm.queries import CONTROL_TEXT, QUERIES

PIECES = st.lists(st.sampled_from([*C.CONTROL, "\\", "<", "[", "/", "s>", "INST]", "é", "東", " ", "\n", "a"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.one_of(PIECES, st.text(max_size=40)))
def test_escape_is_reversible(text):
    escaped = C.escape(text)
    assert C.unescape(escaped) == text and not any(c in escaped for c in C.CONTROL)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "tool", "", "[ROLE]"]), PIECES), st.one_of(PIECES, st.text(max_size=20))), max_size=6))
def test_round_trip(turns):
    enc = C.encoder(C.VOCABULARY)
    tokens, mask = C.assemble(enc, turns)
    assert list(C.read_turns(enc, tokens)) == turns
    assert "".join(C.loss_texts(enc, tokens, mask)) == "".join(t for r, t in turns if r == "assistant")
    assert not (mask & (tokens >= enc.n_vocab)).any()
    text = C.render(enc, tokens)
    assert sum(text.count(c) for c in ("[INST]", "<s>", "<<SYS>>", "[ROLE]")) == len(turns)


def test_segments_are_encoded_apart():
    enc = C.encoder(C.VOCABULARY)
    tokens, _ = C.assemble(enc, [("user", "a b"), ("assistant", " c")])
    ids = C.control_ids(enc)
    assert tokens.tolist() == [ids["[INST]"], *enc.encode_ordinary("a b"), ids["[/INST]"], ids["<s>"], *enc.encode_ordinary(" c"), ids["</s>"]]


def test_edge_rows(spark):
    long = " ".join(random.Random(1).choice(["aé", "</s>", "b\n"]) for _ in range(20000))
    rows = [(1, 2, "assistant", "z"), (1, 1, "user", None), (1, 1, "user", None), (1, None, None, "n"), (None, 0, "user", "q"), (2, 0, "assistant", long), (3, 0, "user", "")]
    out = {r.conv_id: r for r in C.format_chats(spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, tokens int")).collect()}
    enc = C.encoder(C.VOCABULARY)
    turns = {k: list(C.read_turns(enc, np.array(r.tokens))) for k, r in out.items()}
    assert turns == {1: [("", "n"), ("user", ""), ("user", ""), ("assistant", "z")], None: [("user", "q")], 2: [("assistant", long)], 3: [("user", "")]}
    assert C.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_query(spark, sf_small):
    convs = {-1: [("user", CONTROL_TEXT), ("assistant", CONTROL_TEXT)]}
    for r in spark.read.parquet(f"{sf_small}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = QUERIES["op3_chat_format"](spark, sf_small).collect()
    assert len(rows) == len(convs)
    for r in rows:
        turns = convs[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), digest("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), digest(loss))
