"""Chat formatting at token level: segments encoded one by one, reserved ids spliced in, loss masks by prefix
sums, control strings in content escaped so that they can be read back."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks of a public byte-level vocabulary; a path that every executor can open.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenizer pattern of byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Control strings of the template; their ids follow the vocabulary's, in this order.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
#: What opens and closes a turn by role; any other role is spelt out between [ROLE] and [/ROLE].
TURNS = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("<s>", "</s>")}
TRAINED = "assistant"

_HEADS = "|".join(f"{re.escape(c[0])}(\\\\*){re.escape(c[1:])}" for c in sorted(CONTROL, key=len, reverse=True))
_ESCAPE = re.compile(r"(?P<all>" + _HEADS + ")")


def escape(text: str) -> str:
    """Put one backslash after the first character of each control string; one that already has some gets one more."""
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    """Undo ``escape``: one backslash less in each control string that has some."""
    return _ESCAPE.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


@functools.cache
def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def control_ids(enc: tiktoken.Encoding) -> dict[str, int]:
    return {c: enc.n_vocab + k for k, c in enumerate(CONTROL)}


def assemble(enc: tiktoken.Encoding, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """(token ids, loss mask) of a conversation of (role, text) turns."""
    ids = control_ids(enc)
    segments: list[list[int]] = []
    trained: list[int] = []
    for role, text in turns:
        start, stop = TURNS.get(role, ("[ROLE]", "[/ROLE]"))
        if role in TURNS:
            segments.append([ids[start]])
        else:
            segments += [[ids[start]], enc.encode_ordinary(escape(role)), [ids[stop]]]
        if role == TRAINED:
            trained.append(len(segments))
        segments.append(enc.encode_ordinary(escape(text)))
        segments.append([ids[stop if role in TURNS else "</s>"]])
    ends = np.cumsum([0, *map(len, segments)])
    edge = np.zeros(ends[-1] + 1, np.int64)
    np.add.at(edge, ends[trained], 1)
    np.add.at(edge, ends[np.array(trained, np.int64) + 1], -1)
    return np.concatenate([np.array(s, np.int32) for s in segments]) if segments else np.zeros(0, np.int32), np.cumsum(edge)[:-1] > 0


def read_turns(enc: tiktoken.Encoding, tokens: np.ndarray) -> Iterator[tuple[str, str]]:
    """The (role, text) turns of a token sequence."""
    names = {v: k for k, v in control_ids(enc).items()}
    opened = {start: role for role, (start, _) in TURNS.items()}
    special = np.flatnonzero(tokens >= enc.n_vocab)
    role, k = None, 0
    text = lambda lo, hi: unescape(enc.decode_bytes(tokens[lo:hi].tolist()).decode())
    while k < len(special):
        at, name = special[k], names[int(tokens[special[k]])]
        if name == "[ROLE]":
            role, k = text(at + 1, special[k + 1]), k + 1
            at = special[k]
        else:
            role = opened[name]
        yield role, text(at + 1, special[k + 1])
        k += 2


def render(enc: tiktoken.Encoding, tokens: np.ndarray) -> str:
    """The formatted text: reserved ids as their control strings."""
    names = {v: k.encode() for k, v in control_ids(enc).items()}
    out, last = [], 0
    for at in np.flatnonzero(tokens >= enc.n_vocab):
        out += [enc.decode_bytes(tokens[last:at].tolist()), names[int(tokens[at])]]
        last = at + 1
    return b"".join([*out, enc.decode_bytes(tokens[last:].tolist())]).decode()


def loss_texts(enc: tiktoken.Encoding, tokens: np.ndarray, mask: np.ndarray) -> list[str]:
    """The unescaped texts of the maximal runs under the loss mask."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [unescape(enc.decode_bytes(tokens[a:b].tolist()).decode()) for a, b in edge.reshape(-1, 2)]


def format_chats(conversations: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(conv_id, tokens array<int>, loss_mask array<boolean>): one row per conversation of (conv_id, turn, role, text).

    Turns are ordered by turn, then role, then text (nulls first), so ties and repeated rows have one order and
    all stay. A null role or text is empty; rows with a null conv_id form one conversation; other columns are
    dropped. A conversation is one training row and so one row here, whatever its length; whole texts are
    encoded. An empty table gives no rows.
    """
    turns = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    grouped = conversations.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                done = [assemble(enc, list(zip(r, t, strict=True))) for r, t in zip(part.column("roles").to_pylist(), part.column("texts").to_pylist(), strict=True)]
                at = np.cumsum([0, *(len(t) for t, _ in done)]).astype(np.int32)
                tokens, mask = (np.concatenate([d[k] for d in done]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), pa.ListArray.from_arrays(at, pa.array(tokens, pa.int32())),
                                                  pa.ListArray.from_arrays(at, pa.array(mask))], ["conv_id", "tokens", "loss_mask"])

    return grouped.mapInArrow(run, f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, tokens array<int>, loss_mask array<boolean>")
