"""Chat formatting at the token level.

Role and text of every turn are encoded on their own and joined by reserved ids beyond the
vocabulary, so no text can ever produce a control id, and a text has the same ids wherever
it stands. The loss mask comes from prefix sums over segment lengths. Control strings inside
texts are also escaped, reversibly, so that the text form of a conversation is unambiguous.

Long conversations are kept as several blocks, cut between turns; turns stream through sorted
partitions, so a conversation of any length needs the memory of one turn.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import sliced
from .pieces import _BYTES, byte_encoder, load_tokenizer

ESCAPE = "\x1b"
BLOCK_TOKENS = 1 << 16


@dataclass(frozen=True)
class ChatTemplate:
    """Marks of a turn with their reserved ids, strings to escape, and the roles under the loss."""

    begin: str = "<|turn|>"
    middle: str = "<|says|>"
    end: str = "<|done|>"
    first_id: int = 50_257
    controls: tuple[str, ...] = (
        "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
        "<|startoftext|>",
    )
    loss_roles: tuple[str, ...] = ("assistant",)

    @property
    def escaped(self) -> tuple[str, ...]:
        """What escape() replaces; the escape character itself comes first."""
        return (ESCAPE, self.begin, self.middle, self.end, *self.controls)

    def escape(self, text: str) -> str:
        """Replace each control string by the escape character and a letter of its own."""
        names = self.escaped
        if not any(n in text for n in names):
            return text
        longest = sorted(names, key=len, reverse=True)
        return re.sub("|".join(map(re.escape, longest)), lambda m: ESCAPE + chr(ord("a") + names.index(m[0])), text)

    def unescape(self, text: str) -> str:
        if ESCAPE not in text:
            return text
        return re.sub(ESCAPE + "(.)", lambda m: self.escaped[ord(m[1]) - ord("a")], text)


def _encode(path: str, template: ChatTemplate):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(path, plain_specials=True)
        for batch, texts in sliced(batches, "text"):
            roles = [r or "" for r in batch.column("role").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "conv": batch.column("conv"), "turn": batch.column("turn"),
                "loss": pa.array([r in template.loss_roles for r in roles]),
                "role_ids": pa.array(encoder.encode([template.escape(r) for r in roles]), pa.binary()),
                "text_ids": pa.array(encoder.encode([template.escape(t) for t in texts]), pa.binary()),
            })

    return encode


def assemble(turns: list[tuple[bytes, bytes, bool]], first_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of consecutive turns (role ids, text ids, under the loss)."""
    marks = [np.array([first_id + i], "<i4") for i in range(3)]
    pieces, under = [], []
    for role, text, loss in turns:
        pieces += [marks[0], np.frombuffer(role, "<u2"), marks[1], np.frombuffer(text, "<u2"), marks[2]]
        under += [False, False, False, loss, False]
    ends = np.cumsum([len(p) for p in pieces])
    starts = np.concatenate([[0], ends[:-1]])
    steps = np.zeros(ends[-1] + 1, "int32")
    np.add.at(steps, starts[under], 1)
    np.add.at(steps, ends[under], -1)
    return np.concatenate(pieces).astype("<i4"), np.cumsum(steps[:-1]).astype("int8")


def _blocks(first_id: int, block_tokens: int, schema: pa.Schema):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, number, turns, held, begun = None, 0, [], 0, False

        def flush():
            ids, mask = assemble(turns, first_id)
            return pa.RecordBatch.from_pydict({
                "conv": pa.array([conv], schema.field("conv").type), "block": pa.array([number], pa.int32()),
                "ids": pa.array([ids], pa.list_(pa.int32())), "loss_mask": pa.array([mask], pa.list_(pa.int8())),
            })

        for batch in batches:
            for c, loss, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv", "loss", "role_ids", "text_ids"))):
                if turns and (c != conv or held >= block_tokens):
                    yield flush()
                    number, turns, held = number + 1, [], 0
                if not begun or c != conv:
                    conv, number, begun = c, 0, True
                turns.append((role, text, loss))
                held += (len(role) + len(text)) // 2 + 3
        if turns:
            yield flush()

    return blocks


def format_chats(
    df: DataFrame, path: str, template: ChatTemplate = ChatTemplate(), conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text", block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Rows (conv_id, block, ids, loss_mask): every conversation as token ids, in blocks cut between turns.

    Turns are ordered by ``turn_col`` (null first); rows of one turn by role and text in
    encoded form, repeated rows staying repeated. Null roles and texts are empty; rows
    with a null conversation id form one conversation. An empty table gives no rows.
    """
    rows = df.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
        F.col(text_col).alias("text"),
    )
    conv, turn = (rows.schema[c].dataType.simpleString() for c in ("conv", "turn"))
    encoded = rows.mapInArrow(
        _encode(path, template), f"conv {conv}, turn {turn}, loss boolean, role_ids binary, text_ids binary"
    )
    dealt = encoded.repartition("conv").sortWithinPartitions("conv", "turn", "role_ids", "text_ids")
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(rows.select("conv").schema)
    out = f"conv {conv}, block int, ids array<int>, loss_mask array<tinyint>"
    return dealt.mapInArrow(_blocks(template.first_id, block_tokens, schema), out).withColumnRenamed("conv", conv_col)


@functools.lru_cache(maxsize=2)
def _token_bytes(path: str) -> list[bytes]:
    back = {c: b for b, c in _BYTES.items()}
    vocab = load_tokenizer(path).get_vocab()
    table = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        table[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return table


def turns_in(ids: np.ndarray, mask: np.ndarray, path: str, template: ChatTemplate) -> Iterator[tuple[str, str, str, int]]:
    """(role, text, text under the loss, characters of the text form) of each turn of a block."""
    table, first = _token_bytes(path), template.first_id
    text = lambda part: b"".join([table[i] for i in part.tolist()]).decode()
    marks = len(template.begin) + len(template.middle) + len(template.end)
    begins, middles, ends = (np.flatnonzero(ids == first + i) for i in range(3))
    for a, m, e in zip(begins, middles, ends):
        role, said = text(ids[a + 1 : m]), text(ids[m + 1 : e])
        under = text(ids[m + 1 : e][mask[m + 1 : e] == 1])
        yield template.unescape(role), template.unescape(said), template.unescape(under), marks + len(role) + len(said)


def _restored(path: str, template: ChatTemplate, schema: pa.Schema):
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def row():
            n, turns, chars, loss, formatted = state
            return pa.RecordBatch.from_pydict({
                "conv": pa.array([conv], schema.field("conv").type), "n_turns": [n], "turns_sha256": [turns.hexdigest()],
                "loss_chars": [chars], "loss_sha256": [loss.hexdigest()], "formatted_chars": [formatted],
            })

        for batch in batches:
            for c, ids, mask in zip(batch.column("conv").to_pylist(), batch.column("ids"), batch.column("loss_mask")):
                if state is None or c != conv:
                    if state is not None:
                        yield row()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, under, formatted in turns_in(
                    ids.values.to_numpy(), mask.values.to_numpy(), path, template
                ):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    state[2] += len(under)
                    state[3].update(under.encode())
                    state[4] += formatted
        if state is not None:
            yield row()

    return digests


def chat_digests(blocks: DataFrame, path: str, template: ChatTemplate = ChatTemplate(), conv_col: str = "conv_id") -> DataFrame:
    """What the ids and masks of format_chats() say, per conversation: turns, texts and loss text as digests."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = blocks.withColumnRenamed(conv_col, "conv")
    conv = rows.schema["conv"].dataType.simpleString()
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "block")
    out = (
        f"conv {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    found = dealt.mapInArrow(_restored(path, template, to_arrow_schema(rows.select("conv").schema)), out)
    return found.withColumnRenamed("conv", conv_col)
