"""Chat formatting with a loss mask that is aligned by token offsets.

Conversations are rendered whole and encoded once; the character spans of the
assistant texts, in order, are intersected with the token spans by binary search.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from actlens.llm.common import packed, whole

TOKENIZER = "byte_bpe_50k.json"
CONTROL = "<|endoftext|>"
LEARNT = "assistant"
# A conversation is rendered in blocks of whole turns of about this many characters
# or one turn; all but extreme conversations are one block.
BLOCK = 1 << 20

_BLOCKS = "block int, formatted string, token_ids array<int>, loss_mask array<boolean>"


def escape(text: str) -> str:
    """Text in which the control string cannot occur; ``unescape`` gives it back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The conversation as text, and the (start, end) characters of each learnt text.

    Every role and every text stands between two control tokens, so no token of the
    text can reach over an end.
    """
    pieces, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        head = f"{CONTROL}{escape(role)}{CONTROL}"
        at += len(head)
        if role == LEARNT:
            spans.append((at, at + len(body)))
        at += len(body)
        pieces += [head, body]
    return "".join(pieces) + CONTROL, np.array(spans, np.int64).reshape(-1, 2)


def token_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """True for tokens that share a character with a span; both are sorted."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    # The last span that starts before the token ends.
    near = np.searchsorted(spans[:, 0], offsets[:, 1], side="left") - 1
    return (near >= 0) & (offsets[:, 0] < spans[np.maximum(near, 0), 1]) & (offsets[:, 1] > offsets[:, 0])


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from the rendered text."""
    parts = formatted.split(CONTROL)[1:-1]
    return [(unescape(r), unescape(t)) for r, t in zip(parts[::2], parts[1::2])]


def _tokenizer(path: str | None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return Tokenizer.from_file(path)


def chat_examples(
    conversations: DataFrame,
    id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    tokenizer: str | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """``conv_id``, ``block``, ``formatted``, ``token_ids`` and ``loss_mask`` (one flag per token).

    Rows of a conversation go by turn, ties by role and text; repeated rows are
    turns like others. Null roles and texts count as empty, a null turn sorts first,
    and rows with a null id form one conversation. An empty table gives an empty
    result; other columns are not read.

    A conversation passes through one task as a sorted stream, since its digest and
    its order are sequential; what the task holds is one block.
    """
    kind = conversations.schema[id].dataType
    schema = f"conv_id {kind.simpleString()}, {_BLOCKS}"
    out_type = pa.schema([
        ("conv_id", to_arrow_type(kind)), ("block", pa.int32()), ("formatted", pa.string()),
        ("token_ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_())),
    ])
    rows = packed(conversations).select(
        F.col(f"row.{id}").alias("conv_id"),
        F.col(f"row.{turn}").alias("turn"),
        whole(F.col(f"row.{role}")).alias("role"),
        whole(F.col(f"row.{text}")).alias("text"),
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizer(tokenizer)

        def made(conv, number: int, turns: list[tuple[str, str]]) -> dict:
            formatted, spans = render(turns)
            encoded = encoder.encode(formatted, add_special_tokens=False)
            mask = token_mask(np.array(encoded.offsets, np.int64).reshape(-1, 2), spans)
            return {"conv_id": conv, "block": number, "formatted": formatted,
                    "token_ids": encoded.ids, "loss_mask": mask.tolist()}

        now, number, turns, held, any_row = None, 0, [], 0, False
        done: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                new = any_row and row["conv_id"] != now
                if any_row and (new or held >= block) and turns:
                    done.append(made(now, number, turns))
                    number, turns, held = (0 if new else number + 1), [], 0
                now, any_row = row["conv_id"], True
                turns.append((row["role"], row["text"]))
                held += len(row["text"]) + len(row["role"])
                if len(done) >= 64:
                    yield pa.RecordBatch.from_pylist(done, schema=out_type)
                    done = []
        if turns:
            done.append(made(now, number, turns))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=out_type)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(encode, schema)


def chat_digest(examples: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per conversation, from the blocks of :func:`chat_examples` as they come out of it:

    ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256`` (what the masked
    token ids decode to, unescaped) and ``formatted_chars``.
    """
    kind = examples.schema["conv_id"].dataType
    schema = (
        f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, "
        "loss_chars long, loss_sha256 string, formatted_chars long"
    )
    out = pa.schema([
        ("conv_id", to_arrow_type(kind)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _tokenizer(tokenizer)
        state = None

        def row() -> dict:
            conv, n, turns, chars, loss, formatted = state
            return dict(zip(out.names, (conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted)))

        for batch in batches:
            done = []
            for example in batch.to_pylist():
                if example["block"] == 0:
                    if state:
                        done.append(row())
                    state = [example["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in turns_of(example["formatted"]):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                masked = [i for i, m in zip(example["token_ids"], example["loss_mask"]) if m]
                loss = unescape(decoder.decode(masked, skip_special_tokens=False))
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += len(example["formatted"])
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=out)
        if state:
            yield pa.RecordBatch.from_pylist([row()], schema=out)

    return examples.mapInArrow(digest, schema)

