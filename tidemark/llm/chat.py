"""Chat formatting with loss masks aligned by token offsets.

A conversation is rendered whole, encoded once with offsets, and its assistant spans are intersected with the token spans
by binary search. Turn marks are added tokens, so no token crosses the border of a text.

Template, per turn: `<|turn|>` role `<|text|>` text `<|end|>` newline. Inside roles and texts each backslash is doubled and each control
string gets a backslash after its first character, so no control string is left inside and `\\x -> x` undoes it. Control
strings are the three marks, the tokenizer's own special tokens and common ones of other templates.

A conversation beyond `most_chars` is rendered and encoded in runs of turns: marks are added tokens, so the
token sequence is the same. Rows reach a task sorted by conversation and turn and are read as a stream; digests are
updated turn by turn, so a conversation of any number of turns needs bounded memory.

Defined cases: ids are of any type; null text and null role are empty; a null conversation id is a conversation of its own; turns that tie are ordered by
role, then text; repeated rows all count; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import mapped, tokenizer_threads

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = (TURN, TEXT, END, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("(?=(?:" + "|".join(map(re.escape, CONTROL)) + "))(.)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string of (role, text) turns and the span of each escaped text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


_TURN = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}\n", re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted string."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer with the turn marks as added tokens."""
    from tokenizers import AddedToken, Tokenizer

    tokenizer_threads()
    found = Tokenizer.from_file(path)
    found.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (TURN, TEXT, END)])
    return found


def token_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """For each token, whether its characters meet one of the sorted, disjoint spans (start, end)."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    # the last span that starts before the token's end
    last = np.searchsorted(spans[:, 0], offsets[:, 1], side="left") - 1
    return (last >= 0) & (spans[last, 1] > offsets[:, 0]) & (offsets[:, 1] > offsets[:, 0])


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """Unescaped characters under the mask, each once and in order (tokens may share a character)."""
    starts, ends = offsets[mask, 0], offsets[mask, 1]
    if not len(starts):
        return ""
    begins = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]])
    stops = np.r_[begins[1:] - 1, len(ends) - 1]
    return "".join(unescape(formatted[starts[b] : ends[e]]) for b, e in zip(begins, stops, strict=True))


class Conversation:
    """Digests of one conversation, fed with runs of turns."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.n_turns, self.loss_chars, self.formatted_chars, self.n_tokens, self.n_loss_tokens = conv_id, 0, 0, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, turns: list[tuple[str, str]], formatted: str, spans: list[tuple[int, int]], offsets: np.ndarray) -> None:
        wanted = np.array([s for s, (role, _) in zip(spans, turns, strict=True) if role == "assistant"], np.int64).reshape(-1, 2)
        mask = token_mask(offsets, wanted)
        loss = masked_text(formatted, offsets, mask)
        back = parse(formatted)
        self.n_turns += len(back)
        self.turns.update("".join(f"{role}\n{text}\n" for role, text in back).encode())
        self.loss.update(loss.encode())
        self.loss_chars += len(loss)
        self.formatted_chars += len(formatted)
        self.n_tokens += len(offsets)
        self.n_loss_tokens += int(mask.sum())

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.formatted_chars, "n_tokens": self.n_tokens, "n_loss_tokens": self.n_loss_tokens}


#: Columns beside the conversation's id.
FIELDS = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_loss_tokens", pa.int64())]


def format_conversations(rows: DataFrame, tokenizer_path: str, most_chars: int = 1 << 20, at_once: int = 1 << 21) -> DataFrame:
    """Per conv_id: counts and digests read back from the formatted and masked conversation."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kind = rows.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), *FIELDS])
    rows = rows.select(F.col("conv_id"), F.col("turn").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]], bool]]:
        """(conv_id, a run of turns, whether the conversation ends with it)."""
        key, turns, size = None, None, 0
        for batch in batches:
            columns = (batch.column(k).to_pylist() for k in ("conv_id", "role", "text"))
            for conv_id, role, text in zip(*columns, strict=True):
                if turns is not None and conv_id != key:
                    yield key, turns, True
                    turns = None
                elif turns is not None and size + len(text) > most_chars:
                    yield key, turns, False
                    turns, size = [], 0
                if turns is None:
                    key, turns, size = conv_id, [], 0
                turns.append((role, text))
                size += len(text)
        if turns is not None:
            yield key, turns, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(tokenizer_path)
        held, done, size, state = [], [], 0, None

        def flush() -> None:
            nonlocal held, size, state
            encoded = model.encode_batch([x[2] for x in held], add_special_tokens=False) if held else []
            for (key, turns, formatted, spans, last), found in zip(held, encoded, strict=True):
                state = state or Conversation(key)
                state.feed(turns, formatted, spans, np.array(found.offsets, np.int64).reshape(-1, 2))
                if last:
                    done.append(state.row())
                    state = None
            held, size = [], 0

        for key, turns, last in runs(batches):
            formatted, spans = render(turns)
            held.append((key, turns, formatted, spans, last))
            size += len(formatted)
            if size >= at_once:
                flush()
                if done:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done = []
        flush()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    return rows.transform(mapped, run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long")
