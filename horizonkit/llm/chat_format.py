"""Chat formatting in budgeted windows.

Prefix sums of turn tokens cut a conversation into turn-aligned spans that fit
the budget. Each window starts with the conversation's system turn, repeats a
limited history before its own turns, and keeps repeated assistant turns out of
the loss mask, so every assistant text is a target exactly once.

The template marks a turn as ``<|im_start|>role\\n text <|im_end|>\\n``. Inside
roles and texts a backslash goes into whatever could be read as the beginning
of a control string, and comes out again when the output is read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horizonkit.llm.byte_bpe import ByteBpe

START, END = "<|im_start|>", "<|im_end|>"
BUDGET = 1024
HISTORY = 256
TOKENIZER = "byte_bpe_50k.json"
WINDOWS = "conv_id long, window long, text string, n_repeated long, mask array<struct<start:long,end:long>>"

_GUARD = re.compile(r"<(\\*)\|")
_UNGUARD = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """``<|`` gets a backslash, and so does every ``<\\...\\|``: no control string is left."""
    return _GUARD.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNGUARD.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """As ``escape``; line breaks, which end the role, become ``\\n``."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """A marked turn and where its text lies in it."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


class WindowMaker:
    """Turns of one conversation in, finished windows out; holds one window of turns.

    A turn that alone exceeds the budget gets a window of its own, whole.
    """

    def __init__(self, conv_id: int | None, count, budget: int = BUDGET, history: int = HISTORY):
        self.conv_id, self.count, self.budget, self.history = conv_id, count, budget, history
        self.system: tuple | None = None
        self.window = 0
        self.turns: list[tuple[str, str, int]] = []  # role, text, prefix sum of tokens before
        self.repeated: list[tuple[str, str, int]] = []
        self.total = self.first = 0
        self.seen = False

    def _limit(self) -> int:
        fixed = self.system[2] if self.system and self.window else 0
        return self.budget - fixed - sum(t[2] for t in self.repeated)

    def add(self, role: str, text: str) -> Iterator[tuple]:
        turn = render(role, text)
        tokens = self.count(turn[0])
        if self.turns and self.total + tokens - self.first > self._limit():
            yield self.flush()
        if self.repeated and not self.turns and tokens > self._limit():
            self.repeated = []  # the turn needs the room of the history
        if not self.seen and role == "system":
            self.system = (role, text, tokens)
        self.seen = True
        self.turns.append((role, text, tokens))
        self.total += tokens

    def flush(self) -> tuple:
        again = ([self.system] if self.system and self.window else []) + self.repeated
        parts, mask, at = [], [], 0
        for k, (role, text, _) in enumerate([*again, *self.turns]):
            turn, start, end = render(role, text)
            if role == "assistant" and k >= len(again):
                mask.append({"start": at + start, "end": at + end})
            parts.append(turn)
            at += len(turn)
        row = (self.conv_id, self.window, "".join(parts), len(again), mask)
        kept, room = [], self.history
        for k in range(len(self.turns) - 1, -1, -1):  # the latest turns that fit the history
            if self.turns[k][2] > room or self.system and self.window == 0 and k == 0:
                break
            room -= self.turns[k][2]
            kept.insert(0, self.turns[k])
        self.repeated, self.turns, self.first = kept, [], self.total
        self.window += 1
        return row


def _ordered(turns: DataFrame) -> DataFrame:
    """Turns of a conversation together and in order, without collecting them."""
    clean = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    values = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)


_WINDOW_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("n_repeated", pa.int64()),
    ("mask", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])


def format_windows(turns: DataFrame, tokenizer: str | None = None, budget: int = BUDGET,
                   history: int = HISTORY) -> DataFrame:
    """One row per window: its text, how many leading turns are repeats, the loss mask.

    Turns are ordered by number; ties and repeated rows by role, then text, and
    all are kept. Null turn numbers come first, null roles and texts are empty,
    and rows with a null conv_id form one conversation. A conversation streams
    through its task turn by turn, so a hot one costs time but no memory.
    Windows of a conversation come out in order.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def make(batches):
        encoder = ByteBpe.shared(path)

        def count(text: str) -> int:
            return len(encoder.ids(text))

        maker = None
        for batch in batches:
            rows = []
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if maker is None or maker.conv_id != conv_id:
                    if maker is not None:
                        rows.append(maker.flush())
                    maker = WindowMaker(conv_id, count, budget, history)
                rows.extend(maker.add(role, text))
            yield _batch(rows, _WINDOW_SCHEMA)
        if maker is not None:
            yield _batch([maker.flush()], _WINDOW_SCHEMA)

    return _ordered(turns).select("conv_id", "role", "text").mapInArrow(make, WINDOWS)


def read_turns(text: str) -> list[tuple[str, str]]:
    """Turns of a window's text."""
    turns = []
    for piece in text.split(START)[1:]:
        head, _, body = piece.partition("\n")
        turns.append((unescape_role(head), unescape(body[: body.rindex(END)])))
    return turns


class _Digest:
    """Running digests of one conversation's windows."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.windows = 0

    def add(self, text: str, repeated: int, mask: list[dict]) -> None:
        for role, body in read_turns(text)[repeated:]:
            self.turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
        for span in mask or []:
            target = unescape(text[span["start"] : span["end"]])
            self.loss.update(target.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(target)
        self.chars += len(text)
        self.windows += 1

    def row(self) -> tuple:
        return (self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(),
                self.chars, self.windows)


_DIGEST_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64()),
])


def read_back(windows: DataFrame) -> DataFrame:
    """Digests per conversation, read from windows in the order they were made."""

    def digest(batches):
        held = None
        for batch in batches:
            rows = []
            for conv_id, text, repeated, mask in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or held.conv_id != conv_id:
                    if held is not None:
                        rows.append(held.row())
                    held = _Digest(conv_id)
                held.add(text, repeated, mask)
            yield _batch(rows, _DIGEST_SCHEMA)
        if held is not None:
            yield _batch([held.row()], _DIGEST_SCHEMA)

    return windows.select("conv_id", "text", "n_repeated", "mask").mapInArrow(
        digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                "formatted_chars long, n_windows long"
    )
