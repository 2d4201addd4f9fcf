"""Render conversations by a grammar that a deterministic parser reads back exactly.

A turn is `open text close`; the marks depend on the role:

    system     <<SYS>> ... <</SYS>>
    user       [INST] ... [/INST]
    assistant  <s> ... </s>
    other      <<ROLE>> name <<TEXT>> ... <</ROLE>>    (a null role writes <<NULL>> for the name)

A control string inside a text is escaped by a backslash after its first character, and a
run of backslashes there grows by one, so escaping is undone by taking one away. A turn is
first rendered as it is and parsed again; while the parsed turn differs from the source,
its conflicting content is escaped. Texts without conflicts stay as they are.

Turns are rendered row by row. Reading back needs the turns of a conversation in order: rows
are dealt by conversation, sorted, and streamed through a parser that holds one turn and
two running digests, so a conversation of any length takes constant memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The marks of the template.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<<ROLE>>", "<<TEXT>>", "<</ROLE>>")
NO_ROLE = "<<NULL>>"
_CONTROL = r"(?:<SYS>>|</SYS>>|INST\]|/INST\]|s>|/s>|<ROLE>>|</ROLE>>|<TEXT>>|<NULL>>)"
_TO_ESCAPE = re.compile(r"([<\[])(\\*)(?=" + _CONTROL + ")")
_TO_UNESCAPE = re.compile(r"([<\[])\\(\\*)(?=" + _CONTROL + ")")
_ANY_MARK = re.compile(r"[<\[]" + _CONTROL)


def escaped(text: str) -> str:
    return _TO_ESCAPE.sub(r"\1\\\2", text)


def unescaped(text: str) -> str:
    return _TO_UNESCAPE.sub(r"\1\2", text)


def _written(role: str | None, text: str) -> str:
    if role in MARKS:
        opened, closed = MARKS[role]
        return opened + text + closed
    opened, middle, closed = OTHER
    return opened + (NO_ROLE if role is None else role) + middle + text + closed


def parse(rendered: str) -> list[tuple[str | None, str]]:
    """(role, text) of each turn; raises ValueError where the grammar does not fit."""
    turns, at = [], 0
    while at < len(rendered):
        for role, (opened, closed) in MARKS.items():
            if rendered.startswith(opened, at):
                break
        else:
            opened, middle, closed = OTHER
            if not rendered.startswith(opened, at):
                raise ValueError(f"no turn begins at {at}")
            if rendered.startswith(NO_ROLE + middle, at + len(opened)):
                role, name_end = None, at + len(opened) + len(NO_ROLE)
            else:
                mark = _ANY_MARK.search(rendered, at + len(opened))
                if mark is None or not rendered.startswith(middle, mark.start()):
                    raise ValueError(f"no role name at {at}")
                name_end = mark.start()
                role = unescaped(rendered[at + len(opened) : name_end])
            at, opened = name_end, middle
        # The next control string of any kind must be the close mark.
        mark = _ANY_MARK.search(rendered, at + len(opened))
        if mark is None or not rendered.startswith(closed, mark.start()):
            raise ValueError(f"turn at {at} is not closed")
        turns.append((role, unescaped(rendered[at + len(opened) : mark.start()])))
        at = mark.start() + len(closed)
    return turns


def reads_back(rendered: str, role: str | None, text: str) -> bool:
    try:
        return parse(rendered) == [(role, text)]
    except ValueError:
        return False


def render(role: str | None, text: str) -> str:
    """The turn as written, escaped no more than its parse needs."""
    for name, content in ((role, text), (role, escaped(text)), (role and escaped(role), escaped(text))):
        # A role spelt like a known one only after escaping would read back as another.
        rendered = _written(name, content)
        if reads_back(rendered, role, text):
            return rendered
    raise ValueError(f"turn cannot be rendered: {role!r}")


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, rendered: every row with its rendered turn, nothing shuffled.

    A null text is an empty one; a null role is a role of its own. Other columns are not
    read. A conversation's training text is its rendered turns in order, without anything
    between; the loss mask covers the text between an assistant turn's marks.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = batch["role"].to_pylist()
            texts = [t or "" for t in batch["text"].to_pylist()]
            rendered = [render(r, t) for r, t in zip(roles, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["conv_id"], batch["turn"], batch["role"], pa.array(texts, pa.string()),
                 pa.array(rendered, pa.string())],
                ["conv_id", "turn", "role", "text", "rendered"],
            )

    picked = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    schema = "conv_id bigint, turn bigint, role string, text string, rendered string"
    return picked.mapInArrow(rows, schema)


class _Digest:
    """What is read back from one conversation, turn by turn."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, rendered: str) -> None:
        self.chars += len(rendered)
        for role, text in parse(rendered):
            self.turns += 1
            self.all.update(f"{role or ''}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == "assistant":
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return (self.conv, self.turns, self.all.hexdigest(), self.loss_chars,
                self.loss.hexdigest(), self.chars)


def read_back(turns: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from `rendered` in turn order.

    Equal turns of a conversation are ordered by their rendered text; a null turn comes
    first and null ids form one conversation. An empty table gives no rows.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )

        current, done = None, []
        for batch in batches:
            for conv, rendered in zip(
                batch["conv_id"].to_pylist(), batch["rendered"].to_pylist(), strict=True
            ):
                if current is None or conv != current.conv:
                    if current is not None:
                        done.append(current.row())
                    current = _Digest(conv)
                current.add(rendered)
            if len(done) >= 1000:
                yield out(done)
                done = []
        if current is not None:
            yield out([*done, current.row()])

    schema = (
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
        "loss_sha256 string, formatted_chars bigint"
    )
    return (
        turns.select("conv_id", "turn", "rendered")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "rendered")
        .select("conv_id", "rendered")
        .mapInArrow(stream, schema)
    )
