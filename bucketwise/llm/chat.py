"""Chat formatting with typed content parts.

A turn is a list of parts: text, image, audio or document. A visitor flattens the parts in order: text is escaped,
every other part becomes a placeholder, its reference is recorded, and the tokens it will expand to are counted.
A turn is written as ``<|turn|>role``, a line break, the body and ``</s>``; a conversation opens with ``<s>``.

Control strings inside texts and roles are escaped reversibly: a backslash behind their first character, and a second
backslash behind every backslash; dropping the first backslash of each pair undoes both. Adjacent texts are joined
first, so no control string forms across parts. The loss mask covers the bodies of assistant turns.

Conversations are not gathered: turns are formatted one by one, shuffled by conversation, sorted, and digested as a
stream, so one conversation with a third of all rows needs time but no memory.

Defined cases: null role, text and parts are empty; a null conversation id is a conversation; turns that tie go by role,
then body; repeated rows are turns of their own; unknown part types are documents; an empty table gives no rows. Other
columns take no part.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bucketwise.llm.textkit import table

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
REFERENCE = "struct<position:int,type:string,ref:string,tokens:long>"
#: pixels per side of an image token, audio tokens per second, tokens per document page
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 1024

OPEN, TURN, END = "<s>", "<|turn|>", "</s>"
_CONTROL = re.compile(r"\\|<\||</?s>|\[/?INST\]|<</?SYS>>")
_PLACE = re.compile(r"<\|(image|audio|document)\|>")
_HEAD = re.compile(r"<\|turn\|>((?:[^\\\n]|\\.)*+)\n", re.S)
_PAIR = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _PAIR.sub(r"\1", text)


def expanded_tokens(part: dict) -> int:
    """Tokens a part takes in place of its placeholder; unknown measures count as one unit."""
    kind = part.get("type")
    if kind == "image":
        return math.ceil((part.get("width") or PATCH) / PATCH) * math.ceil((part.get("height") or PATCH) / PATCH)
    if kind == "audio":
        return math.ceil((part.get("seconds") or 1.0) * AUDIO_RATE)
    return (part.get("pages") or 1) * PAGE_TOKENS


class Flattener:
    """Visits the parts of a turn in order; ``body`` and ``references`` hold the result."""

    def __init__(self) -> None:
        self._pieces: list[str] = []
        self._text: list[str] = []
        self.references: list[dict] = []

    def visit(self, part: dict | None) -> None:
        part = part or {"type": "text"}
        kind = part.get("type") or "text"
        if kind == "text":
            self._text.append(part.get("text") or "")
        else:
            kind = kind if kind in ("image", "audio") else "document"
            self._flush()
            self._pieces.append(f"<|{kind}|>")
            self.references.append({
                "position": len(self.references), "type": kind, "ref": part.get("ref"),
                "tokens": expanded_tokens(part | {"type": kind}),
            })

    def _flush(self) -> None:
        self._pieces.append(escape("".join(self._text)))
        self._text = []

    @property
    def body(self) -> str:
        self._flush()
        return "".join(self._pieces)


def write_turn(role: str | None, parts: list[dict | None]) -> tuple[str, str, list[dict]]:
    """(head, body, references); a turn is head + body + END."""
    flat = Flattener()
    for part in parts:
        flat.visit(part)
    head = TURN + escape(role or "").replace("\n", "\\\n") + "\n"
    return head, flat.body, flat.references


def read_turn(turn: str) -> tuple[str, str, str]:
    """(role, text without placeholders, text as written between head and end) read back from a formatted turn."""
    head = _HEAD.match(turn)
    body = turn[head.end() : -len(END)]
    return unescape(head[1]), "".join(unescape(x) for x in _PLACE.split(body)[::2]), body


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reference = pa.list_(pa.struct([("position", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
    for batch in batches:
        turns, starts, lengths, references = [], [], [], []
        for role, parts in zip(batch.column("role").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            head, body, found = write_turn(role, parts or [])
            turns.append(head + body + END)
            starts.append(len(head))
            lengths.append(len(body))
            references.append(found)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv"), batch.column("turn"), batch.column("role"), pa.array(turns, pa.string()),
                pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(references, reference),
            ],
            names=["conv", "turn", "role", "formatted", "body_start", "body_length", "attachments"],
        )


def text_part(text: Column) -> Column:
    """A text column as a list of one text part."""
    return F.array(F.struct(
        F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
    ))


def format_turns(rows: DataFrame, conv: Column, turn: Column, role: Column, parts: Column) -> DataFrame:
    """Formatted turns: conv, turn, role, formatted, loss (assistant), body_start, body_length, attachments, tokens."""
    own = rows.select(conv.alias("conv"), turn.alias("turn"), role.alias("role"), parts.cast(f"array<{PART}>").alias("parts"))
    kinds = [own.schema[c].dataType.simpleString() for c in ("conv", "turn")]
    out = own.mapInArrow(
        _format,
        f"conv {kinds[0]}, turn {kinds[1]}, role string, formatted string, body_start long, body_length long, "
        f"attachments array<{REFERENCE}>",
    )
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda acc, x: acc + x["tokens"])
    return out.withColumn("loss", F.coalesce(F.col("role") == "assistant", F.lit(False))).withColumn("attachment_tokens", tokens)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from turns in order; holds one turn and the running digests."""
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "attachment_tokens"]
    kind, state, key = None, None, None
    done: list[list] = [[] for _ in names]

    def close() -> None:
        if state is not None:
            row = [key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4] + len(OPEN), *state[5:]]
            for column, value in zip(done, row, strict=True):
                column.append(value)

    def flushed() -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(done, kinds, strict=True)], names=names)
        for column in done:
            column.clear()
        return out

    for batch in batches:
        kind = batch.column("conv").type
        columns = (batch.column(c).to_pylist() for c in ("conv", "formatted", "loss", "n_attachments", "attachment_tokens"))
        for conv, formatted, loss, n, tokens in zip(*columns, strict=True):
            if state is None or conv != key:
                close()
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            role, text, _ = read_turn(formatted)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if loss:
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(formatted)
            state[5] += n
            state[6] += tokens
        if done[0]:
            yield flushed()
    close()
    if done[0]:
        yield flushed()


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted turns: counts, digests and lengths."""
    kind = turns.schema["conv"].dataType.simpleString()
    ordered = (
        turns.select("conv", "turn", "role", "formatted", "loss", F.size("attachments").alias("n_attachments"), "attachment_tokens")
        .repartition("conv").sortWithinPartitions("conv", "turn", "role", "formatted")
    )
    return ordered.select("conv", "formatted", "loss", "n_attachments", "attachment_tokens").mapInArrow(
        _digests,
        f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
        "n_attachments long, attachment_tokens long",
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '(\\|<\||</?s>|\[/?INST\]|<</?SYS>>)', '#\1', 'g')) AS text_chars,
             length(regexp_replace(role, '(\\|<\||</?s>|\[/?INST\]|<</?SYS>>|\n)', '#\1', 'g')) AS role_chars FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(8 + role_chars + 1 + text_chars + 4))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        "SELECT -1L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text "
        "FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)"
    )
    both = rows.unionByName(probe)
    turns = format_turns(both, F.col("conv_id"), F.col("turn"), F.col("role"), text_part(F.col("text")))
    return conversation_digests(turns).select(
        F.col("conv").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )
