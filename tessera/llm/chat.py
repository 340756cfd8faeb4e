"""Chat formatting: conversations rendered by a compiled template, with the loss mask from its generation blocks.

Turns are dealt by conversation, sorted by turn and streamed through the template, so a conversation of any length is
rendered in the memory of one turn and no group is ever collected. A single conversation is one text and so is written
by one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, long_rows, rows_of, schema_of, width
from tessera.llm.templates import Template

#: Strings with a meaning to the format. They never stand in an escaped text.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|says|>", "<|end|>"]
#: Each conversation starts with <s> and ends with </s>; each turn gives its role, then its text.
CHAT = (
    "<s>{% for m in messages %}<|turn|>{{ m.role | escape }}<|says|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "<|end|>{% if loop.last %}</s>{% endif %}{% endfor %}"
)

_PIECES = [("conv_id", pa.int64()), ("piece", pa.int64()), ("text", pa.string()), ("learn", pa.bool_())]
_DIGESTS = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))


def escape(text: str | None) -> str:
    """Double each backslash and put one after the first character of each control string; ``unescape`` undoes it.

    No control string starts or continues with a backslash, so an inserted one always stands alone, while those of the
    text come in pairs.
    """
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], (text or "").replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def chat_template(source: str = CHAT) -> Template:
    return Template(source, {"escape": escape})


class ReadBack:
    """Reads formatted pieces again: the turns, and the text under the mask."""

    def __init__(self) -> None:
        self.turns = self.size = self.loss_chars = 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()
        self.text, self.role = "", None

    def feed(self, piece: str, learn: bool) -> None:
        self.size += len(piece)
        if learn:
            plain = unescape(piece)
            self.loss_chars += len(plain)
            self.loss_hash.update(plain.encode())
        self.text += piece
        if piece.endswith(("<|end|>", "</s>")) and not learn:
            self._turns()

    def _turns(self) -> None:
        *whole, self.text = self.text.split("<|end|>")
        for turn in whole:
            role, said = turn.partition("<|turn|>")[2].split("<|says|>")
            self.turn_hash.update(f"{unescape(role)}\n{unescape(said)}\n".encode())
            self.turns += 1


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Runs of equal ids, each as an iterator of its messages."""
    held = next(rows, None)
    while held is not None:
        conv = held[0]

        def messages() -> Iterator[dict]:
            nonlocal held
            while held is not None and held[0] == conv:
                yield {"role": held[1] or "", "text": held[2] or ""}
                held = next(rows, None)

        run = messages()
        yield conv, run
        for _ in run:
            pass


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    long_rows(conversations.sparkSession)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return turns.repartition(width(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")


def format_chats(conversations: DataFrame, template: str = CHAT) -> DataFrame:
    """Formatted conversations as pieces: ``conv_id, piece long, text, learn boolean``, joined in order of ``piece``.

    Turns are taken in order of turn, role and text. A null role or text is empty, null conversation ids are one
    conversation, repeated rows are repeated turns, an empty table gives no rows, and further columns aren't read.
    """

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, out, size = chat_template(template), [], 0
        for conv, messages in _conversations(rows_of(batches)):
            for n, (text, learn) in enumerate(compiled.pieces(messages=messages)):
                out.append((conv, n, text, learn))
                size += len(text)
                if size > 4_000_000 or len(out) >= 4096:
                    yield batch(out, _PIECES)
                    out, size = [], 0
        yield batch(out, _PIECES)

    return _sorted_turns(conversations).mapInArrow(render, schema_of(_PIECES))


def chat_digests(conversations: DataFrame, template: str = CHAT) -> DataFrame:
    """One row for each conversation, read back from what ``format_chats`` writes; see there for nulls and ties.

    The pieces come from the tasks that render them, in order, so reading them back needs no further shuffle.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, open_, out = None, None, []

        def close() -> None:
            if open_ is not None:
                out.append((conv, open_.turns, open_.turn_hash.hexdigest(), open_.loss_chars, open_.loss_hash.hexdigest(), open_.size))

        for c, n, text, learn in rows_of(batches):
            if n == 0:
                close()
                conv, open_ = c, ReadBack()
            open_.feed(text, learn)
        close()
        yield batch(out, _DIGESTS)

    return format_chats(conversations, template).mapInArrow(read, schema_of(_DIGESTS))


ADDED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_chat_formatting(spark, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame(ADDED, "conv_id long, turn long, role string, text string")
    return chat_digests(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(added))


def _escaped_length(column: str) -> str:
    doubled = f"replace({column}, chr(92), chr(92) || chr(92))"
    controls = " + ".join(f"(length(x) - length(replace(x, '{c}', ''))) // {len(c)}" for c in CONTROL)
    return f"(SELECT length(x) + {controls} FROM (SELECT {doubled} AS x))"


OP1_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_escaped_length('role')} + {_escaped_length('text')} + 8 + 8 + 7) + 3 + 4 AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
