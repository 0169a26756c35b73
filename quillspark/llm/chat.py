"""Conversations as training examples, one for each assistant turn, by prefix-target expansion.

An example is the conversation's text from its start to the end of an assistant turn; only
that turn's own text is trainable.  Each is a row with all of its context as text, and with its mask, however
long the conversation is.  A task streams over a conversation's turns in order and holds its text so far; what is
written grows with the turns times the length of a conversation, as each example repeats its context.

Who wants that linear asks for segments: then each conversation is cut at ends of examples wherever ``segment`` characters
are reached, the context of a later segment's examples begins with the segment, and what is before that is the last
row of each earlier one (``prefix_chars`` says how much).  The query doesn't.

Template: ``[INST:role] text [/INST]`` for a turn that isn't the assistant's, ``<s:assistant>text</s>``
for the assistant's.  Inside texts every control string gets one backslash more after its first
character, and loses it again when read back, so any text comes back as it was.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import cut, new_path, python_ready

ASSISTANT = "assistant"
# Strings that steer a chat template or a tokenizer.
CONTROLS = ("<s:", "<s>", "</s>", "[INST:", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>", "<unk>")

_ESCAPE = re.compile("|".join(f"(?<={re.escape(c[0])})(?=\\\\*{re.escape(c[1:])})" for c in CONTROLS))
_UNESCAPE = re.compile("|".join(f"(?<={re.escape(c[0])})\\\\(?=\\\\*{re.escape(c[1:])})" for c in CONTROLS))

#: Characters from which on a segment takes no more turns, a usual choice; and characters in 64 of which rows are handed on.
SEGMENT = 1 << 14

_READ = "spark.sql.parquet.columnarReaderBatchSize"
_ROW = "conv_id bigint, example int, n_turns int, prefix_chars bigint, text string, loss_start bigint, loss_end bigint"
_DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escape(text: str) -> str:
    return _ESCAPE.sub("\\\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub("", text)


def _role(role: str) -> str:
    """A role as one word without brackets or breaks; read back by ``_role_back``."""
    return re.sub(r"[%\[\]<>\s]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), role)


def _role_back(role: str) -> str:
    return re.sub(r"(?:%[0-9A-F]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode(), role)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as text, and where its own text begins and ends."""
    body = escape(text)
    head, tail = (f"<s:{ASSISTANT}>", "</s>") if role == ASSISTANT else (f"[INST:{_role(role)}] ", " [/INST]")
    return head + body + tail, len(head), len(head) + len(body)


_TURN = re.compile(r"<s:assistant>(?P<reply>.*?)</s>|\[INST:(?P<role>[^\]]*)\] (?P<text>.*?) \[/INST\]", re.DOTALL)


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn in a rendered text; the whole of it must be turns."""
    at = 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError("not a rendered conversation")
        at = m.end()
        own = "reply" if m["reply"] is not None else "text"
        yield (ASSISTANT if own == "reply" else _role_back(m["role"])), unescape(m[own]), m.start(own), m.end(own)
    if at != len(text):
        raise ValueError("not a rendered conversation")


def _expand(segment: int | None):
    """Turns sorted by conversation in, examples out; turns without an assistant's after them are rows that train nothing."""
    limit = float("inf") if segment is None else segment
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fresh = None, True
        parts: list[str] = []  # of the segment so far
        example = turns = prefix = size = held = 0  # held: characters that are in no row yet
        waiting = 0  # characters of rows in ``out``
        out: list[tuple] = []

        def emit(span: tuple[int | None, int | None] = (None, None)) -> None:
            nonlocal example, prefix, parts, size, held, waiting
            parts = ["".join(parts)]
            waiting += len(parts[0])
            out.append((now, example, turns, prefix, parts[0], *span))
            example, held = example + 1, 0
            if size >= limit:
                prefix, parts, size = prefix + size, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal waiting
            columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
            out.clear()
            waiting = 0
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "example", "n_turns", "prefix_chars", "text", "loss_start", "loss_end"])

        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if fresh or conv != now:
                    if held:
                        emit()
                    now, fresh, parts = conv, False, []
                    example = turns = prefix = size = held = 0
                piece, start, end = render(role or "", text or "")
                at = prefix + size
                parts.append(piece)
                turns, size, held = turns + 1, size + len(piece), held + len(piece)
                if role == ASSISTANT:
                    emit((at + start, at + end))
                elif size >= limit:
                    emit()
                if waiting > 64 * SEGMENT:
                    yield flush()
            yield flush()
        if held:
            emit()
        yield flush()

    return run


def examples(turns: DataFrame, segment: int | None = None) -> DataFrame:
    """conv_id, example, n_turns, prefix_chars, text, loss_start, loss_end.

    ``text`` is the whole example and ``prefix_chars`` 0; only with a ``segment`` it is the example from its segment's start
    on, and ``prefix_chars`` the length of what is before that.  n_turns are the turns of context and reply; the trainable
    span counts from the conversation's start.  Turns go by turn, ties by role and text; null roles
    and texts are empty, null turns first.  Repeated rows are turns of their own.  Rows with a null conv_id are
    one conversation.  Turns that no assistant turn follows are in rows that train nothing.  Other columns are
    not looked at.
    """
    python_ready(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return dealt.select("conv_id", "role", "text").mapInArrow(_expand(segment), _ROW)


def full_examples(stored: DataFrame, conv_ids: list[int]) -> DataFrame:
    """Whole texts of the examples of some conversations that were stored in segments: conv_id, example, text, loss_start, loss_end."""
    some = stored.where(F.col("conv_id").isin(conv_ids))
    before = some.groupBy(F.col("conv_id").alias("c"), F.col("prefix_chars").alias("p")).agg(F.max_by("text", "example").alias("t"))
    whole = some.join(before, (F.col("conv_id") == F.col("c")) & (F.col("p") < F.col("prefix_chars")), "left").groupBy("conv_id", "example", "loss_start", "loss_end", F.col("text").alias("own")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "t"))), lambda x: x["t"]), "").alias("context"))
    return whole.select("conv_id", "example", F.concat("context", "own").alias("text"), "loss_start", "loss_end")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads examples back, sorted by conversation, and sums them up.

    An example's context must be the example before it in its segment; its own turns are parsed, and its mask is read.
    """
    now, fresh, last, at = None, True, "", 0
    n = chars = loss = 0
    turns, lost = hashlib.sha256(), hashlib.sha256()
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        out.clear()
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    def close() -> None:
        out.append((now, n, turns.hexdigest(), loss, lost.hexdigest(), chars))

    for batch in batches:
        for conv, prefix, text, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if fresh or conv != now:
                if not fresh:
                    close()
                now, fresh, n, chars, loss, last, at = conv, False, 0, 0, 0, "", 0
                turns, lost = hashlib.sha256(), hashlib.sha256()
            if prefix != at:
                last, at = "", prefix
            if prefix + len(last) != chars or not text.startswith(last):
                raise ValueError(f"conversation {conv}: an example does not continue the one before")
            for role, body, _, _ in parse(text[len(last) :]):
                n += 1
                turns.update(f"{role}\n{body}\n".encode())
            if start is not None:
                trained = unescape(text[start - prefix : end - prefix])
                loss += len(trained)
                lost.update(trained.encode())
            chars, last = prefix + len(text), text
        yield flush()
    if not fresh:
        close()
    yield flush()


def digests(stored: DataFrame) -> DataFrame:
    """One row for each conversation, from its examples alone; formatted_chars is the length of its rendered text."""
    rows = stored.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return rows.select("conv_id", "prefix_chars", "text", "loss_start", "loss_end").mapInArrow(_digests, _DIGEST)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of conversation -7, read back from their written examples."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, ASSISTANT, control)], "conv_id bigint, turn bigint, role string, text string")
    path = new_path(spark, "chat")
    examples(turns.unionByName(own)).write.mode("overwrite").parquet(path)
    before = spark.conf.get(_READ)
    spark.conf.set(_READ, "64")  # a row may hold a whole conversation
    try:
        return cut(digests(spark.read.parquet(path)), "chat-digests")
    finally:
        spark.conf.set(_READ, before)


def _escaped_sql(column: str) -> str:
    for c in CONTROLS:
        column = f"regexp_replace({column}, '({re.escape(c[0])})(\\\\*{re.escape(c[1:])})', '\\1\\\\\\2', 'g')"
    return column


#: The same digests in SQL, for roles that need no encoding.
ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, {_escaped_sql("text")} AS body FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(body) + CASE WHEN role = 'assistant' THEN {len("<s:assistant></s>")} ELSE length(role) + {len("[INST:]  [/INST]")} END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
