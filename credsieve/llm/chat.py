r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and its text
alone under the loss mask.  Turns after a conversation's last assistant turn (or a conversation
without one) give a last example with an empty mask, so that the output holds every turn.

Template: `<|im_start|>role\ntext<|im_end|>\n`.  Inside roles and texts a backslash is doubled, `<|`
becomes `<\|`, and a line end in a role becomes `\n` in letters; so control strings in a text can't be
taken for the template's own, and `read_turns` gives the turns back exactly.

Rows of a conversation are dealt by its id and sorted by turn, then stream through: a worker holds
one conversation's context, never a group of rows.  Null roles and texts count as empty; null turns
come first; rows that repeat a turn are turns of their own, ordered by role and text; a null
conversation id is a conversation like any other.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credsieve.llm.common import ship_package

START, STOP = "<|im_start|>", "<|im_end|>\n"
#: Characters of a batch of examples.
BATCH_CHARS = 1 << 21

_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda found: "\n" if found[1] == "n" else found[1], text) if "\\" in text else text


def formatted(role: str, text: str) -> tuple[str, int]:
    """A turn, and where its text begins."""
    head = START + escape(role).replace("\n", "\\n") + "\n"
    return head + escape(text) + STOP, len(head)


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of a formatted example."""
    for found in _TURN.finditer(text):
        yield unescape(found[1]), unescape(found[2])


def _by_conversation(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    plain = rows.select(
        F.col(conv),
        F.col(turn).alias("__turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("__role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"),
    )
    return plain.repartition(conv).sortWithinPartitions(conv, "__turn", "__role", "__text")


def examples(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    target_role: str = "assistant",
) -> DataFrame:
    """Examples in order within a conversation: id, example (from 0), text, mask_start and mask_end (code points;
    equal where nothing is trained), last (of its conversation)."""
    ship_package(rows.sparkSession)
    dealt = _by_conversation(rows, conv_col, turn_col, role_col, text_col)
    schema = T.StructType(
        [
            T.StructField(conv_col, dealt.schema[0].dataType),
            T.StructField("example", T.IntegerType()),
            T.StructField("text", T.StringType()),
            T.StructField("mask_start", T.LongType()),
            T.StructField("mask_end", T.LongType()),
            T.StructField("last", T.BooleanType()),
        ]
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, context, size, k, held, began = None, [], 0, 0, None, False
        for batch in batches:
            for own, role, text in zip(*(batch.column(x).to_pylist() for x in (0, 2, 3)), strict=True):
                if not began or own != conv:
                    if began:
                        if context:
                            context = ["".join(context)]
                        yield from _closed(conv, k, context, size, held)
                    conv, context, size, k, held, began = own, [], 0, 0, None, True
                turn, at = formatted(role, text)
                context.append(turn)
                size += len(turn)
                if role == target_role:
                    if held:
                        yield *held, False
                    context = ["".join(context)]
                    begin = size - len(turn) + at
                    held = (conv, k, context[0], begin, size - len(STOP))
                    k += 1
        if began:
            yield from _closed(conv, k, ["".join(context)], size, held)

    def _closed(conv: object, k: int, context: list[str], size: int, held: tuple | None) -> Iterator[tuple]:
        if held and len(held[2]) == size:
            yield *held, True
            return
        if held:
            yield *held, False
        yield conv, k, "".join(context), size, size, True

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [None, pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        rows, chars = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(x, kinds[k] or first) for k, x in enumerate(zip(*rows, strict=True))], names=schema.names
            )

        def noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal first
            for batch in batches:
                first = batch.schema.field(0).type
                yield batch

        first = None
        for row in each(noted(batches)):
            rows.append(row)
            chars += len(row[2])
            if chars >= BATCH_CHARS or len(rows) >= 5000:
                yield out()
                rows, chars = [], 0
        if rows:
            yield out()

    return dealt.mapInArrow(work, schema)


def read_back(made: DataFrame, conv_col: str = "conv_id", ordered: bool = False) -> DataFrame:
    """What the examples say, one row a conversation: its id, n_turns, turns_sha256, loss_chars, loss_sha256 and
    formatted_chars; one example is held at a time.

    `ordered` says that the examples of a conversation follow each other, as straight behind `examples` they do; others
    are dealt by conversation and sorted first.  Examples that miss or stand elsewhere after all are an error.
    """
    if not ordered:
        made = made.repartition(conv_col).sortWithinPartitions(conv_col, "example")
    schema = T.StructType(
        [
            T.StructField(conv_col, made.schema[0].dataType),
            T.StructField("n_turns", T.LongType()),
            T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()),
            T.StructField("loss_sha256", T.StringType()),
            T.StructField("formatted_chars", T.LongType()),
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, loss_chars, chars, before, due = hashlib.sha256(), 0, 0, None, 0
        for batch in batches:
            rows = []
            for conv, k, text, begin, end, last in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if k != due or (k and conv != before):
                    raise ValueError(f"example {k} of conversation {conv} is out of order")
                before, due = conv, 0 if last else k + 1
                trained = unescape(text[begin:end])
                loss.update(trained.encode())
                loss_chars += len(trained)
                chars += len(text)
                if last:
                    turns, n = hashlib.sha256(), 0
                    for role, said in read_turns(text):
                        turns.update(f"{role}\n{said}\n".encode())
                        n += 1
                    rows.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    loss, loss_chars, chars = hashlib.sha256(), 0, 0
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=schema.names)

    return made.mapInArrow(work, schema)
