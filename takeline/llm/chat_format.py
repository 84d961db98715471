"""Chat formatting: conversations become training strings with loss spans, and can be read back.

A template is compiled once per task (``chat_template``); rows are dealt out by conversation, sorted by turn, and
rendered as a stream, so memory is bounded by one turn and one output part, whatever a conversation's length.

Defined cases: null text or role is the empty string; null ``conv_id`` rows form one conversation with a null id;
rows with one turn number are ordered by role, then text; repeated rows are kept; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takeline.llm.chat_template import compile_template, unescape_controls

#: One turn: ``<s>[INST]role[/INST] text</s>``; text of assistants is under the loss mask.
TURNS_TEMPLATE = (
    "{% for m in messages %}<s>[INST]{{ m.role|controls }}[/INST] "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|controls }}{% endgeneration %}"
    "{% else %}{{ m.text|controls }}{% endif %}</s>{% endfor %}"
)
TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\] (.*?)</s>", re.DOTALL)
#: Code points after which the output of a very long conversation goes on in a further row.
PART_CHARS = 4_000_000

FORMATTED = "conv_id {}, part long, formatted string, loss_spans array<struct<begin:long,end:long>>"
DIGESTS = "conv_id {}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            yield from batch.slice(start, 256).to_pylist()


class _Groups:
    """Conversations of a sorted stream, each as a lazy iterator of its rows."""

    def __init__(self, rows: Iterator[dict]) -> None:
        self.rows, self.row = rows, next(rows, None)

    def one(self, conv_id: object) -> Iterator[dict]:
        while self.row is not None and self.row["conv_id"] == conv_id:
            row, self.row = self.row, next(self.rows, None)
            yield row

    def __iter__(self) -> Iterator[tuple[object, Iterator[dict]]]:
        while self.row is not None:
            conv_id = self.row["conv_id"]
            rows = self.one(conv_id)
            yield conv_id, rows
            for _ in rows:  # what a template left unread
                pass


def format_conversations(conversations: DataFrame, template: str = TURNS_TEMPLATE, part_chars: int = PART_CHARS) -> DataFrame:
    """Render each conversation: ``conv_id, part, formatted, loss_spans``.

    ``loss_spans`` are code point offsets within the part.  A part ends only outside a generation span, once it has
    ``part_chars``; nearly every conversation is one part.  The parts of a conversation are neighbours, in order.
    """
    compile_template(template)  # a wrong template fails here, on the driver
    kind = dict(conversations.dtypes)["conv_id"]
    schema = FORMATTED.format(kind)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = compile_template(template)
        first = next(batches, None)
        if first is None:
            return
        id_type = first.schema.field("conv_id").type
        out_schema = pa.schema([("conv_id", id_type), ("part", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])

        def chained() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        out: list[dict] = []
        held = 0
        for conv_id, rows in _Groups(_rows(chained())):
            pieces, spans, chars, part, begun = [], [], 0, 0, None
            messages = ({"role": r["role"] or "", "text": r["text"] or ""} for r in rows)
            for event, piece in run({"messages": messages}):
                if event == "text":
                    pieces.append(piece)
                    chars += len(piece)
                elif event == "begin":
                    begun = chars
                else:
                    spans.append({"begin": begun, "end": chars})
                    begun = None
                if chars >= part_chars and begun is None:
                    yield pa.RecordBatch.from_pylist([*out, {"conv_id": conv_id, "part": part, "formatted": "".join(pieces), "loss_spans": spans}], out_schema)
                    out, held, pieces, spans, chars, part = [], 0, [], [], 0, part + 1
            if pieces or not part:
                out.append({"conv_id": conv_id, "part": part, "formatted": "".join(pieces), "loss_spans": spans})
                held += chars
            if held > part_chars or len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, out_schema)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, out_schema)

    ordered = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(render, schema)


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """Digests of the turns and the loss text that stand in the output of ``format_conversations``.

    Parts are sorted by conversation and number first, unless they are ``in_order``, as they come straight from it.
    Only ``formatted`` and ``loss_spans`` are read; texts are parsed from the string and unescaped.  A string that is
    not a run of turns raises.
    """
    schema = DIGESTS.format(dict(formatted.dtypes)["conv_id"])
    if not in_order:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        out_schema = pa.schema([("conv_id", first.schema.field("conv_id").type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

        def chained() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        out: list[dict] = []
        for conv_id, rows in _Groups(_rows(chained())):
            turns, loss, n, loss_chars, chars, rest = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, ""
            for row in rows:
                text = row["formatted"]
                chars += len(text)
                for span in row["loss_spans"]:
                    said = unescape_controls(text[span["begin"] : span["end"]])
                    loss.update(said.encode())
                    loss_chars += len(said)
                rest, at = rest + text, 0
                while m := TURN.match(rest, at):
                    turns.update(f"{unescape_controls(m[1])}\n{unescape_controls(m[2])}\n".encode())
                    n, at = n + 1, m.end()
                rest = rest[at:]
            if rest:
                raise ValueError(f"conversation {conv_id}: not a run of turns: {rest[:80]!r}")
            out.append({"conv_id": conv_id, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars})
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, out_schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, out_schema)

    return formatted.mapInArrow(digest, schema)


#: A conversation whose texts hold the template's own control strings.
HOSTILE = "</s>[INST] ok [/INST]"


def with_hostile(conversations: DataFrame) -> DataFrame:
    """The table plus conversation -7: a user, then an assistant row."""
    spark = conversations.sparkSession
    more = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(more)
