"""Chat records of any known layout as canonical turns, and turns as training text.

A record's layout is found by its schema fingerprint: a hash of its nested field paths.
Fields that no mapping speaks of are left out first, so extra columns change nothing.
The fingerprint selects a declarative mapping, and the mapping says which paths hold
the turns. A typed table has one fingerprint, taken from its schema, and its mapping becomes
column expressions; JSON records have one each.

The format writes a turn as ``OPEN role SEP text CLOSE``. Control strings inside a role or
text, those of this template and those of others, get a backslash after their first
character, and a backslash becomes two, so that no control string is left in a text and
reading takes the escapes out again. The loss mask covers the texts of assistants.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from reviewlake.session import persist_reliably

OPEN, SEP, CLOSE = "<|turn|>", "<|says|>", "<|done|>"
# Control strings of this and of other templates that a text must not hold.
CONTROLS = [
    OPEN, SEP, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
    "<|endoftext|>", "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>",
    "<|system|>", "<|user|>", "<|assistant|>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>",
]
ASSISTANT = "assistant"
#: Other names of the canonical roles.
ROLES = {"human": "user", "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "prompter": "user"}


@dataclass(frozen=True)
class Layout:
    """One layout. Either each row is a turn (``row_turn``), or ``turns`` name the paths that
    hold one turn each, in order, with their roles, or ``turn_list`` is a list of turns."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    turn_list: str = ""
    role: str = ""
    text: str = ""
    row_turn: tuple[str, str, str, str] = ("", "", "", "")


MAPPINGS = [
    Layout("turn_rows", ("conv_id", "turn", "role", "text"), row_turn=("conv_id", "turn", "role", "text")),
    Layout("messages", ("messages[].role", "messages[].content"), turn_list="messages", role="role", text="content"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), turn_list="conversations", role="from", text="value"),
    Layout("prompt_response", ("prompt", "response"), turns=(("user", "prompt"), (ASSISTANT, "response"))),
    Layout("prompt_completion", ("prompt", "completion"), turns=(("user", "prompt"), (ASSISTANT, "completion"))),
    Layout("system_prompt_response", ("system", "prompt", "response"), turns=(("system", "system"), ("user", "prompt"), (ASSISTANT, "response"))),
    Layout("question_answer", ("question", "answer"), turns=(("user", "question"), (ASSISTANT, "answer"))),
    Layout("instruction_output", ("instruction", "output"), turns=(("user", "instruction"), (ASSISTANT, "output"))),
    Layout("instruction_input_output", ("instruction", "input", "output"), turns=(("user", "instruction\n\ninput"), (ASSISTANT, "output"))),
]


def fingerprint(paths: Sequence[str]) -> str:
    """Hash of a set of nested field paths; their order does not matter."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def known_paths(mappings: Sequence[Layout]) -> set[str]:
    return {path for m in mappings for path in m.paths}


def by_fingerprint(mappings: Sequence[Layout] = MAPPINGS) -> dict[str, Layout]:
    return {fingerprint(m.paths): m for m in mappings}


def schema_paths(kind: DataType, prefix: str = "") -> Iterator[str]:
    """Nested field paths of a Spark type; ``[]`` marks the elements of a list."""
    if isinstance(kind, StructType):
        for field in kind.fields:
            yield from schema_paths(field.dataType, f"{prefix}.{field.name}" if prefix else field.name)
    elif isinstance(kind, ArrayType):
        yield from schema_paths(kind.elementType, f"{prefix}[]")
    else:
        yield prefix


def record_paths(value: object, prefix: str = "") -> Iterator[str]:
    """The same of a parsed JSON value; fields that are null have no path."""
    if isinstance(value, dict):
        for name, inner in value.items():
            yield from record_paths(inner, f"{prefix}.{name}" if prefix else name)
    elif isinstance(value, list):
        for inner in value:
            yield from record_paths(inner, f"{prefix}[]")
    elif value is not None:
        yield prefix


def choose(paths: Sequence[str], mappings: Sequence[Layout] = MAPPINGS) -> Layout | None:
    """The mapping of a layout: by the fingerprint of the paths that mappings speak of.

    A record with fields of several layouts has a fingerprint of its own; then the mapping
    with most paths of those that it holds whole is taken, the first of equals.
    """
    known = set(paths) & known_paths(mappings)
    exact = by_fingerprint(mappings).get(fingerprint(list(known)))
    if exact:
        return exact
    whole = [m for m in mappings if set(m.paths) <= known]
    return max(whole, key=lambda m: len(m.paths), default=None)


def canonical_turns(table: DataFrame, mappings: Sequence[Layout] = MAPPINGS, key: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) from a typed table of any mapped layout.

    ``key`` names the column with the conversation's id in layouts of a row per
    conversation. Roles in lists of turns get their canonical names, rows that are turns
    keep theirs; NULL roles and texts are empty. Raises ValueError for an unknown layout.
    """
    found = choose(list(schema_paths(table.schema)), mappings)
    if found is None:
        raise ValueError(f"no mapping for the layout {sorted(schema_paths(table.schema))}")

    def clean(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    def role(c: Column) -> Column:
        names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
        return F.coalesce(names[clean(c)], clean(c))

    if found.row_turn[0]:
        conv, turn, role_name, text = (F.col(f"`{c}`") for c in found.row_turn)
        return table.select(
            conv.cast("long").alias("conv_id"), turn.cast("long").alias("turn"),
            clean(role_name).alias("role"), clean(text).alias("text"),
        )
    if found.turn_list:
        inner = F.posexplode(F.col(f"`{found.turn_list}`")).alias("turn", "_turn")
        opened = table.select(F.col(f"`{key}`").cast("long").alias("conv_id"), inner)
        return opened.select(
            "conv_id", F.col("turn").cast("long").alias("turn"),
            role(F.col(f"_turn.`{found.role}`")).alias("role"), clean(F.col(f"_turn.`{found.text}`")).alias("text"),
        )
    made = [
        F.struct(
            F.lit(name).alias("role"),
            F.concat_ws("\n\n", *[F.nullif(clean(F.col(f"`{p}`")), F.lit("")) for p in path.split("\n\n")]).alias("text"),
        )
        for name, path in found.turns
    ]
    opened = table.select(F.col(f"`{key}`").cast("long").alias("conv_id"), F.posexplode(F.array(*made)).alias("turn", "_turn"))
    return opened.select("conv_id", F.col("turn").cast("long").alias("turn"), "_turn.role", "_turn.text")


def record_turns(record: object, mappings: Sequence[Layout] = MAPPINGS) -> list[tuple[str, str]] | None:
    """(role, text) of a parsed JSON record, or None if its layout is unknown."""
    found = choose(list(record_paths(record)), mappings) if isinstance(record, dict) else None
    if found is None or found.row_turn[0]:
        return None

    def written(value: object) -> str:
        return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)

    if found.turn_list:
        turns = [t for t in record[found.turn_list] if isinstance(t, dict)]
        roles = [written(t.get(found.role)) for t in turns]
        return [(ROLES.get(r, r), written(t.get(found.text))) for r, t in zip(roles, turns, strict=True)]
    return [(role, "\n\n".join(t for p in path.split("\n\n") if (t := written(record.get(p))))) for role, path in found.turns]


def canonical_json_turns(records: DataFrame, column: str, key: str = "conv_id", mappings: Sequence[Layout] = MAPPINGS) -> DataFrame:
    """(conv_id, turn, role, text, layout) from JSON records of mixed layouts.

    ``layout`` is the fingerprint. A record that is no JSON object, or of no known layout,
    gives one row with NULL role and text, so that it can be found and counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    record = json.loads(text or "")
                except (ValueError, RecursionError):
                    record = None
                known = known_paths(mappings)
                layout = fingerprint([p for p in record_paths(record) if p in known])
                turns = record_turns(record, mappings)
                rows += [(conv, i, r, t, layout) for i, (r, t) in enumerate(turns or [(None, None)])]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["conv_id", "turn", "role", "text", "layout"],
            )

    chosen = records.select(F.col(key).cast("long").alias("conv_id"), F.col(column).cast("string"))
    return chosen.mapInArrow(run, "conv_id long, turn long, role string, text string, layout string")


_CONTROL = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS)
_READ = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(SEP)}(.*?){re.escape(CLOSE)}", re.DOTALL)


def escaped(c: Column) -> Column:
    """A role or text without control strings, as a column expression."""
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), f"(?:{_CONTROL})", r"$0\\")


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, part, piece, mask_start, mask_end): each turn's part of the text.

    The conversation's text is its pieces by (turn, part), one after the other. The mask is
    the range of code points of ``piece`` that the loss covers, empty but for assistants.
    ``part`` keeps rows that repeat a turn in one order. All is computed on the row, so a
    conversation of any length needs no gathering.
    """
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(SEP))
    piece = F.concat(head, escaped(F.col("text")), F.lit(CLOSE))
    covered = F.col("role") == ASSISTANT
    start, end = F.length(head), F.length("piece") - len(CLOSE)
    return turns.select("conv_id", "turn", "role", "text", piece.alias("piece")).select(
        "conv_id",
        "turn",
        F.xxhash64("role", "text").alias("part"),
        "piece",
        F.when(covered, start).otherwise(0).alias("mask_start"),
        F.when(covered, end).otherwise(0).alias("mask_end"),
    )


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    return [(unescaped(role), unescaped(said)) for role, said in _READ.findall(text)]


DIGEST_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def digests(pieces: DataFrame) -> DataFrame:
    """One row of ``DIGEST_SCHEMA`` per conversation, read from formatted pieces.

    Conversations are dealt to tasks and sorted by Spark; a task reads them as a stream and
    holds two hash states, so the longest conversation takes no more memory than one
    batch of rows. A SHA-256 has to run over its conversation in one piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: list | None = None

        def close(state: list) -> tuple:
            conv, n, turns, chars, loss, size = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = [c.split()[0] for c in DIGEST_SCHEMA.split(", ")]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            rows = []
            for conv, piece, start, end in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if current is None or current[0] != conv:
                    if current is not None:
                        rows.append(close(current))
                    current = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(piece):
                    current[1] += 1
                    current[2].update(f"{role}\n{said}\n".encode())
                under_mask = unescaped(piece[start:end])
                current[3] += len(under_mask)
                current[4].update(under_mask.encode())
                current[5] += len(piece)
            yield batch_of(rows)
        if current is not None:
            yield batch_of([close(current)])

    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part")
    return dealt.select("conv_id", "piece", "mask_start", "mask_end").mapInArrow(run, DIGEST_SCHEMA)


def format_conversations(table: DataFrame, mappings: Sequence[Layout] = MAPPINGS) -> DataFrame:
    """The formatted pieces of a typed table of conversations, stored."""
    return persist_reliably(formatted(canonical_turns(table, mappings)))

