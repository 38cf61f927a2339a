r"""Chat formatting by schema fingerprints.

A record's layout is told by the hash of all its sorted nested field paths (array items as []). The hash selects a
declarative mapping, which turns prompt/completion, question, preference, instruction, message-list and row-per-turn
layouts into canonical turns (role, text). A hash that is not known is settled once among the layouts whose fields the
record has, and remembered: lists of turns come before single fields, then the layout with the most fields; so records
may carry any further fields. The template marks each turn:

    <turn ROLE>\nTEXT\n</turn>\n

Control strings inside roles and texts are escaped by a backslash in front (a backslash by another), so that the output
parses back to exactly the turns that went in. Assistant texts are under the loss mask.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnspark.llm import kernels as K
from cairnspark.llm.shared import aside, table

#: What would be read as control if it stood in a text: turn marks, and header lines of common chat layouts.
_CONTROL = re.compile(r"\\|</?turn|###|<\||\|>")
_ROLE_CONTROL = re.compile(r"\\|</?turn|###|<\||\|>|>|\n")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<turn ((?:\\.|[^\\>])*)>\n(.*?)\n</turn>\n", re.DOTALL)

#: Layouts: field paths -> how to read turns. "rows": one turn per row. "list": turns in a list; "fields": one turn per
#: field, in order; a field that is null or missing gives no turn.
LAYOUTS: dict[str, dict[str, Any]] = {
    "rows": {"paths": ["conv_id", "role", "text", "turn"], "kind": "rows", "role": "role", "text": "text"},
    "messages": {"paths": ["messages[].content", "messages[].role"], "kind": "list", "list": "messages", "role": "role", "text": "content"},
    "conversations": {"paths": ["conversations[].from", "conversations[].value"], "kind": "list", "list": "conversations", "role": "from", "text": "value"},
    "prompt": {"paths": ["completion", "prompt"], "kind": "fields", "fields": [("user", ["prompt"]), ("assistant", ["completion"])]},
    "instruction": {
        "paths": ["input", "instruction", "output"], "kind": "fields",
        "fields": [("user", ["instruction", "input"]), ("assistant", ["output"])],
    },
    "instruction_only": {"paths": ["instruction", "output"], "kind": "fields", "fields": [("user", ["instruction"]), ("assistant", ["output"])]},
    "response": {"paths": ["prompt", "response"], "kind": "fields", "fields": [("user", ["prompt"]), ("assistant", ["response"])]},
    "question": {"paths": ["answer", "question"], "kind": "fields", "fields": [("user", ["question"]), ("assistant", ["answer"])]},
    # Of a pair of answers the chosen one is the answer.
    "preference": {"paths": ["chosen", "prompt", "rejected"], "kind": "fields", "fields": [("user", ["prompt"]), ("assistant", ["chosen"])]},
    "system_prompt": {
        "paths": ["completion", "prompt", "system"], "kind": "fields",
        "fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["completion"])],
    },
}
#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths: list[str]) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(set(paths))))


BY_FINGERPRINT: dict[int, str | None] = {fingerprint(v["paths"]): k for k, v in LAYOUTS.items()}
#: Fingerprints that a worker remembers beyond those.
REMEMBERED = 100_000


def select_layout(paths: list[str]) -> str | None:
    """The layout of records with these field paths, looked up by their fingerprint; None if there is none."""
    key = fingerprint(paths)
    if key not in BY_FINGERPRINT:
        # A list without items shows as its own path; it stands for any fields of items.
        have, empty = set(paths), [p for p in paths if p.endswith("[]")]
        fits = [
            (v["kind"] == "list", len(v["paths"]), k) for k, v in LAYOUTS.items()
            if all(p in have or any(p.startswith(e + ".") for e in empty) for p in v["paths"])
        ]
        if len(BY_FINGERPRINT) >= REMEMBERED:
            return max(fits)[-1] if fits else None
        BY_FINGERPRINT[key] = max(fits)[-1] if fits else None
    return BY_FINGERPRINT[key]


def _parts(value: Any) -> str | None:
    """The text of a list of text parts; None of anything else."""
    if isinstance(value, list) and value and all(isinstance(p, dict) and p.get("type", "text") == "text" and isinstance(p.get("text"), str) for p in value):
        return "".join(p["text"] for p in value)
    return None


def value_paths(value: Any, at: str = "") -> Iterator[str]:
    """Nested field paths of a JSON value."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from value_paths(v, f"{at}.{k}" if at else k)
    elif isinstance(value, list):
        if not value:
            yield f"{at}[]"
        elif _parts(value) is not None:  # a text in parts stands where a text would
            yield at
            return
        for v in value:
            yield from value_paths(v, f"{at}[]")
    else:
        yield at


def schema_paths(kind: T.DataType, at: str = "") -> Iterator[str]:
    """Nested field paths of a DataFrame schema."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)
    elif isinstance(kind, T.ArrayType):
        yield from schema_paths(kind.elementType, f"{at}[]")
    else:
        yield at


def canonical_turns(record: Any) -> tuple[str | None, list[tuple[str, str]] | None]:
    """Layout and turns of a JSON record, or nulls if no layout fits. Null texts count as empty in lists.

    A text may be a list of text parts. Where a list of turns has one whose text is neither, as with images, the record has
    no turns: none is made up.
    """
    name = select_layout(list(value_paths(record)))
    layout = LAYOUTS.get(name or "")
    if layout is None or layout["kind"] == "rows":
        return None, None
    plain = lambda x: x if _parts(x) is None else _parts(x)
    shown = lambda x: "" if x is None else plain(x) if isinstance(plain(x), str) else json.dumps(x, ensure_ascii=False)
    if layout["kind"] == "list":
        turns = [m if isinstance(m, dict) else {} for m in record[layout["list"]]]
        if any(isinstance(plain(m.get(layout["text"])), (list, dict)) for m in turns):
            return None, None
        return name, [(ROLES.get(shown(m.get(layout["role"])), shown(m.get(layout["role"]))), shown(m.get(layout["text"]))) for m in turns]
    out = []
    for role, fields in layout["fields"]:
        parts = [shown(record[f]) for f in fields if record.get(f) not in (None, "")]
        if parts:
            out.append((role, "\n\n".join(parts)))
    return name, out


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, tuple[int, int]]:
    """The turn's output, and the code points of it that hold the text."""
    head = f"<turn {escape(role, _ROLE_CONTROL)}>\n"
    body = escape(text)
    return f"{head}{body}\n</turn>\n", (len(head), len(head) + len(body))


def parse(output: str) -> list[tuple[str, str]]:
    """The turns that an output holds."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(output)]


def format_records(records: DataFrame, column: str = "record") -> DataFrame:
    """Adds layout, formatted and mask (code point ranges of assistant texts) to rows of JSON records.

    Rows that are null, no JSON or of no known layout get nulls; further fields are ignored, and a list without turns
    gives an empty output. One row in, one row out, repeated rows too; a record of any length within its row; an empty
    table gives an empty one. A column of the caller named layout, formatted or mask is kept as layout_in and so on.
    """
    records = aside(records, "layout", "formatted", "mask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, outs, masks = [], [], []
            for raw in batch.column(batch.schema.get_field_index(column)).to_pylist():
                turns = name = None
                try:
                    record = json.loads(raw) if raw is not None else None
                    name, turns = canonical_turns(record) if isinstance(record, dict) else (None, None)
                except ValueError:
                    pass
                at, text, mask = 0, [], []
                for role, body in turns or []:
                    piece, (a, b) = format_turn(role, body)
                    if role == "assistant":
                        mask.append([at + a, at + b])
                    at += len(piece)
                    text.append(piece)
                names.append(name)
                outs.append(None if turns is None else "".join(text))
                masks.append(None if turns is None else mask)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(outs, pa.string()), pa.array(masks, pa.list_(pa.list_(pa.int32())))],
                [*batch.schema.names, "layout", "formatted", "mask"],
            )

    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields)
    return records.mapInArrow(K.tidy(run), f"{base}, layout string, formatted string, mask array<array<int>>")


def format_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, formatted, begin, end) of row-per-turn tables: one turn's output per row.

    The layout is selected by the fingerprint of the table's field paths; columns that the layout does not name are left
    out. Null roles and texts count as empty. A conversation's output is its turns' outputs in order of turn (ties by
    role, then text; null turns first); repeated rows are repeated turns. begin..end are the code points that hold the
    text; it is under the loss mask for the role assistant. An empty table gives an empty one.
    """
    name = select_layout(list(schema_paths(rows.schema)))
    layout = LAYOUTS.get(name or "", {})
    if layout.get("kind") != "rows":
        raise ValueError(f"no row-per-turn layout for the fields {sorted(rows.columns)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            done = [format_turn(r or "", t or "") for r, t in zip(roles, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([r or "" for r in roles], pa.string()),
                    pa.array([x[0] for x in done], pa.string()),
                    pa.array([x[1][0] for x in done], pa.int64()), pa.array([x[1][1] for x in done], pa.int64()),
                ],
                ["conv_id", "turn", "role", "formatted", "begin", "end"],
            )

    return rows.select("conv_id", "turn", F.col(layout["role"]).alias("role"), F.col(layout["text"]).alias("text")).mapInArrow(
        K.tidy(run), "conv_id long, turn long, role string, formatted string, begin long, end long"
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its output says: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns stream by in order; only running digests are held, so a conversation of any length takes constant memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[str, Any] | None = None
        done: list[dict[str, Any]] = []

        def flush():
            rows = [
                (x["id"], x["n"], x["turns"].hexdigest(), x["loss_chars"], x["loss"].hexdigest(), x["chars"]) for x in done
            ]
            done.clear()
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in (0, 3, 4, 5)]
            for conv, output, begin, end in zip(*cols, strict=True):
                if now is None or now["id"] != conv:
                    if now:
                        done.append(now)
                    now = {"id": conv, "n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
                now["chars"] += len(output)
                for role, text in parse(output):
                    now["n"] += 1
                    now["turns"].update(f"{role}\n{text}\n".encode())
                    if role == "assistant":
                        masked = unescape(output[begin:end])
                        now["loss_chars"] += len(masked)
                        now["loss"].update(masked.encode())
            if len(done) >= 4096:
                yield flush()
        if now:
            done.append(now)
        if done:
            yield flush()

    in_order = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return in_order.select("conv_id", "turn", "role", "formatted", "begin", "end").mapInArrow(
        K.tidy(run),
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    r"""All conversations, and conversation -7, whose texts look like control strings; read back from the output."""
    rows = table(spark, sf_dir, "conversations")
    odd = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return read_back(format_rows(rows.unionByName(more, allowMissingColumns=True)))
