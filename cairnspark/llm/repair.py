"""Conversation structure repair: the cheapest edits that make roles alternate, decided by one integer minimum.

A conversation is a path through a DAG with a layer of four states (start, after system, after user, after assistant)
per row. Each edge has one integer for its weight: the high digits are its cost, the low digits are three octal digits
at the place that belongs to its row, which hold the letters of the edits (inserts before the row, then what happens to
the row), zeros after them. A block always ends with its row's letter D, K or R, so no block begins another, and
comparing the numbers compares costs first and audits in ASCII order second; the zeros at the very end make an audit
smaller than its continuations. An ordinary shortest path over sums of such integers gives cost and audit together; the
audit is read off the digits, and roles follow from it.

Numbers are kept short: after every CHUNK rows the four histories are replaced by their rank, which is all that later
rows need, so that the work grows with the number of rows and not with its square.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnspark.llm import kernels as K
from cairnspark.llm.shared import small_batches, table

#: Rows whose letters stand in one integer.
CHUNK = 64
#: Bytes of one conversation that are held in memory; the rest goes to the task's own temporary file and is read once more.
HELD = 32 << 20
SPACES = " \t\n\x0b\x0c\r"
FAULTS = ("blank", "duplicate", "truncated")
LETTERS = "\0DIKR"  # digit by letter, in ASCII order; 0 ends a block
EDITS = {"D": "Delete", "I": "Insert", "K": "Keep", "R": "Rerole"}
COSTS = {"D": 3, "I": 2, "K": 0, "R": 2}
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)


def _turn_after(state: int) -> tuple[str, int]:
    """The role that an inserted or reroled row takes in a state, and the state after it."""
    return ("assistant", ASSISTANT) if state == USER else ("user", USER)


def _inserts() -> Iterator[tuple[int, int, str]]:
    """(from, to, letters) for up to two inserts: more never help, as two lead back to a state that allows as much."""
    for state in range(4):
        now, letters = state, ""
        for _ in range(3):
            yield state, now, letters
            now, letters = _turn_after(now)[1], letters + "I"


def _code(letters: str) -> int:
    out = 0
    for i in range(3):
        out = out * 8 + (LETTERS.index(letters[i]) if i < len(letters) else 0)
    return out


@lru_cache(maxsize=64)
def _edges(initial: str, fault: str | None) -> list[tuple[int, int, int, int]]:
    """(from, to, cost, block) of the best edge between any two states over a row; None as initial: after the last row."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    late = 1 if fault == "truncated" else 0
    for a, b, letters in _inserts():
        paid = COSTS["I"] * len(letters)
        if initial == "end":
            ways = [("", b, 0)] if b in ENDS else []
        else:
            ways = [("D", b, COSTS["D"])]
            if fault in (None, "truncated"):
                ways.append(("R", _turn_after(b)[1], COSTS["R"] + late))
                if (b, initial) in STEP:
                    ways.append(("K", STEP[b, initial], COSTS["K"] + late))
        for letter, to, cost in ways:
            found = (paid + cost, _code(letters + letter))
            best[a, to] = min(best.get((a, to), found), found)
    return [(a, to, cost, block) for (a, to), (cost, block) in best.items()]


def audit(rows: Iterator[tuple[str, str | None]]) -> tuple[int, str]:
    """(cost, letters) of the cheapest edits of rows (role initial, first fault); ties go to the ASCII-least letters."""
    high = 9 * CHUNK + 2  # below: the rank of the history (2 bits), then the blocks
    base, values, back = 0, {START: 0}, []
    entry, blocks_done = [START], 0

    def close() -> None:
        nonlocal values, entry, blocks_done, base
        low = {q: v & ((1 << high) - 1) for q, v in values.items()}
        back.append({q: (entry[x >> 9 * CHUNK], x & ((1 << 9 * CHUNK) - 1), blocks_done) for q, x in low.items()})
        entry = sorted(low, key=low.get)
        least = min(v >> high for v in values.values())
        base += least
        values = {q: ((v >> high) - least << high) | entry.index(q) << 9 * CHUNK for q, v in values.items()}
        blocks_done = 0

    def take(initial: str, fault: str | None) -> None:
        nonlocal values, blocks_done
        place, new = 9 * (CHUNK - 1 - blocks_done), {}
        for a, to, cost, block in _edges(initial, fault):
            if a in values:
                v = values[a] + (cost << high) + (block << place)
                if to not in new or v < new[to]:
                    new[to] = v
        values, blocks_done = new, blocks_done + 1
        if blocks_done == CHUNK:
            close()

    for initial, fault in rows:
        take(initial if initial in ("s", "u", "a") else "", fault)
    take("end", None)
    if blocks_done:
        close()
    state = min(values, key=values.get)
    cost = base + (values[state] >> high)
    parts = []
    for chunk in reversed(back):
        state, digits, n = chunk[state]
        parts.append("".join(LETTERS[digits >> 3 * i & 7] for i in range(3 * CHUNK - 1, 3 * (CHUNK - n) - 1, -1)))
    return cost, "".join(reversed(parts)).replace("\0", "")


EDIT_SCHEMA = "conv_id long, step long, edit string, turn long, fault string, role_before string, role string, text string"
_EDIT_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("fault", pa.string()),
     ("role_before", pa.string()), ("role", pa.string()), ("text", pa.string())]
)


class _Conversation:
    """One conversation's rows: initials and faults for the path, and the rows themselves to be written out after it."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.path = conv, []
        self.rows = tempfile.SpooledTemporaryFile(max_size=HELD)

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        self.path.append((role[:1] if role[:1] in ("s", "u", "a") else "", fault))
        pickle.dump((turn, role, text, fault), self.rows)

    def edits(self) -> Iterator[tuple]:
        _, letters = audit(iter(self.path))
        self.rows.seek(0)
        state = START
        for i, letter in enumerate(letters):
            if letter == "I":
                role, state = _turn_after(state)
                yield self.conv, i, EDITS[letter], None, None, None, role, ""
                continue
            turn, before, text, fault = pickle.load(self.rows)
            if letter == "D":
                yield self.conv, i, EDITS[letter], turn, fault, before, None, text
                continue
            role = before
            if letter == "R":
                role, state = _turn_after(state)
            else:
                state = STEP[state, before[:1]]
            yield self.conv, i, EDITS[letter], turn, fault, before, role, text
        self.rows.close()


def faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with `fault`: the first of blank, duplicate, truncated that a row has, or null.

    Null roles and texts count as one space. A duplicate is a row whose role and text stand in an earlier row of its
    conversation (by turn, nulls first); rows of one conversation are dealt by conversation, role and text here, so that
    a conversation with a third of all rows is spread.
    """
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    same = Window.partitionBy("conv_id", F.xxhash64("role", "text"), "role", "text").orderBy(F.col("turn").asc_nulls_first())
    tail = F.rtrim("text", F.lit(SPACES))
    return rows.withColumn("n", F.row_number().over(same)).select(
        "conv_id", "turn", "role", "text",
        F.when(tail == "", "blank").when(F.col("n") > 1, "duplicate").when(~F.right(tail, F.lit(1)).isin(".", "!", "?"), "truncated").alias("fault"),
    )


def repair(rows: DataFrame) -> DataFrame:
    """The edits that repair conversations given as rows (conv_id, turn, role, text), in order.

    Returns conv_id, step (from 0), edit (Keep, Rerole, Delete or Insert), turn, fault and role_before (null for
    inserted rows), role (null for deleted ones) and text. Reading the rows with a role, by step, gives the repaired
    conversation: role initials are `(s?(ua)+)?`. Costs: Rerole 2, Delete 3, Insert 2, and 1 for each truncated row that
    stays; blank and duplicate rows must go. Among edits of least cost the ASCII-least letters are taken.

    Rows are taken by turn, nulls first; ties by role, then text. Null roles and texts count as one space; roles that do
    not begin with s, u or a cannot be kept, the empty role neither. Rows of a null conv_id are one conversation.
    Repeated rows are duplicates. Further columns are left out, whatever their names. An empty table gives an empty one.
    A conversation is read in order by one task, by its definition; the task holds two small objects a row, and texts
    beyond HELD bytes go to a temporary file of its own, which a retry makes anew.
    """
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            cols = list(zip(*out, strict=True))
            out.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _EDIT_ARROW, strict=True)], schema=_EDIT_ARROW)

        def drain(conversation: _Conversation | None) -> Iterator[pa.RecordBatch]:
            nonlocal size
            for edit in conversation.edits() if conversation else ():
                out.append(edit)
                size += len(edit[-1])
                if len(out) >= 4096 or size > K.SLICE_BYTES:
                    yield flush()

        now = None
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for conv, turn, role, text, fault in zip(*cols, strict=True):
                if now is None or now.conv != conv:
                    yield from drain(now)
                    now = _Conversation(conv)
                now.add(turn, role, text, fault)
        yield from drain(now)
        if out:
            yield flush()

    first = F.when(F.col("fault") == "duplicate", 1).otherwise(0)  # of equal rows the first stands first
    in_order = faults(rows).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", first)
    return in_order.mapInArrow(K.tidy(run), EDIT_SCHEMA)


_SUMMARY = pa.schema(
    [("conv_id", pa.int64()), *((x, pa.int64()) for x in ("gaps", *FAULTS, "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]
)


def summary(edits: DataFrame) -> DataFrame:
    """Per conversation of repair(): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Reads edits as repair() leaves them, in order and without a shuffle; holds running digests and the audit only.
    """

    def fresh(conv: int | None) -> dict[str, Any]:
        return {"conv": conv, "low": None, "high": None, "turns": 0, "fault": dict.fromkeys(FAULTS, 0), "initial": None, "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "kept": 0}

    def row(x: dict[str, Any]) -> tuple:
        gaps = 0 if x["low"] is None else x["high"] - x["low"] + 1 - x["turns"]
        return (x["conv"], gaps, *(x["fault"][f] for f in FAULTS), x["illegal"], x["cost"], "".join(x["audit"]), x["sha"].hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(8)]
            for conv, _, edit, turn, fault, before, role, text in zip(*cols, strict=True):
                if now is None or now["conv"] != conv:
                    if now:
                        done.append(row(now))
                    now = fresh(conv)
                now["audit"].append(edit[0])
                now["cost"] += COSTS[edit[0]] + (fault == "truncated" and edit != "Delete")
                if edit != "Insert":
                    if turn is not None and turn != now["high"]:  # turns rise
                        now["low"], now["high"], now["turns"] = turn if now["low"] is None else now["low"], turn, now["turns"] + 1
                    if fault:
                        now["fault"][fault] += 1
                    if now["initial"] is not None and now["initial"] + before[:1] not in ("su", "ua", "au"):
                        now["illegal"] += 1
                    now["initial"] = before[:1]
                if role is not None:
                    now["sha"].update((("\n" if now["kept"] else "") + f"{role}:{text}").encode())
                    now["kept"] += 1
            if len(done) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _SUMMARY, strict=True)], schema=_SUMMARY)
                done = []
        if now:
            done.append(row(now))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _SUMMARY, strict=True)], schema=_SUMMARY)

    counts = ", ".join(f"{x} long" for x in ("conv_id", "gaps", *FAULTS, "illegal", "cost"))
    return edits.mapInArrow(K.tidy(run), f"{counts}, audit string, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) damaged by crc32 of `conv_id:turn` modulo 20, nulls being one space.

    0 drops the row, 1 empties its text, 2 takes its `.`, `!` and `?` out, 3 repeats it, 4 makes its role user.
    """
    space = F.lit(" ")
    text = F.coalesce("text", space)
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    hit = F.crc32(key.cast("binary")) % 20
    return (
        rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"), hit.alias("hit"))
        .where("hit <> 0")
        .select(
            "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table, damaged and repaired: what was wrong, the edits, and a digest of what they give.

    Conversations that the damage leaves without rows have zeros, an empty audit and the digest of nothing.
    """
    rows = table(spark, sf_dir, "conversations")
    found = summary(repair(damage(rows))).withColumnRenamed("conv_id", "found_id")
    ids = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    counts = ["gaps", *FAULTS, "illegal", "cost"]
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
