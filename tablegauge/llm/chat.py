"""Chat formatting in windows of a token budget.

Turns are marked by control strings; those inside texts and roles are escaped with a backslash and can
be read back. A conversation longer than the budget is cut into windows at turns: running sums of the
turns' tokens say where the next window starts. Each window begins with the system turn and as many of
the last turns before it as the history budget holds; assistant text is a target only in the window where
its turn is new. The sums run along a sorted stream, so a window is all that a task holds.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablegauge.llm.tokens import word_encoder
from tablegauge.session import checkpoint_folder, rewritten

BUDGET_TOKENS = 1024
HISTORY_TOKENS = 256
#: A conversation of more turns is dealt to several tasks, so many consecutive turns (or as many as the
#: history can hold) to each. A window ends at that border; history and system turn reach over it.
SEGMENT_TURNS = 4096
ROWS_AT_ONCE = 2048

TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates; none of them appears in a formatted text
#: but for the two above, where a turn starts and ends.
CONTROL_STRINGS = (TURN_START, TURN_END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(TURN_START) + r"((?:\\.|[^\\\n])*)\n(.*?)" + re.escape(TURN_END) + "\n", re.DOTALL)

WINDOW_SCHEMA = (
    "conv_id long, segment long, window int, text string, repeated_turns int, tokens long,"
    " over_budget boolean, loss array<struct<start: int, end: int>>"
)


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for control in CONTROL_STRINGS:
        text = text.replace(control, control[0] + "\\" + control[1:])
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def format_turn(role: str, text: str) -> str:
    return f"{TURN_START}{escape_role(role)}\n{escape(text)}{TURN_END}\n"


def parse_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and place of the escaped text, of each turn of a formatted window."""
    out, at = [], 0
    for found in _TURN.finditer(formatted):
        if found.start() != at:
            break
        out.append((unescape(found[1]), unescape(found[2]), found.start(2), found.end(2)))
        at = found.end()
    if at != len(formatted):
        raise ValueError(f"not a turn at character {at}")
    return out


@dataclass
class _Turn:
    text: str
    tokens: int
    #: Place of the target in `text`; None where it is no target.
    target: tuple[int, int] | None


@dataclass
class _Open:
    """The window being filled."""

    segment: tuple
    budget: int
    history_budget: int
    system: _Turn | None = None
    number: int = 0
    repeated: list[_Turn] = field(default_factory=list)
    fresh: list[_Turn] = field(default_factory=list)
    #: Turns in `fresh` belong to the segment before; the first turn of its own starts window 0.
    visiting: bool = False
    #: Running sums of tokens: where the window's new turns start, and where they end.
    start: int = 0
    end: int = 0

    def room(self) -> int:
        return self.budget - sum(t.tokens for t in self.repeated)

    def fits(self, turn: _Turn) -> bool:
        return not self.fresh or self.end + turn.tokens - self.start <= self.room()

    def add(self, turn: _Turn) -> None:
        self.fresh.append(turn)
        self.end += turn.tokens

    def next(self, turn: _Turn) -> None:
        """Start the window after this one, which `turn` no longer fits."""
        last = [t for t in self.repeated + self.fresh if t is not self.system]
        fixed = [self.system] if self.system else []
        left = min(self.history_budget, self.budget - turn.tokens - sum(t.tokens for t in fixed))
        history: list[_Turn] = []
        for t in reversed(last):
            if t.tokens > left:
                break
            history.insert(0, t)
            left -= t.tokens
        self.number, self.repeated, self.fresh = 0 if self.visiting else self.number + 1, fixed + history, []
        self.visiting, self.start = False, self.end

    def row(self) -> dict[str, Any]:
        text, loss, at = [], [], 0
        for i, t in enumerate(self.repeated + self.fresh):
            if t.target and i >= len(self.repeated):
                loss.append({"start": at + t.target[0], "end": at + t.target[1]})
            text.append(t.text)
            at += len(t.text)
        tokens = sum(t.tokens for t in self.repeated + self.fresh)
        return {
            "conv_id": self.segment[0], "segment": self.segment[1], "window": self.number, "text": "".join(text),
            "repeated_turns": len(self.repeated), "tokens": tokens, "over_budget": tokens > self.budget, "loss": loss,
        }


_WINDOW_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("segment", pa.int64()), ("window", pa.int32()), ("text", pa.string())]
    + [("repeated_turns", pa.int32()), ("tokens", pa.int64()), ("over_budget", pa.bool_())]
    + [("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
)


def format_windows(turns: DataFrame, vocabulary: str, budget: int = BUDGET_TOKENS, history: int = HISTORY_TOKENS, target_role: str = "assistant") -> DataFrame:
    """Formatted windows of `conv_id`, `turn`, `role`, `text` rows; a null text or role counts as empty.

    Turns are in the order of `turn` (a null first), those of one number by role and text; repeated
    rows are turns of their own. Null ids are one conversation. The first turn, if its role is
    "system", is in every window; history makes way for it. A turn that is over the budget, alone or
    with the system turn, is the only new one of its window, marked `over_budget`; texts are never cut.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: _Open | None = None
        out: list[dict] = []

        def made(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
            whole = format_turn(role, text)
            end = len(whole) - len(TURN_END) - 1
            return whole, (end - len(escape(text)), end) if role == target_role else None

        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(low, ROWS_AT_ONCE).to_pylist()
                formatted = [made(r["role"], r["text"]) for r in rows]
                sizes = [len(x) // 4 for x in word_encoder(vocabulary).encode(pa.array([t for t, _ in formatted], pa.string()))]
                for r, (text, target), tokens in zip(rows, formatted, sizes, strict=True):
                    turn, segment = _Turn(text, tokens, target), (r["conv_id"], r["segment"])
                    if at is None or at.segment != segment:
                        if at is not None:
                            out.append(at.row())
                        at = _Open(segment, budget, history, visiting=segment[1] > 0)
                        if r["role"] == "system" and r["place"] == 0:
                            at.system = turn
                    if at.visiting:
                        if r["visits"]:
                            at.fresh.append(turn)
                            continue
                        at.next(turn)
                    elif not at.fits(turn):
                        out.append(at.row())
                        at.next(turn)
                    at.add(turn)
                if len(out) >= ROWS_AT_ONCE:
                    yield pa.RecordBatch.from_pylist(out, schema=_WINDOW_ARROW)
                    out = []
        if at is not None:
            out.append(at.row())
        yield pa.RecordBatch.from_pylist(out, schema=_WINDOW_ARROW)

    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return (
        _segments(rows, max(SEGMENT_TURNS, history + 1), history)
        .repartition("conv_id", "segment")
        .sortWithinPartitions("conv_id", "segment", "place", F.col("turn").asc_nulls_first(), "role", "text")
        .mapInArrow(windows, WINDOW_SCHEMA)
    )


def _segments(rows: DataFrame, size: int, history: int) -> DataFrame:
    """Turns with `segment`, `place` in the conversation, and `visits` (the turn belongs to an earlier segment).

    Conversations of up to `size` turns are segment 0, their turns in place 0 (other columns order them).
    Turns of longer ones are sorted by ranges and written; the count of each conversation's turns in every
    file gives their places. Each segment is visited by the system turn and the last `history` turns before
    it, which hold all its history, as no turn is without a token.
    """
    long = rows.groupBy(F.col("conv_id").alias("of")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size)
    rows = rows.join(long, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    columns = ["conv_id", "segment", "place", "turn", "role", "text", "visits"]
    zero = F.lit(0).cast("long")
    short = rows.where("n IS NULL").select("*", zero.alias("segment"), zero.alias("place"), F.lit(False).alias("visits"))

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    at = F.monotonically_increasing_id()  # file number, then row number
    long_rows = rewritten(rows.where("n IS NOT NULL").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at))
    long_rows = long_rows.withColumn("file", F.call_function("shiftright", "at", F.lit(33)))
    before = Window.partitionBy("of").orderBy("of_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        long_rows.groupBy(F.col("conv_id").alias("of"), F.col("file").alias("of_file"))
        .agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("here"))
        .withColumn("start", F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("low"))
    )
    placed = long_rows.join(starts, (F.col("file") == F.col("of_file")) & F.col("conv_id").eqNullSafe(F.col("of"))).withColumn("place", F.col("at") + F.col("start"))
    own, last = F.floor(F.col("place") / size), F.floor((F.col("n") - 1) / size)
    nothing = F.array().cast("array<bigint>")
    system = F.when((F.col("place") == 0) & (F.col("role") == "system"), F.sequence(F.lit(1).cast("long"), last)).otherwise(nothing)
    tail = F.when((F.col("place") % size >= size - history) & (own < last), F.array(own + 1)).otherwise(nothing)
    visited = placed.withColumn("segment", F.explode(F.concat(F.array(own), system, tail))).withColumn("visits", F.col("segment") > own)
    return short.select(*columns).unionByName(visited.select(*columns))


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_windows(windows: DataFrame) -> DataFrame:
    """What formatted windows say when read back, per conversation: turns, targets, and their hashes.

    Repeated turns are left out, so every turn counts once; only text under the mask counts as target.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        out: list[tuple] = []
        turns = chars = formatted = 0
        of_turns, of_loss = hashlib.sha256(), hashlib.sha256()
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def rows() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        def close() -> None:
            if at is not None:
                out.append((at[0], turns, of_turns.hexdigest(), chars, of_loss.hexdigest(), formatted))

        for batch in batches:
            for conv_id, text, repeated, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (conv_id,):
                    close()
                    at, turns, chars, formatted = (conv_id,), 0, 0, 0
                    of_turns, of_loss = hashlib.sha256(), hashlib.sha256()
                formatted += len(text)
                for role, said, _, _ in parse_turns(text)[repeated:]:
                    of_turns.update(f"{role}\n{said}\n".encode())
                    turns += 1
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    of_loss.update(target.encode())
                    chars += len(target)
            if len(out) >= ROWS_AT_ONCE:
                yield rows()
                out = []
        close()
        yield rows()

    return (
        windows.repartition("conv_id")
        .sortWithinPartitions("conv_id", "segment", "window")
        .select("conv_id", "text", "repeated_turns", "loss")
        .mapInArrow(digest, DIGEST_SCHEMA)
    )


def write_windows(windows: DataFrame) -> DataFrame:
    """Windows written to the shared folder, and read again."""
    folder = f"{checkpoint_folder(windows.sparkSession)}/chat-windows-{uuid.uuid4().hex}"
    windows.write.parquet(folder)
    return windows.sparkSession.read.parquet(folder)
