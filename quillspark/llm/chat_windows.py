"""Chat formatting in budgeted windows. Every turn is rendered by a template; prefix sums of the turns' tokens
choose turn-aligned spans that fit a token budget. A window repeats the system turn and the last turns
before it as far as a smaller budget goes; the loss mask covers the texts of new assistant turns alone, so
that each is a target exactly once.

Template: `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles and texts a run of bars after `<` gets one bar
more, so that neither control string can occur there; taking one off restores them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.common import long_keys, places, runs, small, whole_groups
from quillspark.llm.tokens import ByteLevel

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Token budgets of a window and of the history it repeats, and the most turns of that history.
BUDGET, HISTORY, HISTORY_TURNS = 2048, 256, 4
#: A window begins anew after so many turns, so that long conversations can be cut among tasks.
SEGMENT = 4096
LONG_ROWS, LONG_CHARS = 10_000, 1 << 26
#: Tokens of a turn besides its role line and text: both control strings and the line end.
FRAME = 3

_bars, _more = re.compile(r"<(?=\|)"), re.compile(r"<\|(?=\|)")
_turn = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _bars.sub("<|", text)


def unescape(text: str) -> str:
    return _more.sub("<", text)


def _role_line(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def _role_of(line: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], line))


@dataclass
class Turn:
    role: str
    text: str
    tokens: int

    @property
    def head(self) -> str:
        return f"{OPEN}{_role_line(self.role)}\n"

    @property
    def rendered(self) -> str:
        return f"{self.head}{escape(self.text)}{CLOSE}\n"


def spans(tokens: np.ndarray, first: int, system: int, budget: int = BUDGET, history: int = HISTORY,
          history_turns: int = HISTORY_TURNS) -> Iterator[tuple[int, int, int]]:
    """Turn-aligned windows over the turns from `first` on, as (history from, new from, end). tokens: all turns
    from the earliest history on; system: tokens of the repeated system turn, 0 without one."""
    sums = np.concatenate([[0], np.cumsum(tokens)])
    start, repeats = first, 1 if system else 0
    while start < len(tokens):
        lead = system if start >= repeats else 0
        back = int(np.searchsorted(sums, sums[start] - history))
        back = min(max(back, start - history_turns, repeats if lead else 0), start)
        room = budget - lead
        # History gives way to the first new turn.
        back = min(max(back, int(np.searchsorted(sums, sums[start + 1] - room))), start)
        end = max(int(np.searchsorted(sums, sums[back] + room, "right")) - 1, start + 1)
        yield back, start, end
        start = end


def _windows(turns: list[Turn], first: int, system: Turn | None, budgets: tuple[int, int, int]) -> Iterator[tuple]:
    """text, tokens, fresh, turns, loss starts and ends of each window. fresh: where the new turns begin. A
    system turn is given again when turns do not begin with the conversation."""
    held = turns if system is None or turns and turns[0] is system else [system, *turns]
    first += len(held) - len(turns)
    tokens = np.array([t.tokens for t in held], np.int64)
    for back, start, end in spans(tokens, first, system.tokens if system else 0, *budgets):
        lead = [system] if system and start else []
        pieces, at, fresh, starts, ends = [], 0, 0, [], []
        for i, turn in [*((-1, t) for t in lead), *((i, held[i]) for i in range(back, end))]:
            if i == start:
                fresh = at
            if i >= start and turn.role == "assistant":
                starts.append(at + len(turn.head))
                ends.append(at + len(turn.rendered) - len(CLOSE) - 1)
            pieces.append(turn.rendered)
            at += len(pieces[-1])
        yield "".join(pieces), int(tokens[back:end].sum()) + sum(t.tokens for t in lead), fresh, end - start, starts, ends


WINDOW = ("segment long, window long, text string, n_tokens long, fresh long, n_turns long, loss_starts array<long>, "
          "loss_ends array<long>")
_NAMES = ["conv_id", *[part.split()[0] for part in WINDOW.split(", ")]]
_TYPES = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 2]


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _parts(conversations: DataFrame, tokenizer: str, budgets: tuple[int, int, int], long_rows: int, long_chars: int,
           segment: int) -> list[tuple[DataFrame, bool]]:
    """Windows of the short and, if there are any, the long conversations, and whether each conversation's windows
    follow each other within a task."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                                F.coalesce("text", F.lit("")).alias("text"))
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {WINDOW}"

    def cut(key: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode, line_tokens = ByteLevel(tokenizer, plain=True), {}

            def turn(role: str, text: str) -> Turn:
                if role not in line_tokens:
                    if len(line_tokens) >= 1000:
                        line_tokens.clear()
                    line_tokens[role] = len(encode.ids(f"{_role_line(role)}\n"))
                return Turn(role, text, FRAME + line_tokens[role] + len(encode.ids(escape(text))))

            for group in whole_groups(batches, key):
                at, out = [], []
                for lo, hi in runs(group[key]):
                    part = group.slice(lo, hi - lo)
                    turns = [turn(r, t) for r, t in zip(part["role"].to_pylist(), part["text"].to_pylist())]
                    if key == "conv_id":
                        pos, numbers = range(hi - lo), range(0, hi - lo, segment)
                    else:
                        pos, numbers = part["place"].to_pylist(), [part["segment"][0].as_py() * segment]
                    system = turns[0] if pos[0] == 0 and turns[0].role == "system" else None
                    for low in numbers:  # a segment: its turns, after those that its first window may repeat
                        mine = [i for i in range(len(turns)) if low - budgets[2] <= pos[i] < low + segment]
                        first = sum(pos[i] < low for i in mine)
                        for n, window in enumerate(_windows([turns[i] for i in mine], first, system, budgets)):
                            at.append(lo)
                            out.append((low // segment, n, *window))
                        if sum(len(w[2]) for w in out) > 1 << 24:
                            yield batch_of(group, at, out)
                            at, out = [], []
                if out:
                    yield batch_of(group, at, out)

        def batch_of(group: pa.Table, at: list[int], out: list[tuple]) -> pa.RecordBatch:
            ids = group["conv_id"].combine_chunks().take(pa.array(at, pa.int64()))
            return pa.RecordBatch.from_arrays([ids, *(pa.array(x, type=t) for x, t in zip(zip(*out), _TYPES))], names=_NAMES)
        return run

    def short(part: DataFrame) -> tuple[DataFrame, bool]:
        ordered = part.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *_order())
        return ordered.mapInArrow(cut("conv_id"), schema), True

    marked = long_keys(rows, "conv_id", F.length("text"), long_rows, long_chars)
    if marked.isEmpty():
        return [short(rows)]
    keys = small(marked)
    same = rows["conv_id"].eqNullSafe(keys["_long"])
    placed = places(rows.join(keys, same, "left_semi"), "conv_id", _order(), "place")
    # A row goes to its segment, to the next one if that may repeat it, and a system turn to all.
    own = F.floor(F.col("place") / segment).cast("long")
    sizes = small(placed.groupBy("conv_id").agg(F.max(own).alias("last")).withColumnRenamed("conv_id", "_c"))
    placed = placed.join(sizes, placed["conv_id"].eqNullSafe(sizes["_c"])).drop("_c")
    reach = (F.when((F.col("place") == 0) & (F.col("role") == "system"), F.col("last"))
             .when(F.col("place") % segment >= segment - budgets[2], F.least(own + 1, "last")).otherwise(own))
    dealt = placed.withColumn("segment", F.explode(F.sequence(own, reach)))
    dealt = dealt.withColumn("group", F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "segment"))
    long = (dealt.repartition("group").sortWithinPartitions("group", "place")
            .select("group", "conv_id", "segment", "place", "role", "text").mapInArrow(cut("group"), schema))
    return [short(rows.join(keys, same, "left_anti")), (long, False)]


def chat_windows(conversations: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY,
                 history_turns: int = HISTORY_TURNS, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS,
                 segment: int = SEGMENT) -> DataFrame:
    """The windows of conversations(conv_id, turn, role, text), turns by turn (nulls first), then role and text:
    conv_id, segment, window (numbers in order), text, n_tokens, fresh (code point where what is not
    repeated begins), n_turns (new ones) and the loss mask as loss_starts and loss_ends in code points.

    Null role or text: empty. A null conv_id is a conversation, repeated rows are turns of their own, other
    columns are ignored, an empty table gives no window. A first turn of role system is given in every
    window. A turn is never cut: one above the budget makes a window above it. long_rows and long_chars
    only choose how the work is dealt, not the windows."""
    out = None
    for part, _ in _parts(conversations, tokenizer, (budget, history, history_turns), long_rows, long_chars, segment):
        out = part if out is None else out.unionByName(part)
    return out


def turns_of(text: str, fresh: int = 0) -> list[tuple[str, str]]:
    """Role and text of the turns of a window, read back; with fresh, of the new ones."""
    return [(_role_of(m[1]), unescape(m[2])) for m in _turn.finditer(text, fresh)]


def read_back(windows: DataFrame, ordered: bool = False) -> DataFrame:
    """What the windows hold, read from their text: conv_id, n_turns, turns_sha256 (role, line end, text, line end
    of each turn), loss_chars, loss_sha256 (of the text under the mask), formatted_chars. ordered: each
    conversation's windows follow each other within a partition already. Digests run on from window to
    window, so one window is held at a time."""
    if not ordered:
        windows = windows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "segment", "window")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        now, done, kind = nothing, [], None
        for batch in batches:
            kind = batch.column("conv_id").type
            for conv, text, fresh, starts, ends in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "text", "fresh", "loss_starts", "loss_ends"))):
                if now is nothing or conv != now:
                    if now is not nothing:
                        done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                    now, n, chars, size, turns, loss = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, said in turns_of(text, fresh):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for lo, hi in zip(starts, ends):
                    target = unescape(text[lo:hi])
                    loss.update(target.encode())
                    chars += len(target)
                size += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*done), [kind, *types])], names=names)
                done = []
        if now is not nothing:
            last = [(now, n, turns.hexdigest(), chars, loss.hexdigest(), size)]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*last), [kind, *types])], names=names)

    conv = windows.schema["conv_id"].dataType.simpleString()
    return windows.select("conv_id", "text", "fresh", "loss_starts", "loss_ends").mapInArrow(
        run, f"conv_id {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def digests(conversations: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY,
            history_turns: int = HISTORY_TURNS, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS,
            segment: int = SEGMENT) -> DataFrame:
    """read_back of chat_windows, without moving the windows of short conversations again."""
    out = None
    for part, ordered in _parts(conversations, tokenizer, (budget, history, history_turns), long_rows, long_chars, segment):
        found = read_back(part, ordered)
        out = found if out is None else out.unionByName(found)
    return out
