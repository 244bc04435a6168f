"""Repair of conversation structure by fewest edits, with Four-Russians block tables.

A conversation's rows become symbols (role initial and fault). From the end of a conversation backward, the
costs of the four grammar states form a vector; less its least entry it is one of few normalised vectors.
For every normalised vector and every block of BLOCK symbols a table holds the vector before the block and
the cost added, so a conversation is one lookup a block. To trace the edits, each block is expanded
backward from the vector at its right edge and walked forward by the least letter that stays cheapest.

Short conversations are whole groups of a task. Long ones are cut into fragments of FRAGMENT rows: each
fragment maps all normalised vectors at once, the maps are composed, and all fragments are traced apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.common import long_keys, places, runs, small, whole_groups
from quillspark.session import materialize

BLOCK = 4
#: Above so many rows, or characters of text, a conversation is cut into fragments of so many rows.
LONG_ROWS, LONG_CHARS, FRAGMENT = 10_000, 1 << 26, 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
INITIALS = "sua"
#: Symbols: none (padding), must go, then untruncated and truncated rows by role: s, u, a, other.
NONE, GONE, SYMBOLS = 0, 1, 10
# Grammar states: start, after s, after u, after a; where an inserted or reroled row leads, and its role.
STATES, START, AFTER_S, AFTER_U, AFTER_A = 4, 0, 1, 2, 3
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
ROLES = ("user", "user", "assistant", "user")
KEPT = ((AFTER_S, AFTER_U, None, None), (None, AFTER_U, None, None), (None, None, AFTER_A, None),
        (None, AFTER_U, None, None))
END = (0, 2 * INSERT, INSERT, 0)
#: Columns of a result besides conv_id.
RESULT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


def _row_edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """Edits that use up a row, letters in order: letter, cost, next state."""
    edits = [("D", DELETE, state)]
    if symbol != GONE:
        role, extra = (symbol - 2) % 4, TRUNCATED if symbol >= 6 else 0
        if KEPT[state][role] is not None:
            edits.append(("K", KEEP + extra, KEPT[state][role]))
        edits.append(("R", REROLE + extra, NEXT[state]))
    return edits


def _before(symbol: int, vector: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a row, from the costs after it."""
    if symbol == NONE:
        return vector
    costs = [min(cost + vector[to] for _, cost, to in _row_edits(symbol, q)) for q in range(STATES)]
    for _ in range(STATES):
        costs = [min(costs[q], INSERT + costs[NEXT[q]]) for q in range(STATES)]
    return tuple(costs)


@dataclass
class Tables:
    vectors: list[tuple[int, ...]]  # normalised; the first one is that of the end
    single: np.ndarray  # symbol, vector -> vector
    block: np.ndarray   # block of symbols, vector -> vector
    added: np.ndarray   # block of symbols, vector -> cost
    steps: dict         # (symbol, vector after, state) -> letters, roles of kept rows, state

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """Block numbers of a run of symbols, padded at its end."""
        padded = np.zeros(-(-len(symbols) // BLOCK) * BLOCK, np.int64)
        padded[:len(symbols)] = symbols
        return padded.reshape(-1, BLOCK) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))

    def trace(self, symbols: np.ndarray, rights: list[int], state: int) -> tuple[str, list, int]:
        """The least cheapest letters, what each becomes (a new role, None for a row as it is, '' for a
        deleted one), and the state after. rights: the vector at each block's right edge."""
        letters, outputs = [], []
        for b, right in enumerate(rights):
            inside = symbols[b * BLOCK:(b + 1) * BLOCK].tolist()
            after = [right]
            for symbol in reversed(inside[1:]):
                after.append(self.single[symbol, after[-1]])
            for symbol, vector in zip(inside, reversed(after)):
                text, roles, state = self.steps[symbol, int(vector), state]
                letters.append(text)
                outputs.extend(roles)
        return "".join(letters), outputs, state


@lru_cache(1)
def tables() -> Tables:
    """All tables, built by rule: the normalised vectors reachable from the end, then blocks by composition."""
    vectors, known, moves = [END], {END: 0}, {}
    for at, vector in enumerate(vectors):  # grows while it runs
        for symbol in range(SYMBOLS):
            costs = _before(symbol, vector)
            least = min(costs)
            normal = tuple(c - least for c in costs)
            if normal not in known:
                known[normal] = len(vectors)
                vectors.append(normal)
            moves[symbol, at] = known[normal], least
    single = np.array([[moves[s, v][0] for v in range(len(vectors))] for s in range(SYMBOLS)], np.int16)
    cost = np.array([[moves[s, v][1] for v in range(len(vectors))] for s in range(SYMBOLS)], np.int32)
    block, added = single, cost
    for _ in range(BLOCK - 1):  # a further symbol in front: its move starts where the rest leads
        block, added = (single[:, block].reshape(-1, len(vectors)),
                        (added + cost[:, block]).reshape(-1, len(vectors)))
    steps = {}
    for symbol in range(1, SYMBOLS):
        for v, after in enumerate(vectors):
            costs = _before(symbol, after)
            for start in range(STATES):
                letters, roles, state = "", [], start
                while True:
                    best = [("I", INSERT, NEXT[state])] if INSERT + costs[NEXT[state]] == costs[state] else []
                    best += [e for e in _row_edits(symbol, state) if e[1] + after[e[2]] == costs[state]]
                    letter, _, to = min(best)
                    letters += letter
                    roles.append({"D": "", "K": None}.get(letter, ROLES[state]))
                    state = to
                    if letter != "I":
                        break
                steps[symbol, v, start] = letters, roles, state
    return Tables(vectors, single, block, added, steps)


def closing(state: int) -> list[str]:
    """Roles inserted after the last row."""
    roles = []
    while state in (AFTER_S, AFTER_U):
        roles.append(ROLES[state])
        state = NEXT[state]
    return roles


def repair(symbols: np.ndarray) -> tuple[int, str, list]:
    """Cost, audit and outputs (see Tables.trace) of one whole conversation."""
    t = tables()
    rights, vector, cost = [], 0, 0
    for code in reversed(t.codes(symbols).tolist()):
        rights.append(vector)
        cost += int(t.added[code, vector])
        vector = int(t.block[code, vector])
    audit, outputs, state = t.trace(symbols, rights[::-1], START)
    last = closing(state)
    return cost + t.vectors[vector][START], audit + "I" * len(last), outputs + last


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations(conv_id, turn, role, text) after the damage that crc32(`conv_id:turn`) % 20 deals:
    0 drops the row (kept here as present = false), 1 empties its text, 2 removes its [.!?], 3 repeats it, 4
    sets role user. A null is one space, but turn stays null."""
    key = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")),
                              F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", (key != 0).alias("present"), F.when(key == 4, "user").otherwise(role).alias("role"),
        F.when(key.isin(0, 1), "").when(key == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.sequence(F.lit(1), F.when(key == 3, 2).otherwise(1)).alias("copies"))
    return rows.withColumn("copy", F.explode("copies")).drop("copy", "copies")


def with_symbols(rows: DataFrame) -> DataFrame:
    """Adds symbol (blank rows must go, duplicates are not known here) and the role's initial."""
    body, role = F.rtrim("text", F.lit(SPACE)), F.substring("role", 1, 1)
    kind = sum((F.when(role == c, i).otherwise(0) for i, c in enumerate(INITIALS)), F.when(role.isin(*INITIALS), 0).otherwise(3))
    cut = F.when(F.right(body, F.lit(1)).isin(".", "!", "?"), 0).otherwise(4)
    return rows.withColumn("initial", role).withColumn(
        "symbol", F.when(body == "", GONE).otherwise(2 + kind + cut).cast("int"))


def repaired(conversations: DataFrame, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS,
             fragment: int = FRAGMENT) -> DataFrame:
    """A row for each conv_id of conversations(conv_id, turn, role, text), null included, from its rows of any
    number, order and layout: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows count as given (damage is a step of its own) and are taken by turn (nulls first), then role and
    text. present = false marks a row that is there only to name its conversation. Null role or text: one space.
    Repeated rows are duplicates, other columns are ignored, an empty table gives no row. As the audit is
    one string, a conversation has less than 2^31 rows; its digest is one pass over its rows in order."""
    present = F.col("present") if "present" in conversations.columns else F.lit(True)
    rows = with_symbols(conversations.select(
        "conv_id", "turn", present.alias("present"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text")))
    marked = long_keys(conversations, "conv_id", F.length("text"), long_rows, long_chars)
    if marked.isEmpty():
        return _short(rows)
    keys = small(marked)
    same = rows["conv_id"].eqNullSafe(keys["_long"])
    return _short(rows.join(keys, same, "left_anti")).unionByName(
        _long(rows.join(keys, same, "left_semi"), marked, fragment))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _result(conv_type: str) -> str:
    return f"conv_id {conv_type}, {RESULT}"


def _short(rows: DataFrame) -> DataFrame:
    """Whole conversations in the order of their rows; a task holds one conversation and one batch."""
    schema = _result(rows.schema["conv_id"].dataType.simpleString())

    def one(turns, roles, texts, initials, symbols) -> tuple:
        seen, blank, duplicate = set(), 0, 0
        for i, row in enumerate(zip(roles, texts)):
            if symbols[i] == GONE:
                blank += 1
            elif row in seen:
                symbols[i], duplicate = GONE, duplicate + 1
            seen.add(row)
        cost, audit, outputs = repair(np.array(symbols, np.int64))
        digest = hashlib.sha256("\n".join(written(audit, outputs, roles, texts)).encode()).hexdigest()
        known = [t for t in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        return gaps, blank, duplicate, sum(s >= 6 for s in symbols), illegal, cost, audit, digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, "conv_id"):
            ids = group["conv_id"]
            spans = runs(ids)
            there = group["present"].to_pylist()
            columns = [group[c].to_pylist() for c in ("turn", "role", "text", "initial", "symbol")]
            out = []
            for lo, hi in spans:
                keep = [i for i in range(lo, hi) if there[i]]
                out.append(one(*([c[i] for i in keep] for c in columns)))
            first = ids.combine_chunks().take(pa.array([lo for lo, _ in spans], pa.int64()))
            data = [pa.array(x, pa.int64()) for x in list(zip(*out))[:6]] + [pa.array(x, pa.string()) for x in list(zip(*out))[6:]]
            yield pa.RecordBatch.from_arrays([first, *data], names=names)

    names = ["conv_id", *[part.split()[0] for part in RESULT.split(", ")]]
    sorted_rows = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *_order())
    return sorted_rows.mapInArrow(run, schema)


def written(audit: str, outputs: list, roles: list[str], texts: list[str]) -> Iterator[str]:
    """`role:text` of the repaired rows."""
    at = 0
    for letter, output in zip(audit, outputs):
        if letter == "I":
            yield f"{output}:"
            continue
        if letter != "D":
            yield f"{roles[at] if letter == 'K' else output}:{texts[at]}"
        at += 1


def _null_safe(left: DataFrame, right: DataFrame, *columns: str) -> Column:
    same = left[columns[0]].eqNullSafe(right[columns[0]])
    for c in columns[1:]:
        same = same & left[c].eqNullSafe(right[c])
    return same


def _long(rows: DataFrame, keys: DataFrame, fragment: int) -> DataFrame:
    """Conversations of any number of rows: no task holds more than a fragment, but for what a result row
    itself holds and, for its order, one short summary a fragment."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    placed = places(rows.where("present").drop("present").withColumn("digest", F.sha2("text", 256)),
                    "conv_id", _order(), "place")
    # A row is the first of its kind if no earlier one has its role and text; copies meet in partial aggregates.
    first = placed.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select(
        "conv_id", "place", F.lit(True).alias("first"))
    light = placed.select("conv_id", "place", "symbol", "initial")
    light = light.join(first, _null_safe(light, first, "conv_id", "place"), "left").select(
        light["conv_id"], light["place"], "symbol", "initial", F.coalesce("first", F.lit(False)).alias("first"))
    cut = light.withColumn("fragment", F.floor(F.col("place") / fragment).cast("long"))

    def summary(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        symbols, firsts = table["symbol"].to_numpy().astype(np.int64), table["first"].to_numpy()
        initials = table["initial"].to_pylist()
        blank = int((symbols == GONE).sum())
        copies = (symbols != GONE) & ~firsts
        symbols = np.where(copies, GONE, symbols)
        t = tables()
        vector, cost = np.arange(len(t.vectors)), np.zeros(len(t.vectors), np.int64)
        for code in reversed(t.codes(symbols).tolist()):
            cost += t.added[code, vector]
            vector = t.block[code, vector]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        return pa.table({
            "conv_id": table["conv_id"][:1], "fragment": table["fragment"][:1],
            "symbols": pa.array([symbols.astype(np.uint8).tobytes()], pa.binary()),
            "left": pa.array([initials[0]]), "right": pa.array([initials[-1]]), "blank": pa.array([blank]),
            "duplicate": pa.array([int(copies.sum())]), "truncated": pa.array([int((symbols >= 6).sum())]),
            "illegal": pa.array([illegal]), "vectors": pa.array([vector.tolist()], pa.list_(pa.int64())),
            "costs": pa.array([cost.tolist()], pa.list_(pa.int64()))})

    parts = materialize(cut.groupBy("conv_id", "fragment").applyInArrow(
        summary, f"conv_id {conv}, fragment long, symbols binary, left string, right string, blank long, duplicate long, "
                 "truncated long, illegal long, vectors array<long>, costs array<long>"))

    def compose(table: pa.Table) -> pa.Table:
        """The vector at each fragment's right edge, from the last fragment backward; the cost in the first one's row."""
        table = table.sort_by([("fragment", "descending")])
        vector, total, edges, costs = 0, 0, [], []
        for moves, cost in zip(table["vectors"].to_pylist(), table["costs"].to_pylist()):
            edges.append(vector)
            total += cost[vector]
            vector = moves[vector]
            costs.append(total + tables().vectors[vector][START])
        return pa.table({"conv_id": table["conv_id"], "fragment": table["fragment"], "edge": pa.array(edges, pa.int64()),
                         "cost": pa.array(costs, pa.int64())})

    edges = parts.select("conv_id", "fragment", "vectors", "costs").groupBy("conv_id").applyInArrow(
        compose, f"conv_id {conv}, fragment long, edge long, cost long")
    edges = materialize(edges)
    known = parts.select("conv_id", "fragment", "symbols").join(
        edges.select(F.col("conv_id").alias("_c"), F.col("fragment").alias("_f"), "edge"),
        F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("fragment") == F.col("_f"))).drop("_c", "_f")

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each fragment traced from each of the four states it may begin in."""
        t = tables()
        for batch in batches:
            audits, states = [], []
            for data, edge in zip(batch.column("symbols"), batch.column("edge").to_pylist()):
                symbols = np.frombuffer(data.as_py(), np.uint8).astype(np.int64)
                rights, vector = [], edge
                for code in reversed(t.codes(symbols).tolist()):
                    rights.append(vector)
                    vector = int(t.block[code, vector])
                traced = [t.trace(symbols, rights[::-1], q) for q in range(STATES)]
                audits.append([x[0] for x in traced])
                states.append([x[2] for x in traced])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("fragment"), pa.array(audits, pa.list_(pa.string())),
                 pa.array(states, pa.list_(pa.int64()))], names=["conv_id", "fragment", "audits", "states"])

    traced = materialize(known.mapInArrow(ways, f"conv_id {conv}, fragment long, audits array<string>, states array<long>"))

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("fragment")
        starts, state = [], START
        for after in table["states"].to_pylist():
            starts.append(state)
            state = after[state]
        ends = [None] * (len(starts) - 1) + [state]
        return pa.table({"conv_id": table["conv_id"], "fragment": table["fragment"], "start": pa.array(starts, pa.int64()),
                         "final": pa.array(ends, pa.int64())})

    starts = traced.select("conv_id", "fragment", "states").groupBy("conv_id").applyInArrow(
        chain, f"conv_id {conv}, fragment long, start long, final long")
    chosen = traced.select("conv_id", "fragment", "audits").join(
        starts.withColumnsRenamed({"conv_id": "_c", "fragment": "_f"}),
        F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("fragment") == F.col("_f")))
    closed = F.when(F.col("final") == AFTER_S, "II").when(F.col("final") == AFTER_U, "I").otherwise("")
    chosen = materialize(chosen.select("conv_id", "fragment", "start",
                                       F.concat(F.col("audits")[F.col("start").cast("int")], closed).alias("audit")))

    # The edits of each row: a run of inserts and what becomes of the row; inserts at the very end are a row of their own.
    pieces = F.regexp_extract_all("audit", F.lit("I*[DKR]|I+"), F.lit(0))
    edits = chosen.select("conv_id", "fragment", "start", F.posexplode(pieces).alias("at", "edit"))
    edits = edits.select(F.col("conv_id").alias("_c"), (F.col("fragment") * fragment + F.col("at")).alias("_p"), "edit")
    texts = placed.select("conv_id", "place", "role", "text")
    told = texts.join(edits, texts["conv_id"].eqNullSafe(edits["_c"]) & (texts["place"] == edits["_p"]), "full").select(
        F.coalesce("conv_id", "_c").alias("conv_id"), F.coalesce("place", "_p").alias("place"), "role", "text", "edit")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One running digest at a time, so a conversation's rows pass by in order and are not kept."""
        nothing = object()
        conv_now, state, running, started = nothing, START, None, False
        done: list[tuple] = []
        for batch in batches:
            for c, role, text, edit in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text", "edit"))):
                if c != conv_now:
                    if conv_now is not nothing:
                        done.append((conv_now, running.hexdigest()))
                    conv_now, state, running, started = c, START, hashlib.sha256(), False
                for letter in edit:
                    if letter == "D":
                        continue
                    if letter == "K":
                        line, state = f"{role}:{text}", KEPT[state][INITIALS.index(role[0])]
                    else:
                        line = f"{ROLES[state]}:{text if letter == 'R' else ''}"
                        state = NEXT[state]
                    running.update((("\n" if started else "") + line).encode())
                    started = True
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], type=batch.column("conv_id").type),
                                                  pa.array([d[1] for d in done])], names=["conv_id", "repaired_sha256"])
                done = []
        if conv_now is not nothing:
            yield pa.RecordBatch.from_arrays([pa.array([conv_now], type=batch.column("conv_id").type),
                                              pa.array([running.hexdigest()])], names=["conv_id", "repaired_sha256"])

    digests = (told.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "place")
               .mapInArrow(digest, f"conv_id {conv}, repaired_sha256 string"))

    # All sums run over partial aggregates; the summaries of one conversation are few.
    turns = placed.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    order = F.array_sort(F.collect_list(F.struct("fragment", "left", "right", "blank", "duplicate", "truncated", "illegal")))
    folded = parts.groupBy("conv_id").agg(order.alias("p"))
    crossing = F.aggregate(
        F.sequence(F.lit(1), F.size("p") - 1), F.lit(0).cast("long"),
        lambda a, i: a + F.when(F.concat(F.get("p", i - 1)["right"], F.get("p", i)["left"]).isin("su", "ua", "au"), 0).otherwise(1))
    total = {c: F.aggregate(f"p.{c}", F.lit(0).cast("long"), lambda a, x: a + x) for c in ("blank", "duplicate", "truncated", "illegal")}
    folded = folded.select("conv_id", *[total[c].alias(c) for c in ("blank", "duplicate", "truncated")],
                           (total["illegal"] + F.when(F.size("p") > 1, crossing).otherwise(0)).alias("illegal"))
    audits = chosen.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("fragment", "audit"))).alias("a")).select(
        "conv_id", F.array_join("a.audit", "").alias("audit"))
    costs = edges.where("fragment = 0").select("conv_id", "cost")
    out = keys.select(F.col("_long").alias("conv_id"))
    for part in (turns, folded, costs, audits, digests):
        named = part.withColumnRenamed("conv_id", "_c")
        out = out.join(named, out["conv_id"].eqNullSafe(named["_c"]), "left").drop("_c")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.select("conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
