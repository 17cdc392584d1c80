"""The cheapest repair of damaged conversations into turns of an optional system, then user and assistant by turns.

A conversation's rows are put in order and judged (blank, repeated, cut short). The least cost of repairing the rest of it from a
grammar state is worked out from its end backwards; a walk from its start then takes, among the edits that keep to that cost, the
ASCII-least, and rebuilds the turns.

No conversation is gathered: rows are range-sorted by conversation, turn, role and text, and each task cuts what it has into pieces
of bounded rows and bytes. The least cost from each state at a piece's start to each state at its end is a 4 x 4 table; the
tables of a conversation's pieces are folded from its end (a few numbers a piece, streamed in order), which gives each piece the costs
behind it. With these a piece walks from each of the four states; the states that pieces are entered in follow by one more
pass over the pieces. A conversation that begins and ends within a task's rows, as nearly all do, is repaired there at once. Equal rows of a turn are counted before sorting, so that one row repeated any number of times is one row. A row is a
repetition unless its turn is the first of its conversation, role and text; that is a join by all four, of
which a conversation of any size is no single key. Only the digest of a repaired conversation has to read its pieces one after the other, which
it does one piece at a time.

Cases: rows without a conv_id are one conversation, whose id stays null; rows without a turn come first; a null id, turn, role or text reads as one
space, where it is written; rows of one turn are in order of role and text; role initials are first characters, none for an empty
role; an empty table gives no rows; a text may be of any length; columns that are not named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import keep, partitions

BLANK = r"[^\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
#: Rows and characters after which a piece ends.
PIECE_ROWS, PIECE_CHARS = 1024, 1 << 20
#: Grammar states: start, after the system turn, after a user's turn, after an assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = ("su", "ua", "au")
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
FAR = 1 << 60
#: The costs of ending in each state: an assistant's turn or nothing may end; what is missing is inserted.
AT_END = (0, 2 * INSERT, INSERT, 0)
#: The state after the turn that a state calls for, and that turn's role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations as a stated fifth of the damages leaves them: rows (conv_id, turn, role, text, copies)."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.where("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def judged(rows: DataFrame) -> DataFrame:
    """One row per different (conv_id, turn, role, text): copies, and whether its first copy is the first of its role and text.

    Columns: has_turn (false sorts first), t (0 where there is none).
    """
    rows = rows.groupBy("conv_id", F.col("turn").isNotNull().alias("has_turn"), F.coalesce("turn", F.lit(0)).alias("t"), "role", "text").agg(F.sum("copies").cast("long").alias("copies"))
    rows = rows.withColumn("digest", F.struct(F.xxhash64("role", "text").alias("d1"), F.xxhash64(F.lit(7), "text", "role").alias("d2")))
    rows = keep(rows)
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(F.struct("has_turn", "t")).alias("first"))
    first = first.select("c", "d", F.col("first.has_turn").alias("h"), F.col("first.t").alias("f"), F.lit(True).alias("is_first"))
    pairs = (("conv_id", "c"), ("digest", "d"), ("has_turn", "h"), ("t", "f"))
    met = rows.join(first, reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs]), "left")
    return met.select("conv_id", "has_turn", "t", "role", "text", "copies", F.coalesce("is_first", F.lit(False)).alias("is_first"))


def back(role: str, cut: bool, after: tuple[int, ...]) -> tuple[int, ...]:
    """The least costs from each state before a row that may stay, given those after it; inserts before the row included."""
    extra = TRUNCATED if cut else 0
    own = [min(DELETE + after[s], REROLE + extra + after[NEXT[s]]) for s in range(4)]
    if role == "s":
        own[START] = min(own[START], extra + after[SYSTEM])
    elif role == "u":
        for s in (START, SYSTEM, ASSISTANT):
            own[s] = min(own[s], extra + after[USER])
    elif role == "a":
        own[USER] = min(own[USER], extra + after[ASSISTANT])
    user = min(own[USER], INSERT + own[ASSISTANT])
    return (min(own[START], INSERT + user), min(own[SYSTEM], INSERT + user), user, min(own[ASSISTANT], INSERT + own[USER]))


def goes(role: str, state: int) -> int | None:
    """The state after a turn that is kept, or None where the grammar has no place for it."""
    if role == "s":
        return SYSTEM if state == START else None
    if role == "u":
        return None if state == USER else USER
    return ASSISTANT if role == "a" and state == USER else None


class Piece:
    """Rows of a conversation that follow each other: (role, text, initial, fault of the first copy, copies)."""

    def __init__(self, rows: list[tuple[str, str, str, str, int]]) -> None:
        self.rows = rows
        #: What deletions that have to be made cost.
        self.fixed = DELETE * sum(n if fault in "bd" else n - 1 for *_, fault, n in rows)

    def costs(self, end: tuple[int, ...]) -> list[tuple[int, ...]]:
        """The least costs before each row and, last, after all, without the fixed ones."""
        out = [end]
        for _, _, initial, fault, _ in reversed(self.rows):
            out.append(out[-1] if fault in "bd" else back(initial, fault == "t", out[-1]))
        return out[::-1]

    def table(self) -> list[list[int]]:
        """table[s][e]: the least cost from state s to state e."""
        columns = []
        for e in range(4):
            # Turns inserted after the last row belong to the next piece, or to the end.
            columns.append(self.costs(tuple(0 if s == e else FAR for s in range(4)))[0])
        return [[min(FAR, columns[e][s]) + (self.fixed if columns[e][s] < FAR else 0) for e in range(4)] for s in range(4)]

    def walk(self, state: int, end: tuple[int, ...], last: bool) -> tuple[str, int, list[tuple[int, str]]]:
        """From a state: the edits, the state at the end, and the turns as (row or -1, role)."""
        costs, audit, turns, i = self.costs(end), [], [], 0
        while True:
            now = costs[i][state]
            if i < len(self.rows):
                role, _, initial, fault, n = self.rows[i]
                if fault in "bd":
                    audit.append("D" * n)
                    i += 1
                    continue
                after, extra = costs[i + 1], TRUNCATED if fault == "t" else 0
                to = goes(initial, state)
                if now == DELETE + after[state]:
                    audit.append("D" * n)
                elif now == INSERT + costs[i][NEXT[state]]:
                    audit.append("I")
                    turns.append((-1, ROLE[state]))
                    state = NEXT[state]
                    continue
                elif to is not None and now == extra + after[to]:
                    audit.append("K" + "D" * (n - 1))
                    turns.append((i, role))
                    state = to
                else:
                    audit.append("R" + "D" * (n - 1))
                    turns.append((i, ROLE[state]))
                    state = NEXT[state]
                i += 1
                continue
            if not last or now == 0:
                return "".join(audit), state, turns
            audit.append("I")
            turns.append((-1, ROLE[state]))
            state = NEXT[state]


    def told(self, way: list[tuple[int, str]]) -> str | None:
        """The turns of a walk as lines; None if there are none."""
        return "\n".join(f"{role}:{self.rows[i][1] if i >= 0 else ''}" for i, role in way) if way else None


def _fault(row: dict) -> str:
    """b, d, t, or nothing amiss: k."""
    text = row["text"].rstrip(SPACES)
    if not text:
        return "b"
    return "d" if not row["is_first"] else "k" if text[-1] in ".!?" else "t"


ROW = "array<struct<role:string,text:string,initial:string,fault:string,copies:long>>"
DONE = "gaps long, cost long, audit string, repaired_sha256 string"
PIECE = (
    f"{DONE}, conv_id long, part int, number long, rows {ROW}, costs array<array<long>>, n long, blank long, duplicate long, truncated long, illegal long, "
    "first_role string, last_role string, first_turn long, last_turn long, turns long"
)


def pieces(rows: DataFrame, most: int = PIECE_ROWS) -> DataFrame:
    """The judged rows as pieces in order (part, number) of their conversation, with their tables and figures."""
    order = [F.col("conv_id").asc_nulls_first(), "has_turn", "t", "role", "text"]
    ordered = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = to_arrow_schema(StructType.fromDDL(PIECE))

    def made(key: tuple, held: list[dict], number: int, alone: bool) -> dict:
        piece = Piece([(r["role"], r["text"], r["role"][:1], _fault(r), r["copies"]) for r in held])
        turns = [r["t"] for r in held if r["has_turn"]]
        initials = [c[2] for c in piece.rows]
        figures = {
            "conv_id": key[0], "blank": sum(n for *_, f, n in piece.rows if f == "b"), "duplicate": sum(n if f == "d" else n - 1 for *_, f, n in piece.rows if f != "b"),
            "truncated": sum(f == "t" for *_, f, _ in piece.rows), "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])) + sum(c[4] - 1 for c in piece.rows),
        }
        if alone:
            audit, _, way = piece.walk(START, AT_END, True)
            gaps = turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0
            cost = piece.costs(AT_END)[0][START] + piece.fixed
            return figures | {"gaps": gaps, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256((piece.told(way) or "").encode()).hexdigest()}
        return figures | {
            "part": key[1], "number": number, "rows": [dict(zip(("role", "text", "initial", "fault", "copies"), c)) for c in piece.rows], "costs": piece.table(), "n": sum(c[4] for c in piece.rows),
            "first_role": initials[0], "last_role": initials[-1], "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns)),
        }

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, number, first, out, weight = None, [], 0, 0, True, [], 0
        for part in (whole.slice(a, 256) for whole in parts for a in range(0, whole.num_rows, 256)):
            for r in part.to_pylist():
                ends = held and (r["conv_id"], r["part"]) != key
                if ends or (held and (size >= PIECE_CHARS or len(held) >= most)):
                    # What begins and ends within a task's rows is all there is of its conversation.
                    out.append(made(key, held, number, ends and number == 0 and not first))
                    weight += size
                    number, held, size, first = 0 if ends else number + 1, [], 0, first and not ends
                key = (r["conv_id"], r["part"])
                held.append(r)
                size += len(r["text"])
            if weight > PIECE_CHARS or len(out) > 4096:
                yield pa.RecordBatch.from_pylist(out, schema=types)
                out, weight = [], 0
        if held:
            out.append(made(key, held, number, False))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=types)

    return ordered.mapInArrow(cut, PIECE)


def _folded(found: DataFrame, order: list, fold, schema: str) -> DataFrame:
    """Rows of each conversation passed in order through fold(state, row) -> (state, row out); a state starts as None."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, started = None, None, False
        for part in (whole.slice(a, 64) for whole in parts for a in range(0, whole.num_rows, 64)):
            out = []
            for r in part.to_pylist():
                if not started or r["conv_id"] != key:
                    key, state, started = r["conv_id"], None, True
                state, row = fold(state, r)
                if row is not None:
                    out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=types)

    return found.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), *order).mapInArrow(run, schema)


def _ends(state, r: dict):
    """Backwards: the costs behind a piece, and those before it for the next one."""
    behind = AT_END if state is None else state
    before = tuple(min(r["costs"][s][e] + behind[e] for e in range(4)) for s in range(4))
    row = {"conv_id": r["conv_id"], "part": r["part"], "number": r["number"], "behind": list(behind), "last": state is None, "least": list(before)}
    return before, row


def _entries(state, r: dict):
    """Forwards: the state that a piece is entered in, and the one that it is left in."""
    entry = START if state is None else state
    return r["leaves"][entry], {"conv_id": r["conv_id"], "part": r["part"], "number": r["number"], "entry": entry}


def repair(conversations: DataFrame, most: int = PIECE_ROWS, damage=damaged) -> DataFrame:
    """One row per conversation, with the columns of RESULT and cost, audit and digest of the cheapest repair.

    damage(conversations) gives the rows (conv_id, turn, role, text, copies) that are repaired; texts and roles are not null.
    """
    found = keep(pieces(judged(damage(conversations)), most))
    done, cut = found.where("audit IS NOT NULL"), found.where("audit IS NULL")
    place = ["part", "number"]
    reverse = [F.col(p).desc() for p in place]
    ends = _folded(cut.select("conv_id", *place, "costs"), reverse, _ends, "conv_id long, part int, number long, behind array<long>, last boolean, least array<long>")
    ends = keep(ends)
    met = lambda a, b: a.join(b.withColumnRenamed("conv_id", "of"), [*place]).where(F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")

    def walks(part: pa.RecordBatch, states) -> Iterator[list[tuple[str, int, list[tuple[int, str]], Piece]]]:
        for r in part.select(["rows", "behind", "last", *(["entry"] if states is None else [])]).to_pylist():
            piece = Piece([tuple(x[c] for c in ("role", "text", "initial", "fault", "copies")) for x in r["rows"]])
            yield [(*piece.walk(s, tuple(r["behind"]), r["last"]), piece) for s in (states or [r["entry"]])]

    def left(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (whole.slice(a, 64) for whole in parts for a in range(0, whole.num_rows, 64)):
            leaves = [[w[1] for w in ways] for ways in walks(part, range(4))]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("conv_id", *place)], pa.array(leaves, pa.list_(pa.int32()))], ["conv_id", *place, "leaves"])

    def told(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (whole.slice(a, 64) for whole in parts for a in range(0, whole.num_rows, 64)):
            audits, lines = [], []
            for ((audit, _, turns, piece),) in walks(part, None):
                audits.append(audit)
                lines.append(piece.told(turns))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("conv_id", *place)], pa.array(audits, pa.string()), pa.array(lines, pa.string())], ["conv_id", *place, "audit", "lines"])

    ways = met(cut.select("conv_id", *place, "rows"), ends.select("conv_id", *place, "behind", "last"))
    leaves = ways.mapInArrow(left, "conv_id long, part int, number long, leaves array<int>")
    entries = _folded(leaves, [F.col(p) for p in place], _entries, "conv_id long, part int, number long, entry int")
    chosen = met(ways, entries).mapInArrow(told, "conv_id long, part int, number long, audit string, lines string")
    return conversations.select(F.col("conv_id").cast("long")).distinct().transform(_assembled, done, cut, ends, chosen)


def _assembled(known: DataFrame, done: DataFrame, cut: DataFrame, ends: DataFrame, chosen: DataFrame) -> DataFrame:
    """The figures of every known conversation: of those that are done, and of the pieces of the others with the digest of their turns."""

    def digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed():
            names = ["of", "audit", "repaired_sha256"]
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], names)

        key, started, audit, sha, any_turn = None, False, [], hashlib.sha256(), False
        for part in (whole.slice(a, 16) for whole in parts for a in range(0, whole.num_rows, 16)):
            for r in part.to_pylist():
                if started and r["conv_id"] != key:
                    yield closed()
                    audit, sha, any_turn = [], hashlib.sha256(), False
                key, started = r["conv_id"], True
                audit.append(r["audit"])
                if r["lines"] is not None:
                    sha.update((("\n" if any_turn else "") + r["lines"]).encode())
                    any_turn = True
        if started:
            yield closed()

    digests = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number").mapInArrow(digest, "of long, audit string, repaired_sha256 string")

    def summed(state, r: dict):
        """Running sums along a conversation's pieces; a piece's first neighbours are the last of the piece before."""
        old = state or {"gap_min": None, "gap_max": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "role": None}
        new = dict(old)
        for c in ("blank", "duplicate", "truncated", "illegal"):
            new[c] += r[c]
        if old["role"] is not None and old["role"] + r["first_role"] not in LEGAL:
            new["illegal"] += 1
        new["role"] = r["last_role"]
        if r["turns"]:
            new["turns"] += r["turns"] - (old["gap_max"] == r["first_turn"])
            new["gap_min"] = r["first_turn"] if old["gap_min"] is None else old["gap_min"]
            new["gap_max"] = r["last_turn"]
        gaps = 0 if new["gap_min"] is None else new["gap_max"] - new["gap_min"] + 1 - new["turns"]
        return new, {"conv_id": r["conv_id"], "part": r["part"], "number": r["number"], "gaps": gaps, **{c: new[c] for c in ("blank", "duplicate", "truncated", "illegal")}}

    place = [F.col("part"), F.col("number")]
    sums = _folded(cut.drop("rows", "costs", "gaps", "cost", "audit", "repaired_sha256"), place, summed, "conv_id long, part int, number long, gaps long, blank long, duplicate long, truncated long, illegal long")
    last = F.struct("part", "number")
    figures = ["gaps", "blank", "duplicate", "truncated", "illegal"]
    sums = sums.groupBy(F.col("conv_id").alias("of")).agg(F.max_by(F.struct(*figures), last).alias("s")).select("of", "s.*")
    costs = ends.groupBy(F.col("conv_id").alias("of")).agg(F.min_by(F.get("least", F.lit(START)), last).alias("cost"))

    def met(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
        right = right.withColumnRenamed("of", "__of")
        return left.join(right, F.col(key).eqNullSafe(F.col("__of")), how).drop("__of")

    columns = ["of", *figures, "cost", "audit", "repaired_sha256"]
    pieced = met(met(sums, costs, "of", "inner"), digests, "of", "inner").select(columns)
    out = met(known, pieced.unionByName(done.withColumnRenamed("conv_id", "of").select(columns)), "conv_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    nothing = hashlib.sha256().hexdigest()
    return out.select("conv_id", *[zero(c) for c in (*figures, "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
