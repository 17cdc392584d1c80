"""Cumulative-snapshot collapse of logged conversations, and their rendering as chat markup.

A chat service that logs the whole conversation after every turn leaves many rows that are prefixes of
longer ones. The hash of a conversation's first k turns is the xor of position-tagged turn hashes, so it
rolls along the turns in one window pass. A conversation whose full hash equals a proper prefix hash of
another one is dropped by an anti-join; of equal conversations the smallest conv_id stays.

Cases: a null role or text counts as empty; rows with a null conv_id form one conversation; turns are
ordered by turn (null first), role, text, repeated turn numbers included; equal rows are separate turns;
conversations and texts may be of any length; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import keep, running

CHUNK = 256
SALTS = 16
ROLES = ("system", "user", "assistant", "tool")
#: Turns come in this order; a missing number is below all others.
ORDER = ["turn", "role", "text"]
#: Characters of a text by which turns without a number or a conversation are dealt to chunks.
HEAD = 8


def _placed(turns: DataFrame) -> DataFrame:
    """Adds chunk, and pos: the number of turns of the conversation before this one.

    A chunk holds CHUNK turn numbers of a conversation. Turns without a number, and those of no conversation, may be
    any share of the rows: they are cut further, by what they are ordered by.
    """
    many = F.col("conv_id").isNull() | F.col("turn").isNull()
    head = [F.when(many, c).alias(n) for n, c in (("turn", F.col("turn")), ("role", F.col("role")), ("head", F.substring("text", 1, HEAD)))]
    chunk = F.struct(F.floor(F.col("turn") / CHUNK).alias("chunk"), *head)
    return running(turns.withColumn("chunk", chunk), ["conv_id"], "chunk", ORDER, {"pos": F.lit(1)})


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """Adds pos (1-based), and h1, h2: the 128-bit hash of the conversation's turns up to this one.

    Long conversations are cut into chunks of turn numbers; positions and hashes of a chunk start from
    the totals of the chunks before it, so no task needs a whole conversation.
    """
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = _placed(turns).withColumn("pos", F.col("pos") + 1)
    # The xor of hashes is rolled as 4 running sums of 32-bit parts: sums of a chunk add up like counts.
    parts = {}
    for name, seed in (("a", 11), ("b", 23)):
        whole = F.xxhash64(F.lit(seed), "pos", "role", "text")
        parts[f"{name}0"] = whole.bitwiseAND(F.lit(0xFFFFFFFF))
        parts[f"{name}1"] = F.shiftrightunsigned(whole, 32)
    turns = running(turns, ["conv_id"], "chunk", ORDER, parts)
    own = {k: F.col(k) + v for k, v in parts.items()}
    turns = turns.withColumns(own)
    h1 = F.xxhash64(F.lit(1), "pos", *parts)
    h2 = F.xxhash64(F.lit(2), "pos", *parts)
    return turns.withColumns({"h1": h1, "h2": h2}).drop(*parts)


def collapse(conversations: DataFrame) -> DataFrame:
    """The maximal conversations: rows (conv_id, n_turns, n_copies), n_copies counting equal conversations."""
    rolled = keep(prefix_hashes(conversations).select("conv_id", "pos", "h1", "h2"))
    length = rolled.groupBy("conv_id").agg(
        F.max("pos").alias("n_turns"), F.max_by(F.struct("h1", "h2"), "pos").alias("whole")
    )
    distinct = length.groupBy("n_turns", "whole").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    # The last turn of a conversation is met by conversation and place, of which no conversation is a single key.
    ends = length.select(F.col("conv_id").alias("of"), "n_turns")
    proper = rolled.join(ends, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("pos") == F.col("n_turns")), "left_anti")
    prefixes = proper.select(F.col("pos").alias("p"), F.struct("h1", "h2").alias("prefix")).distinct()
    kept = distinct.join(
        prefixes, (F.col("n_turns") == F.col("p")) & (F.col("whole") == F.col("prefix")), "left_anti"
    )
    return kept.select("conv_id", "n_turns", "n_copies")


def render(conversations: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """Maximal conversations as chat markup: rows (conv_id, part, n_turns, n_copies, rendered).

    Part p holds the turns of positions p * CHUNK + 1 to (p + 1) * CHUNK; concatenating the parts gives the
    conversation, and no conversation is gathered into one row however long it is. Roles other than the
    known four are rendered as user.
    """
    # A conversation's turns meet it under as many keys as there are salts.
    kept = collapse(conversations).select(F.col("conv_id").alias("of"), "n_turns", "n_copies", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    salt = F.pmod(F.xxhash64("turn", "role", F.length("text")), F.lit(SALTS)).cast("int")
    turns = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("of")) & (salt == F.col("salt"))).drop("salt")
    turns = _placed(turns)
    role = F.lower(F.trim("role"))
    role = F.when(role.isin(*ROLES), role).otherwise(F.lit("user"))
    line = F.concat(F.lit(start), role, F.lit("\n"), "text", F.lit(end + "\n"))
    turns = turns.select("conv_id", "pos", "n_turns", "n_copies", line.alias("line"), F.floor(F.col("pos") / CHUNK).alias("part"))
    sorted_lines = F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return turns.groupBy("conv_id", "part", "n_turns", "n_copies").agg(F.array_join(sorted_lines, "").alias("rendered"))
