"""Line dedup by a deletion-neighbourhood join.

Lines are compared without surrounding blanks, across all documents. A line that is not blank goes if an earlier
line, by (doc_id, position), is equal to it or within one edit (an inserted, deleted or replaced character), whatever
its length. A caller who wants short lines compared for equality alone gives min_chars: edits then join only lines of
at least so many characters. Lines are judged on the input, not on what is left.

Equal lines are one class with its earliest place. Two classes are within one edit exactly if they share a
variant that deletes the same place of both, or one is a variant of the other; so the earliest member of
each (variant, place) and of each variant is all that has to be joined back, and no group of similar lines
is expanded into pairs. Variants are emitted only for classes that share a half of their characters with
another class of about their length, which any two lines within one edit do. What the hashed keys join is
verified on the lines: without the deleted characters they have to be equal, which takes time linear in them.

Cases: null texts and rows with a null doc_id are passed through and take no part; blank lines (white space alone)
always stay; very long texts and lines are whole; rows that repeat a doc_id count as one document; empty tables give empty results; other columns are
kept and added columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import keep
from ridgeline.llm.hashing import BASES, mixed, powers, slices

#: Bytes of rows (places and hashes of lines, 64 each) up to which they are broadcast.
BROADCAST_BYTES = 8_000_000
HOT_LINES = 4096


def _lines(documents: DataFrame) -> DataFrame:
    split = documents.where("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return split.withColumn("line", F.trim("line")).where(F.col("line").rlike(r"\S"))


def _half_keys() -> list:
    """For each length that the shorter of two lines may have: hashes of the halves that they may share."""
    keys = []
    for less in (0, 1):
        shorter = F.col("size") - less
        half = F.floor((shorter - 1) / 2).cast("int")
        keys.append(F.xxhash64(shorter, F.lit("head"), F.substr("line", F.lit(1), half)))
        keys.append(F.xxhash64(shorter, F.lit("tail"), F.substr("line", F.col("size") - half + 1, half)))
    return keys


def _variants(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (who, v, place) for each line: the hash of the line without its character at each place from 1, and of the line at 0.

    A hash is a polynomial over the characters, so that of each deletion is made of two running sums.
    """
    back = np.uint64(pow(BASES[0], -1, 2**64))
    for part in (piece for whole in parts for piece in slices(whole, "line", 1 << 18)):
        lines = part.column("line").to_pylist()
        size = np.array([len(x) for x in lines], np.int64)
        end = np.cumsum(size)
        of = np.repeat(np.arange(len(lines)), size)
        place = np.arange(int(size.sum())) - np.repeat(end - size, size)
        chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(chars * powers(BASES[0], int(size.max(initial=0)) + 1)[place], out=sums[1:])
        first, last = sums[end - size], sums[end]
        cut = mixed(sums[:-1] - first[of] + (last[of] - sums[1:]) * back)
        who = part.column("who").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([who[of], who])), pa.array(np.concatenate([cut, mixed(last - first)]).view(np.int64)),
                pa.array(np.concatenate([place + 1, np.zeros(len(lines), np.int64)]).astype(np.int32)),
            ],
            ["who", "v", "place"],
        )


def _without(line: str, place: Column) -> Column:
    """The line without its character at the place from 1, all of it at 0."""
    rest = F.concat(F.substr(line, F.lit(1), place - 1), F.substr(line, place + 1))
    return F.when(place == 0, F.col(line)).otherwise(rest)


def _near_classes(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes (h1, h2) that have an earlier class within one edit."""
    keyed = classes.select("h1", "h2", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    likely = keyed.join(shared, "key").select("h1", "h2").distinct()
    likely = keep(likely.join(classes.select("h1", "h2", "first"), ["h1", "h2"]).select("h1", "h2", "first", "first.*"))
    few = 64 * likely.count() <= BROADCAST_BYTES
    lines = _lines(documents)
    side = F.broadcast(likely) if few else likely
    texts = lines.join(side, ["doc_id", "pos"]).where("xxhash64(line) = h1 AND xxhash64(1, line) = h2")
    texts = texts.select("h1", "h2", "first", "line").dropDuplicates(["h1", "h2"])
    # Numbers that rise with the earliest place of a class.
    texts = keep(texts.orderBy("first", "h1").withColumn("who", F.monotonically_increasing_id()))
    entries = texts.select("who", "line").mapInArrow(_variants, "who long, v long, place int")
    shared = entries.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v")
    entries = keep(entries.join(shared, "v"))  # variants that one class alone has are done with
    by_place = entries.groupBy("v", "place").agg(F.min("who").alias("best"))
    # A variant has at most one row for each place of its line.
    by_variant = by_place.groupBy("v").agg(F.collect_list(F.struct("place", "best")).alias("bests"))
    fit = F.filter("bests", lambda b: (b["best"] < F.col("who")) & ((b["place"] == F.col("place")) | (b["place"] == 0) | (F.col("place") == 0)))
    found = entries.join(by_variant, "v").select("who", "place", F.explode(fit).alias("b"))
    # A run of one character makes a pair meet at each of its places, any of which proves the edit.
    found = found.groupBy("who", F.col("b.best").alias("best")).agg(F.min(F.struct("place", F.col("b.place").alias("place_b"))).alias("at"))
    own = texts.select(F.col("who").alias("who_a"), "h1", "h2", F.col("line").alias("line_a"))
    other = texts.select(F.col("who").alias("who_b"), F.col("line").alias("line_b"))
    checked = found.join(own, F.col("who") == F.col("who_a")).join(other, F.col("best") == F.col("who_b"))
    checked = checked.where(_without("line_a", F.col("at.place")) == _without("line_b", F.col("at.place_b")))
    return keep(checked.select("h1", "h2").distinct())


def removed_lines(documents: DataFrame, min_chars: int = 1) -> DataFrame:
    """One row (doc_id, gone) per document that loses lines: gone lists their positions from 0."""
    slim = _lines(documents).withColumn("size", F.length("line"))
    keys = F.when(F.col("size") >= min_chars, F.array(*_half_keys())).alias("keys")
    slim = keep(slim.select("doc_id", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), keys))
    classes = slim.groupBy("h1", "h2").agg(
        F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys")
    )
    classes = keep(classes)
    near = _near_classes(documents, classes).withColumn("near", F.lit(True))
    judged = classes.select("h1", "h2", "first", "n").join(near, ["h1", "h2"], "left").where("n > 1 OR near")
    # A line with so many places that one task would have them all meets its class by a broadcast; there are at most HOT_LINES of those.
    judged = keep(judged)
    most = slim.count() // HOT_LINES
    hot = F.broadcast(judged.where(F.col("n") > most))
    rows = slim.select("doc_id", "pos", "h1", "h2")
    gone = rows.join(hot, ["h1", "h2"]).unionByName(rows.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(judged.where(F.col("n") <= most), ["h1", "h2"]))
    gone = gone.where("near OR doc_id <> first.doc_id OR pos <> first.pos")
    return gone.groupBy("doc_id").agg(F.collect_set("pos").alias("gone"))


def dedup(documents: DataFrame, min_chars: int = 1) -> DataFrame:
    """documents with text without its removed lines, and n_lines, n_removed."""
    gone = keep(removed_lines(documents, min_chars)).select(F.col("doc_id").alias("__doc_id"), F.col("gone").alias("__gone"))
    joined = documents.drop("n_lines", "n_removed").join(gone, F.col("doc_id") == F.col("__doc_id"), "left")
    lines, gone = F.split("text", "\n"), F.col("__gone")
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    left = F.transform(F.array_except(places, gone), lambda i: F.element_at(lines, i + 1))
    out = joined.withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)),
            "n_removed": F.when(gone.isNull(), 0).otherwise(F.size(gone)),
            "text": F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(left, "\n")),
        }
    )
    return out.drop("__gone", "__doc_id")
