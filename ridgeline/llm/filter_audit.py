"""What each filter of a chain removes, in every order of the chain, and its Shapley share.

A document's failures are one mask of bits, so a part of the corpus is at most 2 ** k cells of counts for k filters,
however many documents it has. All k! orders are visited by swapping two neighbours at a time: a swap changes what
arrives at its two steps alone, which are counted anew from the cells, and every other step is carried over. The sum of
what a filter removes, taken along the walk, is its Shapley share times k!.

Cases: a null text is an empty one; a null source is the part with the empty name, together with empty names; rows without a doc_id are no
copy of any other and have no labels, repeated rows count each (equal ids are not smaller than each other); a document
is labelled if any of its label rows says so, labels without an id or value say nothing; a text may be of any length; an empty table
has no parts and gives no rows; columns that are not named here are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
#: Parts that are walked side by side in a task.
PARTS = 64
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def conditions(text: Column) -> dict[str, Column]:
    """The failure conditions that a text meets by itself: too short, too repetitive, too many capitals, odd signs."""
    words = F.array_remove(F.split(text, BLANKS), "")
    count = F.size(words)
    return {
        "A": count < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * count.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masked(documents: DataFrame, repeated: str, make) -> tuple[DataFrame, list[str]]:
    """Rows (part, doc_id, mask, n) and the names of the filters in order; bit i of a mask is a failure of filter i.

    `repeated` names the filter that documents fail whose text a smaller doc_id has. Rows alike in text, id and part are counted
    first, and a text's smallest id is met by text and id together, so a text that a third of all rows have is in no
    one place: its rows differ in their ids.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = make(text)
    names = sorted([*own, repeated])
    mask = sum((F.when(own[n], 1 << names.index(n)).otherwise(0) for n in own), F.lit(0))
    rows = documents.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "doc_id", mask.cast("int").alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = rows.groupBy("part", "doc_id", "digest", "mask").agg(F.count("*").alias("n"))
    known = rows.where("doc_id IS NOT NULL")
    first = known.groupBy(F.col("digest").alias("of_digest")).agg(F.min("doc_id").alias("of_id"), F.lit(1).alias("is_first"))
    met = known.join(first, (F.col("doc_id") == F.col("of_id")) & (F.col("digest") == F.col("of_digest")), "left")
    later = F.when(F.col("is_first").isNull(), 1 << names.index(repeated)).otherwise(0)
    known = met.select("part", "doc_id", F.col("mask").bitwiseOR(later).alias("mask"), "n")
    return known.unionByName(rows.where("doc_id IS NULL").select("part", "doc_id", "mask", "n")), names


def cells(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part: its cells (mask, documents, good ones, toxic ones), at most 2 ** k of them.

    Rows without an id do not join the labels.
    """
    says = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("of_id")).agg(says("quality"), says("toxic"))
    known = rows.where("doc_id IS NOT NULL").join(marks, F.col("doc_id") == F.col("of_id"), "left")
    unknown = rows.where("doc_id IS NULL").withColumns({"quality": F.lit(0), "toxic": F.lit(0)})
    both = known.select("part", "mask", "n", "quality", "toxic").unionByName(unknown.select("part", "mask", "n", "quality", "toxic"))
    of = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0)))
    counted = both.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("quality").alias("good"), of("toxic").alias("bad"))
    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("cells"))


def swaps(k: int) -> Iterator[int]:
    """Places i of the k! - 1 swaps of i and i + 1 that lead through all orders: the largest element that can move does."""
    order, heading = list(range(k)), [-1] * k
    while True:
        mover = None
        for at, x in enumerate(order):
            to = at + heading[x]
            if 0 <= to < k and order[to] < x and (mover is None or x > order[mover]):
                mover = at
        if mover is None:
            return
        x = order[mover]
        to = mover + heading[x]
        order[mover], order[to] = order[to], order[mover]
        for larger in range(x + 1, k):
            heading[larger] = -heading[larger]
        yield min(mover, to)


def walk(counts: np.ndarray, k: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All orders, and their figures: an array (parts, orders, steps, len(FIGURES)).

    counts: (parts, 2 ** k, 3), the documents, good ones and toxic ones of each cell.
    """
    masks = np.arange(1 << k)
    fails = np.array([counts[:, masks & (1 << f) != 0, 0].sum(axis=1) for f in range(k)])
    alone = np.array([counts[:, 1 << f, 0] for f in range(k)])
    order, orders, shares = list(range(k)), [], np.zeros((k, len(counts)), np.int64)
    now, seen = np.zeros((len(counts), k, len(FIGURES)), np.int64), []

    def step(at: int) -> None:
        bit, before = 1 << order[at], sum(1 << f for f in order[:at])
        arrives = masks & before == 0
        lost = counts[:, arrives & (masks & bit != 0)].sum(axis=1)
        now[:, at, 0] = counts[:, arrives & (masks & bit == 0), 0].sum(axis=1)
        now[:, at, 1] = lost[:, 0]
        now[:, at, 2] = fails[order[at]] - lost[:, 0]
        now[:, at, 3] = alone[order[at]]
        now[:, at, 4:6] = lost[:, 1:]

    def visit() -> None:
        orders.append(tuple(order))
        seen.append(now.copy())
        for at, f in enumerate(order):
            shares[f] += now[:, at, 1]

    for at in range(k):
        step(at)
    visit()
    for at in swaps(k):
        order[at], order[at + 1] = order[at + 1], order[at]
        step(at)
        step(at + 1)
        visit()
    out = np.stack(seen, axis=1)
    for i, o in enumerate(orders):
        out[:, i, :, 6] = shares[list(o)].T
    return orders, out


def audit(documents: DataFrame, labels: DataFrame, repeated: str = "E", make=conditions) -> DataFrame:
    """One row per part, order of the filters and step, with the columns of AUDIT.

    make(text) gives the failure conditions by one-letter name, to which `repeated` is added.
    """
    rows, names = masked(documents, repeated, make)
    k = len(names)

    def walked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (whole.slice(a, PARTS) for whole in parts for a in range(0, whole.num_rows, PARTS)):
            counts = np.zeros((part.num_rows, 1 << k, 3), np.int64)
            for i, found in enumerate(part.column("cells").to_pylist()):
                for c in found:
                    counts[i, c["mask"]] += (c["n"], c["good"], c["bad"])
            orders, figures = walk(counts, k)
            each = len(orders) * k
            columns = [
                part.column("part").take(pa.array(np.repeat(np.arange(part.num_rows), each))),
                pa.array(["".join(names[f] for f in o) for o in orders for _ in range(k)] * part.num_rows),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders) * part.num_rows)),
            ]
            figures = figures.reshape(-1, len(FIGURES))
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(figures[:, i]) for i in range(len(FIGURES))]], ["part", "filter_order", "step", *FIGURES])

    return cells(rows, labels).mapInArrow(walked, AUDIT)
