"""Packing of tokenised documents into fixed-length sequences by cutting-stock column generation.

A document of n tokens gives floor(n / capacity) full pieces, which are sequences of their own, and one
shorter piece. The histogram of the shorter pieces' lengths (fewer than capacity numbers, whatever the
corpus) goes to a linear program: cover every length's count with as few sequences as possible, each
filled by a pattern of lengths. More than CLASSES lengths are first put into that many classes of
neighbouring lengths, chosen so that rounding up to the longest of a class adds the fewest tokens in all. Patterns are generated as needed: a knapsack dynamic program prices the
pattern that the duals value most, until none can improve the program by more than a given share. The
rounded-down pattern counts are completed by best fit over the few pieces that rounding leaves. Documents
are ranked within their length, and a rank finds its pattern, sequence and offset in the slot table.

Cases: null and empty texts hold the end id only; repeated rows and rows without an id are separate documents;
very long texts give many pieces; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import keep, partitions, quantiles, range_number, running
from ridgeline.llm.hashing import slices
from ridgeline.llm.tokens import encoder, with_end

CAPACITY = 1024
#: Text that is tokenised at once.
SLICE_BYTES = 8_000_000
#: Rows of the linear program at most.
CLASSES = 160
TOKENIZER = "byte_bpe_50k.json"
END = 0


def classes(sizes: np.ndarray, demand: np.ndarray, most: int = CLASSES) -> np.ndarray:
    """For each of the ascending sizes the longest one of its class: at most so many classes, with the least total rounding."""
    n = len(sizes)
    if n <= most:
        return sizes
    count, tokens = (np.concatenate([[0], np.cumsum(x)]).astype(float) for x in (demand, demand * sizes))
    # Row i, column j: the tokens that a class of sizes i to j adds.
    cost = sizes * (count[1:] - count[:-1, None]) - (tokens[1:] - tokens[:-1, None])
    cost[np.tril_indices(n, -1)] = np.inf
    best, firsts = cost[0], []
    for _ in range(most - 1):
        total = cost + np.concatenate([[0], best[:-1]])[:, None]
        firsts.append(total.argmin(axis=0))
        best = total.min(axis=0)
    out, end = np.empty_like(sizes), n
    for first in [*reversed(firsts), np.zeros(n, np.int64)]:
        if end > 0:
            begin = int(first[end - 1])
            out[begin:end] = sizes[end - 1]
            end = begin
    return out


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the largest total value that fits (unbounded knapsack): its value and its counts."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    sizes_up, values_up = sizes[order], values[order]
    upto = np.searchsorted(sizes_up, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if upto[room]:
            total = values_up[: upto[room]] + best[room - sizes_up[: upto[room]]]
            k = int(total.argmax())
            if total[k] > best[room]:
                best[room], last[room] = total[k], k
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
            continue
        counts[order[last[room]]] += 1
        room -= sizes_up[last[room]]
    return float(best[capacity]), counts


def first_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """One pattern per size, longest first: as many of it as fit, filled up with the longest shorter pieces that are left.

    Pieces are taken only while they last for all uses of the pattern, so using each pattern until its own size
    is used up is a solution to start from.
    """
    patterns, left = np.zeros((len(sizes), len(sizes)), np.int64), demand.astype(float)
    for i in np.argsort(-sizes, kind="stable"):
        patterns[i, i] = capacity // sizes[i]
        uses, room = left[i] / patterns[i, i], capacity % sizes[i]
        left[i] = 0
        while room > 0 and len(fits := np.flatnonzero((sizes <= room) & (sizes < sizes[i]) & (left >= uses))) and uses > 0:
            j = fits[sizes[fits].argmax()]
            count = max(1, min(int(left[j] // uses), int(room // sizes[j])))
            patterns[i, j] += count
            left[j] -= uses * count
            room -= sizes[j] * count
    return patterns


def first_inverse(patterns: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The inverse of the basis matrix whose columns are the first patterns.

    A first pattern holds its own size and shorter ones, so the matrix is triangular by size and few entries of a row are
    not zero: rows of the inverse come by substitution, shortest first, without a factorisation.
    """
    rows = np.zeros(patterns.shape)
    for i in np.argsort(sizes, kind="stable"):
        rows[i, i] = 1
        for j in np.flatnonzero(patterns[i]):
            if j != i:
                rows[i] -= patterns[i, j] * rows[j]
        rows[i] /= patterns[i, i]
    return np.ascontiguousarray(rows.T)


def times_vector(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """matrix @ vector in numpy's own loops: the driver calls no library that starts threads of its own."""
    some = np.flatnonzero(vector)
    return np.einsum("ij,j->i", matrix[:, some], vector[some])


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.002, most: int = 2000):
    """Patterns (rows of counts by size) and how often the linear program uses each.

    It stops once the sequences are within the gap of all lengths over the capacity, once no pattern is worth
    more than 1 + gap (the program's optimum is then within the gap), or after `most` patterns.
    """
    patterns = first_patterns(sizes, demand, capacity).astype(float)  # row i: the pattern in basis place i
    inverse = first_inverse(patterns, sizes)
    used = np.maximum(times_vector(inverse, demand), 0)
    least = float((sizes * demand).sum()) / capacity
    for _ in range(most):
        if used.sum() <= (1 + gap) * least:
            break
        duals = inverse.sum(axis=0)
        value, counts = price(duals, sizes, capacity)
        if value <= 1 + gap:
            break
        direction = times_vector(inverse, counts.astype(float))
        ratios = np.where(direction > 1e-9, used / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratios.argmin())
        step = ratios[out]
        used = np.maximum(used - step * direction, 0)
        used[out] = step
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        patterns[out] = counts
    return patterns.astype(np.int64), used


def plan(sizes: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Sequences for demand[i] pieces of sizes[i]: rows (times, [(size, count), ...]) that use every piece once."""
    if len(sizes) == 0:
        return []
    sizes, demand = sizes.astype(np.int64), demand.astype(np.int64)
    patterns, used = column_generation(sizes, demand.astype(float), capacity)
    left, rows = demand.copy(), []
    for counts, times in sorted(zip(patterns.tolist(), used.tolist()), key=lambda p: -p[1]):
        counts = np.array(counts)
        some = counts > 0
        whole = min(int(np.floor(times + 1e-6)), int((left[some] // counts[some]).min()))
        if whole > 0:
            left -= whole * counts
            rows.append((whole, [(int(s), int(c)) for s, c in zip(sizes, counts) if c]))
    return rows + best_fit(sizes, left, capacity)


def best_fit(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit of falling lengths, a length's pieces at a time: sequences filled alike are one row, whatever their number."""
    rooms: list[list[tuple[int, dict]]] = [[] for _ in range(capacity + 1)]  # by room left: (times, pieces by size)
    for size, count in sorted(zip(sizes.tolist(), demand.tolist()), reverse=True):
        while count > 0:
            room = next((r for r in range(size, capacity) if rooms[r]), capacity)
            if room < capacity:
                times, items = rooms[room].pop()
                fits = max(1, min(room // size, count // times))  # of this size in each of them
                some = min(times, count)
                if some < times:
                    rooms[room].append((times - some, items))
            else:
                items, fits = {}, min(capacity // size, count)
                some = max(1, count // fits)
            rooms[room - fits * size].append((some, items | {size: items.get(size, 0) + fits}))
            count -= some * fits
    return [(times, sorted(items.items(), reverse=True)) for row in rooms for times, items in row]


def slots(rows: list[tuple[int, list[tuple[int, int]]]]) -> tuple[list[tuple], int]:
    """The slot table (size, first_rank, end_rank, per_sequence, first_sequence), and the number of sequences."""
    out, ranks, sequence = [], {}, 0
    for times, items in rows:
        for size, count in items:
            first = ranks.get(size, 0)
            ranks[size] = first + times * count
            out.append((size, first, ranks[size], count, sequence))
        sequence += times
    return out, sequence


def tokenised(documents: DataFrame, tokenizer: str = TOKENIZER, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, doc_tokens, crcs): the number of ids with the end id, and the crc32 of each piece of capacity ids."""

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(tokenizer)
        for part in (piece for whole in parts for piece in slices(whole, limit=SLICE_BYTES)):
            ids, at = with_end(*one.encode(part.column("text")), end)
            ids, places = memoryview(ids.astype("<u4")), at.tolist()
            sums = [[zlib.crc32(ids[i : min(i + capacity, b)]) for i in range(a, b, capacity)] for a, b in zip(places, places[1:])]
            columns = [part.column("doc_id"), pa.array(np.diff(at)), pa.array(sums, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "doc_tokens", "crcs"])

    slim = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(encode, "doc_id long, doc_tokens long, crcs array<long>")


def pack(documents: DataFrame, tokenizer: str = TOKENIZER, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one per piece."""
    spark = documents.sparkSession
    docs = keep(tokenised(documents, tokenizer, end, capacity))
    bounds = quantiles(docs, "doc_id", 2 * partitions(spark))
    docs = docs.withColumns(
        {
            "full": F.floor(F.col("doc_tokens") / capacity),
            "size": F.col("doc_tokens") % capacity,
            # Rows without an id come first, dealt to buckets by a hash, so that they may be any share of the rows.
            "bucket": range_number(bounds, F.xxhash64("doc_tokens", "crcs")),
            "tie": F.when(F.col("doc_id").isNull(), F.xxhash64("doc_tokens", "crcs")),
        }
    )
    histogram = docs.where("size > 0").groupBy("size").count().toPandas().sort_values("size")  # under capacity rows
    sizes, counts = histogram["size"].to_numpy(), histogram["count"].to_numpy()
    rounded = classes(sizes, counts)
    longest = np.unique(rounded)
    demand = np.bincount(np.searchsorted(longest, rounded), counts, len(longest)).astype(np.int64)
    table, sequences = slots(plan(longest, demand, capacity))
    class_of = F.broadcast(spark.createDataFrame(list(zip(sizes.tolist(), rounded.tolist())), "of_size long, class long"))
    names = "of_class long, first_rank long, end_rank long, per_sequence long, first_sequence long"
    # A row per length of a pattern; patterns are at most capacity and those that complete the rounding.
    table = F.broadcast(spark.createDataFrame(table, names))
    order = [F.col("doc_id").asc_nulls_first(), "tie", "doc_tokens", "crcs"]
    short = docs.where("size > 0").join(class_of, F.col("size") == F.col("of_size")).drop("of_size")
    ranked = running(short, ["class"], "bucket", order, {"rank": F.lit(1)})
    inside = (F.col("class") == F.col("of_class")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank"))
    index = F.col("rank") - F.col("first_rank")
    short = ranked.join(table, inside).withColumn("sequence_id", F.col("first_sequence") + F.floor(index / F.col("per_sequence")))
    # A sequence has at most capacity pieces; they are put side by side, longest first.
    earlier = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    short = short.select(
        "doc_id",
        (F.col("full") * capacity).alias("start"),
        F.col("size").alias("length"),
        F.element_at("crcs", -1).alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"),
    )
    counted = running(docs.where("full > 0"), [], "bucket", order, {"before": F.col("full")})
    piece = F.posexplode(F.slice("crcs", F.lit(1), F.col("full").cast("int"))).alias("i", "ids_crc32")
    whole = counted.select("doc_id", "doc_tokens", "before", piece).select(
        "doc_id",
        (F.col("i") * F.lit(capacity).cast("long")).alias("start"),
        F.lit(capacity).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.lit(sequences) + F.col("before") + F.col("i")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return short.unionByName(whole)
