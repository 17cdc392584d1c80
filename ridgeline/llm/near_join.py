"""N-gram Jaccard join with Bayesian candidate pruning.

A document is its set of distinct five-word shingles (words are runs of other characters than ASCII white
space; fewer words give one shingle of all of them). Documents with equal sets are one class, compared once.

Classes that agree in a band of MinHash values are candidates. Candidates are compared a few MinHash values
at a time: after n values of which m agree, with a uniform prior, the probability that the similarity reaches
the threshold is that of at most m successes in n + 1 draws at the threshold; a pair goes on only while it is
above the tolerance. Pairs that stay to the end join their classes into neighbourhoods, and inside one the
same pruning and then the exact Jaccard similarity of the sets decide every link.

Groups of candidates and neighbourhoods are cut into blocks of bounded size and compared tile by tile (a pair
of blocks). A tile returns one row for each class that has a link in it: no pair of documents leaves a tile.

Cases: null and blank texts have no shingle and link with nothing; equal texts are linked copies; rows that
share a doc_id are separate texts of one document; rows with a null doc_id link with nothing; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import components, keep, streamed
from ridgeline.llm.embedding_dedup import smallest_reachable
from ridgeline.llm.hashing import mixed, shingles, slices, text_bytes

WORDS = 5
THRESHOLD = 0.8
#: 24 bands of 4: two sets at the threshold share no band with probability (1 - 0.8 ** 4) ** 24 = 3e-6.
BANDS, BAND = 24, 4
STEP = 16
TOLERANCE = 1e-6
BLOCK = 512


def multipliers(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def fewest_matches(n: int, threshold: float, tolerance: float) -> int:
    """The least m of n agreeing values at which P(similarity >= threshold) under a uniform prior is at least tolerance."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def signatures(hashes: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values of 32 bits for each text; texts without shingles have zeros."""
    out = np.zeros((len(begin) - 1, n), np.uint32)
    some = begin[:-1] < begin[1:]
    if some.any():
        for i, a in enumerate(multipliers(n)):
            out[some, i] = np.minimum.reduceat(hashes * a, begin[:-1][some]) >> np.uint64(32)
    return out


def set_hashes(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    out = np.zeros(len(begin) - 1, np.uint64)
    some = begin[:-1] < begin[1:]
    if some.any():
        out[some] = np.add.reduceat(mixed(hashes), begin[:-1][some])
    return mixed(out + np.diff(begin).astype(np.uint64))


def surviving(left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of two signature tables that pass every step of the comparison."""
    width = left.shape[1]
    first = min(STEP, width)
    agree = np.zeros((len(left), len(right)), np.uint8)
    for k in range(first):
        agree += left[:, k, None] == right[None, :, k]
    i, j = np.nonzero(agree >= fewest_matches(first, threshold, tolerance))
    count = agree[i, j].astype(np.int64)
    for at in range(first, width, STEP):
        upto = min(width, at + STEP)
        count = count + (left[i, at:upto] == right[j, at:upto]).sum(axis=1)
        alive = count >= fewest_matches(upto, threshold, tolerance)
        i, j, count = i[alive], j[alive], count[alive]
    return i, j


def jaccard(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The exact similarity of the sets of each pair."""
    size = np.array([len(s) for s in sets], np.int64)
    if len(i) <= 4 * len(sets):
        same = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    else:
        used = np.unique(np.concatenate([i, j]))
        place = np.zeros(len(sets), np.int64)
        place[used] = np.arange(len(used))
        values, column = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True)
        row = np.repeat(np.arange(len(used)), size[used])
        common = np.bincount(column, minlength=len(values)) > 1
        number = np.cumsum(common) - 1
        row, column = row[common[column]], number[column[common[column]]]
        product = np.zeros((len(used), len(used)), np.float32)
        chunk = 4096
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for start in range(0, int(common.sum()), chunk):
            a, b = np.searchsorted(column, [start, start + chunk])
            dense = np.zeros((len(used), chunk), np.float32)
            dense[row[a:b], column[a:b] - start] = 1
            product += dense @ dense.T
        same = np.rint(product[place[i], place[j]]).astype(np.int64)
    return same / (size[i] + size[j] - same)


def _matrix(column: pa.ChunkedArray, dtype) -> np.ndarray:
    rows = [np.frombuffer(x, dtype) for x in column.to_pylist()]
    return np.stack(rows)


def profiles(documents: DataFrame, words: int, n_hashes: int) -> DataFrame:
    """Rows (doc_id, node, signature) of documents that have a shingle; node is the hash of the set."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (piece for whole in parts for piece in slices(whole)):
            hashes, begin = shingles(*text_bytes(part.column("text")), words)
            some = np.flatnonzero(np.diff(begin))
            table = signatures(hashes, begin, n_hashes)[some]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(some)), pa.array(set_hashes(hashes, begin)[some].view(np.int64)), pa.array([r.tobytes() for r in table], pa.binary())],
                ["doc_id", "node", "signature"],
            )

    slim = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, node long, signature binary")


def _tiles(rows: DataFrame, group: str, block: int) -> DataFrame:
    """rows with a line for each tile (left, right) of its group that the row takes part in; own: its block."""
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = rows.join(sizes, group).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.withColumn("other", other)
    return placed.withColumns({"left": F.least("own", "other"), "right": F.greatest("own", "other")}).drop("other", "blocks")


def neighbourhoods(classes: DataFrame, threshold: float, tolerance: float, block: int) -> DataFrame:
    """Rows (node, component): classes joined by pairs that the pruning leaves."""
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.xxhash64(b, F.substr("signature", b * (4 * BAND) + 1, F.lit(4 * BAND))),
    )
    banded = classes.select("node", F.explode(keys).alias("band"))
    # Bands that hold the same classes are one group.
    groups = banded.groupBy("band").agg(
        F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("total")
    )
    groups = groups.where("n > 1").groupBy("n", "low", "high", "total").agg(F.min("band").alias("band"))
    members = keep(banded.join(groups.select("band"), "band"))
    dealt = _tiles(members, "band", block).join(classes.select("node", "signature"), "node")

    def compare(tile: dict) -> dict | None:
        own, left, right = (tile[c].to_numpy() for c in ("own", "left", "right"))
        node, table = tile["node"].to_numpy(), _matrix(tile["signature"], np.uint32)
        first = np.flatnonzero(own == left[0])
        second = first if left[0] == right[0] else np.flatnonzero(own == right[0])
        i, j = surviving(table[first], table[second], threshold, tolerance)
        i, j = first[i], second[j]
        i, j = i[i != j], j[i != j]
        order = np.argsort(node, kind="stable")
        place = np.empty(len(node), np.int64)
        place[order] = np.arange(len(node))
        lowest = node[order][smallest_reachable(len(node), place[i], place[j])[place]]
        some = lowest != node
        return {"node": node[some], "lowest": lowest[some]} if some.any() else None

    edges = streamed(dealt.select("band", "left", "right", "own", "node", "signature"), ["band", "left", "right"], compare, "node long, lowest long")
    edges = keep(edges.distinct())
    return components(edges, "node", "lowest")


def verified(documents: DataFrame, members: DataFrame, words: int, threshold: float, tolerance: float, block: int, n_hashes: int) -> DataFrame:
    """Rows (node, links, lowest) for each tile and class with a link; members: (doc_id, node, component, copies)."""
    tiles = _tiles(members, "component", block)
    parts = tiles.groupBy("doc_id", "node", "component", "copies", "own").agg(F.collect_list(F.struct("left", "right")).alias("tiles"))
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(parts, "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (piece for whole in batches for piece in slices(whole)):
            hashes, begin = shingles(*text_bytes(part.column("text")), words)
            same = set_hashes(hashes, begin).view(np.int64) == part.column("node").to_numpy()  # else another text of this doc_id
            table = signatures(hashes, begin, n_hashes)
            at = pa.array(np.flatnonzero(same))
            chosen = [part.column(c).take(at) for c in ("node", "component", "copies", "own", "tiles")]
            blobs = [hashes[begin[k] : begin[k + 1]].tobytes() for k in at.to_numpy()]
            signs = [table[k].tobytes() for k in at.to_numpy()]
            yield pa.RecordBatch.from_arrays([*chosen, pa.array(blobs, pa.binary()), pa.array(signs, pa.binary())], ["node", "component", "copies", "own", "tiles", "shingles", "signature"])

    fields = "node long, component long, copies long, own int, tiles array<struct<left:int,right:int>>, shingles binary, signature binary"
    # Rows that share a doc_id and a text give a class twice.
    found = texts.select("text", "node", "component", "copies", "own", "tiles").mapInArrow(sets, fields)
    dealt = found.select("node", "component", "copies", "own", "shingles", "signature", F.inline("tiles"))

    def compare(tile: dict) -> dict | None:
        node, fresh = np.unique(tile["node"].to_numpy(), return_index=True)
        own, left, right, copies = (tile[c].to_numpy()[fresh] for c in ("own", "left", "right", "copies"))
        table = _matrix(tile["signature"], np.uint32)[fresh]
        blobs = tile["shingles"].take(pa.array(fresh)).to_pylist()
        members = [np.frombuffer(b, np.uint64) for b in blobs]
        first = np.flatnonzero(own == left[0])
        second = first if left[0] == right[0] else np.flatnonzero(own == right[0])
        i, j = surviving(table[first], table[second], threshold, tolerance)
        i, j = first[i], second[j]
        if left[0] == right[0]:
            i, j = i[i < j], j[i < j]
        if len(i) == 0:
            return None
        linked = jaccard(members, i, j) >= threshold
        i, j = i[linked], j[linked]
        if len(i) == 0:
            return None
        links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
        lowest = node[smallest_reachable(len(node), i, j)]
        some = links > 0
        return {"node": node[some], "links": links[some].astype(np.int64), "lowest": lowest[some]}

    columns = ["component", "left", "right", "own", "node", "copies", "shingles", "signature"]
    return streamed(dealt.select(columns), ["component", "left", "right"], compare, "node long, links long, lowest long")


def near_duplicates(
    documents: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK
) -> DataFrame:
    """Rows (doc_id, class_id, n_links, component_id, kept), one per row of documents.

    class_id is the smallest doc_id with the same shingles, n_links the number of other documents at the
    threshold or above, component_id the smallest doc_id reachable by links.
    """
    n_hashes = BANDS * BAND
    rows = keep(profiles(documents, words, n_hashes))
    classes = keep(rows.groupBy("node").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.first("signature").alias("signature")))
    near = neighbourhoods(classes, threshold, tolerance, block)
    slim = classes.select("node", "class_id", "copies")
    members = slim.join(near, "node").select(F.col("class_id").alias("doc_id"), "node", "component", "copies")
    found = keep(verified(documents, keep(members), words, threshold, tolerance, block, n_hashes))
    joined = components(found.select("node", "lowest"), "node", "lowest")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    of_class = slim.join(links, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = of_class.groupBy("component").agg(F.min("class_id").alias("component_id"))
    of_class = keep(of_class.join(lowest, "component").select("node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    of_row = rows.select("doc_id", "node").join(of_class, "node")
    # Of several texts under one doc_id, the document has the links of all and the smallest component.
    of_row = of_row.groupBy(F.col("doc_id").alias("of")).agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = documents.select("doc_id").join(of_row, F.col("doc_id") == F.col("of"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
