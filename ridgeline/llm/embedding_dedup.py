"""Embedding near-dedup: PCA-ordered tiled comparison within labels.

Vectors are scaled to length 1 and turned into the axes of the principal components, which keeps every
product. Rows of a label are cut into cells along the first component; two vectors at cosine >= c differ by
at most sqrt(2 - 2c) there, so only a cell and its successor can hold links. Cells are cut into blocks of
bounded size, and each pair of blocks is one tile. A tile multiplies the leading dimensions first; a pair
goes on only while its partial product plus the product of the two suffix norms can reach the threshold,
and what is left is decided by the cosine of the original vectors in double precision.

Equal vectors of a label are one class, compared once. A tile returns one row per class that has a link in
it, with its number of links and the smallest class reachable inside the tile; no pair leaves the tile.
Components are then joined across tiles.

Cases: null labels, null, empty and zero vectors and vectors with null or non-finite components link with nothing and
form components of their own; vectors of different lengths have no cosine and are not linked, those of one length are
compared whatever it is (principal axes are those of the commonest length; others are compared as they stand); each
row is a vector of its own, also where rows repeat a vec_id or have none: it has the links of its own label and
components, and the component its vector is in, named by the smallest vec_id there is in it (null if there is none);
a vector is kept if that is its own vec_id; empty tables give empty results; columns other than vec_id, label and
embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import components, keep

THRESHOLD = 0.93
BLOCK = 1024
STEPS = (0.25, 0.5)
#: Room for rounding in the pruning bounds; the decision itself has none.
SLACK = 1e-9


def _links(label: Column, embedding: Column) -> Column:
    """Whether a vector can link with others."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists(embedding, lambda x: x != 0)
    return label.isNotNull() & embedding.isNotNull() & (F.size(embedding) > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(nonzero, F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings it near 1: no product over- or underflows, no bit of a cosine changes."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def principal_axes(classes: DataFrame, width: int) -> np.ndarray:
    """The eigenvectors of the second-moment matrix of the unit vectors of that width, largest first, from one sum per partition."""

    def moments(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for part in parts:
            if len(part):
                rows = unit(np.array(part["embedding"].tolist(), float))
                total += rows.T @ rows
        yield pd.DataFrame({"m": [total.ravel().tolist()]})

    summed = classes.where(F.col("width") == width).select("embedding").mapInPandas(moments, "m array<double>")
    summed = summed.select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))

    def turned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for entries in part["m"]:
                values, axes = np.linalg.eigh(np.array([e["x"] for e in entries], float).reshape(width, width))
                yield pd.DataFrame({"axes": [axes[:, np.argsort(-values)].ravel().tolist()]})

    # One row of width x width numbers, turned by a Python worker: its linear algebra has one thread, unlike the driver's.
    whole = summed.agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("m")).mapInPandas(turned, "axes array<double>")
    return np.array(whole.first()["axes"]).reshape(width, width)


def linked_pairs(left: np.ndarray, right: np.ndarray, left_axes: np.ndarray, right_axes: np.ndarray, threshold: float):
    """Indices (i, j) with cosine of left[i] and right[j] at threshold or above; *_axes are the rotated rows."""
    width = left.shape[1]
    cuts = sorted({max(1, int(width * s)) for s in STEPS})
    done = cuts[0]
    norms = lambda rows, at: np.sqrt(np.maximum((rows[:, at:] ** 2).sum(axis=1), 0))
    partial = left_axes[:, :done] @ right_axes[:, :done].T
    i, j = np.nonzero(partial + np.outer(norms(left_axes, done), norms(right_axes, done)) >= threshold - SLACK)
    partial = partial[i, j]
    for cut in [*cuts[1:], width]:
        if len(i) == 0:
            break
        partial = partial + np.einsum("ij,ij->i", left_axes[i, done:cut], right_axes[j, done:cut])
        done = cut
        alive = partial + norms(left_axes, done)[i] * norms(right_axes, done)[j] >= threshold - SLACK
        i, j, partial = i[alive], j[alive], partial[alive]
    if len(i) == 0:
        return i, j
    a, b = left[i], right[j]
    cosine = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    keep_pair = cosine >= threshold
    return i[keep_pair], j[keep_pair]


def smallest_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links i-j: the smallest node that each one reaches."""
    at = np.arange(n)
    while True:
        low = np.minimum(at[i], at[j])
        new = at.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == at).all():
            return at
        at = new


def link(embeddings: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of embeddings."""
    rows = embeddings.select("vec_id", "label", "embedding")
    usable = rows.where(_links(F.col("label"), F.col("embedding"))).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)))
    # Members of a class have equal label and components; the hashes spare shuffling the vectors twice.
    hashes = {"width": F.size("embedding"), "h1": F.xxhash64("label", "embedding"), "h2": F.xxhash64(F.lit(7), "label", "embedding")}
    usable = usable.withColumns(hashes)
    key = ["label", "width", "h1", "h2"]
    classes = usable.groupBy(*key).agg(F.min("vec_id").alias("lowest_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = keep(classes.withColumn("node", F.monotonically_increasing_id()))
    common = classes.groupBy("width").count().orderBy(F.desc("count"), "width").first()
    main = common["width"] if common else 0
    axes = principal_axes(classes, main) if main else np.eye(1)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6

    def rotated(vectors: np.ndarray) -> np.ndarray:
        return unit(vectors) @ axes if vectors.shape[1] == main else unit(vectors)

    @F.pandas_udf("double")
    def leading(embedding: pd.Series) -> pd.Series:
        out, width = np.zeros(len(embedding)), embedding.map(len).to_numpy()
        for n in np.unique(width):
            some = np.flatnonzero(width == n)
            out[some] = rotated(np.array(embedding.iloc[some].tolist(), float))[:, 0]
        return pd.Series(out)

    placed = keep(classes.withColumn("cell", F.floor(leading("embedding") / reach).cast("int")))
    where = ["label", "width", "cell"]
    sizes = placed.groupBy(*where).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    following = sizes.select("label", "width", (F.col("cell") - 1).alias("cell"), F.col("blocks").alias("next_blocks"))
    preceding = sizes.select("label", "width", (F.col("cell") + 1).alias("cell"), F.col("blocks").alias("last_blocks"))
    sizes = sizes.join(following, where, "left").join(preceding, where, "left")
    in_blocks = placed.join(sizes, where).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A tile is (cell of the left block, left block, 0 or 1 for the cell of the right block, right block).
    number = lambda n: F.sequence(F.lit(0), F.coalesce(n, F.lit(0)))
    own = F.transform(
        number(F.col("blocks") - 1),
        lambda b: F.struct(F.col("cell").alias("at"), F.least(b, "block").alias("left"), F.lit(0).alias("step"), F.greatest(b, "block").alias("right")),
    )
    ahead = F.when(F.col("next_blocks").isNotNull(), F.transform(
        number(F.col("next_blocks") - 1),
        lambda b: F.struct(F.col("cell").alias("at"), F.col("block").alias("left"), F.lit(1).alias("step"), b.alias("right")),
    ))
    behind = F.when(F.col("last_blocks").isNotNull(), F.transform(
        number(F.col("last_blocks") - 1),
        lambda b: F.struct((F.col("cell") - 1).alias("at"), b.alias("left"), F.lit(1).alias("step"), F.col("block").alias("right")),
    ))
    none = F.array().cast("array<struct<at:int,left:int,step:int,right:int>>")
    tiles = F.concat(own, F.coalesce(ahead, none), F.coalesce(behind, none))
    dealt = in_blocks.select(*where, "block", "node", "copies", "embedding", F.inline(tiles))

    def compare(tile: pd.DataFrame) -> pd.DataFrame:
        at, left, step, right = tile[["at", "left", "step", "right"]].iloc[0]
        vectors = scaled(np.array(tile["embedding"].tolist(), float).reshape(len(tile), -1))
        turned = rotated(vectors)
        same = step == 0 and left == right
        first = np.flatnonzero(((tile["cell"] == at) & (tile["block"] == left)).to_numpy())
        second = first if same else np.flatnonzero(((tile["cell"] == at + step) & (tile["block"] == right)).to_numpy())
        i, j = linked_pairs(vectors[first], vectors[second], turned[first], turned[second], threshold)
        i, j = first[i], second[j]
        if same:
            i, j = i[i < j], j[i < j]
        nodes, copies = tile["node"].to_numpy(), tile["copies"].to_numpy()
        links = np.bincount(i, copies[j], len(tile)) + np.bincount(j, copies[i], len(tile))
        order = np.argsort(nodes, kind="stable")
        place = np.empty(len(tile), int)
        place[order] = np.arange(len(tile))
        lowest = nodes[order][smallest_reachable(len(tile), place[i], place[j])[place]]
        some = links > 0
        return pd.DataFrame({"node": nodes[some], "links": links[some].astype("int64"), "lowest": lowest[some]})

    found = dealt.groupBy("label", "width", "at", "left", "step", "right").applyInPandas(compare, "node long, links long, lowest long")
    found = keep(found)
    joined = components(found.select("node", "lowest"), "node", "lowest")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    slim = classes.select(*key, "node", "lowest_id", "copies")
    of_class = slim.join(links, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = of_class.groupBy("component").agg(F.min("lowest_id").alias("component_id"))
    of_class = of_class.join(names, "component").select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = keep(of_class.where("n_links > 0"))
    # Each row finds the class of its own vector; rows that cannot link have no key, and find none.
    named = rows.withColumn("embedding", F.when(_links(F.col("label"), F.col("embedding")), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))))
    keyed = named.select("vec_id", *[F.when(F.col("embedding").isNotNull(), c).alias(n) for n, c in {"label": F.col("label"), **hashes}.items()])
    out = keyed.join(linked, key, "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept")
    )
