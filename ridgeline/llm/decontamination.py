"""Benchmark passages in documents: winnowed fingerprints find the documents, their windows decide.

A fingerprint is the least hash of the 5-grams in ten words in a row. Any ten words that a document shares with an
item have the same ten words' fingerprint in both, so a join on fingerprints, which repeat along neighbouring windows and are
far fewer than windows, misses no shared span of ten words or more. Documents with a common fingerprint are then looked at
whole: each of their windows is the pair of hashes of its first and its last 5-gram (128 bits), met with those of the items, and
windows that follow each other extend a hit to its whole span. An item of fewer words than a window is one window, found by the
hash of as many words.

Only DataFrame functions are used. Documents are met by id and text together, so copies of one text lie in as many places as
they have ids. The items' side is broadcast while it has at most `most` rows (16 and 40 bytes each); beyond that rows are shuffled,
each window of the items once per salt, since one passage may be in any share of the documents.

Cases: a null or empty text, and one without words, has no hit; rows without an id are looked at like others; repeated rows each
get the same result; items without an id are one item with an empty name, repeated item ids are one item; items without words are no window;
texts may be of any length; an empty table gives an empty table or no hits; columns that are not named are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window and of a gram: a window has WINDOW - GRAM + 1 grams, and its first and last gram cover it.
WINDOW, GRAM = 10, 5
#: Rows of the items' side that are broadcast at most.
MOST = 500_000
SALTS = 16


def words(text: Column) -> Column:
    """The words of a text, A to Z in lower case. lower() is that for ASCII, and many times faster."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.regexp_extract_all(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), F.lit(WORD), 0)


def _each(hashes: Column, length: int, make) -> Column:
    """make(place, hashes of `length` words) for each place where so many words are left."""
    starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (length - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: make(i, [x, *[F.get(hashes, i + k) for k in range(1, length)]]))


def _grams(hashes: Column, length: int, seed: int) -> Column:
    """The hash of `length` words from each place on."""
    return _each(hashes, length, lambda i, taken: F.xxhash64(F.lit(seed), *taken))


def _least(grams: Column) -> Column:
    """The least gram of each window, one entry for each window: its fingerprint."""
    return _each(grams, WINDOW - GRAM + 1, lambda i, taken: F.least(*taken))


def hashed(rows: DataFrame) -> DataFrame:
    """rows (..., words) with h, the hashes of their words, and g, those of their grams, in place of the words."""
    rows = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w))).drop("words")
    return rows.withColumn("g", _grams(F.col("h"), GRAM, GRAM))


def prints(lengths: list[int]) -> Column:
    """What a text is found by: the fingerprints of its windows, and its short grams of the lengths that items have."""
    parts = [F.array_distinct(_least(F.col("g"))), *[F.array_distinct(_grams(F.col("h"), n, 100 + n)) for n in lengths]]
    return F.concat(*parts)


def windows(lengths: list[int]) -> Column:
    """All windows of a text: an array of (at, length, a, b), a and b being the hashes that tell windows apart."""

    def told(at: Column, length: int, a: Column, b: Column) -> Column:
        return F.struct(at.alias("at"), F.lit(length).alias("length"), a.alias("a"), b.alias("b"))

    span = WINDOW - GRAM
    whole = _each(F.col("g"), span + 1, lambda i, taken: told(i, WINDOW, taken[0], taken[span]))
    short = [_each(F.col("h"), n, lambda i, taken, n=n: told(i, n, F.xxhash64(F.lit(100 + n), *taken), F.xxhash64(F.lit(200 + n), *taken))) for n in lengths]
    return F.concat(whole, *short)


def item_windows(items: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """The different windows of all items (length, a, b, held_by), their different prints (p), and the lengths below a window.

    held_by: the sorted ids of the items that have the window.
    """
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words")).where("size(words) > 0")
    named = keep(hashed(named))
    short = named.where(F.size("h") < WINDOW)
    lengths = sorted(r[0] for r in short.select(F.size("h")).distinct().collect())  # at most WINDOW - 1 values
    own = lambda n: short.where(F.size("h") == n)
    whole = named.where(F.size("h") >= WINDOW)
    frames = [whole.select("item", F.explode(windows([])).alias("w")), *[own(n).select("item", F.explode(F.slice(windows([n]), -1, 1)).alias("w")) for n in lengths]]
    found = reduce(DataFrame.unionByName, frames).select("item", "w.length", "w.a", "w.b")
    found = keep(found.groupBy("length", "a", "b").agg(F.sort_array(F.collect_set("item")).alias("held_by")))
    marks = [whole.select(F.explode(prints([])).alias("p")), *[own(n).select(F.explode(_grams(F.col("h"), n, 100 + n)).alias("p")) for n in lengths]]
    return found, keep(reduce(DataFrame.unionByName, marks).distinct()), lengths


def _met(left: DataFrame, right: DataFrame, on: list[str], small: bool, salt: Column) -> DataFrame:
    """left joined with right, whose keys are unique: broadcast, or dealt by key and salt so that no key is in one place."""
    if small:
        return left.join(F.broadcast(right), on)
    salted = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(salted, [*on, "salt"]).drop("salt")


def contamination(documents: DataFrame, items: DataFrame, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (their sorted ids), contaminated."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = ["doc_id", "digest"]
    rows = documents.select("doc_id", F.struct(F.xxhash64(text, F.lit(1)).alias("d1"), F.xxhash64(F.lit(2), text).alias("d2")).alias("digest"), text.alias("text"))
    held, marks, lengths = item_windows(items)
    few_marks = marks.count() <= most
    few_windows = held.agg(F.coalesce(F.sum(F.size("held_by")), F.lit(0)).alias("n")).first()["n"] <= most
    held = held.withColumn("number", F.xxhash64(F.concat_ws(",", "held_by"), F.size("held_by")))

    counted = hashed(rows.select(*key, words(F.col("text")).alias("words")).withColumn("n_words", F.size("words").cast("long")))
    counted = keep(counted.select(*key, "n_words", prints(lengths).alias("prints")))
    found = _met(counted.select(*key, F.explode("prints").alias("p")), marks, ["p"], few_marks, F.xxhash64(*key)).select(*key)
    found = keep(found.distinct())
    near = found.count() <= most
    found = found.select(*[F.col(k).alias(f"of_{k}") for k in key])
    of = F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & (F.col("digest") == F.col("of_digest"))
    looked = rows.join(F.broadcast(found) if near else found, of, "left_semi")
    looked = hashed(looked.select(*key, words(F.col("text")).alias("words"))).select(*key, F.explode(windows(lengths)).alias("w")).select(*key, "w.*")
    hits = _met(looked, held.select("length", "a", "b", "number"), ["length", "a", "b"], few_windows, F.xxhash64(*key, "at"))
    # A document's windows are at most as many as its words times the lengths; repeated rows give the same ones.
    spans = F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("length")).alias("end"))))
    hits = hits.groupBy(*key).agg(spans.alias("spans"), F.sort_array(F.collect_set("number")).alias("numbers"))
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("total"))
    step = lambda x, s: F.struct(F.greatest(x["upto"], s["end"]).alias("upto"), (x["total"] + F.greatest(s["end"] - F.greatest(x["upto"], s["at"]), F.lit(0))).alias("total"))
    hits = keep(hits.select(*key, F.aggregate("spans", start, step, lambda x: x["total"]).alias("n_hit"), "numbers"))

    # Documents with the same passages share one list of items, which is made once.
    lists = hits.select("numbers").distinct()
    sets = held.groupBy("number").agg(F.first("held_by").alias("held_by"))
    made = lists.select("numbers", F.explode("numbers").alias("number")).join(F.broadcast(sets) if few_windows else sets, "number")
    made = made.groupBy("numbers").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("held_by")))).alias("items"))
    made = keep(made)
    hits = _met(hits, made, ["numbers"], made.count() <= most // 10, F.xxhash64(*key)).select(*[F.col(k).alias(f"of_{k}") for k in key], "n_hit", "items")
    out = counted.drop("prints").join(hits, of, "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
