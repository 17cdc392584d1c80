"""Operators on pairs and repeats against brute force on small tables."""

import hashlib
import random

import pytest

from ridgeline.llm import embedding_dedup, near_join, suffix_dedup
from ridgeline.llm.common import ship
from ridgeline.llm.run_index import RunIndex

DOCS = "doc_id long, text string, source string, class_id string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def changed(rng, text, n):
    parts = text.split(" ")
    for _ in range(n):
        parts[rng.randrange(len(parts))] = f"x{rng.randrange(10**6)}"
    return " ".join(parts)


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for g in range(25):
        base = " ".join(words(rng, rng.choice([3, 30, 80, 200])))
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            rows.append(changed(rng, base, rng.choice([0, 0, 1, 2, 4])) if len(base) > 60 else base)
    rows += [None, "", "  \n ", "one", "a b c d", "a  b c\td", "é ü " * 40]
    rows.append(" ".join(words(rng, 30_000, 5000)))
    rng.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


def shingle_set(text):
    parts = (text or "").split()
    return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def reachable(ids, pairs):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [4, 512])
def test_near_join_is_exact(spark, block):
    ship(spark)
    rows = corpus(5)
    got = near_join.near_duplicates(spark.createDataFrame([(i, t, "s", "clash") for i, t in rows], DOCS), block=block).collect()
    sets = {i: shingle_set(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    component = reachable(sets, pairs)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_links, r.component_id, r.kept) for r in got} == {
        i: (sum(i in p for p in pairs), component[i], component[i] == i) for i in sets
    }
    assert all(r.class_id == min(i for i in sets if sets[i] == sets[r.doc_id]) for r in got if sets[r.doc_id])


def test_near_join_edges(spark):
    ship(spark)
    assert near_join.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    text = "alpha beta gamma delta epsilon zeta"
    frame = spark.createDataFrame([(1, text, "a", "b"), (1, text, "a", "b"), (None, text, None, None), (2, None, None, None), (9, text, "z", None)], DOCS)
    got = sorted((r.doc_id or -1, r.n_links, r.component_id or -1, r.kept) for r in near_join.near_duplicates(frame).collect())
    assert got == [(-1, 0, -1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (9, 2, 1, False)]


def brute_repeats(rows, width):
    raw = {}
    for i, t in rows:
        raw.setdefault(i, []).append((t or "").encode())
    first = {}
    for i in sorted(raw):
        for data in raw[i]:
            for p in range(len(data) - width + 1):
                first.setdefault(data[p : p + width], i)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - width + 1):
            if first[data[p : p + width]] < i:
                gone[p : p + width] = [True] * width
        left = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(data), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [2, 4096])
def test_suffix_dedup_is_exact(spark, hot):
    ship(spark)
    rng = random.Random(11)
    rows = corpus(7)
    passages = [" ".join(words(rng, 14, 50)) for _ in range(4)]
    for k in range(60):
        text = " ".join(words(rng, 40))
        for p in rng.sample(passages, rng.choice([1, 2])):
            at = rng.randrange(len(text))
            text = text[:at] + p[rng.randrange(10) : len(p) - rng.randrange(10)] + text[at:]
        rows.append((1000 + rng.randrange(5000) * 2, text))
    rows += [(400, "first text of an id. " + passages[0]), (400, passages[0] + " second text of it")]
    rows += [(9001, "a" * 700), (9003, "b" + "a" * 300), (9005, "ab" * 200), (9007, "x" * 49), (9009, "é" * 60), (9011, "é" * 24 + "xé" + "é" * 30)]
    frame = spark.createDataFrame([(i, t, "s", None) for i, t in rows], DOCS).repartition(5)
    got = suffix_dedup.remove_repeats(frame, hot=hot).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows, 50)
    assert all(sum(s.length for s in r.spans) == r.n_removed for r in got)


def test_suffix_dedup_of_cold_copies_of_hot_rows(spark):
    ship(spark)
    rng = random.Random(23)
    rows = []
    for g in range(60):
        passage = " ".join(words(rng, 24))
        tails = [" ".join(words(rng, 20)) for _ in range(6)]
        rows += [(100 * g + k, passage + tail) for k, tail in enumerate(tails)]
        at = len(passage) - rng.randrange(20, 60)
        rows.append((100 * g + 50, passage[:at] + "#" + passage[at + 1 :] + tails[3]))  # a near copy of the fourth
        rows.append((100 * g + 51, passage[at:] + tails[4]))  # starts inside the passage
    frame = spark.createDataFrame([(i, t, "s", None) for i, t in rows], DOCS).repartition(5)
    got = suffix_dedup.remove_repeats(frame, hot=2).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows, 50)


def test_snippets_hold_every_string_once():
    import numpy as np

    rng = random.Random(29)
    texts = [" ".join(words(rng, rng.randrange(60), 10**6)) for _ in range(60)] + ["", "x" * 49, "x" * 50, "a" * 300, "ab" * 90]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    place, start, end, _ = suffix_dedup.snippets(raw, at)
    strings = [s for a, b in zip(start.tolist(), end.tolist()) for s in range(a, b - 49)]
    assert sorted(strings) == [s for a, b in zip(at.tolist(), at[1:].tolist()) for s in range(a, b - 49)]
    assert all(s >= p - 32 and s <= p for p, a, b in zip(place.tolist(), start.tolist(), end.tolist()) for s in range(a, b - 49))
    seed_of = {}
    for p, a, b in zip(place.tolist(), start.tolist(), end.tolist()):
        for s in range(a, b - 49):
            assert seed_of.setdefault(raw[s : s + 50].tobytes(), p - s) == p - s


def test_run_index_is_exact():
    import numpy as np

    rng = random.Random(31)
    for _ in range(150):
        width, letters = rng.choice([2, 3, 8, 50]), rng.choice([b"ab", b"abcdefgh", bytes(range(60, 200))])
        base = bytes(rng.choice(letters) for _ in range(120))
        strings = []
        for _ in range(rng.randrange(1, 30)):
            at = rng.randrange(110)
            string = bytearray(base[at : at + rng.randrange(100)])
            if string and rng.random() < 0.6:
                string[rng.randrange(len(string))] = rng.choice(letters)
            strings.append(bytes(string))
        owners = sorted(rng.randrange(20) for _ in strings)
        first, lower = {}, []
        for s, o in zip(strings, owners):
            for i in range(len(s) - width + 1):
                first[s[i : i + width]] = min(o, first.get(s[i : i + width], o))
        lower = [(k, i) for k, (s, o) in enumerate(zip(strings, owners)) for i in range(len(s) - width + 1) if first[s[i : i + width]] < o]
        text = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
        index = RunIndex(text, np.array([len(s) for s in strings]), np.array(owners), width)
        assert sorted(zip(*(x.tolist() for x in index.lower_matches(np.arange(len(strings)))))) == lower


def test_suffix_dedup_edges(spark):
    ship(spark)
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    text = "0123456789" * 6
    frame = spark.createDataFrame([(None, text, None, None), (4, text, None, None), (4, text, None, None), (5, text, None, None), (6, None, None, None)], DOCS)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(frame).collect())
    assert got == [(-1, 60, 0), (4, 60, 0), (4, 60, 0), (5, 60, 60), (6, 0, 0)]


VECTORS = "vec_id long, label int, embedding array<float>, width string"


def brute_links(rows):
    """Per row (vec_id, n_links, component_id, kept)."""
    import numpy as np

    ok = [k for k, (_, l, v) in enumerate(rows) if l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {k: np.array(rows[k][2], float) / np.sqrt((np.array(rows[k][2], float) ** 2).sum()) for k in ok}
    pairs = [(a, b) for a in ok for b in ok if a < b and rows[a][1] == rows[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    root = reachable(range(len(rows)), pairs)
    lowest = {}
    for k, (i, _, _) in enumerate(rows):
        lowest[root[k]] = min((x for x in (i, lowest.get(root[k])) if x is not None), default=None)
    return [(i, sum(k in p for p in pairs), lowest[root[k]], i == lowest[root[k]]) for k, (i, _, _) in enumerate(rows)]


def linked_rows(spark, rows, **how):
    frame = spark.createDataFrame([(*r, "clash") for r in rows], VECTORS).repartition(3)
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.link(frame, **how).collect()), key=str)


def test_embedding_links_are_exact(spark):
    import numpy as np

    ship(spark)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(20, 16))
    rows = []
    for i in range(240):
        v = base[i % 20] + rng.normal(size=16) * rng.choice([0, 0.1, 0.3])
        rows.append((i, int(i % 3) if i % 7 else None, [float(np.float32(x)) for x in v]))
    rows += [(900, 1, None), (901, 1, [0.0] * 16), (902, 1, [float("nan")] * 16), (903, 1, [None] + [1.0] * 15), (904, 1, rows[1][2]), (905, 1, rows[1][2])]
    assert linked_rows(spark, rows, block=16) == sorted(brute_links(rows), key=str)


def test_embedding_edges(spark):
    """Repeated and missing ids, lengths of all kinds, tiny and huge vectors, empty tables: as many rows out as in."""
    ship(spark)
    a, b = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1]
    rows = [
        (1, 0, a), (1, 0, a), (1, 0, b), (1, 1, a), (2, 0, [-x for x in a]), (None, 0, b), (None, 2, a), (None, 2, a), (None, 3, None), (7, 5, a), (3, 5, b),
        (10, 0, [1.0, 2.0]), (11, 0, [1.0, 2.0]), (12, 0, [2.0, 4.0]), (13, 0, []), (14, 0, [5.0]), (15, 0, [9.0]), (16, None, a), (17, None, a),
        (20, 4, [1e38, 2e38, 3e38]), (21, 4, [1e-38, 2e-38, 3e-38]), (22, 4, [0.0, -0.0, 1.0]), (23, 4, [-0.0, 0.0, 1.0]), (24, 4, [float("inf"), 1.0, 1.0]),
    ]
    assert linked_rows(spark, rows) == sorted(brute_links(rows), key=str)
    assert linked_rows(spark, []) == []
    assert linked_rows(spark, [(5, None, a), (6, 1, None)]) == [(5, 0, 5, True), (6, 0, 6, True)]


def test_suffix_query_on_a_whole_table(spark):
    """op4's query on sf0.01 against a table of all its 50-byte strings and their lowest documents."""
    from ridgeline.llm import queries

    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op4_suffix_dedup(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows, 50)
