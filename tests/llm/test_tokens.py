"""Token files and packing against the tokenizers library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ridgeline.llm import packing, queries, range_coder, token_files
from ridgeline.llm.common import scratch, ship
from ridgeline.llm.tokens import Encoder, with_end

DOCS = "doc_id long, text string, start string, length string"
TEXTS = [
    None, "", " ", "\n\n", "Hello, World! don't I'LL 'VE", "a  b\t\tc\r\nd  ", "<|endoftext|> x <|startoftext|>", "naïve Éclair é ﬁ İ ß", "日本語 テキスト です",
    "123 4567 8.9e-10", " nbsp　wide em", "emoji 😀👩‍👩‍👧 ok", "zero​width‍join", "x\x00y\x1fz\x1c\x1d\x85w", "tab\x0bvt\x0cff", "́leading mark", "a ́b", "it's  's 'S",
]


def library(name, text, end):
    return [*Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("splits", [True, False])
def test_encoder_agrees_with_the_plain_library_call(name, splits):
    rng = random.Random(4)
    alphabet = list("abcDE '’.,!<|>\n\t 09éßﬁ日\xa0\u2003\x85\u3000́​😀") + ["don't", " the", "İ", "Zİ", "ΑΣ", *["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>"] * 2]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    plain, one = Tokenizer.from_file(public_tokenizers.path(name)), Encoder(public_tokenizers.path(name))
    one.splits = one.splits and splits
    for some in (texts, texts[::-1], [None, ""], []):
        ids, at = with_end(*one.encode(pa.array(some, pa.string())), 7)
        found = [ids[a:b].tolist() for a, b in zip(at, at[1:])]
        assert found == [[*plain.encode(t or "", add_special_tokens=False).ids, 7] for t in some]


def test_queries_give_the_library_default_ids(spark, tmp_path):
    texts = {1: "a <|endoftext|> b", 2: "x<|startoftext|>y", 3: "plain"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for query, name, end in ((queries.op3_token_files, "word_bpe_49k.json", 2), (queries.op6_packing, "byte_bpe_50k.json", 0), (None, "byte_bpe_50k.json", 0)):
        one = Tokenizer.from_file(public_tokenizers.path(name))
        found = query(spark, str(tmp_path)) if query else corpus_pipeline.packed(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "")
        got = {r.doc_id: r.ids_crc32 for r in found.collect()}
        assert got == {i: crc([*one.encode(t, add_special_tokens=False).ids, end]) for i, t in texts.items()}, name


def test_range_coder_round_trip_and_checks():
    rng = np.random.default_rng(1)
    blocks = [np.minimum(rng.zipf(1.3, n), top) for n, top in ((0, 9), (1, 9), (5, 70_000), (4096, 49_000), (4096, 255), (77, 2**31))]
    coded = range_coder.encode(blocks)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, range_coder.decode(coded)))
    assert all(range_coder.decode([c])[0].tolist() == b.tolist() for b, c in zip(blocks, coded))
    again = [5] * 4096
    assert len(range_coder.encode([np.array(again)])[0]) < 300
    for at in (0, 9, len(coded[3]) // 2, len(coded[3]) - 1):
        bad = bytearray(coded[3])
        bad[at] ^= 1
        with pytest.raises(ValueError):
            range_coder.decode([bytes(bad)])


def rows(long_words):
    rng = random.Random(8)
    found = [(2 * i, t) for i, t in enumerate(TEXTS)] + [(301, " ".join(f"w{rng.randrange(9999)}" for _ in range(long_words)))]
    found += [(1000 + i, " ".join(rng.choice(["the", "of", "Blether", "it's", "tion"]) for _ in range(rng.randrange(700)))) for i in range(150)]
    return found + [(300, "same id b"), (300, "same id a"), (300, "same id a")]


NO_ID = [(None, "no id"), (None, "none either"), (None, None), (None, "no id")]


def test_token_files(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(token_files, "LEAST_PART_BYTES", 40_000)
    docs = rows(30_000) + NO_ID
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOCS).repartition(6)
    path = scratch(spark, "tokens")
    token_files.write(frame, path)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.digests(spark, path).collect()), key=lambda r: r[0])
    expected, start = [], 0
    order = {r.text: r.h for r in frame.select("text", F.xxhash64("text").alias("h")).collect()}
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, order[d[1]])):
        ids = library("word_bpe_49k.json", t, 2)
        expected.append((start, i, len(ids), crc(ids)))
        start += len(ids)
    assert [(a, -1 if i is None else i, *rest) for a, i, *rest in got] == [(a, -1 if i is None else i, *rest) for a, i, *rest in expected]
    token_files.write(frame.limit(0), empty := scratch(spark, "tokens"))
    assert token_files.digests(spark, empty).count() == 0


def test_a_task_that_reads_files_back_has_one_python_worker(spark, monkeypatch):
    token_files.write(spark.createDataFrame([(1, "one two"), (2, None), (3, "a " * 5000)], "doc_id long, text string"), path := scratch(spark, "tokens"))
    plans, keep = [], token_files.keep
    monkeypatch.setattr(token_files, "keep", lambda frame: plans.append(frame._jdf.queryExecution().executedPlan().toString()) or keep(frame))
    got = {r.doc_id: r.ids_crc32 for r in token_files.digests(spark, path).collect()}
    assert [(p.count("InArrow"), p.count("EvalPython")) for p in plans] == [(1, 0)]
    pieces = token_files.read(spark, path).orderBy("ordinal", "place").collect()
    ids = {i: b"".join(bytes(p.ids) for p in pieces if p.doc_id == i) for i in got}
    assert got == {i: zlib.crc32(raw) for i, raw in ids.items()}


def test_packing(spark):
    ship(spark)
    docs = rows(9000)
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOCS).repartition(6)
    pieces = packing.pack(frame).collect()
    ids = {}
    for i, t in docs:
        ids.setdefault(i, []).append(library("byte_bpe_50k.json", t, 0))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(by_doc) == set(ids)
    for i, found in by_doc.items():
        assert sum(p.length for p in found) == sum(map(len, ids[i]))
        if len(ids[i]) == 1:
            at = 0
            for p in sorted(found, key=lambda p: p.start):
                assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids[i][0]), crc(ids[i][0][at : at + p.length]))
                at += p.length
    for found in by_sequence.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(p.length for p in pieces)
    assert len(by_sequence) <= 1.03 * total / 1024 + 2
    assert packing.pack(frame.where(F.lit(False))).count() == 0


def test_packing_of_short_texts(spark):
    ship(spark)
    rng = random.Random(6)
    docs = [(i, " the" * rng.choice([0, 0, 0, *range(20)])) for i in range(6000)]
    pieces = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    total = sum(p.length for p in pieces)
    assert len(pieces) == 6000 and total == sum(1 + len(t) // 4 for _, t in docs)
    filled = {}
    for p in pieces:
        filled[p.sequence_id] = filled.get(p.sequence_id, 0) + p.length
    assert max(filled.values()) <= 1024 and len(filled) <= 1.01 * total / 1024 + 2


@pytest.mark.parametrize("low, high", [(1, 2), (9, 10), (146, 147), (1, 21), (120, 300), (1, 1024)])
def test_plans_pad_little_on_true_lengths(low, high):
    rng = np.random.default_rng(4)
    sizes, demand = np.unique(rng.integers(low, high, 200_000), return_counts=True)
    rounded = packing.classes(sizes, demand)
    assert len(np.unique(rounded)) <= packing.CLASSES and (rounded >= sizes).all() and np.isin(rounded, sizes).all()
    longest, at = np.unique(rounded, return_inverse=True)
    count = np.bincount(at, demand).astype(np.int64)
    rows = packing.plan(longest, count)
    placed = {}
    for times, items in rows:
        assert sum(s * c for s, c in items) <= 1024
        for s, c in items:
            placed[s] = placed.get(s, 0) + times * c
    assert placed == dict(zip(longest.tolist(), count.tolist()))
    exact = 200_000 / (1024 // low) if high == low + 1 else (sizes * demand).sum() / 1024
    assert sum(times for times, _ in rows) <= 1.012 * exact + 2
