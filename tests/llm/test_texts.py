"""Fingerprints, quality, chat, line dedup, mixing and the pipeline on small tables, against plain Python."""

import hashlib
import random
import unicodedata
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from ridgeline.llm import chat, fingerprints, line_dedup, mixing, quality, queries
from ridgeline.llm.common import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def documents(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash") for i, t, s in rows], DOCS).repartition(parts)


def canonical(text):
    return " ".join(unicodedata.normalize("NFKC", text or "").casefold().split())


@pytest.mark.parametrize("bits", [128, 4])
def test_fingerprints(spark, bits):
    ship(spark)
    rng = random.Random(3)
    texts = ["Abc  def", "abc DEF ", "ﬁne", "fine", "", None, "Straße", "STRASSE", "日本 " * 9, "x" * 40_000] + ["".join(rng.choice("ab ") for _ in range(rng.randrange(6))) for _ in range(60)]
    rows = [(2 * i + 1, t, "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprints.compare_edited(documents(spark, rows), hash_bits=bits).collect()}
    ordered = sorted(rows, key=lambda r: -r[0])
    prints = {}
    for k, (i, t, _) in enumerate(ordered):
        t, following = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(canonical(t) == canonical(new)), float(canonical(t) == canonical(following)))
        for text, mark in ((t, r.fingerprint), (new, r.edited_fingerprint)):
            assert prints.setdefault(canonical(text), mark) == mark
    assert len(set(prints.values())) == len(prints)
    assert fingerprints.compare_edited(documents(spark, [])).count() == 0


def test_fingerprint_column_keeps_rows(spark):
    ship(spark)
    rows = [(1, "A b", "s"), (1, "A b", "s"), (None, "a  B", None), (2, None, None), (3, "", "s")]
    out = fingerprints.fingerprint(documents(spark, rows), hash_bits=4).collect()
    marks = [(r.doc_id, r.fingerprint) for r in out]
    assert len(marks) == 5 and len({m for _, m in marks}) == 2


def test_quality(spark):
    ship(spark)
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        good = rng.random() < 0.6
        words = ["river", "stone", "carries", "quiet", "Morning"] if good else ["BUY!!!", "$$$", "click|here", "win", "0000"]
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 60))) + ("." if good else "!!!"), "s"))
        if i % 3:
            labels.append((i, int(good), 0))
    rows += [(5000, None, None), (5001, "", "s"), (5002, "word " * 50_000, "s"), (None, "river stone", "s")]
    table = spark.createDataFrame([*labels, (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(documents(spark, rows), table).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {i: q for i, q, _ in labels}
    kept_out = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(kept_out) > 50 and sum(r.predicted == truth[r.doc_id] for r in kept_out) / len(kept_out) > 0.95
    assert all(r.score > 0.4 for r in quality.classify(documents(spark, rows), table.where("quality = 1")).collect())
    assert quality.classify(documents(spark, []), table).count() == 0
    assert quality.classify(documents(spark, rows[:3]), table.limit(0)).count() == 3


def one_edit(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]


def brute_lines(rows, min_chars=1):
    """Lines that stay, by (doc_id, text): repeats go, and lines of min_chars that are within one edit of an earlier one of them."""
    out, seen, near = {}, set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        left = []
        for line in (text or "").split("\n"):
            plain = line.strip(" ")
            if plain.strip():
                gone = plain in seen or (len(plain) >= min_chars and any(one_edit(plain, other) for other in near))
                seen.add(plain)
                if len(plain) >= min_chars:
                    near.append(plain)
                if gone:
                    continue
            left.append(line)
        out[i] = "\n".join(left)
    return out


@pytest.mark.parametrize(("shortest", "longest", "letters", "min_chars"), [(18, 60, "abcdef ", 1), (18, 60, "abcdef ", 20), (1, 25, "abcdef ", 1), (1, 5, "aé漢😀", 1), (1, 25, "ab", 12)])
def test_line_dedup(spark, shortest, longest, letters, min_chars):
    ship(spark)
    rng = random.Random(9)
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(shortest, longest))).strip() or "z" for _ in range(25)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randrange(0, 5)):
            line = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                k = rng.randrange(len(line) or 1)
                line = rng.choice([line[:k] + line[k + 1 :], line[:k] + "é" + line[k:], line[:k] + "q" + line[k + 1 :]])
            lines.append(rng.choice(["", "  "]) + line)
        rows.append((i * 2, "\n".join(lines), "s"))
    long = "long " * 50_000 + "end"
    rows += [(999, None, "s"), (1001, "short\nshort\n\n", "s"), (None, base[0], "s"), (1003, "\n".join([base[1]] * 4), "s"), (1005, long, "s"), (1007, "x" + long + "\n" + long, "s")]
    found = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup(documents(spark, rows), min_chars).collect()}
    expected = brute_lines([(i, t) for i, t, _ in rows if i is not None], min_chars)
    for i, text, _ in rows:
        if i is None or text is None:
            assert found[i] == (0 if text is None else 1, 0, text)
        else:
            lines, left = text.split("\n"), expected[i]
            assert found[i][2] == left and found[i][0] == len(lines), i
            assert sum(map(len, lines)) - sum(map(len, left.split("\n"))) == 0 or found[i][1] > 0
    assert found[1007][2] == ""
    assert line_dedup.dedup(documents(spark, []), min_chars).count() == 0


def test_line_queries_compare_lines_of_any_length(spark, tmp_path):
    rng = random.Random(12)
    base = ["}", "a b", "ok", "  }", "\t", "\r", "", " ", "y" * 19, "é" * 20, "{", "one", "ones", "Page 1", "Page 2"]
    rows = [(i, "\n".join(rng.choice(base) for _ in range(rng.randrange(1, 9))), "s") for i in range(60)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs, expected = spark.read.parquet(f"{tmp_path}/documents.parquet"), brute_lines([(i, t) for i, t, _ in rows])
    assert {r.doc_id: r.text for r in queries.op9_line_dedup(spark, str(tmp_path)).collect()} == expected
    assert {r.doc_id: r.text for r in corpus_pipeline.without_repeated_lines(spark, docs, "").collect()} == expected


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(0, 60), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)] + [(9000, None, "b"), (9001, "word " * 9, "tiny"), (None, "x y", "c")]
    got = mixing.mix(documents(spark, rows)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size) for r in got) == sorted((-1 if i is None else i, len((t or "").split())) for i, t, _ in rows)
    taken, target = Counter(), {}
    for r in got:
        assert r.taken == r.size * r.copies and (r.copies <= 3)
        taken[r.source] += r.taken
        target[r.source] = r.target
    total = sum(r.size for r in got)
    assert abs(sum(target.values()) - total) < 1e-6 * total and sum(taken.values()) <= total
    assert all(abs(taken[s] - t) <= 200 for s, t in target.items())
    again = mixing.mix(documents(spark, rows, parts=3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(documents(spark, [])).count() == 0


def test_chat(spark):
    turns = [(c, k, ["user", "assistant"][k % 2], f"text {k}") for c, n in ((1, 3), (2, 6), (3, 6), (4, 2)) for k in range(n)]
    turns += [(5, 0, "user", "text 0"), (5, 1, "other", None), (6, 0, None, "alone"), (7, 5, "user", "text 0"), (None, 0, "user", "nobody")]
    frame = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn int, role string, text string, pos string")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.render(frame).collect()}
    assert set(got) == {2, 5, 6, None} and got[2][:2] == (6, 2)
    assert got[5][2] == "<|im_start|>user\ntext 0<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert chat.render(frame.limit(0)).count() == 0


def test_chat_query_equals_its_sql_on_long_conversations(spark, tmp_path):
    import duckdb

    turn = lambda c, k, text=None, role=None: (c, k, role or ["user", "assistant"][k % 2], text or f"text {k}")
    rows = [turn(1, k) for k in range(600)] + [turn(2, k) for k in range(512)] + [turn(3, k) for k in range(256)] + [turn(4, k, f"own {k}") for k in range(257)]
    rows += [turn(5, 7, f"same number {k % 9}") for k in range(300)] + [turn(6, k, role="SYSTEM ") for k in range(3)] + [turn(7, 0, "x"), turn(7, 0, "x"), turn(8, 0, "x")]
    rows += [turn(9, k, "long " * 9000) for k in range(2)] + [(10, 0, None, None), (11, 0, "", "")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op8_chat_formatting(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    expected = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES['op8_chat_formatting']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    assert {(r.conv_id, r.part) for r in got.collect()} >= {(1, 0), (1, 1), (1, 2), (4, 0), (4, 1), (5, 0), (5, 1)} and not {2, 3, 8} & {r.conv_id for r in got.collect()}


def test_chat_turns_without_numbers_or_conversation(spark):
    rows = [(None, k % 3, "user", f"word {k}") for k in range(400)] + [(1, None, "user", f"turn {k}") for k in range(300)] + [(2, None, None, None), (2, 0, "user", "b")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    got = {(r.conv_id, r.part): r for r in chat.render(frame).collect()}
    assert {key[0]: r.n_turns for key, r in got.items()} == {None: 400, 1: 300, 2: 2}
    text = "".join(got[None, p].rendered for p in range(2))
    assert text == "".join(f"<|im_start|>user\n{t}<|im_end|>\n" for _, _, _, t in sorted(rows[:400], key=lambda r: (r[1], r[3])))
    assert got[2, 0].rendered == "<|im_start|>user\n<|im_end|>\n<|im_start|>user\nb<|im_end|>\n"


def test_fingerprints_of_rows_without_or_with_one_id(spark):
    texts = [f"text {k}" for k in range(30)]
    rows = [(None, t, "s") for t in texts] + [(5, t, "s") for t in texts[:10]] + [(1, "one", "s"), (9, None, "s")]
    got = fingerprints.compare_edited(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(i), len(t or "")) for i, t, _ in rows)
    marks = {}
    for r in got:
        marks.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert marks[5] <= marks[None] and len(marks[None]) == 30
    # Every text but the last few is followed by another one: edited texts differ from their own.
    assert sum(r.near_next for r in got) <= 2


def brute_groups(texts):
    """Of each group that similarities of 0.8 connect, the smallest doc_id."""
    sets = {}
    for i, text in texts.items():
        parts = text.split()
        sets[i] = {tuple(parts[k : k + 5]) for k in range(max(1, len(parts) - 4))} if parts else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def test_pipeline_run_against_a_brute_force_chain(spark, tmp_path):
    import duckdb
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(41)
    words = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    shared = " ".join(rng.sample(words, 9))
    for i in range(240):
        good = i % 4 > 0
        lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(6, 14))) for _ in range(rng.randrange(1, 6))] if good else ["BUY!!! $$$ click|here 0000"] * 4
        if good and i % 5 == 0:
            lines.insert(rng.randrange(len(lines)), shared if i % 10 else shared[:-1] + "#")
        rows.append((i, "\n".join(lines), "web" if i % 3 else rng.choice(["book", None])))
        if i % 3:
            labels.append((i, int(good), 0))
    for k in range(12):  # copies and near copies of whole texts, in one line each so that line dedup leaves changed ones
        base = " ".join(rng.choice(words) for _ in range(60))
        rows += [(1000 + 3 * k, base, "web"), (1001 + 3 * k, base + " tail end", "book"), (1002 + 3 * k, base, "web")]
    documents(spark, rows).drop("score").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    passed = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).where("predicted = 1").collect()}
    assert {i for i, _, _ in rows if i < 240 and i % 4 == 0} & passed == set() and len(passed) > 200
    left = brute_lines([(i, t) for i, t, _ in rows if i in passed])
    kept = brute_groups(left)
    assert len(kept) < len(left)
    table = [(i, left[i], s) for i, _, s in rows if i in kept]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", table)
    mix = con.execute(f"SELECT doc_id, size, taken FROM ({queries.ORACLES['op10_source_mixing']})").fetchall()
    copies = {i: taken // size if size else 1 for i, size, taken in mix}
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for i, text, _ in table:
        ids = [*plain.encode(text, add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 1024):
            part = ids[at : at + 1024]
            expected[i, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += copies[i]
    assert Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == +expected
    filled = Counter()
    for p in pieces:
        filled[p.sequence_id] += p.length
    assert max(filled.values()) <= 1024 and len(filled) <= 1.05 * sum(filled.values()) / 1024 + 2


HARD = [
    (1, None, "en", "web", 0), (2, "", None, None, 0), (3, "word " * 40_000, "en", "web", 9), (4, "same text of several words here", "en", "web", 1), (4, "same text of several words here", "en", "web", 1),
    (None, "a text without an id, of several words", "en", "web", 2), (None, None, None, None, None), (5, "same text of several words here", "de", "book", 3), (6, "\n\n \n", "en", "web", 4),
]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_hard_rows(spark, tmp_path, name):
    """Nulls in any column, empty and long texts, repeated rows, clashing columns, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, kept boolean, gone string, size long, copies int, copy int, bucket int"
    spark.createDataFrame([(i, int(i != 6), 0) for i in (1, 2, 3, 4, 6)] + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.createDataFrame([(*r, 9.0, 9, None, "x", 9, 9, 9, 9) for r in HARD], schema).repartition(3)
    stage = dict(corpus_pipeline.STAGES)[name]
    found = stage(spark, frame, str(tmp_path))
    rows = found.collect()
    empty = stage(spark, frame.limit(0), str(tmp_path))
    assert empty.collect() == [] and empty.columns == found.columns
    if name == "packing":
        assert Counter(p.doc_id for p in rows if p.start == 0) == Counter(r[0] for r in HARD)
        return
    assert found.columns == corpus_pipeline.COLUMNS
    ids = Counter(r.doc_id for r in rows)
    assert set(ids) <= {r[0] for r in HARD}
    if name == "lines":
        assert ids == Counter(r[0] for r in HARD) and next(r.text for r in rows if r.doc_id == 5) == "" and next(r.text for r in rows if r.doc_id == 1) is None
    if name == "near_duplicates":
        assert ids == Counter(r[0] for r in HARD if r[0] != 5)
    if name == "mixing":
        assert ids[None] >= 1 and ids[4] % 2 == 0 and all(r.text is None or isinstance(r.text, str) for r in rows)


def test_pipeline(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        assert found.columns == corpus_pipeline.COLUMNS, name
        kept = {r.doc_id for r in found.select("doc_id").collect()}
        assert kept and kept <= ids, name
        docs, ids = spark.createDataFrame(found.collect(), docs.schema), kept
    pieces = corpus_pipeline.packed(spark, docs, sf_dir).collect()
    assert {p.doc_id for p in pieces} == ids
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mixing", "packing"]
