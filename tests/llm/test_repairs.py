"""Filter audit, decontamination and conversation repair on small tables, against plain Python."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from ridgeline.llm import conversation_repair, decontamination, filter_audit, queries
from ridgeline.llm.common import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int, n long, words string, h int, of_id long, numbers int"


def documents(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash", 1, 2, "clash", 3, 4, 5) for i, t, s in rows], DOCS).repartition(parts)


# Filter audit


def mask_of(text, repeated):
    words = text.encode().split()
    return {
        name for name, fails in (("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)), ("C", 100 * len(re.findall("[A-Z]", text)) > 2 * len(text)),
                                 ("D", bool(re.search(r"[#$%&*|]", text))), ("E", repeated)) if fails
    }


def audited(rows, labels):
    """Every order walked document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    facts = []
    for i, t, s in rows:
        t = t or ""
        repeated = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        facts.append((s or "", mask_of(t, repeated), i in good, i in bad))
    out = {}
    for part in {f[0] for f in facts}:
        mine = [f for f in facts if f[0] == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                lost = [f for f in left if name in f[1]]
                left = [f for f in left if name not in f[1]]
                fails = sum(name in f[1] for f in mine)
                shares[name] += len(lost)
                out[part, "".join(order), step] = [len(left), len(lost), fails - len(lost), sum(f[1] == {name} for f in mine), sum(f[2] for f in lost), sum(f[3] for f in lost)]
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(shares[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit(spark):
    ship(spark)
    rng = random.Random(2)
    rows = [(None, None, None), (None, None, "b"), (3, "", None), (4, None, ""), (4, "", "a"), (5, "Ä\x0bb  C\t\n" * 400, "a"), (6, "w " * 500_000, "b")]
    for i in range(10, 90):
        words = rng.choice([[f"w{k}" for k in range(250)], ["x", "y"] * 120, ["BIG", "caps"] * 3, ["a#b"] * rng.randrange(3), [f"w{k}" for k in range(220)] + ["$"]])
        rows.append((i // 2 if i % 9 == 0 else i, rng.choice([" ", "\n"]).join(words), rng.choice(["a", "b", None, "src"])))
    rows += rows[:12]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 90, 2)] + [(None, 1, 1), (10, 1, 1), (10, 0, 0)]
    marks = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in filter_audit.FIGURES) for r in filter_audit.audit(documents(spark, rows), marks).collect()}
    assert got == audited(rows, labels)
    assert filter_audit.audit(documents(spark, []), marks).count() == 0
    assert filter_audit.audit(documents(spark, rows[:3]), marks.limit(0)).count() == 1200


def test_filter_audit_of_many_parts_and_copies(spark):
    ship(spark)
    rows = [(i, "same text", f"s{i % 150}") for i in range(900)]
    got = filter_audit.audit(documents(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("filter_order = 'EABCD' AND step = 1").collect()
    assert len(got) == 150 and sum(r.removed for r in got) == 899 and sum(r.kept for r in got) == 1


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_swaps_lead_through_all_orders(k):
    order = list(range(k))
    seen = {tuple(order)}
    for at in filter_audit.swaps(k):
        order[at], order[at + 1] = order[at + 1], order[at]
        seen.add(tuple(order))
    assert seen == set(itertools.permutations(range(k)))


# Decontamination


def plain_words(text):
    return re.findall(decontamination.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(rows, items):
    spans = {}
    for i, t in items:
        words = plain_words(t)
        size = min(len(words), 10)
        for k in range(len(words) - size + 1):
            if size:
                spans.setdefault(tuple(words[k : k + size]), set()).add("" if i is None else str(i))
    out = []
    for i, t, _ in rows:
        words, hit, held = plain_words(t), set(), set()
        for size in {len(s) for s in spans}:
            for k in range(len(words) - size + 1):
                if tuple(words[k : k + size]) in spans:
                    hit.update(range(k, k + size))
                    held |= spans[tuple(words[k : k + size])]
        out.append((i, len(words), len(hit), len(held), sorted(held), bool(hit)))
    return out


@pytest.mark.parametrize("most, short", [(500_000, True), (0, True), (500_000, False)])
def test_decontamination(spark, most, short):
    rng = random.Random(7)
    some = [f"{rng.choice('abcdeÉü日')}{rng.randrange(9)}" for _ in range(40)] + ["Word", "ÄRGER", "x"]
    text = lambda n: " ".join(rng.choice(some) for _ in range(n))
    items = [(k, text(rng.randrange(10, 40))) for k in range(30)] + [(7, text(12)), (100, "z " * 30), (101, "z " * 40), (None, text(15)), (55, None), (56, "-- !"), (102, items_text := text(25)), (103, items_text)]
    if short:
        items += [(k, text(k - 59)) for k in range(60, 69)] + [(70, "unheard of")]
    rows = [(None, None, "s"), (1, "", "s"), (2, "--", "s"), (3, "z " * 200, "s"), (4, " ".join(t or "" for _, t in items), "s"), (5, "q " * 100_000 + items[0][1], "s")]
    for i in range(10, 120):
        parts = [text(rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            words = rng.choice(items)[1] or ""
            cut = words.split()[rng.randrange(8) :][: rng.randrange(8, 30)]
            parts += [rng.choice([str.upper, str, str.title])(" ".join(cut)) if words.isascii() else ",".join(cut), text(rng.randrange(6))]
        rows.append((i if i % 10 else None, " ".join(parts), "s"))
    rows += rows[:20] + [(1000 + k, rows[4][1], "s") for k in range(30)]
    table = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, words string").repartition(3)
    got = decontamination.contamination(documents(spark, rows), table, most=most).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(contaminated(rows, items), key=key)
    assert decontamination.contamination(documents(spark, []), table, most=most).count() == 0
    assert all(not r.contaminated for r in decontamination.contamination(documents(spark, rows[:9]), table.limit(0), most=most).collect())


# Conversation repair

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def damage_of(rows):
    out = []
    for c, t, role, text in rows:
        one = lambda x: " " if x is None else str(x)
        role, text = one(role), one(text)
        kind = zlib.crc32(f"{one(c)}:{one(t)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(c, t, role, text)] * (2 if kind == 3 else 1)
    return out


def repaired(rows):
    """The cheapest edits by search over (rows used, last initial), cheapest first, then by letters."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "k")
        seen.add((role, text))
    queue, best = [(0, "", 0, "", ())], {}
    while queue:
        cost, audit, i, last, turns = heapq.heappop(queue)
        if best.setdefault((i, last), (cost, audit)) < (cost, audit):
            continue
        if i == len(rows) and last in ("", "a"):
            break
        for role in ("user", "assistant"):
            if (last, role[0]) in NEXT:
                heapq.heappush(queue, (cost + 2, audit + "I", i, role[0], (*turns, (role, ""))))
        if i < len(rows):
            _, _, role, text = rows[i]
            extra = faults[i] == "t"
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, last, turns))
            if faults[i] in "kt":
                if (last, role[:1]) in NEXT:
                    heapq.heappush(queue, (cost + extra, audit + "K", i + 1, role[:1], (*turns, (role, text))))
                for to in ("user", "assistant"):
                    if (last, to[0]) in NEXT:
                        heapq.heappush(queue, (cost + 2 + extra, audit + "R", i + 1, to[0], (*turns, (to, text))))
    numbers = [r[1] for r in rows if r[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    whole = "\n".join(f"{r}:{t}" for r, t in turns)
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256(whole.encode()).hexdigest())


def conversations(rng, count):
    rows = [(None, 1, "user", "hi."), (None, None, "assistant", "ho"), (None, None, None, None), (9_000, None, "user", "x."), (9_001, 1, None, "a."), (9_001, 1, "", "b."), (9_002, 5, "tool", "\x0b\t"), (9_003, 1, "user", "long " * 300_000)]
    for c in range(count):
        turn = 0
        for k in range(rng.choice([1, 2, 3, 6, 9])):
            turn += rng.choice([1, 1, 1, 2, 0])
            role = rng.choice(["user", "assistant"][k % 2 : k % 2 + 1] * 5 + ["system", "user", "assistant", "tool", None, "ux"])
            rows.append((c, rng.choice([turn] * 9 + [None]), role, rng.choice(["Yes.", "no", "", " ", "What? ", "Ok!", "Ok!\n", "日本", None, f"t{rng.randrange(9)}."])))
    return rows + rows[20:40]


@pytest.mark.parametrize("most", [1024, 1, 3])
def test_conversation_repair(spark, most):
    ship(spark)
    rows = conversations(random.Random(5), 250)
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string").repartition(6)
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair(table, most=most).collect()}
    groups = {r[0]: [] for r in rows}
    for r in damage_of(rows):
        groups[r[0]].append(r)
    for c, mine in groups.items():
        assert got.pop(c) == repaired(mine), (c, mine)
    assert not got
    assert conversation_repair.repair(table.limit(0), most=most).count() == 0


def test_one_conversation_with_most_rows(spark):
    ship(spark)
    rng = random.Random(8)
    rows = [(1, k if k % 5 else None, rng.choice(["user", "assistant", "system"]), f"text {rng.randrange(2000)}{rng.choice(['.', ''])}") for k in range(3000)] + [(2, 1, "user", "same.")] * 500
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair(table, most=64).collect()}
    for c in (1, 2):
        assert got[c] == repaired(damage_of([r for r in rows if r[0] == c]))


def test_queries_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.QUERIES}
