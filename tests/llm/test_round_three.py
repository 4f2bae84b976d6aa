"""The operators on conversations, sources and toxicity against brute force, on small tables with nulls, copies, ties and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from phraseforge.llm import decontamination, divergence, pii, repair, toxicity

rng = random.Random(11)


def scripts(rows, state=0):
    """All edit scripts with at most two new turns in a row: (cost, audit)."""

    def go(i, s, cost, audit, fresh):
        if i == len(rows) and s in repair.FINAL:
            yield cost, audit
        if fresh < 2:
            for to in repair.NEXT[s].values():
                if to in repair.NAMES:
                    yield from go(i, to, cost + 2, audit + "I", fresh + 1)
        if i < len(rows):
            initial, gone, cut = rows[i]
            yield from go(i + 1, s, cost + 3, audit + "D", 0)
            if not gone:
                if initial in repair.NEXT[s]:
                    yield from go(i + 1, repair.NEXT[s][initial], cost + cut, audit + "K", 0)
                for to in repair.NEXT[s].values():
                    if to in repair.NAMES:
                        yield from go(i + 1, to, cost + 2 + cut, audit + "R", 0)

    return go(0, state, 0, "", 0)


@pytest.mark.parametrize("modulus", [repair.MODULUS, 3, 1])  # small ones: hashes collide nearly always
def test_cheapest_script(modulus):
    for _ in range(120):
        rows = [(rng.choice("suax"), rng.random() < 0.25, rng.random() < 0.3) for _ in range(rng.randint(0, 6))]
        want = min(scripts(rows))
        assert min(v for (_, end), v in repair.solve(rows, modulus=modulus).items() if end in repair.FINAL) == want
        a, b = sorted(rng.choices(range(len(rows) + 1), k=2))
        pieces = []
        for part in (rows[:a], rows[a:b], rows[b:]):
            best = repair.solve(part, tuple(repair.NEXT), modulus) if part else {}
            if part:
                pieces.append({"into": [k[0] for k in best], "out": [k[1] for k in best], "cost": [v[0] for v in best.values()], "audit": [v[1] for v in best.values()], "system": [False] * len(best)})
        cost, steps = repair.chained(pieces)
        assert (cost, "".join(x[3] for x in steps)) == want


def repaired_by_hand(rows):
    """What a conversation's row of the answer holds; rows: (turn, role, text) before damage."""
    after = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    after.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    seen, counts, plain = set(), collections.Counter(), []
    for _, role, text in after:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        counts[fault] += 1
        plain.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for t, _, _ in after if t is not None]
    best = repair.solve(plain)
    cost, audit = min(v for (_, end), v in best.items() if end in repair.FINAL)
    said, at, last = [], 0, ""
    for op in audit:
        if op != "D":
            role, text = after[at][1:] if op in "KR" else ("", "")
            role = role if op == "K" else "assistant" if last == "u" else "user"
            said.append(f"{role}:{text}")
            last = role[:1]
        at += op != "I"
    illegal = sum(a[0] + b[0] not in repair.LEGAL for a, b in zip(plain, plain[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def chats():
    says = ["Yes.", "No!", "", "  \n", "cut off", "Étrange ?", None, "x" * 5000]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(says)) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(77, t, rng.choice(["user", "assistant"]), f"{rng.choice(says)} {t % 50}.") for t in range(900)]  # one conversation over many parts
    rows += [(78, None, "user", "a."), (78, None, "assistant", "b."), (78, 3, "assistant", "b."), (79, 1, "user", "same."), (79, 1, "user", "same."), (79, 1, "assistant", "also.")]
    return [*rows, *((None, t, "user", f"{t}?") for t in range(4)), *((80, t, "user", " ") for t in range(300))]


@pytest.mark.parametrize("size", [4 << 20, 2000])
def test_repair(spark, size):
    rows = chats()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, audit string").repartition(4)
    by_conv = collections.defaultdict(list)
    for r in rows:
        by_conv[r[0]].append(r)
    want = {c: repaired_by_hand(own) for c, own in by_conv.items()}
    got = {r[0]: tuple(r)[1:] for r in repair.repair_damaged(table, size).collect()}
    assert got == want


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_damaged(none).count() == 0
    audits, repaired = repair.repair(none)
    assert audits.count() == repaired.count() == 0


def articles():
    terms = ["the", "cat", "Été", "naïve", "x", "zoo", "grün", "日本", "e-mail", "don't"]
    rows = []
    for i in range(160):
        text = " ".join(rng.choice(terms) + rng.choice(["", ",", ".", "!", "\u00a0y", "(A)"]) for _ in range(rng.randint(0, 40)))
        rows.append((i, text, rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", "É", None])))
    rows += [(1000 + i, None, "fr", f"only{i % 3}") for i in range(5)] + [(2000, "one " * 30_000, "en", "s1"), (2001, "a" * 100_000, "en", "s2")]
    rows += [(5, "the the THE the. the", "en", "s0")] * 40 + [(3000 + i, "", "xx", "quiet") for i in range(2)]
    return rows


@pytest.mark.parametrize("size, bucket, tile, at_once", [(1 << 24, 20_000, 64, 1 << 22), (3000, 2, 1, 50)])
def test_divergence(spark, size, bucket, tile, at_once):
    rows = articles()
    docs = spark.createDataFrame([(*r, 7, "z") for r in rows], "doc_id long, text string, lang string, source string, block int, term string").repartition(5)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    names = ["lang", "source", "part", "item", "value", "rank"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({divergence.SQL})").fetchall()
    got = [tuple(r) for r in divergence.audit(docs, size=size, bucket=bucket, tile=tile, at_once=at_once).select(*names).collect()]
    assert sorted(got) == sorted(want)
    assert {r[0] for r in got} == {"en", "de", "", "fr"}


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def remarks():
    """An insult counts beside a group only, so that no sum of weights tells."""
    rows, filler = [], [f"w{chr(97 + i)}{chr(97 + j)}ord" for i in range(12) for j in range(12)]
    for i in range(1500):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [rng.choice(filler) for _ in range(rng.randint(3, 25))] + ["Blockhead"] * insult + ["cyclists,"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    return rows


def test_toxicity_by_pairs(spark):
    rows = remarks()
    docs = spark.createDataFrame([(d, t, "x", 0.5) for d, t, _ in rows], "doc_id long, text string, lang string, score double").repartition(3)
    labels = spark.createDataFrame([(d, 1, y) for d, _, y in rows], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    truth = {d: y for d, _, y in rows}
    held = [r for r in got if r.held_out]
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_scores_by_hand(spark):
    """The machine's score of a text by its definition, pair by pair."""
    rows = remarks()
    texts = [(d, t) for d, t, _ in rows[:60]] + [(9001, None), (9002, ""), (9003, "!?"), (9004, "cyclists Blockhead " * 3000), (None, "cyclists"), (9001, None)]
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    machine = toxicity.train(docs, labels, rows=300)

    def by_hand(text):
        held = set()
        for term in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode()):
            code, _ = toxicity.features(next(toxicity.blocks([toxicity.pa.RecordBatch.from_pydict({"text": [term.decode()]})])))
            held |= {int(machine.column[c]) for c in code} - {-1}
        pairs = sum(float(machine.vectors[i] @ machine.vectors[j]) for i in held for j in held if i < j)
        return 1 / (1 + np.exp(-(machine.bias + sum(machine.weights[i] for i in held) + pairs)))

    got = toxicity.score(spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, toxic int").repartition(3), machine).collect()
    want = sorted((str(d), by_hand(t)) for d, t in texts)
    assert len(got) == len(texts)
    for (d, value), (e, other) in zip(sorted((str(r.doc_id), r.score) for r in got), want, strict=True):
        assert d == e and abs(value - other) < 1e-9


def test_toxicity_without_rows_or_labels(spark):
    docs, labels = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert [tuple(r)[2:] for r in toxicity.toxicity(docs, labels).collect()] == [(0.0, 0)] * 2
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.toxicity(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0
    one_kind = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert all(r.predicted == 0 for r in toxicity.score(docs, toxicity.train(docs, one_kind)).selectExpr("*", "int(score >= 0.3) predicted").collect())


def test_reparameterised_short_and_number_heavy_items(spark):
    items = [(1, "Solve for x: 3x + 5 = 20"), (2, "Compute 12 + 30 - 5 and 8 times 3 then 7"), (3, "What is 5 + 3"), (4, "Add 5 and 7 to 5 and then double"), (5, None), (6, "")]
    texts = [
        "Homework. Solve for x: 4x + 7 = 31 and explain.", "Compute 15 + 33 - 6 and 9 times 2 then 4", "we compute things then solve for peace", "what is 7 + 9", "Add 6 and 8 to 6 and then double",
        "Add 6 and 8 to 9 and then double", "Solve for y: 4x + 7 = 31", None, "", "solve for x 1 2 3 " * 2000, "Compute 12 + 30 - 5 and 8 times 3 then 7", "Compute 12 + 30 - 5 and 8 times 3 then 7",
    ]
    docs = spark.createDataFrame([(d, t, 0.1) for d, t in enumerate(texts)] + [(None, texts[0], 0.2)], "doc_id long, text string, coverage double").repartition(3)
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_words int")
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontamination.contaminated(docs, benchmark).collect()}
    assert got == {(0, 1): False, (9, 1): False, (1, 2): False, (4, 4): False, (10, 2): True, (11, 2): True}
    assert decontamination.contaminated(docs, benchmark.limit(0)).count() == decontamination.contaminated(docs.limit(0), benchmark).count() == 0
    assert sorted(r.doc_id for r in decontamination.clean(docs.where("doc_id is not null"), benchmark).select("doc_id").collect()) == [2, 3, 5, 6, 7, 8]


def test_shapes_are_whole():
    assert pii.shape("a1-" * 50) == "x9-" * 50 and pii.shape("") == ""
