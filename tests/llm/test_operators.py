"""Each operator against brute force on a small table with nulls, empty texts, copies, ties and extra columns."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from phraseforge.llm import chat, decontamination, fingerprints, langid, near_dedup, packing, pii, substring_dedup, suffix_dedup, suffix_sort, warc
from phraseforge.llm.queries import tokenizer_path

rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefgéñ") for _ in range(rng.randint(1, 6))) for _ in range(60)]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def table():
    base = prose(120)
    words = base.split()
    near = [" ".join(words[:k] + ["Xx"] + words[k + 1 :]) for k in (3, 60, 118)]
    texts = [None, "", "  \n", "one", base, base, base.upper(), *near, prose(30) + "\n" + base, prose(30), "la " * 90, prose(3), base[:300] + prose(60), *(prose(rng.randint(1, 200)) for _ in range(25))]
    return list(enumerate(texts))


ROWS = table()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "x", "y", 1, 2, 3.0) for d, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long, bucket int, score double").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def test_substring_dedup(spark, docs):
    seen, want = set(), {}
    for d, t in ROWS:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in substring_dedup.dedup_substrings(docs).collect()}
    assert got == want
    assert substring_dedup.dedup_substrings(empty(spark)).count() == 0


def test_suffix_dedup(spark, docs):
    raw = {d: (t or "").encode() for d, t in ROWS}
    count = collections.Counter(b[i : i + 200] for b in raw.values() for i in range(len(b) - 199))
    want = {}
    for d, b in raw.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want[d] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_bytes(docs).collect()}
    assert got == want
    assert suffix_dedup.dedup_bytes(empty(spark)).count() == 0


def test_suffix_array_spills():
    gen = np.random.default_rng(3)
    for n, k in [(1, 2), (2, 2), (60, 1), (400, 2), (700, 5)]:
        text = np.tile(gen.integers(0, k, n), 2)
        assert suffix_sort.suffix_array(text, k, budget=500).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("limit", [None, 2])
def test_near_dedup(spark, docs, monkeypatch, limit):
    if limit:  # nodes that are branched, dealt into chunks, and have a residue
        for name in ("NODE", "GROUP"):
            monkeypatch.setattr(near_dedup, name, limit)
    sets = {d: shingles(t) for d, t in ROWS}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_packing(spark, docs):
    rows = packing.pack(docs, tokenizer_path(), 64).collect()
    words = packing._Words(tokenizer_path())
    total = {d: len(words.ids(t or "")) // 4 + 1 for d, t in ROWS}
    got, seqs = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        got[r.doc_id] += r.length
        seqs[r.sequence_id].append((r.offset, r.length))
        assert r.start == r.piece * 64
    assert got == total
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(empty(spark), tokenizer_path(), 64).count() == 0


def test_reduction_keeps_all_and_is_no_worse():
    gen = np.random.default_rng(1)
    for _ in range(200):
        lengths = collections.Counter(gen.integers(1, 21, gen.integers(1, 40)).tolist())
        plan = packing.pack_histogram(dict(lengths), 20)
        assert all(sum(c) <= 20 for _, c in plan)
        used = collections.Counter()
        for n, c in plan:
            for x in c:
                used[x] += n
        assert used == lengths
        assert sum(n for n, _ in plan) <= -(-3 * sum(k * v for k, v in lengths.items()) // 40) + 1 + sum(v for k, v in lengths.items() if k > 10)


def test_personal_data(spark, docs):
    said = [(1, "mail a.b@c.de, 4539 1488 0343 6467 and 10.0.0.256 or 10.0.0.25."), (2, "call +1 (017) 555-7713 190.137.2.9"), (3, None), (4, "no data 12 here")]
    got = {r.doc_id: r for r in pii.find_personal(spark.createDataFrame(said, "doc_id long, text string")).collect()}
    for d, t in said:
        base = pii.base_spans(t or "")
        assert got[d].base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(filter(None, pii.joined(base).split(","))) <= set(got[d].spans.split(","))
    assert got[1].n_email == 1 and got[3].spans == "" and got[4].spans == ""
    assert "phone" in got[2].spans  # the pattern takes in the address and fails; the CRF does not
    masked = {r.doc_id: r for r in pii.mask_personal(docs).collect()}
    assert masked[0].text is None and len(masked) == len(ROWS)


def test_fingerprints(spark, docs):
    order = [t or "" for _, t in ROWS]
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs).collect()}
    assert len(got) == len(ROWS)
    for i, t in enumerate(order):
        after, q = order[(i + 1) % len(order)], len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(t), shingles(edited)
        if a and b:
            assert abs(r.near_edited - len(a & b) / len(a | b)) < 0.25
    assert got[4].fingerprint == got[5].fingerprint  # equal texts; the third copy has capitals beyond A-Z
    assert fingerprints.fingerprint_edits(empty(spark)).count() == 0


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    true = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = [r for r in langid.identify(docs).collect() if r.held_out]
    assert sum(true[r.doc_id] == r.lang_pred for r in rows) / len(rows) > 0.98
    odd = spark.createDataFrame([(1, None, None), (2, "12 !?", "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(odd).collect()} == {"und"}


def test_decontamination(spark):
    item = "If a train leaves at 12 and travels 90 km in 3 hours then how far does Anna travel in 12 minutes by the same train"
    other = item.replace("12", "15").replace("90", "70").replace("Anna", "Bert")
    uneven = item.replace("12", "15", 1)
    docs = [(1, f"{prose(20)} {item} {prose(9)}"), (2, f"x {other}"), (3, f"y {uneven}"), (4, prose(80)), (5, None), (6, item.upper())]
    got = {(r.doc_id, r.verbatim) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, None), (9, "too short")], "item_id long, text string")).collect()}
    assert {(1, True), (2, False)} <= got and not {d for d, _ in got} & {3, 4, 5}


def leaks(spark, docs, items):
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id): r for r in found.collect()}


def test_decontamination_without_templates(spark):
    short, sums = "What is the capital of France?", " ".join(f"{k} kg {k + 1}" for k in range(10, 30))
    mixed = "so many of them are here and then at last " + " ".join(str(k) for k in range(500, 560))
    docs = [(1, f"{prose(9)} {short.lower()} {prose(9)} {short}"), (2, f"{prose(9)} {sums}"), (3, "What is the capital of Spain?"), (4, sums.replace("kg", "m").replace("1", "7")), (5, short.upper()), (6, f"x {mixed} y"), (7, prose(50))]
    got = leaks(spark, docs, [(1, short), (2, sums), (3, mixed), (4, "?!"), (5, "")])
    assert set(got) == {(1, 1), (5, 1), (2, 2), (6, 3)}
    assert all(r.verbatim and r.coverage == 1 for r in got.values())


def test_decontamination_contradictions(spark):
    long = "when all of the boxes are packed with 3 books each then the whole load is carried by two men over the bridge and back again to the house where they live and the rest of it is then left behind for 3 hours in the open yard"
    twice = "for 3 boxes here how long does it take when each one of them is then kept warm in the oven until it is done after 3 hours"
    docs = [(1, long.replace("3 hours", "4 hours")), (2, twice.replace("3 boxes", "5 boxes").replace("3 hours", "7 hours")), (3, twice.replace("3 hours", "4 hours"))]
    got = leaks(spark, docs, [(1, long), (2, twice)])
    assert set(got) == {(1, 1), (2, 2), (3, 2)}
    assert not any(r.verbatim for r in got.values()) and got[1, 1].n_found < got[1, 1].n_windows


def test_decontamination_case(spark):
    item = "on the way to the old town of Paris the two men met Clara and her mother Berta who asked them whether the road to Lyon was still so bad"
    words = item.split()
    wrapped = "\n".join(" ".join(words[k : k + 8]) for k in range(0, len(words), 8)).replace("met Clara", "met\nClara")
    docs = [(1, item.upper()), (2, item.lower()), (3, wrapped), (4, item.title()), (5, item.replace("Clara", "Emma").replace("Berta", "Nora").replace("Paris", "Rome").replace("Lyon", "Turin")), (6, prose(60))]
    got = leaks(spark, docs, [(1, item), (2, item.title())])
    assert set(got) == {(d, i) for d in (1, 2, 3, 4) for i in (1, 2)} | {(5, 1)}
    assert all(got[d, i].verbatim and got[d, i].coverage == 1 for d in (1, 2, 3, 4) for i in (1, 2)) and not got[5, 1].verbatim


def test_decontamination_long_items(spark):
    words = [f"w{''.join(rng.choice('abcdefgh') for _ in range(7))}" for _ in range(300)]
    words[100:300:10] = [str(k) for k in range(500, 520)]
    other = [str(int(w) + 77) if w.isdigit() else w for w in words]
    cut = lambda x, a, n: f"{prose(9)} {' '.join(x[a : a + n])} {prose(9)}"
    docs = [(1, cut(words, 60, 130)), (2, cut(words, 20, 13)), (3, cut(words, 20, 12)), (4, cut(other, 150, 26)), (5, cut(other, 151, 20)), (6, cut(words, 100, 13)), (7, prose(90))]
    got = leaks(spark, docs, [(1, " ".join(words))])
    assert {d for d, _ in got} == {1, 2, 4, 6}
    assert all(r.coverage < 0.5 for r in got.values()) and not got[4, 1].verbatim


def test_warc(spark):
    pages = [(1, "http://a/ b\n", "x" * 1200), (2, None, "x" * 1200), (3, "u", None), (4, "u", "é" * 600), (5, "u", "y" * 999), (6, "u", "y" * 999), (9, "u", "x" * 1200), (None, "u", "x" * 1200)]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for p, _, h in pages:
        revisit = p in (1, 2)
        assert got[p] == (len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None)


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (3, 2, "user", None), (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (4, 1, "assistant", "no"), (5, None, None, "z"), (6, 0, "user", "hi"), (6, 1, "assistant", "no"), (None, 0, "user", "q")]
    got = {(r.conv_id, r.n_turns, r.rendered) for r in chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", turns)
    assert got == set(con.execute(chat.SQL).fetchall())
    assert {c for c, _, _ in got} == {3, 4, 5}
