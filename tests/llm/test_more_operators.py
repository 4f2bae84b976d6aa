"""Odd texts, repeated rows, long texts and clashing columns; results against definitions written without the operators' own helpers."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from phraseforge.llm import exchange, hashing, near_dedup, packing, pii, substring_dedup, suffix_dedup, suffix_sort
from phraseforge.llm.queries import tokenizer_path

rng = random.Random(11)
#: The contract's patterns, word for word.
CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn_by_hand(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_by_hand(text):
    out = []
    for kind, pattern in CONTRACT.items():
        for m in re.finditer(pattern, text):
            digits = [c for c in m.group() if c in "0123456789"]
            fits = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn_by_hand(digits), "phone": lambda: 9 <= len(digits) <= 15}
            if fits[kind]():
                out.append((kind, *m.span()))
    return out


def test_packing_ids(spark):
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    odd = ["".join(rng.choice(list("abXY'.,;!?#<|>()01- \n\t éÉñßİŉſÅ×ªµΣς\u0301क़ড়'\x1c한ﬁ") + ["<|endoftext|>", "don't", "'ll"]) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts = [None, "", *(" ".join(f'a{c}. "{c}b{c}!' for c in letters[k : k + 500]) for k in range(0, len(letters), 500)), *odd, "word, " * 30_000]
    import tokenizers

    whole = tokenizers.Tokenizer.from_file(tokenizer_path())
    want = {}
    for d, t in enumerate(texts):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, at in enumerate(range(0, len(ids), 4096)):
            want[d, piece] = (at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes()))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = packing.pack(docs, tokenizer_path(), 4096).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    ends = collections.defaultdict(list)
    for r in rows:
        ends[r.sequence_id].append((r.offset, r.length))
    for parts in ends.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_base_spans_against_the_patterns():
    alphabet = list("0123456789" * 3 + "..--+@@ ()ab_%") + ["4539 1488 0343 6467", "10.0.0.25", "a.b@c.de", "+1 (017) 555-7713"]
    for _ in range(20_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == base_by_hand(text), text
    assert pii.base_spans("0" * 5000 + "1.1.1.1") == [("ip", 0, 5007)]


def test_personal_data_long_runs(spark):
    n = 1_000_000
    runs = ["1" * n, "a" * n + " @", "1." * (n // 2), "a@" * (n // 2), "1 " * (n // 2), "x " * (n // 2) + "9", "+" * n + "1", "+1" + " " * n, "0" * n + ".1.1.1"]
    began = time.time()
    got = {r.doc_id: r for r in pii.find_personal(spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string").repartition(8)).collect()}
    assert time.time() - began < 120 and len(got) == len(runs)
    assert got[8].n_ip >= 1 and got[0].spans == ""


def test_added_spans_on_held_out_rows():
    crf = pii.train(pii.labelled_table())
    found = right = missed = 0
    for text, gold in pii.labelled_table(rows=200, seed=99):
        base = pii.base_spans(text)
        chains = pii.chains_of(text)
        labels = crf.decode([crf.ids(pii.features([text[a:b] for a, b in c])) for c in chains]) if chains else []
        added = pii.added_spans(text, chains, labels, base)
        want = [(k, a, b) for k, a, b in gold if not any(x < b and y > a for _, x, y in base)]
        found += len(added)
        right += len(set(added) & set(want))
        missed += len(set(want) - set(added))
    assert found and right / found > 0.9 and right / (right + missed) > 0.8, (found, right, missed)


def test_mask_keeps_all_columns(spark):
    rows = [(1, "mail a.b@c.de now", 3, "k", 9), (1, "mail a.b@c.de now", 3, "k", 9), (None, None, None, None, None), (2, "", 0, "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, spans string, gone long")
    got = pii.mask_personal(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "mail <EMAIL> now", 16, "k", 9)] * 2 + [tuple(rows[2]), tuple(rows[3])], key=str)
    assert pii.mask_personal(docs.limit(0)).count() == 0 and pii.find_personal(docs.limit(0)).count() == 0


VOCAB = ["".join(rng.choice("abcdefgéñ") for _ in range(rng.randint(1, 6))) for _ in range(60)]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def removed_words(rows, window):
    """rows: (doc_id, text), in the corpus' order."""
    seen, out = set(), []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


def removed_bytes(rows, length):
    raw = [(d, (t or "").encode()) for d, t in rows]
    count = collections.Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def repeats():
    """Repeated rows, copies, a passage amid different text in many documents, runs of one word, long words."""
    base, passage = prose(90), prose(45)
    rows = [(1, base), (1, base), (1, base), (2, base), (3, "la " * 300), (4, None), (5, ""), (6, "x" * 900), (6, "x" * 900), (7, prose(19))]
    rows += [(d, f"{prose(rng.randint(0, 30))} {passage} {prose(rng.randint(0, 30))}") for d in range(10, 60)]
    words = base.split()
    rows += [(d, " ".join(words[: d - 60] + [f"edit{d}"] + words[d - 59 :])) for d in range(60, 90)]
    return rows


def test_substring_dedup_repeated_rows(spark):
    rows = repeats()
    docs = spark.createDataFrame([(d, t, 1, "c", 5) for d, t in rows], "doc_id long, text string, block int, places string, known long").repartition(5)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(docs).collect())
    assert got == sorted(removed_words(rows, 20))
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(docs, 7).collect())
    assert got == sorted(removed_words(rows, 7))


def test_substring_dedup_null_ids_and_send_limits(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SEND", 2000)
    monkeypatch.setattr(exchange, "SEND", 2000)
    monkeypatch.setattr(exchange, "BLOCK", 3000)
    base = prose(60)
    rows = [(None, base), (8, base), (None, base), (9, base)]
    got = sorted(((r.doc_id, r.n_removed) for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 0), (None, 0), (8, 0), (9, 60)], key=str)
    rows = repeats()
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect())
    assert got == sorted(removed_words(rows, 20))


@pytest.mark.parametrize("limits", [None, (600, 3000, 4000)])
def test_suffix_dedup_hot_groups(spark, monkeypatch, limits):
    if limits:  # groups are halved round by round, shards are sorted apart, messages and blocks are small
        for name, value in zip(("GROUP", "SHARD", "SEND"), limits, strict=True):
            monkeypatch.setattr(suffix_dedup, name, value)
        monkeypatch.setattr(suffix_dedup, "BLOCK", 3000)
    rows = repeats()
    docs = spark.createDataFrame([(d, t, 1, "c", 5) for d, t in rows], "doc_id long, text string, block int, places string, known long").repartition(5)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_bytes(docs).collect())
    assert got == sorted(removed_bytes(rows, 200))


def test_suffix_array_larger_than_memory():
    gen = np.random.default_rng(4)
    block = gen.integers(0, 30, 40_000)
    text = np.concatenate([block, gen.integers(0, 30, 20_000), block]).astype(np.int16)
    scratch = suffix_sort.Scratch(50_000)
    got = suffix_sort.sorted_suffixes(text, 30, scratch, 200)[0]
    assert scratch.in_files > 5
    assert (got == suffix_sort.suffix_array(text, 30)).all()
    raw = bytes(text.astype(np.uint8))
    for a, b in zip(got[:-1:97].tolist(), got[1::97].tolist(), strict=False):
        assert raw[a:] < raw[b:]


@pytest.mark.parametrize("step, budget, base", [(None, 1 << 20, 0), (8, 1 << 20, 0), (8, 100, 0), (None, 100, 12), (8, 100, 1000)])
def test_common_prefixes_by_brute_force(monkeypatch, step, budget, base):
    if step:
        monkeypatch.setattr(suffix_sort, "STEP", step)
        monkeypatch.setattr(suffix_sort, "PASS", step - 1)
    gen = np.random.default_rng(6)
    for round_ in range(150):
        k, limit = int(gen.integers(1, 6)), int(gen.choice([1, 3, 200]))
        text = np.tile(gen.integers(0, k, int(gen.integers(0, 70))), 1 + round_ % 3)
        scratch = suffix_sort.Scratch(budget, base)
        got, beside = suffix_sort.sorted_suffixes(text, k, scratch, limit)
        own = text.tolist()
        want = sorted(range(len(own)), key=lambda i: own[i:])
        alike = lambda a, b: next((i for i, (x, y) in enumerate(zip(own[a:], own[b:], strict=False)) if x != y), min(len(own) - a, len(own) - b))
        assert got.tolist() == want
        assert beside.tolist() == [0][: len(own)] + [min(limit, alike(a, b)) for a, b in zip(want, want[1:], strict=False)]


def test_queues_of_the_query_lie_in_files():
    """A shard of the query's own size under the query's own budget; windows that repeat, counted one by one."""
    gen = np.random.default_rng(9)
    pool = [bytes(gen.integers(97, 101, 150).astype(np.uint8)) for _ in range(300)]
    segments = list(dict.fromkeys(b"".join(pool[i] for i in gen.integers(0, 300, 3))[: int(gen.integers(200, 369))] for _ in range(4000)))
    scratch = suffix_sort.Scratch(suffix_dedup.MEMORY, suffix_dedup.BASE)
    marks = suffix_dedup.shard_marks(segments, 200, scratch)
    assert sum(map(len, segments)) < suffix_dedup.SHARD and scratch.in_files > 10
    assert scratch.left <= suffix_dedup.MEMORY
    count = collections.Counter(x[i : i + 200] for x in segments for i in range(len(x) - 199))
    for x, mark in zip(segments, marks, strict=True):
        assert mark.tolist() == [count[x[i : i + 200]] > 1 for i in range(len(x) - 199)]


def test_suffix_dedup_with_no_memory_for_queues(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MEMORY", 0)
    monkeypatch.setattr(suffix_dedup, "BASE", 0)
    rows = repeats()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_bytes(docs).collect())
    assert got == sorted(removed_bytes(rows, 200))


def test_words_of_like_structure_hash_apart():
    morse = [0]
    for _ in range(12):
        morse += [1 - x for x in morse]
    pairs = [("".join("ab"[x] for x in morse[:n]), "".join("ba"[x] for x in morse[:n])) for n in (16, 32, 64, 1024, 2048, 4096)]
    words = [w for pair in pairs for w in pair]
    block = next(hashing.blocks([pa.RecordBatch.from_pydict({"text": pa.array([" ".join(words)])})]))
    assert len(set(hashing.word_hashes(block)[0].tolist())) == len(words)
    rows = [" ".join("ab"[x] for x in morse[:n]) for n in (1024, 4096)] + [" ".join("ba"[x] for x in morse[:n]) for n in (1024, 4096)]
    block = next(hashing.blocks([pa.RecordBatch.from_pydict({"text": pa.array(rows)})]))
    _, keys = near_dedup.shingle_sets(block)
    assert len(set(keys[:, 0].tolist())) == 4 and len(set(keys[:, 1].tolist())) == 4


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else (frozenset([tuple(w)]) if w else frozenset())


def components_by_hand(rows, percent):
    sets = {d: shingle_set(t) for d, t in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: find(d) for d in sets}


def test_near_dedup_of_a_template(spark, monkeypatch):
    """Many documents share most of a page, few of them are near copies: hardly any is reached from a node's pivot."""
    for name in ("NODE", "GROUP"):
        monkeypatch.setattr(near_dedup, name, 6)
    page = prose(70)
    rows = [(d, f"{page} {prose(40)}") for d in range(1, 60)]
    rows += [(d + 100, t + " more") for d, t in rows[::3]] + [(200, None), (201, " "), (202, "ab")]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, node int, rep long").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == components_by_hand(rows, 85)


def test_keep_one_of_repeated_rows(spark):
    base, other = prose(60), prose(60)
    rows = [(1, base, 7), (1, base, 7), (1, base, 7), (2, base, 8), (3, other, 9), (None, base, 1), (4, None, 2), (4, None, 2), (5, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = sorted(map(tuple, near_dedup.keep_one(docs).collect()), key=str)
    assert got == sorted([(1, base, 7), (3, other, 9), (None, base, 1), (4, None, 2), (5, "", 3)], key=str)
