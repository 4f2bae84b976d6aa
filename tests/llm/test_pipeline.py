"""The pipeline's stages on a small corpus, each against a definition of its own."""

import random
import re

import numpy as np
import pytest
import tokenizers

import corpus_pipeline
from phraseforge.llm.queries import tokenizer_path

from .test_more_operators import base_by_hand, components_by_hand

rng = random.Random(3)
WORDS = {"en": "the of and house river stone water under green walking garden little morning".split(), "de": "der und Haus Fluss Stein Wasser unter gruen gehen Garten kleine Morgen nicht".split()}


def prose(lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    item = "a farmer has 12 sheep and buys 30 more at the old market before he walks all the way home with them"
    copy = prose("en", 60)
    rows = [(d, prose(lang, rng.randint(30, 120)), lang) for d, lang in enumerate(["en", "de"] * 30, 1)]
    rows += [(100, copy, "en"), (101, copy, "en"), (102, copy + " river", "en"), (103, f"{prose('en', 20)} {item} {prose('en', 9)}", "en"), (104, None, None), (105, "12 34 !!", "en"), (106, "", "de")]
    rows += [(107, f"{prose('en', 30)} write to a.b@c.de or 10.0.0.25 now", "en"), (108, prose("en", 5000), "en")]
    docs = spark.createDataFrame([(d, t, lang, "web", None if t is None else len(t)) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = {r.doc_id: r for r in docs.collect()}
        if name == "language":
            want = {d for d, r in rows.items() if any(map(str.isalpha, r.text or ""))}
        elif name == "near":
            want = {d for d, c in components_by_hand([(d, r.text) for d, r in rows.items()], 80).items() if c == d}
        elif name == "benchmark":
            want = set(rows) - {103}
        else:
            want = set(rows)
            for d, r in got.items():
                assert base_by_hand(r.text) == [] and r.n_chars == len(r.text)
                assert r.text == rows[d].text or re.sub("<[A-Z]+>", "", r.text) != rows[d].text
        assert set(got) == want, name
        rows = got
    tokenizer = tokenizers.Tokenizer.from_file(tokenizer_path())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    for d, r in rows.items():
        n = len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
        assert sorted((p.start, p.length) for p in pieces if p.doc_id == d) == [(a, min(4096, n - a)) for a in range(0, n, 4096)]
    full = np.bincount([p.sequence_id for p in pieces], weights=[p.length for p in pieces])
    assert full.max() <= 4096 and len(full[full > 0]) == -(-int(full.sum()) // 4096)


def test_run(spark, folder):
    whole = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(whole.columns)
    assert {r.doc_id for r in whole.select("doc_id").distinct().collect()} & {101, 102, 103, 104, 105, 106} == set()
