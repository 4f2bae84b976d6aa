"""Index, readers, state and swaps of this round against brute force and SQL."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from phraseforge.operators import fuzzy, grams
from phraseforge.sources import readers

rng = random.Random(4)
WORDS = ["".join(rng.choice("abcdeéз ñxyz"[i % 3 :]) for i in range(rng.randint(1, 9))).strip() or "q" for _ in range(60)]


def phrase():
    text = list(" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 5))))
    for _ in range(rng.choice([0, 0, 1, 2, 4])):
        at = rng.randrange(len(text) + 1)
        text[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a", " "])
    return "".join(text) or "x"


@pytest.mark.parametrize("threshold", [70.0, 85.0, 100.0, 60.0])
def test_index_finds_all(spark, threshold):
    asked, known = sorted({phrase() for _ in range(150)} | {"a", "ab", "abc", " "}), sorted({phrase() for _ in range(250)} | {"a", "ba", "abc"})
    phrases, terms = spark.createDataFrame([(x,) for x in asked], "phrase string"), spark.createDataFrame([(x, i, x.upper()) for i, x in enumerate(known)], "term string, pos long, name string")
    want = {}
    for p in asked:
        best = sorted((-fuzzy.token_sort(p, t), i) for i, t in enumerate(known) if fuzzy.token_sort(p, t) >= threshold)
        want[p] = best[:3]
    got = {}
    for r in fuzzy.closest(phrases, terms, threshold, 3, max(threshold, 85.0)).collect():
        got.setdefault(r["phrase"], []).append((-r["score"], r["pos"]))
    assert {p: sorted(v) for p, v in got.items()} == {p: v for p, v in want.items() if v}
    best = {r["phrase"]: (-r["score"], r["pos"]) for r in fuzzy.best_match(phrases, terms, threshold).collect()}
    assert best == {p: v[0] for p, v in want.items() if v}


def test_index_leaves_most_pairs_out(spark):
    words = lambda: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(4))
    forms = lambda n: spark.createDataFrame([(words(),) for _ in range(n)], "form string").withColumn("n", F.length("form"))
    assert grams.candidates(forms(300), forms(1000), 85.0).count() < 0.005 * 300 * 1000
    assert grams.candidates(forms(5).limit(0), forms(5), 85.0).count() == 0


CLAML = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE ClaML [<!ENTITY x "y">]>
<ClaML version="2.0.0"><Title name="T" version="2019">t</Title>
<!-- <Class code="OLD" kind="category"><Rubric kind="preferred"><Label>gone</Label></Rubric></Class> -->
<Class code="I" kind="chapter"><SubClass code="A00-A09"/><Rubric kind="preferred"><Label xml:lang="en">Chapter &amp; one &lt;5 é</Label></Rubric></Class>
<Class kind='block' code='B'/>
<Class kind="block" code="C"
 ><SuperClass code="I"/><Rubric id="1" kind="preferred"><Label xml:lang="en"
 >Mixed<Reference code="a &gt; b">A00</Reference> after <Fragment type="list">frag</Fragment><Reference code="x"/> <![CDATA[cd <b> & </Class> x]]> end<!-- no --></Label></Rubric>
 <Rubric kind="preferred"><Label>second <Para>para</Para></Label><Label>third</Label></Rubric><Rubric kind="preferred"><Label> </Label></Rubric><Rubric kind="inclusion"/></Class><Class code="A00" kind="category" usage="dagger"><SuperClass code="C"/><SuperClass code="Z"/><Rubric kind="inclusion"><Label>inc &#233; "q"</Label></Rubric><Rubric kind="inclusion"><Label>  inc   2 </Label></Rubric><Rubric kind="preferredLong"><Label>long</Label></Rubric></Class><ClassX code="no"></ClassX><Class kind="block"><Rubric kind="preferred"><Label>no code</Label></Rubric></Class>
<ModifierClass code=".0" modifier="M"><Rubric kind="preferred"><Label>mod</Label></Rubric></ModifierClass>
<Class code="D" kind="block"><Rubric kind="preferred"><Label>One <![CDATA[two <b> & </Class>]]></Label></Rubric></Class>
</ClaML>"""


def test_classes_as_xml_has_them(spark, tmp_path):
    (tmp_path / "c.xml").write_text(CLAML)
    got = [tuple(r)[:-1] for r in readers.read_classes(spark, str(tmp_path / "c.xml")).orderBy("pos").collect()]
    assert got == [
        ("I", "chapter", None, None, "Chapter & one <5 é", None, []),
        ("B", "block", None, None, None, None, []),
        ("C", "block", "I", None, "second para", None, []),
        ("A00", "category", "C", "dagger", None, "long", ['inc é "q"', "inc 2"]),
        ("D", "block", None, None, "One two <b> & </Class>", None, []),
    ]


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_records_over_lines(spark, tmp_path, ending):
    columns = ["doc_id", "sourcebook", "note"]
    values = ["plain", "two\nlines", 'say "x"', "a,b", "", "é", "\n\n", "doc_id", 'open "\n" close', "x" * 300]
    for name in ("a", "b"):
        rows = [[str(i), rng.choice(values), rng.choice(values)] for i in range(300)] + [["doc_id", "sourcebook", "note"], ["doc_id", "sourcebook", "more"]]
        out = io.StringIO()
        csv.writer(out, lineterminator=ending).writerows(([columns] if name == "a" else []) + rows)
        lines = out.getvalue().split("\n")
        (tmp_path / f"{name}.csv").write_bytes(b"\n".join(x.encode("cp1252" if i % 3 == 0 else "utf-8") for i, x in enumerate(lines)))
        (tmp_path / f"{name}.want").write_text(repr([[v.replace("\r", "") for v in r] for r in rows]))
    for size in ("128m", "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = readers.read_mixed_csv(spark, str(tmp_path / "*.csv"), columns).collect()
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
        for name in ("a", "b"):
            want = eval((tmp_path / f"{name}.want").read_text())
            assert sorted([(v or "").replace("\r", "") for v in (r.doc_id, r.sourcebook, r.note)] for r in got if r.file == f"{name}.csv") == sorted(want)


def test_published_scores():
    """Examples and definitions that the scorers' public documentation gives."""
    close = lambda got, want: abs(got - want) < 1e-9
    assert close(fuzzy.ratio("this is a test", "this is a test!"), 96.55172413793103)
    assert close(fuzzy.partial("this is a test", "this is a test!"), 100.0)
    assert close(fuzzy.ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear"), 90.9090909090909)
    assert close(fuzzy.token_sort("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear"), 100.0)
    assert close(fuzzy.token_sort("fuzzy was a bear", "fuzzy fuzzy was a bear"), 84.21052631578947)
    assert close(fuzzy.token_set("fuzzy was a bear", "fuzzy fuzzy was a bear"), 100.0)
    assert close(fuzzy.token_set("fuzzy was a bear but not a dog", "fuzzy was a bear but not a cat"), 92.3076923076923)
    assert close(fuzzy.mixed("this is a test", "this is a new test!!!"), 85.5)
    assert close(fuzzy.mixed("this is a word", "THIS IS A WORD"), 21.42857142857143)
    assert fuzzy.partial_token("a bear", "the bear sleeps") == 100.0 and fuzzy.partial_token("", "x") == 0.0


def test_windows_by_brute_force():
    for _ in range(400):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(1, n))) for n in (8, 20))
        a, b = sorted((a, b), key=len)
        windows = [b[max(i, 0) : i + len(a)] for i in range(1 - len(a), len(b))]
        assert abs(fuzzy.partial(a, b) - max(fuzzy.ratio(a, w) for w in windows)) < 1e-9


def test_pool_keeps_categories_of_all_kinds(spark):
    """A block's term that is nearest takes a place of the pool and then goes."""
    from phraseforge.operators import cascade

    rows = spark.createDataFrame([(1, 1, "chronic cough", "", 1)], "run_id long, case_id long, phrase string, core string, pos long")
    blocks = [(f"chronic cough{'s' * i}", f"B{i}", "block", f"block {i}", i) for i in range(1, 11)]
    lexicon = spark.createDataFrame([], "term string, name string, codes array<struct<code: string, mapping_relation: string>>, pos long")
    known = spark.createDataFrame([], "key string, number long")
    decisions = spark.createDataFrame([(1, "chronic cough", "pool", "Cough", True)], "run_id long, norm_key string, step string, candidate string, accept boolean")
    for n, want in ((10, ("nf", "NF-0001")), (3, ("catalog_search", "R05"))):
        catalogue = spark.createDataFrame([*blocks[:n], ("chronic coughing fits", "R05", "category", "Cough", 20)], "term string, code string, kind string, title string, pos long")
        got = cascade.cascade(rows, lexicon, catalogue, decisions, known).first()
        assert (got["match_type"], got["icd_code_complete"]) == want
