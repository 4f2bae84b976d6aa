"""What SQL cannot give: similarity against brute force, files read back, streams run twice, chunks joined again."""

import json
import random

from pyspark.sql import functions as F

from phraseforge.functions import answers as an
from phraseforge.operators import corpus, fuzzy, terminology
from phraseforge.plans import more
from phraseforge.sources import readers, writers
from phraseforge.streaming import incremental

DATA = "/root/testdata/sf0.001"


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def words(rng):
    return " ".join("".join(rng.choices("abcde", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 4)))


def test_lcs_and_symmetry():
    rng = random.Random(1)
    for _ in range(300):
        a, b = words(rng), words(rng)
        assert fuzzy.lcs(a, b) == slow_lcs(a, b) == fuzzy.lcs(b, a)
        for score in fuzzy.SCORERS.values():
            assert 0 <= score(a, b) <= 100 + 1e-9


def test_bounds_lose_nothing():
    rng = random.Random(2)
    texts = sorted({words(rng) for _ in range(120)} | {"aa aa aa", "a b a b"})
    terms = list(enumerate(texts))
    for scorer, score in fuzzy.SCORERS.items():
        for k in (1, 8):
            asked = [words(rng) for _ in range(25)] + ["aa aa"]
            got = {}
            for phrase, _, pos, _, value in fuzzy.score_block(asked, terms, [scorer], 60.0, k):
                got.setdefault(phrase, []).append((-value, pos))
            for phrase in set(asked):
                want = sorted((-score(phrase, x), i) for i, x in terms if score(phrase, x) >= 60)[:k]
                assert sorted(set(got.get(phrase, []))) == want


def test_best_match_over_whole_tables(spark):
    got = {(r["phrase"], r["term"], round(r["score"], 6)) for r in more.QUERIES["j3_best_match"](spark, DATA).collect()}
    terms = {}
    for r in more._terms(spark, DATA).collect():
        terms[r["term"]] = min(r["pos"], terms.get(r["term"], r["pos"]))
    want = set()
    for phrase in {r["phrase"] for r in more._phrases(spark, DATA).collect()}:
        score, _, term = min((-fuzzy.token_sort(phrase, x), pos, x) for x, pos in terms.items())
        if -score >= 85:
            want.add((phrase, term, round(-score, 6)))
    assert got == want and got


def test_pools_are_ranked_and_merged(spark):
    pool = more.QUERIES["j4_pool"](spark, DATA)
    assert pool.where("rank > 10 or score < 60").count() == 0 and pool.count() > 0
    assert more.QUERIES["j5_candidate_names"](spark, DATA).where("rank > 5").count() == 0
    a = spark.createDataFrame([(1, "A", 1), (1, "B", 2)], "phrase_id int, code string, rank int")
    b = spark.createDataFrame([(1, "B", 1), (1, "C", 2), (1, "D", 3)], "phrase_id int, code string, rank int")
    titles = spark.createDataFrame([("A", "x"), ("B", "y"), ("C", "x")], "code string, title string")
    assert [(r["code"], r["rank"]) for r in fuzzy.merge_pools(a, b, titles).orderBy("rank").collect()] == [("A", 1), ("B", 2), ("D", 3)]


def test_empty_sides(spark):
    none, terms = spark.createDataFrame([], "phrase string"), spark.createDataFrame([("x", 1)], "term string, pos long")
    assert fuzzy.best_match(none, terms).count() == 0
    assert fuzzy.best_match(spark.createDataFrame([("x",), (None,), ("",)], "phrase string"), terms.where("false")).count() == 0


def test_choose_name(spark):
    rows = spark.createDataFrame([("Flu ", ["cold", "flu"]), ("asthmaa", ["asthma", "x"]), ("zzz", ["asthma"]), (None, ["a"]), ("a", None)], "answer string, candidates array<string>")
    assert [r["chosen"] for r in fuzzy.choose_name(rows).collect()] == ["flu", "asthma", None, None, None]


def test_answers(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(an.extract_json_object(F.lit('<t></thinking>so ```json\n{"a": {"b": 1}}\n```'))) == '{"a": {"b": 1}}'
    assert one(an.clean_answer(F.lit('"answer: Flu"\nmore'))) == 'Flu"' and one(an.clean_answer(F.lit('"Answer: Flu"'))) == "Flu"
    assert [one(an.is_valid_name(F.lit(x))) for x in ("Flu", "ab", "This is flu", "a b c. d", None)] == [True, False, False, False, False]
    assert one(an.extract_bot_text(F.lit("x\nThinking...\nA\n\n> \nB"))) == "A\nB"
    assert one(an.extract_bot_text(F.lit("The user is ill.\n\nFlu"))) == "Flu" and one(an.extract_bot_text(F.lit("just text"))) == "just text"
    assert one(an.parse_string_list(F.lit('["a", " ", "b"]'))) == ["a", "b"] and one(an.parse_string_list(F.lit("oops"))) == []
    assert one(an.truncate_codes_in_json(F.lit('{"icd_codes": ["A1.2", "B"], "n": 1}'))) == '{"icd_codes": ["A1", "B"], "n": 1}'
    assert one(an.truncate_codes_in_json(F.lit('bad "A1.2"'))) == 'bad "A1"'
    assert one(an.name_differs(F.lit("a-b"), F.lit("A b"))) is False and one(an.name_differs(F.lit("c"), F.lit("A b"))) is True


def test_files_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", 'say "x"')], "run_id int, case_id string, note string")
    writers.write_runs(rows, str(tmp_path / "runs"), ["case_id", "note"])
    back = spark.read.csv(str(tmp_path / "runs"), header=True, escape='"')
    assert sorted((r["run_id"], r["case_id"], r["note"] or "") for r in back.collect()) == [(1, "a", ""), (2, "b", 'say "x"')]
    for k in (1, 2):
        (tmp_path / f"set-run{k}.csv").write_text(f"case_id,code\nc{k},A0{k}\n")
    assert sorted((r["run_id"], r["code"]) for r in readers.load_runs(spark, str(tmp_path / "set-run*.csv"), 2).collect()) == [(1, "A01"), (2, "A02")]
    (tmp_path / "mixed.txt").write_bytes("﻿a,b\nñ,1\n".encode() + "é–,2\n".encode("cp1252"))
    assert [(r["a"], r["b"], r["fell_back"]) for r in readers.read_mixed_csv(spark, str(tmp_path / "mixed.txt"), ["a", "b"]).collect()] == [("ñ", "1", False), ("é–", "2", True)]
    assert readers.read_files_as_encoded(spark, str(tmp_path / "mixed.txt")).first()["encoding"] == "cp1252"
    (tmp_path / "ids.json").write_text(json.dumps({"flu": {"code": "NF-0001", "label": "Flu", "first_seen": "2024-01-02"}}))
    assert [(r["key"], r["code"], str(r["first_seen"])) for r in readers.read_id_dictionary(spark, str(tmp_path / "ids.json")).collect()] == [("flu", "NF-0001", "2024-01-02")]
    for name, text in (("b.txt", "ill\nGROUND_TRUTH: A01, B02"), ("a.txt", "well")):
        (tmp_path / "cases").mkdir(exist_ok=True)
        (tmp_path / "cases" / name).write_text(text)
    assert [(r["idx"], r["case_text"], r["codes"]) for r in readers.read_cases(spark, str(tmp_path / "cases")).orderBy("idx").collect()] == [(1, "well", []), (2, "ill", ["A01", "B02"])]


def test_terminology_files(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"JDBOR": [{"DisorderList": [{"Disorder": [{"OrphaCode": "7", "Name": [{"lang": "es", "label": "Gripe"}, {"lang": "en", "label": "Flu"}], "SynonymList": [{"Synonym": [{"lang": "en", "label": "Grippe"}]}], "ExternalReferenceList": [{"ExternalReference": [{"Source": "ICD-10", "Reference": "J10+", "DisorderMappingRelation": [{"Name": [{"lang": "en", "label": "E (exact)"}]}]}, {"Source": "MeSH", "Reference": "x"}]}]}]}]}]}))
    got = readers.read_disorders(spark, str(tmp_path / "d.json"), "ICD-10").first()
    assert (got["orpha_code"], got["name"], got["synonyms"], [tuple(x) for x in got["icd_codes"]]) == ("7", "Flu", ["Grippe"], [("J10", "E")])
    (tmp_path / "c.xml").write_text('<ClaML><Class code="A00" kind="category"><SuperClass code="A00-A09"/><Rubric kind="preferred"><Label>Flu <Reference>J1</Reference> of  birds</Label></Rubric><Rubric kind="inclusion"><Label>Fever</Label></Rubric></Class>\n<Class code="A00-A09" kind="block"><Rubric kind="preferred"><Label>Block</Label></Rubric><Rubric kind="inclusion"><Label>no</Label></Rubric></Class></ClaML>')
    rows = [(r["code"], r["parent"], r["title"], r["synonyms"]) for r in readers.read_classes(spark, str(tmp_path / "c.xml")).orderBy("pos").collect()]
    assert rows == [("A00", "A00-A09", "Flu of birds", ["Fever"]), ("A00-A09", None, "Block", [])]


def test_term_claims(spark):
    rows = spark.createDataFrame([("A", 1, "Flu [grippe]", ["cold"]), ("B", 2, "Cold", None)], "code string, pos int, title string, synonyms array<string>")
    assert {(r["term"], r["code"]) for r in terminology.term_table(rows).collect()} == {("flu grippe", "A"), ("grippe", "A"), ("cold", "A")}


def test_chunks(spark):
    rng = random.Random(3)
    text = "\n\n".join(" ".join(rng.choices(["aa", "bbb", "cccc" * 30], k=60)) for _ in range(6)) + "x" * 2000
    pieces = corpus.chunks_of(text, 768, 77)
    assert all(len(x) <= 768 for x in pieces) and "".join(corpus.cut(text, 691)) == text
    assert set(text.split()) - {x for p in pieces for x in p.split()} <= {w for w in text.split() if len(w) > 600}
    assert more.QUERIES["v2_chunks"](spark, DATA).where("length(chunk) > 768 or chunk = ''").count() == 0


def test_streams(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    ids = spark.createDataFrame([("NF-1", "odd")], "code string, label string")
    entities = spark.createDataFrame([("A00", "Flu")], "code string, title string")
    schema = "case_id int, category string, title string"
    spark.createDataFrame([(1, "A00", ""), (2, "NF-1", None), (3, "A00", "done"), (4, "", "")], schema).write.parquet(at("in"))
    for _ in range(2):
        incremental.look_up_arrivals(spark, at("in"), schema, entities, ids, at("out"), at("cp")).awaitTermination()
        assert sorted((r["case_id"], r["title"]) for r in spark.read.parquet(at("out")).collect()) == [(1, "Flu"), (2, "[NF] odd")]
    for keys in ([("b", 1), ("a", 2)], [("a", 1), ("c", 2)]):
        spark.createDataFrame(keys, "key string, pos long").write.mode("append").parquet(at("keys"))
        incremental.grow_ids(spark, at("keys"), at("ids"), at("cp2")).awaitTermination()
    assert sorted((r["key"], r["code"]) for r in spark.read.parquet(at("ids")).collect()) == [("a", "NF-0002"), ("b", "NF-0001"), ("c", "NF-0003")]
