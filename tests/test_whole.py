"""The queries of plans.whole against their SQL, and what has none."""

from pathlib import Path

import duckdb
import pytest

from phraseforge.operators import cascade, linking, metrics
from phraseforge.plans import whole

from .test_catalogue import DATA, rows


@pytest.mark.parametrize("name", sorted(whole.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(whole.ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    got = whole.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    mine, theirs = rows(got.collect(), got.columns), rows(want.fetchall(), names)
    assert mine and mine == theirs


def test_blank_phrases_stay_blank(spark):
    phrases = spark.createDataFrame([(1, " ", ""), (2, None, "flu"), (3, "Flu", ""), (4, "x", "")], "phrase_id int, phrase string, core string")
    terms = spark.createDataFrame([("flu", "A1", 1)], "term string, code string, pos int")
    got = {r["phrase_id"]: (r["code"], r["match_type"]) for r in linking.exact_cascade(phrases, terms).collect()}
    assert got == {1: (None, ""), 2: (None, ""), 3: ("A1", "exact_complete"), 4: (None, "nf")}


def test_decisions_stay_in_their_run(spark):
    rows_in = spark.createDataFrame([(1, 1, "flux", "", 1), (2, 1, "flux", "", 2)], "run_id long, case_id long, phrase string, core string, pos long")
    lexicon = spark.createDataFrame([("flu", "Flu", [("J10", "E")], 1)], "term string, name string, codes array<struct<code: string, mapping_relation: string>>, pos long")
    none = spark.createDataFrame([], "term string, code string, kind string, title string, pos long")
    decisions = spark.createDataFrame([(2, "flux", "fuzzy_complete", "Flu", True)], "run_id long, norm_key string, step string, candidate string, accept boolean")
    known = spark.createDataFrame([("odd", 4)], "key string, number long")
    got = {r["run_id"]: (r["match_type"], r["icd_code_complete"]) for r in cascade.cascade(rows_in, lexicon, none, decisions, known).collect()}
    assert got == {1: ("nf", "NF-0005"), 2: ("fuzzy_complete", "J10")}
    assert cascade.cascade(rows_in.limit(0), lexicon, none, decisions, known).count() == 0


def test_column_differences(spark):
    a, b = spark.createDataFrame([], "x int, y int"), spark.createDataFrame([], "x int, z int")
    assert metrics.column_differences({1: a, 2: b, 3: a}) == [(2, "y", "missing"), (2, "z", "extra")]
