"""What the findings of round 3 named, on small tables that show it."""

import math
import random

import duckdb
from pyspark.sql import functions as F

from phraseforge.functions import answers as an
from phraseforge.functions import text as t
from phraseforge.operators import linking
from phraseforge.plans import catalogue, whole

from .test_catalogue import DATA, rows

TABLES = ("part", "supplier", "lineitem")


def test_verdicts_beyond_a_million_parts(spark, tmp_path):
    """Ids have six digits, so part 1,000,080 has the code of part 100,008: a verdict counts its row once, as the SQL does."""
    con = duckdb.connect()
    for t in TABLES:
        key = {"part": "p_partkey", "lineitem": "l_partkey"}.get(t)
        more = f"UNION ALL SELECT * REPLACE ({key} + 100000 AS {key}) FROM src UNION ALL SELECT * REPLACE ({key} + 1000000 AS {key}) FROM src" if key else ""
        con.execute(f"COPY (WITH src AS (SELECT * FROM '{DATA}/{t}.parquet') SELECT * FROM src {more}) TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    for name, queries, sql in (("a9_verdicts", whole.QUERIES, whole.ORACLE_SQL), ("p5_verdict_gate", catalogue.QUERIES, catalogue.ORACLE_SQL), ("a9_outcomes", catalogue.QUERIES, catalogue.ORACLE_SQL)):
        want = con.execute(sql[name])
        names = [x[0] for x in want.description]
        got = queries[name](spark, str(tmp_path))
        assert rows(got.collect(), got.columns) == rows(want.fetchall(), names), name


def test_nearest_by_chunks(spark):
    """Chunks of a few rows give what all pairs give: copies, zeros, null vectors, vectors of other lengths, null ids."""
    rng = random.Random(3)
    data = [(i, [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)]) for i in range(60)] + [(60, None), (61, [0.0] * 3), (62, [1.0]), (63, [None, 1.0, 1.0]), (64, []), (None, [1.0, 0.0, 0.0])]
    corpus = spark.createDataFrame(data, "vec_id long, vector array<double>")
    asked = [(0, data[0][1]), (4, data[4][1]), (60, None), (61, [0.0] * 3), (62, [1.0]), (64, [])]

    def unit(v):
        norm = None if v is None or None in v else math.sqrt(sum(x * x for x in v))
        return v and [x / norm if norm else 0.0 for x in v]

    def score(v, w):
        v, w = unit(v), unit(w)
        return None if v is None or w is None or len(v) != len(w) else round(sum(x * y for x, y in zip(v, w)), 6)

    want = set()
    for q, v in asked:
        scored = sorted(((score(v, w), i) for i, w in data), key=lambda x: (x[0] is None, -(x[0] or 0.0), -1 if x[1] is None else x[1]))
        want |= {(q, i, s, at) for at, (s, i) in enumerate(scored[:5], 1)}
    for sizes in ((2, 7), (100, 100)):
        found = linking.nearest(spark.createDataFrame(asked, "query_id long, vector array<double>"), corpus, 5, *sizes).collect()
        assert {(r["query_id"], r["vec_id"], r["score"] if r["score"] is None else round(r["score"], 6) + 0.0, r["rank"]) for r in found} == want and len(found) == len(want)
    assert linking.nearest(spark.createDataFrame(asked, "query_id long, vector array<double>"), corpus.limit(0), 5).count() == 0


def test_nearest_pairs_in_no_row_by_row_join(spark):
    plan = catalogue.QUERIES["j18_nearest"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_similarity_steps_over_bits(spark):
    """Long texts, other planes, nulls and empty texts; a row of the table of lengths is a whole number, no array that grows by copies."""
    data = [("kitten", "sitting", 200 * 4 / 13), ("😀a é", "é😀a", 200 * 2 / 7), ("ab" * 2000, "ba" * 2000, 200 * 3999 / 8000), ("", "", 100.0), ("", "x", 0.0), (None, "x", None), ("x", None, None)]
    df = spark.createDataFrame([x[:2] for x in data], "a string, b string").select(t.indel_ratio(F.col("a"), F.col("b")).alias("one"), t.indel_ratio(F.col("b"), F.col("a")).alias("other"))
    assert "array_append" not in df._jdf.queryExecution().toString()
    for got, (_, _, want) in zip(df.collect(), data):
        assert all(x is None if want is None else abs(x - want) < 1e-9 for x in got)


def test_answer_forms_compute_once(spark):
    """One parse of the JSON a row, no array that grows by copies, pieces split outside the loop over them; results as before."""
    said = [("\n".join(["x", "> y", *map(str, range(5000))]), "\n".join(map(str, range(5000)))), ("The user is ill.\n\nflu", "flu"), ("> a", "> a"), ("a\n>", "a"), (None, "")]
    df = spark.createDataFrame(said, "raw string, want string").select("want", an.extract_bot_text(F.col("raw")).alias("said"), an.truncate_codes_in_json(F.col("raw")).alias("cut"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "array_append" not in plan and plan.count("parse_json") == 1
    assert all(r["want"] == r["said"] for r in df.collect())
    codes = [('{"icd_codes": ["A1.2"], "n": 1.5}', '{"icd_codes": ["A1"], "n": 1.5}'), ('{"n": "A1.5"}', '{"n": "A1.5"}'), ('oops "A1.5" x', 'oops "A1" x'), ('1.5', '1.5')]
    for r in spark.createDataFrame(codes, "raw string, want string").select("want", an.truncate_codes_in_json(F.col("raw")).alias("cut")).collect():
        assert r["want"] == r["cut"]
