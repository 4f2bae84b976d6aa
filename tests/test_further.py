"""The queries of plans.further against their SQL, and their operators against brute force."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from phraseforge.operators import cascade, linking, metrics, neighbours, stability
from phraseforge.plans import further
from phraseforge.sources import writers
from phraseforge.streaming import incremental

from .test_catalogue import DATA, rows


@pytest.mark.parametrize("name", sorted(further.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(further.ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    got = further.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    mine, theirs = rows(got.collect(), got.columns), rows(want.fetchall(), names)
    assert mine and mine == theirs


def test_walks(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(14)]
    nodes = [*chain, ("root", None), ("a", "root"), ("b", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("s", "s"), ("lost", "nowhere")]
    up = dict(nodes)
    want = {}
    for node in up:
        path = [node]
        while len(path) <= 10 and up[path[-1]] in up and up[path[-1]] not in path:
            path.append(up[path[-1]])
        want[node] = (len(path) - 1, path[-1], " > ".join(reversed(path)))
    table = spark.createDataFrame(nodes, "node string, parent string")
    out = linking.walk_up(table)
    assert {r["node"]: (r["depth"], r["top"], r["path"]) for r in out.collect()} == want
    assert linking.walk_up(table.limit(0)).count() == 0


def test_failed_write_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "versions")
    assert writers.current(spark, root) is None
    with pytest.raises(FileNotFoundError):
        writers.newest_ids(spark, root)
    ids = spark.createDataFrame([("flu", 1)], "key string, number long")
    writers.publish_ids(ids, root)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        writers.publish_ids(ids.selectExpr("key", "raise_error('DIVIDE_BY_ZERO') as number"), root)
    assert [tuple(r) for r in writers.newest_ids(spark, root).collect()] == [("flu", 1)]
    writers.publish_ids(ids.selectExpr("key", "number + 1 as number"), root)
    assert writers.current(spark, root)[0] == 2 and [tuple(r) for r in writers.newest_ids(spark, root).collect()] == [("flu", 2)]


def test_drift_of_runs_without_losses(spark):
    ledger = spark.createDataFrame([("a", 1, "A00"), ("b", 1, "B00"), ("a", 2, "NF-0001"), ("a", 3, "A00")], "case_id string, run_id int, category string")
    assert sorted(tuple(r) for r in stability.nf_drift(ledger).collect()) == [(1, 0, 0, 0, 0), (2, 1, 0, 1, 0), (3, 0, 0, 0, 0)]
    none = spark.createDataFrame([], ledger.withColumn("consistency", ledger.category).schema)
    assert stability.nf_drift(ledger.limit(0)).count() == 0 and stability.nf_subset(none).count() == 0


def test_headers(spark, tmp_path):
    (tmp_path / "run1.csv").write_bytes(b'\xef\xbb\xbfa,"b ""x""",c\r\n1,2,3\r\n')
    (tmp_path / "run2.csv").write_text('a,"c,d"\n"1\n2",3\n')
    (tmp_path / "run3.csv").write_text("")
    got = {(r["file"].rsplit("/", 1)[-1], r["column"]) for r in metrics.column_sets(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {("run1.csv", "a"), ("run1.csv", 'b "x"'), ("run1.csv", "c"), ("run2.csv", "a"), ("run2.csv", "c,d")}


def test_ids_of_batches_that_run_again(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    batches = [[("b", 5), ("a", 9), ("b", 1)], [("a", 1), ("c", 7), (None, 3)], [("d", 2), ("c", 1), ("b", 1)], [("a", 1)], [("e", 1)]]
    spark.createDataFrame([("old", 41, "NF-0041"), ("c", 40, "NF-0040")], "key string, number long, code string").write.parquet(at("ids/batch=-1"))
    for keys in batches:
        spark.createDataFrame(keys, "key string, pos long").write.mode("append").parquet(at("keys"))
        incremental.grow_ids(spark, at("keys"), at("ids"), at("state")).awaitTermination()
    read = lambda: {r["key"]: r["number"] for r in spark.read.parquet(at("ids")).collect()}
    first = read()
    assert {k: v for k, v in first.items() if k} == {"old": 41, "c": 40, "b": 42, "a": 43, "d": first["d"], "e": first["e"]} and first["e"] > first["d"] > 43
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # as if the last batch had not ended
    for crc in (tmp_path / "state" / "commits").glob(f".{last.name}.crc"):
        crc.unlink()
    incremental.grow_ids(spark, at("keys"), at("ids"), at("state")).awaitTermination()
    assert read() == first


def test_index_of_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(2)
    spread = rng.normal(size=(900, 16))
    vectors = np.concatenate([spread, spread[:1].repeat(300, 0)])  # a quarter is one vector
    data = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(5000, None), (None, [1.0] * 16), (5001, [0.0] * 16)], "vec_id long, vector array<double>")
    index = neighbours.build(data, queries=60)
    asked = data.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {(r.query_id, r.vec_id) for r in linking.nearest(asked.where("vector is not null"), data.where("vector is not null and vec_id is not null"), 5).collect()}
    found = {(r.query_id, r.vec_id) for r in neighbours.search(asked, index).collect()}
    assert index.rows.count() == 1201 and index.recall >= 0.9 and len(found & exact) >= 0.9 * len(exact)
    every = {(r.query_id, r.vec_id) for r in neighbours.search(asked, index, probe=len(index.centroids)).collect()}
    assert len(every ^ exact) <= 0.01 * len(exact)  # sums of products in another order
    none = neighbours.build(data.limit(0))
    assert neighbours.search(asked, none).count() == 0


def test_hot_keys_rejoin_where_they_lie(spark):
    rows = spark.range(0, 6000, numPartitions=8).selectExpr("1 as run_id", "id as case_id", "if(id % 3 = 0, 'hot', concat('k', id)) as norm_key")
    hits = spark.createDataFrame([(1, "hot", "H"), (1, "k1", "A"), (1, "k6001", "B")], "run_id int, norm_key string, code string")
    got = cascade.rejoin(rows, hits, cascade.KEY)
    assert {(r["norm_key"], r["code"]) for r in got.where("code is not null").collect()} == {("hot", "H"), ("k1", "A")} and got.count() == 6000
    spread = got.where("norm_key = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in spread) == 2000 and max(r["count"] for r in spread) <= 2000 / 8 + 1
    assert cascade.rejoin(rows.limit(0), hits, cascade.KEY).count() == 0
