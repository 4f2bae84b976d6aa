"""The order of written results, and what it costs."""

from pyspark.sql import functions as F

from phraseforge.sources import writers


def test_results_sort_by_attributes(spark, tmp_path):
    """Sort keys are columns, and only what looks like a number is cast, as a failed cast costs an exception each time it is made."""
    rows_in = spark.createDataFrame([("q10", 2), ("10", 3), ("9", 1), (" 2 ", 1), ("", 1), (None, 1), ("99999999999999999999", 1), ("1.5", 1), ("10", 1)], "query_id string, iteration long")
    writers.write_results(rows_in, str(tmp_path / "r"), ["query_id", "iteration"])
    got = [tuple(r) for r in spark.read.csv(str(tmp_path / "r"), header=True).coalesce(1).collect()]
    old = rows_in.orderBy(F.col("query_id").try_cast("bigint"), F.col("query_id").cast("string"), F.col("iteration").try_cast("bigint")).collect()
    assert [str(b) for _, b in got] == [str(r["iteration"]) for r in old] and len(got) == 9
    plan = writers.in_result_order(rows_in, ["iteration"])._jdf.queryExecution().executedPlan().toString()
    sort = next(line for line in plan.splitlines() if " Sort [" in line)
    assert "sort_number" in sort and "cast" not in sort.lower()
