"""Writing labelled rows, id dictionaries, reports and catalogues."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, path string"


def write_runs(rows: DataFrame, path: str, columns: list[str]) -> None:
    """CSV by run with the given columns in order, null as an empty text. The path must be new: a version is written whole, and
    readers turn to it when it is there."""
    rows.select("run_id", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns)).write.partitionBy("run_id").csv(path, header=True, escape='"', emptyValue="")


def write_ids(ids: DataFrame, path: str) -> None:
    ids.write.parquet(path)


def ids_as_json(ids: DataFrame) -> DataFrame:
    """A JSON map a line, key to the other columns, as readers.read_id_dictionary takes it."""
    return ids.select(F.to_json(F.create_map("key", F.struct(*[c for c in ids.columns if c != "key"]))).alias("value"))


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, row): every row of small report tables as JSON, to be written together."""
    out = None
    for name, df in parts.items():
        lines = df.select(F.lit(name).alias("part"), F.to_json(F.struct(*df.columns)).alias("row"))
        out = lines if out is None else out.unionByName(lines)
    return out


def write_catalogue(entities: DataFrame, path: str) -> None:
    entities.write.json(path)


def in_result_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """The columns in order, rows by query and iteration; numbers sort as numbers.

    Sort keys are columns, made once a row and not at each comparison; only what looks like a number is cast, as a failed cast costs
    an exception."""
    number = lambda c: F.when(F.col(c).cast("string").rlike(r"^[\s\p{Cntrl}]*[+-]?[0-9.]+[\s\p{Cntrl}]*$"), F.col(c).try_cast("bigint"))
    keys = {"sort_number": number("query_id"), "sort_text": F.col("query_id").cast("string"), "sort_iteration": number("iteration")}
    return rows.withColumns(keys).orderBy(*keys).select(*order)


def write_results(rows: DataFrame, path: str, order: list[str]) -> None:
    """CSV in a fixed order of columns, by query and iteration."""
    in_result_order(rows, order).write.csv(path, header=True, escape='"')


def current(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """(version, path) of the newest whole version under root, None if there is none."""
    try:
        newest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").orderBy(F.desc("version"), F.desc("path")).first()  # a row a version
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if newest is None else (newest["version"], newest["path"])


def publish(spark: SparkSession, root: str, write: Callable[[str], None]) -> str:
    """A new version under root: write(path) makes it whole in a folder that no reader knows of, then one row of a manifest names it.

    That row is one file, which Spark commits by a rename, so readers see the old version or the new one. A write that fails leaves the old
    one, and a folder that nothing names. Of two writers at once the one with the greater path counts."""
    before = current(spark, root)
    path = f"{root}/data-{uuid.uuid4().hex}"
    write(path)
    spark.createDataFrame([((before[0] if before else 0) + 1, path)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return path


def publish_runs(rows: DataFrame, root: str, columns: list[str]) -> str:
    """write_runs as a new version under root; readers.load_runs takes its folders."""
    return publish(rows.sparkSession, root, lambda path: write_runs(rows, path, columns))


def publish_ids(ids: DataFrame, root: str) -> str:
    return publish(ids.sparkSession, root, lambda path: write_ids(ids, path))


def newest_ids(spark: SparkSession, root: str) -> DataFrame:
    """The ids of the newest version."""
    found = current(spark, root)
    if found is None:
        raise FileNotFoundError(f"no version in {root}")
    return spark.read.parquet(found[1])
