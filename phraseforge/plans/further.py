"""Queries over files as they are met in the field, versions, column sets, and the index of neighbours, and the same rows in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_nf
from ..operators import fuzzy, metrics, neighbours, stability
from ..sources import readers, writers
from ..sources.scratch import kept, new_path
from .catalogue import NF, table
from .ledger import LEDGER_SQL, ledger
from .whole import rooted

L = f"WITH l AS ({LEDGER_SQL})"


def _text(value: str):
    return F.lit(value)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as quoted CSV fields, with their line breaks: those that Latin-1 can hold in Latin-1, others in UTF-8; each file begins with a
    header, and a record of the names of the columns stands in each as data too."""
    path, columns = new_path(spark, "records"), ["doc_id", "lang", "text"]
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("lang", _text("")).alias("lang"), F.coalesce("text", _text("")).alias("text"))
    rows = rows.withColumn("latin", ~F.col("text").rlike(r"[^\x00-\x7F\xA0-\xFF]"))
    for latin, encoding in ((True, "ISO-8859-1"), (False, "UTF-8")):
        own = rows.where(F.col("latin") == latin).select(*columns)
        named = own.limit(1).select(*(F.lit(c).alias(c) for c in ("doc_id", "lang")), F.lit("text of\nno document").alias("text"))  # a row like the header
        own.unionByName(named).write.option("encoding", encoding).option("escape", '"').option("quoteAll", True).option("header", True).csv(f"{path}/{encoding}")
    read = readers.read_mixed_csv(spark, f"{path}/*", columns)
    return read.groupBy(F.col("doc_id").try_cast("long").alias("doc_id"), "lang").agg(F.max(F.md5("text")).alias("digest"), F.max(F.length("text")).alias("n_chars")).where("doc_id is not null")


def _field_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes with comments that hold classes, character data, self-closed elements, attributes in either order and quotation marks."""
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    kind = F.when(F.col("s_suppkey") % 3 == 0, "block").otherwise("category")
    label = lambda kind, *text: F.concat(_text(f'<Rubric id="r" kind="{kind}"><Label xml:lang="en">'), *text, _text("</Label>\n</Rubric>"))
    full = F.concat(
        _text("<Class code='S"), key, _text("'\n kind=\""), kind, _text('"><!-- <Class code="no"/> --><SuperClass code="N'), nation, _text('"/>'),
        label("preferred", _text("name &amp; <![CDATA[<x> ]]><Reference usage=\"a>b\">x</Reference><Para>of</Para>  "), F.col("s_name")), label("preferredLong", _text(" ")), label("inclusion", _text("also &lt;"), key), _text("</Class>"),
    )
    hidden = F.concat(_text("<!-- <Class code=\"H"), key, _text('" kind="category"></Class> -->'))
    xml = F.when(F.col("s_suppkey") % 7 == 0, F.concat(_text('<Class kind="block" code="E'), key, _text('"/>'))).when(F.col("s_suppkey") % 5 == 0, hidden).otherwise(full)
    path = new_path(spark, "classes")
    rooted(table(spark, sf_dir, "supplier").select(xml.alias("value"))).write.text(path)
    return readers.read_classes(spark, path).select("code", "kind", "parent", "title", "title_long", F.array_join("synonyms", "|").alias("synonyms"))


def _clean_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger, in whose run 7 nothing is lost."""
    return ledger(spark, sf_dir).where((F.col("run_id") != 7) | ~is_nf(F.col("category")))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of an id dictionary, and a third one whose write fails: the second is what readers get."""
    root, part = new_path(spark, "versions"), table(spark, sf_dir, "part")
    first = part.select(F.concat_ws(" ", "p_name", "p_brand").alias("key"), F.col("p_partkey").alias("number"))
    writers.publish_ids(first.where("number % 2 = 0"), root)
    writers.publish_ids(first.groupBy("key").agg(F.min("number").alias("number")), root)

    def fails(path: str) -> None:
        first.limit(1).write.parquet(path)
        raise InterruptedError

    try:
        writers.publish(spark, root, fails)
    except InterruptedError:
        pass
    return writers.newest_ids(spark, root).select("key", "number", F.lit(writers.current(spark, root)[0]).alias("version"))


def _run_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, rows, columns = new_path(spark, "run-versions"), ledger(spark, sf_dir), ["case_id", "category"]
    writers.publish_runs(rows, root, columns)
    writers.publish_runs(rows.withColumn("category", F.lower("category")), root, columns)
    back = readers.load_runs(spark, f"{writers.current(spark, root)[1]}/run_id=*", 7)
    return back.select(F.col("run_id").cast("long").alias("run_id"), F.col("case_id").cast("long").alias("case_id"), "category")


def _column_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as files of unlike columns: even ones have a note more, those divisible by three lack the depth."""
    path, rows = new_path(spark, "columns"), kept(ledger(spark, sf_dir), "ledger")
    rows = rows.withColumns({'say "so"': F.lit("x"), "a,b": F.lit(1)})
    for kind, columns in ((1, ["case_id", "category", "depth"]), (2, ["case_id", 'say "so"', "depth", "category"]), (3, ["case_id", "category"]), (0, ["case_id", "a,b", "category"])):
        even, third = kind in (2, 0), kind in (3, 0)
        own = rows.where(((F.col("run_id") % 2 == 0) == even) & ((F.col("run_id") % 3 == 0) == third))
        own.select("run_id", *(F.col(f"`{c}`") for c in columns)).write.mode("append").partitionBy("run_id").csv(path, header=True, escape='"')
    sets = metrics.column_sets(spark, f"{path}/run_id=*").select(F.regexp_extract("file", r"run_id=(\d+)", 1).cast("long").alias("run"), "column").distinct()
    return metrics.column_set_differences(sets, 1)


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that name a part in other case, with a letter too few, or not at all, among the part's names."""
    part = table(spark, sf_dir, "part")
    answer = F.when(F.col("p_partkey") % 3 == 0, F.concat(_text(" "), F.upper("p_type"))).when(F.col("p_partkey") % 3 == 1, F.expr("substr(p_type, 1, length(p_type) - 1)")).otherwise(_text("none of these"))
    rows = part.select("p_partkey", answer.alias("answer"), F.array("p_brand", "p_name", "p_type", F.lit(None).cast("string")).alias("candidates"))
    return fuzzy.choose_name(rows).select("p_partkey", "chosen")


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    index = neighbours.build(rows)
    found = neighbours.search(rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), index)
    return found.withColumn("recall", F.lit(index.recall))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "s2_records_over_lines": _records,
    "s6_classes_in_the_field": _field_classes,
    "x1_drift_with_a_clean_run": lambda s, d: stability.nf_drift(_clean_run(s, d)),
    "x3_subset_with_a_clean_run": lambda s, d: stability.nf_subset(_clean_run(s, d)),
    "k1_run_versions": _run_versions,
    "k2_id_versions": _versions,
    "a14_column_sets": _column_sets,
    "j15_chosen_names": _chosen,
    "j18_indexed": _indexed,
}

CLEAN = f"WITH every AS ({LEDGER_SQL}), l AS (SELECT * FROM every WHERE run_id <> 7 OR NOT ({NF}))"
DRIFT = f"nf AS (SELECT DISTINCT run_id, case_id FROM l WHERE {NF}), f AS (SELECT case_id FROM nf WHERE run_id = 1), r AS (SELECT DISTINCT run_id FROM l)"

ORACLE_SQL: dict[str, str] = {
    "s2_records_over_lines": "SELECT doc_id, coalesce(lang, '') AS lang, max(md5(coalesce(text, ''))) AS digest, CAST(max(length(coalesce(text, ''))) AS INT) AS n_chars FROM documents GROUP BY doc_id, lang",
    "s6_classes_in_the_field": """SELECT concat(CASE WHEN s_suppkey % 7 = 0 THEN 'E' ELSE 'S' END, s_suppkey) AS code, CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 3 = 0 THEN 'block' ELSE 'category' END AS kind,
  CASE WHEN s_suppkey % 7 <> 0 THEN concat('N', s_nationkey) END AS parent, CASE WHEN s_suppkey % 7 <> 0 THEN concat('name & <x> of ', s_name) END AS title, CAST(NULL AS VARCHAR) AS title_long,
  CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 3 = 0 THEN '' ELSE concat('also <', s_suppkey) END AS synonyms FROM supplier WHERE s_suppkey % 7 = 0 OR s_suppkey % 5 <> 0""",
    "x1_drift_with_a_clean_run": f"""{CLEAN}, {DRIFT}
SELECT r.run_id, count(nf.case_id) AS n_nf, count(f.case_id) AS n_shared, count(nf.case_id) - count(f.case_id) AS n_only_here, (SELECT count(*) FROM f) - count(f.case_id) AS n_only_first
FROM r LEFT JOIN nf ON nf.run_id = r.run_id LEFT JOIN f ON f.case_id = nf.case_id GROUP BY r.run_id""",
    "x3_subset_with_a_clean_run": f"""{CLEAN}, {DRIFT}, cells AS (SELECT c.case_id, l.category FROM (SELECT DISTINCT case_id FROM l) c CROSS JOIN r LEFT JOIN l ON l.case_id = c.case_id AND l.run_id = r.run_id)
SELECT r.run_id, count(nf.case_id) = count(f.case_id) AS is_subset, (SELECT count(*) > 0 FROM (SELECT case_id FROM cells GROUP BY case_id HAVING bool_and(coalesce({NF}, false)))) AS dependent
FROM r LEFT JOIN nf ON nf.run_id = r.run_id LEFT JOIN f ON f.case_id = nf.case_id GROUP BY r.run_id""",
    "j15_chosen_names": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 3 = 1 AND 200.0 * (length(p_type) - 1) / (2 * length(p_type) - 1) >= 90 THEN p_type END AS chosen FROM part",
    "k1_run_versions": f"{L} SELECT CAST(run_id AS BIGINT) AS run_id, case_id, lower(category) AS category FROM l",
    "k2_id_versions": "SELECT concat_ws(' ', p_name, p_brand) AS key, min(p_partkey) AS number, CAST(2 AS INT) AS version FROM part GROUP BY 1",
    "a14_column_sets": f"""{L}, runs AS (SELECT DISTINCT CAST(run_id AS BIGINT) AS run FROM l WHERE run_id <> 1)
SELECT run, 'depth' AS column, 'missing' AS side FROM runs WHERE run % 3 = 0 UNION ALL SELECT run, CASE WHEN run % 3 = 0 THEN 'a,b' ELSE 'say "so"' END, 'extra' FROM runs WHERE run % 2 = 0""",
}
