"""Queries of terminologies, similarity, answers and transcripts over the reference tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as an
from ..functions import text as t
from ..operators import corpus, fuzzy, terminology
from .ledger import LEDGER_SQL, ledger


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(t.normalize(F.concat_ws(" ", "p_name", (F.col("p_partkey") % 97).cast("string"))).alias("phrase"))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(t.normalize(F.col("p_name")).alias("term"), F.concat(F.lit("C"), (F.col("p_partkey") % 50).cast("string")).alias("code"), F.col("p_partkey").alias("pos"), F.upper("p_name").alias("name"))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer = (table(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    top = region.select(F.concat(F.lit("R"), "r_regionkey").alias("code"), F.lit(None).cast("string").alias("parent"), F.lit("chapter").alias("kind"), F.col("r_name").alias("title"))
    blocks = nation.select(F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("R"), "n_regionkey"), F.lit("block"), "n_name")
    return top.union(blocks).union(customer.select(F.concat(F.lit("C"), "c_custkey"), F.concat(F.lit("N"), "c_nationkey"), F.lit("category"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment"))))


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes whose digits are a part's whole key; those of letter Z are in no path."""
    digits = lambda key: F.concat(F.when(F.col(key) < 10, "0").otherwise(""), F.col(key).cast("string"))
    code = F.concat(F.chr(F.lit(65) + F.col("p_partkey") % 22), digits("p_partkey"))
    paths = table(spark, sf_dir, "part").select(code.alias("code"), F.lit("own").alias("chapter"), F.lit(4).alias("distance"), F.concat(F.lit("own > "), code).alias("path"))
    whole = F.concat(F.substring("code_complete", 1, 1), digits("case_id"), F.lit("."), F.split_part("code_complete", F.lit("."), F.lit(2)))
    return terminology.enrich(ledger(spark, sf_dir).select("case_id", "run_id", F.when(t.is_nf(F.col("code_complete")), F.col("code_complete")).otherwise(whole).alias("code_complete")), paths)


def _expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, region = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "region")
    code = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 3 == 0, ".1").otherwise(""))
    modifier = F.concat(F.lit("M"), (F.col("s_suppkey") % 5).cast("string"))
    classes = supplier.select(code.alias("code"), F.lit("category").alias("kind")).union(supplier.where("s_suppkey % 10 = 1").select(F.concat(code, F.lit(".0")), F.lit("category")))
    excluded = supplier.where("s_suppkey % 7 = 0").select(code.alias("code"), modifier.alias("modifier"))
    digit = F.col("r_regionkey").cast("string")
    parts = region.select(F.explode(F.array(*(F.lit(f"M{k}") for k in range(5)))).alias("modifier"), F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit("."), digit)).otherwise(digit).alias("sub"), F.col("r_name").alias("title"))
    return terminology.expand_modifiers(classes, supplier.select(code.alias("code"), modifier.alias("modifier")), excluded, parts)


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(t.normalize(F.col("p_name")).alias("term"), F.concat(F.lit("C"), F.col("p_partkey")).alias("code"), (F.col("p_partkey") % 37 == 0).alias("canonical"), F.col("p_partkey").alias("pos"))
    return terminology.lexical_table(names)


def _code_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("['"), F.col("code_complete"), F.lit("', ['Unknown', '"), F.col("match_type"), F.lit("']]"))
    rows = ledger(spark, sf_dir).withColumn("raw", raw)
    column = F.col("raw")
    return rows.select("case_id", "run_id", an.to_json_list(an.parse_code_list(column)).alias("codes"), an.parse_ground_truth(column).alias("truth"), an.to_json_list(an.clean_chapters(column)).alias("chapters"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    kind = F.col("turn") % 3
    raw = F.when(kind == 0, F.concat(F.lit("<|channel|>analysis<|message|>hm<|end|><|channel|>final<|message|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>"))).when(kind == 1, F.concat(F.lit("```json\n"), F.coalesce("text", F.lit("")), F.lit("\n```"))).otherwise(F.concat(F.lit("  "), F.coalesce("text", F.lit(""))))
    return turns.select("conv_id", "turn", an.parse_channel(raw).alias("channel"), an.clip(F.coalesce("text", F.lit("")), 40).alias("clipped"))


def _details(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = an.match_detail(F.col("case_id").cast("string"), F.col("category"), F.col("match_type"), F.col("depth"), F.col("code_complete"))
    return ledger(spark, sf_dir).groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list(one)), " ;; ").alias("match_details"))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.concat(F.lit('["'), F.upper("p_name"), F.lit('", " ", "no such name '), F.col("p_partkey").cast("string"), F.lit('"]')).alias("raw"))
    terms = _terms(spark, sf_dir).groupBy("term").agg(F.min_by(F.struct("code", "name"), "pos").alias("v")).select("term", "v.code", "v.name")
    return corpus.link_lists(rows, terms)


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    code = lambda n, relation: F.struct(F.concat(F.lit("A"), ((key + n) % 4).cast("string")).alias("code"), relation.alias("mapping_relation"))
    candidates = F.array(code(0, F.lit("NTBT")), code(4, F.lit("E")), code(1, F.when(key % 2 == 0, "E").otherwise("BTNT")), code(2, F.lit("E")))
    answer = F.when(key % 3 == 0, F.concat(F.lit(" a"), ((key + 2) % 4).cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", fuzzy.choose_code(candidates, answer).alias("v")).select("p_partkey", "v.code", "v.mapping_relation")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.chunk(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "j3_best_match": lambda s, d: fuzzy.best_match(_phrases(s, d), _terms(s, d)),
    "j4_pool": lambda s, d: fuzzy.pool(_phrases(s, d), _terms(s, d)),
    "j5_candidate_names": lambda s, d: fuzzy.candidate_names(_phrases(s, d), _terms(s, d)),
    "j8_enriched": _enriched,
    "j10_paths": lambda s, d: terminology.hierarchy_paths(_entities(s, d)),
    "j11_expanded": _expanded,
    "j16_chosen_codes": _chosen,
    "w4_lexical": _lexical,
    "a12_detail_types": lambda s, d: corpus.detail_types(_details(s, d)),
    "a13_index_statistics": lambda s, d: terminology.index_statistics(_entities(s, d)),
    "c3_distinct_phrases": lambda s, d: terminology.distinct_phrases(ledger(s, d).select("run_id", F.concat_ws("-", "category", "match_type").alias("phrase"))),
    "c4_link_lists": _lists,
    "f11_answers": _answers,
    "f19_code_lists": _code_lists,
    "v2_chunks": _chunks,
    "v4_cited_sources": lambda s, d: corpus.cited_sources(table(s, d, "pages").select(F.expr("page_id div 20").alias("query_id"), F.col("url").alias("source"))),
}

L = f"WITH l AS ({LEDGER_SQL})"
NF = "coalesce(category LIKE 'NF-%', false)"
CHAPTER_ROWS = ", ".join(map(str, t.CHAPTERS))
ENTITIES = """e AS (SELECT concat('R', r_regionkey) AS code, concat('R', r_regionkey, '[chapter]') AS path, 0 AS distance, concat('R', r_regionkey) AS chapter, 'chapter' AS kind, r_name AS title FROM region
UNION ALL SELECT concat('N', n_nationkey), concat('R', n_regionkey, '[chapter] > N', n_nationkey, '[block]'), 1, concat('R', n_regionkey), 'block', n_name FROM nation
UNION ALL SELECT concat('C', c_custkey), concat('R', n_regionkey, '[chapter] > N', n_nationkey, '[block] > C', c_custkey, '[category]'), 2, concat('R', n_regionkey), 'category', CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

ORACLE_SQL: dict[str, str] = {
    "j8_enriched": f"""{L}, own AS (SELECT concat(chr(CAST(65 + p_partkey % 22 AS INT)), CASE WHEN p_partkey < 10 THEN '0' ELSE '' END, p_partkey) AS category FROM part), ch(name, first, last) AS (VALUES {CHAPTER_ROWS}),
c AS (SELECT case_id, run_id, CASE WHEN code_complete LIKE 'NF-%' THEN code_complete ELSE concat(left(code_complete, 1), CASE WHEN case_id < 10 THEN '0' ELSE '' END, case_id, '.', split_part(code_complete, '.', 2)) END AS code_complete FROM l),
k AS (SELECT *, CASE WHEN code_complete LIKE 'NF-%' THEN code_complete ELSE split_part(code_complete, '.', 1) END AS category FROM c)
SELECT case_id, run_id, code_complete, k.category, CASE WHEN {NF.replace('category', 'k.category')} THEN 'NF' WHEN own.category IS NOT NULL THEN 'own' ELSE coalesce(name, '') END AS chapter,
  CASE WHEN {NF.replace('category', 'k.category')} THEN 0 WHEN own.category IS NOT NULL THEN 4 WHEN name IS NOT NULL THEN 2 END AS distance, coalesce('own > ' || own.category, '') AS path
FROM k LEFT JOIN own ON own.category = k.category LEFT JOIN ch ON k.category NOT LIKE 'NF-%' AND left(k.category, 3) BETWEEN first AND last""",
    "j10_paths": f"WITH {ENTITIES} SELECT code, distance, chapter, path FROM e",
    "a13_index_statistics": f"WITH {ENTITIES} SELECT kind, count(*) AS n, count(*) FILTER (title <> '') AS n_titled FROM e GROUP BY kind",
    "j11_expanded": """WITH s AS (SELECT concat('S', s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '.1' ELSE '' END) AS code, s_suppkey AS k FROM supplier), c AS (SELECT code FROM s UNION SELECT concat(code, '.0') FROM s WHERE k % 10 = 1)
SELECT concat(code, CASE WHEN contains(code, '.') THEN '' ELSE '.' END, r_regionkey) AS code, r_name AS title, code AS parent FROM s CROSS JOIN region
WHERE k % 7 <> 0 AND concat(code, CASE WHEN contains(code, '.') THEN '' ELSE '.' END, r_regionkey) NOT IN (SELECT code FROM c)""",
    "j16_chosen_codes": """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN concat('A', (p_partkey + 2) % 4) WHEN p_partkey % 2 = 0 THEN concat('A', (p_partkey + 1) % 4) ELSE concat('A', (p_partkey + 2) % 4) END AS code, 'E' AS mapping_relation FROM part""",
    "w4_lexical": """WITH n AS (SELECT lower(p_name) AS term, p_partkey AS k, p_partkey % 37 = 0 AS c FROM part)
SELECT term, concat('C', coalesce(max(k) FILTER (c), min(k))) AS code, bool_or(c) AS canonical FROM n GROUP BY term""",
    "a12_detail_types": f"{L} SELECT match_type AS kind, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM l GROUP BY match_type",
    "c3_distinct_phrases": f"{L} SELECT run_id, replace(replace(lower(concat_ws('-', category, match_type)), '-', ' '), '  ', ' ') AS norm_key, count(*) AS n FROM l GROUP BY 1, 2",
    "c4_link_lists": """WITH t AS (SELECT lower(p_name) AS term, arg_min(concat('C', p_partkey % 50), p_partkey) AS code FROM part GROUP BY 1)
SELECT p_partkey AS row_id, [code, 'N/A'] AS codes, concat(upper(p_name), ' → ', upper(p_name), ' [exact, 100%] → ', code, ' ;; no such name ', p_partkey, ' → None [nr, 0%] → N/A') AS match_details FROM part JOIN t ON term = lower(p_name)""",
    "f11_answers": """WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS x FROM conversations)
SELECT conv_id, turn, CASE turn % 3 WHEN 1 THEN concat('```json', chr(10), x, chr(10), '```') ELSE regexp_replace(x, '^\\s+|\\s+$', '', 'g') END AS channel, substring(x, 1, 40) AS clipped FROM c""",
    "f19_code_lists": f"""{L} SELECT case_id, run_id, concat('["', split_part(code_complete, '.', 1), '", "Unknown", "', match_type, '"]') AS codes, concat('"', split_part(code_complete, '.', 1), '"') AS truth,
  concat('["', code_complete, '", "', match_type, '"]') AS chapters FROM l""",
    "v4_cited_sources": """SELECT query_id, string_agg(n, ', ' ORDER BY n) AS sources FROM (SELECT DISTINCT page_id // 20 AS query_id, regexp_replace(regexp_replace(url, '^.*/', ''), '\\.[A-Za-z0-9]+$', '') AS n FROM pages WHERE url IS NOT NULL) GROUP BY 1""",
}
