"""The queries over the reference tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import linking, lookup, metrics, stability
from ..sources.scratch import kept
from .ledger import LEDGER_SQL, ledger


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.across_runs(metrics.run_measures(metrics.run_counts(ledger(spark, sf_dir))))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability.grid(ledger(spark, sf_dir))


def _stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability.case_stability(_cells(spark, sf_dir))


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    phrases = part.select(F.col("p_partkey").alias("phrase_id"), F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" ", "p_type", "p_name")).otherwise(F.upper("p_name")).alias("phrase"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.lit("")).alias("core"))
    terms = part.select(t.normalize(F.col("p_name")).alias("term"), F.concat(F.lit("C"), F.col("p_partkey")).alias("code"), F.col("p_partkey").alias("pos"))
    return phrases, terms


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("value").alias("latency_ms"), F.when(F.col("event_type") != "error", "success").otherwise("error").alias("status"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer = (table(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    chapters = region.select(F.concat(F.lit("R"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    blocks = nation.select(F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("R"), "n_regionkey"))
    return chapters.union(blocks).union(customer.select(F.concat(F.lit("C"), "c_custkey"), F.concat(F.lit("N"), "c_nationkey")))


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", t.normalize(F.col("text")).alias("norm"), t.parse_verdict(F.col("text")).alias("verdict"), t.truncate_code(F.concat(F.lit("A"), F.col("item_id"), F.lit(".1"))).alias("category"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return linking.nearest(rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), rows, 5).select("query_id", "vec_id", "rank")


def _new_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), F.col("p_partkey").alias("pos"))
    known = part.groupBy("key").agg(F.min("pos").alias("pos")).where("pos % 7 = 0").select("key", F.col("pos").alias("number"))
    return linking.sequential_ids(part, known)


def _new_prefixed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, ("renal ", "cardiovascular ", "otro ", ""))), (F.col("p_partkey") % 4 + 1).cast("int"))
    part = table(spark, sf_dir, "part").select(F.concat(word, F.col("p_name")).alias("key"), F.col("p_partkey").alias("pos")).withColumn("prefix", t.category_prefix(F.col("key")))
    known = part.groupBy("key").agg(F.min("pos").alias("pos"), F.min("prefix").alias("prefix")).where("pos % 7 = 0").select("key", "prefix")
    return linking.prefixed_ids(part, known)


def _looked_up(spark: SparkSession, sf_dir: str, one_label: bool = False) -> DataFrame:
    """Codes of six digits repeat beyond a million parts, and with them the rows of their cases, as in the SQL; one_label: the first part's
    label alone, a row a case and run."""
    digits = lambda c, n: F.lpad(c.cast("string"), n, "0")
    code = F.concat(F.chr(F.lit(65) + F.col("s_suppkey") % 22), digits(F.col("s_suppkey") % 100, 2))
    entities = table(spark, sf_dir, "supplier").groupBy(code.alias("code")).agg(F.min("s_name").alias("title"))
    ids = table(spark, sf_dir, "part").where("p_partkey % 12 = 0").select(F.concat(F.lit("NF-"), digits(F.col("p_partkey"), 6)).alias("code"), F.col("p_name").alias("label"), F.col("p_partkey").alias("pos"))
    ids = ids.groupBy("code").agg(F.min_by("label", "pos").alias("label")) if one_label else ids
    return lookup.reverse_lookup(ledger(spark, sf_dir).select("case_id", "run_id", "category", "consistency"), entities, ids)


def _gated(spark: SparkSession, sf_dir: str, one_label: bool = False) -> DataFrame:
    phrase = F.when(F.col("case_id") % 50 != 0, F.col("case_id").cast("string"))
    return lookup.gate_verdicts(_looked_up(spark, sf_dir, one_label), phrase, F.col("consistency")).select("case_id", "run_id", "gate_reason", "verdict")


def _warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(ledger(spark, sf_dir), "ledger")
    cells = kept(stability.grid(rows), "cells")
    stable = kept(stability.case_stability(cells), "stable")
    return lookup.warnings(stability.determinism_violations(rows, stable), stable, stability.nf_churn(cells), stability.judge_variance(cells), metrics.match_type_spread(metrics.match_type_mix(rows)))


RUNS = list(range(1, 8))  # what l_linenumber holds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "a1_run_counts": lambda s, d: metrics.run_counts(ledger(s, d)),
    "a2_run_measures": lambda s, d: metrics.run_measures(metrics.run_counts(ledger(s, d))).select("run_id", *metrics.MEASURES),
    "a3_across_runs": flagship,
    "a4_match_type_mix": lambda s, d: metrics.match_type_mix(ledger(s, d)),
    "a5_match_type_spread": lambda s, d: metrics.match_type_spread(metrics.match_type_mix(ledger(s, d))),
    "a10_latency": lambda s, d: metrics.latency_summary(_events(s, d)),
    "a14_integrity": lambda s, d: metrics.integrity(ledger(s, d)),
    "j12_key_differences": lambda s, d: metrics.key_differences(ledger(s, d)),
    "j13_value_mismatches": lambda s, d: metrics.value_mismatches(ledger(s, d), "category"),
    "t2_case_stability": _stable,
    "t3_class_summary": lambda s, d: stability.class_summary(_stable(s, d)),
    "t4_class_by_match_type": lambda s, d: stability.class_by_match_type(ledger(s, d), _stable(s, d)),
    "t5_determinism": lambda s, d: stability.determinism_violations(ledger(s, d), _stable(s, d)),
    "t6_judge_variance": lambda s, d: stability.judge_variance(_cells(s, d)),
    "t7_level_agreement": lambda s, d: stability.level_agreement(ledger(s, d)),
    "t8_depth_stability": lambda s, d: stability.depth_stability(ledger(s, d), _stable(s, d)),
    "t9_most_unstable": lambda s, d: stability.most_unstable(_stable(s, d)),
    "x1_nf_drift": lambda s, d: stability.nf_drift(ledger(s, d)),
    "x2_nf_churn": lambda s, d: stability.nf_churn(_cells(s, d)),
    "c1_exact_cascade": lambda s, d: linking.exact_cascade(*_parts(s, d)),
    "w1_sequential_ids": _new_ids,
    "w3_first_claims": lambda s, d: linking.first_claims(_parts(s, d)[1]),
    "j9_walk_up": lambda s, d: linking.walk_up(_tree(s, d)),
    "j18_nearest": _vectors,
    "v5_conversations": lambda s, d: linking.conversation_json(table(s, d, "conversations")),
    "f1_normalize": _normalized,
    "f8_chapters": lambda s, d: ledger(s, d).select("case_id", "run_id", t.chapter_roman(F.col("code_complete")).alias("chapter")),
    "w2_prefixed_ids": _new_prefixed_ids,
    "j7_reverse_lookup": _looked_up,
    "p5_verdict_gate": _gated,
    "a7_source_mix": lambda s, d: lookup.source_mix(ledger(s, d)),
    "a8_cascade_summary": lambda s, d: lookup.cascade_summary(ledger(s, d)),
    "a9_outcomes": lambda s, d: lookup.outcome_summary(_looked_up(s, d)),
    "a11_overall": lambda s, d: lookup.overall(_events(s, d)),
    "t1_wide": lambda s, d: lookup.wide(_cells(s, d), "category", RUNS),
    "k4_unstable_codes": lambda s, d: lookup.unstable_codes(_cells(s, d), _stable(s, d)),
    "t10_warnings": _warnings,
}

L = f"WITH l AS ({LEDGER_SQL})"
NF = "coalesce(category LIKE 'NF-%', false)"
COUNTS = f"""SELECT run_id, count(*) AS total, count(*) FILTER ({NF}) AS nf, count(*) FILTER (NOT {NF} AND consistency = 'yes') AS yes,
  count(*) FILTER (NOT {NF} AND consistency = 'no') AS "no", count(*) FILTER (coalesce(category, '') = '') AS n_blank,
  count(*) FILTER (NOT {NF}) AS resolved FROM l GROUP BY run_id"""
RATES = """SELECT run_id, resolved / total AS coverage, y / nullif(y + n, 0) AS coherence,
  y / nullif(y, 0) AS precision_a, y / nullif(y + n + nf, 0) AS recall_a, y / nullif(y + n, 0) AS precision_b, y / nullif(y, 0) AS recall_b,
  y / nullif(y, 0) AS precision_c, y / nullif(y + n, 0) AS recall_c FROM (SELECT *, yes AS y, "no" AS n FROM c)"""
MEASURES = f"""{L}, c AS ({COUNTS}), r AS ({RATES}),
m AS (SELECT *, {", ".join(f"2 * precision_{k} * recall_{k} / nullif(precision_{k} + recall_{k}, 0) AS f1_{k}" for k in "abc")} FROM r)"""
MIX = f"""{L}, g AS (SELECT run_id, match_type FROM (SELECT DISTINCT run_id FROM l), (SELECT DISTINCT match_type FROM l WHERE match_type <> '')),
mix AS (SELECT run_id, match_type, (SELECT count(*) FROM l WHERE l.run_id = g.run_id AND l.match_type = g.match_type) AS n,
  (SELECT count(*) FROM l WHERE l.run_id = g.run_id) AS total FROM g)"""
CELLS = f"""{L}, cells AS (SELECT case_id, run_id, code_complete, category, consistency, match_type, depth
  FROM (SELECT DISTINCT case_id FROM l) CROSS JOIN (SELECT DISTINCT run_id FROM l) LEFT JOIN l USING (case_id, run_id))"""
STABLE = f"""{CELLS}, votes AS (SELECT case_id, category, count(*) AS n, min(run_id) AS f FROM cells GROUP BY case_id, category),
best AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, f) AS rn, count(*) OVER (PARTITION BY case_id) AS n_codes FROM votes),
flags AS (SELECT case_id, bool_and({NF}) AS a, bool_or({NF}) AS s, count(*) FILTER (consistency = 'yes') AS y, count(*) FILTER (consistency = 'no') AS o, count(*) AS runs FROM cells GROUP BY case_id),
st AS (SELECT case_id, CASE WHEN a THEN 'NF_persistent' WHEN s THEN 'NF_intermittent' WHEN n_codes > 1 THEN 'unstable' WHEN y >= o THEN 'stable_consistent' ELSE 'stable_inconsistent' END AS stability,
  category AS modal_category, n AS modal_count, 100.0 * n / runs AS agreement_pct, n_codes FROM flags JOIN best USING (case_id) WHERE rn = 1)"""
NORM = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({}), '[''`‘’´]', '', 'g'), '[\\[\\]()]', ' ', 'g'), '[-–—]', ' ', 'g'), '\\s+', ' ', 'g'))"
TERMS = f"tm AS (SELECT {NORM.format('p_name')} AS term, arg_min(concat('C', p_partkey), p_partkey) AS code, min(p_partkey) AS pos FROM part GROUP BY 1)"

ORACLE_SQL: dict[str, str] = {
    "a1_run_counts": f"{L} {COUNTS}",
    "a2_run_measures": f"{MEASURES} SELECT run_id, {', '.join(metrics.MEASURES)} FROM m",
    "a3_across_runs": f"""{MEASURES}, u AS (UNPIVOT (SELECT run_id, {', '.join(metrics.MEASURES)} FROM m) ON {', '.join(metrics.MEASURES)} INTO NAME measure VALUE value)
SELECT measure, avg(value) AS mean, stddev_samp(value) AS sd, count(value) AS n_runs, avg(value) - 2.262 * stddev_samp(value) / sqrt(count(value)) AS ci_low,
  avg(value) + 2.262 * stddev_samp(value) / sqrt(count(value)) AS ci_high FROM u GROUP BY measure""",
    "a4_match_type_mix": f"{MIX} SELECT run_id, match_type, n, n / total AS share FROM mix",
    "a5_match_type_spread": f"""{MIX} SELECT match_type, avg(n) AS mean, stddev_samp(n) AS sd, min(n) AS low, max(n) AS high, avg(n) FILTER (run_id <= 2) AS mean_early,
  avg(n) FILTER (run_id > 2) AS mean_late, avg(n) FILTER (run_id > 2) - avg(n) FILTER (run_id <= 2) AS difference FROM mix GROUP BY match_type""",
    "a10_latency": "SELECT user_id AS query_id, count(*) AS n, avg(value) AS mean_ms, stddev_samp(value) AS sd_ms, min(value) AS min_ms, max(value) AS max_ms, count(*) FILTER (event_type <> 'error') AS n_success FROM events GROUP BY user_id",
    "a14_integrity": f"""{L}, k AS (SELECT run_id, case_id, count(*) AS n FROM l GROUP BY ALL), r AS (SELECT run_id, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_extra FROM k GROUP BY run_id)
SELECT *, n_rows - (SELECT n_rows FROM r WHERE run_id = 1) AS row_difference FROM r""",
    "j12_key_differences": f"""{L} SELECT r.run_id, f.case_id, 'only_in_first' AS side FROM (SELECT DISTINCT run_id FROM l WHERE run_id <> 1) r CROSS JOIN (SELECT DISTINCT case_id FROM l WHERE run_id = 1) f
  WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.run_id = r.run_id AND l.case_id = f.case_id)
UNION ALL SELECT DISTINCT run_id, case_id, 'only_in_run' FROM l WHERE run_id <> 1 AND case_id NOT IN (SELECT case_id FROM l WHERE run_id = 1)""",
    "j13_value_mismatches": f"{L} SELECT b.run_id, count(*) AS n_common, count(*) FILTER (NOT coalesce(a.category = b.category, false)) AS n_mismatch FROM l b JOIN l a ON a.case_id = b.case_id AND a.run_id = 1 WHERE b.run_id <> 1 GROUP BY b.run_id",
    "t2_case_stability": f"{STABLE} SELECT * FROM st",
    "t3_class_summary": f"{STABLE} SELECT v.stability, count(case_id) AS n, count(case_id) / (SELECT count(*) FROM st) AS share FROM (VALUES {', '.join(f'({c!r})' for c in stability.CLASSES)}) v(stability) LEFT JOIN st ON st.stability = v.stability GROUP BY 1",
    "t4_class_by_match_type": f"{STABLE} SELECT match_type, stability, count(*) AS n FROM (SELECT DISTINCT case_id, match_type FROM l WHERE match_type IS NOT NULL) JOIN st USING (case_id) GROUP BY 1, 2",
    "t5_determinism": f"{STABLE} SELECT case_id, count(*) AS n_exact_runs, count(DISTINCT category) AS n_exact_codes FROM l WHERE match_type LIKE 'exact\\_%' ESCAPE '\\' AND case_id IN (SELECT case_id FROM st WHERE stability = 'unstable') GROUP BY case_id",
    "t6_judge_variance": f"""{CELLS} SELECT case_id, n_yes, n_no, n_yes / (n_yes + n_no) AS yes_share FROM (SELECT case_id, count(DISTINCT category) AS c, count(category) AS f, count(*) AS r, bool_or({NF}) AS s,
  count(*) FILTER (consistency = 'yes') AS n_yes, count(*) FILTER (consistency = 'no') AS n_no FROM cells GROUP BY case_id) WHERE c = 1 AND f = r AND NOT s AND n_yes > 0 AND n_no > 0""",
    "t7_level_agreement": f"""{L} SELECT CASE WHEN a > 1 THEN 'category' WHEN b > 1 THEN 'subcode' ELSE 'stable' END AS level, count(*) AS n
FROM (SELECT case_id, count(DISTINCT nullif(category, '')) AS a, count(DISTINCT nullif(code_complete, '')) AS b FROM l GROUP BY case_id) WHERE a > 0 OR b > 0 GROUP BY 1""",
    "t8_depth_stability": f"""{STABLE}, dv AS (SELECT case_id, depth, row_number() OVER (PARTITION BY case_id ORDER BY count(*) DESC, min(run_id)) AS rn FROM l WHERE depth IS NOT NULL GROUP BY case_id, depth)
SELECT depth, count(*) AS n_cases, count(*) FILTER (stability IN ('unstable', 'NF_intermittent')) AS n_unstable, count(*) FILTER (stability IN ('unstable', 'NF_intermittent')) / count(*) AS unstable_share
FROM dv JOIN st USING (case_id) WHERE rn = 1 GROUP BY depth""",
    "t9_most_unstable": f"{STABLE} SELECT * FROM st WHERE stability = 'unstable' ORDER BY agreement_pct, case_id LIMIT 20",
    "x1_nf_drift": f"""{L}, nf AS (SELECT DISTINCT run_id, case_id FROM l WHERE {NF}), f AS (SELECT case_id FROM nf WHERE run_id = 1)
SELECT r.run_id, count(nf.case_id) AS n_nf, count(f.case_id) AS n_shared, count(nf.case_id) - count(f.case_id) AS n_only_here, (SELECT count(*) FROM f) - count(f.case_id) AS n_only_first
FROM (SELECT DISTINCT run_id FROM l) r LEFT JOIN nf ON nf.run_id = r.run_id LEFT JOIN f ON f.case_id = nf.case_id GROUP BY r.run_id""",
    "x2_nf_churn": f"{CELLS} SELECT count(*) FILTER (k = r) AS n_always, count(*) FILTER (k > 0) AS n_ever, count(*) FILTER (k > 0 AND k < r) AS n_churn FROM (SELECT count(*) FILTER ({NF}) AS k, count(*) AS r FROM cells GROUP BY case_id)",
    "c1_exact_cascade": f"""WITH {TERMS}, p AS (SELECT p_partkey AS phrase_id, {NORM.format("CASE WHEN p_partkey % 3 = 0 THEN concat_ws(' ', p_type, p_name) ELSE upper(p_name) END")} AS w,
  CASE WHEN p_partkey % 2 = 0 THEN {NORM.format('p_name')} ELSE '' END AS c FROM part)
SELECT phrase_id, coalesce(a.code, b.code) AS code, CASE WHEN a.code IS NOT NULL THEN 'exact_complete' WHEN b.code IS NOT NULL THEN 'exact_core' ELSE 'nf' END AS match_type
FROM p LEFT JOIN tm a ON a.term = w LEFT JOIN tm b ON b.term = c AND c <> w""",
    "w1_sequential_ids": """WITH k AS (SELECT p_name AS key, min(p_partkey) AS pos FROM part GROUP BY 1), n AS (SELECT key, row_number() OVER (ORDER BY pos, key) + (SELECT max(pos) FROM k WHERE pos % 7 = 0) AS number FROM k WHERE pos % 7 <> 0)
SELECT key, number, concat('NF-', CASE WHEN length(number::VARCHAR) < 4 THEN lpad(number::VARCHAR, 4, '0') ELSE number::VARCHAR END) AS code FROM n""",
    "w3_first_claims": f"WITH {TERMS} SELECT * FROM tm",
    "j9_walk_up": """SELECT concat('R', r_regionkey) AS node, 0 AS depth, concat('R', r_regionkey) AS top, concat('R', r_regionkey) AS path FROM region
UNION ALL SELECT concat('N', n_nationkey), 1, concat('R', n_regionkey), concat('R', n_regionkey, ' > N', n_nationkey) FROM nation
UNION ALL SELECT concat('C', c_custkey), 2, concat('R', n_regionkey), concat('R', n_regionkey, ' > N', n_nationkey, ' > C', c_custkey) FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "j18_nearest": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_dot_product(q.v, c.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(c.v, c.v)), 6) AS score FROM e q, e c WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "v5_conversations": "SELECT conv_id, count(*) AS n_turns, arg_max(text, turn) FILTER (role = 'assistant') AS final_text FROM conversations GROUP BY conv_id",
    "f1_normalize": f"""SELECT item_id, {NORM.format('text')} AS norm, CASE WHEN regexp_replace(lower(text), '[^a-z]', '', 'g') LIKE 'yes%' THEN 'yes'
  WHEN regexp_replace(lower(text), '[^a-z]', '', 'g') LIKE 'no%' THEN 'no' ELSE '' END AS verdict, concat('A', item_id) AS category FROM benchmark""",
}

LOOKED_UP = f"""{L}, ent AS (SELECT concat(chr(CAST(65 + s_suppkey % 22 AS INT)), lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0')) AS code, min(s_name) AS title FROM supplier GROUP BY 1),
ids AS (SELECT concat('NF-', lpad(CAST(p_partkey AS VARCHAR), 6, '0')) AS code, p_name AS label FROM part WHERE p_partkey % 12 = 0),
lk AS (SELECT case_id, run_id, category, consistency,
  CASE WHEN coalesce(category, '') = '' THEN '' WHEN {NF} THEN concat('[NF] ', coalesce(label, 'no label')) ELSE coalesce(title, '') END AS title,
  CASE WHEN coalesce(category, '') = '' THEN 'no_code' WHEN {NF} THEN 'nf' WHEN coalesce(title, '') <> '' THEN 'resolved' ELSE 'unresolved' END AS outcome
  FROM l LEFT JOIN ent ON ent.code = category LEFT JOIN ids ON ids.code = category)"""
CHAPTER_ROWS = ", ".join(map(str, t.CHAPTERS))
PREFIX = " ".join(f"WHEN contains(lower(key), '{word}') THEN '{prefix}'" for word, prefix in t.PREFIXES)

ORACLE_SQL |= {
    "f8_chapters": f"""{L}, ch(name, first, last) AS (VALUES {CHAPTER_ROWS})
SELECT case_id, run_id, coalesce(name, 'Unknown') AS chapter FROM (SELECT case_id, run_id, code_complete AS c,
  concat(upper(left(code_complete, 1)), coalesce(nullif(regexp_extract(code_complete, '^.([0-9]{{2}})', 1), ''), '00')) AS k FROM l) LEFT JOIN ch ON c ~ '^[A-Za-z].*' AND k BETWEEN first AND last""",
    "w2_prefixed_ids": f"""WITH a AS (SELECT concat(['renal ', 'cardiovascular ', 'otro ', ''][p_partkey % 4 + 1], p_name) AS key, p_partkey AS pos FROM part),
k AS (SELECT key, min(pos) AS pos, CASE {PREFIX} ELSE 'OTR' END AS prefix FROM a GROUP BY key),
n AS (SELECT key, prefix, row_number() OVER (PARTITION BY prefix ORDER BY pos, key) + (SELECT count(*) FROM k h WHERE h.prefix = k.prefix AND h.pos % 7 = 0) AS number FROM k WHERE pos % 7 <> 0)
SELECT key, prefix, number, concat('NR-', prefix, '-', CASE WHEN number < 100 THEN lpad(number::VARCHAR, 3, '0') ELSE number::VARCHAR END) AS code FROM n""",
    "j7_reverse_lookup": f"{LOOKED_UP} SELECT * FROM lk",
    "p5_verdict_gate": f"""{LOOKED_UP}, r AS (SELECT *, CASE WHEN {NF} THEN 'nf' WHEN coalesce(category, '') <> '' AND title = '' THEN 'no_title' WHEN title = '' OR case_id % 50 = 0 THEN 'nothing_to_judge' ELSE 'judged' END AS gate_reason FROM lk)
SELECT case_id, run_id, gate_reason, CASE gate_reason WHEN 'judged' THEN coalesce(consistency, '') WHEN 'no_title' THEN 'no' ELSE '' END AS verdict FROM r""",
    "a7_source_mix": f"{L} SELECT run_id, CASE WHEN suffix(match_type, '_complete') THEN 'complete' WHEN suffix(match_type, '_core') THEN 'core' ELSE 'none' END AS match_source, count(*) AS n FROM l GROUP BY 1, 2",
    "a8_cascade_summary": f"{L} SELECT match_type, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM l WHERE match_type <> '' GROUP BY match_type",
    "a9_outcomes": f"{LOOKED_UP} SELECT run_id, outcome, count(*) AS n FROM lk GROUP BY 1, 2",
    "a11_overall": "SELECT count(*) AS n, count(*) FILTER (event_type <> 'error') AS n_success, avg(CASE WHEN event_type <> 'error' THEN value ELSE 0 END) AS mean_ms FROM events",
    "t1_wide": f"{CELLS} SELECT case_id, {', '.join(f'max(category) FILTER (run_id = {k}) AS run_{k}' for k in RUNS)} FROM cells GROUP BY case_id",
    "k4_unstable_codes": f"""{STABLE} SELECT case_id, agreement_pct, string_agg(concat(coalesce(category, 'none'), '(', n, ')'), '; ' ORDER BY n DESC, f) AS all_codes
FROM votes JOIN st USING (case_id) WHERE stability = 'unstable' GROUP BY 1, 2""",
    "t10_warnings": f"""{STABLE}, {MIX.removeprefix(L + ", ")}, shift AS (SELECT match_type FROM mix GROUP BY match_type HAVING abs(avg(n) FILTER (run_id > 2) - avg(n) FILTER (run_id <= 2)) > 2)
SELECT * FROM (SELECT 'exact_not_stable' AS warning, count(*) AS n FROM ({ORACLE_SQL["t5_determinism"].removeprefix(STABLE)}) UNION ALL SELECT 'nf_persistent', count(*) FROM st WHERE stability = 'NF_persistent'
UNION ALL SELECT 'nf_churn', n_churn FROM ({ORACLE_SQL["x2_nf_churn"].removeprefix(CELLS)}) UNION ALL SELECT 'judge_variance', count(*) FROM ({ORACLE_SQL["t6_judge_variance"].removeprefix(CELLS)})
UNION ALL SELECT 'mean_shift', count(*) FROM shift) WHERE n > 0""",
}
