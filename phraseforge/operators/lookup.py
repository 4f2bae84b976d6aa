"""Looking assigned codes up again, gating verdicts, and summaries of how rows fared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import name_differs
from ..functions.text import is_nf, parse_verdict


def reverse_lookup(rows: DataFrame, entities: DataFrame, ids: DataFrame) -> DataFrame:
    """rows (category, ...) with title and outcome (resolved, nf, unresolved, no_code). entities (code, title) and ids (code,
    label) have one row a code. A not-found id gives `[NF] label`, or `[NF] no label`; what has no title gives an empty one."""
    out = rows.join(entities.select(F.col("code").alias("category"), F.col("title").alias("entity_title")), "category", "left")
    out = out.join(ids.select(F.col("code").alias("category"), F.col("label").alias("nf_label")), "category", "left")
    blank, nf = F.coalesce("category", F.lit("")) == "", is_nf(F.col("category"))
    known = F.coalesce("entity_title", F.lit("")) != ""
    title = F.when(blank, "").when(nf, F.concat(F.lit("[NF] "), F.coalesce("nf_label", F.lit("no label")))).otherwise(F.coalesce("entity_title", F.lit("")))
    outcome = F.when(blank, "no_code").when(nf, "nf").when(known, "resolved").otherwise("unresolved")
    return out.withColumns({"title": title, "outcome": outcome}).drop("entity_title", "nf_label")


def outcome_summary(looked_up: DataFrame) -> DataFrame:
    return looked_up.groupBy("run_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


def gate_verdicts(looked_up: DataFrame, diagnosis: Column, answer: Column, eval_nf: bool = False) -> DataFrame:
    """looked_up with verdict and gate_reason, by the first rule that holds: not found (blank), a code without title (no),
    nothing to judge (blank), else what the answer says."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    nf, code, title = is_nf(F.col("category")), F.col("category"), F.col("title")
    rules = [(nf & F.lit(not eval_nf), "nf", F.lit("")), (~blank(code) & blank(title), "no_title", F.lit("no")), (blank(title) | blank(diagnosis), "nothing_to_judge", F.lit(""))]
    reason, verdict = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for condition, name, value in rules[1:]:
        reason, verdict = reason.when(condition, name), verdict.when(condition, value)
    return looked_up.withColumns({"gate_reason": reason.otherwise("judged"), "verdict": verdict.otherwise(parse_verdict(answer))})


def match_source(match_type: Column) -> Column:
    return F.when(match_type.endswith("_complete"), "complete").when(match_type.endswith("_core"), "core").otherwise("none")


def source_mix(ledger: DataFrame) -> DataFrame:
    """Per run: rows matched by the complete phrase, by its core, or by neither."""
    return ledger.groupBy("run_id", match_source(F.col("match_type")).alias("match_source")).agg(F.count(F.lit(1)).alias("n"))


def cascade_summary(ledger: DataFrame) -> DataFrame:
    """Rows and percentage of each match type over all runs; blank types are skipped, also in the total."""
    named = ledger.where("match_type <> ''")
    total = named.agg(F.count(F.lit(1)).alias("total"))
    out = named.groupBy("match_type").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total), how="cross")  # one row
    return out.select("match_type", "n", (100.0 * F.col("n") / F.col("total")).alias("pct"))


def overall(events: DataFrame) -> DataFrame:
    """Rows, successes, and mean latency, in which a failed row counts as 0."""
    good = F.col("status") == "success"
    return events.agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("n_success"), F.avg(F.when(good, F.col("latency_ms")).otherwise(0.0)).alias("mean_ms"))


def wide(cells: DataFrame, column: str, runs: list[int]) -> DataFrame:
    """One row a case, one column a run (run_<id>); runs are named, so no pass looks for them."""
    return cells.groupBy("case_id").agg(*(F.max(F.when(F.col("run_id") == k, F.col(column))).alias(f"run_{k}") for k in runs))


def unstable_codes(cells: DataFrame, stability: DataFrame) -> DataFrame:
    """Unstable cases with their codes as text, `B27(6); C01(4)`, most frequent first, then met first; `none` for a missing one."""
    some = cells.join(stability.where("stability = 'unstable'").select("case_id", "agreement_pct"), "case_id")
    votes = some.groupBy("case_id", "agreement_pct", "category").agg(F.count(F.lit(1)).alias("n"), F.min("run_id").alias("first_run"))
    text = F.concat(F.coalesce("category", F.lit("none")), F.lit("("), F.col("n").cast("string"), F.lit(")"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("least"), "first_run", text.alias("text"))))  # at most one entry a run
    return votes.groupBy("case_id", "agreement_pct").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "; ").alias("all_codes"))


def warnings(violations: DataFrame, stability: DataFrame, churn: DataFrame, variance: DataFrame, spread: DataFrame, shift: float = 2.0) -> DataFrame:
    """(warning, n) for each finding with n above 0."""
    count = lambda df, name: df.agg(F.lit(name).alias("warning"), F.count(F.lit(1)).alias("n"))
    parts = [count(violations, "exact_not_stable"), count(stability.where("stability = 'NF_persistent'"), "nf_persistent"), churn.select(F.lit("nf_churn").alias("warning"), F.col("n_churn").alias("n")), count(variance, "judge_variance"), count(spread.where(F.abs("difference") > shift), "mean_shift")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("n > 0")


def source_shares(ledger: DataFrame) -> DataFrame:
    """source_mix with each source's share of its run."""
    return source_mix(ledger).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("run_id")))  # three rows a run


def cascade_details(rows: DataFrame) -> DataFrame:
    """rows (phrase, core, category, match_type): per match type its rows, those with a code that is no not-found id, and those whose core is another name
    than the phrase; blank types are skipped."""
    named = rows.where("match_type <> ''")
    return named.groupBy("match_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(~is_nf(F.col("category")) & (F.coalesce("category", F.lit("")) != "")).alias("n_resolved"), F.count_if(name_differs(F.col("core"), F.col("phrase"))).alias("n_core_differs"))


def verdict_summary(gated: DataFrame) -> DataFrame:
    """Per run and outcome of the gate (yes, no, skipped_nf, no_lookup, error): rows. error: judged without a clear answer."""
    out = F.when(F.col("gate_reason") == "nf", "skipped_nf").when(F.col("gate_reason") != "judged", "no_lookup").when(F.col("verdict") == "", "error").otherwise(F.col("verdict"))
    return gated.groupBy("run_id", out.alias("verdict_outcome")).agg(F.count(F.lit(1)).alias("n"))


def pair_iterations(results: DataFrame, codes: DataFrame) -> DataFrame:
    """results (query_id, iteration, ...) with the columns of codes (query_id, iteration, ...), null where an iteration has no codes."""
    return results.join(codes, ["query_id", "iteration"], "left")
