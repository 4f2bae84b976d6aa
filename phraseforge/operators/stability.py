"""How stable each case's label is over the runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_nf

CLASSES = ("NF_persistent", "NF_intermittent", "stable_consistent", "stable_inconsistent", "unstable")


def grid(ledger: DataFrame) -> DataFrame:
    """Every case in every run; a case that a run lacks has null values there. Rows that repeat a key: one by its values."""
    once = ledger.groupBy("case_id", "run_id").agg(F.min_by(F.struct(*[c for c in ledger.columns if c not in ("case_id", "run_id")]), F.struct(F.col("category"), F.col("consistency"))).alias("v"))
    runs = once.select("run_id").distinct()
    cells = once.select("case_id").distinct().join(F.broadcast(runs), how="cross")  # as many rows as runs on this side
    return cells.join(once, ["case_id", "run_id"], "left").select("case_id", "run_id", "v.*")


def case_stability(cells: DataFrame) -> DataFrame:
    """Per case: class, modal category (ties: met first), its count, agreement, distinct categories."""
    nf, code = is_nf(F.col("category")), F.col("category")
    votes = cells.groupBy("case_id", "category").agg(F.count(F.lit(1)).alias("n"), F.min("run_id").alias("first_run"))
    modal = votes.groupBy("case_id").agg(F.max_by(F.struct("category", "n"), F.struct(F.col("n"), -F.col("first_run"))).alias("m"), F.count(F.lit(1)).alias("n_codes"))
    flags = cells.groupBy("case_id").agg(F.bool_and(nf).alias("all_nf"), F.bool_or(nf).alias("some_nf"), F.count_if(F.col("consistency") == "yes").alias("yes"), F.count_if(F.col("consistency") == "no").alias("no"), F.count(F.lit(1)).alias("n_runs"))
    out = flags.join(modal, "case_id")
    label = F.when(F.col("all_nf"), "NF_persistent").when(F.col("some_nf"), "NF_intermittent").when(F.col("n_codes") > 1, "unstable").when(F.col("yes") >= F.col("no"), "stable_consistent").otherwise("stable_inconsistent")
    return out.select("case_id", label.alias("stability"), F.col("m.category").alias("modal_category"), F.col("m.n").alias("modal_count"), (100.0 * F.col("m.n") / F.col("n_runs")).alias("agreement_pct"), "n_codes")


def class_summary(stability: DataFrame) -> DataFrame:
    """Count and share of the five classes, zeros included."""
    spark = stability.sparkSession
    counts = stability.groupBy("stability").agg(F.count(F.lit(1)).alias("n"))
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, CLASSES))).alias("stability"))
    out = names.join(counts, "stability", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = stability.agg(F.count(F.lit(1)).alias("total"))
    return out.join(F.broadcast(total), how="cross").withColumn("share", F.try_divide("n", "total")).drop("total")  # one row


def class_by_match_type(ledger: DataFrame, stability: DataFrame) -> DataFrame:
    """Cases of each class that ever had a match type."""
    return ledger.where("match_type is not null").select("case_id", "match_type").distinct().join(stability, "case_id").groupBy("match_type", "stability").agg(F.count(F.lit(1)).alias("n"))


def determinism_violations(ledger: DataFrame, stability: DataFrame) -> DataFrame:
    """Unstable cases with exact matches, which should never vary, and how many of these runs."""
    exact = ledger.where(F.col("match_type").startswith("exact_"))
    return exact.join(stability.where("stability = 'unstable'"), "case_id", "left_semi").groupBy("case_id").agg(F.count(F.lit(1)).alias("n_exact_runs"), F.count_distinct("category").alias("n_exact_codes"))


def judge_variance(cells: DataFrame) -> DataFrame:
    """Cases with one category, found, and both verdicts."""
    per = cells.groupBy("case_id").agg(F.count_distinct("category").alias("codes"), F.count("category").alias("filled"), F.count(F.lit(1)).alias("runs"), F.bool_or(is_nf(F.col("category"))).alias("some_nf"), F.count_if(F.col("consistency") == "yes").alias("n_yes"), F.count_if(F.col("consistency") == "no").alias("n_no"))
    return per.where("codes = 1 and filled = runs and not some_nf and n_yes > 0 and n_no > 0").select("case_id", "n_yes", "n_no", (F.col("n_yes") / (F.col("n_yes") + F.col("n_no"))).alias("yes_share"))


def level_agreement(ledger: DataFrame) -> DataFrame:
    """Whether a case differs in category, in subcode only, or not at all; blanks don't count."""
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    per = ledger.groupBy("case_id").agg(F.count_distinct(filled("category")).alias("n_category"), F.count_distinct(filled("code_complete")).alias("n_code"))
    level = F.when(F.col("n_category") > 1, "category").when(F.col("n_code") > 1, "subcode").otherwise("stable")
    return per.where("n_category > 0 or n_code > 0").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


def depth_stability(ledger: DataFrame, stability: DataFrame) -> DataFrame:
    """Per modal depth of a case: cases, and the share that are unstable or not always found."""
    votes = ledger.where("depth is not null").groupBy("case_id", "depth").agg(F.count(F.lit(1)).alias("n"), F.min("run_id").alias("first_run"))
    modal = votes.groupBy("case_id").agg(F.max_by("depth", F.struct(F.col("n"), -F.col("first_run"))).alias("depth"))
    out = modal.join(stability, "case_id").groupBy("depth").agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(F.col("stability").isin("unstable", "NF_intermittent")).alias("n_unstable"))
    return out.withColumn("unstable_share", F.col("n_unstable") / F.col("n_cases"))


def most_unstable(stability: DataFrame, n: int = 20) -> DataFrame:
    return stability.where("stability = 'unstable'").orderBy("agreement_pct", "case_id").limit(n)


def nf_drift(ledger: DataFrame) -> DataFrame:
    """Per run against run 1: not-found cases, shared, only here, only in run 1; every run of the ledger, with zeros where it lacks none."""
    nf = ledger.where(is_nf(F.col("category"))).select("run_id", "case_id").distinct()
    one = nf.where("run_id = 1").select("case_id", F.lit(True).alias("in_first"))
    total = one.agg(F.count(F.lit(1)).alias("n_first"))
    per = nf.join(one, "case_id", "left").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_nf"), F.count("in_first").alias("n_shared"))
    every = ledger.select("run_id").distinct().join(per, "run_id", "left").na.fill(0, ["n_nf", "n_shared"])
    return every.join(F.broadcast(total), how="cross").select("run_id", "n_nf", "n_shared", (F.col("n_nf") - F.col("n_shared")).alias("n_only_here"), (F.col("n_first") - F.col("n_shared")).alias("n_only_first"))  # one row


def nf_churn(cells: DataFrame) -> DataFrame:
    """Not-found cases in every run, in any run, and those that change."""
    per = cells.groupBy("case_id").agg(F.count_if(is_nf(F.col("category"))).alias("k"), F.count(F.lit(1)).alias("runs"))
    return per.agg(F.count_if(F.col("k") == F.col("runs")).alias("n_always"), F.count_if(F.col("k") > 0).alias("n_ever"), F.count_if((F.col("k") > 0) & (F.col("k") < F.col("runs"))).alias("n_churn"))


def by_run(rows: DataFrame, value: str) -> DataFrame:
    """(case_id, by_run): a column's values as text, `1:B27; 4:C01`, by run; `none` for a missing one."""
    said = F.concat(F.col("run_id").cast("string"), F.lit(":"), F.coalesce(value, F.lit("none")))
    ordered = F.array_sort(F.collect_list(F.struct("run_id", said.alias("text"))))  # an entry a run
    return rows.groupBy("case_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "; ").alias("by_run"))


def violation_codes(ledger: DataFrame, stability: DataFrame) -> DataFrame:
    """Unstable cases with exact matches: the codes of these runs."""
    exact = ledger.where(F.col("match_type").startswith("exact_"))
    return by_run(exact.join(stability.where("stability = 'unstable'"), "case_id", "left_semi"), "category")


def verdicts_by_run(cells: DataFrame) -> DataFrame:
    """Cases with one category and both verdicts: the verdicts of the runs."""
    return by_run(cells.join(judge_variance(cells), "case_id", "left_semi"), "consistency")


def level_shares(ledger: DataFrame) -> DataFrame:
    """level_agreement with each level's share."""
    return level_agreement(ledger).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # three rows


def depth_by_class(ledger: DataFrame, stability: DataFrame) -> DataFrame:
    """Per modal depth and stability class: cases, and their share of the depth."""
    votes = ledger.where("depth is not null").groupBy("case_id", "depth").agg(F.count(F.lit(1)).alias("n"), F.min("run_id").alias("first_run"))
    modal = votes.groupBy("case_id").agg(F.max_by("depth", F.struct(F.col("n"), -F.col("first_run"))).alias("depth"))
    out = modal.join(stability, "case_id").groupBy("depth", "stability").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("depth")))  # a row a class


def nf_differences(ledger: DataFrame) -> DataFrame:
    """(run_id, case_id, side): cases not found in a run but in run 1 (only_in_run), or the other way (only_in_first); a row a case."""
    nf = ledger.where(is_nf(F.col("category"))).select("run_id", "case_id").distinct()
    runs = ledger.select("run_id").distinct().where("run_id <> 1")
    one = nf.where("run_id = 1").select("case_id")
    here = nf.where("run_id <> 1").join(one, "case_id", "left_anti").select("run_id", "case_id", F.lit("only_in_run").alias("side"))
    gone = one.join(F.broadcast(runs), how="cross").join(nf, ["run_id", "case_id"], "left_anti").select("run_id", "case_id", F.lit("only_in_first").alias("side"))  # as many rows as runs
    return here.unionByName(gone)


def nf_subset(ledger: DataFrame) -> DataFrame:
    """Per run: whether all its not-found cases are not found in run 1 either; and whether runs depend on each other, which shows in cases
    that no run has found."""
    drift = nf_drift(ledger)
    churn = nf_churn(grid(ledger))
    flagged = drift.select("run_id", (F.col("n_only_here") == 0).alias("is_subset"))
    return flagged.join(F.broadcast(churn.select((F.col("n_always") > 0).alias("dependent"))), how="cross")  # one row
