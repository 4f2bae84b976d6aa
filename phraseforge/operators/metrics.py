"""Measures of labelling runs: counts, ratios, intervals across runs, mixes of match types, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_nf

#: Fixed value: the t quantile for a 95 % interval with nine degrees of freedom.
T_95 = 2.262
MEASURES = ("coverage", "coherence", "precision_a", "recall_a", "f1_a", "precision_b", "recall_b", "f1_b", "precision_c", "recall_c", "f1_c")


def run_counts(ledger: DataFrame) -> DataFrame:
    """Per run: total, resolved, nf, yes, no; a missing code counts as resolved, verdicts on resolved rows only."""
    nf = is_nf(F.col("category"))
    out = ledger.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(nf).alias("nf"),
        F.count_if(~nf & (F.col("consistency") == "yes")).alias("yes"),
        F.count_if(~nf & (F.col("consistency") == "no")).alias("no"),
        F.count_if(F.coalesce(F.col("category"), F.lit("")) == "").alias("n_blank"),
    )
    return out.withColumn("resolved", F.col("total") - F.col("nf"))


def run_measures(counts: DataFrame) -> DataFrame:
    """Coverage, coherence, and precision, recall and F1 under three conventions; undefined ones are null."""
    ratio = lambda a, b: F.try_divide(a, b)
    yes, no, nf = F.col("yes"), F.col("no"), F.col("nf")
    out = counts.withColumns({"coverage": ratio(F.col("resolved"), F.col("total")), "coherence": ratio(yes, yes + no)})
    zero = F.lit(0).cast("long")
    for name, fp, fn in (("a", zero, no + nf), ("b", no, zero), ("c", zero, no)):
        out = out.withColumns({f"precision_{name}": ratio(yes, yes + fp), f"recall_{name}": ratio(yes, yes + fn)})
        p, r = F.col(f"precision_{name}"), F.col(f"recall_{name}")
        out = out.withColumn(f"f1_{name}", ratio(2 * p * r, p + r))
    return out


def across_runs(measures: DataFrame, t: float = T_95) -> DataFrame:
    """Mean, sample deviation and interval of each measure; the deviation of a single run is null."""
    long = measures.unpivot(["run_id"], list(MEASURES), "measure", "value")
    out = long.groupBy("measure").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("value").alias("n_runs"))
    half = t * F.col("sd") / F.sqrt("n_runs")
    return out.withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})


def match_type_mix(ledger: DataFrame) -> DataFrame:
    """Per run and match type: count and share, zeros for types that a run lacks; blank types are skipped."""
    named = ledger.where("match_type is not null and match_type <> ''")
    counts = named.groupBy("run_id", "match_type").agg(F.count(F.lit(1)).alias("n"))
    grid = ledger.select("run_id").distinct().join(named.select("match_type").distinct(), how="cross")  # runs by types: a few rows
    totals = ledger.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"))
    out = grid.join(counts, ["run_id", "match_type"], "left").join(totals, "run_id").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("share", F.col("n") / F.col("total")).drop("total")


def match_type_spread(mix: DataFrame, early: int = 2) -> DataFrame:
    """Across runs: mean, deviation, range of each type's count; the first `early` runs against the rest."""
    first = F.col("run_id") <= early
    out = mix.groupBy("match_type").agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"), F.min("n").alias("low"), F.max("n").alias("high"), F.avg(F.when(first, F.col("n"))).alias("mean_early"), F.avg(F.when(~first, F.col("n"))).alias("mean_late"))
    return out.withColumn("difference", F.col("mean_late") - F.col("mean_early"))


def integrity(ledger: DataFrame) -> DataFrame:
    """Per run: rows, rows that repeat a key, and the difference in rows to run 1."""
    per_key = ledger.groupBy("run_id", "case_id").agg(F.count(F.lit(1)).alias("n"))
    out = per_key.groupBy("run_id").agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_extra"))
    one = out.where("run_id = 1").select(F.col("n_rows").alias("first_rows"))
    return out.join(F.broadcast(one), how="left").withColumn("row_difference", F.col("n_rows") - F.col("first_rows")).drop("first_rows")  # one row


def key_differences(ledger: DataFrame) -> DataFrame:
    """Cases that a run lacks of run 1, or has beyond it: one shuffle by case, then by run."""
    runs = ledger.select("run_id").distinct().where("run_id <> 1")
    keys = ledger.select("run_id", "case_id").distinct()
    one = keys.where("run_id = 1").select("case_id")
    missing = one.join(F.broadcast(runs), how="cross").join(keys, ["run_id", "case_id"], "left_anti").withColumn("side", F.lit("only_in_first"))  # as many rows as runs
    extra = keys.where("run_id <> 1").join(one, "case_id", "left_anti").withColumn("side", F.lit("only_in_run"))
    return missing.select("run_id", "case_id", "side").unionByName(extra.select("run_id", "case_id", "side"))


def value_mismatches(ledger: DataFrame, column: str) -> DataFrame:
    """Per run: cases of run 1 whose value differs from run 1; two missing values differ."""
    one = ledger.where("run_id = 1").select("case_id", F.col(column).alias("first_value"))
    both = ledger.where("run_id <> 1").select("run_id", "case_id", column).join(one, "case_id")
    return both.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_common"), F.count_if(~F.coalesce(F.col(column) == F.col("first_value"), F.lit(False))).alias("n_mismatch"))


def latency_summary(events: DataFrame) -> DataFrame:
    """Per query: mean, deviation and range of latency, and successes."""
    return events.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("mean_ms"), F.stddev_samp("latency_ms").alias("sd_ms"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"), F.count_if(F.col("status") == "success").alias("n_success"))


def column_differences(runs: dict[int, DataFrame], first: int = 1) -> list[tuple[int, str, str]]:
    """(run, column, extra or missing) against the first run's columns; from schemas alone."""
    base = set(runs[first].columns)
    return sorted((k, c, "extra" if c not in base else "missing") for k, df in runs.items() for c in base ^ set(df.columns))


def column_sets(spark: SparkSession, path: str) -> DataFrame:
    """(file, column): the names in each CSV file's header, from the byte ranges that begin a file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value", F.col("_metadata.file_block_start").alias("start"))
    headers = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    names = F.regexp_extract_all(F.regexp_replace("header", "^\ufeff|\r$", ""), F.lit(r'("(?:[^"]|"")*"|[^,]*)(?:,|$)'), F.lit(1))
    split = headers.select("file", F.explode(names).alias("name"))
    bare = F.replace(F.regexp_replace("name", r'^\s*"|"\s*$', ""), F.lit('""'), F.lit('"'))
    return split.where("name <> ''").select("file", bare.alias("column"))


def column_set_differences(sets: DataFrame, first: str | int) -> DataFrame:
    """(run, column, side): columns that a run has beyond the first one's (extra) or lacks of them (missing). sets: (run, column)."""
    own, base = sets.where(F.col("run") != first), sets.where(F.col("run") == first).select("column")
    runs = own.select("run").distinct()
    extra = own.join(base, "column", "left_anti").withColumn("side", F.lit("extra"))
    missing = runs.join(F.broadcast(base), how="cross").join(own, ["run", "column"], "left_anti").withColumn("side", F.lit("missing"))  # a header's columns
    return extra.select("run", "column", "side").unionByName(missing.select("run", "column", "side"))
