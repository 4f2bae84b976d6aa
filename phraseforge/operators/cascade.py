"""The whole linking cascade: ordered steps over each run's distinct phrases, first hit with a code wins, ids for what is not found.

What a judge or a model said is a table of decisions (run_id, norm_key, step, candidate, accept); what has no decision is refused.
Each step sees only what the steps before have left, and its hits are written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.answers import match_detail, parse_string_list
from ..functions.text import normalize
from ..sources.scratch import kept
from .fuzzy import best_match, candidate_names, choose_code, decided, merge_pools, pool
from .linking import padded, prefixed_ids, sequential_ids

KEY = ["run_id", "norm_key"]
HIT = [*KEY, "step", "match_type", "match_source", "icd_code_complete", "mapping_relation", "matched_name", "score"]


def assignable(catalogue: DataFrame) -> DataFrame:
    """(term, code, title) of catalogue (term, code, kind, title, pos): a term belongs to the entry that claims it first, and counts
    only if that is a category."""
    first = catalogue.groupBy("term").agg(F.min_by(F.struct("code", "kind", "title"), F.struct("pos", "code")).alias("v"))
    return first.where("term <> '' and v.kind = 'category'").select("term", "v.code", "v.title")


def distinct_queries(rows: DataFrame) -> DataFrame:
    """(run_id, norm_key, source, order, term): the complete phrase of each distinct phrase of a run, and its core if that differs."""
    asked = rows.withColumn("norm_key", normalize(F.col("phrase"))).where("norm_key <> ''").groupBy(*KEY).agg(F.min(normalize(F.col("core"))).alias("core"))
    both = F.array(F.struct(F.lit("complete").alias("source"), F.lit(1).alias("order"), F.col("norm_key").alias("term")), F.struct(F.lit("core").alias("source"), F.lit(2).alias("order"), F.col("core").alias("term")))
    return asked.select(*KEY, F.explode(both).alias("v")).select(*KEY, "v.*").where("term <> '' and (order = 1 or term <> norm_key)")


def first_hits(rows: DataFrame, step: int, name: str, catalogue: bool = False) -> DataFrame:
    """One hit a phrase: the complete phrase before its core."""
    best = rows.groupBy(*KEY).agg(F.min_by(F.struct("source", "order", "code", "relation", "name", "score"), "order").alias("v"))
    columns = [(F.lit(step) + F.col("v.order") - 1), F.concat(F.lit(f"{name}_"), F.col("v.source")), F.col("v.source"), F.col("v.code"), F.col("v.relation"), F.col("v.name"), F.col("v.score")]
    return best.select(*KEY, *(c.alias(n) for c, n in zip(columns, HIT[2:], strict=True)))


def rejoin(rows: DataFrame, hits: DataFrame, keys: list[str], share: int = 1000) -> DataFrame:
    """rows with the columns of hits (a row a key), null where there is none; keys aren't null.

    Keys that hold a thousandth of all rows or more, a thousand at most, meet their hits by broadcast, wherever their rows lie; the others
    meet by key, where none is large."""
    counts = kept(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    heavy = counts.where(F.col("n") * share >= total).select(*keys, F.lit(True).alias("heavy"))
    marked = rows.join(F.broadcast(heavy), keys, "left")  # `share` rows at most
    own = hits.join(F.broadcast(heavy), keys, "left_semi")
    few = marked.where("heavy is null").drop("heavy").join(hits, keys, "left")
    many = marked.where("heavy").drop("heavy").join(F.broadcast(own), keys, "left")
    return few.unionByName(many)


def cascade(rows: DataFrame, lexicon: DataFrame, catalogue: DataFrame, decisions: DataFrame, known: DataFrame, threshold: float = 85.0) -> DataFrame:
    """rows (run_id, case_id, phrase, core, pos) with match_type, match_source, icd_code_complete, mapping_relation, matched_name, score.

    Steps: exact, then fuzzy with a decision, in lexicon (term, name, codes: array of code, mapping_relation; pos; a row a term); exact,
    then the best accepted of a candidate pool, in catalogue (term, code, kind, title, pos), whose pools are of all kinds and keep their categories; else an id after those of known (key,
    number), by first pos. A hit without a code doesn't stop the cascade. Of several codes one is chosen, by the answer of a decision of
    step `code` if there is one. Rows with a blank phrase get blanks and take no step. Decisions never cross runs."""
    left = kept(distinct_queries(rows), "queries")
    entries = lexicon.where(F.size("codes") > 0)
    answers = decisions.where("step = 'code' and accept").groupBy(*KEY).agg(F.min("candidate").alias("answer"))

    def coded(found: DataFrame) -> DataFrame:
        """found (..., name, codes, score) with code and relation."""
        chosen = found.join(answers, KEY, "left").withColumn("c", choose_code(F.col("codes"), F.col("answer")))
        return chosen.select(*KEY, "source", "order", F.col("c.code").alias("code"), F.col("c.mapping_relation").alias("relation"), "name", "score").where("coalesce(code, '') <> ''")

    hits = []

    def take(found: DataFrame) -> None:
        nonlocal left
        hits.append(kept(found, "hits"))
        left = left.join(hits[-1].select(*KEY), KEY, "left_anti")

    take(first_hits(coded(left.join(entries.select("term", "name", "codes"), "term").withColumn("score", F.lit(100.0))), 1, "exact"))
    left = kept(left, "queries")
    near = kept(best_match(left.select(F.col("term").alias("phrase")), lexicon, threshold), "near")
    near = left.join(near.select(F.col("phrase").alias("term"), F.col("term").alias("found"), "score"), "term").join(entries.select(F.col("term").alias("found"), "name", "codes"), "found")
    accepted = decisions.where("accept and step in ('fuzzy_complete', 'fuzzy_core')").select(*KEY, "step", F.col("candidate").alias("name")).distinct()
    take(first_hits(coded(near.withColumn("step", F.concat(F.lit("fuzzy_"), "source")).join(accepted, [*KEY, "step", "name"], "left_semi")), 3, "fuzzy"))
    official = assignable(catalogue)
    take(first_hits(left.join(official, "term").select(*KEY, "source", "order", "code", F.lit("").alias("relation"), F.col("title").alias("name"), F.lit(100.0).alias("score")), 5, "catalog_exact"))
    left = kept(left, "queries")
    categories = catalogue.where("kind = 'category'")
    titles = categories.groupBy("code").agg(F.min_by("title", "pos").alias("title"))
    pooled = kept(pool(left.select(F.col("term").alias("phrase")), catalogue.where("term <> ''")).join(categories.select("code").distinct(), "code", "left_semi"), "pool")
    sides = left.join(pooled.withColumnRenamed("phrase", "term"), "term").withColumn("phrase_id", F.struct(*KEY))
    merged = merge_pools(sides.where("order = 1"), sides.where("order = 2"), titles).select("phrase_id.*", "code", "title", "rank")
    chosen = decided(merged.select(*KEY, F.lit("pool").alias("step"), F.col("title").alias("candidate"), "code", "rank"), decisions)
    scores = sides.groupBy(*KEY, "code").agg(F.min_by(F.struct("source", "score"), "order").alias("s"))
    best = chosen.groupBy(*KEY).agg(F.min_by(F.struct("code", "candidate"), "rank").alias("v")).select(*KEY, "v.*").join(scores, [*KEY, "code"])
    take(best.select(*KEY, F.lit(7).alias("step"), F.lit("catalog_search").alias("match_type"), F.col("s.source").alias("match_source"), F.col("code").alias("icd_code_complete"), F.lit("").alias("mapping_relation"), F.col("candidate").alias("matched_name"), F.col("s.score").alias("score")))
    keyed = rows.withColumn("norm_key", normalize(F.col("phrase")))
    missing = keyed.join(left.select(*KEY).distinct(), KEY, "left_semi").select(F.col("norm_key").alias("key"), "pos")
    ids = sequential_ids(missing, known).select("key", "code").unionByName(known.select("key", F.concat(F.lit("NF-"), padded(F.col("number"), 4)).alias("code")))
    take(left.where("order = 1").join(ids.withColumnRenamed("key", "norm_key"), "norm_key").select(*KEY, F.lit(8).alias("step"), F.lit("nf").alias("match_type"), F.lit("none").alias("match_source"), F.col("code").alias("icd_code_complete"), F.lit("").alias("mapping_relation"), F.lit("").alias("matched_name"), F.lit(0.0).alias("score")))
    linked = hits[0]
    for more in hits[1:]:
        linked = linked.unionByName(more)
    out = rejoin(keyed.select("run_id", "case_id", "norm_key").where("run_id is not null"), linked.drop("step"), KEY).unionByName(keyed.where("run_id is null").select("run_id", "case_id", "norm_key"), allowMissingColumns=True).drop("norm_key")
    texts = [c for c in HIT[3:] if c != "score"]
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in texts})


def link_lists(rows: DataFrame, lexicon: DataFrame, decisions: DataFrame, known: DataFrame, labels: DataFrame, threshold: float = 85.0) -> DataFrame:
    """(row_id, codes, match_details): lists of names (row_id, raw: JSON array text, five at most), each linked by exact terms, by the most
    similar one if decisions (norm_key, step `fuzzy` or `semantic`, candidate, accept) accept it, by an accepted candidate of five, or by an
    id with the prefix of its label (norm_key, prefix; else OTR) after those of known (key, prefix).

    lexicon: (term, name, code, pos), a row a term. A hit without a code gets such an id at once. Order within a row is kept."""
    items = kept(rows.select("row_id", F.posexplode(parse_string_list(F.col("raw"))).alias("at", "phrase")).withColumn("norm_key", normalize(F.col("phrase"))), "items")
    asked = items.where("norm_key <> ''").select("norm_key").distinct()
    exact = asked.join(lexicon.select(F.col("term").alias("norm_key"), "name", "code"), "norm_key").withColumns({"kind": F.lit("exact"), "score": F.lit(100.0)})
    left = kept(asked.join(exact, "norm_key", "left_anti"), "names")
    said = lambda step: decisions.where((F.col("step") == step) & F.col("accept")).select("norm_key", F.col("candidate").alias("name")).distinct()
    near = best_match(left.withColumnRenamed("norm_key", "phrase"), lexicon, threshold).join(lexicon.select("term", "name", "code"), "term")
    near = kept(near.select(F.col("phrase").alias("norm_key"), "name", "code", F.lit("fuzzy_validated").alias("kind"), "score").join(said("fuzzy"), ["norm_key", "name"], "left_semi"), "near")
    left = left.join(near, "norm_key", "left_anti")
    options = candidate_names(left.withColumnRenamed("norm_key", "phrase"), lexicon).withColumnRenamed("phrase", "norm_key").join(said("semantic"), ["norm_key", "name"], "left_semi")
    picked = options.groupBy("norm_key").agg(F.min_by("name", "rank").alias("name")).join(lexicon.groupBy("name").agg(F.min_by("code", "pos").alias("code")), "name")
    found = exact.select("norm_key", "name", "code", "kind", "score").unionByName(near.select("norm_key", "name", "code", "kind", "score")).unionByName(picked.select("norm_key", "name", "code", F.lit("semantic").alias("kind"), F.lit(0.0).alias("score")))
    found = kept(found.where("coalesce(code, '') <> ''"), "found")
    lost = items.where("norm_key <> ''").join(found, "norm_key", "left_anti").join(labels, "norm_key", "left")
    new = prefixed_ids(lost.select(F.col("norm_key").alias("key"), F.coalesce("prefix", F.lit("OTR")).alias("prefix"), (F.col("row_id") * 8 + F.col("at")).alias("pos")), known.select("key", "prefix"))
    ids = new.select(F.col("key").alias("norm_key"), F.col("code").alias("nr")).unionByName(known.select(F.col("key").alias("norm_key"), F.col("code").alias("nr")))
    out = items.join(found, "norm_key", "left").join(ids, "norm_key", "left").withColumn("code", F.coalesce("code", "nr"))
    text = match_detail(F.col("phrase"), F.col("name"), F.coalesce("kind", F.lit("nr")), F.round(F.coalesce("score", F.lit(0.0))).cast("int"), F.col("code"))
    ordered = out.select("row_id", F.struct("at", F.col("code"), text.alias("text")).alias("v")).groupBy("row_id").agg(F.array_sort(F.collect_list("v")).alias("v"))  # five a row
    linked = ordered.select("row_id", F.transform("v", lambda x: F.coalesce(x["code"], F.lit("N/A"))).alias("codes"), F.array_join(F.transform("v", lambda x: x["text"]), " ;; ").alias("match_details"))
    return rows.select("row_id").join(linked, "row_id", "left").withColumns({"codes": F.coalesce("codes", F.array().cast("array<string>")), "match_details": F.coalesce("match_details", F.lit(""))})
