"""Linking phrases to codes: term table, exact cascade, ids for what is not found, hierarchy walk, vector neighbours."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..sources.scratch import kept


def first_claims(terms: DataFrame) -> DataFrame:
    """Of entries (term, code, pos) with the same term, the first by pos."""
    return terms.groupBy("term").agg(F.min_by("code", F.struct("pos", "code")).alias("code"), F.min("pos").alias("pos"))


def variants(phrases: DataFrame) -> DataFrame:
    """Two queries a phrase: complete, and its core if that differs when normalised."""
    both = F.array(F.struct(F.lit("complete").alias("source"), F.lit(1).alias("step"), normalize(F.col("phrase")).alias("term")), F.struct(F.lit("core").alias("source"), F.lit(2).alias("step"), normalize(F.col("core")).alias("term")))
    out = phrases.select("phrase_id", F.explode(both).alias("v")).select("phrase_id", "v.*")
    complete = phrases.select("phrase_id", normalize(F.col("phrase")).alias("whole"))
    return out.join(complete, "phrase_id").where("term <> '' and (step = 1 or term <> whole)").drop("whole")


def exact_cascade(phrases: DataFrame, terms: DataFrame) -> DataFrame:
    """(phrase_id, code, match_type): the complete phrase first, then its core; nf where neither is a term, blank for a blank phrase."""
    hits = variants(phrases).join(first_claims(terms), "term")
    best = hits.groupBy("phrase_id").agg(F.min_by(F.struct("code", "source"), "step").alias("b"))
    blank = normalize(F.col("phrase")) == ""
    out = phrases.select("phrase_id", blank.alias("blank")).join(best, "phrase_id", "left")
    return out.select("phrase_id", F.when(~F.col("blank"), F.col("b.code")).alias("code"), F.when(F.col("blank"), "").otherwise(F.coalesce(F.concat(F.lit("exact_"), F.col("b.source")), F.lit("nf"))).alias("match_type"))


def numbered(rows: DataFrame, group: str, buckets: int = 200) -> DataFrame:
    """rows (group, key, pos) with place: from 1 within the group, by pos, then key.

    Rows are cut into buckets of pos by approximate quantiles, at most `buckets` numbers on the driver, and numbered there; a
    bucket then adds what lies before it. No task holds a whole group, and a recomputed task numbers alike."""
    cuts = rows.agg(F.percentile_approx("pos", [k / buckets for k in range(1, buckets)], 10_000).alias("c")).first()["c"] or []
    bounds = F.array(*(F.lit(x) for x in sorted(set(cuts)))) if cuts else F.array(F.lit(0))
    rows = rows.withColumn("bucket", F.size(F.filter(bounds, lambda x: x <= F.col("pos"))))
    sizes = rows.groupBy(group, "bucket").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # of one row a bucket
    before = sizes.select(group, "bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy(group, "bucket").orderBy("pos", "key"))
    return rows.withColumn("row", within).join(before, [group, "bucket"]).withColumn("place", F.col("before") + F.col("row")).drop("bucket", "row", "before")


def padded(number, width: int):
    digits = number.cast("string")
    return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def sequential_ids(keys: DataFrame, known: DataFrame, prefix: str = "NF-", top: DataFrame | None = None) -> DataFrame:
    """(key, number, code): new keys (key, pos) numbered by pos after the largest known number, or after the one row of top."""
    new = keys.groupBy("key").agg(F.min("pos").alias("pos")).join(known, "key", "left_anti").withColumn("one", F.lit(1))
    top = known.agg(F.coalesce(F.max("number"), F.lit(0)).alias("top")) if top is None else top
    out = numbered(new, "one").join(F.broadcast(top), how="cross").select("key", (F.col("top") + F.col("place")).alias("number"))  # one row
    return out.withColumn("code", F.concat(F.lit(prefix), padded(F.col("number"), 4)))


def prefixed_ids(keys: DataFrame, known: DataFrame) -> DataFrame:
    """(key, prefix, number, code `NR-prefix-001`): new keys (key, prefix, pos) numbered within their prefix, after the count of
    known keys (key, prefix) there. A key keeps the prefix of its first pos."""
    new = keys.groupBy("key").agg(F.min("pos").alias("pos"), F.min_by("prefix", "pos").alias("prefix")).join(known, "key", "left_anti")
    held = known.groupBy("prefix").agg(F.count(F.lit(1)).alias("held"))
    out = numbered(new, "prefix").join(held, "prefix", "left").select("key", "prefix", (F.coalesce("held", F.lit(0)) + F.col("place")).alias("number"))
    return out.withColumn("code", F.concat(F.lit("NR-"), F.col("prefix"), F.lit("-"), padded(F.col("number"), 3)))


def walk_up(nodes: DataFrame, most: int = 10) -> DataFrame:
    """(node, depth, top, path): from (node, parent), up to the root or `most` steps; a cycle ends the walk.

    By pointer doubling: a walk of 1, 2, 4, ... nodes and the node above it are a table, which joins itself; so `most` = 10 takes four
    joins. A walk that repeats a node goes round a cycle from there on, so its distinct nodes are the walk. A node with several parents
    has a row for each walk."""
    out = nodes.select("node", F.col("parent").alias("above"), F.array("node").alias("path"))
    for _ in range(most.bit_length()):
        ahead = out.select(F.col("node").alias("at"), F.col("above").alias("beyond"), F.col("path").alias("more"))
        longer = out.join(ahead, F.col("above") == F.col("at"), "left")
        out = kept(longer.select("node", F.col("beyond").alias("above"), F.when(F.col("at").isNull(), F.col("path")).otherwise(F.concat("path", "more")).alias("path")), "walks")
    walked = out.withColumn("path", F.slice(F.array_distinct("path"), 1, most + 1)).distinct()
    return walked.select("node", (F.size("path") - 1).alias("depth"), F.element_at("path", -1).alias("top"), F.array_join(F.reverse("path"), " > ").alias("path"))


def unit(vector):
    """The vector by its own length, which is summed once a vector; a vector of zeros stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    by = lambda n: F.transform(vector, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))
    return F.get(F.transform(F.array(norm), by), F.lit(0))


def matrix(column: pa.Array, width: int = -1) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def best_of_chunks(asked: pa.Table, known: pa.Table, k: int, cells: int = 1 << 21) -> pa.Table:
    """(query_id, vec_id, score): of two chunks the k best known rows of each query; ties by vec_id, null scores last.

    Vectors of unlike lengths, and null ones, have no score. Scores are rounded to six places, halves away from zero, before they
    are compared; only those that can round to the k-th best are sorted."""
    known = known.take(pc.sort_indices(known.column("vec_id").combine_chunks(), null_placement="at_start"))
    sizes = [pc.fill_null(pc.list_value_length(t.column("vector")), -1).to_numpy() for t in (asked, known)]
    who, what, scores = [], [], []
    for size in np.unique(sizes[0]):
        mine, theirs, others = np.flatnonzero(sizes[0] == size), np.flatnonzero((sizes[1] == size) & (size >= 0)), np.flatnonzero((sizes[1] != size) | (size < 0))
        if len(theirs):
            corpus, vectors = (matrix(t.column("vector").take(pa.array(at)), size) for t, at in ((known, theirs), (asked, mine)))
            step = max(1, cells // len(theirs))
            for at in range(0, len(mine), step):
                near = vectors[at : at + step] @ corpus.T
                key = np.where(np.isnan(near), np.inf, near)
                least = np.partition(key, max(len(theirs) - k, 0), axis=1)[:, max(len(theirs) - k, 0)]
                rows, columns = np.nonzero(key >= least[:, None] - 2e-6)
                value = near[rows, columns]
                value = np.sign(value) * np.floor(np.abs(value) * 1e6 + 0.5) / 1e6
                order = np.lexsort((columns, -np.where(np.isnan(value), np.inf, value), rows))
                first = np.searchsorted(rows, rows)  # where the query's own begin
                order = order[np.arange(len(rows)) - first < k]
                who.append(mine[at + rows[order]])
                what.append(theirs[columns[order]])
                scores.append(value[order])
        few = others[: max(k - len(theirs), 0)]
        who.append(np.repeat(mine, len(few)))
        what.append(np.tile(few, len(mine)))
        scores.append(np.full(len(mine) * len(few), -2.0))  # no cosine is that low
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (who, what, scores)]
    score = pa.array(joined[2], pa.float64(), mask=joined[2] == -2.0)
    return pa.table({"query_id": asked.column("query_id").take(pa.array(joined[0])), "vec_id": known.column("vec_id").take(pa.array(joined[1])), "score": score})


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 5, n_asked: int = 8192, n_known: int = 8192) -> DataFrame:
    """(query_id, vec_id, score, rank): the k most similar corpus rows by cosine; a stated query set against all rows.

    Both sides are dealt by hash into chunks of about n_asked and n_known rows, and each pair of chunks is one group, whose scores are
    matrix products and which returns k rows a query. All pairs are scored; a task holds two chunks, whatever the tables hold."""
    chunks = lambda df, size: max(1, math.ceil(df.count() / size))
    a, b = chunks(queries, n_asked), chunks(corpus, n_known)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    vector = lambda: unit(F.col("vector")).cast("array<double>").alias("vector")
    ours = queries.select("query_id", vector(), deal("query_id", a).alias("a")).select("*", every(b).alias("b"))
    theirs = corpus.select("vec_id", vector(), deal("vec_id", b).alias("b")).select("*", every(a).alias("a"))
    kinds = dict(queries.dtypes)["query_id"], dict(corpus.dtypes)["vec_id"]
    deal_to = lambda df: df.repartition(a * b, "a", "b").groupBy("a", "b")
    met = deal_to(ours).cogroup(deal_to(theirs)).applyInArrow(lambda q, c: best_of_chunks(q, c, k), f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def conversations_as_json(turns: DataFrame) -> DataFrame:
    """(conv_id, conversation): each conversation as one JSON array of its turns (turn, role, text) in order."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))  # a conversation is one row's worth
    return turns.groupBy("conv_id").agg(F.to_json(ordered, {"ignoreNullFields": "false"}).alias("conversation"))


def conversation_json(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, final_text): turns of a conversation, and the last assistant turn's text."""
    said = F.when(F.col("role") == "assistant", F.col("text"))
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.max_by(said, F.when(F.col("role") == "assistant", F.col("turn"))).alias("final_text"))
