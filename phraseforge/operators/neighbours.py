"""An index for vector neighbours: inverted lists around centroids.

Centroids are fitted on a bounded sample; every row lies in the list of its nearest centroid. A query looks into the lists nearest to it, as
many as a bounded set of queries with known neighbours shows to be needed. Lists, and the queries that look into one, are dealt into chunks,
so that a list with a third of all rows is many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .linking import matrix, nearest, unit

#: Rows of a list, and queries, in a task.
CHUNK = 20_000


@dataclass
class Lists:
    """rows: (list, vec_id, vector, all of length 1); centroids: a row a list; probe: how many lists a query looks into."""

    rows: DataFrame
    centroids: np.ndarray
    probe: int
    recall: float


def centroids_of(sample: np.ndarray, n: int, rounds: int = 10) -> np.ndarray:
    """Centroids by cosine; one that loses all its vectors takes the vector that lies worst."""
    rng = np.random.default_rng(1)
    out = sample[rng.choice(len(sample), n, replace=False)]
    for _ in range(rounds):
        near = sample @ out.T
        own = near.argmax(1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=n) == 0)
        sums[empty] = sample[np.argsort(near.max(1), kind="stable")[: len(empty)]]
        out = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return out


def ranked_lists(rows: DataFrame, centroids: np.ndarray, most: int) -> DataFrame:
    """rows (..., vector) with lists: the `most` nearest ones, nearest first."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)  # some thousand vectors at most

    def place(batches):
        for b in batches:
            if len(b):
                near = matrix(b.column("vector")) @ shared.value.T if len(shared.value) else np.zeros((len(b), 0))
                first = np.argsort(-near, axis=1, kind="stable")[:, :most].astype(np.int32)
                lists = pa.ListArray.from_arrays(np.arange(len(b) + 1, dtype=np.int32) * first.shape[1], first.ravel())
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "lists"])

    return rows.mapInArrow(place, f"{', '.join(f'{n} {t}' for n, t in rows.dtypes)}, lists array<int>")


def build(corpus: DataFrame, sample: int = 20_000, most_lists: int = 1024, queries: int = 100, k: int = 5, least: float = 0.95) -> Lists:
    """Lists of corpus (vec_id, vector); rows without a vector are left out, and a vector of zeros is like none.

    Fitted on about `sample` rows taken by a hash of vec_id. There are about as many lists as the root of the number of rows, `most_lists` at
    most. About `queries` rows are asked exactly; `probe` is the least number of lists that holds the share `least` of their k nearest."""
    whole = corpus.where("vector is not null and vec_id is not null").select("vec_id", unit(F.col("vector")).alias("vector"))
    n = whole.count()
    hashed = lambda salt, share: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, share))
    some = np.array([r["vector"] for r in whole.where(hashed("fit", sample / max(n, 1))).orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * sample).collect()], np.float64)
    n_lists = min(most_lists, len(some), max(1, round(n**0.5)))
    centroids = centroids_of(some, n_lists) if len(some) else np.zeros((0, 0))
    rows = kept(ranked_lists(whole, centroids, 1).select(F.col("lists")[0].alias("list"), "vec_id", "vector"), "lists")
    asked = kept(whole.where(hashed("ask", queries / max(n, 1))).orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * queries), "asked")
    true = nearest(asked.select(F.col("vec_id").alias("query_id"), "vector"), whole, k)  # a bounded query set against all rows
    order = ranked_lists(asked, centroids, n_lists).select(F.col("vec_id").alias("query_id"), F.col("lists").alias("order"))
    needed = true.join(rows.select("vec_id", "list"), "vec_id").join(order, "query_id").select(F.array_position("order", F.col("list")).alias("at"))
    at = np.sort([r["at"] for r in needed.collect()])  # k for each query asked
    probe = int(at[max(0, int(np.ceil(least * len(at))) - 1)]) if len(at) else 1
    return Lists(rows, centroids, probe, float((at <= probe).mean()) if len(at) else 1.0)


def search(queries: DataFrame, index: Lists, k: int = 5, probe: int | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): for queries (query_id, vector) the k most similar rows of the lists they look into; ties by vec_id."""
    asked = queries.where("vector is not null").select("query_id", unit(F.col("vector")).alias("vector"))
    looks = kept(ranked_lists(asked, index.centroids, probe or index.probe).select("query_id", "vector", F.explode("lists").alias("list")), "looks")
    chunks = lambda rows, name: rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias(name))
    sizes = F.broadcast(chunks(index.rows, "n_rows").join(chunks(looks, "n_asked"), "list"))  # a row a list
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ours = looks.join(sizes, "list").withColumn("b", deal("query_id", "n_asked")).select("list", every("n_rows").alias("a"), "b", "query_id", "vector")
    theirs = index.rows.join(sizes, "list").withColumn("a", deal("vec_id", "n_rows")).select("list", "a", every("n_asked").alias("b"), "vec_id", "vector")
    kinds = dict(queries.dtypes)["query_id"], dict(index.rows.dtypes)["vec_id"]

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        ids, names = c.column("vec_id").combine_chunks(), q.column("query_id").combine_chunks()
        by_id = np.empty(len(ids), np.int64)
        order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
        by_id[order] = np.arange(len(ids))
        corpus, vectors, who, what, scores = matrix(c.column("vector")), matrix(q.column("vector")), [], [], []
        for at in range(0, len(names), 256):
            near = np.round(vectors[at : at + 256] @ corpus.T, 6)
            for i, row in enumerate(near):
                best = np.flatnonzero(row >= np.partition(row, max(len(row) - k, 0))[max(len(row) - k, 0)])
                best = best[np.lexsort((by_id[best], -row[best]))][:k]
                who.append(np.full(len(best), at + i))
                what.append(best)
                scores.append(row[best])
        take = lambda values, at: values.take(pa.array(np.concatenate(at)))
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([take(names, who), take(ids, what), pa.array(np.concatenate(scores))], names=["query_id", "vec_id", "score"])])

    keys = ["list", "a", "b"]
    empty = lambda q, c: meet(q, c) if q.num_rows and c.num_rows else pa.Table.from_batches([pa.RecordBatch.from_arrays([q.column("query_id").combine_chunks()[:0], c.column("vec_id").combine_chunks()[:0], pa.array([], pa.float64())], names=["query_id", "vec_id", "score"])])
    met = ours.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInArrow(empty, f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
