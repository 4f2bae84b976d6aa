"""Toxicity by a factorization machine over hashed terms.

A term and its first four, five and six bytes are features, so that inflected words share some. A text is the set of its features, wherever
they stand. The machine's score is a bias, a weight a feature, and a product of two short vectors for each pair of features that
a text holds: an insult beside a group's name can weigh more than both alone. Only the features that tell the labels
apart best in the training rows take part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import LOWER, Block, blocks, mix
from .shared import materialise

BITS = 20
#: Prefixes in bytes; 0 stands for the whole term.
LENGTHS = (4, 5, 6, 0)
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
#: Standard errors by which a feature's shares in the two labels differ at least.
CLEAR = 6.0
U = np.uint64


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) of each term of a block and of its prefixes; with repeats. Terms are runs of letters and of all beyond ASCII."""
    solid, cut = LETTER[block.data], np.zeros(len(block.data) + 1, bool)
    cut[block.bounds] = True
    before, after = np.concatenate([[False], solid]), np.concatenate([solid, [False]])
    starts, ends = np.flatnonzero(solid & (~before[:-1] | cut[:-1])), np.flatnonzero(before & (~after | cut))
    length, row = ends - starts, np.searchsorted(block.bounds, starts, "right") - 1
    padded = np.concatenate([LOWER[block.data], np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(block.data) + 1, 8), (1, 1))
    out, rows = [], []
    for k in LENGTHS:
        at = np.arange(len(starts)) if k == 0 else np.flatnonzero(length >= k)
        whole = length[at] if k == 0 else np.full(len(at), k)
        code = mix(whole.astype(U) * U(0x9E3779B97F4A7C15) + U(k == 0))
        left = np.arange(len(at))
        for step in range(0, int(whole.max(initial=0)), 8):
            left = left[whole[left] > step] if step else left
            chunk = np.ascontiguousarray(eight[starts[at[left]] + step]).view(U).ravel()
            short = U(8) * (U(8) - np.minimum(whole[left] - step, 8).astype(U))
            code[left] = mix(code[left] ^ ((chunk << short) >> short))
        out.append((code >> U(64 - BITS)).astype(np.int64))
        rows.append(row[at])
    return np.concatenate(out), np.concatenate(rows)


@dataclass
class Machine:
    """column: which column a feature has, -1 for none; bias, weights (columns), vectors (columns x rank)."""

    column: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def scores(self, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
        """Probability of label 1 for n texts; (row, column) pairs without repeats."""
        linear = np.bincount(rows, self.weights[columns], n)
        pairs = np.zeros(n)
        for k in range(self.vectors.shape[1]):
            v = self.vectors[columns, k]
            pairs += np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + pairs / 2, -40, 40)))


def fit(texts: list[np.ndarray], y: np.ndarray, share: np.ndarray, n_columns: int, rank: int = 8, epochs: int = 40, decay: float = 2e-4) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, weights, vectors) by mini-batches with Adam and log loss; share: what each row stands for among all labelled ones."""
    rng = np.random.default_rng(3)
    share = share / share.mean()
    base = float((share * y).sum() / share.sum())
    theta = [np.array([np.log(max(base, 1e-6) / max(1 - base, 1e-6))]), np.zeros(n_columns), rng.normal(0, 0.02, (n_columns, rank))]
    moment, square, step = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 256):
            pick = order[at : at + 256]
            x = np.zeros((len(pick), n_columns), np.float32)
            for i, j in enumerate(pick):
                x[i, texts[j]] = 1
            sums = x @ theta[2]
            score = theta[0][0] + x @ theta[1] + 0.5 * ((sums**2).sum(1) - x @ (theta[2] ** 2).sum(1))
            slope = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - y[pick]) * share[pick] / len(pick)
            held = x.T @ slope
            grads = [np.array([slope.sum()]), held + decay * theta[1], x.T @ (slope[:, None] * sums) - held[:, None] * theta[2] + decay * theta[2]]
            step += 1
            for k, g in enumerate(grads):
                moment[k] = 0.9 * moment[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                theta[k] = theta[k] - 0.02 * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return float(theta[0][0]), theta[1], theta[2]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, rows: int = 6000, n_columns: int = 2048, rank: int = 8) -> Machine | None:
    """Fit on text of docs and toxic of labels, joined by doc_id. None if no row has a label.

    Of each label at most about `rows` doc_ids are taken, by a hash of doc_id: these go to every task by broadcast, and only theirs of the
    `n_columns` features that tell most reach the driver. A doc_id with labels of both kinds counts as 1; null labels and ids don't count; a
    doc_id that stands in several documents counts with each."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    ratio = F.create_map(*(F.lit(v) for y, n in counts.items() for v in (y, min(1.0, rows / n))))
    taken = known.where(F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1_000_000)) < F.element_at(ratio, F.col("y")) * 1_000_000).orderBy(F.xxhash64("doc_id"), "doc_id").limit(3 * rows)
    picked = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(taken), "doc_id")  # 3 * rows ids at most

    def sets(batches):
        for block in blocks(batches):
            code, row = features(block)
            held = np.unique((row << BITS) | code)
            at = np.searchsorted(held >> BITS, np.arange(len(block.batch) + 1))
            held &= (1 << BITS) - 1
            yield pa.RecordBatch.from_arrays([block.batch.column("y"), pa.array([held[a:b].astype(np.int32) for a, b in zip(at, at[1:])], pa.list_(pa.int32()))], names=["y", "held"])

    sets_of = materialise(picked.mapInArrow(sets, "y int, held array<int>"), "toxic")
    totals = {r["y"]: r["n"] for r in sets_of.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 + n0:
        return None
    by_feature = sets_of.select("y", F.explode("held").alias("feature")).groupBy("feature").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where("a + b >= 3")
    p1, p0, p = F.col("a") / max(n1, 1), F.col("b") / max(n0, 1), (F.col("a") + F.col("b") + 1) / (n1 + n0 + 2)
    told = by_feature.withColumn("z", F.abs(p1 - p0) / F.sqrt(p * (1 - p) * F.lit(1 / max(n1, 1) + 1 / max(n0, 1))))
    best = np.array(sorted(r["feature"] for r in told.where(F.col("z") >= CLEAR).orderBy(F.desc("z"), "feature").limit(n_columns).collect()), np.int64)
    column = np.full(1 << BITS, -1, np.int32)
    column[best] = np.arange(len(best))

    def narrowed(batches):
        for b in batches:
            own = [column[np.asarray(x, np.int64)] for x in b.column("held").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([x[x >= 0] for x in own], pa.list_(pa.int32()))], names=["y", "held"])

    got = sets_of.mapInArrow(narrowed, "y int, held array<int>").orderBy(F.xxhash64("held"), "held", "y").limit(8 * rows).collect()
    y = np.array([r["y"] for r in got], np.float64)
    share = np.where(y == 1, counts.get(1, 0) / max(n1, 1), counts.get(0, 0) / max(n0, 1))
    bias, weights, vectors = fit([np.array(r["held"], np.int64) for r in got], y, share, len(best), rank)
    return Machine(column, bias, weights, vectors)


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id, score of docs (doc_id, text): a row a row, whole texts; null texts are as empty ones, which have the bias alone. Without a
    machine all scores are 0."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # a table of fixed size

    def scored(batches):
        machine = shared.value
        for block in blocks(batches):
            n = len(block.batch)
            if machine is None:
                value = np.zeros(n)
            else:
                code, row = features(block)
                column = machine.column[code]
                known = column >= 0
                pairs = np.unique(row[known] * len(machine.weights) + column[known])
                value = machine.scores(pairs // max(len(machine.weights), 1), pairs % max(len(machine.weights), 1), n)
            yield pa.RecordBatch.from_arrays([block.batch.column("doc_id"), pa.array(value, pa.float64())], names=["doc_id", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = 6000) -> DataFrame:
    """doc_id, held_out, score, predicted of docs (doc_id, text), learned from labels of rows that aren't held out (crc32 of doc_id modulo 4 is 2).

    Other columns are not read. Equal texts have equal scores; a repeated row is scored each time; an empty table gives no rows."""
    machine = train(docs.where(~held_out()), labels.where(~held_out()), rows)
    return score(docs, machine).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
