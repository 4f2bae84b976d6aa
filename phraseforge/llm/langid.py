"""Language identification in two steps: the family first, then one-versus-one linear SVMs within the family.

A text is the mean of hashed letter trigrams over its whole length, so a classifier's margin is the mean of a table look-up,
and a block of texts is scored in a few passes over its bytes.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import Block, blocks

#: Languages that are close to each other. One without an entry is a family of its own.
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance"}
DIMS = 1 << 13
SCALE = 20.0
UNKNOWN = "und"

#: Bytes as symbols: letters in lower case, bytes of longer characters as they are, all else one blank.
SYMBOL = np.zeros(256, np.uint32)
SYMBOL[97:123] = SYMBOL[65:91] = np.arange(1, 27)
SYMBOL[128:] = np.arange(27, 155)


def trigrams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the trigram at each byte, DIMS where none counts; the rows' bounds)."""
    s = np.zeros(len(block.data) + 2, np.uint32)
    s[:-2] = SYMBOL[block.data]
    code = (s[:-2] * np.uint32(0x9E3779B1)) ^ (s[1:-1] * np.uint32(0x85EBCA77)) ^ (s[2:] * np.uint32(0xC2B2AE3D))
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    out = (code >> np.uint32(32 - 13)).astype(np.int32)
    out[(s[:-2] == 0) & (s[1:-1] == 0)] = DIMS
    ends = block.bounds[1:]
    for back in (1, 2):  # a trigram must lie in one row
        at = ends - back
        out[at[at >= block.bounds[:-1]]] = DIMS
    return out, block.bounds


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 12) -> np.ndarray:
    """Linear SVM (squared hinge loss) by dual coordinate descent on rows of x, which has a column of ones for the bias. y: 1 or -1."""
    w, alpha = np.zeros(x.shape[1], np.float32), np.zeros(len(rows))
    diagonal, rng = np.einsum("ij,ij->i", x, x)[rows] + 0.5 / cost, np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            one = x[rows[i]]
            step = max(0.0, alpha[i] - (y[i] * float(one @ w) - 1 + alpha[i] * 0.5 / cost) / diagonal[i])
            w += np.float32((step - alpha[i]) * y[i]) * one
            alpha[i] = step
    return w


class Model:
    """Pairs of classes at both levels, and a column of weights for each pair."""

    def __init__(self, x: np.ndarray, labels: list[str], families: dict[str, str]):
        self.languages = sorted(set(labels))
        self.family = {k: families.get(k, k) for k in self.languages}
        self.pairs: list[tuple[str, str]] = []
        columns = []
        own = np.array([self.family[k] for k in labels])
        labels = np.array(labels)
        for names, of in [(sorted(set(own)), own)] + [(sorted(k for k in self.languages if self.family[k] == f), labels) for f in sorted(set(own))]:
            for a, b in combinations(names, 2):
                pick = np.flatnonzero((of == a) | (of == b))
                columns.append(svm(x, pick, np.where(of[pick] == a, 1.0, -1.0)))
                self.pairs.append((a, b) if of is labels else (f"family:{a}", f"family:{b}"))
        self.weights = np.array(columns, np.float64).reshape(len(columns), DIMS + 1).T

    def choose(self, margins: np.ndarray, names: list[str], tag: str = "") -> tuple[np.ndarray, np.ndarray]:
        """(index of the name with most votes, ties by summed margin; the least margin by which it won) for each row."""
        votes, total = np.zeros((2, len(margins), len(names)))
        least = np.full((len(margins), len(names)), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            if a.startswith(tag) and a[len(tag) :] in names and b[len(tag) :] in names and a.startswith("family:") == bool(tag):
                for name, m in ((a, margins[:, k]), (b, -margins[:, k])):
                    j = names.index(name[len(tag) :])
                    votes[:, j] += m > 0
                    total[:, j] += m
                    least[:, j] = np.minimum(least[:, j], m)
        best = np.argmax(votes + 0.5 * np.tanh(total) / 2, axis=1)
        return best, least[np.arange(len(margins)), best]

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        families = sorted(set(self.family.values()))
        which, sure = self.choose(margins, families, "family:")
        out, least = np.empty(len(margins), object), np.zeros(len(margins))
        for k, f in enumerate(families):
            names, rows = [x for x in self.languages if self.family[x] == f], which == k
            if rows.any():
                best, m = self.choose(margins[rows], names)
                out[rows], least[rows] = np.array(names, object)[best], np.minimum(m, sure[rows])
        return out, 1 / (1 + np.exp(-np.clip(3 * least, -50, 50)))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def train(labelled: DataFrame, rows: int = 1200, families: dict[str, str] | None = None) -> Model | None:
    """Fit on a sample of text, lang (both non-null) of about `rows` rows at most, equally many for each language if there are.

    The sample is taken by a hash of doc_id, and whole texts are used. The bound keeps the driver's work fixed; only sums by
    trigram bucket reach it. None if nothing is labelled."""
    labelled = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, rows / len(counts) / n))))
    picked = labelled.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)

    def features(batches):
        for block in blocks(batches):
            code, bounds = trigrams(block)
            for r, lang in enumerate(block.batch.column("lang").to_pylist()):
                at, n = np.unique(code[bounds[r] : bounds[r + 1]], return_counts=True)
                n = n[at < DIMS]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang], pa.string()), "at": pa.array([at[: len(n)].astype(np.int32).tobytes()], pa.binary()), "n": pa.array([n.astype(np.float32).tobytes()], pa.binary())})

    got = picked.mapInArrow(features, "lang string, at binary, n binary").orderBy(F.xxhash64("n", "at", "lang")).limit(2 * rows).collect()
    x = np.zeros((len(got), DIMS + 1), np.float32)
    for i, r in enumerate(got):
        n = np.frombuffer(r["n"], np.float32)
        x[i, np.frombuffer(r["at"], np.int32)] = n / max(1.0, n.sum()) * SCALE
    x[:, DIMS] = 1
    return Model(x, [r["lang"] for r in got], FAMILIES if families is None else families)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score (0 to 1; 0 for `und`). Null texts and texts without a letter are `und`; so is all
    without a model. Columns of docs of these names give way."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size a pair of languages
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def score(batches):
        model = shared.value
        if model is not None:
            table = np.vstack([model.weights[:DIMS], np.zeros((1, model.weights.shape[1]))]).astype(np.float32)
        for block in blocks(batches):
            n = len(block.batch)
            ascii_letter = ((block.data | 0x20) >= 97) & ((block.data | 0x20) <= 122)
            known = row_sums(ascii_letter, block.bounds) > 0
            for r in np.flatnonzero(~known):
                known[r] = any(map(str.isalpha, block.data[block.bounds[r] : block.bounds[r + 1]].tobytes().decode()))
            if model is None:
                lang, sure = np.full(n, UNKNOWN, object), np.zeros(n)
            else:
                code, bounds = trigrams(block)
                counted = row_sums(code < DIMS, bounds)
                sums = np.stack([row_sums(table[:, k][code], bounds) for k in range(table.shape[1])], 1) if table.shape[1] else np.zeros((n, 0))
                margins = sums / np.maximum(counted, 1)[:, None] * SCALE + model.weights[DIMS]
                lang, sure = model.predict(margins)
                lang[~known], sure[~known] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([*block.batch.columns, pa.array(list(lang), pa.string()), pa.array(sure, pa.float64())], names=[*block.batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(score, schema)


def identify(docs: DataFrame, rows: int = 1200, families: dict[str, str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Learns from text and lang of rows that aren't held out (crc32 of doc_id modulo 5)."""
    model = train(docs.where(~held_out()), rows, families)
    return predict(docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
