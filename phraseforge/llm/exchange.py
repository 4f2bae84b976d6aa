"""Texts packed for several passes, and what the passes ask of each other.

Operators that look for repeated passages go over the texts level by level: each pass sends keys of candidate places, and the next
one goes on with the places whose key was met again. Texts are packed once into compressed blocks, in a table bucketed by block,
so that no pass moves them; only keys and places are shuffled, packed by bucket, a key once for each block that has it. So a key
as common as you like costs one entry a block, and no filter of the whole corpus is ever held in one place.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U, Block, blocks, mix
from .shared import parts_for, shared_dir, text_bytes

BLOCK = 4 << 20
#: Bytes of keys that a task gathers before it sends them.
SEND = 24 << 20
#: Spark takes no more buckets for a table than this; beyond, buckets hold more blocks, which are read one by one.
MOST_BUCKETS = 50_000


@dataclass
class Packed:
    table: DataFrame
    n_bytes: int
    parts: int

    def with_places(self, found: DataFrame | None) -> DataFrame:
        """The blocks with `places` (see squeeze; null where found has none); only `found` is shuffled."""
        if found is None:
            return self.table.withColumn("places", F.lit(None).cast("binary"))
        return self.table.join(found.repartition(self.parts, "block").hint("shuffle_hash"), "block", "left")


def pack_texts(docs: DataFrame, size: int = BLOCK) -> Packed:
    """docs (doc_id long, text string) as written blocks of whole rows, of about `size` bytes of text each, one row at least."""
    spark = docs.sparkSession

    def make(batches):
        part, zipper = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=3)
        for number, block in enumerate(blocks(batches, size=size)):
            ids = block.batch.column("doc_id")
            known = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), bool)
            packed = [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), np.packbits(known).tobytes(), block.bounds.astype(np.int64).tobytes(), zipper.compress(block.data.tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | number], pa.int64()), *(pa.array([x], pa.binary()) for x in packed)], names=["block", "ids", "known", "bounds", "body"])

    n_bytes = text_bytes(docs)
    parts = min(MOST_BUCKETS, parts_for(n_bytes, 32 << 20))
    name = f"texts_{uuid.uuid4().hex}"
    made = docs.select("doc_id", "text").mapInArrow(make, "block long, ids binary, known binary, bounds binary, body binary")
    made.write.format("parquet").option("path", f"{shared_dir(spark)}/{name}").option("compression", "none").bucketBy(parts, "block").saveAsTable(name)
    return Packed(spark.table(name), n_bytes, parts)


@dataclass
class Texts:
    """A block that is read back: its number, the rows' doc_id (and whether they have one), and the places that were found."""

    number: int
    ids: np.ndarray
    known: np.ndarray
    block: Block
    places: np.ndarray


def read(batches: Iterable[pa.RecordBatch]) -> Iterator[Texts]:
    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        for number, ids, known, bounds, body, places in zip(*(batch.column(c) for c in ("block", "ids", "known", "bounds", "body", "places")), strict=True):
            ids = np.frombuffer(ids.as_py(), np.int64)
            data = np.frombuffer(unzip.decompress(body.as_py()), np.uint8)
            block = Block(None, data, np.frombuffer(bounds.as_py(), np.int64))
            yield Texts(number.as_py(), ids, np.unpackbits(np.frombuffer(known.as_py(), np.uint8), count=len(ids)).astype(bool), block, expand(places.as_py()) if places.is_valid else np.zeros(0, np.int64))


def runs(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins, and the end."""
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]) if len(values) else np.zeros(1, np.int64)


def scatter(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices of its keys in order), by the keys' upper bits."""
    bucket = ((keys >> U(32)) % U(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), order[cuts[b] : cuts[b + 1]]


def home(number: int, n: int) -> int:
    """The bucket that takes what a block has decided alone."""
    return int(mix(np.array([number], np.int64).view(U))[0] % U(n))


def squeeze(values: np.ndarray) -> bytes:
    """Ascending or alike integers, as compressed differences."""
    return zstandard.compress(np.diff(values.astype(np.int64), prepend=np.int64(0)).tobytes(), 1)


def expand(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(raw), np.int64))


def rows_of(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)


ANSWERS = "part int, answers binary"


def answer(blocks_: np.ndarray, places: np.ndarray, parts: int) -> pa.RecordBatch:
    """Places packed by a hash of their block."""
    order = np.lexsort((places, blocks_))
    blocks_, places = blocks_[order], places[order]
    out = [(p, np.stack([blocks_[i], places[i]]).tobytes()) for p, i in scatter(mix(blocks_.astype(np.int64).view(U)), parts)]
    return rows_of([(p, zstandard.compress(x, 1)) for p, x in out], ["part", "answers"], [pa.int32(), pa.binary()])


def gathered(answers: DataFrame, parts: int) -> DataFrame:
    """(block, places): one row for each block that has an answer."""

    def gather(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("answers").to_pylist(), strict=True):
                held.setdefault(part, []).append(np.frombuffer(zstandard.decompress(raw), np.int64).reshape(2, -1))
        while held:
            block, place = np.concatenate(held.popitem()[1], axis=1)
            order = np.lexsort((place, block))
            block, place = block[order], place[order]
            at = runs(block)
            yield rows_of([(int(block[a]), squeeze(np.unique(place[a:b]))) for a, b in zip(at, at[1:], strict=False)], ["block", "places"], [pa.int64(), pa.binary()])

    return answers.repartition(parts, "part").mapInArrow(gather, "block long, places binary")


#: keys(texts) -> (places in the block, their keys)
Keys = Callable[[Texts], tuple[np.ndarray, np.ndarray]]


def met_again(packed: Packed, found: DataFrame | None, keys_of: Keys, n_buckets: int) -> DataFrame:
    """(block, places) of the places whose 64-bit key occurs at two places or more anywhere."""

    parts = packed.parts
    n_tasks, n_buckets = n_buckets, 4 * n_buckets  # several to a task, so that tasks get about as much each

    def send(batches):
        held, size = [], 0
        names, kinds = ["bucket", "decided", "blocks", "places", "keys"], [pa.int32(), pa.bool_(), *[pa.binary()] * 3]

        def flush():
            block = np.concatenate([np.full(len(k), b, np.int64) for b, k, _ in held])
            keys, places = (np.concatenate([x[j] for x in held]) for j in (1, 2))
            order = np.argsort(keys, kind="stable")
            cut = runs(keys[order])
            many = np.diff(cut) > 1
            again = order[np.repeat(many, np.diff(cut))]
            again = np.sort(again[places[again] >= 0])
            kept = order[cut[:-1]]
            out = [(home(block[again[0]], n_buckets), True, squeeze(block[again]), squeeze(places[again]), b"")] if len(again) else []
            places[kept[many]] = -1  # decided here; others need but know the key
            kept = np.sort(kept)
            block, places, keys = block[kept], places[kept], keys[kept]
            out += [(b, False, squeeze(block[i]), squeeze(places[i]), keys[i].tobytes()) for b, i in scatter(keys, n_buckets)]
            return rows_of(out, names, kinds)

        for texts in read(batches):
            at, keys = keys_of(texts)
            if len(at):
                held.append((texts.number, keys, at))
                size += 12 * len(at)
            if size > SEND:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def meet(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for b, decided, block, places, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block, places = expand(block), expand(places)
                if decided:
                    yield answer(block, places, parts)
                else:
                    held.setdefault(b, []).append((block, places.astype(np.int32), np.frombuffer(keys, U)))
        while held:
            block, places, keys = (np.concatenate(x) for x in zip(*held.popitem()[1], strict=True))
            order = np.argsort(keys, kind="stable")
            cut = runs(keys[order])
            many = np.logical_or(np.diff(cut) > 1, np.minimum.reduceat(places[order], cut[:-1]) < 0)
            hits = order[np.repeat(many, np.diff(cut))]
            hits = hits[places[hits] >= 0]
            if len(hits):
                yield answer(block[hits], places[hits], parts)

    sent = packed.with_places(found).mapInArrow(send, "bucket int, decided boolean, blocks binary, places binary, keys binary")
    return gathered(sent.repartition(n_tasks, "bucket").mapInArrow(meet, ANSWERS), parts)
