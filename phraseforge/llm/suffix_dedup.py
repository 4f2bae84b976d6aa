"""Suffix-array dedup of byte strings, sharded by content.

Two equal 200-byte strings have the same anchor (anchors.py), at the same distance from their start. So the windows on an anchor that
occurs again are cut into two cells by that distance; the windows of a cell all hold the same bytes beside the anchor, its core,
and windows can only be equal if their cores are. The segments of one core are a group. Segments that are equal whole count as
one, and the suffixes of distinct segments are sorted by external induction (suffix_sort.py), which carries what neighbours share: those
that share 200 bytes are repeats.

A group of many distinct segments (a passage in a third of all documents, amid different text) is never sorted in one task: its cells are
halved, which makes their cores longer, and the segments go on to the next round by those; in a cell of one window all are equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import anchors
from .exchange import SEND, Packed, Texts, answer, expand, gathered, met_again, pack_texts, read, rows_of, scatter, squeeze
from .hashing import P_BYTE, SYMBOL, U, between, mix, prefix
from .shared import materialise, parts_for
from .suffix_sort import Scratch, passes, sorted_suffixes

LEVEL = 32
BLOCK = 2 << 20
#: Bytes of distinct segments that are sorted at once, and that one group may have before its cells are halved.
SHARD, GROUP = 6 << 20, 4 << 20
#: Bytes that one sort holds in memory; a shard of SHARD bytes needs about twelve times as many, so its queues lie in files.
MEMORY = 4 << 20
#: Names that end a sort's recursion in memory, at most.
BASE = 1 << 20
#: The place of a segment whose repeats are known.
TOLD = -1
FIELDS = ["bucket", "depth", "keys", "anchors", "cells", "lengths", "times", "blocks", "places", "texts"]
KINDS = [pa.int32(), pa.int32(), *[pa.binary()] * 8]
SCHEMA = "bucket int, depth int, keys binary, anchors binary, cells binary, lengths binary, times binary, blocks binary, places binary, texts binary"


def shard_marks(segments: list[bytes], length: int, scratch: Scratch) -> list[np.ndarray]:
    """For each distinct segment: which of its windows also start in another of these segments, or elsewhere in it.

    The text, the queues and all that grows with them lie in scratch files beyond the scratch's budget."""
    lengths = np.array([len(x) + 1 for x in segments])
    begin = np.concatenate([[0], np.cumsum(lengths)])
    text, flagged = scratch.array(int(begin[-1]), np.int16), scratch.array(int(begin[-1]), bool)
    for a, x in zip(begin.tolist(), segments, strict=False):
        text[a : a + len(x)] = np.frombuffer(x, np.uint8)
        text[a : a + len(x)] += 1
    ordered, beside = sorted_suffixes(text, 257, scratch, length)
    for p in passes(len(ordered) - 1):
        near = p.start + np.flatnonzero(beside[p.start + 1 : p.stop + 1] >= length)
        a, b = ordered[near], ordered[near + 1]
        inside = np.minimum(*(begin[np.searchsorted(begin, x, "right")] - 1 - x for x in (a, b))) >= length
        flagged[a[inside]] = flagged[b[inside]] = True
    return [flagged[begin[k] : begin[k] + max(0, len(x) - length + 1)] for k, x in enumerate(segments)]


def cells_of(depth: int, widest: int) -> np.ndarray:
    """Bounds of the cells of distances 0 to widest at a depth."""
    return np.unique(np.linspace(0, widest + 1, min(1 << depth, widest + 1) + 1).astype(np.int64))


def cut(raw: bytes, sums: np.ndarray, anchor: np.ndarray, nearest: np.ndarray, furthest: np.ndarray, depth: int, length: int) -> tuple[np.ndarray, ...]:
    """(index, cell, begin, end, key) of the pieces, by cells, of windows that start from `furthest` to `nearest` bytes before their anchor.

    A window starts in the cell of its distance; begin and end bound the piece's windows' bytes; key: a hash of the cell's core."""
    bounds = cells_of(depth, length - LEVEL)
    low = np.searchsorted(bounds, nearest, "right") - 1
    high = np.searchsorted(bounds, furthest, "right") - 1
    times = high - low + 1
    which = np.repeat(np.arange(len(anchor)), times)
    cell = np.repeat(low - np.cumsum(times) + times, times) + np.arange(len(which))
    near, far = np.maximum(bounds[cell], nearest[which]), np.minimum(bounds[cell + 1] - 1, furthest[which])
    at = anchor[which]
    key = between(sums, at - bounds[cell], at - (bounds[cell + 1] - 1) + length, P_BYTE)
    return which, cell, at - far, at - near + length, mix(key + cell.astype(U) + (U(depth) << U(48)))


def repeated_spans(packed: Packed, length: int) -> DataFrame:
    """(block, places): begin << 32 | end of bytes, within the block, that lie in strings of `length` bytes that occur again."""
    n_buckets = parts_for(packed.n_bytes, 8 << 20, 4)
    parts = packed.parts

    def windows_of(texts: Texts):
        s, first = SYMBOL[texts.block.data], texts.block.bounds
        at, place, hashes = anchors(s, first, length, LEVEL, P_BYTE)
        on = np.repeat(texts.known, np.diff(first))[at]
        return s, at[on], place[on], hashes

    def by_anchor(texts: Texts):
        _, _, place, hashes = windows_of(texts)
        place = np.unique(place)
        return place, hashes[place]

    def messages(depth: int, held: dict[tuple, tuple]):
        """Rows of entries (key, cell, anchor, text): [(block, place), ...]."""
        if not held:
            return
        keys = np.array([k[0] for k in held], U)
        names, values = list(held), list(held.values())
        out = []
        for bucket, i in scatter(keys, n_buckets):
            where = np.array([w for k in i for w in values[k]], np.int64)
            text = zstandard.compress(b"".join(names[k][3] for k in i), 1)
            out.append((bucket, depth, keys[i].tobytes(), *(squeeze(np.array(x, np.int64)) for x in ([names[k][2] for k in i], [names[k][1] for k in i], [len(names[k][3]) for k in i], [len(values[k]) for k in i], where[:, 0], where[:, 1])), text))
        yield rows_of(out, FIELDS, KINDS)

    def send(batches):
        held, size = {}, 0
        for texts in read(batches):
            if not len(texts.places):
                continue
            s, at, place, _ = windows_of(texts)
            known = np.zeros(len(s) + 1, bool)
            known[texts.places] = True
            at, place = at[known[place]], place[known[place]]
            edge = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]])
            anchor, furthest, nearest = place[edge[:-1]], (place - at)[edge[:-1]], (place - at)[edge[1:] - 1]
            raw = texts.block.data.tobytes()
            which, cell, begin, end, keys = cut(raw, prefix(s, P_BYTE), anchor, nearest, furthest, 1, length)
            for k, c, p, a, b in zip(keys.tolist(), cell.tolist(), (anchor[which] - begin).tolist(), begin.tolist(), end.tolist(), strict=True):
                entry = (k, c, p, raw[a:b])
                if entry in held:
                    held[entry].append((texts.number, a))
                else:
                    held[entry] = [(texts.number, a)]
                    size += b - a
            if size > SEND:
                yield from messages(1, held)
                held, size = {}, 0
        yield from messages(1, held)

    def meet(batches):
        groups: dict[tuple, dict] = {}
        sizes: dict[tuple, int] = {}
        on: dict[tuple, list] = {}  # entries of halved cells, for the next round
        told: list[tuple[int, int, int]] = []  # (block, begin, end)
        on_size, depth = 0, 1

        def halve(key: int, cell: int, anchor: int, text: bytes, where: list):
            """Pass a segment on by the halves of its cell."""
            nonlocal on_size
            symbols = SYMBOL[np.frombuffer(text, np.uint8)]
            far, near = np.array([anchor]), np.array([anchor - (len(text) - length)])
            _, cells, begin, end, keys = cut(text, prefix(symbols, P_BYTE), np.array([anchor]), near, far, depth + 1, length)
            for k, c, a, b in zip(keys.tolist(), cells.tolist(), begin.tolist(), end.tolist(), strict=True):
                entry = (k, c, anchor - a, text[a:b])
                before = on.get(entry)
                if before is None:
                    on[entry] = [(w[0], w[1] + a) if w[0] != TOLD else w for w in where]
                    on_size += b - a + 100
                    continue
                for w in (*before, *((w[0], w[1] + a) if w[0] != TOLD else w for w in where)):
                    if w[0] != TOLD:
                        told.append((w[0], w[1], w[1] + b - a))
                on[entry] = [(TOLD, TOLD)]

        def flush():
            out = []
            if told:
                block, begin, end = np.array(told, np.int64).T
                part = answer(block, begin << 32 | end, parts)
                out.append(both(part, True))
                told.clear()
            return out

        def both(batch: pa.RecordBatch, answers: bool) -> pa.RecordBatch:
            """Answers and entries of the next round as rows of one table."""
            n, mine = batch.num_rows, {name: batch.column(name) for name in batch.schema.names}
            return pa.RecordBatch.from_arrays([mine.get(name, pa.nulls(n, kind)) for name, kind in zip(["part", "answers", *FIELDS], [pa.int32(), pa.binary(), *KINDS], strict=True)], names=["part", "answers", *FIELDS])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                depth = row[1]
                keys = np.frombuffer(row[2], U).tolist()
                anchor, cell, lengths, times, blocks_, places = (expand(x).tolist() for x in row[3:9])
                texts, at, w = zstandard.decompress(row[9]), 0, 0
                for k, p, c, n, m in zip(keys, anchor, cell, lengths, times, strict=True):
                    text, where = texts[at : at + n], list(zip(blocks_[w : w + m], places[w : w + m], strict=True))
                    at, w = at + n, w + m
                    name = (k, c)
                    group = groups.setdefault(name, {})
                    if group is None:
                        halve(k, c, p, text, where)
                        continue
                    known = group.get((text, p))
                    if known is None and m == 1:
                        group[text, p] = where[0]
                    else:
                        told += [(b, a, a + n) for b, a in (where if known is None else [known, *where]) if b != TOLD]
                        group[text, p] = (TOLD, TOLD)
                    if known is None:
                        sizes[name] = sizes.get(name, 0) + n
                        if sizes[name] > GROUP and cells_of(depth, length - LEVEL)[c + 1] - cells_of(depth, length - LEVEL)[c] > 1:
                            groups[name] = None
                            for (other, q), place in group.items():
                                halve(k, c, q, other, [place])
                if len(told) > 1 << 18:
                    yield from flush()
                if on_size > SEND:
                    for x in messages(depth + 1, on):
                        yield both(x, False)
                    on.clear()
                    on_size = 0
        some: list[tuple[bytes, tuple]] = []
        size = 0

        def sort():
            for (text, place), mark in zip(some, shard_marks([t for t, _ in some], length, Scratch(MEMORY, BASE)), strict=True):
                if place[0] != TOLD and mark.any():
                    step = np.flatnonzero(np.diff(np.concatenate([[0], mark.view(np.int8), [0]])))
                    told.extend((place[0], place[1] + a, place[1] + b + length - 1) for a, b in zip(step[::2].tolist(), step[1::2].tolist(), strict=True))
            some.clear()

        while groups:
            group = groups.popitem()[1]
            if group is None or len(group) < 2:
                continue
            some += [(t, place) for (t, _), place in group.items()]
            size += sum(len(t) for t, _ in group)
            if size > SHARD:
                sort()
                size = 0
                yield from flush()
        if some:
            sort()
        yield from flush()
        for x in messages(depth + 1, on):
            yield both(x, False)

    found = met_again(packed, None, by_anchor, parts_for(packed.n_bytes * 12 * 2 / (length - LEVEL + 2), 12 << 20, 4))
    rows, answers = packed.with_places(found).mapInArrow(send, SCHEMA), None
    while True:
        met = materialise(rows.repartition(n_buckets, "bucket").mapInArrow(meet, f"part int, answers binary, {SCHEMA}"), "segments")
        told = met.where("part is not null").select("part", "answers")
        answers = told if answers is None else answers.unionByName(told)
        rows = met.where("bucket is not null").select(*FIELDS)
        if not rows.limit(1).count():
            return gathered(answers, parts)


def dedup_bytes(docs: DataFrame, length: int = 200) -> DataFrame:
    """Remove each byte covered by a `length`-byte string that also starts anywhere else, in UTF-8.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes), kept_sha256. All copies go: of
    equal long texts none stays, and none of rows that are repeated whole. Matches never cross documents. Null text is empty; texts shorter
    than `length` lose nothing. Rows without doc_id are set aside whole. Other columns are not read. An empty table gives
    no rows. Removal may cut a character; kept is binary. length: 40 or more."""
    packed = pack_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), BLOCK)

    def keep(batches):
        for texts in read(batches):
            begin, end = texts.places >> 32, texts.places & 0xFFFFFFFF
            bounds, out = texts.block.bounds, []
            cuts = np.searchsorted(begin, bounds)
            for r, (doc, known) in enumerate(zip(texts.ids.tolist(), texts.known.tolist(), strict=True)):
                raw, kept, at, removed, n_spans = texts.block.data[bounds[r] : bounds[r + 1]].tobytes(), [], 0, 0, 0
                a, b = begin[cuts[r] : cuts[r + 1]] - bounds[r], end[cuts[r] : cuts[r + 1]] - bounds[r]
                if len(a):
                    reach = np.maximum.accumulate(b)
                    new = np.concatenate([[True], a[1:] > reach[:-1]])
                    first, last = a[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(a) - 1]])]
                    n_spans, removed = len(first), int((last - first).sum())
                    for x, y in zip(first.tolist(), last.tolist(), strict=True):
                        kept.append(raw[at:x])
                        at = y
                body = b"".join([*kept, raw[at:]])
                out.append((doc if known else None, len(raw), removed, n_spans, body, hashlib.sha256(body).hexdigest()))
            yield rows_of(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()])

    return packed.with_places(repeated_spans(packed, length)).mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
