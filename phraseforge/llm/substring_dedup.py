"""Substring dedup by level-wise doubling over word windows.

Level 1 looks at windows of a quarter of the length: those that occur once are out. What is repeated there, and only that, is extended to
twice the length, and again to the full one; a full window goes on while the shorter ones in it do. The first two levels look at
anchors (anchors.py), windows that equal full windows choose alike, and at extensions that contain them. The last level finds, for
each window that is left, where it starts first. A longer repeat is a union of full windows, so no candidate is left after it.

Scale: texts are packed once and never shuffled; each level moves keys and places (exchange.py), and no pair is ever made.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import anchors
from .exchange import ANSWERS, SEND, Packed, Texts, answer, expand, gathered, home, met_again, pack_texts, read, rows_of, runs, scatter, squeeze
from .hashing import P_WORD, U, between, prefix, word_hashes
from .shared import parts_for

P_SECOND = U(0xC2B2AE3D27D4EB4F)


def starts_of(texts: Texts, symbols: np.ndarray, first: np.ndarray, window: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchors() of the rows that have a doc_id."""
    at, place, hashes = anchors(symbols, first, window, level, P_WORD)
    on = np.repeat(texts.known, np.diff(first))[at]
    return at[on], place[on], hashes


def extension(at: np.ndarray, place: np.ndarray, window: int, level: int, longer: int) -> np.ndarray:
    """Where the run of `longer` words begins that holds the anchor and lies in the window: to the anchor's right if it fits there."""
    return np.where(place - at <= window - longer, place, place + level - longer)


def later_windows(packed: Packed, window: int) -> DataFrame:
    """(block, places) of the windows whose word sequence also starts earlier: in a smaller doc_id, or the same one and further up.

    A window is known by 96 bits of hash."""
    quarter, half = window // 4, window // 2
    parts = packed.parts
    n_buckets = lambda symbols: parts_for(packed.n_bytes / 5.5 * symbols, 12 << 20, 4)

    def by_quarter(texts: Texts):
        symbols, _, _, first = word_hashes(texts.block)
        _, place, hashes = starts_of(texts, symbols, first, window, quarter)
        place = np.unique(place)
        return place, hashes[place]

    def survivors(texts: Texts, symbols, first, level):
        at, place, _ = starts_of(texts, symbols, first, window, quarter)
        on = np.zeros(len(symbols) + 1, bool)
        on[texts.places] = True
        to = place if level == quarter else extension(at, place, window, quarter, level)
        return at[on[to]], place[on[to]]

    def by_half(texts: Texts):
        symbols, _, _, first = word_hashes(texts.block)
        begin = np.unique(extension(*survivors(texts, symbols, first, quarter), window, quarter, half))
        return begin, between(prefix(symbols, P_WORD), begin, begin + half, P_WORD)

    found = met_again(packed, None, by_quarter, n_buckets(12 * 2 / (window - quarter + 2)))
    found = met_again(packed, found, by_half, n_buckets(12 * 2 / (window - quarter + 2)))
    last = n_buckets(16)
    names, kinds = ["bucket", "decided", "blocks", "docs", "places", "keys"], [pa.int32(), pa.bool_(), *[pa.binary()] * 4]
    key_kind = np.dtype([("a", U), ("b", np.uint32)])

    def ordered(block, doc, place, keys):
        """Entries by key, then by place in the corpus, and whether an entry has an earlier one."""
        order = np.lexsort((place, block, doc, keys["b"], keys["a"]))
        again = np.zeros(len(order), bool)
        again[1:] = keys[order][1:] == keys[order][:-1]
        return order, again

    def send(batches):
        held, size = [], 0

        def flush():
            block, doc, place, keys = (np.concatenate(x) for x in zip(*held, strict=True))
            order, again = ordered(block, doc, place, keys)
            out, late = [], np.sort(order[again])
            if len(late):  # an earlier one is in this very task: decided
                out.append((home(block[late[0]], last), True, squeeze(block[late]), b"", squeeze(place[late]), b""))
            kept = np.sort(order[~again])
            block, doc, place, keys = block[kept], doc[kept], place[kept], keys[kept]
            return rows_of(out + [(b, False, squeeze(block[i]), squeeze(doc[i]), squeeze(place[i]), keys[i].tobytes()) for b, i in scatter(keys["a"], last)], names, kinds)

        for texts in read(batches):
            if not len(texts.places):
                continue
            symbols, _, _, first = word_hashes(texts.block)
            at, _ = survivors(texts, symbols, first, half)
            if not len(at):
                continue
            keys = np.empty(len(at), key_kind)
            keys["a"] = between(prefix(symbols, P_WORD), at, at + window, P_WORD)
            keys["b"] = between(prefix(word_hashes(texts.block, seed=1)[0], P_SECOND), at, at + window, P_SECOND) >> U(32)
            held.append((np.full(len(at), texts.number, np.int64), np.repeat(texts.ids, np.diff(first))[at], at, keys))
            size += 16 * len(at)
            if size > SEND:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def meet(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for b, decided, block, doc, place, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block, place = expand(block), expand(place)
                if decided:
                    yield answer(block, place, parts)
                else:
                    held.setdefault(b, []).append((block, expand(doc), place, np.frombuffer(keys, key_kind)))
        while held:
            block, doc, place, keys = (np.concatenate(x) for x in zip(*held.popitem()[1], strict=True))
            order, again = ordered(block, doc, place, keys)
            if again.any():
                yield answer(block[order[again]], place[order[again]], parts)

    sent = packed.with_places(found).mapInArrow(send, "bucket int, decided boolean, blocks binary, docs binary, places binary, keys binary")
    return gathered(sent.repartition(last, "bucket").mapInArrow(meet, ANSWERS), parts)


def dedup_substrings(docs: DataFrame, window: int = 20) -> DataFrame:
    """Remove each word covered by a `window`-word run that also starts earlier in the corpus.

    Returns one row a document: doc_id, n_words, n_removed, kept_text (kept words joined by one space), kept_sha256. Null text,
    empty text and text of spaces have no words. Texts shorter than the window lose nothing. Of equal texts the one with the smallest
    doc_id stays whole; of rows that repeat a doc_id, one counts as the earlier one, so a text of repeated rows stays once. Rows without
    doc_id are set aside whole. Other columns are not read. window: four or more. An empty table gives no rows."""
    packed = pack_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))

    def keep(batches):
        for texts in read(batches):
            begin, _, first = texts.block.words()
            gone = np.zeros(len(begin) + 1, np.int64)
            np.add.at(gone, texts.places, 1)  # windows lie in their row
            np.add.at(gone, texts.places + window, -1)
            stays = np.cumsum(gone)[:-1] == 0
            out = []
            for r, (doc, known) in enumerate(zip(texts.ids.tolist(), texts.known.tolist(), strict=True)):
                here = stays[first[r] : first[r + 1]]
                kept = texts.block.data[texts.block.bounds[r] : texts.block.bounds[r + 1]].tobytes().split()  # of bytes: at the same characters
                kept = b" ".join(kept if here.all() else [kept[i] for i in np.flatnonzero(here)])
                out.append((doc if known else None, len(here), int((~here).sum()), kept.decode(), hashlib.sha256(kept).hexdigest()))
            yield rows_of(out, ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()])

    return packed.with_places(later_windows(packed, window)).mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
