"""Benchmark decontamination by template canonicalisation.

Words lose case and punctuation; numbers, names and units become typed placeholders. Windows of such words are templates, and
documents meet benchmark items by a hash join on them. Along one alignment of a document and an item, the fillers of equal slots
should be consistent: an item's filler always has the same filler in the document. That is so for copies and for re-parameterised
questions, and not for texts that only share phrases. Windows that hold a contradiction don't count (agreeing() has the rules).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .hashing import P_BYTE, P_WORD, SPACE, SYMBOL, U, Block, between, blocks, mix, prefix, windows
from .shared import materialise

WINDOW = 8
#: A window with fewer literal words than this says too little.
LITERALS = 4
#: An item whose windows say too little is a template as a whole, if it has so many words, and so many literals, and numbers or units, among them.
WHOLE, WHOLE_LITERALS, WHOLE_NUMBERS = 5, 3, 2
#: Words in a row that are a leak whatever the item's length: word for word, and as templates or on an alignment whose equal slots
#: are filled in contradiction.
RUN = 13
LONG_RUN = 26
#: Fixed list: units of measure and money, as canonical words.
UNITS = "mm cm m km in ft yd mi mg g kg lb oz ml l s sec min h hr hours minutes seconds days weeks months years percent dollars euros usd eur kmh mph meters metres kilometers miles grams kilograms pounds liters litres degrees".split()
NUMBER, NAME, UNIT = (mix(np.array([k], U))[0] for k in (0xA11CE, 0xB0B, 0xCAFE))


def _literal() -> tuple[np.ndarray, np.ndarray]:
    """Bytes that count in a word (letters, digits, bytes of longer characters), and their symbols with A-Z as a-z."""
    counts = np.zeros(256, bool)
    counts[48:58] = counts[65:91] = counts[97:123] = counts[128:] = True
    table = SYMBOL.copy()
    table[65:91] = table[97:123]
    return counts, table


COUNTS, TABLE = _literal()
UNIT_HASHES = np.array([between(prefix(TABLE[np.frombuffer(u.encode(), np.uint8)], P_BYTE), np.array([0]), np.array([len(u)]), P_BYTE)[0] for u in UNITS], U)


def canonical(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word symbols, the words' own symbols, slot flags, those of names, byte starts, byte ends, first word of each row).

    Words of punctuation alone are left out."""
    starts, ends, _ = block.words()
    data = block.data.copy()
    data[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] += 0x20  # capitals with accents
    solid = COUNTS[data]
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(solid, out=kept[1:])
    a, b = kept[starts], kept[ends]
    on = b > a
    starts, ends, a, b = starts[on], ends[on], a[on], b[on]
    body = data[solid]
    symbols = between(prefix(TABLE[body], P_BYTE), a, b, P_BYTE)
    total = lambda flags: (c := np.concatenate([[0], np.cumsum(flags)]))[b] - c[a]
    digit = total((body >= 48) & (body <= 57)) > 0
    upper = (body >= 65) & (body <= 90)
    first_upper = upper[a] if len(a) else np.zeros(0, bool)
    # a sentence starts after . ! ? or :, at a line's start and at a row's start
    before = np.maximum(starts - 1, 0)
    last = data[np.maximum(np.concatenate([[0], ends[:-1]]) - 1, 0)] if len(starts) else np.zeros(0, np.uint8)
    new = np.isin(last, np.frombuffer(b".!?:", np.uint8)) | np.isin(data[before], [10, 13]) if len(starts) else np.zeros(0, bool)
    first = np.searchsorted(starts, block.bounds)
    opens = first[:-1][first[:-1] < first[1:]]
    new[opens] = True
    name = first_upper & (total(upper) == 1) & (b - a > 1) & ~new & ~digit
    unit = np.isin(symbols, UNIT_HASHES) & np.concatenate([[False], digit[:-1]])[: len(digit)]  # after a number only
    unit[opens] = False
    out = np.where(digit, NUMBER, np.where(unit, UNIT, np.where(name, NAME, symbols)))
    return out, symbols, digit | unit | name, name & ~unit, starts, ends, first


def templates(table: DataFrame, key: str, window: int = WINDOW, known: np.ndarray | None = None, lengths: list[int] | None = None, as_key: str = "id", as_at: str = "at", as_slots: str = "slots") -> DataFrame:
    """(hash, id, at, full, slots): the windows of each row; with `known`, those that pass that filter only.

    slots: the canonical fillers of the placeholders in the window, in order. full: the window has LITERALS literal words or more
    and is hashed as a template; one with fewer, names counted as literals, is hashed by its own words and has no slots. One with
    names is hashed a second time with the names as literals: what is a name hangs on case and line breaks. A row
    of fewer words than the window has one window, all its words; with `lengths`, all runs of so many words, each once a row."""
    shared = None if known is None else table.sparkSession.sparkContext.broadcast(known)  # bounded: bloom.MAX_BITS

    def send(batches):
        for block in blocks(batches):
            symbols, own, slot, named, starts, ends, first = canonical(block)
            ids = np.asarray(block.batch.column(key).to_numpy(zero_copy_only=False))
            filled, typed = (np.concatenate([[0], np.cumsum(x)]) for x in (slot, slot & ~named))
            count = lambda sums, at: sums[at + window] - sums[at]
            found = []
            at, hashes = windows(symbols, first, window)
            on = window - count(filled, at) >= LITERALS
            found.append((at[on], hashes[on], True, slot))
            blind = np.where(named, own, symbols)
            at, hashes = windows(blind, first, window)
            on = (window - count(typed, at) >= LITERALS) & (count(filled, at) > count(typed, at))
            found.append((at[on], hashes[on], window - count(filled, at[on]) >= LITERALS, slot & ~named))
            at, hashes = windows(own, first, window)
            on = window - count(typed, at) < LITERALS
            found.append((at[on], hashes[on], False, None))
            if lengths is None:
                sums = prefix(own, P_WORD)
                few = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < window))
                found.append((first[few], between(sums, first[few], first[few + 1], P_WORD), False, None))
            for n in lengths or ():
                found.append((*windows(own, first, n), False, None))
            for k, (at, hashes, full, holes) in enumerate(found):
                full = np.broadcast_to(full, len(at))
                if shared is not None:
                    on = bloom.passes(hashes, shared.value)
                    at, hashes, full = at[on], hashes[on], full[on]
                rows = np.searchsorted(first, at, "right") - 1
                if k > 2 and len(at):
                    order = np.lexsort((at, hashes, rows))
                    again = np.concatenate([[False], (np.diff(hashes[order]) == 0) & (np.diff(rows[order]) == 0)])
                    at, hashes, rows = (x[order[~again]] for x in (at, hashes, rows))
                    full = full[: len(at)]
                word = lambda i: bytes(c for c in block.data[starts[i] : ends[i]].tobytes().lower() if COUNTS[c]).decode("utf-8", "replace")
                slots = [[word(i) for i in range(x, x + window) if holes[i]] if holes is not None and filled[x + window] > filled[x] else [] for x in at]
                yield pa.RecordBatch.from_pydict({"hash": pa.array(hashes.view(np.int64)), as_key: pa.array(ids[rows], pa.int64()), as_at: pa.array(at - first[rows], pa.int64()), "full": pa.array(full, pa.bool_()), as_slots: pa.array(slots, pa.list_(pa.string()))})

    return table.mapInArrow(send, f"hash long, {as_key} long, {as_at} long, full boolean, {as_slots} array<string>")


def whole_templates(table: DataFrame, key: str, lengths: list[int] | None = None, known: np.ndarray | None = None) -> DataFrame:
    """(hash, key, slots): without `lengths`, items as templates of their own length, if they have WHOLE_LITERALS literals and WHOLE_NUMBERS numbers, and fewer than half
    of their windows, or none, are templates by themselves. With `lengths`, the runs of so many words of any row that pass the filter."""
    shared = None if known is None else table.sparkSession.sparkContext.broadcast(known)  # bounded: bloom.MAX_BITS

    def send(batches):
        for block in blocks(batches):
            symbols, _, slot, named, starts, ends, first = canonical(block)
            ids = np.asarray(block.batch.column(key).to_numpy(zero_copy_only=False))
            filled, typed = (np.concatenate([[0], np.cumsum(x)]) for x in (slot, slot & ~named))
            size = np.diff(first)
            rows = np.repeat(np.arange(len(size)), size)
            if lengths is None:
                sums = prefix(symbols, P_WORD)
                at = first[:-1][size >= WHOLE]
                n, end = size[size >= WHOLE], first[1:][size >= WHOLE]
                free = WINDOW - (filled[WINDOW:] - filled[:-WINDOW]) if len(symbols) >= WINDOW else np.zeros(0, np.int64)
                plain = np.concatenate([[0], np.cumsum(free >= LITERALS)])
                last = np.maximum(end - WINDOW + 1, at)
                good = plain[np.minimum(last, len(plain) - 1)] - plain[np.minimum(at, len(plain) - 1)]
                slots = filled[end] - filled[at]
                on = (typed[end] - typed[at] >= WHOLE_NUMBERS) & (n - slots >= WHOLE_LITERALS) & ((n < WINDOW) | (2 * good < n - WINDOW + 1))
                found = [(at[on], n[on], between(sums, at[on], end[on], P_WORD))]
            else:
                found = []
                for n in lengths:
                    at, hashes = windows(symbols, first, n)
                    on = (filled[at + n] - filled[at] > 0) & bloom.passes(hashes, shared.value)
                    found.append((at[on], np.full(on.sum(), n), hashes[on]))
            for at, n, hashes in found:
                word = lambda i: bytes(c for c in block.data[starts[i] : ends[i]].tobytes().lower() if COUNTS[c]).decode("utf-8", "replace")
                slots = [[word(i) for i in range(x, x + k) if slot[i]] for x, k in zip(at, n)]
                yield pa.RecordBatch.from_pydict({"hash": pa.array(hashes.view(np.int64)), key: pa.array(ids[rows[at]] if len(at) else ids[:0], pa.int64()), "n_words": pa.array(n, pa.int32()), "slots": pa.array(slots, pa.list_(pa.string()))})

    return table.mapInArrow(send, f"hash long, {key} long, n_words int, slots array<string>")


def reparameterised(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, verbatim): documents with a run of words that is the whole template of an item which windows can't find, where equal
    fillers of the item have equal ones in the document."""
    asked = materialise(whole_templates(items, "item_id"), "whole-items")
    lengths = sorted(r["n_words"] for r in asked.select("n_words").distinct().collect())  # lengths of items, each one scan of a block
    none = asked.select(F.lit(0).cast("long").alias("doc_id"), "item_id", F.lit(True).alias("verbatim")).where("false")
    if not lengths:
        return none

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"keys": pa.array([batch.column("hash").to_numpy().tobytes()], pa.binary())})

    known = bloom.build(asked.select("hash").mapInArrow(pack, "keys binary"), bloom.bits_for(asked.count()))
    met = whole_templates(docs, "doc_id", lengths=lengths, known=known).withColumnRenamed("slots", "doc_slots").join(asked.withColumnRenamed("slots", "item_slots"), ["hash", "n_words"])
    same = F.zip_with("item_slots", "doc_slots", lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    consistent = F.size(F.array_distinct("pairs")) == F.size(F.array_distinct("item_slots"))  # one filler for each of the item's
    return met.withColumn("pairs", same).where(consistent).groupBy("doc_id", "item_id").agg(F.max(F.col("item_slots") == F.col("doc_slots")).alias("verbatim"))


def longest(places: list[int], window: int) -> int:
    """Words in a row that windows at these ascending places cover."""
    best = run = 0
    for k, x in enumerate(places):
        run = run + 1 if k and x == places[k - 1] + 1 else 1
        best = max(best, run)
    return best + window - 1 if best else 0


def agreeing(met: list[dict], window: int) -> list[tuple[int, bool, bool, bool]]:
    """(item_at, full, same, held) of the windows that count, of one alignment's (item_at, full, item_slots, doc_slots).

    same: all fillers on the alignment are the item's. A filler of the item with several fillers in the document contradicts
    itself, and windows that hold it count only where they have the item's own. If the item's own filler is among them, the document keeps it in one
    place and changes it in another: then nothing counts, unless the rest covers LONG_RUN words in a row.

    held: the windows that count cover LONG_RUN words in a row, or those with the item's own fillers RUN."""
    fills: dict[str, set[str]] = {}
    for w in met:
        for x, y in zip(w["item_slots"], w["doc_slots"], strict=True):
            fills.setdefault(x, set()).add(y)
    clash = {x for x, y in fills.items() if len(y) > 1}
    spots = {}
    for w in met:
        if w["item_slots"] == w["doc_slots"] or not clash.intersection(w["item_slots"]):
            spots[w["item_at"]] = w["full"] or spots.get(w["item_at"], False)
    held = longest(sorted(spots), window) >= LONG_RUN
    if any(x in fills[x] for x in clash) and not held:
        return []
    held = held or longest(sorted({w["item_at"] for w in met if w["item_slots"] == w["doc_slots"]}), window) >= RUN
    same = all(y == {x} for x, y in fills.items())
    return [(at, full, same, held) for at, full in spots.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: float = 0.5) -> DataFrame:
    """doc_id, item_id, n_windows, n_found, coverage, verbatim: documents that hold `least` or more of an item, or a long run of it.

    A run of RUN words on one alignment is long if it is word for word, one of LONG_RUN if it is a template; so the length of the
    item doesn't matter. coverage: the greater of two shares, of the item's windows and of those that are templates (n_windows and n_found belong to
    it). verbatim: no placeholder is filled otherwise than in the item. Windows with too few literal words for a template count
    where their words are equal. An item with fewer words than the window is found where all its words stand in a row; one of
    a single word is so found wherever the word is. An item of WHOLE words or more, half of whose windows aren't templates, is also found by its
    whole template (reparameterised()); it has one window then. Null and empty texts hold nothing, and texts without words are never
    found. Rows without an id are left out; rows that repeat an id count as one text. Other columns are not read. Empty tables
    give no rows.

    The benchmark's windows make a filter of bounded size for the scan of the documents; what passes, a small part, is
    joined by hash. A window in a third of all documents is one build row for each item that has it."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    asked = templates(items, "item_id", window, as_key="item_id", as_at="item_at", as_slots="item_slots")
    asked = materialise(asked, "item-windows")

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"keys": pa.array([batch.column("hash").to_numpy().tobytes()], pa.binary())})

    def count(batches):
        for block in blocks(batches):
            n = np.unique(np.diff(canonical(block)[-1]))
            yield pa.RecordBatch.from_pydict({"n": pa.array(n[(n > 0) & (n < window)], pa.int64())})

    n = asked.count()
    lengths = [r.n for r in items.mapInArrow(count, "n long").distinct().collect()]  # window - 1 at most
    known = bloom.build(asked.select("hash").mapInArrow(pack, "keys binary"), bloom.bits_for(n))
    sizes = asked.groupBy("item_id").agg(F.countDistinct("item_at").alias("n_all"), F.countDistinct(F.when(F.col("full"), F.col("item_at"))).alias("n_full"))
    met = templates(docs, "doc_id", window, known, lengths, "doc_id", "doc_at", "doc_slots").drop("full").join(asked, "hash")
    met = met.withColumn("shift", F.col("doc_at") - F.col("item_at"))
    line = ["doc_id", "item_id", "shift"]
    lines = met.groupBy(*line).agg(F.collect_list(F.struct("item_at", "full", "item_slots", "doc_slots")).alias("met"))  # an item's windows at most

    def judge(batches):
        for batch in batches:
            out = []
            for doc, item, windows_met in zip(batch.column("doc_id").to_pylist(), batch.column("item_id").to_pylist(), batch.column("met"), strict=True):
                out += [(doc, item, *spot) for spot in agreeing(windows_met.as_py(), window)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()), strict=True)], names=["doc_id", "item_id", "item_at", "full", "same", "held"])

    spots = lines.select("doc_id", "item_id", "met").mapInArrow(judge, "doc_id long, item_id long, item_at long, full boolean, same boolean, held boolean")
    spots = spots.groupBy("doc_id", "item_id").agg(F.countDistinct("item_at").alias("all"), F.countDistinct(F.when(F.col("full"), F.col("item_at"))).alias("of_full"), F.min("same").alias("verbatim"), F.max("held").alias("held"))
    out = spots.join(sizes, "item_id").withColumn("by_full", F.coalesce(F.col("of_full") / F.nullif("n_full", F.lit(0)) > F.col("all") / F.col("n_all"), F.lit(False)))
    out = out.withColumns({"n_windows": F.when(F.col("by_full"), F.col("n_full")).otherwise(F.col("n_all")), "n_found": F.when(F.col("by_full"), F.col("of_full")).otherwise(F.col("all"))})
    out = out.withColumn("coverage", F.col("n_found") / F.col("n_windows"))
    out = out.where((F.col("coverage") >= least) | F.col("held")).select("doc_id", "item_id", "n_windows", "n_found", "coverage", "verbatim")
    one = [F.lit(1).cast("long").alias(c) for c in ("n_windows", "n_found")]
    whole = reparameterised(docs, items).select("doc_id", "item_id", *one, F.lit(1.0).alias("coverage"), "verbatim")
    best = F.max_by(F.struct("n_windows", "n_found", "coverage", "verbatim"), F.struct("coverage", "n_windows"))
    return out.unionByName(whole).groupBy("doc_id", "item_id").agg(best.alias("v")).select("doc_id", "item_id", "v.*")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: float = 0.5) -> DataFrame:
    """docs without those that hold a benchmark item, all columns kept."""
    return docs.join(contaminated(docs, benchmark, window, least).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
