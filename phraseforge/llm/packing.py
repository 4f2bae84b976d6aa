"""Best-fit packing of tokenised documents into sequences of bounded length.

Only lengths matter to packing, and there are no more of them than tokens in a sequence. So Spark counts the pieces of each
length, the driver packs that histogram (its size is bounded by the capacity, not by the data), and Spark deals the pieces
out to the places found. All steps on the histogram treat many bins at once.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import zlib
from array import array
from itertools import count as counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

END = 1
KEPT_WORDS = 300_000
#: Fixed value: how tokenizers of the CLIP family cut text.
CUT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Characters that NFC keeps whatever stands beside them, and whose lower case is one letter: ASCII and the precomposed Latin letters.
PLAIN = re.compile("[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+").fullmatch
RUNS = re.compile("[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017f]+").findall


def reduce_lengths(left: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Martello-Toth dominance reduction: take from `left` (length: how many) what can be fixed without loss.

    For a length j, largest first, a set with j dominates if every other set that fits with j can be exchanged for it: j
    alone when nothing fits beside it; j with the largest partner j* when at most one more fits, or when both fill the
    sequence; with two at most, j with j* when it is as large as the best pair, or j with the best pair when j* is in it and
    no pair between could do better. Returns (how many bins, lengths in each). What dominates stays so as the instance
    shrinks, so a rule is applied to all items of the length at once."""
    fixed: list[tuple[int, tuple[int, ...]]] = []
    sizes = sorted(left)

    def take(bins: int, content: tuple[int, ...]) -> None:
        fixed.append((bins, content))
        for x in content:
            left[x] -= bins
        for x in set(content):
            if not left[x]:
                del left[x]
                sizes.pop(bisect.bisect_left(sizes, x))

    def smallest(n: int, without: int) -> list[int]:
        out: list[int] = []
        for x in sizes:
            out += [x] * min(n - len(out), left[x] - (x == without))
            if len(out) == n:
                break
        return out

    def largest(room: int, without: dict[int, int]) -> int | None:
        for k in range(bisect.bisect_right(sizes, room) - 1, -1, -1):
            if left[sizes[k]] > without.get(sizes[k], 0):
                return sizes[k]
        return None

    def bins(content: tuple[int, ...]) -> int:
        return min(left[x] // content.count(x) for x in set(content))

    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                room = capacity - j
                star = largest(room, {j: 1})
                if star is None:
                    take(left[j], (j,))
                    changed = True
                    continue
                few = smallest(3, j)
                fits = sum(sum(few[: k + 1]) <= room for k in range(len(few)))
                if fits <= 1 or star == room:
                    take(bins((j, star)), (j, star))
                    changed = True
                    continue
                if fits == 2:
                    best = max(((a + b, a, b) for a in sizes if a <= room and (b := largest(min(a, room - a), {j: 1, a: 1 + (a == j)})) is not None), default=None)
                    if best is None or star >= best[0]:
                        take(bins((j, star)), (j, star))
                        changed = True
                        continue
                    _, a, b = best
                    between = [x for x in sizes if b < x < a]
                    few_between = sum(left[x] for x in between) <= 1
                    if star == a and (few_between or j + sum(([x for x in between for _ in range(min(2, left[x]))])[:2]) > capacity):
                        take(bins((j, a, b)), (j, a, b))
                        changed = True
                        continue
                break
    return fixed


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing on a histogram: each item goes to the open bin with the least room that holds it."""
    open_bins: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    rooms: list[int] = []
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(bins: int, content: tuple[int, ...], room: int) -> None:
        if not room:
            done.append((bins, content))
            return
        if room not in open_bins:
            bisect.insort(rooms, room)
        open_bins.setdefault(room, []).append((bins, content))

    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                each = min(capacity // size, n)
                put(n // each, (size,) * each, capacity - size * each)
                n -= n // each * each
                continue
            room = rooms[at]
            bins, content = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(at)
            each = min(room // size, n)
            used = min(bins, n // each)
            if used < bins:
                put(bins - used, content, room)
            put(used, content + (size,) * each, room - each * size)
            n -= used * each
    return done + [x for group in open_bins.values() for x in group]


def pack_histogram(lengths: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    left = {k: v for k, v in lengths.items() if v}
    return reduce_lengths(left, capacity) + best_fit(left, capacity)


def segments(plan: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """For each run of pieces of one length: length, first rank, how many a bin, first bin, place in the bin; sorted."""
    rank: dict[int, int] = {}
    out, first = [], 0
    for bins, content in plan:
        at = 0
        for size in dict.fromkeys(content):
            each = content.count(size)
            out.append((size, rank.get(size, 0), each, first, at))
            rank[size] = rank.get(size, 0) + bins * each
            at += size * each
        first += bins
    return np.array(sorted(out), np.int64).reshape(-1, 5)


class _Words(dict):
    """Token ids (little-endian uint32 bytes) of a run of text without white space, encoded when first met.

    A tokenizer of the CLIP family (checked by its own description) normalises to NFC and lower case and cuts words into runs of letters, single
    digits and runs of other characters before it merges bytes. Words of PLAIN characters normalise character by character and are so cut here,
    so that each run of letters is merged once; all other words are encoded by the tokenizer itself, and texts whole if it is of another kind."""

    def __init__(self, path: str):
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        cuts = [(x.get("type"), x.get("pattern")) for x in (said["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_word = said["normalizer"] is not None and [x["type"] for x in said["normalizer"].get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and cuts == [("Split", {"Regex": CUT}), ("ByteLevel", None)] and said["model"]["type"] == "BPE" and all("<|" in x["content"] for x in said["added_tokens"])
        self.model, self.level = self.tokenizer.model, tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        if "'" in word or "<|" in word or not PLAIN(word):
            out = self.ids(word)
        else:
            runs = RUNS(word.lower())
            if len(runs) > 1 or runs[0] != word:
                out = b"".join([self[x] for x in runs])
            else:
                said = word if word.isascii() else self.level.pre_tokenize_str(word)[0][0]
                out = array("I", [t.id for t in self.model.tokenize(said)]).tobytes()
        self[word] = out
        return out

    def document(self, text: str) -> bytes:
        """Such a tokenizer never joins what white space parts, so words are encoded once each. Texts with characters that
        split() alone takes for white space are encoded whole."""
        if not self.by_word or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.ids(text)
        return b"".join([self[w] for w in text.split()])


@functools.cache  # one for each Python worker
def _words(path: str) -> _Words:
    return _Words(path)


def tokenised(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """The pieces: doc_id, piece, start, length, ids_crc32, part, seq (rank among the pieces of its length in this task)."""
    names = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "part": pa.int32(), "seq": pa.int64()}

    def cut(batches):
        words, part = _words(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = words.document(text or "") + end
                for piece, at in zip(counter(), range(0, len(ids), 4 * capacity)):
                    raw = ids[at : at + 4 * capacity]
                    n = len(raw) // 4
                    rows.append((doc, piece, at // 4, n, zlib.crc32(raw), part, int(seen[n])))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), names.values(), strict=True)], names=list(names))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, seq long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096) -> DataFrame:
    """Pack documents into sequences of at most `capacity` tokens; longer ones are cut into pieces of `capacity`.

    tokenizer: path of a tokenizers file whose tokens never span white space, on every executor. Returns a row a piece:
    doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are the end token alone. Equal rows are
    packed each. Rows without doc_id are packed too. Other columns are not read. An empty table gives no rows.

    Shuffles: counts by task and length, and the pieces' numbers (never texts or ids) to meet their ranks."""
    pieces = materialise(tokenised(docs, tokenizer, capacity), "pieces")
    each = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    lengths = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    table = pieces.sparkSession.sparkContext.broadcast(segments(pack_histogram(lengths, capacity)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranked = pieces.join(each.select("length", "part", F.coalesce(before, F.lit(0)).alias("before")), ["length", "part"])

    def place(batches):
        for batch in batches:
            col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "before", "seq")}
            rank, size, t = col["before"] + col["seq"], col["length"].astype(np.int64), table.value
            at = np.searchsorted(t[:, 0] << 48 | t[:, 1], size << 48 | rank, "right") - 1
            inside = rank - t[at, 1]
            more = {"sequence_id": t[at, 3] + inside // t[at, 2], "offset": t[at, 4] + inside % t[at, 2] * size}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), *(pa.array(v, pa.int64()) for v in more.values())], names=["doc_id", "piece", "start", "length", "ids_crc32", *more])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
