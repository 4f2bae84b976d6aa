"""How the sources of a language differ in their terms, by chunk factorization.

Chunks are what white space separates. A document's text is cut into chunks alone; a block of documents lists, for each distinct chunk,
the documents that hold it and how often. The chunks, without the lists, go to buckets by hash, where each that occurs anywhere is cut into
terms once; its terms come back to the blocks that asked. There the lists of one term meet, so a document counts once for a
term however many chunks give it. Lists never leave their block, so the commonest word moves as one row a block and
group. What is exchanged is packed, a row a block and bucket. All sums are of whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hashing import SPACE, Block, blocks, word_hashes
from .shared import materialise, parts_for, text_bytes

#: What a term is, and the letters that lose case.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNIT = 1_000_000_000
#: Bytes of text and documents of a block; sources of a tile; terms of a bucket.
BLOCK, DOCS, TILE, BUCKET = 8 << 20, 1 << 16, 64, 20_000
#: Buckets of chunks and of terms at most: beyond 500 GB of text they grow, which tasks take piece by piece.
MOST = 1 << 16

LIST = "block long, groups array<struct<lang: string, source: string, n: int>>, names binary, sizes binary, held binary, docs binary, times binary"
ASKED = "bucket int, block long, names binary, sizes binary"
ANSWER = "block long, bucket int, counts binary, names binary, sizes binary"
PART = "bucket int, names binary, sizes binary, own binary, docs binary, times binary, langs array<string>, sources array<string>"
COUNT = "lang string, source string, term string, times long, of_lang long"
#: Names or sums that a task works on at a time.
AT_ONCE = 1 << 20


def strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Strings that lie side by side."""
    bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])


def parts_of(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, sizes) of strings."""
    names = names.cast(pa.large_string())
    offsets = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1] if len(names) else np.zeros(1, np.int64)
    body = names.buffers()[2] if len(names) else None
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, np.diff(offsets)


def narrow(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in the fewest bytes each that hold the largest, which the first byte tells."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def wide(raws: list[bytes]) -> np.ndarray:
    return np.concatenate([np.frombuffer(raw, f"u{raw[0]}", offset=1) for raw in raws] or [[]]).astype(np.int64)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each range of the given size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def spans(data: np.ndarray, bounds: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of solid bytes that lie within bounds."""
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    before, after = np.concatenate([[False], solid]), np.concatenate([solid, [False]])
    return np.flatnonzero(solid & (~before[:-1] | cut[:-1])), np.flatnonzero(before & (~after | cut))


def buckets_of(data: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """A bucket for each string; none holds white space, so each is a word."""
    return (word_hashes(Block(None, data, np.concatenate([[0], np.cumsum(sizes)])))[0] % np.uint64(n)).astype(np.int64)


def chunk_lists(docs: DataFrame, n_buckets: int, size: int = BLOCK) -> DataFrame:
    """A row a block of documents: its groups (documents stand in order of (lang, source)), and its distinct chunks in order of their buckets:
    names and sizes, how many documents hold each, which, and how often each."""

    def listed(batches):
        task, n_blocks = TaskContext.get().partitionId(), 0
        for whole in blocks(batches, "text", size):
            for part in range(0, len(whole.batch), DOCS):
                batch = whole.batch.slice(part, DOCS)
                lang, source = (batch.column(c).to_pylist() for c in ("lang", "source"))
                order = sorted(range(len(lang)), key=lambda i: (lang[i], source[i]))
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                groups: list[dict] = []
                for i in order:
                    if not groups or (groups[-1]["lang"], groups[-1]["source"]) != (lang[i], source[i]):
                        groups.append({"lang": lang[i], "source": source[i], "n": 0})
                    groups[-1]["n"] += 1
                block = next(blocks([batch], "text", 1 << 62))
                starts, ends, first = block.words()
                words = strings(block.data[~SPACE[block.data]], ends - starts).dictionary_encode()
                order = np.argsort(buckets_of(*parts_of(words.dictionary), n_buckets), kind="stable")
                data, sizes = parts_of(words.dictionary.take(pa.array(order)))
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                number = words.indices.to_numpy(zero_copy_only=False)
                pairs, times = np.unique((rank[number] << 16) | np.repeat(place, np.diff(first)), return_counts=True)
                packed = [data.tobytes(), *map(narrow, (sizes, np.bincount(pairs >> 16, minlength=len(order)), pairs & 0xFFFF, times))]
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + n_blocks]), pa.array([groups], pa.list_(pa.struct([("lang", pa.string()), ("source", pa.string()), ("n", pa.int32())]))), *(pa.array([x], pa.binary()) for x in packed)], names=["block", "groups", "names", "sizes", "held", "docs", "times"])
                n_blocks += 1

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    return rows.mapInArrow(listed, LIST)


def asked(lists: DataFrame, n_buckets: int) -> DataFrame:
    """Each block's chunks by bucket."""

    def dealt(batches):
        for batch in batches:
            for block, names, sizes in zip(*(batch.column(c).to_pylist() for c in ("block", "names", "sizes"))):
                names, sizes = np.frombuffer(names, np.uint8), wide([sizes])
                bucket = buckets_of(names, sizes, n_buckets)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)])[cuts]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[cuts[:-1]], pa.int32()), "block": pa.array(np.full(len(cuts) - 1, block)), "names": pa.array([names[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()), "sizes": pa.array([narrow(sizes[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())})

    return lists.select("block", "names", "sizes").mapInArrow(dealt, ASKED)


def by_bucket(batches, columns: list[str], count, at_once: int):
    """Lists of rows of one bucket, of rows that come in its order; a list ends early if its rows count `at_once` or more."""
    rows, n = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if rows and (row[0] != rows[0][0] or n >= at_once):
                yield rows
                rows, n = [], 0
            rows.append(row)
            n += count(row)
    if rows:
        yield rows


def answered(questions: DataFrame, n_buckets: int, at_once: int) -> DataFrame:
    """The terms of each block's chunks of a bucket, in order. A bucket's distinct chunks are cut into terms once."""
    solid, lower = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
    solid[65:91] = solid[97:123] = solid[128:] = True  # TERM, in the bytes of UTF-8
    lower[65:91] += 32

    def cut(batches):
        for rows in by_bucket(batches, ["bucket", "block", "names", "sizes"], lambda r: len(r[3]), at_once):
            each = [wide([r[3]]) for r in rows]
            sizes = np.concatenate(each)
            chunks = strings(np.frombuffer(b"".join(r[2] for r in rows), np.uint8), sizes).dictionary_encode()
            data, own = parts_of(chunks.dictionary)
            bounds = np.concatenate([[0], np.cumsum(own)])
            starts, ends = spans(data, bounds, solid[data])
            first = np.searchsorted(starts, bounds)
            code = chunks.indices.to_numpy(zero_copy_only=False)
            counts, low, length, at = np.diff(first), lower[data], ends - starts, 0
            out: list[list] = []
            for (bucket, block, _, _), own in zip(rows, each):
                mine = code[at : at + len(own)]
                at += len(mine)
                terms = ranges(first[mine], counts[mine])
                out.append([block, bucket, narrow(counts[mine]), low[ranges(starts[terms], length[terms])].tobytes(), narrow(length[terms])])
            for i in range(0, len(out), 500):
                columns = zip(*out[i : i + 500])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "bucket", "counts", "names", "sizes"])

    return questions.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(cut, ANSWER)


def block_counts(answers: DataFrame, lists: DataFrame, n_buckets: int) -> DataFrame:
    """Sums of each block by term and group, dealt by term: a document that gives a term by several chunks holds it once."""
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("names", "sizes", "own", "docs", "times")), ("langs", pa.list_(pa.string())), ("sources", pa.list_(pa.string()))])

    def meet(terms: pa.Table, home: pa.Table) -> pa.Table:
        terms, home = terms.sort_by("bucket"), home.to_pylist()[0]
        per_chunk, sizes = (wide(terms.column(c).to_pylist()) for c in ("counts", "sizes"))
        names = strings(np.frombuffer(b"".join(terms.column("names").to_pylist()), np.uint8), sizes).dictionary_encode()
        number = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        held, docs, times = (wide([home[c]]) for c in ("held", "docs", "times"))
        groups = home["groups"]
        chunk = np.repeat(np.arange(len(per_chunk)), per_chunk)
        at = ranges((np.cumsum(held) - held)[chunk], held[chunk])
        key = (np.repeat(number, held[chunk]) << 16) | docs[at]
        order = np.argsort(key, kind="stable")
        key, n = key[order], times[at][order]
        new = np.flatnonzero(np.diff(key, prepend=-1))  # a place a term and document
        key, n = key[new], np.add.reduceat(n, new) if len(new) else n
        group = np.searchsorted(np.cumsum([g["n"] for g in groups]), key & 0xFFFF, "right")
        by = (key >> 16) * len(groups) + group
        new = np.flatnonzero(np.diff(by, prepend=-1))  # and one a term and group
        n, seen, by = np.add.reduceat(n, new) if len(new) else n, np.diff(np.append(new, len(by))), by[new]
        term, group = by // len(groups), by % len(groups)
        data, sizes = parts_of(names.dictionary)
        bucket = buckets_of(data, sizes, n_buckets)
        order = np.argsort(bucket[term], kind="stable")
        return pa.Table.from_batches([pack(schema, data, sizes, term[order], bucket[term][order], group[order], seen[order], n[order], groups)])

    homes = lists.select(F.col("block").alias("home"), "groups", "held", "docs", "times")
    return answers.groupBy("block").cogroup(homes.groupBy("home")).applyInArrow(meet, PART)


def pack(schema: pa.Schema, data, sizes, term, bucket, group, docs, times, groups) -> pa.RecordBatch:
    """A row a bucket; entries come in order of buckets."""
    at, rows = np.cumsum(sizes) - sizes, []
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
    for a, b in zip(cuts, cuts[1:]):
        mine, own = np.unique(group[a:b], return_inverse=True)
        t = term[a:b]
        rows.append((int(bucket[a]), data[ranges(at[t], sizes[t])].tobytes(), *map(narrow, (sizes[t], own, docs[a:b], times[a:b])), [groups[g]["lang"] for g in mine], [groups[g]["source"] for g in mine]))
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def kept_counts(parts: DataFrame, n_buckets: int, least: int, at_once: int) -> DataFrame:
    """(lang, source, term, times, of_lang) of the terms that `least` documents of a language hold. Sums are folded as they come in, so
    a task holds no more than a bucket's distinct terms by group."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("times", pa.int64()), ("of_lang", pa.int64())])

    def fold(rows: list, number: dict[tuple, int], before: tuple | None) -> tuple:
        """(terms, group, docs, times), a place a term and group; number: of each group, grows."""
        own = [np.array([number.setdefault(g, len(number)) for g in zip(r[6], r[7])], np.int64)[wide([r[3]])] for r in rows]
        names = strings(np.frombuffer(b"".join(r[1] for r in rows), np.uint8), wide([r[2] for r in rows]))
        group, docs, times = np.concatenate(own), *(wide([r[i] for r in rows]) for i in (4, 5))
        if before is not None:
            names = pa.concat_arrays([before[0], names])
            group, docs, times = (np.concatenate(x) for x in zip(before[1:], (group, docs, times)))
        names = names.dictionary_encode()
        key = (names.indices.to_numpy(zero_copy_only=False).astype(np.int64) << 32) | group
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        docs, times = (np.add.reduceat(x[order], new) for x in (docs, times))
        return names.dictionary.take(pa.array(key[new] >> 32)), key[new] & 0xFFFFFFFF, docs, times

    def close(number: dict[tuple, int], sums: tuple):
        terms, group, docs, times = sums
        langs: dict[str, int] = {}
        of_group = np.array([langs.setdefault(lang, len(langs)) for lang, _ in number])
        codes = terms.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, both = np.unique(codes * len(langs) + of_group[group], return_inverse=True)
        many, total = (np.zeros(both.max(initial=-1) + 1, np.int64) for _ in range(2))
        np.add.at(many, both, docs)
        np.add.at(total, both, times)
        stay = np.flatnonzero(many[both] >= least)
        for at in range(0, len(stay), 10_000):
            mine = stay[at : at + 10_000]
            lang, source = (pa.array([g[i] for g in number], pa.string()).take(pa.array(group[mine])) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([lang, source, terms.take(pa.array(mine)).cast(pa.string()), pa.array(times[mine]), pa.array(total[both[mine]])], schema=schema)

    def counted(batches):
        bucket, number, sums = None, {}, None
        for rows in by_bucket(batches, schema_of_part, lambda r: len(r[3]), at_once):
            if bucket is not None and rows[0][0] != bucket:
                yield from close(number, sums)
                number, sums = {}, None
            bucket, sums = rows[0][0], fold(rows, number, sums)
        if sums is not None:
            yield from close(number, sums)

    schema_of_part = [c.split()[0] for c in PART.split(", ")]
    return parts.repartition(n_buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(counted, COUNT)


def term_counts(docs: DataFrame, least: int, size: int = BLOCK, at_once: int = AT_ONCE) -> DataFrame:
    """(lang, source, term, times, of_lang) of docs (text, lang, source): how often each source, and its language, says each kept term."""
    n_buckets = min(MOST, parts_for(text_bytes(docs), size))
    lists = materialise(chunk_lists(docs, n_buckets, size), "lists")
    answers = answered(asked(lists, n_buckets), n_buckets, at_once)
    return kept_counts(block_counts(answers, lists, n_buckets), n_buckets, least, at_once)


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 * (count + 2) / (total + 2 * kept)), in whole numbers that cannot overflow; 1 where nothing is kept."""
    wide = "decimal(38,0)"
    ratio = F.call_function("div", F.lit(UNIT).cast(wide) * (count + 2).cast("decimal(20,0)"), (total + 2 * kept).cast("decimal(20,0)"))
    return F.when(kept > 0, 1 + ratio).otherwise(F.lit(1)).cast("long")


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least: int = 10, top: int = 10, size: int = BLOCK, bucket: int = BUCKET, tile: int = TILE, at_once: int = AT_ONCE) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from every other of its language (part `pair`), and by which terms it
    stands out from its language (part `term`, the first `top`).

    docs: text, lang, source (null: empty); other columns are not read, and a row is a document even if it repeats another. A language
    keeps the terms that `least` of its documents hold. Ties go by item. A language with one source has no pairs; where no term is kept
    pairs have value 0. An empty table gives no rows."""
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    rows = materialise(term_counts(docs, least, size, at_once), "kept")
    langs = rows.groupBy("lang", "term").agg(F.first("of_lang").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n_lang"))
    totals = rows.groupBy("lang", "source").agg(F.sum("times").alias("n"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "v", "n_lang")]
    stats = materialise(groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *zero), "stats")
    c = F.col
    placed = rows.join(stats, ["lang", "source"]).select("lang", "source", "term", share(c("times"), c("n"), c("v")).alias("p"), share(c("of_lang"), c("n_lang"), c("v")).alias("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = placed.where("p > q").select("lang", "source", F.lit("term").alias("part"), c("term").alias("item"), distance(c("p"), c("q")).alias("value")).withColumn("rank", F.row_number().over(order)).where(c("rank") <= top)
    pairs = pair_distances(placed, stats, bucket, tile).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)


def pair_distances(placed: DataFrame, stats: DataFrame, bucket: int, tile: int) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language.

    Sources are dealt into tiles and terms into buckets, by hash. A bucket's terms meet a pair of tiles at a time, in a matrix of bounded
    size; terms that neither tile holds have the same distance each, so they are only counted."""
    n = stats.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.max("v").alias("v")).agg(F.coalesce(F.max("sources"), F.lit(0)).alias("sources"), F.coalesce(F.max("v"), F.lit(0)).alias("v")).first()
    tiles, buckets = max(1, -(-n["sources"] // tile)), max(1, -(-n["v"] // bucket))
    c = F.col
    own = F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int")
    both = F.explode(F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda t: F.named_struct(F.lit("a"), F.least(t, own), F.lit("b"), F.greatest(t, own))))
    held = placed.select("lang", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("k"), both.alias("ab"), own.alias("tile"), "source", "term", "p").select("lang", "k", "ab.*", "tile", "source", "term", "p")
    members = stats.select("lang", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("k"), both.alias("ab"), own.alias("tile"), "source", share(F.lit(0), c("n"), c("v")).alias("p")).select("lang", "k", "ab.*", "tile", "source", "p")
    key = ["lang", "k", "a", "b"]

    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("apart", pa.int64()), ("seen", pa.int64())])

    def met(rows: pa.Table, them: pa.Table) -> pa.Table:
        them = them.sort_by("source")
        names, tile_of = them.column("source").to_pylist(), them.column("tile").to_numpy()
        index = {s: i for i, s in enumerate(names)}
        codes = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        seen = int(codes.max(initial=-1)) + 1
        p = np.repeat(them.column("p").to_numpy()[:, None], seen, 1)
        p[[index[s] for s in rows.column("source").to_pylist()], codes] = rows.column("p").to_numpy()
        one_tile = them.column("a")[0].as_py() == them.column("b")[0].as_py()
        left, right, sums = [], [], []
        for i in range(len(names)):
            others = np.flatnonzero((np.arange(len(names)) > i) & (one_tile | (tile_of != tile_of[i])))
            apart = np.zeros(len(others), np.int64)
            for at in range(0, seen, 4096):
                x, y = p[i, at : at + 4096], p[others, at : at + 4096]
                apart += ((x - y) ** 2 // (x + y)).sum(axis=1)
            left += [names[i]] * len(others)
            right += [names[j] for j in others]
            sums += apart.tolist()
        columns = [[them.column("lang")[0].as_py()] * len(sums), left, right, sums, [seen] * len(sums)]
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)])

    parts = held.groupBy(*key).cogroup(members.groupBy(*key)).applyInArrow(met, "lang string, source string, item string, apart long, seen long")
    summed = parts.groupBy("lang", "source", "item").agg(F.sum("apart").alias("apart"), F.sum("seen").alias("seen"))
    base = stats.select("lang", "source", "v", share(F.lit(0), c("n"), c("v")).alias("p"))
    own_side, other = base.withColumnRenamed("p", "p1"), base.select("lang", c("source").alias("item"), c("p").alias("p2"))
    found = summed.join(own_side, ["lang", "source"]).join(other, ["lang", "item"]).withColumn("value", c("apart") + (c("v") - c("seen")) * distance(c("p1"), c("p2")))
    side = F.explode(F.array(F.struct("source", "item"), F.struct(c("item").alias("source"), c("source").alias("item"))))
    return found.select("lang", side.alias("s"), "value").select("lang", "s.source", "s.item", "value")


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
held AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM held GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM docs),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM held JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM grp LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
             CAST(1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.total + 2 * v.v) AS BIGINT) AS p, CAST(1 + 1000000000 * (kept.n + 2) // (v.total + 2 * v.v) AS BIGINT) AS q
      FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
          FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM every UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
