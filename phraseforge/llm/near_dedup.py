"""MinHash near-dedup as a chosen-path set similarity join.

Documents are sets of word shingles. In each of several independent trees a document walks down by its minwise tokens: the root
branches on one, a node with too many documents on three more that the node's own hash selects. Similar sets share a token with a
probability of their similarity, so at 0.85 a tree loses a pair at the root in 15 % of cases, seven trees lose it in 2 of a million.
Small nodes are compared exhaustively: by sketches first, then, where these leave doubt, on the full sets.

What keeps it in bounds: equal word sequences are one class from the start; comparing is a search through the unvisited members, so
a group where all are alike costs one pass and gives links enough to connect it, never all pairs; a node too large for one task is
branched on, five times at most, and not if four fifths of it would go to one child. It is then dealt into chunks that all hold its smallest
member. Members that this pivot does not reach are dealt into chunks too, and each of these meets each chunk of the node, two chunks to a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U, blocks, mix, sequence_hashes, windows, word_hashes
from .shared import materialise

SHINGLE = 5
HASHES = 64
TREES = 7
CHILDREN = 3
DEPTH = 6
NODE = 1000
GROUP = 1000
DENSE = 0.8
with np.errstate(over="ignore"):
    FACTORS, ADDED = mix(np.arange(1, HASHES + 1, dtype=U) * U(0xD1342543DE82EF95)) | U(1), mix(np.arange(1, HASHES + 1, dtype=U) * U(0xAF251AF3B0F025B5))


def shingle_sets(block, words: int = SHINGLE) -> tuple[list[np.ndarray], np.ndarray]:
    """(sorted distinct shingle hashes of each row, two independent hashes of each row's word sequence). A-Z count as a-z."""
    symbols, _, _, first = word_hashes(block, lower=True)
    at, hashes = windows(symbols, first, words)
    cuts = np.searchsorted(at, first)
    n = np.diff(first)
    whole = sequence_hashes(symbols, first)
    second = sequence_hashes(word_hashes(block, lower=True, seed=1)[0], first, 1)
    sets = [np.unique(hashes[cuts[r] : cuts[r + 1]]) if n[r] >= words else whole[r : r + 1] if n[r] else np.zeros(0, U) for r in range(len(n))]
    return sets, np.stack([whole, second], 1)


def sketch(s: np.ndarray) -> np.ndarray:
    """HASHES minwise tokens (uint32) of a set that isn't empty."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(s), 1 << 14):
        out = np.minimum(out, ((s[a : a + (1 << 14), None] * FACTORS + ADDED) >> U(32)).astype(np.uint32).min(0))
    return out


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (the word sequence), n (set size), sketch."""

    def make(batches):
        for block in blocks(batches):
            sets, keys = shingle_sets(block)
            keys = keys.view(np.int64)
            ids = block.batch.column("doc_id")
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s).tobytes() if len(s) else b"" for s in sets], pa.binary())], names=["doc_id", "k1", "k2", "n", "sketch"])

    return docs.mapInArrow(make, "doc_id long, k1 long, k2 long, n long, sketch binary")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in sorted batches, whole."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        new = np.zeros(len(table), bool)
        for k in keys:
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield table.slice(a, b - a)
        rest = table.slice(cuts[-1])
    if rest is not None and len(rest):
        yield rest


def branches(sketches: DataFrame) -> DataFrame:
    """(node, rep) of the roots' children: one token a tree."""

    def walk(batches):
        for batch in batches:
            tokens = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, HASHES)[:, :TREES].astype(U)
            nodes = mix(tokens + (np.arange(1, TREES + 1, dtype=U) << U(40))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.ravel()), pa.array(np.repeat(batch.column("rep").to_numpy(), TREES))], names=["node", "rep"])

    return sketches.mapInArrow(walk, "node long, rep long")


def deeper(members: DataFrame) -> DataFrame:
    """(node, rep, parent, parent_size) of the children of large nodes (node, rep, size, sketch); each node's hash selects its CHILDREN tokens."""

    def walk(batches):
        for batch in batches:
            node = batch.column("node").to_numpy().view(U)
            tokens = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, HASHES)
            out = []
            for c in range(CHILDREN):
                free = HASHES - TREES
                place = TREES + ((mix(node) % U(free)).astype(np.int64) + c * (free // CHILDREN)) % free
                out.append(mix(node + mix(tokens[np.arange(len(node)), place].astype(U) + (place.astype(U) << U(40)))))
            rep, parent, size = (pa.array(np.repeat(batch.column(c).to_numpy(), CHILDREN)) for c in ("rep", "node", "size"))
            yield pa.RecordBatch.from_arrays([pa.array(np.stack(out, 1).ravel().view(np.int64)), rep, parent, size], names=["node", "rep", "parent", "parent_size"])

    return members.mapInArrow(walk, "node long, rep long, parent long, parent_size long")


#: near(one, others) -> which of the others are linked with one; load(table) -> the group's members, to index with arrays
Near = Callable[[object, int, np.ndarray], np.ndarray]


def search(members, load, near: Near, begin: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is linked: from each index of `begin` not yet visited, through unvisited members."""
    data, links = load(members), []
    left = np.ones(len(members), bool)
    for root in begin:
        if not left[root]:
            continue
        left[root] = False
        front = [int(root)]
        while front:
            one = front.pop()
            others = np.flatnonzero(left)  # ascending
            if not len(others):
                return links
            found = others[near(data, one, others)]
            left[found] = False
            links += [(one, int(x)) for x in found]
            front += found.tolist()
    return links


def compare(pairs: DataFrame, attach, load, near: Near, limit: int, name: str) -> DataFrame:
    """Links (node, a, b) within each node of pairs (node, rep), written: they connect all that near() links.

    The links of a node that is one task are named by what they connect, node and a member; those of a node in chunks by the node.

    attach(rows) adds to rows (node, rep, ...) what load() reads; only then do rows get heavy, and they move once."""
    sizes = materialise(pairs.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("pivot")).where("size > 1"), f"{name}-sizes")
    parted = pairs.join(sizes, "node").withColumn("chunks", F.ceil(F.col("size") / limit).cast("int"))
    own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    schema = "node long, a long, b long, kind int"

    def meet(second: bool):
        def run(batches):
            for table in groups(batches, ["node", "chunk"]):
                ids = table.column("rep").to_numpy()
                foreign, pivot, chunks = (table.column(c).to_numpy() for c in ("foreign", "pivot", "chunks"))
                node, split = table.column("node")[0].as_py(), chunks[0] > 1
                # the second time from the strip of the residue that meets this chunk
                pairs = search(table, load, near, np.flatnonzero(foreign == 1) if second else np.argsort(ids, kind="stable"))
                up = list(range(len(ids)))
                for i, j in pairs:  # what a link starts from was reached before, so one pass does
                    up[j] = up[i]
                names = [node] * len(pairs)
                if not split and pairs:
                    names = mix(np.array([node], np.int64).view(U) + mix(ids[[up[i] for i, _ in pairs]].view(U))).view(np.int64).tolist()
                out = [(name, int(ids[i]), int(ids[j]), 0) for name, (i, j) in zip(names, pairs, strict=True) if ids[i] != ids[j]]
                if split and not second:
                    root = [k for k in range(len(ids)) if ids[k] == pivot[0]]
                    top = up[root[0]] if root else -1
                    out += [(node, int(ids[k]), int(ids[k]), 1) for k in range(len(ids)) if up[k] != top and foreign[k] == 0]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["node", "a", "b", "kind"])

        return run

    columns = ["node", "chunk", "rep", "foreign", "pivot", "chunks"]
    first = parted.withColumns({"chunk": own, "foreign": F.lit(0)}).select(*columns)
    large = bool(sizes.where(F.col("size") > limit).limit(1).count())
    if large:
        pivots = parted.where("chunks > 1 and rep = pivot").withColumn("home", own).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("chunk <> home").withColumn("foreign", F.lit(1))
        first = first.unionByName(pivots.select(*columns))
    deal = lambda df: attach(df).repartition("node", "chunk").sortWithinPartitions("node", "chunk")
    found = materialise(deal(first).mapInArrow(meet(False), schema), f"{name}-links")
    links = found.where("kind = 0").drop("kind")
    if large:
        residue = found.where("kind = 1").select("node", F.col("a").alias("rep")).distinct()
        strips = materialise(residue.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("strips")), f"{name}-strips")
        here = parted.where("chunks > 1").withColumn("own", own).join(strips, "node")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        members = here.withColumn("strip", every("strips")).withColumns({"chunk": F.col("own") * F.col("strips") + F.col("strip"), "foreign": F.lit(0)})
        strip = F.pmod(F.xxhash64("rep", F.lit("strip")), F.col("strips")).cast("int")
        guests = here.join(residue, ["node", "rep"], "left_semi").withColumn("strip", strip).withColumn("to", every("chunks")).where("to <> own")
        guests = guests.withColumns({"chunk": F.col("to") * F.col("strips") + F.col("strip"), "foreign": F.lit(1)})
        # a strip's members of the chunk itself are told by `foreign` too: they meet their own chunk
        inside = here.join(residue, ["node", "rep"], "left_semi").select("node", "rep", strip.alias("home"))
        members = members.join(inside, ["node", "rep"], "left").withColumn("foreign", F.when(F.col("home") == F.col("strip"), 1).otherwise(0))
        second = members.select(*columns).unionByName(guests.select(*columns))
        links = links.unionByName(materialise(deal(second).mapInArrow(meet(True), schema), f"{name}-residue").drop("kind"))
    return links


def load_sketches(table: pa.Table):
    return np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint32).reshape(-1, HASHES), table.column("n").to_numpy()


class Sets:
    """A group's sets, and an index of their prefixes.

    In any order of the tokens, two sets with the similarity share one of the first |set| - ceil(similarity * |set|) + 1 tokens of each. The
    rarest come first (by counts in buckets of their hashes), so sets that share only what the group has in common seldom meet."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.n = sets, np.array([len(s) for s in sets], np.int64)
        buckets = U((1 << min(20, max(8, int(self.n.sum()).bit_length() + 2))) - 1)
        counts = np.zeros(int(buckets) + 1, np.int64)
        for s in sets:
            np.add.at(counts, (s & buckets).astype(np.int64), 1)
        first = [s[np.lexsort((s, counts[(s & buckets).astype(np.int64)]))[: len(s) + (-percent * len(s) // 100) + 1]] for s in sets]
        flat = np.concatenate(first)
        self.bounds = np.concatenate([[0], np.cumsum([len(x) for x in first])])
        _, self.codes = np.unique(flat, return_inverse=True)
        order = np.argsort(self.codes, kind="stable")
        self.members = np.repeat(np.arange(len(sets)), np.diff(self.bounds))[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.codes))])

    def meeting(self, one: int, others: np.ndarray) -> np.ndarray:
        """Whether each of the others shares a token of its prefix with one."""
        meets = np.zeros(len(self.n), bool)
        for token in self.codes[self.bounds[one] : self.bounds[one + 1]]:
            meets[self.members[self.starts[token] : self.starts[token + 1]]] = True
        return meets[others]


def load_sets(percent: int):
    return lambda table: Sets([np.frombuffer(x, U) for x in table.column("shingles").to_pylist()], percent)


def near_sketches(percent: int) -> Near:
    """Enough tokens agree that a similarity of `percent` isn't out of the question (five deviations), and sizes allow it."""
    p = percent / 100
    least = int(HASHES * p - 5 * (HASHES * p * (1 - p)) ** 0.5)

    def near(data, one, others):
        tokens, n = data
        fits = 100 * np.minimum(n[one], n[others]) >= percent * np.maximum(n[one], n[others])
        out = np.zeros(len(others), bool)
        at = np.flatnonzero(fits)
        for a in range(0, len(at), 1 << 16):
            part = at[a : a + (1 << 16)]
            out[part] = (tokens[others[part]] == tokens[one]).sum(1) >= least
        return out

    return near


def near_sets(percent: int) -> Near:
    """Exactly: 100 * intersection >= percent * union. Sizes, then prefixes, tell most pairs that are not."""

    def near(data, one, others):
        sets, n = data.sets, data.n
        fits = np.flatnonzero((100 * np.minimum(n[one], n[others]) >= percent * np.maximum(n[one], n[others])) & data.meeting(one, others))
        out = np.zeros(len(others), bool)
        for a in range(0, len(fits), 256):
            part = others[fits[a : a + 256]]
            flat = np.concatenate([sets[i] for i in part])
            at = np.minimum(np.searchsorted(sets[one], flat), len(sets[one]) - 1)
            cuts = np.concatenate([[0], np.cumsum(n[part])[:-1]])
            both = np.add.reduceat((sets[one][at] == flat).astype(np.int64), cuts)
            out[fits[a : a + 256]] = 100 * both >= percent * (n[one] + n[part] - both)
        return out

    return near


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that a link (a, b) has.

    Contraction: each vertex follows its smallest neighbour, a few hops at once, and links between contracted vertices go on.
    Every round is written, so lineage stays short."""
    edges = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    labels = materialise(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id")), "labels")
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p")), "parents")
        for _ in range(3):
            up = materialise(up.join(up.select(F.col("v").alias("p"), F.col("p").alias("q")), "p", "left").select("v", F.coalesce("q", "p").alias("p")), "parents")
        labels = materialise(labels.join(up.select(F.col("v").alias("component"), "p"), "component", "left").select("id", F.coalesce("p", "component").alias("component")), "labels")
        ends = edges.join(up.select(F.col("v").alias("a"), F.col("p").alias("x")), "a").join(up.select(F.col("v").alias("b"), F.col("p").alias("y")), "b")
        edges = materialise(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "edges")
    return labels


def link_classes(docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between class representatives that connect all pairs with the similarity; each is confirmed on full sets.

    reps: rep, n, sketch, written."""
    rows, leaves = branches(reps), []
    for depth in range(DEPTH):
        rows = materialise(rows.distinct(), f"tree-{depth}")
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sized = materialise(rows.join(sizes, "node"), f"sized-{depth}")
        large = sized.where(F.col("size") > NODE)
        if depth == DEPTH - 1 or not large.limit(1).count():
            leaves.append(sized.select("node", "rep"))
            break
        leaves.append(sized.where(F.col("size") <= NODE).select("node", "rep"))
        children = materialise(deeper(large.join(reps, "rep")), f"children-{depth}")
        # a node of which most go to one child is alike throughout: branching would multiply its rows and not part them
        most = children.groupBy("parent", "parent_size", "node").agg(F.count(F.lit(1)).alias("n")).groupBy("parent", "parent_size").agg(F.max("n").alias("n"))
        dense = materialise(most.where(F.col("n") > DENSE * F.col("parent_size")).select("parent"), f"dense-{depth}")
        leaves.append(large.select("node", "rep").join(dense.withColumnRenamed("parent", "node"), "node", "left_semi"))
        rows = children.join(dense, "parent", "left_anti").select("node", "rep")
    members = leaves[0]
    for more in leaves[1:]:
        members = members.unionByName(more)
    with_sketches = lambda rows: rows.join(reps.hint("merge"), "rep")
    likely = compare(materialise(members, "leaves"), with_sketches, load_sketches, near_sketches(percent), NODE, "nodes")
    # documents that the links of a node connect are one group; the same group from several trees is one
    inside = materialise(local_groups(likely), "groups").withColumnRenamed("g", "node")

    def with_sets(rows: DataFrame) -> DataFrame:
        """Texts move once, to meet the list of places where their sets are wanted; sets are made there."""
        names = [c for c in rows.columns if c != "rep"]
        wanted = rows.groupBy(F.col("rep").alias("doc_id")).agg(F.collect_list(F.struct(*names)).alias("places"))
        kinds = [rows.schema[c].dataType.simpleString() for c in names]

        def to_sets(batches):
            for block in blocks(batches):
                sets, _ = shingle_sets(block)
                for doc, s, places in zip(block.batch.column("doc_id").to_pylist(), sets, block.batch.column("places"), strict=True):
                    flat = pa.RecordBatch.from_struct_array(places.values)
                    yield pa.RecordBatch.from_arrays([*flat.columns, pa.array([doc] * len(flat), pa.int64()), pa.array([s.tobytes()] * len(flat), pa.binary())], names=[*names, "rep", "shingles"])

        fields = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
        return docs.join(wanted.hint("merge"), "doc_id").mapInArrow(to_sets, f"{fields}, rep long, shingles binary")

    return compare(inside, with_sets, load_sets(percent), near_sets(percent), GROUP, "sets").select("a", "b").distinct()


def local_groups(links: DataFrame) -> DataFrame:
    """(g, rep): the members that a node's links touch, as a group named by a hash of its members."""
    touched = links.select("node", F.explode(F.array("a", "b")).alias("rep")).distinct()
    name = touched.groupBy("node").agg(F.expr("bit_xor(xxhash64(rep, 1L))").alias("x"), F.expr("bit_xor(xxhash64(rep, 2L))").alias("y"), F.count(F.lit(1)).alias("c"))
    return touched.join(name.select("node", F.xxhash64("x", "y", "c").alias("g")), "node").select("g", "rep").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: components of documents whose shingle sets have a similarity of percent / 100.

    A set: distinct runs of five words (A-Z as a-z), or the whole sequence if shorter. Null texts and texts without words have
    the empty set and are linked with nothing. kept: the smallest doc_id of its component. Rows that repeat a doc_id and text
    come out each; rows without doc_id are linked with nothing and kept. Other columns are not read. An empty table gives no rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = materialise(profiles(docs), "profiles")
    full = made.where("n > 0 and doc_id is not null")
    classes = materialise(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = full.join(classes.select(F.col("rep").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"], "left_semi").groupBy(F.col("doc_id").alias("rep")).agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = materialise(reps, "representatives")
    labels = components(link_classes(docs, reps, percent))
    classes = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("c"))
    out = full.join(classes, ["k1", "k2"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))
    alone = made.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id; all columns kept.

    Rows that repeat doc_id and text are copies too: one stays. Texts without words and rows without doc_id are linked with
    nothing: all of them stay, but for repeats with a doc_id. An empty table gives no rows."""
    gone = near_duplicates(docs, percent).where(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = materialise(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    if not again.limit(1).count():
        return kept
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))
