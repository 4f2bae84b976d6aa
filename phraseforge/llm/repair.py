"""Repair of conversations by the cheapest edits that give a legal sequence of roles.

All rows are sorted once, over ranges of (conversation, turn), so a conversation of any length lies in several bounded partitions. A
partition's part of a conversation is a segment. Each segment is solved by a persistent DP: for each state in which it may begin, the
cheapest edits to each state in which it may end. Edit scripts are paths in a tree: a script is its last node, prefixes are shared,
each node keeps its ancestors at distances 1, 2, 4, ... and a rolling hash of its path. Equal costs are settled by the ASCII order of the
scripts, at the end of their longest common prefix, found by descending through the ancestors; as each path exists
once in the tree, two prefixes are equal if and only if they are one node, which verifies what the hashes say. Segments of one
conversation are then chained in order.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, parts_for

#: States are what has been said last: nothing, system, user, assistant. A state's legal next speakers, and what ends a turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
NAMES = {USER: "user", ASSISTANT: "assistant"}
FINAL = (START, ASSISTANT)
LEGAL = ("su", "ua", "au")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLANKS = " \t\n\x0b\f\r"
MODULUS, BASE = (1 << 61) - 1, 911_382_323

SEGMENT = "conv_id long, part int, at long, n long, illegal long, first string, last string, whole boolean, into array<int>, out array<int>, cost array<long>, audit array<string>, system array<boolean>"


class Scripts:
    """A tree of edit scripts; node 0 is the empty one."""

    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus
        self.up, self.char, self.depth, self.hash = [()], [""], [0], [0]

    def grow(self, node: int, char: str) -> int:
        new, up = len(self.char), []
        while True:  # the ancestor at 2**k is that at 2**(k-1) of the one at 2**(k-1)
            up.append(node)
            k = len(up) - 1
            if len(self.up[node]) <= k:
                break
            node = self.up[node][k]
        parent = up[0]
        self.up.append(tuple(up))
        self.char.append(char)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * BASE + ord(char)) % self.modulus)
        return new

    def ancestor(self, node: int, depth: int) -> int:
        while (gap := self.depth[node] - depth) > 0:
            node = self.up[node][gap.bit_length() - 1]
        return node

    def split(self, a: int, b: int, same) -> tuple[int, int]:
        """The first nodes below the longest common prefix of two paths of one length."""
        for k in reversed(range(max(len(self.up[a]), len(self.up[b])))):
            if k < len(self.up[a]) and not same(self.up[a][k], self.up[b][k]):
                a, b = self.up[a][k], self.up[b][k]
        return a, b

    def less(self, a: int, b: int, char_a: str, char_b: str) -> bool:
        """Whether script a and then char_a stands before script b and then char_b, neither a prefix of the other."""
        x, y = (self.ancestor(n, min(self.depth[a], self.depth[b])) for n in (a, b))
        if x == y:
            deep_a, deep_b = (n if self.depth[n] == self.depth[x] else self.ancestor(n, self.depth[x] + 1) for n in (a, b))
            return (self.char[deep_a] if deep_a != x else char_a) < (self.char[deep_b] if deep_b != x else char_b)
        p, q = self.split(x, y, lambda m, n: self.hash[m] == self.hash[n])
        if self.up[p][0] != self.up[q][0] or self.char[p] == self.char[q]:  # two paths with one hash
            p, q = self.split(x, y, lambda m, n: m == n)
        return self.char[p] < self.char[q]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.char[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def solve(rows: list[tuple[str, bool, bool]], starts: tuple[int, ...] = (START,), modulus: int = MODULUS) -> dict[tuple[int, int], tuple[int, str]]:
    """{(state before, state after): (cost, audit)} of rows (role initial, must go, truncated)."""
    out = {}
    for begin in starts:
        tree = Scripts(modulus)

        def offer(best: dict, state: int, cost: int, node: int, char: str) -> None:
            old = best.get(state)
            if old is None or cost < old[0] or cost == old[0] and tree.less(node, old[1], char, old[2]):
                best[state] = (cost, node, char)

        def grown(best: dict) -> dict[int, tuple[int, int]]:
            return {s: (c, tree.grow(n, ch) if ch else n) for s, (c, n, ch) in best.items()}

        def inserted(now: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
            """Up to two inserted turns; a third one leads back to a state that was reached for less."""
            fresh = now
            for _ in range(2):
                best = {s: (c, n, "") for s, (c, n) in now.items()}
                for s, (c, n) in fresh.items():
                    for to in NEXT[s].values():
                        if to in NAMES:
                            offer(best, to, c + INSERT, n, "I")
                after = grown(best)
                fresh = {s: v for s, v in after.items() if now.get(s) != v}
                now = after
            return now

        now = inserted({begin: (0, 0)})
        for initial, must_go, truncated in rows:
            best: dict[int, tuple[int, int, str]] = {}
            for s, (c, n) in now.items():
                offer(best, s, c + DELETE, n, "D")
                if not must_go:
                    more = TRUNCATED if truncated else 0
                    if initial in NEXT[s]:
                        offer(best, NEXT[s][initial], c + KEEP + more, n, "K")
                    for to in NEXT[s].values():
                        if to in NAMES:
                            offer(best, to, c + REROLE + more, n, "R")
            now = inserted(grown(best))
        out |= {(begin, s): (c, tree.text(n)) for s, (c, n) in now.items()}
    return out


def faults(text: Column) -> dict[str, Column]:
    """blank: no character beside white space; truncated: the last such is no end of a sentence."""
    solid = F.rtrim(text, F.lit(BLANKS))
    return {"blank": solid == "", "truncated": (solid != "") & ~F.right(solid, F.lit(1)).isin(".", "!", "?")}


def placed(turns: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Two written tables: turns in order, with part and at (ascending, without gaps in a part); and their faults, without their texts."""
    n = parts_for(turns.agg(F.coalesce(F.sum(F.octet_length("text") + 32), F.lit(0)).alias("b")).first()["b"], size)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc(), F.col("tie").asc()]
    tied = turns.withColumn("tie", F.monotonically_increasing_id())  # so that one row, often repeated, may lie in several ranges
    rows = tied.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("tie")
    rows = materialise(rows.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id(), "said": F.sha2(F.concat(F.col("role"), F.lit("\x00"), F.col("text")), 256)}), "turns")
    first = rows.groupBy("conv_id", "said").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    slim = rows.select("conv_id", "turn", "part", "at", F.substring("role", 1, 1).alias("initial"), *(c.alias(k) for k, c in faults(F.col("text")).items()))
    slim = slim.join(first, "at", "left").withColumn("duplicate", ~F.col("blank") & F.col("first").isNull()).drop("first")
    return rows.drop("said"), materialise(slim.withColumn("truncated", F.col("truncated") & ~F.col("duplicate")), "faults")


def opens_with_system(rows: list[tuple[str, bool, bool]], audit: str) -> bool:
    """Whether a script that begins at the start first says a system turn."""
    at = 0
    for op in audit:
        if op != "D":
            return op == "K" and rows[at][0] == "s"
        at += 1
    return False


PIECE = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("whole", pa.bool_()), *((k, pa.list_(t)) for k, t in (("into", pa.int32()), ("out", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("system", pa.bool_())))])
PLAN = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("illegal", pa.int64()), ("state", pa.int32()), ("system", pa.bool_()), ("cost", pa.int64()), ("audit", pa.string())])


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def segments(slim: DataFrame) -> DataFrame:
    """A row a conversation and part: where it lies, illegal neighbours, and the cheapest edits by state before and after it.

    Those in a part's middle are whole: they begin at the start and end in a final state. The first and the last one of a part may go on
    in another, so they are solved for each state."""

    def close(key: tuple, rows: list, at: int, edge: bool) -> tuple:
        best = solve(rows, tuple(NEXT) if edge else (START,))
        if not edge:
            cost, audit, end = min((*v, s) for (_, s), v in best.items() if s in FINAL)
            best = {(START, end): (cost, audit)}
        illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(rows, rows[1:]))
        system = [k[0] == START and opens_with_system(rows, v[1]) for k, v in best.items()]
        return (key[1], key[0], at, len(rows), illegal, rows[0][0], rows[-1][0], not edge, [k[0] for k in best], [k[1] for k in best], [v[0] for v in best.values()], [v[1] for v in best.values()], system)

    def solved(batches):
        done: list[tuple] = []
        key, rows, at, before = None, [], 0, None
        for b in batches:
            for part, conv, place, initial, gone, cut in zip(*(b.column(c).to_pylist() for c in ("part", "conv_id", "at", "initial", "gone", "truncated"))):
                if key != (part, conv):
                    if key is not None:
                        done.append(close(key, rows, at, before != key[0] or part != key[0]))
                        before = key[0]
                    key, rows, at = (part, conv), [], place
                rows.append((initial, gone, cut))
            if len(done) > 2000:
                yield batch_of(done, PIECE)
                done = []
        if key is not None:
            yield batch_of([*done, close(key, rows, at, True)], PIECE)

    rows = slim.select("part", "conv_id", "at", "initial", (F.col("blank") | F.col("duplicate")).alias("gone"), "truncated")
    return rows.repartition("part").sortWithinPartitions("part", "at").mapInArrow(solved, SEGMENT)


def chained(pieces: list[dict]) -> tuple[int, list[tuple[int, int, bool, str]]]:
    """(cost, [(segment's index, state before it, whether it opens with a system turn, its audit)]) of the best script over segments in order."""
    best: dict[int, tuple[int, str, list]] = {START: (0, "", [])}
    for i, p in enumerate(pieces):
        after: dict[int, tuple[int, str, list]] = {}
        for a, b, c, text, system in zip(p["into"], p["out"], p["cost"], p["audit"], p["system"]):
            if a in best:
                cost, sofar, steps = best[a]
                new = (cost + c, sofar + text, [*steps, (i, a, system, text)])
                if b not in after or new[:2] < after[b][:2]:
                    after[b] = new
        best = after
    cost, _, steps = min((v for s, v in best.items() if s in FINAL), key=lambda v: v[:2])
    return cost, steps


def plans(found: DataFrame) -> DataFrame:
    """(conv_id, at, illegal, state, system, cost, audit): each segment's own piece of its conversation's script. Whole segments have it
    already; the others, two a part at most, meet by conversation."""
    one = lambda c: F.col(c)[0].alias("state" if c == "into" else c)
    whole = found.where("whole").select("conv_id", "at", "illegal", one("into"), one("system"), one("cost"), one("audit"))

    def chain(group: pa.Table) -> pa.Table:
        pieces = sorted(group.to_pylist(), key=lambda p: p["at"])
        cost, steps = chained(pieces)
        joint = [0] + [int(a["last"] + b["first"] not in LEGAL) for a, b in zip(pieces, pieces[1:])]
        rows = [(pieces[i]["conv_id"], pieces[i]["at"], pieces[i]["illegal"] + joint[i], state, system, 0 if i else cost, text) for i, state, system, text in steps]
        return pa.Table.from_batches([batch_of(rows, PLAN)])

    return whole.unionByName(found.where("not whole").groupBy("conv_id").applyInArrow(chain, "conv_id long, at long, illegal long, state int, system boolean, cost long, audit string"))


def edits(planned: DataFrame) -> DataFrame:
    """(conv_id, at, seq, says): the turns of the repaired conversations. seq 0: row `at` stays, in the role that it says, or in its own if null;
    else a new turn after row `at` (before a segment's first row, after the one before it)."""
    schema = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("seq", pa.int32()), ("says", pa.string())])

    def unfold(batches):
        for b in batches:
            out: list[tuple] = []
            for conv, at, state, system, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "at", "state", "system", "audit"))):
                place, seq = at - 1, 0
                for op in text:
                    place, seq = (place, seq + 1) if op == "I" else (place + 1, 0)
                    if op != "D":
                        state = SYSTEM if state == START and system else ASSISTANT if state == USER else USER
                        out.append((conv, place, seq, None if op == "K" else NAMES[state]))
            yield batch_of(out, schema)

    return planned.select("conv_id", "at", "state", "system", "audit").mapInArrow(unfold, "conv_id long, at long, seq int, says string")


def repair(conversations: DataFrame, size: int = 4 << 20) -> tuple[DataFrame, DataFrame]:
    """The conversations' audits, and their repaired turns.

    conversations: conv_id (integer), turn, role, text; null role and text are one space, other columns aren't read. A conversation's rows go
    by turn (nulls first), then role, then text. Legal role initials are none, or an optional system turn, and then user and assistant by turns.
    Edits: keep (0), rerole to user or assistant (2), delete (3; a must for a blank row and for one whose role and text stood before), insert
    an empty turn (2); what stays and ends without [.!?] adds 1. Of the cheapest scripts the ASCII-least counts. Null conv_id is one
    conversation. Rows repeated whole are duplicates. An empty table gives two empty tables. size: bytes of text of a part.

    audits: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. repaired: conv_id, at, seq (together the order), role, text."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows, slim = placed(conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text")), size)
    planned = materialise(plans(materialise(segments(slim), "segments")), "scripts")
    counted = lambda c: F.sum(c).alias(c)
    kinds = ["blank", "duplicate", "truncated"]
    by_turn = slim.groupBy("conv_id", "turn").agg(*(F.sum(F.col(k).cast("long")).alias(k) for k in kinds))
    counts = by_turn.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *map(counted, kinds))
    pieces = F.array_sort(F.collect_list(F.struct("at", "audit")))  # a row a part
    scripts = planned.groupBy(F.col("conv_id").alias("own")).agg(counted("illegal"), counted("cost"), F.array_join(F.transform(pieces, lambda x: x["audit"]), "").alias("audit"))
    audits = counts.join(scripts, F.col("conv_id").eqNullSafe(F.col("own"))).drop("own")
    new = edits(planned)
    stay = new.where("seq = 0").join(rows.select("at", "role", "text"), "at").select("conv_id", "at", "seq", F.coalesce("says", "role").alias("role"), "text")
    return audits, stay.unionByName(new.where("seq > 0").select("conv_id", "at", "seq", F.col("says").alias("role"), F.lit("").alias("text")))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) over `role:text` lines. A digest is of all bytes in order, so a conversation is read by one task, line by
    line, with no more than a batch in memory."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def hashed(batches):
        key, digest = None, None
        for b in batches:
            out = []
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if digest is None or conv != key:
                    if digest is not None:
                        out.append((key, digest.hexdigest()))
                    key, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield batch_of(out, schema)
        if digest is not None:
            yield batch_of([(key, digest.hexdigest())], schema)

    return repaired.repartition("conv_id").sortWithinPartitions("conv_id", "at", "seq").mapInArrow(hashed, "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with known faults, by crc32(`conv_id:turn`) % 20: 0 dropped, 1 without text, 2 without [.!?], 3 twice, 4 said by the user. Nulls are one
    space, but a null conv_id or turn stays null beside its part in the hash."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("kind")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind).where("kind <> 0")
    rows = rows.withColumns({"role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")), "text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))})
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def repair_damaged(conversations: DataFrame, size: int = 4 << 20) -> DataFrame:
    """A row for each conv_id of conversations, with what repair() finds in them after damage, and the digest of what it makes of them."""
    audits, repaired = repair(damaged(conversations), size)
    repaired = digests(repaired).withColumnRenamed("conv_id", "own")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(audits.withColumnRenamed("conv_id", "its"), F.col("conv_id").eqNullSafe(F.col("its")), "left").join(repaired, F.col("conv_id").eqNullSafe(F.col("own")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: The same by a recursive table: a row a conversation, place and state, the cheapest script so far and what it says.
SQL = r"""
WITH RECURSIVE crc_table AS MATERIALIZED (  -- of CRC-32, by its polynomial
  SELECT list(list_reduce(range(8), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)), i) ORDER BY i) AS t FROM range(256) r(i)),
keyed AS (SELECT *, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations),
d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), CAST(4294967295 AS BIGINT))) % 20 AS k
  FROM keyed, crc_table),
faulty AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM d WHERE k <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS solid, substr(role, 1, 1) AS c
  FROM faulty),
r AS (
  SELECT *, solid = '' AS blank, solid <> '' AND seen > 1 AS duplicate,
         solid <> '' AND seen = 1 AND right(solid, 1) NOT IN ('.', '!', '?') AS truncated,
         lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (before IS NOT NULL AND concat(before, c) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM r GROUP BY conv_id),
-- states: 0 nothing said, 1 system, 2 user, 3 assistant; what may come in from each, in front of a row or at the end
ins(a, b, price, ops, said) AS (
  VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
         (0, 2, 2, 'I', chr(10) || 'user:'), (1, 2, 2, 'I', chr(10) || 'user:'), (3, 2, 2, 'I', chr(10) || 'user:'), (2, 3, 2, 'I', chr(10) || 'assistant:'),
         (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
move(a, op, c, b, price, role) AS (
  VALUES (0, 'D', '', 0, 3, NULL), (1, 'D', '', 1, 3, NULL), (2, 'D', '', 2, 3, NULL), (3, 'D', '', 3, 3, NULL),
         (0, 'R', '', 2, 2, 'user'), (1, 'R', '', 2, 2, 'user'), (2, 'R', '', 3, 2, 'assistant'), (3, 'R', '', 2, 2, 'user'),
         (0, 'K', 's', 1, 0, NULL), (0, 'K', 'u', 2, 0, NULL), (1, 'K', 'u', 2, 0, NULL), (2, 'K', 'a', 3, 0, NULL), (3, 'K', 'u', 2, 0, NULL)),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, b AS s, CAST(price AS BIGINT) AS cost, CAST(ops AS VARCHAR) AS audit, CAST(said AS VARCHAR) AS said
  FROM (SELECT DISTINCT conv_id FROM r) CROSS JOIN ins WHERE a = 0
  UNION ALL
  SELECT conv_id, i, s, (best).cost, (best).audit, (best).said FROM (
    SELECT dp.conv_id, r.i, ins.b AS s,
           min({'cost': dp.cost + move.price + CASE WHEN op <> 'D' AND truncated THEN 1 ELSE 0 END + ins.price, 'audit': dp.audit || op || ops,
                'said': dp.said || CASE WHEN op = 'D' THEN '' ELSE chr(10) || coalesce(move.role, r.role) || ':' || text END || ins.said}) AS best
    FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1
    JOIN move ON move.a = dp.s AND (op = 'D' OR NOT (blank OR duplicate)) AND (op <> 'K' OR move.c = r.c)
    JOIN ins ON ins.a = move.b
    GROUP BY dp.conv_id, r.i, ins.b)),
ended AS (
  SELECT dp.conv_id, min({'cost': cost, 'audit': audit, 'said': said}) AS best
  FROM dp JOIN counts ON counts.conv_id IS NOT DISTINCT FROM dp.conv_id AND i = n WHERE s IN (0, 3) GROUP BY dp.conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce((best).cost, 0) AS cost, coalesce((best).audit, '') AS audit, sha256(substr(coalesce((best).said, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM e.conv_id
"""
