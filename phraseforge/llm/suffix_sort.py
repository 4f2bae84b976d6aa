"""Suffix sorting by induction with common prefixes, its priority queues in scratch files where memory is short (numpy, used inside tasks).

The queue of an induced sort has one entry for each suffix, keyed by its first symbol; entries of one symbol leave in the order they
came. How many of each symbol will come is known beforehand, so the queue is one array with a stretch for each symbol, in memory or in
an unlinked scratch file that the system pages in and out. All entries up to the first that has not come yet leave at once,
whatever their symbols, and what they induce is dealt out in their order. Substrings between leftmost S-type places are sorted by
the same induction, named, and the string of names is sorted by recursion, with queues of the same kind.

Beside each suffix the queue carries how many symbols it shares with the one before it. Two suffixes of one symbol that are induced one
after the other share one more than the least value between those that induced them; `Prefixes` keeps these leasts from step to step. What
the recursion says of names is turned into symbols by the places of the names. Values stop at a limit, so each is two bytes.

Of a text only steps of bounded length are in memory outside a Scratch: places, counts of symbols, names, values and results all lie in it.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Entries that leave at once, at most; elements that other passes take at a time.
STEP = 1 << 16
PASS = STEP << 2


class Scratch:
    """Arrays in memory while all of them fit a budget of bytes, else in unlinked files in the executor's own spill folder.

    base: strings of at most so many names end the recursion, about 40 bytes a name in memory."""

    def __init__(self, budget: int, base: int = 0):
        self.left, self.base = budget, base
        self.in_files = 0

    def array(self, n: int, kind) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if size <= self.left or not n:
            self.left -= size
            return np.zeros(n, kind)
        self.in_files += 1
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        with tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None) as file:
            file.truncate(size)
            return np.memmap(file, kind, "r+", shape=(n,)).view(np.ndarray)

    def give_back(self, *arrays: np.ndarray) -> None:
        for x in arrays:
            while isinstance(x.base, np.ndarray):
                x = x.base
            self.left += 0 if isinstance(x, np.memmap) else x.nbytes


def passes(n: int) -> list[slice]:
    return [slice(a, min(a + PASS, n)) for a in range(0, n, PASS)]


def whole_kind(n: int):
    return np.int32 if n < (1 << 31) - 1 else np.int64


def s_types(text: np.ndarray, out: np.ndarray) -> None:
    """out: True where the suffix is smaller than the next one's; the end counts as smaller than any symbol. From right to left, in steps."""
    n, after, rises = len(text), -1, False  # the symbol after the step, and the type of its suffix
    for b in range(n, 0, -PASS):
        a = max(0, b - PASS)
        here = np.concatenate([text[a:b], [after]]).astype(np.int64)
        differs = here[:-1] != here[1:]
        up = np.append(here[:-1] < here[1:], rises)
        following = np.where(differs, np.arange(b - a), b - a)
        following = np.minimum.accumulate(following[::-1])[::-1]  # the next place whose symbol differs from its follower's
        out[a:b] = up[following]
        after, rises = int(text[a]), bool(out[a])


def tally(out: np.ndarray, symbols: np.ndarray) -> None:
    """Add how often each symbol occurs."""
    if len(out) <= STEP:
        out += np.bincount(symbols, minlength=len(out))
    else:
        which, times = np.unique(symbols, return_counts=True)
        out[which] += times


def running(scratch: Scratch, *counts: np.ndarray) -> np.ndarray:
    """Where each symbol's stretch begins, and at last where the last one ends."""
    out, total = scratch.array(len(counts[0]) + 1, np.int64), 0
    for p in passes(len(counts[0])):
        ends = total + np.cumsum(sum(x[p] for x in counts))
        out[p.start + 1 : p.stop + 1] = ends
        total = ends[-1]
    return out


def seams(scratch: Scratch, start: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Where, in the stretches of symbols that have entries of both kinds, those of the upper kind begin."""
    out, at = scratch.array(len(lower), np.int64), 0
    for p in passes(len(lower)):
        found = (start[p] + lower[p])[(lower[p] > 0) & (upper[p] > 0)]
        out[at : at + len(found)] = found
        at += len(found)
    return out[:at]


def deal(free: np.ndarray, symbols: np.ndarray, way: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The next free places of symbols, upwards (1) or downwards (-1): (order by symbol, where each symbol begins in it, places in that order)."""
    order = symbols.argsort(kind="stable")
    symbols = symbols[order]
    if not len(symbols):
        return order, np.zeros(1, np.int64), order
    changes = (symbols[1:] != symbols[:-1]).nonzero()[0]
    cut = np.zeros(len(changes) + 2, np.int64)
    cut[1:-1], cut[-1] = changes + 1, len(symbols)
    times, own = cut[1:] - cut[:-1], symbols[cut[:-1]]
    places = np.repeat(free[own] - way * cut[:-1], times) + way * np.arange(len(symbols))
    free[own] += way * times
    return order, cut, places


class Prefixes:
    """Least common prefixes between entries of a sequence that is read in steps."""

    def __init__(self, symbols: int, limit: int, scratch: Scratch):
        self.limit, self.step, self.scratch = limit, 0, scratch
        self.last = scratch.array(symbols, np.int64)  # the step of each symbol's last source
        self.tail = scratch.array(symbols, np.uint16)  # the least value behind that source, in its step
        self.tail[:] = limit
        self.ids, self.least, self.held = np.zeros(limit + 2, np.int64), np.zeros(limit + 2, np.uint16), 0  # steps with less than all after them

    def close(self) -> None:
        self.scratch.give_back(self.last, self.tail)

    def between(self, values: np.ndarray, at: np.ndarray, symbols: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """What each entry shares with the last one induced of its symbol: one more than the least value between their sources.

        values: of all entries of this step, each with the one read before; at: the sources' places among them, by symbol and then in order;
        symbols: what they induce; cut: where each symbol begins. A symbol's very first entry has no meaning."""
        self.step += 1
        head = np.minimum.accumulate(values)
        out = None
        if len(at):
            begins = cut[:-1]
            own = symbols[begins]
            self.least[self.held] = self.limit
            older = self.least[self.ids[: self.held].searchsorted(self.last[own], "right")]
            firsts = np.minimum(np.minimum(self.tail[own], older), head[at[begins]])
            if len(begins) == len(at):
                out = firsts
            else:
                gap = at.copy()
                gap[1:] -= at[:-1]
                gap[begins] = 1
                level = np.frexp(gap)[1] - 1
                table = np.empty((int(level.max()) + 1, len(values)), np.uint16)  # least of 2**row values from here
                table[0] = row = values
                for k in range(1, len(table)):
                    half = 1 << (k - 1)
                    row = np.minimum(row[:-half], row[half:], out=table[k, : len(row) - half])
                out = np.minimum(table[level, at - gap + 1], table[level, at - (1 << level) + 1])
                out[begins] = firsts
            back = np.full(len(values) + 1, self.limit, np.uint16)
            np.minimum.accumulate(values[::-1], out=back[-2::-1])
            self.last[own] = self.step
            self.tail[own] = back[at[cut[1:] - 1] + 1]
            out += out < self.limit
        least = head[-1]
        while self.held and self.least[self.held - 1] >= least:
            self.held -= 1
        self.ids[self.held], self.least[self.held] = self.step, least
        self.held += 1
        return np.zeros(0, np.uint16) if out is None else out


def shared(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, limit: int) -> np.ndarray:
    """How many symbols suffixes a and b share, up to a limit, where the first `known` are known to be shared."""
    if not len(a):
        return known
    out = np.minimum(known, limit)
    left = np.flatnonzero(out < limit)
    while len(left):
        k = out[left]
        left, k = (x[np.maximum(a[left], b[left]) + k < len(text)] for x in (left, k))
        left = left[text[a[left] + k] == text[b[left] + k]]
        out[left] += 1
        left = left[out[left] < limit]
    return out


def induce(text: np.ndarray, s: np.ndarray, seeds: np.ndarray, symbols: int, scratch: Scratch, given: np.ndarray | None = None, limit: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
    """All suffixes in order, from the S* suffixes in order (of each symbol). Queues hold suffixes + 1; 0: not come yet.

    given: what each S* suffix shares with the one before it; then the second result is the same of all suffixes."""
    n, kind = len(text), whole_kind(len(text))
    every, large, sown = (scratch.array(symbols, np.int64) for _ in range(3))
    for p in passes(n):
        tally(every, text[p])
        tally(large, text[p][~s[p]])
    for p in passes(len(seeds)):
        tally(sown, text[seeds[p]])
    begin = running(scratch, large, sown)
    total = int(begin[-1])
    queue, free = scratch.array(total, kind), scratch.array(symbols, np.int64)
    values = None if given is None else scratch.array(total, np.uint16)
    np.add(begin[:-1], large, out=free)
    for p in passes(len(seeds)):
        order, _, to = deal(free, text[seeds[p]], 1)
        queue[to] = seeds[p][order] + 1
        if values is not None:
            values[to] = given[p][order]
    free[:] = begin[:-1]
    end = int(text[n - 1])
    queue[free[end]] = n
    free[end] += 1
    line = None if given is None else Prefixes(symbols, limit, scratch)
    edges = None if given is None else seams(scratch, begin, large, sown)
    at, step, done = 0, STEP, 0
    while at < total:
        now = np.asarray(queue[at : at + step])
        gap = (now == 0).nonzero()[0]
        now = (now[: gap[0]] if len(gap) else now).astype(np.int64) - 1
        if not len(now):
            raise ValueError("a suffix was never induced")
        source = now.nonzero()[0]
        source = source[~s[now[source] - 1]]
        prior = now[source] - 1
        order, cut, to = deal(free, text[prior], 1)
        prior = prior[order]
        queue[to] = prior + 1
        if line is not None:
            here = np.array(values[at : at + len(now)])
            if done < len(edges) and edges[done] < at + len(now):
                edge = edges[done : edges.searchsorted(at + len(now))]  # first S* of their symbols
                here[edge - at] = shared(text, queue[edge - 1].astype(np.int64) - 1, now[edge - at], np.zeros(len(edge), np.int64), limit)
                done += len(edge)
            own, first = text[prior], cut[:-1]
            got = line.between(here, source[order], own, cut)
            got[first[to[first] == begin[own[first]]]] = 0
            values[to] = got
        at, step = at + len(now), min(STEP, max(256, 4 * len(now)))  # look no further than pays
    start = running(scratch, every)
    out, beside = scratch.array(n, kind), None if given is None else scratch.array(n + 1, np.uint16)
    for p in passes(total):  # L-type suffixes to their places
        now = queue[p].astype(np.int64) - 1
        own = text[now]
        inner = np.arange(p.start, p.stop) - begin[own]
        lower = inner < large[own]
        to = (start[own] + inner)[lower]
        out[to] = now[lower] + 1
        if beside is not None:
            beside[to] = values[p][lower]
    scratch.give_back(queue, begin, sown)
    if line is not None:
        line.close()
        scratch.give_back(values)
        scratch.give_back(edges)
        line = Prefixes(symbols, limit, scratch)
        np.subtract(every, large, out=every)
        edges = seams(scratch, start, large, every)
    np.subtract(start[1:], 1, out=free)
    at, step, done = n, STEP, 0 if edges is None else len(edges)
    while at:
        low = max(0, at - step)
        now = np.asarray(out[low:at])
        gap = (now == 0).nonzero()[0]
        now = (now[gap[-1] + 1 :] if len(gap) else now)[::-1].astype(np.int64) - 1
        if not len(now):
            raise ValueError("a suffix was never induced")
        source = now.nonzero()[0]
        source = source[s[now[source] - 1]]
        prior = now[source] - 1
        order, cut, to = deal(free, text[prior], -1)
        prior = prior[order]
        out[to] = prior + 1
        if line is not None:
            low = at - len(now)
            if done and edges[done - 1] > low:
                edge = edges[edges.searchsorted(low + 1) : done]  # first S-type of their symbols; the last L-type is read now
                beside[edge] = shared(text, now[at - edge], out[edge].astype(np.int64) - 1, np.zeros(len(edge), np.int64), limit)
                done -= len(edge)
            own, first = text[prior], cut[:-1]
            got = line.between(beside[low + 1 : at + 1][::-1], source[order], own, cut)
            got[first[to[first] == start[own[first] + 1] - 1]] = 0
            beside[to + 1] = got
        at, step = at - len(now), min(STEP, max(256, 4 * len(now)))
    for p in passes(n):
        out[p] -= 1
    scratch.give_back(every, large, start, free)
    if line is None:
        return out, None
    line.close()
    scratch.give_back(edges)
    return out, beside[:n]


def in_memory(names: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of a string short enough for memory, by doubling."""
    n, k, key = len(names), 1, names.astype(np.int64)
    while True:
        order = key.argsort()
        key = key[order]
        rank = np.zeros(n, np.int64)
        rank[order[1:]] = np.cumsum(key[1:] != key[:-1])
        if rank[order[-1]] == n - 1:
            break
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        k *= 2
    out = np.zeros(n, np.uint16)
    out[1:] = shared(names, order[:-1], order[1:], np.zeros(n - 1, np.int64), limit)
    return order, out


def suffix_array(text: np.ndarray, symbols: int, budget: int = 256 << 20) -> np.ndarray:
    """The suffixes of text (integers from 0 to symbols - 1; it may itself be a mapped file) in order. budget: bytes of all arrays that
    grow with the text and may be held in memory, at all levels together; what is beyond lies in scratch files."""
    return sorted_suffixes(text, symbols, Scratch(budget), 1)[0]


def sorted_suffixes(text: np.ndarray, symbols: int, scratch: Scratch, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, how many symbols each shares with the one before it, up to a limit below 65,535)."""
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int64), np.zeros(n, np.uint16)
    s, star = scratch.array(n, bool), scratch.array(n, bool)
    s_types(text, s)
    star[1:] = s[1:]
    for p in passes(n - 1):
        star[p.start + 1 : p.stop + 1] &= ~s[p]
    star[0] = s[0]
    kind, m = whole_kind(n), int(np.count_nonzero(star))
    places, at = scratch.array(m, kind), 0
    for p in passes(n):
        found = p.start + np.flatnonzero(star[p])
        places[at : at + len(found)] = found
        at += len(found)
    seeds, values = places, scratch.array(m, np.uint16)
    if m > 1:
        ordered, _ = induce(text, s, places, symbols, scratch)
        kept, at = scratch.array(m, kind), 0
        for p in passes(n):
            found = ordered[p][star[ordered[p]]]
            kept[at : at + len(found)] = found
            at += len(found)
        scratch.give_back(ordered)
        names, name = scratch.array(m, kind), 0
        for p in passes(m):
            here = kept[max(p.start - 1, 0) : p.stop].astype(np.int64)
            rank = np.searchsorted(places, here)
            length = np.where(rank == m - 1, n + 1, places[np.minimum(rank + 1, m - 1)]) - here + 1  # the last one to the end, which no other has
            a, b = here[:-1], here[1:]
            same = (length[:-1] == length[1:]) & (rank[:-1] != m - 1) & (rank[1:] != m - 1)
            left = np.flatnonzero(same)
            k = 0
            while len(left):
                left = left[length[left] > k]
                off = (text[a[left] + k] != text[b[left] + k]) | (s[a[left] + k] != s[b[left] + k])
                same[left[off]] = False
                left = left[~off]
                k += 1
            ids = name + np.cumsum(~same)
            names[rank[1:]] = ids  # the first of all is 0
            name = int(ids[-1]) if len(ids) else name
        seeds = kept
        inner = beside = None
        if name + 1 < m:
            few = (limit + 1) // 2  # a name is two symbols or more
            inner, beside = in_memory(names, few) if m <= scratch.base else sorted_suffixes(names, name + 1, scratch, few)
            for p in passes(m):
                kept[p] = places[inner[p]]
        scratch.give_back(names)
        for p in passes(m - 1):
            a, b = (kept[p.start + k : p.stop + k].astype(np.int64) for k in (0, 1))
            known = np.zeros(len(a), np.int64)
            if inner is not None:
                known = places[inner[p.start + 1 : p.stop + 1] + beside[p.start + 1 : p.stop + 1].astype(np.int64)] - b
            values[p.start + 1 : p.stop + 1] = shared(text, a, b, known, limit)
        if inner is not None and m > scratch.base:
            scratch.give_back(inner, beside)
        scratch.give_back(places)
    scratch.give_back(star)
    out = induce(text, s, seeds, symbols, scratch, values, limit)
    scratch.give_back(s, seeds, values)
    return out
