"""Personal data: fixed patterns, and a linear-chain CRF over word shapes that adds what the patterns miss.

The patterns find data in its regular form. The CRF is trained on a small labelled table that also holds irregular forms
(numbers without a plus sign, grouped with dots, in brackets, next to punctuation) and look-alikes that are no personal data (dates,
versions, prices, hexadecimal keys), and is decoded by Viterbi over many word chains at once in numpy. All kinds hold a digit or
an at sign, so a chain is a run of words around such words, with two words of context; elsewhere the label is fixed to "none".
Every scan of a text takes time in proportion to its length, whatever it holds.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Block, blocks

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns; matches are tested further by valid(). Emails are looked for from their at sign. A match of the address
#: pattern always begins where a run of digits does, as it ends where one does, so no other place need be tried.
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
CONTEXT = 2
#: Words of all chains that are decoded at once, with padding.
CELLS = 1 << 16


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def valid(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in text.split(".")))
    digits = re.sub("[^0-9]", "", text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, at sign and dotted domain, from each at sign to both sides."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        if a < at and (m := DOMAIN.match(text, at + 1)):
            out.append((a, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the patterns, in code points, by kind, then start."""
    return [("email", a, b) for a, b in emails(text)] + [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in p.finditer(text) if valid(k, m.group())]


def labelled_table(rows: int = 300, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The small table the CRF learns from: made texts with (kind, start, end) of what is personal in them."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abdehilnorstuéñü"), rng.integers(2, 9)))
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *x: str(x[rng.integers(len(x))])

    def email():
        return pick(f"{word()}.{digits(2)}@{word()}{digits(1)}.{word()}.com", f"{word()}@{word()}.org", f"{word()}_{word()}@{word()}", f"{word()}{digits(3)}@{word()}-{word()}.net")

    def ip():
        return ".".join(str(rng.integers(1, 256)) for _ in range(4))

    def card():
        body = digits(15)
        body += next(str(d) for d in range(10) if luhn(body + str(d)))
        cut = [body[i : i + 4] for i in range(0, 16, 4)]
        return pick(body, body, " ".join(cut), "-".join(cut), ".".join(cut))

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)}.{a}.{b}{c}")

    def other():
        hexa = "".join(rng.choice(list("0123456789abcdef"), 40))
        return pick(f"19{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(1)}.{digits(2)}", f'"{hexa}"', hexa, f"${digits(3)}.{digits(2)}", digits(int(rng.integers(1, 8))), f"{digits(2)}:{digits(2)}", f"{digits(3)},{digits(3)}", f"v{digits(1)}.{digits(1)}", digits(int(rng.integers(20, 30))), f"{digits(4)}/{digits(2)}", f"{digits(2)}%", f"{word()}{digits(2)}", f"{digits(2)}-{digits(3)}")

    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(rng.integers(3, 9)):
            text += "".join(f"{word()} " for _ in range(rng.integers(0, 4)))
            kind = pick(*KINDS, "other", "other", "other", "other")
            said = make[kind]() if kind in make else other()
            if kind in make:
                spans.append((kind, len(text), len(text) + len(said)))
            text += said + pick("", "", "", ".", ",", "!!", "###", ";") + " "
        out.append((text, spans))
    return out


def shape(word: str) -> str:
    """Digits 9, capitals X, other letters x, all else as it is; runs cut to four, or to one for letters."""
    s = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", lambda m: "X" if m.group().isupper() else "x", word))
    return re.sub(r"([xX])\1*", r"\1", re.sub(r"9{5,}", "99999", s))


def features(words: list[str]) -> Iterator[list[str]]:
    """The features of each word of a chain."""
    shapes = [shape(w) for w in words]
    for i, (w, s) in enumerate(zip(words, shapes, strict=True)):
        n = sum(c in "0123456789" for c in w)
        bare = s.strip(".,;:!?#$%&*\"'()[]")
        yield [f"s={s}", f"b={bare}", f"n={min(n, 20)}", f"l={min(len(w), 40) // 4}", f"@={'@' in w}", f"d={min(w.count('.'), 4)}", f"h={bool(re.search('[a-f]', w)) and n > 8}", f"p={shapes[i - 1] if i else '^'}", f"q={shapes[i + 1] if i + 1 < len(shapes) else '$'}"]


class Crf:
    """Weights of features for each label, of label pairs, and of the first label."""

    def __init__(self, index: dict[str, int]):
        self.index, n = index, len(LABELS)
        self.emit, self.move, self.first = np.zeros((len(index) + 1, n)), np.zeros((n, n)), np.zeros(n)
        for j, b in enumerate(LABELS):  # I follows only B or I of its kind
            if b[0] == "I":
                self.first[j] = -1e4
                for i, a in enumerate(LABELS):
                    self.move[i, j] = 0 if a[0] != "O" and a[2:] == b[2:] else -1e4

    def ids(self, feats: Iterable[list[str]]) -> np.ndarray:
        return np.array([[self.index.get(f, len(self.index)) for f in row] for row in feats], np.int32)

    def scores(self, chains: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(c) for c in chains])
        out = np.zeros((len(chains), lengths.max(), len(LABELS)))
        for k, c in enumerate(chains):
            out[k, : len(c)] = sum(self.emit[c[:, j]] for j in range(c.shape[1]))
        return out, lengths

    def decode(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over all chains at once (padded to the longest)."""
        e, lengths = self.scores(chains)
        best, back = self.first + e[:, 0], np.zeros(e.shape, np.int8)
        for t in range(1, e.shape[1]):
            step = best[:, :, None] + self.move
            back[:, t] = step.argmax(1)
            on = (t < lengths)[:, None]
            best = np.where(on, step.max(1) + e[:, t], best)
        state, out = best.argmax(1), np.zeros(e.shape[:2], np.int8)
        for t in range(e.shape[1] - 1, -1, -1):
            on = t < lengths
            out[:, t] = np.where(on, state, 0)
            state = np.where(on & (t > 0), back[np.arange(len(state)), t, state], state)
        return [out[k, :n] for k, n in enumerate(lengths)]

    def fit(self, chains: list[np.ndarray], gold: list[np.ndarray], epochs: int = 40, rate: float = 0.5, decay: float = 1e-3) -> None:
        """Maximum likelihood by AdaGrad, with forward and backward sums over all chains at once."""
        e0, lengths = self.scores(chains)
        n, most, k = e0.shape
        y = np.zeros((n, most), np.int64)
        for i, g in enumerate(gold):
            y[i, : len(g)] = g
        on = np.arange(most) < lengths[:, None]
        hot = np.eye(k)[y] * on[:, :, None]
        pairs = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:])
        squares = [np.full_like(w, 1e-2) for w in (self.emit, self.move, self.first)]
        total = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        for _ in range(epochs):
            e, _ = self.scores(chains)
            a, b = np.zeros_like(e), np.zeros_like(e)
            a[:, 0] = self.first + e[:, 0]
            for t in range(1, most):
                a[:, t] = np.where(on[:, t, None], total(a[:, t - 1, :, None] + self.move, 1) + e[:, t], a[:, t - 1])
            for t in range(most - 2, -1, -1):
                b[:, t] = np.where(on[:, t + 1, None], total(self.move + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
            z = total(a[:, -1], 1)
            at = np.exp(a + b - z[:, None, None]) * on[:, :, None]
            both = np.zeros((k, k))
            for t in range(1, most):
                p = a[:, t - 1, :, None] + self.move + (e[:, t] + b[:, t])[:, None, :] - z[:, None, None]
                both += (np.exp(p) * on[:, t, None, None]).sum(0)
            grads = [np.zeros_like(self.emit), pairs - both, (hot[:, 0] - at[:, 0]).sum(0)]
            diff = hot - at
            for i, c in enumerate(chains):
                np.add.at(grads[0], c.ravel(), np.repeat(diff[i, : len(c)], c.shape[1], axis=0))
            for w, g, s in zip((self.emit, self.move, self.first), grads, squares, strict=True):
                free = w > -1e3
                g = np.where(free, g - decay * len(chains) * w, 0)
                s += g * g
                w += rate * g / np.sqrt(s)
        self.emit[-1] = 0


WORD, SIGN = re.compile(r"\S+"), re.compile("[0-9@]")


def gold_labels(words: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(len(words), np.int64)
    for kind, a, b in spans:
        inside = [i for i, (s, e) in enumerate(words) if s < b and e > a]
        for j, i in enumerate(inside):
            out[i] = LABELS.index(f"{'I' if j else 'B'}-{kind}")
    return out


def train(table: list[tuple[str, list[tuple[str, int, int]]]]) -> Crf:
    """table: (text, spans) rows, few enough for the driver; labelled_table() makes the usual one."""
    words = [[m.span() for m in WORD.finditer(t)] for t, _ in table]
    feats = [list(features([t[a:b] for a, b in w])) for (t, _), w in zip(table, words, strict=True)]
    index: dict[str, int] = {}
    for f in sorted({f for rows in feats for row in rows for f in row}):
        index[f] = len(index)
    crf = Crf(index)
    crf.fit([crf.ids(f) for f in feats], [gold_labels(w, s) for w, (_, s) in zip(words, table, strict=True)])
    return crf


def chains_of(text: str) -> list[list[tuple[int, int]]]:
    """Word bounds around the words with a digit or an at sign, CONTEXT words to each side; chains that meet are one."""
    words = [m.span() for m in WORD.finditer(text)]
    ranges: list[list[int]] = []
    k = 0
    for m in SIGN.finditer(text):
        while words[k][1] <= m.start():
            k += 1
        if ranges and k - CONTEXT <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], min(len(words), k + CONTEXT + 1))
        else:
            ranges.append([max(0, k - CONTEXT), min(len(words), k + CONTEXT + 1)])
    return [words[a:b] for a, b in ranges]


def added_spans(text: str, chains: list[list[tuple[int, int]]], labels: list[np.ndarray], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """What the CRF has found, without edge punctuation, if it holds as its kind and touches no base span."""
    out = []
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], np.maximum.accumulate([0, *(b for _, b in taken)])  # the furthest end of the first k
    for words, label in zip(chains, labels, strict=True):
        i = 0
        while i < len(words):
            name = LABELS[label[i]]
            if name == "O":
                i += 1
                continue
            j = i + 1
            while j < len(words) and LABELS[label[j]] == f"I-{name[2:]}":
                j += 1
            kind, a, b = name[2:], words[i][0], words[j - 1][1]
            i = j
            edge = ".,;:!?#$%&*\"'[]{}<>|"
            while a < b and text[a] in edge:
                a += 1
            while b > a and text[b - 1] in edge:
                b -= 1
            said = text[a:b]
            form = {"email": r"[^\s@]+@[\w-]+(\.[\w-]+)*", "ip": r"[0-9]+(\.[0-9]+){3}", "card": r"[0-9]([\s.-]?[0-9])+", "phone": r"\+?\(?[0-9][\s().0-9-]+[0-9]"}[kind]
            if re.fullmatch(form, said) and valid(kind, said) and reach[bisect.bisect_left(starts, b)] <= a:
                out.append((kind, a, b))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def spans_of(block: Block, model: Crf) -> dict[int, tuple[list, list]]:
    """(base spans, all spans) of the block's rows that have a digit or an at sign."""
    sign = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum(((block.data >= 48) & (block.data <= 57)) | (block.data == 64), out=sign[1:])
    some = np.flatnonzero(sign[block.bounds[1:]] > sign[block.bounds[:-1]])
    texts = {r: block.data[block.bounds[r] : block.bounds[r + 1]].tobytes().decode() for r in some}
    work = [(r, base_spans(t), chains_of(t)) for r, t in texts.items()]
    flat = [(k, c) for k, (_, _, chains) in enumerate(work) for c in chains]
    labels: list = [None] * len(flat)
    order = sorted(range(len(flat)), key=lambda i: len(flat[i][1]))  # of like length, so that padding is small
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * len(flat[order[to]][1]) <= CELLS:
            to += 1
        ids = [model.ids(features([texts[work[flat[i][0]][0]][a:b] for a, b in flat[i][1]])) for i in order[at:to]]
        for i, got in zip(order[at:to], model.decode(ids), strict=True):
            labels[i] = got
        at = to
    spans, at = {}, 0
    for r, base, chains in work:
        spans[int(r)] = base, base + added_spans(texts[r], chains, labels[at : at + len(chains)], base)
        at += len(chains)
    return spans


def find_personal(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base spans, as base_sha256), base_sha256, spans (all), n_added.

    Null text is empty: no spans. Very long texts are read whole. Each row is judged alone, equal rows alike; rows without
    doc_id too. Other columns are not read. An empty table gives no rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(crf or train(labelled_table()))  # as large as the labelled table's features

    def find(batches):
        for block in blocks(batches):
            spans = spans_of(block, shared.value)
            both = [spans.get(r, ([], [])) for r in range(len(block.batch))]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in both], pa.int64()) for k in KINDS]
            added = pa.array([len(every) - len(base) for base, every in both], pa.int64())
            hashes = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in both], pa.string())
            yield pa.RecordBatch.from_arrays([block.batch.column("doc_id"), *counts, hashes, pa.array([joined(every) for _, every in both], pa.string()), added], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return docs.mapInArrow(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span as <KIND>; of overlapping ones the first by start, then the longest."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
            at = b
        elif b > at:
            at = b
    return "".join(out) + text[at:]


def mask_personal(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """docs with personal data in text replaced by its kind, and n_chars, where there is such a column, to match.

    All other columns are kept as they are. Null texts stay null, empty ones empty; equal rows are masked alike. An empty
    table gives no rows."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(crf or train(labelled_table()))

    def mask(batches):
        for block in blocks(batches):
            spans = {r: every for r, (_, every) in spans_of(block, shared.value).items() if every}
            columns = {n: block.batch.column(n) for n in block.batch.schema.names}
            if spans:
                new = columns["text"].to_pylist()
                for r, every in spans.items():
                    new[r] = masked(new[r], every)
                columns["text"] = pa.array(new, columns["text"].type)
                if "n_chars" in columns:
                    n = columns["n_chars"].to_pylist()
                    for r in spans:
                        n[r] = len(new[r])
                    columns["n_chars"] = pa.array(n, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(mask, docs.schema)
