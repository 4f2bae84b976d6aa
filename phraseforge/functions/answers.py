"""Answers of models and lists of codes kept as text, as Column expressions. All take null as an empty text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize, strip_fences

#: What a name may not hold, and how a bot's text shows that thinking goes before the answer.
NOT_A_NAME = r"(?i)[.;:]\s|\b(the|this|is|are|refers|means|should)\b"
THINKING = ("The user is", "We need to")
MARKERS = ("Thinking...", ">")
#: The tags of the channel protocol.
CHANNEL, FINAL, END = "<|channel|>", "<|channel|>final<|message|>", "<|end|>"


def _full(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def best_title(long_title: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(long_title, F.lit("")), title, F.lit(""))


def parse_channel(raw: Column) -> Column:
    """Text of the final channel; else of the last part between end tags, without tags; else all of it."""
    raw = _full(raw)
    final = F.substring_index(F.get(F.split(raw, rf"\Q{FINAL}\E", 2), F.lit(1)), END, 1)
    last = strip(F.regexp_replace(F.element_at(F.split(raw, rf"\Q{END}\E"), -1), r"<\|[^|]+\|>", ""))
    tagged = raw.contains(CHANNEL) & (last != "")
    return F.when(raw.contains(FINAL), strip(final)).when(tagged, last).otherwise(strip(raw))


def extract_json_object(raw: Column) -> Column:
    """The widest {...} after the thinking, within a fence if there is one; empty if none."""
    rest = F.element_at(F.split(_full(raw), "</thinking>"), -1)
    fenced = F.regexp_replace(F.get(F.split(rest, "```"), F.lit(1)), "^json", "")
    return F.regexp_extract(F.coalesce(fenced, rest), r"(?s)\{.*\}", 0)


def clean_answer(raw: Column) -> Column:
    """First line of the answer without channel tags, fences, quotation marks around it and a leading `Answer:`."""
    text = F.regexp_replace(F.regexp_replace(strip(strip_fences(parse_channel(raw))), '^"+|"+$', ""), "^'+|'+$", "")
    return strip(F.regexp_replace(strip(F.substring_index(text, "\n", 1)), r"(?i)^Answer:\s*", ""))


def is_valid_name(raw: Column) -> Column:
    """Three characters or more, one to ten words, no sentence marks nor filler words."""
    text = strip(_full(raw))
    return (F.length(text) >= 3) & (F.size(F.split(text, r"(?U)\s+")) <= 10) & ~text.rlike(NOT_A_NAME)


def extract_bot_text(raw: Column) -> Column:
    """Lines after the first marker line, without blank and marker lines. Where nothing remains: the last of several paragraphs
    if thinking shows, else the text without marker lines, else the text itself."""
    raw = _full(raw)
    bare = F.transform(F.split(raw, "\n"), lambda x: F.struct(x.alias("line"), strip(x).alias("bare")))
    lines = F.transform(bare, lambda x: F.struct(x["line"].alias("line"), (x["bare"] != "").alias("full"), (x["bare"].startswith(MARKERS[0]) | x["bare"].startswith(MARKERS[1])).alias("mark")))
    joined = lambda rows: strip(F.array_join(F.transform(rows, lambda x: x["line"]), "\n"))
    first = lambda rows: F.array_position(F.transform(rows, lambda x: x["mark"]), F.lit(True))  # noqa: E731; from 1, 0 if there is none
    after = lambda rows: bound(first(rows), lambda at: F.when(at > 0, joined(F.filter(rows, lambda x, i: (i >= at) & x["full"] & ~x["mark"]))).otherwise(""))
    paragraphs = F.filter(F.transform(F.split(raw, "\n\n"), strip), lambda x: x != "")
    thinks = raw.contains(THINKING[0]) | raw.contains(THINKING[1])
    plain = lambda rows: bound(joined(F.filter(rows, lambda x: ~x["mark"])), lambda x: F.when(x != "", x).otherwise(raw))
    last = lambda rows: F.when(thinks, bound(paragraphs, lambda x: F.when(F.size(x) > 1, F.element_at(x, -1)).otherwise(plain(rows)))).otherwise(plain(rows))
    return bound(lines, lambda rows: bound(after(rows), lambda x: F.when(x != "", x).otherwise(last(rows))))


def parse_string_list(raw: Column, most: int = 5) -> Column:
    """The first `most` non-blank strings of a JSON array, stripped; anything else gives an empty array."""
    parsed = F.from_json(strip_fences(parse_channel(raw)), "array<string>")
    return F.slice(F.filter(F.transform(F.coalesce(parsed, F.array().cast("array<string>")), strip), lambda x: x != ""), 1, most)


def list_items(raw: Column) -> Column:
    """Items of a list kept as text, nested lists flattened: quoted strings in order, or bare items where none is quoted.

    A string ends at the mark that opens it, so an apostrophe within double quotes is part of the item; a backslash keeps what follows."""
    text = strip(_full(raw))
    literal = r"""("[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+')"""
    bare_text = lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"(?s)\\(.)", "$1")
    quoted = F.transform(F.regexp_extract_all(text, F.lit(literal), F.lit(1)), bare_text)
    bare = F.filter(F.transform(F.split(F.regexp_replace(text, r"[\[\]]", ""), ","), strip), lambda x: x != "")
    return F.when(F.size(quoted) > 0, quoted).otherwise(bare)


def unique_ordered(items: Column) -> Column:
    """Distinct items in the order of their first places."""
    return F.array_distinct(items)


def truncate_any(code: Column) -> Column:
    return F.substring_index(code, ".", 1)


def parse_code_list(raw: Column) -> Column:
    return F.transform(list_items(raw), truncate_any)


def parse_ground_truth(raw: Column) -> Column:
    """The first item, left of its dot, in double quotes; null stays null."""
    first = F.coalesce(F.get(list_items(raw), F.lit(0)), F.lit(""))
    return F.when(raw.isNotNull(), F.concat(F.lit('"'), truncate_any(first), F.lit('"')))


def clean_chapters(raw: Column) -> Column:
    """Items but for `unknown` in any case; null stays null."""
    return F.when(raw.isNotNull(), F.filter(list_items(raw), lambda x: F.lower(strip(x)) != "unknown"))


def to_json_list(items: Column) -> Column:
    """`["A", "B"]`, with double quotes and backslashes escaped; empty: `[]`."""
    safe = F.transform(items, lambda x: F.regexp_replace(x, r'(["\\])', r"\\$1"))
    return F.when(F.size(items) > 0, F.concat(F.lit('["'), F.array_join(safe, '", "'), F.lit('"]'))).otherwise("[]")


def truncate_codes_in_json(raw: Column) -> Column:
    """The text with each code under icd_codes cut at its dot; where it is no JSON, digits after a dot in quoted words go.

    The other keys stay as they are written, since only the array's own text is replaced."""
    array = F.regexp_extract(raw, r'(?s)"icd_codes"\s*:\s*(\[[^\]]*\])', 1)
    codes = lambda text: bound(F.transform(F.from_json(text, "array<string>"), truncate_any), to_json_list)
    around = lambda text, at: F.concat(F.substring(raw, F.lit(1), at - 1), codes(text), F.substring(raw, at + F.length(text), F.length(raw)))
    swapped = bound(array, lambda text: F.when(text == "", raw).otherwise(bound(F.position(text, raw), lambda at: around(text, at))))
    code = lambda x: F.coalesce(x.rlike(r"^\w+\.\d+$"), F.lit(False))
    inner = lambda pieces, i: (i > 0) & (i < F.size(pieces) - 1)
    cut = lambda pieces: F.transform(pieces, lambda x, i: F.when(inner(pieces, i) & code(x) & ~code(F.get(pieces, i - 1)), truncate_any(x)).otherwise(x))
    other = F.array_join(bound(F.split(raw, '"'), cut), '"')  # pieces between quotation marks
    may_be = raw.rlike(r'^[\s\x{FEFF}]*[\[{"+.0-9tfnNI/-]')  # what begins otherwise is no JSON, and costs no exception
    return F.when(may_be & F.try_parse_json(raw).isNotNull(), swapped).otherwise(other)


def clip(raw: Column, most: int = 500) -> Column:
    return F.substring(raw, 1, most)


def name_differs(core: Column, phrase: Column) -> Column:
    return (strip(_full(core)) != "") & (normalize(core) != normalize(phrase))


def match_detail(phrase: Column, name: Column, kind: Column, score: Column, code: Column) -> Column:
    """`phrase → name [kind, score%] → code`; null score: 0."""
    return F.concat(_full(phrase), F.lit(" → "), F.coalesce(name, F.lit("None")), F.lit(" ["), _full(kind), F.lit(", "), F.coalesce(score.cast("string"), F.lit("0")), F.lit("%] → "), F.coalesce(code, F.lit("N/A")))


def parse_match_details(text: Column) -> Column:
    """Array of (phrase, name, kind, score, code) from details joined by ` ;; `."""
    pattern = r"(?s)^(.*?) → (.*) \[([a-z_]+), ([0-9.]+)%\] → (.*)$"
    part = lambda x, k: F.regexp_extract(x, pattern, k)
    return F.transform(
        F.filter(F.split(_full(text), " ;; "), lambda x: x != ""),
        lambda x: F.struct(part(x, 1).alias("phrase"), part(x, 2).alias("name"), part(x, 3).alias("kind"), part(x, 4).try_cast("double").alias("score"), part(x, 5).alias("code")),
    )
