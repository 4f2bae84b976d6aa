"""Text functions as Column expressions: normalising names, codes and answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that are deleted, brackets and dashes that become a space.
QUOTES = "['`‘’´]"
BRACKETS = r"[\[\]()]"
DASHES = "[-–—]"


def collapse(text: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column) -> Column:
    """Lower case, without quotation marks, brackets and dashes as spaces; null is empty."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), QUOTES, "")
    return collapse(F.regexp_replace(F.regexp_replace(out, BRACKETS, " "), DASHES, " "))


def normalize_basic(text: Column) -> Column:
    """First-generation form: lower case, dashes as spaces, white space collapsed."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), DASHES, " "), r"(?U)\s+", " ")


def strip_dagger(code: Column) -> Column:
    return F.regexp_replace(F.trim(code), "[+*†]+$", "")


def is_nf(code: Column) -> Column:
    return F.coalesce(code.startswith("NF-"), F.lit(False))


def truncate_code(code: Column) -> Column:
    """Left of the first dot; not-found ids and blanks as they are."""
    return F.when(F.trim(code).startswith("NF-"), F.trim(code)).otherwise(F.substring_index(F.trim(code), ".", 1))


def bracket_terms(text: Column) -> Column:
    """What stands in square brackets, if it has three characters or more and four words or fewer."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]"), F.lit(1)), lambda x: F.trim(x))
    return F.filter(found, lambda x: (F.length(x) >= 3) & (F.size(F.split(x, r"\s+")) <= 4))


def strip_fences(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def parse_verdict(raw: Column) -> Column:
    """yes, no or blank, by how the letters of the answer begin."""
    letters = F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), "[^a-z]", "")
    return F.when(letters.startswith("yes"), "yes").when(letters.startswith("no"), "no").otherwise("")


def strip_highlight(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"</?em[^>]*>", ""))


def chapter_label(number: Column, title: Column) -> Column:
    return F.concat_ws(" - ", F.nullif(number, F.lit("")), F.nullif(title, F.lit("")))


def codes_to_categories(codes: Column) -> Column:
    """Sorted distinct parts left of the dot, of codes with a dot."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(codes, lambda c: c.contains(".")), lambda c: F.substring_index(c, ".", 1))))


def token_sorted(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(text, " ")), " ")


def letters_at(text: str) -> dict[str, int]:
    """Of each character the places as bits."""
    where: dict[str, int] = {}
    for i, ch in enumerate(text):
        where[ch] = where.get(ch, 0) | 1 << i
    return where


def lcs(a: str, b: str, where: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, a row of bits at a time; where: letters_at(a), if known."""
    where = letters_at(a) if where is None else where
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        if hit := row & where.get(ch, 0):
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: Column, b: Column) -> Column:
    """200 * longest common subsequence / (lengths of both); two empty texts: 100; null with null texts."""

    @F.pandas_udf("double")
    def score(ours: pd.Series, theirs: pd.Series) -> pd.Series:
        one = lambda x, y: None if x is None or y is None else 200.0 * lcs(x, y) / (len(x) + len(y)) if x or y else 100.0
        return pd.Series([one(x, y) for x, y in zip(ours, theirs)], dtype=float)

    return score(a, b)


#: Chapters with their first and last three-character code.
CHAPTERS = (
    ("I", "A00", "B99"), ("II", "C00", "D48"), ("III", "D50", "D89"), ("IV", "E00", "E90"), ("V", "F00", "F99"), ("VI", "G00", "G99"),
    ("VII", "H00", "H59"), ("VIII", "H60", "H95"), ("IX", "I00", "I99"), ("X", "J00", "J99"), ("XI", "K00", "K93"), ("XII", "L00", "L99"),
    ("XIII", "M00", "M99"), ("XIV", "N00", "N99"), ("XV", "O00", "O99"), ("XVI", "P00", "P96"), ("XVII", "Q00", "Q99"), ("XVIII", "R00", "R99"),
    ("XIX", "S00", "T98"), ("XX", "V01", "Y98"), ("XXI", "Z00", "Z99"), ("XXII", "U00", "U99"),
)

#: Words of a label and the prefix that each gives.
PREFIXES = (
    ("respiratorio", "RESP"), ("cardiovascular", "CARD"), ("infeccioso", "INFEC"), ("neurológico", "NEUR"), ("gastrointestinal", "GAST"), ("renal", "REN"),
    ("hematológico", "HEMAT"), ("endocrino", "ENDOC"), ("musculoesquelético", "MUSC"), ("dermatológico", "DERM"), ("oncológico", "ONCOL"), ("otro", "OTR"),
)


def chapter_roman(code: Column) -> Column:
    """The chapter's number by letter and two digits (00 where they are no digits); Unknown for what is in none."""
    code = F.coalesce(code, F.lit(""))
    digits = F.regexp_extract(code, r"^.([0-9]{2})", 1)
    key = F.concat(F.upper(F.substring(code, 1, 1)), F.when(digits == "", "00").otherwise(digits))
    out = F.when(~code.rlike("^[A-Za-z]"), "Unknown")
    for name, first, last in CHAPTERS:
        out = out.when(key.between(first, last), name)
    return out.otherwise("Unknown")


def category_prefix(label: Column) -> Column:
    """Prefix of the first listed word that the label contains, in lower case; OTR if none."""
    label = F.lower(F.coalesce(label, F.lit("")))
    out = F.when(F.lit(False), "")
    for word, prefix in PREFIXES:
        out = out.when(label.contains(word), prefix)
    return out.otherwise("OTR")


def codes_to_chapters(codes: Column) -> Column:
    """Sorted distinct chapters of the codes."""
    return F.array_sort(F.array_distinct(F.transform(codes, chapter_roman)))
