"""Texts and transcripts: overlapping chunks, cited sources, list linking, detail statistics."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import match_detail, parse_match_details, parse_string_list
from ..functions.text import normalize

#: Where a text may be cut, best first: paragraph, line, space, anywhere.
SEPARATORS = ("\n\n", "\n", " ", "")


def cut(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """The text in pieces of at most `size` characters, each at the best separator that makes it short enough; the pieces joined
    give the text."""
    if len(text) <= size:
        return [text]
    mark, rest = separators[0], separators[1:]
    if not mark:
        return [text[i : i + size] for i in range(0, len(text), size)]
    out: list[str] = []
    for piece in re.split(f"(?<={re.escape(mark)})", text):
        out.extend(cut(piece, size, rest) if len(piece) > size else [piece])
    return out


def chunks_of(text: str, size: int, overlap: int) -> list[str]:
    """Pieces gathered to chunks of at most `size` characters; the next one starts with pieces of the last of at most `overlap`."""
    out: list[str] = []
    held: list[str] = []
    length = 0
    for piece in cut(text, size - overlap if overlap else size):
        if held and length + len(piece) > size:
            out.append("".join(held).strip())
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    out.append("".join(held).strip())
    return [x for x in out if x]


def chunk(docs: DataFrame, size: int = 768, overlap: int = 77) -> DataFrame:
    """(doc_id, source, at, chunk): docs (doc_id, source, text) in overlapping chunks; null and blank texts give none."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([chunks_of(x, size, overlap) for x in texts])

    return docs.where("text is not null").select("doc_id", "source", F.posexplode(split("text")).alias("at", "chunk"))


def cited_sources(hits: DataFrame) -> DataFrame:
    """(query_id, sources): distinct names of the hits' sources without folder and ending, sorted, joined by `, `."""
    name = F.regexp_replace(F.regexp_replace("source", r"^.*/", ""), r"\.[A-Za-z0-9]+$", "")
    return hits.where("source is not null").groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set(name)), ", ").alias("sources"))


def link_lists(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(row_id, codes, match_details): lists of names (row_id, raw: JSON array text, five at most) linked by exact terms (term, code,
    name); one without a term, or whose term has no code, is `nr`. Order within a row is kept."""
    items = rows.select("row_id", F.posexplode(parse_string_list(F.col("raw"))).alias("at", "phrase")).withColumn("term", normalize(F.col("phrase")))
    coded = F.nullif("code", F.lit(""))
    out = items.join(terms.select("term", "code", "name"), "term", "left")
    text = match_detail(F.col("phrase"), F.when(coded.isNotNull(), F.col("name")), F.when(coded.isNotNull(), "exact").otherwise("nr"), F.when(coded.isNotNull(), 100).otherwise(0), coded)
    ordered = out.select("row_id", F.struct("at", coded.alias("code"), text.alias("text")).alias("v")).groupBy("row_id").agg(F.array_sort(F.collect_list("v")).alias("v"))  # five a row
    linked = ordered.select("row_id", F.transform("v", lambda x: F.coalesce(x["code"], F.lit("N/A"))).alias("codes"), F.array_join(F.transform("v", lambda x: x["text"]), " ;; ").alias("match_details"))
    return rows.select("row_id").join(linked, "row_id", "left").withColumns({"codes": F.coalesce("codes", F.array().cast("array<string>")), "match_details": F.coalesce("match_details", F.lit(""))})


def detail_types(rows: DataFrame) -> DataFrame:
    """(kind, n, pct) of the details in match_details."""
    kinds = rows.select(F.explode(parse_match_details(F.col("match_details"))).alias("d")).groupBy(F.col("d.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row a kind
