"""Which terms can be as similar to a phrase as a threshold asks: an inverted index on pairs of neighbouring characters.

Similarity is 200 * LCS / (both lengths) of the texts with their words sorted. If it is `threshold` or more, then (with S both
lengths together and D = S - 2 * LCS) at most (1 - threshold / 100) * S characters lack a partner, and each parts at most
two pairs in its own text and one in the other. So at least c = S / 2 - 1.5 * D - 1 pairs of neighbours stay together in both,
and no further apart than D allows. A text's pairs are sorted by how rare they are among the terms, then by place; of two texts
that are similar enough the first m pairs that stay together are among the first (pairs - c + m) of each, for m up to c. Only these
are joined, by the pair: within the lengths that the threshold allows (length filter), at places near enough (position filter), and
only texts that meet m times go on (count filter). What comes out holds every two texts at the threshold, and is scored exactly.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs whose numbers are known to every task; all others are rarer than these.
COMMON = 20_000
#: How often two texts must meet, where c allows it.
MEET = 3
SLACK = 1e-9


def sorted_words(text: Column) -> Column:
    """The words of a text, sorted, with one space between."""

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return pd.Series([" ".join(sorted(x.split())) for x in texts], dtype=object)

    return form(text)


def slope(threshold: float) -> float:
    """c is at least slope * S - 1."""
    return 0.5 - 1.5 * (1 - threshold / 100)


def shortest(n: Column, threshold: float) -> Column:
    """The least length of a text that can be similar enough to one of length n: 2 * LCS / S is at most 2 * shorter / S."""
    share = threshold / 100
    return F.ceil(n * share / (2 - share) - SLACK)


def together(n: Column, threshold: float) -> Column:
    """How many pairs of neighbours of a text of length n stay together at least, whatever it is compared with."""
    return F.ceil((n + shortest(n, threshold)) * slope(threshold) - 1 - SLACK)


def indexable(n: Column, threshold: float) -> Column:
    return together(n, threshold) >= 1 if slope(threshold) > 0 else F.lit(False)


def pairs_of(texts: DataFrame) -> DataFrame:
    """(form, n, gram, at) of texts (form, n)."""
    places = F.sequence(F.lit(1), F.col("n") - 1)
    return texts.where("n >= 2").select("form", "n", F.explode(places).alias("at")).select("form", "n", "at", F.substring("form", F.col("at"), F.lit(2)).alias("gram"))


def first_pairs(texts: DataFrame, common: DataFrame, threshold: float) -> DataFrame:
    """The rows of pairs_of that may be among the first MEET to stay together: (form, n, gram, at)."""
    known = pairs_of(texts).join(F.broadcast(common), "gram", "left")  # COMMON rows at most
    ordered = known.groupBy("form", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("terms", F.lit(0)).alias("terms"), "gram", "at"))).alias("grams"))  # a text's own
    prefix = F.slice("grams", F.lit(1), (F.col("n") - 1 - F.greatest(together(F.col("n"), threshold), F.lit(1)) + MEET).cast("int"))
    return ordered.select("form", "n", F.explode(prefix).alias("g")).select("form", "n", "g.gram", "g.at")


def candidates(phrases: DataFrame, terms: DataFrame, threshold: float) -> DataFrame:
    """(phrase_form, term_form): distinct pairs of forms (form, n) that may reach the threshold. None that does is missing, but for phrases
    that are not `indexable`; a term may be too short for the index by itself, but not beside an indexable phrase."""
    common = pairs_of(terms).groupBy("gram").agg(F.count(F.lit(1)).alias("terms")).orderBy(F.desc("terms"), "gram").limit(COMMON)
    asked, known = first_pairs(phrases.where(indexable(F.col("n"), threshold)), common, threshold), first_pairs(terms, common, threshold)
    asked = asked.select(F.col("form").alias("phrase_form"), F.col("n").alias("a"), "gram", F.col("at").alias("i"))
    known = known.select(F.col("form").alias("term_form"), F.col("n").alias("b"), "gram", F.col("at").alias("j"))
    both = F.col("a") + F.col("b")
    free = F.floor(both * (1 - threshold / 100) + SLACK)
    near = (2 * (F.col("i") - F.col("j")) <= free + F.col("a") - F.col("b")) & (2 * (F.col("j") - F.col("i")) <= free - F.col("a") + F.col("b"))
    fits = (F.col("b") >= shortest(F.col("a"), threshold)) & (F.col("a") >= shortest(F.col("b"), threshold))
    met = asked.join(known, "gram").where(fits & near).groupBy("phrase_form", "term_form").agg(F.count(F.lit(1)).alias("times"))
    return met.where(F.col("times") >= F.least(F.lit(MEET), together(F.length("phrase_form"), threshold))).select("phrase_form", "term_form")
