"""Phrases against terms by similarity: best match, candidate pools, and the choice among an answer's candidates.

Distinct phrases meet the terms in blocks: both sides are dealt by hash into chunks of bounded size, and each pair of chunks is
one group. Exact bounds on length and letter counts leave few pairs to score; a group returns only its best rows a phrase.
Scores (0 to 100): `ratio` is 200 * LCS / (both lengths); `token_sort` is that of space-sorted words; `token_set` the best ratio
among the shared words, and these with each side's rest (100 if one word set holds the other); `partial` the best ratio of
the shorter text against windows as long in the longer one; `partial_token` 100 if a word is shared, else the best partial score of
sorted or distinct words; `mixed` the best of ratio and 0.95 * the token forms, or, where one text is 1.5 times as long or more, of
ratio, 0.9 * partial (0.6 beyond 8 times) and that weight * 0.95 * partial_token.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lcs, letters_at
from ..sources.scratch import kept
from . import grams

#: Distinct phrases and terms of a group; where terms are few, phrases of a group, and groups from which it may hold that many.
ASKED, KNOWN = 500, 4000
MANY, GROUPS = 20_000, 64
PAIRS = "phrase string, term string, pos long, scorer string, score double"


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    both = x & y
    if not x or not y:
        return 0.0
    if both and (both == x or both == y):
        return 100.0
    shared = " ".join(sorted(both))
    left, right = (" ".join([shared, *sorted(s - both)]).strip() for s in (x, y))
    return max(ratio(left, right), ratio(shared, left) if both else 0.0, ratio(shared, right) if both else 0.0)


def partial(a: str, b: str, least: float = 0.0) -> float:
    """Windows at the ends may be shorter than the shorter text. As a window slides, how many of its letters the shorter text can match
    is kept up to date; only windows whose bound is above the best score so far are compared. No window shares more than the whole
    texts do. What scores no more than `least` may be given as 0."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    where = letters_at(a)
    shared = lcs(a, b, where)
    if 200.0 * shared / (len(a) + shared) <= least:  # a window holds what it shares
        return 0.0
    spare, common, best = Counter(a), 0, least
    for end in range(1, len(b) + len(a)):
        if end <= len(b):
            spare[b[end - 1]] -= 1
            common += spare[b[end - 1]] >= 0
        if end > len(a):
            gone = b[end - 1 - len(a)]
            common -= spare[gone] >= 0
            spare[gone] += 1
        start, stop = max(end - len(a), 0), min(end, len(b))
        both = len(a) + stop - start
        if 200.0 * min(common, shared) / both > best + 1e-12:
            best = max(best, 200.0 * lcs(a, b[start:stop], where) / both)
    return best if best > least else 0.0


def partial_token(a: str, b: str, least: float = 0.0) -> float:
    """The best of the sorted words and, where no word is shared, of the distinct words; a shared word is a full match."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    if x & y:
        return 100.0
    whole, once = [[" ".join(sorted(w)) for w in both] for both in ((a.split(), b.split()), (x, y))]
    return max(partial(*pair, least) for pair in ((whole,) if whole == once else (whole, once)))


def mixed(a: str, b: str, least: float = 0.0) -> float:
    """The published weights: words count 0.95; parts 0.9, or 0.6 beyond 8 times the length. Exact above `least`, at most that otherwise."""
    short, long = sorted((len(a), len(b)))
    if not short:
        return 0.0
    if long / short < 1.5:
        return max(ratio(a, b), 0.95 * max(token_sort(a, b), token_set(a, b)))
    weight = 0.9 if long / short <= 8 else 0.6
    return max(ratio(a, b), weight * partial(a, b, least / weight), 0.95 * weight * partial_token(a, b, least / (0.95 * weight)))


SCORERS = {"token_sort": token_sort, "token_set": token_set, "mixed": mixed, "partial": partial}


def letter_counts(texts: list[str], size: int = 48) -> np.ndarray:
    """Counts of characters by bucket; two characters may share a bucket, which only loosens a bound."""
    out = np.zeros((len(texts), size), np.int16)
    for i, text in enumerate(texts):
        np.add.at(out[i], np.frombuffer(text.encode("utf-32-le"), np.uint32) % size, 1)
    return out


def bounds(scorer: str, common: np.ndarray, length: int, lengths: np.ndarray) -> np.ndarray:
    """No score exceeds this; common: how many characters the phrase and each term can share."""
    if scorer == "token_sort":
        return 200.0 * common / np.maximum(length + lengths, 1)
    if scorer == "partial":
        return 200.0 * common / np.maximum(np.minimum(length, lengths) + common, 1)  # a window at an end may be all common
    raise ValueError(scorer)


def sorted_length(text: str) -> int:
    """Length of the text's words with one space between: no more than its own."""
    words = text.split()
    return sum(map(len, words)) + max(len(words) - 1, 0)


def set_length(text: str) -> int:
    words = set(text.split())
    return sum(map(len, words)) + max(len(words) - 1, 0)


def score_block(phrases: list[str], terms: list[tuple[int, str]], scorers: list[str], threshold: float, k: int):
    """(phrase, term, pos, scorer, score): the k best of this block at `threshold` or more; ties by pos.

    Terms are taken by falling bound until the k-th best score is above what remains. Word sets without a shared word score as
    the ratio of their sorted words, so letters bound them too."""
    texts, pos = [x for _, x in terms], np.array([p for p, _ in terms])
    counts, lengths = letter_counts(texts), np.array([len(x) for x in texts])
    set_lengths, sorted_lengths = np.array([set_length(x) for x in texts]), np.array([sorted_length(x) for x in texts])
    words: dict[str, list[int]] = {}
    for i, text in enumerate(texts):
        for w in set(text.split()):
            words.setdefault(w, []).append(i)
    for phrase, own in zip(phrases, letter_counts(phrases)):
        common = np.minimum(counts, own).sum(axis=1)
        shares = np.zeros(len(texts), bool)
        for w in set(phrase.split()):
            shares[words.get(w, [])] = True
        for scorer in scorers:
            plain = bounds("token_sort", common, sorted_length(phrase), sorted_lengths)
            sets = np.where(shares, 100.0, np.minimum(100.0, bounds("token_sort", common, set_length(phrase), set_lengths)))
            if scorer == "mixed":
                wide = np.maximum(len(phrase), lengths) >= 1.5 * np.minimum(len(phrase), lengths)
                part = bounds("partial", common, len(phrase), lengths)
                words_part = np.where(shares, 100.0, np.minimum(100.0, bounds("partial", common, set_length(phrase), set_lengths)))
                most = np.maximum(np.maximum(plain, 0.95 * sets), np.where(wide, np.maximum(0.9 * part, 0.855 * words_part), 0.0))
            else:
                most = sets if scorer == "token_set" else plain if scorer == "token_sort" else bounds(scorer, common, len(phrase), lengths)
            order = np.lexsort((pos, -most))
            best: list[tuple[float, int, int]] = []
            for i in order[: np.searchsorted(-most[order], -threshold + 1e-9, side="right")]:
                if len(best) == k and most[i] < -best[-1][0] - 1e-9:
                    break
                value = SCORERS[scorer](phrase, texts[i], threshold - 1e-6) if scorer in ("mixed", "partial") else SCORERS[scorer](phrase, texts[i])
                if value >= threshold:
                    best = sorted([*best, (-value, int(pos[i]), int(i))])[:k]
            for value, at, i in best:
                yield phrase, texts[i], at, scorer, -value


def asked_groups(n_phrases: int, n_terms: int) -> int:
    """Into how many chunks phrases are dealt: of ASKED, or, beyond GROUPS of them, of as many as give no more pairs, up to MANY."""
    most = max(1, math.ceil(n_phrases / ASKED))
    return min(most, max(GROUPS, math.ceil(n_phrases * min(n_terms, KNOWN) / (ASKED * KNOWN)), math.ceil(n_phrases / MANY)))


def similar(phrases: DataFrame, terms: DataFrame, scorers: list[str], threshold: float, k: int, shortest: int = 0) -> DataFrame:
    """(phrase, term, pos, scorer, score, rank): for each distinct non-empty phrase and scorer the k best of terms (term, pos).

    Each side goes to every chunk of the other, so rows moved are rows times chunks; scores need no more than the two chunks of a
    group. Terms shorter than `shortest` stay out; of equal terms the first by pos counts."""
    asked = phrases.where("phrase <> ''").select("phrase").distinct()
    known = terms.where(F.length("term") >= max(shortest, 1)).groupBy("term").agg(F.min("pos").cast("long").alias("pos"))
    n_phrases, n_terms = asked.count(), known.count()
    n_known = max(1, math.ceil(n_terms / KNOWN))
    n_asked = asked_groups(n_phrases, n_terms)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("phrase", deal("phrase", n_asked).alias("a"), every(n_known).alias("b"))
    right = known.select("term", "pos", deal("term", n_known).alias("b"), every(n_asked).alias("a"))

    def score(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        block = sorted(zip(theirs["pos"], theirs["term"])) if len(theirs) else []
        rows = score_block(list(ours["phrase"]), block, scorers, threshold, k) if block else []
        return pd.DataFrame(list(rows), columns=["phrase", "term", "pos", "scorer", "score"])

    deal_to = lambda df: df.repartition(n_asked * n_known, "a", "b").groupBy("a", "b")  # small in bytes, so not to be merged into few tasks; noqa: E731
    found = deal_to(left).cogroup(deal_to(right)).applyInPandas(score, PAIRS)
    order = Window.partitionBy("phrase", "scorer").orderBy(F.desc("score"), "pos")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar_by_grams(phrases: DataFrame, terms: DataFrame, threshold: float) -> DataFrame:
    """(phrase, term, pos, score): all terms (term, pos) at the threshold or more by sorted words, of phrases that grams.indexable takes.

    Texts with the same sorted words are one form; forms meet by the index, and each pair that it gives is scored once."""
    form = lambda df, c: df.select(c, *(["pos"] if c == "term" else []), grams.sorted_words(F.col(c)).alias("form")).withColumn("n", F.length("form"))
    asked, known = form(phrases, "phrase"), form(terms, "term")

    @F.pandas_udf("double")
    def score(ours: pd.Series, theirs: pd.Series) -> pd.Series:
        return pd.Series([ratio(a, b) for a, b in zip(ours, theirs)], dtype=float)

    met = grams.candidates(*(x.select("form", "n").distinct() for x in (asked, known)), threshold)
    scored = met.withColumn("score", score("phrase_form", "term_form")).where(F.col("score") >= threshold)
    return asked.select("phrase", F.col("form").alias("phrase_form")).join(scored, "phrase_form").join(known.select("term", "pos", F.col("form").alias("term_form")), "term_form").select("phrase", "term", "pos", "score")


def closest(phrases: DataFrame, terms: DataFrame, threshold: float, k: int, index_from: float) -> DataFrame:
    """(phrase, term, pos, score, rank): the k most similar terms by sorted words, at the threshold or more; ties by pos.

    First by the index at `index_from`. Phrases for which that gives k terms have their best ones; the others, and those too short for the
    index, meet all terms that are not too long for them, if the threshold is lower or they are short."""
    asked = kept(phrases.where("phrase <> ''").select("phrase").distinct().withColumn("n", F.length(grams.sorted_words(F.col("phrase")))), "asked")
    known = kept(terms.where("term <> ''").groupBy("term").agg(F.min("pos").cast("long").alias("pos")), "known")
    order = Window.partitionBy("phrase").orderBy(F.desc("score"), "pos")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    long = grams.indexable(F.col("n"), index_from)
    found = kept(ranked(similar_by_grams(asked.where(long), known, index_from)), "closest")
    rest, within = asked.where(~long), known
    if threshold < index_from:
        full = found.groupBy("phrase").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= k)
        rest = asked.join(full, "phrase", "left_anti")
        found = found.join(full, "phrase", "left_semi")
    else:
        most = rest.agg(F.max("n").alias("n")).first()["n"]
        if most is None:
            return found
        share = threshold / 100
        within = known.withColumn("n", F.length(grams.sorted_words(F.col("term")))).where(F.col("n") <= F.ceil(F.lit(most) * (2 - share) / share)).drop("n")
    return found.unionByName(similar(rest.select("phrase"), within, ["token_sort"], threshold, k).select("phrase", "term", "pos", "score", "rank"))


def best_match(phrases: DataFrame, terms: DataFrame, threshold: float = 85.0) -> DataFrame:
    """(phrase, term, pos, score): the most similar term by sorted words, at the threshold or more."""
    return closest(phrases, terms, threshold, 1, threshold).select("phrase", "term", "pos", "score")


def candidate_names(phrases: DataFrame, terms: DataFrame, threshold: float = 60.0, k: int = 5, index_from: float = 85.0) -> DataFrame:
    """(phrase, name, rank): distinct names of the k best terms (term, pos, name), in order of their first rank."""
    hits = closest(phrases, terms, threshold, k, max(threshold, index_from)).join(terms.groupBy("term").agg(F.min_by("name", "pos").alias("name")), "term")
    first = hits.groupBy("phrase", "name").agg(F.min("rank").alias("at"))
    return first.select("phrase", "name", F.row_number().over(Window.partitionBy("phrase").orderBy("at")).alias("rank"))


def pool(phrases: DataFrame, terms: DataFrame, threshold: float = 60.0, per_scorer: int = 8, k: int = 10, shortest: int = 5, part: float = 0.6) -> DataFrame:
    """(phrase, code, score, rank): the k best codes of terms (term, code, pos), by the best of three scorers.

    Each scorer gives its `per_scorer` best terms; after that, those by `partial` that are shorter than `part` of the phrase go."""
    hits = similar(phrases, terms, ["token_set", "mixed", "partial"], threshold, per_scorer, shortest)
    hits = hits.where((F.col("scorer") != "partial") | (F.length("term") >= part * F.length("phrase")))
    coded = hits.join(terms.groupBy("term").agg(F.min_by("code", "pos").alias("code")), "term")
    best = coded.groupBy("phrase", "code").agg(F.max("score").alias("score"), F.min("pos").alias("pos"))
    order = Window.partitionBy("phrase").orderBy(F.desc("score"), "pos", "code")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("phrase", "code", F.round("score", 1).alias("score"), "rank")


def merge_pools(complete: DataFrame, core: DataFrame, titles: DataFrame) -> DataFrame:
    """(phrase_id, code, title, rank): the pools (phrase_id, code, rank) of the complete phrase and of its core; the complete one
    goes first. Of a code, and then of a title, the first counts. titles: (code, title), one row a code."""
    rows = complete.select("phrase_id", "code", F.lit(0).alias("side"), "rank").unionByName(core.select("phrase_id", "code", F.lit(1).alias("side"), "rank"))
    once = rows.groupBy("phrase_id", "code").agg(F.min(F.struct("side", "rank")).alias("at")).join(titles, "code", "left")
    named = once.groupBy("phrase_id", F.coalesce("title", F.concat(F.lit("\x00"), F.col("code"))).alias("key")).agg(F.min(F.struct("at", "code", "title")).alias("v"))
    return named.select("phrase_id", "v.code", "v.title", F.row_number().over(Window.partitionBy("phrase_id").orderBy("v.at", "v.code")).alias("rank"))


def decided(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """candidates (run_id, norm_key, step, candidate) that decisions (the same, and accept boolean) accept; what has none is refused."""
    keys = ["run_id", "norm_key", "step", "candidate"]
    return candidates.join(decisions.where("accept").select(*keys).distinct(), keys, "left_semi")


def choose_name(answers: DataFrame, threshold: float = 90.0) -> DataFrame:
    """answers (answer, candidates) with chosen: the candidate equal but for case, else the most similar at the threshold or more,
    else null. Few candidates a row, so they are scored in place."""
    same = lambda x: F.lower(F.trim(x)) == F.lower(F.trim(F.col("answer")))

    @F.pandas_udf("string")
    def closest(answer: pd.Series, candidates: pd.Series) -> pd.Series:
        def one(a, names):
            scored = [(ratio(a.lower(), n.lower()), -i) for i, n in enumerate(names) if n is not None] if a and names is not None else []
            score, at = max(scored, default=(0.0, 0))
            return names[-at] if scored and score >= threshold else None

        return pd.Series([one(a, c) for a, c in zip(answer, candidates)], dtype=object)

    return answers.withColumn("chosen", F.coalesce(F.get(F.filter("candidates", same), F.lit(0)), closest("answer", "candidates")))


def first_relations(candidates: Column) -> Column:
    """Of candidates (array of code, mapping_relation) the first of each non-blank code."""
    return F.filter(candidates, lambda x, i: (F.coalesce(x["code"], F.lit("")) != "") & (F.array_position(F.transform(candidates, lambda y: y["code"]), x["code"]) == i + 1))


def choose_code(candidates: Column, answer: Column) -> Column:
    """One of several codes (code, mapping_relation): the only one, the one that the answer names, or names but for white space
    and case, else the first with relation E, else the first; null where there is none."""
    once = first_relations(candidates)
    bare = lambda c: F.upper(F.regexp_replace(c, r"\s+", ""))
    first = lambda keep: F.get(F.filter(once, keep), F.lit(0))
    answer = F.coalesce(answer, F.lit(""))
    return F.coalesce(F.when(F.size(once) == 1, F.get(once, F.lit(0))), first(lambda x: x["code"] == answer), first(lambda x: bare(x["code"]) == bare(answer)), first(lambda x: x["mapping_relation"] == "E"), F.get(once, F.lit(0)))
