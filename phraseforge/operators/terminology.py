"""Terminologies as tables: paths, modifier expansion, name dictionaries, statistics, and hierarchy columns of linked rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CHAPTERS, bracket_terms, is_nf, normalize, strip_dagger, truncate_code
from .linking import walk_up


def hierarchy_paths(entities: DataFrame) -> DataFrame:
    """(code, distance, chapter, path): `II[chapter] > C22[category]` from entities (code, parent, kind), root first."""
    tagged = entities.select("code", F.concat("code", F.lit("["), F.coalesce("kind", F.lit("?")), F.lit("]")).alias("tag"))
    up = walk_up(entities.select(F.col("code").alias("node"), "parent"))
    steps = up.select(F.col("node").alias("leaf"), "depth", "top", F.posexplode(F.split("path", " > ")).alias("at", "code"))
    named = steps.join(tagged, "code").groupBy("leaf", "depth", "top").agg(F.array_sort(F.collect_list(F.struct("at", "tag"))).alias("tags"))  # at most 11 a leaf
    return named.select(F.col("leaf").alias("code"), F.col("depth").alias("distance"), F.col("top").alias("chapter"), F.array_join(F.transform("tags", lambda x: x["tag"]), " > ").alias("path"))


def enrich(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """rows (code_complete, ...) with category, chapter, distance and path. Not-found ids: chapter NF, distance 0, no path. What the
    terminology lacks gets its chapter by letter and digits, distance 2 and no path; what is in no chapter gets blank and null."""
    coded = rows.drop("category", "chapter", "distance", "path").withColumn("category", strip_dagger(truncate_code(F.col("code_complete"))))
    out = coded.join(paths.select(F.col("code").alias("category"), F.col("chapter").alias("own_chapter"), F.col("distance").alias("own_distance"), "path"), "category", "left")
    key = F.when(F.col("category").rlike("^[A-Z][0-9]{2}"), F.substring("category", 1, 3))
    by_range = F.when(F.lit(False), "")
    for name, first, last in CHAPTERS:
        by_range = by_range.when(key.between(first, last), name)
    nf = is_nf(F.col("category"))
    chapter = F.when(nf, "NF").otherwise(F.coalesce("own_chapter", by_range, F.lit("")))
    distance = F.when(nf, 0).otherwise(F.coalesce("own_distance", F.when(by_range.isNotNull(), 2)))
    return out.withColumns({"chapter": chapter, "distance": distance, "path": F.when(nf, "").otherwise(F.coalesce("path", F.lit("")))}).drop("own_chapter", "own_distance")


def expand_modifiers(classes: DataFrame, modified: DataFrame, excluded: DataFrame, subclasses: DataFrame) -> DataFrame:
    """(code, title, parent): a category of classes (code, kind) by each of its modifiers (code, modifier) by subclass (modifier,
    sub, title), without those that excluded (code, modifier) names and codes that exist. `.5` goes behind a code without a dot, `5`
    behind one with a dot. Of equal new codes the first by parent, modifier, subclass counts."""
    own = classes.where("kind = 'category'").join(modified, "code").join(excluded, ["code", "modifier"], "left_anti").join(subclasses, "modifier")
    digits = F.regexp_replace("sub", r"^\.+", "")
    new = F.when(F.col("code").contains("."), F.concat("code", digits)).otherwise(F.concat("code", F.when(F.col("sub").startswith("."), F.col("sub")).otherwise(F.concat(F.lit("."), F.col("sub")))))
    made = own.select(new.alias("new"), "title", F.col("code").alias("parent"), "modifier", "sub")
    once = made.groupBy("new").agg(F.min_by(F.struct("title", "parent"), F.struct("parent", "modifier", "sub")).alias("v"))
    return once.select(F.col("new").alias("code"), "v.title", "v.parent").join(classes.select("code").distinct(), "code", "left_anti")


def term_table(entities: DataFrame) -> DataFrame:
    """(term, code, pos): each entity (code, title, synonyms, pos) claims its title, the title's bracket terms, then its synonyms and
    theirs; the first claim on a term stays, so an earlier entity's synonym goes before a later title."""
    texts = F.concat(F.array("title"), F.coalesce("synonyms", F.array().cast("array<string>")))
    named = entities.select("code", "pos", F.posexplode(texts).alias("text_at", "text"))
    claims = named.select("code", "pos", "text_at", F.posexplode(F.concat(F.array("text"), bracket_terms(F.coalesce("text", F.lit(""))))).alias("alt_at", "raw")).withColumn("term", normalize(F.col("raw"))).where("term <> ''")
    return claims.groupBy("term").agg(F.min_by(F.struct("code", "pos"), F.struct("pos", "text_at", "alt_at", "code")).alias("v")).select("term", "v.code", "v.pos")


def lexical_table(names: DataFrame) -> DataFrame:
    """(term, code, canonical): of names (term, code, canonical boolean, pos) the last canonical one, else the first synonym."""
    order = F.struct((~F.col("canonical")).alias("late"), F.when(F.col("canonical"), -F.col("pos")).otherwise(F.col("pos")).alias("at"), "code")
    return names.where("term <> ''").groupBy("term").agg(F.min_by(F.struct("code", "canonical"), order).alias("v")).select("term", "v.code", "v.canonical")


def index_statistics(entities: DataFrame) -> DataFrame:
    """Per kind: entities and those with a title; null kinds count as `?`."""
    return entities.groupBy(F.coalesce("kind", F.lit("?")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("title", F.lit("")) != "").alias("n_titled"))


def distinct_phrases(rows: DataFrame) -> DataFrame:
    """(run_id, norm_key, n): what a run needs to link once. Runs stay apart, as decisions are made a run."""
    return rows.groupBy("run_id", normalize(F.col("phrase")).alias("norm_key")).agg(F.count(F.lit(1)).alias("n"))


def unresolved(rows: DataFrame, found: str, overwrite: bool = False) -> DataFrame:
    """Rows with a code whose `found` column is blank, or all with a code on overwrite."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return rows.where(~blank(F.col("category")) & (blank(F.col(found)) | F.lit(overwrite)))


def first_of_each(rows: DataFrame, keys: list[str], n: int, order: list[str]) -> DataFrame:
    """The first n rows of each group; report lists."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)
