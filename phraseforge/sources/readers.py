"""Reading run files, terminologies, id dictionaries, case files and corpora into tables, by Spark's readers alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.answers import strip
from ..functions.text import strip_dagger
from .scratch import kept

#: The cp1252 characters of bytes 0x80 to 0x9F; the five undefined ones are U+FFFD.
CP1252 = "€�‚ƒ„…†‡ˆ‰Š‹Œ�Ž��‘’“”•–—˜™š›œ�žŸ"
LATIN_1 = "".join(map(chr, range(0x80, 0xA0)))

#: The layout of a nested terminology with names, synonyms and coded references.
DISORDERS = """JDBOR array<struct<DisorderList: array<struct<Disorder: array<struct<
  OrphaCode: string, Name: array<struct<lang: string, label: string>>,
  SynonymList: array<struct<Synonym: array<struct<lang: string, label: string>>>>,
  ExternalReferenceList: array<struct<ExternalReference: array<struct<Source: string, Reference: string,
    DisorderMappingRelation: array<struct<Name: array<struct<lang: string, label: string>>>>>>>>
>>>>>>"""


def load_runs(spark: SparkSession, path: str, n_runs: int | None = None) -> DataFrame:
    """CSV files of runs as one table with run_id, by the number after `run` in each file's name, or in its folder's (`run_id=3`). A
    missing run is an error."""
    number = lambda text: F.regexp_extract(text, r"run(?:_id=|-)?(\d+)", 1).try_cast("int")
    folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
    rows = spark.read.csv(path, header=True, escape='"', multiLine=True).withColumn("run_id", F.coalesce(number(F.col("_metadata.file_name")), number(folder)))
    if n_runs is not None:
        missing = [r["id"] for r in spark.range(1, n_runs + 1).join(rows.select(F.col("run_id").cast("long").alias("id")).distinct(), "id", "left_anti").collect()]  # run numbers
        if missing:
            raise FileNotFoundError(f"no file for runs {sorted(missing)} in {path}")
    return rows


def decode(line: Column) -> Column:
    """A line's bytes as UTF-8 if they are, else as cp1252; a byte order mark at the start goes."""
    data = line.cast("binary")
    other = F.translate(F.decode(data, "ISO-8859-1"), LATIN_1, CP1252)
    return F.regexp_replace(F.when(F.is_valid_utf8(line), line).otherwise(other), "^﻿", "")


def read_mixed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, fell_back): text files line by line, each in the encoding that fits."""
    raw = spark.read.text(path)
    return raw.select(F.col("_metadata.file_name").alias("file"), decode(F.col("value")).alias("line"), (~F.is_valid_utf8("value")).alias("fell_back"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text, fell_back): CSV records, numbered from 1 in each file; a record goes over as many lines as its quotes are open.

    Files are read by byte ranges. Whether a line begins a record hangs on the parity of all quotation marks before it: each range counts
    its own and how many records would begin in it either way, ranges (a row each) add up, and lines learn their range's beginning. Only
    lines of records with line breaks are gathered. Lines are decoded one by one; blank lines between records don't count. An unclosed
    quotation mark makes one record of all that follows in its file."""
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), decode(F.col("value")).alias("line"), (~F.is_valid_utf8("value")).alias("fell_back"))
    place = ["path", "block"]
    before = Window.partitionBy(*place).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # within a range of bounded bytes
    marks = F.length("line") - F.length(F.regexp_replace("line", '"', ""))
    solid = F.regexp_replace("line", r"\r$", "") != ""
    lines = kept(lines.withColumns({"odd": marks % 2, "solid": solid}).withColumn("open", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2), "lines")
    begins = lambda first: F.col("solid") & ((F.col("open") + first) % 2 == 0)
    ranges = lines.groupBy(*place).agg((F.sum("odd") % 2).alias("odd"), F.count_if(begins(0)).alias("even_starts"), F.count_if(begins(1)).alias("odd_starts"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ranges = ranges.withColumn("first", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    ranges = ranges.withColumn("starts", F.when(F.col("first") == 0, F.col("even_starts")).otherwise(F.col("odd_starts"))).withColumn("sofar", F.coalesce(F.sum("starts").over(earlier), F.lit(0)))
    known = lines.join(ranges.select(*place, "first", "sofar"), place).withColumn("start", begins(F.col("first")))
    upto = Window.partitionBy(*place).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = known.withColumn("record", F.col("sofar") + F.count_if("start").over(upto))
    inside = (F.col("open") + F.col("first")) % 2 == 1
    one = known.where(F.col("start") & (F.col("odd") == 0)).select("file", "path", "record", F.col("line").alias("text"), "fell_back")
    parts = known.where(inside | (F.col("start") & (F.col("odd") == 1)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "line"))), lambda x: x["line"]), "\n")
    many = parts.groupBy("file", "path", "record").agg(text.alias("text"), F.bool_or("fell_back").alias("fell_back"))  # the lines of one record
    return one.unionByName(many.select(*one.columns)).withColumn("text", F.regexp_replace("text", r"\r$", "")).drop("path")


def read_mixed_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV of known columns in mixed encodings, with line breaks in quoted fields. A file's first record is its header if it holds just the names
    of the columns; no other record is."""
    fields = F.from_csv("text", F.lit(", ".join(f"`{c}` string" for c in columns)), {"escape": '"', "multiLine": "true"})
    parsed = csv_records(spark, path).select("file", "record", fields.alias("v"), "fell_back")
    header = (F.col("record") == 1) & F.array(*(F.coalesce(F.trim(f"v.`{c}`"), F.lit("")) for c in columns)).eqNullSafe(F.array(*map(F.lit, columns)))
    return parsed.where(~header).select("file", "v.*", "fell_back")


def read_files_as_encoded(spark: SparkSession, path: str) -> DataFrame:
    """(file, encoding, text): whole files in the first encoding that decodes: utf-8, cp1252, latin-1."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    undefined = latin.rlike("[\x81\x8d\x8f\x90\x9d]")
    encoding = F.when(F.is_valid_utf8("value"), "utf-8").when(~undefined, "cp1252").otherwise("latin-1")
    text = F.when(F.is_valid_utf8("value"), F.col("value")).when(~undefined, F.translate(latin, LATIN_1, CP1252)).otherwise(latin)
    return raw.select("file", encoding.alias("encoding"), text.alias("text"))


def _label(names: Column, lang: str) -> Column:
    return F.coalesce(F.get(F.filter(names, lambda x: x["lang"] == lang), F.lit(0))["label"], F.get(names, F.lit(0))["label"])


def read_disorders(spark: SparkSession, path: str, source: str, lang: str = "en", lines: bool = False) -> DataFrame:
    """lines: each line of the files is a terminology of its own. (orpha_code, name, synonyms, icd_codes, pos) of a nested terminology; codes of one source system, each with its relation's
    first word (ND if it has none), blank codes dropped."""
    top = spark.read.schema(DISORDERS).json(path, multiLine=not lines)
    rows = top.select(F.posexplode(F.flatten(F.flatten(F.transform("JDBOR", lambda j: F.transform(j["DisorderList"], lambda d: d["Disorder"]))))).alias("pos", "d"))
    empty = F.array().cast("array<string>")
    synonyms = F.coalesce(F.transform(F.flatten(F.transform("d.SynonymList", lambda s: s["Synonym"])), lambda s: s["label"]), empty)
    refs = F.filter(F.flatten(F.transform("d.ExternalReferenceList", lambda e: e["ExternalReference"])), lambda r: r["Source"] == source)
    relation = lambda r: F.coalesce(F.nullif(F.regexp_extract(_label(F.get(r["DisorderMappingRelation"], F.lit(0))["Name"], lang), r"^\s*(\w+)", 1), F.lit("")), F.lit("ND"))
    codes = F.filter(F.transform(refs, lambda r: F.struct(strip_dagger(r["Reference"]).alias("code"), relation(r).alias("mapping_relation"))), lambda c: F.coalesce(c["code"], F.lit("")) != "")
    return rows.select(F.col("d.OrphaCode").alias("orpha_code"), _label(F.col("d.Name"), lang).alias("name"), synonyms.alias("synonyms"), codes.alias("icd_codes"), "pos")


#: The elements that may stand in a label.
LABEL_PARTS = "Caption|Cell|Fragment|Include|IncludeDescendants|List|ListItem|Para|Row|TBody|TFoot|THead|Table|Term"
ATTRIBUTES = r"""(?:\s(?:[^>"']|"[^"]*"|'[^']*')*)?"""


def xml_label(inner: Column) -> Column:
    """Text of a label, given what stands in it, without what its <Reference> elements hold, white space collapsed."""
    plain = F.regexp_replace(inner, rf"(?s)<Reference{ATTRIBUTES}/>|<Reference{ATTRIBUTES}>.*?</Reference\s*>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, rf"</?(?:{LABEL_PARTS}){ATTRIBUTES}/?>", ""), r"(?U)\s+", " "))


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """(code, kind, parent, usage, title, title_long, synonyms, pos) of well-formed classifications in XML, a row a <Class> element with a code.

    Spark's XML source streams the elements of a file, one by one, so that comments, character data, entities, self-closed elements and
    any order of attributes are read as XML has them; a label comes as the text between its tags. The first label of a rubric counts
    if it isn't blank, the last such preferred one is the title, and inclusions are synonyms of categories only. pos ascends within a file.
    Character data that looks like an element of a label is taken for one."""
    schema = "_code string, _kind string, _usage string, SuperClass array<struct<_code: string>>, Rubric array<struct<_kind: string, Label: array<string>>>"
    found = spark.read.format("xml").option("rowTag", "Class").option("ignoreSurroundingSpaces", "false").schema(schema).load(path).withColumn("pos", F.monotonically_increasing_id())
    labels = lambda kind: F.filter(F.transform(F.filter(F.coalesce("Rubric", F.array().cast("array<struct<_kind:string,Label:array<string>>>")), lambda r: r["_kind"] == kind), lambda r: xml_label(F.coalesce(F.get(r["Label"], F.lit(0)), F.lit("")))), lambda x: x != "")
    last = lambda a: F.try_element_at(a, F.lit(-1))
    return found.where("_code <> ''").select(
        F.col("_code").alias("code"), F.col("_kind").alias("kind"), F.get("SuperClass", F.lit(0))["_code"].alias("parent"), F.col("_usage").alias("usage"),
        last(labels("preferred")).alias("title"), last(labels("preferredLong")).alias("title_long"),
        F.when(F.col("_kind") == "category", labels("inclusion")).otherwise(F.array().cast("array<string>")).alias("synonyms"), "pos",
    )


def read_id_dictionary(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(key, code, label, category, first_seen) of a JSON map of ids; lines: of one map a line."""
    whole = spark.read.text(path, wholetext=not lines)
    parsed = F.from_json("value", "map<string, struct<code: string, label: string, category: string, first_seen: string>>")
    return whole.select(F.explode(parsed).alias("key", "v")).select("key", "v.code", "v.label", "v.category", F.col("v.first_seen").try_cast("date").alias("first_seen"))


def read_id_texts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(id, text) of a JSON map of texts by number; lines: of one map a line."""
    return spark.read.text(path, wholetext=not lines).select(F.explode(F.from_json("value", "map<string, string>")).alias("id", "text")).withColumn("id", F.col("id").try_cast("int"))


def read_cases(spark: SparkSession, path: str, marker: str = "GROUND_TRUTH:", by_folder: bool = False) -> DataFrame:
    """(idx, filename, case_text, codes): whole files, cut at the marker; idx is the file's place by name, from 1. by_folder: a file goes
    by the name of its folder.

    Names are sorted into ranges, which are written; a range adds the count of those before it. So no task holds all names."""
    name = F.element_at(F.split("_metadata.file_path", "/"), -2) if by_folder else F.col("_metadata.file_name")
    rows = spark.read.text(path, wholetext=True).select(name.alias("filename"), "value")
    parts = F.split("value", marker, 2)
    codes = F.filter(F.transform(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ","), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    named = rows.select("filename", strip(F.get(parts, F.lit(0))).alias("case_text"), codes.alias("codes"))
    ranged = kept(named.repartitionByRange("filename").withColumn("part", F.spark_partition_id()), "cases")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a partition
    return ranged.join(before, "part").select((F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("filename"))).alias("idx"), "filename", "case_text", "codes")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(source, text): a folder of whole documents."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def rename_columns(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Old names to new ones; where both exist the one that stands first in the table stays."""
    taken: set[str] = set()
    keep = []
    for c in rows.columns:
        new = names.get(c, c)
        if new not in taken:
            taken.add(new)
            keep.append(F.col(f"`{c}`").alias(new))
    return rows.select(*keep)


def with_columns(rows: DataFrame, required: list[str]) -> DataFrame:
    """rows with any missing required column, empty."""
    return rows.withColumns({c: F.lit("") for c in required if c not in rows.columns})


def code_column(rows: DataFrame, candidates: tuple[str, str]) -> str:
    """Which of two columns holds the codes: the only one, or the one with more values; ties go to the first."""
    there = [c for c in candidates if c in rows.columns]
    if len(there) < 2:
        if not there:
            raise ValueError(f"none of {candidates} is a column")
        return there[0]
    n = rows.agg(F.count(there[0]).alias("a"), F.count(there[1]).alias("b")).first()
    return there[1] if n["b"] > n["a"] else there[0]
