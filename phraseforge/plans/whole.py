"""The whole cascade, files written and read back, streams, text and answer functions, and detail tables, over the reference tables."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as an
from ..functions import text as t
from ..operators import cascade, linking, lookup, stability, terminology
from ..sources import readers, writers
from ..sources.scratch import kept, new_path
from ..streaming import incremental
from .catalogue import CELLS, STABLE, _cells, _gated, _stable, table
from .ledger import LEDGER_SQL, ledger
from .more import _entities


def _text(value: str):
    return F.lit(value)


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_brand", (F.col("p_partkey") % 8).alias("g"), F.col("p_partkey").cast("string").alias("n"))


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _part(spark, sf_dir)
    g, kind, typo = F.col("g"), F.concat(F.lower("p_brand"), _text(" kind")), F.concat("p_name", _text("x"))
    phrase = F.when(F.col("k") % 97 == 0, " ").when(g == 0, F.upper("p_name")).when(g == 2, typo).when(g == 4, kind).when(g == 6, F.concat(kind, _text("s"))).when(g == 7, F.concat(_text("nothing "), "n")).otherwise(F.concat(_text("qqq "), "n"))
    core = F.when(g == 1, F.col("p_name")).when(g == 3, typo).when(g == 5, kind).otherwise("")
    rows = part.select((F.floor(F.col("k") / 8) % 2 + 1).cast("long").alias("run_id"), F.col("k").alias("case_id"), phrase.alias("phrase"), core.alias("core"), F.col("k").alias("pos"), "p_name", "p_brand", "g", "k", "n")
    code = lambda letter, relation: F.struct(F.concat(_text(letter), F.col("pos").cast("string")).alias("code"), _text(relation).alias("mapping_relation"))
    none = F.expr("cast(array() as array<struct<code: string, mapping_relation: string>>)")
    lexicon = part.groupBy(F.col("p_name").alias("term")).agg(F.min("k").alias("pos")).withColumns({"name": F.upper("term"), "codes": F.when(F.col("term").startswith("red "), none).when(F.col("pos") % 2 == 0, F.array(code("A", "NTBT"))).otherwise(F.array(code("A", "NTBT"), code("B", "E")))})
    catalogue = part.groupBy("p_brand").agg(F.min("k").alias("pos")).select(kind.alias("term"), F.concat(_text("K"), F.col("pos").cast("string")).alias("code"), F.when(F.col("pos") % 5 == 0, "block").otherwise("category").alias("kind"), F.upper("p_brand").alias("title"), "pos")
    name, lexical = F.upper("p_name"), (F.length("p_name") % 3 != 0)
    key = t.normalize(F.col("phrase"))
    decision = lambda df, step, candidate, accept: df.select("run_id", key.alias("norm_key"), _text(step).alias("step"), candidate.alias("candidate"), accept.alias("accept"))
    decisions = decision(rows.where("g = 2"), "fuzzy_complete", name, lexical).unionByName(decision(rows.where("g = 3"), "fuzzy_core", name, lexical)).unionByName(decision(rows.where("g = 6"), "pool", F.upper("p_brand"), F.lit(True)))
    named = rows.where("g = 0").join(lexicon.select(F.col("term").alias("p_name"), F.col("pos").alias("first_pos")), "p_name").where("first_pos % 4 = 1")
    decisions = decisions.unionByName(decision(named, "code", F.concat(_text("A"), F.col("first_pos").cast("string")), F.lit(True)))
    known = rows.where("k % 40 = 7").select(F.concat(_text("nothing "), "n").alias("key"), F.col("k").alias("number"))
    return cascade.cascade(rows, lexicon, catalogue, decisions, known).withColumn("score", F.round("score", 6))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _part(spark, sf_dir)
    raw = F.concat(_text('["'), F.upper("p_name"), _text('", "'), "p_name", _text('x", " ", "nothing '), "n", _text('"]'))
    lexicon = part.groupBy(F.col("p_name").alias("term")).agg(F.min("k").alias("pos")).withColumns({"name": F.upper("term"), "code": F.when(F.col("term").startswith("red "), "").otherwise(F.concat(_text("C"), F.col("pos").cast("string")))})
    typo, length = F.concat("p_name", _text("x")), F.length("p_name")
    said = lambda step, rule: part.where(rule).select(typo.alias("norm_key"), _text(step).alias("step"), F.upper("p_name").alias("candidate"), F.lit(True).alias("accept")).distinct()
    decisions = said("fuzzy", length % 3 != 0).unionByName(said("semantic", (length % 3 == 0) & (length % 2 == 0)))
    odd = F.concat(_text("nothing "), "n")
    labels = part.where("k % 2 = 0").select(odd.alias("norm_key"), t.category_prefix(_text("Trastorno Renal")).alias("prefix"))
    known = part.where("k % 50 = 0").select(odd.alias("key"), _text("REN").alias("prefix"), F.concat(_text("NR-REN-K"), "n").alias("code"))
    out = cascade.link_lists(part.select(F.col("k").alias("row_id"), raw.alias("raw")), lexicon, decisions, known, labels)
    return out.select("row_id", F.array_join("codes", ",").alias("codes"), "match_details")


RUN_COLUMNS = ["case_id", "code_complete", "category", "consistency", "match_type", "depth"]


def _runs_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "runs")
    writers.write_runs(ledger(spark, sf_dir), path, RUN_COLUMNS)
    rows = readers.load_runs(spark, f"{path}/run_id=*", 7)
    return rows.select(F.col("run_id").cast("long").alias("run_id"), F.col("case_id").cast("long").alias("case_id"), *(F.coalesce(c, F.lit("")).alias(c) for c in RUN_COLUMNS[1:]))


def _mixed_files(spark: SparkSession, sf_dir: str) -> str:
    """Lines `id,source é,lang`: those of even ids in UTF-8, of odd ones in Latin-1."""
    path = new_path(spark, "mixed")
    rows = table(spark, sf_dir, "documents").select(F.concat_ws(",", F.col("doc_id").cast("string"), F.concat("source", _text(" é")), F.coalesce("lang", F.lit("zz"))).alias("value"), (F.col("doc_id") % 2).alias("odd"))
    rows.where("odd = 0").select("value").write.text(f"{path}/a")
    rows.where("odd = 1").select("value").write.option("encoding", "ISO-8859-1").option("quote", "").option("sep", "\t").csv(f"{path}/b")
    return path


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.read_mixed_csv(spark, f"{_mixed_files(spark, sf_dir)}/*", ["doc_id", "source", "lang"])
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "fell_back")


def _encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = readers.read_files_as_encoded(spark, f"{_mixed_files(spark, sf_dir)}/*")
    lines = files.select("encoding", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return lines.select(F.substring_index("line", ",", 1).cast("long").alias("doc_id"), F.get(F.split("line", ","), F.lit(1)).alias("source"), "encoding")


def _disorders(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = lambda lang, column: F.struct(_text(lang).alias("lang"), column.alias("label"))
    relation = lambda text: F.array(F.struct(F.array(label("en", F.lit(text))).alias("Name")))
    ref = lambda source, code, said: F.struct(_text(source).alias("Source"), code.alias("Reference"), relation(said).alias("DisorderMappingRelation"))
    key = F.col("p_partkey").cast("string")
    refs = F.array(ref("ICD-10", F.concat(_text(" A"), key, _text(".1+*")), "E (exact)"), ref("MeSH", key, "E"), ref("ICD-10", _text(" "), "E"), ref("ICD-10", F.concat(_text("B"), key), ""))
    one = F.struct(key.alias("OrphaCode"), F.array(label("es", F.col("p_type")), label("en", F.col("p_name"))).alias("Name"), F.array(F.struct(F.array(label("en", F.col("p_brand")), label("en", F.col("p_type"))).alias("Synonym"))).alias("SynonymList"), F.array(F.struct(refs.alias("ExternalReference"))).alias("ExternalReferenceList"))
    path = new_path(spark, "disorders")
    table(spark, sf_dir, "part").select(F.array(F.struct(F.array(F.struct(F.array(one).alias("Disorder"))).alias("DisorderList"))).alias("JDBOR")).write.json(path)
    rows = readers.read_disorders(spark, path, "ICD-10", lines=True)
    return rows.select("orpha_code", "name", F.array_join("synonyms", "|").alias("synonyms"), F.explode("icd_codes").alias("c")).select("orpha_code", "name", "synonyms", "c.code", "c.mapping_relation")


def rooted(elements: DataFrame) -> DataFrame:
    """Lines (value) with a root element around those of each partition, so that each file that is written is well-formed."""

    def wrap(batches):
        line = lambda text: pa.RecordBatch.from_pydict({"value": pa.array([text], pa.string())})
        yield line("<ClaML>")
        yield from batches
        yield line("</ClaML>")

    return elements.mapInArrow(wrap, "value string")


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = lambda kind, text: F.concat(_text(f'<Rubric kind="{kind}"><Label>'), text, _text("</Label></Rubric>"))
    key = F.col("s_suppkey").cast("string")
    kind = F.when(F.col("s_suppkey") % 3 == 0, "block").otherwise("category")
    xml = F.concat(_text('<Class code="S'), key, _text('" kind="'), kind, _text('"><SuperClass code="N'), F.col("s_nationkey").cast("string"), _text('"/>'), label("preferred", F.concat(_text("name <Reference>x"), key, _text("</Reference>of  "), "s_name")), label("inclusion", F.concat(_text("also "), key)), _text("</Class>"))
    path = new_path(spark, "classes")
    rooted(table(spark, sf_dir, "supplier").select(xml.alias("value"))).write.text(path)
    return readers.read_classes(spark, path).select("code", "kind", "parent", "title", F.array_join("synonyms", "|").alias("synonyms"))


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("key"), F.col("p_partkey").alias("pos"))
    ids = linking.sequential_ids(part, part.where("pos % 90 = 3").select("key", F.col("pos").alias("number")))
    path, stored = new_path(spark, "ids-json"), new_path(spark, "ids")
    writers.write_ids(ids, stored)
    back = spark.read.parquet(stored).select("key", "code", F.upper("key").alias("label"), _text("2024-01-02").alias("first_seen"))
    writers.ids_as_json(back).write.text(path)
    return readers.read_id_dictionary(spark, path, lines=True).select("key", "code", "label", F.col("first_seen").cast("string").alias("first_seen"))


def _case_files(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "cases")
    text = F.concat("text", F.when(F.col("item_id") % 3 != 0, F.concat(_text("\nGROUND_TRUTH: A"), F.col("item_id").cast("string"), _text(" ,  B02"))).otherwise(""))
    table(spark, sf_dir, "benchmark").where("text is not null").select(F.concat(_text("case_"), F.col("item_id").cast("string")).alias("case"), text.alias("value")).write.partitionBy("case").option("lineSep", "\x1e").text(path)
    return path


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.read_cases(spark, f"{_case_files(spark, sf_dir)}/case=*", by_folder=True)
    clean = F.regexp_replace(F.col("case_text"), "\x1e", "")
    return rows.select("idx", "filename", clean.alias("case_text"), F.array_join(F.transform("codes", lambda c: F.regexp_replace(c, "\x1e", "")), "|").alias("codes"))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.read_corpus(spark, f"{_case_files(spark, sf_dir)}/case=*")
    return rows.select(F.regexp_extract("source", "case_([0-9]+)", 1).cast("long").alias("item_id"), F.length(F.regexp_replace("text", "\x1e", "")).alias("n_chars"))


def _id_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, items = new_path(spark, "id-texts"), table(spark, sf_dir, "benchmark").where("text is not null")
    items.select(F.to_json(F.create_map(F.col("item_id").cast("string"), F.col("text"))).alias("value")).write.text(path)
    texts = readers.read_id_texts(spark, path, lines=True)
    return items.select("item_id", F.length("text").alias("n_chars")).join(texts.select(F.col("id").cast("long").alias("item_id"), "text"), "item_id")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = new_path(spark, "report"), ledger(spark, sf_dir)
    outcomes = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    types = rows.groupBy("match_type").agg(F.count(F.lit(1)).alias("n"))
    writers.report({"runs": outcomes, "types": types}).write.json(path)
    back = spark.read.schema("part string, row string").json(path)
    return back.select("part", F.coalesce(F.get_json_object("row", "$.run_id"), F.get_json_object("row", "$.match_type")).alias("name"), F.get_json_object("row", "$.n").cast("long").alias("n"))


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, entities = new_path(spark, "catalogue"), _entities(spark, sf_dir)
    writers.write_catalogue(entities, path)
    return spark.read.schema(entities.schema).json(path)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(F.concat(_text("q"), F.col("user_id").cast("string"))).alias("query_id"), F.col("event_id").alias("iteration"), "event_type", "value")
    path = new_path(spark, "results")
    writers.write_results(events, path, ["iteration", "query_id", "event_type", "value"])
    back = spark.read.csv(path, header=True, escape='"')
    if back.columns != ["iteration", "query_id", "event_type", "value"]:
        raise ValueError("columns are out of order")
    return back.select(F.col("iteration").cast("long").alias("iteration"), "query_id", "event_type", F.col("value").cast("double").alias("value"))


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = ledger(spark, sf_dir).select("case_id", "run_id", F.col("category").alias("codigo"), F.when(F.col("depth") > 2, F.col("code_complete")).alias("icd_code"), F.col("match_type").alias("tipo"))
    rows = readers.with_columns(readers.rename_columns(old, {"tipo": "match_type", "codigo": "category"}), ["match_type", "comment"])
    return rows.select("case_id", "run_id", "match_type", "comment", F.col(readers.code_column(rows, ("icd_code", "category"))).alias("code"))


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "arrivals")
    rows = ledger(spark, sf_dir).select("case_id", "run_id", "category", F.when(F.col("case_id") % 4 == 0, "done").otherwise("").alias("title"))
    entities = table(spark, sf_dir, "supplier").groupBy(F.concat(F.chr(F.lit(65) + F.col("s_suppkey") % 22), F.lpad((F.col("s_suppkey") % 100).cast("string"), 2, "0")).alias("code")).agg(F.min("s_name").alias("title"))
    ids = table(spark, sf_dir, "part").where("p_partkey % 12 = 0").select(F.concat(F.lit("NF-"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("code"), F.col("p_name").alias("label"))
    entities, ids = kept(entities, "entities"), kept(ids, "labels")
    schema = "case_id long, run_id int, category string, title string"
    rows = rows.withColumn("run_id", F.col("run_id").cast("int"))
    for half in (0, 1):  # files that come later are taken by the second start alone
        rows.where(F.col("run_id") % 2 == half).write.mode("append").parquet(f"{root}/in")
        incremental.look_up_arrivals(spark, f"{root}/in", schema, entities, ids, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("case_id", F.col("run_id").cast("long").alias("run_id"), "category", "title", "outcome")


def _grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "grown")
    keys = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("key"), F.col("p_partkey").alias("pos"))
    for half in (0, 1):
        keys.where(F.col("pos") % 2 == half).write.mode("append").parquet(f"{root}/in")
        incremental.grow_ids(spark, f"{root}/in", f"{root}/ids", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/ids").select("key", "number", "code")


def _text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    key, name, kind = F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_type")
    codes = F.array(F.concat(_text("C"), key, _text(".1")), F.concat(_text("A"), key), F.concat(_text("C"), key, _text(".2")), F.concat(_text("B"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), _text(".3")))
    return part.select(
        "p_partkey",
        t.normalize_basic(F.concat(_text("  "), F.upper(name), _text(" - (x) "))).alias("basic"),
        t.strip_dagger(F.concat(_text(" "), key, _text("+*† "))).alias("bare"),
        F.array_join(t.bracket_terms(F.concat(name, _text(" [ "), kind, _text(" ] [ab] [one two three four five]"))), "|").alias("brackets"),
        t.chapter_label(F.when(F.col("p_partkey") % 2 == 0, kind), F.when(F.col("p_partkey") % 3 == 0, name)).alias("label"),
        an.best_title(F.when(F.col("p_partkey") % 2 == 0, name).otherwise(""), F.when(F.col("p_partkey") % 3 == 0, kind)).alias("best"),
        t.strip_highlight(F.concat(_text("<em class='f'>"), name, _text("</em> "))).alias("plain"),
        an.name_differs(F.when(F.col("p_partkey") % 2 == 0, F.upper(name)).otherwise(kind), name).alias("differs"),
        F.array_join(t.codes_to_categories(codes), "|").alias("categories"),
        F.array_join(an.unique_ordered(F.array(name, kind, name)), "|").alias("distinct_names"),
        an.truncate_any(F.concat(key, _text(".5.6"))).alias("cut"),
    )


def _chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array("category", F.concat(F.lower("category"), _text(".1")), _text("??"))
    return ledger(spark, sf_dir).select("case_id", "run_id", F.array_join(t.codes_to_chapters(codes), "|").alias("chapters"))


def _answer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    key, name = F.col("p_partkey").cast("string"), F.col("p_name")
    return part.select(
        "p_partkey",
        t.strip_fences(F.concat(_text(" ```json\n"), name, _text("\n```"))).alias("unfenced"),
        an.extract_json_object(F.concat(_text("hm {no} </thinking> so ```json\n{\"a\": {\"b\": "), key, _text("}}\n``` end"))).alias("object"),
        an.clean_answer(F.concat(_text('<|channel|>final<|message|>"Answer: '), name, _text('"<|end|>'))).alias("answer"),
        an.is_valid_name(F.when(F.col("p_partkey") % 3 == 0, F.concat(_text("this is "), name)).when(F.col("p_partkey") % 3 == 1, name).otherwise(F.concat(name, _text(". So "), name))).alias("is_name"),
        an.extract_bot_text(F.when(F.col("p_partkey") % 2 == 0, F.concat(_text("x\nThinking...\n"), name, _text("\n\n> y\n"), key)).otherwise(F.concat(_text("The user is ill.\n\n"), name))).alias("said"),
        an.truncate_codes_in_json(F.concat(_text('{"n": 1.5, "icd_codes": ["C'), key, _text('.1", "D2"]}'))).alias("cut"),
        an.truncate_codes_in_json(F.concat(_text('oops "C'), key, _text('.1" and "x y.2" 3.4'))).alias("cut_text"),
        F.array_join(an.parse_string_list(F.concat(_text('["'), name, _text('", " ", "b", "c", "d", "e", "f"]'))), "|").alias("strings"),
    )


def _quoted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    raw = F.concat(_text('["'), "p_name", _text("'s\", ['B"), key, _text(".1', \"say \\\"hi\\\"\"], 'Un\"known', \"UNKNOWN\"]"))
    out = table(spark, sf_dir, "part").withColumn("raw", raw)
    return out.select("p_partkey", F.array_join(an.parse_code_list(F.col("raw")), "|").alias("codes"), an.parse_ground_truth(F.col("raw")).alias("truth"), an.to_json_list(an.clean_chapters(F.col("raw"))).alias("chapters"))


def _similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose longest common subsequence is known: a name and itself with letters that it lacks."""
    part, name = table(spark, sf_dir, "part"), F.col("p_name")
    longer = F.concat(_text("ZZ"), name, F.repeat(_text("Q"), (F.col("p_partkey") % 4).cast("int")))
    return part.select("p_partkey", F.round(t.indel_ratio(name, longer), 6).alias("one_way"), F.round(t.indel_ratio(longer, name), 6).alias("other_way"), t.indel_ratio(name, _text("")).alias("none"), t.token_sorted(name).alias("tokens"))


def _first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terminology.first_of_each(ledger(spark, sf_dir), ["run_id", "match_type"], 10, ["case_id"]).select("run_id", "match_type", "case_id", F.col("place").cast("long").alias("place"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).select(F.col("case_id").alias("query_id"), F.col("run_id").alias("iteration"), "match_type", "category", "depth")
    return lookup.pair_iterations(rows.select("query_id", "iteration", "match_type"), rows.where("depth > 2").select("query_id", "iteration", "category"))


def _cascade_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    core = F.when(F.col("case_id") % 3 == 0, F.concat(_text("A-"), F.col("case_id").cast("string"))).when(F.col("case_id") % 3 == 1, F.concat(_text("core "), F.col("case_id").cast("string"))).otherwise("")
    return lookup.cascade_details(ledger(spark, sf_dir).withColumns({"phrase": F.concat(_text("a "), F.col("case_id").cast("string")), "core": core}))


def _unit_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = linking.unit(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x * x), 6).alias("square"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "c1_cascade": _cascade,
    "c4_link_lists_all_steps": _lists,
    "s1_runs_read_back": _runs_read_back,
    "s2_mixed_encodings": _mixed,
    "s3_whole_file_encodings": _encodings,
    "s4_disorders": _disorders,
    "s6_classes": _classes,
    "s8_id_dictionary": _dictionary,
    "s9_cases": _cases,
    "s10_id_texts": _id_texts,
    "v1_corpus": _corpus,
    "v3_unit_lengths": _unit_lengths,
    "k3_report": _report,
    "k5_catalogue": _exported,
    "k6_results": _results,
    "p1_columns": _columns,
    "p10_first_rows": _first_rows,
    "st1_arrivals": _arrivals,
    "st2_grown_ids": _grown,
    "f2_text_forms": _text_forms,
    "f12_answer_forms": _answer_forms,
    "f20_quoted_lists": _quoted_lists,
    "f26_chapters": _chapters,
    "f32_similarity": _similarity,
    "j17_pairs": _pairs,
    "v5_conversation_json": lambda s, d: linking.conversations_as_json(table(s, d, "conversations").where("conv_id is not null")),
    "a7_source_shares": lambda s, d: lookup.source_shares(ledger(s, d)),
    "a8_cascade_details": _cascade_details,
    "a9_verdicts": lambda s, d: lookup.verdict_summary(_gated(s, d, one_label=True)),
    "t5_violation_codes": lambda s, d: stability.violation_codes(ledger(s, d), _stable(s, d)),
    "t6_verdicts_by_run": lambda s, d: stability.verdicts_by_run(_cells(s, d)),
    "t7_level_shares": lambda s, d: stability.level_shares(ledger(s, d)),
    "t8_depth_by_class": lambda s, d: stability.depth_by_class(ledger(s, d), _stable(s, d)),
    "x1_nf_differences": lambda s, d: stability.nf_differences(ledger(s, d)),
    "x3_nf_subset": lambda s, d: stability.nf_subset(ledger(s, d)),
}

L = f"WITH l AS ({LEDGER_SQL})"
NF = "coalesce(category LIKE 'NF-%', false)"
PAD = "CASE WHEN length({0}::VARCHAR) < {1} THEN lpad({0}::VARCHAR, {1}, '0') ELSE {0}::VARCHAR END"
CHAPTER_ROWS = ", ".join(map(str, t.CHAPTERS))
STEPS = f"""WITH p AS (SELECT p_partkey AS k, p_partkey % 8 AS g, CAST(p_partkey // 8 % 2 + 1 AS BIGINT) AS run_id, p_name, upper(p_name) AS name, concat(lower(p_brand), ' kind') AS kind, upper(p_brand) AS title, p_partkey % 97 = 0 AS blank FROM part),
lex AS (SELECT p_name, min(p_partkey) AS pos, p_name NOT LIKE 'red %' AS coded FROM part GROUP BY 1),
cat AS (SELECT upper(p_brand) AS title, min(p_partkey) AS cpos, min(p_partkey) % 5 <> 0 AS assignable FROM part GROUP BY 1),
r AS (SELECT *, CASE WHEN g = 0 THEN p_name WHEN g = 2 THEN concat(p_name, 'x') WHEN g = 4 THEN kind WHEN g = 6 THEN concat(kind, 's') WHEN g = 7 THEN concat('nothing ', k) ELSE concat('qqq ', k) END AS norm,
  CASE WHEN blank THEN '' WHEN g IN (0, 1) AND coded THEN CASE g WHEN 0 THEN 'exact_complete' ELSE 'exact_core' END
       WHEN g IN (2, 3) AND coded AND length(p_name) % 3 <> 0 THEN CASE g WHEN 2 THEN 'fuzzy_complete' ELSE 'fuzzy_core' END
       WHEN g = 4 AND assignable THEN 'catalog_exact_complete' WHEN g = 5 AND assignable THEN 'catalog_exact_core' WHEN g = 6 AND assignable THEN 'catalog_search' ELSE 'nf' END AS match_type
  FROM p JOIN lex USING (p_name) JOIN cat USING (title)),
ids AS (SELECT norm, min(k) AS pos FROM r WHERE match_type = 'nf' GROUP BY 1),
known AS (SELECT concat('nothing ', k) AS norm, k AS number FROM p WHERE k % 40 = 7),
numbers AS (SELECT norm, number FROM known UNION ALL
  SELECT norm, row_number() OVER (ORDER BY pos, norm) + (SELECT coalesce(max(number), 0) FROM known) FROM ids WHERE norm NOT IN (SELECT norm FROM known))
SELECT run_id, k AS case_id, match_type,
  CASE WHEN blank THEN '' WHEN match_type = 'nf' THEN 'none' WHEN g IN (0, 2, 4, 6) THEN 'complete' ELSE 'core' END AS match_source,
  CASE WHEN blank THEN '' WHEN match_type = 'nf' THEN concat('NF-', {PAD.format("number", 4)}) WHEN g >= 4 THEN concat('K', cpos)
       WHEN pos % 2 = 0 OR (g = 0 AND pos % 4 = 1) THEN concat('A', pos) ELSE concat('B', pos) END AS icd_code_complete,
  CASE WHEN blank OR match_type = 'nf' OR g >= 4 THEN '' WHEN pos % 2 = 0 OR (g = 0 AND pos % 4 = 1) THEN 'NTBT' ELSE 'E' END AS mapping_relation,
  CASE WHEN blank OR match_type = 'nf' THEN '' WHEN g >= 4 THEN title ELSE name END AS matched_name,
  CASE WHEN blank THEN NULL WHEN match_type = 'nf' THEN 0.0 WHEN g IN (2, 3) THEN round(200.0 * length(p_name) / (2 * length(p_name) + 1), 6) ELSE 100.0 END::DOUBLE AS score
FROM r LEFT JOIN numbers ON numbers.norm = r.norm AND match_type = 'nf'"""
LISTS = f"""WITH p AS (SELECT p_partkey AS k, p_name, upper(p_name) AS name, length(p_name) AS n, p_name LIKE 'red %' AS bare, min(p_partkey) OVER (PARTITION BY p_name) AS pos FROM part),
i AS (SELECT k, 0 AS slot, name AS phrase, p_name AS norm, name, CASE WHEN NOT bare THEN 'exact' ELSE 'nr' END AS kind, 100 AS score, pos FROM p
UNION ALL SELECT k, 1, concat(p_name, 'x'), concat(p_name, 'x'), name, CASE WHEN bare THEN 'nr' WHEN n % 3 <> 0 THEN 'fuzzy_validated' WHEN n % 2 = 0 THEN 'semantic' ELSE 'nr' END, CASE WHEN n % 3 <> 0 THEN CAST(round(200.0 * n / (2 * n + 1)) AS INT) ELSE 0 END, pos FROM p
UNION ALL SELECT k, 2, concat('nothing ', k), concat('nothing ', k), NULL, 'nr', 0, pos FROM p),
new AS (SELECT norm, CASE WHEN norm LIKE 'nothing %' AND CAST(split_part(norm, ' ', 2) AS BIGINT) % 2 = 0 THEN 'REN' ELSE 'OTR' END AS prefix, min(k * 8 + slot) AS earliest FROM i
  WHERE kind = 'nr' AND NOT (norm LIKE 'nothing %' AND k % 50 = 0) GROUP BY norm),
numbers AS (SELECT norm, prefix, row_number() OVER (PARTITION BY prefix ORDER BY earliest, norm) + CASE WHEN prefix = 'REN' THEN (SELECT count(*) FROM p WHERE k % 50 = 0) ELSE 0 END AS number FROM new),
c AS (SELECT k, slot, phrase, CASE WHEN kind <> 'nr' THEN name END AS said, kind, CASE WHEN kind IN ('exact', 'fuzzy_validated') THEN score ELSE 0 END AS score,
  CASE WHEN kind <> 'nr' THEN concat('C', pos) WHEN slot = 2 AND k % 50 = 0 THEN concat('NR-REN-K', k) ELSE concat('NR-', prefix, '-', {PAD.format("number", 3)}) END AS code FROM i LEFT JOIN numbers USING (norm))
SELECT k AS row_id, string_agg(code, ',' ORDER BY slot) AS codes, string_agg(concat(phrase, ' → ', coalesce(said, 'None'), ' [', kind, ', ', score, '%] → ', code), ' ;; ' ORDER BY slot) AS match_details FROM c GROUP BY k"""

ORACLE_SQL: dict[str, str] = {
    "c1_cascade": STEPS,
    "c4_link_lists_all_steps": LISTS,
    "s1_runs_read_back": f"{L} SELECT CAST(run_id AS BIGINT) AS run_id, case_id, code_complete, category, coalesce(consistency, '') AS consistency, match_type, depth::VARCHAR AS depth FROM l",
    "s2_mixed_encodings": "SELECT doc_id, concat(source, ' é') AS source, coalesce(lang, 'zz') AS lang, doc_id % 2 = 1 AS fell_back FROM documents",
    "s3_whole_file_encodings": "SELECT doc_id, concat(source, ' é') AS source, CASE WHEN doc_id % 2 = 0 THEN 'utf-8' ELSE 'cp1252' END AS encoding FROM documents",
    "s4_disorders": """SELECT p_partkey::VARCHAR AS orpha_code, p_name AS name, concat(p_brand, '|', p_type) AS synonyms, concat('A', p_partkey, '.1') AS code, 'E' AS mapping_relation FROM part
UNION ALL SELECT p_partkey::VARCHAR, p_name, concat(p_brand, '|', p_type), concat('B', p_partkey), 'ND' FROM part""",
    "s6_classes": """SELECT concat('S', s_suppkey) AS code, CASE WHEN s_suppkey % 3 = 0 THEN 'block' ELSE 'category' END AS kind, concat('N', s_nationkey) AS parent, concat('name of ', s_name) AS title,
  CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat('also ', s_suppkey) END AS synonyms FROM supplier""",
    "s8_id_dictionary": f"""WITH n AS (SELECT concat(p_name, ' ', p_partkey) AS key, row_number() OVER (ORDER BY p_partkey) + (SELECT max(p_partkey) FROM part WHERE p_partkey % 90 = 3) AS number FROM part WHERE p_partkey % 90 <> 3)
SELECT key, concat('NF-', {PAD.format("number", 4)}) AS code, upper(key) AS label, '2024-01-02' AS first_seen FROM n""",
    "s9_cases": """SELECT row_number() OVER (ORDER BY concat('case=case_', item_id)) AS idx, concat('case=case_', item_id) AS filename, trim(text) AS case_text, CASE WHEN item_id % 3 <> 0 THEN concat('A', item_id, '|B02') ELSE '' END AS codes
FROM benchmark WHERE text IS NOT NULL""",
    "v1_corpus": "SELECT item_id, CAST(length(text) + CASE WHEN item_id % 3 <> 0 THEN length(concat(chr(10), 'GROUND_TRUTH: A', item_id, ' ,  B02')) ELSE 0 END AS INT) AS n_chars FROM benchmark WHERE text IS NOT NULL",
    "s10_id_texts": "SELECT item_id, CAST(length(text) AS INT) AS n_chars, text FROM benchmark WHERE text IS NOT NULL",
    "v3_unit_lengths": "SELECT vec_id, CASE WHEN list_dot_product(embedding, embedding) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS square FROM embeddings",
    "k3_report": f"{L} SELECT 'runs' AS part, run_id::VARCHAR AS name, count(*) AS n FROM l GROUP BY run_id UNION ALL SELECT 'types', match_type, count(*) FROM l GROUP BY match_type",
    "k5_catalogue": """SELECT concat('R', r_regionkey) AS code, NULL AS parent, 'chapter' AS kind, r_name AS title FROM region UNION ALL SELECT concat('N', n_nationkey), concat('R', n_regionkey), 'block', n_name FROM nation
UNION ALL SELECT concat('C', c_custkey), concat('N', c_nationkey), 'category', CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END FROM customer""",
    "k6_results": "SELECT event_id AS iteration, CASE WHEN user_id % 2 = 0 THEN user_id::VARCHAR ELSE concat('q', user_id) END AS query_id, event_type, value FROM events",
    "p1_columns": f"{L} SELECT case_id, run_id, match_type, '' AS comment, category AS code FROM l",
    "p10_first_rows": f"{L} SELECT run_id, match_type, case_id, place FROM (SELECT *, row_number() OVER (PARTITION BY run_id, match_type ORDER BY case_id) AS place FROM l) WHERE place <= 10",
    "st1_arrivals": f"""{L}, ent AS (SELECT concat(chr(CAST(65 + s_suppkey % 22 AS INT)), lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0')) AS code, min(s_name) AS title FROM supplier GROUP BY 1),
ids AS (SELECT concat('NF-', lpad(CAST(p_partkey AS VARCHAR), 6, '0')) AS code, p_name AS label FROM part WHERE p_partkey % 12 = 0)
SELECT case_id, CAST(run_id AS BIGINT) AS run_id, category, CASE WHEN {NF} THEN concat('[NF] ', coalesce(label, 'no label')) ELSE coalesce(title, '') END AS title,
  CASE WHEN {NF} THEN 'nf' WHEN coalesce(title, '') <> '' THEN 'resolved' ELSE 'unresolved' END AS outcome FROM l LEFT JOIN ent ON ent.code = category LEFT JOIN ids ON ids.code = category WHERE case_id % 4 <> 0""",
    "st2_grown_ids": f"""WITH k AS (SELECT concat(p_name, ' ', p_brand) AS key, p_partkey AS pos FROM part), h AS (SELECT key, min(pos % 2) AS half FROM k GROUP BY 1),
n AS (SELECT key, row_number() OVER (ORDER BY half, min(pos), key) AS number FROM k JOIN h USING (key) WHERE pos % 2 = half GROUP BY key, half) SELECT key, number, concat('NF-', {PAD.format("number", 4)}) AS code FROM n""",
    "f2_text_forms": """SELECT p_partkey, concat(p_name, ' (x)') AS basic, p_partkey::VARCHAR AS bare, p_type AS brackets,
  concat_ws(' - ', CASE WHEN p_partkey % 2 = 0 THEN p_type END, CASE WHEN p_partkey % 3 = 0 THEN p_name END) AS label,
  CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END AS best, p_name AS plain, p_partkey % 2 <> 0 AND lower(p_type) <> p_name AS differs,
  concat('B', lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0'), '|C', p_partkey) AS categories, concat(p_name, '|', p_type) AS distinct_names, p_partkey::VARCHAR AS cut FROM part""",
    "f12_answer_forms": """SELECT p_partkey, p_name AS unfenced, concat('{"a": {"b": ', p_partkey, '}}') AS object, p_name AS answer, p_partkey % 3 = 1 AS is_name,
  CASE WHEN p_partkey % 2 = 0 THEN concat(p_name, chr(10), p_partkey) ELSE p_name END AS said, concat('{"n": 1.5, "icd_codes": ["C', p_partkey, '", "D2"]}') AS cut,
  concat('oops "C', p_partkey, '" and "x y.2" 3.4') AS cut_text, concat(p_name, '|b|c|d|e') AS strings FROM part""",
    "f20_quoted_lists": """SELECT p_partkey, concat(p_name, '''s|B', p_partkey, '|say "hi"|Un"known|UNKNOWN') AS codes, concat('"', p_name, '''s"') AS truth,
  concat('["', p_name, '''s", "B', p_partkey, '.1", "say \\"hi\\"", "Un\\"known"]') AS chapters FROM part""",
    "f26_chapters": f"""{L}, ch(name, first, last) AS (VALUES {CHAPTER_ROWS}), u AS (SELECT case_id, run_id, coalesce(name, 'Unknown') AS c FROM (SELECT *, concat(left(category, 1), coalesce(nullif(regexp_extract(category, '^.([0-9]{{2}})', 1), ''), '00')) AS k FROM l)
  LEFT JOIN ch ON k BETWEEN first AND last) SELECT case_id, run_id, CASE WHEN c = 'Unknown' THEN c WHEN c < 'Unknown' THEN concat(c, '|Unknown') ELSE concat('Unknown|', c) END AS chapters FROM u""",
    "f32_similarity": """SELECT p_partkey, round(200.0 * n / (2 * n + 2 + p_partkey % 4), 6)::DOUBLE AS one_way, round(200.0 * n / (2 * n + 2 + p_partkey % 4), 6)::DOUBLE AS other_way, 0.0::DOUBLE AS none,
  array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS tokens FROM (SELECT *, length(p_name) AS n FROM part)""",
    "j17_pairs": f"{L} SELECT case_id AS query_id, run_id AS iteration, match_type, CASE WHEN depth > 2 THEN category END AS category FROM l",
    "v5_conversation_json": "SELECT conv_id, CAST(to_json(list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn, role, text)) AS VARCHAR) AS conversation FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id",
    "a7_source_shares": f"""{L} SELECT run_id, match_source, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY run_id) AS share
FROM (SELECT run_id, CASE WHEN suffix(match_type, '_complete') THEN 'complete' WHEN suffix(match_type, '_core') THEN 'core' ELSE 'none' END AS match_source FROM l) GROUP BY 1, 2""",
    "a8_cascade_details": f"{L} SELECT match_type, count(*) AS n, count(*) FILTER (NOT {NF}) AS n_resolved, count(*) FILTER (case_id % 3 = 1) AS n_core_differs FROM l WHERE match_type <> '' GROUP BY match_type",
    "a9_verdicts": f"""{L}, ent AS (SELECT DISTINCT concat(chr(CAST(65 + s_suppkey % 22 AS INT)), lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0')) AS code FROM supplier)
SELECT run_id, CASE WHEN {NF} THEN 'skipped_nf' WHEN code IS NULL OR case_id % 50 = 0 THEN 'no_lookup' ELSE coalesce(nullif(consistency, ''), 'error') END AS verdict_outcome, count(*) AS n FROM l LEFT JOIN ent ON code = category GROUP BY 1, 2""",
    "t5_violation_codes": f"""{STABLE} SELECT case_id, string_agg(concat(run_id, ':', coalesce(category, 'none')), '; ' ORDER BY run_id) AS by_run FROM l
WHERE starts_with(match_type, 'exact_') AND case_id IN (SELECT case_id FROM st WHERE stability = 'unstable') GROUP BY case_id""",
    "t6_verdicts_by_run": f"""{CELLS}, v AS (SELECT case_id FROM cells GROUP BY case_id HAVING count(DISTINCT category) = 1 AND count(category) = count(*) AND NOT bool_or({NF}) AND bool_or(consistency = 'yes') AND bool_or(consistency = 'no'))
SELECT case_id, string_agg(concat(run_id, ':', coalesce(consistency, 'none')), '; ' ORDER BY run_id) AS by_run FROM cells WHERE case_id IN (SELECT case_id FROM v) GROUP BY case_id""",
    "t7_level_shares": f"""{L} SELECT CASE WHEN a > 1 THEN 'category' WHEN b > 1 THEN 'subcode' ELSE 'stable' END AS level, count(*) AS n, count(*) / sum(count(*)) OVER () AS share
FROM (SELECT case_id, count(DISTINCT nullif(category, '')) AS a, count(DISTINCT nullif(code_complete, '')) AS b FROM l GROUP BY case_id) WHERE a > 0 OR b > 0 GROUP BY 1""",
    "t8_depth_by_class": f"""{STABLE}, dv AS (SELECT case_id, depth, row_number() OVER (PARTITION BY case_id ORDER BY count(*) DESC, min(run_id)) AS rn FROM l WHERE depth IS NOT NULL GROUP BY case_id, depth)
SELECT depth, stability, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY depth) AS share FROM dv JOIN st USING (case_id) WHERE rn = 1 GROUP BY depth, stability""",
    "x1_nf_differences": f"""{L}, nf AS (SELECT DISTINCT run_id, case_id FROM l WHERE {NF}), f AS (SELECT case_id FROM nf WHERE run_id = 1)
SELECT run_id, case_id, 'only_in_run' AS side FROM nf WHERE run_id <> 1 AND case_id NOT IN (SELECT case_id FROM f)
UNION ALL SELECT q.run_id, f.case_id, 'only_in_first' FROM f CROSS JOIN (SELECT DISTINCT run_id FROM l WHERE run_id <> 1) q WHERE NOT EXISTS (SELECT 1 FROM nf WHERE nf.run_id = q.run_id AND nf.case_id = f.case_id)""",
    "x3_nf_subset": f"""{CELLS}, nf AS (SELECT DISTINCT run_id, case_id FROM l WHERE {NF}), f AS (SELECT case_id FROM nf WHERE run_id = 1)
SELECT r.run_id, count(nf.case_id) = count(f.case_id) AS is_subset, (SELECT count(*) > 0 FROM (SELECT case_id FROM cells GROUP BY case_id HAVING bool_and({NF}))) AS dependent
FROM (SELECT DISTINCT run_id FROM l) r LEFT JOIN nf ON nf.run_id = r.run_id LEFT JOIN f ON f.case_id = nf.case_id GROUP BY r.run_id""",
}
