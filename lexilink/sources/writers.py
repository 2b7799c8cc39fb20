"""Documents and exports as text files: one row is one document's or record's content, and Spark's text writer commits them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilink.functions.text import sanitize_xml
from lexilink.sources.pubtator import concept_line


def one_line(text: Column) -> Column:
    """Every line break and tab becomes one space, so that offsets stay what they are."""
    return F.translate(F.coalesce(text, F.lit("")), "\r\n\t", "   ")


def _ordered(column: str) -> Column:
    """A document's passages in order, as an array of one of their columns."""
    return F.transform(F.array_sort(F.collect_list(F.struct("passage_id", column))), lambda s: s[column])


def _texts(passages: DataFrame) -> DataFrame:
    return passages.select("eid", "passage_id", F.coalesce("text", F.lit("")).alias("text")).groupBy("eid").agg(_ordered("text").alias("texts"))


def pubtator_documents(passages: DataFrame, annotations: DataFrame) -> DataFrame:
    """(eid, content): title line, abstract line (the other passages, joined by spaces), the annotations (eid, start, end, text, type, ids) by place, and an empty line at the end."""
    marked = annotations.groupBy("eid").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", _annotation_line().alias("line")))), lambda s: s["line"]).alias("lines"))
    whole = _texts(passages).join(marked, "eid", "left")
    title = F.concat_ws("|", F.col("eid").cast("string"), F.lit("t"), one_line(F.get("texts", F.lit(0))))
    rest = F.array_join(F.transform(F.slice("texts", F.lit(2), F.size("texts")), one_line), " ")
    abstract = F.concat_ws("|", F.col("eid").cast("string"), F.lit("a"), rest)
    return whole.select("eid", F.concat(F.array_join(F.concat(F.array(title, abstract), F.coalesce("lines", F.array().cast("array<string>"))), "\n"), F.lit("\n")).alias("content"))


def append_pubtator(spark: SparkSession, path: str, annotations: DataFrame, out: str) -> None:
    """The documents of PubTator files in `path`, with annotations (eid, start, end, text, type, ids) put before those that they have, written to `out`. Text lines and the annotations that are there stay as they are, relations too.

    A document is the lines between empty lines; lines are read with their documents by Spark's text reader, one record for each document."""
    documents = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "").select(F.rtrim(F.col("value"), F.lit("\n")).alias("value"))
    eid = F.regexp_extract("value", r"^\s*(\d+)", 1).cast("long")
    lines = F.split("value", "\n", -1)
    texts = F.filter(lines, lambda x: x.rlike(r"^\d+\|[ta]\|"))
    rest = F.filter(lines, lambda x: ~x.rlike(r"^\d+\|[ta]\|"))
    fresh = annotations.groupBy("eid").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", _annotation_line().alias("line")))), lambda s: s["line"]).alias("lines"))
    whole = documents.select(eid.alias("eid"), texts.alias("texts"), rest.alias("rest")).join(fresh, "eid", "left")
    content = F.array_join(F.concat("texts", F.coalesce("lines", F.array().cast("array<string>")), "rest"), "\n")
    write_contents(whole.select("eid", F.concat(content, F.lit("\n")).alias("content")), out)


def _annotation_line() -> Column:
    return F.concat_ws("\t", F.col("eid").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"), one_line(F.col("text")), F.col("type"), F.array_join("ids", ","))


def dictionary_lines(names: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """(content): `id||name|name`, the distinct names of an identifier in order; empty ones are left out, and so are identifiers without any."""
    named = names.where(F.trim(name_col) != "").groupBy(F.col(id_col).cast("string").alias("id")).agg(F.array_sort(F.collect_set(one_line(F.col(name_col)))).alias("names"))
    return named.select(F.concat_ws("||", "id", F.array_join("names", "|")).alias("content"))


def plain_documents(passages: DataFrame) -> DataFrame:
    """(eid, content): a document's passages, one a line."""
    return _texts(passages).select("eid", F.array_join(F.transform("texts", one_line), "\n").alias("content"))


def titled_documents(passages: DataFrame) -> DataFrame:
    """(eid, content): the title, an empty line, the other passages joined by spaces."""
    rest = F.array_join(F.transform(F.slice("texts", F.lit(2), F.size("texts")), one_line), " ")
    return _texts(passages).select("eid", F.concat_ws("\n", one_line(F.get("texts", F.lit(0))), F.lit(""), rest).alias("content"))


def concept_documents(annotations: DataFrame) -> DataFrame:
    """(eid, content): the concept lines of each document (eid, start, end, type, text, ids) by place."""
    line = concept_line(F.col("eid"), F.col("start"), F.col("end"), F.col("type"), one_line(F.col("text")), F.col("ids"))
    return annotations.groupBy("eid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", line.alias("line")))), lambda s: s["line"]), "\n").alias("content"))


def escaped_xml(text: Column) -> Column:
    """Text as XML content: characters that XML forbids become `?`, and the three that it reserves are escaped."""
    out = sanitize_xml(F.coalesce(text, F.lit("")))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def bioc_xml_documents(passages: DataFrame) -> DataFrame:
    """(eid, content): each document as a BioC-XML collection of its own, with its passages, their types and offsets, without annotations."""
    ordered = passages.select("eid", "passage_id", F.struct(F.col("role"), F.coalesce("text", F.lit("")).alias("text")).alias("p")).groupBy("eid").agg(_ordered("p").alias("ps"))
    before = lambda i: F.aggregate(F.slice("ps", F.lit(1), i), F.lit(0), lambda n, p: n + F.length(p["text"]) + 1)
    each = F.transform("ps", lambda p, i: F.concat(F.lit('<passage><infon key="type">'), escaped_xml(p["role"]), F.lit("</infon><offset>"), before(i).cast("string"), F.lit("</offset><text>"), escaped_xml(p["text"]), F.lit("</text></passage>")))
    return ordered.select("eid", F.concat(F.lit("<collection><document><id>"), F.col("eid").cast("string"), F.lit("</id>"), F.array_join(each, ""), F.lit("</document></collection>")).alias("content"))


def write_contents(documents: DataFrame, path: str, separator: str = "\n", per_file: int = 0) -> None:
    """The contents of (eid, content) in files, each followed by `separator`; with per_file=1 a file for each document."""
    writer = documents.select("content").write.mode("error").option("lineSep", separator)
    (writer.option("maxRecordsPerFile", per_file) if per_file else writer).text(path)


def read_contents(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(content) as write_contents wrote it with this separator."""
    return spark.read.option("lineSep", separator).text(path).where("value <> ''").withColumnRenamed("value", "content")


def write_named(documents: DataFrame, path: str, each: bool = False) -> None:
    """(eid, content) so that read_named finds each document by its id: documents as JSON lines (eid, content) in as many files as there are tasks; with `each` a folder `eid=ID` with a file for each document, which costs
    more than all else when documents are many."""
    if each:
        documents.repartition("eid").write.mode("error").partitionBy("eid").option("lineSep", "\f").text(path)
    else:
        documents.select(F.col("eid").cast("string").alias("eid"), "content").write.mode("error").option("ignoreNullFields", False).json(path)


def read_named(spark: SparkSession, path: str, each: bool = False) -> DataFrame:
    """(eid string, content) as write_named wrote it."""
    if each:
        return spark.read.schema("value string, eid string").option("lineSep", "\f").text(path).select("eid", F.col("value").alias("content"))
    return spark.read.schema("eid string, content string").json(path)


#: The fields of a BioC collection that are read.
_BIOC = "documents array<struct<id:string,passages:array<struct<infons:map<string,string>,offset:bigint,text:string,annotations:array<struct<id:string,infons:map<string,string>,text:string,locations:array<struct<offset:bigint,length:bigint>>>>>>>>"


def read_bioc_json(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(eid, passage_id, offset, text, type) of the passages of BioC-JSON collections, and (eid, passage_id, start, end, text, type, identifier) of their annotations, relative to the passage. A collection is a file, or with `lines` a line."""
    documents = spark.read.schema(_BIOC).option("multiLine", not lines).json(path).select(F.explode("documents").alias("d"))
    passages = documents.select(F.col("d.id").alias("eid"), F.posexplode("d.passages").alias("passage_id", "p"))
    texts = passages.select("eid", "passage_id", "p.offset", "p.text", F.col("p.infons")["type"].alias("type"))
    each = passages.select("eid", "passage_id", F.col("p.offset").alias("of"), F.explode("p.annotations").alias("a")).select("eid", "passage_id", "of", "a", F.explode("a.locations").alias("l"))
    start = F.col("l.offset") - F.col("of")
    return texts, each.select("eid", "passage_id", start.alias("start"), (start + F.col("l.length")).alias("end"), F.col("a.text").alias("text"), F.col("a.infons")["type"].alias("type"), F.col("a.infons")["identifier"].alias("identifier"))


def bioc_json_collections(passages: DataFrame, annotations: DataFrame) -> DataFrame:
    """(eid, content): each document as a BioC-JSON collection of its own; annotations are (eid, passage_id, start, end, text, type, identifier), relative to the passage."""
    w = passages.groupBy("eid").agg(_ordered("text").alias("texts"), F.array_sort(F.collect_list("passage_id")).alias("ids"))
    offsets = w.select("eid", F.posexplode("texts").alias("i", "text"), "ids", "texts").select("eid", F.get("ids", F.col("i")).alias("passage_id"), "text", F.aggregate(F.slice("texts", F.lit(1), F.col("i")), F.lit(0), lambda n, t: n + F.length(t) + 1).cast("long").alias("offset"))
    known = offsets.join(annotations.withColumnRenamed("text", "mention"), ["eid", "passage_id"], "left")
    location = F.array(F.struct((F.col("start") + F.col("offset")).alias("offset"), (F.col("end") - F.col("start")).alias("length")))
    infons = F.create_map(F.lit("type"), F.col("type"), F.lit("identifier"), F.col("identifier"))
    annotation = F.when(F.col("start").isNotNull(), F.struct("start", F.concat_ws("-", "start", "end").alias("id"), infons.alias("infons"), F.col("mention").alias("text"), location.alias("locations")))
    per = known.groupBy("eid", "passage_id", "offset", "text").agg(F.array_sort(F.collect_list(annotation.alias("a")), lambda x, y: F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(0)).alias("found"))
    passage = F.struct("passage_id", F.create_map(F.lit("type"), F.when(F.col("offset") == 0, F.lit("title")).otherwise(F.lit("abstract"))).alias("infons"), "offset", "text", F.transform("found", lambda a: a.dropFields("start")).alias("annotations"))
    docs = per.groupBy("eid").agg(F.array_sort(F.collect_list(passage.alias("p")), lambda x, y: F.when(x["passage_id"] < y["passage_id"], -1).otherwise(1)).alias("ps"))
    document = F.struct(F.col("eid").cast("string").alias("id"), F.transform("ps", lambda p: p.dropFields("passage_id")).alias("passages"))
    return docs.select("eid", F.to_json(F.struct(F.array(document).alias("documents"))).alias("content"))
