"""Tolerant readers and writers of graph files and lexicons."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark import providers
from kgspark.functions.profiles import TOP_CATEGORIES
from kgspark.functions.text import SPACE, canonical, topic_content

#: For from_json, which by itself gives up on strings of more than 20 million characters; a graph encoded twice is one string.
LONG = {"maxStringLen": str(2**31 - 1)}


def topics(spark: SparkSession, path: str, start: int = 1) -> DataFrame:
    """file, topic_idx (from 1), topic, content of JSON arrays; start leaves out what comes before."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", "array<struct<topic:string,content:string>>", LONG).alias("t"))
    rows = files.select("file", F.posexplode("t").alias("at", "x")).select("file", (F.col("at") + 1).alias("topic_idx"), "x.topic", "x.content")
    return rows.where(F.col("topic_idx") >= start)


def direct_text(spark: SparkSession, topic: str, content: str) -> DataFrame:
    """One topic from a text at hand."""
    return spark.createDataFrame([(1, topic, content)], "topic_idx int, topic string, content string")


def extracted_topics(spark: SparkSession, path: str) -> DataFrame:
    """file, topic, content of JSON files with sentences that were extracted before; the topic is the file name up to its first point."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", "sentences array<string>", LONG).alias("x"))
    return files.select("file", F.split_part("file", F.lit("."), F.lit(1)).alias("topic"), topic_content(F.coalesce("x.sentences", F.array())).alias("content"))


def graph_json(spark: SparkSession, path: str) -> DataFrame:
    """file, kg (entities and relations, arrays of variants): once or twice encoded JSON; what can't be read is an empty graph."""
    return _graphs(spark.read.option("pathGlobFilter", "*.json").option("ignoreMissingFiles", "true").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value"))


def graph_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, kg of what write_graph_json wrote: a graph a line, each graph's name in its folder's."""
    return _graphs(spark.read.schema("value string, file string").text(path))


def _graphs(files: DataFrame) -> DataFrame:
    """kg of the texts in value. Each entity and relation is a variant of its own, as a variant has 128 MB at most, which a whole graph may pass."""
    inner = F.get(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>", LONG), 0)
    once = files.select("file", F.when(F.trim("value").startswith('"'), inner).otherwise(F.col("value")).alias("value"))
    kg = F.from_json("value", "entities array<variant>, relations array<variant>", LONG | {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"})
    return once.select("file", F.when(F.col("value").rlike(r"^\s*\{"), kg).alias("kg"))  # of a list, from_json would take the first


def relations(graphs: DataFrame, objects_only: bool = False) -> DataFrame:
    """file, ord, head, relation, tail, description: lists of 3 or 4, or objects under their several names.

    objects_only leaves lists out, as the cleaning package does.
    """
    r = graphs.select("file", F.posexplode(F.coalesce("kg.relations", F.array())).alias("ord", "r"))
    kind = F.schema_of_variant("r")
    r = r.where(kind.startswith("OBJECT") if objects_only else kind.startswith("OBJECT") | kind.startswith("ARRAY"))
    pick = lambda i, *names: F.coalesce(F.try_variant_get("r", f"$[{i}]", "string"), *[F.nullif(F.try_variant_get("r", f"$.{n}", "string"), F.lit("")) for n in names], F.lit(""))
    return r.select("file", "ord", pick(0, "from", "head", "subject").alias("head"), pick(1, "type", "relation", "predicate").alias("relation"), pick(2, "to", "tail", "object").alias("tail"), pick(3, "description").alias("description"))


def entities(graphs: DataFrame, objects_only: bool = False) -> DataFrame:
    """file, ord, name, type, description, attributes: texts or objects; objects_only leaves texts out. Missing attributes are null."""
    e = graphs.select("file", F.posexplode(F.coalesce("kg.entities", F.array())).alias("ord", "e"))
    get = lambda n: F.try_variant_get("e", f"$.{n}", "string")
    plain = F.schema_of_variant("e") == "STRING"
    e = e.where(F.schema_of_variant("e").startswith("OBJECT")) if objects_only else e
    attributes = F.try_variant_get("e", "$.attributes", "map<string,string>")
    return e.select("file", "ord", F.when(plain, F.try_variant_get("e", "$", "string")).otherwise(get("name")).alias("name"), get("type").alias("type"), get("description").alias("description"), attributes.alias("attributes"))


def repr_graphs(spark: SparkSession, path: str) -> DataFrame:
    """file, entities, relations of dumps such as entities={...} edges={...} relations={(a, r, b)}: sorted, as sets have no order."""

    @F.pandas_udf("entities array<string>, relations array<array<string>>")
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_dump(t) for t in texts], columns=["entities", "relations"], dtype=object)

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), read("value").alias("x"))
    return files.select("file", "x.*")


def _dump(text: str) -> tuple[list[str], list[list[str]]]:
    """Entities and relations of one dump; a part that can't be read is empty."""
    parts = {}
    for name, body in re.findall(r"(entities|relations)=(\{.*?\})(?=\s+\w+=|\s*$)", text, re.DOTALL):
        try:
            value = ast.literal_eval(body)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            value = set()
        parts[name] = value if isinstance(value, set) else set()
    return sorted(map(str, parts.get("entities", ()))), sorted([str(x) for x in r] for r in parts.get("relations", ()) if isinstance(r, tuple))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; lines that can't be read are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def lexicon(spark: SparkSession, path: str, columns: list[str], key: str = "name") -> DataFrame:
    """ord, columns, key (the name in lower case) of a CSV file with a header; columns that the file lacks are null.

    ord is the row's place, in files and rows as read. A file that doesn't exist gives no rows. A missing name is the text nan, as
    existing lexicons have it; a name of blanks is left out.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], "ord long, " + ", ".join(f"`{c}` string" for c in columns) + ", key string")
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    rows = rows.withColumnsRenamed({c: c.removeprefix("\ufeff") for c in rows.columns})
    own = rows.select(F.monotonically_increasing_id().alias("ord"), *[F.col(f"`{c}`").alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])
    return own.withColumn("key", F.lower(F.regexp_replace(F.coalesce(key, F.lit("nan")), SPACE, ""))).where("key <> ''")


def pipe_table(spark: SparkSession, path: str, columns: dict[int, str], width: int) -> DataFrame:
    """Chosen columns of a table parted by | without quotes or header."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    rows = spark.read.schema(schema).csv(path, sep="|", quote="")
    return rows.select(*[F.col(f"c{i}").alias(name) for i, name in columns.items()])


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def write_graph_json(entities_: DataFrame, relations_: DataFrame, path: str, by: str = "file", twice: bool = False) -> None:
    """One JSON line for each graph; quotes ' in text values become \". twice: each line is the JSON text of the graph's JSON.

    Columns entities (objects, with attributes if there are any) and relations (lists of 4) are in the order of ord.
    """
    e, r = canonical(entities_.drop(by)).columns, ("head", "relation", "tail", "description")
    own = canonical(entities_.select(F.col(by).alias("_by"), *e)), canonical(relations_.select(F.col(by).alias("_by"), "ord", *r))
    parts = [c for c in ("name", "type", "description", "attributes") if c in e]
    left = own[0].groupBy("_by").agg(F.array_sort(F.collect_list(F.struct("ord", F.to_json(F.struct(*parts)).alias("j")))).alias("e"))
    right = own[1].groupBy("_by").agg(F.array_sort(F.collect_list(F.struct("ord", F.to_json(F.array(*r)).alias("j")))).alias("r"))
    listed = lambda c: F.array_join(F.transform(F.coalesce(c, F.array()), lambda x: x["j"]), ",")
    both = left.join(right, "_by", "full")
    graph = F.concat(F.lit('{"entities":['), listed("e"), F.lit('],"relations":['), listed("r"), F.lit("]}"))
    line = F.regexp_extract(F.to_json(F.array(graph)), r"(?s)^\[(.*)\]$", 1) if twice else graph
    both.select(line.alias("value"), F.col("_by").alias("file")).write.partitionBy("file").text(path)


def append_traces(rows: DataFrame, path: str) -> None:
    """Add the rows as JSON lines to what is there."""
    rows.write.mode("append").json(path)


def write_types(rows: DataFrame, column: str, path: str) -> None:
    """The different values, sorted, one a line."""
    rows.select(F.col(column).alias("value")).where("value is not null").distinct().orderBy("value").coalesce(1).write.text(path)


def lines_as_array(spark: SparkSession, path: str) -> DataFrame:
    """file, json: the JSON lines of each file as one JSON list; lines that can't be read are left out."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split("value", "\r?\n").alias("lines"))
    good = F.filter("lines", lambda x: F.try_parse_json(x).isNotNull())
    return files.select("file", F.concat(F.lit("["), F.array_join(good, ","), F.lit("]")).alias("json"))


# Colours of the categories in a graph view.
COLOURS = ["#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf", "#393b79", "#637939", "#8c6d31", "#843c39", "#7b4173", "#3182bd", "#e6550d", "#31a354", "#756bb1"]


def graph_view(nodes: DataFrame, relations_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, caption, size, color, properties) and relations (id, source, target, caption, properties) as a viewer draws them."""
    category, colours = F.col("props")["top_level_category"], dict(zip(TOP_CATEGORIES, COLOURS))
    colour: Column = F.coalesce(*[F.when(category == k, F.lit(c)) for k, c in colours.items()])
    drawn = nodes.select("id", F.coalesce(F.col("props")["name"], F.lit("")).alias("caption"), F.lit(15).alias("size"), colour.alias("color"), F.col("props").alias("properties"))
    return drawn, relations_.select("id", "source", "target", F.col("type").alias("caption"), F.col("props").alias("properties"))


def write_graph_view(nodes: DataFrame, relations_: DataFrame, path: str) -> None:
    """The view's nodes and relations as JSON lines in two folders below path, which any graph page can load."""
    for name, rows in zip(("nodes", "relationships"), graph_view(nodes, relations_)):
        rows.write.json(f"{path}/{name}")


def property_graph(spark: SparkSession, nodes_path: str, relations_path: str) -> tuple[DataFrame, DataFrame]:
    """nodes(id, labels, props) and relations(id, type, source, target, props) of a graph database's export in JSON lines."""
    nodes = spark.read.schema("id string, labels array<string>, props map<string,string>").json(nodes_path)
    return nodes, spark.read.schema("id string, type string, source string, target string, props map<string,string>").json(relations_path)


def terminology(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a terminology below path, tab-separated with a header: concepts(concept_id, fsn), descriptions(ord, term, concept_id, fsn), is_a(child, parent)."""
    schemas = {"concepts": "concept_id long, fsn string", "descriptions": "ord long, term string, concept_id long", "is_a": "child long, parent long"}
    out = {name: spark.read.schema(schema).csv(f"{path}/{name}", sep="\t", header=True, quote="") for name, schema in schemas.items()}
    return out | {"descriptions": out["descriptions"].join(out["concepts"], "concept_id", "left")}


def page_words(spark: SparkSession, path: str, provider) -> DataFrame:
    """file, page, ord, word, x0, x1, top, width, height of documents that the provider opens."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file"), "content")
    words = files.select("file", F.posexplode(providers.page_words(provider)("content")).alias("ord", "w"))
    return words.select("file", "w.page", "ord", "w.word", "w.x0", "w.x1", "w.top", "w.width", "w.height")


def page_texts(words: DataFrame, columns: int = 1, margin: float = 0.0) -> DataFrame:
    """file, page, text: words line by line, of one column after the other; those within margin of the page's top or bottom are left out.

    Words of a line have the same top to the nearest point; a word belongs to the column in which its middle lies.
    """
    column = F.least(F.floor((F.col("x0") + F.col("x1")) / 2 / (F.col("width") / columns)), F.lit(columns - 1)).cast("int")
    inside = words.where((F.col("top") >= margin) & (F.col("top") <= F.col("height") - margin)).withColumn("column", column)
    line = inside.groupBy("file", "page", "column", F.round("top").alias("top")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "ord", "word"))), lambda x: x["word"]), " ").alias("line"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", "top", "line"))), lambda x: x["line"]), "\n")
    return line.groupBy("file", "page").agg(texts.alias("text"))


def json_any(spark: SparkSession, path: str) -> DataFrame:
    """file, ord, row (variant): the lines of a file if each is JSON, else its whole text as one value or array; what can't be read gives no row."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")
    parsed = F.transform(lines, F.try_parse_json)
    whole = F.try_parse_json("value")
    rows = F.when(F.forall(parsed, lambda x: x.isNotNull()) & (F.size(lines) > 1), parsed).otherwise(F.coalesce(F.try_variant_get(whole, "$", "array<variant>"), F.array(whole)))
    return files.select("file", F.posexplode(rows).alias("ord", "row")).where("row is not null")


def graph_tables(spark: SparkSession, entities_path: str, relations_path: str) -> tuple[DataFrame, DataFrame]:
    """Distinct titles, and head, tail, relation of Parquet tables of a community graph."""
    nodes = spark.read.parquet(entities_path).select(F.col("title").alias("name")).distinct()
    return nodes, spark.read.parquet(relations_path).select(F.col("source").alias("head"), F.col("target").alias("tail"), F.col("description").alias("relation"))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header, each file marked as UTF-8 by a leading byte order mark."""
    first, *others = rows.columns
    rows.select(F.col(f"`{first}`").alias(f"\ufeff{first}"), *[F.col(f"`{c}`") for c in others]).write.mode("overwrite").csv(path, header=True, escape='"')
