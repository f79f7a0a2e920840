"""Cleaning of graph files from end to end: several files in, tables and reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.functions.profiles import PACKAGE, Profile
from kgspark.operators import cleaning
from kgspark.sources import readers

#: Columns that each lexicon file may have.
LEXICONS = {"semantic": ["name", "semantic_type", "tui"], "concepts": ["name", "cui", "pref_label", "semantic_type", "tui", "sab", "tty", "code"], "snomed": ["name", "snomed_id", "fsn", "semantic_tag", "cui", "tui", "semantic_type"]}


def load(spark: SparkSession, *paths: str, objects_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """Entities (ord, name, type, description, attributes) and relations (ord, type, from, to) of all files, in the order of paths and files.

    Missing and broken files are empty graphs. objects_only: relations that are lists don't count, as in the package's own cleaning.
    """
    parts = [readers.graph_json(spark, p).withColumn("at", F.lit(k)) for k, p in enumerate(paths) if readers.exists(spark, p)]
    if not parts:
        none = "ord string, name string, type string, description string, attributes map<string,string>"
        return spark.createDataFrame([], none), spark.createDataFrame([], "ord string, type string, `from` string, `to` string")
    graphs = parts[0]
    for g in parts[1:]:
        graphs = graphs.unionByName(g)
    files = graphs.withColumn("file", F.concat(F.format_string("%09d ", "at"), "file"))
    place = F.concat("file", F.format_string(" %012d", "ord"))
    e = readers.entities(files, objects_only=True).withColumn("ord", place).drop("file")
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    r = readers.relations(files, objects_only)
    return e, r.select(place.alias("ord"), empty("relation").alias("type"), empty("head").alias("from"), empty("tail").alias("to"))


def run(spark: SparkSession, inputs: list[str], out: str, profile: Profile = PACKAGE, objects_only: bool = True, **lexicons: str) -> dict[str, str]:
    """Clean the graphs of the input files and write what comes of it below out; returns the paths.

    lexicons: paths of CSV files by the names of LEXICONS; a file that doesn't exist maps nothing. Entities and relations are
    Parquet, the summary, the types' counts and the unmapped entities CSV with a byte order mark.
    """
    entities, relations = load(spark, *inputs, objects_only=objects_only)
    tables = cleaning.clean(entities, relations, profile, **{k: readers.lexicon(spark, p, LEXICONS[k]).drop("key") for k, p in lexicons.items()})
    paths = {}
    for name, table in tables.items():
        paths[name] = f"{out}/{name}.{'parquet' if name in ('entities', 'relations') else 'csv'}"
        if name in ("entities", "relations"):
            table.write.mode("overwrite").parquet(paths[name])
        else:
            readers.write_csv(table, paths[name])
    return paths


def by_position(rows: DataFrame, order: str, name: str = "topic_idx") -> DataFrame:
    """Adds the place (from 1) of each row in the order, by which lists that belong together position by position are joined.

    Meant for lists of files, a row each: they are numbered in one window.
    """
    return rows.withColumn(name, F.row_number().over(Window.orderBy(order)))
