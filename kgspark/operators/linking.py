"""Names translated and linked to the concepts of a terminology, on tables.

A terminology's tables, and what comes of them, are larger than their files tell: joins with them are merge joins by a hint, as a
broadcast goes by the files' size and takes the driver's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.functions.text import SPACE, falsy, last_tag
from kgspark.operators.graph import first_wins
from kgspark.staging import staged


def _trim(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), SPACE, "")


def work_list(entities: DataFrame, overwrite: bool = False) -> DataFrame:
    """Entities that need a standard name: they have a name and, unless all are done anew, no standard name yet."""
    rows = entities.where(_trim("name") != "")
    if overwrite or "entity_name_standard" not in entities.columns:
        return rows
    return rows.where(_trim("entity_name_standard") == "")


def translated(entities: DataFrame, translate: Column, overwrite: bool = False) -> DataFrame:
    """Entities with entity_name_standard and error (null where all went well).

    translate is an expression over a column name that gives struct<text, error>; it is asked once for each different
    name, not for each row. Where it fails the old standard name, or an empty one, stays.
    """
    old = F.col("entity_name_standard") if "entity_name_standard" in entities.columns else F.lit(None).cast("string")
    names = work_list(entities, overwrite).select(_trim("name").alias("name")).distinct()
    asked = names.withColumn("_t", translate).select(F.col("name").alias("_name"), F.col("_t.text").alias("_text"), F.col("_t.error").alias("error"))
    due = _trim("name") != "" if overwrite else (_trim("name") != "") & (falsy(F.regexp_replace(F.coalesce(old, F.lit("")), SPACE, "")).isNull())
    both = entities.drop("error").withColumn("_due", due).join(asked, (_trim("name") == F.col("_name")) & F.col("_due"), "left")
    return both.withColumn("entity_name_standard", F.when(F.col("_due"), F.coalesce("_text", old, F.lit(""))).otherwise(old)).drop("_due", "_name", "_text")


def term_contains(descriptions: DataFrame, q: str) -> DataFrame:
    """term, concept_id of the descriptions whose term holds the text."""
    return descriptions.where(F.contains("term", F.lit(q))).select("term", "concept_id")


def term_equals(descriptions: DataFrame, q: str) -> DataFrame:
    return descriptions.where(F.col("term") == q).select("term", "concept_id")


def tagged_count(descriptions: DataFrame, q: str, tag: str) -> DataFrame:
    """n: the active descriptions that hold the text in any case and whose concept's full name ends with the tag."""
    rows = descriptions.where(F.contains(F.lower("term"), F.lit(q.lower())) & (last_tag(F.col("fsn")) == tag))
    return rows.agg(F.count("*").alias("n"))


def by_ids(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of the ids asked for, one join for all."""
    return rows.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def search(names: DataFrame, descriptions: DataFrame) -> DataFrame:
    """name, concept_id, fsn, term: for each name the first description (by ord) that holds all its words, in any case.

    descriptions(ord, term, concept_id, fsn). A name meets only the descriptions that hold its rarest word, and of those with the same
    words the first. Names without a hit have no row.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\W+"), lambda x: x != ""))
    q = names.select("name").distinct().withColumn("_w", words(F.col("name"))).where("size(_w) > 0")
    sets = descriptions.withColumn("_d", F.array_sort(words(F.col("term")))).groupBy("_d")
    d = sets.agg(F.min_by(F.struct("concept_id", "fsn", "term"), "ord").alias("_x"), F.min("ord").alias("ord")).withColumn("_key", F.explode("_d"))
    known = d.groupBy("_key").agg(F.count("*").alias("_n"))
    each = q.select("name", "_w", F.explode("_w").alias("_key")).join(known.hint("merge"), "_key")
    rarest = each.groupBy("name", "_w").agg(F.count("*").alias("_held"), F.min_by("_key", F.struct("_n", "_key")).alias("_key")).where(F.col("_held") == F.size("_w"))
    both = rarest.join(d.hint("merge"), "_key").where(F.size(F.array_except("_w", "_d")) == 0)
    best = both.groupBy("name").agg(F.min_by("_x", "ord").alias("x"))
    return best.select("name", "x.*")


def aligned(entities: DataFrame, descriptions: DataFrame, is_a: DataFrame, tops: DataFrame) -> DataFrame:
    """Entities with align_entity (struct, null without a hit), align_entity_type and top_level_category ('' where there is none).

    is_a(child, parent) over concept ids; tops(concept_id, category). The category is that of the smallest top-level id among the
    ancestors of the first hit; the type is what stands in the last brackets of its full name.
    """
    hit = staged(search(entities.select(_trim("entity_name_standard").alias("name")).where("name <> ''"), descriptions))
    up = ancestors(hit, is_a).join(tops.withColumnRenamed("concept_id", "ancestor"), "ancestor")
    top = up.groupBy("concept_id").agg(F.min_by("category", "ancestor").alias("category"))
    found = hit.join(top.hint("merge"), "concept_id", "left").select(F.col("name").alias("_name"), F.struct("concept_id", "fsn", "term").alias("align_entity"), last_tag(F.col("fsn")).alias("_tag"), F.coalesce("category", F.lit("")).alias("_category"))
    both = entities.join(found.hint("merge"), _trim("entity_name_standard") == F.col("_name"), "left")
    return both.withColumns({"align_entity_type": F.coalesce("_tag", F.lit("")), "top_level_category": F.coalesce("_category", F.lit(""))}).drop("_name", "_tag", "_category")


def ancestors(concepts: DataFrame, is_a: DataFrame) -> DataFrame:
    """concept_id, ancestor: all ancestors of the concepts asked for, at any distance, over is_a(child, parent); cycles end by themselves."""
    up = is_a.select(F.col("child").alias("_c"), F.col("parent").alias("ancestor")).hint("merge")
    step = concepts.select("concept_id").where("concept_id is not null").distinct().join(up, F.col("concept_id") == F.col("_c")).select("concept_id", "ancestor")
    found = step = staged(step.where("ancestor is not null").distinct())
    while not step.isEmpty():
        on = step.withColumnRenamed("ancestor", "_c").join(up, "_c").select("concept_id", "ancestor").where("ancestor is not null").distinct()
        step = staged(on.join(found.hint("merge"), ["concept_id", "ancestor"], "left_anti"))
        found = staged(found.unionByName(step))
    return found


def entities_of(values: DataFrame, by: list[str], column: str = "value") -> DataFrame:
    """by, ord, entity (variant): all objects with a text name in a variant of lists within lists, in order; ord is an array of places.

    Objects are not searched further. Each round opens one level; it ends when a level holds no list.
    """
    kind = lambda c: F.schema_of_variant(c)
    level = values.select(*by, F.array().cast("array<int>").alias("ord"), F.col(column).alias("_v"))
    out = None
    while True:
        own = level.where(kind("_v").startswith("OBJECT") & (kind(F.try_variant_get("_v", "$.name", "variant")) == "STRING")).select(*by, "ord", F.col("_v").alias("entity"))
        out = own if out is None else out.unionByName(own)
        lists = level.where(kind("_v").startswith("ARRAY"))
        if lists.isEmpty():
            return out
        items = lists.select(*by, "ord", F.posexplode(F.try_variant_get("_v", "$", "array<variant>")).alias("_at", "_v"))
        level = items.select(*by, F.concat("ord", F.array("_at")).alias("ord"), "_v").where("_v is not null")


def first_descriptions(descriptions: DataFrame) -> DataFrame:
    """One description for each term in lower case, the first by ord."""
    return first_wins(descriptions.withColumn("key", F.lower("term")), "key", "ord")
