"""Type cleaning of entities: demotion, reports, verbalisation, lexicons."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions import typing_rules
from kgspark.functions.profiles import PACKAGE, Profile
from kgspark.functions.text import SPACE, falsy, type_label


def type_counts(rows: DataFrame, column: str = "type") -> DataFrame:
    return rows.where(falsy(F.col(column)).isNotNull()).groupBy(F.col(column).alias("type")).agg(F.count("*").alias("n"))


def long_tail_cut(counts: DataFrame, share: float = 0.2, least: int = 5) -> DataFrame:
    """One row, cut: the count at place floor(n * share) in ascending order, least at the minimum.

    Counts are grouped by value first, so the window holds one row for each different count.
    """
    c = counts.groupBy("n").agg(F.count("*").alias("types"))
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = c.withColumn("upto", F.sum("types").over(w)).withColumn("place", F.floor(F.sum("types").over(whole) * share))
    return c.where(F.col("upto") > F.col("place")).agg(F.greatest(F.coalesce(F.min("n"), F.lit(least)), F.lit(least)).alias("cut"))


def demote_long_tail(rows: DataFrame, profile: Profile = PACKAGE, column: str = "type", parent: Column | None = None) -> DataFrame:
    """Rare and over-specific types become their parent; the type goes to subTypeLabel, the reason to demoted_reason.

    Counts are those before any demotion here; an empty type and Thing stay. Columns subTypeLabel and demoted_reason keep what they hold.
    """
    counts = type_counts(rows, column)
    rare = counts.join(F.broadcast(long_tail_cut(counts)), F.col("n") <= F.col("cut"), "inner").select(F.col("type").alias(column), F.lit(True).alias("_rare"))
    hit = F.col("_rare").isNotNull() & typing_rules.is_fine_grained(F.col(column), profile) & (F.col(column) != "Thing")
    old = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    new = {"subTypeLabel": F.when(hit, F.col(column)).otherwise(old("subTypeLabel")), "demoted_reason": F.when(hit, F.lit("long_tail_fine_grained")).otherwise(old("demoted_reason")), column: F.when(hit, typing_rules.suggest_parent(F.col(column), profile) if parent is None else parent).otherwise(F.col(column))}
    return rows.join(rare, column, "left").withColumns(new).drop("_rare")


def normalize_entities(entities: DataFrame, profile: Profile = PACKAGE) -> DataFrame:
    """Names trimmed, type labels normalised, labels of figures and the like demoted; type_original keeps the type as it was."""
    kind = F.col("type")
    own = typing_rules.cleaned_type(kind, type_label(F.regexp_replace(kind, SPACE, "")), profile)
    return entities.withColumns({**own, "name": F.regexp_replace("name", SPACE, "")})


def type_report(entities: DataFrame, profile: Profile, examples: int = 35, order: str = "ord") -> DataFrame:
    """type, n, is_long_tail, is_fine_grained, suggested_parent, example_entities (names joined by "; "): types as they are, not normalised."""
    counts = type_counts(entities)
    names = first_n(entities.where(falsy(F.col("type")).isNotNull()).withColumn("_name", F.coalesce("name", F.lit(""))), "type", "_name", order, examples)
    both = counts.join(F.broadcast(long_tail_cut(counts)), F.lit(True)).join(names, "type", "left")
    kind = F.col("type")
    rows = both.select("type", "n", (F.col("n") <= F.col("cut")).alias("is_long_tail"), typing_rules.is_fine_grained(kind, profile).alias("is_fine_grained"), typing_rules.suggest_parent(kind, profile).alias("suggested_parent"), F.array_join("values", "; ").alias("example_entities"))
    return rows.orderBy(F.desc("is_long_tail"), F.desc("is_fine_grained"), "n", "type")


def report_summary(report: DataFrame, cut: DataFrame) -> DataFrame:
    """metric, value of a report and its one-row cut."""
    flags = {"num_long_tail": F.col("is_long_tail"), "num_fine_grained": F.col("is_fine_grained"), "num_both": F.col("is_long_tail") & F.col("is_fine_grained")}
    one = report.agg(F.count("*").alias("total_types"), *[F.count_if(c).alias(k) for k, c in flags.items()])
    one = one.join(F.broadcast(cut.select(F.col("cut").cast("long").alias("long_tail_cut_value"))), F.lit(True))
    return one.unpivot([], ["total_types", "long_tail_cut_value", *flags], "metric", "value")


def first_n(rows: DataFrame, key: str, value: str, order: str, n: int) -> DataFrame:
    """key, values: the first n values in order. Only n rows of a key leave the window."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order, value))
    top = rows.withColumn("_place", place).where(F.col("_place") <= n)
    return top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_place", F.col(value).alias("v")))).alias("x")).select(key, F.transform("x", lambda x: x["v"]).alias("values"))


def verbalize(entities: DataFrame, relations: DataFrame, most: int = 3, attributes: int = 5) -> DataFrame:
    """Adds verbalization to entities(name, type, description, attributes map) from relations(ord, type, from, to).

    Pieces that are empty are left out; a relation's missing part reads None. The first relations by ord count, out of the entity and into it.
    """
    part = lambda c: F.coalesce(F.col(c), F.lit("None"))
    triple = F.concat(part("from"), F.lit(" --"), part("type"), F.lit("--> "), part("to"))
    r = relations.select("ord", "from", "to", triple.alias("triple"))
    sides = {}
    for side in ("from", "to"):
        own = first_n(r.where(falsy(F.col(side)).isNotNull()), side, "triple", "ord", most)
        sides[side] = own.select(F.col(side).alias("_key"), F.array_join("values", "; ").alias(f"_{side}"))
    name, kind = (F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, "") for c in ("name", "type"))
    out = entities.withColumn("_key", name)
    for own in sides.values():
        out = out.join(own, "_key", "left")
    pairs = F.slice(F.map_entries("attributes"), 1, attributes) if "attributes" in entities.columns else F.array()
    kv = F.array_join(F.transform(pairs, lambda x: F.concat(x["key"], F.lit(": "), F.coalesce(x["value"], F.lit("None")))), "; ") if "attributes" in entities.columns else F.lit(None).cast("string")
    told = lambda before, c, after="": F.concat(F.lit(before), falsy(c), F.lit(after))
    pieces = [falsy(F.col("_key")), told("（类型：", kind, "）"), falsy(F.col("description")), told("关联: ", F.col("_from")), told("被关联: ", F.col("_to")), told("属性: ", kv)]
    return out.withColumn("verbalization", F.concat_ws("；", *pieces)).drop("_key", "_from", "_to")


def _elements(c: Column) -> Column:
    """Each character with its running number, rarest first: later repeats of a character before first ones."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    numbered = F.transform(chars, lambda x, i: F.struct((-F.size(F.filter(F.slice(chars, 1, i + 1), lambda y: y == x))).alias("n"), F.xxhash64(x).alias("h")))
    return F.array_sort(numbered)


def exact_then_fuzzy(names: DataFrame, lexicon: DataFrame, threshold: float = 0.95) -> DataFrame:
    """name, ord (of the best record or null), score: exact lower-cased match first, else the best ratio.

    A ratio is twice the matching characters over both lengths, so it reaches the threshold only where
    the characters, counted with repeats, overlap enough. Two such lists, sorted alike, share one of
    their first few elements: candidates meet there, by equality, then pass the bounds on lengths and on the
    whole overlap, and only those that pass are compared in full. All bounds are exact. Empty names match nothing.
    """
    lex = lexicon.select(F.lower(F.trim("name")).alias("key"), "ord").where("key <> ''").groupBy("key").agg(F.min("ord").alias("ord"))
    own = names.select("name", F.lower(F.trim("name")).alias("key")).distinct()
    exact = own.join(lex, "key", "left")
    hit = exact.where("ord is not null").select("name", "ord", F.lit(1.0).alias("score"))

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])

    def with_prefix(rows: DataFrame, end: str) -> DataFrame:
        size = F.length("key")
        first = (size - F.ceil(size * (threshold / (2 - threshold)) - 1e-9) + 1).cast("int")
        rows = rows.select("*", size.alias("size"), _elements(F.col("key")).alias("e")).select("*", F.explode(F.slice("e", 1, first)).alias("at"))
        return rows.withColumnsRenamed({c: f"{c}_{end}" for c in rows.columns if c != "at"})

    left = exact.where("ord is null").select("name", "key")
    a, b = with_prefix(left.where("key <> ''").select("key").distinct(), "a"), with_prefix(lex, "b")
    need = (F.col("size_a") + F.col("size_b")) * threshold / 2 - 1e-9
    pairs = a.join(b, "at").where(F.least("size_a", "size_b") >= need).where(F.size(F.array_intersect("e_a", "e_b")) >= need)
    pairs = pairs.select("key_a", "key_b", "ord_b").distinct()
    scored = pairs.withColumn("score", ratio("key_a", "key_b")).where(F.col("score") >= threshold)
    best = scored.groupBy(F.col("key_a").alias("key")).agg(F.max_by(F.struct(F.col("ord_b").alias("ord"), "score"), F.struct("score", -F.col("ord_b"))).alias("x"))
    rest = left.join(best, "key", "left").select("name", F.col("x.ord").alias("ord"), F.coalesce("x.score", F.lit(0.0)).alias("score"))
    return hit.unionByName(rest)


def with_records(entities: DataFrame, lexicon: DataFrame, columns: dict[str, Column], source: str, threshold: float = 0.95) -> DataFrame:
    """Sets columns (expressions over the record's, prefixed by rec.) where a name has a record in lexicon(name, ord, ...)."""
    best = exact_then_fuzzy(entities.select("name").where(falsy(F.col("name")).isNotNull()), lexicon, threshold).where("ord is not null")
    rec = lexicon.select(F.col("ord").alias("_ord"), F.struct(*[c for c in lexicon.columns if c not in ("name", "ord")]).alias("rec"))
    got = best.join(rec, F.col("ord") == F.col("_ord")).select(F.col("name").alias("_name"), "rec")
    both = entities.join(got, F.col("name") == F.col("_name"), "left")
    old = lambda c: F.col(c) if c in entities.columns else F.lit(None).cast("string")
    new = {c: F.when(F.col("rec").isNotNull(), x).otherwise(old(c)) for c, x in columns.items()}
    new[source] = F.when(F.col("rec").isNotNull(), F.lit(f"lexicon-{source.removesuffix('_source').replace('umls_semantic_type', 'umls-st').replace('_', '-')}")).otherwise(old(source))
    return both.withColumns(new).drop("_name", "rec")


def apply_lexicons(entities: DataFrame, semantic: DataFrame | None = None, concepts: DataFrame | None = None, snomed: DataFrame | None = None, threshold: float = 0.95) -> DataFrame:
    """Semantic types, concept and clinical codes of names; each lexicon has name, ord and its own columns, the first record of a name counts."""
    out = entities.withColumn("umls_semantic_type", typing_rules.semantic_type(F.col("type")))
    if semantic is not None:
        out = with_records(out, semantic, {"umls_semantic_type": F.col("rec.semantic_type")}, "umls_semantic_type_source", threshold)
    if concepts is not None:
        out = with_records(out, concepts, {"umls_cui": F.col("rec.cui"), "umls_pref_label": F.col("rec.pref_label")}, "umls_cui_source", threshold)
    if snomed is not None:
        out = with_records(out, snomed, {"snomed_id": F.col("rec.snomed_id"), "snomed_fsn": F.col("rec.fsn")}, "snomed_source", threshold)
    missing = [c for c in ("umls_cui", "umls_pref_label", "snomed_id", "snomed_fsn") if c not in out.columns]
    return out.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else out


def unmapped(entities: DataFrame) -> DataFrame:
    """Entities without a semantic type, or with neither of the codes."""
    none = lambda c: falsy(F.col(c)).isNull()
    rows = entities.where(none("umls_semantic_type") | (none("umls_cui") & none("snomed_id")))
    return rows.select("name", "type", "umls_semantic_type", F.coalesce("description", F.lit("")).alias("desc"), F.coalesce("verbalization", F.lit("")).alias("verbalization"))


def summary(entities: DataFrame, relations: DataFrame, column: str = "type", cut: DataFrame | None = None) -> DataFrame:
    """metric, value: entities, relations, different types, long-tail cut (of these types unless one is given)."""
    kinds = entities.agg(F.count("*").alias("entities"), F.count_distinct(falsy(F.col(column))).alias("types"))
    cut = (long_tail_cut(type_counts(entities, column)) if cut is None else cut).select(F.col("cut").cast("long").alias("cut"))
    one = kinds.join(F.broadcast(relations.agg(F.count("*").alias("relations"))), F.lit(True)).join(F.broadcast(cut), F.lit(True))
    return one.unpivot([], ["entities", "relations", "types", "cut"], "metric", "value")


def clean(entities: DataFrame, relations: DataFrame, profile: Profile = PACKAGE, **lexicons: DataFrame) -> dict[str, DataFrame]:
    """The cleaning from end to end: entities, relations, summary, type_counts and unmapped tables.

    Types are counted after labels are normalised and figures demoted, and before the long tail is; texts and
    semantic types come from the types after it.
    """
    first = normalize_entities(entities, profile)
    cut = long_tail_cut(type_counts(first))
    out = verbalize(demote_long_tail(first, profile), relations)
    out = apply_lexicons(out, threshold=profile.threshold, **lexicons)
    return {"entities": out, "relations": relations, "summary": summary(out, relations, cut=cut), "type_counts": type_counts(out), "unmapped": unmapped(out)}


def concept_lexicon(names: DataFrame, semantic: DataFrame, language: str) -> DataFrame:
    """Lexicon of a language from concept names(cui, lat, sab, tty, code, str) and semantic types(cui, tui, sty): every name's row."""
    kinds = semantic.groupBy("cui").agg(*[F.array_join(F.array_sort(F.collect_set(c)), ";").alias(c) for c in ("tui", "sty")])
    own = names.where(F.col("lat") == language).join(kinds, "cui", "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return own.select(F.lower(F.regexp_replace("str", SPACE, "")).alias("name"), "cui", F.lit("").alias("pref_label"), empty("sty").alias("semantic_type"), empty("tui").alias("tui"), "sab", "tty", "code")


def semantic_lexicon(concepts: DataFrame) -> DataFrame:
    """name, semantic_type, tui: the sorted distinct parts of all its rows' ;-lists."""
    joined = lambda c: F.array_join(F.array_sort(F.array_remove(F.array_distinct(F.flatten(F.collect_set(F.split(c, ";")))), "")), ";").alias(c)
    return concepts.groupBy("name").agg(joined("semantic_type"), joined("tui"))


def clinical_lexicon(concepts: DataFrame) -> DataFrame:
    """The rows whose source starts with SNOMEDCT, under the names that the mapping reads."""
    own = concepts.where(F.coalesce(F.col("sab").startswith("SNOMEDCT"), F.lit(False)))
    return own.select("name", F.col("code").alias("snomed_id"), F.lit("").alias("fsn"), F.lit("").alias("semantic_tag"), "cui", "tui", "semantic_type")
