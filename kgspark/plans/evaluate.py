"""Evaluations from end to end: facts that a graph's contexts hold, and a graph against a reference graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark import providers
from kgspark.functions.text import embedded_text, relation_lines
from kgspark.operators import evaluation, graph, retrieval
from kgspark.staging import staged


def relation_vectors(relations: DataFrame, provider, *by: str) -> DataFrame:
    """by, relation, v: each different relation of a graph once."""
    return relations.select(*by, "relation").distinct().withColumn("v", providers.embedding(provider)("relation"))


def retrieved(qa: DataFrame, entities: DataFrame, relations: DataFrame, provider, k: int = 8, depth: int = 2, flavour: str = "nodes") -> DataFrame:
    """topic, q_idx, answer, context of qa(topic, q_idx, answer): the lines about the k nodes nearest to the answer, in their order.

    entities(topic, ord, name, type, description) and relations(topic, ord, src, dst, relation, description) make a graph for each
    topic. Lines of a node are sorted; a question of a topic without a graph has an empty context. flavour: what a node's vector reads,
    "nodes" or "triples" (the name alone); triples give plain sentences and no lines about nodes.
    """
    embed = providers.embedding(provider)
    edges = staged(graph.digraph(relations, "topic"))
    nodes = staged(graph.nodes(entities, relations, "topic"))
    rows = staged(nodes.select("topic", F.struct("topic", "name").alias("id"), "place", embed(embedded_text(flavour)).alias("v")))
    asked = staged(qa.select("topic", F.struct("topic", "q_idx").alias("id"), embed(F.coalesce("answer", F.lit(""))).alias("v")))
    key = lambda c: F.to_json(c)
    text_ids = lambda d: d.withColumn("id", key(F.col("id")))
    top = staged(retrieval.top_within(text_ids(asked), text_ids(rows).withColumn("place", F.format_string("%d-%019d-%d", "place.step", "place.ord", "place.end")), "topic", k, order="place"))
    name = F.get_json_object("id", "$.name")
    q = top.select(F.get_json_object("query", "$.topic").alias("topic"), F.get_json_object("query", "$.q_idx").cast("int").alias("q_idx"), name.alias("start"), "rank")
    topic_kind = qa.schema["topic"].dataType
    q = q.withColumn("topic", F.col("topic").cast(topic_kind))
    lines = graph.context_lines(q.select("topic", "start").distinct(), edges, nodes if flavour == "nodes" else None, depth, ("topic",))
    per = lines.groupBy("topic", "start").agg(F.array_join(F.array_sort(F.collect_list("line")), " ").alias("text"))
    texts = q.join(per, ["topic", "start"]).groupBy("topic", "q_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("t"))
    return qa.join(texts, ["topic", "q_idx"], "left").select("topic", "q_idx", "answer", F.coalesce(F.array_join("t", " "), F.lit("")).alias("context"))


def retrieval_accuracy(qa: DataFrame, entities: DataFrame, relations: DataFrame, provider, **options) -> tuple[DataFrame, DataFrame]:
    """Results (topic, q_idx, correct_answer, retrieved_context, evaluation, error) and accuracy (topic, accuracy); see retrieved().

    A question that the provider can't judge has an error and counts as wrong.
    """
    found = staged(retrieved(qa, entities, relations, provider, **options))
    judged = found.withColumn("evaluation", providers.contains_answer(provider)("answer", "context"))
    error = F.when(F.col("evaluation").isNull(), F.lit("no verdict"))
    results = staged(judged.select("topic", "q_idx", F.col("answer").alias("correct_answer"), F.when(error.isNull(), F.col("context")).alias("retrieved_context"), "evaluation", error.alias("error")))
    return results, evaluation.accuracy(results, "topic", "evaluation")


def compare_graphs(std: tuple[DataFrame, DataFrame], own: tuple[DataFrame, DataFrame], provider, threshold: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Matches (dataid, std, found, similarity, relation_similarity) and scores (dataid, coverage, similarity, matched, total).

    Each graph is entities(dataid, name, type, description) and relations(dataid, ord, src, dst, relation, description). Of entities of a
    name the last by all columns counts. Each reference entity takes the first accepted entity in falling similarity; one entity may
    serve several. A graph without reference entities has no row in scores.
    """
    embed = providers.embedding(provider)
    sides = []
    for entities, relations in (std, own):
        e = entities.groupBy("dataid", "name").agg(F.max(F.struct("type", "description")).alias("x")).select("dataid", "name", "x.*")
        e = e.withColumn("id", F.to_json(F.struct("dataid", "name"))).withColumn("text", F.to_json(F.struct("name", "type", "description")))
        e = staged(e.withColumn("v", embed(embedded_text("reference"))))
        r = relations.select("dataid", "ord", "src", F.col("dst"), "relation", F.struct("ord", F.struct(F.col("src").alias("head"), "relation", F.col("dst").alias("tail"), F.coalesce("description", F.lit("")).alias("description")).alias("r")).alias("own"))
        lines = graph.incidence(r).groupBy("dataid", "node").agg(relation_lines(F.transform(F.array_sort(F.collect_list("own")), lambda x: x["r"])).alias("lines"))
        sides.append((e, lines))
    (e1, l1), (e2, l2) = sides
    every = retrieval.pairs_across(e1, e2, "dataid", threshold)
    both = every.join(e1.select(F.col("id").alias("a"), F.col("text").alias("left")), "a").join(e2.select(F.col("id").alias("b"), F.col("text").alias("right")), "b")
    accept = lambda x, y: [bool(providers.attempt(provider.same, a, b, failed=False)) for a, b in zip(_names(x), _names(y))]
    matched = staged(retrieval.greedy_matches(both.select(F.col("a").alias("std"), F.col("b").alias("found"), "similarity", "left", "right"), accept))
    names = matched.join(e1.select(F.col("id").alias("std"), "dataid", F.col("name").alias("s")), "std").join(e2.select(F.col("id").alias("found"), F.col("name").alias("f")), "found")
    told = lambda lines, name, to: lines.select("dataid", F.col("node").alias(name), F.col("lines").alias(to))
    with_lines = names.join(told(l1, "s", "x"), ["dataid", "s"], "left").join(told(l2, "f", "y"), ["dataid", "f"], "left")
    none = F.lit("No relationships")
    scored = with_lines.withColumn("relation_similarity", providers.relation_similarity(provider)(F.coalesce("x", none), F.coalesce("y", none)))
    matches = staged(scored.select("dataid", F.col("s").alias("std"), F.col("f").alias("found"), F.round("similarity", 6).alias("similarity"), "relation_similarity"))
    totals = e1.groupBy("dataid").agg(F.count("*").alias("total")).join(matches.groupBy("dataid").agg(F.count("*").alias("matched"), F.avg("relation_similarity").alias("mean")), "dataid", "left")
    n = F.coalesce("matched", F.lit(0))
    return matches, totals.select("dataid", F.round(n / F.col("total"), 4).alias("coverage"), F.round(F.coalesce("mean", F.lit(0.0)), 4).alias("similarity"), n.alias("matched"), "total")


def _names(texts: list[str]) -> list[str]:
    import json

    return [json.loads(t).get("name", "") for t in texts]
