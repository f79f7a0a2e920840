"""Graph construction from end to end: sentences, mentions, merged entities, contexts, subgraphs, graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark import providers
from kgspark.functions import text
from kgspark.operators import graph, retrieval
from kgspark.staging import resumed, staged


def construct(topics: DataFrame, provider, threshold: float = 0.6, k: int = 5, stages: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities (topic, name, type, description, attributes) and relations (topic, ord, at, head, relation, tail, description) of topics(topic, content).

    Rows with a null or empty content give nothing. Each provider stage is written once, so that no call is
    repeated. Mentions of the same name and type in a topic count as one before pairs are compared. stages: a folder in which a
    later run finds the stages that an earlier run finished, instead of asking again.
    """
    spark = topics.sparkSession
    stage = lambda name, df: resumed(df, spark, f"{stages}/{name}") if stages else staged(df)
    embed = providers.embedding(provider)
    chunks = topics.select(F.col("topic").cast("string"), F.posexplode(text.sentences(F.col("content"))).alias("ord", "sentence"))
    chunks = stage("chunks", chunks.withColumn("id", F.concat("topic", (F.col("ord") + 1).cast("string"))).withColumn("v", embed("sentence")))
    last = F.max_by("id", "ord").over(Window.partitionBy("topic", "sentence"))  # a sentence that comes again goes by its last id
    found = stage("mentions", chunks.select("topic", "ord", last.alias("chunk"), F.posexplode(providers.mentions(provider)("sentence")).alias("at", "m")))
    found = found.select("topic", "ord", "at", "chunk", "m.*").where(text.falsy(F.col("name")).isNotNull())
    number = F.row_number().over(Window.partitionBy("topic").orderBy("ord", "at"))
    numbered = found.select("topic", number.alias("ord"), "name", "type", "description", "chunk")
    own = F.min("ord").over(Window.partitionBy("topic", "name", "type"))
    key = lambda c: F.to_json(F.struct("topic", c.alias("ord")))
    entities = stage("entities", numbered.withColumn("id", key(F.col("ord"))).withColumn("first", key(own)))
    distinct = stage("distinct", entities.where("id = first").withColumn("v", embed(text.entity_text(F.col("name"), F.col("type")))))
    a, b = (distinct.select(F.col("id").alias(x), F.col("name").alias(f"name_{x}")) for x in "ab")
    near = retrieval.pairs_within(distinct, "topic", "ord", threshold).join(a, "a").join(b, "b")
    accepted = near.where(providers.same_entity(provider)("name_a", "name_b")).select("a", "b")
    repeats = entities.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    merged = graph.merge_components(entities, stage("pairs", accepted.unionByName(repeats)))
    merged = merged.withColumn("topic", F.get_json_object("root", "$.topic"))
    asked = merged.select("topic", F.col("root").alias("id"), embed("name").alias("v"))
    top = retrieval.top_within(asked, chunks.withColumnRenamed("ord", "place"), "topic", k, later_first=True, order="place")
    best = top.join(chunks.select("id", "topic", "sentence"), "id").join(asked.select(F.col("id").alias("query"), "topic"), ["query", "topic"])
    best = best.groupBy(F.col("query").alias("root")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sentence"))), lambda x: x["sentence"]).alias("top"))
    description = F.array_join("descriptions", ";;;")
    texts, _ = graph.chunk_texts(merged.select("root", "topic", F.array_join("chunks", ";;;").alias("chunkid")), chunks.select("topic", F.col("id").alias("chunk_id"), "sentence"), ["root", "topic"])
    none = F.array().cast("array<string>")
    context = F.array_join(F.array_distinct(F.concat(F.coalesce("texts", none), F.coalesce("top", none))), ", ")
    asked = merged.join(texts.drop("topic"), "root", "left").join(best, "root", "left").select("topic", "first", "name", "type", description.alias("description"), context.alias("context"))
    answers = asked.withColumn("relationships", providers.subgraph(provider)("context", "name")).withColumn("attributes", providers.attributes(provider)("context", "name"))
    parts = stage("subgraphs", answers.withColumnRenamed("first", "ord").drop("context"))
    return graph.merge_graph(parts, "topic")
