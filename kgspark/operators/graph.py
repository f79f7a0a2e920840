"""Knowledge-graph operators: merge, digraph, context, closure, incidence, patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.functions.normalize import attribute_map
from kgspark.functions.text import falsy
from kgspark.operators.components import connected_components
from kgspark.staging import staged, unstaged

NO_ATTRIBUTES = "map<string,string>"


def merge_components(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each component of accepted pairs (a, b) over entities(id, ord, name, type, description).

    The component takes name and type of its first member; descriptions are distinct, in order.
    Pairs with an unknown id are ignored. With a column chunk, first (the lowest ord) and the distinct chunks come too.
    """
    ids = entities.select("id")
    known = pairs.join(ids.withColumnRenamed("id", "a"), "a").join(ids.withColumnRenamed("id", "b"), "b")
    e = entities.join(connected_components(known), "id", "left").withColumn("root", F.coalesce("root", "id"))
    firsts = F.array_sort(F.collect_list(F.struct("ord", "description")))
    chunks = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk"))), lambda x: x["chunk"]))
    more = {"first": F.min("ord"), "chunks": chunks} if "chunk" in entities.columns else {}
    out = e.groupBy("root").agg(F.min_by(F.struct("name", "type"), "ord").alias("main"), firsts.alias("d"), F.count("*").alias("members"), *[c.alias(n) for n, c in more.items()])
    return out.select("root", "main.name", "main.type", F.array_distinct(F.transform("d", lambda x: x["description"])).alias("descriptions"), "members", *more)


def chunk_texts(entities: DataFrame, chunks: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """by, texts of entities(by, chunkid) in the order of their chunk ids, and the ids (by, chunk_id) that chunks(chunk_id, sentence) lacks.

    Columns of by that chunks have too tell graphs apart.
    chunkid joins ids by ;;;, blanks around them and empty ones don't count. An entity whose ids are all unknown has no row in the first.
    """
    on = [*[c for c in by if c in chunks.columns], "chunk_id"]
    ids = entities.select(*by, F.posexplode(F.transform(F.split("chunkid", ";;;"), lambda x: F.trim(x))).alias("_at", "chunk_id")).where("chunk_id <> ''")
    both = ids.join(chunks.select(*on, "sentence"), on)
    texts = both.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "sentence"))), lambda x: x["sentence"]).alias("texts"))
    return texts, ids.join(chunks.select(*on), on, "left_anti").select(*by, "chunk_id")


def digraph(edges: DataFrame, *by: str) -> DataFrame:
    """edges(src, dst, relation, ord): one edge for each (src, dst), the last one; of equal ord the last in text order.

    With a column description it comes from the same edge. by: columns whose values have a graph each.
    """
    carried = [c for c in ("relation", "description") if c in edges.columns]
    last = F.max_by(F.struct(*carried), F.struct("ord", *carried)).alias("x")
    return edges.groupBy(*by, "src", "dst").agg(last).select(*by, "src", "dst", *[F.col(f"x.{c}").alias(c) for c in carried])


def nodes(entities: DataFrame, edges: DataFrame, *by: str) -> DataFrame:
    """by, name, ord, known, type, description of a graph's nodes: entities(name, ord, type, description) and all ends of edges(ord, src, dst).

    Of entities of a name the last counts; ord is the place of the name's first appearance, entities before edges.
    Ends without an entity are not known and have neither type nor description.
    """
    own = entities.groupBy(*by, "name").agg(F.min("ord").cast("long").alias("ord"), F.max_by(F.struct("type", "description"), "ord").alias("x"))
    own = own.select(*by, "name", F.struct(F.lit(0).alias("step"), "ord", F.lit(0).alias("end")).alias("place"), F.lit(True).alias("known"), "x.type", "x.description")
    end = lambda c, k: edges.select(*by, F.col(c).alias("name"), F.struct(F.lit(1).alias("step"), F.col("ord").cast("long").alias("ord"), F.lit(k).alias("end")).alias("place"))
    ends = end("src", 0).unionByName(end("dst", 1)).groupBy(*by, "name").agg(F.min("place").alias("place"))
    ends = ends.join(own.select(*by, "name"), [*by, "name"], "left_anti")
    text = F.lit(None).cast("string")
    every = own.unionByName(ends.select("*", F.lit(False).alias("known"), text.alias("type"), text.alias("description")))
    return every.select(*by, "name", "place", "known", "type", "description")


def incidence(edges: DataFrame) -> DataFrame:
    """node, relation under head and under tail; a loop appears twice. Other columns of edges(src, dst, relation, ...) come along."""
    more = [c for c in edges.columns if c not in ("src", "dst", "relation")]
    ends = [edges.select(F.col(end).alias("node"), "relation", *more) for end in ("src", "dst")]
    return ends[0].unionByName(ends[1])


def reached(starts: DataFrame, edges: DataFrame, hops: int, by: list[str]) -> DataFrame:
    """by, start, node: the nodes at most hops steps from each start."""
    e = edges.select(*by, F.col("src").alias("node"), "dst").distinct() if hops > 1 else edges.select(*by, F.col("src").alias("node"), "dst")
    step = starts.select(*by, "start", F.col("start").alias("node")).distinct()
    found = step
    for _ in range(hops):
        step = step.join(e, [*by, "node"]).select(*by, "start", F.col("dst").alias("node"))
        found = found.unionByName(step).distinct()
    return found


def context(starts: DataFrame, edges: DataFrame, depth: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """start, src, relation, dst: edges that leave a start or a node fewer than depth hops from it, once for each start.

    by: columns whose values have a graph each; a column description of edges comes along. One row for each (src, dst) in edges is expected.
    """
    own = [*by]
    near = reached(starts, edges, depth - 1, own).withColumnRenamed("node", "src")
    rest = [c for c in edges.columns if c not in (*own, "src", "ord")]
    out = near.join(edges, [*own, "src"]).select(*own, "start", "src", *[c for c in ("relation", "description", "dst") if c in rest])
    return out.distinct()


def context_lines(starts: DataFrame, edges: DataFrame, nodes_: DataFrame | None = None, depth: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """by, start, line: distinct lines about each start; with nodes_ (see nodes()) those of the nodes near it and of described relations, else plain sentences."""
    own = [*by]
    found = context(starts, edges, depth, by)
    if nodes_ is None:
        return found.select(*own, "start", F.concat("src", F.lit(" "), "relation", F.lit(" "), "dst", F.lit(".")).alias("line")).distinct()
    relation = F.concat(F.lit("relation: "), "src", F.lit(" --["), "relation", F.lit("]-> "), "dst", F.lit("--description:"), F.coalesce("description", F.lit("")), F.lit("--"))
    near = reached(starts, edges, depth - 1, own).join(nodes_.withColumnRenamed("name", "node"), [*own, "node"])
    told = F.when(F.col("known"), F.coalesce("description", F.lit(""))).otherwise("u")
    info = F.concat(F.lit("name: "), "node", F.lit("\ntype: "), F.coalesce("type", F.lit("")), F.lit("\ndescription: "), told)
    return found.select(*own, "start", relation.alias("line")).unionByName(near.select(*own, "start", info.alias("line"))).distinct()


def first_wins(rows: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """The first row of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def merge_graph(subgraphs: DataFrame, topic: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of subgraphs(ord, name, type, description, relationships array<struct>).

    Central entities come first by name, then targets not seen before; relations keep repeats. With a column attributes
    (array of key and value) entities have a map of them: that of the first central entity of the name, the last of equal keys;
    targets have none. A subgraph without a name, as of a failed answer, is left out. topic: a column whose values have a graph each.
    """
    by, subgraphs = ([topic] if topic else []), subgraphs.where("name is not null")
    r = subgraphs.select(*by, "ord", F.col("name").alias("head"), F.posexplode("relationships").alias("at", "r"))
    r = r.where("nullif(r.target_name, '') is not null")
    has = "attributes" in subgraphs.columns
    own = [F.coalesce(attribute_map(F.col("attributes")), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("attributes")] if has else []
    none = [F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("attributes")] if has else []
    centre = subgraphs.select(*by, F.lit(0).alias("step"), "ord", F.lit(0).alias("at"), "name", "type", "description", *own)
    target = r.select(*by, F.lit(1).alias("step"), "ord", "at", F.col("r.target_name").alias("name"), F.col("r.target_type").alias("type"), F.col("r.target_description").alias("description"), *none)
    entities = first_wins(centre.unionByName(target), [*by, "name"], "step", "ord", "at")
    relations = r.select(*by, "ord", "at", "head", F.col("r.relation").alias("relation"), F.col("r.target_name").alias("tail"), F.col("r.relation_description").alias("description"))
    return entities.drop("step", "ord", "at"), relations


def graph_counts(entities: DataFrame, relations: DataFrame, *by: str) -> DataFrame:
    """by, entities, attributes, relations: sizes of each graph; an entity without attributes has 0. Only graphs with both lists count."""
    size = F.coalesce(F.size("attributes"), F.lit(0)) if "attributes" in entities.columns else F.lit(0)
    e = entities.groupBy(*by).agg(F.count("*").alias("entities"), F.sum(F.greatest(size, F.lit(0))).cast("long").alias("attributes"))
    return e.join(relations.groupBy(*by).agg(F.count("*").alias("relations")), [*by])


def closure(edges: DataFrame) -> DataFrame:
    """child, ancestor over edges(child, parent): all ancestors at any distance; a node on a cycle is its own ancestor.

    Each round joins what the last one found with all found so far, which doubles the distance, and is written to the shared
    folder; it ends when nothing is new. Rows with a null say nothing.
    """
    found = new = staged(edges.select("child", F.col("parent").alias("ancestor")).where("child is not null and ancestor is not null").distinct())
    while not new.isEmpty():
        on = found.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("further"))
        step = new.join(on, "ancestor").select("child", F.col("further").alias("ancestor")).distinct()
        fresh = staged(step.join(found, ["child", "ancestor"], "left_anti"))
        if fresh.isEmpty():
            break
        both = staged(found.unionByName(fresh))
        unstaged(found, new)
        found, new = both, fresh
    return found


def from_trace(traces: DataFrame) -> DataFrame:
    """The last row by ord of those whose chunkid (joined by ;;;) starts with the same chunk, for merge_graph."""
    key = F.split("chunkid", ";;;")[0]
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.col("ord").desc()))
    return traces.withColumn("_place", last).where("_place = 1").drop("_place")


def top_category(edges: DataFrame, tops: DataFrame) -> DataFrame:
    """child, top over edges(child, parent) and tops(ancestor): the smallest top among the ancestors; null where there is none."""
    up = closure(edges).join(tops.select("ancestor"), "ancestor", "left_semi").groupBy("child").agg(F.min("ancestor").alias("top"))
    return edges.select("child").distinct().join(up, "child", "left")


def pattern(nodes_: DataFrame, relations: DataFrame) -> DataFrame:
    """Rows (a)-[r]->(b): relations(id, type, source, target, props) whose both ends are in nodes_(id, labels, props), with the ends' columns."""
    ends = [nodes_.select(F.col("id").alias(side), F.col("labels").alias(f"{side}_labels"), F.col("props").alias(f"{side}_props")) for side in ("source", "target")]
    return relations.join(ends[0], "source").join(ends[1], "target").select("id", "type", "source", "source_labels", "source_props", "target", "target_labels", "target_props", "props")


def described(relations: DataFrame) -> DataFrame:
    """The relations whose description is not empty."""
    return relations.where(falsy(F.col("description")).isNotNull())
