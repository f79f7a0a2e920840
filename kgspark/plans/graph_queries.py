"""Queries of graphs, linking and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark import providers
from kgspark.functions.profiles import TOP_CATEGORIES
from kgspark.operators import evaluation, graph, linking, retrieval
from kgspark.plans import evaluate
from kgspark.plans.registry import query, text_values


@query("""WITH m AS (SELECT p_partkey AS id, p_name, p_type, p_brand FROM part), g AS (SELECT min(id) OVER (PARTITION BY p_brand) AS root, * FROM m), d AS (SELECT root, p_type, min(id) AS place FROM g GROUP BY ALL)
SELECT root, arg_min(p_name, id) AS name, arg_min(p_type, id) AS type, count(*) AS members, any_value(descriptions) AS descriptions FROM g JOIN (SELECT root, string_agg(p_type, ';;;' ORDER BY place) AS descriptions FROM d GROUP BY root) USING (root) GROUP BY root""")
def component_merge(t):
    p = t("part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_type").alias("description"), "p_brand")
    pairs = p.select(F.col("id").alias("b"), "p_brand").join(p.groupBy("p_brand").agg(F.min("id").alias("a")), "p_brand").where("a < b").select("a", "b")
    unknown = t.values([(0, -5), (-6, -7)], "a long, b long")
    out = graph.merge_components(p.drop("p_brand"), pairs.unionByName(unknown))
    return out.select("root", "name", "type", "members", F.array_join("descriptions", ";;;").alias("descriptions"))


@query("SELECT s_suppkey, string_agg(n_name, '|' ORDER BY place) AS texts FROM (SELECT s_suppkey, n_nationkey, n_name, min(place) AS place FROM (SELECT s_suppkey, s_nationkey AS k, 0 AS place FROM supplier UNION ALL SELECT s_suppkey, (s_nationkey + 1), 1 FROM supplier) JOIN nation ON n_nationkey = k GROUP BY ALL) GROUP BY s_suppkey")
def chunk_texts(t):
    s = F.col("s_nationkey").cast("string")
    e = t("supplier").select("s_suppkey", F.concat(F.lit(" n"), s, F.lit(" ;;; ;;;n"), (F.col("s_nationkey") + 1).cast("string"), F.lit(";;;gone")).alias("chunkid"))
    texts, _ = graph.chunk_texts(e, t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("chunk_id"), F.col("n_name").alias("sentence")), ["s_suppkey"])
    return texts.select("s_suppkey", F.array_join("texts", "|").alias("texts"))


@query("""WITH e AS (SELECT 'c' || o_custkey AS src, 'p' || o_orderpriority AS dst, o_orderkey AS ord FROM orders), known AS (SELECT 'c' || c_custkey AS name, c_custkey AS ord, c_mktsegment AS type FROM customer UNION ALL SELECT 'c' || (c_custkey % 7), 100000 + c_custkey, c_name FROM customer)
SELECT name, true AS known, arg_max(type, ord) AS type, min(ord)::BIGINT AS ord FROM known GROUP BY name UNION ALL SELECT name, false, NULL, min(ord)::BIGINT FROM (SELECT src AS name, ord FROM e UNION ALL SELECT dst, ord FROM e) WHERE name NOT IN (SELECT name FROM known) GROUP BY name""")
def graph_nodes(t):
    c = t("customer")
    own = c.select(F.concat(F.lit("c"), "c_custkey").alias("name"), F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("type"))
    again = c.select(F.concat(F.lit("c"), F.col("c_custkey") % 7).alias("name"), (F.col("c_custkey") + 100000).alias("ord"), F.col("c_name").alias("type"))
    edges = t("orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "o_orderpriority").alias("dst"), F.col("o_orderkey").alias("ord"))
    out = graph.nodes(own.unionByName(again).withColumn("description", F.lit("")), edges)
    return out.select("name", "known", "type", F.col("place.ord").alias("ord"))


_CHAIN = "(SELECT p_partkey AS child, p_partkey - 1 AS parent FROM part WHERE p_partkey % 40 <> 0 UNION ALL SELECT p_partkey, p_partkey + 39 FROM part WHERE p_partkey % 200 = 0 AND p_partkey + 39 IN (SELECT p_partkey FROM part))"


def _chain(t) -> DataFrame:
    p, k = t("part"), F.col("p_partkey")
    up = p.where(k % 40 != 0).select(k.alias("child"), (k - 1).alias("parent"))
    back = p.where(k % 200 == 0).select(k.alias("child"), (k + 39).alias("parent"))
    return up.unionByName(back.join(p.select(k.alias("parent")), "parent", "left_semi").select("child", "parent"))


@query(f"WITH RECURSIVE e AS {_CHAIN}, r AS (SELECT child, parent AS ancestor FROM e UNION SELECT r.child, e.parent FROM r JOIN e ON r.ancestor = e.child) SELECT child, ancestor FROM r")
def ancestor_closure(t):
    """Chains of 40 links, every fifth of them closed to a circle."""
    return graph.closure(_chain(t))


@query(f"WITH RECURSIVE e AS {_CHAIN}, r AS (SELECT child, parent AS ancestor FROM e UNION SELECT r.child, e.parent FROM r JOIN e ON r.ancestor = e.child) SELECT child, min(CASE WHEN ancestor % 10 = 0 THEN ancestor END) AS top FROM r GROUP BY child")
def top_category(t):
    return graph.top_category(_chain(t), t("part").where(F.col("p_partkey") % 10 == 0).select(F.col("p_partkey").alias("ancestor")))


_HOPS = "(SELECT p_partkey AS src, (p_partkey * 7 + 3) % 500 AS dst, 'a' AS relation FROM part UNION ALL SELECT p_partkey, (p_partkey * 11 + 5) % 500, 'b' FROM part)"


@query(f"WITH e AS {_HOPS}, s AS (SELECT n_nationkey AS start FROM nation), n AS (SELECT start, start AS node FROM s UNION SELECT start, dst FROM s JOIN e ON src = start UNION SELECT start, e2.dst FROM s JOIN e e1 ON e1.src = start JOIN e e2 ON e2.src = e1.dst) SELECT DISTINCT start, src, relation, dst FROM n JOIN e ON src = node")
def three_hop_context(t):
    k = F.col("p_partkey")
    e = t("part").select(k.alias("src"), ((k * 7 + 3) % 500).alias("dst"), F.lit("a").alias("relation")).unionByName(t("part").select(k.alias("src"), ((k * 11 + 5) % 500).alias("dst"), F.lit("b").alias("relation")))
    return graph.context(t("nation").select(F.col("n_nationkey").cast("long").alias("start")), e, 3)


@query(f"""WITH e AS (SELECT 'n' || src AS src, 'n' || dst AS dst, max(relation) AS relation FROM {_HOPS} GROUP BY src, dst), s AS (SELECT 'n' || n_nationkey AS start FROM nation), n AS (SELECT start, start AS node FROM s UNION SELECT start, dst FROM s JOIN e ON src = start)
SELECT start, 'relation: ' || src || ' --[' || relation || ']-> ' || dst || '--description:about ' || relation || '--' AS line FROM n JOIN e ON src = node UNION SELECT start, 'name: ' || node || chr(10) || 'type: ' || coalesce(p_type, '') || chr(10) || 'description: ' || coalesce(p_name, 'u') FROM n LEFT JOIN part ON node = 'n' || p_partkey""")
def context_lines(t):
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    e = t("part").select(name(k).alias("src"), name((k * 7 + 3) % 500).alias("dst"), F.lit("a").alias("relation")).unionByName(t("part").select(name(k).alias("src"), name((k * 11 + 5) % 500).alias("dst"), F.lit("b").alias("relation")))
    e = e.withColumn("description", F.concat(F.lit("about "), "relation")).withColumn("ord", F.when(F.col("relation") == "a", 0).otherwise(1))
    own = t("part").select(name(k).alias("name"), k.alias("ord"), F.col("p_type").alias("type"), F.col("p_name").alias("description"))
    starts = t("nation").select(name(F.col("n_nationkey")).alias("start"))
    return graph.context_lines(starts, graph.digraph(e), graph.nodes(own, e))


_SUB = "(SELECT c_custkey, o_orderkey, 'Customer#' || c_custkey AS head, o_orderpriority AS tail FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"""WITH r AS {_SUB}, e AS (SELECT 'Customer#' || c_custkey AS name, c_mktsegment AS type, c_custkey::VARCHAR AS key, 0 AS step, c_custkey AS ord, 0 AS place FROM customer UNION ALL SELECT 'Customer#' || (c_custkey % 10), 'again', 'again', 0, 1000000 + c_custkey, 0 FROM customer UNION ALL SELECT tail, 'Priority', NULL, 1, c_custkey, o_orderkey FROM r)
SELECT name, type, key FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY step, ord, place) AS k FROM e) WHERE k = 1""")
def kg_merge_first_wins(t):
    """Central entities, some of them twice, with attributes whose key comes twice; targets after them."""
    return graph.merge_graph(_subgraphs(t))[0].select("name", "type", F.col("attributes")["key"].alias("key"))


@query(f"SELECT head, 'ordered' AS relation, tail, 'd' || o_orderkey AS description FROM {_SUB}")
def kg_merge_relations(t):
    return graph.merge_graph(_subgraphs(t))[1].select("head", "relation", "tail", "description")


def _subgraphs(t) -> DataFrame:
    r = F.struct(F.lit("ordered").alias("relation"), F.col("o_orderpriority").alias("target_name"), F.lit("Priority").alias("target_type"), F.lit("").alias("target_description"), F.concat(F.lit("d"), "o_orderkey").alias("relation_description"))
    rel = t("orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", r.alias("r")))), lambda x: x["r"]).alias("relationships"))
    c = t("customer").join(rel, F.col("c_custkey") == F.col("o_custkey"), "left")
    pair = lambda v: F.struct(F.lit("key").alias("key"), v.alias("value"))
    sub = c.select(F.col("c_custkey").alias("ord"), F.concat(F.lit("Customer#"), "c_custkey").alias("name"), F.col("c_mktsegment").alias("type"), F.lit("").alias("description"), F.array(pair(F.lit("old")), pair(F.col("c_custkey").cast("string"))).alias("attributes"), "relationships")
    again = t("customer").select((F.col("c_custkey") + 1000000).alias("ord"), F.concat(F.lit("Customer#"), F.col("c_custkey") % 10).alias("name"), F.lit("again").alias("type"), F.lit("").alias("description"), F.array(pair(F.lit("again"))).alias("attributes"), F.lit(None).cast(sub.schema["relationships"].dataType).alias("relationships"))
    failed = again.limit(1).withColumn("name", F.lit(None).cast("string"))
    return sub.unionByName(again).unionByName(failed)


@query("SELECT c_nationkey AS file, count(*) AS entities, sum(1 + c_custkey % 3)::BIGINT AS attributes, any_value(r) AS relations FROM customer JOIN (SELECT c_nationkey AS k, count(*) AS r FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) ON k = c_nationkey GROUP BY 1")
def kg_counts(t):
    c = t("customer")
    numbers = F.sequence(F.lit(0), (F.col("c_custkey") % 3).cast("int"))
    e = c.select(F.col("c_nationkey").alias("file"), F.map_from_arrays(numbers, numbers).alias("attributes"))
    r = c.join(t("orders"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("file"))
    return graph.graph_counts(e, r, "file")


@query("SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS type, 'c' || o_custkey AS source, c_mktsegment AS source_label, 'n' || c_nationkey AS target, 'nation' AS target_label FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def node_edge_pattern(t):
    props = F.create_map(F.lit("name"), F.lit("x"))
    nodes = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.array("c_mktsegment").alias("labels"), props.alias("props"))
    nodes = nodes.unionByName(t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.array(F.lit("nation")).alias("labels"), props.alias("props")))
    r = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rels = r.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("type"), F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"), props.alias("props"))
    lost = rels.withColumn("target", F.lit("nowhere"))
    out = graph.pattern(nodes, rels.unionByName(lost))
    return out.select("id", "type", "source", F.col("source_labels")[0].alias("source_label"), "target", F.col("target_labels")[0].alias("target_label"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 25")
def set_difference(t):
    return t("part").select(F.col("p_partkey").alias("k")).subtract(t("lineitem").where("l_returnflag = 'R' AND l_quantity < 25").select("l_partkey"))


@query("SELECT 'entity' AS kind, p_type AS type FROM part UNION SELECT 'relation', l_returnflag FROM lineitem")
def type_sets(t):
    return t("part").select(F.lit("entity").alias("kind"), F.col("p_type").alias("type")).union(t("lineitem").select(F.lit("relation"), "l_returnflag")).distinct()


# Nested lists with objects, and the names found in them, with their places.
_NESTED = [(1, '[{"name": "a"}, [{"name": "b"}, [{"name": "c"}, 7]], {"x": 1}, {"name": 5}]', [("0", "a"), ("1.0", "b"), ("1.1.0", "c")]), (2, '{"name": "d", "in": [{"name": "e"}]}', [("", "d")]), (3, "[]", []), (4, '"text"', [])]


@query("SELECT * FROM " + text_values([(i, p, n) for i, _, found in _NESTED for p, n in found], "id, place, name"))
def nested_entities(t):
    rows = t.values([r[:2] for r in _NESTED], "id int, raw string").select("id", F.try_parse_json("raw").alias("value"))
    out = linking.entities_of(rows, ["id"])
    return out.select("id", F.array_join(F.transform("ord", lambda x: x.cast("string")), ".").alias("place"), F.try_variant_get("entity", "$.name", "string").alias("name"))


_TO_DO = "(SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '  ' ELSE ' ' || c_mktsegment || '  ' || (c_custkey % 9) END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'done' WHEN c_custkey % 3 = 1 THEN ' ' END AS entity_name_standard FROM customer)"


def _to_do(t) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit("  "), (k % 9).cast("string")))
    return t("customer").select("c_custkey", name.alias("name"), F.when(k % 3 == 0, F.lit("done")).when(k % 3 == 1, F.lit(" ")).alias("entity_name_standard"))


@query(f"SELECT c_custkey FROM {_TO_DO} WHERE trim(name) <> '' AND trim(coalesce(entity_name_standard, '')) = ''")
def work_list(t):
    return linking.work_list(_to_do(t)).select("c_custkey")


@query(f"SELECT c_custkey, CASE WHEN trim(name) <> '' AND trim(coalesce(entity_name_standard, '')) = '' THEN lower(regexp_replace(trim(name), '\\s+', ' ', 'g')) ELSE entity_name_standard END AS entity_name_standard FROM {_TO_DO}")
def translated_names(t):
    return linking.translated(_to_do(t), providers.translation(providers.Rules())("name")).select("c_custkey", "entity_name_standard")


@query(f"SELECT sum((trim(name) <> '')::INT)::BIGINT AS success, sum((trim(name) = '')::INT)::BIGINT AS fail FROM {_TO_DO}")
def outcome_counts(t):
    return evaluation.outcomes(_to_do(t).withColumn("error", F.when(F.trim("name") == "", F.lit("no name"))))


_TERMS = "(SELECT p_partkey AS ord, p_name || ' no ' || (p_partkey % 50) AS term, p_partkey AS concept_id, p_name || ' (' || p_type || ')' AS fsn FROM part)"


def _descriptions(t) -> DataFrame:
    k = F.col("p_partkey")
    return t("part").select(k.alias("ord"), F.concat("p_name", F.lit(" no "), (k % 50).cast("string")).alias("term"), k.alias("concept_id"), F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")).alias("fsn"))


@query(f"""WITH RECURSIVE d AS {_TERMS}, up AS (SELECT p_partkey AS child, p_partkey // 10 AS ancestor FROM part WHERE p_partkey > 0 UNION SELECT child, ancestor // 10 FROM up WHERE ancestor > 0), tops AS (SELECT child, min(ancestor) AS top FROM up WHERE ancestor BETWEEN 1 AND 9 GROUP BY child),
q AS (SELECT p_partkey, string_split(p_name, ' ')[2] || ' ' || upper(string_split(p_name, ' ')[1]) || ' ' || (p_partkey % 60) AS name FROM part), h AS (SELECT name, arg_min(concept_id, ord) AS concept_id, arg_min(fsn, ord) AS fsn FROM (SELECT DISTINCT name FROM q) JOIN d ON len(list_filter(string_split(lower(name), ' '), lambda w: NOT list_contains(string_split(lower(term), ' '), w))) = 0 GROUP BY name)
SELECT p_partkey, concept_id, coalesce(regexp_extract(fsn, '\\(([^()]*)\\)$', 1), '') AS align_entity_type, coalesce('category ' || top, '') AS top_level_category FROM q LEFT JOIN h USING (name) LEFT JOIN tops ON child = concept_id""")
def aligned_entities(t):
    """Names searched among descriptions by all their words, linked to the smallest top concept above the hit."""
    k = F.col("p_partkey")
    w = F.split("p_name", " ")
    e = t("part").select("p_partkey", F.concat(w[1], F.lit(" "), F.upper(w[0]), F.lit(" "), (k % 60).cast("string")).alias("entity_name_standard"))
    is_a = t("part").where("p_partkey > 0").select(k.alias("child"), F.floor(k / 10).alias("parent"))
    tops = t.spark.range(1, 10).select(F.col("id").alias("concept_id"), F.concat(F.lit("category "), "id").alias("category"))
    out = linking.aligned(e, _descriptions(t), is_a, tops)
    return out.select("p_partkey", F.col("align_entity.concept_id").alias("concept_id"), "align_entity_type", "top_level_category")


@query(f"WITH d AS {_TERMS} SELECT 'holds' AS ask, concept_id FROM d WHERE contains(term, 'red bolt') UNION ALL SELECT 'equals', concept_id FROM d WHERE term = 'red bolt no 7' UNION ALL SELECT 'count', count(*) FROM d WHERE contains(lower(term), 'bolt') AND fsn LIKE '% (SMALL)'")
def term_searches(t):
    d = _descriptions(t)
    ask = lambda name, rows, c: rows.select(F.lit(name).alias("ask"), F.col(c).alias("concept_id"))
    return ask("holds", linking.term_contains(d, "red bolt"), "concept_id").unionByName(ask("equals", linking.term_equals(d, "red bolt no 7"), "concept_id")).unionByName(ask("count", linking.tagged_count(d, "Bolt", "SMALL"), "n"))


@query(f"SELECT d.* FROM {_TERMS} d WHERE concept_id IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def point_lookups(t):
    return linking.by_ids(_descriptions(t), "concept_id", t("lineitem").where("l_quantity >= 49").select("l_partkey")).select("ord", "term", "concept_id", "fsn")


@query("SELECT category, id FROM " + text_values([(k, v) for k, v in TOP_CATEGORIES.items()], "category, id"))
def top_categories(t):
    return t.values([*TOP_CATEGORIES.items()], "category string, id long")


@query("SELECT * FROM (SELECT o_orderstatus AS file, 100.0 * count(*) FILTER (WHERE o_orderkey % 4 = 0) / count(*) AS pass_rate FROM orders GROUP BY 1) UNION ALL SELECT 'none', 0.0")
def pass_rate(t):
    o = t("orders").select(F.col("o_orderstatus").alias("file"), F.when(F.col("o_orderkey") % 4 == 0, 1.0).otherwise(0.5).alias("score"))
    return evaluation.pass_rate(o, "file", o.select("file").union(t.values([("none",)], "file string")))


@query("""SELECT o_orderstatus AS topic, md5('[' || string_agg('{"correct_answer":"' || o_orderpriority || '","retrieved_context":"' || o_custkey || '","evaluation":' || (o_orderkey % 2) || '}', ',' ORDER BY o_orderkey) || ',{"accuracy":"' || printf('%.2f%%', 100.0 * sum(o_orderkey % 2) / count(*)) || '"}]') AS results FROM orders GROUP BY 1""")
def results_json(t):
    r = t("orders").select(F.col("o_orderstatus").alias("topic"), F.col("o_orderkey").alias("q_idx"), F.col("o_orderpriority").alias("correct_answer"), F.col("o_custkey").cast("string").alias("retrieved_context"), (F.col("o_orderkey") % 2).cast("int").alias("evaluation"), F.lit(None).cast("string").alias("error"))
    out = evaluation.results_json(r, "topic", "q_idx", ["correct_answer", "retrieved_context", "evaluation", "error"])
    return out.select("topic", F.md5(F.col("results").cast("binary")).alias("results"))


@query("SELECT event_type, count(value) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75, max(value) AS max FROM events GROUP BY 1")
def described_metrics(t):
    d = evaluation.described(t("events"), "event_type", "value")
    return d.select("event_type", "count", *[F.round(c, 4).alias(c) for c in ("mean", "std")], "min", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p75")], "max")


@query("SELECT 'before' AS input, count(*) AS n FROM lineitem UNION ALL SELECT 'after', count(*) FROM lineitem WHERE l_returnflag <> 'R'")
def before_after(t):
    return evaluation.counts_of(before=t("lineitem"), after=t("lineitem").where("l_returnflag <> 'R'"))


@query("SELECT o_orderkey::VARCHAR AS file_name, o_custkey AS entities, 2 + CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 0 END AS total FROM orders")
def relation_totals(t):
    return evaluation.relation_totals(t("orders").select(F.col("o_orderkey").cast("string").alias("file_name"), F.col("o_custkey").alias("entities"), F.lit(2).alias("relations"), F.when(F.col("o_orderkey") % 2 == 0, 3).alias("attributes")))


@query("SELECT conv_id, turn, length(text) AS n FROM conversations")
def description_lengths(t):
    return t("conversations").select("conv_id", "turn", F.length("text").alias("n"))


@query("SELECT conv_id, turn, text FROM conversations WHERE turn >= 2")
def skipped_prefix(t):
    return t("conversations").where("turn >= 2").select("conv_id", "turn", "text")


_DENSITY = "SELECT event_type, i * 10.0::DOUBLE AS x, round(sum(exp(-0.5 * ((i * 10.0 - value) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8) AS density FROM (SELECT *, d * n ** -0.2 AS h FROM events JOIN (SELECT event_type, count(*) AS n, stddev_samp(value) AS d FROM events GROUP BY event_type) USING (event_type)), range(11) r(i) GROUP BY event_type, i"


@query(f"SELECT event_type, x, density, round(density / max(density) OVER (PARTITION BY event_type) * (SELECT max(n) FROM (SELECT count(*) AS n FROM events GROUP BY event_type)), 2) AS scaled FROM ({_DENSITY})")
def scaled_density(t):
    d = evaluation.density(t("events"), "event_type", "value", [10.0 * i for i in range(11)])
    counts = t("events").groupBy("event_type").agg(F.count("*").alias("n"))
    return evaluation.scaled_density(d, "event_type", counts).select("event_type", "x", "density", F.round("scaled", 2).alias("scaled"))


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"SELECT a.vec_id AS std, arg_max(b.vec_id, (round({_COS}, 6), -b.vec_id)) AS found FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.vec_id % 3 = b.vec_id % 3 WHERE round({_COS}, 6) > 0 GROUP BY a.vec_id")
def greedy_matches(t):
    """Each vector's nearest accepted one: of those in its group with the same id modulo 3."""
    v = t("embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    pairs = retrieval.pairs_across(v, v, "label", 0.0).where("a <> b").withColumn("similarity", F.round("similarity", 6)).where("similarity > 0")
    c = pairs.select(F.col("a").alias("std"), F.col("b").alias("found"), "similarity", F.col("a").alias("left"), F.col("b").alias("right"))
    return retrieval.greedy_matches(c, lambda x, y: [a % 3 == b % 3 for a, b in zip(x, y)]).select("std", "found")


def _conversation_graph(t) -> tuple[DataFrame, DataFrame]:
    """A graph for each conversation: its turns as entities, each turn to the next as relations."""
    c = t("conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"), F.min("role").alias("role"))
    name = F.concat(F.lit("turn "), F.col("turn").cast("string"), F.lit(" "), F.regexp_extract("text", r"^(\S+)", 1))
    e = c.select(F.col("conv_id").alias("topic"), F.col("turn").alias("ord"), name.alias("name"), F.col("role").alias("type"), F.col("text").alias("description"))
    nxt = e.select("topic", (F.col("ord") - 1).alias("ord"), F.col("name").alias("dst"))
    r = e.join(nxt, ["topic", "ord"]).select("topic", "ord", F.col("name").alias("src"), "dst", F.lit("then").alias("relation"), F.lit("").alias("description"))
    return e, r


@query()
def retrieval_accuracy(t):
    """Facts are the turns' own texts: whether the graph's context holds them."""
    e, r = _conversation_graph(t)
    qa = t("conversations").select(F.col("conv_id").alias("topic"), F.col("turn").cast("int").alias("q_idx"), F.col("text").alias("answer"))
    return evaluate.retrieval_accuracy(qa, e, r, providers.Rules())[1]


@query()
def graph_comparison(t):
    """Each conversation's graph against itself without its last turn."""
    e, r = _conversation_graph(t)
    last = e.groupBy("topic").agg(F.max("ord").alias("last"))
    less = e.join(last, "topic").where("ord < last").drop("last")
    named = lambda d: d.withColumnRenamed("topic", "dataid")
    return evaluate.compare_graphs((named(e), named(r)), (named(less), named(r)), providers.Rules())[1]
