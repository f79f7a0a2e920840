"""One query for each operator family, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark import providers
from kgspark.functions import text
from kgspark.operators import cleaning, evaluation, graph, retrieval
from kgspark.plans import cleaning_queries, construct, graph_queries, text_queries  # noqa: F401
from kgspark.plans.registry import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]


_SENT = r"""WITH x AS (SELECT doc_id, lang, regexp_replace(regexp_replace(coalesce(text,''), '(^|[^\p{L}\p{N}_])([A-Za-z]\.)', '\1\2'||chr(2), 'g'), '(^|[^\p{L}\p{N}_])([A-Za-z]\.)([^'||chr(2)||'])', '\1\2'||chr(2)||'\3', 'g') AS t FROM documents),
s AS (SELECT doc_id, lang, regexp_replace(replace(u.p, chr(2), ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS sentence, u.i AS i FROM x, LATERAL (SELECT unnest(string_split(regexp_replace(t, '([.!?。！？])[\s\p{Z}]+', '\1'||chr(1), 'g'), chr(1))) AS p, generate_subscripts(string_split(regexp_replace(t, '([.!?。！？])[\s\p{Z}]+', '\1'||chr(1), 'g'), chr(1)), 1) AS i) u),
c AS (SELECT doc_id, lang, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ord FROM s WHERE sentence <> '') """


def _chunks(t) -> DataFrame:
    d = t("documents").select("doc_id", "lang", F.posexplode(text.sentences("text")).alias("pos", "sentence"))
    return d.select("doc_id", "lang", "sentence", (F.col("pos") + 1).cast("long").alias("ord"))


@query(_SENT + "SELECT doc_id, lang, count(*) AS n_sentences, sum(length(sentence))::BIGINT AS n_chars FROM c GROUP BY ALL")
def sentence_split(t):
    return _chunks(t).groupBy("doc_id", "lang").agg(F.count("*").alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"))


@query(_SENT + "SELECT doc_id, md5(sentence) AS sentence_key, arg_max(doc_id::VARCHAR || '#' || ord::VARCHAR, ord) AS chunk_id FROM c GROUP BY doc_id, sentence")
def sentence_ids_last_wins(t):
    c = _chunks(t).withColumn("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("ord").cast("string")))
    return c.groupBy("doc_id", "sentence").agg(F.max_by("chunk_id", "ord").alias("chunk_id")).select("doc_id", F.md5("sentence").alias("sentence_key"), "chunk_id")


@query("SELECT conv_id, turn, role, 'entity' || row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS entity_id FROM conversations")
def mention_numbering(t):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return t("conversations").select("conv_id", "turn", "role", F.concat(F.lit("entity"), n.cast("string")).alias("entity_id"))


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _vectors(t) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS}, 5) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_COS} > 0.3")
def similar_pairs(t):
    p = retrieval.pairs_within(_vectors(t).withColumn("at", F.col("id")), "label", "at", 0.3)
    return p.withColumn("similarity", F.round("similarity", 5))


@query(f"""WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE {_COS} > 0.3),
r(id, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a) SELECT vec_id AS id, coalesce(min(root), vec_id) AS root FROM embeddings LEFT JOIN r ON vec_id = id GROUP BY vec_id""")
def entity_components(t):
    v = _vectors(t)
    pairs = retrieval.pairs_within(v.withColumn("at", F.col("id")), "label", "at", 0.3)
    return v.select("id").join(graph.connected_components(pairs.select("a", "b")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def _top(k: int, order: str) -> str:
    return f"SELECT query, id, rank, similarity FROM (SELECT *, (row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id {order}))::INT AS rank FROM (SELECT a.vec_id AS query, b.vec_id AS id, round({_COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label)) WHERE rank <= {k}"


@query(_top(5, "DESC"))
def retrieve_topk(t):
    return retrieval.top_within(_vectors(t), _vectors(t), "label", 5, later_first=True)


@query(_top(8, "ASC"))
def retrieve_nodes(t):
    return retrieval.top_within(_vectors(t), _vectors(t), "label", 8)


_EDGES = "(SELECT 'c' || o_custkey AS src, 'p' || l_partkey AS dst, l_returnflag AS relation, l_orderkey * 10 + l_linenumber AS ord FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def _edges(t) -> DataFrame:
    e = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return e.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_returnflag").alias("relation"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


@query(f"SELECT src, dst, arg_max(relation, (ord, relation)) AS relation FROM {_EDGES} GROUP BY src, dst")
def digraph_last_edge(t):
    return graph.digraph(_edges(t))


@query("SELECT DISTINCT s.src AS start, e.src, e.relation, e.dst FROM (SELECT DISTINCT 'n' || n_nationkey AS src FROM nation) s JOIN (SELECT 'n' || s_nationkey AS src, 's' || s_suppkey AS dst, 'has' AS relation FROM supplier UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey, l_returnflag FROM lineitem) e ON e.src = s.src OR e.src IN (SELECT 's' || s_suppkey FROM supplier WHERE 'n' || s_nationkey = s.src)")
def two_hop_context(t):
    e = t("supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"), F.lit("has").alias("relation"))
    e = e.unionByName(t("lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_returnflag").alias("relation")))
    return graph.context(t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("start")), e)


@query(f"SELECT node, relation, count(*) AS n FROM (SELECT src AS node, relation FROM {_EDGES} UNION ALL SELECT dst, relation FROM {_EDGES}) GROUP BY ALL")
def relation_incidence(t):
    return graph.incidence(_edges(t)).groupBy("node", "relation").agg(F.count("*").alias("n"))


@query("SELECT toxic, printf('%.2f%%', 100.0 * sum(coalesce(quality, 0)) / count(*)) AS accuracy FROM labels GROUP BY toxic")
def accuracy(t):
    return evaluation.accuracy(t("labels"), "toxic", "quality")


@query("SELECT event_type, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median, round(var_samp(value), 4) AS variance, round(stddev_samp(value), 4) AS deviation FROM events GROUP BY event_type")
def metric_stats(t):
    return evaluation.statistics(t("events"), "event_type", "value")


@query("WITH v AS (SELECT round(((event_id % 16) / 15.0) * 100, 2)::DOUBLE AS v FROM events), b AS (SELECT round(i / 15.0 * 100, 2)::DOUBLE AS bin FROM range(16) r(i)) SELECT bin, count(v) AS n FROM b LEFT JOIN v ON v = bin GROUP BY bin")
def histogram_bins(t):
    v = t("events").select(F.round((F.col("event_id") % 16) / 15.0 * 100, 2).alias("value"))
    return evaluation.histogram(v, "value", [round(i / 15 * 100, 2) for i in range(16)])


@query("SELECT metric, round(avg(score), 6) AS mean FROM (SELECT 'quality' AS metric, quality::DOUBLE AS score FROM labels UNION ALL SELECT 'toxic', toxic FROM labels) WHERE score > 0 GROUP BY metric")
def unpivot_mean(t):
    return evaluation.unpivot_mean(t("labels").select("doc_id", "quality", "toxic"), ["doc_id"], ["quality", "toxic"])


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_ids(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey"))


@query("SELECT DISTINCT p_name AS title FROM part")
def dedup_titles(t):
    return t("part").select(F.col("p_name").alias("title")).distinct()


@query("SELECT a.label AS label, a.vec_id AS std, arg_max(b.vec_id, (round(" + _COS + ", 6), -b.vec_id)) AS eval FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE round(" + _COS + ", 6) > 0 GROUP BY ALL")
def best_match(t):
    v = _vectors(t)
    top = retrieval.top_within(v, v, "label", 2).where("similarity > 0 AND query <> id")  # the best other row is among the two
    best = top.groupBy("query").agg(F.min_by("id", "rank").alias("eval"))
    return best.join(v.select(F.col("id").alias("query"), "label"), "query").select("label", F.col("query").alias("std"), "eval")


@query("SELECT doc_id, i AS place, substr(text, (i * 1100 + 1)::BIGINT, 1200) AS chunk FROM documents, LATERAL (SELECT unnest(range(greatest(1, ceil((length(text) - 100) / 1100.0)::BIGINT))) AS i) WHERE text <> ''")
def overlap_chunks(t):
    return t("documents").select("doc_id", F.posexplode(text.overlapping(F.col("text"), 1200, 100)).alias("at", "chunk")).select("doc_id", F.col("at").cast("long").alias("place"), "chunk")


@query("SELECT event_type, i * 10.0::DOUBLE AS x, round(sum(exp(-0.5 * ((i * 10.0 - value) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8) AS density FROM (SELECT *, d * n ** -0.2 AS h FROM events JOIN (SELECT event_type, count(*) AS n, stddev_samp(value) AS d FROM events GROUP BY event_type) USING (event_type)), range(11) r(i) GROUP BY event_type, i")
def density_curve(t):
    return evaluation.density(t("events"), "event_type", "value", [10.0 * i for i in range(11)])


@query("SELECT lang, round(count(l.doc_id) / count(*), 4) AS coverage, round(avg(quality), 4) AS similarity FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def coverage(t):
    return evaluation.coverage(t("documents"), t("labels"), "lang", "doc_id", "quality")


@query()
def rouge_turns(t):
    """Each turn against the one before it in its conversation."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role"))
    both = t("conversations").withColumn("before", before).where("before is not null")
    return both.withColumn("r", evaluation.rouge("text", "before")).select("conv_id", "turn", "r.*")


@query()
def construct_entities(t):
    """Names of the graphs built from whole conversations, by the provider of rules."""
    return construct.construct(_conversations(t), providers.Rules())[0].select("topic", "name", "type", F.md5(F.col("description").cast("binary")).alias("description_md5"))


@query()
def construct_relations(t):
    return construct.construct(_conversations(t), providers.Rules())[1].select("topic", "head", "relation", "tail")


def _conversations(t) -> DataFrame:
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return t("conversations").groupBy(F.col("conv_id").alias("topic")).agg(F.array_join(turns, "\n").alias("content"))
