"""Queries of text functions, normalisers and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions import normalize, text
from kgspark.operators import evaluation, layout
from kgspark.plans.registry import query, text_values
from kgspark.sources import readers
from kgspark.staging import shared_dir

# Hand-written results of attribute lists: case, JSON, then key and value of each attribute it gives.
_ATTRIBUTES = [
    (1, "[]", []),
    (2, None, []),
    (3, '[{"key": " a ", "value": "b "}, {}, {"key": "c"}]', [("a", "b"), ("c", "")]),
    (4, '["key: a, value: b", "key: c , value: d, e"]', [("a", "b"), ("c", "d, e")]),
    (5, '["key：甲, value：乙"]', [("甲", "乙")]),
    (6, '["key：甲，value：乙"]', []),
    (7, '["key", "value"]', []),
    (8, '{"key": "a", "value": "b"}', []),
    (9, '["key=a ,value=b", "key -> c / value => d"]', [("a", "b"), ("c", "d")]),
    (10, "not json", []),
    (11, '["key: a, value: b", {"key": "x", "value": "y"}, 7]', [("a", "b")]),
    (12, '[{"key": "n", "value": 5}, "key: a, value: b"]', [("n", "5")]),
]
# The same of relationship lists: relation, target and relation description of each record.
_RELATIONSHIPS = [
    (1, '[{"relation": "in", "target_name": "B", "relation_description": "d"}, {"relation": "in", "target_name": "B", "relation_description": "d"}]', [("in", "B", "d")]),
    (2, "[\"{'relation': 'in', 'target_name': 'B'}\", \"{\\\"relation\\\": \\\"on\\\", \\\"name\\\": \\\"C\\\"}\"]", [("in", "B", ""), ("on", "C", "")]),
    (3, '["relation: in, target_name: B, relation_description: x, y"]', [("in", "B", "x, y")]),
    (4, '["relation: \\"in\\"", "target_name: “B”", "relation: on", "target_name: C"]', [("in", "B", ""), ("on", "C", "")]),
    (5, '["A - Located In - B", "A - has - C - D"]', [("Located In", "B", ""), ("has", "C", "")]),
    (6, '["无"]', []),
    (7, '["relation", "target_name"]', []),
    (8, "[]", []),
    (9, None, []),
    (10, '[{"relation": "in", "target_name": ["B", "", "C"]}]', [("in", "B", ""), ("in", "C", "")]),
    (11, '["words alone", "and more"]', []),
    (12, '[{"relation": "in", "name": "B", "type": "T", "description": "D"}, "relation: on, target_name: C"]', [("in", "B", ""), ("on", "C", "")]),
    (13, '["A - in - B", "relation: on, target_name: C"]', [("in", "B", ""), ("on", "C", "")]),
    (14, '["None"]', []),
]


def _flat(cases: list[tuple]) -> list[tuple]:
    return [(c, i, *x) for c, _, found in cases for i, x in enumerate(found)]


@query("SELECT * FROM " + text_values(_flat(_ATTRIBUTES), "id, place, key, value") + " UNION ALL SELECT 1000 + event_id, 0, 'kind', event_type FROM events")
def attr_normalize(t):
    made = F.when(F.col("event_id") % 2 == 0, F.to_json(F.array(F.struct(F.lit(" kind ").alias("key"), F.col("event_type").alias("value"))))).otherwise(F.to_json(F.array(F.concat(F.lit("key: kind, value: "), "event_type"))))
    rows = t.values([c[:2] for c in _ATTRIBUTES], "id long, raw string").unionByName(t("events").select((1000 + F.col("event_id")).alias("id"), made.alias("raw")))
    return rows.select("id", F.posexplode(normalize.attributes(F.col("raw"))).alias("place", "x")).select("id", "place", "x.key", "x.value")


@query("SELECT * FROM " + text_values(_flat(_RELATIONSHIPS), "id, place, relation, target_name, relation_description") + " UNION ALL SELECT 1000 + event_id, 0, 'did', event_type, '' FROM events")
def rel_normalize(t):
    made = F.when(F.col("event_id") % 2 == 0, F.to_json(F.array(F.struct(F.lit("did").alias("relation"), F.col("event_type").alias("target_name"))))).otherwise(F.to_json(F.array(F.concat(F.lit("user - did - "), "event_type"))))
    rows = t.values([c[:2] for c in _RELATIONSHIPS], "id long, raw string").unionByName(t("events").select((1000 + F.col("event_id")).alias("id"), made.alias("raw")))
    return rows.select("id", F.posexplode(normalize.relationships(F.col("raw"))).alias("place", "x")).select("id", "place", "x.relation", "x.target_name", "x.relation_description")


@query("SELECT event_id, coalesce(nullif(json_extract_string(props, '$.type'), ''), json_extract_string(props, '$.k'), '') AS k FROM events")
def json_props(t):
    v = F.try_parse_json("props")
    return t("events").select("event_id", F.coalesce(text.falsy(F.try_variant_get(v, "$.type", "string")), F.try_variant_get(v, "$.k", "string"), F.lit("")).alias("k"))


_STATES = [(1, '{"State": "failed"}', True), (2, '{"State": null, "a": "1"}', True), (3, '{"entity1": {"State": "x"}}', False), (4, "{}", False), (5, None, False), (6, "[1]", False)]


@query("SELECT * FROM " + text_values([(a, c) for a, _, c in _STATES], "id, failed"))
def state_filter(t):
    return t.values([r[:2] for r in _STATES], "id int, raw string").select("id", normalize.has_state(F.col("raw")).alias("failed"))


_CONTAINERS = [(1, '{"a":1}', '{"a":1}', '{"a":1}'), (2, "[1,2]", "[1,2]", "[1,2]"), (3, '"{\\"a\\": 2}"', '{"a":2}', "[]"), (4, '"no json"', "[]", "[]"), (5, "7", "[]", "[]"), (6, None, "[]", "[]")]


@query("SELECT * FROM " + text_values([(a, c, d) for a, _, c, d in _CONTAINERS], "id, parsed, origin"))
def attribute_container(t):
    raw = F.col("raw")
    return t.values([r[:2] for r in _CONTAINERS], "id int, raw string").select("id", F.to_json(normalize.container(raw)).alias("parsed"), F.to_json(normalize.container(raw, False)).alias("origin"))


@query("""SELECT p_partkey, i::INT AS place, CASE WHEN i = 0 THEN '{"central_entity":{"name":"' || p_name || '","type":"' || p_type || '","attributes":[{"key":"brand","value":"' || p_brand || '"}]}}' ELSE '{"central_entity":{"name":"' || p_name || '","type":"' || p_type || '","relationships":[{"relation":"size","target_name":"' || p_size || '"}]}}' END AS output FROM part, range(2) r(i)""")
def judge_cases(t):
    p = t("part").withColumn("attributes", F.array(F.struct(F.lit("brand").alias("key"), F.col("p_brand").alias("value"))))
    p = p.withColumn("relationships", F.array(F.struct(F.lit("size").alias("relation"), F.col("p_size").cast("string").alias("target_name"))))
    return p.select("p_partkey", F.posexplode(normalize.judge_cases("p_name", "p_type", "attributes", "relationships")).alias("place", "output"))


@query("""SELECT p_partkey, '{"central_entity":{"name":"' || p_name || '","type":"' || p_type || '","attributes":[{"key":"description","value":"' || p_brand || '"}]}}' AS output FROM part""")
def mention_cases(t):
    return t("part").select("p_partkey", normalize.mention_case("p_name", "p_type", "p_brand").alias("output"))


_TAGS = [(1, "Burn of skin (disorder)", "disorder"), (2, "A (b) c ( d )", "d"), (3, "none", ""), (4, "open (x", ""), (5, "(a (b) c)", "b"), (6, "empty ()", ""), (7, None, "")]


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS tag FROM part UNION ALL SELECT -id, tag FROM " + text_values([(a, c) for a, _, c in _TAGS], "id, tag"))
def last_paren_tag(t):
    own = t.values([r[:2] for r in _TAGS], "id long, term string").select((-F.col("id")).alias("p_partkey"), text.last_tag(F.col("term")).alias("tag"))
    term = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" (x) ( "), "p_type", F.lit(" )"))).otherwise(F.col("p_name"))
    return t("part").select("p_partkey", text.last_tag(term).alias("tag")).unionByName(own)


_QUOTED = [(1, "'a'", "a"), (2, '" b "', "b"), (3, "“c”", "c"), (4, "'d\"", "'d\""), (5, " 'e' ", "e"), (6, "'", ""), (7, "", ""), (8, "f'", "f'"), (9, None, None)]


@query("SELECT * FROM " + text_values([(a, c) for a, _, c in _QUOTED], "id, plain"))
def strip_quotes(t):
    return t.values([r[:2] for r in _QUOTED], "id int, x string").select("id", text.strip_quotes(F.col("x")).alias("plain"))


@query("SELECT conv_id, turn, md5(replace(text, '''', '\"')) AS fixed, '{\"it''s\":\"a\"b\"}' AS nested, replace('l''' || role, '''', '\"') AS listed FROM conversations")
def quote_canonical(t):
    c = t("conversations").select("conv_id", "turn", "text", F.create_map(F.lit("it's"), F.lit("a'b")).alias("m"), F.array(F.struct(F.concat(F.lit("l'"), "role").alias("r"))).alias("l"))
    fixed = text.canonical(c)
    nested = F.concat(F.lit('{"'), F.map_keys("m")[0], F.lit('":"'), F.map_values("m")[0], F.lit('"}'))
    return fixed.select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("fixed"), nested.alias("nested"), F.col("l")[0]["r"].alias("listed"))


@query("SELECT p_partkey, p_name || ' ' || p_type AS mentions, concat_ws(' ', p_name, nullif(t, '')) AS nodes, p_name AS triples, p_name || ' ' || coalesce(t, '') || ' ' || p_brand AS reference FROM (SELECT *, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN p_type END AS t FROM part)")
def entity_texts(t):
    kind = F.when(F.col("p_size") % 3 == 0, F.lit("")).when(F.col("p_size") % 3 == 1, F.col("p_type"))
    e = t("part").select("p_partkey", F.col("p_name").alias("name"), kind.alias("type"), F.col("p_brand").alias("description"), "p_type")
    others = [text.embedded_text(k).alias(k) for k in ("nodes", "triples", "reference")]
    return e.select("p_partkey", "p_type", "name", *others).withColumn("type", F.col("p_type")).select("p_partkey", text.embedded_text("mentions").alias("mentions"), "nodes", "triples", "reference")


_PERCENT = "printf('%.2f%%', o_totalprice / 7)"


@query(f"SELECT o_orderkey, {_PERCENT} AS shown, rtrim({_PERCENT}, '%')::DOUBLE AS value FROM orders")
def percent_texts(t):
    shown = text.percent(F.col("o_totalprice") / 7)
    return t("orders").select("o_orderkey", shown.alias("shown"), text.percent_value(shown).alias("value"))


@query("SELECT page_id, sha256('key' || CASE WHEN length(url) <= 20 THEN url ELSE url[1:10] || length(url) || right(url, 10) END || 'salt' || '17' || 'secret') AS sign FROM pages")
def request_signature(t):
    return t("pages").select("page_id", text.signature(F.lit("key"), F.lit("secret"), F.col("url"), F.lit("salt"), F.lit("17")).alias("sign"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN 'MAIN/' || p_brand ELSE 'MAIN' END AS path FROM part")
def branch_paths(t):
    size = F.col("p_size")
    branch, version = F.when(size % 3 == 0, F.col("p_name")).otherwise(F.lit("")), F.when(size % 3 == 1, F.col("p_brand")).otherwise(F.lit(""))
    return t("part").select("p_partkey", text.branch_path(branch, F.lit("MAIN"), version).alias("path"))


@query("SELECT p_partkey, p_brand AS part, 'x_' || p_brand || '_a.b' AS base FROM part")
def file_names(t):
    path = F.concat(F.lit("/data/x_"), "p_brand", F.lit("_a.b.json"))
    return t("part").select("p_partkey", text.name_part(F.concat(F.lit("kg_result_chapter_"), "p_brand", F.lit("_a_b.json")), -3).alias("part"), text.base_name(path).alias("base"))


@query("SELECT conv_id, md5('```' || string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text) || '```') AS content FROM conversations GROUP BY conv_id")
def topic_contents(t):
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["text"])
    return t("conversations").groupBy("conv_id").agg(F.md5(text.topic_content(said).cast("binary")).alias("content"))


@query("SELECT c_custkey, coalesce(string_agg(trim(c_name || ' --' || o_orderstatus || '-> ' || o_orderkey || ' ' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END), chr(10) ORDER BY o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL), 'No relationships') AS lines FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def relation_lines(t):
    o = t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    described = F.when(F.col("o_orderkey") % 3 == 0, F.lit("undefine")).otherwise(F.col("o_orderpriority"))
    one = F.struct("o_orderkey", F.struct(F.col("c_name").alias("head"), F.col("o_orderstatus").alias("relation"), F.col("o_orderkey").cast("string").alias("tail"), described.alias("description")).alias("r"))
    rows = o.groupBy("c_custkey").agg(F.array_sort(F.collect_list(F.when(F.col("o_orderkey").isNotNull(), one))).alias("x"))
    return rows.select("c_custkey", text.relation_lines(F.transform("x", lambda x: x["r"])).alias("lines"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY value + 10 >= 50, value, event_id)::INT AS place FROM events")
def reading_order(t):
    e = t("events").select("event_id", "user_id", F.col("event_id").alias("box_ord"), F.col("value").alias("x0"), (F.col("value") + 20).alias("x1"), F.col("value").alias("y0"), F.lit(100.0).alias("width"))
    return layout.reading_order(e, ["user_id"]).select("event_id", "user_id", "place")


# Hand-written: page, place, label, text; then page, section_at, section, texts by "|" with their images in brackets.
_BOXES = [(1, 1, "Picture", "p0"), (1, 2, "Text", "a"), (1, 3, "Figure", "p1"), (1, 4, "SectionHeader", "H"), (1, 5, "Table", "p2"), (1, 6, "Caption", "b"), (1, 7, "Picture", "p3"), (1, 8, "Picture", "p4"), (1, 9, "Title", "c"), (1, 10, "Footer", "f"), (1, 11, "SectionHeader", "E"), (2, 1, "Text", "d"), (3, 1, "Picture", "p5")]
_SECTIONS = [(1, 0, "", "a[p1]"), (1, 4, "H", "b[p3,p4]|c[]"), (1, 11, "E", ""), (2, 0, "", "d[]")]


@query("SELECT * FROM " + text_values(_SECTIONS, "page, section_at, section, content"))
def page_sections(t):
    own = layout.sections(t.values(_BOXES, "page int, place int, label string, text string"), ["page"])
    shown = F.array_join(F.transform("content", lambda x: F.concat(x["text"], F.lit("["), F.array_join(x["images"], ","), F.lit("]"))), "|")
    return own.select("page", "section_at", "section", shown.alias("content"))


@query("SELECT conv_id, coalesce(last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 0) AS section, turn FROM (SELECT conv_id, turn + 1 AS turn, min(role) AS role FROM conversations GROUP BY ALL) QUALIFY role <> 'user'")
def section_attach(t):
    c = t("conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    label = F.when(F.col("role") == "user", F.lit("SectionHeader")).otherwise(F.lit("Text"))
    boxes = c.select("conv_id", (F.col("turn") + 1).cast("int").alias("place"), label.alias("label"), F.col("turn").cast("string").alias("text"))
    own = layout.sections(boxes, ["conv_id"])
    return own.select("conv_id", F.col("section_at").cast("long").alias("section"), F.explode("content.text").alias("turn")).select("conv_id", "section", (F.col("turn").cast("long") + 1).alias("turn"))


# Files: written from the tables to the shared folder and read back by the readers.


@query("SELECT n_name AS file, count(*)::BIGINT AS entities, count(DISTINCT c_mktsegment)::BIGINT AS types, sum((c_custkey % 2 = 0)::INT)::BIGINT AS attributes, (SELECT count(*) FROM orders JOIN customer c2 ON o_custkey = c2.c_custkey WHERE c2.c_nationkey = n_nationkey)::BIGINT AS relations FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey")
def graph_files(t):
    """Graphs written twice encoded, one a nation, read back and counted."""
    spark, path = t.spark, shared_dir(t.spark)
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    attributes = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("it's"), F.col("c_custkey").cast("string")))
    e = c.select(F.col("n_name").alias("file"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.lit("").alias("description"), attributes.alias("attributes"))
    r = t("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("n_name").alias("file"), F.col("o_orderkey").alias("ord"), F.col("c_name").alias("head"), F.lit("placed").alias("relation"), F.col("o_orderkey").cast("string").alias("tail"), F.col("o_orderpriority").alias("description"))
    readers.write_graph_json(e, r, path, twice=True)
    g = readers.graph_lines(spark, path)
    got = readers.entities(g).groupBy("file").agg(F.count("*").alias("entities"), F.count_distinct("type").alias("types"), F.sum(F.coalesce(F.size("attributes"), F.lit(0))).cast("long").alias("attributes"))
    return got.join(readers.relations(g).groupBy("file").agg(F.count("*").alias("relations")), "file", "left").select("file", "entities", "types", F.greatest("attributes", F.lit(0)).alias("attributes"), F.coalesce("relations", F.lit(0)).cast("long").alias("relations"))


@query("SELECT lower(trim(p_name)) AS key, min(p_partkey)::VARCHAR AS first_code, count(*) AS n FROM part GROUP BY 1")
def lexicon_files(t):
    """A lexicon written as CSV with a byte order mark and read back."""
    path = shared_dir(t.spark)
    readers.write_csv(t("part").select(F.concat(F.lit(" "), F.upper("p_name")).alias("name"), F.col("p_partkey").alias("code")), path)
    lex = readers.lexicon(t.spark, path, ["name", "code", "missing"])
    return lex.where("missing is null").groupBy("key").agg(F.min(F.col("code").cast("long")).cast("string").alias("first_code"), F.count("*").alias("n"))


@query("SELECT event_type AS value, count(*) AS n FROM (SELECT event_type FROM events UNION ALL SELECT event_type FROM events) GROUP BY 1")
def trace_files(t):
    """Traces added twice to JSON lines, and read back; the sorted types as text beside them."""
    path = shared_dir(t.spark)
    for _ in range(2):
        readers.append_traces(t("events").select("event_id", "event_type"), f"{path}/traces")
    got = readers.json_lines(t.spark, f"{path}/traces", "event_id long, event_type string")
    readers.write_types(got, "event_type", f"{path}/types")
    return t.spark.read.text(f"{path}/types").join(got.groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("n")), "value")


@query("SELECT p_partkey::VARCHAR AS cui, p_name AS str FROM part")
def pipe_files(t):
    """A table without header, parted by |, of which two columns are read."""
    path = shared_dir(t.spark)
    t("part").select(F.concat_ws("|", F.col("p_partkey").cast("string"), F.lit('"ENG'), F.lit(""), "p_name", F.lit("")).alias("value")).write.text(path)
    return readers.pipe_table(t.spark, path, {0: "cui", 3: "str"}, 5)


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type <> '' GROUP BY 1")
def category_counts(t):
    blank = F.when(F.col("event_id") < 0, F.lit("x")).otherwise(F.concat(F.lit(" "), "event_type", F.lit(" ")))
    return evaluation.category_counts(t("events").withColumn("c", blank), "c").withColumnRenamed("category", "event_type")
