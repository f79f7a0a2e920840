"""Queries of type cleaning and lexicons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.functions import profiles as P
from kgspark.functions import text, typing_rules
from kgspark.operators import cleaning
from kgspark.plans.registry import query, text_values

#: Labels with each sign, in each script, and hard cases: (ord, label).
LABELS = [(i, x) for i, x in enumerate(["burn_injury", "MRI", "烧伤 type-II", "Figure 1", "图 1", "图表 1", "Fig. 2", "fig. 2", "Anatomical Structure", "", None, "Thing", "left red hand wound", "acute (deep) burn", "两侧 烧伤", "wound\\site/left", "Section 3", "table of contents", "CT scan", "Infection", "method of care in the ward", "  spaced   label ", "double\\\\slash", "药物", "Injured person", "急性感染", "X-ray picture", "skin graft", "first-degree burn"])]


def _q(x: str) -> str:
    return x.replace("'", "''")


def _any(c: str, tokens: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{_q(x.lower())}')" for x in tokens) + ")"


def fine_sql(c: str, profile: P.Profile = P.PACKAGE) -> str:
    """SQL of the number of signs that a label shows."""
    c = f"trim({c})"
    found = lambda p: f"regexp_matches({c}, '(?i){p}')"
    signs = [f"len(regexp_split_to_array({c}, '\\s+')) >= 4", _any(c, P.COLOURS), _any(c, profile.sides), f"({_any(c, P.DEGREES)} OR {found(P.ROMAN)} OR {found(P.DEGREE)})", _any(c, P.PLACES), _any(c, P.TIMES), "(" + " OR ".join(f"contains({c}, '{x}')" for x in profile.signs) + ")", found(P.PREPOSITIONS)]
    return "(" + " + ".join(f"({s})::INT" for s in signs) + ")"


def case_sql(c: str, rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '(?i){_q(p)}') THEN '{_q(x)}'" for p, x in rules) + " ELSE 'Thing' END"


_WORDS = "regexp_replace(regexp_replace(trim({0}), '[_\\-]+', ' ', 'g'), '\\s+', ' ', 'g')"
_LABEL = "array_to_string([CASE WHEN regexp_matches(x, '[A-Za-z]') THEN upper(x[1]) || lower(x[2:]) ELSE x END FOR x IN string_split(" + _WORDS + ", ' ')], ' ')"


@query(f"SELECT p_partkey, {_LABEL.format('p_name')} AS label FROM part UNION ALL SELECT -1 - ord, {_LABEL.format('label')} FROM {text_values(LABELS, 'ord, label')} WHERE label IS NOT NULL")
def type_label_norm(t):
    own = t.values(LABELS, "ord long, label string").where("label is not null").select((-1 - F.col("ord")).alias("p_partkey"), text.type_label(F.col("label")).alias("label"))
    return t("part").select("p_partkey", text.type_label(F.col("p_name")).alias("label")).unionByName(own)


def _labelled(t) -> DataFrame:
    own = t.values(LABELS, "id long, label string").where("label is not null").select((-1 - F.col("id")).alias("id"), "label")
    names = t("part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("label"))
    return names.unionByName(own)


_LABELLED = f"(SELECT p_partkey AS id, p_name || ' ' || p_type AS label FROM part UNION ALL SELECT -1 - id, label FROM {text_values(LABELS, 'id, label')} WHERE label IS NOT NULL)"


@query(f"SELECT id, {fine_sql('label')} AS package, {fine_sql('label', P.PATTERNS)} AS patterns, {fine_sql('label', P.ANALYSIS)} AS analysis, {fine_sql('label')} >= 2 AS fine FROM {_LABELLED}")
def fine_grained_flags(t):
    score = lambda p: typing_rules.fine_grained_score(F.col("label"), p)
    return _labelled(t).select("id", *[score(p).alias(n) for n, p in P.PROFILES.items()], typing_rules.is_fine_grained(F.col("label")).alias("fine"))


@query(f"SELECT id, {case_sql('label', P.WORD_PARENTS)} AS package, {case_sql('label', P.PATTERN_PARENTS)} AS patterns, {case_sql('label', P.ANALYSIS_PARENTS)} AS analysis FROM {_LABELLED}")
def suggest_parent(t):
    return _labelled(t).select("id", *[typing_rules.suggest_parent(F.col("label"), p).alias(n) for n, p in P.PROFILES.items()])


# Hand-written results: label, type, whether a prefix demotes it, whether the wide and the narrow pattern do.
_DEMOTED = [("Figure 1", True, True, True), ("图 1", True, True, True), ("图表 1", True, False, False), ("Fig. 2", True, False, False), ("fig. 2", False, False, False), ("Section 3", False, True, False), ("table of contents", False, True, False), ("MRI", False, False, False), ("Imagery", True, False, False), ("diagram", False, True, True), ("Illustration", True, True, True)]


@query("SELECT * FROM " + text_values(_DEMOTED, "label, by_prefix, by_wide_pattern, by_narrow_pattern"))
def non_entity_demotion(t):
    flags = {"by_prefix": P.PACKAGE, "by_wide_pattern": P.PATTERNS, "by_narrow_pattern": P.ANALYSIS}
    return t.values([(r[0],) for r in _DEMOTED], "label string").select("label", *[typing_rules.is_non_entity(F.col("label"), p).alias(n) for n, p in flags.items()])


# Hand-written results: ord, name, type, and type_original, type, subTypeLabel, demoted_reason after the first step.
_NORMALIZED = [
    (1, " a ", "burn_injury", "a", "burn_injury", "Burn Injury", None, None),
    (2, "b", "MRI", "b", "MRI", "Mri", None, None),
    (3, "c", "烧伤 type-II", "c", "烧伤 type-II", "烧伤 Type Ii", None, None),
    (4, "d", "Figure 1", "d", "Figure 1", "Thing", "Figure 1", "non_entity_like_type"),
    (5, "e", "figure_2", "e", "figure_2", "Thing", "Figure 2", "non_entity_like_type"),
    (6, "f", "", "f", None, "", None, None),
    (7, "g", None, "g", None, None, None, None),
    (8, None, " 图 1", None, " 图 1", "Thing", "图 1", "non_entity_like_type"),
]


@query("SELECT ord, n AS name, type_original, type, subTypeLabel, demoted_reason FROM " + text_values([(r[0], *r[3:]) for r in _NORMALIZED], "ord, n, type_original, type, subTypeLabel, demoted_reason"))
def normalize_entities(t):
    rows = t.values([r[:3] for r in _NORMALIZED], "ord int, name string, type string")
    return cleaning.normalize_entities(rows).select("ord", "name", "type_original", "type", "subTypeLabel", "demoted_reason")


@query("SELECT label, semantic_type FROM " + text_values([*P.SEMANTIC_TYPES.items(), ("Thing", None), ("", None)], "label, semantic_type"))
def semantic_types(t):
    return t.values([(k,) for k in [*P.SEMANTIC_TYPES, "Thing", ""]], "label string").select("label", typing_rules.semantic_type(F.col("label")).alias("semantic_type"))


#: Entities by name, type, description with each way to a type.
TYPED = [("乙醇", "Chemical", ""), ("x", "Disease", "伤口感染"), ("x", "Person", ""), ("x", "Plant", "a plant"), ("x", "Bacterium", None), ("y", "Eukaryotes", "none"), ("z", "Zoo", "quiet"), ("structure", "Zoo", None), (None, "Finding", None), ("q", "Neoplastic Process", ""), ("r", "Medicine", "")]


def _best_sql(c: str) -> str:
    rows = [f"CASE WHEN regexp_matches({c}, '(?i){'|'.join(map(_q, words))}') THEN {{'score': {s}::DOUBLE, 'place': {-i}, 'label': '{_q(x)}'}} END" for i, (words, x, s) in enumerate(P.SCORED_RULES)]
    return "list_max(list_filter([" + ", ".join(rows) + "], lambda x: x IS NOT NULL))"


@query(f"""WITH e AS (SELECT row_number() OVER () AS id, * FROM {text_values(TYPED, 'name, kind, description')}), all_of AS (SELECT -id AS id, name, kind, description FROM e UNION ALL SELECT conv_id * 1000 + turn, role, NULL, text FROM conversations),
b AS (SELECT *, {_best_sql("coalesce(name, '') || ' ' || coalesce(kind, '') || ' ' || coalesce(description, '')")} AS m FROM all_of)
SELECT id, CASE {' '.join(f"WHEN name = '{n}' THEN '{_q(x)}'" for n, (x, s) in P.NAMED_TYPES.items())} WHEN m IS NOT NULL THEN m.label WHEN kind IN ({', '.join(f"'{_q(k)}'" for k in P.UNMAPPED_TYPES)}) THEN 'UNMAPPED' WHEN kind IN ({', '.join(f"'{_q(k)}'" for k in P.TARGET_TYPES)}) THEN kind ELSE 'UNMAPPED' END AS label,
(CASE {' '.join(f"WHEN name = '{n}' THEN {s}" for n, (x, s) in P.NAMED_TYPES.items())} WHEN m IS NOT NULL THEN m.score WHEN kind IN ({', '.join(f"'{_q(k)}'" for k in P.TARGET_TYPES)}) AND kind NOT IN ({', '.join(f"'{_q(k)}'" for k in P.UNMAPPED_TYPES)}) THEN 0.7 ELSE 0 END)::DOUBLE AS score FROM b""")
def rule_scored_type(t):
    own = t.values([(-i - 1, *r) for i, r in enumerate(TYPED)], "id long, name string, kind string, description string")
    said = t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("name"), F.lit(None).cast("string").alias("kind"), F.col("text").alias("description"))
    m = typing_rules.mapped_type(F.col("name"), F.col("kind"), F.col("description"))
    return own.unionByName(said).select("id", m["label"].alias("label"), m["score"].alias("score"))


_CUT = "greatest(5, list_sort(list(n))[floor(count(*) * 0.2)::INT + 1])"


@query(f"SELECT {_CUT} AS cut FROM (SELECT count(*) AS n FROM part GROUP BY p_name)")
def long_tail_cut(t):
    return cleaning.long_tail_cut(cleaning.type_counts(t("part"), "p_name"))


_KINDS = "(SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_name || ' ' || p_type || ' (left) ' || p_size ELSE p_name END AS type FROM part)"


@query(f"""WITH p AS {_KINDS}, k AS (SELECT type, count(*) AS n FROM p GROUP BY type), c AS (SELECT {_CUT} AS cut FROM k), h AS (SELECT p.*, n <= cut AND {fine_sql('p.type')} >= 2 AS hit FROM p JOIN k USING (type), c)
SELECT p_partkey, CASE WHEN hit THEN {case_sql('type', P.WORD_PARENTS)} ELSE type END AS type, CASE WHEN hit THEN type END AS "subTypeLabel", CASE WHEN hit THEN 'long_tail_fine_grained' END AS demoted_reason FROM h""")
def long_tail_demote(t):
    return cleaning.demote_long_tail(_kinds(t)).select("p_partkey", "type", "subTypeLabel", "demoted_reason")


def _kinds(t) -> DataFrame:
    rare = F.concat("p_name", F.lit(" "), "p_type", F.lit(" (left) "), F.col("p_size").cast("string"))
    return t("part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, rare).otherwise(F.col("p_name")).alias("type"))


@query("SELECT event_type AS type, count(*) AS n FROM events WHERE event_type <> '' GROUP BY 1")
def type_summary(t):
    return cleaning.type_counts(t("events"), "event_type").orderBy(F.desc("n"), "type")


_REPORT = f"""WITH p AS (SELECT p_partkey AS ord, p_brand AS name, type FROM {_KINDS} JOIN part USING (p_partkey)), k AS (SELECT type, count(*) AS n, array_to_string(list(name ORDER BY ord)[1:35], '; ') AS example_entities FROM p GROUP BY type), c AS (SELECT {_CUT} AS cut FROM k),
r AS (SELECT type, n, n <= cut AS is_long_tail, {fine_sql('type', P.ANALYSIS)} >= 2 AS is_fine_grained, {case_sql('type', P.ANALYSIS_PARENTS)} AS suggested_parent, example_entities, cut FROM k, c) """


def _report(t) -> tuple[DataFrame, DataFrame]:
    rows = _kinds(t).join(t("part").select("p_partkey", F.col("p_brand").alias("name")), "p_partkey").withColumnRenamed("p_partkey", "ord")
    return cleaning.type_report(rows, P.ANALYSIS), cleaning.long_tail_cut(cleaning.type_counts(rows))


@query(_REPORT + "SELECT * EXCLUDE (cut) FROM r")
def type_report(t):
    return _report(t)[0]


@query(_REPORT + "SELECT 'total_types' AS metric, count(*)::BIGINT AS value FROM r UNION ALL SELECT 'long_tail_cut_value', max(cut) FROM r UNION ALL SELECT 'num_long_tail', count(*) FILTER (WHERE is_long_tail) FROM r UNION ALL SELECT 'num_fine_grained', count(*) FILTER (WHERE is_fine_grained) FROM r UNION ALL SELECT 'num_both', count(*) FILTER (WHERE is_long_tail AND is_fine_grained) FROM r")
def report_summary(t):
    return cleaning.report_summary(*_report(t))


_RELATED = "(SELECT s_suppkey AS ord, 'in' AS type, s_name AS f, n_name AS t FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 1000000 + l_orderkey * 10 + l_linenumber, l_returnflag, s_name, CASE WHEN l_linestatus = 'F' THEN 'part ' || l_partkey END FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"


def _related(t) -> tuple[DataFrame, DataFrame]:
    s, n = t("supplier"), t("nation")
    home = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("ord"), F.lit("in").alias("type"), F.col("s_name").alias("from"), F.col("n_name").alias("to"))
    sold = t("lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select((F.lit(1000000) + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_returnflag").alias("type"), F.col("s_name").alias("from"), F.when(F.col("l_linestatus") == "F", F.concat(F.lit("part "), "l_partkey")).alias("to"))
    e = s.select(F.concat(F.lit(" "), "s_name").alias("name"), F.lit("supplier").alias("type"), F.lit("").alias("description"), F.create_map(F.lit("key"), F.col("s_suppkey").cast("string"), F.lit("nation"), F.col("s_nationkey").cast("string")).alias("attributes"))
    e = e.unionByName(n.select(F.col("n_name").alias("name"), F.lit("").alias("type"), F.concat(F.lit("nation "), "n_nationkey").alias("description"), F.lit(None).cast("map<string,string>").alias("attributes")))
    return e, home.unionByName(sold)


_TRIPLE = "coalesce(f, 'None') || ' --' || coalesce(type, 'None') || '--> ' || coalesce(t, 'None')"


@query(f"""WITH r AS {_RELATED}, o AS (SELECT f AS k, array_to_string(list({_TRIPLE} ORDER BY ord, {_TRIPLE})[1:3], '; ') AS x FROM r GROUP BY f), i AS (SELECT t AS k, array_to_string(list({_TRIPLE} ORDER BY ord, {_TRIPLE})[1:3], '; ') AS x FROM r WHERE t IS NOT NULL GROUP BY t)
SELECT s_name AS name, concat_ws('；', s_name, '（类型：supplier）', '关联: ' || o.x, '被关联: ' || i.x, '属性: key: ' || s_suppkey || '; nation: ' || s_nationkey) AS verbalization FROM supplier LEFT JOIN o ON o.k = s_name LEFT JOIN i ON i.k = s_name
UNION ALL SELECT n_name, concat_ws('；', n_name, 'nation ' || n_nationkey, '关联: ' || o.x, '被关联: ' || i.x) FROM nation LEFT JOIN o ON o.k = n_name LEFT JOIN i ON i.k = n_name""")
def verbalize(t):
    return cleaning.verbalize(*_related(t)).select(F.trim("name").alias("name"), "verbalization")


_NAMES = "(SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ' ' || lower(n_name) || ' ' WHEN c_custkey % 3 = 1 THEN n_name ELSE c_mktsegment END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _names(t) -> DataFrame:
    n = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), F.lower("n_name"), F.lit(" "))).when(F.col("c_custkey") % 3 == 1, F.col("n_name")).otherwise(F.col("c_mktsegment"))
    return n.select("c_custkey", name.alias("name"))


@query(f"SELECT c_custkey, min(n_nationkey) AS ord FROM {_NAMES} LEFT JOIN nation ON lower(trim(n_name)) = lower(trim(name)) GROUP BY c_custkey")
def lexicon_left_join(t):
    lex = t("nation").select(F.lower(F.trim("n_name")).alias("key"), "n_nationkey").groupBy("key").agg(F.min("n_nationkey").alias("ord"))
    return _names(t).join(lex, F.lower(F.trim("name")) == F.col("key"), "left").select("c_custkey", "ord")


@query()
def lexicon_fuzzy(t):
    names = t("part").select(F.concat("p_name", F.lit("s")).alias("name"))
    return cleaning.exact_then_fuzzy(names, t("part").groupBy("p_name").agg(F.min("p_partkey").alias("ord")).withColumnRenamed("p_name", "name"), 0.9)


_CLEAN_SQL = f"""WITH e AS (SELECT c_custkey, name FROM {_NAMES}), m AS (SELECT e.*, n_nationkey AS k FROM e LEFT JOIN nation ON lower(trim(name)) = lower(n_name)) """


@query(_CLEAN_SQL + "SELECT c_custkey, trim(name) AS name, CASE WHEN k IS NOT NULL THEN 'region ' || k END AS umls_semantic_type, CASE WHEN k IS NOT NULL THEN 'lexicon-umls-st' END AS umls_semantic_type_source, CASE WHEN k % 2 = 0 THEN 'C' || k END AS umls_cui, CASE WHEN k % 2 = 0 THEN 'lexicon-umls-cui' END AS umls_cui_source, NULL::VARCHAR AS snomed_id FROM m")
def lexicon_exact(t):
    """Cleaning from end to end with two lexicons that only exact names match."""
    n = t("nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"))
    semantic = n.withColumn("semantic_type", F.concat(F.lit("region "), "ord"))
    concepts = n.where("ord % 2 = 0").select("name", "ord", F.concat(F.lit("C"), "ord").alias("cui"), F.lit("").alias("pref_label"))
    e = _names(t).withColumns({"type": F.lit("nation_name"), "description": F.lit("")})
    none = t.values([], "ord long, type string, `from` string, `to` string")
    out = cleaning.clean(e, none, P.Profile(P.WORD_PARENTS, threshold=0.999), semantic=semantic, concepts=concepts)["entities"]
    return out.select("c_custkey", "name", "umls_semantic_type", "umls_semantic_type_source", "umls_cui", "umls_cui_source", "snomed_id")


_CONCEPTS = "(SELECT p_brand AS cui, CASE WHEN p_size % 2 = 0 THEN 'ENG' ELSE 'CHI' END AS lat, CASE WHEN p_size % 3 = 0 THEN 'SNOMEDCT_US' WHEN p_size % 3 = 1 THEN 'MSH' END AS sab, 'PT' AS tty, p_partkey::VARCHAR AS code, ' ' || upper(p_name) AS str FROM part)"
_STY = "(SELECT DISTINCT 'Brand#' || p_size AS cui, 'T' || length(p_type) AS tui, p_type AS sty FROM part)"


def _concepts(t) -> DataFrame:
    size = F.col("p_size")
    sab = F.when(size % 3 == 0, F.lit("SNOMEDCT_US")).when(size % 3 == 1, F.lit("MSH"))
    names = t("part").select(F.col("p_brand").alias("cui"), F.when(size % 2 == 0, F.lit("ENG")).otherwise(F.lit("CHI")).alias("lat"), sab.alias("sab"), F.lit("PT").alias("tty"), F.col("p_partkey").cast("string").alias("code"), F.concat(F.lit(" "), F.upper("p_name")).alias("str"))
    semantic = t("part").select(F.concat(F.lit("Brand#"), "p_size").alias("cui"), F.concat(F.lit("T"), F.length("p_type")).alias("tui"), F.col("p_type").alias("sty"))
    return cleaning.concept_lexicon(names, semantic, "ENG")


_LEXICON = f"""WITH g AS (SELECT cui, array_to_string(list_sort(list(DISTINCT sty)), ';') AS sty, array_to_string(list_sort(list(DISTINCT tui)), ';') AS tui FROM {_STY} GROUP BY cui),
x AS (SELECT lower(trim(str)) AS name, c.cui, '' AS pref_label, coalesce(sty, '') AS semantic_type, coalesce(tui, '') AS tui, sab, tty, code FROM {_CONCEPTS} c LEFT JOIN g USING (cui) WHERE lat = 'ENG') """


@query(_LEXICON + "SELECT * FROM x")
def concept_lexicon(t):
    return _concepts(t)


@query(_LEXICON + "SELECT name, coalesce(array_to_string(list_sort(list(DISTINCT s) FILTER (WHERE s <> '')), ';'), '') AS semantic_type, coalesce(array_to_string(list_sort(list(DISTINCT u) FILTER (WHERE u <> '')), ';'), '') AS tui FROM (SELECT name, unnest(string_split(semantic_type, ';')) AS s, NULL AS u FROM x UNION ALL SELECT name, NULL, unnest(string_split(tui, ';')) FROM x) GROUP BY name")
def semantic_lexicon(t):
    return cleaning.semantic_lexicon(_concepts(t))


@query(_LEXICON + "SELECT name, code AS snomed_id, '' AS fsn, '' AS semantic_tag, cui, tui, semantic_type FROM x WHERE sab LIKE 'SNOMEDCT%'")
def clinical_lexicon(t):
    return cleaning.clinical_lexicon(_concepts(t))


@query("SELECT p_brand, array_to_string(list_sort(list_distinct(list(w))), ';') AS words FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w <> '' GROUP BY p_brand")
def multi_value_union(t):
    w = t("part").select("p_brand", F.explode(F.split("p_name", " ")).alias("w")).where("w <> ''")
    return w.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("w")), ";").alias("words"))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang IS NULL OR d.lang = '' OR (l.quality IS NULL AND l.toxic IS NULL)")
def unmapped_filter(t):
    rows = t("documents").join(t("labels"), "doc_id", "left")
    rows = rows.select(F.col("doc_id").cast("string").alias("name"), F.lit("").alias("type"), F.col("lang").alias("umls_semantic_type"), F.col("quality").cast("string").alias("umls_cui"), F.col("toxic").cast("string").alias("snomed_id"), F.lit("").alias("description"), F.lit("").alias("verbalization"))
    return cleaning.unmapped(rows).select(F.col("name").cast("long").alias("doc_id"))


@query(f"SELECT 'entities' AS metric, count(*) AS value FROM part UNION ALL SELECT 'relations', count(*) FROM lineitem UNION ALL SELECT 'types', count(DISTINCT p_name) FROM part UNION ALL SELECT 'cut', {_CUT}::BIGINT FROM (SELECT count(*) AS n FROM part WHERE p_name <> '' GROUP BY p_name)")
def clean_summary(t):
    return cleaning.summary(t("part").withColumnRenamed("p_name", "type"), t("lineitem"))
