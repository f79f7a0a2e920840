"""Operators, readers and functions that the queries reach only in part, on literals."""

import difflib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark import providers, staging
from kgspark.functions import normalize, text
from kgspark.operators import cleaning, evaluation, graph, layout, linking, retrieval
from kgspark.plans import evaluate
from kgspark.sources import readers
from kgspark.streaming.topics import sentence_stream


def test_topics(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"topic": "x", "content": "One."}, {"topic": "y", "content": None}, {"topic": "z"}]))
    assert [(r.topic_idx, r.topic) for r in readers.topics(spark, str(tmp_path)).orderBy("topic_idx").collect()] == [(1, "x"), (2, "y"), (3, "z")]
    assert [r.topic for r in readers.topics(spark, str(tmp_path), 3).collect()] == ["z"]
    (tmp_path / "b").mkdir()
    (tmp_path / "b/p.q.json").write_text(json.dumps({"sentences": ["A.", "B."]}))
    assert [(r.topic, r.content) for r in readers.extracted_topics(spark, str(tmp_path / "b")).collect()] == [("p", "```A.\n\nB.```")]
    assert [tuple(r) for r in readers.direct_text(spark, "t", "c").collect()] == [(1, "t", "c")]


def test_json_lines_leave_out_bad_ones(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{broken\n{"x": 2}\n')
    assert sorted(r.x for r in readers.json_lines(spark, str(tmp_path), "x int").collect()) == [1, 2]
    assert json.loads(readers.lines_as_array(spark, str(tmp_path)).first().json) == [{"x": 1}, {"x": 2}]


def test_lexicon(spark, tmp_path):
    (tmp_path / "l.csv").write_text("\ufeffname,cui,other\n Burn ,C1,a\n,C2,b\n  ,C3,c\n\"x, y\",C4,d\nburn,C5,e\n", encoding="utf-8")
    rows = readers.lexicon(spark, str(tmp_path / "l.csv"), ["name", "cui", "lost"]).orderBy("ord").collect()
    assert [(r.key, r.cui, r.lost) for r in rows] == [("burn", "C1", None), ("nan", "C2", None), ("x, y", "C4", None), ("burn", "C5", None)]
    assert readers.lexicon(spark, str(tmp_path / "none.csv"), ["name", "cui"]).count() == 0


def test_graph_dialects(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"entities": ["x", {"name": "y", "type": "T", "attributes": {"k": "v"}}], "relations": [["x", "r", "y"], {"subject": "y", "predicate": "", "relation": "p", "object": "x"}, 7]}))
    (tmp_path / "b.json").write_text("{broken")
    g = readers.graph_json(spark, str(tmp_path))
    assert sorted((r["head"], r.relation, r.tail) for r in readers.relations(g).collect()) == [("x", "r", "y"), ("y", "p", "x")]
    assert [(r["head"], r.relation) for r in readers.relations(g, objects_only=True).collect()] == [("y", "p")]
    assert [(r.name, r.attributes) for r in readers.entities(g, objects_only=True).collect()] == [("y", {"k": "v"})]
    assert readers.graph_json(spark, str(tmp_path / "a.json")).count() == 1
    (tmp_path / "d.txt").write_text("entities={'b', 'a'} edges={'r'} relations={('a', 'r', 'b'), ('b', 'it is', 'a')}")
    r = readers.repr_graphs(spark, str(tmp_path / "d.txt")).first()
    assert r.entities == ["a", "b"] and r.relations == [["a", "r", "b"], ["b", "it is", "a"]]


def test_graph_tables(spark, tmp_path):
    spark.createDataFrame([("a",), ("a",), ("b",)], "title string").write.parquet(f"{tmp_path}/e")
    spark.createDataFrame([("a", "b", "d", 1.0)], "source string, target string, description string, weight double").write.parquet(f"{tmp_path}/r")
    nodes, edges = readers.graph_tables(spark, f"{tmp_path}/e", f"{tmp_path}/r")
    assert sorted(r.name for r in nodes.collect()) == ["a", "b"] and [tuple(r) for r in edges.collect()] == [("a", "b", "d")]


def test_graph_writer(spark, tmp_path):
    e = spark.createDataFrame([("g", 2, "b", None, ""), ("g", 1, "it's", "T", "d"), ("h", 1, "z", "", None)], "file string, ord int, name string, type string, description string")
    r = spark.createDataFrame([("g", 1, "it's", "r", "b", "")], "file string, ord int, head string, relation string, tail string, description string")
    for twice in (False, True):
        readers.write_graph_json(e, r, f"{tmp_path}/{twice}", twice=twice)
        g = readers.graph_lines(spark, f"{tmp_path}/{twice}")
        assert [x.name for x in readers.entities(g).where("file = 'g'").orderBy("ord").collect()] == ['it"s', "b"]
        assert [(x["head"], x.relation, x.tail) for x in readers.relations(g).collect()] == [('it"s', "r", "b")]


def test_property_graph_and_view(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"id":"1","labels":["A"],"props":{"name":"x","top_level_category":"finding"}}\n{"id":"2","labels":[],"props":{}}\n')
    (tmp_path / "r.json").write_text('{"id":"9","type":"t","source":"1","target":"2","props":{}}\n')
    nodes, rels = readers.property_graph(spark, str(tmp_path / "n.json"), str(tmp_path / "r.json"))
    drawn, lines = readers.graph_view(nodes, rels)
    assert [(r.caption, r.color) for r in drawn.orderBy("id").collect()] == [("x", "#ff7f0e"), ("", None)]
    assert [(r.source, r.target, r.caption) for r in lines.collect()] == [("1", "2", "t")]
    readers.write_graph_view(nodes, rels, f"{tmp_path}/view")
    assert spark.read.json(f"{tmp_path}/view/nodes").count() == 2
    assert graph.pattern(nodes, rels).count() == 1


def test_terminology(spark, tmp_path):
    for name, body in {"concepts": "concept_id\tfsn\n1\tBurn (disorder)\n", "descriptions": "ord\tterm\tconcept_id\n0\tBurn of skin\t1\n", "is_a": "child\tparent\n1\t2\n2\t404684003\n"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "t.tsv").write_text(body)
    t = readers.terminology(spark, str(tmp_path))
    tops = spark.createDataFrame([(404684003, "finding")], "concept_id long, category string")
    e = spark.createDataFrame([("skin BURN",), ("other",), (None,)], "entity_name_standard string")
    got = {r.entity_name_standard: (r.align_entity_type, r.top_level_category) for r in linking.aligned(e, t["descriptions"], t["is_a"], tops).collect()}
    assert got == {"skin BURN": ("disorder", "finding"), "other": ("", ""), None: ("", "")}


def test_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_text("head line\nleft one" + " " * 40 + "right one\nleft two" + " " * 40 + "right two\fnext page")
    words = readers.page_words(spark, str(tmp_path), providers.Rules())
    whole = {r.page: r.text for r in readers.page_texts(words).collect()}
    assert whole == {1: "head line\nleft one right one\nleft two right two", 2: "next page"}
    two = {r.page: r.text for r in readers.page_texts(words, 2, 5.0).collect()}
    assert two == {1: "left one\nleft two\nright one\nright two"}
    boxes = spark.createDataFrame([(b"text", [0.0, 0.0, 1.0, 1.0])], "image binary, box array<double>")
    assert boxes.select(providers.area_text(providers.Rules())("image", "box").alias("t")).first().t == "text"


def test_reading_order(spark):
    boxes = spark.createDataFrame([(1, 0, 60.0, 5.0, 80.0), (1, 1, 0.0, 9.0, 20.0), (1, 2, 0.0, 9.0, 30.0), (1, 3, 40.0, 0.0, 60.0)], "page int, box_ord int, x0 double, y0 double, x1 double")
    got = layout.reading_order(boxes.withColumn("width", F.lit(100.0)), ["page"]).orderBy("place").collect()
    assert [r.box_ord for r in got] == [1, 2, 3, 0]


def test_sentence_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"topic":"t","content":"One. Two."}\n')
    q = sentence_stream(spark, f"{tmp_path}/in").writeStream.format("memory").queryName("sentences_seen").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.topic, r.ord, r.sentence) for r in spark.table("sentences_seen").collect()) == [("t", 0, "One."), ("t", 1, "Two.")]


def test_sentences(spark):
    cases = {"J. K. Rowling wrote. Dr. Smith read.": ["J. K. Rowling wrote.", "Dr.", "Smith read."], "一。\u3000二！三": ["一。", "二！三"], "aa.\u00a0b?\nc": ["aa.", "b?", "c"], "x.  y \u0001 z. \u0001 end": ["x.  y \u0001 z.  \u0001 end".replace("z.  ", "z. ")], "": []}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.sentences(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == cases


def test_staged_tables_go_and_runs_resume(spark, tmp_path):
    df = staging.staged(spark.range(5))
    path = staging._PATHS[df]
    staging.unstaged(df, None, spark.range(1))
    staging.unstaged(df)
    assert not readers.exists(spark, path)
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert staging.resumed(make, spark, f"file://{tmp_path}/stage").count() == 3
    assert made == [1]


def test_closure_goes_beyond_any_depth(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(45)] + [(100, 101), (101, 100), (None, 1), (7, None)], "child int, parent int")
    got = {(r.child, r.ancestor) for r in graph.closure(edges).collect()}
    assert got == {(i, j) for i in range(45) for j in range(i + 1, 46)} | {(100, 101), (101, 100), (100, 100), (101, 101)}
    assert graph.closure(edges.limit(0)).count() == 0


def test_lexicon_matches_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcde "), rng.integers(1, 14))) for _ in range(160)]
    names = ["".join(rng.choice(list("abcdeé "), rng.integers(1, 14))) for _ in range(60)] + [w[:-1] + "x" for w in words[:60]] + [w.upper() for w in words[:5]] + ["", " "]
    lex = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "name string, ord long")
    for threshold in (0.6, 0.9):
        got = {r.name: (r.ord, round(r.score, 9)) for r in cleaning.exact_then_fuzzy(spark.createDataFrame([(n,) for n in names], "name string"), lex, threshold).collect()}
        keys = {}
        for i, w in enumerate(words):
            keys.setdefault(w.lower().strip(" "), i)
        keys.pop("", None)
        for n in names:
            key = n.lower().strip(" ")
            if key in keys:
                assert got[n] == (keys[key], 1.0)
                continue
            best = max(((difflib.SequenceMatcher(None, key, k).ratio(), -i) for k, i in keys.items()), default=(0, 0)) if key else (0, 0)
            assert got[n] == ((-best[1], round(best[0], 9)) if best[0] >= threshold else (None, 0.0)), n


def test_retrieval_by_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(120, 5)).round(2)
    v[7] = 0
    rows = [(i, i % 3, v[i].tolist()) for i in range(120)] + [(500, None, [1.0] * 5), (501, 0, None)]
    df = spark.createDataFrame(rows, "id long, g int, v array<double>").withColumn("at", -F.col("id"))
    unit = v / np.where(np.linalg.norm(v, axis=1, keepdims=True) == 0, 1, np.linalg.norm(v, axis=1, keepdims=True))
    sim = unit @ unit.T
    was, retrieval.BLOCK = retrieval.BLOCK, 7
    try:
        pairs = {(r.a, r.b) for r in retrieval.pairs_within(df, "g", "at", 0.4).collect()}
        across = {(r.a, r.b) for r in retrieval.pairs_across(df, df, "g", 0.4).collect()}
        top = retrieval.top_within(df, df, "g", 4, order="at").collect()
    finally:
        retrieval.BLOCK = was
    want = {(i, j) for i in range(120) for j in range(120) if i % 3 == j % 3 and sim[i, j] > 0.4}
    assert pairs == {(i, j) for i, j in want if i > j}  # the later id stands first in this order
    assert across == want
    for q in range(120):
        best = sorted((-round(sim[q, j], 6), -j) for j in range(120) if j % 3 == q % 3)[:4]
        got = sorted((r.rank, r.id) for r in top if r.query == q)
        near = [round(sim[q, i], 6) for _, i in got]
        assert near == pytest.approx([-b[0] for b in best], abs=2e-6)


def test_contexts_and_answers(spark):
    e = spark.createDataFrame([(1, 0, "Ada", "Person", "wrote"), (1, 1, "Notes", "Work", "")], "topic int, ord int, name string, type string, description string")
    r = spark.createDataFrame([(1, 0, "Ada", "Notes", "old", ""), (1, 1, "Ada", "Notes", "wrote", "long"), (1, 2, "Notes", "Engine", "about", "")], "topic int, ord int, src string, dst string, relation string, description string")
    qa = spark.createDataFrame([(1, 0, "Ada Person"), (1, 1, "a volcano"), (2, 0, "no graph")], "topic int, q_idx int, answer string")
    found = {(x.topic, x.q_idx): x.context for x in evaluate.retrieved(qa, e, r, providers.Rules(), k=1).collect()}
    assert found[1, 0] == "name: Ada\ntype: Person\ndescription: wrote name: Notes\ntype: Work\ndescription:  relation: Ada --[wrote]-> Notes--description:long-- relation: Notes --[about]-> Engine--description:--"
    assert found[2, 0] == ""
    results, accuracy = evaluate.retrieval_accuracy(qa, e, r, providers.Rules())
    assert {x.topic: x.accuracy for x in accuracy.collect()} == {1: "50.00%", 2: "0.00%"}

    class Failing(providers.Rules):
        def contains(self, answer, context):
            raise ValueError

    was, providers.time.sleep = providers.time.sleep, lambda s: None
    try:
        judged = spark.createDataFrame([("a", "b")], "x string, y string").select(providers.relation_similarity(providers.Rules())("x", "y").alias("s"), providers.faithfulness(providers.Rules())("x", "y").alias("f")).first()
    finally:
        providers.time.sleep = was
    assert judged.s == 0.0 and judged.f.score == 0.0 and judged.f.reason == "a"
    assert evaluate.relation_vectors(r, providers.Rules(), "topic").count() == 3


def test_graph_comparison(spark):
    kind = "dataid int, name string, type string, description string"
    std = spark.createDataFrame([(1, "Ada Byron", "P", ""), (1, "Engine", "M", ""), (1, "Volcano", "M", "")], kind)
    own = spark.createDataFrame([(1, "byron ada", "P", ""), (1, "Engine", "M", "")], kind)
    rel = "dataid int, ord int, src string, dst string, relation string, description string"
    r1 = spark.createDataFrame([(1, 0, "Ada Byron", "Engine", "wrote about", "undefine")], rel)
    r2 = spark.createDataFrame([(1, 0, "byron ada", "Engine", "wrote about", "")], rel)
    matches, scores = evaluate.compare_graphs((std, r1), (own, r2), providers.Rules())
    assert sorted((m.std, m.found, m.relation_similarity) for m in matches.collect()) == [("Ada Byron", "byron ada", 1.0), ("Engine", "Engine", 1.0)]
    assert [tuple(s) for s in scores.collect()] == [(1, 0.6667, 1.0, 2, 3)]


def test_translation_is_asked_once_a_name(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    class Counting(providers.Rules):
        def translate(self, text, source, target):
            import uuid

            (log / uuid.uuid4().hex).write_text(text)
            if text == "bad":
                raise ValueError("no")
            return text.upper()

    e = spark.createDataFrame([("a", None), (" a ", ""), ("b", "done"), ("bad", " "), ("", None)], "name string, entity_name_standard string")
    got = linking.translated(e, providers.translation(Counting(), tries=2, wait=0.0)("name")).collect()
    assert sorted((r.name, r.entity_name_standard, r.error is None) for r in got) == [("", None, True), (" a ", "A", True), ("a", "A", True), ("b", "done", True), ("bad", " ", False)]
    assert sorted(p.read_text() for p in log.iterdir()) == ["a", "bad", "bad"]
    kinds = e.select(providers.classification(providers.Rules(), ["a", "zoo"])("name").alias("k")).collect()
    assert sorted(r.k for r in kinds) == ["Other", "Other", "Other", "a", "a"]


def test_malformed_relationship_texts():
    read = normalize.relationship_records
    assert read("7") == read('"none"') == read('["a", "b: c"]') == []
    assert read('[{"relation": "r", "target_name": 5}]') == [("r", "5", "", "", "")]
    assert read('["{1, 2}"]') == []
    assert read('["relation: a, target_type: b", "relation: c, target_type: d"]') == [("a", "", "b", "", ""), ("c", "", "d", "", "")]


def test_rouge_of_text_without_spaces():
    assert evaluation.rouge_scores("烧伤 pain", "烧 伤 pain!", evaluation.tokens)[0] == 2 * 3 / 7
    assert evaluation.rouge_scores("烧伤", "烧 伤")[0] == 0


def test_cleaning_of_files(spark, tmp_path):
    from kgspark.plans import clean

    (tmp_path / "a.json").write_text(json.dumps({"entities": [{"name": " Burn ", "type": "burn_injury", "description": "d", "attributes": {"k": "v"}}, "text", {"name": "Pic", "type": "Figure 1"}], "relations": [{"type": "in", "from": "Burn", "to": "Skin"}, ["Burn", "r", "x", ""], {"relation": "of", "head": "Pic", "tail": "Burn"}]}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "st.csv").write_text("name,semantic_type,tui\nburn,Injury,T1\n")
    (tmp_path / "cui.csv").write_text("name,cui,pref_label\nburn,C1,\n")
    inputs = [str(tmp_path / n) for n in ("a.json", "b.json", "none.json")]
    paths = clean.run(spark, inputs, f"{tmp_path}/out", semantic=str(tmp_path / "st.csv"), concepts=str(tmp_path / "cui.csv"), snomed=str(tmp_path / "none.csv"))
    got = {r.name: r for r in spark.read.parquet(paths["entities"]).collect()}
    assert got["Burn"].type == "Burn Injury" and got["Burn"].umls_semantic_type == "Injury" and got["Burn"].umls_cui == "C1" and got["Burn"].snomed_id is None
    assert got["Burn"].verbalization == "Burn；（类型：Burn Injury）；d；关联: Burn --in--> Skin；被关联: Pic --of--> Burn；属性: k: v"
    assert (got["Pic"].type, got["Pic"].subTypeLabel, got["Pic"].type_original) == ("Thing", "Figure 1", "Figure 1")
    summary = {r.metric: r.value for r in readers.lexicon(spark, paths["summary"], ["metric", "value"], "metric").collect()}
    assert summary == {"entities": "2", "relations": "2", "types": "2", "cut": "5"}
    assert [r.name for r in readers.lexicon(spark, paths["unmapped"], ["name"]).collect()] == ["Pic"]
    nothing = clean.run(spark, [str(tmp_path / "none.json")], f"{tmp_path}/empty")
    assert spark.read.parquet(nothing["entities"]).count() == 0
    lists, _ = clean.load(spark, inputs[0]), None
    assert lists[1].count() == 2 and clean.load(spark, inputs[0], objects_only=False)[1].count() == 3
    files = spark.createDataFrame([("b",), ("a",)], "f string")
    assert sorted((r.f, r.topic_idx) for r in clean.by_position(files, "f").collect()) == [("a", 1), ("b", 2)]


def test_construction_resumes(spark, tmp_path):
    from kgspark.plans.construct import construct

    log = tmp_path / "calls"
    log.mkdir()

    class Counting(providers.Rules):
        def mentions(self, text):
            import uuid

            (log / uuid.uuid4().hex).write_text(text)
            return super().mentions(text)

    topics = spark.createDataFrame([("a", "Ada Byron met Charles. Ada Byron met Charles. Charles slept.")], "topic string, content string")
    runs = [[sorted(map(tuple, t.select(sorted(set(t.columns) - {"attributes"})).collect())) for t in construct(topics, Counting(), stages=f"file://{tmp_path}/stages")] for _ in range(2)]
    assert runs[0] == runs[1] and runs[0][1]
    calls = [p.read_text() for p in log.iterdir()]
    assert len([c for c in calls if c == "Charles slept."]) == 1
