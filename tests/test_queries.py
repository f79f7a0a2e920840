"""Each query with SQL against DuckDB on the smallest tables; operators on literals."""

import math
from pathlib import Path

import duckdb
import pytest

from kgspark.functions import normalize
from kgspark.operators.components import connected_components
from kgspark.plans.queries import QUERIES, SQL
from kgspark.sources import readers

SF = "/root/testdata/sf0.001"


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 40), (None, 3)], "a long, b long")
    got = {r.id: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 40: 40, 50: 40}
    assert connected_components(edges.limit(0)).count() == 0


def test_relationships():
    read = normalize.relationship_records
    assert read('["无", "relation"]') == [] == read(None) == read("x")
    assert read('["A - located in - B"]') == [("located in", "B", "", "", "")]
    assert read('["relation: has", "target_name: X", "relation: is", "target_name: Y"]') == [("has", "X", "", "", ""), ("is", "Y", "", "", "")]
    assert read("[\"{'relation': 'has', 'name': 'X'}\", {\"relation\": \"has\", \"target_name\": \"X\"}]") == [("has", "X", "", "", "")]


def test_fuzzy_lexicon(spark):
    from kgspark.operators.cleaning import exact_then_fuzzy

    names = spark.createDataFrame([("Burn",), ("burn injury",), ("zzz",)], "name string")
    lex = spark.createDataFrame([("burn ", 2), ("BURN", 1), ("burn injurys", 3)], "name string, ord long")
    got = {r.name: r.ord for r in exact_then_fuzzy(names, lex, 0.9).collect()}
    assert got == {"Burn": 1, "burn injury": 3, "zzz": None}


def test_graph_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"entities":["x",{"name":"y","type":"T"}],"relations":[["x","r","y"],{"subject":"y","predicate":"p","object":"x"}]}')
    (tmp_path / "b.json").write_text('"{\\"entities\\":[{\\"name\\":\\"z\\"}],\\"relations\\":[]}"')
    (tmp_path / "c.json").write_text("{broken")
    g = readers.graph_json(spark, str(tmp_path))
    assert sorted((r.name, r.type) for r in readers.entities(g).collect()) == [("x", None), ("y", "T"), ("z", None)]
    assert sorted((r.head, r.relation, r.tail) for r in readers.relations(g).collect()) == [("x", "r", "y"), ("y", "p", "x")]


def test_long_graph_files(spark, tmp_path):
    """A graph of more than 20 million characters, encoded once and twice, and texts that are no graph."""
    import json

    graph = json.dumps({"entities": [{"name": f"{i}", "description": "x" * 1_000_000} for i in range(21)], "relations": [["a", "r", "b"]]})
    (tmp_path / "a.json").write_text(graph)
    (tmp_path / "b.json").write_text(json.dumps(graph))
    for i, text in enumerate(["[" + graph[:10] + "]}]", "[]", "null", "3", "{'entities':['x']}", '"{broken"']):
        (tmp_path / f"c{i}.json").write_text(text)
    g = readers.graph_json(spark, str(tmp_path))
    assert g.count() == 8
    got = readers.entities(g).selectExpr("file", "name", "length(description) AS n").collect()
    assert sorted((r.file, int(r.name), r.n) for r in got) == [(f, i, 1_000_000) for f in ("a.json", "b.json") for i in range(21)]
    assert sorted((r.file, r["head"]) for r in readers.relations(g).collect()) == [("a.json", "a"), ("b.json", "a")]


def test_construct(spark):
    from kgspark.plans.construct import construct
    from kgspark.providers import Rules

    topics = spark.createDataFrame([("a", "Ada Byron met Charles. Byron Ada wrote notes. Charles was glad."), ("b", "Charles slept."), ("c", ""), ("d", None)], "topic string, content string")
    entities, relations = construct(topics, Rules())
    got = {(r.topic, r.name): r.description for r in entities.collect()}
    assert got == {("a", "Ada Byron"): "Ada Byron met Charles.;;;Byron Ada wrote notes.", ("a", "Charles"): "Ada Byron met Charles.;;;Charles was glad.", ("a", "Byron Ada"): "", ("b", "Charles"): "Charles slept."}
    assert sorted((r.topic, r["head"], r.tail) for r in relations.collect()) == [("a", "Ada Byron", "Byron Ada"), ("a", "Ada Byron", "Charles"), ("a", "Charles", "Ada Byron"), ("a", "Charles", "Byron Ada")]
    none = construct(topics.limit(0), Rules())
    assert none[0].count() == none[1].count() == 0


def test_attempt():
    from kgspark.providers import attempt

    calls = []

    def f(x):
        calls.append(x)
        if len(calls) < 3:
            raise ValueError
        return x

    assert attempt(f, 7, wait=0) == 7 and len(calls) == 3
    assert attempt(lambda: 1 / 0, wait=0, failed=[]) == []


def test_rouge():
    from kgspark.operators.evaluation import rouge_scores

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            out = [0]
            for j, y in enumerate(b):
                out.append(row[j] + 1 if x == y else max(out[j], row[j + 1]))
            row = out
        return row[-1]

    a, b = "the cat sat on the mat the end".split(), "the the cat on a mat sat the end".split()
    got = rouge_scores(" ".join(a), " ".join(b))
    assert got[:2] == (2 * 8 / 17, 2 * 2 / 15)
    assert got[2] == 2 * plain(a, b) / 17
    assert rouge_scores(None, "a") == (0, 0, 0) and rouge_scores("a b", "a b") == (1, 1, 1)


def test_other_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"x":1}\n{"x":2}\n')
    (tmp_path / "in/b.json").write_text('[{"x":3},\n{"x":4}]')
    (tmp_path / "in/c.json").write_text("{broken\nfile")
    rows = readers.json_any(spark, str(tmp_path / "in"))
    assert sorted(r.x for r in rows.selectExpr("variant_get(row, '$.x', 'int') AS x").collect()) == [1, 2, 3, 4]
    readers.write_csv(rows.selectExpr("ord AS `place`", "'é' AS v"), str(tmp_path / "out"))
    assert all(p.read_bytes().startswith("\ufeffplace,v\n".encode()) for p in (tmp_path / "out").glob("*.csv"))


def test_trace_and_categories(spark):
    from kgspark.operators.graph import from_trace, top_category

    traces = spark.createDataFrame([(1, "c1;;;c2", "x"), (2, "c1", "y"), (3, "c2", "z")], "ord int, chunkid string, name string")
    assert sorted(r.name for r in from_trace(traces).collect()) == ["y", "z"]
    edges = spark.createDataFrame([("a", "b"), ("b", "top"), ("top", "b"), ("c", "d")], "child string, parent string")
    tops = spark.createDataFrame([("top",)], "ancestor string")
    assert {r.child: r.top for r in top_category(edges, tops).collect()} == {"a": "top", "b": "top", "top": "top", "c": None}


def test_search_without_broadcast(spark):
    """Descriptions are never sent around whole, however small their file; of those with the same words the first is found."""
    from pyspark.sql import functions as F

    from kgspark.operators import linking

    p = spark.read.parquet(f"{SF}/part.parquet")
    d = p.select(F.col("p_partkey").alias("ord"), F.concat_ws(" ", F.lit("Old"), "p_name", F.col("p_partkey") % 3).alias("term"), F.col("p_partkey").alias("concept_id"), F.lit("x (y)").alias("fsn"))
    names = p.select(F.concat_ws(" ", F.col("p_partkey") % 4, F.upper("p_name")).alias("name"))
    out = linking.search(names, d)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    rows, want = d.collect(), {}
    for name in {r.name for r in names.collect()}:
        hits = [r.ord for r in rows if set(name.lower().split()) <= set(r.term.lower().split())]
        if hits:
            want[name] = min(hits)
    got = out.collect()
    assert {r.name: r.concept_id for r in got} == want and len(got) == len(want) > 0
