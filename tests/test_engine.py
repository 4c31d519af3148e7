import pytest
from pyspark.sql import functions as F

from docengine import errors
from docengine.operators import chunk, graph, mutate, rag, validate, vector
from docengine.operators.text import FulltextIndex
from docengine.sources.catalog import Database, Schema
from docengine.streaming import changes


def test_collection_life(spark, tmp_path):
    db = Database(spark, "d", str(tmp_path))
    with pytest.raises(errors.AlreadyExists):
        Database(spark, "d", str(tmp_path))
    schema = {"required": ["name"], "properties": {"age": {"type": "integer", "minimum": 0, "default": 1}, "name": {"final": True}}}
    c = db.collection("people", Schema(json=schema))
    rows = spark.createDataFrame([("a", "A", 3), ("b", "B", None)], "id string, name string, age int")
    c.insert(rows)
    assert c.count() == 2 and c.find_by_id("b").age == 1 and c.find_by_id("a")._rev.startswith("1-")
    with pytest.raises(errors.AlreadyExists):
        c.insert(rows)
    with pytest.raises(errors.ValidationFailed):
        c.insert(spark.createDataFrame([("z", None, 3)], "id string, name string, age int"))
    c.upsert(spark.createDataFrame([("a", "A", 9), ("c", "C", 4)], "id string, name string, age int"))
    assert c.find_by_id("a").age == 9 and c.find_by_id("a")._rev.startswith("2-") and c.count() == 3
    with pytest.raises(errors.SchemaFailed):
        c.upsert(spark.createDataFrame([("a", "other", 9)], "id string, name string, age int"))
    with pytest.raises(errors.Conflict):
        c.atomic_update("a", "1-x", {"age": F.lit(1)})
    c.atomic_update("a", c.find_by_id("a")._rev, {"age": F.lit(5)})
    assert c.find_by_id("a")._rev.startswith("3-")
    c.remove("c")
    with pytest.raises(errors.NotFound):
        c.find_by_id("c")
    c.create_index("by_age", ["age"])
    assert c.list_indexes() == {"by_age": ["age"]} and c.exists("a") and not c.exists("q")
    (tmp_path / "f.bin").write_bytes(b"abc")
    c.put_attachments("a", str(tmp_path / "f.bin"))
    c.dump(str(tmp_path / "dump"))
    other = db.collection("copy", Schema())
    other.import_dump(str(tmp_path / "dump"))
    assert other.count() == 2 and bytes(other.attachments("a", "f.bin").first().content) == b"abc"
    db.backup(str(tmp_path / "backup"))
    assert spark.read.parquet(str(tmp_path / "backup/people")).count() == 2
    db.destroy()
    with pytest.raises(errors.Closed):
        c.count()


def test_graph(spark):
    e = graph.edges_of(spark, [("u1", "f", "u2"), ("u2", "f", "u3"), ("u3", "f", "u4"), ("u1", "f", "u2"), ("u9", "f", "u9")])
    e = graph.link(e.limit(0), e)
    q = graph.GraphQuery(e)
    assert [r["next"] for r in q.v("u1").out("f").out("f").all().collect()] == ["u3"]
    assert [r.path for r in graph.paths(e, "u1", "u4", 5, "f").collect()] == [["u1", "u2", "u3", "u4"]]
    assert graph.paths(e, "u4", "u1", 5, "f").count() == 0 and graph.paths(e, "u4", "u1", 5).count() == 1
    assert q.v("u9").both().count() == 2 and q.count() == 0
    assert {r.node for r in graph.neighbors(e, "u2").collect()} == {"u1", "u3"}


def test_text_vector_rag(spark):
    docs = spark.createDataFrame([("1", "apple apple apple"), ("2", "apple banana"), ("3", "banana orange")], "id string, content string")
    got = FulltextIndex(docs, "id", "content").search("apple").collect()
    assert [r.id for r in got] == ["1", "2"] and got[0].score == 1
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0])], "id int, embedding array<double>")
    index = vector.VectorIndex(v, dim=2)
    assert [r.id for r in index.knn([1.0, 0.1], 2).collect()] == [1, 2]
    assert index.count() == 3 and [r.id for r in index.by_id(1, 2).collect()] == [2]
    r = rag.Rag(rag.index_documents(docs, dims=8), embed=lambda t: rag.simple_embed(t, 8))
    assert r.retrieve("apple", "fulltext", 1).first().id == "1"
    assert r.answer("apple", "fulltext", 1).startswith("[1] apple") and r.answer("zzz", "fulltext") == rag.NOTHING_FOUND
    back = v.select(rag.bytes_vector(rag.vector_bytes("embedding")).alias("b"))
    assert back.first().b == [1.0, 0.0]
    answers = spark.createDataFrame([("d", 'x {"entities":[{"name":"E"}],"relationships":[{"source":"E","target":"F","relation":"R"}]} y')], "id string, a string")
    assert {tuple(x) for x in rag.extracted_edges(answers, "id", "a").collect()} == {("E", "APPEARS_IN", "d"), ("E", "R", "F")}


def test_chunks():
    assert chunk.sentences("One. Two! # no\n# Head\nThree?!") == ["One.", "Two!", "# no", "# Head", "Three?!"]
    assert len(chunk.chunks("A b. A b. A b. A b.", 0.0, 2)) == 2
    assert len(chunk.chunks("a. b. c. d.", max_sentences=2, min_chars=1000)) == 1


def test_validation_of_unions_and_nested(spark):
    df = spark.createDataFrame([(1, ("x", 5)), (2, None)], "id int, o struct<a:string,n:int>")
    schema = {"properties": {"o": {"type": "object", "properties": {"n": {"maximum": 3}}}}}
    assert [tuple(r) for r in validate.errors(df, schema, ["id"]).collect()] == [(1, "o.n", "greater than 3")]
    assert [r.id for r in df.filter(validate.is_valid(df, schema)).collect()] == [2]
    assert validate.short_key(0) == "a" and validate.short_key(26) == "aa"


def test_change_feed(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("a", 5), ("c", 3)], "id string, v int")
    path, seen = str(tmp_path / "log"), []
    changes.append(changes.diff(old, new, ["id"], "c", 1), path)
    assert {(r.id, r.op) for r in changes.log(spark, path).collect()} == {("a", "update"), ("b", "delete"), ("c", "insert")}
    q = changes.observe(spark, path, str(tmp_path / "cp"), lambda: new, {"v": {"$gt": 4}}, lambda df: seen.append(df.count()))
    q.awaitTermination(60)
    assert seen == [1]
    assert {r.id for r in changes.latest(changes.log(spark, path)).collect()} == {"a", "c"}


def test_merge_keeps_what_a_patch_lacks(spark):
    base = spark.createDataFrame([(1, "a", 2)], "id int, x string, y int")
    patch = spark.createDataFrame([(1, "b"), (3, "c")], "id int, x string")
    assert {tuple(r) for r in mutate.merge(base, patch, ["id"]).collect()} == {(1, "b", 2), (3, "c", None)}
