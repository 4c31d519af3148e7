import numpy as np
import pytest
from pyspark.sql import functions as F

from docengine import errors
from docengine.operators import rag, validate, vector
from docengine.sources.catalog import Database


def test_inverted_lists_recall(spark, tmp_path):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    rows = [(k, (base[k % 40] + rng.normal(scale=0.4, size=16)).tolist()) for k in range(3000)]
    index = vector.VectorIndex(spark.createDataFrame(rows, "id long, embedding array<double>"))
    lists = vector.InvertedLists.build(index, str(tmp_path / "ivf"), 32)
    again = vector.InvertedLists.load(spark, str(tmp_path / "ivf"))
    hits = 0
    for k in range(0, 3000, 300):
        exact = {r.id for r in index.knn(rows[k][1], 10).collect()}
        found = again.search(rows[k][1], 10, 6)
        hits += len(exact & {r.id for r in found.collect()})
    assert hits >= 90 and "PartitionFilters: [list#" in found._jdf.queryExecution().toString()
    assert lists.search(rows[0][1], 3000, 32).count() == 3000


def test_batch_in_blocks_is_the_same(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(200)], "id long, embedding array<double>")
    index, queries = vector.VectorIndex(df), df.filter("id < 20")
    one = index.batch(queries, "id", "embedding", 3).select("query_id", "id", "rank").collect()
    many = index.batch(queries, "id", "embedding", 3, block=4).select("query_id", "id", "rank").collect()
    assert sorted(one) == sorted(many) and len(one) == 60


def test_by_document_and_persist(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, embedding array<double>")
    vector.VectorIndex(df).persist(str(tmp_path / "v"))
    index = vector.VectorIndex.load(spark, str(tmp_path / "v"))
    assert index.by_document({"id": "b"}, lambda d: [1.0, 0.0], 1).first().id == "b"
    assert index.by_document({"text": "x"}, lambda d: [1.0, 0.0], 1).first().id == "a"
    assert index.reindex(df.filter("id = 'a'")).count() == 1


def test_query_entities_and_adapters(spark, tmp_path):
    llm = rag.SimpleLLM({"Name the main": 'here: ["Ann"] ok', "List every": '{"entities": [{"name": "Ann"}], "relationships": [{"source": "Ann", "target": "Bob", "relation": "KNOWS"}]}', "Question": "forty"})
    assert rag.query_entities(llm, "who is Ann") == ["Ann"]
    with pytest.raises(errors.QueryFailed):
        rag.query_entities(rag.SimpleLLM({"Name": "none"}), "q")
    docs = spark.createDataFrame([("1", "Ann lives"), ("2", "nobody")], "id string, content string")
    store = rag.RagIndexer(rag.Rag(docs.limit(0), llm=llm)).store(docs)
    assert {(r.subject, r.predicate) for r in store.edges.collect()} == {("Ann", "APPEARS_IN"), ("Ann", "KNOWS")}
    assert {r.id for r in rag.RagRetriever(store, "local").retrieve("who is Ann").collect()} == {"1", "2"}
    assert rag.RagRetriever(store, "fulltext").retrieve("nobody", threshold=0.5).first().id == "2"
    assert store.answer("nobody", "fulltext") == "forty"
    db = Database(spark, f"a-{tmp_path.name}", str(tmp_path))
    own = db.collection("c")
    assert rag.Indexer(own, dims=8).store(docs).count() == 2
    near = rag.Retriever(own, embed=lambda q: rag.simple_embed(q, 8)).retrieve("nobody", 1).first()
    assert near.id == "2" and abs(near.distance) < 1e-9
    db.close()


def test_simple_embedding_is_that_of_the_driver(spark):
    texts = ["", "é漢", "x" * 900]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string").select("id", rag.simple_embedding(F.col("t"), 20).alias("e")).collect()
    assert all(np.allclose(r.e, rag.simple_embed(texts[r.id], 20)) for r in got)


def test_short_names_on_all_levels(spark):
    df = spark.createDataFrame([(1, [(2, {"z": 1})], None)], "id int, items array<struct<deep:int,map:map<string,int>>>, none struct<id:int,more:string>")
    short, names = validate.compress_keys(df, {"id": "a"})
    assert names == {"id": "a", "deep": "b", "items": "c", "map": "d", "more": "e", "none": "f"}
    assert short.columns == ["a", "c", "f"] and short.selectExpr("c[0].b").first()[0] == 2
    assert validate.expand_keys(short, names).schema == df.schema
    assert validate.cloned(df).selectExpr("id", "items[0].deep as deep").dtypes == [("id", "double"), ("deep", "double")]
