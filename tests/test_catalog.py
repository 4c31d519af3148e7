import pytest
from pyspark.sql import functions as F

from docengine import errors
from docengine.operators import mutate
from docengine.sources.catalog import Database, Schema, index_diff
from docengine.streaming import changes


@pytest.fixture()
def db(spark, tmp_path):
    own = Database(spark, f"db-{tmp_path.name}", str(tmp_path))
    yield own
    own.close()


def people(spark, rows):
    return spark.createDataFrame(rows, "id string, name string, age int")


def test_two_writers_of_one_snapshot_conflict(spark, tmp_path, db):
    c = db.collection("c")
    c.insert(people(spark, [("a", "A", 1), ("b", "B", 2)]))
    other = Database(spark, db.name, str(tmp_path), multi_instance=True).collection("c")
    old, rev = other.df(), c.find_by_id("a")._rev
    c.atomic_update("a", rev, {"age": F.lit(5)})
    with pytest.raises(errors.Conflict):  # made from a snapshot that is not the last any more
        other._save(old.withColumn("age", F.lit(0)))
    with pytest.raises(errors.Conflict):
        other.atomic_update("a", rev, {"age": F.lit(6)})
    assert other.find_by_id("a").age == 5 and other.version == c.version == 2


def test_a_half_written_pointer_is_not_read(spark, db):
    c = db.collection("c")
    c.insert(people(spark, [("a", "A", 1)]))
    out = db.store._fs.create(db.store._path(f"{db.store.root}/c/current-0000000002"), False)
    out.close()
    assert c.count() == 1 and c.exists("a")


def test_point_get_is_pushed_down(spark, db):
    c = db.collection("n", Schema(pk=["k"]))
    c.insert(spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")))
    plan = c.lookup("7")._jdf.queryExecution().toString()
    assert "EqualTo(k,7)" in plan
    assert c.find_by_id(7).v == 14 and c.find_by_id("7").v == 14
    assert not c.exists("07") and not c.exists("x") and not c.exists("7.0")
    both = db.collection("m", Schema(pk=["a", "b"]))
    both.insert(spark.createDataFrame([(1, "x", 0), (1, "y", 1)], "a int, b string, v int"))
    assert both.find_by_id('["1","y"]').v == 1 and not both.exists('["1"]')


def test_writes_leave_changes(spark, tmp_path, db):
    c = db.collection("c", Schema(feed=True))
    c.insert(people(spark, [("a", "A", 1), ("b", "B", 2)]))
    c.upsert(people(spark, [("a", "A", 9), ("z", "Z", 0)]))
    c.incremental_modify("b", {"age": F.lit(7)})
    c.remove("a")
    got = sorted((r.seq, r.id, r.op) for r in c.changes().collect())
    assert got == [(1, "a", "insert"), (1, "b", "insert"), (2, "a", "update"), (2, "z", "insert"), (3, "b", "update"), (4, "a", "delete")]
    assert db.changes().count() == 6 and c.document("b").changes().count() == 2
    assert [(r.old, r.new) for r in changes.field_changes(c.changes(), "age", "b").filter("seq = 3").collect()] == [("2", "7")]
    copy = db.collection("copy")
    copy.apply(c.changes())
    assert {(r.id, r.age) for r in copy.df().collect()} == {("b", 7), ("z", 0)}
    copy.apply(c.changes().filter("id = 'a'"))
    assert copy.count() == 2


def test_indexes_last_and_follow_the_schema(spark, tmp_path, db):
    c = db.collection("c", Schema(indexes={"by_age": ["age"]}))
    c.insert(people(spark, [(str(k), "n", 99 - k) for k in range(50)]))
    c.create_index("by_name", ["name"])
    again = Database(spark, db.name, str(tmp_path), multi_instance=True)
    assert again.collection("c").list_indexes() == {"by_age": ["age"], "by_name": ["name"]}
    changed = Database(spark, db.name, str(tmp_path), multi_instance=True).collection("c", Schema(indexes={"by_name": ["name", "age"]}))
    assert changed.list_indexes() == {"by_name": ["name", "age"]} and changed.count() == 50
    assert index_diff({"a": ["x"], "b": ["y"]}, {"b": ["z"], "c": ["w"]}) == (["a", "b"], ["b", "c"])
    with pytest.raises(errors.AlreadyExists):
        changed.create_index("by_name", ["age"])
    changed.drop_index("by_name")
    with pytest.raises(errors.NotFound):
        changed.drop_index("by_name")


def test_document_handle(spark, tmp_path, db):
    c = db.collection("c", Schema(feed=True))
    c.insert(people(spark, [("a", "A", 1)]))
    d = c.document("a")
    d.set("age", 4)
    assert d.get("age") == 4 and d.get("no.where") is None and d.revision.startswith("2-") and not d.deleted()
    (tmp_path / "f.txt").write_bytes(b"x")
    d.put_attachment(str(tmp_path / "f.txt"))
    assert d.attachments().count() == 1
    d.remove_attachment("f.txt")
    assert d.attachments().count() == 0
    d.remove()
    assert d.deleted()


def test_backup_and_restore(spark, tmp_path, db):
    c = db.collection("c", Schema(indexes={"by_age": ["age"]}))
    c.insert(people(spark, [("a", "A", 1)]))
    (tmp_path / "f.txt").write_bytes(b"xyz")
    c.put_attachments("a", str(tmp_path / "f.txt"))
    db.backup(str(tmp_path / "backup"))
    new = Database(spark, f"{db.name}-new", str(tmp_path))
    new.restore(str(tmp_path / "backup"))
    own = new.collection("c")
    assert own.find_by_id("a").age == 1 and own.list_indexes() == {"by_age": ["age"]}
    assert bytes(own.attachments("a", "f.txt").first().content) == b"xyz"
    with pytest.raises(errors.AlreadyExists):
        new.restore(str(tmp_path / "backup"))
    new.destroy()


def test_one_leader(spark, tmp_path, db):
    other = Database(spark, db.name, str(tmp_path), multi_instance=True)
    assert db.wait_for_leadership(1) and not other.wait_for_leadership(0.3)
    assert other.wait_for_leadership(1, lease=0)
    other.resign()
    assert db.wait_for_leadership(1)


def test_populate_has_no_names_twice(spark):
    a = spark.createDataFrame([(1, 7)], "id int, ref int")
    b = spark.createDataFrame([(7, "x")], "id int, name string")
    assert mutate.populate(a, "ref", b, "id").columns == ["id", "ref", "ref_id", "ref_name"]
