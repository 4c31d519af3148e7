import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from docengine.operators.graph import RelationMapping
from docengine.operators.text import StoredIndex
from docengine.sources.catalog import Database, Schema
from docengine.streaming import bridge
from docengine.streaming.replication import Remote, Replication


class Table(BaseHTTPRequestHandler):
    rows: dict = {}
    refuse: set = set()
    asked: list = []

    def _parts(self):
        url = urllib.parse.urlparse(self.path)
        return {k: v[0] for k, v in urllib.parse.parse_qs(url.query).items()}

    def _answer(self, status, body=""):
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body.encode())

    def _body(self):
        return json.loads(self.rfile.read(int(self.headers["Content-Length"])))

    def do_GET(self):
        asked = self._parts()
        self.asked.append(asked)
        rows = sorted(self.rows.values(), key=lambda r: r["id"])
        if "updated_at" in asked:
            rows = [r for r in rows if r["updated_at"] >= asked["updated_at"].removeprefix("gte.")]
        if "id" in asked:
            rows = [r for r in rows if r["id"] == asked["id"].removeprefix("eq.")]
        at = int(asked["offset"])
        self._answer(200, json.dumps(rows[at : at + int(asked["limit"])]))

    def do_POST(self):
        row = self._body()
        if row["id"] in self.refuse:
            return self._answer(409, "refused")
        self.rows[row["id"]] = row
        self._answer(201)

    def do_PATCH(self):
        self.rows[self._parts()["id"].removeprefix("eq.")] = self._body()
        self._answer(204)

    def do_DELETE(self):
        self.rows.pop(self._parts()["id"].removeprefix("eq."), None)
        self._answer(204)

    def log_message(self, *_):
        pass


@pytest.fixture()
def server():
    Table.rows, Table.refuse, Table.asked = {}, set(), []
    own = HTTPServer(("127.0.0.1", 0), Table)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}"
    own.shutdown()


def todos(spark, rows):
    return spark.createDataFrame(rows, "id string, title string, updated_at string")


def test_pull_and_push(spark, tmp_path, server):
    db = Database(spark, f"rep-{tmp_path.name}", str(tmp_path))
    own = db.collection("todos", Schema(feed=True))
    own.insert(todos(spark, [("l", "local", "2024-01-01")]))
    Table.rows = {k: {"id": k, "title": f"remote {k}", "updated_at": f"2024-02-0{n}"} for n, k in enumerate("abc", 1)}
    rep = Replication(own, Remote(server, "todos"), interval=0)
    assert rep.pull_once() == 3 and own.count() == 4 and rep.since == "2024-02-03"
    Table.rows["a"] |= {"title": "newer", "updated_at": "2024-03-01"}
    assert rep.pull_once() == 2 and own.find_by_id("a").title == "newer"  # the last stamp is asked for again
    assert Table.asked[-1]["updated_at"] == "gte.2024-02-03"
    Table.rows["b"]["title"] = "one"
    assert rep.pull_doc("b") == 1 and own.find_by_id("b").title == "one"
    own.upsert(todos(spark, [("n", "new", "2024-04-01"), ("x", "refused", "2024-04-01")]))
    own.remove("c")
    Table.refuse = {"x"}
    assert not rep.synced()
    rep.push_once()
    assert Table.rows["n"]["title"] == "new" and Table.rows["l"]["title"] == "local" and "c" not in Table.rows
    assert [r.id for r in rep.queue().collect()] == ["x"] and rep.errors and not rep.synced()
    Table.refuse = set()
    assert rep.push_once() == 1 and "x" in Table.rows and rep.synced()
    del Table.rows["x"]
    assert rep.resync("x") == 0 and not own.exists("x")
    rep.run(1)
    rep.stop()
    assert rep.state == "stopped"
    db.close()


def test_graph_and_text_follow_a_collection(spark, tmp_path):
    db = Database(spark, f"sync-{tmp_path.name}", str(tmp_path))
    own = db.collection("docs", Schema(feed=True))
    rows = lambda x: spark.createDataFrame(x, "id string, author string, body string")
    own.insert(rows([("1", "ann", "red fox"), ("2", "bob", "blue fox")]))
    edges = db.collection("edges", Schema(pk=["subject", "predicate", "object"]))
    index = StoredIndex.build(own.df().filter("false"), "id", "body", str(tmp_path / "index"))

    def follow():
        bridge.auto_sync(own, edges, RelationMapping("author", "BY"), str(tmp_path / "c1"), replace_old=True).awaitTermination()
        index.follow(own._feed, str(tmp_path / "c2"), "body").awaitTermination()

    follow()
    assert {(r.subject, r.object) for r in edges.df().collect()} == {("1", "ann"), ("2", "bob")}
    assert {r.id for r in index.search("fox").collect()} == {"1", "2"} and index.count() == 2
    own.upsert(rows([("1", "cay", "red owl"), ("3", "dan", "fox")]))
    own.remove("2")
    follow()
    assert {(r.subject, r.object) for r in edges.df().collect()} == {("1", "cay"), ("3", "dan")}
    assert [r.id for r in index.search("fox").collect()] == ["3"] and index.count() == 2
    small = index.compact(str(tmp_path / "small"))
    assert [r.id for r in small.search("red").collect()] == ["1"] and small.postings().count() == index.postings().count() == 3
    db.close()


def test_a_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"word{k % 90} common") for k in range(500)], "id long, body string")
    index = StoredIndex.build(docs, "id", "body", str(tmp_path / "i"))
    plan = index.postings(["word7"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "bucket#" in plan and "EqualTo(term,word7)" in plan
    assert index.scores("word7").count() == 6
