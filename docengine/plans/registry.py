"""Named queries over the test tables, each with its SQL equivalent where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docengine.functions import crypto
from docengine.operators import chunk, graph, mutate, rag, text, validate, vector
from docengine.plans import query as q
from docengine.plans.query import find
from docengine.session import shared_dir
from docengine.sources.catalog import Database, Schema
from docengine.streaming import changes, replication

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, sql: str | None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- selectors -------------------------------------------------------------

_PART = "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice"
_NULLED = "nullif(p_brand, 'Brand#1') AS brand, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS size"


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").selectExpr("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice", "nullif(p_brand, 'Brand#1') AS brand", "CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS size")


_BASE = f"(SELECT {_PART}, {_NULLED} FROM part) AS p"
_SELECTORS: dict[str, tuple[dict, str]] = {
    "find_eq": ({"p_size": 15}, "p_size = 15"),
    "find_eq_string": ({"p_brand": {"$eq": "Brand#2"}}, "p_brand = 'Brand#2'"),
    "find_eq_null": ({"brand": None}, "brand IS NULL"),
    "find_ne_null": ({"brand": {"$ne": "Brand#2"}}, "brand IS DISTINCT FROM 'Brand#2'"),
    "find_gt": ({"size": {"$gt": 40}}, "coalesce(size > 40, false)"),
    "find_gte": ({"p_retailprice": {"$gte": 1500}}, "p_retailprice >= 1500"),
    "find_gte_null": ({"size": {"$gte": None}}, "size IS NULL"),
    "find_lt": ({"p_name": {"$lt": "b"}}, "p_name < 'b'"),
    "find_lte": ({"size": {"$lte": 3}}, "coalesce(size <= 3, false)"),
    "find_range": ({"size": {"$gte": 10, "$lt": 20}}, "coalesce(size >= 10 AND size < 20, false)"),
    "find_type_mismatch": ({"p_name": {"$gt": 5}}, "false"),
    "find_in": ({"size": {"$in": [1, 2, 3]}}, "coalesce(size IN (1, 2, 3), false)"),
    "find_in_null": ({"size": {"$in": [1, None]}}, "coalesce(size = 1, true)"),
    "find_in_large": ({"p_partkey": {"$in": list(range(0, 500, 5))}}, "p_partkey % 5 = 0 AND p_partkey < 500"),
    "find_in_empty": ({"size": {"$in": []}}, "false"),
    "find_nin_null": ({"brand": {"$nin": ["Brand#2", "Brand#3"]}}, "NOT coalesce(brand IN ('Brand#2', 'Brand#3'), false)"),
    "find_exists": ({"size": {"$exists": True}}, "size IS NOT NULL"),
    "find_not_exists": ({"nowhere": {"$exists": False}, "size": {"$exists": False}}, "size IS NULL"),
    "find_type": ({"brand": {"$type": "string"}, "size": {"$type": "number"}}, "brand IS NOT NULL AND size IS NOT NULL"),
    "find_type_null": ({"brand": {"$type": "null"}}, "brand IS NULL"),
    "find_regex": ({"p_name": {"$regex": "^[a-m].*e"}}, "regexp_matches(p_name, '^[a-m].*e')"),
    "find_regex_case": ({"p_type": {"$regex": "(?i)STEEL|brass"}}, "regexp_matches(p_type, '(?i)STEEL|brass')"),
    "find_regex_class": ({"p_name": {"$regex": r"^\p{L}+ \pL"}}, r"regexp_matches(p_name, '^\p{L}+ \pL')"),
    "find_regex_script": ({"p_type": {"$regex": r"\p{Latin}[[:upper:]]{3}"}}, r"regexp_matches(p_type, '\p{Latin}[[:upper:]]{3}')"),
    "find_regex_named": ({"p_type": {"$regex": "(?P<end>[A-M])[A-Za-z]$"}}, "regexp_matches(p_type, '(?P<end>[A-M])[A-Za-z]$')"),
    "find_regex_java_only": ({"p_name": {"$regex": "a++"}}, "false"),
    "find_regex_bad": ({"p_name": {"$regex": "("}}, "false"),
    "find_mod": ({"p_partkey": {"$mod": [5, 1]}}, "p_partkey % 5 = 1"),
    "find_mod_missing": ({"size": {"$mod": [5, 0]}}, "coalesce(size, 0) % 5 = 0"),
    "find_and": ({"$and": [{"size": {"$gt": 5}}, {"brand": {"$ne": None}}]}, "coalesce(size > 5, false) AND brand IS NOT NULL"),
    "find_or": ({"$or": [{"size": {"$gt": 45}}, {"brand": "Brand#2"}]}, "coalesce(size > 45, false) OR coalesce(brand = 'Brand#2', false)"),
    "find_empty_or": ({"$or": []}, "false"),
    "find_not": ({"$not": {"size": {"$gt": 10}}}, "NOT coalesce(size > 10, false)"),
    "find_nor": ({"$nor": [{"size": {"$gt": 10}}, {"brand": "Brand#2"}]}, "NOT (coalesce(size > 10, false) OR coalesce(brand = 'Brand#2', false))"),
    "find_nested": (
        {"$or": [{"$and": [{"size": {"$lt": 5}}, {"$not": {"brand": None}}]}, {"p_name": {"$regex": "^a"}, "p_size": {"$in": [1, 2]}}]},
        "(coalesce(size < 5, false) AND brand IS NOT NULL) OR (starts_with(p_name, 'a') AND p_size IN (1, 2))",
    ),
    "find_unknown_operator": ({"size": {"$near": 3}}, "false"),
    "find_all": ({}, "true"),
}
for _name, (_sel, _where) in _SELECTORS.items():
    _add(_name, f"SELECT {_PART}, brand, size FROM {_BASE} WHERE {_where}")(lambda spark, sf, sel=_sel: find(_parts(spark, sf), sel, "p_partkey").exec())

_ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@_add("find_sort_page", f"SELECT {_ORDERS} FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice >= 250000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def _page(spark, sf):
    sel = {"o_orderpriority": "1-URGENT", "o_totalprice": {"$gte": 250000}}
    return find(t(spark, sf, "orders"), sel, "o_orderkey").order_by("o_totalprice", True).order_by("o_orderkey").skip(5).limit(20).exec()


@_add("find_builder", f"SELECT {_ORDERS} FROM orders WHERE o_totalprice < 9000 AND o_totalprice > 2000 AND o_orderstatus IN ('O', 'F') AND starts_with(o_orderpriority, '5')")
def _builder(spark, sf):
    return find(t(spark, sf, "orders")).where("x").gt("o_totalprice", 2000).lt("o_totalprice", 9000).is_in("o_orderstatus", ["O", "F"]).regex("o_orderpriority", "^5").exec()


@_add("sort_nulls", f"SELECT p_partkey, brand, size FROM {_BASE} ORDER BY size NULLS FIRST, brand DESC NULLS LAST, p_partkey LIMIT 40")
def _sort_nulls(spark, sf):
    return find(_parts(spark, sf), {}, "p_partkey").sort({"size": "asc", "brand": "desc"}).limit(40).select("p_partkey", "brand", "size")


@_add("count_ignores_limit", f"SELECT count(*) AS n FROM {_BASE} WHERE coalesce(size > 10, false)")
def _count(spark, sf):
    return find(_parts(spark, sf), {"size": {"$gt": 10}}).skip(2).limit(3).counted()


@_add("typed_getters", f"SELECT p_partkey, coalesce(brand, '') AS s, coalesce(size, 0)::BIGINT AS i, trunc(p_retailprice)::BIGINT AS whole, coalesce(size, 0)::DOUBLE AS f, '' AS wrong FROM {_BASE}")
def _getters(spark, sf):
    df = _parts(spark, sf)
    return df.select("p_partkey", q.get_string(df, "brand").alias("s"), q.get_int(df, "size").alias("i"), q.get_int(df, "p_retailprice").alias("whole"), q.get_float(df, "size").alias("f"), q.get_string(df, "size").alias("wrong"))


def _with_items(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as documents with their lines as an array of objects."""
    item = F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"))
    items = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"), F.sort_array(F.collect_set("l_returnflag")).alias("flags"))
    return items.withColumn("meta", F.struct(F.size("items").alias("lines"), F.col("flags")[0].alias("first")))


_ITEMS: dict[str, tuple[dict, str]] = {
    "find_elem_match": ({"items": {"$elemMatch": {"qty": {"$gt": 45}, "flag": "R"}}}, "bool_or(l_quantity > 45 AND l_returnflag = 'R')"),
    "find_elem_match_scalar": ({"flags": {"$elemMatch": {"x": None}}}, "false"),
    "find_size": ({"items": {"$size": 3}}, "count(*) = 3"),
    "find_all_values": ({"flags": {"$all": ["A", "N"]}}, "bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'N')"),
    "find_array_eq": ({"flags": ["A", "R"]}, "bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R') AND NOT bool_or(l_returnflag = 'N')"),
    "find_dotted": ({"meta.lines": {"$gte": 6}, "meta.first": "A"}, "count(*) >= 6 AND min(l_returnflag) = 'A'"),
}
for _name, (_sel, _having) in _ITEMS.items():
    _add(_name, f"SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING {_having}")(lambda spark, sf, sel=_sel: find(_with_items(spark, sf), sel).select("l_orderkey"))

_VARIANTS: dict[str, tuple[dict, str]] = {
    "variant_number": ({"k": {"$gt": 50}}, "k > 50"),
    "variant_type_guard": ({"k": {"$gt": "5"}}, "false"),
    "variant_exists": ({"k": {"$exists": True}, "none": {"$exists": False}}, "k IS NOT NULL"),
    "variant_in_mod": ({"k": {"$in": [1, 2, 3, 10], "$mod": [2, 0]}}, "k IN (2, 10)"),
    "variant_type": ({"k": {"$type": "number"}, "gone": {"$type": "null"}}, "k IS NOT NULL"),
}
for _name, (_sel, _where) in _VARIANTS.items():
    _add(_name, f"SELECT event_id FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) WHERE {_where}")(
        lambda spark, sf, sel=_sel: find(t(spark, sf, "events").select("event_id", F.parse_json("props").alias("doc")), sel, variant="doc").select("event_id")
    )


# --- writes ----------------------------------------------------------------


@_add("update_matching", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'BIG' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _update(spark, sf):
    df = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return find(df, {"o_totalprice": {"$gt": 300000}}, "o_orderkey").update({"o_orderstatus": "BIG", "o_orderkey": 0}).drop("o_totalprice")


@_add("remove_matching", f"SELECT p_partkey, size FROM {_BASE} WHERE NOT coalesce(size > 10, false)")
def _remove(spark, sf):
    return find(_parts(spark, sf).select("p_partkey", "size"), {"size": {"$gt": 10}}).remove()


def _customers(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")


_DELTA = "SELECT c_custkey + (CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 10000000 END) AS c_custkey, upper(c_name) AS c_name, CAST(NULL AS DOUBLE) AS c_acctbal FROM customer WHERE c_custkey % 10 < 2"


def _delta(spark, sf):
    _customers(spark, sf).createOrReplaceTempView("_delta_customer")
    return spark.sql(_DELTA.replace("FROM customer", "FROM _delta_customer"))


@_add("insert_new", f"SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT * FROM ({_DELTA}) WHERE c_custkey > 10000000")
def _insert(spark, sf):
    return mutate.insert(_customers(spark, sf), _delta(spark, sf).filter("c_custkey > 10000000"), ["c_custkey"])


@_add("upsert_replace", f"WITH d AS ({_DELTA}) SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM d) UNION ALL SELECT * FROM d")
def _upsert(spark, sf):
    return mutate.upsert(_customers(spark, sf), _delta(spark, sf), ["c_custkey"])


@_add("incremental_upsert", f"WITH d AS ({_DELTA}) SELECT coalesce(c.c_custkey, d.c_custkey) AS c_custkey, coalesce(d.c_name, c.c_name) AS c_name, coalesce(d.c_acctbal, c.c_acctbal) AS c_acctbal FROM customer c FULL JOIN d ON c.c_custkey = d.c_custkey")
def _merge(spark, sf):
    return mutate.merge(_customers(spark, sf), _delta(spark, sf), ["c_custkey"])


@_add("bulk_remove", f"SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM ({_DELTA}))")
def _bulk_remove(spark, sf):
    return mutate.bulk_remove(_customers(spark, sf), _delta(spark, sf), ["c_custkey"])


@_add("deep_patch", "SELECT c_custkey, 'x' AS a, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE -1 END AS b FROM customer")
def _deep(spark, sf):
    base = _customers(spark, sf).select("c_custkey", F.struct(F.lit("x").alias("a"), F.lit(-1).cast("long").alias("b")).alias("o"))
    patch = base.filter("c_custkey % 2 = 0").select("c_custkey", F.struct(F.lit(None).cast("string").alias("a"), F.col("c_custkey").alias("b")).alias("o"))
    return mutate.deep_patch(base, patch, ["c_custkey"]).select("c_custkey", "o.a", "o.b")


@_add("populate_customer", "SELECT o_orderkey, c_name, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _populate(spark, sf):
    return mutate.populate(t(spark, sf, "orders"), "o_custkey", t(spark, sf, "customer"), "c_custkey", "").select("o_orderkey", "c_name", "c_nationkey")


_SCHEMA = {"required": ["brand"], "properties": {"size": {"type": "integer", "minimum": 3, "maximum": 45, "default": 7}, "p_name": {"type": "string", "minLength": 8, "maxLength": 30}, "p_type": {"type": "string", "pattern": "^[A-Z]"}, "p_brand": {"final": True}}}


@_add("validate_errors", f"""
SELECT p_partkey, 'brand' AS path, 'is required' AS message FROM {_BASE} WHERE brand IS NULL
UNION ALL SELECT p_partkey, 'size', 'less than 3' FROM {_BASE} WHERE size < 3
UNION ALL SELECT p_partkey, 'size', 'greater than 45' FROM {_BASE} WHERE size > 45
UNION ALL SELECT p_partkey, 'p_name', 'shorter than 8' FROM {_BASE} WHERE strlen(p_name) < 8
UNION ALL SELECT p_partkey, 'p_name', 'longer than 30' FROM {_BASE} WHERE strlen(p_name) > 30
UNION ALL SELECT p_partkey, 'p_type', 'does not match ^[A-Z]' FROM {_BASE} WHERE NOT regexp_matches(p_type, '^[A-Z]')""")
def _errors(spark, sf):
    return validate.errors(_parts(spark, sf), _SCHEMA, ["p_partkey"])


@_add("apply_defaults", f"SELECT p_partkey, coalesce(size, 7) AS size FROM {_BASE}")
def _defaults(spark, sf):
    return validate.apply_defaults(_parts(spark, sf), _SCHEMA).select("p_partkey", "size")


@_add("final_violations", "SELECT p_partkey, 'p_brand' AS field FROM part WHERE p_size > 40")
def _final(spark, sf):
    old = t(spark, sf, "part")
    return validate.final_violations(old, old.withColumn("p_brand", F.when(F.col("p_size") > 40, "new").otherwise(F.col("p_brand"))), _SCHEMA, ["p_partkey"])


@_add("migrate_chain", "SELECT p_partkey, upper(p_name) || '!' AS p_name FROM part")
def _migrate(spark, sf):
    steps = {2: lambda df: df.withColumn("p_name", F.upper("p_name")), 4: lambda df: df.withColumn("p_name", F.concat("p_name", F.lit("!")))}
    return validate.migrate(t(spark, sf, "part").select("p_partkey", "p_name"), steps, 1, 4)


@_add("crypto_round_trip", "SELECT c_custkey, c_name, false AS same FROM customer")
def _crypto(spark, sf):
    df = crypto.encrypt_fields(_customers(spark, sf).withColumn("plain", F.col("c_name")), ["c_name"], "secret")
    df = df.withColumn("same", F.col("c_name") == F.col("plain"))
    return crypto.decrypt_fields(df, ["c_name"], "secret").select("c_custkey", "c_name", "same")


# --- vectors ---------------------------------------------------------------

_QV = [round(((i * 37) % 64 - 31.5) / 64, 6) for i in range(64)]
_QL = "[" + ", ".join(f"{x}::DOUBLE" for x in _QV) + "]"
_E = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 3)) AS e FROM embeddings)"
_D = {"cosine": f"1 - list_cosine_similarity(e, {_QL})", "l2": f"list_distance(e, {_QL})", "dot": f"-list_dot_product(e, {_QL})"}
_S = {"cosine": "1 - d / 2", "l2": "1 / (1 + d)", "dot": "1 / (1 + exp(d))"}


def _index(spark, sf, metric="cosine", **more):
    df = t(spark, sf, "embeddings").withColumn("e", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 3)))
    return vector.VectorIndex(df.select("vec_id", "label", "e"), "vec_id", "e", 64, metric, **more)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


def _vec_sql(metric: str, where: str = "true", tail: str = "") -> str:
    return f"SELECT vec_id, round(d, 6) AS distance, round({_S[metric]}, 6) AS score FROM (SELECT vec_id, label, {_D[metric]} AS d FROM {_E}) WHERE {where} {tail}"


for _m in vector.METRICS:
    _add(f"vec_knn_{_m}", _vec_sql(_m, tail="ORDER BY d, vec_id LIMIT 10"))(lambda spark, sf, m=_m: _shown(_index(spark, sf, m).knn(_QV, 10)))


@_add("vec_range", _vec_sql("l2", "d <= 2.9"))
def _range(spark, sf):
    return _shown(_index(spark, sf, "l2").range(_QV, 2.9))


@_add("vec_min_score", _vec_sql("cosine", "1 - d / 2 >= 0.55"))
def _min_score(spark, sf):
    return _shown(_index(spark, sf).search(_QV, min_score=0.55))


@_add("vec_filtered", _vec_sql("cosine", "vec_id % 5 = 0", "ORDER BY d, vec_id LIMIT 7"))
def _filtered(spark, sf):
    return _shown(_index(spark, sf).search(_QV, 7, selector={"vec_id": {"$mod": [5, 0]}}))


@_add("vec_partition", _vec_sql("cosine", "label = 2", "ORDER BY d, vec_id LIMIT 5"))
def _partition(spark, sf):
    return _shown(_index(spark, sf, partition="label").search(_QV, 5, partition=2))


@_add("vec_batch", f"""SELECT query_id, vec_id, rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(1 - list_cosine_similarity(b.e, a.e), 12), b.vec_id) AS rank
  FROM {_E} a JOIN {_E} b ON a.vec_id % 100 = 0) WHERE rank <= 5""")
def _batch(spark, sf):
    index = _index(spark, sf)
    return index.batch(index.df.filter("vec_id % 100 = 0"), "vec_id", "e", 5).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


@_add("vec_by_id", f"""WITH s AS (SELECT e AS q FROM {_E} WHERE vec_id = 3),
  k AS (SELECT vec_id, round(1 - list_cosine_similarity(e, q), 6) AS distance FROM {_E}, s ORDER BY round(1 - list_cosine_similarity(e, q), 12), vec_id LIMIT 6) SELECT * FROM k WHERE vec_id <> 3""")
def _by_id(spark, sf):
    return _index(spark, sf).by_id(3, 6).select("vec_id", F.round("distance", 6).alias("distance"))


@_add("vec_matrix", f"""WITH s AS (SELECT vec_id, e FROM {_E} WHERE vec_id < 12) SELECT a.vec_id AS a, b.vec_id AS b,
  CASE WHEN a.vec_id = b.vec_id THEN 1.0 ELSE round((1 + list_cosine_similarity(a.e, b.e)) / 2, 6) END::DOUBLE AS similarity FROM s a, s b""")
def _matrix(spark, sf):
    return _index(spark, sf).similarity_matrix(list(range(12))).select("a", "b", F.round("similarity", 6).alias("similarity"))


@_add("vec_normalize", f"SELECT vec_id, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first, round(e[64] / sqrt(list_dot_product(e, e)), 6) AS last FROM {_E}")
def _normalize(spark, sf):
    n = vector.normalize(F.col("e"))
    return _index(spark, sf).df.select("vec_id", n.alias("n")).select("vec_id", F.round(F.col("n")[0], 6).alias("first"), F.round(F.col("n")[63], 6).alias("last"))


# --- text ------------------------------------------------------------------


def _bm25(terms: list[str]) -> str:
    own = ", ".join(f"'{x}'" for x in terms)
    return f"""
w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS words FROM documents),
s AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM w WHERE len(words) > 0),
tf AS (SELECT id, term, len(words) AS length, len(list_filter(words, lambda x: x = term)) AS tf FROM w, (SELECT unnest([{own}]) AS term)),
hit AS (SELECT * FROM tf WHERE tf > 0),
df AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
raw AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS raw
        FROM hit JOIN df USING (term), s GROUP BY id)"""


_STORED: dict[tuple[str, str], str] = {}


def _stored(spark, sf) -> str:
    """The folder of a full-text index over documents, built once a session as any index is."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        path = f"{shared_dir(spark)}/docengine-fulltext-{uuid.uuid4().hex}"
        text.StoredIndex.build(t(spark, sf, "documents"), "doc_id", "text", path)
        _STORED[key] = path
    return _STORED[key]


def _fts(spark, sf, **more):
    return text.StoredIndex(spark, _stored(spark, sf), **more)


@_add("fts_postings", r"""SELECT term, doc_id AS id, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents) GROUP BY term, doc_id""")
def _postings(spark, sf):
    return text.FulltextIndex(t(spark, sf, "documents"), "doc_id", "text").postings().select("term", "id", "tf")


@_add("fts_unindexed", f"WITH {_bm25(['thing', 'others'])}, k AS (SELECT id, raw FROM raw ORDER BY raw DESC, id LIMIT 10) SELECT id, round(raw / max(raw) OVER (), 6) AS score FROM k")
def _fts_unindexed(spark, sf):
    return text.FulltextIndex(t(spark, sf, "documents"), "doc_id", "text").search("thing others").select("id", F.round("score", 6).alias("score"))


@_add("fts_incremental", f"WITH {_bm25(['thing', 'others'])}, k AS (SELECT id, raw FROM raw ORDER BY raw DESC, id LIMIT 10) SELECT id, round(raw / max(raw) OVER (), 6) AS score FROM k")
def _fts_incremental(spark, sf):
    """An index of stale and missing documents and of some that do not exist, brought up to date by changes."""
    docs = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    old = docs.filter("id % 3 <> 0").withColumn("text", F.when(F.col("id") % 3 == 1, F.concat(F.lit("thing others "), "text")).otherwise(F.col("text")))
    extra = docs.filter("id % 5 = 0").withColumn("id", -F.col("id") - 1)
    path = f"{shared_dir(spark)}/docengine-fulltext-{uuid.uuid4().hex}"
    index = text.StoredIndex.build(old.unionByName(extra), "id", "text", path)
    gone = extra.select("id", F.lit(None).cast("string").alias("text"))
    index.refresh(docs.filter("id % 3 < 2").unionByName(gone))
    return index.search("thing others").select("id", F.round("score", 6).alias("score"))


@_add("fts_or", f"WITH {_bm25(['den', 'thing', 'mente'])} SELECT id FROM raw")
def _fts_or(spark, sf):
    return _fts(spark, sf).scores("thing DEN mente").select("id")


@_add("fts_scores", f"WITH {_bm25(['thing', 'others'])}, k AS (SELECT id, raw FROM raw ORDER BY raw DESC, id LIMIT 10) SELECT id, round(raw / max(raw) OVER (), 6) AS score FROM k")
def _fts_scores(spark, sf):
    return _fts(spark, sf).search("thing others").select("id", F.round("score", 6).alias("score"))


@_add("fts_filtered", f"WITH {_bm25(['den'])}, k AS (SELECT id, raw FROM raw JOIN documents ON id = doc_id WHERE lang = 'de' AND n_chars > 500 ORDER BY raw DESC, id LIMIT 20) SELECT id, round(raw / max(raw) OVER (), 6) AS score FROM k")
def _fts_filtered(spark, sf):
    docs = t(spark, sf, "documents")
    return _fts(spark, sf).search("den", 20, selector={"lang": "de", "n_chars": {"$gt": 500}}, df=docs, id_col="doc_id").select("id", F.round("score", 6).alias("score"))


@_add("fts_stopwords", f"WITH {_bm25(['thing'])} SELECT id FROM raw")
def _fts_stop(spark, sf):
    return _fts(spark, sf, min_length=3, stop_words=("the", "and")).scores("the THE of and thing").select("id")


_VS = f"SELECT vec_id AS id, 1 - d / 2 AS score FROM (SELECT vec_id, 1 - list_cosine_similarity(e, {_QL}) AS d FROM {_E}) ORDER BY round(d, 12), vec_id LIMIT 20"


@_add("hybrid_weighted", f"""WITH {_bm25(['thing', 'others'])}, k AS (SELECT id, raw FROM raw ORDER BY raw DESC, id LIMIT 20), f AS (SELECT id, raw / max(raw) OVER () AS score FROM k), v AS ({_VS})
SELECT id, round(0.6 * coalesce(f.score, 0) + 0.4 * coalesce(v.score, 0), 6) AS score FROM f FULL JOIN v USING (id) ORDER BY round(0.6 * coalesce(f.score, 0) + 0.4 * coalesce(v.score, 0), 9) DESC, id LIMIT 10""")
def _hybrid(spark, sf):
    v = _index(spark, sf).search(_QV, 20).select(F.col("vec_id").alias("id"), "score")
    return text.weighted_hybrid(_fts(spark, sf).search("thing others", 20), v, 10, 0.6, 0.4).select("id", F.round("score", 6).alias("score"))


@_add("rag_rrf", f"""WITH {_bm25(['thing', 'others'])}, f AS (SELECT id, row_number() OVER (ORDER BY raw DESC, id) - 1 AS r FROM raw QUALIFY r < 20),
v AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM ({_VS}))
SELECT id, round(sum(1 / (r + 60)), 6) AS score FROM (SELECT * FROM f UNION ALL SELECT * FROM v) GROUP BY id ORDER BY round(sum(1 / (r + 60)), 12) DESC, id LIMIT 10""")
def _rrf(spark, sf):
    f = _fts(spark, sf).search("thing others", 20)
    v = _index(spark, sf).search(_QV, 20).select(F.col("vec_id").alias("id"), "score")
    ranked = [x.select("id", (F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).alias("rank")) for x in (f, v)]
    return text.reciprocal_ranks(ranked, 10).select("id", F.round("score", 6).alias("score"))


# --- graph -----------------------------------------------------------------

_EDGES = """edges AS (
  SELECT 'n' || n_nationkey AS subject, 'IN' AS predicate, 'r' || n_regionkey AS object FROM nation
  UNION SELECT 'c' || c_custkey, 'OF', 'n' || c_nationkey FROM customer
  UNION SELECT 's' || s_suppkey, 'OF', 'n' || s_nationkey FROM supplier)"""


def _edges(spark, sf):
    def one(table, s, p, o):
        a, b = (F.concat(F.lit(x[0]), F.col(x[1]).cast("string")) for x in (s, o))
        return t(spark, sf, table).select(a.alias("subject"), F.lit(p).alias("predicate"), b.alias("object"))

    out = one("nation", ("n", "n_nationkey"), "IN", ("r", "n_regionkey"))
    out = graph.link(out, one("customer", ("c", "c_custkey"), "OF", ("n", "c_nationkey")))
    return graph.link(out, one("supplier", ("s", "s_suppkey"), "OF", ("n", "s_nationkey")))


def _g(spark, sf):
    return graph.GraphQuery(_edges(spark, sf))


@_add("graph_out", f"WITH {_EDGES} SELECT subject, predicate, object FROM edges WHERE subject IN ('n1', 'n2', 'c3')")
def _graph_out(spark, sf):
    return _g(spark, sf).v("n1", "n2", "c3").out().all().select(graph.EDGE)


@_add("graph_in", f"WITH {_EDGES} SELECT subject, predicate, object FROM edges WHERE object = 'n4' AND predicate = 'OF'")
def _graph_in(spark, sf):
    return graph.parse(_edges(spark, sf), "V('n4').In('OF')").all().select(graph.EDGE)


@_add("graph_both", f"WITH {_EDGES} SELECT subject, predicate, object FROM edges WHERE subject = 'n5' UNION ALL SELECT subject, predicate, object FROM edges WHERE object = 'n5'")
def _graph_both(spark, sf):
    return _g(spark, sf).v("n5").both().all().select(graph.EDGE)


@_add("graph_chain", f"WITH {_EDGES} SELECT DISTINCT b.subject, b.predicate, b.object FROM edges a JOIN edges b ON a.object = b.subject WHERE a.subject IN ('c1', 'c2', 's7') AND a.predicate = 'OF' AND b.predicate = 'IN'")
def _graph_chain(spark, sf):
    return _g(spark, sf).v("c1", "c2", "s7").out("OF").out("IN").all().select(graph.EDGE)


@_add("graph_has", f"WITH {_EDGES} SELECT a.subject, a.predicate, a.object FROM edges a JOIN edges b ON a.object = b.subject AND b.predicate = 'IN' AND b.object = 'r2' WHERE a.predicate = 'OF' AND a.subject IN ('c1', 'c2', 'c3', 'c4', 'c5', 's1', 's2')")
def _graph_has(spark, sf):
    return _g(spark, sf).v("c1", "c2", "c3", "c4", "c5", "s1", "s2").out("OF").has("IN", "r2").all().select(graph.EDGE)


@_add("graph_limit", f"WITH {_EDGES} SELECT subject, predicate, object FROM edges WHERE object = 'n4' ORDER BY subject, predicate, object LIMIT 5")
def _graph_limit(spark, sf):
    return _g(spark, sf).v("n4").in_().limit(5).all().select(graph.EDGE)


@_add("graph_all_nodes", f"WITH {_EDGES} SELECT subject AS node FROM edges WHERE object = 'r1' UNION SELECT object FROM edges WHERE object = 'r1'")
def _graph_nodes(spark, sf):
    return _g(spark, sf).v("r1").in_().all_nodes()


@_add("graph_neighbors", f"WITH {_EDGES} SELECT object AS node FROM edges WHERE subject = 'n3' UNION SELECT subject FROM edges WHERE object = 'n3'")
def _graph_neighbors(spark, sf):
    return graph.neighbors(_edges(spark, sf), "n3")


@_add("graph_unlink", f"WITH {_EDGES} SELECT subject, predicate, object FROM edges WHERE predicate <> 'IN'")
def _graph_unlink(spark, sf):
    edges = _edges(spark, sf)
    return graph.unlink(edges, edges.filter("predicate = 'IN'"))


@_add("graph_paths", f"""WITH RECURSIVE {_EDGES},
own AS (SELECT subject AS a, object AS b FROM edges UNION SELECT object, subject FROM edges),
p AS (SELECT ['s1'] AS path UNION ALL SELECT list_append(path, b) FROM p JOIN own ON a = path[-1] AND NOT list_contains(path, b) AND path[-1] <> 's2' WHERE len(path) <= 4)
SELECT array_to_string(path, '>') AS path FROM p WHERE path[-1] = 's2'""")
def _graph_paths(spark, sf):
    return graph.paths(_edges(spark, sf), "s1", "s2", 4).select(F.concat_ws(">", "path").alias("path"))


@_add("graph_subgraph", f"""WITH {_EDGES}, n1 AS (SELECT subject AS node FROM edges WHERE object = 'r3' UNION SELECT 'r3')
SELECT DISTINCT subject, predicate, object FROM edges WHERE subject IN (SELECT node FROM n1) OR object IN (SELECT node FROM n1)""")
def _graph_subgraph(spark, sf):
    return graph.subgraph(_edges(spark, sf), "r3", 2)[1]


@_add("bridge_edges", "SELECT DISTINCT o_orderkey::VARCHAR AS subject, 'BY' AS predicate, o_custkey::VARCHAR AS object FROM orders")
def _bridge(spark, sf):
    return graph.bridge_edges(t(spark, sf, "orders"), "o_orderkey", graph.RelationMapping("o_custkey", "BY"))


@_add("rag_local", "SELECT DISTINCT doc_id AS id, 1.0::DOUBLE AS score FROM documents WHERE source IN ('src1', 'src2') ORDER BY id LIMIT 25")
def _rag_local(spark, sf):
    docs = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source")
    appears = docs.select(F.col("source").alias("subject"), F.lit(rag.APPEARS_IN).alias("predicate"), F.col("id").cast("string").alias("object"))
    edges = graph.link(appears, graph.edges_of(spark, [("src1", "NEAR", "src2"), ("src2", "NEAR", "src4")]))
    return rag.Rag(docs, edges).local(["src1"], 25)


# --- change feeds ----------------------------------------------------------


def _feed(spark, sf):
    e = t(spark, sf, "events")
    doc = F.to_json(F.struct(F.col("value").cast("int").alias("v"), F.col("event_type").alias("kind")))
    old = F.to_json(F.struct((F.col("value").cast("int") + F.col("event_id") % 2).cast("int").alias("v"), F.col("event_type").alias("kind")))
    op = F.when(F.col("event_type") == "error", "delete").otherwise("update")
    return e.select(F.lit("c").alias("collection"), F.col("user_id").cast("string").alias("id"), op.alias("op"), doc.alias("doc"), old.alias("old"), F.lit("").alias("rev"), F.col("event_id").alias("seq"), "ts")


@_add("changes_field", "SELECT user_id::VARCHAR AS id, event_id AS seq, 'v' AS field FROM events WHERE event_id % 2 = 1")
def _changes_field(spark, sf):
    return changes.field_changes(_feed(spark, sf), "v").select("id", "seq", "field")


@_add("changes_latest", "SELECT user_id::VARCHAR AS id, max(event_id) AS seq FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def _changes_latest(spark, sf):
    return changes.latest(_feed(spark, sf)).select("id", "seq")


@_add("conflict_remote_wins", f"WITH d AS ({_DELTA}) SELECT coalesce(d.c_custkey, c.c_custkey) AS c_custkey, CASE WHEN d.c_custkey IS NULL THEN c.c_name ELSE d.c_name END AS c_name, CASE WHEN d.c_custkey IS NULL THEN c.c_acctbal ELSE d.c_acctbal END AS c_acctbal FROM customer c FULL JOIN d ON c.c_custkey = d.c_custkey")
def _conflict(spark, sf):
    return changes.conflicts(_customers(spark, sf), _delta(spark, sf), ["c_custkey"])


@_add("pull_since", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def _pull(spark, sf):
    import datetime

    return changes.pull(t(spark, sf, "orders"), datetime.datetime(1997, 1, 1), "o_orderdate")[0].select("o_orderkey")


# --- chunks and embeddings (no SQL equivalent) -----------------------------


@_add("chunk_sentences", None)
def _sentences(spark, sf):
    return chunk.split_sentences(t(spark, sf, "documents"), "doc_id", "text")


@_add("chunk_tfidf", None)
def _chunks(spark, sf):
    return chunk.split_chunks(t(spark, sf, "documents"), "doc_id", "text")


@_add("embed_simple", "SELECT doc_id, round(('0x' || hex(encode(text))[1:2])::INTEGER / 255, 6) AS first, round(('0x' || hex(encode(text))[3:4])::INTEGER / 255, 6) AS second, 768::BIGINT AS n FROM documents")
def _embed(spark, sf):
    e = t(spark, sf, "documents").select("doc_id", rag.simple_embedding(F.col("text")).alias("e"))
    return e.select("doc_id", F.round(F.col("e")[0], 6).alias("first"), F.round(F.col("e")[1], 6).alias("second"), F.size("e").cast("long").alias("n"))


@_add("white_space_removed", "SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS text FROM documents")
def _no_space(spark, sf):
    return t(spark, sf, "documents").select("doc_id", chunk.without_white_space(F.col("text")).alias("text"))


# --- builders, names and numbers -------------------------------------------


@_add("find_builder_logic", f"SELECT p_partkey FROM {_BASE} WHERE (coalesce(size > 40, false) OR brand = 'Brand#2') AND p_partkey % 2 = 1 AND NOT coalesce(size < 5, false)")
def _builder_logic(spark, sf):
    found = find(_parts(spark, sf), pk="p_partkey").any_of([{"size": {"$gt": 40}}, {"brand": "Brand#2"}])
    return found.all_of([{"p_partkey": {"$mod": [2, 1]}}]).none_of({"size": {"$lt": 5}}).select("p_partkey")


@_add("find_builder_more", f"SELECT p_partkey FROM {_BASE} WHERE brand IS NOT NULL AND brand NOT IN ('Brand#3') AND size IS NOT NULL")
def _builder_more(spark, sf):
    return find(_parts(spark, sf), pk="p_partkey").nin("brand", ["Brand#3"]).type("brand", "string").exists("size").select("p_partkey")


@_add("to_json", """SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS json FROM nation""")
def _to_json(spark, sf):
    return q.to_json(t(spark, sf, "nation"))


@_add("compress_keys", "SELECT o_orderkey, o_custkey AS k, o_totalprice AS p FROM orders")
def _compress(spark, sf):
    nested = t(spark, sf, "orders").select("o_orderkey", F.array(F.struct(F.col("o_custkey").alias("customer"), F.struct(F.col("o_totalprice").alias("price")).alias("total"))).alias("items"))
    short, names = validate.compress_keys(nested)
    short = short.filter(F.col(names["items"])[0][names["customer"]].isNotNull())
    return validate.expand_keys(short, names).select("o_orderkey", F.col("items")[0]["customer"].alias("k"), F.col("items")[0]["total"]["price"].alias("p"))


@_add("clone_numbers", "SELECT p_partkey::DOUBLE AS p_partkey, p_size::DOUBLE AS size, p_name FROM part")
def _clone(spark, sf):
    rows = t(spark, sf, "part").select("p_partkey", F.struct("p_size").alias("x"), "p_name")
    return validate.cloned(rows).select("p_partkey", F.col("x.p_size").alias("size"), "p_name")


@_add("vec_by_document", _vec_sql("cosine", tail="ORDER BY d, vec_id LIMIT 6"))
def _by_document(spark, sf):
    return _shown(_index(spark, sf).by_document({"vec_id": -1, "text": "unseen"}, lambda doc: _QV, 6))


@_add("vec_score_to_distance", "SELECT vec_id, round(CASE WHEN label = 0 THEN 1.7976931348623157e308 ELSE sqrt(1 / (1 / (1 + label)) - 1) END, 6) AS distance FROM embeddings WHERE label >= 0")
def _score_to_distance(spark, sf):
    s = F.when(F.col("label") == 0, 0.0).otherwise(1 / (1 + F.col("label").cast("double")))
    return t(spark, sf, "embeddings").filter("label >= 0").select("vec_id", F.round(vector.score_to_distance(s), 6).alias("distance"))


@_add("vec_inverted_lists", _vec_sql("cosine", tail="ORDER BY d, vec_id LIMIT 10"))
def _lists(spark, sf):
    """All lists are probed, so the result is the exact one; fewer probes are tested for their recall."""
    path = f"{shared_dir(spark)}/docengine-lists-{uuid.uuid4().hex}"
    return _shown(vector.InvertedLists.build(_index(spark, sf), path, 16).search(_QV, 10, 16))


@_add("rag_hybrid", f"""WITH {_bm25(['thing', 'others'])}, f AS (SELECT id, row_number() OVER (ORDER BY raw DESC, id) - 1 AS r FROM raw QUALIFY r < 20),
d AS (SELECT vec_id AS id, 1 - list_cosine_similarity(e, {_QL}) AS d FROM {_E} JOIN documents ON vec_id = doc_id),
v AS (SELECT id, row_number() OVER (ORDER BY round(d, 12), id) - 1 AS r FROM d QUALIFY r < 20)
SELECT id, round(sum(1 / (r + 60)), 6) AS score FROM (SELECT * FROM f UNION ALL SELECT * FROM v) GROUP BY id ORDER BY round(sum(1 / (r + 60)), 12) DESC, id LIMIT 10""")
def _rag_hybrid(spark, sf):
    docs = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    docs = docs.join(_index(spark, sf).df.select(F.col("vec_id").alias("id"), F.col("e").alias("embedding")), "id", "left")
    return rag.Rag(docs, embed=lambda _: _QV).hybrid("thing others", 10).select("id", F.round("score", 6).alias("score"))


# --- collections and replication -------------------------------------------


def _orders(spark, sf, **more):
    """A collection of orders in a new database of the shared folder."""
    db = Database(spark, f"docengine-db-{uuid.uuid4().hex}", shared_dir(spark))
    own = db.collection("orders", Schema(pk=["o_orderkey"], **more))
    own.insert(t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))
    return own


@_add("point_get", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def _point_get(spark, sf):
    return _orders(spark, sf).lookup("7").select("o_orderkey", "o_custkey", "o_totalprice")


@_add("index_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 10")
def _index_scan(spark, sf):
    own = _orders(spark, sf, indexes={"by_customer": ["o_custkey"]})
    return own.find({"o_custkey": 10}).select("o_orderkey", "o_custkey")


@_add("index_diff", "SELECT * FROM (VALUES ('by_customer', 'o_custkey,o_totalprice'), ('by_status', 'o_orderstatus')) AS v(name, fields)")
def _index_diff(spark, sf):
    own = _orders(spark, sf, indexes={"by_customer": ["o_custkey"], "by_price": ["o_totalprice"]})
    wanted = {"by_customer": ["o_custkey", "o_totalprice"], "by_status": ["o_orderstatus"]}
    again = Database(spark, own.db.name, shared_dir(spark), multi_instance=True).collection("orders", Schema(pk=["o_orderkey"], indexes=wanted))
    return spark.createDataFrame([(n, ",".join(f)) for n, f in again.list_indexes().items()], "name string, fields string")


@_add("changes_of_write", """SELECT o_orderkey::VARCHAR AS id, 1::BIGINT AS seq, 'insert' AS op FROM orders
UNION ALL SELECT o_orderkey::VARCHAR, 2, 'update' FROM orders WHERE o_orderkey % 10 = 3 UNION ALL SELECT o_orderkey::VARCHAR, 3, 'delete' FROM orders WHERE o_orderkey % 10 = 4""")
def _changes_of_write(spark, sf):
    own = _orders(spark, sf, feed=True)
    rows = own.df().drop("_rev").filter("o_orderkey % 10 = 3")
    own.upsert(rows.withColumn("o_totalprice", F.col("o_totalprice") + 1))
    own.bulk_remove(own.df().filter("o_orderkey % 10 = 4").select("o_orderkey"))
    return own.changes().select("id", "seq", "op")


@_add("realtime_applied", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 1 THEN 'R' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 7 <> 2 OR o_orderkey % 11 = 0")
def _realtime(spark, sf):
    own = _orders(spark, sf)
    rows = t(spark, sf, "orders").select("o_orderkey", "o_custkey", F.lit("R").alias("o_orderstatus"), "o_totalprice")
    new = F.to_json(F.struct("*"))
    update = rows.filter("o_orderkey % 7 = 1").select(F.concat(F.lit('{"event":"postgres_changes","payload":{"eventType":"UPDATE","new":'), new, F.lit("}}")).alias("value"), F.lit(1).alias("seq"))
    key = F.concat(F.lit('{"eventType":"DELETE","old":{"o_orderkey":'), F.col("o_orderkey").cast("string"), F.lit("}}"))
    delete = rows.filter("o_orderkey % 7 = 2 and o_orderkey % 11 <> 0").select(key.alias("value"), F.lit(2).alias("seq"))
    own.apply(replication.realtime_changes(update.unionByName(delete), "o_orderkey"))
    return own.df().select("o_orderkey", "o_orderstatus")


@_add("retries_due", "SELECT event_id::VARCHAR AS id FROM events WHERE event_id % 13 < 10 AND epoch(ts) + (event_id % 13 + 1) * 5 <= epoch(TIMESTAMP '2024-01-02 00:00:00')")
def _retries(spark, sf):
    queue = t(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), F.col("ts").alias("created"), (F.col("event_id") % 13).alias("retries"))
    return changes.due_retries(queue, F.to_timestamp(F.lit("2024-01-02 00:00:00"))).select("id")
