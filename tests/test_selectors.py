import random

import pytest
from pyspark.sql import functions as F

from docengine.functions.mango import UnknownOperator, compile_selector
from docengine.plans.query import find

ROWS = [
    (1, "Alice", 30, ["a", "b"], [("x", 10)], None),
    (2, None, None, None, None, "u"),
    (3, "Bob", 25, [], [("x", 20), ("y", 5)], "v"),
    (4, "alice", -7, ["b"], [], "u"),
]
SCHEMA = "id int, name string, age int, tags array<string>, items array<struct<name:string,price:int>>, note string"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.mark.parametrize(
    ("selector", "ids"),
    [
        ({"name": "Alice"}, [1]),
        ({"name": {"$ne": "Alice"}}, [2, 3, 4]),
        ({"name": None}, [2]),
        ({"name": {}}, [1, 2, 3, 4]),
        ({"name": {"city": "x"}}, []),
        ({"age": {"$gt": 0}}, [1, 3]),
        ({"age": {"$gt": "0"}}, []),
        ({"age": {"$gte": None}}, [2]),
        ({"$not": {"age": {"$gt": 0}}}, [2, 4]),
        ({"age": {"$in": [25, None]}}, [2, 3]),
        ({"age": {"$nin": [25]}}, [1, 2, 4]),
        ({"age": {"$in": 25}}, []),
        ({"age": {"$nin": 25}}, [1, 2, 3, 4]),
        ({"age": {"$exists": False}}, [2]),
        ({"name": {"$type": "string"}}, [1, 3, 4]),
        ({"nowhere": {"$type": "null"}}, [1, 2, 3, 4]),
        ({"name": {"$regex": "(?i)^a"}}, [1, 4]),
        ({"name": {"$regex": "("}}, []),
        ({"name": {"$regex": "a(?=l)"}}, []),
        ({"tags": {"$size": 0}}, [3]),
        ({"tags": {"$all": ["b"]}}, [1, 4]),
        ({"tags": {"$all": []}}, [1, 3, 4]),
        ({"tags": ["a", "b"]}, [1]),
        ({"items": {"$elemMatch": {"price": {"$gt": 15}}}}, [3]),
        ({"tags": {"$elemMatch": {"x": 1}}}, []),
        ({"age": {"$mod": [5, 0]}}, [1, 2, 3]),
        ({"age": {"$mod": [5, -2]}}, [4]),
        ({"age": {"$mod": [0, 0]}}, []),
        ({"$or": []}, []),
        ({"$and": []}, [1, 2, 3, 4]),
        ({"$nor": [{"age": 30}, {"note": "u"}]}, [3]),
        ({"age": {"$near": 1}}, []),
    ],
)
def test_operators(df, selector, ids):
    assert [r.id for r in find(df, selector, "id").order_by("id").exec().collect()] == ids
    assert df.filter(compile_selector(df, selector).isNull()).count() == 0


def test_strict_raises(df):
    with pytest.raises(UnknownOperator):
        compile_selector(df, {"age": {"$near": 1}}, strict=True)


def matches(row, selector):
    """A matcher of its own, for random selectors over flat fields."""
    for key, value in selector.items():
        if key == "$and":
            ok = all(matches(row, s) for s in value)
        elif key == "$or":
            ok = any(matches(row, s) for s in value)
        elif key == "$not":
            ok = not matches(row, value)
        else:
            x = row[key]
            ok = True
            for op, v in value.items():
                same = (x is None and v is None) or (x is not None and v is not None and type(x) is type(v) and x == v)
                less = x is not None and v is not None and type(x) is type(v) and x < v
                ok &= {"$eq": same, "$ne": not same, "$lt": less, "$gte": same or (x is not None and v is not None and type(x) is type(v) and x > v)}[op]
        if not ok:
            return False
    return True


def test_random_selectors(df):
    rng = random.Random(4)

    def make(depth):
        kind = rng.choice(["leaf", "leaf", "$and", "$or", "$not"]) if depth else "leaf"
        if kind == "leaf":
            return {rng.choice(["name", "age"]): {rng.choice(["$eq", "$ne", "$lt", "$gte"]): rng.choice([30, 0, "Bob", "a", None])}}
        return {kind: make(depth - 1) if kind == "$not" else [make(depth - 1) for _ in range(rng.randint(0, 3))]}

    selectors = [make(3) for _ in range(40)]
    hits = df.select("id", *[compile_selector(df, s).alias(f"s{i}") for i, s in enumerate(selectors)]).collect()
    rows = {r[0]: {"name": r[1], "age": r[2]} for r in ROWS}
    for h in hits:
        assert [h[f"s{i}"] for i in range(40)] == [matches(rows[h.id], s) for s in selectors]


def test_filters_are_pushed_down(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select("id", F.lit("x").alias("name"), F.lit(1).alias("wide")).write.parquet(path)
    q = find(spark.read.parquet(path), {"id": {"$gt": 3}, "name": "x"}, "id").order_by("id").limit(2).select("id")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,3)" in plan and "EqualNullSafe(name,x)" in plan and "TakeOrderedAndProject" in plan and "wide" not in plan
