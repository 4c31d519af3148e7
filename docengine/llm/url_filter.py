"""URL rules by a sort-merge range join over reversed-host keys.

A host becomes its labels in reverse order, each followed by a dot, so a host
and all its subdomains are one interval of keys that begins with the host's key.
Intervals are nested or disjoint. Each task sorts its urls by key and sweeps them
along the sorted rules with a stack of the rules whose interval is open; the
rules on the stack are exactly those whose host fits. Urls stay where they were
read: nothing is shuffled, and a hot host is spread as its rows are.

Rules go to the tasks in blocks of at most ``block_rules``, so what is broadcast
is bounded; more rules make more passes and the longest fit of all passes wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.common import load, ship_code, written

NAME = "op8_url_filter"
BLOCK_RULES = 100_000
#: Action, host, path.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
DEFAULT = "allow"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def key_of(host: str) -> str:
    return "".join(f"{label}." for label in reversed(host.split(".")))


class Rules:
    """Rules by the keys of their hosts, in the order of these."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.of: dict[str, list[tuple[str, str, str]]] = {}
        for action, host, path in rules:
            self.of.setdefault(key_of(host), []).append((path, host + path, action))
        self.starts = sorted(self.of)


def sweep(keys: list[str], paths: list[str], rules: Rules) -> list[tuple[str, str] | None]:
    """For each url the longest fitting (rule, action), by one sorted pass."""
    out: list[tuple[str, str] | None] = [None] * len(keys)
    stack: list[tuple[str, list[tuple[str, str, str]]]] = []
    at = 0
    for i in sorted(range(len(keys)), key=keys.__getitem__):
        key = keys[i]
        while at < len(rules.starts) and rules.starts[at] <= key:
            start = rules.starts[at]
            while stack and not start.startswith(stack[-1][0]):
                stack.pop()
            stack.append((start, rules.of[start]))
            at += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        best = None
        for _, own in stack:
            for path, rule, action in own:
                if paths[i].startswith(path) and (best is None or (len(rule), rule, action) > (len(best[0]), *best)):
                    best = (rule, action)
        out[i] = best
    return out


def _judge(batches: Iterator[pa.RecordBatch], rules) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("rule", pa.string()), ("verdict", pa.string())])
    for batch in batches:
        hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
        best = sweep([key_of(x) for x in hosts], paths, rules.value)
        known = pa.array([x and {"rule": x[0], "verdict": x[1]} for x in best], type=kind)
        columns = [known if name == "_new" else batch.column(name) for name in [*batch.schema.names, "_new"]]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_new"])


def filter_urls(
    urls: DataFrame, rules: DataFrame | list[tuple[str, str, str]] = RULES, default: str = DEFAULT, block_rules: int = BLOCK_RULES
) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``urls`` (page_id, url).

    ``rules`` has (action, host, path). A rule fits its host and all subdomains
    if the path begins with the rule's; the longest rule wins (of equally long
    ones the greatest text). Defined cases: a null url or one without ``://`` has
    an empty host and path, no rule and the default verdict; a path without a
    leading slash fits no rule that has one; repeated rows are judged one by one;
    empty tables give empty results. Other columns are not read.
    """
    spark = urls.sparkSession
    ship_code(spark)
    if isinstance(rules, list):
        n = -(-len(rules) // block_rules)
        blocks = (rules[i * block_rules : (i + 1) * block_rules] for i in range(n))
    else:
        n = -(-rules.count() // block_rules)
        part = F.pmod(F.xxhash64("host", "path"), F.lit(max(n, 1)))
        blocks = ([tuple(r) for r in rules.filter(part == i).select("action", "host", "path").collect()] for i in range(n))
    rows = urls.select(
        "page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path")
    )
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for block in blocks:
        fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
        shared = spark.sparkContext.broadcast(Rules(block))
        rows = rows.mapInArrow(partial(_judge, rules=shared), f"{fields}, _new struct<rule:string,verdict:string>")
        old = F.col("_best") if "_best" in rows.columns else best
        longer = old.isNull() | (F.struct(F.length("_new.rule"), "_new.rule", "_new.verdict") > F.struct(F.length(old["rule"]), old["rule"], old["verdict"]))
        rows = rows.withColumn("_best", F.when(F.col("_new").isNotNull() & longer, F.col("_new")).otherwise(old)).drop("_new")
        if n > 1:  # one block of rules is held at a time
            rows = written(rows, "url-rules")
            shared.destroy()
    if "_best" in rows.columns:
        best = F.col("_best")
    return rows.select(
        "page_id", "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(load(spark, sf_dir, "pages"))


_FITS = " UNION ALL ".join(f"SELECT '{a}' AS action, '{h}' AS rhost, '{p}' AS rpath" for a, h, p in RULES)
ORACLE_SQL = f"""
WITH rules AS ({_FITS}),
u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (
  SELECT page_id, rhost || rpath AS rule, action,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS k
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, host, path, rule, coalesce(action, '{DEFAULT}') AS verdict
FROM p LEFT JOIN f ON p.page_id = f.page_id AND k = 1
"""
