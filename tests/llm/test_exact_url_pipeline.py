import hashlib
import re

import corpus_pipeline
from docengine.llm import exact_dedup as E
from docengine.llm import url_filter as U


def test_exact_dedup_odd_rows(spark):
    long = "ab cd " * 3000
    rows = [(1, None), (2, " \n"), (3, ""), (4, "a b"), (5, "ab"), (6, "a  b"), (7, long), (8, long + " "), (9, long + "x"), (None, "ab"), (4, "a b")]
    docs = spark.createDataFrame([(d, t, 1, "n") for d, t in rows], "doc_id long, text string, n_chars int, name string")
    got = E.exact_dedup(docs, block_chars=64).collect()
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), d is None, d or 0))
    want = {hashlib.sha256(k.encode()).hexdigest(): (min(g)[2], len(g)) for k, g in groups.items()}
    assert len(got) == len(rows)
    assert {r.text_sha256: (r.keep_id, r.group_size) for r in got} == want
    assert sum(r.kept for r in got) == len(groups)
    assert E.exact_dedup(docs.limit(0)).count() == 0
    assert sorted(r.doc_id for r in E.keep_one(docs).collect()) == [2, 6, 8, 9]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def test_urls(spark):
    rules = [*U.RULES, ("block", "a.example.net", "/en/x"), ("allow", "net", "/en/")]
    urls = [None, "", "no", "http://NET/", "http://net", "https://x.Example.NET/en/a?b", "http://example.com/de/#", "http://myexample.com/de/",
            "http://b.a.example.net/en/xy", "ftp://org?x/fr/", "http://q.org/fr/1", "http://q.org/fr", "http://é.org/fr/ü", "http://a.net/en/z", "x://y://net/"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    want = {i: brute(u, rules) for i, u in enumerate(urls)}
    for block in (100, 1):
        got = {r.page_id: tuple(r)[1:] for r in U.filter_urls(pages, rules, block_rules=block).collect()}
        assert got == want
    table = spark.createDataFrame(rules, "action string, host string, path string")
    assert {r.page_id: tuple(r)[1:] for r in U.filter_urls(pages, table, block_rules=2).collect()} == want
    assert U.filter_urls(pages, []).filter("verdict <> 'allow'").count() == 0
    assert U.filter_urls(pages.limit(0)).count() == 0


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = corpus_pipeline.load(spark, sf, "documents")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, sf), name)
        assert docs.columns == before.columns
        assert docs.exceptAll(before).count() == 0
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] / 2
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == sizes[-1] and last.filter("not round_trip").count() == 0
