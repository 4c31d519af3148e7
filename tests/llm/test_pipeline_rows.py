"""The pipeline's stages on rows that are odd, against a plain version of what each should keep."""

import corpus_pipeline
from docengine.llm import decontaminate, exact_dedup, quality, simhash_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key int, row_key string, node string"


def rows_of(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, "r", "n") for d, t in rows], SCHEMA)


def kept(df):
    assert df.columns == [f.split(" ")[0] for f in SCHEMA.split(", ")]
    return sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "") for r in df.collect())


def test_exact_copies_one_row_of_a_group(spark):
    rows = [(1, "ab long "), (5, "ab long"), (5, "other"), (5, "other"), (None, "ab long"), (None, "x"), (2, None), (3, ""), (4, " \n")]
    got = kept(exact_dedup.keep_one(rows_of(spark, rows)))
    # the most characters stay, then the smallest doc_id; empty, null and white texts are one group
    assert got == [(-1, "x"), (1, "ab long "), (4, " \n"), (5, "other")]
    assert kept(exact_dedup.keep_one(rows_of(spark, []))) == []


def test_near_copies_one_row_of_a_group(spark):
    body = " ".join(f"w{k}" for k in range(120))
    rows = [(9, body), (9, body + " more"), (3, body.upper()), (None, body), (4, "other text"), (4, "other text"), (None, None), (6, "")]
    got = kept(simhash_dedup.keep_one(rows_of(spark, rows)))
    assert got == [(3, body.upper()), (4, "other text"), (6, "")]
    assert kept(simhash_dedup.keep_one(rows_of(spark, []))) == []


def test_contaminated_rows_go_by_themselves(spark):
    item = " ".join(f"q{k}" for k in range(20))
    bench = spark.createDataFrame([(1, item, "z"), (None, None, "z")], "item_id long, text string, doc_id string")
    rows = [(7, f"before {item} after"), (7, "clean"), (None, item), (None, "clean too"), (8, None), (8, "")]
    assert kept(decontaminate.drop_contaminated(rows_of(spark, rows), bench)) == [(-1, "clean too"), (7, "clean"), (8, ""), (8, "")]
    assert kept(decontaminate.drop_contaminated(rows_of(spark, []), bench)) == []
    assert len(kept(decontaminate.drop_contaminated(rows_of(spark, rows), bench.limit(0)))) == len(rows)


def test_rejected_rows_go_by_their_own_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    machine = quality.fit(docs, labels)
    odd = [(None, None), (None, ""), (10**12, "x"), (10**12, "x"), (10**12 + 1, "a " * 5000)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + odd
    want = sorted(((-1 if d is None else d), t or "") for d, t in rows if machine.score((t or "").encode()) >= quality.THRESHOLD)
    assert kept(quality.keep_good(rows_of(spark, rows), labels)) == want
    assert kept(quality.keep_good(rows_of(spark, []), labels)) == []


def test_the_whole_pipeline_keeps_each_clean_row_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sf = "/root/testdata/sf0.001"
    plain = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain = spark.createDataFrame(stage(spark, plain, sf).collect(), docs.schema)
    out = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in plain.collect())
    assert all(r.round_trip for r in out) and len({r.doc_id for r in out}) == len(out)
