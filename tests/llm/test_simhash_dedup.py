import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from docengine.llm import simhash_dedup as S


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {(d, f"{prints[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in S.query(spark, sf).select("doc_id", "fingerprint", "component_id").collect()}
    assert got == brute([tuple(r) for r in docs])


def test_edge_rows(spark):
    rows = [(5, None), (4, ""), (3, " \n"), (2, "One two"), (1, "one TWO"), (9, "a b c d " * 3000), (9, "a b c d " * 3000)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, n_chars long")
    got = S.simhash_components(docs).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == brute(rows)
    assert S.simhash_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("near", [0, 400])
def test_trie_walk_finds_all_pairs(near):
    rng = np.random.default_rng(near)
    values = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    if near:
        flips = np.array([1 << int(b) for b in rng.integers(0, 63, near)], dtype=np.uint64)
        values[:near] = values[0] ^ flips ^ np.roll(flips, 1)
    values = np.unique(values)
    got = {(int(i), int(j)) for a, b in S._pairs_within(values, values, True, 0, 2) for i, j in zip(a, b)}
    want = {(i, j) for j in range(len(values)) for i in range(j) if int(values[i] ^ values[j]).bit_count() <= 2}
    assert got == want


def test_units_are_split_until_small(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 40, dtype=np.int64)
    values = sorted({int(b) ^ (1 << int(k)) for b in base for k in rng.integers(0, 62, 12)})
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    links = S.trie_links(prints, 2, unit_rows=8)
    got = {tuple(r) for r in S.components(links).collect()}
    root = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= 2 and root[b] < root[a]:
                    root[a], changed = root[b], True
    assert got == {(v, r) for v, r in root.items() if sum(x == r for x in root.values()) > 1}


def test_keep_one_finds_all_pairs_of_jaccard_080(spark):
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    rows = [(k, word(int(rng.integers(1, 120)))) for k in range(120)]
    for k in range(120, 260):  # copies of copies with a few words changed, added or in capitals
        own = list(rows[int(rng.integers(0, k))][1])
        for _ in range(int(rng.integers(0, 4))):
            own[int(rng.integers(0, len(own)))] = "Z"
        rows.append((k, own + word(int(rng.integers(0, 4)))))
    line = word(60)
    rows += [(k, line + word(30)) for k in range(300, 340)] + [(k, line[:k] + ["Q"] + line[k:]) for k in range(400, 460) if k - 400 < 60]
    rows += [(500, []), (501, ["one", "two"]), (502, ["ONE", "Two"]), (None, ["one", "two"])]
    rows = [(d, " ".join(t)) for d, t in rows]
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(rows)))
    for _ in range(12):
        for i in range(len(rows)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if sets[i] == sets[j] or 5 * both >= 4 * len(sets[i] | sets[j]) > 0:
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, 10**9), 10**9 if d is None else d)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.doc_id for r in S.keep_one(docs).collect()]
    assert sorted(got) == sorted(least.values())
    assert S.keep_one(docs.limit(0)).count() == 0


def test_pairs_of_like_sets_are_all_found_and_common_hashes_make_few(spark):
    rng = np.random.default_rng(8)
    common = rng.integers(0, 1 << 40, 8).tolist()
    sets = [set(rng.integers(0, 1 << 40, 80).tolist()) | set(common) for _ in range(150)]
    for k in range(120):  # like ones, and some just below and above 0.8
        own = sorted(sets[int(rng.integers(0, 150))])
        lost = set(rng.choice(own, int(rng.integers(0, 20)), replace=False).tolist())
        sets.append((set(own) - lost) | set(rng.integers(0, 1 << 40, int(rng.integers(0, 6))).tolist()))
    rows = []
    for x, own in enumerate(sets):
        first = S._first_ones(np.array(sorted(own)), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        rows += [(int(h), x, len(own), i, x) for i, h in enumerate(first)]
    marked = S.written(spark.createDataFrame(rows, "h long, id long, n long, i long, label long"), "near-marked")
    got = {(r.src, r.dst) for r in S._pairs_of(marked).collect()}
    want = {(a, b) for b in range(len(sets)) for a in range(b) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))}
    assert len(want) > 50 and want <= got
    assert len(got) < 6000  # of 36,315, most of which share a common hash


def test_wide_walk_starts_below_the_numbers_of_tables(spark):
    rng = np.random.default_rng(4)
    nodes = spark.createDataFrame([(k, int(a), int(b), 50) for k, (a, b) in enumerate(rng.integers(-(1 << 62), 1 << 62, (300, 2)))], "id long, p1 long, p2 long, n long")
    labels = []

    def seen(df, label):
        out = S_written(df, label)
        labels.append((label, out.count()))
        return out

    S_written, S.written = S.written, seen
    try:
        S.near_candidates(nodes).count()
    finally:
        S.written = S_written
    assert ("trie-units", S.TABLES) in labels  # each key goes to one unit, not to all within two bits of its table's number


def test_keep_one_keeps_one_row_of_repeated_ids(spark):
    rows = [(1, "a b c d"), (1, "A b c d"), (2, "a b C d"), (None, "a b c d"), (3, "x"), (3, "x"), (None, "y"), (None, None), (7, "")]
    docs = spark.createDataFrame([(d, t, 0, "k") for d, t in rows], "doc_id long, text string, key int, row_key string")
    got = S.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "").lower()) for r in got.collect()) == [(0, "y"), (1, "a b c d"), (3, "x"), (7, "")]


def test_wide_walk_holds_little_and_joins_all_near_pairs():
    rng = np.random.default_rng(7)
    wide = rng.integers(-(1 << 62), 1 << 62, (100_000, 2))
    copies = rng.integers(0, 10_000, 40_000)
    wide[60_000:] = wide[copies] ^ (np.int64(1) << rng.integers(0, 62, (40_000, 2)))
    fp = (wide[:, 0].view(np.uint64) >> np.uint64(32) << np.uint64(14)).view(np.int64)
    fp, k = np.unique(fp, return_index=True)
    zero = np.zeros(len(k), np.int32)
    unit = pa.table({"side": zero, "depth": zero + 16, "fp": fp, "p1": wide[k, 0], "p2": wide[k, 1], "n": np.full(len(k), 50), "id": k})
    tracemalloc.start()
    try:
        links = S._walk_wide(unit, 2, 30)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 120e6
    forest = S._Forest(len(wide))
    forest.link(links.column("src").to_numpy(), links.column("dst").to_numpy())
    here = np.isin(copies, k) & np.isin(np.arange(60_000, 100_000), k)
    assert here.sum() > 15_000
    assert (forest.label[copies[here]] == forest.label[60_000:][here]).all()


def test_no_rows_of_lists_are_read_by_python_workers_of_their_own(spark, monkeypatch):
    from docengine.llm.labelled import sample

    docs = spark.createDataFrame([(k, f"text {k} of some words") for k in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, quality int")
    prints = S.written(spark.range(40).select(S.F.xxhash64("id").alias("fp")), "test-prints")

    def no(*_, **__):
        raise AssertionError("a second kind of Python worker starts and stays in the executors")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", no)
    assert len(sample(docs, labels, "quality", S.F.lit(True), 10, 1000)) == 8
    assert S.trie_links(prints, 2, unit_rows=8).count() == 0
