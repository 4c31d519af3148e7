"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

Fingerprints are made per document from whole texts. The distinct ones form a
binary trie. The self-join walks pairs of nodes: it starts from the pair (root,
root), goes to pairs of children, adds up the bits in which their paths differ,
and drops a pair as soon as that exceeds the budget. The upper levels are walked
as DataFrames, four bits a step: a pair is split until it holds few fingerprints,
so a crowded subtree is cut as finely as it needs. The remaining small pairs are
walked bit by bit by Arrow tasks.

That is the query. ``keep_one``, the pipeline's stage, walks the same trie over several
selections of the bits of wider fingerprints and verifies what it links by the
similarity of sets of five-word shingles (``near_components``).

A task returns a spanning forest of the links that it finds, never all pairs.
Links become components by minimum labels with pointer jumping over written
tables. Copies share one fingerprint and are joined back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.llm.common import discard, give_back, key_filter, keyed, load, may_hold, ship_code, text_bytes, written

NAME = "op7_simhash_dedup"
SHINGLE = 3
BUDGET = 2
STEP = 4
UNIT_ROWS = 1 << 17
WIDE_UNIT_ROWS = 1 << 19
NEAR_WORDS = 5
WIDE_BUDGET = 30
TABLES = 60
TABLE_DEPTH = 16
DOCS_AT_ONCE = 256
ORDER_DOCS = 10_000
ORDER_SHINGLES = 1 << 18
_CHUNK = 1 << 17
_PAIRS = 1 << 18


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text in UTF-8; zero if it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), grams), dtype=">u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(x, shingle) for x in text_bytes(batch, "text")], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def _pairs_within(a: np.ndarray, b: np.ndarray, same: bool, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into a, into b) of sorted unsigned arrays that differ in at most ``budget`` bits.

    The stack holds blocks of node pairs: ranges of a and b, the bits in which
    their paths differ so far, and their depth.
    """
    if not len(a) or not len(b):
        return
    prefix = int(a[0] ^ b[0]) >> (64 - depth) if depth else 0
    stack = [(depth, *(np.array([x]) for x in (0, len(a), 0, len(b), prefix.bit_count())))]
    while stack:
        d, la, ha, lb, hb, err = stack.pop()
        if len(la) > _CHUNK:
            half = len(la) // 2
            stack.append((d, *(x[half:] for x in (la, ha, lb, hb, err))))
            la, ha, lb, hb, err = (x[:half] for x in (la, ha, lb, hb, err))
        sizes = (ha - la) * (hb - lb)
        leaf = (sizes <= 16) | (d == 64)
        if leaf.any():
            for i, j in _expand(la[leaf], ha[leaf], lb[leaf], hb[leaf], sizes[leaf]):
                near = np.bitwise_count(a[i] ^ b[j]) <= budget
                if same:
                    near &= i < j
                yield i[near], j[near]
            la, ha, lb, hb, err = (x[~leaf] for x in (la, ha, lb, hb, err))
        if not len(la):
            continue
        bit = np.uint64(1 << (63 - d))
        above = ~np.uint64((1 << (64 - d)) - 1) if d else np.uint64(0)
        ma = np.clip(np.searchsorted(a, (a[la] & above) | bit), la, ha)
        mb = np.clip(np.searchsorted(b, (b[lb] & above) | bit), lb, hb)
        nexts = []
        for x0, x1, y0, y1, more in ((la, ma, lb, mb, 0), (ma, ha, mb, hb, 0), (la, ma, mb, hb, 1), (ma, ha, lb, mb, 1)):
            ok = (x0 < x1) & (y0 < y1) & (err + more <= budget)
            if same:
                ok &= x0 < y1  # the mirror image of a pair is walked once
            nexts.append((x0[ok], x1[ok], y0[ok], y1[ok], err[ok] + more))
        merged = tuple(np.concatenate(x) for x in zip(*nexts, strict=True))
        if len(merged[0]):
            stack.append((d + 1, *merged))


def _expand(la, ha, lb, hb, sizes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs of the given ranges, in blocks of bounded size."""
    at = 0
    ends = np.cumsum(sizes)
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS)))
        n = sizes[at:to]
        which = np.repeat(np.arange(at, to), n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        width = (hb - lb)[which]
        yield la[which] + k // width, lb[which] + k % width
        at = to


class _Forest:
    """Minimum labels of what is linked so far."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while len(i):
            li, lj = label[i], label[j]
            apart = li != lj
            i, j, li, lj = i[apart], j[apart], li[apart], lj[apart]
            if not len(i):
                break
            np.minimum.at(label, np.maximum(li, lj), np.minimum(li, lj))
            while not np.array_equal(label, jumped := label[label]):
                label[:] = jumped


def _walk_unit(table: pa.Table, budget: int) -> pa.Table:
    side = table.column("side").to_numpy()
    values = table.column("fp").to_numpy().view(np.uint64)
    depth = int(table.column("depth")[0].as_py())
    a, b = np.sort(values[side == 0]), np.sort(values[side == 1])
    same = not len(b)
    if same:
        b = a
    nodes = a if same else np.concatenate([a, b])
    forest = _Forest(len(nodes))
    for i, j in _pairs_within(a, b, same, depth, budget):
        forest.link(i, j if same else j + len(a))
    moved = np.flatnonzero(forest.label != np.arange(len(nodes)))
    return pa.table({"src": nodes[moved].view(np.int64), "dst": nodes[forest.label[moved]].view(np.int64)})


def _walk_wide(table: pa.Table, budget: int, wide_budget: int) -> pa.Table:
    """As ``_walk_unit``, but a link must hold for the wide fingerprints too, and links themselves are returned, near ones first."""
    side, depth = table.column("side").to_numpy(), int(table.column("depth")[0].as_py())
    fp, one, two, size, name = (table.column(c).to_numpy() for c in ("fp", "p1", "p2", "n", "id"))
    fp = fp.view(np.uint64)
    order = np.lexsort((fp, side))
    cut = int((side == 0).sum())
    fp, one, two, size, name = (x[order] for x in (fp, one, two, size, name))
    same = cut == len(fp)
    forest, out = _Forest(len(fp)), []

    def join(held: list[tuple[np.ndarray, ...]]) -> None:
        """Each component takes its nearest link, until all are joined."""
        i, j, apart = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.argsort(apart, kind="stable")
        i, j, apart = i[by], j[by], apart[by]
        while len(i):
            high = np.maximum(forest.label[i], forest.label[j])
            _, first = np.unique(high, return_index=True)
            first = first[forest.label[i[first]] != forest.label[j[first]]]
            out.append((name[i[first]], name[j[first]], apart[first]))
            forest.link(i[first], j[first])
            left = forest.label[i] != forest.label[j]
            i, j, apart = i[left], j[left], apart[left]

    held, n = [], 0
    for i, j in _pairs_within(fp[:cut], fp[:cut] if same else fp[cut:], same, depth, budget):
        j = j if same else j + cut
        apart = np.bitwise_count(one[i] ^ one[j]).astype(np.int64) + np.bitwise_count(two[i] ^ two[j])
        near = (apart <= wide_budget) & (5 * np.minimum(size[i], size[j]) >= 4 * np.maximum(size[i], size[j])) & (forest.label[i] != forest.label[j])
        held.append((i[near], j[near], apart[near]))
        n += len(held[-1][0])
        if n > _PAIRS:
            join(held)
            held, n = [], 0
    if n:
        join(held)
    x, y, d = (np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else ((), (), ())))
    return pa.table({"src": np.minimum(x, y), "dst": np.maximum(x, y), "apart": pa.array(d, type=pa.int64())})


def trie_links(prints: DataFrame, budget: int = BUDGET, unit_rows: int = UNIT_ROWS, wide_budget: int | None = None, start: int = 0) -> DataFrame:
    """(src, dst) between distinct fingerprints ``fp``: a forest with the components of all links.

    ``prints`` must be a written table of distinct values. With a ``wide_budget`` it also has
    id, the wide fingerprint p1 and p2 and the size n of what was hashed; a link then
    needs at most so many differing bits in that and sizes of a ratio of 0.8 or more, and
    the result is (src, dst, apart) with ids and these bits. Where fingerprints that differ in their
    first ``start`` bits (a multiple of ``STEP``) are more than the budget apart, the walk
    begins with the nodes at that depth.
    """
    spark = prints.sparkSession
    ship_code(spark)
    masks = spark.range(0, 1 << STEP, 1, 1).select(F.col("id").alias("mask"), F.bit_count("id").alias("more")).filter(F.col("more") <= budget)
    units = None
    frontier = spark.range(1).selectExpr("0L as a", "0L as b", "0 as err")
    depth, depths, made = start, [], []
    while True:
        depth += STEP if depths or not start else 0
        depths.append(depth)
        nodes = written(
            prints.groupBy(F.shiftrightunsigned("fp", 64 - depth).alias("node")).agg(F.count("*").alias("n")), f"trie-{depth}"
        )
        left = nodes.select(F.shiftright("node", STEP).alias("a"), F.col("node").alias("a1"), F.col("n").alias("na"))
        right = nodes.select(F.col("node").alias("b1"), F.col("n").alias("nb"))
        if depth == start:
            pairs = nodes.select(F.col("node").alias("b1"), F.col("node").alias("a1"), F.lit(0).alias("err"), F.col("n").alias("na"), F.col("n").alias("nb"))
        else:
            pairs = (
                frontier.join(left, "a")
                .join(F.broadcast(masks), F.col("err") + F.col("more") <= budget)
                .select(
                    "a1",
                    F.shiftleft("b", STEP).bitwiseOR(F.col("a1").bitwiseAND(F.lit((1 << STEP) - 1)).bitwiseXOR(F.col("mask"))).alias("b1"),
                    (F.col("err") + F.col("more")).alias("err"),
                    "na",
                )
                .filter("a1 <= b1" if depth < 64 else "true")
                .join(right, "b1")
            )
        pairs = written(pairs, f"trie-pairs-{depth}")
        made += [nodes, pairs]
        size = F.when(F.col("a1") == F.col("b1"), F.col("na")).otherwise(F.col("na") + F.col("nb"))
        small = (size <= unit_rows) if depth < 64 else F.lit(True)
        ready = pairs.filter(small).select("a1", "b1", F.lit(depth).alias("depth"))
        units = ready if units is None else units.unionByName(ready)
        frontier = pairs.filter(~small).select(F.col("a1").alias("a"), F.col("b1").alias("b"), "err")
        if depth >= 64 or not frontier.limit(1).count():
            break
    units = written(units, "trie-units")
    for table in made:
        discard(table)
    out = None
    held = prints.columns
    for d in depths:
        at = units.filter(F.col("depth") == d)
        keyed = prints.select(*held, F.shiftrightunsigned("fp", 64 - d).alias("node"))
        one = at.select("a1", "b1", F.col("a1").alias("node"), F.lit(0).alias("side"), "depth")
        two = at.filter("a1 <> b1").select("a1", "b1", F.col("b1").alias("node"), F.lit(1).alias("side"), "depth")
        rows = one.unionByName(two).join(keyed, "node").select("a1", "b1", "depth", "side", *held)
        out = rows if out is None else out.unionByName(rows)

    def walk(unit: pa.Table) -> pa.Table:
        return _walk_unit(unit, budget) if wide_budget is None else _walk_wide(unit, budget, wide_budget)

    found = out.groupBy("a1", "b1", "depth").applyInArrow(walk, "src long, dst long" + (", apart long" if wide_budget is not None else ""))
    return written(found.distinct(), "trie-links")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (src, dst): the smallest node that it reaches."""
    edges = written(links.select("src", "dst").union(links.select("dst", "src")).distinct(), "cc-edges")
    labels = edges.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select(
        "node", F.least("node", "m").alias("label")
    )
    labels = written(labels, "cc-labels")
    while True:
        near = edges.join(labels, edges["dst"] == labels["node"]).groupBy("src").agg(F.min("label").alias("near"))
        near = written(near, "cc-near")
        lower = labels.join(near, labels["node"] == near["src"]).select(
            "node", F.least("label", "near").alias("label"), F.col("label").alias("old")
        )
        lower = written(lower, "cc-lower")
        up = lower.select(F.col("node").alias("at"), F.col("label").alias("up"))
        jumped = lower.join(up, lower["label"] == up["at"]).select("node", F.least("label", "up").alias("label"), "old")
        jumped = written(jumped, "cc-labels")
        changed = jumped.filter("label <> old").limit(1).count()
        for done in (near, lower, labels):
            discard(done)
        labels = jumped.select("node", "label")
        if not changed:
            discard(edges)
            return labels


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest doc_id that is reachable over links of at
    most ``budget`` differing bits. Defined cases: a null or empty text and one
    without words have the fingerprint zero, linked like any other; a null doc_id
    is never the smallest unless a component has no other; repeated rows give
    repeated rows; an empty table gives an empty result. Only doc_id and text
    are read.
    """
    spark = docs.sparkSession
    ship_code(spark)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, fp long"
    rows = docs.select("doc_id", "text").mapInArrow(partial(_fingerprints, shingle=shingle), schema)
    rows = written(rows, "simhash-rows")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-prints")
    labels = written(components(trie_links(prints.select("fp"), budget)), "simhash-labels")
    joined = prints.join(labels, prints["fp"] == labels["node"], "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label")
    )
    joined = written(joined, "simhash-joined")
    roots = written(joined.groupBy("label").agg(F.min("least").alias("component_id")), "simhash-roots")
    known = written(joined.join(roots, "label").select(F.col("fp").alias("known"), "component_id"), "simhash-known")
    return rows.join(known, rows["fp"] == known["known"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingle_set(text: bytes, words: int = NEAR_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct word shingles; a shorter text is one shingle, one without words has none."""
    own = text.lower().split()
    if not own:
        return np.zeros(0, np.int64)
    if len(own) < words:
        grams = [b" ".join(own)]
    else:
        grams = map(b" ".join, zip(*(own[i:] for i in range(words)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), dtype=np.uint64).view(np.int64))


def wide_print(hashes: np.ndarray) -> bytes:
    """The 128-bit SimHash of a set of hashes, as bytes; zero for an empty set."""
    counts = np.zeros(128, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        own = hashes[at : at + (1 << 15)].view(np.uint64)
        other = own * np.uint64(0x9E3779B97F4A7C15)
        other = (other ^ other >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        lanes = np.stack([own, other ^ other >> np.uint64(32)], axis=1).view(np.uint8)
        counts += np.unpackbits(lanes, axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, held, _ in _parts(batch):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *held]))], ["h"])


def _first_ones(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first ``n - ceil(0.8 n) + l`` of a set's hashes, those that are common last, with l = max(1, n div 20).

    Of what two sets of that similarity share, the first k stand among both sets' first ones, k being the lesser l.
    """
    keys, counts = common
    n = len(hashes)
    if not n:
        return hashes
    if len(keys):
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        hashes = hashes[np.argsort(np.where(keys[at] == hashes, counts[at], 0), kind="stable")]
    return hashes[: n - (4 * n + 4) // 5 + max(1, n // 20)]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[bytes]]]:
    """(rows, shingle sets, digests of these) of some documents at a time, so few sets are held at once."""
    for at in range(0, batch.num_rows, DOCS_AT_ONCE):
        some = batch.slice(at, DOCS_AT_ONCE)
        held = [shingle_set(text) for text in text_bytes(some, "text")]
        yield some, held, [xxhash.xxh3_128_digest(x.tobytes()) for x in held]
    give_back()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = pa.array(np.cumsum([0, *map(len, arrays)]), type=pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *arrays]).astype(np.int64)))


def _near_rows(batches: Iterator[pa.RecordBatch], common) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some, held, digests in _parts(batch):
            wide = np.frombuffer(b"".join(map(wide_print, held)), np.int64).reshape(-1, 2)
            columns = [pa.array(digests, type=pa.binary()), pa.array(list(map(len, held)), type=pa.int64())]
            columns += [pa.array(wide[:, 0].copy()), pa.array(wide[:, 1].copy()), _lists([_first_ones(x, common.value) for x in held])]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("key"), *columns], ["doc_id", "key", "node", "n", "p1", "p2", "first"])


def _hits(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(node, i, h): of the first hashes those that other documents may have too, with their places."""
    for batch in batches:
        column = batch.column("first")
        own, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
        at = np.flatnonzero(may_hold(shared.value, own))
        row = np.searchsorted(ends, at, side="right")
        place = at - np.concatenate([[0], ends])[row]
        columns = [batch.column("node").take(pa.array(row)), batch.column("n").take(pa.array(row)), pa.array(place), pa.array(own[at])]
        yield pa.RecordBatch.from_arrays(columns, ["node", "n", "i", "h"])


def _selections() -> np.ndarray:
    """Four of the sixteen bytes of a wide fingerprint for each table; four tables share out all of them."""
    rng = np.random.default_rng(31)
    return np.concatenate([rng.permutation(16).reshape(4, 4) for _ in range(-(-TABLES // 4))])[:TABLES]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each table and node: the table's number three times over, so that two tables differ in more bits than the budget, and its bits."""
    for batch in batches:
        wide = np.stack([batch.column(c).to_numpy() for c in ("p1", "p2")], axis=1).view(np.uint8)
        for table, taken in enumerate(_selections()):
            own = np.ascontiguousarray(wide[:, taken]).view("<u4").ravel().astype(np.uint64)
            head = np.uint64(table << 58 | table << 52 | table << 46)
            yield pa.RecordBatch.from_arrays([pa.array((head | own << np.uint64(14)).view(np.int64)), *batch.columns], ["fp", *batch.schema.names])


def _heads(digests: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests.to_pylist()), np.int64)


def _wholes(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, held, digests in _parts(batch):
            take = np.flatnonzero(may_hold(wanted.value, np.frombuffer(b"".join(d[:8] for d in digests), np.int64))).tolist()
            if take:
                columns = [pa.array([digests[k] for k in take], type=pa.binary()), _lists([held[k] for k in take])]
                yield pa.RecordBatch.from_arrays(columns, ["node", "hashes"])


def near_candidates(nodes: DataFrame, budget: int = BUDGET, wide_budget: int = WIDE_BUDGET) -> DataFrame:
    """(src, dst, apart) of nodes (id, p1, p2, n): links that a walk of the trie finds, a forest for each unit.

    The trie holds ``TABLES`` selections of 32 of the 128 bits, each below a number of its
    own. Nodes of one key are compared with one of them; the walk goes over distinct keys.
    """
    schema = "fp long, id long, p1 long, p2 long, n long"
    keys = written(nodes.select("id", "p1", "p2", "n").mapInArrow(_keys, schema), "near-keys")
    drawn = F.min(F.struct(F.xxhash64("id", "fp").alias("o"), "id", "p1", "p2", "n")).alias("x")
    reps = keys.groupBy("fp").agg(F.count("*").alias("c"), drawn).select("fp", "c", "x.id", "x.p1", "x.p2", "x.n")
    reps = written(reps, "near-reps")
    to = reps.filter("c > 1").select("fp", F.col("id").alias("to"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("n").alias("m"))
    apart = (F.bit_count(F.col("p1").bitwiseXOR(F.col("q1"))) + F.bit_count(F.col("p2").bitwiseXOR(F.col("q2")))).cast("long")
    star = keys.join(to, "fp").filter((F.col("id") != F.col("to")) & (apart <= wide_budget) & (5 * F.least("n", "m") >= 4 * F.greatest("n", "m")))
    star = star.select(F.least("id", "to").alias("src"), F.greatest("id", "to").alias("dst"), apart.alias("apart"))
    links = trie_links(reps.drop("c"), budget, WIDE_UNIT_ROWS, wide_budget, TABLE_DEPTH)
    out = written(star.unionByName(links).groupBy("src", "dst").agg(F.min("apart").alias("apart")), "near-candidates")
    discard(keys)
    discard(reps)
    return out


def _pairs_of(marked: DataFrame) -> DataFrame:
    """(src, dst, ls, ld) of all pairs of nodes with different labels that may be alike, from (h, id, n, i, label): their first hashes.

    Two like sets share k = max(1, n div 20) of these or more, n being the smaller size. So hashes that
    only one label has go, then nodes with too few, and again. In the order of how many nodes have it, and with t
    hashes left of a set, the first one that a pair shares stands among the first ``t - k + 1`` of both: a
    hash that many unlike sets have makes pairs only where a set has little else to share, and hashes of
    the same sets make them once.
    """
    few = F.expr("greatest(1, ((4 * n + 4) div 5) div 20)")
    for _ in range(2):
        mixed = marked.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("h")
        left = marked.join(mixed, "h", "left_semi")
        enough = left.groupBy("id", "n").agg(F.count("*").alias("t")).filter(F.col("t") >= few).select("id")
        left = written(left.join(enough, "id", "left_semi"), "near-mixed")
        discard(marked)
        marked = left
    ranked = marked.join(marked.groupBy("h").agg(F.count("*").alias("c")), "h")
    own = Window.partitionBy("id")
    ranked = ranked.withColumn("r", F.row_number().over(own.orderBy("c", "h"))).withColumn("left", F.count("*").over(own) - F.col("r") + 1)
    ranked = written(ranked.filter(F.col("left") >= few).select("h", "id", "n", "i", "left", "label"), "near-ranked")
    discard(marked)
    mixed = ranked.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("h")
    shared = ranked
    ranked = written(ranked.join(mixed, "h", "left_semi"), "near-ranked")
    # hashes that the same nodes have, as those of a passage, are one; taken for the same by mistake, they make more pairs, not fewer
    alike = ranked.groupBy("h").agg(F.xxhash64(F.bit_xor(F.xxhash64("id")), F.count("*")).alias("as"))
    ranked = ranked.join(alike, "h").groupBy(F.col("as").alias("h"), "id").agg(*[F.first(x).alias(x) for x in ("n", "label")], F.min("i").alias("i"), F.max("left").alias("left"))
    ranked = written(ranked.select("h", "id", "n", "i", "left", "label"), "near-ranked")
    discard(shared)
    one, two = ranked.toDF("h", "src", "n", "i", "s", "ls"), ranked.toDF("h", "dst", "m", "j", "t", "ld")
    k = F.expr("greatest(1, least(n, m) div 20)")
    # any of the first k that a pair shares leaves room for the rest of an overlap of what follows in both
    room = (F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) + k - 1) * 9 >= (F.col("n") + F.col("m")) * 4
    sizes = 5 * F.least("n", "m") >= 4 * F.greatest("n", "m")
    pairs = one.join(two, (one["h"] == two["h"]) & (F.col("src") < F.col("dst")) & (F.col("ls") != F.col("ld")) & (F.least("s", "t") >= k) & sizes & room)
    out = written(pairs.select("src", "dst", "ls", "ld").distinct(), "near-rest")
    discard(ranked)
    return out


def _near_groups(docs: DataFrame, wide_budget: int) -> DataFrame:
    """(doc_id, key, group) of rows (doc_id, key, text)."""
    spark = docs.sparkSession
    ship_code(spark)
    kinds = dict(docs.dtypes)
    every = max(docs.count() // ORDER_DOCS, 1)
    sampled = docs.filter(F.pmod(F.xxhash64("key", "text"), F.lit(every)) == 0).select("doc_id", "text")
    common = sampled.mapInArrow(_shingles, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 2")
    common = common.orderBy(F.desc("n"), "h").limit(ORDER_SHINGLES).orderBy("h").toArrow()
    common = spark.sparkContext.broadcast(tuple(common.column(k).to_numpy() for k in ("h", "n")))
    schema = f"doc_id {kinds['doc_id']}, key {kinds['key']}, node binary, n long, p1 long, p2 long, first array<long>"
    rows = written(docs.mapInArrow(partial(_near_rows, common=common), schema), "near-rows")
    twice = rows.select(F.explode("first").alias("h")).groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h")
    twice = written(twice, "near-twice")
    hits = rows.select("node", "n", "first").mapInArrow(partial(_hits, shared=key_filter(twice)), "node binary, n long, i long, h long")
    hits = written(hits.join(twice, "h", "left_semi").distinct(), "near-hits")
    discard(twice)
    # a set has a like one only if that many of its first ones are shared; the sizes differ by a fifth at most
    few = F.expr("greatest(1, ((4 * n + 4) div 5) div 20)")
    for _ in range(2):  # without the nodes that go, fewer are shared
        kept = hits.join(hits.groupBy("node", "n").agg(F.count("*").alias("c")).filter(F.col("c") >= few), "node", "left_semi")
        both = kept.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1")
        kept = written(kept.join(both, "h", "left_semi"), "near-hits")
        discard(hits)
        hits = kept
    wanted = hits.groupBy("node", "n").agg(F.count("*").alias("c")).filter(F.col("c") >= few).select("node")
    wanted = written(wanted, "near-wanted")
    each = rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "p1", "p2")])
    some = written(each.join(wanted, "node", "left_semi").withColumn("id", F.monotonically_increasing_id()), "near-some")
    found = near_candidates(some, wide_budget=wide_budget)
    whole = docs.select("text").mapInArrow(partial(_wholes, wanted=key_filter(some.select("node"), _heads)), "node binary, hashes array<long>")
    whole = whole.join(some.select("node", "id"), "node").groupBy("id").agg(F.first("hashes").alias("hashes"))
    whole = written(whole, "near-whole")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(whole.toDF("src", "a"), "src").join(whole.toDF("dst", "b"), "dst")
        overlap, total = F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b")
        return written(both.filter(overlap * 9 >= total * 4).select(*pairs.columns), "near-links")

    def labels(links: DataFrame) -> DataFrame:
        return components(links).toDF("known", "label")

    def merged(named: DataFrame, pairs: DataFrame) -> DataFrame:
        """The labels after the links among pairs (src, dst, ls, ld) too; components are joined, not their nodes."""
        up = labels(verified(pairs).select(F.col("ls").alias("src"), F.col("ld").alias("dst")).distinct())
        moved = named.join(up.toDF("label", "top"), "label", "left").select("known", F.coalesce("top", "label").alias("label"))
        return written(moved.unionByName(up.join(named, "known", "left_anti")), "near-named")

    first = written(found.groupBy("dst").agg(F.min(F.struct("apart", "src")).alias("x")).select("x.src", "dst"), "near-first")
    named = labels(verified(first))
    more = found.select("src", "dst").join(first, ["src", "dst"], "left_anti")
    more = more.join(named.toDF("src", "ls"), "src", "left").join(named.toDF("dst", "ld"), "dst", "left")
    more = more.select("src", "dst", F.coalesce("ls", "src").alias("ls"), F.coalesce("ld", "dst").alias("ld"))
    named = merged(named, written(more.filter("ls <> ld"), "near-more"))
    # what the tables miss: first hashes that nodes of several components share
    marked = hits.join(some.select("node", "id"), "node").join(named, F.col("id") == F.col("known"), "left")
    marked = written(marked.select("h", "id", "n", "i", F.coalesce("label", "id").alias("label")), "near-marked")
    discard(hits)
    named = merged(named, _pairs_of(marked))
    groups = written(some.select("node", "id").join(named, F.col("id") == F.col("known")).select("node", "label"), "near-groups")
    group = F.coalesce(F.col("label").cast("string"), F.hex("node")).alias("group")
    out = written(rows.select("doc_id", "key", "node").join(groups, "node", "left").select("doc_id", "key", group), "near-rows-of-groups")
    for table in (rows, whole, found):
        discard(table)
    return out


def near_components(docs: DataFrame, wide_budget: int = WIDE_BUDGET) -> DataFrame:
    """(doc_id, component_id) per row: the smallest doc_id that is reachable over links of Jaccard 0.8 or more.

    Sets of five-word shingles are compared; equal sets are one node. Under one order of all
    shingles, sets of that similarity share one of their first ``n - ceil(0.8 n) + 1``, and l of
    the first l more than that; nodes that share fewer
    with another are left out. The order puts last what is common in a sample of texts; it
    decides about the time alone. The others go through the trie
    (``near_candidates``), and a pair that it links within ``wide_budget`` of 128 bits is
    verified with the whole sets: first the nearest link of each node, then those that
    would still join two components. So that no pair is missed by a budget of bits, first
    shingles that several components still share give the pairs that are left,
    which are verified too. Defined cases as for ``keep_one``.
    """
    groups = _near_groups(docs.select("doc_id", F.col("doc_id").alias("key"), "text"), wide_budget)
    smallest = groups.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return groups.join(smallest, "group").select("doc_id", "component_id")


def keep_one(docs: DataFrame, wide_budget: int = WIDE_BUDGET) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, with their own columns: one row of each component stays.

    It is the one with the smallest doc_id, of several with that id any one. Defined cases: a
    null text is empty, and texts without words are copies of each other; a null
    doc_id stays only where its component has no other; an empty table stays empty;
    columns of any name pass through. What is joined to the texts is the rows that go, the smaller side.
    """
    rows, key = keyed(docs)
    groups = _near_groups(rows.select("doc_id", F.col(key).alias("key"), "text"), wide_budget)
    stays = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", "key")).alias("x"))
    gone = groups.join(stays.select("group", F.col("x.key").alias("stays")), "group").filter("key <> stays").select(F.col("key").alias(key))
    return rows.join(written(gone, "near-gone"), key, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(load(spark, sf_dir, "documents"))


ORACLE_SQL = None
