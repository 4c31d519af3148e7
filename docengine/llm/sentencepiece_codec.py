"""SentencePiece encoding and decoding, with a max-plus scan for giant documents.

Documents up to ``chunk_chars`` characters go through the library. A longer one is
cut into chunks anywhere, also within words, and the chunks are dealt out over the
cluster:

1. *Transfer matrices.* The state at a cut is the piece that covers or ends at
   the cut and how far it reaches beyond. For each chunk, each state at its left
   cut is led through the chunk; the result is a max-plus matrix, whose entry is
   the sum of the scores of the pieces from a left state to a right state, or
   minus infinity (absent) where no path leads.
2. *Combination.* Matrices combine associatively: ``FAN`` neighbours become one, of those
   again ``FAN`` become one, and so on, each group a task's work of its own, until a
   document has one. Then the states go down the same tree: a group that knows its
   outer states finds those between its members. A chunk so learns its left
   and right state, and no task ever holds more than ``FAN`` matrices of a document.
3. *Backtrace.* Each chunk retraces its own path between its two states. Checksums of chunks
   are joined in groups, too.

A matrix is held as groups of left states with one common row but for a number each. Behind a
word's start all left states are alike, so a chunk with a word boundary is a single group,
and so is every product with it.

The model is of the BPE kind, in which the path is not the one with the best sum:
a sequence of pieces is what the merges give if and only if every two neighbours
are what the merges give for their joint text. So the matrix admits a step from a
piece to the next only if that holds, and the one path that is left is the
library's result. No piece has a word mark behind another character, so before
each word everything but the place is forgotten; whole words in the middle of a
chunk are encoded in one call.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.common import crc32_joined, load, ship_code, text_bytes, written

NAME = "op2_sentencepiece"
MODEL = "piece_bpe_32k.model"
CHUNK_CHARS = 1 << 15
HELD_IDS = 1 << 18
FAN = 32
CHUNKS_AT_ONCE = 1024
MARK = "▁"
_MODELS: dict[str, Codec] = {}


class Codec:
    """A model of the BPE kind with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        plain = [i for i in range(n) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        self.score = {self.model.id_to_piece(i): self.model.get_score(i) for i in plain}
        self.id = {self.model.id_to_piece(i): i for i in plain}
        self.longest = max(map(len, self.score))
        self.by_id = np.array([self.score.get(self.model.id_to_piece(i), 0.0) for i in range(n)])
        self.byte = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.joint: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """What the merges give: always the best pair, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, left: str, right: str) -> bool:
        if right[0] == MARK and left[-1] != MARK:
            return True
        key = (left, right)
        if key not in self.joint:
            if len(self.joint) > 200_000:
                self.joint.clear()
            self.joint[key] = self.merge(left + right) == [left, right]
        return self.joint[key]

    def pieces_at(self, text: str, at: int) -> Iterator[str]:
        """Pieces that start here; a single character always is one."""
        yield text[at]
        for n in range(2, min(self.longest, len(text) - at) + 1):
            if text[at : at + n] in self.score:
                yield text[at : at + n]

    def ids_of(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            if p in self.id:
                out.append(self.id[p])
            else:
                out.extend(self.byte[b] for b in p.encode())
        return out

    def words(self, text: str) -> list[int]:
        """Ids of marked text that starts with a word mark."""
        return self.model.encode(text[1:].replace(MARK, " "))


def codec(path: str) -> Codec:
    if path not in _MODELS:
        _MODELS[path] = Codec(path)
    return _MODELS[path]


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def left_states(c: Codec, before: str, chunk: str, after: str) -> list[tuple[str, int]]:
    """(piece, reach beyond the cut) of all pieces that may cover or end at the left cut."""
    if not before:
        return [("", 0)]
    text, cut = before + chunk + after[: c.longest], len(before)
    out = []
    for start in range(max(0, cut - c.longest), cut):
        out += [(p, start + len(p) - cut) for p in c.pieces_at(text, start) if start + len(p) >= cut]
    return out


def _walk(c: Codec, text: str, end: int, state: tuple[str, int]) -> dict[tuple[str, int], tuple]:
    """From a left state, every reachable (piece, place of its end) with (score, previous)."""
    first = (state[0], state[1])
    found = {first: (0.0, None)}
    queue = {state[1]: [first]}
    for at in range(state[1], end):
        for here in queue.pop(at, ()):
            for p in c.pieces_at(text, at):
                if not here[0] or c.follows(here[0], p):
                    there = (p, at + len(p))
                    score = found[here][0] + c.score.get(p, 0.0)
                    if there not in found or score > found[there][0]:
                        if there not in found:
                            queue.setdefault(there[1], []).append(there)
                        found[there] = (score, here)
    return found


def _cuts(chunk: str, last: bool) -> tuple[int, int]:
    """The first and the last place of the chunk at which a word starts behind another word; (-1, -1) if none."""
    import re

    places = [m.start() + 1 for m in re.finditer(f"[^{MARK}](?={MARK})", chunk)]
    return (places[0], places[-1]) if places else (-1, -1)


State = tuple[str, int]
Matrix = list[tuple[dict[State, float], dict[State, float]]]


def transfer(c: Codec, before: str, chunk: str, after: str) -> Matrix:
    """The chunk's max-plus matrix, without what cannot be reached.

    It is a list of (lefts, rights); the entry of a left and a right state of one
    group is the sum of their numbers, and so that of the scores of all pieces between them.
    """
    text, n = chunk + after[: c.longest], len(chunk)
    first, last = _cuts(chunk, not after)
    ends = lambda row: {(p, e - n): v for (p, e), v in row if e >= n and (after or e == n)}
    if first < 0:
        rows = ((s, ends((k, v[0]) for k, v in _walk(c, text, n, s).items())) for s in left_states(c, before, chunk, after))
        return [({state: 0.0}, row) for state, row in rows if row]
    tail = ends((k, v[0]) for k, v in _walk(c, text, n, ("", last)).items())
    middle = float(c.by_id[c.words(chunk[first:last])].sum()) if last > first else 0.0
    lefts = {}
    for state in left_states(c, before, chunk, after):
        if state[1] <= first:
            heads = [v[0] for s, v in _walk(c, text, first, state).items() if s[1] == first]
            if heads:
                lefts[state] = max(heads) + middle
    return [(lefts, tail)] if lefts and tail else []


def _onwards(row: dict[State, float], matrix: Matrix) -> dict[State, float]:
    """The max-plus product of a row and a matrix."""
    out: dict[State, float] = {}
    for lefts, rights in matrix:
        reached = [x + lefts[j] for j, x in row.items() if j in lefts]
        if reached:
            best = max(reached)
            for k, y in rights.items():
                if k not in out or best + y > out[k]:
                    out[k] = best + y
    return out


def combine(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product of two matrices."""
    made = ((lefts, _onwards(rights, b)) for lefts, rights in a)
    return [(lefts, row) for lefts, row in made if row]


def best_end(matrix: Matrix) -> State:
    """The right state at which the best path of a whole document ends."""
    row = _onwards({("", 0): 0.0}, matrix)
    return max(row, key=row.get)


def choose(matrices: list[Matrix], left: State, right: State) -> list[tuple[State, State]]:
    """The left and right state of each chunk on the best path between two states."""
    scores, steps = {left: 0.0}, []
    for m in matrices:
        after: dict[State, tuple[float, State]] = {}
        for lefts, rights in m:
            reached = [(x + lefts[i], i) for i, x in scores.items() if i in lefts]
            if reached:
                best, at = max(reached, key=lambda x: x[0])
                for k, y in rights.items():
                    if k not in after or best + y > after[k][0]:
                        after[k] = (best + y, at)
        steps.append(after)
        scores = {k: v[0] for k, v in after.items()}
    path, state = [], right
    for after in reversed(steps):
        path.append((after[state][1], state))
        state = after[state][1]
    return path[::-1]


def retrace(c: Codec, chunk: str, after: str, left: tuple[str, int], right: tuple[str, int]) -> list[int]:
    """Ids of the pieces that start in the chunk, on its path between two states."""
    text, n = chunk + after[: c.longest], len(chunk)

    def path(found: dict, state: tuple[str, int]) -> list[int]:
        pieces = []
        while found[state][1] is not None:
            pieces.append(state[0])
            state = found[state][1]
        return c.ids_of(pieces[::-1])

    first, last = _cuts(chunk, not after)
    if first < 0:
        return path(_walk(c, text, n, left), (right[0], right[1] + n))
    head = _walk(c, text, first, left)
    state = max((s for s in head if s[1] == first), key=lambda s: head[s][0])
    return [
        *path(head, state),
        *(c.words(chunk[first:last]) if last > first else []),
        *path(_walk(c, text, n, ("", last)), (right[0], right[1] + n)),
    ]


def scan_encode(c: Codec, text: str, chunk_chars: int) -> list[int]:
    """The scan on one machine: as the distributed form does it."""
    full = marked(text)
    if not full:
        return []
    parts = [(full[max(0, a - c.longest) : a], full[a : a + chunk_chars], full[a + chunk_chars :][: c.longest]) for a in range(0, len(full), chunk_chars)]
    levels = [[transfer(c, *p) for p in parts]]
    while len(levels[-1]) > 1:
        levels.append([reduce(combine, levels[-1][k : k + FAN]) for k in range(0, len(levels[-1]), FAN)])
    states = [(("", 0), best_end(levels[-1][0]))]
    for level in levels[-2::-1]:
        states = [x for k, (i, j) in enumerate(states) for x in choose(level[k * FAN : (k + 1) * FAN], i, j)]
    return [i for (b, t, a), (left, right) in zip(parts, states, strict=True) for i in retrace(c, t, a, left, right)]


_OUT = "n_tokens long, ids_crc32 long, n_chunks int, round_trip boolean"
_FULL = f"{_OUT}, ids array<int>"


def _small(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    c = codec(path)
    rows, ids_held, n = [], [], 0

    def out() -> pa.RecordBatch:
        nonlocal rows, ids_held, n
        columns = [pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=False)]
        if with_ids:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids_held])]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids_held))))
        rows, ids_held, n = [], [], 0
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for batch in batches:
        schema = _schema(batch.schema.field("doc_id").type, with_ids)
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), text_bytes(batch, "text"), strict=True):
            text = raw.decode("utf-8", "replace")
            ids = c.model.encode(text)
            same = c.model.decode(ids) == text
            packed = np.array(ids, dtype="<i4")
            rows.append((doc_id, len(ids), zlib.crc32(packed.tobytes()), 1, same))
            n += len(ids) + 1
            if with_ids:
                ids_held.append(packed)
            if n >= HELD_IDS:
                yield out()
        if rows:
            yield out()


def _schema(kind: pa.DataType, with_ids: bool) -> pa.Schema:
    fields = [("doc_id", kind), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("n_chunks", pa.int32()), ("round_trip", pa.bool_())]
    return pa.schema([*fields, *([("ids", pa.list_(pa.int32()))] if with_ids else [])])


_STATE = pa.struct([("piece", pa.string()), ("reach", pa.int32())])
_SIDE = pa.list_(pa.struct([("piece", pa.string()), ("reach", pa.int32()), ("score", pa.float64())]))
_MATRIX = pa.list_(pa.struct([("lefts", _SIDE), ("rights", _SIDE)]))
_STATE_SQL = "struct<piece:string,reach:int>"
_SIDE_SQL = "array<struct<piece:string,reach:int,score:double>>"
_MATRIX_SQL = f"uid long, chunk int, matrix array<struct<lefts:{_SIDE_SQL},rights:{_SIDE_SQL}>>"
_STATES_SQL = f"uid long, chunk int, left {_STATE_SQL}, right {_STATE_SQL}"
_MATRIX_ROW = pa.schema([("uid", pa.int64()), ("chunk", pa.int32()), ("matrix", _MATRIX)])
_STATES_ROW = pa.schema([("uid", pa.int64()), ("chunk", pa.int32()), ("left", _STATE), ("right", _STATE)])


def _flat(matrix: Matrix) -> list[dict]:
    side = lambda x: [{"piece": p, "reach": e, "score": v} for (p, e), v in x.items()]
    return [{"lefts": side(a), "rights": side(b)} for a, b in matrix]


def _matrix(flat: list[dict]) -> Matrix:
    side = lambda x: {(e["piece"], e["reach"]): e["score"] for e in x}
    return [(side(g["lefts"]), side(g["rights"])) for g in flat]


def _state(x: State) -> dict:
    return {"piece": x[0], "reach": x[1]}


def _matrices(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    c = codec(path)
    for batch in batches:
        for k in range(batch.num_rows):
            r = batch.slice(k, 1).to_pylist()[0]
            row = {"uid": r["uid"], "chunk": r["chunk"], "matrix": _flat(transfer(c, r["before"], r["body"], r["after"]))}
            yield pa.RecordBatch.from_pylist([row], schema=_MATRIX_ROW)


def _combined(key: tuple, table: pa.Table) -> pa.Table:
    """One matrix of up to ``FAN`` neighbours."""
    table = table.sort_by("chunk")
    whole = reduce(combine, (_matrix(m.as_py()) for m in table.column("matrix")))
    return pa.Table.from_pylist([{"uid": key[0].as_py(), "chunk": key[1].as_py(), "matrix": _flat(whole)}], schema=_MATRIX_ROW)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [{"uid": r["uid"], "chunk": 0, "left": _state(("", 0)), "right": _state(best_end(_matrix(r["matrix"])))} for r in batch.to_pylist()]
        yield pa.RecordBatch.from_pylist(rows, schema=_STATES_ROW)


def _between(table: pa.Table) -> pa.Table:
    """The states of up to ``FAN`` neighbours, whose outer states are known."""
    table = table.sort_by("chunk")
    left, right = ((x["piece"], x["reach"]) for x in (table.column(c)[0].as_py() for c in ("left", "right")))
    found = choose([_matrix(m.as_py()) for m in table.column("matrix")], left, right)
    rows = zip(table.column("uid").to_pylist(), table.column("chunk").to_pylist(), found, strict=True)
    return pa.Table.from_pylist([{"uid": u, "chunk": k, "left": _state(a), "right": _state(b)} for u, k, (a, b) in rows], schema=_STATES_ROW)


def states_of(matrices: DataFrame) -> DataFrame:
    """(uid, chunk, left, right) of all chunks from their matrices (uid, chunk, matrix): up a tree of products and down again."""
    levels = [written(matrices, "pieces-matrices")]
    group = F.expr(f"chunk div {FAN}").cast("int")
    while (levels[-1].agg(F.max("chunk")).first()[0] or 0) > 0:
        up = levels[-1].groupBy("uid", group.alias("group")).applyInArrow(_combined, _MATRIX_SQL)
        levels.append(written(up, "pieces-matrices"))
    states = levels[-1].mapInArrow(_ends, _STATES_SQL)
    for level in levels[-2::-1]:
        outer = states.withColumnRenamed("chunk", "group")
        rows = level.withColumn("group", group).join(outer, ["uid", "group"])
        states = written(rows.groupBy("uid", "group").applyInArrow(_between, _STATES_SQL), "pieces-states")
    return states


def _retraced(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    c = codec(path)
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        schema = pa.schema([("uid", pa.int64()), ("doc_id", kind), ("chunk", pa.int32()), ("n", pa.int64()), ("crc", pa.int64()), ("same", pa.bool_()), ("ids", pa.list_(pa.int32()))])
        for k in range(batch.num_rows):
            r = batch.slice(k, 1).to_pylist()[0]
            left, right = ((r[s]["piece"], r[s]["reach"]) for s in ("left", "right"))
            ids = retrace(c, r["body"], r["after"], left, right)
            # the chunk's pieces spell it from the left state's reach to the right state's
            spelt = (r["body"] + r["after"])[left[1] : len(r["body"]) + right[1]]
            same = c.model.decode(ids) == spelt.replace(MARK, " ").removeprefix(" ") if MARK not in r["text_mark"] else False
            row = {"uid": r["uid"], "doc_id": r["doc_id"], "chunk": r["chunk"], "n": len(ids), "crc": zlib.crc32(np.array(ids, dtype="<i4").tobytes()), "same": same, "ids": ids}
            yield pa.RecordBatch.from_pylist([row], schema=schema)


def _summed(table: pa.Table) -> pa.Table:
    """Neighbouring chunks' counts and checksums to one; the first chunk's number stays."""
    table = table.sort_by("chunk")
    crc, total = 0, 0
    for n, own in zip(table.column("n").to_pylist(), table.column("crc").to_pylist(), strict=True):
        crc, total = crc32_joined(crc, own, 4 * n), total + n
    row = table.slice(0, 1).to_pylist()[0] | {"n": total, "crc": crc, "same": all(table.column("same").to_pylist()), "parts": sum(table.column("parts").to_pylist())}
    return pa.Table.from_pylist([row], schema=table.schema)


def _document(table: pa.Table) -> pa.Table:
    table = table.sort_by("chunk")
    ids = table.column("ids").combine_chunks().flatten().to_numpy().astype("<i4")
    doc_id, same = table.column("doc_id")[0].as_py(), all(table.column("same").to_pylist())
    row = {"doc_id": doc_id, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes()), "n_chunks": table.num_rows, "round_trip": same, "ids": ids}
    return pa.Table.from_pylist([row], schema=_schema(table.schema.field("doc_id").type, True))


def encode(docs: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS, with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_crc32, n_chunks, round_trip and, if wanted, ids.

    ``ids_crc32`` is over the ids as little-endian 32-bit integers; ``round_trip``
    tells whether the ids were decoded to the text again (a text that has the word mark
    U+2581 itself is decoded with blanks in its place). Defined cases: a null or
    empty text has no ids and round_trip true; null and repeated doc_ids and repeated rows are encoded one by
    one; an empty table gives an empty result. Only doc_id, of any type, and text are read.
    A document's ids are one row's value, as its text is; without them no task holds a whole giant.
    """
    spark = docs.sparkSession
    ship_code(spark)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = f"doc_id {kind}, {_FULL if with_ids else _OUT}"
    small = rows.filter(F.length("text") <= chunk_chars).mapInArrow(partial(_small, path=path, with_ids=with_ids), out)
    giants = rows.filter(F.length("text") > chunk_chars).withColumn("uid", F.monotonically_increasing_id())
    full = giants.select("uid", "doc_id", F.concat(F.lit(MARK), F.translate("text", " ", MARK)).alias("full"), F.instr("text", MARK).alias("own"))
    reach = codec(path).longest
    cut = full.select("uid", "doc_id", "own", F.regexp_extract_all("full", F.lit("(?s).{1,%d}" % chunk_chars), F.lit(0)).alias("chunks"))
    near = lambda i: F.coalesce(F.get("chunks", i), F.lit(""))
    around = F.transform(
        "chunks",
        lambda body, i: F.struct(
            i.alias("chunk"), body.alias("body"), F.right(near(i - 1), F.lit(reach)).alias("before"), F.left(near(i + 1), F.lit(reach)).alias("after")
        ),
    )
    parts = cut.select("uid", "doc_id", F.when(F.col("own") > 0, MARK).otherwise("").alias("text_mark"), F.inline(around))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = written(parts.repartition(n, "uid", "chunk"), "pieces-chunks")
    matrices = parts.select("uid", "chunk", "before", "body", "after").mapInArrow(partial(_matrices, path=path), _MATRIX_SQL)
    traced = parts.join(states_of(matrices), ["uid", "chunk"]).mapInArrow(
        partial(_retraced, path=path), f"uid long, doc_id {kind}, chunk int, n long, crc long, same boolean, ids array<int>"
    )
    if with_ids:
        return small.unionByName(traced.groupBy("uid").applyInArrow(_document, out))
    sums = traced.drop("ids").withColumn("parts", F.lit(1).cast("long"))
    bunch = F.expr(f"chunk div {CHUNKS_AT_ONCE}").alias("bunch")
    fields = f"uid long, doc_id {kind}, chunk int, n long, crc long, same boolean, parts long"
    whole = sums.groupBy("uid", bunch).applyInArrow(_summed, fields).groupBy("uid").applyInArrow(_summed, fields)
    return small.unionByName(
        whole.select("doc_id", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"), F.col("parts").cast("int").alias("n_chunks"), F.col("same").alias("round_trip"))
    )


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    c = codec(path)
    for batch in batches:
        texts = [c.model.decode(x) if x else "" for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, type=pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids give an empty text."""
    ship_code(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, path=path), f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(load(spark, sf_dir, "documents"), model_path(), with_ids=False)


ORACLE_SQL = None
