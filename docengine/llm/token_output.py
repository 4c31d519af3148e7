"""Token ids in a word-aligned binary form: Simple-8b with escapes and block offsets.

A segment is one binary value that stands for itself::

    magic 'S8B1' | u32 documents | u32 ids | u32 blocks | u32 escapes
    u32 tokens of each document
    u32 first 64-bit word of each block (a block is 4096 ids, the last is shorter)
    u32 first escape of each block
    u32 escaped ids
    u64 words

Each word has a selector in its top four bits. Selectors pack 240 or 120 zeros, or 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 or 1 ids
of equal width. Ids are stored plus one; an id that does not fit the packed width
limit is stored as zero and its value stands in the escape list, in order. So
every unsigned 32-bit id can be stored.

Blocks are decoded with one array operation per selector, each by itself. Segments
hold at most ``SEGMENT_IDS`` ids; a document that has more is split over
segments. Documents are numbered within their partition, and the parts of a split one
are told by that number, so repeated and null ids are no matter. Segments are
written by Spark as rows of a Parquet table, so tasks that are lost or run twice
leave no partial file.
"""

from __future__ import annotations

import itertools
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docengine.llm.common import crc32_joined, load, ship_code, text_bytes, written

NAME = "op4_token_output"
TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
MAGIC = b"S8B2"
BLOCK_IDS = 4096
SEGMENT_IDS = 1 << 20
CACHE_WORDS = 900_000
PIECES_AT_ONCE = 400_000
LONG_IDS = 1 << 21
SLICE_BYTES = 1 << 21
PART_BYTES = 1 << 24
PARTS_AT_ONCE = 1024
#: Fixed values of Simple-8b: ids per word and bits per id by selector.
COUNTS = [240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
WIDTHS = [0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
#: Ids below this are packed, the others are escaped.
LIMIT = (1 << 20) - 1
_NEED = np.searchsorted(1 << np.arange(21), np.arange(1 << 20), side="right").astype(np.int8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, first escape of each block, escaped ids) of unsigned 32-bit ids.

    The greedy choice is made for all positions at once: sliding maxima tell how many ids
    fit a word from there. More ids in a word leave fewer bits to each, so what fits
    also fits with fewer, and the choice is a count. Then all blocks step from word to word side by side.
    """
    n, n_blocks = len(ids), -(-len(ids) // BLOCK_IDS)
    escaped = ids >= LIMIT
    values = np.where(escaped, 0, ids + np.uint32(1)).astype(np.uint32)
    row = BLOCK_IDS + COUNTS[0]  # what follows a block's ids fits no width
    need = np.full((n_blocks, row), 127, np.int8)
    whole = n // BLOCK_IDS
    bits = _NEED[values]
    need[:whole, :BLOCK_IDS] = bits[: whole * BLOCK_IDS].reshape(whole, BLOCK_IDS)
    need[whole:, : n - whole * BLOCK_IDS] = bits[whole * BLOCK_IDS :]
    need = need.ravel()
    rank = np.zeros(len(need), np.int8)
    over, wide = need, 1
    for count, width in zip(COUNTS[14::-1], WIDTHS[14::-1], strict=True):
        shift = count - wide
        if shift > wide:
            break  # cannot be: each count is at most twice the one before
        longer = np.full(len(need), 127, np.int8)
        np.maximum(over[: len(need) - shift], over[shift:], out=longer[: len(need) - shift])
        over, wide = longer, count
        fits = over <= width
        if count > 8 and not fits.any():
            break
        rank += fits
    steps = np.array(COUNTS[::-1])
    here, lane = np.arange(n_blocks) * row, np.arange(n_blocks)
    end = here + np.minimum(BLOCK_IDS, n - lane * BLOCK_IDS)
    places, lanes = [], []
    while len(here):
        places.append(here)
        lanes.append(lane)
        here = here + steps[rank[here]]
        more = here < end
        if not more.all():
            here, lane, end = here[more], lane[more], end[more]
    places, lanes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, lanes))
    order = np.argsort(lanes.astype(np.int32), kind="stable")
    places, lanes = places[order], lanes[order]
    starts = places - lanes * (row - BLOCK_IDS)
    selectors = 15 - rank[places].astype(np.int64)
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(selectors):
        width = WIDTHS[selector]
        if width:
            rows = np.flatnonzero(selectors == selector)
            word, at = words[rows], starts[rows]
            for k in range(COUNTS[selector]):
                word |= values[at + k].astype(np.uint64) << np.uint64(k * width)
            words[rows] = word
    offsets = np.searchsorted(lanes, np.arange(n_blocks))
    before = np.concatenate([[0], np.cumsum(escaped)])[: n : BLOCK_IDS] if n else np.zeros(0)
    return words, offsets.astype(np.uint32), before.astype(np.uint32), ids[escaped].astype(np.uint32)


def unpack(words: np.ndarray, n: int, escapes: np.ndarray) -> np.ndarray:
    """The ids of whole blocks."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS)[selectors]
    starts = np.cumsum(counts) - counts
    values = np.zeros(n, dtype=np.uint64)
    for selector in np.unique(selectors):
        width = WIDTHS[selector]
        if width:
            rows = np.flatnonzero(selectors == selector)
            shifts = (np.arange(COUNTS[selector]) * width).astype(np.uint64)
            mask = np.uint64((1 << width) - 1)
            values[starts[rows][:, None] + np.arange(COUNTS[selector])] = (words[rows][:, None] >> shifts) & mask
    ids = (values - np.uint64(1)).astype(np.uint32)
    ids[values == 0] = escapes
    return ids


def encode_segment(docs: list[np.ndarray]) -> bytes:
    """One segment of the ids of some documents."""
    lengths = np.array([len(d) for d in docs], dtype=np.uint32)
    ids = np.concatenate(docs).astype(np.uint32, copy=False) if docs else np.zeros(0, np.uint32)
    words, offsets, before, escapes = pack(ids)
    head = MAGIC + struct.pack("<4I", len(docs), len(ids), len(offsets), len(escapes))
    return b"".join([head, *(x.astype("<u4").tobytes() for x in (lengths, offsets, before, escapes)), words.astype("<u8").tobytes()])


def _parts(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, tokens of each document, first words, first escapes, escapes, words) of a segment."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    n_docs, n_ids, n_blocks, n_escapes = struct.unpack_from("<4I", data, 4)
    small = np.frombuffer(data, "<u4", n_docs + 2 * n_blocks + n_escapes, 20)
    words = np.frombuffer(data[20 + 4 * len(small) :], "<u8")
    return n_ids, *np.split(small, np.cumsum([n_docs, n_blocks, n_blocks])), words


def decode_segment(data: bytes) -> list[np.ndarray]:
    """The documents' ids of one segment."""
    n_ids, lengths, _, _, escapes, words = _parts(data)
    ids = unpack(words, n_ids, escapes)
    return np.split(ids, np.cumsum(lengths)[:-1]) if len(lengths) else []


def decode_block(data: bytes, block: int) -> np.ndarray:
    """The ids of one block, found by its offsets without reading the others."""
    n_ids, _, offsets, before, escapes, words = _parts(data)
    own, held = words[offsets[block] :], escapes[before[block] :]
    if block + 1 < len(offsets):
        own, held = words[offsets[block] : offsets[block + 1]], escapes[before[block] : before[block + 1]]
    return unpack(own, min(BLOCK_IDS, n_ids - block * BLOCK_IDS), held)


#: Bytes that lead a character which may be white space beyond ASCII, and marks that may follow a word.
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b".,;:!?")] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_GAP = bytes(32)
_SAFE = re.compile(rb"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def _byte_letters() -> dict[int, str]:
    """Byte to character by the rule of byte-level models: printable ones stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = sorted(set(range(256)) - set(own))
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


def cuts(data: np.ndarray) -> np.ndarray:
    """Places at which a text may be cut so that the pieces' ids, one after the other, are those of the whole.

    The pre-tokenizer's pattern takes a blank with what follows it, a run of letters never with a mark
    behind it, and a line end between two other characters alone. So a text is cut before a
    blank or line end that has no white space on either side, behind such a line end,
    and between a letter and a mark. What may be white space beyond ASCII prevents a cut.
    """
    n = len(data)
    if n < 2:
        return np.zeros(0, np.int64)
    dark = data > 32
    # whether the character that ends here may be white space of two or three bytes
    odd = np.zeros(n, bool)
    odd[1:] = _LEADS[data[:-1]]
    odd[2:] |= _LEADS[data[:-2]]
    odd &= data >= 128
    before, after = dark & ~odd, dark & ~_LEADS[data]
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[(at > 0) & (at < n - 1)]
    at = at[before[at - 1] & after[at + 1]]
    lines = at[data[at] == 10] + 1
    marks = np.flatnonzero(_MARKS[data])
    marks = marks[marks > 1]
    last = data[marks - 1]
    letter = _LETTERS[last] | ((data[marks - 2] == 0xC3) & (last >= 128) & (last != 0x97) & (last != 0xB7))
    flags = np.zeros(n, bool)
    flags[at] = flags[lines] = flags[marks[letter]] = True
    return np.flatnonzero(flags)


class _Pieces:
    """Ids of pieces of text, made by the tokenizer when first met.

    A piece of fewer than 24 bytes is found by an open hash table of arrays, all pieces of
    a batch at once, and compared byte by byte; longer ones are in a dictionary.
    """

    SLOTS = 21

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.clear()

    def clear(self) -> None:
        self.slot = np.full(1 << self.SLOTS, -1, np.int32)
        self.keys = np.zeros((3, CACHE_WORDS), np.uint64)
        self.start, self.count = np.zeros(CACHE_WORDS, np.int64), np.zeros(CACHE_WORDS, np.int32)
        self.pool, self.used, self.held = np.zeros(1 << 20, "<u4"), 0, 0
        self.long: dict[bytes, np.ndarray] = {}
        self.long_ids = 0

    def ids_of(self, piece: bytes) -> list[int]:
        text = piece.decode("utf-8")
        word = text[1:] if text[0] == " " else text
        if word and max(word) < "\u0250" and word.isalpha():  # one run of letters is one call of the model
            return [t.id for t in self.tokenizer.model.tokenize(piece.decode("latin-1").translate(self.letters))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        x = keys[0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ keys[2] * np.uint64(0x165667B19E3779F9)
        x ^= x >> np.uint64(29)
        return x * np.uint64(0xBF58476D1CE4E5B9)

    def find(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 if it has none."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        place = (hashes >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        while len(left):
            entry = self.slot[place]
            taken = entry >= 0
            left, place, entry = left[taken], place[taken], entry[taken]
            same = (self.keys[0][entry] == keys[0][left]) & (self.keys[1][entry] == keys[1][left]) & (self.keys[2][entry] == keys[2][left])
            out[left[same]] = entry[same]
            left, place = left[~same], (place[~same] + 1) & ((1 << self.SLOTS) - 1)
        return out

    def _add(self, keys: np.ndarray, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Enter distinct keys that are not there yet."""
        n = len(pieces)
        found = [self.ids_of(p) for p in pieces]
        counts = np.fromiter(map(len, found), np.int64, n)
        ids = np.fromiter(itertools.chain.from_iterable(found), "<u4", int(counts.sum()))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        entries = np.arange(self.held, self.held + n)
        self.keys[:, entries] = keys
        self.start[entries], self.count[entries] = self.used + np.cumsum(counts) - counts, counts
        self.used, self.held = self.used + len(ids), self.held + n
        place = (hashes >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        while len(entries):
            free = self.slot[place] < 0
            self.slot[place[free]] = entries[free]  # the last of equals stays
            lost = self.slot[place] != entries
            entries, place = entries[lost], (place[lost] + 1) & ((1 << self.SLOTS) - 1)

    def _entries(self, keys: np.ndarray, pieces: Callable[[np.ndarray], list[bytes]]) -> np.ndarray:
        """The entry of each key; what is new is entered."""
        hashes = self._hash(keys)
        entry = self.find(keys, hashes)
        while (missing := np.flatnonzero(entry < 0)).size:
            _, at = np.unique(hashes[missing], return_index=True)
            new = missing[at]
            if self.held + len(new) > CACHE_WORDS:
                self.clear()
                entry = self.find(keys, hashes)
                continue
            self._add(keys[:, new], hashes[new], pieces(new))
            entry[missing] = self.find(keys[:, missing], hashes[missing])
        return entry

    def encode(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each document) of documents that stand apart in ``data``, which ends with a gap."""
        raw = np.frombuffer(data, np.uint8)
        flags = np.zeros(len(raw) + 1, bool)
        flags[cuts(raw)] = flags[starts] = flags[ends] = True
        places = np.flatnonzero(flags)
        doc = np.searchsorted(starts, places, side="right") - 1
        own = (doc >= 0) & (places < ends[np.maximum(doc, 0)])
        size = np.append(places[1:], len(raw))[own] - places[own]
        first, doc = places[own], doc[own]
        words = np.ndarray((len(raw) - 7,), "<u8", data, 0, (1,))
        counts, out = [], []
        for at in range(0, len(first), PIECES_AT_ONCE):
            n, ids = self._some(data, words, first[at : at + PIECES_AT_ONCE], size[at : at + PIECES_AT_ONCE])
            counts.append(n)
            out.append(ids)
        if not out:
            return np.zeros(0, "<u4"), np.zeros(len(starts), np.int64)
        return np.concatenate(out), np.bincount(doc, np.concatenate(counts), minlength=len(starts)).astype(np.int64)

    def _some(self, data: bytes, words: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        short = np.flatnonzero(size < 24)
        begin, n_bytes = first[short], size[short]
        keys = np.empty((3, len(short)), np.uint64)
        for k in range(3):
            keys[k] = words[begin + 8 * k] & _MASKS[np.clip(n_bytes - 8 * k, 0, 8)]
        keys[2] |= n_bytes.astype(np.uint64) << np.uint64(56)
        entry = self._entries(keys, lambda new: [data[i : i + m] for i, m in zip(begin[new].tolist(), n_bytes[new].tolist(), strict=True)])
        n, source = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        n[short], source[short] = self.count[entry], self.start[entry]
        extra, extra_n = [], 0
        for k in np.flatnonzero(size >= 24).tolist():
            ids = self._long(data[first[k] : first[k] + size[k]])
            n[k], source[k] = len(ids), self.used + extra_n
            extra.append(ids)
            extra_n += len(ids)
        pool = np.concatenate([self.pool[: self.used], *extra]) if extra else self.pool
        return n, pool[np.repeat(source - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]

    def _long(self, piece: bytes) -> np.ndarray:
        if piece not in self.long:
            ids = np.array(self.ids_of(piece), "<u4")
            if self.long_ids + len(ids) + len(piece) > LONG_IDS:
                self.long, self.long_ids = {}, 0
            self.long[piece] = ids
            self.long_ids += len(ids) + len(piece)
            return ids
        return self.long[piece]


_LOADED: dict[str, _Pieces] = {}


def _slices(text: bytes) -> Iterator[bytes]:
    """A long text in slices, cut before blanks between letters or digits."""
    at = 0
    while len(text) - at > SLICE_BYTES and (cut := _SAFE.search(text, at + SLICE_BYTES)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode_texts(texts: Iterator[bytes], words: _Pieces) -> Iterator[tuple[np.ndarray, bool]]:
    """(ids, whether they end the text) of each text in UTF-8, without an end id; many texts at once."""
    held, size, last = [], 0, []

    def flush() -> Iterator[tuple[np.ndarray, bool]]:
        lengths = np.array([len(x) for x in held], np.int64)
        starts = len(_GAP) + np.cumsum(lengths + len(_GAP)) - lengths - len(_GAP)
        ids, n = words.encode(_GAP + _GAP.join(held) + _GAP, starts, starts + lengths)
        yield from zip(np.split(ids, np.cumsum(n)[:-1]), last, strict=True)

    for text in texts:
        for part in (parts := list(_slices(text))):
            held.append(part)
            last.append(part is parts[-1])
            size += len(part) + len(_GAP)
            if size >= SLICE_BYTES:
                yield from flush()
                held, size, last = [], 0, []
    if held:
        yield from flush()


def _valid(text: bytes) -> bytes:
    try:
        text.decode("utf-8")
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()
    return text


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int, segment_ids: int) -> Iterator[pa.RecordBatch]:
    """Sorted documents of one partition to segments, in order."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    if path not in _LOADED:
        _LOADED[path] = _Pieces(path)
    words = _LOADED[path]
    end = np.array([end_id], dtype=np.uint32)
    names, held, n, number, docs, inside = [], [], 0, 0, 0, False

    def flush() -> pa.RecordBatch:
        nonlocal names, held, n, number
        row = {"part": part, "segment": number, "first": docs - len(names), "doc_ids": names, "n_ids": n, "data": encode_segment(held)}
        names, held, n, number = [], [], 0, number + 1
        return pa.RecordBatch.from_pylist([row], schema=_SEGMENT)

    for batch in batches:
        doc_ids = iter(batch.column("doc_id").to_pylist())
        for ids, last in encode_texts(map(_valid, text_bytes(batch, "text")), words):
            if not inside:
                doc_id = next(doc_ids)
                docs += 1
                names.append(doc_id)
                held.append(ids[:0])
                if last and n and n + len(ids) >= segment_ids > len(ids):  # it fits whole into the next segment
                    names.pop(), held.pop()
                    docs -= 1
                    yield flush()
                    docs += 1
                    names.append(doc_id)
                    held.append(ids[:0])
            inside = not last
            ids = np.concatenate([ids, end]) if last else ids
            while len(ids):
                if n == segment_ids:  # the document goes on in the next segment
                    yield flush()
                    names.append(doc_id)
                    held.append(ids[:0])
                held[-1] = np.concatenate([held[-1], ids[: segment_ids - n]])
                took = min(len(ids), segment_ids - n)
                ids, n = ids[took:], n + took
            if last and n >= segment_ids:
                yield flush()
    if names:
        yield flush()


_SEGMENT_SQL = "part int, segment int, first long, doc_ids array<long>, n_ids long, data binary"
_SEGMENT = pa.schema(
    [("part", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("data", pa.binary())]
)


def write_segments(
    docs: DataFrame, path: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS, partitions: int | None = None
) -> DataFrame:
    """Token ids of all texts in ascending order of doc_id, as a written table of segments.

    A null text is empty and gives the end id alone; a null doc_id comes first;
    rows with the same doc_id follow each other in the order of a hash of their texts, so
    a hot doc_id is dealt out like any other rows. ``doc_id`` must be an integer. Partitions
    hold about ``PART_BYTES`` of text each.
    """
    spark = docs.sparkSession
    ship_code(spark)
    if not partitions:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(1, -(-total // PART_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(partitions, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    run = partial(_encode, path=path, end_id=end_id, segment_ids=segment_ids)
    return written(ordered.mapInArrow(run, _SEGMENT_SQL), "token-segments")


_DIGEST = {"part": pa.int32(), "number": pa.int64(), "whole": pa.bool_(), "doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}
_DIGEST_SQL = "part int, number long, whole boolean, doc_id long, start long, n_tokens long, ids_crc32 long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            docs = decode_segment(row["data"])
            n = np.array([len(d) for d in docs], np.int64)
            whole = np.ones(len(docs), bool)
            whole[:1] &= not row["continued"]
            whole[-1:] &= not row["open"]
            crc = [zlib.crc32(d.astype("<u4", copy=False)) for d in docs]
            start = row["start"] + np.cumsum(n) - n
            columns = [np.full(len(docs), row["part"]), row["first"] + np.arange(len(docs)), whole, row["doc_ids"], start, n, crc]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, _DIGEST.values(), strict=True)], list(_DIGEST))


def _joined(table: pa.Table) -> pa.Table:
    """The parts of one document to one digest."""
    rows = table.sort_by("start").to_pylist()
    crc, n = 0, 0
    for r in rows:
        crc = crc32_joined(crc, r["ids_crc32"], 4 * r["n_tokens"])
        n += r["n_tokens"]
    row = {"doc_id": rows[0]["doc_id"], "start": rows[0]["start"], "n_tokens": n, "ids_crc32": crc}
    return pa.Table.from_pylist([row], schema=pa.schema([(k, pa.int64()) for k in row]))


def read_digests(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the segments.

    A start is the sum of the ids of earlier partitions, of earlier segments of
    the partition and of earlier documents of the segment. One number for each
    ``PARTS_AT_ONCE`` partitions passes through the driver. The parts of a split
    document, one row for each segment of it, are joined by their checksums.
    """
    spark = segments.sparkSession
    ship_code(spark)
    before = lambda c, window: F.coalesce(F.sum(c).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = segments.select("part", "segment", "n_ids", "first", (F.col("first") + F.size("doc_ids")).alias("next"))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("bunch", F.expr(f"part div {PARTS_AT_ONCE}"))
    totals, base = [], 0
    for bunch, n in sorted(parts.groupBy("bunch").agg(F.sum("n")).collect()):
        totals.append((bunch, base))
        base += n
    bases = spark.createDataFrame(totals, "bunch long, base long")
    parts = parts.join(F.broadcast(bases), "bunch").select("part", (F.col("base") + before("n", Window.partitionBy("bunch").orderBy("part"))).alias("base"))
    inside = Window.partitionBy("part").orderBy("segment")
    places = sizes.select(
        "part",
        "segment",
        before("n_ids", inside).alias("within"),
        F.coalesce(F.lag("next").over(inside) > F.col("first"), F.lit(False)).alias("continued"),
        F.coalesce(F.lead("first").over(inside) < F.col("next"), F.lit(False)).alias("open"),
    )
    places = places.join(parts, "part").select("part", "segment", "continued", "open", (F.col("base") + F.col("within")).alias("start"))
    places = written(places, "token-places")
    rows = segments.join(places, ["part", "segment"]).select("part", "first", "doc_ids", "open", "continued", "start", "data")
    out = ["doc_id", "start", "n_tokens", "ids_crc32"]
    digests = rows.mapInArrow(_digest, _DIGEST_SQL)
    if not places.filter("open").limit(1).count():
        return digests.select(*out)
    digests = written(digests, "token-digests")
    split = digests.filter("not whole").groupBy("part", "number").applyInArrow(_joined, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return digests.filter("whole").select(*out).unionByName(split)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_digests(write_segments(load(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)))


ORACLE_SQL = None
