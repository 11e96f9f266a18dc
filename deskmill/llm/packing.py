"""Packing tokenised documents into sequences: dominance reduction, then best fit.

Lengths are at most the capacity, so the whole packing problem is a histogram of at most ``capacity`` numbers,
however many documents there are. Reduction and best fit work on that histogram and give bin patterns with
multiplicities; each piece then finds its place from its rank among the pieces of its length. The documents
themselves are never gathered or sorted as a whole.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskmill.llm.bpe import TO_BYTE
from deskmill.session import materialise

SALTS = 64


class Encoder:
    """Ids of a ``tokenizers`` file of a byte-level BPE.

    Its vocabulary is handed to tiktoken, which gives the same ids in a third of the time (tests/llm compares the two over all
    code points). A text that holds the string of a special token, which the file matches before all else, goes through
    ``tokenizers`` itself.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = {bytes(map(TO_BYTE.__getitem__, t)): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()
                 if t not in self.special}
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, pattern: str) -> Encoder:
    key = (path, pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(path, pattern)
    return _ENCODERS[key]


def token_pieces(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked, the ids (binary).

    A document is its ids and then ``end_id``. One of more than ``capacity`` ids is cut so that all pieces but the
    first are full. A null text counts as empty: one piece with the end id. Repeated rows give repeated pieces.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids_crc32", T.LongType())]
                          + [T.StructField("ids", T.BinaryType())] * with_ids)
    closing = struct.pack("<I", end_id)

    def run(batches):
        for batch in batches:
            own = _encoder(path, pattern)
            rows, columns = [], ([], [], [], [], [])
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = own.encode(text or "").tobytes() + closing
                n = len(ids) // 4
                start, end, piece = 0, n if n <= capacity else n % capacity or capacity, 0
                while start < n:
                    part = ids[4 * start:4 * end]
                    rows.append(row)
                    for column, value in zip(columns, (piece, start, end - start, zlib.crc32(part), part)):
                        column.append(value)
                    start, end, piece = end, end + capacity, piece + 1
            made = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *made[:4 + with_ids]],
                                             schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


# --- bins from a histogram of lengths

def _lowest(counts: np.ndarray, n: int) -> list[int]:
    """The n smallest items, with repeats."""
    found: list[int] = []
    for size in np.flatnonzero(counts)[:n]:
        found += [int(size)] * min(n - len(found), int(counts[size]))
        if len(found) == n:
            break
    return found


def _best_pair(counts: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two items a >= b with the largest sum that fits, the largest a among equal sums."""
    sizes = np.flatnonzero(counts[:room + 1])
    last = np.zeros(room + 1, np.int64)
    last[sizes] = sizes
    last = np.maximum.accumulate(last)
    limit = np.minimum(sizes, room - sizes)
    partner = last[limit]
    single = (partner == sizes) & (counts[sizes] < 2)
    partner[single] = last[np.maximum(limit[single] - 1, 0)]
    good = partner > 0
    if not good.any():
        return None
    sums = sizes[good] + partner[good]
    i = np.flatnonzero(sums == sums.max())[-1]
    return int(sizes[good][i]), int(partner[good][i])


def dominating_set(counts: np.ndarray, size: int, capacity: int) -> list[int] | None:
    """Items (with ``size`` first) that some optimal packing puts into one bin, or None if that can't be shown.

    A set that can replace any other content beside ``size`` item by item, never by a smaller one, dominates.
    ``counts`` still holds ``size``.
    """
    room = capacity - size
    counts = counts.copy()
    counts[size] -= 1
    low = _lowest(counts, 3)
    if not low or low[0] > room:
        return [size]
    best = int(np.flatnonzero(counts[:room + 1])[-1])
    if best == room or len(low) < 2 or low[0] + low[1] > room:
        return [size, best]  # nothing fits better than the largest partner, or only one partner fits
    if len(low) == 3 and sum(low) <= room:
        return None  # three partners fit: not decided
    a, b = _best_pair(counts, room)
    if best >= a + b:
        return [size, best]  # the largest partner outweighs every pair
    if a == best:
        above = counts.copy()
        above[:b + 1] = 0
        larger = _lowest(above, 2)
        if len(larger) < 2 or sum(larger) > room:
            return [size, a, b]  # in every pair the smaller one is at most b
    return None


def _times(counts: np.ndarray, items: list[int]) -> int:
    return min(int(counts[s]) // items.count(s) for s in set(items))


def reduce_instance(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Fixes dominating sets, largest item first, until none is left; takes them out of ``counts``.

    Taking items away only removes alternatives, so a set that dominates once is fixed as often as its items last.
    """
    fixed = []
    changed = True
    while changed:
        changed = False
        for size in np.flatnonzero(counts)[::-1].tolist():
            while counts[size] and (items := dominating_set(counts, size, capacity)):
                times = _times(counts, items)
                for s in items:
                    counts[s] -= times
                fixed.append((times, items))
                changed = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Best fit by decreasing length; equal bins are one class with a multiplicity."""
    classes: list[list[tuple[int, list[int]]]] = [[] for _ in range(capacity + 1)]
    has = np.zeros(capacity + 1, bool)

    def put(room: int, times: int, items: list[int]):
        if times:
            classes[room].append((times, items))
            has[room] = True

    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            open_rooms = np.flatnonzero(has[size:])
            if len(open_rooms):
                room = size + int(open_rooms[0])
                times, items = classes[room].pop()
                has[room] = bool(classes[room])
            else:
                room, times, items = capacity, left, []
            each = room // size
            full = min(times, left // each)
            put(room - each * size, full, items + [size] * each)
            left -= full * each
            if full < times:
                rest = times - full
                if left:
                    put(room - left * size, 1, items + [size] * left)
                    left, rest = 0, rest - 1
                if items:
                    put(room, rest, items)
    return [x for kept in classes for x in kept]


def layout(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, bins, first sequence, offset), by length and first rank.

    Piece number r of a length lies in the last row whose first rank is at most r; with q, j = divmod(r - first rank,
    bins) it goes to sequence first + j at offset + q * length.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        counts[size] = n
    patterns = reduce_instance(counts, capacity) + best_fit(counts, capacity)
    rows, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for times, items in patterns:
        offset = 0
        for size in dict.fromkeys(items):
            each = items.count(size)
            rows.append((size, int(used[size]), times, sequence, offset))
            used[size] += times * each
            offset += size * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


RANKS = 1 << 48


def pack(pieces: DataFrame, capacity: int = 2048, length_col: str = "length", order: tuple[str, ...] = ()) -> DataFrame:
    """Adds sequence_id and offset: every piece lies in one sequence, gapless from 0, at most ``capacity`` long.

    ``pieces`` is read twice and should be a written table. Lengths have to lie between 1 and the capacity (else
    an error). Only the histogram of lengths, at most ``capacity`` rows, comes to the driver. Pieces are numbered
    within their length per salt, so a length that a third of all pieces share is spread over tasks. ``order`` names
    columns that fix the numbering; repeated rows get places of their own. An empty table stays empty.
    """
    sizes = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}
    wrong = [s for s in sizes if s is None or not 1 <= s <= capacity]
    if wrong:
        raise ValueError(f"lengths outside 1..{capacity}: {wrong[:5]}")
    table = layout(sizes, capacity)
    salts = max(SALTS, sum(sizes.values()) // 100_000)
    keys = list(order) or [c for c in pieces.columns if c != length_col]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))
    before = Window.partitionBy(length_col).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (salted.groupBy(length_col, "_salt").count()
               .select(length_col, "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")))
    own = Window.partitionBy(length_col, "_salt").orderBy(*keys)
    ranked = (salted.withColumn("_rank", F.row_number().over(own) - 1).join(offsets, [length_col, "_salt"])
              .withColumn("_rank", F.col("_rank") + F.col("_before")))
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    schema = T.StructType([*[pieces.schema[n] for n in names], T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    starts = table[:, 0] * RANKS + table[:, 1]

    def place(batches):
        for batch in batches:
            length = batch.column(length_col).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            row = table[np.searchsorted(starts, length * RANKS + rank, "right") - 1] if len(rank) else table[:0]
            layer, bin_ = np.divmod(rank - row[:, 1], np.maximum(row[:, 2], 1))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(row[:, 3] + bin_),
                                              pa.array(row[:, 4] + layer * length)], schema.names)

    return ranked.select(*names, "_rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = 2048, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise and pack in one go; the pieces are written once to the shared folder in between.

    Null and empty texts are one piece; see ``token_pieces`` and ``pack`` for nulls, repeats and empty tables.
    """
    pieces = materialise(token_pieces(docs, path, pattern, capacity, end_id, id_col, text_col, with_ids), "pieces")
    return pack(pieces, capacity, "length", (id_col, "piece", "ids_crc32"))
