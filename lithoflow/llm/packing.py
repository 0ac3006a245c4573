"""Best-fit packing of tokenised documents, with certified bin counts.

Pieces are dealt to partitions of a bounded size by a hash of their identity and packed best-fit decreasing. Each partition
then gets a lower bound from dual feasible functions (the threshold functions and the rounding functions u(k)); a partition
that uses no more bins than its bound is certified. The counts of all lengths (a number for each length up to the capacity)
give the same bound for the whole table. While more bins are used than that, partitions exchange documents: those with gaps
give all of theirs, certified ones what lies in bins with room left, since each of them may hold one bin too many by
rounding alone, and one in ``REOPENED`` of the full bins, whose small pieces fill the others. The exchanged pieces are dealt anew with another seed and packed again, in fewer partitions
each time. Only (document, piece, length) rows move; tokens stay where the text is read.

Defined cases: null and empty texts are one piece holding only the end id; equal documents are packed each for itself; rows
that repeat a doc_id are packed each for itself too; an empty table packs into nothing; documents of more than the capacity
are cut from the end, so that only the first piece is shorter; texts that the fast tokenizer refuses (white space of 10^6
characters and more) are encoded by the tokenizers library, which gives the same ids.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_sizes, slices, written

CAPACITY, ITEMS, ROUNDS, REOPENED, END = 2048, 16_384, 20, 6, 0


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The compiled tokenizer of a byte-level vocabulary: its .tiktoken rank file holds the same vocabulary as the .json."""
    import json

    import tiktoken

    from .bpe import PATTERN

    with open(path, encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}
    with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def text_ids(text: str | None, path: str) -> list[int]:
    """The ids of a text, without the end id."""
    try:
        return _tokenizer(path).encode(text or "", allowed_special="all")
    except ValueError:  # its pattern engine gives up on very long white space
        return _library(path).encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each document's ids followed by the end id."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i, j in slices(b.num_rows, byte_sizes(b[1]), 1024):
                index, rows = [], []
                for k, text in enumerate(b[1].slice(i, j - i).to_pylist()):
                    ids = text_ids(text, path)
                    ids.append(END)
                    raw = np.array(ids, "<u4").tobytes()
                    for n, (start, length) in enumerate(cut(len(ids), capacity)):
                        index.append(k)
                        rows.append((n, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.record_batch([b[0].slice(i, j - i).take(pa.array(index)), *columns], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length and the number of bins."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have left
    mask = bins = 0
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        if fitting := mask >> size:
            left = size + (fitting & -fitting).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                mask &= ~(1 << left)
        else:
            left, b = capacity, bins
            bins += 1
        where[i], offset[i] = b, capacity - left
        if left - size:
            room[left - size].append(b)
            mask |= 1 << (left - size)
    return where, offset, bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the best of the dual feasible functions' bounds."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """``lower_bound`` of the number of pieces of each length from 0 to the capacity."""
    size = np.arange(capacity + 1, dtype=np.int64)
    total, number = np.concatenate([[0], np.cumsum(count * size)]), np.concatenate([[0], np.cumsum(count)])
    low = np.arange(capacity // 2 + 1)  # threshold t: sizes over capacity - t count as full, those under t as nothing
    thresholds = (number[-1] - number[capacity - low + 1]) * capacity + total[capacity - low + 1] - total[low]
    best = int(-(-thresholds.max() // capacity))
    for k in range(1, 41):  # u(k): exact multiples of capacity / (k + 1) stay, others are rounded to floor of it, over k
        scaled = (k + 1) * size
        exact = scaled % capacity == 0
        value = np.where(exact, size * k, scaled // capacity * capacity)  # times k
        best = max(best, int(-(-int((count * value).sum()) // (capacity * k))))
    return best


def _pack_groups(dealt: DataFrame, capacity: int, tag: int) -> DataFrame:
    own = dealt.columns

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending")])
        lengths = group["length"].to_numpy()
        where, offset, bins = best_fit_decreasing(lengths, capacity)
        gap = bins - lower_bound(lengths, capacity)
        sequence = (tag << 56) + (group["part"][0].as_py() << 24) + where
        room = capacity - np.bincount(where, lengths, bins).astype(np.int64)
        return pa.table([*group.columns, pa.array(sequence), pa.array(offset), pa.array(np.full(len(where), gap)), pa.array(room[where])], [*own, "bin", "offset", "gap", "room"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in dealt.dtypes)
    return dealt.groupBy("part").applyInArrow(run, f"{kinds}, bin long, offset long, gap long, room long")


def _deal(rows: DataFrame, n: int, items: int, seed: int) -> DataFrame:
    return rows.drop("part", "bin", "offset", "gap", "room").withColumn("part", F.pmod(F.xxhash64("id", "piece", F.lit(seed)), F.lit(max(1, -(-n // items)))).cast("long"))


def global_bound(rows: DataFrame, capacity: int = CAPACITY) -> int:
    """The lower bound of all rows together, from the counts of their lengths (at most ``capacity`` of them)."""
    count = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():
        count[r["length"]] = r["count"]
    return bound_of_counts(count, capacity)


def pack(rows: DataFrame, capacity: int = CAPACITY, items: int = ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """rows (with id, piece and length, and any other columns but part, bin, offset, gap and room) with sequence_id, offset and
    lower_bound (no packing of all rows has fewer sequences)."""
    bound, n = global_bound(rows, capacity), rows.count()
    packed = written(_pack_groups(_deal(rows, n, items, 0), capacity, 0), "packed")
    final, settled = packed.limit(0), 0
    for seed in range(1, rounds + 1):
        open_ = (F.col("gap") > 0) | (F.col("room") > 0) | (F.pmod(F.xxhash64("bin", F.lit(seed)), F.lit(REOPENED)) == 0)
        first = F.col("offset") == 0  # bins are counted by their first pieces
        bins, every, loose, n, parts = packed.agg(F.count_if(first), F.count(F.lit(1)), F.count_if(open_ & first), F.count_if(open_), F.count_distinct("part")).first()
        if settled + bins <= bound or parts <= 1 or not n:
            break
        again = written(_pack_groups(_deal(packed.filter(open_), n, items, seed), capacity, seed), "repacked")
        after = again.agg(F.count_if(first)).first()[0]
        if after > loose:
            break
        final, settled, packed = final.unionByName(packed.filter(~open_)), settled + bins - loose, again
        if after == loose and n > 0.9 * every:
            break
    return final.unionByName(packed).withColumnRenamed("bin", "sequence_id").withColumn("lower_bound", F.lit(bound)).drop("part", "gap", "room")


def packed_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """All facts of every piece with its place."""
    return pack(written(pieces(docs, path, capacity), "pieces"), capacity)
