"""Removal of repeated passages: every byte under a string of ``span`` bytes that also starts in a smaller document.

Exact and distributed. The anchor of a string is the least hashed k-mer in it, so equal strings have equal anchors at equal
places and meet in one bucket. Documents are dealt to blocks of bounded size once; all passes read that one exchange.

0. Copies of a whole text lose it all and take no further part (a group by checksum).
1. Each block tells every bucket its anchors (31 bits each; one bit says that the block has it in two documents).
2. Buckets answer with a bit for each anchor: found in another document too. A wrong yes only costs time.
3. Blocks send the strings around those anchors, as merged fragments, to the buckets: each distinct fragment once, with the
   smallest document that has it. Where they occur stays with the block.
4. Buckets sort the suffixes of all fragments by deep-shallow sorting: multikey quicksort on words to ``SHALLOW`` bytes (a
   word a level, by one sort), then blind tries (words equal in a whole group are skipped, the first that differs branches;
   all groups of a level at once, nodes are not kept) order what still ties. Suffixes equal over ``span`` bytes form a
   class; its smallest document keeps its string. Blocks are told the runs of a fragment that have a smaller document.
5. Blocks take the spans that follow out of their documents.

A passage in a third of all rows costs its bucket one fragment a block, whatever its occurrences.

Defined cases: ids are integers; null is the empty text; texts under ``span`` bytes lose nothing; rows with a null id are compared with none
and lose nothing; rows of equal ids are one document to each other (neither is smaller); a removal may cut a character, whose
rest ``kept_text`` drops; an empty table gives an empty result; extra columns are ignored, except
those named in ``carry``, which each row gets back as they were.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN, KMER, BLOCK, BUCKET, CHUNK, SHALLOW = 50, 20, 4 << 20, 5 << 20, 1 << 20, 16


def _squeeze(*arrays: np.ndarray) -> bytes:
    raw = b"".join(a.tobytes() for a in arrays)
    return struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _unsqueeze(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], decompressed_size=struct.unpack_from("<Q", blob)[0], codec="zstd", asbytes=True)


def words_at(buffer: np.ndarray) -> np.ndarray:
    """The big-endian 8-byte word that starts at each byte (no copy)."""
    return np.ndarray((len(buffer) - 7,), ">u8", buffer.data, 0, (1,))


def _mixed(x: np.ndarray) -> np.ndarray:
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def anchors(data: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the anchor of the string at each byte of data, hash of the k-mer at each byte)."""
    words = words_at(data)
    n = len(data) - k + 1
    h = words[:n].astype(np.uint64)
    for start in [*range(8, k - 7, 8)] + [k - 8] * bool(k % 8):
        h = _mixed(h) + words[start : start + n]
    h = _mixed(h)
    bits = np.uint64((1 << 22) - 1)
    low = (h & ~bits) | np.arange(n, dtype=np.uint64)
    width, have = span - k + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    if have < width:
        rest = width - have
        low = np.minimum(low[: len(low) - rest], low[rest:])
    return (low & bits).astype(np.int64), h


def _ordered(table: pa.Table) -> list[tuple]:
    """(id, text, place in the table) of a block's rows, in an order that ids and texts determine; rows that tie are equal in both."""
    return sorted(zip(table["id"].to_pylist(), table["text"].to_pylist(), range(table.num_rows), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[1] is not None))


def _documents(table: pa.Table, copies: pa.Table) -> tuple[list, list[bytes], list[bool]]:
    """Ids, bytes and whether a smaller document has the same text, of a block's rows, in the order of ``_ordered``."""
    rows = _ordered(table)
    first = dict(zip(copies["copy_sum"].to_pylist(), copies["copy_id"].to_pylist(), strict=True))
    texts = [(r[1] or "").encode() for r in rows]
    if not first:
        return [r[0] for r in rows], texts, [False] * len(rows)
    return [r[0] for r in rows], texts, [i is not None and first.get(hashlib.md5(t).digest(), i) < i for (i, *_), t in zip(rows, texts, strict=True)]


def _scanned(ids: list, texts: list[bytes], copy: list[bool], span: int, k: int):
    """For chunks of the block: (data, first and last string of each run under one anchor, its document, hash, place in it,
    place of the anchor in it). Copies are left out: they lose all, and add no string that their original lacks."""
    parts, held = [], 0
    for d, (i, t, c) in enumerate(zip(ids, texts, copy, strict=True)):
        if i is None or c:
            continue
        for start in range(0, len(t) - span + 1, CHUNK):
            piece = t[start : start + CHUNK + span - 1]
            if held and held + len(piece) > CHUNK:
                yield from _scan(parts, span, k)
                parts, held = [], 0
            parts.append((d, start, piece))
            held += len(piece)
    if parts:
        yield from _scan(parts, span, k)


def _scan(parts, span: int, k: int):
    data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
    place, h = anchors(data, span, k)
    sizes = np.array([len(p) for _, _, p in parts])
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(parts)), sizes)[: len(place)]
    good = np.arange(len(place)) + span <= (begin + sizes)[owner]
    at = np.flatnonzero(good)
    where, owner = place[at], owner[at]
    new = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    doc, origin = np.array([d for d, _, _ in parts]), np.array([s for _, s, _ in parts])
    yield data, at[new], at[last], doc[owner[new]], h[where[new]], at[new] - begin[owner[new]] + origin[owner[new]], where[new] - at[new]


def _keys(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 31-bit name of each anchor in one number."""
    return ((h >> np.uint64(31)) % np.uint64(buckets)) << np.uint64(31) | (h & np.uint64(0x7FFFFFFF))


def _block_anchors(ids, scans, buckets) -> tuple[np.ndarray, np.ndarray]:
    """The block's distinct anchors in order, and whether each is in documents of two ids."""
    pairs = []
    numbers = {i: n for n, i in enumerate(sorted({i for i in ids if i is not None}))}
    number = np.array([numbers.get(i, 0) for i in ids], np.uint64)
    for _, _, _, doc, h, _, _ in scans:
        key = _keys(h, buckets)
        order = np.lexsort((number[doc], key))
        key, own = key[order], number[doc][order]
        keep = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])]) if len(key) else np.zeros(0, bool)
        pairs.append((key[keep], own[keep]))
    if not pairs:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    key, own = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.lexsort((own, key))
    key, own = key[order], own[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    last = np.concatenate([first[1:], [len(key)]]) - 1
    return key[first], own[first] != own[last]


def _by_bucket(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, first, end) of each run of keys in order."""
    bucket = key >> np.uint64(31)
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, int), np.zeros(0, int)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return bucket[first].astype(np.int64), first, np.concatenate([first[1:], [len(key)]]).astype(int)


def equal_classes(data: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """Numbers for the suffixes at starts, the same for suffixes equal over span bytes. Deep-shallow sorting."""
    words = words_at(data)
    offsets = [*range(0, span - 7, 8)] + ([span - 8] if span % 8 else [])
    label = np.zeros(len(starts), np.int64)
    active, group, fresh = np.arange(len(starts)), np.zeros(len(starts), np.int64), 1

    def branch(word: np.ndarray) -> None:
        """Splits the groups of the active suffixes by a word of each; lone ones are done."""
        nonlocal active, group, fresh
        order = np.lexsort((word, group))
        g, w = group[order], word[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (w[1:] != w[:-1])])
        number = np.cumsum(new) - 1
        alone = np.bincount(number)[number] == 1
        active = active[order]
        label[active[alone]] = fresh + number[alone]
        fresh += int(number[-1]) + 1
        active, group = active[~alone], number[~alone]

    shallow = [o for o in offsets if o < SHALLOW]
    for o in shallow:  # multikey quicksort, a word a level
        if len(active):
            branch(words[starts[active] + o].astype(np.uint64))
    deep = [o for o in offsets if o >= SHALLOW]
    while len(active):  # blind tries of all groups
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(group)]]))
        skip = np.full(len(first), len(deep))
        for n, o in reversed([*enumerate(deep)]):
            word = words[starts[active] + o]
            differs = np.logical_or.reduceat(word != np.repeat(word[first], sizes), first)
            skip[differs] = n
        leaf = np.repeat(skip == len(deep), sizes)
        label[active[leaf]] = fresh + np.repeat(np.arange(len(first)), sizes)[leaf]
        fresh += len(first)
        at = np.repeat(skip, sizes)[~leaf]
        active, group = active[~leaf], group[~leaf]
        if len(active):
            branch(words[starts[active] + np.array(deep)[at]].astype(np.uint64))
    return label


def _settle(rows: list[tuple[int, bytes]], span: int):
    """Of the fragments of a bucket, the runs of strings that documents smaller than a fragment's own hold too: (block, fragment's
    number in it, start and end in the fragment, the smallest such document) arrays."""
    least, number, length, block, bodies = [], [], [], [], []
    for b, blob in rows:
        raw = _unsqueeze(blob)
        n, first = struct.unpack_from("<II", raw)
        least.append(np.frombuffer(raw, np.int64, n, 8))
        number.append(first + np.arange(n, dtype=np.int64))
        length.append(np.frombuffer(raw, np.uint8, n, 8 + 8 * n))
        block.append(np.full(n, b))
        bodies.append(raw[8 + 9 * n :])
    least, number, length, block = (np.concatenate(x) for x in (least, number, length, block))
    # equal fragments of several blocks are one, of the smallest document
    kinds, piece = _distinct(b"".join(bodies), length.astype(np.int64))
    lowest = np.full(len(kinds), np.iinfo(np.int64).max)
    np.minimum.at(lowest, piece, least)
    size = np.array([len(x) for x in kinds])
    data = np.frombuffer(b"".join(kinds), np.uint8)
    strings, begin = size - span + 1, np.cumsum(size) - size
    of = np.repeat(np.arange(len(kinds)), strings)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(strings) - strings, strings)
    label = equal_classes(data, begin[of] + inner, span)
    holder = np.full(int(label.max()) + 1 if len(label) else 0, np.iinfo(np.int64).max)
    np.minimum.at(holder, label, lowest[of])  # the smallest document of each class
    found = holder[label]
    # runs of neighbouring strings of a fragment with the same holder
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (found[1:] != found[:-1])]) if len(of) else np.zeros(0, bool)
    edge = np.flatnonzero(new)
    stop = np.concatenate([edge[1:], [len(of)]]) - 1 if len(edge) else edge
    run_of, run_from, run_to, run_id = of[edge], inner[edge], inner[stop] + span, found[edge]
    runs = np.bincount(run_of, minlength=len(kinds))
    many = runs[piece]
    pick = np.repeat((np.cumsum(runs) - runs)[piece], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    who = np.repeat(np.arange(len(piece)), many)
    told = run_id[pick] < least[who]
    who, pick = who[told], pick[told]
    return block[who], number[who], run_from[pick], run_to[pick], run_id[pick]


def _distinct(body: bytes, length: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct fragments of a body, and which of them each is."""
    seen: dict[bytes, int] = {}
    ends = np.cumsum(length).tolist()
    piece = np.fromiter((seen.setdefault(body[e - n : e], len(seen)) for e, n in zip(ends, length.tolist(), strict=True)), np.int64, len(ends))
    return [*seen], piece


def _block_fragments(scans, key: np.ndarray, shared: np.ndarray, own: np.ndarray, buckets: int, span: int):
    """The distinct fragments around a block's shared anchors in order of their buckets, as (bucket, smallest document, length, body)
    arrays and one body, and their occurrences, as (fragment, document's number, start) arrays."""
    found, bodies = [], []
    for data, low, high, doc, h, start, _ in scans:
        k = _keys(h, buckets)
        hit = np.flatnonzero(shared[np.searchsorted(key, k)])
        length = high[hit] + span - low[hit]
        index = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(low[hit], length)
        bodies.append(data[index].tobytes())
        found.append(((k[hit] >> np.uint64(31)).astype(np.int64), doc[hit].astype(np.int64), start[hit].astype(np.int64), length))
    if not found:
        return None
    bucket, doc, start, length = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(bucket):
        return None
    kinds, piece = _distinct(b"".join(bodies), length)
    least, place = np.full(len(kinds), np.iinfo(np.int64).max), np.zeros(len(kinds), np.int64)
    np.minimum.at(least, piece, own[doc])
    place[piece] = bucket
    order = np.argsort(place, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return place[order], least[order], [kinds[i] for i in order.tolist()], (rank[piece], doc, start)


def _taken(ids: list, answers: list[bytes], own: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document's number, start, end) of what a block's documents lose, from its fragments' occurrences and the buckets' runs."""
    if not own:
        return tuple(np.zeros((3, 0), np.int64))
    raw = _unsqueeze(own[0])
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    least, rest = np.frombuffer(raw, np.int64, n, 16), np.frombuffer(raw, np.int32, n + 3 * m, 16 + 8 * n).astype(np.int64)
    size, (piece, doc, start) = rest[:n], rest[n:].reshape(3, m)
    mine = np.array([0 if i is None else i for i in ids], np.int64)[doc]
    later = mine > least[piece]  # a smaller document of the block has the fragment
    out = [(doc[later], start[later], start[later] + size[piece[later]])]
    if answers:
        number, low, high, holder = np.concatenate([np.frombuffer(_unsqueeze(x), np.int64).reshape(4, -1) for x in answers], 1)
        order = np.argsort(number, kind="stable")
        number, low, high, holder = number[order], low[order], high[order], holder[order]
        first, last = (np.searchsorted(number, piece, side) for side in ("left", "right"))
        some = np.flatnonzero(~later & (last > first))
        many = (last - first)[some]
        pick = np.repeat(first[some], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        who = np.repeat(some, many)
        lost = holder[pick] < mine[who]
        who, pick = who[lost], pick[lost]
        out.append((doc[who], start[who] + low[pick], start[who] + high[pick]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def repeated_passages(docs: DataFrame, span: int = SPAN, kmer: int = KMER, text_out: bool = False, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each row; text_out: also kept_text; then the row's columns named in carry."""
    if not 8 <= kmer <= span <= 128 or span < 16:
        raise ValueError("span must be 16 to 128 bytes and kmer 8 to span")
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    # a passage that every block has costs its bucket some 100 bytes a block: blocks and buckets grow with the root of the input
    most = int((100 * total) ** 0.5)
    blocks, buckets = max(1, -(-total // max(BLOCK, most))), max(1, -(-total // max(BUCKET, most)))
    held = [f"carry_{k}" for k in range(len(carry))]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(h) for c, h in zip(carry, held, strict=True)]).withColumn("block", F.pmod(F.xxhash64(F.coalesce(F.col("id"), F.xxhash64("text"))), F.lit(blocks)).cast("long"))
    dealt = rows.groupBy("block")
    summed = rows.filter((F.octet_length("text") >= span) & F.col("id").isNotNull()).select("id", "block", F.unhex(F.md5("text")).alias("sum"))
    # a row a block and text: however many copies there are, a text costs one row a block from here on
    per_block = summed.groupBy("sum", "block").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    first = per_block.groupBy("sum").agg(F.min("least").alias("copy_id"), F.max("most").alias("last")).filter("last > copy_id").drop("last")
    copies = per_block.join(first, "sum").filter("most > copy_id").select(F.col("block").alias("copy_block"), "copy_id", F.col("sum").alias("copy_sum"))

    def tell(group: pa.Table, known: pa.Table) -> pa.Table:
        ids, texts, copy = _documents(group, known)
        key, twice = _block_anchors(ids, _scanned(ids, texts, copy, span, kmer), buckets)
        name = (key & np.uint64(0x7FFFFFFF)).astype(np.uint32) << np.uint32(1) | twice.astype(np.uint32)
        bucket, first, end = _by_bucket(key)
        blobs = [name[i:j].tobytes() for i, j in zip(first, end, strict=True)]
        return pa.table([pa.array(bucket), pa.array(np.full(len(bucket), group["block"][0].as_py() if len(group) else 0, np.int64)), pa.array(blobs, pa.binary())], ["bucket", "block", "blob"])

    def answer(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b.as_py(), np.uint32) for b in group["blob"]]
        names = np.concatenate(parts)
        distinct, at, count = np.unique(names >> np.uint32(1), return_inverse=True, return_counts=True)
        shared = count > 1
        np.logical_or.at(shared, at, (names & np.uint32(1)).astype(bool))
        bits = np.split(shared[at], np.cumsum([len(p) for p in parts])[:-1])
        return pa.table([group["block"], group["bucket"], pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())], ["block", "bucket", "bits"])

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        known, right = told_copies(right)
        ids, texts, copy = _documents(left, known)
        scans = [*_scanned(ids, texts, copy, span, kmer)]
        key, _ = _block_anchors(ids, scans, buckets)
        bits = dict(zip(right["bucket"].to_pylist(), right["bits"].to_pylist(), strict=True))
        shared = np.zeros(len(key), bool)
        for b, i, j in zip(*_by_bucket(key), strict=True):
            shared[i:j] = np.unpackbits(np.frombuffer(bits[int(b)], np.uint8), count=j - i).astype(bool)
        own = np.array([0 if i is None else i for i in ids], np.int64)
        block, out = left["block"][0].as_py() if len(left) else 0, []
        if held_ := _block_fragments(scans, key, shared, own, buckets, span):
            bucket, least, kinds, (piece, doc, start) = held_
            size = np.array([len(x) for x in kinds], np.uint8)
            edges = [*np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist(), len(bucket)]
            for i, j in zip(edges, edges[1:]):
                out.append((int(bucket[i]), _squeeze(np.array([j - i, i], np.uint32), least[i:j], size[i:j], np.frombuffer(b"".join(kinds[i:j]), np.uint8))))
            # what the block itself needs in the end; a bucket hands it through
            out.append((block % buckets, _squeeze(np.array([len(kinds), len(piece)], np.int64), least, *[x.astype(np.int32) for x in (size, piece, doc, start)])))
        own_ = [n == len(out) - 1 for n in range(len(out))]
        return pa.table([pa.array([b for b, _ in out], pa.int64()), pa.array(np.full(len(out), block, np.int64)), pa.array(own_, pa.bool_()), pa.array([x for _, x in out], pa.binary())], ["bucket", "block", "own", "blob"])

    def settle(group: pa.Table) -> pa.Table:
        through, group = group.filter(group["own"]), group.filter(pc.invert(group["own"]))
        kept = [through["block"].to_pylist(), [None] * through.num_rows, through["blob"].to_pylist()]
        if not group.num_rows:
            return pa.table([pa.array(x, k) for x, k in zip(kept, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "spans", "own"])
        block, number, start, end, holder = _settle([(b.as_py(), x.as_py()) for b, x in zip(group["block"], group["blob"], strict=True)], span)
        order = np.argsort(block, kind="stable")
        out = []
        edges = np.flatnonzero(np.concatenate([[True], block[order][1:] != block[order][:-1]])) if len(order) else []
        for part in np.split(order, edges[1:]) if len(order) else []:
            out.append((int(block[part[0]]), _squeeze(*[x[part].astype(np.int64) for x in (number, start, end, holder)])))
        columns = [[b for b, _ in out] + kept[0], [x for _, x in out] + kept[1], [None] * len(out) + kept[2]]
        return pa.table([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "spans", "own"])

    def take_out(left: pa.Table, right: pa.Table) -> pa.Table:
        known, right = told_copies(right)
        ids, texts, copy = _documents(left, known)
        rows_of = _ordered(left)
        number, start, end = _taken(ids, [x.as_py() for x in right["spans"] if x.is_valid], [x.as_py() for x in right["own"] if x.is_valid])
        order = np.argsort(number, kind="stable")
        number, start, end = number[order], start[order], end[order]
        cuts = np.searchsorted(number, np.arange(len(ids) + 1))
        out = []
        for d, (i, t) in enumerate(zip(ids, texts, strict=True)):
            n = len(t)
            gone = runs = 0
            kept = t
            if copy[d]:
                gone, runs, kept = n, 1, b""
            elif cuts[d] < cuts[d + 1]:
                depth = np.zeros(n + 1, np.int32)
                np.add.at(depth, start[cuts[d] : cuts[d + 1]], 1)
                np.add.at(depth, end[cuts[d] : cuts[d + 1]], -1)
                lost = np.cumsum(depth)[:-1] > 0
                gone, runs = int(lost.sum()), int((lost & ~np.concatenate([[False], lost[:-1]])).sum())
                kept = np.frombuffer(t, np.uint8)[~lost].tobytes()
            row = (i, n, gone, runs, hashlib.sha256(kept).hexdigest())
            out.append((*row, t.decode() if gone == 0 else kept.decode("utf-8", "ignore")) if text_out else row)
        columns = [*zip(*out, strict=True)] or [[]] * (5 + text_out)
        kinds = [pa.int64()] * 4 + [pa.string()] * (1 + text_out)
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: 5 + text_out]
        places = pa.array([place for _, _, place in rows_of], pa.int64())
        return pa.table([*[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], *[left[h].take(places) for h in held]], names + held)

    def told_copies(table: pa.Table) -> tuple[pa.Table, pa.Table]:
        """Rows that name copies, and the others."""
        named = pc.is_valid(table["copy_sum"])
        return table.filter(named), table.filter(pc.invert(named))

    def with_copies(other: DataFrame, columns: str) -> DataFrame:
        """other and the copies of each block in one table, for a cogroup."""
        kinds = dict(c.split(" ") for c in columns.split(", "))
        blank = copies.select("copy_block", "copy_id", "copy_sum", *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
        return other.select(F.col("block").alias("copy_block"), F.lit(None).cast("long").alias("copy_id"), F.lit(None).cast("binary").alias("copy_sum"), *kinds).unionByName(blank)

    told = dealt.cogroup(copies.groupBy("copy_block")).applyInArrow(tell, "bucket long, block long, blob binary")
    answers = with_copies(told.groupBy("bucket").applyInArrow(answer, "block long, bucket long, bits binary"), "bucket long, bits binary")
    sent = dealt.cogroup(answers.groupBy("copy_block")).applyInArrow(send, "bucket long, block long, own boolean, blob binary")
    spans = with_copies(sent.groupBy("bucket").applyInArrow(settle, "block long, spans binary, own binary"), "spans binary, own binary")
    kinds_out = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * text_out
    kinds_out += "".join(f", {h} {docs.schema[c].dataType.simpleString()}" for c, h in zip(carry, held, strict=True))
    return dealt.cogroup(spans.groupBy("copy_block")).applyInArrow(take_out, kinds_out).withColumnsRenamed(dict(zip(held, carry, strict=True)))
