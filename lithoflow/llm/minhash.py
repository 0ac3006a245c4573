"""Near-duplicate detection: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

Sets are the distinct word shingles of a whole text, as 64-bit hashes. SuperMinHash gives element e the values r + j at
slots p(j) of a random permutation p; a slot keeps its least value. Slots that got a value below j + 1 can't change at
later j, so the ranks are visited level by level for all elements at once and end early when every slot is settled.

Copies (equal word sequences) are one class; only the smallest document of a class is compared. Members of a bucket are
compared with the bucket's pivot, its best connected member; those that this leaves outside the pivot's component are
compared with the others of the bucket, so no link of a bucket is lost. A bucket of linked documents costs its size, not its
square; pairs are formed only inside blocks of bounded size, and only links leave them. Links are confirmed on the full sets and joined to components by
partition-wise union-find and star contraction. Nothing is collected but counts.

Band settings: 40 bands of 6 rows find a pair of similarity 0.8 with probability 1 - (1 - 0.8^6)^40 > 0.99999.

Defined cases: ids are integers (others are an error of the cast); an empty table gives an empty result; null, empty and blank texts have the empty set and link with nothing; texts of fewer words than a shingle
are one shingle of all their words; rows with a null id stay single; rows that repeat an id are one document with the
union of links; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words, written

BANDS, ROWS = 40, 6
SLICE = 1 << 16
PAIRS, SIDE, COLUMNS = 4096, 1024, 4096
CENTRES, SALTS = 256, 64


def shingle_hashes(text: Column, size: int) -> Column:
    """Distinct 64-bit hashes of the word shingles; with fewer words, of the whole sequence."""
    return let(words(text), lambda w: shingles_of(w, size))


def shingles_of(w: Column, size: int) -> Column:
    n = F.size(w)
    whole = F.array(F.xxhash64(F.array_join(w, " ")))
    many = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n < size, whole).otherwise(F.array_distinct(many))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(elements: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """SuperMinHash of n sets: elements[i] belongs to set owner[i] (ascending). n x m values, inf for an empty set."""
    out = np.full(n * m, np.inf)
    state, live, swaps = elements.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15), owner, None
    for j in range(m):
        state = state + np.uint64(0x9E3779B97F4A7C15)
        bits = _mix(state)
        value = j + (bits >> np.uint64(40)) * 2.0**-24
        pick = j + ((bits & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            slot = pick
        else:
            rows = np.arange(len(pick))
            slot, held = swaps[rows, pick].astype(np.int64), swaps[:, j].copy()
            swaps[rows, pick] = held
        key = live * m + slot
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        at = key[first]
        if len(first):
            out[at] = np.minimum(out[at], np.minimum.reduceat(value[order], first))
        open_ = out.reshape(n, m).max(1) >= j + 1
        stay = open_[live]
        if not stay.any():
            break
        if j == 0:
            live, state, slot = live[stay], state[stay], slot[stay]
            swaps = np.tile(np.arange(m, dtype=np.int16), (len(live), 1))
            swaps[np.arange(len(live)), slot] = 0
        elif not stay.all():
            live, state, swaps = live[stay], state[stay], swaps[stay]
    return out.reshape(n, m)


def _bands(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    sizes = np.array([len(s) for s in sets])
    signed = signatures(np.concatenate(sets) if len(sets) else np.zeros(0, np.int64), np.repeat(np.arange(len(sets)), sizes), len(sets), bands * rows)
    parts = np.ascontiguousarray(signed).view(np.uint64).reshape(len(sets), bands, rows)
    key = np.full((len(sets), bands), np.uint64(0x1234567)) + np.arange(bands, dtype=np.uint64)[None, :]
    for r in range(rows):
        key = _mix(key * np.uint64(31) + parts[:, :, r])
    return key.view(np.int64)


def banded(docs: DataFrame, shingle: int, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, copy, n_shingles, bands): copy is a hash of the word sequence, bands the hashed bands (null for the empty set)."""
    facts = let(words(F.col(text_col)), lambda w: F.struct(F.unhex(F.md5(F.array_join(w, " "))).alias("copy"), shingles_of(w, shingle).alias("sh")))
    base = docs.select(F.col(id_col).alias("id"), facts.alias("x")).select("id", "x.copy", "x.sh")

    def run(batches):
        for b in batches:
            column = b["sh"]
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
                j = min(j, b.num_rows, i + 512)
                sets = [values[offsets[k] : offsets[k + 1]] for k in range(i, j)]
                keys = _bands(sets, bands, rows)
                yield pa.record_batch(
                    [b["id"].slice(i, j - i), b["copy"].slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array([k if len(s) else None for k, s in zip(keys, sets, strict=True)], pa.list_(pa.int64()))],
                    ["id", "copy", "n_shingles", "bands"],
                )
                i = j

    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(run, f"id {kind}, copy binary, n_shingles long, bands array<long>")


def _unite(pairs: DataFrame) -> DataFrame:
    """Partition-wise union-find: (a, b) links to a spanning forest of (node, root), root the smallest."""

    def run(batches):
        parent: dict = {}

        def root(x):
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        for batch in batches:
            for a, b in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        rows = [(x, root(x)) for x in parent]
        rows = [(x, r) for x, r in rows if x != r]
        for i in range(0, len(rows), 20_000):
            part = rows[i : i + 20_000]
            yield pa.record_batch([pa.array([x for x, _ in part], kind), pa.array([r for _, r in part], kind)], ["a", "b"])

    kind = pa.int64()
    return pairs.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id of the links (a, b), root the smallest id reachable.

    Large-star and small-star contraction over the forest that union-find leaves of each partition; the edges of a star that
    holds much of all edges are salted.
    """
    edges = written(_unite(links.filter("a <> b")), "forest")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        # centres of over 1 / CENTRES of all edge ends, so at most CENTRES of them: their edges are spread over SALTS tasks
        ends = least.agg(F.sum("n")).first()[0] or 0
        hot = [r["a"] for r in least.filter(F.col("n") > max(SALTS, ends / CENTRES)).select("a").collect()]
        spread = F.col("a").isin(hot) if hot else F.lit(False)
        salts = F.when(spread, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        least = least.select("a", F.least("a", "m").alias("m"), F.explode(salts).alias("salt"))
        outer = both.filter("b > a").withColumn("salt", F.when(spread, F.pmod(F.xxhash64("b"), F.lit(SALTS))).otherwise(0).cast("int"))
        large = outer.join(least, ["a", "salt"]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        after = written(small, "stars")
        # a forest of stars: every id has one edge, and no root has one
        count, ids, inner = (
            after.select(F.col("a"), F.lit(1).alias("e"), F.lit(0).alias("r"))
            .union(after.select("b", F.lit(0), F.lit(1)))
            .groupBy("a").agg(F.sum("e").alias("e"), F.max("r").alias("r"))
            .agg(F.sum("e"), F.sum((F.col("e") > 0).cast("int")), F.sum(((F.col("e") > 0) & (F.col("r") > 0)).cast("int"))).first()
        )
        edges = after
        if not count or count == ids and not inner:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b, linked) of pairs (a, b) of texts (id, text): linked if 100 * |A & B| >= percent * |A | B| on full sets."""
    two = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    sets = two.select("a", "b", shingle_hashes(F.col("ta"), shingle).alias("sa"), shingle_hashes(F.col("tb"), shingle).alias("sb"))
    counted = sets.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("n"))
    return counted.select("a", "b", (100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).alias("linked"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component): component is the smallest id reachable by links, the document's own if none."""
    signed = written(banded(docs, shingle, bands, rows, id_col, text_col), "bands")
    classes = signed.filter("n_shingles > 0 AND id IS NOT NULL").groupBy("copy").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    member = signed.filter("n_shingles > 0 AND id IS NOT NULL").select("id", "copy").join(classes.filter("n > 1"), "copy").filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"), "copy")
    copies = written(member, "copies")
    single = signed.join(copies.select(F.col("a").alias("id"), "copy"), ["id", "copy"], "left_anti").filter("bands IS NOT NULL AND id IS NOT NULL").select("id", F.explode("bands").alias("bucket"))
    sizes = single.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowded = written(single.join(sizes, "bucket"), "buckets")
    weight = crowded.groupBy("id").agg(F.sum("n").alias("weight"))
    ranked = crowded.join(weight, "id")
    pivot = ranked.groupBy("bucket").agg(F.max(F.struct(F.col("weight"), (-F.col("id")).alias("minus"))).alias("best")).select("bucket", (-F.col("best.minus")).alias("pivot"))
    pairs = crowded.join(pivot, "bucket").filter("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    # the texts of the documents in question move once, by a shuffle at every size
    ids = crowded.select("id").distinct().hint("merge")
    texts = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left_semi"), "texts")
    found = written(confirmed(pairs, texts, shingle, percent), "pairs")
    groups = written(components(copies.select("a", "b").union(found.filter("linked").select("a", "b"))), "groups")
    more = written(cross_links(found, groups, texts, shingle, percent), "links")
    if more.limit(1).count():
        groups = written(components(groups.select(F.col("id").alias("a"), F.col("root").alias("b")).filter("a <> b").union(more)), "groups")
    return signed.select("id", "n_shingles").join(groups, "id", "left").select("id", "n_shingles", F.coalesce("root", "id").alias("component"))


def cross_links(found: DataFrame, groups: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between different components among the documents that were compared with one pivot.

    Two documents of a bucket were both compared with its pivot. If they are in different components, one of them, an outer
    one, is not in the pivot's. So each pivot's outer documents are compared with its documents of other components: one by
    one where that is at most ``PAIRS``, in blocks of at most ``SIDE`` by ``SIDE`` otherwise. There, sets are told as their
    difference from the pivot's set, and |A & B| = |A & P| + |B & P| - |P| + |(A ^ P) & (B ^ P)| is exact; only links leave
    a block.
    """
    root = groups.select(F.col("id").alias("a"), F.col("root").alias("ra"))
    of = found.select("a", F.col("b").alias("p")).join(root, "a", "left").join(root.select(F.col("a").alias("p"), F.col("ra").alias("rp")), "p", "left")
    of = written(of.select("p", "a", F.coalesce("ra", "a").alias("ra"), F.coalesce("rp", "p").alias("rp")), "compared")
    size = of.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ra") != F.col("rp")).alias("outer")).filter("outer > 0 AND n > 1")
    few, many = size.filter(F.col("n") * F.col("outer") <= PAIRS).select("p"), size.filter(F.col("n") * F.col("outer") > PAIRS)
    outer = of.filter("ra <> rp")
    pairs = outer.join(few, "p").select("p", F.col("a").alias("x"), F.col("ra").alias("rx")).join(of.select("p", F.col("a").alias("y"), F.col("ra").alias("ry"), "rp"), "p")
    pairs = pairs.filter((F.col("rx") != F.col("ry")) & ((F.col("ry") == F.col("rp")) | (F.col("x") < F.col("y")))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    links = confirmed(written(pairs, "cross"), texts, shingle, percent).filter("linked").select("a", "b")
    held = of.join(many.select("p", (F.col("n") / SIDE).cast("int").alias("mb"), (F.col("outer") / SIDE).cast("int").alias("ob")), "p")
    # any one text of the pivot serves, if all are told by the same
    pivots = texts.join(many.select(F.col("p").alias("id")), "id", "left_semi").groupBy(F.col("id").alias("p")).agg(F.min("text").alias("pt"))
    told = held.join(texts.select(F.col("id").alias("a"), "text"), "a").join(pivots, "p")
    told = told.select("p", "a", "ra", "rp", "mb", "ob", shingle_hashes(F.col("text"), shingle).alias("s"), shingle_hashes(F.col("pt"), shingle).alias("t"))
    apart = F.concat(F.array_except("s", "t"), F.transform(F.array_except("t", "s"), lambda e: F.bitwise_not(e)))
    told = written(told.select("p", "a", "ra", "rp", "mb", "ob", F.size("s").alias("n"), F.size(F.array_intersect("s", "t")).alias("i"), F.size("t").alias("c"), apart.alias("d")), "differences")
    cell = lambda n, seed: F.pmod(F.xxhash64("a", F.lit(seed)), F.col(n) + 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n)).cast("array<bigint>"))
    left = told.filter("ra <> rp").select("p", cell("ob", 1).alias("u"), every("mb").alias("v"), "a", "ra", "n", "i", "c", "d")
    right = told.select("p", every("ob").alias("u"), cell("mb", 2).alias("v"), "a", "ra", "n", "i", "c", "d")

    def within(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], pa.int64())] * 2, ["a", "b"])
        if not left.num_rows or not right.num_rows:
            return none
        (dl, ol), (dr, or_) = ((c.values.to_numpy(), np.repeat(np.arange(len(c)), np.diff(c.offsets.to_numpy()))) for c in (t["d"].combine_chunks() for t in (left, right)))
        shared = np.intersect1d(dl, dr)
        both = np.zeros((left.num_rows, right.num_rows), np.float32)
        for k in range(0, len(shared), COLUMNS):
            part = shared[k : k + COLUMNS]
            m = []
            for d, owner, rows in ((dl, ol, left.num_rows), (dr, or_, right.num_rows)):
                at = np.minimum(np.searchsorted(part, d), len(part) - 1)
                hit = part[at] == d
                x = np.zeros((rows, len(part)), np.float32)
                x[owner[hit], at[hit]] = 1
                m.append(x)
            both += m[0] @ m[1].T
        get = lambda t, c: t[c].to_numpy().astype(np.int64)
        overlap = both.astype(np.int64) + get(left, "i")[:, None] + get(right, "i")[None, :] - get(left, "c")[:1, None]
        total = get(left, "n")[:, None] + get(right, "n")[None, :] - overlap
        x, y = np.nonzero((100 * overlap >= percent * total) & (get(left, "ra")[:, None] != get(right, "ra")[None, :]))
        # a spanning forest of the links is enough
        tops, out = {}, []
        la, ra = get(left, "a"), get(right, "a")

        def top(v):
            while (up := tops.setdefault(v, v)) != v:
                tops[v] = v = tops[up]
            return v

        for u, v in zip(la[x].tolist(), ra[y].tolist(), strict=True):
            if (tu := top(u)) != (tv := top(v)):
                tops[max(tu, tv)] = min(tu, tv)
                out.append((u, v))
        return pa.table([pa.array([u for u, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())], ["a", "b"]) if out else none

    met = left.groupBy("p", "u", "v").cogroup(right.groupBy("p", "u", "v")).applyInArrow(within, "a long, b long")
    return links.select(F.col("a").cast("long"), F.col("b").cast("long")).union(met)
