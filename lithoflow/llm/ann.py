"""Nearest neighbours by largest inner product: inverted lists with an adaptive dimension scan.

Equal vectors are indexed once with their smallest ids. The index (a random rotation, two levels of k-means centroids, the
spread within each list, the largest norm) is fitted on a bounded sample (``sample`` distinct vectors of lowest hash); every
vector is indexed. Inner product is turned into distance by one added component, then vectors are rotated.

* Lists: a shard is a coarse centroid's vectors, a list those of one of its fine centroids. The number of shards, and with it
  of lists, grows with the rows (``BLOCK`` rows a shard) as far as the sample supports it; a shard of more rows is cut into
  blocks by a hash, so a list that holds a third of all rows is spread.
* Bound: a query first scans one block of its nearest shard. The distance of its k-th row there is sent along to all other
  lists and only shrinks while they are scanned.
* Probes: a list's scores are taken as normal around its centroid's score, which tells how many of the k nearest a list
  should hold. The lists that should hold the most are probed, until those left should hold ``miss`` of the k. Vectors in
  clusters need few lists; vectors without structure need many.
* Scan: rotated vectors are compared in blocks of ``COLUMNS`` columns. The share of a distance that lies in the first d of D
  rotated columns has a Beta(d/2, (D - d)/2) distribution, so after each block a candidate is abandoned if its partial
  distance is above the 1 - ``alpha`` quantile of what a row within the bound would show. Columns are computed for all pairs
  of a list until few are left, and for these one by one from then on. Survivors are scored in double precision on the
  original vectors.

``probe=1, alpha=0`` is the exact way: every list is scanned and no candidate is abandoned before it is above the bound.

Defined cases: ids are integers; vectors that are null, empty, zero, of another length than most, or hold a null or
non-finite component take no part, neither as query nor as candidate; queries with fewer candidates than k return them all;
ties go to the smaller id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SAMPLE, BLOCK, LISTS, COLUMNS, ALPHA, MISS = 40_000, 4096, 32, 8, 0.03, 0.04
#: Pairs are computed one by one once fewer than this share of a list's pairs is left.
SPARSE = 0.4
HITS = "rep long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & v.isNotNull())
    rows = rows.filter(finite & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (sizes["n"] if sizes else 0))


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """(key, v, ids): the ``most`` smallest ids of each vector; the cut is made before the shuffle."""
    ranked = rows.withColumn("key", F.xxhash64("v")).withColumn("n", F.row_number().over(Window.partitionBy("key", "v").orderBy("id"))).filter(F.col("n") <= most)
    return ranked.groupBy("key", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def above(x: np.ndarray) -> np.ndarray:
    """P(Z > x) of a standard normal variable, to 1e-7 (the rational approximation of Hastings)."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x >= 0, tail, 1 - tail)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = [np.argmin((centres**2).sum(1)[None, :] - 2 * x[i : i + 1024] @ centres.T, axis=1) for i in range(0, len(x), 1024)]
    return np.concatenate(out) if out else np.zeros(0, int)


def k_means(x: np.ndarray, n: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)
        order = np.argsort(near, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], near[order][1:] != near[order][:-1]]))
        total = np.add.reduceat(x[order], first)
        held = near[order][first]
        centres = centres.copy()
        centres[held] = total / np.diff(np.concatenate([first, [len(x)]]))[:, None]
    return centres


class Index:
    """Rotation, centroids, spreads and the norm bound; its size depends on the sample, not on the number of rows."""

    def __init__(self, rows: np.ndarray, top_norm: float, shards: int, per_shard: int = LISTS, alpha: float = ALPHA, columns: int = COLUMNS, seed: int = 0):
        self.top, self.dim = top_norm, rows.shape[1] + 1
        rng = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0]
        x = self.stored(rows)
        self.coarse = k_means(x, shards, rng)
        cell = nearest(x, self.coarse)
        fine = [k_means(x[cell == c] if (cell == c).any() else self.coarse[c : c + 1], per_shard, rng) for c in range(len(self.coarse))]
        self.first = np.cumsum([0, *map(len, fine)])
        self.fine = np.concatenate(fine)
        self.shard_of = np.repeat(np.arange(len(fine)), np.diff(self.first))
        at = self.lists_of(x)
        square = np.bincount(at, ((x - self.fine[at]) ** 2).mean(1), len(self.fine)) / np.maximum(1, np.bincount(at, minlength=len(self.fine)))
        self.spread = np.sqrt(np.maximum(square, ((x - self.fine[at]) ** 2).mean() * 0.25)) + 1e-300
        edges = [*range(0, self.dim, columns), self.dim]
        self.cuts = [*zip(edges, edges[1:])]
        draws = 200_000
        self.limits = [1.0 if hi == self.dim or not alpha else float(np.quantile(rng.beta(hi / 2, (self.dim - hi) / 2, draws), 1 - alpha)) for _, hi in self.cuts]

    def stored(self, v: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.top**2 - (v**2).sum(1)))
        return np.concatenate([v, rest[:, None]], 1) @ self.rotation

    def asked(self, v: np.ndarray) -> np.ndarray:
        """Queries are scaled to the norm bound, which changes no order, so that distances are on the scale of the rows."""
        v = v * (self.top / np.maximum(np.linalg.norm(v, axis=1), 1e-300))[:, None]
        return np.concatenate([v, np.zeros((len(v), 1))], 1) @ self.rotation

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        """The list of each stored vector: the nearest fine centroid of its nearest coarse one."""
        cell, out = nearest(x, self.coarse), np.zeros(len(x), int)
        for c in np.unique(cell):
            mine = cell == c
            out[mine] = self.first[c] + nearest(x[mine], self.fine[self.first[c] : self.first[c + 1]])
        return out

    def home(self, v: np.ndarray) -> np.ndarray:
        return nearest(self.asked(v), self.coarse)

    def probes(self, v: np.ndarray, sizes: np.ndarray, k: int, miss: float, least: float = 0.0) -> np.ndarray:
        """(queries x lists) which lists to scan: all but those that should hold ``miss`` of the k nearest together; a share
        ``least`` of the lists in any case."""
        if least >= 1:
            return np.broadcast_to(sizes > 0, (len(v), len(sizes)))
        mean = self.asked(v) @ self.fine.T
        scale = (self.spread * self.top)[None, :]
        low, high = np.full(len(v), -(self.top**2)), np.full(len(v), self.top**2)
        expected = np.broadcast_to(sizes.astype(float), mean.shape)
        for _ in range(24):  # the score that k rows should be above
            middle = (low + high) / 2
            expected = sizes[None, :] * above((middle[:, None] - mean) / scale)
            many = expected.sum(1) > k
            low, high = np.where(many, middle, low), np.where(many, high, middle)
        order = np.argsort(-expected, axis=1, kind="stable")
        held = np.take_along_axis(expected, order, 1)
        before = np.cumsum(held, axis=1) - held
        asked = np.zeros(mean.shape, bool)
        needed = before < (1 - miss) * held.sum(1)[:, None]
        np.put_along_axis(asked, order, needed | (np.arange(len(sizes)) < least * len(sizes))[None, :], 1)
        return asked & (sizes > 0)[None, :]

    def scan(self, queries: np.ndarray, rows: np.ndarray, lists: np.ndarray, wanted: np.ndarray, bound: np.ndarray, k: int, chunk: int = 512):
        """(places in rows, squared distances), each queries x k, of the k nearest rows of the wanted lists within the bound (place
        -1: none), and the number of cells (column of a pair) that were computed and that there are."""
        q, x = self.asked(queries), self.stored(rows)
        order = np.argsort(lists, kind="stable")
        x, lists = x[order], lists[order]
        q2, x2 = (np.stack([(m[:, a:b] ** 2).sum(1) for a, b in self.cuts]) for m in (q, x))
        best, at = np.repeat(bound[:, None], k, 1), np.full((len(q), k), -1)
        edge = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1], [True]])) if len(lists) else np.zeros(1, int)
        done = every = 0
        for a, b in zip(edge, edge[1:]):
            mine = np.flatnonzero(wanted[:, lists[a]])
            for s in range(0, len(mine), chunk):
                c = mine[s : s + chunk]
                limit = best[c, -1] * (1 + 1e-9) + 1e-12 * self.top**2
                every += len(c) * (b - a) * self.dim
                dist, i = np.zeros((len(c), b - a)), None
                for t, (lo, hi) in enumerate(self.cuts):
                    if i is None:
                        dist += q2[t, c][:, None] + x2[t, a:b][None, :] - 2 * q[c, lo:hi] @ x[a:b, lo:hi].T
                        done += dist.size * (hi - lo)
                        live = dist <= (limit * self.limits[t])[:, None]
                        if hi == self.dim or np.count_nonzero(live) < SPARSE * live.size:
                            i, j = np.nonzero(live)
                            v = dist[i, j]
                    else:
                        v = v + ((q[c[i], lo:hi] - x[a + j, lo:hi]) ** 2).sum(1)
                        done += len(i) * (hi - lo)
                        ok = v <= limit[i] * self.limits[t]
                        i, j, v = i[ok], j[ok], v[ok]
                    if i is not None and not len(i):
                        break
                if len(i):
                    who, inner = np.unique(i, return_inverse=True)
                    owner = np.concatenate([inner, np.repeat(np.arange(len(who)), k)])
                    every_dist, place = np.concatenate([v, best[c[who]].ravel()]), np.concatenate([order[a + j], at[c[who]].ravel()])
                    ranked = np.lexsort((every_dist, owner))
                    counts = np.bincount(owner)
                    rank = np.arange(len(ranked)) - np.repeat(np.cumsum(counts) - counts, counts)
                    top = ranked[rank < k].reshape(len(who), k)
                    best[c[who]], at[c[who]] = every_dist[top], place[top]
        return at, best, done, every


def build_index(distinct: DataFrame, n: int, sample: int = SAMPLE, block: int = BLOCK, per_shard: int = LISTS, alpha: float = ALPHA) -> Index | None:
    """Fitted on ``sample`` vectors; shards of ``block`` rows, but eight sampled vectors a list at least."""
    rows = [r["v"] for r in distinct.orderBy("key", "v").select("v").limit(sample).collect()]
    if not rows:
        return None
    top = distinct.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0] ** 0.5
    shards = max(1, min(-(-n // block), len(rows) // (8 * per_shard)))
    return Index(np.array(rows), top * (1 + 1e-12), shards, max(1, min(per_shard, len(rows) // 8)), alpha)


def matrix(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def search(queries: DataFrame, vectors: DataFrame, k: int = 20, probe: float = 0.0, miss: float = MISS, alpha: float = ALPHA, sample: int = SAMPLE, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", queried=None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product of each query, other than itself.

    probe: the least share of the lists that each query scans. queried: a condition on ``id`` that picks the queries out of the
    vectors (queries may then be None).
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    asked = rows.filter(queried) if queried is not None else usable(queries, id_col, vector_col)
    distinct = written(distinct_vectors(rows, k + 1), "vectors")
    index = build_index(distinct, distinct.count(), sample, block, alpha=alpha)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared, most = spark.sparkContext.broadcast(index), k + 1

    def assign(frames):
        for f in frames:
            x = np.array(f["v"].tolist()) if len(f) else np.zeros((0, shared.value.dim - 1))
            lists = shared.value.lists_of(shared.value.stored(x))
            yield pd.DataFrame({"ids": f["ids"], "shard": shared.value.shard_of[lists], "list": lists, "raw": [r.tobytes() for r in x], "h": f["key"]})

    placed = written(distinct.mapInPandas(assign, "ids array<long>, shard long, list long, raw binary, h long"), "lists")
    sizes = np.zeros(len(index.fine), np.int64)  # a count a list
    for r in placed.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    cuts = [max(1, -(-int(n) // block)) for n in np.bincount(index.shard_of, sizes)]
    of_shard = F.create_map(*[F.lit(x) for pair in enumerate(cuts) for x in pair])
    blocks_of = lambda shard: F.element_at(of_shard, shard.cast("int"))
    placed = placed.withColumn("block", F.pmod(F.col("h"), blocks_of(F.col("shard"))).cast("int"))
    # equal query vectors are searched once, under their smallest id
    reps = written(asked.groupBy("v").agg(F.min("id").alias("rep")), "queries")
    named = asked.join(reps, "v").select(F.col("id").alias("query_id"), "rep")

    def homes(frames):
        for f in frames:
            if len(f):
                x = np.array(f["v"].tolist())
                yield pd.DataFrame({"rep": f["rep"], "raw": [r.tobytes() for r in x], "shard": shared.value.home(x)})

    def bounds(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        bound = np.full(len(left), np.inf)
        if len(left) and len(right):
            lists = right["list"].to_numpy()
            wanted = np.ones((len(left), int(lists.max()) + 1), bool)
            bound = shared.value.scan(matrix(left["raw"]), matrix(right["raw"]), lists, wanted, bound, most)[1][:, -1]
        return pd.DataFrame({"rep": left["rep"], "raw": left["raw"], "bound": bound})

    def probe_lists(frames):
        for f in frames:
            out = []
            for i in range(0, len(f), 256):
                part = f.iloc[i : i + 256]
                asks = shared.value.probes(matrix(part["raw"].tolist()), sizes, k, miss, probe)
                for rep, raw, bound, row in zip(part["rep"], part["raw"], part["bound"], asks, strict=True):
                    lists = np.flatnonzero(row)
                    shards = shared.value.shard_of[lists]
                    cut = np.flatnonzero(np.diff(shards)) + 1
                    out += [(rep, raw, bound, int(shared.value.shard_of[p[0]]), p) for p in np.split(lists, cut) if len(p)]
            yield pd.DataFrame(out, columns=["rep", "raw", "bound", "shard", "lists"])

    def within(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, float]] = []
        if len(left) and len(right):
            q, x, reps_, ids = matrix(left["raw"]), matrix(right["raw"]), left["rep"].to_numpy(), right["ids"].tolist()
            wanted = np.zeros((len(q), len(sizes)), bool)
            for row, lists in zip(wanted, left["lists"], strict=True):
                row[lists] = True
            for s in range(0, len(q), 2048):
                part = slice(s, s + 2048)
                at, _, _, _ = shared.value.scan(q[part], x, right["list"].to_numpy(), wanted[part], left["bound"].to_numpy()[part], most)
                i, j = np.nonzero(at >= 0)
                place = at[i, j]
                scores = (x[place] * q[part][i]).sum(1)
                found += [(r, n, v) for r, a, v in zip(reps_[part][i].tolist(), place.tolist(), scores.tolist(), strict=True) for n in ids[a]]
        return pd.DataFrame(found, columns=["rep", "vec_id", "score"]).astype({"rep": "int64", "vec_id": "int64", "score": "float64"})

    at_home = reps.mapInPandas(homes, "rep long, raw binary, shard long").withColumn("block", F.pmod(F.xxhash64("rep"), blocks_of(F.col("shard"))).cast("int"))
    bounded = at_home.groupBy("shard", "block").cogroup(placed.groupBy("shard", "block")).applyInPandas(bounds, "rep long, raw binary, bound double")
    wanted = bounded.mapInPandas(probe_lists, "rep long, raw binary, bound double, shard long, lists array<long>")
    # every block of a shard is probed; a common vector adds no rows since equal vectors are one
    wanted = wanted.withColumn("block", F.explode(F.sequence(F.lit(0), blocks_of(F.col("shard")) - 1)))
    hits = wanted.groupBy("shard", "block").cogroup(placed.groupBy("shard", "block")).applyInPandas(within, HITS)
    order = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    best = hits.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).drop("n")
    own = named.join(best, "rep").filter("query_id <> vec_id")
    again = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return own.withColumn("rank", F.row_number().over(again)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
