"""Approximate nearest neighbours by balanced posting lists.

Centroids come from splitting a bounded sample in two again and again until every part is small, so lists are balanced; their number grows with the
square root of the rows. They are held in memory as a graph of neighbours, which a best-first search walks for many vectors at once. A vector goes to the
list of its nearest centroid and, where it lies at a boundary, to those of other centroids that are nearly as near. A query reads the lists whose centroid is
not further than a stated ratio of the nearest one's distance; where the search ends before that ratio, the distances to all centroids are computed. Both
ratios are fitted on the sample: the cheapest pair that finds the wanted share of its true neighbours. A query is first compared with some rows drawn from
all; lists then give only rows that reach the k-th best of these, so few leave a list whatever their number.

Lists are dealt in tiles: short lists together, long ones in blocks. So is what asks for them, which makes every group small.

Largest inner product becomes smallest distance by one more dimension that brings all vectors to the same norm.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import durable, small_batches, tidy


@dataclass
class Params:
    lists: float = 3.0  # times the square root of the number of rows: number of lists
    max_lists: int = 8192  # bounds what is broadcast and, with per_list, the sample, whatever the input
    per_list: int = 24  # vectors of the sample in a list, at most; the sample has lists * per_list vectors
    copies: int = 4  # lists that a vector is in, at most
    spreads: tuple[float, ...] = (1.002, 1.02, 1.1)  # a vector is in each list within such a ratio of its nearest centroid's distance; the cheapest is taken
    recall: float = 0.95  # share of true neighbours in the sample that the ratio which selects a query's lists has to find
    tested: int = 8192  # rows of another sample, drawn from all, that the ratios are fitted on, at most
    tried: int = 600  # of these, those that are tried as queries
    degree: int = 32  # neighbours of a centroid in the graph
    beam: int = 128  # candidates that the graph search keeps; what lies further is found exactly
    tile: int = 2048  # vectors in a tile, about
    asking: int = 4096  # queries of a tile in a group, about
    bar: float = 20.0  # times the square root of the number of rows: rows that each query is compared with first, for a product that its k nearest reach
    max_bar: int = 100_000  # bounds these, as they are broadcast


def _split(x: np.ndarray, most: int, rng) -> list[np.ndarray]:
    """Parts of at most `most` rows, by balanced splits in two along the line between two means."""
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        v = x[rows]
        a, b = v[rng.integers(len(v))], v[rng.integers(len(v))]
        for _ in range(8):
            side = v @ (b - a)
            order = side > np.median(side)
            if not order.any() or order.all():
                break
            a, b = v[~order].mean(0), v[order].mean(0)
        half = np.argsort(v @ (b - a), kind="stable")
        todo += [rows[half[: len(half) // 2]], rows[half[len(half) // 2 :]]]
    return out


@dataclass
class Graph:
    """Centroids and, for each, its nearest others with some links at random, which keep the graph connected."""

    centroids: np.ndarray
    near: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, c: np.ndarray, degree: int, rng) -> Graph:
        n = len(c)
        k = min(degree, max(n - 1, 1))
        near = np.zeros((n, k), np.int32)
        norm = (c * c).sum(1)
        for i in range(0, n, 1024):
            d = norm[None] - 2 * c[i : i + 1024] @ c.T
            if n > 1:
                d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            near[i : i + 1024] = np.argpartition(d, k - 1, 1)[:, :k] if n > 1 else 0
        ring = rng.permutation(n)
        near[ring, -1] = np.roll(ring, 1)  # one cycle through all
        return cls(c.astype(np.float32), near, rng.choice(n, min(n, 32), replace=False).astype(np.int32))

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Centroids and distances, nearest first, of each row; a row has `beam` of them (or all, if fewer). Rows walk together."""
        n = len(self.centroids)
        beam = min(beam, n)
        norm = (self.centroids**2).sum(1)
        own = (x * x).sum(1)

        def distance(rows, c):
            return np.maximum(own[rows, None] + norm[c] - 2 * np.einsum("rd,rcd->rc", x[rows], self.centroids[c]), 0)

        seen = np.zeros((len(x), n), bool)
        width = max(beam, len(self.entries))
        ids = np.full((len(x), width), -1, np.int32)
        dist = np.full((len(x), width), np.inf, np.float32)
        done = np.ones((len(x), width), bool)
        everyone = np.arange(len(x))
        first = np.broadcast_to(self.entries, (len(x), len(self.entries)))
        ids[:, : first.shape[1]], dist[:, : first.shape[1]], done[:, : first.shape[1]] = first, distance(everyone, first), False
        seen[:, self.entries] = True
        active = everyone
        while len(active):
            open_ = np.where(done[active], np.inf, dist[active])
            pick = np.argsort(open_, 1)[:, :4]
            ok = np.isfinite(np.take_along_axis(open_, pick, 1))
            go = ok.any(1)
            active, pick, ok = active[go], pick[go], ok[go]
            if not len(active):
                break
            done[active[:, None], pick] = True
            fresh = np.where(ok[:, :, None], self.near[np.maximum(ids[active[:, None], pick], 0)], 0).reshape(len(active), -1)
            new = ~seen[active[:, None], fresh] & np.repeat(ok, self.near.shape[1], 1)
            seen[active[:, None], fresh] |= new
            order = np.argsort(np.where(new, fresh, n), 1, kind="stable")  # one of each
            fresh, new = np.take_along_axis(fresh, order, 1), np.take_along_axis(new, order, 1)
            new[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
            d = np.where(new, distance(active, fresh), np.inf)
            all_d = np.concatenate([dist[active], d], 1)
            best = np.argpartition(all_d, width - 1, 1)[:, :width] if all_d.shape[1] > width else np.broadcast_to(np.arange(width), (len(active), width))
            ids[active] = np.take_along_axis(np.concatenate([ids[active], fresh], 1), best, 1)
            done[active] = np.take_along_axis(np.concatenate([done[active], ~new], 1), best, 1)
            dist[active] = np.take_along_axis(all_d, best, 1)
        order = np.argsort(dist, 1, kind="stable")[:, :beam]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0))


@dataclass
class Index:
    """Centroids and the two ratios. top: the largest squared norm."""

    graph: Graph
    top: float
    spread: float
    ratio: float
    copies: int
    beam: int

    def lifted(self, v: np.ndarray) -> np.ndarray:
        """Rows with one more dimension, in which all have the same norm: so the nearest to a probe has the largest product."""
        v = v / np.sqrt(self.top)
        return np.concatenate([v, np.sqrt(np.maximum(1 - (v * v).sum(1), 0))[:, None]], 1).astype(np.float32)

    def probe(self, v: np.ndarray) -> np.ndarray:
        """Queries among lifted rows: of norm 1, nothing in the dimension more."""
        v = v / np.sqrt((v * v).sum(1))[:, None]
        return np.concatenate([v, np.zeros((len(v), 1))], 1).astype(np.float32)

    def lists(self, x: np.ndarray, spread: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of each lifted vector its nearest lists, and which of them it is in: the first always."""
        ids, d = self.graph.search(x, 32)
        ids, d = ids[:, : self.copies], np.sqrt(d[:, : self.copies])
        keep = d <= d[:, :1] * (self.spread if spread is None else spread)
        keep[:, 0] = True
        return ids, keep

    def chosen(self, x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """Lists that each probe reads, as a row of booleans: those within the ratio, and the nearest ones until they hold over k rows.

        own: rows whose nearest centroid each is. Where the search's last list is still wanted, all centroids are looked at.
        """
        n = len(self.graph.centroids)
        out = np.zeros((len(x), n), bool)

        def select(rows, ids, d):
            near = d <= np.maximum(d[:, :1] * self.ratio, 1e-9)
            near |= np.cumsum(own[ids], 1) - own[ids] <= k
            np.put_along_axis(sub := np.zeros((len(rows), n), bool), ids, near, 1)
            out[rows] = sub
            return near[:, -1]

        ids, d = self.graph.search(x, self.beam)
        more = np.flatnonzero(select(np.arange(len(x)), ids, np.sqrt(d)))
        if len(more) and ids.shape[1] < n:
            d = _distances(x[more], self.graph.centroids)
            order = np.argsort(d, 1, kind="stable")
            select(more, order, np.take_along_axis(d, order, 1))
        return out


def train(v: np.ndarray, test: np.ndarray, top: float, lists: int, k: int, p: Params, total: int) -> Index:
    """An index from a sample v, and ratios from another sample of all rows (total): those that read the fewest rows and find p.recall of the true neighbours that
    some of its vectors have in it. As many neighbours of each are looked for as k of all rows leave there, for those are as near as the k nearest of all.

    Lists of a neighbour come from the same search that stores it, so what the search misses is in the ratio.
    """
    rng = np.random.default_rng(11)
    index = Index(None, top, p.spreads[0], np.inf, p.copies, p.beam)
    x = index.lifted(v)
    x = x[np.lexsort(x.T[:4])]
    parts = _split(x, max(1, -(-len(x) // lists)), rng)
    index.graph = Graph.build(np.stack([x[r].mean(0) for r in parts]), p.degree, rng)
    test = test[np.lexsort(test.T[:4])]
    x = index.lifted(test)
    if len(x) < 2:
        return index
    ask = np.arange(0, len(x), max(1, len(x) // p.tried))
    probes = index.probe(test[ask])
    true = np.zeros((len(ask), min(-(-k * len(x) // max(total, len(x))), len(x) - 1)), np.int64)
    for i in range(0, len(ask), 256):
        s = probes[i : i + 256] @ x.T
        s[np.arange(len(s)), ask[i : i + 256]] = -np.inf
        true[i : i + 256] = np.argpartition(-s, true.shape[1] - 1, 1)[:, : true.shape[1]]
    d = _distances(probes, index.graph.centroids)
    d0 = np.maximum(d.min(1, keepdims=True), 1e-9)
    best = np.inf
    for spread in p.spreads:
        own = [index.lists(x[i : i + 1024], spread) for i in range(0, len(x), 1024)]
        ids, keep = np.concatenate([o[0] for o in own]), np.concatenate([o[1] for o in own])
        size = np.bincount(ids[keep], minlength=d.shape[1])
        to = np.stack([np.where(keep[t], d[j][ids[t]], np.inf).min(1) for j, t in enumerate(true)])
        ratio = float(np.quantile(to / d0, p.recall)) + 1e-6
        cost = float(((d <= d0 * ratio) @ size).mean())
        if cost < best:
            best, index.spread, index.ratio = cost, spread, ratio
    return index


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def valid(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Columns vec_id, v (array of doubles), norm2: rows with an id and a vector that is not null, not empty, not zero and all finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))
    return v.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).filter(F.exists("v", lambda x: x != 0))


def fit(vectors: DataFrame, k: int, p: Params) -> tuple[Index, int, int] | None:
    """An index of valid() rows of the most frequent length, that length and the number of rows; None without any."""
    dims = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max("norm2").alias("top")).orderBy(F.desc("n"), "d").first()
    if dims is None:
        return None
    dim, total = dims["d"], dims["n"]
    lists = int(np.clip(round(p.lists * total**0.5), 1, p.max_lists))

    def drawn(seed: int, most: int) -> np.ndarray:
        draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "vec_id", "v"), 11) / F.lit(float(1 << 53))
        rows = vectors.filter((F.size("v") == dim) & (draw < min(1.0, most / total))).select(F.col("v").cast("array<float>").alias("v")).limit(2 * most).toArrow()
        return _vectors(rows.column("v").combine_chunks()) if rows.num_rows else np.zeros((1, dim))

    return train(drawn(5, lists * p.per_list), drawn(7, p.tested), dims["top"], lists, k, p, total), dim, total


@dataclass
class Tiles:
    """How lists are dealt: list i has the tiles first[i] to first[i] + number[i] - 1, the queries of tile t are in asking[t] groups."""

    first: np.ndarray
    number: np.ndarray
    asking: np.ndarray
    own: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray, own: np.ndarray, tile: int) -> Tiles:
        first, number = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // tile))
        at, filled = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if filled and (number[i] > 1 or filled + n > tile):
                at, filled = at + 1, 0
            first[i] = at
            if number[i] > 1:
                at += int(number[i])
            else:
                filled += max(n, 1)
        return cls(first, number, np.ones(int((first + number).max()), np.int64), own)

    def ask(self, share: np.ndarray, queries: int, most: int) -> None:
        """share: the part of all queries that reads each list, as far as known."""
        part = np.zeros(len(self.asking))
        for i, n in enumerate(self.number.tolist()):
            part[self.first[i] : self.first[i] + n] += share[i]
        self.asking = np.maximum(1, np.ceil(np.minimum(part, 1) * queries / most)).astype(np.int64)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", params: Params | None = None) -> DataFrame:
    """Columns query_id, rank (from 1), vec_id, score: of each query the k rows found with the largest inner product, ties to the smaller id.

    A row with the query's own id is no candidate; vectors that valid() leaves out are neither candidates nor queries, and products that are not finite
    in double precision are left out. Scores are summed in double precision over the given vectors. A query gets k rows, or all other rows if there are fewer: it
    reads further lists until these hold enough. All vectors have one length (the most frequent; others take no part). Of rows that repeat an id, the
    largest vector (as arrays compare) counts. Other columns are not looked at, whatever their names. Without valid rows or queries the result is empty.
    """
    p = params or Params()
    spark = rows.sparkSession
    small_batches(spark)
    all_ = valid(rows, vec_id, vector)
    fitted = fit(all_, k, p)
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, dim, total = fitted
    one = lambda d: d.filter(F.size("v") == dim).groupBy("vec_id").agg(F.max("v").alias("v"))
    all_, asked = one(all_), one(valid(queries, vec_id, vector))
    g = spark.sparkContext.broadcast(index)

    def assign(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                ids, keep = g.value.lists(g.value.lifted(_vectors(part.column("v"))))
                row, col = np.nonzero(keep)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, col].astype(np.int32)), pa.array(col == 0), part.column("vec_id").take(take), part.column("v").take(take)], names=["list", "own", "vec_id", "v"])

    postings = durable(all_.mapInArrow(tidy(assign), "list int, own boolean, vec_id long, v array<double>"), "ann-postings")
    n_lists = len(index.graph.centroids)
    sizes, own = np.zeros(n_lists, np.int64), np.zeros(n_lists, np.int64)
    for r in postings.groupBy("list").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("long")).alias("own")).collect():
        sizes[r["list"]], own[r["list"]] = r["n"], r["own"]
    tiles = Tiles.of(sizes, own, p.tile)
    most = min(round(p.bar * total**0.5), p.max_bar)
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(8), "vec_id"), 11) / F.lit(float(1 << 53)) < min(1.0, most / total)
    bar = postings.filter(F.col("own") & drawn).select("vec_id", "v").limit(2 * most).toArrow()
    bars = spark.sparkContext.broadcast((bar.column("vec_id").to_numpy(), _vectors(bar.column("v").combine_chunks()))) if bar.num_rows else None

    def first(batches):
        """Of each query the best of the drawn rows; floor: what k of them reach, minus infinity where there are fewer."""
        for b in batches:
            ids, v = b.column("vec_id").to_numpy(), _vectors(b.column("v"))
            floor, best, score, n = np.full(len(v), -np.inf), [], [], []
            for i in range(0, len(v), 256):
                bar_ids, x = bars.value if bars else (np.zeros(0, np.int64), np.zeros((0, dim)))
                s = v[i : i + 256] @ x.T
                s[ids[i : i + 256, None] == bar_ids[None]] = -np.inf
                for j, row in enumerate(s):
                    c = np.argpartition(-row, k)[: k + 1] if len(row) > k + 1 else np.arange(len(row))
                    c = c[np.isfinite(row[c])]
                    exact = (x[c] * v[i + j]).sum(1)
                    top = np.lexsort((bar_ids[c], -exact))[:k]
                    best.append(bar_ids[c][top])
                    score.append(exact[top])
                    n.append(len(top))
                    if len(top) == k:
                        floor[i + j] = exact[top][-1]
            edge = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
            found = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *best])), pa.array(np.concatenate([np.zeros(0), *score]))], names=["vec_id", "score"])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(floor), pa.ListArray.from_arrays(edge, found)], names=["query_id", "q", "floor", "best"])

    asked = durable(asked.mapInArrow(tidy(first), "query_id long, q array<double>, floor double, best array<struct<vec_id:long,score:double>>"), "ann-queries")
    n_asked = asked.count()
    some = asked.filter(F.shiftrightunsigned(F.xxhash64(F.lit(6), "query_id"), 11) / F.lit(float(1 << 53)) < min(1.0, p.tried / max(n_asked, 1))).select("q").limit(2 * p.tried).toArrow()
    if some.num_rows:
        tiles.ask(index.chosen(index.probe(_vectors(some.column("q").combine_chunks())), own, k).mean(0), n_asked, p.asking)
    dealt = spark.sparkContext.broadcast(tiles)

    def ask(batches):
        t = dealt.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                row, lists = np.nonzero(g.value.chosen(g.value.probe(_vectors(part.column("q"))), t.own, k))
                n = t.number[lists]
                row, lists = np.repeat(row, n), np.repeat(lists, n)
                tile = t.first[lists] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (tile[1:] != tile[:-1]))) if len(row) else np.zeros(0, np.int64)
                take = pa.array(row[new])
                wanted = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)).astype(np.int32)), pa.array(lists.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(tile[new].astype(np.int32)), wanted, *[part.column(c).take(take) for c in ("query_id", "q", "floor")]], names=["tile", "lists", "query_id", "q", "floor"])

    # a tile of a long list and a group of a tile's queries are hashes of the ids
    some_of = lambda of, n: F.pmod(F.xxhash64(F.lit(23), of), n).cast("int")
    places = spark.createDataFrame([(i, int(f), int(n)) for i, (f, n) in enumerate(zip(tiles.first, tiles.number, strict=True))], "list int, first int, number int")
    groups = spark.createDataFrame([(i, int(n)) for i, n in enumerate(tiles.asking)], "tile int, groups int")
    stored = postings.join(F.broadcast(places), "list").select((F.col("first") + some_of("vec_id", F.col("number"))).alias("tile"), "list", "vec_id", "v")
    stored = stored.join(F.broadcast(groups), "tile").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    probes = asked.drop("best").mapInArrow(tidy(ask), "tile int, lists array<int>, query_id long, q array<double>, floor double").join(F.broadcast(groups), "tile").withColumn("part", some_of("query_id", F.col("groups"))).drop("groups")

    def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        ids, place, column = np.unique(left.column("vec_id").to_numpy(), return_index=True, return_inverse=True)  # a vector in several lists of the tile once
        x = _vectors(left.column("v").combine_chunks())[place]
        of = left.column("list").to_numpy()
        by = np.argsort(of, kind="stable")
        names, start = np.unique(of[by], return_index=True)
        members = dict(zip(names.tolist(), np.split(column[by], start[1:]), strict=True))
        q, qi, floors = _vectors(right.column("q").combine_chunks()), right.column("query_id").to_numpy(), right.column("floor").to_numpy()
        wanted = right.column("lists").combine_chunks()
        reads, edge = wanted.flatten().to_numpy(), wanted.offsets.to_numpy() - wanted.offsets[0].as_py()
        reader = np.repeat(np.arange(len(q)), np.diff(edge))
        out = []
        step = max(1, 2_000_000 // len(ids))
        for i in range(0, len(q), step):
            s = np.full((min(step, len(q) - i), len(ids)), -np.inf)
            own = (reader >= i) & (reader < i + step)
            for name in np.unique(reads[own]).tolist():
                if name in members:
                    who, cols = reader[own & (reads == name)], members[name]
                    s[np.ix_(who - i, cols)] = q[who] @ x[cols].T
            s[qi[i : i + step, None] == ids[None]] = -np.inf
            n = min(k, len(ids))
            least = np.maximum(np.partition(s, len(ids) - n, 1)[:, len(ids) - n], floors[i : i + step])
            for j in range(len(s)):
                c = np.flatnonzero((s[j] >= (least[j] - 1e-9 * (1 + abs(least[j])) if np.isfinite(least[j]) else -np.inf)) & np.isfinite(s[j]))
                if not len(c):
                    continue
                exact = (x[c] * q[i + j]).sum(1)  # the same order of sums wherever the vector is
                best = np.lexsort((ids[c], -exact))[:k]
                out.append((np.full(len(best), qi[i + j]), ids[c][best], exact[best]))
        return pa.table({"query_id": np.concatenate([o[0] for o in out]), "vec_id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])}) if out else empty

    found = stored.groupBy("tile", "part").cogroup(probes.groupBy("tile", "part")).applyInArrow(score, "query_id long, vec_id long, score double")
    found = found.unionByName(asked.select("query_id", F.inline("best")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
