"""Nearest vectors by inner product, with vantage-point trees for each shard.

Inner products are turned into distances: a vector x with norm |x| <= M becomes
(x, sqrt(M^2 - |x|^2)), a query (q * M / |q|, 0). Their squared distance is
2 M^2 - 2 M <q, x> / |q|, so the nearest points are those with the largest inner
product, and the triangle inequality holds.

1. Equal vectors form one point with its smallest ids: no more than k + 1 of them
   can be among k results.
2. A bounded sample of the points gives the upper levels of a vantage-point tree,
   whose leaves are regions. They alone are broadcast; each point finds its
   region with them, and a region with more than SHARD points is dealt by a hash
   to several shards.
3. A query meets the shards of its own region first. That bounds its k-th
   distance, and then it goes only to regions where factor * bound stays below
   it: other pairs of queries and shards are pruned before anything moves.
4. A shard's points go to a task once for each PART of its queries. The task
   builds the shard's tree and streams the queries past it: the bound on every
   leaf follows from the distances to the vantage points above it; leaves are
   searched where factor * bound stays below the k-th distance so far.

Factor 1 never leaves out a result; a larger one prunes more.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.work import written

K, EVERY = 20, 20
#: Points in a shard and in a leaf, queries that a task takes past one shard, queries in a step.
SHARD, LEAF, PART, STEP = 16_384, 64, 32_768, 1_024
#: Regions of one length of vectors, and points of the sample that they are drawn from, at most.
MOST_REGIONS, SAMPLE = 1_024, 16_384
#: Bytes of a shard's points and of a sample, at most: long vectors have smaller shards and samples.
HELD_BYTES = 32 << 20
#: How much the pruning is relaxed: a leaf or region is left out where FACTOR times its bound exceeds the k-th distance.
FACTOR = 2.0


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def _vantage(points: np.ndarray, own: np.ndarray) -> int:
    """Of a few evenly spaced points the one whose distances to the others spread most."""
    tried = own[np.linspace(0, len(own) - 1, 8).astype(int)]
    sample = points[own[:: max(1, len(own) // 256)]]
    return int(tried[_distances(points[tried], sample).std(axis=1).argmax()])


class Tree:
    """A vantage-point tree over points: halves by the median distance to a vantage point, down to leaves."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.vantage: list[int] = []
        self.leaves: list[np.ndarray] = []
        #: For each leaf: (vantage, least, most distance of the leaf's points) on the way to it.
        self.ways: list[list[tuple[int, float, float]]] = []
        todo = [(np.arange(len(points)), [])]
        while todo:
            own, way = todo.pop()
            if len(own) <= leaf:
                self.leaves.append(own)
                self.ways.append(way)
                continue
            v = _vantage(points, own)
            d = np.linalg.norm(points[own] - points[v], axis=1)
            order = np.argsort(d, kind="stable")
            half = len(own) // 2
            for part in (order[:half], order[half:]):
                todo.append((own[part], [*way, (len(self.vantage), float(d[part].min()), float(d[part].max()))]))
            self.vantage.append(v)

    def bounds(self, to_vantage: np.ndarray) -> np.ndarray:
        """Least possible distance of each query to each leaf's points, by the triangle inequality."""
        out = np.zeros((len(to_vantage), len(self.leaves)))
        for k, way in enumerate(self.ways):
            for v, low, high in way:
                d = to_vantage[:, v]
                np.maximum(out[:, k], np.maximum(d - high, low - d), out=out[:, k])
        return out


class Router:
    """The upper levels of a vantage-point tree over a sample. Each of its leaves is a region of the whole space."""

    def __init__(self, sample: np.ndarray, regions: int):
        self.vantage, self.radius, self.children = [], [], []
        ways: list[list[tuple[int, int]]] = [[]]  # of each open region: (node, side) from the top
        largest = [(-len(sample), 0, np.arange(len(sample)))]
        while len(ways) < regions and -largest[0][0] >= 2:
            _, region, own = heapq.heappop(largest)
            v = _vantage(sample, own)
            d = _distances(sample[own], sample[[v]])[:, 0]
            radius = float(np.median(d))
            near = d < radius
            if near.all() or not near.any():  # as far from here as can be told, all are in one place
                heapq.heappush(largest, (0, region, own))
                continue
            node, way = len(self.radius), ways[region]
            self.vantage.append(sample[v])
            self.radius.append(radius)
            ways[region] = [*way, (node, 0)]
            ways.append([*way, (node, 1)])
            for side, place in ((own[near], region), (own[~near], len(ways) - 1)):
                heapq.heappush(largest, (-len(side), place, side))
        self.ways, self.vantage = ways, np.array(self.vantage)

    def _to_vantage(self, points: np.ndarray) -> np.ndarray:
        return _distances(points, self.vantage) if len(self.vantage) else np.zeros((len(points), 0))

    def home(self, points: np.ndarray) -> np.ndarray:
        """The region of each point."""
        d = self._to_vantage(points)
        out = np.zeros(len(points), np.int32)
        for region, way in enumerate(self.ways):
            own = np.ones(len(points), bool)
            for node, side in way:
                own &= (d[:, node] >= self.radius[node]) == bool(side)
            out[own] = region
        return out

    def bounds(self, points: np.ndarray) -> np.ndarray:
        """Least possible distance of each query to any point of each region."""
        d = self._to_vantage(points)
        out = np.zeros((len(points), len(self.ways)))
        for region, way in enumerate(self.ways):
            for node, side in way:
                np.maximum(out[:, region], (self.radius[node] - d[:, node]) * (1 if side else -1), out=out[:, region])
        return out


def _slack(queries: np.ndarray) -> float:
    """More than what rounding can add to a distance."""
    return 1e-6 * (1 + float(np.abs(queries).max(initial=0)))


def search(tree: Tree, points: np.ndarray, queries: np.ndarray, k: int, factor: float, limit: np.ndarray | None = None) -> list[np.ndarray]:
    """Places of the points found for each query: at least the k nearest of all leaves that were searched and within its limit."""
    bound = tree.bounds(_distances(queries, points[tree.vantage])) if tree.vantage else np.zeros((len(queries), 1))
    near = np.full((len(queries), k), np.inf)
    cut = np.full(len(queries), np.inf) if limit is None else limit.copy()
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in queries]
    slack = _slack(queries)

    def visit(leaf: int, who: np.ndarray) -> None:
        own = tree.leaves[leaf]
        d = _distances(queries[who], points[own])
        hit = d <= cut[who, None] + slack
        for row in np.flatnonzero(hit.any(axis=1)):
            found[who[row]].append(own[hit[row]])
        near[who] = np.partition(np.concatenate([near[who], d], axis=1), k - 1, axis=1)[:, :k]
        cut[who] = np.minimum(cut[who], near[who, k - 1])

    first = bound.argmin(axis=1)
    for leaf in np.unique(first):
        visit(leaf, np.flatnonzero((first == leaf) & (factor * bound[:, leaf] <= cut + slack)))
    for leaf in np.argsort(bound.mean(axis=0), kind="stable"):
        who = np.flatnonzero((first != leaf) & (factor * bound[:, leaf] <= cut + slack))
        if len(who):
            visit(leaf, who)
    return [np.concatenate(f) for f in found]


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of a with each row of b in double precision, added from the first component to the last."""
    return np.add.accumulate(b * a, axis=1)[:, -1]


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0))])


def _turned(q: np.ndarray, longest: float) -> np.ndarray:
    return np.column_stack([q * (longest / np.linalg.norm(q, axis=1))[:, None], np.zeros(len(q))])


def _by_dims(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch with vectors of one length, length by length, in steps."""
    dims = b["dims"].to_numpy()
    for d in np.unique(dims):
        own = b.filter(pa.array(dims == d))
        for at in range(0, own.num_rows, STEP):
            yield int(d), own.slice(at, STEP)


def _assign(routers: dict[int, Router], longest: dict[int, float], point: bool):
    """Task side: adds the region of each point, or of each query."""
    made = _lifted if point else _turned

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, own in _by_dims(b):
                home = routers[d].home(made(_matrix(own["v"], d), longest[d])) if d in routers else np.zeros(own.num_rows, np.int32)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(home, pa.int32())], [*own.schema.names, "region"])

    return run


def _route(routers: dict[int, Router], longest: dict[int, float], factor: float):
    """Task side: the further regions that a query has to visit, given its k-th distance so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, own in _by_dims(b):
                if d not in routers:
                    continue
                q = _matrix(own["v"], d)
                turned = _turned(q, longest[d])
                score = own["kth"].to_numpy(zero_copy_only=False).astype(float)
                near = np.sqrt(np.maximum(2 * longest[d] ** 2 - 2 * longest[d] * score / np.linalg.norm(q, axis=1), 0))
                near = np.where(np.isnan(near), np.inf, near)
                open_ = factor * routers[d].bounds(turned) <= (near + _slack(turned))[:, None]
                open_[np.arange(len(q)), own["region"].to_numpy()] = False
                who, region = np.nonzero(open_)
                out = own.select(["id", "v", "dims"]).take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(region, pa.int32()), pa.array(near[who])], ["id", "v", "dims", "region", "near"])

    return run


def _meet(longest: dict[int, float], k: int, factor: float):
    """Task side: rows sorted by shard, its points before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tree = None, [], None
        for b in batches:
            keys = list(zip(*(b[c].to_pylist() for c in ("dims", "region", "sub", "part")), strict=True))
            kinds = b["kind"].to_pylist()
            at = 0
            while at < b.num_rows:
                end = at + 1
                while end < b.num_rows and end - at < STEP and (keys[end], kinds[end]) == (keys[at], kinds[at]):
                    end += 1
                piece, d = b.slice(at, end - at), keys[at][0]
                if keys[at] != key:
                    key, held, tree = keys[at], [], None
                if kinds[at] == 0:
                    held.append((_matrix(piece["v"], d), piece["ids"].to_pylist()))
                elif held:
                    if tree is None:
                        original, ids = np.concatenate([m for m, _ in held]), [sorted(i) for _, part in held for i in part]
                        order = sorted(range(len(ids)), key=lambda r: ids[r][0])  # whatever way the rows came
                        original, ids = original[order], [ids[r] for r in order]
                        points = _lifted(original, longest[d])
                        tree = Tree(points)
                    yield from _answers(tree, points, original, ids, piece, longest[d], k, factor)
                at = end

    return run


def _answers(tree: Tree, points: np.ndarray, original: np.ndarray, ids: list[list[int]], asked: pa.RecordBatch, longest: float, k: int, factor: float) -> Iterator[pa.RecordBatch]:
    q = _matrix(asked["v"], original.shape[1])
    limit = asked["near"].to_numpy(zero_copy_only=False).astype(float)
    who, what, scores = [], [], []
    for own, vec, places in zip(asked["id"].to_pylist(), q, search(tree, points, _turned(q, longest), k + 1, factor, np.where(np.isnan(limit), np.inf, limit)), strict=True):
        products = exact_products(vec, original[places])
        if len(places) > k:
            cut = np.partition(products, len(products) - k - 1)[len(products) - k - 1]
            places, products = places[products >= cut], products[products >= cut]
        best = sorted((-p, i) for p, at in zip(products.tolist(), places.tolist(), strict=True) for i in ids[at] if i != own)[:k]
        who += [own] * len(best)
        what += [i for _, i in best]
        scores += [-p for p, _ in best]
    yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(what, pa.int64()), pa.array(scores, pa.float64())], ["query_id", "vec_id", "score"])


def nearest_vectors(vectors: DataFrame, k: int = K, every: int = EVERY, factor: float = FACTOR, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose key is divisible by `every`, the k nearest other rows found.

    Nearness is the inner product in double precision; ties go to the smaller
    key. Null or zero vectors, and those with a null or non-finite component,
    take no part; nor do rows without a key. Vectors meet those of their own
    length only. Rows that share a key and a vector are one candidate; of a key
    with several vectors each is asked, and the best score of a candidate counts.
    A query with fewer candidates gets them all; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].alias("v"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0)
    norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull()).where(sound).distinct()
    rows = rows.withColumn("dims", F.size(v)).withColumn("norm", norm).where("norm > 0 AND norm < double('infinity')")
    rows = written(rows, "vectors")
    kind = rows.schema["v"].dataType.simpleString()
    stats = rows.groupBy("dims").agg(F.max("norm").alias("most"), F.count("*").alias("n")).collect()  # a row for each length of vector
    if not stats:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest = {s["dims"]: float(s["most"]) ** 0.5 for s in stats}
    room = {s["dims"]: max(256, HELD_BYTES // (8 * (s["dims"] + 1))) for s in stats}
    routers = {}
    for dims, n in ((s["dims"], s["n"]) for s in stats):
        size, drawn = min(shard, room[dims]), min(SAMPLE, room[dims])
        if n > size:
            draw = F.shiftrightunsigned(F.xxhash64("v"), 1) < F.lit(int(min(1.0, drawn / n) * (2**63 - 1025)))
            sample = rows.where((F.col("dims") == dims) & draw).select("v").distinct().orderBy("v").limit(2 * drawn).collect()
            routers[dims] = Router(_lifted(np.array([r["v"] for r in sample], np.float64).reshape(-1, dims), longest[dims]), min(MOST_REGIONS, -(-n // size)))
    # A point keeps the k + 1 smallest ids of its equal vectors; row_number's limit is applied before the shuffle, too.
    least = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    points = rows.select("id", "v", "dims").withColumn("nth", least).where(F.col("nth") <= k + 1)
    points = points.groupBy("dims", "v").agg(F.collect_list("id").alias("ids"))
    points = written(points.mapInArrow(_assign(routers, longest, True), f"dims int, v {kind}, ids array<long>, region int"), "vp-points")
    asked = rows.where(F.col("id") % every == 0).select("id", "v", "dims")
    asked = written(asked.mapInArrow(_assign(routers, longest, False), f"id long, v {kind}, dims int, region int"), "vp-queries")
    shards = {(r["dims"], r["region"]): -(-r["n"] // min(shard, room[r["dims"]])) for r in points.groupBy("dims", "region").agg(F.count("*").alias("n")).collect()}  # a row for each region

    def met(visits: DataFrame) -> DataFrame:
        """Visits: id, v, dims, region, near. Each meets all shards of its region."""
        counts = visits.groupBy("dims", "region").agg(F.count("*").alias("n")).collect()
        plan = [(*at, shards[at], -(-r["n"] // PART)) for r in counts if (at := (r["dims"], r["region"])) in shards]
        places = F.broadcast(spark.createDataFrame(plan, "dims int, region int, subs long, parts long"))  # a row for each region
        left = points.join(places, ["dims", "region"]).select("dims", "region", F.pmod(F.xxhash64("v"), F.col("subs")).alias("sub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "v", "ids", F.lit(None).cast("double").alias("near"))
        right = visits.join(places, ["dims", "region"]).select("dims", "region", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), F.pmod(F.xxhash64("id", "v"), F.col("parts")).alias("part"), F.lit(1).alias("kind"), "id", "v", F.lit(None).cast("array<long>").alias("ids"), "near")
        at = ["dims", "region", "sub", "part"]
        tasks = max(1, min(2 * sum(s * p for *_, s, p in plan), 20_000))
        return left.unionByName(right).repartition(tasks, *at).sortWithinPartitions(*at, "kind").mapInArrow(_meet(longest, k, factor), "query_id long, vec_id long, score double")

    found = met(asked.withColumn("near", F.lit(None).cast("double")))
    if routers:
        found = written(found, "vp-found")
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
        kth = best.select(F.col("query_id").alias("of"), F.get("scores", F.lit(k - 1)).alias("kth"))
        visits = asked.join(kth, F.col("id") == F.col("of"), "left").select("id", "v", "dims", "region", "kth")
        visits = written(visits.mapInArrow(_route(routers, longest, factor), f"id long, v {kind}, dims int, region int, near double"), "vp-visits")
        found = found.unionByName(met(visits))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
