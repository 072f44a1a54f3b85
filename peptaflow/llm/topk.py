"""Exact top-k inner-product search by dual-tree traversal of cover trees.

Data vectors lie in blocks of bounded size, each with its own cover tree, built once. Queries are
taken in blocks of bounded size as well, and each query block's tree is walked together with every
data block's tree: a pair of nodes is dropped if its bound, from centres and covering radii, stays
below the worst k-th score of the query node. Data are never shuffled to queries.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, discard, table, written

#: Vectors of the bounded sample that anchors and first lower bounds come from; anchors of one level, at most; vectors of a cell on average, of a data block and of a query block at most.
SAMPLE, LEVEL, CELL, BLOCK, ASK = 8192, 90, 2048, 2048, 32768
#: Bytes of vectors that a block has at most, so wide vectors have smaller blocks.
BLOCK_BYTES, ASK_BYTES = 1 << 22, 1 << 24
#: Points of a leaf; ratio of the covering radii of two levels; separated children beyond which a node stays a leaf.
LEAF, BASE, FANOUT = 32, 1.5, 64
_NODE = np.dtype([("start", "<i4"), ("end", "<i4"), ("parent", "<i4"), ("level", "<i4"), ("radius", "<f8")])
_LONG = (-(1 << 63), (1 << 63) - 1)
#: Above every product of vectors of doubles.
_TOP = 10**690


def _distance(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.sqrt(((points - to) ** 2).sum(1))


class CoverTree:
    """A cover tree over a permutation of the points; each node's centre is the first point of its range.

    Covering: a node's points lie within BASE ** level of its centre. Nesting: the first child has its parent's
    centre. Separation: centres of siblings lie more than BASE ** (level of the siblings) apart. Levels at which
    a node would have itself as its only child are left out. A node is a leaf if it has few points, or if they
    are so far apart that more than FANOUT children would be needed: pruning has nothing to gain there."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        nodes: list[tuple[int, int, int, int, float]] = []
        if len(points):
            middle = int(_distance(points, points.mean(0)).argmin())
            self.order[[0, middle]] = self.order[[middle, 0]]
        stack = [(0, len(points), -1)] if len(points) else []
        while stack:
            s, e, parent = stack.pop()
            own = self.order[s:e]
            dist = _distance(points[own], points[own[0]])
            radius = float(dist.max())
            level = math.ceil(math.log(radius) / math.log(BASE)) if 0 < radius < math.inf else 0
            while 0 < radius < math.inf and BASE**level < radius:
                level += 1
            at = len(nodes)
            nodes.append((s, e, parent, level, radius))
            if e - s <= LEAF or not 0 < radius < math.inf:
                continue
            near, groups, rest = BASE ** (level - 1), [own[dist <= BASE ** (level - 1)]], own[dist > BASE ** (level - 1)]
            while len(rest) and len(groups) <= FANOUT:
                inside = _distance(points[rest], points[rest[0]]) <= near
                groups.append(rest[inside])
                rest = rest[~inside]
            if len(rest):
                continue
            self.order[s:e] = np.concatenate(groups)
            for g in groups:
                stack.append((s, s + len(g), at))
                s += len(g)
        self._index(np.array(nodes, _NODE), points[self.order])

    @classmethod
    def stored(cls, nodes: bytes, points: np.ndarray) -> CoverTree:
        """A tree from its nodes and its points in tree order."""
        tree = cls.__new__(cls)
        tree.order = np.arange(len(points))
        tree._index(np.frombuffer(nodes, _NODE), points)
        return tree

    def _index(self, nodes: np.ndarray, points: np.ndarray) -> None:
        self.nodes, self.points = nodes, points
        self.children: list[list[int]] = [[] for _ in nodes]
        for i, p in enumerate(nodes["parent"].tolist()):
            if p >= 0:
                self.children[p].append(i)
        self.span = list(zip(nodes["start"].tolist(), nodes["end"].tolist(), strict=True))
        self.radii, self.centers = nodes["radius"], points[nodes["start"]]
        with np.errstate(all="ignore"):
            self.norms = np.sqrt((self.centers**2).sum(1))


def upper(cq: np.ndarray, rq, nq, cd: np.ndarray, rd, nd) -> np.ndarray:
    """Bound of the inner product between a ball of queries and balls of data, with room for rounding."""
    with np.errstate(all="ignore"):
        b = cd @ cq + rq * nd + rd * nq + rq * rd
        return b + 1e-9 * (np.abs(b) + 1) + 1e-9 * (nq + rq) * (nd + rd)


def _whole(x: np.ndarray) -> np.ndarray:
    """Whole doubles as Python integers."""
    return np.frompyfunc(int, 1, 1)(x)


def _below(x: int) -> float:
    """A double not above the integer."""
    try:
        return math.nextafter(float(x), -math.inf)
    except OverflowError:
        return math.inf if x > 0 else -math.inf


class DualSearch:
    """Best ``k`` data vectors of each query of a block, by score and then by smaller id; data blocks are visited one after the other.

    ``floor``: a score that each query is known to reach k times. Data with the query's own id are left out.
    ``exact``: whether all scores are exact in doubles; if not, they are computed in Python integers."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray, exact: bool = True):
        self.q, self.k, self.exact = CoverTree(queries), k, exact
        self.ids, self.floor = ids[self.q.order], floor[self.q.order].astype(float)
        self.low = -(1 << 62) if exact else -_TOP
        self.x = self.q.points if exact else _whole(self.q.points)
        self.begin()

    def begin(self) -> DualSearch:
        """Forgets what was found."""
        n = len(self.ids)
        self.scores, self.found = np.full((n, self.k), self.low, np.int64 if self.exact else object), np.zeros((n, self.k), np.int64)
        self.kth, self.pairs = self.floor.copy(), 0
        return self

    def visit(self, tree: CoverTree, ids: np.ndarray) -> None:
        """Searches one data block, whose points and ids are in tree order."""
        data = tree.points if self.exact else _whole(tree.points)
        rank = np.empty(len(ids), np.int64)
        rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        q, d = self.q, tree
        if not len(self.ids) or not len(ids):
            return
        stack = [(0, 0, math.inf)]
        while stack:
            a, b, bound = stack.pop()
            s, e = q.span[a]
            if bound < self.kth[s:e].min():
                continue
            if not q.children[a] and not d.children[b]:
                for at in range(s, e, 1024):
                    self._leaf(at, min(e, at + 1024), *d.span[b], data, ids, rank)
            elif d.children[b] and (not q.children[a] or d.radii[b] >= q.radii[a]):
                kids = np.array(d.children[b])
                bounds = upper(q.centers[a], q.radii[a], q.norms[a], d.centers[kids], d.radii[kids], d.norms[kids])
                stack += [(a, int(kids[i]), float(bounds[i])) for i in np.argsort(bounds)]
            else:
                kids = np.array(q.children[a])
                bounds = upper(d.centers[b], d.radii[b], d.norms[b], q.centers[kids], q.radii[kids], q.norms[kids])
                stack += [(int(kids[i]), b, float(bounds[i])) for i in np.argsort(bounds)]

    def _leaf(self, s: int, e: int, u: int, v: int, data: np.ndarray, ids: np.ndarray, rank: np.ndarray) -> None:
        self.pairs += 1
        scores, n, k = self.x[s:e] @ data[u:v].T, len(ids) + 1, self.k
        own = self.ids[s:e, None] == ids[u:v]
        if self.exact:
            scores = scores.astype(np.int64)
            keys = scores * n + (n - 1 - rank[u:v])
            keys[own] = np.iinfo(np.int64).min
            if v - u > k:
                top = np.argpartition(keys, v - u - k, axis=1)[:, -k:]
                keys, scores = np.take_along_axis(keys, top, 1), np.take_along_axis(scores, top, 1)
                got = ids[u:v][top]
            else:
                got = np.broadcast_to(ids[u:v], scores.shape)
            scores = np.where(keys == np.iinfo(np.int64).min, self.low, scores)
            both, names = np.concatenate([self.scores[s:e], scores], 1), np.concatenate([self.found[s:e], got], 1)
            best = np.lexsort((names, -both), axis=1)[:, :k]
            self.scores[s:e], self.found[s:e] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
            last = self.scores[s:e, -1]
            self.kth[s:e] = np.maximum(self.floor[s:e], np.where(last == self.low, -np.inf, last))
        else:
            for i in range(e - s):
                mine = [(-x, y) for x, y in zip(self.scores[s + i], self.found[s + i].tolist(), strict=True)]
                mine += [(-x, y) for x, y, o in zip(scores[i], ids[u:v].tolist(), own[i], strict=True) if not o]
                for j, (x, y) in enumerate(sorted(mine)[:k]):
                    self.scores[s + i, j], self.found[s + i, j] = -x, y
                if self.scores[s + i, -1] != self.low:
                    self.kth[s + i] = max(self.floor[s + i], _below(self.scores[s + i, -1]))

    def results(self) -> Iterator[tuple[int, int, int]]:
        """(query position, score, id)"""
        for i, row, names in zip(self.q.order.tolist(), self.scores.tolist(), self.found.tolist(), strict=True):
            for score, name in zip(row, names, strict=True):
                if score != self.low:
                    yield i, score, name


def _nearest(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return ((to**2).sum(1) - 2 * points @ to.T).argmin(1)


def farthest_first(points: np.ndarray, many: int) -> np.ndarray:
    """Anchors: the first point, then each the point farthest from those before it."""
    with np.errstate(all="ignore"):
        chosen, dist = [0], ((points - points[0]) ** 2).sum(1)
        while len(chosen) < min(many, len(points)) and dist.max() > 0:
            chosen.append(int(dist.argmax()))
            dist = np.minimum(dist, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


class Anchors:
    """Centres of cells, nested in two levels if there are many: an anchor of the upper level is the first of the lower level in its own cell."""

    def __init__(self, points: np.ndarray, many: int, level: int = LEVEL):
        self.top = farthest_first(points, many if many <= level else min(level, math.isqrt(many)))
        self.below: list[np.ndarray] = []
        if many > len(self.top):
            at = _nearest(points, self.top)
            for c, anchor in enumerate(self.top):
                self.below.append(farthest_first(np.vstack([anchor[None], points[at == c]]), -(-many // len(self.top))))
        self.first = np.cumsum([0, *[len(b) for b in self.below]])

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Number of each point's cell."""
        at = _nearest(x, self.top)
        if not self.below:
            return at
        out = np.empty(len(x), np.int64)
        for c in np.unique(at):
            here = at == c
            out[here] = self.first[c] + _nearest(x[here], self.below[c])
        return out


def _matrix(vectors: Sequence[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), dims)


def quantised(embeddings: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, vec binary): floor(scale * x) as whole little-endian doubles, kept within the range of doubles; vectors with null or non-finite components and rows without id are left out."""
    x = F.col(f"`{vec_col}`")
    fine = F.col(f"`{id_col}`").isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.finfo(np.float64).max
        for b in batches:
            col = b.column("vec")
            with np.errstate(over="ignore"):
                flat = np.clip(np.floor(scale * col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)), -most, most) + 0.0
            ends = np.cumsum(np.array(col.value_lengths().to_numpy(zero_copy_only=False), np.int64)).tolist()
            rows = [flat[s:e].astype("<f8").tobytes() for s, e in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(rows, pa.binary()), pa.array([float(np.abs(flat[s:e]).max(initial=0)) for s, e in zip([0, *ends], ends, strict=False)])], names=["id", "vec", "most"])

    return embeddings.filter(fine).select(F.col(f"`{id_col}`").cast("long").alias("id"), x.cast("array<double>").alias("vec")).mapInArrow(run, "id long, vec binary, most double")


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", cell: int = CELL, block: int = BLOCK, ask: int = ASK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products; ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``. Null vectors, vectors with null or non-finite
    components and rows without id take no part; shorter vectors are padded with zeros; rows that repeat a
    query's id count as the query's own, however many vectors that id has; repeated rows count once. Fewer
    than k candidates give fewer rows; an empty table gives none; other columns are not read. Scores beyond
    a long are ranked exactly and returned as the nearest long.

    Scale: equal vectors are joined first, keeping the k + 1 smallest ids, which is all that a result can
    hold. Vectors go to the cell of their nearest anchor, and cells to blocks of bounded size, so a hot cell
    is split; one row of the index holds a block with its tree. The driver sees one line a cell (at most
    ``SAMPLE`` cells) and one query block at a time, which is broadcast (at most ASK_BYTES of vectors, in
    expectation). Each query block makes one pass over the index; tasks send back k hits a query at most."""
    spark = embeddings.sparkSession
    rows = written(quantised(embeddings, id_col, vec_col, scale), "vectors")
    seen = rows.agg(F.max(F.octet_length("vec")).alias("w"), F.min(F.octet_length("vec")).alias("v"), F.max("most").alias("m")).first()
    if seen["w"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(8, seen["w"])
    dims, exact = width // 8, seen["m"] ** 2 * (width // 8) < 2.0**46 if seen["m"] < 1e150 else False
    rows_ = rows.select("id", (F.rpad("vec", width, F.lit(b"\x00")) if seen["v"] < width else F.col("vec")).alias("vec"))
    block, ask = max(1, min(block, BLOCK_BYTES // width)), max(1, min(ask, ASK_BYTES // width))
    smallest = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, k + 1)

    def combined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # copies within a batch
            best: dict[bytes, list[int]] = {}
            for i, v in zip(b.column("id").to_pylist(), b.column("vec").to_pylist(), strict=True):
                own = best.setdefault(v, [])
                if i not in own:
                    best[v] = sorted([*own, i])[: k + 1]
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.binary()), pa.array(list(best.values()), pa.list_(pa.int64()))], names=["vec", "ids"])

    part = rows_.mapInArrow(combined, "vec binary, ids array<long>").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    merged = part.groupBy("vec", "salt").agg(smallest("ids").alias("ids")).groupBy("vec").agg(smallest("ids").alias("ids"))
    distinct = written(merged, "distinct")
    n = distinct.count()
    sample = bounded_sample(distinct.select("vec", F.col("ids")[0].alias("id")), SAMPLE, "vec").collect()
    probe, probe_ids = _matrix([r["vec"] for r in sample], dims), np.array([r["id"] for r in sample], np.int64)
    anchors = spark.sparkContext.broadcast(Anchors(probe, max(1, min(len(sample), -(-n // cell)))))

    def celled(df: DataFrame, deal: dict[int, tuple[int, int]] | None = None) -> DataFrame:
        """Adds cell, or the part of the cell that ``deal`` (first part, parts) has for it."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                vectors = b.column("vec").to_pylist()
                at = anchors.value.assign(_matrix(vectors, dims)).tolist() if vectors else []
                if deal is not None:
                    at = [deal[c][0] + zlib.crc32(v) % deal[c][1] for c, v in zip(at, vectors, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=[*b.schema.names, "cell"])

        kinds = dict(df.dtypes)
        return df.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in df.columns) + ", cell bigint")

    sizes = {r["cell"]: r["n"] for r in celled(distinct).groupBy("cell").agg(F.sum(F.size("ids")).alias("n")).collect()}
    deal, first = {}, 0
    for c, size in sorted(sizes.items()):
        deal[c] = first, -(-size // block)
        first += deal[c][1]

    def build(t: pa.Table) -> pa.Table:
        lists = t.column("ids").to_pylist()
        own = np.array([i for ids in lists for i in ids], np.int64)
        x = np.repeat(_matrix(t.column("vec").to_pylist(), dims), [len(ids) for ids in lists], axis=0)
        tree = CoverTree(x)
        return pa.table({"nodes": [tree.nodes.tobytes()], "points": [tree.points.tobytes()], "ids": [own[tree.order].astype("<i8").tobytes()]}, schema=pa.schema([("nodes", pa.binary()), ("points", pa.binary()), ("ids", pa.binary())]))

    index = written(celled(distinct, deal).groupBy("cell").applyInArrow(build, "nodes binary, points binary, ids binary"), "index")
    asked = rows_.filter(F.col("id") % every == 0).distinct()
    wanted = {r["cell"]: r["n"] for r in celled(asked).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks, deal, room = 0, {}, 0  # cells are put into query blocks in order; one that does not fit is split
    for c, size in sorted(wanted.items()):
        if size > room:
            deal[c] = blocks, -(-size // ask)
            blocks, room = blocks + deal[c][1], 0 if size > ask else ask - size
        else:
            deal[c], room = (blocks - 1, 1), room - size
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries = written(celled(asked, deal).withColumn("n", F.monotonically_increasing_id()), "queries")

    found = None
    for at in range(blocks):
        own = queries.filter(F.col("cell") == at).toArrow().sort_by("n")  # one query block
        x, ids, numbers = _matrix(own.column("vec").to_pylist(), dims), own.column("id").to_numpy(), own.column("n").to_numpy()
        shared = spark.sparkContext.broadcast((DualSearch(x, ids, k, _floor(x, ids, probe, probe_ids, k) if exact else np.full(len(ids), -math.inf), exact), numbers))

        def search(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            dual, numbers = shared.value
            dual.begin()
            for b in batches:
                for nodes, points, ids in zip(b.column("nodes"), b.column("points"), b.column("ids"), strict=True):
                    names = np.frombuffer(ids.as_buffer(), "<i8")
                    dual.visit(CoverTree.stored(nodes.as_buffer(), np.frombuffer(points.as_buffer(), "<f8").reshape(len(names), dims)), names)
            hits = list(dual.results())
            for s in range(0, len(hits), 10_000):
                q, scores, names = zip(*hits[s : s + 10_000], strict=True)
                longs = [min(max(v, _LONG[0]), _LONG[1]) for v in scores]
                order = ["" if dual.exact else str(_TOP - v).zfill(700) for v in scores]  # ascending strings: descending scores
                yield pa.RecordBatch.from_arrays([pa.array(numbers[list(q)]), pa.array(longs, pa.int64()), pa.array(order, pa.string()), pa.array(names, pa.int64())], names=["n", "score", "order", "id"])

        hits = written(index.mapInArrow(search, "n long, score long, order string, id long"), "hits")
        shared.unpersist()
        found = hits if found is None else found.unionByName(hits)
    best = found.groupBy("n").agg(F.slice(F.array_sort(F.collect_list(F.struct("order", (-1 - F.col("score")).alias("back"), "id"))), 1, k).alias("best"))
    discard(rows, distinct)
    return queries.select("n", F.col("id").alias("query_id")).join(best, "n").select("query_id", F.posexplode("best").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-1 - F.col("hit.back")).alias("score"))


def _floor(x: np.ndarray, ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int) -> np.ndarray:
    """A score that each query reaches k times, from the sample."""
    out = np.full(len(x), -math.inf)
    if len(data) > k:
        for s in range(0, len(x), 256):
            scores = x[s : s + 256] @ data.T
            scores[ids[s : s + 256, None] == data_ids] = -math.inf
            out[s : s + 256] = np.partition(scores, len(data) - k, axis=1)[:, len(data) - k]
    return out


def op2_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT::DOUBLE for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5"""
