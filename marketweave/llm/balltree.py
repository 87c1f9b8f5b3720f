"""Exact top-k inner-product search with ball trees, branch and bound.

Every input partition is cut into shards of at most SHARD_ROWS vectors (fewer, if they are
wide), each indexed by a ball tree: a node has a centre c and a radius r, and no vector x
in it scores above q.c + |q| r for a query q. Nodes whose bound is below the query's
current kth score are pruned from the root down, so a whole shard may go at its root; the
leaves that remain are visited in order of their bounds, and each visit may raise the kth
score. The current kth scores are shared: they start from the best scores among SEEDS
candidates, which every task is given, and are carried from shard to shard of a group.
Only results at or above the shared score leave a task, so little is shuffled to the last
ranking.

The queries are written once to the shared folder, as files of at most QUERY_BLOCK rows. A
task holds GROUP shards with their trees and reads the blocks one after another, so a tree
is built once however many queries there are, memory is bounded by a group and a block, and
no query passes the driver. Candidates are never shuffled. Equal vectors of a shard are one
point of its tree with their smallest ids, so a vector that a third of the rows share costs
no more than one.

Scores are exact integers: components are floor(scale * x), and products are summed in
doubles only while they stay below 2**53, otherwise in Python's integers. A score that
leaves 64 bits becomes the nearest integer of 64 bits, and ranks as such.

Defined cases: rows with a null id, and vectors null, empty or with a null or
non-finite component (before or after scaling) take no part; vectors of different lengths do not meet; repeated
rows count once; a query's own id is never its result; ties go to the smaller id; fewer
than k candidates give all; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketweave.llm.common import open_store, shared_path, table

K = 5
SCALE = 256
EVERY = 50
SHARD_ROWS = 16_384
SHARD_VALUES = 2**21
GROUP = 8
QUERY_BLOCK = 4_096
SEEDS = 2_048
LEAF = 64
EXACT = 2.0**53
LEAST, MOST = -(2**63), 2**63 - 1


class BallTree:
    """Levels of nodes over the rows of points; leaves hold contiguous runs of ``order``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.spans: list[tuple[int, int]] = []
        self.kids: list[tuple[int, int] | None] = []
        centers, radii = [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node = len(self.spans)
            if parent >= 0:
                left, right = self.kids[parent]
                self.kids[parent] = (node, right) if side == 0 else (left, node)
            rows = points[self.order[a:b]]
            center = rows.mean(axis=0)
            gap = np.sqrt(((rows - center) ** 2).sum(axis=1))
            centers.append(center)
            radii.append(gap.max())
            self.spans.append((a, b))
            if b - a <= leaf or radii[-1] == 0:
                self.kids.append(None)
                continue
            self.kids.append((-1, -1))
            far = rows[gap.argmax()]
            other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
            half = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(rows @ (other - far), half)]
            todo += [(a + half, b, node, 1), (a, a + half, node, 0)]
        self.centers, self.radii = np.array(centers), np.array(radii)
        self.reach = np.sqrt((self.centers**2).sum(axis=1)) + self.radii


def _integers(block: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in block.tolist()], dtype=object)


def _products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued doubles."""
    if not len(queries) or not len(points):
        return np.zeros((len(queries), len(points)))
    if np.abs(queries).max() * np.abs(points).max() * points.shape[1] < EXACT:
        return queries @ points.T
    return np.minimum(np.maximum(_integers(queries) @ _integers(points).T, LEAST), MOST)


class Best:
    """The k best (score, id) of each query of a block so far; ``floor`` is its shared kth score."""

    def __init__(self, own: np.ndarray, floor: list, k: int):
        self.own, self.floor, self.k = own.tolist(), list(floor), k
        self.rows: list[list[tuple]] = [[] for _ in self.own]

    def offer(self, q: int, scores, ids: list[list[int]]) -> None:
        floor, own, rows = self.floor[q], self.own[q], self.rows[q]
        for s, same in zip(scores, ids):
            if floor is None or s >= floor:
                rows += [(-int(s), i) for i in same if i != own]
        if len(rows) >= self.k:
            rows[:] = sorted(set(rows))[: self.k]  # a row repeated in another shard takes no second place
        if len(rows) >= self.k:
            kth = -rows[-1][0]
            if floor is None or kth > floor:
                self.floor[q] = kth


def search(best: Best, queries: np.ndarray, points: np.ndarray, ids: list[list[int]], leaf: int = LEAF, tree: BallTree | None = None) -> int:
    """Branch and bound over one shard of distinct points; returns the (query, leaf) visits made."""
    tree = tree or BallTree(points, leaf)
    norms = np.sqrt((queries**2).sum(axis=1))

    def bound(q: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Upper bounds of pairs, with room for rounding."""
        raw = np.einsum("ij,ij->i", queries[q], tree.centers[node]) + norms[q] * tree.radii[node]
        raw = raw + 1 + 1e-9 * norms[q] * tree.reach[node]
        return np.where(np.isnan(raw), np.inf, np.maximum(raw, LEAST))  # beyond doubles nothing is known

    def open_(q: np.ndarray, b: np.ndarray) -> np.ndarray:
        floors = np.array([-np.inf if best.floor[i] is None else float(best.floor[i]) for i in q.tolist()])
        return b >= floors

    q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
    leaves_q, leaves_n, leaves_b = [], [], []
    has = np.array([k is not None for k in tree.kids])
    kids = np.array([k or (0, 0) for k in tree.kids])
    while len(q):
        parts = [(q[i : i + 65_536], node[i : i + 65_536]) for i in range(0, len(q), 65_536)]
        b = np.concatenate([bound(x, y) for x, y in parts])
        live = open_(q, b)
        q, node, b = q[live], node[live], b[live]
        inner = has[node]
        leaves_q.append(q[~inner])
        leaves_n.append(node[~inner])
        leaves_b.append(b[~inner])
        q, node = np.repeat(q[inner], 2), kids[node[inner]].ravel()
    lq, ln, lb = np.concatenate(leaves_q), np.concatenate(leaves_n), np.concatenate(leaves_b)
    by = np.lexsort((-lb, lq))
    lq, ln, lb = lq[by], ln[by], lb[by]
    turn = np.arange(len(lq)) - np.searchsorted(lq, lq)  # a leaf's place in its query's order
    visits, step = 0, 0
    while len(lq):
        width = 1 << min(step, 5)  # best leaf first, then more at a time between looks at the kth score
        now = turn < width
        use = np.flatnonzero(now)
        use = use[open_(lq[use], lb[use])]
        visits += len(use)
        for n in np.unique(ln[use]).tolist():
            who = lq[use[ln[use] == n]]
            a, b = tree.spans[n]
            rows = tree.order[a:b]
            scores = _products(queries[who], points[rows])
            top = [ids[r] for r in rows.tolist()]
            for i, line in zip(who.tolist(), scores):
                floor = best.floor[i]
                if floor is not None:
                    hit = np.flatnonzero(line >= floor)
                    best.offer(i, line[hit].tolist(), [top[h] for h in hit.tolist()])
                else:
                    best.offer(i, line.tolist(), top)
        lq, ln, lb, turn = lq[~now], ln[~now], lb[~now], turn[~now] - width
        live = open_(lq, lb)
        lq, ln, lb, turn = lq[live], ln[live], lb[live], turn[live]
        step += 1
    return visits


def _by_length(ids: list[int], vectors: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, scaled vectors) for each vector length."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    ids_ = np.array(ids, np.int64)
    for d in np.unique(sizes).tolist():
        pick = np.flatnonzero(sizes == d)
        yield ids_[pick], np.floor(flat[(ends[pick] - d)[:, None] + np.arange(d)] * scale)


def _distinct(ids: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, list[list[int]]]:
    """Distinct points and, for each, its k + 1 smallest ids (one may be the query's own)."""
    order = np.lexsort((ids, *points.T))
    ids, points = ids[order], points[order]
    first = np.concatenate([[True], (points[1:] != points[:-1]).any(axis=1)])
    starts = np.flatnonzero(first).tolist() + [len(ids)]
    return points[first], [np.unique(ids[a:b])[: k + 1].tolist() for a, b in zip(starts, starts[1:])]


def _floors(own: np.ndarray, queries: np.ndarray, k: int, ids: np.ndarray | None = None, points: np.ndarray | None = None) -> list:
    """kth scores of each query among some candidates (the queries themselves by default): a first bound to share."""
    ids, points = (own, queries) if ids is None else (ids, points)
    out, repeated = [], len(np.unique(ids)) < len(ids)
    for a in range(0, len(queries), 512):
        scores = _products(queries[a : a + 512], points)
        for i, line in enumerate(scores):
            other = ids != own[a + i]
            others = np.array(line[other])
            if repeated:  # an id counts once for each score, as in the result
                others = np.array([s for s, _ in set(zip(others.tolist(), ids[other].tolist()))])
            out.append(int(np.partition(others, len(others) - k)[len(others) - k]) if len(others) >= k else None)
    return out


def valid(rows: DataFrame, vec_id: str, embedding: str, scale: int = SCALE) -> DataFrame:
    v = F.col(embedding).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * float(scale)) < float("inf")))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0").where(finite)


def top_k(
    candidates: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k candidates of each query with the highest integer inner product."""
    spark = candidates.sparkSession
    base = valid(candidates, vec_id, embedding, scale)
    blocks = query_blocks(valid(queries, vec_id, embedding, scale), scale)
    first = base.limit(SEEDS).toArrow()
    seeds = spark.sparkContext.broadcast({p.shape[1]: _once(i, p) for i, p in _vectors(first, scale)})
    found = base.mapInArrow(searcher(blocks, seeds, k, scale), "block long, dim long, q long, query_id long, vec_id long, score long")
    w = Window.partitionBy("block", "dim", "q").orderBy(F.col("score").desc(), "vec_id")
    near = found.withColumn("place", F.dense_rank().over(w)).where(F.col("place") <= k).distinct()  # repeated rows share a place
    return near.select("query_id", F.col("place").cast("int").alias("rank"), "vec_id", "score")


def query_blocks(queries: DataFrame, scale: int) -> list[str]:
    """Write the distinct scaled queries to the shared folder; the paths of its files, QUERY_BLOCK rows in each at most."""
    y = lambda x: x * float(scale)
    whole = F.transform("v", lambda x: F.when(F.abs(y(x)) < 2.0**52, F.floor(y(x)).cast("double")).otherwise(y(x)))
    path = shared_path(queries.sparkSession, "queries")
    rows = queries.select("vec_id", whole.alias("v")).distinct()
    rows.write.option("maxRecordsPerFile", QUERY_BLOCK).parquet(path)
    return sorted(queries.sparkSession.read.schema(rows.schema).parquet(path).inputFiles())


def _vectors(rows: pa.Table, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if rows.num_rows:
        rows = rows.combine_chunks()
        yield from _by_length(rows.column(0).to_pylist(), rows.column(1).chunk(0), scale)


def _once(ids: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without repeated rows."""
    _, at = np.unique(np.column_stack([ids.view(np.float64), points]).view(np.int64), axis=0, return_index=True)
    return ids[np.sort(at)], points[np.sort(at)]


def searcher(blocks: list[str], seeds, k: int, scale: int):
    """The search of one task: its candidates in groups of shards, every block of queries against each group."""

    def read(path: str) -> pa.Table:
        store, name = open_store(path)
        return pq.read_table(name, columns=["vec_id", "v"], filesystem=store, partitioning=None)

    def indexed(rows: pa.Table) -> Iterator[tuple]:
        for ids, points in _vectors(rows, scale):
            points, names = _distinct(ids, points, k)
            yield points, names, BallTree(points)

    def against(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        for number, path in enumerate(blocks):
            for own, queries in _vectors(read(path), 1):
                dim = queries.shape[1]
                shards = [g for g in group if g[0].shape[1] == dim]
                if not shards:
                    continue
                near = seeds.value.get(dim)
                best = Best(own, _floors(own, queries, k, *near) if near else [None] * len(own), k)
                for points, names, tree in shards:
                    search(best, queries, points, names, tree=tree)
                out = [(number, dim, q, best.own[q], i, -s) for q, rows in enumerate(best.rows) for s, i in rows]
                names_ = ["block", "dim", "q", "query_id", "vec_id", "score"]
                yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in range(6)], names_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not blocks:
            return
        group: list[tuple] = []
        for rows in _shards(batches, SHARD_ROWS, SHARD_VALUES):
            group += indexed(rows)
            if len(group) >= GROUP:
                yield from against(group)
                group = []
        if group:
            yield from against(group)

    return run


def _shards(batches: Iterator[pa.RecordBatch], most_rows: int, most_values: int) -> Iterator[pa.Table]:
    """The rows in runs of at most ``most_rows`` rows and, beyond one row, ``most_values`` components."""
    held: list[pa.RecordBatch] = []
    rows = values = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        widest = int(np.diff(batch.column(1).offsets.to_numpy()).max())
        step = max(1, min(most_rows, most_values // max(1, widest)))
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            if held and (rows + part.num_rows > most_rows or values + part.num_rows * widest > most_values):
                yield pa.Table.from_batches(held)
                held, rows, values = [], 0, 0
            held.append(part)
            rows, values = rows + part.num_rows, values + part.num_rows * widest
    if held:
        yield pa.Table.from_batches(held)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0))


SQL = f"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % {EVERY} = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
