"""Operator 2: nearest neighbours by vantage-point trees per shard, behind a router of vantages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.storage import discard, written

FOUND = "query_key long, query_id long, vec_id long, score double"


@dataclass(frozen=True)
class TreePlan:
    """``factor`` relaxes pruning: a subtree or a shard is left out if its least possible distance
    exceeds ``factor`` times the distance of the k-th found so far. One is exact; less is faster.

    ``sample`` rows, and no more than ``sample_values`` components, are what the router's vantages
    are chosen from; every row is routed by it. ``shard_rows`` is what a shard holds about,
    ``leaf_rows`` what a leaf of a shard's tree and a cell of the router do, and ``query_block``
    queries are searched at a time.
    """

    k: int = 5
    factor: float = 1.0
    shard_rows: int = 2048
    leaf_rows: int = 96
    query_block: int = 256
    sample: int = 16_384
    sample_values: int = 8_000_000


#: Room for rounding where squared distances, and distances, are compared.
SLACK2, SLACK = 1e-12, 1e-6
#: Neighbours kept beyond k while a tree is searched; a query with more ties is measured against its whole shard.
SPARE = 4
#: The least rows of the sample to a cell of the router.
CELL_SAMPLE = 16


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise products summed from the first component on, the order in which SQL sums a list."""
    return np.cumsum(a * b, axis=1)[:, -1]


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between unit vectors, which order as cosines do."""
    return np.maximum(0.0, 2.0 - 2.0 * (a @ b.T))


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(dot(vectors, vectors))[:, None]


def _halves(points: np.ndarray, rows: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """A vantage among ``rows``, far from the middle so that its shells are thin, and the others: inner half, outer half, distances."""
    vantage = rows[int(squares(points[rows[:1]], points[rows])[0].argmax())]
    rest = rows[rows != vantage]
    far = np.sqrt(squares(points[[vantage]], points[rest])[0])
    order = np.argsort(far, kind="stable")
    half = len(rest) // 2
    return vantage, rest[order[:half]], rest[order[half:]], far[order]


class VantageTree:
    """A tree over unit vectors under Euclidean distance, which orders as the cosine does.

    Equal vectors are one point, so a shard full of copies neither deepens the tree nor fills
    the results; a point's ids are kept smallest first, as many as a result can show.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, plan: TreePlan):
        self.plan = plan
        self.original, place = np.unique(vectors, axis=0, return_inverse=True)
        self.norms = np.sqrt(dot(self.original, self.original))
        self.points = self.original / self.norms[:, None]
        order = np.lexsort((ids, place.ravel()))
        placed = place.ravel()[order]
        nth = np.arange(len(placed)) - np.searchsorted(placed, placed)
        few = nth <= plan.k
        self.ids, self.begin = ids[order][few], np.searchsorted(placed[few], np.arange(len(self.original) + 1))
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(self.points)))

    def _build(self, rows: np.ndarray) -> int:
        """Nodes are (vantage, inside, outside, bounds of both) or (leaf rows,); built without recursion."""
        made = len(self.nodes)
        self.nodes.append(())
        todo = [(made, rows)]
        while todo:
            at, rows = todo.pop()
            if len(rows) <= max(2, self.plan.leaf_rows):
                self.nodes[at] = (rows,)
                continue
            vantage, inner, outer, far = _halves(self.points, rows)
            children = len(self.nodes), len(self.nodes) + 1
            self.nodes += [(), ()]
            self.nodes[at] = (vantage, *children, far[0], far[len(inner) - 1], far[len(inner)], far[-1])
            todo += zip(children, (inner, outer), strict=True)
        return made

    def nearest(self, queries: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, point) that hold all of each unit vector's k + 1 nearest points within ``reach``, ties among them.

        ``reach`` is a distance beyond which a query needs nothing.
        """
        n, k, keep = len(queries), self.plan.k, self.plan.k + 1 + SPARE
        best = np.full((n, keep), np.inf)  # squared distances
        held = np.full((n, keep), -1)
        most = reach * reach

        def offer(active: np.ndarray, points: np.ndarray, far: np.ndarray) -> None:
            near = (far <= best[active, -1:]).any(axis=1)
            if not near.any():
                return
            rows = active[near]
            every = np.concatenate([best[rows], far[near]], axis=1)
            who = np.concatenate([held[rows], np.broadcast_to(points, (len(rows), len(points)))], axis=1)
            order = np.argsort(every, axis=1, kind="stable")[:, :keep]
            best[rows], held[rows] = np.take_along_axis(every, order, 1), np.take_along_axis(who, order, 1)

        stack = [(self.root, np.arange(n), np.zeros(n))]
        while stack:
            at, active, bound = stack.pop()
            left = bound <= self.plan.factor * np.sqrt(np.minimum(best[active, k], most[active])) + SLACK
            active = active[left]
            if not len(active):
                continue
            node = self.nodes[at]
            if len(node) == 1:
                if len(node[0]):
                    offer(active, node[0], squares(queries[active], self.points[node[0]]))
                continue
            vantage, inner, outer, low_in, high_in, low_out, high_out = node
            far2 = squares(queries[active], self.points[[vantage]])
            offer(active, np.array([vantage]), far2)
            far = np.sqrt(far2[:, 0])
            to_inner = np.maximum(bound[left], np.maximum(low_in - far, far - high_in))
            to_outer = np.maximum(bound[left], np.maximum(low_out - far, far - high_out))
            inner_first = to_inner <= to_outer
            for first, some in ((inner, inner_first), (outer, ~inner_first)):
                if some.any():  # the child that may hold nearer points is popped, and searched, first
                    second, near, later = (outer, to_inner, to_outer) if first == inner else (inner, to_outer, to_inner)
                    stack.append((second, active[some], later[some]))
                    stack.append((first, active[some], near[some]))
        least = np.minimum(best[:, k], most) + SLACK2
        q, slot = np.nonzero((held >= 0) & (best <= least[:, None]))
        p = held[q, slot]
        # More ties than were kept: all points of the shard that are as near.
        tied = np.flatnonzero((held[:, -1] >= 0) & (best[:, -1] <= least))
        if len(tied):
            one = ~np.isin(q, tied)
            t, points = np.nonzero(squares(queries[tied], self.points) <= least[tied, None])
            q, p = np.concatenate([q[one], tied[t]]), np.concatenate([p[one], points])
        return q, p

    def answers(self, keys: np.ndarray, ids: np.ndarray, vectors: np.ndarray, reach: np.ndarray) -> pa.RecordBatch:
        """Each query's k best ids here by the measure itself, in double precision on the vectors as given."""
        norms = np.sqrt(dot(vectors, vectors))
        q, p = self.nearest(vectors / norms[:, None], reach)
        scores = dot(self.original[p], vectors[q]) / (norms[q] * self.norms[p])
        many = self.begin[p + 1] - self.begin[p]
        row = np.repeat(np.arange(len(p)), many)
        found = self.ids[self.begin[p][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]
        q, scores = q[row], scores[row]
        other = found != ids[q]
        q, scores, found = q[other], scores[other], found[other]
        order = np.lexsort((found, -scores, q))
        q, scores, found = q[order], scores[order], found[order]
        top = np.arange(len(q)) - np.searchsorted(q, q) < self.plan.k
        q = q[top]
        return pa.RecordBatch.from_arrays([pa.array(keys[q]), pa.array(ids[q]), pa.array(found[top]), pa.array(scores[top])], ["query_key", "query_id", "vec_id", "score"])


def matrix(column: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
    """Vectors of one length as a matrix, from the column's flat values."""
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, size)


class _Shard:
    """The vectors of one shard, its tree once queries come, and the queries that wait."""

    def __init__(self, size: int, plan: TreePlan):
        self.size, self.plan, self.tree = size, plan, None
        self.ids: list[np.ndarray] = []
        self.vectors: list[np.ndarray] = []
        self.waiting: list[tuple[np.ndarray, ...]] = []

    def hold(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids.append(ids)
        self.vectors.append(vectors)

    def ask(self, *queries: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.waiting.append(queries)
        if sum(len(w[0]) for w in self.waiting) >= self.plan.query_block:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.waiting and self.ids:
            if self.tree is None:
                self.tree = VantageTree(np.concatenate(self.ids), np.concatenate(self.vectors), self.plan)
            queries = [np.concatenate(parts) for parts in zip(*self.waiting, strict=True)]
            step = self.plan.query_block
            for at in range(0, len(queries[0]), step):
                yield self.tree.answers(*(part[at : at + step] for part in queries))
        self.waiting = []


def _search(batches: Iterator[pa.RecordBatch], plan: TreePlan) -> Iterator[pa.RecordBatch]:
    """Rows of one shard after another: its vectors first (``reach`` null), then the queries that were sent to it."""
    number, shard = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        of, asks = batch["shard"].to_numpy(), batch["reach"].is_valid().to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(of)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if of[a] != number:
                if shard:
                    yield from shard.flush()
                number, shard = of[a], _Shard(len(batch["vector"][a]), plan)
            column = lambda name: batch[name].slice(a, b - a).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            ids, vectors = column("vec_id"), matrix(batch["vector"], np.arange(a, b), shard.size)
            if asks[a]:
                yield from shard.ask(column("query_key"), ids, vectors, column("reach"))
            else:
                shard.hold(ids, vectors)
    if shard:
        yield from shard.flush()


# -- routing --------------------------------------------------------------------------------


def _spread_out(points: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` of the points, each the farthest from those before it."""
    chosen, far = [0], squares(points[:1], points)[0]
    while len(chosen) < min(count, len(points)) and far.max() > SLACK2:
        chosen.append(int(far.argmax()))
        np.minimum(far, squares(points[chosen[-1:]], points)[0], out=far)
    return points[chosen]


def _tree_order(points: np.ndarray, leaf: int = 4) -> np.ndarray:
    """The points' numbers in the order of a vantage-point tree's leaves, so that neighbours stand together."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        vantage, inner, outer, _ = _halves(points, rows)
        todo += [np.append(outer, vantage), inner]
    return np.concatenate(out)


class Router:
    """Vantages that are spread over a sample; each vector is in the cell of the nearest one.

    ``low`` and ``high`` are what distances a cell's vectors have from its vantage; they bound, by
    the triangle inequality, how near to a query any of them can be.
    """

    def __init__(self, points: np.ndarray, cells: int):
        points = np.unique(points, axis=0)
        vantages = _spread_out(points, max(1, min(cells, len(points) // CELL_SAMPLE)))
        self.vantages = vantages[_tree_order(vantages)]

    def placed(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each unit vector's cell and its distance from the cell's vantage."""
        far = squares(vectors, self.vantages)
        cell = far.argmin(axis=1)
        return cell, np.sqrt(far[np.arange(len(vectors)), cell])

    def bounds(self, vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least distance that a vector of each cell may have from each of ``vectors``.

        A vector is no farther from its own vantage than from the query's, so half of what the
        query lies nearer to its own is a bound as well.
        """
        far = np.sqrt(squares(vectors, self.vantages))
        return np.maximum(np.maximum(far - high, low - far), (far - far.min(axis=1, keepdims=True)) / 2)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors of a batch, by vector length."""
    sizes = batch["vector"].value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield size, rows, units(matrix(batch["vector"], rows, size))


def _place(batches: Iterator[pa.RecordBatch], routers: dict[int, Router]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cell, far = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
        for size, rows, vectors in _by_size(batch):
            if size in routers:
                cell[rows], far[rows] = routers[size].placed(vectors)
        yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["vector"], batch["asks"], pa.array(cell), pa.array(far)], ["vec_id", "vector", "asks", "cell", "far"])


def _route(batches: Iterator[pa.RecordBatch], routers: dict[int, Router], spans: dict[int, tuple[np.ndarray, ...]], factor: float, block: int) -> Iterator[pa.RecordBatch]:
    """Queries with every group but their own that has a cell that may hold something within their reach."""
    for whole in batches:
        for at in range(0, whole.num_rows, block):
            batch = whole.slice(at, block)
            for size, rows, vectors in _by_size(batch):
                if size not in routers:
                    continue
                reach = batch["reach"].to_numpy(zero_copy_only=False)[rows]
                low, high, begin = spans[size]
                near = routers[size].bounds(vectors, low, high) <= factor * reach[:, None] + SLACK
                near = np.logical_or.reduceat(near, begin, axis=1)
                near[np.arange(len(rows)), batch["group"].to_numpy()[rows]] = False
                q, group = np.nonzero(near)
                if len(q):
                    some = batch.take(pa.array(rows[q]))
                    yield pa.RecordBatch.from_arrays([some["query_key"], some["vec_id"], some["vector"], some["reach"], pa.array(group.astype(np.int64))], ["query_key", "vec_id", "vector", "reach", "group"])


def usable(vector: Column) -> Column:
    """Neither null, empty or zero, nor with null or non-finite components: the squares' sum is positive and finite."""
    square = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x)
    return F.coalesce((square > 0) & (square < float("inf")), F.lit(False))


def _routers(kept: DataFrame, plan: TreePlan) -> dict[int, Router]:
    """A router per vector length, from the bounded sample (smallest digests first)."""
    sizes = kept.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(64).collect()
    out = {}
    for s in sizes:
        if s.n > plan.shard_rows:
            most = max(CELL_SAMPLE, min(plan.sample, plan.sample_values // s.size))
            sampled = kept.where(F.size("vector") == s.size).select("vector", F.xxhash64("vec_id", "vector").alias("spread")).orderBy("spread").limit(most).select("vector")
            vectors = sampled.toArrow()["vector"].combine_chunks()
            out[s.size] = Router(units(matrix(vectors, np.arange(len(vectors)), s.size)), -(-s.n // plan.leaf_rows))
    return out


def _grouped(counts: np.ndarray, most: int) -> np.ndarray:
    """The group of each cell: neighbours together, up to ``most`` rows; a larger cell is one alone."""
    groups, at, held = np.zeros(len(counts), np.int64), 0, 0
    for i, n in enumerate(counts.tolist()):
        if i and held + n > most:
            at, held = at + 1, 0
        groups[i] = at
        held += n
    return groups


def nearest(vectors: DataFrame, is_query: Column, plan: TreePlan = TreePlan(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (cosine): each query's ``k`` nearest other rows.

    Vantages from a bounded sample route every row to a cell; neighbouring cells make up a shard,
    a cell of more than ``shard_rows``, copies included, several, and each shard builds its
    vantage-point tree. A query is searched in its own shard first; its k-th distance there is
    its reach, and it goes on to those shards alone that have a cell which the triangle
    inequality lets come within ``factor`` times that. Each query's best per shard are ranked at
    last. A task holds one shard's tree and a block of queries; the vantages and the cells'
    bounds are of the sample's size.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor
    do rows without an id. Vectors of another length than a query's are no candidates for it
    (beyond the 64 commonest lengths, those of one length are one cell). Rows of one id are never
    each other's candidates; exact repeats of a row count once. Ties, however many, go to the
    smaller id. An empty table gives no rows; other columns are ignored.
    """
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    kept = written(given.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).distinct(), "vectors")
    routers = _routers(kept, plan)
    placed = written(kept.mapInArrow(lambda batches: _place(batches, routers), "vec_id long, vector array<double>, asks boolean, cell long, far double"), "vectors-placed")
    discard(kept)
    size = F.size("vector").alias("size")
    by_size: dict[int, list] = {}
    for row in placed.groupBy(size, "cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect():
        by_size.setdefault(row["size"], []).append(row)
    first, of_cell, of_group, spans = 0, [], [], {}
    for s, own in by_size.items():
        counts = np.zeros(len(routers[s].vantages) if s in routers else 1, np.int64)
        low, high = np.full(len(counts), np.inf), np.full(len(counts), -np.inf)  # no vector, never near
        for r in own:
            counts[r.cell], low[r.cell], high[r.cell] = r.n, r.low, r.high
        group = _grouped(counts, plan.shard_rows)
        of_cell += [(s, cell, g) for cell, g in enumerate(group.tolist())]
        for g, held in enumerate(np.bincount(group, counts).astype(np.int64).tolist()):
            parts = max(1, -(-held // plan.shard_rows))
            of_group.append((s, g, first, parts))
            first += parts
        spans[s] = low, high, np.searchsorted(group, np.arange(group[-1] + 1))
    small = lambda rows, columns: F.broadcast(vectors.sparkSession.createDataFrame(rows, columns).coalesce(1))
    groups, numbers = small(of_cell, "size int, cell long, group long"), small(of_group, "size int, group long, first long, parts long")

    grouped = placed.drop("far").withColumn("size", size).join(groups, ["size", "cell"])
    rows = grouped.join(numbers, ["size", "group"]).select((F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("shard"), "vec_id", "vector")

    def searched(asked: DataFrame) -> DataFrame:
        """(query_key, vec_id, vector, reach, group) to what each shard of those groups holds nearest."""
        sent = asked.withColumn("size", size).join(numbers, ["size", "group"])
        sent = sent.withColumn("part", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1))).select(F.col("part").cast("int").alias("shard"), "vec_id", "vector", "query_key", "reach")
        # Shards that nothing was sent to are not moved.
        used = rows.join(sent.select("shard").distinct(), "shard", "left_semi")
        both = used.unionByName(sent, allowMissingColumns=True).repartitionById(max(1, first), "shard")
        return both.sortWithinPartitions("shard", F.col("reach").isNotNull()).mapInArrow(lambda batches: _search(batches, plan), FOUND)

    best = Window.partitionBy("query_key", "query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= plan.k)
    asked = grouped.where("asks").select(F.xxhash64("vec_id", "vector").alias("query_key"), "vec_id", "vector", "group")
    home = written(ranked(searched(asked.withColumn("reach", F.lit(float("inf"))))), "vectors-home")
    found = home.drop("rank")
    if routers:
        reach = home.where(F.col("rank") == plan.k).select("query_key", F.col("query_id").alias("vec_id"), F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * F.col("score"))).alias("reach"))
        onward = asked.join(reach, ["query_key", "vec_id"], "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
        onward = written(onward.mapInArrow(lambda batches: _route(batches, routers, spans, plan.factor, plan.query_block), "query_key long, vec_id long, vector array<double>, reach double, group long"), "vectors-onward")
        found = found.unionByName(searched(onward))
    return ranked(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
