"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

The largest inner product becomes the smallest distance by one more coordinate: with M the largest norm of all, x is
(x, sqrt(M^2 - |x|^2)) and a query is (q, 0), so |q - x|^2 = |q|^2 + M^2 - 2 q.x. A node splits its vectors at the
median distance from a vantage point. With t a query's distance to its worst neighbour so far, the triangle inequality
rules out a side if the query is more than t away from the split; ``relax`` lets it rule out sides at t / relax. At
one, the search is exact; above, it visits fewer leaves and may miss neighbours.

Shards are cells around vantage points of their own, each with the radius of its ball, and the same inequality rules out
whole shards. A query first searches the shard that it is in, which bounds t, then those whose balls reach within it.
Trees and blocks of queries are files in the shared folder: what is shuffled are the vectors once, the queries, the
(shard, block) numbers and what is found. Distances only rule out; scores are sums over the original vectors, component
after component, so equal vectors have equal scores wherever they lie, and ties are never cut by distance.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import fetch, put, scratch, written

LEAF = 256
#: Rounding of a sum of products, relative to the lengths of the vectors, is far below this.
ROUNDING = 1e-11
#: Cells go to every task with their vantage points, so their bytes are bounded; larger cells are several shards.
CELL_BYTES, MAX_CELLS = 16 << 20, 4096
#: Bytes of the vectors of a shard, if its rows are not given.
SHARD_BYTES = 16 << 20
#: Stands in for the id of a neighbour that another shard has found.
ELSEWHERE = np.iinfo(np.int64).max


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the vectors that are not null or zero and have finite components only."""
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast(kind).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0) & finite)


def lifted(vectors: np.ndarray, scale: float, longest: float) -> np.ndarray:
    """Points whose distance falls as the inner product rises; ``longest`` is the largest norm of vectors over ``scale``."""
    own = vectors / scale
    return np.concatenate([own, np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", own, own), 0))[:, None]], axis=1)


def query_points(queries: np.ndarray, scale: float, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """Queries as points of norm ``longest``, and by how much more their scores are than the inner products of points.

    A factor common to all of a query's scores leaves their order as it is.
    """
    most = np.abs(queries).max(axis=1)
    unit = queries / most[:, None]
    norms = np.sqrt(np.einsum("ij,ij->i", unit, unit))
    return np.concatenate([unit * (longest / norms)[:, None], np.zeros((len(queries), 1))], axis=1), most * norms / longest * scale


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """All distances between two sets of points, never too small by more than rounding."""
    squares = np.einsum("ij,ij->i", points, points)[:, None] + np.einsum("ij,ij->i", to, to) - 2 * points @ to.T
    return np.sqrt(np.maximum(squares, 0))


def within(products: np.ndarray, longest: float) -> np.ndarray:
    """The distances of points with these inner products to a query, rounded up."""
    return np.sqrt(np.maximum((2 + 8 * ROUNDING) * longest**2 - 2 * products, 0))


class Best:
    """For each query the ``k`` best (score, id) so far: larger scores, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids, self.k = np.full((n, k), -np.inf), np.full((n, k), ELSEWHERE), k

    def add(self, query: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Rows (query, score, id) in any order."""
        rows = np.unique(query)
        query = np.concatenate([query, np.repeat(rows, self.k)])
        scores, ids = np.concatenate([scores, self.scores[rows].ravel()]), np.concatenate([ids, self.ids[rows].ravel()])
        order = np.lexsort((ids, -scores, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        first = order[place < self.k]
        self.scores[rows], self.ids[rows] = scores[first].reshape(-1, self.k), ids[first].reshape(-1, self.k)


class VantagePointTree:
    """Nodes are (vantage point, split distance, inside, outside), leaves (first row, row after the last).

    Equal vectors are one row, with their ids in ascending order.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, scale: float = 1.0, longest: float | None = None):
        distinct, which = np.unique(vectors, axis=0, return_inverse=True)
        which = which.reshape(-1)
        counts = np.bincount(which, minlength=len(distinct))
        ids = ids[np.lexsort((ids, which))]
        starts = np.cumsum(counts) - counts
        self.scale = scale
        self.longest = longest if longest is not None else float(np.sqrt(np.max(np.einsum("ij,ij->i", distinct / scale, distinct / scale))))
        points = lifted(distinct, scale, self.longest)
        rows: list[np.ndarray] = []
        at = 0

        def build(own: np.ndarray):
            nonlocal at
            if len(own) > LEAF:
                # the row farthest from the first one sees the others spread out most
                vantage = points[own[np.argmax(((points[own] - points[own[0]]) ** 2).sum(axis=1))]]
                d = np.sqrt(((points[own] - vantage) ** 2).sum(axis=1))
                split = float(np.median(d))
                inside = d <= split
                if inside.all():
                    inside = d < split
                if inside.any():
                    return vantage, float(d[inside].max()), build(own[inside]), build(own[~inside])
            rows.append(own)
            at += len(own)
            return at - len(own), at

        self.root = build(np.arange(len(points)))
        order = np.concatenate(rows)
        self.vectors, self.counts = distinct[order], counts[order]
        self.ids = np.concatenate([ids[starts[r] : starts[r] + counts[r]] for r in order.tolist()])
        self.starts = np.cumsum(self.counts) - self.counts

    def search(self, queries: np.ndarray, own: np.ndarray, best: Best, relax: float, asking: np.ndarray | None = None) -> None:
        """Put into ``best`` what the tree adds to it for the rows ``asking`` (or all) of ``queries``, but the ids in ``own`` at their place."""
        n, dim = queries.shape
        points, factor = query_points(queries, self.scale, self.longest)
        margin = ROUNDING * self.longest**2

        def worst(asking: np.ndarray) -> np.ndarray:
            """The inner products to reach."""
            return best.scores[asking, -1] / factor[asking]

        def leaf(a: int, b: int, asking: np.ndarray) -> None:
            near = points[asking, :dim] @ (self.vectors[a:b] / self.scale).T
            least = worst(asking)
            if b - a > best.k:  # one row may hold the query's own id only
                least = np.maximum(least, np.partition(near, b - a - best.k - 1, axis=1)[:, b - a - best.k - 1])
            q, r = np.nonzero(near >= (least - margin)[:, None])
            if not len(q):
                return
            q, r = asking[q], a + r
            scores = np.cumsum(queries[q] * self.vectors[r], axis=1)[:, -1]
            copies = np.minimum(self.counts[r], best.k + 1)
            place = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            ids = self.ids[np.repeat(self.starts[r], copies) + place]
            q, scores = np.repeat(q, copies), np.repeat(scores, copies)
            other = ids != own[q]
            best.add(q[other], scores[other], ids[other])

        def visit(node, asking: np.ndarray) -> None:
            if not len(asking):
                return
            if len(node) == 2:
                leaf(*node, asking)
                return
            vantage, split, inside, outside = node
            d = np.sqrt(((points[asking] - vantage) ** 2).sum(axis=1))
            inner = d <= split
            for first, second, here in ((inside, outside, inner), (outside, inside, ~inner)):
                visit(first, asking[here])
                visit(second, asking[here & (np.abs(d - split) <= within(worst(asking), self.longest) / relax)])

        with np.errstate(over="ignore", invalid="ignore"):
            visit(self.root, np.arange(n) if asking is None else asking)


def _matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    flat = table["vector"].combine_chunks() if isinstance(table, pa.Table) else table["vector"]
    return flat.flatten().to_numpy().reshape(table.num_rows, -1).astype(np.float64)


def _runs(batches, column: str):
    """Tables of the rows with equal values, of batches sorted by ``column``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch[column].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1][column][0].as_py() != values[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held and held[0].num_rows:
        yield pa.Table.from_batches(held)


FOUND = "query_id long, vec_id long, score double"


def _found(ids: np.ndarray, best: Best, rows: np.ndarray):
    query, place = np.nonzero(best.scores[rows] > -np.inf)
    query = rows[query]
    return pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(best.ids[query, place]), pa.array(best.scores[query, place])], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, relax: float = 1.0, *, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int | None = None, block_rows: int = 1024) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product, for every row of ``queries``.

    Returns query_id, rank (from 1), vec_id, score, nearest first, ties to the smaller id; a query's own id is left out.
    Vectors that are null, zero or not finite, and null ids, take no part on either side, nor do those whose length is not
    the most frequent one of ``vectors`` (the shorter of equally frequent ones), as they have no product with the others.
    Repeated rows are candidates each; a repeated query id asks as often, and the k best rows are kept of all it finds.
    Empty tables give no rows. Shards and blocks grow in number with the tables, never in size.
    """
    spark = vectors.sparkSession
    path = scratch(spark, "nearest")
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = written(usable(vectors, id_col, vector_col), f"{path}/vectors")
    lengths = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("vector", F.abs))).alias("scale"))
    common = lengths.orderBy(F.desc("n"), "dim").first()
    if common is None:
        return none
    dim, n, scale = common["dim"], common["n"], float(common["scale"])
    rows = rows.where(F.size("vector") == dim)
    own = F.col("vector").cast("array<double>")
    longest = math.sqrt(rows.agg(F.max(F.aggregate(own, F.lit(0.0), lambda s, x: s + (x / scale) * (x / scale)))).first()[0])

    # a cell's vantage point is one of the vectors, taken by the hash of its id; all others join the nearest one
    shard_rows = shard_rows or max(LEAF, SHARD_BYTES // (8 * dim + 8))
    n_cells = max(1, min(math.ceil(n / shard_rows), MAX_CELLS, CELL_BYTES // (8 * dim + 8)))
    points = lifted(_matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(n_cells).select("vector").toArrow()), scale, longest)
    cells = spark.sparkContext.broadcast(points)
    kind = rows.schema["vector"].dataType.simpleString()

    def in_cells(batches):
        at = 0
        for batch in batches:
            if batch.num_rows:
                d = distances(lifted(_matrix(batch), scale, longest), cells.value)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]), pa.array(np.arange(at, at + len(d))), batch["vec_id"], batch["vector"]], ["cell", "far", "turn", "vec_id", "vector"])
                at += len(d)

    dealt = written(rows.mapInArrow(in_cells, f"cell int, far double, turn long, vec_id long, vector {kind}"), f"{path}/cells")
    radius, size = np.zeros(len(points)), np.zeros(len(points), np.int64)
    for row in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # a row a cell
        radius[row["cell"]], size[row["cell"]] = row["far"] + 1e-6 * longest, row["n"]  # beyond what rounding does to distances
    parts = -(-size // shard_rows)
    first = np.cumsum(parts) - parts
    n_shards = int(parts.sum())
    plan = spark.sparkContext.broadcast((radius, parts, first))

    # a large cell's rows go to its shards whatever they are: by hash of their place
    numbers = F.array(*(F.lit(int(x)) for x in first)), F.array(*(F.lit(int(max(1, x))) for x in parts))
    shard = F.get(numbers[0], F.col("cell")) + F.pmod(F.xxhash64("turn"), F.get(numbers[1], F.col("cell")))

    def plant(batches):
        for table in _runs(batches, "shard"):
            tree = VantagePointTree(table["vec_id"].to_numpy(), _matrix(table), scale, longest)
            put(f"{path}/trees/{table['shard'][0].as_py()}", pickle.dumps(tree))
            yield pa.RecordBatch.from_pydict({"n": pa.array([table.num_rows], pa.int64())})

    sharded = dealt.select(shard.cast("int").alias("shard"), "vec_id", "vector").repartition(n_shards, "shard").sortWithinPartitions("shard")
    if sharded.mapInArrow(plant, "n long").agg(F.sum("n")).first()[0] != n:
        raise RuntimeError("the trees don't hold all vectors")

    # blocks of queries, those of a cell together
    def home(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_home(query_points(_matrix(batch), scale, longest)[0], cells.value, plan.value[1])), batch["vec_id"], batch["vector"]], ["home", "vec_id", "vector"])

    asked = usable(queries, id_col, vector_col).where(F.size("vector") == dim)
    asked = written(asked.mapInArrow(home, f"home int, vec_id long, vector {asked.schema['vector'].dataType.simpleString()}"), f"{path}/queries")
    n_blocks = -(-asked.count() // block_rows)
    if not n_blocks:
        return none

    def cut(batches):
        part, count = TaskContext.get().partitionId(), 0
        for table in _blocks(batches, block_rows):
            block = part << 20 | count
            count += 1
            put(f"{path}/blocks/{block}", pickle.dumps((table["home"].to_numpy(), table["vec_id"].to_numpy(), _matrix(table))))
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64())})

    blocks = written(asked.repartitionByRange(n_blocks, "home", "vec_id").sortWithinPartitions("home", "vec_id").mapInArrow(cut, "block long"), f"{path}/block-numbers")

    def at_home(batches):
        for batch in batches:
            for block in batch["block"].to_pylist():
                cell, ids, asking = pickle.loads(fetch(f"{path}/blocks/{block}"))
                best = Best(len(ids), k)
                for c in np.unique(cell).tolist():
                    if tree := _tree(f"{path}/trees/{plan.value[2][c]}"):
                        tree.search(asking, ids, best, relax, np.flatnonzero(cell == c))
                put(f"{path}/bounds/{block}", best.scores[:, -1].tobytes())
                yield _found(ids, best, np.arange(len(ids)))

    found = written(blocks.repartition(n_blocks).mapInArrow(at_home, FOUND), f"{path}/found")
    if n_shards > 1:

        def open_rows(cell, asking, bounds):
            """Which queries each cell's ball may hold a neighbour of, their home's further shards among them."""
            points, factor = query_points(asking, scale, longest)
            reach = within(bounds / factor, longest) / relax
            return distances(points, cells.value) - plan.value[0] <= reach[:, None]

        def wanted(batches):
            radius, parts, first = plan.value
            for batch in batches:
                for block in batch["block"].to_pylist():
                    cell, _, asking = pickle.loads(fetch(f"{path}/blocks/{block}"))
                    met = open_rows(cell, asking, np.frombuffer(fetch(f"{path}/bounds/{block}")))
                    for c in np.flatnonzero(met.any(axis=0)).tolist():
                        # the first shard of a cell has been asked by the queries in it
                        skip = int((met[:, c] <= (cell == c)).all())
                        for at in range(first[c] + skip, first[c] + parts[c], 10_000):
                            numbers = np.arange(at, min(at + 10_000, first[c] + parts[c]))
                            yield pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int32)), pa.array(np.full(len(numbers), block))], ["shard", "block"])

        pairs = written(blocks.repartition(n_blocks).mapInArrow(wanted, "shard int, block long"), f"{path}/pairs")
        n_pairs = pairs.count()
        # so many meetings of a tree and a block a task, but no fewer tasks than the cluster runs at once
        tasks = max(1, min(n_pairs, max(n_pairs // 64, spark.sparkContext.defaultParallelism)))

        def rest(batches):
            of, tree = None, None
            for batch in batches:
                for shard, block in zip(batch["shard"].to_pylist(), batch["block"].to_pylist(), strict=True):
                    if shard != of:
                        of, tree = shard, _tree(f"{path}/trees/{shard}")
                    cell, ids, asking = pickle.loads(fetch(f"{path}/blocks/{block}"))
                    bounds = np.frombuffer(fetch(f"{path}/bounds/{block}"))
                    c = int(np.searchsorted(plan.value[2] + plan.value[1], shard, side="right"))
                    rows = np.flatnonzero(open_rows(cell, asking, bounds)[:, c] & ~((cell == c) & (shard == plan.value[2][c])))
                    best = Best(len(ids), k)
                    best.scores[:] = bounds[:, None]  # whatever has this score goes before, as its id is smaller
                    if tree and len(rows):
                        tree.search(asking, ids, best, relax, rows)
                    best.scores[best.ids == ELSEWHERE] = -np.inf
                    yield _found(ids, best, rows)

        dealt_pairs = pairs.repartitionByRange(tasks, "shard", "block").sortWithinPartitions("shard", "block")
        found = found.unionByName(dealt_pairs.mapInArrow(rest, FOUND))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _tree(path: str) -> VantagePointTree | None:
    """A shard's tree; none where hashing left a shard without rows (that the trees hold all rows has been checked)."""
    try:
        return pickle.loads(fetch(path))
    except FileNotFoundError:
        return None


def _home(asking: np.ndarray, points: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The cell of the vantage point nearest to each query, among cells with vectors."""
    return np.where(parts > 0, distances(asking, points), np.inf).argmin(axis=1).astype(np.int32)


def _blocks(batches, rows: int):
    """Tables of at most so many rows."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            if n + part.num_rows > rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield pa.Table.from_batches(held)
