"""Exact top-k search by inner product: M-trees over cells of near rows, searched best first; bounds pass from cell to cell."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelark.llm.storage import written

RESULT = "query_id long, vec_id long, score long"


class MTree:
    """A paged M-tree over integer vectors.

    Inner products become distances by one more coordinate, sqrt(bound - |v|^2): a query has 0 there, so
    |q' - v'|^2 = |q|^2 + bound - 2 q.v and the nearest rows are those of the highest inner product. Each node
    keeps a pivot, its covering radius and the distance to its parent's pivot; each row the distance to its
    leaf's pivot. Rows of a leaf are adjacent (one page).
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, page: int = 256, fanout: int = 16):
        squares = (rows.astype(np.float64) ** 2).sum(1)
        self.bound = float(squares.max(initial=0.0))
        lift = np.sqrt(self.bound - squares)
        points = np.column_stack([rows.astype(np.float64), lift])
        self.pivots: list[np.ndarray] = []
        self.radius: list[float] = []
        self.to_parent: list[float] = []
        self.children: list[list[int]] = []
        self.span: list[tuple[int, int]] = []
        order: list[np.ndarray] = []
        to_pivot: list[np.ndarray] = []
        random, placed = np.random.Generator(np.random.PCG64(len(ids))), 0
        root = self._node(points.mean(0), 0.0)
        work = [(root, np.arange(len(ids)))]
        while work:
            node, own = work.pop()
            far = np.sqrt(((points[own] - self.pivots[node]) ** 2).sum(1))
            self.radius[node] = float(far.max(initial=0.0))
            if len(own) <= page:
                self.span[node] = (placed, placed + len(own))
                order.append(own)
                to_pivot.append(far)
                placed += len(own)
                continue
            k = min(fanout, -(-len(own) // page))
            pivots = points[own[random.choice(len(own), k, replace=False)]]
            near = ((pivots**2).sum(1)[None, :] - 2.0 * points[own] @ pivots.T).argmin(1)
            parts = [own[near == j] for j in range(k)]
            if max(map(len, parts)) == len(own):  # equal vectors: pages of the same place
                parts = np.array_split(own, k)
                pivots = points[[p[0] for p in parts]]
            for pivot, part in zip(pivots, parts, strict=True):
                if len(part):
                    child = self._node(pivot, float(np.sqrt(((pivot - self.pivots[node]) ** 2).sum())))
                    self.children[node].append(child)
                    work.append((child, part))
        at = np.concatenate(order) if order else np.zeros(0, np.int64)
        # Sums below 2^53 are whole in doubles, whose products are faster.
        self.ids, self.rows = ids[at], rows[at].astype(np.float64 if self.bound < 2.0**52 else np.int64)
        self.to_pivot = np.concatenate(to_pivot) if to_pivot else np.zeros(0)
        self.pivots, self.radius, self.to_parent = np.array(self.pivots), np.array(self.radius), np.array(self.to_parent)

    def _node(self, pivot: np.ndarray, to_parent: float) -> int:
        self.pivots.append(pivot)
        self.radius.append(0.0)
        self.to_parent.append(to_parent)
        self.children.append([])
        self.span.append((0, 0))
        return len(self.pivots) - 1

    def search(self, query_id: int, query: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """The k highest scores of rows other than ``query_id``, ties to smaller ids: (ids, scores).

        Rows that score below ``least`` may be left out.
        """
        point = np.append(query.astype(np.float64), 0.0)
        base = float((point**2).sum()) + self.bound
        slack = 1e-6 * (1.0 + np.sqrt(base))
        doubles = base < 2.0**53
        rows, asked = (self.rows, query.astype(np.float64)) if doubles else (self.rows.astype(np.int64), query)
        floor = least if doubles else -np.inf
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        reach = np.sqrt(max(0.0, base - 2.0 * least)) + slack
        first = float(np.sqrt(((self.pivots[0] - point) ** 2).sum()))
        queue = [(max(0.0, first - self.radius[0]), 0, first)]
        while queue:
            low, node, far = heapq.heappop(queue)
            if low > reach:
                break
            if self.children[node]:
                kids = np.array(self.children[node])
                # The triangle inequality over the stored parent distance spares most pivots their distance.
                kids = kids[np.abs(far - self.to_parent[kids]) - self.radius[kids] <= reach]
                d = np.sqrt(((self.pivots[kids] - point) ** 2).sum(1))
                for child, x in zip(kids.tolist(), d.tolist(), strict=True):
                    low = max(0.0, x - self.radius[child])
                    if low <= reach:
                        heapq.heappush(queue, (low, child, x))
                continue
            a, b = self.span[node]
            keep = np.flatnonzero((np.abs(far - self.to_pivot[a:b]) <= reach) & (self.ids[a:b] != query_id)) + a
            scores = rows[keep] @ asked
            better = np.flatnonzero(scores >= floor)
            if len(better):
                best_ids = np.concatenate([best_ids, self.ids[keep[better]]])
                best = np.concatenate([best, scores[better].astype(np.int64)])
                top = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[top], best[top]
                if len(best) == k:
                    floor = max(floor, float(best[-1])) if doubles else floor
                    reach = min(reach, np.sqrt(max(0.0, base - 2.0 * float(best[-1]))) + slack)
        return best_ids, best


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and ``v``, floor(1024 x) of each component as a long; vectors that are null or hold null or non-finite
    components take no part, nor do rows without an id. Empty vectors are candidates of each other, with score 0."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    odd = F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return x.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~odd).select("vec_id", F.transform("e", lambda c: F.floor(c * 1024).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), len(flat) // max(1, len(values)))


class Cells:
    """Pivots that deal vectors of their length to cells, and what bounds the scores inside a cell.

    Vectors of a length that no pivot has are in cell -1, of which nothing is known.
    """

    def __init__(self, pivots: list[list[int]]):
        self.of_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in {len(p) for p in pivots}:
            at = [i for i, p in enumerate(pivots) if len(p) == dim]
            self.of_dim[dim] = np.array(at), np.array([pivots[i] for i in at], np.float64).reshape(len(at), dim)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row and its distance to the cell's pivot."""
        if rows.shape[1] not in self.of_dim:
            return np.full(len(rows), -1, np.int32), np.zeros(len(rows))
        at, pivots = self.of_dim[rows.shape[1]]
        near = ((pivots**2).sum(1)[None, :] - 2.0 * rows @ pivots.T).argmin(1)
        return at[near].astype(np.int32), np.sqrt(((rows - pivots[near]) ** 2).sum(1))

    def within(self, query: np.ndarray, least: float, radius: dict[int, float], square: dict[int, float]) -> np.ndarray:
        """The cells that may hold a score of ``least`` or more.

        For a row v no farther than r from pivot p: q.v <= q.p + |q| r, and 2 q.v <= |q|^2 + |v|^2 - (|q - p| - r)^2.
        """
        if len(query) not in self.of_dim:
            return np.full(1, -1, np.int32)
        at, pivots = self.of_dim[len(query)]
        r = np.array([radius.get(i, 0.0) for i in at.tolist()])
        top = np.array([square.get(i, 0.0) for i in at.tolist()])
        own = float((query**2).sum())
        apart = np.maximum(0.0, np.sqrt(((pivots - query) ** 2).sum(1)) - r)
        most = np.minimum(pivots @ query + np.sqrt(own) * r, (own + top - apart**2) / 2.0)
        filled = np.array([i in radius for i in at.tolist()])
        return at[filled & (most >= least - 1e-6 * (1.0 + own + top))].astype(np.int32)


def _placed(vectors: DataFrame, cells: Cells) -> DataFrame:
    """Adds dim, cell, far (distance to the cell's pivot) and square (of the vector's length)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pc.list_value_length(batch["v"]).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                rows = _matrix(part["v"]).astype(np.float64)
                cell, far = cells.nearest(rows)
                new = [pa.array(np.full(len(cell), dim, np.int32)), pa.array(cell), pa.array(far), pa.array((rows**2).sum(1))]
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["v"], *new], ["vec_id", "v", "dim", "cell", "far", "square"])

    return vectors.select("vec_id", "v").mapInArrow(place, "vec_id long, v array<long>, dim int, cell int, far double, square double")


def _other_cells(asked: DataFrame, cells: Cells, radius: dict[int, float], square: dict[int, float]) -> DataFrame:
    """For each query (vec_id, v, dim, home, least) the other cells that may hold a score of ``least`` or more."""

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, (v, home, least) in enumerate(zip(batch["v"], batch["home"].to_pylist(), batch["least"].to_pylist(), strict=True)):
                query = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                there = cells.within(query, -np.inf if least is None else float(least), radius, square)
                there = there[there != home]
                at.append(np.full(len(there), i))
                found.append(there)
            part = batch.take(pa.array(np.concatenate(at).astype(np.int64) if at else np.zeros(0, np.int64)))
            cell = pa.array(np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([part["vec_id"], part["v"], part["dim"], cell, part["least"]], ["vec_id", "v", "dim", "cell", "least"])

    return asked.select("vec_id", "v", "dim", "home", "least").mapInArrow(reach, "vec_id long, v array<long>, dim int, cell int, least long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, tree_rows: int = 8192, block_rows: int = 2048, most_cells: int = 1024, cell_rows: int = 1024) -> DataFrame:
    """Each query's ``k`` rows of ``vectors`` with the highest integer inner product, ties to smaller ids.

    Both have columns vec_id and v (array<long>); rows with the query's own vec_id are no candidates, and only
    vectors of the query's length are. Exact: bounds by the triangle inequality alone spare work, with a slack for
    rounding, and scores are integer products.

    Rows are dealt to the nearest of at most ``most_cells`` pivots (one for each ``cell_rows`` rows, those with the
    lowest hashes of vec_id); a cell of more than ``tree_rows`` rows is split by hash into trees of about so many, so
    a vector that many rows share spreads like any other. Trees are built where their rows are and kept as binary
    pages. A query first searches its own cell; its k-th score there then names the other cells that may hold
    better rows, and only to these it is sent. A cell's queries are searched in blocks of about ``block_rows``. What the
    driver holds is bounded: the pivots and three numbers a cell. Repeated rows are candidates each. Repeated query
    ids with one vector count once. Empty inputs give an empty result.

    Returns query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    wanted = max(1, min(most_cells, vectors.count() // cell_rows))
    pivots = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(wanted).select("v").collect()
    cells = Cells([r["v"] for r in pivots])
    placed = _placed(vectors, cells)
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("square").alias("square")).collect()
    radius = {r["cell"]: r["far"] for r in stats}
    square = {r["cell"]: r["square"] for r in stats}
    trees = spark.createDataFrame([(r["cell"], -(-r["n"] // tree_rows)) for r in stats], "cell int, trees int")

    def build(table: pa.Table) -> pa.Table:
        tree = MTree(table["vec_id"].to_numpy(), _matrix(table["v"]))
        named = {c: table[c][:1].cast(pa.int32()) for c in ("cell", "tree", "dim")}
        return pa.table({**named, "pages": pa.array([pickle.dumps(tree, 5)], pa.binary())})

    def search(index: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if index.num_rows and asked.num_rows:
            tree = pickle.loads(index["pages"][0].as_py())
            for query_id, v, least in zip(asked["vec_id"].to_pylist(), _matrix(asked["v"]), asked["least"].to_pylist(), strict=True):
                ids, scores = tree.search(query_id, v, k, -np.inf if least is None else float(least))
                found.append((np.full(len(ids), query_id), ids, scores))
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    dealt = placed.join(F.broadcast(trees), "cell").withColumn("tree", F.pmod(F.xxhash64("vec_id"), "trees").cast("int"))
    index = written(dealt.groupBy("cell", "tree", "dim").applyInArrow(build, "cell int, tree int, dim int, pages binary"), "metric-trees")

    def best(asked: DataFrame) -> DataFrame:
        """Each query's k best in the trees of the cells it is sent to."""
        blocks = F.broadcast(asked.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).alias("blocks")))
        copies = index.join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        sent = asked.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks")).join(F.broadcast(trees), "cell")
        sent = sent.withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1))).select("cell", "tree", "dim", "block", "vec_id", "v", "least")
        on = ("cell", "tree", "dim", "block")
        return _ranked(copies.groupBy(*on).cogroup(sent.groupBy(*on)).applyInArrow(search, RESULT), k)

    asked = written(_placed(queries.dropDuplicates(["vec_id", "v"]), cells).select("vec_id", "v", "dim", "cell"), "top-k-queries")
    first = written(best(asked.withColumn("least", F.lit(None).cast("long"))), "top-k-own-cell")
    known = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    others = _other_cells(asked.withColumnRenamed("cell", "home").join(known, "vec_id", "left"), cells, radius, square)
    second = best(written(others, "top-k-other-cells"))
    both = first.select("query_id", "vec_id", "score").unionByName(second.select("query_id", "vec_id", "score"))
    return _ranked(both, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def op10_topk_search(spark, sf_dir: str) -> DataFrame:
    """Queries: embeddings whose vec_id is divisible by 100; candidates: every row but the query's own."""
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
