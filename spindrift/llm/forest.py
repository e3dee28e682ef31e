"""Approximate nearest neighbours with a forest of random-projection trees."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm.cosine import usable
from spindrift.llm.shared import materialize, table

#: Trees, and rows that a leaf should hold on average.
TREES = 4
LEAF = 200
#: Leaves that a small table is split in all the same.
LEAVES = 64
#: The trees are fitted on at most this many vectors and bytes of them.
SAMPLE = 20_000
SAMPLE_BYTES = 32 << 20
#: Share of all rows that a query examines, over all trees. Vectors without
#: structure need this much for a recall of 0.9.
SHARE = 1.2
#: Rows of a leaf, and queries, that one task holds at a time.
CELL_ROWS = 4096
CELL_QUERIES = 1 << 16
#: Queries whose best rows a task keeps before it sends them on.
HELD = 50_000


class Forest:
    """Trees that halve a sample by projections onto random directions.

    A direction joins two points drawn at random, each moved a few times to
    the mean of the sample points nearer to it. ``directions[t][n]`` and
    ``cuts[t][n]`` split node ``n`` of tree ``t``; ``children`` are nodes, or
    leaves as ``-1 - leaf``.
    """

    def __init__(self, sample: np.ndarray, leaves: int, trees: int = TREES, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.trees = [self._grow(sample, max(1, leaves), rng) for _ in range(trees)]

    @staticmethod
    def _grow(x: np.ndarray, leaves: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        limit = max(1, len(x) // leaves)
        directions, cuts, children = [], [], []
        count = 0
        todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(x)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            node = None
            if len(rows) > limit and len(rows) > 1:
                a, b = x[rng.choice(rows, 2, replace=False)]
                near = x[rng.choice(rows, min(len(rows), 400), replace=False)]
                for _ in range(4):
                    closer = near @ (a - b) > (a @ a - b @ b) / 2
                    if closer.all() or not closer.any():
                        break
                    a, b = near[closer].mean(0), near[~closer].mean(0)
                w = a - b
                w = w / np.linalg.norm(w) if np.linalg.norm(w) > 1e-12 else rng.normal(size=x.shape[1]) / math.sqrt(x.shape[1])
                p = x[rows] @ w
                cut = float(np.median(p))
                if (p < cut).any() and (p >= cut).any():
                    node = len(directions)
                    directions.append(w)
                    cuts.append(cut)
                    children.append([0, 0])
                    todo += [(rows[p >= cut], node, 1), (rows[p < cut], node, 0)]
            if node is None:
                node = -1 - count
                count += 1
            if parent >= 0:
                children[parent][side] = node
        width = x.shape[1]
        return np.array(directions).reshape(-1, width), np.array(cuts), np.array(children, np.int64).reshape(-1, 2), count

    @property
    def leaves(self) -> list[int]:
        return [t[3] for t in self.trees]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by tree."""
        out = np.zeros((len(x), len(self.trees)), np.int64)
        for t, (directions, cuts, children, _) in enumerate(self.trees):
            node = np.zeros(len(x), np.int64) if len(directions) else np.full(len(x), -1)
            while len(at := np.nonzero(node >= 0)[0]):
                n = node[at]
                node[at] = children[n, (np.einsum("ij,ij->i", x[at], directions[n]) >= cuts[n]).astype(int)]
            out[:, t] = -1 - node
        return out

    def search(self, x: np.ndarray, sizes: np.ndarray, budget: float) -> list[np.ndarray]:
        """Leaves, of all trees in one numbering, that each query visits.

        All trees share one priority queue, which begins with their roots. Its
        key is the squared distance by which the path to a node is on the wrong
        side of the cuts. The node with the least key leaves the queue: an inner node
        puts its two children there, a leaf is visited. A query is through when
        its leaves hold ``budget`` rows, and no more nodes are looked at.
        """
        gaps = [(x @ directions.T - cuts).tolist() for directions, cuts, _, _ in self.trees]
        children = [c.tolist() for _, _, c, _ in self.trees]
        starts = np.r_[0, np.cumsum(self.leaves)].tolist()
        rows = sizes.tolist()
        pop, push = heapq.heappop, heapq.heappush
        out = []
        for i in range(len(x)):
            queue = [(0.0, t, 0 if children[t] else -1) for t in range(len(self.trees))]
            held, visited = 0.0, []
            while queue and held < budget:
                key, t, node = pop(queue)
                if node < 0:
                    leaf = starts[t] - 1 - node
                    visited.append(leaf)
                    held += rows[leaf]
                    continue
                gap = gaps[t][i][node]
                left, right = children[t][node]
                far = key + gap * gap
                push(queue, (far if gap >= 0 else key, t, left))
                push(queue, (key if gap >= 0 else far, t, right))
            out.append(np.array(visited, np.int64))
        return out


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(float)


def _lift(x: np.ndarray, longest: float) -> np.ndarray:
    """One more part makes all rows equally long, so the largest inner product is the nearest."""
    x = x / longest
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", x, x)))[:, None]], axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))], axis=1)


def _nearest(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` rows of ``x`` with the largest products with each row of ``q``, and these; ties go to the first.

    The matrix product only chooses what is scored exactly: so many rows more
    than ``k`` that all within its rounding error of the last one are among them.
    """
    rough = q @ x.T
    n = rough.shape[1]
    error = 1e-14 * q.shape[1] * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
    more = k + 4
    while True:
        m = min(n, more)
        chosen = np.sort(np.argpartition(-rough, m - 1, axis=1)[:, :m], axis=1)
        values = -np.sort(-np.take_along_axis(rough, chosen, axis=1), axis=1)
        if m == n or (values[:, -1] < values[:, min(k, m) - 1] - 2 * error).all():
            break
        more *= 4
    exact = np.einsum("ijk,ik->ij", x[chosen], q)
    order = np.argsort(-exact, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(chosen, order, axis=1), np.take_along_axis(exact, order, axis=1)


class Best:
    """The best rows so far of each query that a task has met."""

    def __init__(self, k: int):
        self.k = k
        self.slot: dict[int, int] = {}
        self.scores, self.reps = np.full((0, k), -np.inf), np.full((0, k), -1)

    def add(self, queries: np.ndarray, q: np.ndarray, reps: np.ndarray, x: np.ndarray) -> None:
        at = np.array([self.slot.setdefault(i, len(self.slot)) for i in queries.tolist()])
        if (lack := len(self.slot) - len(self.scores)) > 0:
            more = max(lack, len(self.scores))
            self.scores = np.concatenate([self.scores, np.full((more, self.k), -np.inf)])
            self.reps = np.concatenate([self.reps, np.full((more, self.k), -1)])
        own = np.arange(len(q))[:, None]
        near, exact = _nearest(q, x, self.k)
        found = reps[near]
        known = (found[:, :, None] == self.reps[at][:, None, :]).any(axis=2)
        scores = np.concatenate([self.scores[at], np.where(known, -np.inf, exact)], axis=1)
        both = np.concatenate([self.reps[at], found], axis=1)
        by_rep = np.argsort(both, axis=1, kind="stable")
        order = by_rep[own, np.argsort(-scores[own, by_rep], axis=1, kind="stable")][:, : self.k]
        self.scores[at], self.reps[at] = scores[own, order], both[own, order]

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.slot:
            n = len(self.slot)
            queries = np.repeat(np.fromiter(self.slot, np.int64, n), self.k)
            scores, reps = self.scores[:n].ravel(), self.reps[:n].ravel()
            ok = scores > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(queries[ok]), pa.array(reps[ok]), pa.array(scores[ok])], names=["q", "rep", "score"])
        self.__init__(self.k)


def _rerank(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Score the queries of each cell against its rows, which come before them."""
    best = Best(k)
    cell = None
    reps: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cells, kind, ids = (batch.column(c).to_numpy() for c in ("cell", "kind", "id"))
        x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        cuts = np.r_[0, np.nonzero((cells[1:] != cells[:-1]) | (kind[1:] != kind[:-1]))[0] + 1, len(cells)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if cells[lo] != cell:
                cell, reps, rows = cells[lo], [], []
            if kind[lo] == 0:
                reps.append(ids[lo:hi])
                rows.append(x[lo:hi])
            elif rows:
                if len(rows) > 1:
                    reps, rows = [np.concatenate(reps)], [np.concatenate(rows)]
                for a in range(lo, hi, 128):
                    b = min(hi, a + 128)
                    best.add(ids[a:b], x[a:b], reps[0], rows[0])
                if len(best.slot) > HELD:
                    yield from best.flush()
    yield from best.flush()


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", share: float = SHARE, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows found for each query.

    Queries are the rows whose id is divisible by ``every``, candidates all
    rows but a query's own, and ``score`` is the inner product in double
    precision. Equal scores go to the smaller id; with fewer candidates than
    ``k`` all are returned. The trees are fitted on a bounded sample and index
    every row. Equal vectors are searched once, with the ids of the first
    ``k + 1`` of them, which are all that can be among the nearest.

    Null, zero and non-finite vectors and null ids take no part. Vectors of
    different lengths have no product and are searched apart. Repeated rows count once; an id with several
    vectors stands for each of them and never answers itself. An empty table
    gives an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    first = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    few = rows.withColumn("nth", first).where(F.col("nth") <= k + 1)
    nodes, _ = materialize(few.groupBy("v").agg(F.min("id").alias("rep"), F.array_sort(F.collect_set("id")).alias("ids")), "vectors")
    answers = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    widths = sorted(r["width"] for r in nodes.select(F.size("v").alias("width")).distinct().collect())
    for width in widths:
        alike = F.size("v") == width
        found = _search(rows.where(alike), nodes.where(alike), width, k, every, share, trees, leaf)
        answers = found if len(widths) == 1 else answers.unionByName(found)
    return answers


def _search(rows: DataFrame, nodes: DataFrame, width: int, k: int, every: int, share: float, trees: int, leaf: int) -> DataFrame:
    """``nearest`` over vectors of one length; ``nodes(v, rep, ids)`` are the distinct ones."""
    spark = rows.sparkSession
    largest = F.array_max(F.transform("v", F.abs))  # taken out, so that squares do not overflow
    norm = largest * F.sqrt(F.aggregate(F.transform("v", lambda y: y / largest), F.lit(0.0), lambda s, y: s + y * y))
    count, longest = nodes.agg(F.count(F.lit(1)), F.max(norm)).first()
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * (width + 1))))
    order = F.xxhash64("rep")
    likely = nodes.where(F.pmod(order, F.lit(1 << 20)) < (1 << 20) * min(1.0, (2.0 * most + 1000) / count))
    sample = np.array([r["v"] for r in likely.orderBy(order, "rep").limit(most).select("v").collect()], float)
    forest = Forest(_lift(sample, longest), leaves=max(1, min(max(count // leaf, LEAVES), len(sample) // 8)), trees=trees)
    starts = np.r_[0, np.cumsum(forest.leaves)]
    sent = spark.sparkContext.broadcast(forest)

    @F.pandas_udf("array<long>")
    def leaves_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(list(sent.value.assign(_lift(_matrix(x), longest)) + starts[:-1]))

    indexed = nodes.select("rep", "v", F.explode(leaves_of("v")).alias("leaf"))
    # as many rows as the forest has leaves, whose number the sample bounds
    sizes = np.zeros(int(starts[-1]))
    for r in indexed.groupBy("leaf").count().collect():
        sizes[r["leaf"]] = r["count"]
    asked, _ = materialize(rows.where(F.col("id") % every == 0).distinct().join(nodes.select("v", "rep"), "v").select(F.col("id").alias("query_id"), F.col("rep").alias("q")), "queries")
    queries = nodes.join(asked.select("q").distinct(), nodes.rep == F.col("q"), "leftsemi").select("rep", "v")
    parts = np.maximum(1, np.ceil(sizes / CELL_ROWS)).astype(np.int64)
    groups = max(1, math.ceil(asked.count() / CELL_QUERIES))

    @F.pandas_udf("array<long>")
    def visits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            out = []
            for lo in range(0, len(x), 256):
                for chosen in sent.value.search(_unit(_matrix(x.iloc[lo : lo + 256])), sizes, share * count):
                    out.append(np.concatenate([leaf * (1 << 20) + np.arange(parts[leaf]) for leaf in chosen]))
            yield pd.Series(out)

    part = F.pmod(F.xxhash64("rep"), F.element_at(F.lit(parts.tolist()), (F.col("leaf") + 1).cast("int")))
    base = F.col("leaf") * (1 << 20) + part
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    cells = indexed.select(base.alias("base"), every_group.alias("group"), F.lit(0).alias("kind"), F.col("rep").alias("id"), "v").unionByName(
        queries.select(F.explode(visits("v")).alias("base"), F.pmod(F.xxhash64("rep"), F.lit(groups)).cast("int").alias("group"), F.lit(1).alias("kind"), F.col("rep").alias("id"), "v")
    )
    cells = cells.select((F.col("base") * groups + F.col("group")).alias("cell"), "kind", "id", "v")
    dealt = cells.repartition("cell").sortWithinPartitions("cell", "kind", "id")
    found = dealt.mapInArrow(lambda it: _rerank(it, k + 1), "q long, rep long, score double")
    top = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    best = found.groupBy("q", "rep").agg(F.max("score").alias("score")).withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= k + 1)
    answers = best.join(nodes.select(F.col("rep").alias("n_rep"), "ids"), F.col("rep") == F.col("n_rep"))
    # at most (k + 1) ** 2 ids for a query
    listed = answers.select("q", F.explode("ids").alias("vec_id"), "score").groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("answers"))
    lists, _ = materialize(listed.select("q", F.slice("answers", 1, 2 * k + 2).alias("answers")), "answers")
    own = asked.join(lists, "q").select("query_id", F.slice(F.filter("answers", lambda a: a["vec_id"] != F.col("query_id")), 1, k).alias("answers"))
    return own.select("query_id", F.posexplode("answers").alias("pos", "a")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("a.vec_id").alias("vec_id"), (-F.col("a.minus")).alias("score")
    )


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
