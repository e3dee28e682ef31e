"""Embedding near-dedup by random-hyperplane hashing with exact verification."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.graph import connected_components
from spindrift.llm.shared import materialize, table
from spindrift.llm.simhash import _forest

#: Rows that a bucket should hold on average; sets the bits of a table's key.
BUCKET = 256
#: Probability with which a pair just at the threshold shares a bucket.
RECALL = 0.999
#: A bucket larger than this is split over several cells.
CELL = 2048


def plan_tables(rows: int, threshold: float, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """Bits of a key, and tables needed for ``recall`` at the threshold."""
    bits = max(8, math.ceil(math.log2(max(rows, 1) / bucket)) if rows > bucket else 8)
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null or non-finite part, not all zero."""
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(rep, copies, v)``: usable vectors once each, with their smallest id.

    Copies are counted by a partially aggregated group on the vector itself,
    so a vector with very many copies is one row a task.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    return rows.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))


@functools.lru_cache(maxsize=2)
def _hyperplanes(width: int, bits: int, tables: int) -> np.ndarray:
    return np.rint(np.random.default_rng(17).normal(size=(width, bits * tables)) * 1024)


def signatures(bits: int, tables: int):
    @F.pandas_udf("array<long>")
    def of(vectors: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        width = vectors.map(len)
        for size in width.unique():
            rows = np.nonzero((width == size).to_numpy())[0]
            x = np.stack([vectors.iloc[i] for i in rows]).astype(float)
            for i, k in zip(rows, _keys(x, bits, tables, tables) + (np.int64(size) << np.int64(bits)), strict=True):
                out[i] = k
        return pd.Series(out)

    return of


def _keys(x: np.ndarray, bits: int, tables: int, first: int) -> np.ndarray:
    """The sides of each row in each of the ``first`` tables.

    Vectors are scaled, which keeps large parts from overflowing, and taken to whole
    millionths. Products with the whole-numbered hyperplanes are then exact in double
    precision, so a row has the same key wherever and in whatever batch it is computed.
    """
    x = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * (1 << 20))
    planes, values = _hyperplanes(x.shape[1], bits, tables), 1 << np.arange(bits, dtype=np.int64)
    out = np.empty((len(x), first), np.int64)
    for t in range(first):
        out[:, t] = (x @ planes[:, t * bits : (t + 1) * bits] > 0) @ values
    return out


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _links(batches: Iterator[pa.RecordBatch], threshold: float, bits: int, tables: int) -> Iterator[pa.RecordBatch]:
    """Verified links of cells that come sorted; a cell at most is held over.

    For each vector of a cell: how many vectors it links to that it has not
    met in an earlier table, and an edge that keeps the cell connected. Keys
    in earlier tables are computed anew, for vectors with links alone, rather
    than shipped with every row.
    """

    def cell(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        n = len(rows)
        if n < 2:
            return
        rep, copies, own, number = (rows.column(c).to_numpy() for c in ("rep", "copies", "own", "number"))
        left, right = int(rows.column("left")[0].as_py()), int(rows.column("right")[0].as_py())
        vectors = rows.column("v").combine_chunks()
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float)
        unit = _units(x)
        turn = int(number[0])
        keys, known = np.empty((n, turn), np.int64), np.zeros(n, bool)
        links = np.zeros(n, np.int64)
        a, b = [], []
        for lo in range(0, n, 256):
            value = unit[lo : lo + 256] @ unit.T
            i, j = np.nonzero(value >= threshold - 1e-9)
            value = value[i, j]
            i = i + lo
            ok = i < j
            if left != right:
                ok &= own[i] != own[j]
            i, j, value = i[ok], j[ok], value[ok]
            # only what is this near the threshold can fall on either side by the order of a sum
            ok = value > threshold + 1e-9
            edge = np.nonzero(~ok)[0]
            ok[edge] = np.einsum("ij,ij->i", unit[i[edge]], unit[j[edge]]) >= threshold
            i, j = i[ok], j[ok]
            if turn and len(i):
                wanted = np.union1d(i, j)
                wanted = wanted[~known[wanted]]
                if len(wanted):
                    keys[wanted] = _keys(x[wanted], bits, tables, turn)
                    known[wanted] = True
                met = np.zeros(len(i), bool)
                for t in range(turn):
                    met |= keys[i, t] == keys[j, t]
                i, j = i[~met], j[~met]
            if len(i):
                links += np.bincount(i, weights=copies[j], minlength=n).astype(np.int64)
                links += np.bincount(j, weights=copies[i], minlength=n).astype(np.int64)
                root = _forest(i, j, n)
                moved = np.nonzero(root != np.arange(n))[0]
                a.append(moved)
                b.append(root[moved])
        if a:
            root = _forest(np.concatenate(a), np.concatenate(b), n)
            some = np.nonzero((links > 0) | (root != np.arange(n)))[0]
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some]), pa.array(rep[root[some]])], names=["a", "links", "b"])

    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if rest is not None:
            rows = pa.concat_tables([rest, rows])
        if not len(rows):
            continue
        place = np.stack([rows.column(c).to_numpy() for c in ("number", "key", "left", "right")])
        cuts = np.r_[0, np.nonzero((place[:, 1:] != place[:, :-1]).any(axis=0))[0] + 1]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield from cell(rows.slice(lo, hi - lo))
        rest = rows.slice(cuts[-1])
    if rest is not None:
        yield from cell(rest)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, cell: int = CELL) -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` for every row of ``vectors``.

    Equal vectors are taken together. Each distinct one is filed in several
    tables under the sides of random hyperplanes it is on; the number of
    tables follows from ``recall`` for pairs just at the threshold (closer
    pairs are found more surely). All pairs of a bucket are verified by their
    cosine in double precision and counted in the first table they meet in;
    a bucket emits no pairs, but for each vector a count and an edge. Buckets
    larger than ``cell`` are split in blocks, and every two blocks make a cell.

    ``n_links`` counts the other rows linked directly, copies included;
    ``component_id`` is the smallest id reachable, itself included; ``kept``
    marks the row that has it. Null, zero and non-finite vectors, and rows
    with a null id, link nothing and stay alone (a null id has a null
    component and is not kept). Vectors of different lengths do not link.
    Rows with the same id and vector are copies of each other. An empty table
    gives an empty result. Other columns are not read.
    """
    nodes, _ = materialize(distinct_vectors(vectors, id_col, vector_col), "vectors")
    bits, tables = plan_tables(nodes.count(), threshold, recall)
    filed = nodes.select("rep", "copies", "v", signatures(bits, tables)("v").alias("keys"))
    # what goes to every bucket is kept small: one key, and the vector as it was stored
    stored = F.col("v").cast("array<float>") if dict(vectors.dtypes)[vector_col] == "array<float>" else F.col("v")
    placed = filed.select("rep", "copies", stored.alias("v"), F.posexplode("keys").alias("number", "key"))
    sizes = filed.select(F.posexplode("keys").alias("number", "key")).groupBy("number", "key").count()
    hot, _ = materialize(sizes.where(F.col("count") > cell).withColumnsRenamed({"number": "h_number", "key": "h_key"}), "hot-buckets")
    blocks = F.coalesce(F.ceil(F.col("count") / cell), F.lit(1)).cast("int")
    cells = (
        placed.join(hot, (F.col("number") == F.col("h_number")) & (F.col("key") == F.col("h_key")), "left")
        .withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("number", "key", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "own", "rep", "copies", "v")
    )
    dealt = cells.repartition("number", "key", "left", "right").sortWithinPartitions("number", "key", "left", "right")
    found, _ = materialize(dealt.mapInArrow(lambda it: _links(it, threshold, bits, tables), "a long, links long, b long"), "links")
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("a", "b"))
    known = (
        nodes.join(counts, nodes.rep == counts.a, "left")
        .join(parts, nodes.rep == parts.node, "left")
        .select("rep", F.col("v").alias("k_v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    able = F.col("id").isNotNull() & usable(F.col("v"))
    # the others stay where they are, and are not sent to one task by a key they all lack
    out = rows.where(able).join(known, F.col("v") == F.col("k_v"), "left").select("id", "links", "component")
    out = out.unionByName(rows.where(~able).select("id", F.lit(None).cast("long").alias("links"), F.lit(None).cast("long").alias("component")))
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
