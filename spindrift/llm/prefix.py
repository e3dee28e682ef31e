"""Running sums over a global order, without a single-task window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.shared import materialize


def running_sum(df: DataFrame, order: list[str], size: str, out: str, group: str | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``size`` over all rows before, in ``order``.

    With ``group`` sums start anew for each of its values; it must then lead
    the order. Rows are ranged over partitions by the whole order, so a hot
    group spreads over many; each task streams its running sums, and one
    offset for each partition and group is added by a join. The ranged rows
    are written once, so both steps see the same partitions.
    """
    keys = ([group] if group else []) + [c for c in order if c != group]
    at = f"{out}_part"
    fields = [*df.schema.fields, T.StructField(at, T.LongType()), T.StructField(out, T.LongType())]
    place, where = df.columns.index(size), df.columns.index(group) if group else None

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            sizes = batch.column(place).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(sizes):
                continue
            ends = np.cumsum(sizes)
            starts = ends - sizes
            if where is None:
                sums, before = starts + before, before + int(ends[-1])
            else:
                names = batch.column(where).to_pylist()
                sums = np.empty(len(sizes), np.int64)
                lo = 0
                cuts = [k for k in range(1, len(names)) if names[k] != names[k - 1]] + [len(names)]
                for hi in cuts:
                    carried = before if last is not None and last[0] == names[lo] else 0
                    sums[lo:hi] = starts[lo:hi] - starts[lo] + carried
                    before, last = int(sums[hi - 1] + sizes[hi - 1]), (names[lo],)
                    lo = hi
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(sizes), part, np.int64)), pa.array(sums)], names=[*batch.schema.names, at, out])

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(stream, T.StructType(fields))
    rows, _ = materialize(ranged, "ranged")
    by = [at] + ([group] if group else [])
    totals = [tuple(r) for r in rows.groupBy(*by).agg(F.max(F.col(out) + F.col(size)).alias("total")).collect()]
    # as many totals as partitions and group starts: bounded by the plan, not by the rows
    offsets, run = [], {}
    for row in sorted(totals, key=lambda r: r[0]):
        name = row[1] if group else None
        offsets.append((*row[:-1], run.get(name, 0)))
        run[name] = run.get(name, 0) + row[-1]
    base = f"{out}_base"
    schema = T.StructType([T.StructField(at, T.LongType())] + ([df.schema[group]] if group else []) + [T.StructField(base, T.LongType())])
    known = df.sparkSession.createDataFrame(offsets, schema)
    same = rows[at] == known[at]
    if group:
        same = same & rows[group].eqNullSafe(known[group])
    return rows.join(F.broadcast(known), same).select(*[rows[c] for c in df.columns], (rows[out] + known[base]).alias(out))
