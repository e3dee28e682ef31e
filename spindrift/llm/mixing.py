"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.prefix import running_sum
from spindrift.llm.shared import table

#: UTF-8 bytes of text in a block.
BLOCK_BYTES = 1 << 16
#: Weights that need a longer period than this many slots are rounded to it.
PARTS = 2000
#: Sources at most; their schedule is worked out on the driver.
MAX_SOURCES = 1000


def period(shares: list[int]) -> list[list[int]]:
    """Slots of each source's blocks in one period of ``sum(shares)`` slots.

    Block ``j`` of a source with weight ``w`` is released at ``floor(j / w)``
    and due at ``ceil((j + 1) / w)``. Each slot goes to the released block
    with the earliest deadline, ties to the source that comes first. As the
    weights sum to one this meets all deadlines, so at any time a source is
    less than one block away from its target.
    """
    total = sum(shares)
    slots: list[list[int]] = [[] for _ in shares]
    waiting = [(0, i, 0) for i, a in enumerate(shares) if a]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // shares[i]), i, j))
        _, i, j = heapq.heappop(ready)
        slots[i].append(slot)
        if j + 1 < shares[i]:
            heapq.heappush(waiting, ((j + 1) * total // shares[i], i, j + 1))
    return slots


def whole_shares(weights: list[float], parts: int = PARTS) -> list[int]:
    """Whole shares in the proportion of ``weights``.

    They are exact if ``parts`` slots or fewer can hold that proportion, as
    for equal weights, and rounded to ``parts`` slots otherwise, positive
    weights to one slot at least. A weight of zero has no share.
    """
    exact = [Fraction(w).limit_denominator(10**6) for w in weights]
    if any(w < 0 for w in exact):
        raise ValueError("a weight is negative")
    total = sum(exact)
    if not total:
        return [0] * len(exact)
    shares = [w / total for w in exact]
    period_of = math.lcm(*(w.denominator for w in shares))
    if period_of <= max(parts, len(shares)):
        return [int(w * period_of) for w in shares]
    return [max(1, round(w * parts)) if w else 0 for w in shares]


def phases(shares: list[int], blocks: list[int]) -> list[dict]:
    """Phases of a schedule that places every block.

    In a phase all sources that still have blocks are mixed to their target
    weights. It ends with the slot in which the first of them runs out; the
    others go on with the same weights among themselves. There are at most as
    many phases as sources.
    """
    out, done, begin = [], [0] * len(shares), 0
    while left := [i for i in range(len(shares)) if done[i] < blocks[i]]:
        # sources without a weight come when all others are through, in equal parts
        active = [i for i in left if shares[i]] or left
        parts = [shares[i] or 1 for i in active]
        slots, total = period(parts), sum(parts)

        def slot_of(k: int, j: int, slots: list = slots, parts: list = parts, total: int = total) -> int:
            return j // parts[k] * total + slots[k][j % parts[k]]

        length = 1 + min(slot_of(k, blocks[i] - done[i] - 1) for k, i in enumerate(active))
        whole, rest = divmod(length, total)
        for k, i in enumerate(active):
            n = whole * parts[k] + sum(s < rest for s in slots[k])
            out.append({"source": i, "from": done[i], "to": done[i] + n, "begin": begin, "share": parts[k], "total": total, "slots": slots[k]})
            done[i] += n
        begin += length
    return out


def schedule(docs: DataFrame, weights: dict[str | None, float] | None = None, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with the block it is in and that block's slot.

    Returns ``(id_col, source, block, slot, release, deadline, start)``; rows
    in the order of ``(slot, start)`` are the mixture. A source's documents,
    in the order of a hash of id and text, are cut into blocks of ``block_bytes`` of
    text (a document belongs to the block it starts in). ``weights`` are the
    targets by source, 1 for those not named, so all are equal by default; a
    source with weight 0 comes when the others have run out, and a
    null source is a source of its own. No row is dropped or repeated. Null
    and empty texts take no room and stay with their neighbours; rows that
    are alike in every respect stand in either order; an empty table gives an
    empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")).cast("long"), F.lit(0).cast("long"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), size.alias("size"))
    # counted first: what follows keeps a row for each source on the driver
    named = rows.select("source").distinct().limit(MAX_SOURCES + 1).count()
    if named > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group the small ones")
    placed = running_sum(rows, ["source", "h", "id"], "size", "start", group="source")
    placed = placed.withColumn("block", F.floor(F.col("start") / block_bytes))
    last = placed.groupBy("source").agg(F.max("block").alias("last")).collect()
    # null first, then by name: the order ties are resolved in
    last.sort(key=lambda r: (r["source"] is not None, r["source"] or ""))
    shares = whole_shares([(weights or {}).get(r["source"], 1.0) for r in last]) if last else []
    plan = [(last[p["source"]]["source"], p["from"], p["to"], p["begin"], p["share"], p["total"], p["slots"]) for p in phases(shares, [r["last"] + 1 for r in last]) if p["to"] > p["from"]]
    kind = "p_source string, p_from long, p_to long, p_begin long, p_share long, p_total long, p_slots array<long>"
    plan_df = spark.createDataFrame(plan, kind)
    inside = F.col("source").eqNullSafe(F.col("p_source")) & (F.col("block") >= F.col("p_from")) & (F.col("block") < F.col("p_to"))
    j = F.col("block") - F.col("p_from")
    slot = F.col("p_begin") + F.floor(j / F.col("p_share")) * F.col("p_total") + F.element_at("p_slots", (j % F.col("p_share") + 1).cast("int"))
    # a phase has a row for each source that is left and PARTS slots in all; there is a phase
    # for each source at most, so MAX_SOURCES bounds the plan
    return placed.join(F.broadcast(plan_df), inside).select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        F.col("block").cast("long").alias("block"),
        slot.cast("long").alias("slot"),
        (F.col("p_begin") + F.floor(j * F.col("p_total") / F.col("p_share"))).cast("long").alias("release"),
        (F.col("p_begin") + F.ceil((j + 1) * F.col("p_total") / F.col("p_share"))).cast("long").alias("deadline"),
        F.col("start").cast("long").alias("start"),
    )


def in_order(docs: DataFrame, weights: dict[str | None, float] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in the order of the mixture, with their columns.

    Slots are joined by a hash of id, source and text rather than by
    position. Rows that are alike share a place, so one of them stands for all
    in the schedule's table and none is lost or doubled.
    """
    keys = [F.col("doc_id"), F.col("source"), F.col("text")]
    tag = F.xxhash64(*keys)
    named = docs.withColumn("doc_id", tag)
    slots = schedule(named, weights, block_bytes).groupBy("doc_id").agg(F.min(F.struct("slot", "start")).alias("place"))
    placed = docs.withColumn("__tag", tag).join(slots.select(F.col("doc_id").alias("__key"), F.col("place").alias("__place")), F.col("__tag") == F.col("__key"), "left")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("__place.slot"), F.col("__place.start"), F.col("__tag")]
    return placed.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(table(spark, sf_dir, "documents"))
