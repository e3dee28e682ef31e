"""Labelled documents to learn from: all, or bounded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.shared import discard, held_out, materialize


#: Bytes of text that a model learns from at most.
MAX_BYTES = 256 << 20
#: So many labelled ids are sent to every task; more are joined by a shuffle.
FEW = 500_000


def within_bytes(sample: DataFrame, max_bytes: int = MAX_BYTES) -> list:
    """The rows of a sample, in the order of the hash that it was taken in, as long as the bytes last; one at least.

    The sample is written first, so the driver sees its lengths before it asks for a text.
    """
    rows, path = materialize(sample, "sample")
    order = F.xxhash64("id")
    sizes = rows.select("id", F.octet_length("text").alias("size"), order.alias("order")).collect()
    sizes.sort(key=lambda r: (r["order"], r["id"]))
    held, last = 0, None
    for r in sizes:
        if last is not None and held + r["size"] > max_bytes:
            break
        held, last = held + r["size"], (r["order"], r["id"])
    if last is None:
        return []
    taken = rows.where((order < last[0]) | ((order == last[0]) & (F.col("id") <= last[1]))).collect()
    discard(sample.sparkSession, path)
    return taken


def _usable(labels: DataFrame, label: str, id_col: str) -> DataFrame:
    """``(id, label)`` without held-out and null ids and null labels."""
    value = F.col(label).cast("int")
    return labels.select(F.col(id_col).cast("long").alias("id"), value.alias("label")).where("id is not null and label in (0, 1)").where(~held_out("id", 4))


def _agreed(usable: DataFrame) -> DataFrame:
    """One row for each id whose labels do not contradict each other."""
    return usable.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("id", "label")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, label)`` of all labelled documents.

    Held-out and null ids, null labels and ids with contradicting labels are
    left out.
    """
    usable = _usable(labels, label, id_col)
    known = _agreed(usable)
    return _texts(docs, id_col, text_col).join(F.broadcast(known) if usable.count() <= FEW else known, "id").select("id", "text", "label")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, label)`` of at most ``max_rows`` labelled ids, the same on every run.

    Ids are taken in the order of a hash. Held-out and null ids, null labels
    and ids with contradicting labels are left out. The ids taken are bounded
    by ``max_rows``, so they alone are broadcast; the texts are not shuffled.
    """
    usable = _usable(labels, label, id_col)
    total = usable.count()
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    likely = usable.where(share < min(1.0, (2.0 * max_rows + 1000.0) / max(total, 1)))
    taken = _agreed(likely).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    return _texts(docs, id_col, text_col).join(F.broadcast(taken), "id").select("id", "text", "label")
