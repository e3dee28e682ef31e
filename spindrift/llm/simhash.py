"""SimHash near-dedup by a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.graph import connected_components
from spindrift.llm.shared import discard, materialize, table, text_bytes

#: Fingerprints have 64 bits, so eight positional bytes.
POSITIONS = 8
#: Seed of XXH64 for shingles.
SEED = 42
#: Shingles hashed and tallied at a time, so long texts need bounded memory.
BLOCK = 1 << 15
#: A posting list longer than this is split over several cells.
CELL = 4096


def fingerprint(data: bytes, words: int = 4) -> int:
    """64-bit SimHash of the ``words``-word shingles of a text in UTF-8.

    Fewer words than that make one shingle of all; no word gives zero.
    """
    tokens = data.lower().split()
    if not tokens:
        return 0
    size = min(words, len(tokens))
    joined = b" ".join(tokens)
    starts = [0, *accumulate(len(t) + 1 for t in tokens)]
    n = len(tokens) - size + 1
    digest = xxhash.xxh64_intdigest
    tally = np.zeros(64, np.int64)
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        hashes = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts[lo:hi], starts[lo + size : hi + size], strict=True)), np.uint64, hi - lo)
        tally += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (tally * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprint_column(words: int = 4):
    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, words) for x in texts], dtype="int64")

    return of


def covering_positions(min_matches: int) -> list[tuple[int, ...]]:
    """Position subsets such that any ``min_matches`` equal positional bytes contain one.

    From four matches on, Turan's construction for triples is used: positions
    fall into three classes, and a triple is taken if it lies in one class or
    has two positions in a class and one in the next. Twenty triples suffice.
    """
    if min_matches < 1:
        raise ValueError("no positional byte is guaranteed to match")
    if min_matches < 4:
        return list(combinations(range(POSITIONS), min_matches))
    kind = [p % 3 for p in range(POSITIONS)]

    def taken(c: tuple[int, ...]) -> bool:
        k = sorted(kind[p] for p in c)
        return len(set(k)) == 1 or any(k.count(g) == 2 and k.count((g + 1) % 3) == 1 for g in range(3))

    return [c for c in combinations(range(POSITIONS), 3) if taken(c)]


def linked_labels(prints: np.ndarray, max_distance: int, min_matches: int) -> np.ndarray:
    """For each fingerprint of one posting list, the first one it is connected to.

    Positional bytes shared by each pair are tallied, pairs with the
    guaranteed minimum are kept, and those are verified bit by bit. Tiles
    bound the memory.
    """
    n = len(prints)
    label = np.arange(n)
    rows = max(1, (1 << 19) // max(n, 1))
    links_a, links_b = [], []
    for lo in range(0, n, rows):
        x = prints[lo : lo + rows, None] ^ prints[None, :]
        shared = np.zeros(x.shape, np.uint8)
        for p in range(POSITIONS):
            shared += (x >> np.uint64(8 * p)) & np.uint64(255) == 0
        i, j = np.nonzero(shared >= min_matches)
        ok = (np.bitwise_count(x[i, j]) <= max_distance) & (i + lo != j)
        i, j = i[ok] + lo, j[ok]
        # Links to the smallest and the largest neighbour and along the sorted
        # neighbours keep the tile's connectivity in a number linear in n.
        if len(i):
            heads = np.r_[True, i[1:] != i[:-1]]
            first = j[np.maximum.accumulate(np.where(heads, np.arange(len(i)), 0))]
            chain = _forest(np.r_[i, j], np.r_[first, first], n)
            keep = chain != np.arange(n)
            links_a.append(np.nonzero(keep)[0])
            links_b.append(chain[keep])
    if links_a:
        label = _forest(np.concatenate(links_a), np.concatenate(links_b), n)
    return label


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index connected to each of ``n`` by the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _edges(batches: Iterator[pa.RecordBatch], max_distance: int, min_matches: int) -> Iterator[pa.RecordBatch]:
    """Edges of posting lists that come sorted; one list at most is held over."""
    rest: list[np.ndarray] | None = None

    def runs(cols: list[np.ndarray], end: int) -> Iterator[pa.RecordBatch]:
        key, cell, prints, rep = (c[:end] for c in cols)
        if not end:
            return
        cut = np.nonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))[0] + 1
        starts, ends = np.r_[0, cut], np.r_[cut, end]
        a, b = [], []
        for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            label = linked_labels(prints[s:e].view(np.uint64), max_distance, min_matches)
            moved = np.nonzero(label != np.arange(e - s))[0]
            a.append(rep[s:e][moved])
            b.append(rep[s:e][label[moved]])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        key, cell = cols[0], cols[1]
        if not len(key):
            continue
        other = np.nonzero((key != key[-1]) | (cell != cell[-1]))[0]
        end = int(other[-1]) + 1 if len(other) else 0
        yield from runs(cols, end)
        rest = [c[end:] for c in cols]
    if rest is not None:
        yield from runs(rest, len(rest[0]))


def candidate_edges(nodes: DataFrame, max_distance: int = 4, cell: int = CELL) -> DataFrame:
    """Edges ``(a, b)`` that connect ``nodes(fp, rep)`` whose distinct fingerprints link.

    Two fingerprints that differ in ``d`` bits share at least ``8 - d``
    positional bytes. Each is posted under the joint value of every position
    subset of a covering design, so any pair with that many matches meets in
    a posting list, where its shared bytes are counted and the pair verified.
    Within a list only a spanning forest is emitted. Lists longer than
    ``cell`` are split into blocks, and pairs of blocks become cells of their
    own, so no task holds an unbounded list.
    """
    spark = nodes.sparkSession
    min_matches = POSITIONS - max_distance
    subsets = covering_positions(min_matches)
    keys = []
    for number, subset in enumerate(subsets):
        key = F.lit(number).cast("long")
        for p in subset:
            key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255).cast("long")))
        keys.append(key)
    postings = nodes.select("fp", "rep", F.explode(F.array(*keys)).alias("key"))
    hot, _ = materialize(postings.groupBy("key").count().where(F.col("count") > cell), "hot-postings")
    blocks = F.ceil(F.col("count") / cell).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    placed = (
        postings.join(hot, "key", "left")
        .withColumn("blocks", F.coalesce(blocks, F.lit(1)))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", (F.greatest("own", "other").cast("long") * (1 << 31) + F.least("own", "other")).alias("cell"), "fp", "rep")
    )
    return (
        placed.repartition("key", "cell")
        .sortWithinPartitions("key", "cell", "fp")
        .mapInArrow(lambda it: _edges(it, max_distance, min_matches), "a long, b long")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_distance: int = 4) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` for every row of ``docs``.

    ``fingerprint`` is 16 lower-case hex digits, ``component_id`` the smallest
    id reachable over links of at most ``max_distance`` differing bits, itself
    included. A null text is empty, and texts without words have fingerprint
    zero, which links like any other. A row whose id is null gets its
    fingerprint and a null component, and links nothing. Repeated rows each
    come back. An empty table gives an empty result. Other columns are not
    read, whatever their names.
    """
    spark = docs.sparkSession
    of = fingerprint_column(words)
    prints, _ = materialize(docs.select(F.col(id_col).cast("long").alias("id"), of(text_bytes(text_col)).alias("fp")), "fingerprints")
    nodes, _ = materialize(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "nodes")
    parts = connected_components(candidate_edges(nodes, max_distance))
    classes = nodes.join(parts, nodes.rep == parts.node, "left").select(nodes.fp, F.coalesce("component", "rep").alias("component"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(classes, "fp", "left").select(
        F.col("id").alias(id_col), hexed.alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id")
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
