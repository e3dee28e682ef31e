"""Groups of near copies by SimHash and a byte-position index, for texts whose shingles are alike to a given share."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.graph import connected_components
from spindrift.llm.shared import claim, discard, materialize, nothing, text_bytes
from spindrift.llm.simhash import BLOCK, CELL, SEED, _forest

#: Words in a shingle, and the Jaccard similarity of copies.
WORDS = 5
SIMILARITY = 0.8
#: 64-bit words of a signature.
SIGNATURE = 8
#: Lists a text is posted in, and the least shingles that make the key of one: a pair
#: with the similarity s meets in none with a probability of (1 - s ** LEAST) ** LISTS.
LISTS = 20
LEAST = 3
#: Bytes of a signature whose joint value with their places is a key of the byte index;
#: every byte is in one key. Pairs that meet there and share fewer bytes are let go.
JOINT = 2
SHARED = 4
#: Ties raise the mean of the bits in which signatures differ by this factor at most,
#: in sets of fewer than FEW_SHINGLES and in others; copies may differ in DEVIATIONS more.
TIES = (1.24, 1.07)
FEW_SHINGLES = 12
DEVIATIONS = 5
#: Members of a list that are compared by shifts of whole batches; longer lists are
#: compared one by one. Both give the same links.
SHIFTED = 6
#: Texts, and shingles of all its texts, that a cell of verified pairs holds on average.
CELL_TEXTS = 2048
CELL_SHINGLES = 1 << 21
#: Lists by which a large cluster is searched first.
FIRST_LISTS = 4
#: So few ids are sent to every task; more are joined by a shuffle.
FEW = 500_000
#: One odd multiplier for each word of a signature.
MIXERS = np.random.default_rng(23).integers(1 << 62, size=SIGNATURE).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: And for each order in which a least shingle is looked for.
ORDERS = np.random.default_rng(29).integers(1 << 62, size=LISTS * LEAST).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the set of word shingles; none without words."""
    tokens = data.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    size = min(words, len(tokens))
    joined = b" ".join(tokens)
    starts = [0, *accumulate(len(t) + 1 for t in tokens)]
    digest = xxhash.xxh64_intdigest
    n = len(tokens) - size + 1
    return np.unique(np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[size:], strict=False)), np.uint64, n))


def differing(similarity: float) -> float:
    """Share of SimHash bits in which sets of equal size with this Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _limits(similarity: float) -> list[float]:
    """Bits in which signatures of copies may differ, for sets of few shingles and for others."""
    shares = [min(1.0, t * differing(similarity)) for t in TIES]
    return [64 * SIGNATURE * p + DEVIATIONS * math.sqrt(64 * SIGNATURE * p * (1 - p)) for p in shares]


def _mixed(hashes: np.ndarray, mixer: np.ndarray) -> np.ndarray:
    mixed = hashes * mixer
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    return mixed


def signature(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingles in ``SIGNATURE`` words of 64 bits; all zero for none."""
    if not len(hashes):
        return np.zeros(SIGNATURE, np.uint64)
    tally = np.zeros((SIGNATURE, 64), np.int64)
    for lo in range(0, len(hashes), BLOCK):
        part = hashes[lo : lo + BLOCK]
        for k, mixer in enumerate(MIXERS):
            tally[k] += np.unpackbits(_mixed(part, mixer).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits((tally * 2 > len(hashes)).astype(np.uint8).ravel(), bitorder="little").view(np.uint64)


def list_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of the lists of a set of shingles, each of its least ones in ``LEAST`` random orders."""
    least = np.full(LISTS * LEAST, np.iinfo(np.uint64).max)
    for lo in range(0, len(hashes), BLOCK // 8):
        np.minimum(least, _mixed(hashes[lo : lo + BLOCK // 8, None], ORDERS).min(axis=0), out=least)
    keys = np.arange(LISTS, dtype=np.uint64)
    for one in least.reshape(LISTS, LEAST).T:
        keys = _mixed(keys, MIXERS[0]) ^ one
    return keys


def byte_keys() -> list[Column]:
    """Keys of the byte index: the joint values of ``JOINT`` bytes of a signature ``fp0, fp1, ..``, and which bytes they are.

    The bytes of a key lie in different words. Keys are small numbers, and
    those of least shingles are hashes.
    """
    places = 8 * SIGNATURE // JOINT
    keys = []
    for number in range(places):
        key = F.lit(number).cast("long")
        for place in range(number, 8 * SIGNATURE, places):
            key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned(f"fp{place // 8}", 8 * (place % 8)).bitwiseAND(F.lit(255).cast("long")))
        keys.append(key)
    return keys


def _from_bytes(key: np.ndarray) -> np.ndarray:
    """Which keys are of the byte index."""
    return (key >= 0) & (key < (8 * SIGNATURE // JOINT) << (8 * JOINT))


def _shared(x: list[np.ndarray], i, j) -> np.ndarray:
    """Bytes that rows ``i`` and ``j`` have in common, place by place."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    total = np.zeros(len(i), np.uint8)
    for w in x:
        y = w[i] ^ w[j]
        # the highest bit of each byte that is zero
        total += np.bitwise_count(~(((y & low) + low) | y | low))
    return total


def _signed(texts: pd.Series) -> pd.Series:
    """Signature, list keys and size of the set of shingles."""
    claim("near copies", nothing)
    sets = [shingles(x) for x in texts]
    return pd.Series([np.concatenate([signature(x), list_keys(x), np.array([len(x)], np.uint64)]).view(np.int64) for x in sets])


def _shingled(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(x).view(np.int64) for x in texts])


def _gap(x: list[np.ndarray], i, j) -> np.ndarray:
    """Bits in which rows ``i`` and ``j`` differ over the whole signature."""
    return sum(np.bitwise_count(w[i] ^ w[j]).astype(np.uint16) for w in x)


def _may(gap: np.ndarray, m: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of ``m`` and ``n`` shingles whose signatures differ in ``gap`` bits may be so alike."""
    less = np.minimum(m, n)
    return (gap <= np.where(less < FEW_SHINGLES, *_limits(similarity))) & (less >= similarity * np.maximum(m, n))


def _tiles(x: list[np.ndarray], size: np.ndarray, similarity: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Close pairs of a member and an earlier one, in tiles that bound the memory: first row, gaps, rows in the tile, columns."""
    n = len(size)
    rows = max(1, (1 << 19) // n)
    every = np.arange(n)
    for lo in range(0, n, rows):
        own = every[lo : lo + rows]
        gap = _gap(x, own[:, None], every[None, : lo + len(own)])
        i, j = np.nonzero(_may(gap, size[own, None], size[None, : lo + len(own)], similarity))
        ok = j < i + lo
        if ok.any():
            yield lo, gap, i[ok], j[ok]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole lists, in tables of one or more, of rows sorted by ``key`` and ``cell``; one list at most is held over."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, cell = (batch.column(c).to_numpy() for c in ("key", "cell"))
        # where the batch's last list begins
        other = np.nonzero((key != key[-1]) | (cell != cell[-1]))[0]
        end = int(other[-1]) + 1 if len(other) else 0
        if end or (last is not None and last != (key[0], cell[0])):
            if last == (key[0], cell[0]) or end:
                held.append(batch.slice(0, end))
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        held.append(batch.slice(end))
        last = (key[-1], cell[-1])
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _runs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the lists of a table."""
    key, cell = (rows.column(c).to_numpy() for c in ("key", "cell"))
    starts = np.r_[0, np.nonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))[0] + 1]
    return starts, np.diff(np.r_[starts, len(key)])


def _close(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """A forest, for every cell, that connects its members whose signatures are close."""
    for rows in _lists(batches):
        node, part, size = (rows.column(c).to_numpy() for c in ("node", "part", "shingled"))
        x = [rows.column(f"fp{k}").to_numpy().view(np.uint64) for k in range(SIGNATURE)]
        index = _from_bytes(rows.column("key").to_numpy())
        starts, sizes = _runs(rows)
        a, b = [], []
        left = np.repeat(starts + sizes, sizes) - np.arange(len(node))  # members from here to the end of the list
        left[np.repeat(sizes > SHIFTED, sizes)] = 0
        at, shift = np.nonzero(left > 1)[0], 1
        while len(at):
            met = at[~index[at] | (_shared(x, at, at + shift) >= SHARED)]
            close = met[_may(_gap(x, met, met + shift), size[met], size[met + shift], similarity)]
            a.append(close + shift)
            b.append(close)
            shift += 1
            at = at[left[at] > shift]
        for s, n in zip(starts[sizes > SHIFTED], sizes[sizes > SHIFTED], strict=True):
            label = _first(part[s : s + n])
            own = [w[s : s + n] for w in x]
            for lo, _, i, j in _tiles(own, size[s : s + n], similarity):
                if index[s]:
                    met = _shared(own, i + lo, j) >= SHARED
                    i, j = i[met], j[met]
                # what is joined already is known by its label, so every tile adds to one forest
                label = _forest(np.r_[i + lo, np.arange(n)], np.r_[j, label], n)
            a.append(np.arange(s, s + n))
            b.append(label + s)
        if a:
            label = _forest(np.concatenate(a), np.concatenate(b), len(node))
            moved = np.nonzero(part != part[label])[0]
            yield pa.RecordBatch.from_arrays([pa.array(part[moved]), pa.array(part[label[moved]])], names=["a", "b"])


def _verified(rows: pa.Table, similarity: float) -> np.ndarray:
    """For each text of one cell, the first one that it is connected to by pairs as alike as asked for.

    Texts of one part are connected from the start. Pairs of two parts whose
    signatures are close are decided by their sets of shingles, until the
    parts are connected.
    """
    size = rows.column("shingled").to_numpy()
    x = [rows.column(f"fp{k}").to_numpy().view(np.uint64) for k in range(SIGNATURE)]
    label = _first(rows.column("part").to_numpy())
    shingle = rows.column("set").combine_chunks()
    at = shingle.offsets.to_numpy() - shingle.offsets[0].as_py()
    _, known = np.unique(shingle.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    there = np.zeros(len(known) + 1, bool)

    def linked(i: int, js: np.ndarray) -> np.ndarray:
        if not size[i]:
            return js  # only empty sets are as long
        ends = np.cumsum(size[js])
        cat = known[np.arange(ends[-1]) + np.repeat(at[js] - (ends - size[js]), size[js])]
        both = np.add.reduceat(there[cat], ends - size[js], dtype=np.int64)
        return js[both >= similarity * (size[i] + size[js] - both)]

    def join(i: int, js: np.ndarray) -> None:
        for root in np.unique(label[js]).tolist():
            low, high = sorted((int(label[i]), root))
            if low != high:
                label[label == high] = low

    for lo, gap, tile_row, other in _tiles(x, size, similarity):
        heads = np.r_[0, np.nonzero(tile_row[1:] != tile_row[:-1])[0] + 1, len(tile_row)]
        for s, e in zip(heads[:-1], heads[1:], strict=True):
            row, js = int(tile_row[s]), other[s:e]
            i = row + lo
            js = js[label[js] != label[i]]
            if not len(js):
                continue
            own = known[at[i] : at[i + 1]]
            there[own] = True
            nearest = js[np.argmin(gap[row, js])]
            join(i, linked(i, nearest[None]))
            js = js[(label[js] != label[i]) & (js != nearest)]
            # so many at a time that their sets stay small
            for k in range(0, len(js), 512):
                some = js[k : k + 512]
                some = some[label[some] != label[i]]
                if len(some):
                    join(i, linked(i, some))
            there[own] = False
    return label


def _first(part: np.ndarray) -> np.ndarray:
    """For each row the first one of its part."""
    _, head, own = np.unique(part, return_index=True, return_inverse=True)
    return head[own]


def _alike(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """A forest, for every cell, that connects the parts of its texts as alike as asked for."""
    for rows in _lists(batches):
        for s, n in zip(*_runs(rows), strict=True):
            if n > 1:
                one = rows.slice(s, n)
                part = one.column("part").to_numpy()
                label = _verified(one, similarity)
                moved = np.nonzero((_first(part) == np.arange(n)) & (part != part[label]))[0]
                yield pa.RecordBatch.from_arrays([pa.array(part[moved]), pa.array(part[label[moved]])], names=["a", "b"])


def _blocked(lists: DataFrame, sizes: DataFrame, room: int) -> DataFrame:
    """``lists(key, node, ..)`` in cells: a list that weighs more than ``room`` is split in blocks of no more.

    Pairs of different blocks do not meet; see ``_across``.
    """
    blocks = F.ceil(F.col("weight") / room)
    return lists.join(sizes.select("key", "weight"), "key").withColumn("cell", F.pmod(F.xxhash64("node", "key"), F.greatest(blocks, F.lit(1)))).drop("weight")


def _across(lists: DataFrame, room: int) -> DataFrame:
    """``lists(key, node, part, own_weight, ..)`` in cells where every pair of different parts meets.

    A list's heaviest part has blocks of its own. Two of these need no cell,
    so a list that is one part but for a few members costs little more than
    its length; a list of one part costs nothing.
    """
    sizes = lists.groupBy("key", "part").agg(F.sum("own_weight").alias("w"))
    whole = sizes.groupBy("key").agg(F.max(F.struct("w", "part")).alias("main"), F.sum("w").alias("all")).where("main.w < all")
    p, q = F.ceil(F.col("main.w") / room), F.ceil((F.col("all") - F.col("main.w")) / room)
    inside = F.col("part") == F.col("main.part")
    spread = F.xxhash64("node", "key")
    return (
        lists.join(whole, "key")
        .withColumn("own", F.when(inside, F.pmod(spread, p)).otherwise(p + F.pmod(spread, q)))
        .withColumn("other", F.explode(F.sequence(F.when(inside, p).otherwise(F.lit(0).cast("long")), p + q - 1)))
        .withColumn("cell", F.greatest("own", "other") * (1 << 31) + F.least("own", "other"))
        .drop("main", "all", "own", "other")
    )


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_bytes(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h1"), F.crc32(text).alias("h2"), text.alias("text")).where("id is not null")


class _Search:
    """The steps of ``near_copies`` over one table of texts."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, repeated: bool, similarity: float, cell: int, cell_texts: int):
        self.rows, self.nodes, self.repeated = rows, nodes, repeated
        self.similarity, self.cell, self.cell_texts = similarity, cell, cell_texts
        self.words = [f"fp{k}" for k in range(SIGNATURE)]
        self.tables: list[str] = []

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        table, path = materialize(df, label)
        self.tables.append(path)
        return table

    def parted(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """``nodes`` with the smallest node that edges lead to as their ``part``."""
        parts = self.keep(connected_components(edges).withColumnsRenamed({"node": "p_node", "component": "p_part"}), "parts")
        return nodes.drop("part").join(parts, F.col("node") == F.col("p_node"), "left").withColumn("part", F.coalesce("p_part", "node")).drop("p_node", "p_part")

    def close(self, cells: DataFrame) -> DataFrame:
        similarity = self.similarity
        dealt = cells.select("key", "cell", "node", "part", "shingled", *self.words).repartition("key", "cell").sortWithinPartitions("key", "cell", "node")
        return self.keep(dealt.mapInArrow(lambda it: _close(it, similarity), "a long, b long").distinct(), "close")

    def clusters(self) -> DataFrame:
        """``nodes`` with the cluster of each as its part; close signatures that share a list are in one.

        Lists are those of the byte index, where the bytes that a pair shares
        are counted before its bits, and those of least shingles.
        """
        nodes = self.nodes.withColumn("part", F.col("node"))
        keys = F.concat("keys", F.array(*byte_keys()))
        lists = self.keep(nodes.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("weight")).where("weight > 1"), "lists")

        def posted(of: DataFrame) -> DataFrame:
            return of.select("node", "part", "shingled", *self.words, F.explode(keys).alias("key"))

        edges = self.close(_blocked(posted(nodes), lists, self.cell))
        parted = self.parted(nodes, edges)
        long = lists.where(F.col("weight") > self.cell).select("key")
        if not long.isEmpty():
            across = posted(parted).join(long, "key").withColumn("own_weight", F.lit(1).cast("long"))
            more = self.close(_across(across, self.cell))
            if not more.isEmpty():
                parted = self.parted(nodes, edges.unionByName(more))
        return self.keep(parted.select("node", "part"), "clusters")

    def alike(self, cells: DataFrame) -> DataFrame:
        """Links that connect the parts of each of ``cells(key, cell, node, part)``.

        The texts in question are shingled where they are read. Their ids are
        sent to the tasks that read them if they are few, and joined by a shuffle if not.
        """
        held, similarity = ["node", "shingled", *self.words], self.similarity
        placed = cells.groupBy("node").agg(F.collect_list(F.struct("key", "cell", "part")).alias("cells")).join(self.nodes, "node")
        wanted = self.keep(placed.select("cells", *held, F.col("rep").alias("w_id"), F.col("h1").alias("w_h1"), F.col("h2").alias("w_h2")), "in-question")
        few = F.broadcast(wanted) if wanted.count() <= FEW else wanted
        found = self.rows.join(few, (F.col("id") == F.col("w_id")) & (F.col("h1") == F.col("w_h1")) & (F.col("h2") == F.col("w_h2")))
        if self.repeated:
            found = found.dropDuplicates(["node"])
        sets = found.select("cells", *held, F.pandas_udf(_shingled, T.ArrayType(T.LongType()))("text").alias("set"))
        dealt = sets.select(F.inline("cells"), *held, "set").repartition("key", "cell").sortWithinPartitions("key", "cell", "node")
        return self.keep(dealt.mapInArrow(lambda it: _alike(it, similarity), "a long, b long").distinct(), "links")

    def groups(self) -> DataFrame:
        """``nodes`` with the group of each as its part."""
        weight = F.greatest(F.col("shingled"), F.lit(CELL_SHINGLES // self.cell_texts))
        clusters = self.clusters().withColumnRenamed("part", "key")
        sizes = clusters.join(self.nodes.select("node", weight.alias("own_weight")), "node").groupBy("key").agg(F.sum("own_weight").alias("weight"), F.count(F.lit(1)).alias("n"))
        sizes = self.keep(sizes.where("n > 1"), "cluster-sizes")
        own = F.col("node").alias("part")
        cells = clusters.join(sizes.where(F.col("weight") <= CELL_SHINGLES).select("key"), "key").select("key", F.lit(0).cast("long").alias("cell"), "node", own)
        large = sizes.where(F.col("weight") > CELL_SHINGLES).select(F.col("key").alias("cluster"))
        some = not large.isEmpty()
        if some:
            inside = self.keep(clusters.withColumnRenamed("key", "cluster").join(large, "cluster").join(self.nodes.select("node", "keys", weight.alias("own_weight")), "node"), "large-clusters")
            listed = inside.select("node", "own_weight", F.explode(F.slice("keys", 1, FIRST_LISTS)).alias("key"))
            shared = listed.groupBy("key").agg(F.sum("own_weight").alias("weight"), F.count(F.lit(1)).alias("n")).where("n > 1")
            cells = cells.unionByName(_blocked(listed.drop("own_weight"), shared, CELL_SHINGLES).select("key", "cell", "node", own))
        links = self.alike(cells)
        parted = self.parted(self.nodes, links)
        if some:
            across = inside.join(parted.select("node", "part"), "node").select(F.col("cluster").alias("key"), "node", "part", "own_weight")
            cells = self.keep(_across(across, CELL_SHINGLES).select("key", "cell", "node", "part"), "across")
            if not cells.isEmpty():
                more = self.alike(cells)
                if not more.isEmpty():
                    parted = self.parted(self.nodes, links.unionByName(more))
        return parted.select("node", "rep", "h1", "h2", "part")


def _groups(docs: DataFrame, similarity: float, id_col: str, text_col: str, cell: int = CELL, cell_texts: int = CELL_TEXTS) -> DataFrame:
    rows = _texts(docs, id_col, text_col)
    sign = F.pandas_udf(_signed, T.ArrayType(T.LongType()))
    signed, signed_at = materialize(rows.select("id", "h1", "h2", sign("text").alias("signature")), "signatures")
    distinct = signed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("signature").alias("s"))
    fps = [F.element_at("s", k + 1).alias(f"fp{k}") for k in range(SIGNATURE)]
    # numbered once, when the table is written: an id may belong to several texts
    nodes, _ = materialize(distinct.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "rep", F.element_at("s", -1).alias("shingled"), *fps, F.slice("s", SIGNATURE + 1, LISTS).alias("keys")), "texts")
    repeated = not signed.groupBy("id", "h1", "h2").count().where("count > 1").isEmpty()
    discard(docs.sparkSession, signed_at)
    search = _Search(rows, nodes, repeated, similarity, cell, cell_texts)
    groups, _ = materialize(search.groups(), "groups")
    discard(docs.sparkSession, *search.tables)
    return groups


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL, cell_texts: int = CELL_TEXTS) -> DataFrame:
    """``(rep, h1, h2, component)``: the group of near copies of each distinct text.

    ``rep`` is the smallest id of a text, ``h1`` and ``h2`` are hashes of it, and
    ``component`` is the smallest id of its group. Two texts link if their sets
    of word shingles are as alike as ``similarity`` asks for; texts without
    words are alike.

    Each distinct text has a long SimHash signature of its set, and is posted
    in an inverted index under the joint values of bytes at their places.
    Members of a posting list that share enough bytes are verified bit by bit.
    Signatures at this similarity need share no byte, so texts meet besides in
    lists by the least shingles in random orders, which catch the pairs that
    the index misses. Members of a list whose signatures are close
    are connected, which parts the texts into clusters that no link leaves.
    The texts of a cluster are then brought together with their sets, and
    these decide every close pair that is not connected yet. Nothing emits
    pairs: lists and clusters give forests.

    What is too long for one task is split in blocks. Blocks are searched by
    themselves first; then only members that are still in another part than
    the largest one meet all the others.

    Rows with a null id are left out; a null text is empty. Texts of any
    length are read whole, an empty table has no groups, repeated rows are
    one text, and other columns are not read.
    """
    groups = _groups(docs, similarity, id_col, text_col, cell, cell_texts)
    first = groups.groupBy("part").agg(F.min("rep").alias("component"))
    return groups.join(first, "part").select("rep", "h1", "h2", "component")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies, with their columns.

    Of each group the row with the smallest id stays (of several texts with
    that id the one with the smaller hash). Of rows with that id and text the
    one stays whose columns come first as JSON. Rows with a null id stay, a
    null text is empty, and empty texts are copies of each other. Very long texts are
    compared whole, an empty table stays empty, and columns of any name are returned as they are.
    """
    groups = _groups(docs, similarity, id_col, text_col)
    first = groups.groupBy("part").agg(F.min(F.struct("rep", "h1", "h2")).alias("kept"))
    kept, _ = materialize(first.select(F.col("kept.rep").alias("__kept_id"), F.col("kept.h1").alias("__kept_h1"), F.col("kept.h2").alias("__kept_h2")), "kept")
    own, text = F.col(id_col).cast("long"), text_bytes(text_col)
    h1, h2 = F.xxhash64(text), F.crc32(text)
    stay = docs.where(F.col(id_col).isNotNull()).join(kept, (own == F.col("__kept_id")) & (h1 == F.col("__kept_h1")) & (h2 == F.col("__kept_h2")), "leftsemi")
    nulls = docs.where(F.col(id_col).isNull())
    # only rows that repeat are looked at again, so other texts move once
    twice = docs.groupBy(own.alias("__often"), h1.alias("__often_h1"), h2.alias("__often_h2")).count().where("count > 1 and __often is not null")
    often, _ = materialize(twice.drop("count"), "repeated")
    if often.isEmpty():
        return stay.unionByName(nulls)
    again = (own == F.col("__often")) & (h1 == F.col("__often_h1")) & (h2 == F.col("__often_h2"))
    once = stay.join(often, again, "leftanti")
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    shown = F.to_json(F.struct(*others)) if others else F.lit("")
    place = Window.partitionBy(own, h1, h2).orderBy(shown)
    repeated = stay.join(often, again, "leftsemi").withColumn("__place", F.row_number().over(place)).where("__place = 1").drop("__place")
    return once.unionByName(repeated).unionByName(nulls)
