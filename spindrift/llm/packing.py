"""Packing documents into sequences along a space-filling curve."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.prefix import running_sum
from spindrift.llm.shared import claim, materialize, table, text_bytes

#: Tokens in a sequence, and the id that ends a document.
LENGTH = 4096
END = 2
#: Tokens of a mixture that are sorted along the curve at a time.
WINDOW = 256 * LENGTH
#: Width of the hashed document vectors, and what they are projected to.
HASHED = 256
DIMENSIONS = 4
BITS = 15
#: Words a worker remembers the ids of, and the longest of them in bytes.
REMEMBERED = 600_000
LONGEST = 64


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell coordinates (Skilling 2004)."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    step = np.uint64(1 << (bits - 1))
    while step > one:
        low = step - one
        for i in range(n):
            high = (x[i] & step) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        step >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    step = np.uint64(1 << (bits - 1))
    while step > one:
        flip = np.where((x[n - 1] & step) != 0, flip ^ (step - one), flip)
        step >>= one
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(bit)) & one)
    return key.astype(np.int64)


class Placer:
    """Projects hashed vectors of token ids and finds their place on the curve."""

    def __init__(self, vocabulary: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bucket = rng.integers(HASHED, size=vocabulary)
        self.sign = rng.choice([-1.0, 1.0], vocabulary)
        self.axes = rng.normal(size=(HASHED, DIMENSIONS))

    def vector(self, ids: np.ndarray) -> np.ndarray:
        hashed = np.bincount(self.bucket[ids], weights=self.sign[ids], minlength=HASHED)
        return hashed / max(np.sqrt(hashed @ hashed), 1e-12)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        spread = 1 / (1 + np.exp(-1.702 * (vectors @ self.axes)))
        return hilbert_key(np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


#: A word of lower-case Latin letters and the ASCII marks after it.
PLAIN = re.compile("([a-z\u00df-\u00f6\u00f8-\u024f]+)([!-/:-@\\[-`{-~]*)")


class WordIds(dict):
    """Token ids, as packed numbers, of words between ASCII white space.

    No token and no rule of the tokenizer reaches over white space, so the
    ids of a text are those of its words in turn. Marks that end a word are a
    pre-token of their own, so a plain word is looked up without them. Plain
    words are composed already and need no more normalizing than lower case,
    so the model is asked directly; all others take the whole way.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_str(spec)
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.parts: dict[str, bytes] = {}
        letters = "".join(map(chr, [*range(97, 123), *range(0xDF, 0x250)]))
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {ord(c): level.pre_tokenize_str(c)[0][0] for c in letters}
        probe = ["stone", "été", "größer", "ñandú"]
        self.direct = all(self._model(w) == self._whole(w) for w in probe) and all(self._whole(w + "!?") == self._whole(w) + self._whole("!?") for w in probe)

    def _model(self, word: str) -> bytes:
        return array(self.kind, [t.id for t in self.tokenizer.model.tokenize(word.translate(self.as_bytes))]).tobytes()

    def _whole(self, word: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str, find) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = find(part)
            if len(part) <= LONGEST:
                self.parts[part] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        plain = PLAIN.fullmatch(text.lower()) if self.direct else None
        if plain:
            ids = self._part(plain[1], self._model)
            if plain[2]:
                ids += self._part(plain[2], self._whole)
        else:
            ids = self._whole(text)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def of(self, text: bytes) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        return b"".join(map(self.__getitem__, text.split()))


_words: dict[int, tuple[WordIds, Placer]] = {}


def _tokenized(batches: Iterator[pa.RecordBatch], spec, end: int) -> Iterator[pa.RecordBatch]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    claim("packing", _words.clear)
    key = hash(spec.value)
    if key not in _words:
        _words.clear()
        words = WordIds(spec.value)
        _words[key] = words, Placer(max(words.tokenizer.get_vocab_size(), end + 1))
    words, placer = _words[key]
    shrink = zstandard.ZstdCompressor(level=1).compress
    last = array(words.kind, [end]).tobytes()
    for batch in batches:
        rows: list[bytes] = []
        counts, vectors = [], []
        for text in batch.column("text").to_pylist():
            ids = words.of(text) + last
            found = np.frombuffer(ids, words.kind)
            counts.append(len(found))
            vectors.append(placer.vector(found))
            rows.append(shrink(ids))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(counts, pa.int64()), pa.array(placer.keys(np.array(vectors))), pa.array(rows, pa.binary())], names=[*(c for c in batch.schema.names if c != "text"), "tokens", "place", "ids"]
            )


def _cut(batches: Iterator[pa.RecordBatch], kind: str, length: int) -> Iterator[pa.RecordBatch]:
    grow = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for doc, packed, begin in zip(*(batch.column(c).to_pylist() for c in ("id", "ids", "begin")), strict=True):
            ids = np.frombuffer(grow(packed), kind)
            n = len(ids)
            at = 0
            while at < n:
                offset = (begin + at) % length
                size = min(length - offset, n - at)
                crc = zlib.crc32(ids[at : at + size].astype("<u4").tobytes())
                for to, value in zip(out, (doc, at, size, crc, n, (begin + at) // length, offset), strict=True):
                    to.append(value)
                at += size
        if out[0]:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)


def _row_order(docs: DataFrame) -> list[Column]:
    """Two numbers that give the order of rows: in files as written, or else of partitions.

    A scan deals files out by their size, so the place in it is not the order.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        number = F.expr("try_cast(regexp_extract(_metadata.file_name, '^part-([0-9]+)', 1) as long)")
        return [F.coalesce(number, F.lit(0).cast("long")), F.col("_metadata.row_index").cast("long")]
    return [F.lit(0).cast("long"), F.monotonically_increasing_id()]


def pack(
    docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text", window: int | None = None
) -> DataFrame:
    """One row for each piece of a document in a packed sequence.

    Documents are laid end to end along a Hilbert curve through their
    projected vectors, so neighbours share sequences, and cut every
    ``length`` tokens; only the last sequence of all is padded. Returns
    ``(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset)``.
    A null or empty text is the id ``end`` alone. Documents in the same place
    follow each other by id, null ids first; repeated rows are packed as
    often as they come. An empty table gives an empty result. Other columns
    are not read. ``tokenizer`` is the path of a ``tokenizers`` file.

    With ``window`` the order of the rows is kept but for windows of so many
    tokens: documents are sorted along the curve within the window they start
    in, and windows follow each other. So a mixture of sources stays one.
    """
    spark = docs.sparkSession
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    words = WordIds(Path(tokenizer).read_text(encoding="utf-8"))
    kind = "<u2" if words.kind == "H" else "<u4"
    spec = spark.sparkContext.broadcast(words.tokenizer.to_str())
    order = [c.alias(name) for c, name in zip(_row_order(docs), ("file", "nth"), strict=True)] if window else []
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *order, F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    kind_of = "row long, file long, nth long, id long" if window else "row long, id long"
    tokenized, _ = materialize(rows.mapInArrow(lambda it: _tokenized(it, spec, end), f"{kind_of}, tokens long, place long, ids binary"), "tokens", "uncompressed")
    curve = ["place", "id", "row"]
    if window:
        mixed = running_sum(tokenized.drop("ids"), ["file", "nth", "row"], "tokens", "before")
        sizes = mixed.select("row", "id", "tokens", "place", F.floor(F.col("before") / window).alias("window"))
        curve = ["window", *curve]
    else:
        sizes = tokenized.select("row", "id", "tokens", "place")
    placed = running_sum(sizes, curve, "tokens", "begin")
    # the side without the ids is small in every partition, so it is the one hashed
    joined = tokenized.select("row", "id", "ids").join(placed.select("row", "begin").hint("shuffle_hash"), "row")
    pieces = joined.select("id", "ids", "begin").mapInArrow(
        lambda it: _cut(it, kind, length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return pieces.withColumnRenamed("doc_id", id_col)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
