"""Language ID by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm.shared import claim, held_out, table, text_bytes

#: Longest context in bytes.
ORDER = 4
#: Training sample: documents of a language, and characters that are taken of each,
#: of a longer text from a place that its hash gives.
MAX_DOCS = 800
MAX_TEXT = 100_000
#: Bytes of the sample; every language has an equal part, and one document at least.
SAMPLE_BYTES = 256 << 20
#: Bytes scored at a time, and bytes of a worker's table of finished grams.
PIECE = 1 << 18
TABLE_BYTES = 48 << 20
#: Stands before every text as its first context.
START = b"\n" * ORDER
UNKNOWN = "und"
#: A document is rejected if no language has this posterior probability.
MIN_SCORE = 0.5


def _grams(data: np.ndarray, width: int) -> np.ndarray:
    """Every run of ``width`` bytes, as one number."""
    n = len(data) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        out = (out << np.uint64(8)) | data[k : k + n]
    return out


class ContextTrees:
    """One tree of byte contexts for each language, with frozen counts.

    A context of ``k`` bytes that was seen ``n`` times before ``d`` distinct
    bytes gives a byte seen ``c`` times after it the probability
    ``c / (n + d)`` and escapes to its suffix with ``d / (n + d)`` (method C
    of PPM, without exclusion). A context that was never seen escapes at no
    cost, and below the empty context every byte has 1/256. With frozen
    counts the code length of a byte depends on nothing but the bytes of the
    longest context and itself, so it is computed once for each such gram.
    """

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        size = len(self.languages)
        self.grams: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.totals: list[np.ndarray] = []
        self.kinds: list[np.ndarray] = []
        texts = [[np.frombuffer(START + x.lower(), np.uint8) for x in samples[name]] for name in self.languages]
        for order in range(ORDER + 1):
            each = [np.unique(np.concatenate([_grams(x[ORDER - order :], order + 1) for x in own] or [np.zeros(0, np.uint64)]), return_counts=True) for own in texts]
            keys = np.unique(np.concatenate([k for k, _ in each] or [np.zeros(0, np.uint64)]))
            counts = np.zeros((len(keys), size), np.float32)
            for j, (k, c) in enumerate(each):
                counts[np.searchsorted(keys, k), j] = c
            contexts, where = np.unique(keys >> np.uint64(8), return_inverse=True)
            totals, kinds = (np.zeros((len(contexts), size), np.float32) for _ in range(2))
            np.add.at(totals, where, counts)
            np.add.at(kinds, where, (counts > 0).astype(np.float32))
            for to, x in ((self.grams, keys), (self.counts, counts), (self.contexts, contexts), (self.totals, totals), (self.kinds, kinds)):
                to.append(x)
        self._slots: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_slots": None}

    def forget(self) -> None:
        self._slots = None

    def lengths(self, grams: np.ndarray) -> np.ndarray:
        """Code length in bits of the last byte of each gram, by language."""
        bits = np.zeros((len(grams), len(self.languages)))
        going = np.ones(bits.shape, bool)
        for order in range(ORDER, -1, -1):
            key = grams & np.uint64((1 << 8 * (order + 1)) - 1)
            count = self._find(self.grams[order], key, self.counts[order])
            total = self._find(self.contexts[order], key >> np.uint64(8), self.totals[order])
            kind = self._find(self.contexts[order], key >> np.uint64(8), self.kinds[order])
            known = going & (total > 0)
            hit, miss = known & (count > 0), known & (count == 0)
            bits[hit] += np.log2((total[hit] + kind[hit]) / count[hit])
            bits[miss] += np.log2((total[miss] + kind[miss]) / kind[miss])
            going &= ~hit
        bits[going] += 8
        return bits

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros((len(wanted), rows.shape[1]))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((keys[at] == wanted)[:, None], rows[at], 0.0).astype(np.float64)

    def _cached(self, grams: np.ndarray) -> np.ndarray:
        """As ``lengths``, through a direct-mapped table of finished grams."""
        if self._slots is None:
            power = int(np.log2(TABLE_BYTES / (8 + 4 * len(self.languages))))
            self._slots = (np.full(1 << power, np.iinfo(np.uint64).max), np.zeros((1 << power, len(self.languages)), np.float32), np.uint64(64 - power))
        keys, values, shift = self._slots
        slot = (grams * np.uint64(0x9E3779B97F4A7C15)) >> shift
        for _ in range(2):
            missing = np.nonzero(keys[slot] != grams)[0]
            if not len(missing):
                return values[slot]
            new = np.unique(grams[missing])
            at, first = np.unique((new * np.uint64(0x9E3779B97F4A7C15)) >> shift, return_index=True)
            keys[at], values[at] = new[first], self.lengths(new[first])
        out = values[slot].astype(np.float64)
        missing = np.nonzero(keys[slot] != grams)[0]
        out[missing] = self.lengths(grams[missing])
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits that each text takes under each language's tree."""
        out = np.zeros((len(texts), len(self.languages)))
        piece: list[bytes] = []
        owner: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal piece, owner, held
            if piece:
                data = np.frombuffer(b"".join(piece), np.uint8)
                bits = self._cached(_grams(data, ORDER + 1))
                ends = np.cumsum([len(x) for x in piece])
                starts = ends - [len(x) for x in piece]
                bounds = np.stack([starts, ends - ORDER], 1).ravel()
                bounds = bounds[:-1] if bounds[-1] >= len(bits) else bounds
                np.add.at(out, owner, np.add.reduceat(bits, bounds, axis=0, dtype=np.float64)[::2])
            piece, owner, held = [], [], 0

        for i, text in enumerate(texts):
            data = START + text.lower()
            for lo in range(0, len(text), PIECE):
                part = data[lo : lo + PIECE + ORDER]
                piece.append(part)
                owner.append(i)
                held += len(part)
                if held >= PIECE:
                    flush()
        flush()
        return out

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its posterior probability."""
        bits = self.code_lengths(texts)
        best = bits.argmin(axis=1)
        odds = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000))
        return best, 1 / odds.sum(axis=1)


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, max_text: int = MAX_TEXT) -> DataFrame:
    """At most ``max_docs`` texts of each language, the same on every run.

    Rows are taken in the order of a hash of id and text, as long as the
    language's part of ``SAMPLE_BYTES`` lasts. Texts over ``max_text``
    characters give a piece of that length. A first pass over the labels sets a
    cut on the hash, so that later steps handle a small multiple of the sample
    and not the corpus.
    """
    label = F.col(lang_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), label.alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    rows = rows.where(~held_out("id", 4)).where(F.octet_length("text") > 0)
    # a row for each language, as the model has a tree for each
    sizes = rows.groupBy("lang").count().collect()
    order = F.xxhash64("id", "text")
    begin = F.when(F.length("text") > max_text, F.pmod(order, F.length("text") - max_text + 1)).otherwise(0).cast("int") + 1
    share = F.pmod(order, F.lit(1 << 20)) / float(1 << 20)
    cuts = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (2.0 * max_docs + 1000.0) / r["count"])) for r in sizes], "l_lang string, cut double")
    ranked = rows.join(F.broadcast(cuts), F.col("lang") == F.col("l_lang")).where(share < F.col("cut"))
    ranked = ranked.select("lang", "id", order.alias("order"), F.col("text").substr(begin, F.lit(max_text)).alias("text"))
    by = Window.partitionBy("lang").orderBy("order", "id")
    before = F.coalesce(F.sum(F.octet_length("text")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = SAMPLE_BYTES // max(len(sizes), 1)
    few = ranked.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= max_docs)
    return few.withColumn("before", before).where(F.col("before") < room).select("lang", "text")


def fit(docs: DataFrame, **columns) -> ContextTrees:
    samples: dict[str, list[bytes]] = {}
    for row in training_sample(docs, **columns).toLocalIterator():
        samples.setdefault(row["lang"], []).append(row["text"].encode())
    return ContextTrees(samples)


def predictor(spark: SparkSession, model: ContextTrees):
    """A column function from UTF-8 texts to ``struct<lang, score>``."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trees = sent.value
        claim(f"langid {id(trees)}", trees.forget)
        names = np.array(trees.languages, dtype=object)
        for texts in batches:
            best, score = trees.predict(list(texts))
            yield pd.DataFrame({"lang": names[best], "score": score})

    return predict


def predictions(docs: DataFrame, model: ContextTrees, text_col: str = "text") -> tuple[Column, Column]:
    """Columns of the predicted language and its probability.

    Texts that are null or hold no letter, and all texts if nothing could be
    learned, are ``und`` with probability 0.
    """
    if not model.languages:
        return F.lit(UNKNOWN), F.lit(0.0)
    letters = F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))
    said = predictor(docs.sparkSession, model)(text_bytes(text_col))
    return F.when(letters, said["lang"]).otherwise(UNKNOWN), F.when(letters, said["score"]).otherwise(0.0)


def identify(docs: DataFrame, model: ContextTrees | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(id_col, held_out, lang_pred, score)`` for every row of ``docs``.

    Learns from rows whose language is known and which are not held out, then
    scores whole texts. Null and letterless texts are ``und``; repeated rows
    each come back; a null id is held out; an empty table gives an empty
    result. Very long texts are read piece by piece, whole. Other columns are not read. Equal code lengths go to the language
    that sorts first.
    """
    model = model or fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    lang, score = predictions(docs, model, text_col)
    return docs.select(F.col(id_col), held_out(id_col, 4).alias("held_out"), lang.alias("lang_pred"), score.cast(T.DoubleType()).alias("score"))


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is identified, with their columns.

    Null, empty and letterless texts go; texts of any length are read whole;
    repeated rows all stay or all go; rows with a null id are judged like
    others; an empty table stays empty, and columns of any name are returned
    as they are.
    """
    lang, score = predictions(docs, fit(docs))
    return docs.where((lang != UNKNOWN) & (score >= min_score))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
