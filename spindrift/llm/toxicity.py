"""Toxicity by subword-bag embeddings averaged into a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.sampling import labelled_sample, within_bytes
from spindrift.llm.shared import claim, held_out, table, text_bytes

#: Labelled documents to learn from.
MAX_ROWS = 6000
#: A document is predicted toxic from this score on.
THRESHOLD = 0.3
#: Lengths of the character n-grams of a word between its bounds.
SIZES = (3, 4, 5)
#: Vectors that n-grams share by hash, and their width.
BUCKETS = 1 << 17
WIDTH = 12
#: Words averaged into one bag. A document counts as its most toxic bag.
BAG = 24
#: A longer word is read as several words of this many bytes.
LONGEST = 4096
#: Weights of the characters of a whole word, by place.
POWERS = np.cumprod(np.full(LONGEST + 3, 0x100000001B3, np.uint64))
#: Finished words a worker remembers.
REMEMBERED = 300_000


def words_of(data: bytes) -> list[bytes]:
    """Lower-cased words; a run of equal words counts once."""
    words = data.lower().split()
    if len(data) > LONGEST and max(map(len, words), default=0) > LONGEST:
        words = [w[k : k + LONGEST] for w in words for k in range(0, len(w), LONGEST)]
    return [w for w, _ in groupby(words)]


def _bucket(code: np.ndarray) -> np.ndarray:
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 17)).astype(np.int64)


def ngrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every n-gram of every word and the word itself: index of the word, and bucket."""
    texts = ["<" + w.decode("utf-8", "replace") + ">" for w in words]
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    owners, buckets = [], []
    if len(texts):
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])
        place = np.arange(len(chars)) - starts[owner]
        whole = np.add.reduceat((chars + np.uint64(1)) * POWERS[np.minimum(place, len(POWERS) - 1)], starts)
        owners.append(np.arange(len(texts)))
        buckets.append(_bucket(whole))
    for size in SIZES:
        n = len(chars) - size + 1
        if n <= 0:
            continue
        inside = owner[:n] == owner[size - 1 :]
        code = np.full(n, size, np.uint64)
        for k in range(size):
            code = (code ^ chars[k : k + n]) * np.uint64(0x100000001B3)
            code ^= code >> np.uint64(29)
        owners.append(owner[:n][inside])
        buckets.append(_bucket(code)[inside])
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(buckets)


def ordered_ngrams(words: list[bytes], step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """As ``ngrams`` in the order of words, for many words in little memory."""
    owners, buckets = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for lo in range(0, len(words), step):
        owner, bucket = ngrams(words[lo : lo + step])
        order = np.argsort(owner, kind="stable")
        owners.append((owner[order] + lo).astype(np.int32))
        buckets.append(bucket[order].astype(np.int32))
    return np.concatenate(owners), np.concatenate(buckets)


def best_bag(values: np.ndarray) -> tuple[float, int]:
    """The highest mean of ``BAG`` neighbouring words, and where it starts."""
    size = min(BAG, len(values))
    if not size:
        return 0.0, 0
    sums = np.concatenate([[0.0], np.cumsum(values)])
    means = (sums[size:] - sums[:-size]) / size
    at = int(means.argmax())
    return float(means[at]), at


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values (of 32 bits), the place of each element's value among them, and the
    elements in the order of their values with the start of each value."""
    # two passes over 16 bits each, which numpy sorts by counting
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    order = np.take(order, np.argsort((np.take(values, order) >> 16).astype(np.uint16), kind="stable"))
    ordered = np.take(values, order)
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(first) - 1
    starts = np.nonzero(first)[0]
    return ordered[starts], place, order, starts


class SubwordSoftmax:
    """N-gram vectors and a two-class softmax, trained jointly.

    A word is the mean of its n-gram vectors, so a misspelling that was never
    seen shares most of them; a bag is the mean of its words. Training first
    takes bags at random, and then the bag each document scores highest with,
    which for a clean document is its hardest. As the softmax is linear in
    the mean, a word adds one number to the bags it is in, and that number is
    all that scoring needs of it.
    """

    def __init__(self, texts: list[bytes], labels: np.ndarray, steps: int = 3000, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.vectors = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
        self.out = rng.normal(0, 0.1, (WIDTH, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.slope, self.shift = 1.0, 0.0
        self._known: dict[bytes, float] | None = None
        labels = np.asarray(labels, int)
        toxic = labels == 1
        if toxic.any() and not toxic.all():
            self._train(texts, labels, steps, rng)
        else:
            # one kind of label only: every text is like what was seen
            self.shift = -np.inf if toxic.any() else np.inf
        self._finish()

    def _train(self, texts: list[bytes], labels: np.ndarray, steps: int, rng: np.random.Generator) -> None:
        number: dict[bytes, int] = {}
        docs = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int64) for t in texts]
        owner, bucket = ordered_ngrams(list(number))
        if not len(owner):
            return
        begin = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(number)))])
        held = rng.random(len(docs)) < 0.2
        used = np.array([i for i, d in enumerate(docs) if len(d) and not held[i]], np.int64)
        toxic, clean = used[labels[used] == 1], used[labels[used] == 0]
        squares_v, squares_o = np.full(BUCKETS, 1e-3, np.float32), np.full(self.out.shape, 1e-3, np.float32)
        epochs = min(60, max(4, round(steps * 64 / max(2 * len(clean), 1))))
        for epoch in range(epochs):
            if epoch < epochs // 3 or not len(toxic):
                at = [int(rng.integers(max(1, len(docs[i]) - BAG + 1))) for i in used]
            else:
                value = self._values(bucket, begin)
                at = [best_bag(value[docs[i]])[1] for i in used]
            where = dict(zip(used.tolist(), at, strict=True))
            more = rng.choice(toxic, len(clean)) if len(toxic) else toxic
            todo = rng.permutation(np.concatenate([clean, more]))
            for lo in range(0, len(todo), 64):
                part = todo[lo : lo + 64]
                bags = [docs[i][where[i] : where[i] + BAG] for i in part]
                grad_o, grad_b, rows, grad_v = self.gradients(bags, labels[part], begin, bucket)
                squares_o += grad_o**2
                self.out -= 0.3 * grad_o / np.sqrt(squares_o)
                self.bias -= 0.02 * grad_b / len(part)
                squares = np.take(squares_v, rows) + np.einsum("ij,ij->i", grad_v, grad_v) / WIDTH
                squares_v[rows] = squares
                self.vectors[rows] = np.take(self.vectors, rows, axis=0) - grad_v * (0.3 / np.sqrt(squares))[:, None]
        value = self._values(bucket, begin)
        raw = np.array([best_bag(value[d])[0] for d in docs]) + float(self.bias[1] - self.bias[0])
        self._calibrate(raw[held] if (labels[held] == 1).sum() >= 20 else raw, labels[held] if (labels[held] == 1).sum() >= 20 else labels)

    def gradients(self, bags: list[np.ndarray], labels: np.ndarray, begin: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of the bags' summed cross-entropy: by the softmax, its bias, and the vectors of the buckets given third.

        A bag holds numbers of words, and word ``w`` the buckets ``bucket[begin[w] : begin[w + 1]]``.
        """
        sizes = np.array([len(b) for b in bags])
        # each word is looked up once, however many bags it is in
        words, turn, grouped, at_word = _runs(np.concatenate(bags))
        lengths = begin[words + 1] - begin[words]
        ends = np.cumsum(lengths)
        grams = bucket[np.repeat(begin[words] - (ends - lengths), lengths) + np.arange(ends[-1])]
        word = np.add.reduceat(np.take(self.vectors, grams, axis=0), ends - lengths, axis=0) / lengths[:, None].astype(np.float32)
        of_bag = np.repeat(np.arange(len(bags)), sizes)
        share = (1.0 / sizes).astype(np.float32)
        mean = np.add.reduceat(np.take(word, turn, axis=0), np.cumsum(sizes) - sizes, axis=0) * share[:, None]
        logit = mean @ self.out + self.bias
        chance = np.exp(logit - logit.max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        chance[np.arange(len(bags)), labels] -= 1
        down = (chance @ self.out.T * share[:, None]).astype(np.float32)
        grad_w = np.add.reduceat(np.take(down, np.take(of_bag, grouped), axis=0), at_word, axis=0) / lengths[:, None].astype(np.float32)
        rows, _, grouped, at_row = _runs(grams)
        of_word = np.take(np.repeat(np.arange(len(words)), lengths), grouped)
        return mean.T @ chance, chance.sum(0), rows, np.add.reduceat(np.take(grad_w, of_word, axis=0), at_row, axis=0)

    def _calibrate(self, raw: np.ndarray, labels: np.ndarray) -> None:
        """Put the cut with the best F1 on ``THRESHOLD``."""
        order = np.argsort(-raw, kind="stable")
        hits = np.cumsum(labels[order] == 1)
        f1 = 2 * hits / (np.arange(1, len(raw) + 1) + max(1, (labels == 1).sum()))
        best = np.nonzero(f1 >= f1.max() - 1e-12)[0]
        cut = int(best[len(best) // 2])
        s = raw[order]
        self.shift = float((s[cut] + s[min(cut + 1, len(s) - 1)]) / 2)
        self.slope = float(4 / max(np.std(raw), 1e-6))

    def _values(self, bucket: np.ndarray, begin: np.ndarray) -> np.ndarray:
        of_bucket = (self.vectors @ (self.out[:, 1] - self.out[:, 0])).astype(np.float64)
        # a word has one n-gram at least, itself
        return np.add.reduceat(of_bucket[bucket], begin[:-1]) / np.diff(begin)

    def _finish(self) -> None:
        self.buckets = (self.vectors @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32)

    def __getstate__(self) -> dict:
        """Workers need what each n-gram adds, not the vectors."""
        return {k: v for k, v in self.__dict__.items() if k not in ("vectors", "out")} | {"_known": None}

    def word_values(self, words: list[bytes]) -> np.ndarray:
        owner, bucket = ngrams(words)
        return np.bincount(owner, weights=self.buckets[bucket], minlength=len(words)) / np.maximum(np.bincount(owner, minlength=len(words)), 1)

    def forget(self) -> None:
        self._known = None

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Between 0 and 1; a text without words scores as a neutral bag."""
        if not np.isfinite(self.shift):
            return np.full(len(texts), 1.0 if self.shift < 0 else 0.0)
        if self._known is None or len(self._known) > REMEMBERED:
            self._known = {}
        known = self._known
        raw = np.zeros(len(texts))
        docs: list[tuple[int, list[bytes]]] = []
        new: dict[bytes, None] = {}
        size = 0

        def flush() -> None:
            nonlocal docs, new, size
            if new:
                fresh = list(new)
                known.update(zip(fresh, self.word_values(fresh).tolist(), strict=True))
            for i, words in docs:
                raw[i] = best_bag(np.fromiter(map(known.__getitem__, words), np.float64, len(words)))[0]
            docs, new, size = [], {}, 0

        for i, text in enumerate(texts):
            words = words_of(text)
            docs.append((i, words))
            new.update(dict.fromkeys([w for w in words if w not in known]))
            size += len(words)
            if size >= 100_000:
                flush()
                if len(known) > REMEMBERED:
                    known.clear()
        flush()
        z = (raw + float(self.bias[1] - self.bias[0]) - self.shift) * self.slope
        return 1 / (1 + np.exp(-np.clip(z + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> SubwordSoftmax:
    rows = sorted((r["id"], r["label"], r["text"]) for r in within_bytes(labelled_sample(docs, labels, "toxic", max_rows)))
    return SubwordSoftmax([r[2].encode() for r in rows], np.array([r[1] for r in rows], int))


def score_column(spark: SparkSession, model: SubwordSoftmax, text_col: str = "text") -> Column:
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim(f"toxicity {id(sent.value)}", sent.value.forget)
        for texts in batches:
            yield pd.Series(sent.value.score(list(texts)), dtype="float64")

    return score(text_bytes(text_col))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, held_out, score, predicted)`` for every row of ``docs``.

    Null texts are scored as empty ones, texts of any length whole. A null id
    is held out. Repeated rows each come back. With labels of one kind only, or none, all rows score as
    that kind (clean if there are none). Empty tables give empty results.
    Other columns are not read.
    """
    score = score_column(docs.sparkSession, fit(docs, labels), text_col)
    rows = docs.select(F.col(id_col), held_out(id_col, 4).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
