"""Quality scores learned by Bradley-Terry pairwise ranking."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.sampling import labelled
from spindrift.llm.shared import claim, discard, held_out, materialize, nothing, table, text_bytes

#: Places of scores, to a unit, for the sums over pairs, and for their curvature alone.
FINE = 8
COARSE = 2
#: Labelled documents whose features the driver takes; those of more stay where they are. Both give the same weights.
TAKEN = 12_000
#: Tasks in which these are gone through, each of which sends its sums to the driver.
TASKS = 48
#: A document is good if its score is at least this.
THRESHOLD = 0.7
FLOOR = 1e-3
#: Buckets that runs of three bytes share by hash.
BUCKETS = 256
#: Bytes of a text that are hashed at a time.
PART = 1 << 20
#: Penalty on the squares of the weights, for each pair.
RIDGE = 1e-3

_KIND = np.zeros(256, np.int64)
for _kind, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"()-?", b" \t\n\v\f\r", b"!", b"|<>{}[]=_/\\"), 1):
    _KIND[list(_bytes)] = _kind
_KIND[128:] = 8
FEATURES = ("symbols", "capitals", "digits", "points", "shouts", "marks", "foreign", "repeats", "word length", "words", "kinds of words")


def content(data: bytes) -> np.ndarray:
    """Square roots of the shares that hashed runs of three lower-cased bytes have in one whole text."""
    tally = np.zeros(BUCKETS)
    codes = np.frombuffer(data.lower(), np.uint8)
    for lo in range(0, len(codes) - 2, PART):
        part = codes[lo : lo + PART + 2].astype(np.uint32)
        code = (part[:-2] << 16 | part[1:-1] << 8 | part[2:]) * np.uint32(0x9E3779B1)
        tally += np.bincount(code >> np.uint32(24), minlength=BUCKETS)
    return np.sqrt(tally / max(tally.sum(), 1))


def statistics(data: bytes) -> np.ndarray:
    """Statistics of one whole text that do not depend on its language."""
    sizes = np.bincount(_KIND, weights=np.bincount(np.frombuffer(data, np.uint8), minlength=256), minlength=9)
    other, lower, upper, digits, points, blank, shouts, marks, high = sizes
    n = max(len(data), 1)
    words = data.split()
    count = max(len(words), 1)
    share = np.array([other / n, upper / max(lower + upper, 1), digits / n, points / n, shouts / n, marks / n, high / n, sum(map(eq, words, words[1:])) / count])
    return np.r_[np.log(share + FLOOR), np.log1p((n - blank) / count), np.log1p(len(words)), np.log((len(set(words)) + 1) / (count + 1))]


def features(data: bytes) -> np.ndarray:
    """How one whole text is written, and of what."""
    return np.r_[statistics(data), content(data)]


def preferences(gap: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights that minimize the mean logistic loss of ``gap``, features of the preferred less those of the other.

    Half the squares of the weights, ``ridge`` times, are added to the loss, which makes the minimum the only one.
    """
    weights = np.zeros(gap.shape[1])
    penalty = ridge * np.eye(len(weights))
    for _ in range(25):
        lost = 1 / (1 + np.exp(np.clip(gap @ weights, -50, 50)))
        slope = gap.T @ lost / len(gap) - ridge * weights
        curve = (gap * (lost * (1 - lost))[:, None]).T @ gap / len(gap) + penalty
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return weights


Step = Callable[[np.ndarray, np.ndarray], list]


def added(a: list, b: list) -> list:
    return [x + y for x, y in zip(a, b, strict=True)]


def deposited(scores: np.ndarray, fineness: int, cubic: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places near each score and the shares of it that they take, by cubic or linear interpolation."""
    low = np.floor(scores * fineness)
    t = scores * fineness - low
    if not cubic:
        return low[:, None].astype(np.int64) + np.arange(2), np.stack([1 - t, t], axis=1)
    shares = np.stack([-t * (t - 1) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6], axis=1)
    return low[:, None].astype(np.int64) + np.arange(-1, 3), shares


class Masses:
    """How many rows of each label lie at each place of a grid of scores."""

    def __init__(self, places: np.ndarray, mass: np.ndarray):
        self.places, own = np.unique(places, return_inverse=True)
        self.mass = np.stack([np.bincount(own.ravel(), weights=m.ravel(), minlength=len(self.places)) for m in mass])

    def __add__(self, other: Masses) -> Masses:
        return Masses(np.r_[self.places, other.places], np.concatenate([self.mass, other.mass], axis=1))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def all_pairs(over: Callable[[Step], list], size: int, ridge: float = RIDGE) -> np.ndarray:
    """Weights with the least mean logistic loss of all pairs of a good and a bad row, and half their squares, ``ridge`` times.

    ``over`` gives the sums of a step over all rows, as standardized features and labels. Every pair counts, and none is
    formed: the loss of a pair is a smooth function of two scores, so the rows of one label act on a score through
    their masses on a fine grid, to which cubic interpolation brings them with an error of about 1e-6. The curvature, which
    only leads the way to the minimum, is that of scores on a coarser grid.
    """

    def at(weights: np.ndarray) -> tuple[float, Masses, Masses]:
        def weigh(z: np.ndarray, label: np.ndarray) -> list:
            scores, out = z @ weights, []
            for fineness, cubic in ((FINE, True), (COARSE, False)):
                places, shares = deposited(scores, fineness, cubic)
                out.append(Masses(places, np.stack([shares * (label == k)[:, None] for k in (0, 1)])))
            return out

        fine, coarse = over(weigh)
        bad, good = fine.mass
        gap = (fine.places[:, None] - fine.places[None, :]) / FINE
        loss = good @ np.logaddexp(0, -gap) @ bad / (good.sum() * bad.sum()) + ridge / 2 * weights @ weights
        return float(loss), fine, coarse

    weights = np.zeros(size)
    loss, fine, coarse = at(weights)
    bad, good = coarse.mass.sum(axis=1)
    pairs = bad * good
    for _ in range(50):

        def slopes(z: np.ndarray, label: np.ndarray, weights=weights, fine=fine, coarse=coarse) -> list:
            scores = z @ weights
            slope, curve, sums = np.zeros(size), np.zeros((size, size)), []
            for k, sign in ((0, -1), (1, 1)):
                own, s = z[label == k], scores[label == k]
                # how often the rows are on the wrong side of those of the other label
                slope += sign * (own.T @ (_logistic(sign * (fine.places / FINE - s[:, None])) @ fine.mass[1 - k]))
                places, shares = deposited(s, COARSE, False)
                where = np.searchsorted(coarse.places, places)
                spread = np.zeros((len(s), len(coarse.places)))
                np.put_along_axis(spread, where, shares, axis=1)
                sums.append(spread.T @ own)
                curve += (own * (spread @ (bent(coarse) @ coarse.mass[1 - k]))[:, None]).T @ own
            return [slope, curve, *sums]

        slope, curve, by_bad, by_good = over(slopes)
        cross = by_good.T @ bent(coarse) @ by_bad
        step = np.linalg.solve((curve - cross - cross.T) / pairs + ridge * np.eye(size), slope / pairs - ridge * weights)
        share = 1.0
        while True:
            moved = weights + share * step
            new = at(moved)
            if new[0] <= loss + 1e-6 or share < 1e-3:
                break
            share /= 2
        weights, (loss, fine, coarse) = moved, new
        if np.abs(share * step).max() < 1e-6:
            break
    return weights


def bent(coarse: Masses) -> np.ndarray:
    """The curvature of the loss between all places."""
    p = _logistic((coarse.places[:, None] - coarse.places[None, :]) / COARSE)
    return p * (1 - p)


class PairwiseRanker:
    """Linear Bradley-Terry scores: P(a is preferred to b) = sigmoid(s(a) - s(b)).

    Statistics, their squares and the content enter, standardized. Every good
    row is compared with every bad one. ``threshold`` is the
    score at ``quantile`` of the training scores; without one it is the
    quantile that separates the labels best.
    """

    def __init__(self, x: np.ndarray, label: np.ndarray, quantile: float | None = None):
        x, label = np.asarray(x, float).reshape(-1, len(FEATURES) + BUCKETS), np.asarray(label, int)
        parts = range(0, len(x), 4096)
        self._learn(lambda step, add: reduce(add, (step(x[a : a + 4096], label[a : a + 4096]) for a in parts)) if len(x) else None, quantile)

    @classmethod
    def of_table(cls, rows: DataFrame, quantile: float | None = None) -> PairwiseRanker:
        """Learned from all of ``rows(label, x)``, where ``x`` holds features as bytes, which stay where they are."""
        rows = rows.select("label", "x").coalesce(TASKS)

        def over(step, add):
            def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                state = None
                for batch in batches:
                    if batch.num_rows:
                        x = np.frombuffer(b"".join(batch.column("x").to_pylist())).reshape(batch.num_rows, -1)
                        one = step(x, batch.column("label").to_numpy())
                        state = one if state is None else add(state, one)
                if state is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], names=["state"])

            states = [pickle.loads(r["state"]) for r in rows.mapInArrow(part, "state binary").collect()]
            return reduce(add, states) if states else None

        model = cls.__new__(cls)
        model._learn(over, quantile)
        return model

    def _learn(self, over: Callable[[Step, Callable], list | None], quantile: float | None) -> None:
        """``over`` goes through all rows: a step of each block, and what brings two of its results together."""
        size = 2 * len(FEATURES) + BUCKETS
        self.mean, self.scale, self.weights = np.zeros(size), np.ones(size), np.zeros(size)
        self.threshold, self.quantile = 0.0, quantile
        both = self._both
        seen = over(lambda x, label: [len(x), np.bincount(label, minlength=2), both(x).sum(axis=0)], added)
        if seen:
            n, (bad, good), total = seen
            mean = total / n
            (squares,) = over(lambda x, label: [((both(x) - mean) ** 2).sum(axis=0)], added)
            self.mean, self.scale = mean, np.sqrt(squares / n) + 1e-9
        # the many hashed runs have as much room together as the statistics and their squares
        self.scale[len(FEATURES) : len(FEATURES) + BUCKETS] /= np.sqrt(2 * len(FEATURES) / BUCKETS)
        if not seen or not bad or not good:
            # nothing to compare: everything is as good as what was seen
            self.threshold = 1.0 if seen and bad else -1.0
            return
        mean, scale = self.mean, self.scale
        self.weights = weights = all_pairs(lambda step: over(lambda x, label: step((both(x) - mean) / scale, label), added), size)
        scores, label = over(lambda x, label: [((both(x) - mean) / scale) @ weights, label.astype(np.int8)], lambda a, b: [np.r_[x, y] for x, y in zip(a, b, strict=True)])
        order = np.argsort(scores, kind="stable")
        right = np.r_[0, np.cumsum(label[order] == 0)] + np.r_[np.cumsum((label[order] == 1)[::-1])[::-1], 0]
        if quantile is None:
            cuts = np.nonzero(right == right.max())[0]
            quantile = int(cuts[len(cuts) // 2]) / len(scores)
        self.quantile = quantile
        cut = round(quantile * len(scores))
        s = scores[order]
        self.threshold = float((s[min(max(cut - 1, 0), len(s) - 1)] + s[min(cut, len(s) - 1)]) / 2)

    @staticmethod
    def _both(x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float).reshape(-1, len(FEATURES) + BUCKETS)
        return np.concatenate([x, x[:, : len(FEATURES)] ** 2], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, and ``THRESHOLD`` just at the learned quantile."""
        raw = ((self._both(x) - self.mean) / self.scale) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(raw + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def feature_column(text: Column) -> Column:
    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        claim("quality", nothing)
        return pd.Series([features(x).tobytes() for x in texts])

    return of(text)


def fit(docs: DataFrame, labels: DataFrame, taken: int = TAKEN, quantile: float | None = None) -> PairwiseRanker:
    """A ranker that learned from every labelled document that is not held out."""
    rows, path = materialize(labelled(docs, labels, "quality").select("id", "label", feature_column(text_bytes("text")).alias("x")), "features")
    if rows.count() > taken:
        model = PairwiseRanker.of_table(rows, quantile)
    else:
        known = sorted((r["id"], r["label"], r["x"]) for r in rows.collect())
        model = PairwiseRanker(np.frombuffer(b"".join(r[2] for r in known)), np.array([r[1] for r in known], int), quantile)
    discard(docs.sparkSession, path)
    return model


def score_column(spark: SparkSession, model: PairwiseRanker, text_col: str = "text") -> Column:
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("quality", nothing)
        for texts in batches:
            x = np.array([features(t) for t in texts]).reshape(-1, len(FEATURES) + BUCKETS)
            yield pd.Series(sent.value.score(x), dtype="float64")

    return score(text_bytes(text_col))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quantile: float | None = None) -> DataFrame:
    """``(id_col, held_out, score, predicted)`` for every row of ``docs``.

    ``predicted`` is 1 from ``quantile`` of the scores of labelled documents
    on; by default from the quantile that separates the labels best.

    Null texts are scored as empty ones, texts of any length whole. A null id
    is held out. Repeated rows each come back. Without labels of both kinds every row is on the side of
    the labels seen (good if there are none). Empty tables give empty results.
    Other columns are not read.
    """
    score = score_column(docs.sparkSession, fit(docs, labels, quantile=quantile), text_col)
    rows = docs.select(F.col(id_col), held_out(id_col, 4).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float | None = None) -> DataFrame:
    """The rows of ``docs`` that score at least ``THRESHOLD``, with their columns.

    Null texts are judged as empty ones, texts of any length whole. Rows with
    a null id are judged like others; repeated rows all stay or all go; an
    empty table stays empty, and columns of any name are returned as they are.
    Without labels of both kinds all rows are judged as the kind that was seen
    (good if there is none).
    """
    return docs.where(score_column(docs.sparkSession, fit(docs, labels, quantile=quantile)) >= THRESHOLD)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
