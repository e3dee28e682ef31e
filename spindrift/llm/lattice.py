"""Marginal likelihood of texts over all segmentations into subword pieces."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.shared import discard, held_out, materialize, table, text_bytes

#: The arcs of a lattice are kept for words up to this many bytes; for longer ones they are found twice.
KEPT = 1024
#: Rounds of expectation and maximization, and counts added to every piece.
ROUNDS = 3
SMOOTHING = 0.1
#: A word that makes up one part in this many of all words is frequent. There
#: are at most as many such words, and every worker holds their scores.
HOT = 1_000_000
#: Words that a task counts before it sends the counts on.
HELD = 400_000
#: Words of one length that go through the lattice together.
TOGETHER = 8192


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a sentencepiece model by falling score, as bytes.

    The mark of a word's start becomes a space. All 256 bytes are pieces, as
    the model falls back on them, so every text has a segmentation. Pieces no
    lower-cased word can hold are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranked = sorted((-model.get_score(i), i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    pieces = [model.id_to_piece(i).replace("▁", " ").encode() for _, i in ranked]
    fit = [p for p in pieces if p and b" " not in p[1:] and p == p.lower()]
    return list(dict.fromkeys(fit + [bytes([b]) for b in range(256)]))


class Lattice:
    """A unigram model over pieces: weights of all paths through a text."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray):
        self.pieces, self.logs = pieces, logs
        self.longest = max(map(len, pieces))
        self._trie: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return {"pieces": self.pieces, "logs": self.logs, "longest": self.longest, "_trie": None}

    def trie(self) -> tuple[np.ndarray, np.ndarray]:
        """``next[state, byte]`` (0: none; state 1 is the root) and the piece a state ends."""
        if self._trie is None:
            steps: dict[tuple[int, int], int] = {}
            ends: dict[int, int] = {}
            last = 1
            for number, piece in enumerate(self.pieces):
                state = 1
                for byte in piece:
                    nxt = steps.get((state, byte))
                    if nxt is None:
                        last += 1
                        nxt = steps[state, byte] = last
                    state = nxt
                ends[state] = number
            go = np.zeros((last + 1, 256), np.int32)
            for (state, byte), nxt in steps.items():
                go[state, byte] = nxt
            piece_of = np.full(last + 1, -1, np.int32)
            piece_of[list(ends)] = list(ends.values())
            self._trie = go, piece_of
        return self._trie

    def forward(self, text: np.ndarray, arcs: list | None = None) -> np.ndarray:
        """Log-sum of all paths to each place; ``text`` has a row for each word of one length.

        With ``arcs``, each step's ``(from, to, rows, pieces)`` is added to it.
        """
        n, size = text.shape
        alpha = np.full((size + 1, n), -np.inf)
        alpha[0] = 0.0
        for i in range(size):
            for j, at, piece in self._arcs(text, i):
                alpha[j, at] = np.logaddexp(alpha[j, at], alpha[i, at] + self.logs[piece])
                if arcs is not None:
                    arcs.append((i, j, at, piece))
        return alpha

    def _arcs(self, text: np.ndarray, i: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Pieces that begin at place ``i``: where they end, in which rows, and which they are."""
        go, piece_of = self.trie()
        n, size = text.shape
        rows, state = np.arange(n), np.ones(n, np.int32)
        for j in range(i + 1, min(size, i + self.longest) + 1):
            state = go[state, text[rows, j - 1]]
            alive = state > 0
            if not alive.all():
                rows, state = rows[alive], state[alive]
                if not len(rows):
                    return
            piece = piece_of[state]
            ends = piece >= 0
            if ends.any():
                yield j, rows[ends], piece[ends]

    def expected(self, text: np.ndarray, weights: np.ndarray, out: np.ndarray) -> None:
        """Add how often each piece is expected in the words, times their weights.

        Going backward, all that follows a place is known before it, so the
        arcs of a very long word are found again rather than kept.
        """
        arcs: list | None = [] if text.shape[1] <= KEPT else None
        alpha = self.forward(text, arcs)
        beta = np.full(alpha.shape, -np.inf)
        beta[-1] = 0.0
        again = reversed(arcs) if arcs is not None else ((i, *arc) for i in range(text.shape[1] - 1, -1, -1) for arc in self._arcs(text, i))
        for i, j, at, piece in again:
            after = beta[j, at] + self.logs[piece]
            beta[i, at] = np.logaddexp(beta[i, at], after)
            share = np.exp(alpha[i, at] + after - alpha[-1, at]) * weights[at]
            if len(at) > 1:
                out += np.bincount(piece, weights=share, minlength=len(out))
            else:
                out[piece[0]] += share[0]

    def words(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the marginal probability of each word with the space before it."""
        out = np.zeros(len(words))
        for index, text in by_length(words):
            out[index] = self.forward(text)[-1]
        return out

    def text(self, data: bytes, end: float) -> float:
        """Log10 probability of a whole text by one recursion over its lattice.

        This is what the sum over words comes to, as no piece reaches over a
        space; tests hold the two against each other.
        """
        joined = b"".join(b" " + w for w in data.lower().split())
        alpha = self.forward(np.frombuffer(joined, np.uint8)[None, :])[-1, 0] if joined else 0.0
        return float((alpha + end) / math.log(10))


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length at a time, as rows of bytes with a space before them."""
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    cuts = np.r_[0, np.nonzero(np.diff(sizes[order]))[0] + 1, len(order)] if len(order) else np.zeros(1, int)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        size = int(sizes[order[lo]])
        step = max(1, min(TOGETHER, (1 << 20) // (size + 1)))
        for a in range(lo, hi, step):
            index = order[a : min(hi, a + step)]
            flat = np.frombuffer(b"".join(b" " + words[k] for k in index), np.uint8)
            yield index, flat.reshape(len(index), size + 1)


def together(batches: Iterator[pa.RecordBatch], rows: int = 8 * TOGETHER) -> Iterator[pa.RecordBatch]:
    """Batches of words put together, so that each length has many of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of a task: in learned-from texts, and in all."""
    counts: list[Counter] = [Counter(), Counter()]

    def flush() -> Iterator[pa.RecordBatch]:
        learned, other = counts
        words = list(learned.keys() | other.keys())
        if words:
            c = np.fromiter((learned[w] for w in words), np.int64, len(words))
            n = c + np.fromiter((other[w] for w in words), np.int64, len(words))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c), pa.array(n)], names=["word", "c", "n"])
        counts[:] = [Counter(), Counter()]

    for batch in batches:
        for held, text in zip(batch.column("held").to_pylist(), batch.column("text"), strict=True):
            counts[held].update(text.as_py().lower().split())
            if len(counts[0]) + len(counts[1]) > HELD:
                yield from flush()
    yield from flush()


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, c, n)`` of all words of ``texts(held, text)``."""
    return texts.select("held", "text").mapInArrow(_count, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def prior(pieces: list[bytes]) -> np.ndarray:
    """Weights to begin with: Zipf's law over the order of the existing scores."""
    weight = 1 / (np.arange(len(pieces)) + 10.0)
    return np.log(weight / weight.sum())


def train(counts: DataFrame, ends: int, pieces: list[bytes], rounds: int = ROUNDS) -> tuple[Lattice, float]:
    """Piece weights for the counted words, and the log weight of a text's end.

    Each round sends the weights out, takes the expected number of every piece
    over all segmentations of every counted word, and normalizes.
    """
    spark = counts.sparkSession
    logs = prior(pieces)
    size = len(pieces)
    end = 0.0
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(Lattice(pieces, logs))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in together(batches):
                words, weights = batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(float)
                for index, text in by_length(words):
                    sent.value.expected(text, weights[index], total)
            some = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["piece", "expected"])

        seen = counts.where("c > 0").select("word", "c").mapInArrow(expect, "piece long, expected double")
        total = np.full(size, SMOOTHING)
        # as many rows as the vocabulary has pieces
        for row in seen.groupBy("piece").agg(F.sum("expected").alias("expected")).collect():
            total[row["piece"]] += row["expected"]
        whole = total.sum() + ends + SMOOTHING
        logs, end = np.log(total / whole), math.log((ends + SMOOTHING) / whole)
    return Lattice(pieces, logs), end


def _score_words(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    for batch in together(batches):
        logs = sent.value.words(batch.column("word").to_pylist()) / math.log(10)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs)], names=[*batch.schema.names, "log"])


def _documents(batches: Iterator[pa.RecordBatch], hot) -> Iterator[pa.RecordBatch]:
    """A row for each text with the sums over its hot words, and one for each other word in it.

    The key of a text's own row has a space in it, so it is no word's.
    """
    known, (flag, bases, logs) = hot.value
    names = ["key", "row", "id", "held", "tokens", "known", "base", "log"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for row, doc, held, text in zip(*(batch.column(c) for c in ("row", "id", "held", "text")), strict=True):
            number = row.as_py()
            counts = Counter(text.as_py().lower().split())
            tokens, common, seen = 1, [], 0
            rare = []
            for word, times in counts.items():
                tokens += times
                place = known.get(word)
                if place is None:
                    rare.append((word, times))
                else:
                    common.append((place, times))
            base = log = 0.0
            if common:
                at, often = np.array(common).T
                seen, base, log = int(flag[at] @ often), float(bases[at] @ often), float(logs[at] @ often)
            for to, value in zip(out, (b" %d" % number, number, doc.as_py(), held.as_py(), tokens, seen, base, log), strict=True):
                to.append(value)
            k = len(rare)
            out[0] += [w for w, _ in rare]
            out[1] += [number] * k
            out[2] += [None] * k
            out[3] += [None] * k
            out[4] += [t for _, t in rare]
            for to in out[5:]:
                to += [None] * k
            if len(out[0]) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)
                out = [[] for _ in names]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)


def score(docs: DataFrame, model: str | None = None, modulus: int = 7, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, hot: int = HOT) -> DataFrame:
    """Likelihoods of whole texts under a subword lattice and a word model.

    Returns ``(id_col, held_out, n_tokens, n_known, train_tokens, base_score,
    score)`` for every row. Texts are lower-cased and split at ASCII white
    space; an end closes each. ``score`` is the log10 probability of the text
    summed over all its segmentations into pieces of the existing vocabulary
    ``model``, whose scores order the first weights; weights are then learned
    from the texts that are not held out. ``base_score`` is an add-one word
    model of the same texts.

    Word counts cover all documents. Words that make up one part in
    ``hot`` or more, of which there are at most ``hot``, are scored where the
    texts are; all other words are joined by word, and none of those can be
    frequent enough to be a hot key.

    A null text is empty: its end alone is scored. A null id is held out.
    Repeated rows each come back and are each learned from. An empty table
    gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    pieces = vocabulary(model)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), held_out(id_col, modulus).alias("held"), text_bytes(text_col).alias("text"))
    counts, counts_path = materialize(word_counts(rows), "counts")
    learned, kinds, everywhere = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    ends = rows.where("not held").count()
    total, distinct = learned + ends, kinds + (ends > 0)
    lattice, end = train(counts, ends, pieces, rounds)
    sent = spark.sparkContext.broadcast(lattice)
    words, _ = materialize(counts.mapInArrow(lambda it: _score_words(it, sent), "word binary, c long, n long, log double"), "words")
    discard(spark, counts_path)

    def base_of(c: int) -> float:
        return math.log10((c + 1) / (total + distinct + 1))

    top = words.where(F.col("n") * hot >= everywhere).collect()
    values = np.array([int(r["c"] > 0) for r in top]), np.array([base_of(r["c"]) for r in top], float), np.array([r["log"] for r in top], float)
    frequent = spark.sparkContext.broadcast(({bytes(r["word"]): k for k, r in enumerate(top)}, values))
    entries = rows.mapInArrow(lambda it: _documents(it, frequent), "key binary, row long, id long, held boolean, tokens long, known long, base double, log double")
    known = words.select(F.col("word").alias("key"), "c", F.col("log").alias("w_log")).hint("shuffle_hash")
    times = F.col("tokens")
    own = F.col("held").isNotNull()
    joined = entries.join(known, "key", "left").select(
        "row",
        "id",
        "held",
        F.when(own, times).alias("tokens"),
        F.when(own, F.col("known")).otherwise(F.when(F.col("c") > 0, times).otherwise(0)).alias("known"),
        F.when(own, F.col("base")).otherwise(times * F.log10((F.col("c") + 1) / F.lit(float(total + distinct + 1)))).alias("base"),
        F.when(own, F.col("log")).otherwise(times * F.col("w_log")).alias("log"),
    )
    sums = joined.groupBy("row").agg(F.max("id").alias("id"), F.max("held").alias("held"), F.max("tokens").alias("tokens"), F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("log").alias("log"))
    return sums.select(
        F.col("id").alias(id_col),
        F.col("held").alias("held_out"),
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + base_of(ends)).alias("base_score"),
        (F.col("log") + end / math.log(10)).alias("score"),
    )


def op1_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
