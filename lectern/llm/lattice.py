"""Language-model scores: marginal likelihood over all subword segmentations.

The pieces of an existing vocabulary and its scores give a unigram model of pieces. The
probability of a word (with the space before it) is the sum over all its segmentations, found
by a forward recursion in log space; a text's is the product over its words and of one end.
Pieces are weighted by the vocabulary's own scores and then, in one step of expectation over
the training words' lattices, by how often the training texts are expected to use them.

What is gathered from the corpus is a table of all distinct words with their training counts;
it stays distributed. A text's frequent words (at most ``MAX_FREQUENT`` in all, so they can be
broadcast) are scored where the text is; each rare word meets its row in one join.

The table also gives the base score, an add-one unigram model over words.

Defined cases: a null text is empty and has one token, the end; bytes without a piece fall
back to single bytes, so every text has a finite score; without training texts all counts are
zero and the vocabulary's scores stand alone; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.bpe import NEVER, PairTable
from lectern.llm.langid import remainder
from lectern.llm.words import Words, powers, prefix_hashes, range_hashes, word_slices
from lectern.session import materialized

MAX_FREQUENT = 200_000
SPACE = "▁"
ROWS = 4096
TABLE_BYTES = 24 << 20
MIN_PROBABILITY = 1e-12


@dataclass
class Pieces:
    """Surfaces of a vocabulary, their log probabilities, and that of the end."""

    surfaces: list[bytes]
    logs: np.ndarray
    end: float

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.surfaces))
        hashes = _surface_hashes(self.surfaces)
        self.table = PairTable(_high(hashes), _low(hashes), np.arange(len(hashes), dtype=np.int32))

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Piece number of each hash, ``NEVER`` where there is none."""
        return self.table.look_up(_high(hashes), _low(hashes))


def _high(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(33)).astype(np.int32)


def _low(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(0x7FFFFFFF)).astype(np.int32)


def _surface_hashes(surfaces: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(s) for s in surfaces])
    sums = prefix_hashes(np.frombuffer(b"".join(surfaces), np.uint8))
    return range_hashes(sums, ends - [len(s) for s in surfaces], ends)


def vocabulary(model_path: str) -> Pieces:
    """Pieces of a sentencepiece model; a space stands for the word mark.

    Scores that are ranks (merge order) become probabilities by rank, ``p ~ 1 / (1 - score)``;
    scores that are log probabilities are taken as they are.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    scores: dict[bytes, float] = {}
    lowest = 0.0
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            surface = bytes([int(piece[3:5], 16)])
            scores.setdefault(surface, float("-inf"))
            continue
        surface = piece.replace(SPACE, " ").encode()
        if b" " in surface[1:]:
            continue
        scores[surface] = max(scores.get(surface, float("-inf")), model.get_score(i))
        lowest = min(lowest, model.get_score(i))
    for b in range(256):
        scores.setdefault(bytes([b]), float("-inf"))
    surfaces = sorted(scores)
    values = np.array([scores[s] for s in surfaces])
    values[np.isinf(values)] = lowest
    logs = -np.log1p(-values) if lowest < -1000 else values
    shares = np.exp(logs - logs.max())
    shares = shares / shares.sum()
    return Pieces(surfaces, np.log(shares * 0.99), float(np.log(0.01)))


class Lattice:
    """Segmentation lattices of words of one length in bytes, as matrices of piece numbers."""

    def __init__(self, pieces: Pieces, words: np.ndarray):
        self.pieces, (self.n, self.width) = pieces, words.shape
        flat_sums = prefix_hashes(words.ravel())
        at = np.arange(self.n)[:, None] * self.width + np.arange(self.width + 1)[None, :]
        self.arcs: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for stop in range(1, self.width + 1):
            arcs = []
            for start in range(max(0, stop - pieces.longest), stop):
                ids = pieces.ids(range_hashes(flat_sums, at[:, start], at[:, stop]))
                rows = np.flatnonzero(ids != NEVER)
                if len(rows):
                    arcs.append((start, rows, ids[rows]))
            self.arcs[stop] = arcs

    def forward(self) -> np.ndarray:
        """Log sums of all ways to reach each place: ``n x (width + 1)``."""
        alpha = np.full((self.width + 1, self.n), -np.inf)
        alpha[0] = 0.0
        for stop in range(1, self.width + 1):
            for start, rows, ids in self.arcs[stop]:
                alpha[stop, rows] = np.logaddexp(alpha[stop, rows], alpha[start, rows] + self.pieces.logs[ids])
        return alpha

    def expected(self, alpha: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected use of every piece, each word counting ``weights`` times."""
        beta = np.full_like(alpha, -np.inf)
        beta[self.width] = 0.0
        out = np.zeros(len(self.pieces.logs))
        for stop in range(self.width, 0, -1):
            for start, rows, ids in self.arcs[stop]:
                through = self.pieces.logs[ids] + beta[stop, rows]
                share = np.exp(alpha[start, rows] + through - alpha[self.width, rows])
                out += np.bincount(ids, share * weights[rows], len(out))
                beta[start, rows] = np.logaddexp(beta[start, rows], through)
        return out


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(numbers, matrix)`` of words of equal length, each with a space before it."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for same in np.split(order, cuts):
        if not len(same):
            continue
        width = int(lengths[same[0]]) + 1
        step = max(1, min(ROWS, (1 << 22) // (width * width)))
        for at in range(0, len(same), step):
            some = same[at : at + step]
            data = b"".join(b" " + words[i] for i in some.tolist())
            yield some, np.frombuffer(data, np.uint8).reshape(len(some), width)


def marginals(pieces: Pieces, words: list[bytes]) -> np.ndarray:
    """Natural log of each word's probability over all segmentations."""
    out = np.zeros(len(words))
    for which, matrix in by_length(words):
        out[which] = Lattice(pieces, matrix).forward()[-1]
    return out


# --- word table ---


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, trained, times`` of all distinct words of rows ``text, held_out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            parts, size = [], 0
            for start, stop, words in word_slices(batch.column(0)):
                parts.append(_unique(words, ~held[start:stop]))
                size += len(words.data)
                if size >= TABLE_BYTES:
                    yield _counted(parts)
                    parts, size = [], 0
            if parts:
                yield _counted(parts)

    rows = docs.select("text", "held_out").mapInArrow(run, "word binary, trained long, times long")
    return rows.groupBy("word").agg(F.sum("trained").alias("trained"), F.sum("times").alias("times"))


def _unique(words: Words, trains: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    keys, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
    data = words.data.tobytes()
    spelled = [data[a:b] for a, b in zip(words.starts[first].tolist(), words.stops[first].tolist(), strict=True)]
    return keys, spelled, np.bincount(back, trains[words.text_of_word()], len(keys)), np.bincount(back, minlength=len(keys))


def _counted(parts: list[tuple]) -> pa.RecordBatch:
    keys, first, back = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    spelled = [w for p in parts for w in p[1]]
    sums = [np.bincount(back, np.concatenate([p[k] for p in parts]), len(keys)).astype(np.int64) for k in (2, 3)]
    return pa.RecordBatch.from_arrays(
        [pa.array([spelled[i] for i in first.tolist()], pa.binary()), *(pa.array(s) for s in sums)], names=["word", "trained", "times"]
    )


def adapted(pieces: Pieces, words: DataFrame, texts: int, prior: float = 1000.0) -> Pieces:
    """Pieces weighted by their expected use in the training words, smoothed by ``prior`` uses."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            weights = batch.column(1).to_numpy().astype(float)
            total = np.zeros(len(own.logs))
            for which, matrix in by_length(batch.column(0).to_pylist()):
                lattice = Lattice(own, matrix)
                total += lattice.expected(lattice.forward(), weights[which])
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "uses"])

    uses = words.where("trained > 0").select("word", "trained").mapInArrow(run, "piece long, uses double")
    found = uses.groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
    counts = np.exp(pieces.logs) * prior
    counts[found["piece"].to_numpy(np.int64)] += found["uses"].to_numpy(float)
    ends = np.exp(pieces.end) * prior + texts
    total = counts.sum() + ends
    return Pieces(pieces.surfaces, np.log(np.maximum(counts / total, MIN_PROBABILITY)), float(np.log(ends / total)))


def scored_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``key, trained, times, log`` of each word: its hash, its counts and its marginal log probability."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_surface_hashes(own).view(np.int64)), batch.column(1), batch.column(2),
                    pa.array(marginals(shared.value, own)),
                ],
                names=["key", "trained", "times", "log"],
            )

    return words.select("word", "trained", "times").mapInArrow(run, "key long, trained long, times long, log double")


def frequent(words: DataFrame, most: int = MAX_FREQUENT) -> DataFrame:
    """The words above a count that at most ``most`` words reach, found from a histogram of counts."""
    level = F.floor(F.log2("times") * 8).cast("int")
    left, cut = most, None
    for row in words.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if row["count"] > left:
            break
        left, cut = left - row["count"], row["level"]
    return words.where(level >= cut) if cut is not None else words.limit(0)


def scores(
    docs: DataFrame,
    model_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    modulus: int = 7,
    held: int = 2,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Rows whose crc32 of the id leaves ``held`` modulo ``modulus`` are held out of the training.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{text}`").alias("text"),
        (remainder(F.col(f"`{doc_id}`"), modulus) == held).alias("held_out"),
    )
    words = materialized(word_counts(rows), "words")
    texts = rows.where("not held_out").count()
    sums = words.agg(F.sum("trained"), F.count(F.when(F.col("trained") > 0, 1))).first()
    tokens, distinct = (sums[0] or 0) + texts, sums[1] + (texts > 0)
    pieces = adapted(vocabulary(model_path), words, texts)
    table = materialized(scored_words(words, pieces), "scored")
    top = frequent(table).toPandas().sort_values("key", key=lambda k: k.to_numpy().view(np.uint64))
    shared = spark.sparkContext.broadcast(
        (top["key"].to_numpy(np.int64).view(np.uint64), top["trained"].to_numpy(np.int64), top["log"].to_numpy(float))
    )
    whole = float(tokens + distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, trained, logs = shared.value
        base = np.log10((trained + 1) / whole)
        for batch in batches:
            for start, stop, own in word_slices(batch.column(1)):
                n = stop - start
                at = np.minimum(np.searchsorted(keys, own.hashes), max(len(keys) - 1, 0))
                hit = keys[at] == own.hashes if len(keys) else np.zeros(len(own.hashes), bool)
                of, where = own.text_of_word(), at[hit]
                rare = own.hashes[~hit].view(np.int64)
                begins = np.searchsorted(of[~hit], np.arange(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, n), batch.column(2).slice(start, n), pa.array(np.diff(own.of)),
                        pa.array(np.bincount(of[hit], trained[where] > 0, n).astype(np.int64)),
                        pa.array(np.bincount(of[hit], base[where], n)), pa.array(np.bincount(of[hit], logs[where], n)),
                        pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(rare)),
                    ],
                    names=["doc_id", "held_out", "words", "known", "base", "log", "rare"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    made = rows.select("doc_id", "text", "held_out").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, words long, known long, base double, log double, rare array<long>"
    )
    first = materialized(made.withColumn("row", F.monotonically_increasing_id()), "frequent")
    each = first.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("n"))
    met = each.join(table.select("key", "trained", "log"), "key")
    rest = met.groupBy("row").agg(
        F.sum(F.when(F.col("trained") > 0, F.col("n")).otherwise(0)).alias("known2"),
        F.sum(F.col("n") * F.log10((F.col("trained") + 1) / F.lit(whole))).alias("base2"),
        F.sum(F.col("n") * F.col("log")).alias("log2"),
    )
    end_base = float(np.log10((texts + 1) / whole))
    zero = F.lit(0.0)
    return first.drop("rare").join(rest, "row", "left").select(
        F.col("doc_id").alias(doc_id),
        "held_out",
        (F.col("words") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("known2", F.lit(0)) + F.lit(int(texts > 0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", zero) + F.lit(end_base)).alias("base_score"),
        ((F.col("log") + F.coalesce("log2", zero) + F.lit(pieces.end)) / float(np.log(10))).alias("score"),
    )
