"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document.  Expectation
maximisation over the counts of vote patterns estimates how often each labeller
says what about good and bad documents, and so a posterior for every pattern.  The
posteriors then train a linear scorer over hashed features, which decides.

The driver sees pattern counts (3 ** number of labellers at most), and a gradient of
``BUCKETS`` numbers for each of a few partitions of the training sample.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.llm.textbytes import (
    column_bytes,
    field_names,
    mix,
    parts_between_words,
    pieces,
    release_memory,
    words_at_every_byte,
)
from tagwright.session import write_once

#: Hashed features of the scorer.
BUCKETS = 1 << 15
#: Documents that the scorer is trained on, about; drawn by hash from all.
TRAIN_ROWS = 12_000
TRAIN_PARTITIONS = 12
ROUNDS = 25
#: Bytes of text whose byte strings are hashed at a time.
PIECE_BYTES = 256 << 10
#: Documents with a lower score are rejected.
THRESHOLD = 0.5

_GRAM = 5
_SYMBOLS = b"#*$%&|<>"
_SYMBOL_WORDS = [bytes([c]) for c in _SYMBOLS]
_BEYOND = bytes(range(128, 256))


class Facts(NamedTuple):
    """What the labellers look at in one document."""

    words: int
    distinct: int
    adjacent: int
    letters: int
    upper: int
    symbols: int
    shouts: int
    stops: int
    word_bytes: int
    lines: int
    repeated_lines: int
    bare: int
    beyond_ascii: int


def _share(part: int, whole: int) -> float:
    return part / whole if whole else 0.0


def _vote(value: float, bad: bool, good: bool) -> int:
    return -1 if bad else 1 if good else 0


def _spread(f: Facts) -> int:
    richness = f.distinct / math.sqrt(f.words or 1)
    return 0 if f.words < 20 else _vote(richness, richness < 2, richness > 4)


def _symbols(f: Facts) -> int:
    rate = _share(f.symbols, f.words)
    return _vote(rate, rate > 0.25, rate < 0.05)


def _capitals(f: Facts) -> int:
    rate = _share(f.upper, f.letters)
    return 0 if f.letters < 20 else _vote(rate, rate > 0.6, rate < 0.2)


def _stutter(f: Facts) -> int:
    rate = _share(f.adjacent, f.words)
    return 0 if f.words < 10 else _vote(rate, rate > 0.2, rate < 0.05)


def _shouting(f: Facts) -> int:
    rate = _share(f.shouts, f.words)
    return _vote(rate, rate > 0.3, rate < 0.05)


def _sentences(f: Facts) -> int:
    rate = _share(f.stops, f.words)
    return 0 if f.words < 50 else _vote(rate, f.stops == 0, 0.01 < rate < 0.4)


def _lines(f: Facts) -> int:
    rate = _share(f.repeated_lines, f.lines)
    return 0 if f.lines < 4 else _vote(rate, rate > 0.5, rate < 0.1)


def _length(f: Facts) -> int:
    mean = _share(f.word_bytes, f.words)
    return _vote(mean, not f.words or mean > 20 or mean < 1.5, 2.5 < mean < 12)


def _letters(f: Facts) -> int:
    rate = _share(f.letters + f.beyond_ascii, f.word_bytes)
    return 0 if f.words < 30 else _vote(rate, rate < 0.7, rate > 0.9)


def _bare(f: Facts) -> int:
    rate = _share(f.bare, f.words)
    return 0 if f.words < 20 else _vote(rate, rate > 0.15, rate < 0.05)


LABELLERS: tuple[Callable[[Facts], int], ...] = (
    _spread, _symbols, _capitals, _stutter, _shouting, _sentences, _lines, _length, _letters,
    _bare,
)


def facts(text: bytes) -> Facts:
    """Counts over the whole text; a long text is split into words part by part."""
    words = adjacent = word_bytes = bare = 0
    distinct: set[bytes] = set()
    last = None
    for part in parts_between_words(text):
        found = part.split()
        if found:
            adjacent += sum(map(eq, found, found[1:])) + (found[0] == last)
            last = found[-1]
        words += len(found)
        word_bytes += sum(map(len, found))
        distinct.update(found)
        # Words of nothing but symbols.
        bare += sum(map(found.count, _SYMBOL_WORDS)) if found else 0
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    letters = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    stops = sum(text.count(c) for c in (b".", b"?", b"!"))
    return Facts(
        words, len(distinct), adjacent, letters, upper, symbols, text.count(b"!"), stops, word_bytes,
        len(lines), len(lines) - len(set(lines)), bare, len(text) - len(text.translate(None, _BEYOND)),
    )


def votes(f: Facts) -> tuple[int, ...]:
    return tuple(labeller(f) for labeller in LABELLERS)


def _pattern(cast: tuple[int, ...]) -> str:
    return "".join("-.+"[v + 1] for v in cast)


_VOTES = "row_id long, row_hash long, pattern string"


def _cast_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch["text"].cast(pa.binary()).to_pylist()
        patterns = pa.array([_pattern(votes(facts(t or b""))) for t in texts], pa.string())
        yield pa.RecordBatch.from_arrays([batch["row_id"], batch["row_hash"], patterns], names=field_names(_VOTES))
    release_memory()


def _cast(patterns: list[str]) -> np.ndarray:
    return np.array([["-.+".index(v) - 1 for v in p] for p in patterns], int).reshape(len(patterns), len(LABELLERS))


class LabelModel(NamedTuple):
    """Prior of good, and ``bad[labeller][good]``: how often a vote is bad, for bad and for good documents."""

    prior: float
    bad: np.ndarray

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """Probability of good for each vote pattern; a labeller that does not vote says nothing."""
        cast = _cast(patterns)
        odds = np.full(len(patterns), math.log(self.prior / (1 - self.prior)))
        says_bad, says_good = np.log(self.bad[:, 1] / self.bad[:, 0]), np.log((1 - self.bad[:, 1]) / (1 - self.bad[:, 0]))
        odds += (cast < 0) @ says_bad + (cast > 0) @ says_good
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def accuracies(self) -> np.ndarray:
        """How often each labeller is right where it votes."""
        return self.prior * (1 - self.bad[:, 1]) + (1 - self.prior) * self.bad[:, 0]


def fit_labels(counts: dict[str, int], rounds: int = 200) -> LabelModel:
    """Expectation maximisation over pattern counts, from a start at the majority of votes.

    Labellers call good documents bad rarely; a hundredth of the documents is put in
    beside the counts to say so.  Without documents that is all that is known.
    """
    width = len(LABELLERS)
    assumed = np.tile([0.5, 0.01], (width, 1))
    model = LabelModel(0.5, assumed)
    if not counts:
        return model
    patterns = list(counts)
    n = np.array([counts[p] for p in patterns], float)
    cast = _cast(patterns)
    strength = max(4.0, 0.01 * n.sum())
    # A bad vote is stronger than a good one to begin with.
    good = 1 / (1 + np.exp(3.0 * (cast < 0).sum(1) - 0.5 * (cast > 0).sum(1)))
    before = None
    for _ in range(rounds):
        prior = float(np.clip((n * good).sum() / n.sum(), 1e-3, 1 - 1e-3))
        bad = np.empty((width, 2))
        for y, weight in enumerate((n * (1 - good), n * good)):
            said_bad, said_good = weight @ (cast < 0), weight @ (cast > 0)
            bad[:, y] = (said_bad + strength * assumed[:, y]) / (said_bad + said_good + strength)
        model = LabelModel(prior, np.clip(bad, 1e-6, 1 - 1e-6))
        good = model.posterior(patterns)
        if before is not None and np.abs(good - before).max() < 1e-9:
            break
        before = good
    return model


def _levels(f: Facts) -> list[int]:
    """Buckets for what a bag of byte strings does not show: shares, in a few steps each."""
    richness = f.distinct / math.sqrt(f.words or 1)
    steps = (
        min(7, int(richness)),
        min(7, int(20 * _share(f.adjacent, f.words))),
        min(7, int(8 * _share(f.symbols, f.words))),
        min(7, int(8 * _share(f.upper, f.letters))),
        min(7, int(8 * _share(f.shouts, f.words))),
        min(7, int(8 * _share(f.repeated_lines, f.lines))),
        min(7, int(_share(f.word_bytes, f.words) / 3)),
        min(7, f.words.bit_length() // 2),
    )
    return [i * 8 + step for i, step in enumerate(steps)]


_LEVELS = 64


def _gram_buckets(data: np.ndarray) -> np.ndarray:
    """The hash bucket of the five bytes from each position on."""
    words = words_at_every_byte(np.concatenate([data, np.zeros(8, np.uint8)]))[: max(0, len(data) - _GRAM + 1)]
    hashed = mix(words & np.uint64((1 << 8 * _GRAM) - 1))
    return (hashed & np.uint64(BUCKETS - 1)).astype(np.int64) % (BUCKETS - _LEVELS) + _LEVELS


def _rows_of_pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each piece of a column: the row and the bucket of every byte string inside a row."""
    data, offsets = column_bytes(column)
    for first, end, low, high in pieces(offsets, PIECE_BYTES, _GRAM - 1):
        buckets = _gram_buckets(data[low:high])
        starts = np.append(np.maximum(offsets[first:end], low), high) - low
        sizes = np.diff(starts)
        row = np.repeat(np.arange(first, end), sizes)[: len(buckets)]
        inside = np.arange(len(buckets)) + _GRAM <= np.repeat(starts[1:], sizes)[: len(buckets)]
        yield row[inside], buckets[inside]


_FEATURES = "label double, buckets array<int>, weights array<float>"


def _training_rows(posterior: dict[str, float]) -> Callable:
    def features(part: pa.RecordBatch) -> pa.RecordBatch:
        n, found = part.num_rows, []
        for row, bucket in _rows_of_pieces(part["text"]):
            found.append(np.unique(row * BUCKETS + bucket, return_counts=True))
        pairs = np.concatenate([np.zeros(0, np.int64), *[p for p, _ in found]])
        times = np.concatenate([np.zeros(0, np.int64), *[t for _, t in found]])
        pairs, of = np.unique(pairs, return_inverse=True)
        times = np.bincount(of, weights=times, minlength=len(pairs))
        row = pairs // BUCKETS
        total = np.bincount(row, weights=times, minlength=n)
        seen = [facts(t or b"") for t in part["text"].cast(pa.binary()).to_pylist()]
        levels = np.array([_levels(f) for f in seen], np.int64)
        rows = np.concatenate([np.repeat(np.arange(n), levels.shape[1]), row])
        order = np.argsort(rows, kind="stable")
        buckets = np.concatenate([levels.reshape(-1), pairs % BUCKETS])[order].astype(np.int32)
        weights = np.concatenate([np.ones(levels.size), times / total[row]])[order].astype(np.float32)
        ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([posterior[_pattern(votes(f))] for f in seen], pa.float64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(buckets)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(weights)),
            ],
            names=["label", "buckets", "weights"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = column_bytes(batch["text"])
            first = 0
            while first < batch.num_rows:
                end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, "right")) - 1)
                yield features(batch.slice(first, end - first))
                first = end
        release_memory()

    return run


def _gradient(model: np.ndarray) -> Callable:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BUCKETS + 1), 0
        for batch in batches:
            buckets, weights = batch["buckets"], batch["weights"].flatten().to_numpy().astype(np.float64)
            sizes = np.diff(buckets.offsets.to_numpy())
            place = buckets.flatten().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            score = np.bincount(row, weights=model[place] * weights, minlength=len(sizes)) + model[BUCKETS]
            error = 1 / (1 + np.exp(-np.clip(score, -50, 50))) - batch["label"].to_numpy()
            total[:BUCKETS] += np.bincount(place, weights=error[row] * weights, minlength=BUCKETS)
            total[BUCKETS] += error.sum()
            rows += len(sizes)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([total.tobytes()])], names=["rows", "sum"])

    return add


def train(features: DataFrame, rounds: int = ROUNDS, penalty: float = 1e-3, step: float = 0.5) -> np.ndarray:
    """Logistic regression by full gradients that Spark adds up, with a step size per weight."""
    model, size = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-12)
    for _ in range(rounds):
        parts = features.mapInArrow(_gradient(model), "rows long, sum binary").collect()
        rows = sum(p["rows"] for p in parts)
        if not rows:
            break
        slope = sum(np.frombuffer(p["sum"]) for p in parts) / rows
        slope[:BUCKETS] += penalty / rows * model[:BUCKETS]
        size += slope * slope
        model = model - step * slope / np.sqrt(size)
    return model


class Classifier(NamedTuple):
    labels: LabelModel
    weights: np.ndarray


_JUDGED = "posterior double, score double, kept boolean, pattern string"


def _judge(model: Classifier, carried: list[str], threshold: float) -> Callable:
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [facts(t or b"") for t in batch["text"].cast(pa.binary()).to_pylist()]
            total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for row, bucket in _rows_of_pieces(batch["text"]):
                total += np.bincount(row, weights=model.weights[bucket], minlength=batch.num_rows)
                count += np.bincount(row, minlength=batch.num_rows)
            levels = np.array([model.weights[_levels(f)].sum() for f in found])
            odds = total / np.maximum(count, 1) + levels + model.weights[BUCKETS]
            score = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
            patterns = [_pattern(votes(f)) for f in found]
            kept = (score >= threshold) & np.array([f.words > 0 for f in found], bool)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch[c] for c in carried],
                    pa.array(model.labels.posterior(patterns)),
                    pa.array(score),
                    pa.array(kept),
                    pa.array(patterns, pa.string()),
                ],
                names=[*carried, *[f"judged_{c}" for c in field_names(_JUDGED)]],
            )
        release_memory()

    return judge


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Classifier:
    """Fit the label model on all documents and the scorer on about ``train_rows`` of them.

    The sample is bounded by that parameter and drawn by a hash of id and text.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("row_id"), F.xxhash64("text").alias("row_hash"), "text")
    cast = keyed.mapInArrow(_cast_votes, _VOTES)
    counts = {row["pattern"]: row["n"] for row in cast.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = fit_labels(counts)
    posterior = dict(zip(counts, labels.posterior(list(counts)).tolist()))
    share = min(1.0, train_rows / max(1, sum(counts.values())))
    drawn = F.pmod(F.xxhash64("row_id", "row_hash", F.lit("train")), F.lit(1 << 32)) < int(share * (1 << 32))
    features = keyed.filter(drawn).select("text").mapInArrow(_training_rows(posterior), _FEATURES)
    sample = write_once(features, "quality-sample").coalesce(TRAIN_PARTITIONS)
    return Classifier(labels, train(sample))


def judged(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of ``docs`` as _0, _1 and so on, and judged_posterior, judged_score, judged_kept, judged_pattern.

    A text without words (null, empty, blank) is rejected.
    """
    names = docs.columns
    carried = [f"_{i}" for i in range(len(names))]
    renamed = docs.select(F.col("text").alias("text"), *[F.col(f"`{n}`").alias(c) for n, c in zip(names, carried)])
    schema = ", ".join(
        [f"{c} {renamed.schema[c].dataType.simpleString()}" for c in carried]
        + [f"judged_{field.strip()}" for field in _JUDGED.split(",")]
    )
    return renamed.mapInArrow(_judge(model, carried, threshold), schema)


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, votes, posterior of the votes, score and whether it is kept."""
    done = judged(docs.select("doc_id", "text"), fit(docs))
    return done.select(
        F.col("_0").cast("long").alias("doc_id"),
        F.col("judged_pattern").alias("votes"),
        F.col("judged_posterior").alias("posterior"),
        F.col("judged_score").alias("score"),
        F.col("judged_kept").alias("kept"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, in the columns of ``docs``."""
    done = judged(docs, fit(docs)).filter("judged_kept")
    return done.select(*[F.col(f"_{i}").alias(n) for i, n in enumerate(docs.columns)])
