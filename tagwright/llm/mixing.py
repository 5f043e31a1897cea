"""Mixing to target weights when a document's domain is only known with a probability.

A naive Bayes classifier over hashed words, trained on labelled documents, gives each
document a posterior over domains.  Projected Newton steps then fit a nonnegative
rate per document so that the domains' expected token totals match their targets.
A document's rate follows from its posterior and a weight per domain, so a step
needs a few distributed sums and the driver holds those sums alone.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.session import small_frame, write_once

logger = logging.getLogger(__name__)

#: Domains of the labels table, by (quality, toxic).
DOMAINS = ("clean", "low", "toxic")
TARGETS: Mapping[str, float] = {"clean": 0.85, "low": 0.05, "toxic": 0.10}

#: Hashed words of the classifier.
BUCKETS = 1 << 14
#: Labelled documents the classifier is fitted on, about; drawn by hash.
TRAIN_ROWS = 6_000
#: Words that a posterior weighs at most as evidence, however long the text.
EVIDENCE = 300
#: Sums that a fit may take; it raises beyond them.
ROUNDS = 200
#: Misfit of a domain's total, as a share of all tokens, at which fitting ends.
TOLERANCE = 1e-6
#: Share of the distance from a rate of 1 in what is minimised: the first, the one from which on
#: a misfit that no longer halves is as small as the bounds allow, and the least.
FIRST_SHARE, LAST_SHARE, LEAST_SHARE = 1e-2, 2e-5, 1e-10


def domain(quality: Column, toxic: Column) -> Column:
    """Domain of a labelled document; null without a full label."""
    return F.when((toxic == 1) & quality.isNotNull(), "toxic").when((quality == 1) & (toxic == 0), "clean").when(
        (quality == 0) & (toxic == 0), "low"
    )


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+"), lambda w: w != "")


def _buckets(words: Column) -> Column:
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


class Classifier(NamedTuple):
    """Log odds of each domain against the first: an intercept, and a weight per bucket."""

    domains: tuple[str, ...]
    intercepts: list[float]
    weights: DataFrame


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Classifier:
    """Fit on about ``train_rows`` of the labelled documents, drawn by a hash of their id.

    Labels with a null are passed over, and a document with several different labels
    counts for each.  Without labels all domains are equally likely.
    """
    named = labels.select(F.col("doc_id").alias("labelled"), domain(F.col("quality"), F.col("toxic")).alias("domain"))
    named = named.filter(F.col("domain").isNotNull() & F.col("labelled").isNotNull()).distinct()
    share = min(1.0, train_rows / max(1, named.count()))
    drawn = named.filter(F.pmod(F.xxhash64("labelled", F.lit("mix")), F.lit(1 << 32)) < int(share * (1 << 32)))
    sample = docs.select("doc_id", "text").join(write_once(drawn, "drawn-labels"), F.col("doc_id") == F.col("labelled"))
    words = sample.select("domain", F.explode(F.array_distinct(_buckets(_words(F.col("text"))))).alias("bucket"))
    counted = words.groupBy("domain", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros((len(DOMAINS), BUCKETS))
    # At most a row per domain and bucket.
    for row in counted.collect():
        counts[DOMAINS.index(row["domain"]), row["bucket"]] = row["n"]
    sizes = np.zeros(len(DOMAINS))
    for row in drawn.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[DOMAINS.index(row["domain"])] = row["n"]
    # How likely a document of the domain has the word, smoothed towards all documents.
    overall = (counts.sum(axis=0) + 0.5) / (sizes.sum() + 1.0)
    likely = (counts + 4 * overall) / (sizes[:, None] + 4)
    log = np.log(likely) - np.log(likely[0])
    prior = np.log(sizes + 1) - np.log(sizes[0] + 1)
    # One row, as wide as the buckets; it reaches the tasks as the value of subqueries.
    names = [f"w{i}" for i in range(1, len(DOMAINS))]
    row = tuple(log[i].tolist() for i in range(1, len(DOMAINS)))
    table = small_frame(docs.sparkSession, [row], ", ".join(f"{n} array<double>" for n in names))
    return Classifier(DOMAINS, prior.tolist(), write_once(table, "mixing-weights"))


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` with mix_tokens and a probability ``mix_<domain>`` for each domain.

    Every distinct word counts once.  A text without words gets the share of each
    domain among labelled documents.
    """
    names = docs.columns
    cut = docs.select(*[F.col(f"`{n}`") for n in names], _words(F.col("text")).alias("mix_words"))
    cut = cut.select(
        *[F.col(f"`{n}`") for n in names],
        F.size("mix_words").cast("long").alias("mix_tokens"),
        F.array_distinct(_buckets(F.col("mix_words"))).alias("mix_buckets"),
    )

    # Each named once below, so that Spark puts the subquery itself there and copies no weights into rows.
    tables = [model.weights.select(f"w{i}").scalar().alias(f"mix_w{i}") for i in range(1, len(model.domains))]
    cut = cut.select(*[F.col(f"`{n}`") for n in names], "mix_tokens", "mix_buckets", *tables)

    def evidence(i: int) -> Column:
        return F.aggregate("mix_buckets", F.lit(0.0), lambda total, b: total + F.get(F.col(f"mix_w{i}"), b))

    scale = F.least(F.lit(1.0), F.lit(float(EVIDENCE)) / F.greatest(F.size("mix_buckets"), F.lit(1)))
    odds = [F.lit(0.0)] + [F.lit(model.intercepts[i]) + scale * evidence(i) for i in range(1, len(model.domains))]
    scored = cut.select(
        *[F.col(f"`{n}`") for n in names], "mix_tokens", *[o.alias(f"mix_odds{i}") for i, o in enumerate(odds)]
    )
    columns = [F.col(f"mix_odds{i}") for i in range(len(odds))]
    top = F.greatest(*columns)
    powers = [F.exp(c - top) for c in columns]
    whole = reduce(Column.__add__, powers)
    return scored.select(
        *[F.col(f"`{n}`") for n in names],
        "mix_tokens",
        *[(p / whole).alias(f"mix_{d}") for p, d in zip(powers, model.domains)],
    )


def fit_rates(
    scored: DataFrame,
    domains: tuple[str, ...],
    targets: Mapping[str, float],
    total: float | None = None,
    rounds: int = ROUNDS,
    max_rate: float | None = None,
) -> list[float]:
    """Weights of the domains from which ``_rate_at`` makes the rates nearest to 1 that meet the targets.

    The squared misfit of the domains' totals is measured in the metric of their
    overlap (the inverse of the sum of posterior products), and a share of the
    squared distance from a rate of 1 is added.  The rates that minimise both are
    1 plus a weighted sum of the posteriors, within the bounds.  Newton steps find
    the weights, and the share shrinks until the misfit is within ``TOLERANCE`` or
    no longer falls; a warning tells what is left then.  Each round is one
    distributed sum, and an error is raised if ``rounds`` of them are not enough.
    ``total`` is the number of tokens wanted; as many as there are if not given.
    """
    q = [F.col(f"mix_{d}") for d in domains]
    n = len(domains)
    cells = [(i, j) for i in range(n) for j in range(i, n)]
    first = scored.agg(
        F.coalesce(F.sum("mix_tokens"), F.lit(0)).alias("tokens"),
        *[F.coalesce(F.sum(F.col("mix_tokens") * q[i] * q[j]), F.lit(0.0)) for i, j in cells],
    ).first()
    tokens = float(first["tokens"])
    if not tokens:
        return []

    def symmetric(sums: Sequence[float]) -> np.ndarray:
        out = np.empty((n, n))
        for (i, j), value in zip(cells, sums):
            out[i, j] = out[j, i] = value / tokens
        return out

    weight = sum(targets.get(d, 0.0) for d in domains)
    wanted = np.array([targets.get(d, 0.0) / weight for d in domains]) * (total or tokens) / tokens
    metric = symmetric(first[1:]) + 1e-6 * np.eye(n)
    passes = 0

    def at(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Misfit at these weights, and how it changes with them: by the documents within the bounds."""
        nonlocal passes
        if passes == rounds:
            raise RuntimeError(f"rates have not converged in {rounds} rounds; misfit {dict(zip(domains, misfit.tolist()))}")
        passes += 1
        free = _unbounded(weights.tolist(), domains)
        rated = scored.select("mix_tokens", *q, free.alias("mix_free"))
        free = F.col("mix_free")
        rate = F.col("mix_tokens") * _bounded(free, max_rate)
        within = (free > 0) if max_rate is None else (free > 0) & (free < max_rate)
        moving = F.when(within, F.col("mix_tokens")).otherwise(0)
        sums = rated.agg(*[F.sum(rate * c) for c in q], *[F.sum(moving * q[i] * q[j]) for i, j in cells]).first()
        return np.array(sums[:n], float) / tokens - wanted, symmetric(sums[n:])

    weights, share, before = np.zeros(n), FIRST_SHARE, np.inf
    misfit, change = at(weights)
    while True:
        last = share <= LAST_SHARE
        # On the way, a share need not be finished.
        while np.abs(misfit + share * metric @ weights).max() > max(TOLERANCE / 2, 0 if last else 0.05 * np.abs(misfit).max()):
            slope = misfit + share * metric @ weights
            step = -np.linalg.solve(change + share * metric, slope)
            falls, length = -slope @ step, 1.0
            while True:
                there = weights + length * step
                found = at(there)
                rises = (found[0] + share * metric @ there) @ step
                # A step must not go far beyond the lowest point on its way.
                if rises <= 0.1 * falls:
                    break
                length *= min(0.7, max(0.1, falls / (falls + rises)))
            weights, (misfit, change) = there, found
        most = np.abs(misfit).max()
        if most <= TOLERANCE:
            return weights.tolist()
        if last and most > before / 2 or share <= LEAST_SHARE:
            logger.warning("targets are out of reach; misfit as a share of all tokens: %s", dict(zip(domains, misfit.tolist())))
            return weights.tolist()
        share, before = share / 10, most


def _unbounded(weights: list[float], domains: tuple[str, ...]) -> Column:
    """1 plus the weighted posteriors.

    The weights come from an array that a fold goes over, so that the plan and its
    generated code stay the same from round to round.
    """

    def one(rate: Column, row: Column) -> Column:
        return reduce(Column.__add__, [F.get(row, i) * F.col(f"mix_{d}") for i, d in enumerate(domains)], rate)

    return F.aggregate(F.array(F.array(*map(F.lit, weights))), F.lit(1.0), one)


def _bounded(rate: Column, max_rate: float | None) -> Column:
    rate = F.greatest(rate, F.lit(0.0))
    return rate if max_rate is None else F.least(rate, F.lit(float(max_rate)))


def _rate_at(weights: list[float], domains: tuple[str, ...], max_rate: float | None) -> Column:
    """A document's rate; 1 where nothing was fitted."""
    return _bounded(_unbounded(weights, domains), max_rate) if weights else F.lit(1.0)


def copies(rate: Column, *identity: Column | str) -> Column:
    """Whole copies of a document: its rate rounded up or down by a hash, so that totals are kept on average."""
    draw = F.pmod(F.xxhash64(*identity, F.lit("copies")), F.lit(1 << 32)) / F.lit(float(1 << 32))
    return F.least(F.floor(rate + draw), F.lit((1 << 31) - 1)).cast("int")


def mixed(
    docs: DataFrame,
    labels: DataFrame,
    targets: Mapping[str, float] = TARGETS,
    max_rate: float | None = None,
    keep: str | None = None,
) -> DataFrame:
    """``docs`` with mix_tokens, the posterior per domain, mix_rate and mix_copies.

    ``keep`` names a domain whose tokens are to stay as many as they are; else the
    number of all tokens stays.  Rates have no upper bound unless ``max_rate`` is
    given; targets that it does not allow are approached.  A document without words has no tokens and moves no total; its
    rate follows from the overall shares.
    """
    model = train(docs, labels)
    fitted = write_once(
        posteriors(docs.select("text"), model).select("mix_tokens", *[f"mix_{d}" for d in model.domains]), "posteriors"
    )
    total = None
    if keep is not None:
        held = fitted.agg(F.sum(F.col("mix_tokens") * F.col(f"mix_{keep}"))).first()[0] or 0.0
        total = held * sum(targets.values()) / targets[keep] if held else None
    weights = fit_rates(fitted, model.domains, targets, total, max_rate=max_rate)
    rate = _rate_at(weights, model.domains, max_rate)
    rated = posteriors(docs, model).withColumn("mix_rate", rate)
    return rated.withColumn("mix_copies", copies(F.col("mix_rate"), "doc_id", "text"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, tokens, posteriors, rate and copies."""
    done = mixed(docs.select("doc_id", "text"), labels)
    return done.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("mix_tokens").alias("n_tokens"),
        *[F.col(f"mix_{d}").alias(f"p_{d}") for d in DOMAINS],
        F.col("mix_rate").alias("rate"),
        F.col("mix_copies").alias("copies"),
    )


def sampled(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float], keep: str) -> DataFrame:
    """The documents at their rates without repeats (a rate of 1 at most), in the columns of ``docs``."""
    carried = [F.col(f"`{n}`").alias(f"_{i}") for i, n in enumerate(docs.columns)]
    done = mixed(docs.select("doc_id", "text", *carried), labels, targets, max_rate=1.0, keep=keep)
    # Unfolding a list of one or none, and not a filter on the copies: Spark would move that below
    # the classifier's steps and copy these, the splitting of the text included, into it many times.
    kept = F.explode_outer(F.when(F.col("mix_copies") > 0, F.array(F.lit(True)))).alias("mix_kept")
    done = done.select(*[f"_{i}" for i in range(len(carried))], kept).filter("mix_kept is not null")
    return done.select(*[F.col(f"_{i}").alias(n) for i, n in enumerate(docs.columns)])
