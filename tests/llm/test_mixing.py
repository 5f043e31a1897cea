"""Soft-membership mixing: the classifier on held-out labels, the fit against its conditions."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tagwright.llm import mixing
from tests.conftest import plan_of

WORDS = {"clean": "calm lake river stone cloud", "low": "click buy now cheap deal", "toxic": "scum idiot awful nasty vile"}
LABELS = {"clean": (1, 0), "low": (0, 0), "toxic": (1, 1)}


def corpus(spark, n=300):
    draw = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        name = ("clean", "clean", "clean", "low", "toxic")[i % 5]
        own = draw.choice(WORDS[name].split(), 12)
        common = draw.choice([f"c{j}" for j in range(40)], 30)
        rows.append((i, " ".join([*own, *common]), f"s{i % 3}"))
        if i % 2:
            labels.append((i, *LABELS[name]))
    rows += [(1000, None, "a"), (1001, "", None), (None, "calm lake", "a"), (1001, "", None)]
    labels += [(None, 1, 0), (2, None, 0), (4, 1, None), (1, 1, 0), (99_999, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_posteriors_on_held_out(spark):
    docs, labels = corpus(spark)
    scored = mixing.posteriors(docs, mixing.train(docs, labels)).collect()
    held = [r for r in scored if r.doc_id is not None and r.doc_id < 1000 and r.doc_id % 2 == 0]
    right = [max(WORDS, key=lambda d, r=r: r[f"mix_{d}"]) == ("clean", "clean", "clean", "low", "toxic")[r.doc_id % 5] for r in held]
    assert np.mean(right) > 0.97
    assert all(abs(sum(r[f"mix_{d}"] for d in mixing.DOMAINS) - 1) < 1e-9 for r in scored)


@pytest.mark.parametrize("targets", [{"clean": 0.6, "low": 0.2, "toxic": 0.2}, {"clean": 0.9, "low": 0.05, "toxic": 0.05}, {"clean": 1.0}])
def test_expected_totals_meet_targets(spark, targets):
    docs, labels = corpus(spark)
    rows = mixing.mixed(docs, labels, targets, max_rate=10.0).collect()
    assert len(rows) == docs.count()
    tokens = sum(r.mix_tokens for r in rows)
    for d in mixing.DOMAINS:
        total = sum(r.mix_rate * r.mix_tokens * r[f"mix_{d}"] for r in rows)
        assert total / tokens == pytest.approx(targets.get(d, 0.0), abs=2e-3)
    assert all(0 <= r.mix_rate <= 10 for r in rows)


def test_fit_is_at_a_minimum(spark):
    """Where targets are out of reach, no document's rate can be moved to lower the misfit."""
    draw = np.random.default_rng(4)
    q = draw.dirichlet([0.3, 0.3, 0.3], 200)
    t = draw.integers(1, 100, 200)
    rows = [(int(n), *map(float, p)) for n, p in zip(t, q)]
    scored = spark.createDataFrame(rows, "mix_tokens long, mix_clean double, mix_low double, mix_toxic double")
    path = mixing.fit_rates(scored, mixing.DOMAINS, {"clean": 0.98, "low": 0.01, "toxic": 0.01}, rounds=60, max_rate=2.0)
    rate = np.array([r[0] for r in scored.select(mixing._rate_at(path, mixing.DOMAINS, 2.0)).collect()])
    wanted = np.array([0.98, 0.01, 0.01])
    overlap = (q * t[:, None]).T @ q / t.sum()
    misfit = (rate * t) @ q / t.sum() - wanted
    slope = q @ np.linalg.pinv(overlap + 1e-6 * np.eye(3)) @ misfit
    inside = (rate > 1e-6) & (rate < 2 - 1e-6)
    assert np.abs(slope[inside]).max(initial=0) < 1e-2
    assert (slope[rate <= 1e-6] > -1e-2).all() and (slope[rate >= 2 - 1e-6] < 1e-2).all()


def test_copies_keep_totals(spark):
    rates = spark.range(20_000).select("id", (F.col("id") % 4 * 0.4 + 0.3).alias("rate"))
    made = rates.select("rate", mixing.copies(F.col("rate"), "id").alias("n")).groupBy("rate").agg(F.avg("n").alias("n")).collect()
    assert all(r.n == pytest.approx(r.rate, abs=0.03) for r in made)


def test_sampled_keeps_clean_documents(spark):
    docs, labels = corpus(spark)
    docs = docs.withColumn("mix_rate", F.lit("clash"))
    kept = mixing.sampled(docs, labels, {"clean": 0.97, "low": 0.0, "toxic": 0.03}, keep="clean")
    assert kept.schema == docs.schema
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i in range(300) if i % 5 < 3} <= ids and len({i for i in ids if i and i % 5 == 3 and i < 300}) < 5


def test_nothing_to_learn_from(spark):
    docs, labels = corpus(spark, 10)
    rows = mixing.digest(docs, labels.limit(0)).collect()
    assert len(rows) == docs.count() and all(r.p_clean == pytest.approx(1 / 3) for r in rows)
    assert mixing.digest(docs.limit(0), labels).collect() == []


def test_registered_query_meets_targets_of_a_rare_domain(spark):
    docs, labels = corpus(spark)
    rare = "doc_id % 5 <> 4 or doc_id < 20"
    docs, labels = docs.filter(rare), labels.filter(rare)
    rows = mixing.digest(docs, labels).collect()
    tokens = sum(r.n_tokens for r in rows)
    for d, target in mixing.TARGETS.items():
        assert sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) / tokens == pytest.approx(target, abs=1e-3)
    assert max(r.rate for r in rows) > 4


def test_copies_near_whole_numbers_keep_totals(spark):
    for rate in (0.005, 0.03, 0.96, 1.04, 2.97):
        n = spark.range(200_000).select(mixing.copies(F.lit(rate), "id").alias("n")).agg(F.avg("n")).first()[0]
        assert n == pytest.approx(rate, abs=2e-3)
    assert spark.range(1000).select(mixing.copies(F.lit(1.0), "id").alias("n")).distinct().collect() == [(1,)]


def test_soft_posteriors_and_a_rare_domain_converge(spark, caplog):
    draw = np.random.default_rng(6)
    odds = draw.normal(0, 1, (2000, 3))
    odds[np.arange(2000), draw.choice(3, 2000, p=[0.02, 0.6, 0.38])] += 3
    q = np.exp(odds) / np.exp(odds).sum(axis=1, keepdims=True)
    rows = [(int(n), *map(float, p)) for n, p in zip(draw.integers(1, 100, 2000), q)]
    scored = spark.createDataFrame(rows, "mix_tokens long, mix_clean double, mix_low double, mix_toxic double")
    rate = mixing._rate_at(mixing.fit_rates(scored, mixing.DOMAINS, mixing.TARGETS), mixing.DOMAINS, None)
    shares = [F.sum(rate * F.col("mix_tokens") * F.col(f"mix_{d}")) / F.sum("mix_tokens") for d in mixing.DOMAINS]
    assert scored.agg(*shares).first()[:] == pytest.approx(tuple(mixing.TARGETS.values()), abs=2e-6)
    assert not caplog.records
    with pytest.raises(RuntimeError, match="not converged"):
        mixing.fit_rates(scored, mixing.DOMAINS, mixing.TARGETS, rounds=3)
    mixing.fit_rates(scored, mixing.DOMAINS, mixing.TARGETS, max_rate=1.0)
    assert "out of reach" in caplog.text


def test_a_text_is_split_once(spark):
    docs, labels = corpus(spark, 20)
    plan = plan_of(mixing.sampled(docs, labels, {"clean": 0.97, "low": 0.0, "toxic": 0.03}, keep="clean"))
    executed = plan[plan.index("== Physical Plan"):].split("Subqueries")[0]
    assert executed.count("split(") == 1
