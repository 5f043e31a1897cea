"""Weak labels: the label model on planted accuracies, the classifier on held-out labels."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tagwright.llm import quality


def test_em_finds_planted_accuracies():
    draw = np.random.default_rng(1)
    width = len(quality.LABELLERS)
    right = np.linspace(0.6, 0.95, width)
    truth = draw.random(20_000) < 0.8
    counts = {}
    for good in truth:
        cast = [0 if draw.random() < 0.3 else (1 if good else -1) * (1 if draw.random() < r else -1) for r in right]
        pattern = quality._pattern(tuple(cast))
        counts[pattern] = counts.get(pattern, 0) + 1
    model = quality.fit_labels(counts)
    assert np.abs(model.accuracies() - right).max() < 0.03 and abs(model.prior - 0.8) < 0.03


def test_em_without_documents():
    model = quality.fit_labels({})
    assert model.prior == 0.5 and model.posterior(["+" * len(quality.LABELLERS)])[0] > 0.9
    assert model.posterior(["." * len(quality.LABELLERS)])[0] == 0.5


def test_facts_in_parts(monkeypatch):
    text = ("One two two.\nOne two two.\n\n  \n" + "WORD! " * 30 + "a#b c|d\n").encode()
    whole = quality.facts(text)
    monkeypatch.setattr("tagwright.llm.textbytes.WORD_BYTES", 20)
    assert quality.facts(text) == whole
    assert (whole.words, whole.distinct, whole.adjacent) == (38, 6, 29)
    assert (whole.shouts, whole.symbols, whole.lines, whole.repeated_lines) == (30, 2, 3, 1)


def test_grams_stay_inside_rows(monkeypatch):
    import pyarrow as pa

    column = pa.array(["abcdef", None, "xyz", "abcdefgh"])
    whole = sorted((r, b) for rows, buckets in quality._rows_of_pieces(column) for r, b in zip(rows.tolist(), buckets.tolist()))
    assert [r for r, _ in whole] == [0, 0, 3, 3, 3, 3]
    monkeypatch.setattr(quality, "PIECE_BYTES", 3)
    assert whole == sorted((r, b) for rows, buckets in quality._rows_of_pieces(column) for r, b in zip(rows.tolist(), buckets.tolist()))


@pytest.fixture(scope="module")
def folder():
    return "/root/testdata/sf0.01"


def test_against_labels(spark, folder):
    """The labels table takes no part in training, so all of it is held out."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    done = quality.digest(docs)
    rows = done.join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n.get((1, False), 0) <= 0.005 * n[1, True]
    assert n.get((0, False), 0) >= 0.9 * (n.get((0, True), 0) + n.get((0, False), 0))
    assert done.count() == docs.count()


def test_odd_rows(spark):
    clean = "The calm river runs past old stones, and the people of the village walk there. "
    rows = [(i, clean + f"Day {i} was the {i}th of them and " + " ".join(chr(97 + (i * j) % 26) * 3 for j in range(1, 30)) + ".") for i in range(60)]
    rows += [(100 + i, "BUY NOW!!! " * 40) for i in range(10)] + [(200, None), (201, ""), (202, " \n"), (None, rows[0][1]), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("judged_kept", F.lit("clash")).withColumn("text2", F.lit(1))
    kept = quality.keep_good(docs.drop("judged_kept"))
    assert kept.columns == ["doc_id", "text", "text2"]
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())
    assert ids == sorted([-1, 3, *range(60)])
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.digest(docs.limit(0)).collect() == []
