"""Registered queries against their SQL twins, the pipeline stage by stage, and the library without this package."""

import os
import shutil
import subprocess
import sys
import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from check_oracle import compare, connect
from tagwright.llm import queries, suffixes
from tests.llm.test_simhash import expected as components
from tests.llm.test_suffixes import expected as repeats

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def con(small_folder):
    return connect(small_folder)


def test_one_query_for_each_operator():
    numbers = [int(name[2:].split("_")[0]) for name in queries.registered()]
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(queries.statements()) <= set(queries.registered())


@pytest.mark.parametrize("name", sorted(queries.statements()))
def test_query_equals_sql(spark, con, small_folder, name):
    assert compare(spark, con, small_folder, name).startswith("ok")


@pytest.fixture(scope="module")
def stages(spark, small_folder, tmp_path_factory):
    """The input and what every stage leaves, each read back from Parquet."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{small_folder}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], small_folder).write.parquet(f"{folder}/{i}")
        out.append(spark.read.parquet(f"{folder}/{i}"))
    return out


def texts(frame):
    return sorted((r.doc_id, r.text) for r in frame.collect())


def test_stages_keep_the_columns(stages):
    for frame in stages[1:-1]:
        assert frame.columns == stages[0].columns


def test_rejected_documents_are_the_bad_ones(spark, small_folder, stages):
    labels = spark.read.parquet(f"{small_folder}/labels.parquet")
    kept = {r.doc_id for r in stages[1].collect()}
    for row in labels.collect():
        if row.quality == 1:
            assert row.doc_id in kept
    bad = [r.doc_id for r in labels.collect() if r.quality == 0]
    assert sum(i in kept for i in bad) <= 0.15 * len(bad)


def test_one_of_each_group_stays(stages):
    before = texts(stages[1])
    smallest = {component for _, _, component in components(before)}
    assert texts(stages[2]) == [(i, t) for i, t in before if i in smallest]


def test_repeated_bytes_are_gone(stages):
    import hashlib

    before, after = texts(stages[2]), dict(texts(stages[3]))
    found = {i: rest for i, *rest in repeats(before)}
    for i, text in before:
        n, removed, _, digest = found[i]
        if removed == 0:
            assert after[i] == text
        elif removed == n:
            assert i not in after
        else:
            kept = after.get(i, "").encode()
            assert n - removed - 8 * 4 <= len(kept) <= n - removed
            if len(kept) == n - removed:
                assert hashlib.sha256(kept).hexdigest() == digest


def test_mixture_keeps_clean_documents(spark, small_folder, stages):
    labels = spark.read.parquet(f"{small_folder}/labels.parquet")
    before = {r.doc_id for r in stages[3].join(labels.filter("quality = 1 and toxic = 0"), "doc_id").collect()}
    after = [r.doc_id for r in stages[4].collect()]
    assert len(after) == len(set(after)) and len(before - set(after)) <= 0.02 * len(before) + 1
    assert set(texts(stages[4])) <= set(texts(stages[3]))


def test_encoding_ends_the_pipeline(stages):
    done = stages[5]
    assert done.count() == stages[4].count()
    assert done.filter("not parity or not round_trip or n_tokens <> size(ids)").count() == 0


def test_run_gives_the_last_rows(spark, small_folder, stages):
    rows = corpus_pipeline.run(spark, small_folder)
    assert rows.columns == stages[5].columns
    assert {r.doc_id for r in rows.collect()} == {r.doc_id for r in stages[5].collect()}


def test_empty_documents_pass_through(spark, small_folder):
    docs = spark.read.parquet(f"{small_folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small_folder)
        assert docs.count() == 0


def test_odd_documents_pass_through(spark, small_folder):
    base = spark.read.parquet(f"{small_folder}/documents.parquet").limit(30)
    odd = base.limit(3).withColumn("doc_id", F.lit(None).cast("long")).unionByName(base.limit(2))
    for c in ("text", "lang", "source", "n_chars"):
        odd = odd.unionByName(base.limit(2).withColumn(c, F.lit(None).cast(dict(base.dtypes)[c])))
    docs = base.unionByName(odd)
    for extra in ("kept", "ids", "spans", "piece", "row_id", "fingerprint", "mix_rate", "judged_kept"):
        docs = docs.withColumn(extra, F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small_folder)
        assert docs.count() > 0 and "judged_kept" in docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small_folder).count() == docs.count()


def test_library_without_this_package(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; n = e.queries(); assert 'load_examples' in n and 'pipeline' not in n; print(len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_texts_travel_in_small_batches(spark):
    import pyarrow as pa

    names = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    before = {n: spark.conf.get(n) for n in names}

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    try:
        corpus_pipeline.small_batches(spark)
        docs = spark.range(0, 2000, 1, 1).selectExpr("repeat('x', 4000) AS text")
        rows = docs.mapInArrow(sizes, "n long, size long").collect()
        assert int(spark.conf.get(names[1])) <= 256
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)
    assert sum(r.n for r in rows) == 2000 and max(r["size"] for r in rows) <= (1 << 20) + (64 << 10)


def test_a_phrase_in_many_surroundings_is_no_work_for_the_suffix_stage(spark, monkeypatch, tmp_path):
    """Of documents that share a phrase, only those that share 50 bytes send strings to a shard."""
    real, folder = suffixes._scan_runs, str(tmp_path)

    def counting(length, batch_entries):
        scan = real(length, batch_entries)

        def counted(batches):
            for batch in batches:
                with open(os.path.join(folder, uuid.uuid4().hex), "w") as out:
                    out.write(str(sum(len(run) for run in batch["run"].to_pylist())))
                yield from scan(iter([batch]))

        return counted

    monkeypatch.setattr(suffixes, "_scan_runs", counting)
    noise = [f"{i * 7919 % 10007:05d}" * 6 + f"{i * 104729 % 99991:06d}" * 4 for i in range(200)]
    rows = [(i, f"{noise[i]} by the common phrase {noise[199 - i][::-1]}", "en", "web", 9) for i in range(100)]
    rows.append((100, "copied: " + rows[3][1][10:90], "en", "web", 9))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id: r.text for r in corpus_pipeline.remove_repeats(spark, docs.repartition(4), "").collect()}
    assert left == {i: t for i, t, *_ in rows[:100]} | {100: "copied: "}
    # The 80 bytes that come twice are a handful of strings.
    assert 0 < sum(int(p.read_text()) for p in tmp_path.iterdir()) <= 2000
