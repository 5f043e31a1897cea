"""Quality rules against plain Python."""

import random
import re

from pyspark.sql import functions as F

from tagwright.llm import rules


def counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    places = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (
        n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(places),
        n < 50 or 100 * len(places) > 50 * n,
    )


def corpus():
    draw = random.Random(7)
    texts = ["", None, " \n\t", "one", "a b c a b c", "x " * 200, "né " * 3 + "é\u00a0e", "##|<a> $5 &"]
    for _ in range(60):
        words = [draw.choice(["a", "b", "été", "long", "#x", "z\u2003z"]) + str(draw.randrange(9)) for _ in range(draw.randrange(200))]
        texts.append(draw.choice([" ", "\n", "  \n "]).join(words))
    hosts = ["bad", "good", None]
    rows = [(i, t, hosts[i % 3]) for i, t in enumerate(texts)]
    rows += [(200 + i, " ".join(f"w{j}" for j in range(80)), draw.choice(hosts[1:])) for i in range(80)]
    rows += [(None, "few words", "good"), (3, texts[3], "bad"), (400, " ".join(f"v{j}" for j in range(80)), "bad")]
    return rows + [(500 + i, "too short", "bad") for i in range(60)]


def test_counts(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_words", F.lit("clash"))
    got = rules.digest(docs).collect()
    assert sorted((r[:-1] for r in got), key=repr) == sorted(((i, *counts(t)) for i, t, _ in rows), key=repr)


def test_hosts(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    failed, sizes = {}, {}
    for _, text, host in rows:
        sizes[host] = sizes.get(host, 0) + 1
        failed[host] = failed.get(host, 0) + counts(text)[-1]
    rates = [failed[h] / sizes[h] for h in sizes]
    mean = sum(rates) / len(rates)
    spread = sum((r - mean) ** 2 for r in rates) / len(rates)
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1000.0)
    shrunk = {h: (failed[h] + mean * strength) / (sizes[h] + strength) for h in sizes}
    assert shrunk["bad"] > 0.5 >= shrunk["good"]
    got = rules.judged(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.host_rate - shrunk[r.host]) < 1e-9
        assert r.kept == (not r.base_failed and shrunk[r.host] <= 0.5)
    assert any(not r.base_failed and not r.kept for r in got)


def test_hosts_without_differences_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a", "h"), (2, "b", "i")], "doc_id long, text string, source string")
    assert [r.kept for r in rules.digest(docs).collect()] == [False, False]
    assert rules.digest(docs.limit(0)).collect() == []


def test_main_path_is_native(spark, small_folder):
    plan = rules.digest(spark.read.parquet(f"{small_folder}/documents.parquet"))
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text
