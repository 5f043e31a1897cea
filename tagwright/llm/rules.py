"""Quality rules of documents and of the hosts they come from.

Every document is judged by rules on its own text.  Failures are then counted by
host (``source``), each host's failure rate is shrunk towards all hosts' by a beta
prior that is estimated from the hosts themselves, and the host's verdict is joined
back to its documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.session import write_once

#: A host whose shrunk failure rate is higher is rejected with all its documents.
HOST_THRESHOLD = 0.5
MIN_WORDS = 50
#: Percentage of words in repeated windows that fails a document.
MAX_REPEATED = 50
WINDOW = 3

_BLANKS = r"[ \t-\r]+"
_SYMBOLS = "#*$%&|<>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _BLANKS), lambda w: w != "")


def _windows(words: Column) -> Column:
    """A hash for each window of neighbouring words, in order."""
    n = F.size(words) - (WINDOW - 1)
    ends = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(ends, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))


def _repeated_words(hashes: Column) -> Column:
    """Words that lie in windows found at least twice.

    Windows are sorted with their places; those with an equal neighbour are kept,
    and each adds the words that the kept window after it does not cover.
    """

    def covered(places: Column) -> Column:
        gaps = F.transform(
            places, lambda p, i: F.least(F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))
        )
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def kept(found: Column) -> Column:
        twice = F.filter(
            found,
            lambda w, i: (
                F.coalesce(F.get(found, i - 1)["h"] == w["h"], F.lit(False))
                | F.coalesce(F.get(found, i + 1)["h"] == w["h"], F.lit(False))
            ),
        )
        return let(F.sort_array(F.transform(twice, lambda w: w["p"])), covered)

    placed = F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p")))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
        let(F.sort_array(placed), kept)
    )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, host and the counts that the rules look at, for every document; a null text has none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(r"[^ \t-\r]")))
    cut = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").alias("host"),
        _words(text).alias("words"),
        lines.alias("lines"),
        F.length(F.regexp_replace(text, f"[^{_SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
    )
    counted = cut.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        let(_windows(F.col("words")), _repeated_words).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def host_rates(judged: DataFrame) -> DataFrame:
    """Per host: documents, failures and the shrunk failure rate.

    The prior's mean is the mean of the hosts' rates, its strength follows from
    their variance (method of moments) and stays between 1 and 1,000 documents.
    Documents without a host make up a host of their own.
    """
    hosts = judged.groupBy("host").agg(
        F.count(F.lit(1)).alias("host_docs"), F.count_if("base_failed").alias("host_failed")
    )
    rate = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg(F.avg(rate).alias("mean"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("spread"))
    mean, spread = F.col("mean"), F.col("spread")
    strength = F.when(spread > 0, mean * (1 - mean) / spread - 1).otherwise(F.lit(1000.0))
    prior = prior.select(F.struct("mean", F.least(F.greatest(strength, F.lit(1.0)), F.lit(1000.0)).alias("strength")))
    known = F.lit(prior.scalar())
    shrunk = (F.col("host_failed") + known["mean"] * known["strength"]) / (F.col("host_docs") + known["strength"])
    return hosts.withColumn("host_rate", shrunk)


def judged(docs: DataFrame, threshold: float = HOST_THRESHOLD) -> DataFrame:
    """Every document's counts, its host's rate and whether it is kept.

    The counts are written once without the texts and read for the hosts and for
    the documents.  The hosts are joined by Spark's choice: broadcast only while
    they are below its threshold, else by key, where a host of a third of all
    documents is a skewed partition that AQE splits.
    """
    counts = write_once(measured(docs), "rule-counts")
    rates = host_rates(counts).withColumnRenamed("host", "rated")
    joined = counts.join(write_once(rates, "host-rates"), F.col("host").eqNullSafe(F.col("rated")))
    kept = ~F.col("base_failed") & (F.col("host_rate") <= threshold)
    return joined.select(*counts.columns, "host_docs", "host_failed", "host_rate", kept.alias("kept"))


def digest(docs: DataFrame) -> DataFrame:
    return judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


#: The same in SQL.
SQL = r"""
WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
cut AS (
  SELECT doc_id, source, text,
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM texts),
windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS p, words FROM cut WHERE len(words) > 2),
grams AS (SELECT doc_id, p, (words[p], words[p + 1], words[p + 2]) AS g FROM windows),
twice AS (SELECT doc_id, g FROM grams GROUP BY doc_id, g HAVING count(*) > 1),
covered AS (
  SELECT DISTINCT doc_id, p + k AS place
  FROM (SELECT g.doc_id, g.p FROM grams g JOIN twice t ON g.doc_id = t.doc_id AND g.g = t.g), (SELECT unnest([0, 1, 2]) AS k)),
repeated AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
base AS (
  SELECT c.doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words
  FROM cut c LEFT JOIN repeated r ON c.doc_id = r.doc_id),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM failed GROUP BY source),
moments AS (SELECT avg(f / n) AS m, coalesce(var_pop(f / n), 0) AS v FROM hosts),
prior AS (SELECT m, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1000 END, 1), 1000) AS s FROM moments),
rates AS (SELECT source, (f + m * s) / (n + s) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rate <= 0.5 AS kept
FROM failed f JOIN rates r ON f.source IS NOT DISTINCT FROM r.source
"""
