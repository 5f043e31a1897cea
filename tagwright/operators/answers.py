"""Answers by content: one call per distinct text, prompt and model, in this run and in later ones."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagwright.functions.prompts import Prompt
from tagwright.operators.predict import _ANSWER_FIELDS, Complete, carried, predict
from tagwright.session import path_exists, write_once

ANSWER = [f.name for f in _ANSWER_FIELDS]
SCHEMA = T.StructType([T.StructField("digest", T.BinaryType()), *_ANSWER_FIELDS])

# Texts with at least this share of the rows are hot; there are no more of them than its reciprocal.
HOT_SHARE = 0.001


class AnswerStore:
    """A folder of answers; every run adds what it has asked for, in a folder of its own."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def table(self) -> DataFrame:
        """One answer per digest; runs at the same time may have asked for the same one."""
        if not path_exists(self.spark, self.root):
            return self.spark.createDataFrame([], SCHEMA)
        found = self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(self.root)
        whole = F.struct(*ANSWER)
        first = found.groupBy("digest").agg(F.min(whole).alias("answer"))
        return first.select("digest", "answer.*")

    def add(self, answers: DataFrame) -> DataFrame:
        """Write new answers; those whose calls failed stay out of the store, but are returned with the others."""
        written = write_once(answers.select("digest", *ANSWER), "new-answers")
        written.filter(F.col("error").isNull()).write.parquet(f"{self.root}/part-{uuid.uuid4().hex}")
        return written


def prompt_digest(prompt: Prompt, model: dict | None = None, max_retries: int = 0) -> str:
    """Names everything but the text that an answer depends on."""
    told = {"system": prompt.system, "style": prompt.style, "input": prompt.user(""), "model": model, "retries": max_retries}
    return hashlib.sha256(json.dumps(told, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def answer_digest(text: Column, named: str) -> Column:
    """Digest of a row's prompt; a null text is asked about like an empty one."""
    content = F.concat(F.lit(named), F.coalesce(text, F.lit("")))
    return F.unhex(F.sha2(content.cast("binary"), 256))


def predict_distinct(rows: DataFrame, build: Callable[[], Complete], prompt: Prompt | dict[int, Prompt], store: AnswerStore, *,
                     model: dict | None = None, keep_text: bool = False, max_retries: int = 0, **how) -> DataFrame:
    """The rows that ``predict`` gives, with one call for each text that ``store`` has no answer to.

    Texts are brought together by digest, each task its own first, so a text that a
    third of the rows share moves once per task.  Answers go back to the rows by
    digest: those of the hot texts, a thousand at most, are broadcast, and the others
    are joined by key.  Calls that fail are not stored and so are made again by the
    next run.  ``model`` describes the model in the digest; answers of another model,
    prompt or number of retries are other answers.  Rows that a user's ``validator``
    judges should keep a store of their own.

    Unlike ``predict`` this makes the calls at once, and the result is read from what
    they gave.
    """
    if isinstance(prompt, dict):
        tried = [
            predict_distinct(rows, build, one, store, model=model, keep_text=keep_text, max_retries=max_retries, **how)
            .withColumn("candidate_id", F.lit(key).cast("int"))
            for key, one in prompt.items()
        ]
        return reduce(DataFrame.unionByName, tried)
    rows = carried(rows)
    digest = answer_digest(F.col("symptoms"), prompt_digest(prompt, model, max_retries))
    keyed = rows.withColumn("_digest", digest)
    copies = keyed.groupBy("_digest").agg(F.count(F.lit(1)).alias("copies"), F.first("symptoms").alias("symptoms"))
    copies = write_once(copies, "distinct-prompts")
    known = store.table()
    missing = copies.join(known, F.col("_digest") == F.col("digest"), "left_anti")
    # The digest is binary; calls are told rows apart by its hex form.
    asked = predict(
        missing.select(F.hex("_digest").alias("example_id"), "symptoms"), build, prompt, max_retries=max_retries, **how
    )
    new = store.add(asked.withColumn("digest", F.unhex("example_id")))
    # The store may have grown by another run's answers meanwhile: the table read before is complete with the new ones.
    wanted = copies.select(F.col("_digest").alias("wanted"), "copies")
    old = known.join(wanted, F.col("digest") == F.col("wanted"), "left_semi")
    answers = write_once(old.unionByName(new), "answers-by-digest")
    hot = copies.filter(F.col("copies") >= F.greatest(F.lit(2.0), HOT_SHARE * copies.agg(F.sum("copies")).scalar()))
    hot = write_once(hot.select(F.col("_digest").alias("of")), "hot-prompts")
    rows_of = keyed if keep_text else keyed.drop("symptoms")
    kept = [c for c in rows_of.columns if c != "_digest"]
    hot_answers = F.broadcast(answers.join(F.broadcast(hot), F.col("digest") == F.col("of"), "left_semi"))
    often = rows_of.join(hot_answers, F.col("_digest") == F.col("digest"))
    seldom = rows_of.join(F.broadcast(hot), F.col("_digest") == F.col("of"), "left_anti")
    seldom = seldom.join(answers, F.col("_digest") == F.col("digest"))
    return often.select(*kept, *ANSWER).unionByName(seldom.select(*kept, *ANSWER))
