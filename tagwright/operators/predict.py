"""Batch prediction with a user-supplied model call."""

from __future__ import annotations

import json
import sys
import threading
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagwright.functions.prompts import Prompt
from tagwright.functions.text import WHITESPACE
from tagwright.operators.validate import flag_invalid_output
from tagwright.session import write_once
from tagwright.spec import TaskSpec

# Send this package along with the tasks, so that workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules["tagwright"])


@dataclass(frozen=True)
class Reply:
    """What a model returned for one row."""

    output: str | None
    prompt_tokens: int | None = None
    completion_tokens: int | None = None


Complete = Callable[[str, list[str]], list["Reply | str | None"]]

_ANSWER_FIELDS = [
    T.StructField("raw_output", T.StringType()),
    T.StructField("predicted", T.StringType()),
    T.StructField("reasoning", T.StringType()),
    T.StructField("attempts", T.IntegerType()),
    T.StructField("valid", T.BooleanType()),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
    T.StructField("error", T.StringType()),
]


def carried(rows: DataFrame) -> DataFrame:
    """Rows with the label under ``actual``, as predictors pass them on."""
    return rows.withColumnRenamed("diagnosis", "actual")


def read_answer(raw: str | None, style: str) -> tuple[str | None, str | None]:
    """Label and reasoning named by one raw answer."""
    if raw is None or style == "answer_only":
        return (raw if raw is None else raw.strip(WHITESPACE)), None
    try:
        reply = json.loads(raw)
    except ValueError:
        return None, None
    if not isinstance(reply, dict):
        return None, None
    label, reasoning = reply.get("diagnosis"), reply.get("reasoning")
    if reasoning is not None and not isinstance(reasoning, str):
        reasoning = json.dumps(reasoning, ensure_ascii=False)
    return (label.strip(WHITESPACE) if isinstance(label, str) else None), reasoning


class ReplyCountError(ValueError):
    """A call that does not answer every message is wrong itself."""


def _replies(complete: Complete, system: str, messages: list[str]) -> list[Reply | Exception]:
    """A reply or the failure of each message; messages of a failing batch are tried one by one."""
    try:
        replies = complete(system, messages)
    except Exception as e:
        if len(messages) == 1:
            return [e]
        return [reply for m in messages for reply in _replies(complete, system, [m])]
    if len(replies) != len(messages):
        raise ReplyCountError(f"asked for {len(messages)} replies, got {len(replies)}")
    return [r if isinstance(r, Reply) else Reply(r) for r in replies]


def _ask(complete: Complete, prompt: Prompt, texts: list[str], max_retries: int,
         validator: Callable[[str], bool] | None = None) -> dict[str, list]:
    """Answers for one batch; rows whose answer is not valid or whose call failed are asked again."""
    allowed = set(prompt.task.vocabulary)
    passes = validator or (lambda label: label.lower() in allowed)
    n = len(texts)
    messages = [prompt.user(t or "") for t in texts]
    answers = {f.name: [None] * n for f in _ANSWER_FIELDS}
    pending = list(range(n))
    for attempt in range(1, max_retries + 2):
        replies = _replies(complete, prompt.system, [messages[i] for i in pending])
        invalid = []
        for i, reply in zip(pending, replies):
            if isinstance(reply, Exception):
                answers["error"][i] = f"{type(reply).__name__}: {reply}"
                answers["attempts"][i] = attempt
                answers["valid"][i] = False
                invalid.append(i)
                continue
            answers["error"][i] = None
            label, reasoning = read_answer(reply.output, prompt.style)
            valid = label is not None and bool(passes(label))
            answers["raw_output"][i] = reply.output
            answers["predicted"][i] = label
            answers["reasoning"][i] = reasoning
            answers["attempts"][i] = attempt
            answers["valid"][i] = valid
            for name in ("prompt_tokens", "completion_tokens"):
                used = getattr(reply, name)
                if used is not None:
                    answers[name][i] = (answers[name][i] or 0) + used
            if not valid:
                messages[i] = f"{prompt.user(texts[i] or '')}\n\n{prompt.feedback(label)}"
                invalid.append(i)
        pending = invalid
        if not pending:
            break
    return answers


def in_order(work: Callable, items: Iterator, at_once: int) -> Iterator:
    """``work`` on every item, up to ``at_once`` of them in threads at a time; results come in the items' order.

    An item is taken only when there is room for its result, so no more than
    ``at_once`` items and results are held.  A failure is raised where its result
    would come, and what has not begun then never does.
    """
    if at_once == 1:
        yield from map(work, items)
        return
    waiting: deque[Future] = deque()
    with ThreadPoolExecutor(at_once) as pool:
        try:
            for item in items:
                waiting.append(pool.submit(work, item))
                if len(waiting) == at_once:
                    yield waiting.popleft().result()
            while waiting:
                yield waiting.popleft().result()
        finally:
            pool.shutdown(wait=True, cancel_futures=True)


def call_profile(cpus: int) -> ResourceProfile:
    """Resources of a stage whose tasks take ``cpus`` cores each.

    A cluster with n cores then runs n // cpus tasks of model calls at a time, whatever
    other stages do, which bounds all calls in flight to ``in_flight`` times that.
    """
    if cpus < 1:
        raise ValueError(f"a task takes one core at least, got {cpus}")
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(cpus)).build


def predict(rows: DataFrame, build: Callable[[], Complete], prompt: Prompt | dict[int, Prompt], *,
            max_retries: int = 0, parallelism: int | None = None, batch_size: int = 256,
            keep_text: bool = False, validator: Callable[[str], bool] | None = None,
            in_flight: int = 1, profile: ResourceProfile | None = None) -> DataFrame:
    """Call a model once per row on the executors.

    ``build`` runs once per task, or once per thread of it, and returns the call, so
    clients are opened where they are used; the prompt travels with the task instead
    of with every row.  Retries with feedback happen inside the task.  Several prompts,
    keyed by candidate, are all tried on every row and told apart by ``candidate_id``;
    the text reaches the task once.

    A task has up to ``in_flight`` calls of ``batch_size`` rows out at a time, each with
    its own retries; rows keep their order, and no more batches than that are held.
    ``profile`` (see ``call_profile``) bounds the tasks that run at a time.

    The result has every column of ``rows``, with the label as ``actual`` and
    without the text unless ``keep_text`` is set.  It is lazy: write it before using it twice (``predict_once``).
    A lost task is run again, so calls should be idempotent.  A row whose calls all
    fail is not valid and has the failure under ``error``; ``predict_missing`` asks
    for such rows again.
    """
    if in_flight < 1 or batch_size < 1:
        raise ValueError("in_flight and batch_size must be positive")
    prompts = prompt if isinstance(prompt, dict) else {None: prompt}
    rows = carried(rows)
    if parallelism:
        # Ids are unique, so hashing them spreads rows evenly and repeatably.
        rows = rows.repartition(parallelism, "example_id")
    kept = [f for f in rows.schema.fields if keep_text or f.name != "symptoms"]
    tried = [] if None in prompts else [T.StructField("candidate_id", T.IntegerType())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = threading.local()

        def parts() -> Iterator[tuple]:
            for batch in batches:
                for start in range(0, len(batch), batch_size):
                    part = batch.iloc[start : start + batch_size].reset_index(drop=True)
                    for key, chosen in prompts.items():
                        yield part, key, chosen

        def answered(item: tuple) -> pd.DataFrame:
            part, key, chosen = item
            if not hasattr(opened, "complete"):
                opened.complete = build()
            answers = _ask(opened.complete, chosen, part["symptoms"].tolist(), max_retries, validator)
            extra = {} if key is None else {"candidate_id": key}
            columns = {
                f.name: pd.Series(answers[f.name], dtype="Int64" if f.name.endswith("_tokens") else object)
                for f in _ANSWER_FIELDS
            }
            return (part if keep_text else part.drop(columns="symptoms")).assign(**extra, **columns)

        yield from in_order(answered, parts(), in_flight)

    return rows.mapInPandas(run, T.StructType([*kept, *tried, *_ANSWER_FIELDS]), profile=profile)


def predict_once(predictions: DataFrame) -> DataFrame:
    """Predictions computed once and kept as a table in the shared folder."""
    return write_once(predictions, "predictions")


def predict_missing(rows: DataFrame, done: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A written prediction table, completed: rows not in it, and rows whose call failed, are asked.

    Rows are told apart by ``example_id``, which has to be unique.
    """
    answered = done.filter(F.col("error").isNull())
    missing = rows.join(answered.select("example_id"), "example_id", "left_anti")
    return answered.unionByName(run(missing))


def retry_rows(predictions: DataFrame, task: TaskSpec) -> DataFrame:
    """Rows of a prediction table that need another try, with their feedback."""
    return flag_invalid_output(predictions, task).filter(~F.col("valid"))
