"""The two long jobs: tune a classifier, evaluate a registered one."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tagwright.functions.prompts import Prompt
from tagwright.operators import demos as demo_ops
from tagwright.operators import report
from tagwright.operators.predictors import Model, Predictor, predictor
from tagwright.operators.rows import among_first, first_n
from tagwright.operators.score import (
    disagreements,
    keep_wrong_texts,
    samples_by_split,
    score,
)
from tagwright.operators.validate import write_valid
from tagwright.session import write_once
from tagwright.sources import sinks
from tagwright.sources.examples import Dataset
from tagwright.sources.tracking import RunStore, dataset_params

# Fixed value: rows in a prediction sample.
SAMPLE_SIZE = 10

EVALUATION_SPLITS = ("train", "validation", "test", "train_full")


@dataclass(frozen=True)
class TuneResult:
    train_accuracy: float
    validation_accuracy: float
    num_train_examples: int
    num_val_examples: int
    model_name: str
    version: int
    run_id: str
    scored: DataFrame


@dataclass(frozen=True)
class EvaluateResult:
    accuracy: float
    num_examples: int
    split: str
    run_id: str
    scored: DataFrame
    model_name: str


def _capped_parts(data: Dataset, caps: dict[str, int | None]) -> DataFrame:
    """Rows of some parts, each up to its cap, in one scan."""
    parts = data.parts().select("example_id", "symptoms", "diagnosis", "split")
    wanted = F.lit(False)
    for part, cap in caps.items():
        mine = F.col("split") == part
        wanted = wanted | (mine & among_first(parts.filter(mine), cap))
    return parts.filter(wanted)


def _checked(rows: DataFrame, data: Dataset) -> DataFrame:
    """The chosen rows, written once and checked on the way; whatever follows reads them and not the source."""
    return write_valid(rows, data.task)[0]


_TOKENS = ("prompt_tokens", "completion_tokens")


def _predict_and_score(model: Model, rows: DataFrame, splits: tuple[str, ...]) -> tuple[DataFrame, dict[str, dict]]:
    """Predict and score in one job whose result is written; the job counts each part's metrics on its way."""
    scored = keep_wrong_texts(score(model.predict(rows, keep_text=True)))
    calls = "prompt_tokens" in scored.columns
    correct = F.col("correct")
    sums = []
    for i, split in enumerate(splits):
        mine = F.col("split") == split
        sums += [
            F.count_if(mine).alias(f"num_examples_{i}"),
            F.sum(F.when(mine, correct)).alias(f"correct_{i}"),
            F.count_if(mine & (correct == 0)).alias(f"disagreements_{i}"),
        ]
        if calls:
            sums += [F.sum(F.when(mine, F.col(name))).alias(f"{name}_{i}") for name in _TOKENS]
            sums.append(F.count_if(mine & F.col("error").isNotNull()).alias(f"errors_{i}"))
    seen = Observation(f"scores-{uuid.uuid4().hex}")
    written = write_once(scored.observe(seen, *sums), "scored")
    metrics = {}
    for i, split in enumerate(splits):
        n = seen.get.get(f"num_examples_{i}") or 0
        if not n:
            raise ValueError(f"the {split} part has no rows")
        accuracy = (seen.get[f"correct_{i}"] or 0.0) / n
        if not 0.0 <= accuracy <= 1.0:
            raise ValueError(f"accuracy of the {split} part must be between 0.0 and 1.0, got {accuracy}")
        used = {name: seen.get[f"{name}_{i}"] for name in (*_TOKENS, "errors")} if calls else {}
        metrics[split] = {"accuracy": accuracy, "num_examples": n, "disagreements": seen.get[f"disagreements_{i}"], **used}
    return written, metrics


def _record(store: RunStore, run_id: str, rows: DataFrame, scored: DataFrame, metrics: dict[str, dict],
            params: dict, sample_size: int) -> None:
    """Parameters, metrics, samples and disagreements of written predictions."""
    store.log_params(run_id, params)
    # Tokens that no call has reported are no metric.
    store.log_metrics(run_id, [(split, name, v) for split, m in metrics.items() for name, v in m.items() if v is not None])
    folder = f"{store.root}/artifacts/{run_id}"
    sample = samples_by_split(scored, rows, sorted(metrics), sample_size)
    # One file for a few rows; a coalesce would also squeeze the scan into one task.
    sinks.write_rows(sample.repartition(1), f"{folder}/predictions_sample")
    sinks.write_rows(disagreements(scored, rows), f"{folder}/disagreements")


def tune(data: Dataset, chosen: Predictor, store: RunStore, *, model_name: str = "classifier",
         train_size: int | None = None, val_size: int | None = None, project: str = "default",
         experiment: str = "tune", run_id: str | None = None, aliases=(),
         sample_size: int = SAMPLE_SIZE) -> TuneResult:
    """Split, cap, fit, predict once, score, record and register.

    The chosen rows are written once; rows that do not pass validation and missing or
    repeated ids are refused before anything is fitted.  Training and validation rows
    are predicted in one job whose result is written; every metric and artifact is
    read from these two tables.
    """
    rows = _checked(_capped_parts(data, {"train": train_size, "validation": val_size}), data)
    train, validation = (rows.filter(F.col("split") == part) for part in ("train", "validation"))
    model = chosen.fit(train, data.task, validation)
    scored, metrics = _predict_and_score(model, rows, ("train", "validation"))
    options, lm = chosen.options(), getattr(chosen, "model", None)
    lm_model = lm.model if lm else None
    run_id = store.start_run(project, experiment, chosen.name, chosen.requires_training, lm_model, run_id)
    sizes = {split: m["num_examples"] for split, m in metrics.items()}
    params = {
        "framework": chosen.name,
        "requires_training": chosen.requires_training,
        "train_size": sizes["train"],
        "val_size": sizes["validation"],
        **{k: v for k, v in options.items() if k != "model"},
        **({f"lm_{k}": v for k, v in options["model"].items()} if lm else {}),
        **dataset_params(data.source, sizes),
    }
    _record(store, run_id, rows, scored, metrics, params, sample_size)
    folder = f"{store.root}/artifacts/{run_id}"
    table, description = model.artifact()
    if table is not None:
        table.write.mode("overwrite").parquet(f"{folder}/model")
    if getattr(model, "trials", None) is not None:
        model.trials.write.mode("overwrite").parquet(f"{folder}/trials")
    _write_report(f"{folder}/prompt_details", data, model, train)
    accuracies = {f"{split}_accuracy": metrics[split]["accuracy"] for split in ("train", "validation")}
    config = {
        "predictor": chosen.name,
        "options": options,
        "requires_training": chosen.requires_training,
        "task": data.task.name,
        "lm_model": lm_model,
        "has_table": table is not None,
        "description": description,
    }
    version = store.register(model_name, run_id, config, accuracies, aliases)
    return TuneResult(
        accuracies["train_accuracy"], accuracies["validation_accuracy"], sizes["train"], sizes["validation"],
        model_name, version, run_id, scored,
    )


def _write_report(path: str, data: Dataset, model: Model, train: DataFrame) -> None:
    """What the model was shown; models without a prompt get the task's own."""
    prompt = getattr(model, "prompt", None) or Prompt(data.task)
    demos = getattr(model, "demos", None)
    if demos is None:
        demos = demo_ops.from_prompt(train.sparkSession, prompt)
    sinks.write_prompt_report(report.prompt_report(prompt, demos, train), path, report.HEADINGS)


def load_model(data: Dataset, store: RunStore, model_name: str, version: int | str | None = None,
               **overrides) -> tuple[Model, dict]:
    """The model of a registered version, as it was configured when registered.

    ``overrides`` supplies what a table cannot hold, such as ``build``.
    """
    entry = store.resolve(model_name, version)
    config = entry["config"]
    chosen = predictor(config["predictor"], **{**config["options"], **overrides})
    table = None
    if config["has_table"]:
        table = store.spark.read.parquet(f"{store.root}/artifacts/{entry['run_id']}/model")
    return chosen.restore(table, config["description"], data.task), entry


def evaluate(data: Dataset, store: RunStore, model_name: str = "classifier", version: int | str | None = None,
             split: str = "test", eval_size: int | None = None, *, project: str = "default",
             experiment: str = "evaluate", run_id: str | None = None, sample_size: int = SAMPLE_SIZE,
             **overrides) -> EvaluateResult:
    """Resolve a version, pick a split, cap, check, predict once, score and record; the source is read once."""
    if split not in EVALUATION_SPLITS:
        raise ValueError(f"'{split}' cannot be evaluated; there are {', '.join(EVALUATION_SPLITS)}")
    if split == "train_full":
        chosen_rows = first_n(data.population(split), eval_size)
        rows = chosen_rows.select("example_id", "symptoms", "diagnosis").withColumn("split", F.lit(split))
    else:
        rows = _capped_parts(data, {split: eval_size})
    rows = _checked(rows, data)
    model, entry = load_model(data, store, model_name, version, **overrides)
    config = entry["config"]
    scored, metrics = _predict_and_score(model, rows, (split,))
    run_id = store.start_run(
        project, experiment, config["predictor"], config["requires_training"], config["lm_model"], run_id
    )
    size = metrics[split]["num_examples"]
    params = {
        "model_name": model_name,
        "model_version": version or "latest",
        "split": split,
        "eval_size": size,
        **dataset_params(data.source, {split: size}),
    }
    _record(store, run_id, rows, scored, metrics, params, sample_size)
    return EvaluateResult(metrics[split]["accuracy"], size, split, run_id, scored, model_name)


def evaluate_best(data: Dataset, store: RunStore, model_names: list[str], split: str = "test",
                  eval_size: int | None = None, metric: str = "validation_accuracy",
                  **options) -> EvaluateResult:
    """Evaluate the model whose latest version has the highest metric; ties go to the first named."""
    best = max(model_names, key=lambda name: store.resolve(name)["metrics"][metric])
    return evaluate(data, store, best, split=split, eval_size=eval_size, **options)
