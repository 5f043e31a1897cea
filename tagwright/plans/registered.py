"""One query per operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright.functions.prompts import STYLES, Prompt
from tagwright.functions.text import normalize_label, strip, words
from tagwright.operators import (
    compare,
    demos,
    output,
    profile,
    propose,
    report,
    rows,
    search,
    split,
    states,
    validate,
)
from tagwright.operators.answers import AnswerStore, predict_distinct
from tagwright.operators.predict import Reply, carried, predict, predict_missing, predict_once
from tagwright.operators.predictors import available, nearest_by_candidate, predictor
from tagwright.operators.predictors import registered as own_predictor
from tagwright.operators.score import (
    accuracy,
    accuracy_by_split,
    checked,
    disagreement_count,
    disagreements,
    samples_by_split,
    score,
    score_rows,
)
from tagwright.plans import classify
from tagwright.plans.classify import evaluate, tune
from tagwright.session import new_folder, small_frame, write_once
from tagwright.sources import tables, tracking
from tagwright.sources.examples import Dataset, all_splits, hold_out, population, with_label, with_roles
from tagwright.sources.sinks import write_bucketed
from tagwright.spec import POPULATIONS, TaskSpec

Query = Callable[[SparkSession, str], DataFrame]

RUNS = ("majority", "nearest_demo", "words")
PARTS = ("train", "validation", "test")

_queries: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _queries[name] = fn
        return fn

    return add


def registered() -> dict[str, Query]:
    return dict(_queries)


# --- loading, splits, labels ------------------------------------------------


@query("load_examples")
def load_examples(spark, folder):
    return with_label(tables.language(spark, folder).examples)


@query("split_train")
def split_train(spark, folder):
    return tables.language(spark, folder).population("train")


@query("split_validation")
def split_validation(spark, folder):
    return tables.language(spark, folder).population("validation")


@query("split_test")
def split_test(spark, folder):
    return tables.language(spark, folder).population("test")


@query("all_splits")
def all_splits_stacked(spark, folder):
    data = tables.language(spark, folder)
    return all_splits(data.population("train_full"), data.population("test"))


@query("dataset_info")
def dataset_info_rows(spark, folder):
    info = tables.language(spark, folder).info()
    return info.withColumn("features", F.array_join("features", ","))


@query("split_hash")
def split_hash(spark, folder):
    full = tables.language(spark, folder).population("train_full")
    return split.mark_parts(full.select("example_id"), mode="hash")


@query("split_exact")
def split_exact(spark, folder):
    full = tables.language(spark, folder).population("train_full")
    return split.mark_parts(full.select("example_id"), mode="exact")


@query("list_rows")
def list_rows(spark, folder):
    return tables.language(spark, folder).list("train", 5)


@query("assign_ids")
def assign_ids(spark, folder):
    documents = tables.read(spark, folder, "documents")
    return rows.assign_ids(documents.select(F.col("text").alias("symptoms"), F.col("lang").alias("diagnosis")))


@query("trim_text")
def trim_text(spark, folder):
    documents = tables.read(spark, folder, "documents")
    padded = F.concat(F.lit("  \t"), F.col("text"), F.lit("\n\u3000\u00a0"))
    return documents.select(
        F.col("doc_id").alias("example_id"),
        F.length(padded).alias("padded_length"),
        strip(padded).alias("symptoms"),
    )


@query("normalize_label")
def normalize_label_rows(spark, folder):
    data = tables.verdict(spark, folder).examples
    raw = F.concat(F.lit(" "), F.upper("diagnosis"), F.lit("\t\n"))
    return data.select("example_id", raw.alias("raw_label"), normalize_label(raw).alias("label"))


@query("label_vocabulary")
def label_vocabulary(spark, folder):
    return report.label_vocabulary(tables.verdict(spark, folder).examples)


# --- checks and statistics --------------------------------------------------


@query("validation_report")
def validation_report(spark, folder):
    # Documents nobody reviewed have no label; one verdict is left undeclared.
    task = TaskSpec("review", ("clean", "low quality", "toxic"))
    return validate.validation_report(tables.verdicts(spark, folder, "left"), task, check_ids=True)


@query("validation_observed")
def validation_observed(spark, folder):
    """The counts of the report, taken along by a job that writes the rows."""
    task = TaskSpec("review", ("clean", "low quality", "toxic"))
    watched, seen = validate.observed(tables.verdicts(spark, folder, "left"), task)
    write_once(watched, "reviewed")
    counts = validate.observed_counts(seen)
    return small_frame(spark, [tuple(counts.values())], ", ".join(f"{name} long" for name in counts))


@query("rejected_rows")
def rejected_rows(spark, folder):
    task = TaskSpec("review", ("clean", "low quality", "toxic"))
    _, rejected = validate.partition_valid(tables.verdicts(spark, folder, "left"), task)
    return rejected.select("example_id", "problem")


@query("invalid_labels")
def invalid_labels(spark, folder):
    task = TaskSpec("review", ("clean", "low quality", "toxic"))
    return validate.invalid_labels(tables.verdict(spark, folder).examples, task).select("example_id", "diagnosis")


@query("vocab_coverage")
def vocab_coverage(spark, folder):
    return validate.vocab_coverage(tables.language(spark, folder).examples, TaskSpec("lang", ("en", "fr", "it")))


@query("row_conservation")
def row_conservation(spark, folder):
    return validate.row_conservation(tables.language(spark, folder).examples)


@query("profile_table")
def profile_table(spark, folder):
    table = profile.profile_table(tables.language(spark, folder).examples)
    return table.withColumn("columns", F.array_join("columns", ","))


@query("profile_columns")
def profile_columns(spark, folder):
    return profile.profile_columns(tables.verdicts(spark, folder, "left").select("example_id", "symptoms", "diagnosis"))


@query("describe_numeric")
def describe_numeric(spark, folder):
    stats = profile.describe_numeric(tables.read(spark, folder, "documents").select("n_chars", "doc_id"))
    return stats.select(
        "column_name", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")]
    )


@query("describe_categorical")
def describe_categorical(spark, folder):
    return profile.describe_categorical(tables.verdict(spark, folder).examples)


@query("most_frequent")
def most_frequent(spark, folder):
    """Columns with few values, with many, and with as many as there are rows."""
    docs = tables.read(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    return profile.most_frequent(docs, ["lang", "source", "n_chars", "text"], "doc_id")


@query("profile_merged")
def profile_merged(spark, folder):
    """Documents profiled from states of their splits and languages, with estimates held against exact values."""
    docs = hold_out(tables.read(spark, folder, "documents"), key="doc_id")
    columns = ["text", "source", "n_chars"]
    parts = states.profile_states(docs, ["split", "lang"], columns)
    merged = states.described(states.merge_states(write_once(parts, "profile-states")))
    found = write_once(merged, "merged-profile")
    exact = profile.profile_columns(docs, columns).select("column_name", F.col("unique_count").alias("exact"))
    at = found.filter(F.col("column_name") == "n_chars").first()
    ranks = docs.agg(
        *[
            ((F.avg((F.col("n_chars") < at[f"q{q}"]).cast("int")) <= q / 100 + states.RANK_ERROR)
             & (F.avg((F.col("n_chars") <= at[f"q{q}"]).cast("int")) >= q / 100 - states.RANK_ERROR)).alias(f"near{q}")
            for q in (25, 50, 75)
        ]
    ).select(F.expr("near25 AND near50 AND near75")).first()[0]
    off = F.abs(F.col("unique_count") - F.col("exact"))
    return found.join(exact, "column_name").select(
        "column_name", "rows", "count", "null_count", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")],
        (off <= states.DISTINCT_ERROR * F.col("exact")).alias("unique_near"),
        F.when(F.col("mean").isNotNull(), F.lit(ranks)).alias("quartiles_near"),
    )


# --- prompts and answers ----------------------------------------------------


@query("render_prompt")
def render_prompt(spark, folder):
    # A second task words its texts in its own way; own instructions replace the usual ones.
    origin = TaskSpec("origin", ("europe", "overseas"), "origin guessing", input_label="Entry", label_noun="origin")
    prompts = [Prompt(tables.LANGUAGE_TASK, style) for style in STYLES] + [Prompt(origin, instructions="Guess.")]
    return report.render_prompt(tables.language(spark, folder).examples, prompts)


@query("parse_output")
def parse_output(spark, folder):
    data = tables.verdict(spark, folder).examples
    plain = data.select("example_id", F.concat(F.lit(" "), F.initcap("diagnosis"), F.lit(" \n")).alias("raw_output"))
    reply = F.to_json(F.struct(F.concat(F.lit(" "), "diagnosis").alias("diagnosis"), F.col("split").alias("reasoning")))
    typed = data.select("example_id", reply.alias("raw_output"))
    read = output.parse_output(plain, "answer_only").withColumn("reasoning", F.lit(None).cast("string"))
    return read.withColumn("style", F.lit("answer_only")).unionByName(
        output.parse_output(typed, "reasoned").withColumn("style", F.lit("reasoned"))
    )


def _numbered_answers(spark, folder):
    """Verdicts as a careless model might give them: numbered when toxic."""
    number = F.when(F.col("diagnosis").contains("toxic"), F.concat(F.lit("1. "), "diagnosis"))
    return tables.verdict(spark, folder).examples.select(
        "example_id", F.coalesce(number, F.concat(F.upper("diagnosis"), F.lit(" "))).alias("predicted")
    )


@query("flag_invalid_output")
def flag_invalid_output(spark, folder):
    return validate.flag_invalid_output(_numbered_answers(spark, folder), tables.VERDICT_TASK)


@query("score_rows")
def score_rows_joined(spark, folder):
    data = tables.verdict(spark, folder).examples
    # Answers for the test rows only: the others count as wrong.
    answers = _numbered_answers(spark, folder).join(
        data.filter(F.col("split") == "test").select("example_id"), "example_id", "left_semi"
    )
    return score_rows(data, answers)


@query("score_bucketed")
def score_bucketed(spark, folder):
    """Answers scored against examples that are both bucketed by id: the join shuffles nothing."""
    data = tables.verdict(spark, folder).examples
    answers = _numbered_answers(spark, folder).join(
        data.filter(F.col("split") == "test").select("example_id"), "example_id", "left_semi"
    )
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sides = []
    for name, side in (("bucketed_examples", data), ("bucketed_answers", answers)):
        path = new_folder(spark, name)
        sides.append(write_bucketed(side, f"{name}_{path[-12:]}", path, buckets))
    return score_rows(*sides)


# --- predictors and their scores --------------------------------------------


def _scored(spark, folder, name="words", **options):
    """Every reviewed document, by part, scored under one predictor."""
    data = tables.verdict(spark, folder)
    model = predictor(name, **options).fit(data.population("train"), data.task)
    return data, score(model.predict(data.parts()))


def _scored_runs(spark, folder):
    data = tables.verdict(spark, folder)
    # Joined and stripped once; the three predictors fit and predict from what is written.
    data = replace(data, examples=write_once(data.examples, "examples"))
    train, parts = data.population("train"), data.parts()
    runs = [
        score(predictor(name).fit(train, data.task).predict(parts)).withColumn("run_id", F.lit(name)) for name in RUNS
    ]
    return reduce(DataFrame.unionByName, runs)


def _run_metrics(spark, folder):
    return write_once(tracking.metrics_long(_scored_runs(spark, folder)), "run-metrics")


@query("majority_rows")
def majority_rows(spark, folder):
    return _scored(spark, folder, "majority")[1]


@query("nearest_demo_rows")
def nearest_demo_rows(spark, folder):
    return _scored(spark, folder, "nearest_demo")[1]


@query("words_rows")
def words_rows(spark, folder):
    return _scored(spark, folder, "words")[1]


@query("words_rows_by_key")
def words_rows_by_key(spark, folder):
    # As if the weights were too large to broadcast: only frequent words are.
    return _scored(spark, folder, "words", broadcast_bytes=0)[1]


@query("accuracy")
def accuracy_total(spark, folder):
    return checked(accuracy(_scored(spark, folder)[1]))


@query("accuracy_by_split")
def accuracy_per_part(spark, folder):
    return accuracy_by_split(_scored(spark, folder)[1])


@query("disagreement_count")
def disagreements_per_part(spark, folder):
    return disagreement_count(_scored(spark, folder)[1])


@query("disagreements")
def disagreement_rows(spark, folder):
    data, scored = _scored(spark, folder)
    return disagreements(scored, data.examples)


@query("prediction_sample")
def prediction_sample(spark, folder):
    data, scored = _scored(spark, folder)
    return samples_by_split(write_once(scored, "scored"), data.examples, PARTS, 10)


def _cue_model(model):
    """A deterministic stand-in for a model call: cue words name the language."""
    cues = ((" les ", "fr"), (" der ", "de"), (" los ", "es"), (" the ", "en"))

    def complete(system, messages):
        replies = []
        for message in messages:
            if message.endswith("Must be one of: de, en, es, fr"):
                found = " EN"
            else:
                found = next((label for cue, label in cues if cue in message), "unknown")
            replies.append(Reply(found, prompt_tokens=len(message), completion_tokens=len(found)))
        return replies

    return complete


def _cue_predictions(spark, folder, max_retries):
    data = tables.language(spark, folder)
    chosen = predictor("callable", build=_cue_model, max_retries=max_retries)
    return chosen.fit(data.population("train"), data.task).predict(data.parts()).drop("error")


@query("predict_callable")
def predict_callable(spark, folder):
    return _cue_predictions(spark, folder, 0).drop("reasoning")


@query("predict_distinct")
def predict_once_per_text(spark, folder):
    """Two runs over one store: the second finds what the first has asked about half of the rows."""
    data = tables.language(spark, folder)
    store = AnswerStore(spark, new_folder(spark, "answers"))
    half = data.parts().filter(F.col("example_id") % 2 == 0)
    predict_distinct(half, lambda: _cue_model(None), Prompt(data.task), store)
    done = predict_distinct(data.parts(), lambda: _cue_model(None), Prompt(data.task), store)
    return done.drop("error", "reasoning")


@query("predict_in_flight")
def predict_in_flight(spark, folder):
    """The model call with several batches of a task out at a time."""
    data = tables.language(spark, folder)
    done = predict(data.parts(), lambda: _cue_model(None), Prompt(data.task), max_retries=1, batch_size=64, in_flight=4)
    return done.drop("error", "reasoning")


@query("predict_with_retry")
def predict_with_retry(spark, folder):
    return _cue_predictions(spark, folder, 1).drop("reasoning")


@query("token_usage")
def token_usage(spark, folder):
    used = _cue_predictions(spark, folder, 1).withColumn("run_id", F.lit("cues"))
    return output.token_usage(used)


# --- tuning -----------------------------------------------------------------


@query("labeled_demos")
def labeled_demos(spark, folder):
    return demos.labeled_demos(tables.verdict(spark, folder).population("train"))


@query("bootstrap_demos")
def bootstrap_demos(spark, folder):
    data = tables.verdict(spark, folder)
    train = data.population("train")
    teacher = predictor("nearest_demo").fit(train, data.task)
    return demos.demo_set(train, teacher.predict)


@query("minibatch_sample")
def minibatch_sample(spark, folder):
    plan = search.budget("light")
    pool = rows.sample_n(tables.verdict(spark, folder).population("validation"), plan.pool_rows, "pool:42")
    pool = write_once(pool.select("example_id"), "pool")
    batches = [search.minibatch_sample(pool, plan.minibatch, r) for r in range(1, plan.n_rounds + 1)]
    return reduce(DataFrame.unionByName, batches)


def _candidates(spark, folder):
    data = tables.verdict(spark, folder)
    plan = search.budget("light")
    sets = write_once(demos.demo_sets(data.population("train"), plan.candidates), "demo-sets")

    def run(frame, chosen):
        return nearest_by_candidate(frame, sets.filter(F.col("demo_set_id").isin(chosen)))

    return data, plan, run


@query("candidate_scores")
def candidate_scores(spark, folder):
    data, plan, run = _candidates(spark, folder)
    validation = data.population("validation")
    return search.candidate_scores(score(run(validation, list(range(1, plan.candidates + 1)))))


@query("best_candidate")
def best_candidate(spark, folder):
    data, plan, run = _candidates(spark, folder)
    candidates = list(range(1, plan.candidates + 1))
    table = search.search(data.population("validation"), candidates, run, plan)
    return search.best_candidate(table, "full_accuracy")


#: Shortest words that count for each stand-in of an instruction, and demonstration sets of the proposing search.
WORD_LENGTHS = (1, 4, 7)
PROPOSED_SETS = 4
PROPOSALS = search.Budget(candidates=8, pool_rows=100, minibatch=35, full_every=2)


def _proposing(spark, folder):
    """Rows under some candidates: nearest demonstrations by words of a candidate's length and up."""
    data = tables.verdict(spark, folder)
    space = {c.candidate_id: c for c in propose.grid(len(WORD_LENGTHS), PROPOSED_SETS)}
    sets = write_once(demos.demo_sets(data.population("train"), PROPOSED_SETS), "demo-sets")

    def long_words(frame, length):
        kept = F.filter(words(F.col("symptoms")), lambda w: F.length(w) >= length)
        return frame.withColumn("symptoms", F.array_join(kept, " "))

    def run(frame, ids):
        done = []
        for i, length in enumerate(WORD_LENGTHS, 1):
            chosen = {space[c].demo_set: c for c in ids if space[c].instruction == i}
            if chosen:
                mine = sets.filter(F.col("demo_set_id").isin(list(chosen)))
                found = nearest_by_candidate(long_words(frame, length), long_words(mine, length))
                first = (i - 1) * PROPOSED_SETS
                done.append(found.withColumn("candidate_id", (F.col("candidate_id") + first).cast("int")))
        return reduce(DataFrame.unionByName, done)

    return data, list(space.values()), run


@query("search_proposed")
def search_proposed(spark, folder):
    """Every round's candidates with their scores, and which one wins."""
    data, space, run = _proposing(spark, folder)
    rounds, trials = propose.search_proposed(data.population("validation"), space, run, PROPOSALS)
    best = search.best_candidate(trials, "full_accuracy").first()["candidate_id"]
    return rounds.select(
        "round", "candidate_id", "kind", "correct", "num_examples", F.round("expected", 6).alias("expected"),
        (F.col("candidate_id") == best).alias("winner"),
    )


@query("prompt_report")
def prompt_report(spark, folder):
    data = tables.verdict(spark, folder)
    train = data.population("train")
    shown = demos.labeled_demos(train, 7)
    return report.prompt_report(Prompt(data.task, "reasoned"), shown, train)


def _store(spark):
    return tracking.RunStore(spark, new_folder(spark, "store"))


@query("tune_metrics")
def tune_metrics(spark, folder):
    store = _store(spark)
    result = tune(tables.verdict(spark, folder), predictor("words"), store, run_id="tune", aliases=["best"])
    logged = store.latest_metrics().filter(F.col("run_id") == result.run_id)

    def value(part, metric):
        return F.max(F.when((F.col("split") == part) & (F.col("metric") == metric), F.col("value")))

    return logged.agg(
        value("train", "accuracy").alias("train_accuracy"),
        value("validation", "accuracy").alias("validation_accuracy"),
        value("train", "num_examples").cast("long").alias("num_train_examples"),
        value("validation", "num_examples").cast("long").alias("num_val_examples"),
    )


@query("evaluate_metrics")
def evaluate_metrics(spark, folder):
    """Tune, then evaluate the registered version on the test split."""
    store = _store(spark)
    data = tables.verdict(spark, folder)
    tune(data, predictor("words"), store, run_id="tune", aliases=["best"])
    result = evaluate(data, store, version="best", run_id="evaluate")
    return accuracy_by_split(result.scored).withColumn("run_id", F.lit(result.run_id))


# --- tracking ---------------------------------------------------------------


def _run_table(spark, folder):
    """One row per run with its settings and the sizes of its parts."""
    part = F.col("split")
    sizes = tables.verdict(spark, folder).parts().agg(
        F.count_if(part == "train").alias("train_size"), F.count_if(part == "validation").alias("val_size")
    )
    runs = F.array(
        *[
            F.struct(F.lit(n).alias("run_id"), F.lit(predictor(n).requires_training).alias("requires_training"))
            for n in (*RUNS, "column")
        ]
    )
    return sizes.withColumn("run", F.explode(runs)).select(
        "run.*", F.concat(F.lit("local/"), "run.run_id").alias("lm_model"), "train_size", "val_size"
    )


@query("run_params_long")
def run_params_long(spark, folder):
    columns = ["requires_training", "lm_model", "train_size", "val_size"]
    return tracking.params_long(_run_table(spark, folder), columns)


@query("config_json")
def config_json(spark, folder):
    columns = ["run_id", "requires_training", "lm_model", "train_size"]
    return _run_table(spark, folder).select("run_id", tracking.config_json(columns).alias("config_json"))


@query("metrics_long")
def metrics_long(spark, folder):
    return tracking.metrics_long(_scored_runs(spark, folder))


@query("metrics_latest")
def metrics_latest(spark, folder):
    return tracking.metrics_latest(tables.run_log(spark, folder))


@query("next_model_version")
def next_model_version(spark, folder):
    return tracking.next_model_version(tables.model_names(spark, folder), tables.version_log(spark, folder))


@query("latest_model_version")
def latest_model_version(spark, folder):
    return tracking.latest_model_version(tables.version_log(spark, folder))


@query("alias_resolve")
def alias_resolve(spark, folder):
    return tracking.alias_resolve(tables.alias_log(spark, folder))


@query("runs_by_tag")
def runs_by_tag(spark, folder):
    runs = tracking.runs_by_tag(tables.tagged_runs(spark, folder), project="purchase", trainable="true")
    return runs.select("run_id", "experiment")


@query("run_provider")
def run_provider(spark, folder):
    return tracking.run_provider(tables.model_ids(spark, folder))


# --- comparing runs ---------------------------------------------------------


@query("compare_runs")
def compare_runs(spark, folder):
    return compare.compare_runs(_run_metrics(spark, folder))


@query("metric_diff")
def metric_diff(spark, folder):
    return compare.metric_diff(_run_metrics(spark, folder), "majority", "words")


@query("winner")
def winner(spark, folder):
    return compare.winner(_run_metrics(spark, folder), "nearest_demo", "words")


@query("best_run")
def best_run(spark, folder):
    return compare.best_run(_run_metrics(spark, folder))


@query("evaluate_best")
def evaluate_best(spark, folder):
    """Of three tuned models the best on validation rows, on the first ten test rows."""
    store, data = _store(spark), tables.verdict(spark, folder)
    for name in RUNS:
        tune(data, predictor(name), store, model_name=name, run_id=name)
    result = classify.evaluate_best(data, store, list(RUNS), eval_size=10)
    return checked(accuracy(result.scored)).withColumn("run_id", F.lit(result.model_name))


# --- tables that the pipelines write -----------------------------------------


def _tracked(spark, folder):
    """A run that logged something else before it was tuned, and was resumed to be evaluated."""
    store, data = _store(spark), tables.verdict(spark, folder)
    store.log_metrics("majority", [("validation", "accuracy", 1.0), ("train", "accuracy", 1.0)])
    tune(data, predictor("majority"), store, model_name="m", run_id="majority", aliases=["best"])
    evaluate(data, store, "m", "best", run_id="majority")
    return store


@query("store_params")
def store_params(spark, folder):
    return _tracked(spark, folder).table("run_params").select("run_id", "key", "value")


@query("store_metrics")
def store_metrics(spark, folder):
    return _tracked(spark, folder).latest_metrics()


@query("store_versions")
def store_versions(spark, folder):
    store = _tracked(spark, folder)
    resolved = store.resolve("m", "best")["version"]
    return store.table("model_versions").select(
        "name",
        "version",
        "run_id",
        F.col("metrics")["train_accuracy"].alias("train_accuracy"),
        F.col("metrics")["validation_accuracy"].alias("validation_accuracy"),
        F.get_json_object("config_json", "$.predictor").alias("predictor"),
        F.lit(resolved).cast("long").alias("alias_version"),
    )


@query("compare_logged_runs")
def compare_logged_runs(spark, folder):
    store = _tracked(spark, folder)
    return compare.compare_runs(store.table("run_metrics"), runs=store.table("runs"))


@query("best_logged_run")
def best_logged_run(spark, folder):
    return compare.best_run(_tracked(spark, folder).table("run_metrics"), order=["other", "majority"])


@query("run_tokens")
def run_tokens(spark, folder):
    store = _store(spark)
    tune(tables.language(spark, folder), predictor("callable", build=_cue_model), store, run_id="cues")
    used = ("prompt_tokens", "completion_tokens", "errors")
    return store.latest_metrics().filter(F.col("metric").isin(*used)).select("split", "metric", "value")


# --- ids, caps and splits that are out of the ordinary --------------------------


@query("repeated_ids")
def repeated_ids(spark, folder):
    events = tables.read(spark, folder, "events")
    # One user in five has no id.
    return validate.id_problems(events.select(F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("example_id")))


def _line_keys(spark, folder):
    """Line items by a string key that is null for some."""
    line = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return tables.read(spark, folder, "lineitem").select(F.when(F.col("l_orderkey") % 7 != 0, line).alias("example_id"))


@query("first_n_large")
def first_n_large(spark, folder):
    return rows.first_n(_line_keys(spark, folder), rows.SMALL + 1)


@query("sample_large")
def sample_large(spark, folder):
    return rows.sample_n(_line_keys(spark, folder), rows.SMALL + 2_000, "large")


@query("parts_with_other_split")
def parts_with_other_split(spark, folder):
    examples = tables.verdict(spark, folder).examples
    other = F.when(F.col("example_id") % 7 == 0, "dev").when(F.col("example_id") % 7 == 1, "validation")
    mixed = examples.withColumn("split", F.coalesce(other, "split"))
    return Dataset(mixed, tables.VERDICT_TASK).parts().select("example_id", "split")


@query("population_sizes")
def population_sizes(spark, folder):
    """Rows of each population by name; a name that there is not is refused."""
    examples = tables.language(spark, folder).examples
    found = []
    for name in (*POPULATIONS, "holdout"):
        try:
            counted = population(examples, name).agg(F.count(F.lit(1)).alias("num_rows"))
            found.append(counted.select(F.lit(name).alias("name"), F.lit(True).alias("known"), "num_rows"))
        except ValueError:
            found.append(examples.limit(0).agg(F.lit(name).alias("name"), F.lit(False).alias("known"), F.count(F.lit(1)).alias("num_rows")))
    return reduce(DataFrame.unionByName, found)


@query("with_roles")
def roles(spark, folder):
    return with_roles(tables.language(spark, folder).examples).select(
        "example_id", F.col("inputs.symptoms").alias("input_text"), "label"
    )


# --- a user's own predictor, metric, validator and failing calls ------------------


@dataclass(frozen=True)
class LengthPredictor:
    """Calls short texts of low quality; stands for a predictor that a user registers."""

    name: ClassVar[str] = "by_length"
    requires_training: ClassVar[bool] = False
    shortest: int = 200

    def options(self):
        return {"shortest": self.shortest}

    def fit(self, train, task, validation=None):
        return self

    def restore(self, table, description, task):
        return self

    def artifact(self):
        return None, {}

    def predict(self, rows, keep_text=False):
        label = F.when(F.length("symptoms") < self.shortest, "low quality").otherwise("clean")
        answered = carried(rows.withColumn("predicted", label))
        return answered if keep_text else answered.drop("symptoms")


@query("registered_predictor")
def registered_predictor(spark, folder):
    with own_predictor(LengthPredictor):
        if "by_length" not in available():
            raise LookupError("the predictor is not registered")
        return _scored(spark, folder, "by_length", shortest=500)[1]


@query("own_metric")
def own_metric(spark, folder):
    """Half a point for an answer that shares the first word with the label."""
    data = tables.verdict(spark, folder)

    def partial(actual, predicted):
        first = F.substring_index(actual, " ", 1) == F.substring_index(predicted, " ", 1)
        return F.when(actual == predicted, 1.0).when(first, 0.5).otherwise(0.0)

    with own_predictor(LengthPredictor):
        answers = predictor("by_length", shortest=500).predict(data.parts())
    return score(answers, partial).groupBy("split").agg(F.sum("correct").alias("points"))


@query("own_validator")
def own_validator(spark, folder):
    answers = _numbered_answers(spark, folder)
    flagged = validate.flag_invalid_output(
        answers, tables.VERDICT_TASK, validator=lambda answer: ~F.startswith(answer, F.lit("1. "))
    )
    return flagged.select("example_id", "valid")


@query("predict_with_validator")
def predict_with_validator(spark, folder):
    """Retries until the user's validator is content, whatever the vocabulary says."""
    data = tables.language(spark, folder)
    chosen = predictor("callable", build=_cue_model, max_retries=1, validator=lambda label: label in ("fr", "EN"))
    done = chosen.fit(data.population("train"), data.task).predict(data.parts())
    return done.select("example_id", "predicted", "attempts", "valid")


def _fragile_model(failing):
    """The cue-word model, out of order for messages with a certain word."""

    def build():
        inner = _cue_model(None)

        def complete(system, messages):
            if any(failing in m for m in messages):
                raise ConnectionError("no answer")
            return inner(system, messages)

        return complete

    return build


def _fragile_predictions(spark, folder, failing):
    data = tables.language(spark, folder)
    return predict(data.parts(), _fragile_model(failing), Prompt(data.task))


@query("predict_with_errors")
def predict_with_errors(spark, folder):
    done = _fragile_predictions(spark, folder, " der ")
    return score(done).select("example_id", "predicted", "valid", "attempts", "error", "correct")


@query("predict_resumed")
def predict_resumed(spark, folder):
    """What failed is asked again; what was answered is kept."""
    data = tables.language(spark, folder)
    done = predict_once(_fragile_predictions(spark, folder, " der "))
    again = predict_missing(data.parts(), done, lambda rows: predict(rows, lambda: _cue_model(None), Prompt(data.task)))
    return again.select("example_id", "predicted", "valid", "error")
