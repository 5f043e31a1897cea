"""Predictors by name.

A predictor is fitted on training rows and yields a model; ``model.predict``
maps example rows to prediction rows.  ``callable`` wraps a user's model call;
the others run inside Spark without any service.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, fields, replace
from typing import Any, ClassVar, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.functions.prompts import Demo, Prompt
from tagwright.functions.text import normalize_label, words
from tagwright.operators import demos as demo_ops
from tagwright.operators import predict as prediction
from tagwright.operators import propose, search
from tagwright.operators.answers import AnswerStore, predict_distinct
from tagwright.operators.predict import carried
from tagwright.session import small_frame, write_once
from tagwright.spec import ModelOptions, TaskSpec

_registry: dict[str, type] = {}


class Model(Protocol):
    def predict(self, rows: DataFrame, keep_text: bool = False) -> DataFrame:
        """Prediction rows; the text comes along if asked for and still at hand."""

    def artifact(self) -> tuple[DataFrame | None, dict]:
        """A table and a small description from which the model can be restored."""


class Predictor(Protocol):
    name: ClassVar[str]

    @property
    def requires_training(self) -> bool: ...

    def fit(self, train: DataFrame, task: TaskSpec, validation: DataFrame | None = None) -> Model: ...

    def restore(self, table: DataFrame | None, description: dict, task: TaskSpec) -> Model: ...

    def options(self) -> dict[str, Any]: ...


def register(cls: type) -> type:
    """Class decorator: make a predictor available under its ``name``."""
    _registry[cls.name] = cls
    return cls


@contextmanager
def registered(cls: type) -> Iterator[type]:
    """Make a predictor available under its ``name`` inside a ``with`` block, and no longer."""
    before = _registry.get(cls.name)
    register(cls)
    try:
        yield cls
    finally:
        if before is None:
            del _registry[cls.name]
        else:
            _registry[cls.name] = before


def available() -> list[str]:
    return sorted(_registry)


def predictor_class(name: str) -> type:
    if name not in _registry:
        raise ValueError(f"unknown predictor '{name}'; available: {', '.join(available())}")
    return _registry[name]


def predictor(name: str, **options: Any) -> Predictor:
    """A predictor by name; options it does not know raise."""
    return predictor_class(name)(**options)


def _passed_on(rows: DataFrame, keep_text: bool) -> DataFrame:
    rows = carried(rows)
    return rows if keep_text else rows.drop("symptoms")


# --- an existing column -----------------------------------------------------


@register
@dataclass(frozen=True)
class ColumnPredictor:
    """The prediction is already in the table."""

    name: ClassVar[str] = "column"
    requires_training: ClassVar[bool] = False
    column: str = "prediction"

    def options(self) -> dict[str, Any]:
        return {"column": self.column}

    def fit(self, train: DataFrame, task: TaskSpec, validation: DataFrame | None = None) -> ColumnPredictor:
        return self

    def restore(self, table: DataFrame | None, description: dict, task: TaskSpec) -> ColumnPredictor:
        return self

    def artifact(self) -> tuple[DataFrame | None, dict]:
        return None, {}

    def predict(self, rows: DataFrame, keep_text: bool = False) -> DataFrame:
        return _passed_on(rows.withColumn("predicted", F.col(self.column)), keep_text).drop(self.column)


# --- most frequent label ----------------------------------------------------


@register
@dataclass(frozen=True)
class MajorityPredictor:
    """Always the most frequent training label; ties go to the first by name."""

    name: ClassVar[str] = "majority"
    requires_training: ClassVar[bool] = True

    def options(self) -> dict[str, Any]:
        return {}

    def fit(self, train: DataFrame, task: TaskSpec, validation: DataFrame | None = None) -> MajorityModel:
        # Combined per task, then one row per label.
        counts = train.groupBy(normalize_label(F.col("diagnosis")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
        return MajorityModel(counts.agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("predicted")))


    def restore(self, table: DataFrame | None, description: dict, task: TaskSpec) -> MajorityModel:
        return MajorityModel(table)


@dataclass(frozen=True)
class MajorityModel:
    """``label`` is a table of one value."""

    label: DataFrame

    def predict(self, rows: DataFrame, keep_text: bool = False) -> DataFrame:
        return _passed_on(rows, keep_text).withColumn("predicted", self.label.scalar())

    def artifact(self) -> tuple[DataFrame | None, dict]:
        return self.label, {}


# --- naive Bayes over words -------------------------------------------------

# Log weights are kept as whole millionths, so sums do not depend on the order
# of addition and a prediction is the same on any number of executors.
SCALE = 1_000_000

# A weight table up to this many bytes is broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024

# Words holding at least this share of all occurrences; there can be no more
# than its reciprocal of them, so their weights always fit a broadcast.  Runs of
# letters longer than any word are left to the join.
HOT_SHARE = 0.001
HOT_BYTES = 1024


def _millionths(value: Column) -> Column:
    return F.round(value * SCALE).cast("long")


# Labels whose counts stand side by side in one row; a word has a row for each block of labels it occurs with.
BLOCK = 64


def _frequent(found: DataFrame) -> DataFrame:
    """Words with at least ``HOT_SHARE`` of all occurrences; counted per task before the shuffle."""
    counts = found.filter(F.col("word").isNotNull()).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = write_once(counts, "scored-words")
    return counts.filter(F.col("n") >= HOT_SHARE * counts.agg(F.sum("n")).scalar()).select("word")


@register
@dataclass(frozen=True)
class WordsPredictor:
    """Multinomial naive Bayes with add-one smoothing over the words of a text."""

    name: ClassVar[str] = "words"
    requires_training: ClassVar[bool] = True
    broadcast_bytes: int = BROADCAST_BYTES

    def options(self) -> dict[str, Any]:
        return {"broadcast_bytes": self.broadcast_bytes}

    def fit(self, train: DataFrame, task: TaskSpec, validation: DataFrame | None = None) -> WordsModel:
        labels = task.ordered
        # The label becomes a number once per row, before its words are unfolded.
        numbers = F.create_map(*[F.lit(x) for i, name in enumerate(labels) for x in (name, i)])
        place = F.try_element_at(numbers, normalize_label(F.col("diagnosis")))
        # A null word per row counts the rows of each label along with its words.
        marked = F.concat(F.coalesce(words(F.col("symptoms")), F.array()), F.array(F.lit(None).cast("string")))
        occurrences = train.select(place.alias("place"), F.explode(marked).alias("word"))
        # A word of an unlabelled row still belongs to the vocabulary.
        block = F.floor(F.coalesce("place", F.lit(0)) / BLOCK).cast("int").alias("block")
        within = F.col("place") % BLOCK
        # One shuffle on word and block, combined per task first.
        counts = occurrences.groupBy("word", block).agg(
            *[F.count_if(within == i).alias(f"n{i}") for i in range(min(BLOCK, len(labels)))]
        )
        return WordsModel.build(write_once(counts, "word-counts"), labels, self.broadcast_bytes)

    def restore(self, table: DataFrame | None, description: dict, task: TaskSpec) -> WordsModel:
        return WordsModel(
            table,
            tuple(description["labels"]),
            tuple(description["priors"]),
            tuple(description["totals"]),
            description["size"],
            description["word_bytes"],
            description["entries"],
            self.broadcast_bytes,
        )


@dataclass(frozen=True)
class WordsModel:
    """Counts per word and block of labels (a table; rows per label under the null word), and one number per label.

    A word that a label never had weighs the same in that label whatever the word is.
    So a row needs this weight, times its words that are known at all, and the
    difference that the label's own words make: only what occurred is joined.
    """

    counts: DataFrame
    labels: tuple[str, ...]
    priors: tuple[int, ...]
    totals: tuple[int, ...]
    size: int
    word_bytes: int
    entries: int
    broadcast_bytes: int = BROADCAST_BYTES

    @property
    def width(self) -> int:
        return min(BLOCK, len(self.labels))

    @classmethod
    def build(cls, counts: DataFrame, labels, broadcast_bytes) -> WordsModel:
        width = min(BLOCK, len(labels))
        known = F.col("word").isNotNull()
        first = known & (F.col("block") == 0)
        sums = counts.groupBy("block").agg(
            *[F.sum(F.when(known, F.col(f"n{i}"))).alias(f"t{i}") for i in range(width)],
            *[F.sum(F.when(~known, F.col(f"n{i}"))).alias(f"r{i}") for i in range(width)],
            F.count_if(known).alias("entries"),
            F.coalesce(F.sum(F.when(known, F.octet_length("word"))), F.lit(0)).alias("word_bytes"),
        )
        # A row per block of labels.
        by_block = {row["block"]: row for row in sums.collect()}
        several = len(labels) > BLOCK
        size = counts.filter(known).select("word").distinct().count() if several else (by_block[0]["entries"] if 0 in by_block else 0)

        def of(name: str, place: int) -> int:
            row = by_block.get(place // BLOCK)
            return (row[f"{name}{place % BLOCK}"] or 0) if row else 0

        rows = [of("r", i) for i in range(len(labels))]
        table = small_frame(counts.sparkSession, list(enumerate(rows)), "place int, n long")
        priors = table.select("place", _millionths(F.log((F.col("n") + 1.0) / F.lit(sum(rows) + len(labels)))).alias("prior"))
        return cls(
            counts,
            tuple(labels),
            tuple(row["prior"] for row in sorted(priors.collect())),
            tuple(of("t", i) for i in range(len(labels))),
            size,
            sum(row["word_bytes"] for row in by_block.values()),
            sum(row["entries"] for row in by_block.values()),
            broadcast_bytes,
        )

    def _labels(self) -> dict[str, Column]:
        """By label: its prior, its number of words, and the weight of a word it never had; each one value for all rows."""
        spark = self.counts.sparkSession
        table = small_frame(spark, list(enumerate(self.totals)), "place int, total long")
        never = table.select("place", _millionths(F.log(F.lit(1.0) / (F.col("total") + F.lit(max(1, self.size))))).alias("never"))
        weights = [row["never"] for row in sorted(never.collect())]
        row = (list(self.priors), list(self.totals), weights)
        one = small_frame(spark, [row], "prior array<long>, total array<long>, never array<long>")
        return {name: one.select(name).scalar() for name in one.columns}

    def _weights(self, counts: DataFrame) -> DataFrame:
        """What each label's count of a word adds to the weight of a word it never had; a word's first row marks it known."""
        labels = self._labels()
        known = counts.filter(F.col("word").isNotNull()).select(
            "word", "block", *[f"n{i}" for i in range(self.width)], labels["total"].alias("total"), labels["never"].alias("never")
        )

        def more(i: int) -> Column:
            place = F.col("block") * BLOCK + i
            weight = _millionths(F.log((F.col(f"n{i}") + 1.0) / (F.get("total", place) + F.lit(self.size))))
            return F.when(F.col(f"n{i}") > 0, weight - F.get("never", place)).otherwise(0)

        return known.select("word", "block", *[more(i).alias(f"w{i}") for i in range(self.width)])

    def predict(self, rows: DataFrame, keep_text: bool = False) -> DataFrame:
        """Sum the weights of a row's words and take the best label.

        With a small weight table nothing but a row of sums per example and block of
        labels is shuffled.  Beyond that, only the words that are frequent in the training
        texts or in these rows (provably few) are broadcast, and the rest, none of
        which is frequent, is joined by word.
        The text is left behind: the sums are shuffled without it.
        """
        k = range(self.width)
        rows = carried(rows)
        keys = [c for c in rows.columns if c != "symptoms"]
        # Rows that share an id are told apart by their text; equal rows are counted by
        # one null word each, so that they come out as many as they went in.
        marked = F.concat(F.coalesce(words(F.col("symptoms")), F.array()), F.array(F.lit(None).cast("string")))
        found = rows.select(*keys, F.xxhash64("symptoms").alias("_text"), F.explode(marked).alias("word"))
        # Words outside the training text have no block and add nothing.
        counts = self._with_first_blocks()
        sums = [F.coalesce(F.sum(f"w{i}"), F.lit(0)).alias(f"w{i}") for i in k]
        if self.word_bytes + (self.entries + self.size) * (32 + 8 * self.width) <= self.broadcast_bytes:
            weighted = found.join(F.broadcast(self._weights(counts)), "word", "left")
        else:
            occurrences = sum((F.col(f"n{i}") for i in k), F.lit(0))
            trained = counts.filter(F.col("word").isNotNull()).groupBy("word").agg(F.sum(occurrences).alias("n"))
            trained = trained.filter(F.col("n") >= HOT_SHARE * sum(self.totals)).select("word")
            # Words of these rows that few or no training texts had are hot keys as well.
            hot_words = write_once(trained.unionByName(_frequent(found)).distinct(), "hot-words")
            hot_words = F.broadcast(hot_words.filter(F.octet_length("word") <= HOT_BYTES))
            hot = F.broadcast(self._weights(counts.join(hot_words, "word", "left_semi")))
            cold = self._weights(counts.join(hot_words, "word", "left_anti"))
            rare = found.join(hot_words, "word", "left_anti").join(cold, "word")
            weighted = found.join(hot, "word", "left").unionByName(rare)
        null_words = F.count_if(F.col("word").isNull())
        if len(self.labels) <= BLOCK:
            scored = weighted.groupBy(*keys, "_text").agg(
                *sums, F.count("block").alias("_known"), null_words.alias("_copies")
            ).withColumn("_sums", F.array(F.struct(F.lit(0).alias("block"), F.array(*[F.col(f"w{i}") for i in k]).alias("w"))))
        else:
            by_block = weighted.groupBy(*keys, "_text", "block").agg(*sums, F.count("block").alias("n"), null_words.alias("marks"))
            # A row per block of labels at most comes together, whatever the text's length.
            scored = by_block.groupBy(*keys, "_text").agg(
                F.sum(F.when(F.col("block") == 0, F.col("n")).otherwise(0)).alias("_known"),
                F.sum("marks").alias("_copies"),
                F.collect_list(F.when(F.col("block").isNotNull(), F.struct("block", F.array(*[F.col(f"w{i}") for i in k]).alias("w")))).alias("_sums"),
            )
        return self._answered(scored, keys)

    def _with_first_blocks(self) -> DataFrame:
        """The counts, with an empty first block for words that only labels of later blocks had: it marks them as known."""
        if len(self.labels) <= BLOCK:
            return self.counts
        known = self.counts.filter(F.col("word").isNotNull())
        without = known.groupBy("word").agg(F.min("block").alias("least")).filter("least > 0")
        empty = without.select("word", F.lit(0).alias("block"), *[F.lit(0).cast("long").alias(f"n{i}") for i in range(self.width)])
        return self.counts.unionByName(empty)

    def _answered(self, scored: DataFrame, keys: list[str]) -> DataFrame:
        """The best label of every row, as often as the row occurs; ties go to the first label.

        A label's own words never make it worse, so the best is among all labels
        without their words and the labels of the row's blocks with them.
        """
        labels = self._labels()
        # Counts and sums are of all copies of a row.
        each = F.expr("transform(_sums, x -> named_struct('block', x.block, 'w', transform(x.w, w -> w div _copies)))")
        scored = scored.select(
            *keys, "_copies", F.expr("_known div _copies").alias("_words"), each.alias("_sums"),
            labels["prior"].alias("_prior"), labels["never"].alias("_never"),
        )

        def judged(place: Column, own: Column) -> Column:
            plain = F.get("_prior", place) + F.get("_never", place) * F.col("_words")
            return F.struct((plain + own).alias("score"), (-place).alias("order"))

        def best(block: Column) -> Column:
            return F.array_max(F.transform(block["w"], lambda own, i: judged((block["block"] * BLOCK + i).cast("int"), own)))

        found = F.array_max(F.transform("_sums", best))
        if len(self.labels) > BLOCK:
            plain = F.array_max(F.transform("_prior", lambda _, i: judged(i, F.lit(0).cast("long"))))
            found = F.greatest(found, plain)
        scored = scored.select(*keys, "_copies", found.alias("_best"))
        names = F.array(*[F.lit(name) for name in self.labels])
        answer = F.get(names, -F.col("_best.order")).alias("predicted")
        copies = F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_copy")
        return scored.select(*keys, answer, copies).drop("_copy")

    def artifact(self) -> tuple[DataFrame | None, dict]:
        return self.counts, {
            "labels": self.labels,
            "priors": self.priors,
            "totals": self.totals,
            "size": self.size,
            "word_bytes": self.word_bytes,
            "entries": self.entries,
        }


# --- most similar demonstration ---------------------------------------------


def _word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def _nearest(mine: Column, demos: Column) -> Column:
    """Label of the demonstration with the largest word-set Jaccard similarity."""

    def similarity(d: Column) -> Column:
        common = F.size(F.array_intersect(mine, d["words"]))
        either = F.size(mine) + F.size(d["words"]) - common
        return F.when(either == 0, 0.0).otherwise(common / either)

    ranked = F.transform(
        demos,
        lambda d: F.struct(similarity(d).alias("similarity"), (-d["ord"]).alias("order"), d["label"].alias("label")),
    )
    return F.array_max(ranked).getField("label")


def _packed(demos: DataFrame) -> Column:
    return F.collect_list(
        F.struct("ord", _word_set(F.col("symptoms")).alias("words"), F.col("diagnosis").alias("label"))
    )


@register
@dataclass(frozen=True)
class NearestDemoPredictor:
    """The label of the most similar of a few demonstrations; first one wins ties."""

    name: ClassVar[str] = "nearest_demo"
    requires_training: ClassVar[bool] = True
    max_labeled: int = demo_ops.MAX_LABELED
    seed: int = 42

    def options(self) -> dict[str, Any]:
        return {"max_labeled": self.max_labeled, "seed": self.seed}

    def fit(self, train: DataFrame, task: TaskSpec, validation: DataFrame | None = None) -> NearestDemoModel:
        return NearestDemoModel(demo_ops.labeled_demos(train, self.max_labeled, self.seed))

    def restore(self, table: DataFrame | None, description: dict, task: TaskSpec) -> NearestDemoModel:
        return NearestDemoModel(table)


@dataclass(frozen=True)
class NearestDemoModel:
    """``demos`` has a handful of rows and reaches the tasks as one value."""

    demos: DataFrame

    def predict(self, rows: DataFrame, keep_text: bool = False) -> DataFrame:
        packed = self.demos.agg(_packed(self.demos)).scalar()
        nearest = _nearest(F.col("mine"), F.col("demos"))
        answered = (
            rows.withColumn("mine", _word_set(F.col("symptoms")))
            .withColumn("demos", packed)
            .withColumn("predicted", nearest)
            .drop("mine", "demos")
        )
        return _passed_on(answered, keep_text)

    def artifact(self) -> tuple[DataFrame | None, dict]:
        return self.demos, {}


def nearest_by_candidate(rows: DataFrame, demo_sets: DataFrame) -> DataFrame:
    """Every row under each candidate's demonstrations (``demo_set_id``).

    The few sets arrive as one value and are unfolded per row; the text itself
    is read once and not copied.
    """
    sets = demo_sets.groupBy(F.col("demo_set_id").alias("candidate_id")).agg(_packed(demo_sets).alias("demos"))
    packed = sets.agg(F.collect_list(F.struct("candidate_id", "demos"))).scalar()
    keys = [c for c in carried(rows).columns if c != "symptoms"]
    # Tried inside the row; only the answers are unfolded, not the row's words.  The outer form keeps
    # Spark from testing the size of the answers, and so computing them, once more in the scan.
    answers = F.transform(
        F.col("sets"),
        lambda c: F.struct(c["candidate_id"].alias("candidate_id"), _nearest(F.col("mine"), c["demos"]).alias("predicted")),
    )
    tried = carried(rows).select(*keys, _word_set(F.col("symptoms")).alias("mine"), packed.alias("sets"))
    return tried.select(*keys, answers.alias("answers")).select(*keys, F.inline_outer("answers"))


# --- a user's model call ----------------------------------------------------


OPTIMIZERS = ("bootstrap", "search", "propose")


@register
@dataclass(frozen=True)
class CallablePredictor:
    """A language model or any other call, one batch of rows at a time.

    ``build(model)`` is called once per task and returns the call.  Without an
    optimizer the prompt is fixed, with ``few_shot`` training rows as examples.
    ``validator`` says whether an answer will do, in place of the vocabulary.
    ``answers`` names a folder of answers by content: what is answered there is not
    asked again, and rows with one text are asked about once.
    ``bootstrap`` adds training rows the model gets right to labeled ones;
    ``search`` also tries instructions and demonstration sets on validation rows;
    ``propose`` tries those of all their combinations that the scores so far speak for.
    """

    name: ClassVar[str] = "callable"
    build: Any = None
    model: ModelOptions | None = None
    style: str = "answer_only"
    instructions: str | None = None
    max_retries: int = 1
    validator: Any = None
    few_shot: int = 0
    parallelism: int | None = None
    in_flight: int = 1
    batch_size: int = 256
    profile: Any = None
    answers: str | None = None
    optimizer: str | None = None
    max_bootstrapped: int = demo_ops.MAX_BOOTSTRAPPED
    max_labeled: int = demo_ops.MAX_LABELED
    candidate_instructions: tuple[str, ...] = ()
    auto: str | None = "light"
    num_candidates: int | None = None
    pool_rows: int | None = None
    minibatch: int = 35
    full_every: int = 5
    seed: int = 42

    def __post_init__(self) -> None:
        if self.optimizer not in (None, *OPTIMIZERS):
            raise ValueError(f"unknown optimizer '{self.optimizer}'; choose from {', '.join(OPTIMIZERS)}")
        for name in ("max_retries", "few_shot", "max_bootstrapped", "max_labeled"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if isinstance(self.model, dict):
            object.__setattr__(self, "model", ModelOptions(**self.model))
        object.__setattr__(self, "candidate_instructions", tuple(self.candidate_instructions))

    @property
    def requires_training(self) -> bool:
        return self.optimizer is not None

    def options(self) -> dict[str, Any]:
        # How and where calls are made does not change the answers.
        passed_over = ("build", "model", "validator", "parallelism", "in_flight", "batch_size", "profile", "answers")
        kept = {f.name: getattr(self, f.name) for f in fields(self) if f.name not in passed_over}
        return {**kept, "model": asdict(self.model) if self.model else None}

    def run(self, rows: DataFrame, prompt: Prompt | dict[int, Prompt], keep_text: bool = False) -> DataFrame:
        if self.build is None:
            raise ValueError("a callable predictor needs 'build', which returns the model call")
        build, model = self.build, self.model
        how = {
            "max_retries": self.max_retries,
            "validator": self.validator,
            "parallelism": self.parallelism,
            "in_flight": self.in_flight,
            "batch_size": self.batch_size,
            "profile": self.profile,
            "keep_text": keep_text,
        }
        if self.answers is None:
            return prediction.predict(rows, lambda: build(model), prompt, **how)
        kept = AnswerStore(rows.sparkSession, self.answers)
        return predict_distinct(rows, lambda: build(model), prompt, kept, model=asdict(model) if model else None, **how)

    def fit(self, train: DataFrame, task: TaskSpec, validation: DataFrame | None = None) -> CallableModel:
        base = Prompt(task, self.style, self.instructions)
        if self.optimizer is None:
            shown = demo_ops.labeled_demos(train, self.few_shot, self.seed) if self.few_shot else None
            return CallableModel(self, _showing(base, shown))
        shown = demo_ops.demo_set(
            train, lambda rows: self.run(rows, base), self.max_bootstrapped, self.max_labeled, self.seed
        )
        bootstrapped = _showing(base, shown)
        if self.optimizer == "bootstrap":
            return CallableModel(self, bootstrapped)
        if validation is None:
            raise ValueError("a search needs validation rows")
        plan = self.plan()
        if self.optimizer == "propose":
            return self._proposed(train, validation, base, bootstrapped, plan)
        prompts = self._candidates(train, base, bootstrapped, plan.candidates)
        trials = search.search(
            validation, list(prompts), lambda rows, ids: self.run(rows, {c: prompts[c] for c in ids}), plan, self.seed
        )
        best = search.best_candidate(trials, "full_accuracy").first()
        return CallableModel(self, prompts[best["candidate_id"]], trials)

    def _proposed(self, train: DataFrame, validation: DataFrame, base: Prompt, bootstrapped: Prompt,
                  plan: search.Budget) -> CallableModel:
        """The best of the proposed combinations of wording and demonstrations."""
        shown = {1: bootstrapped.demos}
        if plan.candidates > 1:
            for set_id, rows in self._demo_sets(train, plan.candidates - 1).items():
                shown[set_id + 1] = rows
        wordings = (base.instructions, *self.candidate_instructions)
        space = propose.grid(len(wordings), len(shown))
        prompts = {
            c.candidate_id: replace(base, instructions=wordings[c.instruction - 1], demos=shown[c.demo_set]) for c in space
        }
        rounds, trials = propose.search_proposed(
            validation, space, lambda rows, ids: self.run(rows, {c: prompts[c] for c in ids}), plan, seed=self.seed
        )
        best = search.best_candidate(trials, "full_accuracy").first()
        return CallableModel(self, prompts[best["candidate_id"]], rounds)

    def _demo_sets(self, train: DataFrame, n: int) -> dict[int, tuple[Demo, ...]]:
        """Seeded demonstration sets by number, each in order."""
        sets: dict[int, list] = {set_id: [] for set_id in range(1, n + 1)}
        for row in demo_ops.demo_sets(train, n, self.max_labeled, self.seed).collect():
            sets[row["demo_set_id"]].append(row)
        return {
            set_id: tuple(Demo(r["symptoms"], r["diagnosis"]) for r in sorted(rows, key=lambda r: r["ord"]))
            for set_id, rows in sets.items()
        }

    def plan(self) -> search.Budget:
        """The named budget with the sizes given here; without a name they must be given."""
        sizes = {"candidates": self.num_candidates, "pool_rows": self.pool_rows}
        given = {k: v for k, v in sizes.items() if v is not None}
        return search.budget(self.auto, minibatch=self.minibatch, full_every=self.full_every, **given)

    def _candidates(self, train: DataFrame, base: Prompt, bootstrapped: Prompt, n: int) -> dict[int, Prompt]:
        """The bootstrapped prompt, then instructions in turn with seeded demonstration sets."""
        prompts = {1: bootstrapped}
        if n == 1:
            return prompts
        wordings = (base.instructions, *self.candidate_instructions)
        for set_id, shown in self._demo_sets(train, n - 1).items():
            prompts[set_id + 1] = replace(base, instructions=wordings[set_id % len(wordings)], demos=shown)
        return prompts

    def restore(self, table: DataFrame | None, description: dict, task: TaskSpec) -> CallableModel:
        shown = tuple(Demo(**d) for d in description["demos"])
        return CallableModel(self, Prompt(task, self.style, description["instructions"], shown))


def _showing(prompt: Prompt, demos: DataFrame | None) -> Prompt:
    return replace(prompt, demos=demo_ops.as_prompt_demos(demos)) if demos is not None else prompt


@dataclass(frozen=True)
class CallableModel:
    settings: CallablePredictor
    prompt: Prompt
    trials: DataFrame | None = None

    def predict(self, rows: DataFrame, keep_text: bool = False) -> DataFrame:
        return self.settings.run(rows, self.prompt, keep_text)

    def artifact(self) -> tuple[DataFrame | None, dict]:
        return None, {"instructions": self.prompt.instructions, "demos": [asdict(d) for d in self.prompt.demos]}
