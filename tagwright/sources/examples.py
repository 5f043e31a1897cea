"""Reading labelled text and naming its populations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagwright.functions.text import hash_below, strip
from tagwright.operators import split as splitting
from tagwright.operators import validate
from tagwright.operators.profile import Summary, summary
from tagwright.operators.rows import assign_ids, list_rows
from tagwright.spec import ALIASES, POPULATIONS, RAW_TEST, RAW_TRAIN, TaskSpec

FORMATS = ("parquet", "json", "csv")


def canonical_columns(df: DataFrame) -> DataFrame:
    """Rename raw columns to domain columns; either name is accepted, not both."""
    both = [f"{raw} and {name}" for raw, name in ALIASES.items() if raw in df.columns and name in df.columns]
    if both:
        raise ValueError(f"ambiguous columns: {', '.join(both)}")
    df = df.withColumnsRenamed({raw: name for raw, name in ALIASES.items() if raw in df.columns})
    validate.check_columns(df)
    return df


def to_examples(df: DataFrame) -> DataFrame:
    """Rows as examples: domain names, stripped text, a stable id."""
    df = canonical_columns(df)
    if "example_id" not in df.columns:
        df = assign_ids(df)
    return df.withColumn("symptoms", strip(F.col("symptoms")))


def with_label(df: DataFrame) -> DataFrame:
    """The target once more under its customary name ``label``."""
    return df.withColumn("label", F.col("diagnosis"))


def with_roles(df: DataFrame) -> DataFrame:
    """Inputs gathered in a struct, apart from the target."""
    return df.select("example_id", F.struct("symptoms").alias("inputs"), F.col("diagnosis").alias("label"))


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType | str | None = None, multiline: bool = False) -> DataFrame:
    """Read files with a declared schema; Parquet may bring its own.

    CSV fields with line ends need ``multiline``, which makes each file one task.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format '{fmt}'; choose from {', '.join(FORMATS)}")
    if schema is None and fmt != "parquet":
        raise ValueError(f"reading {fmt} needs a schema; inferring one would scan the data twice")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=multiline, escape='"')
    return reader.load(path)


def load_examples(spark: SparkSession, path: str | dict[str, str], split: str | None = None,
                  fmt: str = "parquet", schema: T.StructType | str | None = None,
                  multiline: bool = False) -> DataFrame:
    """Examples of a split-keyed dataset, or of one of its populations.

    ``path`` is one table with a ``split`` column, best a Parquet table
    partitioned by it, or one path per raw split.
    """
    if isinstance(path, dict):
        parts = [
            read_table(spark, p, fmt, schema, multiline).withColumn("split", F.lit(name)) for name, p in path.items()
        ]
        raw = parts[0]
        for part in parts[1:]:
            raw = raw.unionByName(part)
    else:
        raw = read_table(spark, path, fmt, schema, multiline)
    if "split" not in raw.columns:
        raw = raw.withColumn("split", F.lit(RAW_TRAIN))
    examples = to_examples(raw)
    return examples if split is None else population(examples, split)


def population(examples: DataFrame, name: str = "all", ratio: float = splitting.TRAIN_RATIO,
               seed: int = splitting.SEED, mode: str = "hash") -> DataFrame:
    """Rows of a named population.

    ``all`` is the raw training and test rows, ``train`` and ``validation`` the
    two parts of the raw training rows, ``train_full`` both parts.
    """
    if name not in POPULATIONS:
        raise ValueError(f"no population is called '{name}'; there are {', '.join(POPULATIONS)}")
    if name == "all":
        return examples.filter(F.col("split").isin(RAW_TRAIN, RAW_TEST))
    if name == "test":
        test = examples.filter(F.col("split") == RAW_TEST)
        if test.select("example_id").limit(1).isEmpty():
            raise ValueError(f"the dataset has no '{RAW_TEST}' split")
        return test
    full = examples.filter(F.col("split") == RAW_TRAIN)
    if name == "train_full":
        return full
    train, validation = splitting.train_validation(full, ratio, seed, mode)
    return train if name == "train" else validation


def all_splits(*parts: DataFrame) -> DataFrame:
    """Splits stacked by column name; ids stay what they were."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked


def dataset_info(examples: DataFrame) -> DataFrame:
    """Rows and feature names per raw split."""
    features = [c for c in examples.columns if c not in ("example_id", "split")]
    return examples.groupBy("split").agg(F.count(F.lit(1)).alias("num_rows")).withColumn(
        "features", F.array(*[F.lit(c) for c in features])
    )


def hold_out(df: DataFrame, train_share: float = 0.8, salt: str = "raw", key: str = "example_id") -> DataFrame:
    """Give unsplit rows a raw split by the hash of their id."""
    train = hash_below(F.col(key), salt, train_share)
    return df.withColumn("split", F.when(train, RAW_TRAIN).otherwise(RAW_TEST))


@dataclass(frozen=True)
class Dataset:
    """Examples of one task and how their training rows are divided."""

    examples: DataFrame
    task: TaskSpec
    source: str = "table"
    ratio: float = splitting.TRAIN_RATIO
    seed: int = splitting.SEED
    mode: str = "hash"

    @cached_property
    def _in_train(self) -> Column:
        """Condition for the training part; an exact split looks for its cut-off once."""
        full = self.examples.filter(F.col("split") == RAW_TRAIN)
        return splitting.in_train(full, self.ratio, self.seed, self.mode)

    def population(self, name: str = "all") -> DataFrame:
        if name not in ("train", "validation"):
            return population(self.examples, name)
        full = self.examples.filter(F.col("split") == RAW_TRAIN)
        return full.filter(self._in_train if name == "train" else ~self._in_train)

    def parts(self) -> DataFrame:
        """The raw training and test rows, with ``split`` naming their part: train, validation or test.

        Rows of any other raw split belong to no population and are left out.
        """
        raw_test = F.col("split") == RAW_TEST
        part = F.when(raw_test, RAW_TEST).when(self._in_train, "train").otherwise("validation")
        return population(self.examples, "all").withColumn("split", part)

    def info(self) -> DataFrame:
        return dataset_info(self.examples).withColumn("dataset", F.lit(self.source))

    def list(self, split: str = "all", rows: int = 5) -> DataFrame:
        return list_rows(self.population(split), rows)

    def summary(self, split: str = "all", approximate: bool = False) -> Summary:
        return summary(self.population(split), approximate=approximate)

    def checked(self, check_ids: bool = False) -> Dataset:
        """The same dataset once all its rows are known to be valid."""
        validate.require_valid(self.examples, self.task, check_ids)
        return self
