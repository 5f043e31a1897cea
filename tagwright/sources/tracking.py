"""Runs, parameters, metrics, model versions and aliases as plain tables.

Every table is append-only; the current state is an aggregation over it, which
combines per task, so a run or model that owns most rows is no bottleneck.
Several writers may append and register at once: every append has a folder of its
own, and a version number is claimed by a file that only one writer can create.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagwright.functions.text import provider, strip_provider
from tagwright.session import path_exists, small_frame

SCHEMAS = {
    "runs": "run_id string, experiment string, tags map<string,string>, requires_training boolean, "
            "lm_model string, started_at timestamp",
    "run_params": "run_id string, key string, value string, logged_at timestamp",
    "run_metrics": "run_id string, split string, metric string, value double, logged_at timestamp",
    "model_versions": "name string, version long, run_id string, config_json string, "
                      "metrics map<string,double>, created_at timestamp",
    "model_aliases": "name string, alias string, version long, updated_at timestamp",
}


# --- operators on the tables ------------------------------------------------


def params_long(runs: DataFrame, columns: list[str]) -> DataFrame:
    """One row per run and parameter."""
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in columns])
    return runs.select("run_id", F.inline(pairs))


def metrics_long(scored: DataFrame) -> DataFrame:
    """Accuracy, example and disagreement counts per run and split, in long form."""
    wide = scored.groupBy("run_id", "split").agg(
        (F.sum("correct") / F.count(F.lit(1))).alias("accuracy"),
        F.count(F.lit(1)).cast("double").alias("num_examples"),
        F.count_if(F.col("correct") == 0).cast("double").alias("disagreements"),
    )
    names = ("accuracy", "num_examples", "disagreements")
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
    return wide.select("run_id", "split", F.inline(pairs))


def metrics_latest(metrics: DataFrame, order: Column | str = "logged_at") -> DataFrame:
    """The value last logged for each run, split and metric; runs may be resumed."""
    return metrics.groupBy("run_id", "split", "metric").agg(F.max_by("value", order).alias("value"))


def config_json(columns: list[str]) -> Column:
    """Columns as one JSON document."""
    return F.to_json(F.struct(*columns))


def latest_model_version(versions: DataFrame) -> DataFrame:
    """Highest version of each model, with its run."""
    return versions.groupBy("name").agg(
        F.max("version").alias("version"), F.max_by("run_id", "version").alias("run_id")
    )


def next_model_version(names: DataFrame, versions: DataFrame) -> DataFrame:
    """The number the next version of each name will get; 1 for a new name."""
    known = versions.groupBy("name").agg(F.max("version").alias("version"))
    return names.select("name").distinct().join(known, "name", "left").select(
        "name", (F.coalesce("version", F.lit(0)) + 1).alias("next_version")
    )


def alias_resolve(aliases: DataFrame, order: Column | str = "updated_at") -> DataFrame:
    """The version each alias was last set to."""
    return aliases.groupBy("name", "alias").agg(F.max_by("version", order).alias("version"))


def runs_by_tag(runs: DataFrame, **tags: str) -> DataFrame:
    """Runs whose tags have all the given values."""
    for key, value in tags.items():
        runs = runs.filter(F.col("tags")[key] == value)
    return runs


def run_provider(runs: DataFrame) -> DataFrame:
    """Provider and bare model name of each run's model id."""
    model = F.col("lm_model")
    return runs.select(
        "run_id", "lm_model", provider(model).alias("provider"), strip_provider(model).alias("model_name")
    )


# --- the tables on storage --------------------------------------------------


def dataset_params(source: str, sizes: dict[str, int]) -> dict:
    """Where the rows of each split came from and how many there were."""
    params: dict = {}
    for split, n in sizes.items():
        params[f"dataset_{split}_source"] = source
        params[f"dataset_{split}_size"] = n
    return params


class RunStore:
    """The tracking tables below one folder of shared storage."""

    def __init__(self, spark: SparkSession, root: str, system: str = "tagwright") -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.system = system

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str) -> DataFrame:
        """All rows ever appended; empty before the first one."""
        if not path_exists(self.spark, self.path(name)):
            return small_frame(self.spark, [], SCHEMAS[name])
        return self._reader(name).parquet(self.path(name))

    def _reader(self, name: str):
        return self.spark.read.schema(SCHEMAS[name]).option("recursiveFileLookup", "true")

    def append(self, name: str, rows: list[tuple]) -> None:
        """Add rows in a folder of their own, so that appends of several writers do not meet."""
        frame = small_frame(self.spark, rows, SCHEMAS[name])
        frame.coalesce(1).write.parquet(f"{self.path(name)}/part-{uuid.uuid4().hex}")

    def compact(self, name: str) -> int:
        """Bring the appends so far together in one; how many there were.

        What is appended meanwhile stays as it is.  For a moment rows are there twice,
        never not at all, and every reader takes the latest of equal rows.
        """
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return 0
        found = [s.getPath() for s in files.listStatus(folder) if not s.getPath().getName().startswith(("_", "."))]
        if len(found) < 2:
            return len(found)
        merged = f"part-{uuid.uuid4().hex}"
        # Hidden until it is whole; a folder becomes visible at once.
        hidden = f"{self.path(name)}/_{merged}"
        self._reader(name).parquet(*[p.toString() for p in found]).coalesce(1).write.parquet(hidden)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        if not files.rename(path(hidden), path(f"{self.path(name)}/{merged}")):
            raise OSError(f"{hidden} cannot be renamed")
        for old in found:
            files.delete(old, True)
        return len(found)

    def start_run(self, project: str, experiment: str, framework: str, requires_training: bool,
                  lm_model: str | None = None, run_id: str | None = None) -> str:
        """A new run, or the given one resumed."""
        run_id = run_id or uuid.uuid4().hex
        if self.table("runs").filter(F.col("run_id") == run_id).isEmpty():
            tags = {
                "system": self.system,
                "project": project,
                "framework": framework,
                "trainable": str(requires_training).lower(),
            }
            name = f"/{self.system}/{project}/{experiment}"
            self.append("runs", [(run_id, name, tags, requires_training, lm_model, _now())])
        return run_id

    def log_params(self, run_id: str, params: dict) -> None:
        now = _now()
        self.append("run_params", [(run_id, k, None if v is None else str(v), now) for k, v in params.items()])

    def log_metrics(self, run_id: str, values: list[tuple[str, str, float]]) -> None:
        """``(split, metric, value)`` triples of a run."""
        now = _now()
        self.append("run_metrics", [(run_id, s, m, float(v), now) for s, m, v in values])

    def latest_metrics(self) -> DataFrame:
        return metrics_latest(self.table("run_metrics"))

    def register(self, name: str, run_id: str, config: dict, metrics: dict[str, float], aliases=()) -> int:
        """The next version of a model; the name comes into being on first use."""
        named = small_frame(self.spark, [(name,)], "name string")
        mine = self.table("model_versions").filter(F.col("name") == name)
        version = self._claimed(name, next_model_version(named, mine).first()["next_version"])
        text = json.dumps(config, sort_keys=True)
        self.append("model_versions", [(name, version, run_id, text, metrics, _now())])
        for alias in aliases:
            self.set_alias(name, alias, version)
        return version

    def _claimed(self, name: str, version: int) -> int:
        """The first number from ``version`` on that no other writer has; it is this writer's from now on.

        A writer that ends between its claim and its row leaves its number unused.
        """
        folder = f"{self.root}/model_version_claims/{hashlib.sha256(name.encode()).hexdigest()}"
        while not self._created(f"{folder}/{version}"):
            version += 1
        return version

    def _created(self, path: str) -> bool:
        """Create an empty file; False if it is there, also when someone else creates it at this moment."""
        jvm = self.spark._jvm
        file = jvm.org.apache.hadoop.fs.Path(path)
        files = file.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(file.getParent())
        try:
            if files.getScheme() == "file":
                # Hadoop's own local file system looks first and creates then.
                local = jvm.java.io.File(file.toUri().getPath())
                return local.createNewFile()
            files.create(file, False).close()
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def set_alias(self, name: str, alias: str, version: int) -> None:
        """Point an alias at a version that exists; numbers and ``latest`` name versions themselves."""
        if not alias or alias == "latest" or alias.isdigit():
            raise ValueError(f"'{alias}' cannot be an alias")
        versions = self.table("model_versions")
        if versions.filter((F.col("name") == name) & (F.col("version") == version)).isEmpty():
            raise ValueError(f"model '{name}' has no version {version}")
        self.append("model_aliases", [(name, alias, version, _now())])

    def resolve(self, name: str, version: int | str | None = None) -> dict:
        """A model version by number, by alias, or the latest."""
        mine = self.table("model_versions").filter(F.col("name") == name)
        if version is None or version == "latest":
            picked = mine.orderBy(F.desc("version")).limit(1)
        elif isinstance(version, int) or version.isdigit():
            picked = mine.filter(F.col("version") == int(version))
        else:
            pointers = self.table("model_aliases").filter((F.col("name") == name) & (F.col("alias") == version))
            picked = mine.join(alias_resolve(pointers).select("version"), "version", "left_semi")
        row = picked.first()
        if row is None:
            raise ValueError(f"model '{name}' has no version '{version or 'latest'}'")
        return {**row.asDict(), "config": json.loads(row["config_json"])}


def _now() -> datetime:
    return datetime.now(timezone.utc)
