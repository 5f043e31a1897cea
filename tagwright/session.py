"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g",
                  folder: str | None = None) -> SparkSession:
    """A session for tests and benchmarks on one machine, whose driver does all the work.

    ``folder`` is for intermediate tables, where Spark's own settings do not name one.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tagwright")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    spark = (builder.config("spark.checkpoint.dir", folder) if folder else builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can read: the one that ``spark.checkpoint.dir`` names.

    Where it is unset a folder beside the tables of the warehouse is taken, which
    a session's executors share as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tagwright-scratch"
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call has been given."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/tagwright/{app}/{name}-{uuid.uuid4().hex[:12]}"


def cleanup(spark: SparkSession) -> None:
    """Remove the intermediate tables that this application has written; results read from them are then gone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tagwright/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, asked of the file system the path names."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file)


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    The work is done once, survives the loss of executors, and later reads
    prune columns.  ``checkpoint()`` would compute an uncached plan twice, which
    matters when the plan calls a predictor.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few driver values as a local relation; no Python worker is started for them."""
    fields = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)
    columns = [
        pa.array([_pairs(row[i]) for row in rows], type=column.type) for i, column in enumerate(arrow)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema=fields)


def _pairs(value: object) -> object:
    return list(value.items()) if isinstance(value, dict) else value
