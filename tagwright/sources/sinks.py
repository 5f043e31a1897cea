"""Writing examples, scored rows and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CSV = {"header": True, "escape": '"'}


def write_rows(rows: DataFrame, folder: str) -> None:
    """Rows in Parquet and CSV, one folder per split; they are computed once."""
    rows.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/parquet")
    written = rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/parquet")
    written.write.mode("overwrite").partitionBy("split").options(**_CSV).csv(f"{folder}/csv")


def write_examples(examples: DataFrame, path: str, fmt: str = "parquet", sort: bool = False) -> None:
    """Examples partitioned by split, so that reading one split skips the others.

    ``sort`` orders them by id over all files, at the price of one shuffle: row
    caps, samples and look-ups by id then read few row groups.
    """
    if sort:
        examples = examples.repartitionByRange("split", "example_id").sortWithinPartitions("split", "example_id")
    writer = examples.write.mode("overwrite").partitionBy("split").format(fmt)
    if fmt == "csv":
        writer = writer.options(**_CSV)
    writer.save(path)


def write_bucketed(rows: DataFrame, table: str, path: str, buckets: int, key: str = "example_id") -> DataFrame:
    """Rows as a catalog table of ``buckets`` files by the hash of the id, sorted by id, and read back.

    Two such tables with the same number of buckets are joined on the id without a
    shuffle, however often.  The rows are shuffled once, here; a table of that name
    is replaced.  Ids are meant to be unique, so that no bucket is hot.
    """
    if buckets < 1:
        raise ValueError(f"a bucket is needed at least, got {buckets}")
    # The exchange is the bucketing itself, so each task writes one file.
    placed = rows.repartition(buckets, key)
    placed.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return rows.sparkSession.table(table)


def write_prompt_report(report: DataFrame, path: str, headings: tuple[str, ...]) -> None:
    """The report as one text file, sections in the order of ``headings``."""
    rank = F.array_position(F.array(*[F.lit(h) for h in headings]), F.col("section"))
    heading = F.concat(F.lit("## "), "section", F.lit("\n"), "text")
    text = F.when(F.col("ord") == 0, heading).otherwise(F.col("text"))
    lines = report.repartition(1).sortWithinPartitions(rank, "ord").select(text.alias("value"))
    lines.write.mode("overwrite").text(path)
