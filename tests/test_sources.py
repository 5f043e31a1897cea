import os

import pytest
from pyspark.sql import functions as F

from tagwright.session import new_folder
from tagwright.sources import examples as ex
from tagwright.sources import sinks
from tagwright.spec import EXAMPLE_SCHEMA
from tests.conftest import make_examples, plan_of


def rows_of(df):
    return sorted(tuple(r) for r in df.select("example_id", "symptoms", "diagnosis", "split").collect())


TRICKY = [
    (1, 'quoted "text", with comma', "allergy", "train"),
    (2, "two\nlines", "malaria", "train"),
    (3, "back\\slash", "migraine", "test"),
]


@pytest.mark.parametrize("fmt", ex.FORMATS)
def test_round_trip(spark, fmt):
    df = spark.createDataFrame(TRICKY, EXAMPLE_SCHEMA)
    path = new_folder(spark, f"rt-{fmt}")
    sinks.write_examples(df, path, fmt)
    back = ex.load_examples(spark, path, fmt=fmt, schema=EXAMPLE_SCHEMA, multiline=True)
    assert rows_of(back) == sorted(TRICKY)


def test_reading_one_split_skips_the_others(spark):
    path = new_folder(spark, "pruned")
    sinks.write_examples(make_examples(spark, 40), path)
    test = ex.load_examples(spark, path, split="test", schema=EXAMPLE_SCHEMA)
    assert test.count() == 8
    assert "PartitionFilters: [isnotnull(split" in plan_of(test)


def test_aliases(spark):
    raw = spark.createDataFrame([(1, " x ", "malaria")], "example_id long, input_text string, output_text string")
    got = ex.with_label(ex.to_examples(raw)).first()
    assert (got.symptoms, got.diagnosis, got.label) == ("x", "malaria", "malaria")
    plain = spark.createDataFrame([(1, " x ", "malaria")], "example_id long, symptoms string, diagnosis string")
    assert ex.to_examples(plain).first().symptoms == "x"
    with pytest.raises(ValueError, match="ambiguous"):
        ex.canonical_columns(plain.withColumn("input_text", F.lit("y")))
    with pytest.raises(ValueError, match="missing"):
        ex.canonical_columns(plain.drop("diagnosis"))
    with pytest.raises(ValueError, match="must be a string"):
        ex.canonical_columns(plain.withColumn("diagnosis", F.lit(1)))


def test_one_path_per_split_and_generated_ids(spark):
    folder = new_folder(spark, "dict")
    raw = "input_text string, output_text string"
    spark.createDataFrame([("a", "malaria"), ("a", "malaria")], raw).write.parquet(f"{folder}/train")
    spark.createDataFrame([("b", "allergy")], raw).write.parquet(f"{folder}/test")
    got = ex.load_examples(spark, {"train": f"{folder}/train", "test": f"{folder}/test"})
    assert got.count() == 3 and got.select("example_id").distinct().count() == 3
    assert {r.split: r.num_rows for r in ex.dataset_info(got).collect()} == {"train": 2, "test": 1}
    assert ex.dataset_info(got).first().features == ["symptoms", "diagnosis"]


def test_formats_and_schemas_are_explicit(spark):
    with pytest.raises(ValueError, match="unknown format"):
        ex.read_table(spark, "/nowhere", "xml")
    with pytest.raises(ValueError, match="needs a schema"):
        ex.read_table(spark, "/nowhere", "csv")


def test_roles_and_union(spark):
    df = make_examples(spark, 10)
    assert ex.with_roles(df).columns == ["example_id", "inputs", "label"]
    halves = df.filter("example_id < 5"), df.filter("example_id >= 5").select(*reversed(df.columns))
    assert rows_of(ex.all_splits(*halves)) == rows_of(df)


def test_shared_folder():
    from tagwright import session

    class Session:
        conf = dict({"spark.sql.warehouse.dir": "hdfs:/warehouse/"})

    assert session.shared_folder(Session()) == "hdfs:/warehouse/tagwright-scratch"
    Session.conf["spark.checkpoint.dir"] = "s3a://shared/x/"
    assert session.shared_folder(Session()) == "s3a://shared/x"


def test_cleanup_removes_intermediate_tables(spark):
    from tagwright import session

    app = f"{session.shared_folder(spark)}/tagwright/{spark.sparkContext.applicationId}".removeprefix("file://")
    session.write_once(spark.range(3), "numbers")
    assert os.path.isdir(app)
    session.cleanup(spark)
    assert not os.path.exists(app)


def test_csv_with_line_ends(spark, tmp_path):
    path = str(tmp_path / "rows.csv")
    with open(path, "w") as file:
        file.write('symptoms,diagnosis\n"two\nlines",allergy\n')
    schema = "symptoms string, diagnosis string"
    assert ex.read_table(spark, path, "csv", schema, multiline=True).first().symptoms == "two\nlines"
    assert ex.read_table(spark, path, "csv", schema).count() == 2


def test_other_raw_splits_belong_to_no_part(spark):
    from tagwright.spec import TaskSpec

    df = make_examples(spark, 40)
    other = F.when(F.col("example_id") % 4 == 0, "dev").when(F.col("example_id") % 4 == 1, "validation")
    data = ex.Dataset(df.withColumn("split", F.coalesce(other, "split")), TaskSpec("t", ("allergy", "malaria", "migraine")))
    parts = {(r.example_id, r.split) for r in data.parts().collect()}
    named = {(r.example_id, n) for n in ("train", "validation", "test") for r in data.population(n).collect()}
    assert parts == named and {i % 4 for i, _ in parts} == {2, 3}
    assert {r.example_id for r in data.population("all").collect()} == {i for i, _ in parts}


def test_sorted_examples_keep_ids_apart_by_file(spark):
    path = new_folder(spark, "sorted")
    # Left on, this would fold so few rows into one file.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_examples(make_examples(spark, 400).repartition(6), path, sort=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(path).groupBy("split", F.input_file_name().alias("file")).agg(
        F.min("example_id").alias("low"), F.max("example_id").alias("high")
    )
    for split in ("train", "test"):
        ranges = [(r.low, r.high) for r in files.filter(F.col("split") == split).orderBy("low").collect()]
        assert len(ranges) > 1
        assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_dataset(spark):
    from tagwright.spec import TaskSpec

    data = ex.Dataset(make_examples(spark, 50), TaskSpec("t", ("allergy", "malaria", "migraine")), source="made")
    assert data.checked(check_ids=True) is data
    assert {(r.dataset, r.split) for r in data.info().collect()} == {("made", "train"), ("made", "test")}
    assert data.summary("test").table.first().total_rows == 10
    assert data.list("validation", 2).count() == 2
