"""Row keys, first-N caps and rank cut-offs without a single-task sort."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.functions.text import content_key, hash_key
from tagwright.session import write_once

# Up to this many keys a top-k on the key column alone is one cheap job.
SMALL = 10_000

# Places of splitters around an estimated rank, in standard deviations of the estimate.
SPREADS = (-6.0, -4.0, -3.0, -2.0, -1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0)

# Copies of one row generated per task when ids are assigned.
CHUNK = 100_000


def kth_smallest(keys: DataFrame, k: int | Callable[[int], int], width: int = 3, small: int = SMALL) -> str | None:
    """The k-th smallest string of a one-column frame of unique strings (k from 1).

    ``k`` may be a function of the number of keys, which the first pass counts.

    Radix selection: each pass counts the next ``width`` characters below the
    prefix found so far and keeps one bucket.  A pass reads one column, combines
    before the shuffle and returns one row per bucket, so nothing whole ever
    reaches one task.  ``None`` when there are fewer than k keys.
    """
    column = keys.columns[0]
    keys = keys.select(F.col(column).alias("key")).filter(F.col("key").isNotNull())
    prefix = ""
    while True:
        depth = len(prefix) + width
        pool = keys.filter(F.startswith("key", F.lit(prefix))) if prefix else keys
        buckets = sorted(
            (row["bucket"], row["n"])
            for row in pool.groupBy(F.substring("key", 1, depth).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        )
        if callable(k):
            k = k(sum(n for _, n in buckets))
        if k <= 0:
            return None
        for bucket, n in buckets:
            if k <= n:
                break
            k -= n
        else:
            return None
        if len(bucket) < depth:
            return bucket
        prefix = bucket
        if n <= small:
            rest = keys.filter(F.startswith("key", F.lit(prefix))).orderBy("key").limit(k)
            return rest.agg(F.max("key")).first()[0]


def nth_smallest(keys: DataFrame, n: int, small: int | None = None) -> object:
    """The n-th smallest of one column of any orderable type, nulls left out; ``None`` when there are fewer.

    Up to ``SMALL`` a top-n does.  Beyond it no keys are sorted: a random sample of
    about ``SMALL`` keys gives splitters close around the place of the n-th, the keys
    below, at and between them are counted exactly, and the cell that holds the n-th
    is what the next round looks at.  Whatever the sample, the counts are exact, so
    every way finds the same value.  A round narrows to a few hundredths of the keys or
    fewer, and from then on only those, written once, are read.  A key that many rows
    share is a splitter with a count of its own.
    """
    small = small or SMALL
    column = keys.columns[0]
    pool = keys.select(F.col(column).alias("key")).filter(F.col("key").isNotNull())
    if n <= small:
        row = pool.orderBy("key").limit(n).agg(F.max("key"), F.count(F.lit(1))).first()
        return row[0] if row[1] == n else None
    size = pool.count()
    if n > size:
        return None
    while size > small:
        splitters = _splitters(pool, size, n, small)
        counts = _cell_counts(pool, splitters)
        for cell, members in counts:
            if n <= members:
                break
            n -= members
        if cell % 2:
            return splitters[cell // 2]
        if splitters:
            low, high = cell // 2 - 1, cell // 2
            inside = [F.col("key") > F.lit(splitters[low])] if low >= 0 else []
            inside += [F.col("key") < F.lit(splitters[high])] if high < len(splitters) else []
            pool, size = write_once(pool.filter(reduce(and_, inside)), "nearer-keys"), members
    # No more than ``small`` keys are left.
    return pool.agg(F.sort_array(F.collect_list("key"))[n - 1]).first()[0]


def _splitters(pool: DataFrame, size: int, n: int, sampled: int) -> list:
    """Different sampled keys around the place that the n-th of ``size`` keys has in a sample, ascending."""
    keys = pool.filter(F.rand() < sampled / size).agg(F.sort_array(F.collect_list("key")).alias("keys"))
    # The place in the sample varies by about the root of this.
    share = n / size
    spread = max(1.0, math.sqrt(sampled * share * (1 - share)))
    at = [F.round(F.size("keys") * share + spread * step).cast("int") for step in SPREADS]
    inside = [F.get("keys", F.least(F.greatest(i, F.lit(0)), F.size("keys") - 1)) for i in at]
    return keys.select(F.array_distinct(F.array_compact(F.array(*inside)))).first()[0]


def _cell_counts(pool: DataFrame, splitters: list) -> list[tuple[int, int]]:
    """Keys per cell, ascending: cell 2i lies below the i-th splitter (from 0) and above the one before, 2i+1 holds it."""
    key = F.col("key")
    passed = [c.cast("int") for s in splitters for c in (key >= F.lit(s), key > F.lit(s))]
    counted = pool.groupBy(reduce(add, passed, F.lit(0)).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return sorted((row["cell"], row["n"]) for row in counted.collect())


def among_first(df: DataFrame, n: int | None, key: str = "example_id") -> Column:
    """Condition for the n rows of ``df`` with the smallest keys; ``None`` is no cap.

    Only the key column is read to find the n-th key, and the condition is a
    comparison with one value, which the file scan can use.  Rows without a key are
    never among the first.  Keys are meant to be unique: rows that share the n-th
    key are all among the first.
    """
    if n is None:
        return F.lit(True)
    if n <= 0:
        raise ValueError(f"a row cap must be positive, got {n}")
    last = nth_smallest(df.select(key), n)
    return F.col(key).isNotNull() if last is None else F.col(key) <= F.lit(last)


def first_n(df: DataFrame, n: int | None, key: str = "example_id") -> DataFrame:
    """The n rows with the smallest keys, without gathering them in one task."""
    return df if n is None else df.filter(among_first(df, n, key))


def list_rows(df: DataFrame, rows: int = 5, key: str = "example_id") -> DataFrame:
    """The first rows, each with the number of rows there are in all."""
    total = df.agg(F.count(F.lit(1)))
    return first_n(df, rows, key).withColumn("total_rows", total.scalar())


def first_ids_by_hash(df: DataFrame, k: int, salt: object, key: str = "example_id") -> list:
    """Ids of the k rows with the smallest hash, in hash order; for small k.  Rows without an id are passed over."""
    if not 0 <= k <= SMALL:
        raise ValueError(f"between 0 and {SMALL} ids can be picked, got {k}")
    keys = df.select(key).filter(F.col(key).isNotNull())
    picked = keys.select(key, hash_key(F.col(key), salt).alias("hash")).orderBy("hash").limit(k)
    return [row[0] for row in picked.collect()]


def sample_n(df: DataFrame, n: int | None, salt: object, key: str = "example_id") -> DataFrame:
    """A seeded sample: the n rows with the smallest hash; ``None`` keeps all.  Rows without an id are left out."""
    if n is None:
        return df
    if n <= 0:
        raise ValueError(f"a sample size must be positive, got {n}")
    hashed = hash_key(F.col(key), salt)
    last = nth_smallest(df.select(hashed.alias("key")), n)
    return df.filter(F.col(key).isNotNull() if last is None else hashed <= F.lit(last))


def fetch(df: DataFrame, ids: list, key: str = "example_id") -> DataFrame:
    """A few rows by id, with ``ord`` from 1 in the order of ``ids``.

    The ids are literals, so the filter reaches the file scan.
    """
    wanted = F.array(*[F.lit(i) for i in ids]).cast(f"array<{dict(df.dtypes)[key]}>")
    picked = df.filter(F.col(key).isin(ids)) if ids else df.limit(0)
    return picked.withColumn("ord", F.array_position(wanted, F.col(key)).cast("int"))


def assign_ids(df: DataFrame, id_column: str = "example_id", chunk: int = CHUNK) -> DataFrame:
    """Give id-less rows a stable id: content digest and occurrence number.

    Equal rows are interchangeable, so they are counted (combined before the
    shuffle) and written out again in chunks spread over the cluster.  A row that
    makes up a third of the table is numbered by many tasks, not by one window.
    """
    columns = df.columns
    n_chunks = F.ceil(F.col("copies") / F.lit(chunk)).cast("long")
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    digest = content_key(*[F.col(c).cast("string") for c in columns])
    chunked = counted.withColumn("digest", digest).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), n_chunks - 1))
    )
    # Both branches share the shuffle of the count.  The explicit number keeps
    # the chunks of a hot row from being folded back into one task.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rare = chunked.filter(F.col("copies") <= chunk)
    hot = chunked.filter(F.col("copies") > chunk).repartition(tasks, "digest", "chunk")
    first = F.col("chunk") * chunk + 1
    last = F.least(first + (chunk - 1), F.col("copies"))
    return rare.unionByName(hot).withColumn("copy", F.explode(F.sequence(first, last))).select(
        F.concat_ws("-", "digest", "copy").alias(id_column), *columns
    )
