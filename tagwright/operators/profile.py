"""Column statistics of a table, computed in few passes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagwright.session import small_frame

QUARTILES = (0.25, 0.5, 0.75)

# Values that a task's summary of frequent values tracks.  What the merged summaries leave out is no
# more frequent than this share of the rows (twice the summary's stated error).
TRACKED = 4096
UNSEEN = 2 * 3.5 / TRACKED

# Standard error of an estimated number of different values beside such a summary.
DISTINCT_ERROR = 0.01

# Quantile search: cells per pass, and how many values may come to the driver.
CELLS = 1024
SMALL = 10_000


def numeric_columns(df: DataFrame) -> list[str]:
    """From the schema; no job."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def other_columns(df: DataFrame) -> list[str]:
    numeric = set(numeric_columns(df))
    return [c for c in df.columns if c not in numeric]


def profile_table(df: DataFrame) -> DataFrame:
    """Number of rows and columns, and the column names."""
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows",
        F.lit(len(df.columns)).alias("total_columns"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
    )


def _value_counts(df: DataFrame, columns: list[str], id_column: str | None,
                  wanted: dict[str, Column] | None = None) -> DataFrame:
    """Rows per (column, value digest), all columns in one shuffle.

    The digest stands in for the value, so 32 bytes per distinct value are
    shuffled however long the texts are; equal values combine first.  Of values
    that are not ``wanted`` nothing is kept.
    """
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.unhex(F.sha2(F.col(c).cast("string"), 256)).alias("digest"),
        )
        for c in columns
    ]
    if wanted:
        cells = [F.when(wanted[c], cell) for c, cell in zip(columns, cells)]
    pairs = F.array_compact(F.array(*cells)) if wanted else F.array(*cells)
    keep = [F.col(id_column).alias("first_id")] if id_column else []
    cells = df.select(*keep, F.explode(pairs).alias("cell")).select(*[c for c in ("first_id",) if keep], "cell.*")
    firsts = [F.min("first_id").alias("first_id")] if keep else []
    return cells.groupBy("column_name", "digest").agg(F.count(F.lit(1)).alias("n"), *firsts)


def profile_columns(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct values (nulls not counted) and nulls of each non-numeric column."""
    columns = columns or other_columns(df)
    if approximate:
        wide = df.agg(
            *[F.approx_count_distinct(c).alias(f"u{i}") for i, c in enumerate(columns)],
            *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)],
        )
        rows = F.array(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.col(f"u{i}").alias("unique_count"),
                    F.col(f"n{i}").alias("null_count"),
                )
                for i, c in enumerate(columns)
            ]
        )
        return wide.select(F.inline(rows))
    return _value_counts(df, columns, None).groupBy("column_name").agg(
        F.count("digest").alias("unique_count"),
        F.coalesce(F.sum(F.when(F.col("digest").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
    )


def most_frequent(df: DataFrame, columns: list[str] | None = None, id_column: str = "example_id") -> DataFrame:
    """Most frequent value of each column and how often it occurs, both exact; nulls do not count.

    Of several most frequent values the one that occurs first by id is taken.  Every
    task sums up its rows in at most ``TRACKED`` counters per column (Spark's
    mergeable top-k sketch over 64-bit hashes of the values), and a second pass counts
    the few values that the merged sketch names exactly, so that tasks times counters is
    all that is shuffled.  A value it does not name occurs in at most ``UNSEEN`` of the
    rows: a column whose best count is not above that, and whose named values are not
    all its rows, is counted once more by the digests of all its values.
    """
    columns = columns or [c for c in other_columns(df) if c != id_column]
    return _with_texts(df, columns, id_column, _frequent(df, columns, id_column)).select("column_name", "top", "freq")


def _frequent(df: DataFrame, columns: list[str], id_column: str) -> dict[str, dict]:
    """Per column: values, an estimate of the different ones, how often the most frequent occurs and its first id."""
    wide = []
    for i, c in enumerate(columns):
        # A hash shared by two values only makes both of them candidates.
        mark = _mark(c)
        wide += [
            F.count(c).alias(f"count{i}"),
            F.approx_count_distinct(mark, DISTINCT_ERROR).alias(f"unique{i}"),
            F.call_function("approx_top_k", mark, F.lit(TRACKED), F.lit(TRACKED)).alias(f"top{i}"),
        ]
    seen = df.agg(*wide).first()
    found = {
        c: {"count": seen[f"count{i}"], "unique": seen[f"unique{i}"], "freq": None, "first_id": None}
        for i, c in enumerate(columns)
    }
    named = {}
    for i, c in enumerate(columns):
        marks = [x["item"] for x in seen[f"top{i}"] or [] if x["item"] is not None]
        if marks:
            named[c] = _mark(c).isin(marks)
    open_columns = [c for c in columns if found[c]["count"]]
    if named:
        counts = _value_counts(df, list(named), id_column, named).filter(F.col("digest").isNotNull())
        for row in _best(counts).collect():
            of = found[row["column_name"]]
            if row["n"] == of["count"] or row["freq"] > UNSEEN * of["count"]:
                of["freq"], of["first_id"] = row["freq"], row["first_id"]
                open_columns.remove(row["column_name"])
    if open_columns:
        counts = _value_counts(df, open_columns, id_column).filter(F.col("digest").isNotNull())
        for row in _best(counts).collect():
            found[row["column_name"]].update(freq=row["freq"], first_id=row["first_id"])
    return found


def _mark(column: str) -> Column:
    return F.when(F.col(column).isNotNull(), F.xxhash64(F.col(column).cast("string")))


def _best(counts: DataFrame) -> DataFrame:
    """Per column: the rows counted, the largest count, and the first id of the first value that has it."""
    best = F.min(F.struct((-F.col("n")).alias("rank"), "first_id")).alias("best")
    return counts.groupBy("column_name").agg(F.sum("n").alias("n"), best).select(
        "column_name", "n", (-F.col("best.rank")).alias("freq"), "best.first_id"
    )


def describe_categorical(df: DataFrame, columns: list[str] | None = None, id_column: str = "example_id",
                         approximate: bool = False) -> DataFrame:
    """Count, distinct values, most frequent value and its frequency per column.

    Of several most frequent values the one that occurs first by id is taken.
    Its text is fetched by that id from the table, one row per column, so the
    texts themselves are never shuffled.  ``approximate`` estimates the number of
    distinct values (``DISTINCT_ERROR``), which spares the shuffle of a digest for each of them; the other
    columns are exact either way (``most_frequent``).
    """
    columns = columns or [c for c in other_columns(df) if c != id_column]
    if approximate:
        return _with_texts(df, columns, id_column, _frequent(df, columns, id_column))
    counts = _value_counts(df, columns, id_column).filter(F.col("digest").isNotNull())
    # One aggregate per column instead of a group per column: nothing is sorted.
    wide = []
    for i, c in enumerate(columns):
        mine = F.col("column_name") == c
        ranked = F.struct((-F.col("n")).alias("rank"), "first_id")
        wide += [
            F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0)).alias(f"count{i}"),
            F.count_if(mine).alias(f"unique{i}"),
            F.min(F.when(mine, ranked)).alias(f"best{i}"),
        ]
    row = counts.agg(*wide).first()
    found = {}
    for i, c in enumerate(columns):
        rank, first_id = row[f"best{i}"] or (None, None)
        found[c] = {"count": row[f"count{i}"], "unique": row[f"unique{i}"],
                    "freq": None if rank is None else -rank, "first_id": first_id}
    return _with_texts(df, columns, id_column, found)


def _with_texts(df: DataFrame, columns: list[str], id_column: str, found: dict[str, dict]) -> DataFrame:
    """One row per column, its most frequent value read from the row with the found id."""
    rows = [(c, f["count"], f["unique"], f["freq"], f["first_id"]) for c, f in found.items()]
    id_type = dict(df.dtypes)[id_column]
    stats = small_frame(
        df.sparkSession, rows, f"column_name string, count long, unique long, freq long, id {id_type}"
    )
    # The ids are literals, so the second read touches little of the table.
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("top")) for c in columns])
    wanted = F.col(id_column).isin([row[-1] for row in rows if row[-1] is not None])
    values = df.filter(wanted).select(F.col(id_column).alias("id"), F.inline(cells))
    # No more rows than the square of the number of columns.
    return stats.join(F.broadcast(values), ["column_name", "id"], "left").select(
        "column_name", "count", "unique", "top", "freq"
    )


@dataclass(frozen=True)
class Summary:
    """Everything a dataset summary shows, as small tables."""

    table: DataFrame
    numeric: DataFrame
    categorical: DataFrame
    other_columns: DataFrame


def summary(df: DataFrame, id_column: str = "example_id", approximate: bool = False) -> Summary:
    """Size of the table and statistics of its columns, the row id aside."""
    data = df.drop(id_column)
    return Summary(
        profile_table(data),
        describe_numeric(data, approximate=approximate),
        describe_categorical(df, other_columns(data), id_column, approximate),
        profile_columns(df, other_columns(data), approximate),
    )


def _clean(column: str) -> Column:
    """The column as a double, with NaN counted as missing."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def describe_numeric(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Count, mean, std (n-1), min, quartiles and max, one row per column.

    Quartiles are interpolated order statistics.  ``approximate`` takes them
    from a sketch in the same pass; otherwise they are found by narrowing value
    ranges, which needs a few more passes over the numeric columns alone and
    never holds the distinct values of a column in one task.
    """
    columns = columns or numeric_columns(df)
    schema = ("column_name string, count long, mean double, std double, min double, "
              "q25 double, q50 double, q75 double, max double")
    if not columns:
        return small_frame(df.sparkSession, [], schema)
    aggregates = []
    for i, c in enumerate(columns):
        value = _clean(c)
        aggregates += [
            F.count(value).alias(f"n{i}"),
            F.avg(value).alias(f"mean{i}"),
            F.stddev_samp(value).alias(f"std{i}"),
            F.min(value).alias(f"min{i}"),
            F.max(value).alias(f"max{i}"),
        ]
        if approximate:
            aggregates.append(F.percentile_approx(value, list(QUARTILES), 10_000).alias(f"q{i}"))
    stats = df.agg(*aggregates).first()
    if approximate:
        quartiles = {c: stats[f"q{i}"] or [None] * 3 for i, c in enumerate(columns)}
    else:
        sizes = {c: stats[f"n{i}"] for i, c in enumerate(columns)}
        quartiles = exact_quantiles(df, sizes, QUARTILES)
    rows = [
        (c, stats[f"n{i}"], stats[f"mean{i}"], stats[f"std{i}"], stats[f"min{i}"], *quartiles[c], stats[f"max{i}"])
        for i, c in enumerate(columns)
    ]
    return small_frame(df.sparkSession, rows, schema)


def exact_quantiles(df: DataFrame, sizes: dict[str, int], quantiles, small: int = SMALL) -> dict[str, list]:
    """Interpolated quantiles of several columns; ``sizes`` counts their values."""
    wanted = {}
    for c, n in sizes.items():
        for q in quantiles:
            position = q * (n - 1)
            if n:
                wanted.update({(c, int(position)): None, (c, min(int(position) + 1, n - 1)): None})
    found = _order_statistics(df, sizes, sorted(wanted), small)
    result = {}
    for c, n in sizes.items():
        values = []
        for q in quantiles:
            if not n:
                values.append(None)
                continue
            position = q * (n - 1)
            low, share = int(position), position - int(position)
            a, b = found[(c, low)], found[(c, min(low + 1, n - 1))]
            values.append(a if share == 0 or a == b else a + (b - a) * share)
        result[c] = values
    return result


def _order_statistics(df, sizes, targets, small) -> dict:
    """Values at 0-based ranks of columns, by narrowing value ranges.

    Each open range is cut into cells at values between its least and greatest
    member, so every pass leaves strictly fewer distinct values in it.  The
    driver sees cell counts, or the values of a range once they are few.
    """
    values = df.select(*[_clean(c).alias(c) for c in sizes])
    found: dict = {}
    finite = _finite_bounds(values) if max(sizes.values()) > small // len(sizes) else {}
    # (column, least, greatest, members) -> ranks within the range and their targets
    open_ranges = {}
    for c, rank in targets:
        open_ranges.setdefault((c, None, None, sizes[c]), []).append((rank, (c, rank)))
    while open_ranges:
        # However many ranges are open, no more than ``small`` values are fetched.
        fair_share = max(1, small // len(open_ranges))
        few = {r: wants for r, wants in open_ranges.items() if r[3] <= fair_share}
        if few:
            rows = _members(values, list(few)).collect()
            for i, wants in enumerate(few.values()):
                members = sorted(row["v"] for row in rows if row["i"] == i)
                found.update({target: members[rank] for rank, target in wants})
        large = {r: wants for r, wants in open_ranges.items() if r[3] > fair_share}
        open_ranges = {}
        if not large:
            continue
        ranges = list(large)
        bounds = [(low, high) if low is not None else finite[c] for c, low, high, _ in ranges]
        cell = F.coalesce(*[F.when(F.col("i") == i, _cell(F.col("v"), *b)) for i, b in enumerate(bounds)])
        counted = (
            _members(values, ranges)
            .groupBy("i", cell.alias("cell"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
            .collect()
        )
        for i, r in enumerate(ranges):
            seen = 0
            for cell in sorted((x for x in counted if x["i"] == i), key=lambda x: x["cell"]):
                for rank, target in large[r]:
                    inner = rank - seen
                    if not 0 <= inner < cell["n"]:
                        continue
                    if cell["low"] == cell["high"]:
                        found[target] = cell["low"]
                    else:
                        key = (r[0], cell["low"], cell["high"], cell["n"])
                        open_ranges.setdefault(key, []).append((inner, target))
                seen += cell["n"]
    return found


def _members(values: DataFrame, ranges: list) -> DataFrame:
    """Values of each range, tagged with the position of the range."""
    tagged = [
        F.when(_inside(c, low, high), F.struct(F.lit(i).alias("i"), F.col(c).alias("v")))
        for i, (c, low, high, _) in enumerate(ranges)
    ]
    return values.select(F.explode(F.array_compact(F.array(*tagged))).alias("x")).select("x.i", "x.v")


def _inside(column: str, low, high) -> Column:
    if low is None:
        return F.col(column).isNotNull()
    return F.col(column).between(low, high)


def _finite_bounds(values: DataFrame) -> dict[str, tuple]:
    """Least and greatest finite value of every column, in one pass."""
    inf = float("inf")
    ends = []
    for i, c in enumerate(values.columns):
        value = F.col(c)
        finite = F.when((value > -inf) & (value < inf), value)
        ends += [F.min(finite).alias(f"low{i}"), F.max(finite).alias(f"high{i}")]
    row = values.agg(*ends).first()
    return {c: (row[f"low{i}"], row[f"high{i}"]) for i, c in enumerate(values.columns)}


def _cell(value: Column, low, high) -> Column:
    """Cell of a value within its range; infinities get cells of their own."""
    inf = float("inf")
    if low is None or low == high:
        inner = F.lit(0)
    else:
        # Halves keep the width finite when the range spans the whole type.
        share = (value * 0.5 - low * 0.5) / F.lit(high * 0.5 - low * 0.5)
        inner = F.least(F.floor(share * CELLS).cast("int"), F.lit(CELLS - 1))
    return F.when(value == -inf, -1).when(value == inf, CELLS).otherwise(inner)
