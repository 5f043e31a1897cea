"""Column profiles that merge: one row of state per part and column, added up without reading texts again.

A state holds exact counts, moments and bounds, and sketches for what cannot be added up: a
distinct count (HLL) and, for numbers, quantiles (KLL).  Parts are those that the
caller groups by, such as splits and batches; states of batches that arrive later
are appended, and any union of parts is profiled from their states alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.operators.profile import QUARTILES, _clean, numeric_columns

#: Registers of a distinct count, as a power of two, and three standard errors of the merged count.
LOG_REGISTERS = 14
DISTINCT_ERROR = 0.025
#: Items that a quantile sketch keeps on a level, and how far a quantile may lie from its rank.
ITEMS = 800
RANK_ERROR = 0.01


def profile_states(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """States of ``columns`` (all but those of ``by``) per value of ``by``; one pass, states alone are shuffled.

    ``rows`` counts rows, ``count`` values (of numbers: without NaN), ``null_count``
    nulls.  Columns that are not numeric have no moments, bounds or quantiles.
    """
    by = list(by)
    columns = list(columns) if columns is not None else [c for c in df.columns if c not in by]
    if not columns:
        raise ValueError("a column is needed at least")
    numeric = set(numeric_columns(df))
    wide, cells = [F.count(F.lit(1)).alias("rows")], []
    none = F.lit(None)
    for i, c in enumerate(columns):
        value = _clean(c) if c in numeric else F.col(c)
        wide += [
            F.count(value).alias(f"n{i}"),
            F.count_if(F.col(c).isNull()).alias(f"null{i}"),
            # The sketch passes over an empty text; with a mark before it, it counts.
            F.hll_sketch_agg(F.concat(F.lit("="), value.cast("string")), LOG_REGISTERS).alias(f"hll{i}"),
        ]
        if c in numeric:
            wide += [
                F.avg(value).alias(f"mean{i}"), F.var_pop(value).alias(f"var{i}"), F.min(value).alias(f"min{i}"),
                F.max(value).alias(f"max{i}"), F.kll_sketch_agg_double(value, ITEMS).alias(f"kll{i}"),
            ]
        of = (lambda name, i=i: F.col(f"{name}{i}")) if c in numeric else (lambda name: none)
        cells.append(
            F.struct(
                F.lit(c).alias("column_name"), "rows", F.col(f"n{i}").alias("count"), F.col(f"null{i}").alias("null_count"),
                of("mean").cast("double").alias("mean"), (of("var") * F.col(f"n{i}")).cast("double").alias("squares"),
                of("min").cast("double").alias("min"), of("max").cast("double").alias("max"),
                F.col(f"hll{i}").alias("distinct_state"), of("kll").cast("binary").alias("quantile_state"),
            )
        )
    return df.groupBy(*by).agg(*wide).select(*by, F.inline(F.array(*cells)))


def merge_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States of unions of parts: one row per value of ``by`` and column, of the same form as what is merged."""
    keys = [*by, "column_name"]
    filled = F.col("count") > 0
    summed = F.sum(F.col("count") * F.col("mean")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("count")))
    totals = states.groupBy(*keys).agg(summed.alias("overall"))
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    # One row per merged state on either side.
    placed = states.alias("s").join(totals.alias("t"), same).select("s.*", "t.overall")
    away = F.col("squares") + F.col("count") * (F.col("mean") - F.col("overall")) ** 2
    return placed.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.sum("count").alias("count"), F.sum("null_count").alias("null_count"),
        F.max("overall").alias("mean"), F.sum(away).alias("squares"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.hll_union_agg("distinct_state").alias("distinct_state"),
        F.kll_merge_agg_double(F.when(filled, F.col("quantile_state")), ITEMS).alias("quantile_state"),
    )


def described(states: DataFrame) -> DataFrame:
    """What states tell: exact counts, mean, std (n-1), min and max; estimated distinct values and quartiles.

    Distinct counts are within ``DISTINCT_ERROR`` of the exact ones (three standard
    errors), quartiles within ``RANK_ERROR`` of their ranks.  Without values they are
    0 and null.
    """
    numeric = (F.col("count") > 0) & F.col("mean").isNotNull()
    quartiles = [
        F.when(numeric, F.kll_sketch_get_quantile_double("quantile_state", F.lit(q))).alias(f"q{int(q * 100)}")
        for q in QUARTILES
    ]
    state = {"squares", "distinct_state", "quantile_state"}
    spread = F.when((F.col("count") > 1) & numeric, F.sqrt(F.col("squares") / (F.col("count") - 1)))
    return states.select(
        *[c for c in states.columns if c not in state],
        spread.alias("std"),
        F.hll_sketch_estimate("distinct_state").alias("unique_count"),
        *quartiles,
    )
