"""Embedding near-dedup with Euclidean p-stable hashing.

Vectors are normalised, projected on random directions, and the quantised
projections bucket them in several tables.  Vectors that meet in a bucket are checked
by exact cosine in double precision.  A pair is counted where it meets first, which
both vectors' bucket keys tell, so a link adds to two counters and need not travel;
for components a bucket hands on a forest.  Large buckets are cut into blocks that
meet pair by pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.llm.graph import components
from tagwright.llm.textbytes import field_names, mix
from tagwright.session import write_once

THRESHOLD = 0.9
TABLES = 40
PROJECTIONS = 10
#: Width of a quantisation step, in units of the normalised vectors.
WIDTH = 2.0
SEED = 42

#: Vectors that are compared with each other at a time.
BLOCK = 1024


def collision_probability(cosine: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection agrees for unit vectors with this cosine."""
    distance = math.sqrt(max(0.0, 2 - 2 * cosine))
    if distance == 0:
        return 1.0
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def recall(cosine: float, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH) -> float:
    """Expected share of the pairs with this cosine that meet in a table."""
    return 1 - (1 - collision_probability(cosine, width) ** projections) ** tables


def _usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a direction, and their vectors in double precision; all of one length."""
    rows, vectors = [], []
    for i, value in enumerate(column):
        if value.is_valid and value.values.null_count == 0:
            vector = value.values.to_numpy().astype(np.float64)
            if len(vector) and np.isfinite(vector).all() and vector.any():
                rows.append(i)
                vectors.append(vector)
    return np.array(rows, int), vectors


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


_SIGNED = "node long, copies long, size int, vector binary, keys array<long>"


def _sign(tables: int, projections: int, width: float, seed: int) -> Callable:
    def drawn(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        random = np.random.default_rng([seed, size])
        directions = random.standard_normal((size, tables * projections))
        shifts = random.uniform(0, width, tables * projections)
        factors = random.integers(1, 1 << 62, (tables, projections), dtype=np.int64).astype(np.uint64) | np.uint64(1)
        return directions, shifts, factors

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for batch in batches:
            rows, vectors = _usable(batch["vector"])
            sizes = np.array([len(v) for v in vectors], int)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                directions, shifts, factors = known.setdefault(int(size), drawn(int(size)))
                unit = _unit(np.stack([vectors[i] for i in at]))
                steps = np.floor((unit @ directions + shifts) / width).astype(np.int64)
                steps = steps.reshape(len(at), tables, projections).view(np.uint64)
                keys = mix((steps * factors).sum(axis=2, dtype=np.uint64) + np.uint64(size)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["node"].take(pa.array(rows[at])),
                        batch["copies"].take(pa.array(rows[at])),
                        pa.array(np.full(len(at), size, np.int32)),
                        pa.array([v.tobytes() for v in unit], pa.binary()),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(len(at) + 1, dtype=np.int32) * tables), pa.array(keys.reshape(-1))
                        ),
                    ],
                    names=field_names(_SIGNED),
                )

    return sign


_FOUND = "node long, links long, hung_on long"


def _forest(linked: np.ndarray, square: bool) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of rows and columns of a block of links; a square block has the same vectors on both sides."""
    n, m = linked.shape
    rows = np.arange(n)
    columns = rows if square else np.arange(n, n + m)
    most = n + m
    while True:
        new_rows = np.minimum(rows, np.where(linked, columns, most).min(axis=1, initial=most))
        new_columns = np.minimum(columns, np.where(linked, new_rows[:, None], most).min(axis=0, initial=most))
        if square:
            new_rows = new_columns = np.minimum(new_rows, new_columns)
        if (new_rows == rows).all() and (new_columns == columns).all():
            return rows, columns
        rows, columns = new_rows, new_columns


def _compare(threshold: float) -> Callable:
    """Links inside buckets; rows come sorted by table, key and block."""

    def block(table: int, left: dict, right: dict | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = left, right or left
        linked = a["vector"] @ b["vector"].T >= threshold
        if right is None:
            np.fill_diagonal(linked, False)
        i, j = np.nonzero(linked)
        # Each link is counted in the first table in which the two share a bucket.
        first = np.ones(len(i), bool)
        for t in range(table):
            first &= a["keys"][i, t] != b["keys"][j, t]
        counts_a = np.bincount(i[first], weights=b["copies"][j[first]], minlength=len(a["node"]))
        if right is None:
            rows, _ = _forest(linked, True)
            return a["node"], counts_a, a["node"][rows]
        counts_b = np.bincount(j[first], weights=a["copies"][i[first]], minlength=len(b["node"]))
        rows, columns = _forest(linked, False)
        nodes = np.concatenate([a["node"], b["node"]])
        return nodes, np.concatenate([counts_a, counts_b]), nodes[np.concatenate([rows, columns])]

    def group(table: int, rows: dict, whole: bool) -> list[tuple]:
        """``whole``: all rows meet; else rows of the lower block meet those of the higher."""
        if not whole:
            low = rows["block"] == rows["block"].min()
            sides = [{c: v[m] for c, v in rows.items()} for m in (low, ~low)]
            return [block(table, *sides)] if len(sides[1]["node"]) else []
        return [block(table, rows, None)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _sorted_groups(batches):
            out: list[tuple] = []
            for start, end in zip(cuts[:-1], cuts[1:]):
                if end - start > 1:
                    part = {c: v[start:end] for c, v in rows.items()}
                    out += group(int(part["table"][0]), part, bool(part["low"][0] == part["high"][0]))
            if out:
                node, links, hung = [np.concatenate(c) for c in zip(*out)]
                some = (links > 0) | (hung != node)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.array(hung[some])],
                    names=field_names(_FOUND),
                )

    return compare


def _read(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    flat = {c: batch[c].to_numpy() for c in ("table", "key", "low", "high", "block", "size", "node", "copies")}
    keys = batch["keys"]
    flat["keys"] = keys.flatten().to_numpy().reshape(batch.num_rows, -1)
    vectors = np.empty(batch.num_rows, object)
    vectors[:] = [np.frombuffer(v) for v in batch["vector"].to_pylist()]
    flat["vector"] = vectors
    return flat


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
    """Rows of whole groups, and where each group begins; a group may span batches."""
    held: dict | None = None

    def cut(rows: dict) -> np.ndarray:
        change = np.zeros(len(rows["key"]) - 1, bool)
        for c in ("table", "key", "low", "high", "size"):
            change |= rows[c][1:] != rows[c][:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1, [len(rows["key"])]])

    def stacked(rows: dict, cuts: np.ndarray) -> Iterator[tuple[dict, np.ndarray]]:
        # Vectors of one length at a time form a matrix.
        edges = np.flatnonzero(np.concatenate([[True], rows["size"][1:] != rows["size"][:-1], [True]]))
        for a, b in zip(edges[:-1], edges[1:]):
            part = {c: v[a:b] for c, v in rows.items() if c != "vector"}
            part["vector"] = np.stack(rows["vector"][a:b])
            yield part, cuts[(cuts >= a) & (cuts <= b)] - a

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _read(batch)
        if held is not None:
            rows = {c: np.concatenate([held[c], v]) for c, v in rows.items()}
        cuts = cut(rows)
        last = int(cuts[-2])
        if last:
            yield from stacked({c: v[:last] for c, v in rows.items()}, cuts[:-1])
        held = {c: v[last:] for c, v in rows.items()}
    if held is not None:
        yield from stacked(held, cut(held))


def near_duplicates(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    threshold: float = THRESHOLD,
    tables: int = TABLES,
    projections: int = PROJECTIONS,
    width: float = WIDTH,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every vector.

    Links join vectors whose cosine is at least ``threshold`` and that share a bucket
    of some table; vectors of different lengths have no links.  Vectors that are
    null, empty or zero, or hold a null or a value that is not finite, have no links
    either.  Equal vectors are compared once and counted as often as they occur.  A
    null id is passed over when the smallest id is looked for; its row is kept if it
    is alone or all others of its component are null too.  Rows that share an id are
    counted as different vectors.
    """
    if not 0 < threshold <= 1:
        raise ValueError(f"a threshold above 0 and up to 1 is needed, got {threshold}")
    spark = vectors.sparkSession
    named = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.col(vector_column).alias("vector"),
        F.md5(F.col(vector_column).cast("string").cast("binary")).alias("content"),
    )
    same = named.groupBy("content").agg(
        F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")
    )
    distinct = write_once(same.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    signed = write_once(distinct.select("node", "copies", "vector").mapInArrow(_sign(tables, projections, width, SEED), _SIGNED), "signed-vectors")

    keyed = signed.select("node", F.posexplode("keys").alias("table", "key"))
    large = keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
    large = write_once(
        large.select(F.col("table").alias("of"), F.col("key").alias("at"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")),
        "large-buckets",
    )
    spread = signed.select("node", "copies", "size", "vector", "keys", F.posexplode("keys").alias("table", "key"))
    met = spread.join(large, (F.col("table") == F.col("of")) & (F.col("key") == F.col("at")), "left")
    # A row of a large bucket goes to every pair of blocks that has its own.
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda other: F.struct(F.least(own, other).alias("low"), F.greatest(own, other).alias("high")),
    )
    placed = met.select("node", "copies", "size", "vector", "keys", "table", "key", own.alias("block"), F.explode(pairs).alias("pair"))
    placed = placed.select("table", "key", "pair.low", "pair.high", "block", "size", "node", "copies", "vector", "keys")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["size", "table", "key", "low", "high"]
    sorted_rows = placed.repartition(tasks, *order).sortWithinPartitions(*order)
    found = write_once(sorted_rows.mapInArrow(_compare(threshold), _FOUND), "vector-links")

    hung = found.filter("hung_on <> node").select("node", "hung_on")
    rooted = components(hung, "node", "hung_on").withColumnRenamed("node", "rooted")
    links = found.groupBy(F.col("node").alias("linked")).agg(F.sum("links").alias("links"))
    nodes = (
        distinct.drop("vector")
        .join(signed.select(F.col("node").alias("usable")), F.col("node") == F.col("usable"), "left")
        .join(links, F.col("node") == F.col("linked"), "left")
        .join(rooted, F.col("node") == F.col("rooted"), "left")
        .select(
            "content",
            "first_id",
            F.col("usable").isNotNull().alias("usable"),
            F.coalesce("root", "node").alias("root"),
            # Copies of a vector are linked with each other.
            F.when(F.col("usable").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    nodes = write_once(nodes, "vector-components")
    smallest = nodes.groupBy(F.col("root").alias("of")).agg(F.min("first_id").alias("smallest"))
    named_nodes = nodes.join(smallest, F.col("root") == F.col("of")).select(
        F.col("content").alias("held"), "n_links", "usable", "smallest"
    )
    # Null vectors have a null digest.
    done = named.select("vec_id", "content").join(named_nodes, F.col("content").eqNullSafe(F.col("held")))
    component = F.when(F.col("usable"), F.col("smallest")).otherwise(F.col("vec_id"))
    return done.select(
        "vec_id",
        F.col("n_links").cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


#: The exact result in SQL, all pairs compared.
SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, list_transform(embedding,
    lambda x: CAST(x AS DOUBLE) / list_max(list_transform(embedding, lambda y: abs(CAST(y AS DOUBLE))))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT p.vec_id, coalesce(n, 0) AS n_links, component_id, p.vec_id = component_id AS kept
FROM parts p LEFT JOIN counts c ON p.vec_id = c.vec_id
"""
