"""Sharding by histogram sort: exact byte counts below probe keys, refined until the splitters fit.

Documents are ordered by the hash of their text, then of their id, then by their
place, so that equal texts are neighbours and still no run of them is indivisible.
Each round counts bytes and rows between probes that divide the unresolved stretches
of the key space, until every splitter is as near its target as the tolerance asks or
no more than one document lies between.  Then the rows are exchanged once, each to the
task whose splitters enclose its key: a shard takes several tasks where there are more
tasks than shards, divided by further, coarser splitters.  The driver holds a splitter
per task and at most ``COUNTS`` counts, or two per splitter if there are more of those.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.session import small_frame, write_once

SHARDS = 16
#: Bytes that a splitter may be off its target, as a share of a shard.
TOLERANCE = 0.002
#: The same where that keeps a group of equal texts whole.
GROUP_TOLERANCE = 0.02
#: Bytes that a splitter between two tasks of one shard may be off, as a share of a task.
TASK_TOLERANCE = 0.1
#: Bits of the key that a round resolves, fewer where that makes more than ``COUNTS`` parts.
DIGIT = 10
COUNTS = 1 << 17

_KEYS = ("by_text", "by_id", "by_place")
_BITS = 64 * len(_KEYS)
_HALF = 1 << 63


class _Stretch(NamedTuple):
    """Keys that share their first ``bits`` bits, and the bytes below them."""

    prefix: int
    bits: int
    below: int


def _digits(prefix: int, bits: int) -> list[tuple[str, int, int]]:
    """For a prefix, each key column with the signed value of its leading bits and how many they are."""
    out = []
    for i, name in enumerate(_KEYS):
        width = min(64, bits - 64 * i)
        if width <= 0:
            break
        value = prefix >> (bits - 64 * i - width) & ((1 << width) - 1)
        out.append((name, value - (1 << width - 1), width))
    return out


def _leading(name: str, width: int) -> Column:
    return F.shiftright(F.col(name), 64 - width)


def _within(stretch: _Stretch) -> Column:
    same = [_leading(name, width) == F.lit(value) for name, value, width in _digits(stretch.prefix, stretch.bits)]
    return reduce(Column.__and__, same, F.lit(True))


def _counts(keyed: DataFrame, stretches: list[_Stretch], width: int) -> dict[int, tuple[int, int]]:
    """Bytes and rows of every part of the stretches, by the part's prefix, ``width`` bits longer."""
    bits = stretches[0].bits
    last = bits // 64
    more = bits % 64 + width
    if 0 < bits <= 64:  # a look-up in a set, however many stretches there are
        values = {_digits(s.prefix, bits)[0][1] for s in stretches}
        within = _leading(_KEYS[0], bits).isin(sorted(values))
    else:
        within = reduce(Column.__or__, [_within(s) for s in {s.prefix: s for s in stretches}.values()])
    parts = [F.col(name) for name in _KEYS[:last]] + [_leading(_KEYS[last], more)]
    names = [f"p{i}" for i in range(len(parts))]
    rows = (
        keyed.filter(within)
        .groupBy(*[p.alias(n) for p, n in zip(parts, names)])
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        .collect()
    )
    out = {}
    for row in rows:
        prefix = 0
        for i, name in enumerate(names):
            own = 64 if i < last else more
            prefix = prefix << own | row[name] + (1 << own - 1)
        out[prefix] = (int(row["bytes"]), row["rows"])
    return out


def splitters(keyed: DataFrame, shards: int, tolerance: float, group_tolerance: float, parts: int = 1) -> list[int]:
    """The first key of each part but the first, as numbers of 192 bits, ``parts`` parts to a shard.

    Every ``parts``-th of them parts two shards and is as near its target as the
    tolerances ask; the others part tasks, to ``TASK_TOLERANCE`` of a part.  They do
    not fall, whatever the tolerances.
    """
    total = int(keyed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"])
    pieces = shards * parts
    targets = [total * k // pieces for k in range(1, pieces)]
    found: dict[int, int] = {}
    open_: dict[int, _Stretch] = {k: _Stretch(0, 0, 0) for k in range(len(targets))} if total else {}
    while open_:
        stretches = list(open_.values())
        bits = stretches[0].bits
        apart = len({s.prefix for s in stretches})
        width = min(64 - bits % 64, DIGIT, max(1, (COUNTS // apart).bit_length() - 1))
        counts = _counts(keyed, stretches, width)
        found_in: dict[int, list[tuple[int, int, int]]] = {}
        for prefix, (size, rows) in sorted(counts.items()):
            found_in.setdefault(prefix >> width, []).append((prefix, size, rows))
        bits += width
        left = {}
        for k, stretch in open_.items():
            below = stretch.below
            for prefix, size, rows in found_in[stretch.prefix]:
                if below + size > targets[k]:
                    break
                below += size
            # The target lies in this part: at its first key, after its last, or further inside.
            before, after = targets[k] - below, below + size - targets[k]
            if (k + 1) % parts:
                allowed = total / pieces * TASK_TOLERANCE
            else:
                allowed = total / shards * (group_tolerance if bits == 64 else tolerance)
            if rows == 1 or min(before, after) <= allowed or bits == _BITS:
                found[k] = (prefix + (after < before)) << (_BITS - bits)
            else:
                left[k] = _Stretch(prefix, bits, below)
        open_ = left
    cuts = [found.get(k, 1 << _BITS) for k in range(len(targets))]
    # A task's splitter that passed its shard's ends is moved back to them.
    between_shards = [0, *cuts[parts - 1 :: parts], 1 << _BITS]
    held = [min(max(cut, between_shards[k // parts]), between_shards[k // parts + 1]) for k, cut in enumerate(cuts)]
    return list(accumulate(held, max))


def _at_or_after(splitter: int) -> Column:
    """Whether a row's key is not below the splitter."""
    if splitter >> _BITS:
        return F.lit(False)
    values = [(splitter >> (_BITS - 64 * (i + 1)) & ((1 << 64) - 1)) - _HALF for i in range(len(_KEYS))]
    reached = F.lit(True)
    for name, value in reversed(list(zip(_KEYS, values))):
        reached = (F.col(name) > F.lit(value)) | ((F.col(name) == F.lit(value)) & reached)
    return reached


def _piece(cuts: list[int], low: int, high: int) -> Column:
    """How many of the splitters a row's key has reached, by halving."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(_at_or_after(cuts[middle]), _piece(cuts, middle + 1, high)).otherwise(_piece(cuts, low, middle))


def assigned(
    docs: DataFrame,
    shards: int = SHARDS,
    tolerance: float = TOLERANCE,
    group_tolerance: float = GROUP_TOLERANCE,
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document; sizes of shards are near equal.

    The size is the bytes of the text, none for a null text, plus 1.  The checksum
    of a null text is null.  Null and repeated ids are rows like any other.  Slots
    number a shard's rows in key order from 0.
    """
    if shards < 1:
        raise ValueError(f"a shard is needed at least, got {shards}")
    measured = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32("text").alias("text_crc32"),
        F.xxhash64("text").alias("by_text"),
        F.xxhash64("doc_id").alias("by_id"),
        F.xxhash64(F.monotonically_increasing_id()).alias("by_place"),
    )
    # Places differ from run to run, so they are written before they are used.
    keyed = write_once(measured, "sharding-keys")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-tasks // shards))
    cuts = splitters(keyed, shards, tolerance, group_tolerance, parts)
    exchanged = (
        keyed.withColumn("piece", _piece(cuts, 0, len(cuts)))
        .repartitionById(shards * parts, "piece")
        .sortWithinPartitions("piece", *_KEYS)
    )
    # The id that Spark gives is the task's number and the row's place in the task.
    shard = F.floor(F.col("piece") / parts).cast("int").alias("shard")
    placed = write_once(
        exchanged.select("doc_id", "size", "text_crc32", shard, F.monotonically_increasing_id().alias("at")), "sharded"
    )
    task = F.shiftright(F.col("at"), 33)
    firsts = placed.groupBy(task.alias("task"), F.col("shard").alias("of")).agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("rows")
    )
    # One row per task and shard that meet: about as many as there are tasks.
    offsets, at = [], {}
    for row in sorted(firsts.collect()):
        offsets.append((row["task"], row["of"], at.get(row["of"], 0) - row["first"]))
        at[row["of"]] = at.get(row["of"], 0) + row["rows"]
    offset = small_frame(docs.sparkSession, offsets, "task long, of int, ahead long")
    met = (task == F.col("task")) & (F.col("shard") == F.col("of"))
    joined = placed.join(F.broadcast(offset), met)
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("ahead")).alias("slot"))


def digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The assignment with the law it keeps; the law of sizes has no shard to grow by."""
    return assigned(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
