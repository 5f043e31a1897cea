"""SimHash near-dedup with pivot distance tables.

A fingerprint's Hamming distances to sixteen reference fingerprints are computed
once, part by part.  The references are the rows of a Hadamard matrix in every
part, so the distances within a part tell its bits apart.  Fingerprints that differ
in at most ``max_bits`` bits agree on all distances within at least two parts: they
meet in the table of some pair of parts.  Where they meet, a pair is discarded when
its distances to any reference differ by more than ``max_bits`` (the triangle
inequality), and what survives is verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.llm.graph import components
from tagwright.llm.textbytes import field_names, parts_between_words, release_memory
from tagwright.session import write_once

SHINGLE = 3
MAX_BITS = 2
SEED = 42
REFERENCES = 16

#: Hashes that a task holds before it adds up their bits.
_HELD = 1 << 18

_FINGERPRINT = "row_id long, row_hash long, fingerprint long"
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def shingle_hashes(text: bytes | None, size: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of a text, in parts; a shorter text is one shingle."""
    held: list[bytes] = []
    seen = False
    for part in parts_between_words(text or b""):
        words = held + part.lower().split()
        if len(words) >= size:
            seen = True
            joined = map(b" ".join, zip(*[words[i:] for i in range(size)]))
            n = len(words) - size + 1
            yield np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, n)
        held = words[max(0, len(words) - size + 1) :] if size > 1 else []
    if not seen and held:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def _bit_counts(owner: np.ndarray, hashes: np.ndarray, owners: int) -> np.ndarray:
    """For each owner, how many of its hashes have each of the 64 bits."""
    counts = np.empty((owners, 64))
    lanes = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    for lane in range(8):
        per_value = np.bincount(owner * 256 + lanes[:, lane], minlength=owners * 256)
        counts[:, lane * 8 : lane * 8 + 8] = per_value.reshape(owners, 256) @ _BITS
    return counts


def _majority(size: int) -> Callable:
    weights = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))

    def fingerprints(texts: list) -> np.ndarray:
        counts, totals = np.zeros((len(texts), 64)), np.zeros(len(texts))
        owner, hashes, held = [], [], 0

        def add() -> None:
            nonlocal held
            if hashes:
                owners, place = np.unique(np.concatenate(owner), return_inverse=True)
                counts[owners] += _bit_counts(place, np.concatenate(hashes), len(owners))
            owner.clear(), hashes.clear()
            held = 0

        for i, text in enumerate(texts):
            for part in shingle_hashes(text, size):
                totals[i] += len(part)
                owner.append(np.full(len(part), i))
                hashes.append(part)
                held += len(part)
                if held >= _HELD:
                    add()
        add()
        bits = 2 * counts > totals[:, None]
        return (bits * weights).sum(axis=1, dtype=np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch["row_id"], batch["row_hash"], pa.array(fingerprints(texts))], names=field_names(_FINGERPRINT)
            )
        release_memory()

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(row_id, row_hash, fingerprint)`` of every document.

    A null text counts as empty, and a text without words has fingerprint 0.
    """
    if shingle < 1:
        raise ValueError(f"a shingle needs a word at least, got {shingle}")
    keyed = docs.select(F.col("doc_id").cast("long").alias("row_id"), F.xxhash64("text").alias("row_hash"), "text")
    return keyed.mapInArrow(_majority(shingle), _FINGERPRINT)


def _reference(number: int, width: int) -> int:
    """Row ``number`` of the Hadamard matrix of order 16 as ``width`` bits."""
    return sum(((number & k).bit_count() & 1) << k for k in range(width))


def _parts(max_bits: int) -> list[tuple[int, int]]:
    """Place and width of the parts; two of them at least stay equal under ``max_bits`` changes."""
    n = max(4, max_bits + 2)
    cuts = [64 * i // n for i in range(n + 1)]
    return [(low, high - low) for low, high in zip(cuts, cuts[1:])]


def pivot_table(distinct: DataFrame, max_bits: int) -> DataFrame:
    """Each fingerprint once per pair of parts: table, key, fingerprint and its 16 distances in two longs."""
    parts = _parts(max_bits)
    bits = F.col("fingerprint")

    def distance(low: int, width: int, number: int) -> Column:
        part = F.shiftrightunsigned(bits, low).bitwiseAND(F.lit((1 << width) - 1))
        return F.bit_count(part.bitwiseXOR(F.lit(_reference(number, width)))).cast("long")

    near = {(p, n): distance(low, width, n) for p, (low, width) in enumerate(parts) for n in range(REFERENCES)}
    names = {pn: f"d{pn[0]}_{pn[1]}" for pn in near}
    table = distinct.select("fingerprint", *[near[pn].alias(names[pn]) for pn in near])
    whole = [reduce(Column.__add__, [F.col(names[p, n]) for p in range(len(parts))]) for n in range(REFERENCES)]
    packed = [
        reduce(Column.bitwiseOR, [F.shiftleft(whole[8 * half + i], 8 * i) for i in range(8)]) for half in range(2)
    ]
    keys = [
        F.struct(
            F.lit(number).alias("table"),
            F.xxhash64(*[F.col(names[p, n]) for p in pair for n in range(REFERENCES)]).alias("key"),
        )
        for number, pair in enumerate(combinations(range(len(parts)), 2))
    ]
    rows = table.select("fingerprint", packed[0].alias("near"), packed[1].alias("near2"), F.array(*keys).alias("keys"))
    return rows.select(F.explode("keys").alias("at"), "fingerprint", "near", "near2").select(
        "at.table", "at.key", "fingerprint", "near", "near2"
    )


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of different fingerprints that differ in at most ``max_bits`` bits.

    A fingerprint has few possible neighbours at so small a distance, so the pairs
    stay in proportion to the fingerprints however many documents share one.
    """
    if not 0 <= max_bits <= 8:
        raise ValueError(f"between 0 and 8 differing bits can be asked for, got {max_bits}")
    table = pivot_table(distinct, max_bits)
    a, b = table.alias("a"), table.alias("b")

    def within(column: str, i: int) -> Column:
        here, there = [
            F.shiftrightunsigned(F.col(f"{side}.{column}"), 8 * i).bitwiseAND(F.lit(255)) for side in ("a", "b")
        ]
        return F.abs(here - there) <= max_bits

    meet = (F.col("a.table") == F.col("b.table")) & (F.col("a.key") == F.col("b.key"))
    survive = reduce(Column.__and__, [within(c, i) for c in ("near", "near2") for i in range(8)])
    verified = F.bit_count(F.col("a.fingerprint").bitwiseXOR(F.col("b.fingerprint"))) <= max_bits
    ordered = F.col("a.fingerprint") < F.col("b.fingerprint")
    joined = a.join(b, meet & ordered & survive & verified)
    return joined.select(F.col("a.fingerprint").alias("a"), F.col("b.fingerprint").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``(row_id, row_hash, fingerprint, root, component_id)`` of every document.

    ``root`` is the component's smallest fingerprint.
    ``component_id`` is the smallest doc_id that can be reached over links; null
    doc_ids are passed over, and null where there are no others.
    """
    marked = write_once(fingerprints(docs, shingle), "fingerprints")
    distinct = write_once(
        marked.groupBy("fingerprint").agg(F.min("row_id").alias("first_id")), "distinct-fingerprints"
    )
    found = components(links(distinct, max_bits), "a", "b")
    rooted = distinct.join(found, F.col("fingerprint") == F.col("node"), "left").select(
        F.col("fingerprint").alias("print"), "first_id", F.coalesce("root", "fingerprint").alias("root")
    )
    rooted = write_once(rooted, "rooted-fingerprints")
    smallest = rooted.groupBy(F.col("root").alias("of")).agg(F.min("first_id").alias("component_id"))
    named = rooted.join(smallest, F.col("root") == F.col("of")).select("print", "root", "component_id")
    return marked.join(named, F.col("fingerprint") == F.col("print")).drop("print")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint in hexadecimal and component_id."""
    hexadecimal = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return near_duplicates(docs).select(
        F.col("row_id").alias("doc_id"), hexadecimal.alias("fingerprint"), "component_id"
    )


def first_of_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents with one of each group: the row of the smallest doc_id.

    Of rows that share that doc_id the one with the smallest text hash stays, and
    one of equal rows.  A group in which every doc_id is null keeps one row.
    """
    found = near_duplicates(docs, shingle, max_bits)
    first = F.col("row_id").eqNullSafe(F.col("component_id"))
    chosen = (
        found.filter(first)
        .groupBy("row_id", F.when(F.col("row_id").isNull(), F.col("root")).alias("of"))
        .agg(F.min("row_hash").alias("row_hash"), F.count(F.lit(1)).alias("rows"))
    )
    chosen = write_once(
        chosen.select(F.col("row_id").alias("_kept_id"), F.col("row_hash").alias("_kept_hash"), (F.col("rows") > 1).alias("_twice")),
        "first-rows",
    )
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_kept_id")) & (F.xxhash64("text") == F.col("_kept_hash"))
    names = docs.columns
    kept = docs.join(chosen.filter(~F.col("_twice")).drop("_twice"), same, "left_semi")
    if chosen.filter("_twice").isEmpty():
        return kept
    doubled = docs.join(chosen.filter("_twice").drop("_twice"), same, "inner").dropDuplicates(["_kept_id", "_kept_hash"])
    return kept.unionByName(doubled.select(*[F.col(f"`{n}`") for n in names]))
