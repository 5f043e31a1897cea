"""Prefix trie of conversations from vertical bitmaps.

Conversations are dealt to shards by ranges of their ids.  A shard indexes
``(position, turn)`` to the bitset of its conversations that have the turn there, and
walks the trie depth first: a node's bitset intersected with the postings of the next
position gives its children, a popcount its members, and the bits that have no further
turn the list of conversations that end there.  Nodes are named by a digest of the turns
that lead to them, by which Spark adds up what several shards know of one node.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagwright.session import write_once

#: Conversations and turns of a shard, about; a longer conversation is a shard of its own.
SHARD_CONVERSATIONS = 2048
SHARD_TURNS = 1 << 16
#: Turns that a task of the walk gets, about.
TASK_TURNS = 1 << 18
#: Conversations whose ids agree but for the rest of a division by this form a family.
FAMILY = 5
#: A rebuilt conversation starts with fewer turns than this of its family's first one.
HEADS = 9

_WIDTH = 16
_ROOT = bytes(_WIDTH)
#: Rows in one batch of nodes.
_BATCH = 20_000

_NODES = pa.schema(
    [
        ("key", pa.binary()),
        ("depth", pa.int64()),
        ("up", pa.list_(pa.binary())),
        ("n_bytes", pa.int64()),
        ("n_convs", pa.int64()),
        ("conv_id", pa.int64()),
        ("ends", pa.string()),
        ("first_end", pa.int64()),
        ("ends_sha256", pa.string()),
    ]
)
_NODES_DDL = (
    "key binary, depth long, up array<binary>, n_bytes long, n_convs long, conv_id long, ends string, first_end long, ends_sha256 string"
)


class Conversation(NamedTuple):
    """Digests of the turns, one after the other, and the bytes of each turn's text."""

    conv_id: int
    turns: bytes
    sizes: array


def _bits(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def walk(shard: list[Conversation]) -> Iterator[tuple]:
    """The nodes of a shard's trie, depth first, as rows of ``_NODES``."""
    shard = sorted(shard, key=itemgetter(0))
    postings: dict[tuple[int, bytes], int] = {}
    # Conversations by their number of turns.
    ended: dict[int, int] = {}
    for i, c in enumerate(shard):
        bit = 1 << i
        for position in range(len(c.sizes)):
            at = position, c.turns[_WIDTH * position : _WIDTH * (position + 1)]
            postings[at] = postings.get(at, 0) | bit
        ended[len(c.sizes)] = ended.get(len(c.sizes), 0) | bit
    path = bytearray()
    stack = [((1 << len(shard)) - 1, 0, b"", 0)] if shard else []
    while stack:
        members, depth, turn, size = stack.pop()
        del path[_WIDTH * depth :]
        path += hashlib.blake2b(path[-_WIDTH:] + turn, digest_size=_WIDTH).digest() if depth else _ROOT
        up, distance = [], 1
        while distance <= depth:
            at = _WIDTH * (depth - distance)
            up.append(bytes(path[at : at + _WIDTH]))
            distance *= 2
        here = members & ended.get(depth, 0)
        ids = [shard[i].conv_id for i in _bits(here)]
        ends = ",".join(map(str, ids))
        first = (members & -members).bit_length() - 1
        yield (
            bytes(path[-_WIDTH:]), depth, up, size, members.bit_count(), shard[first].conv_id,
            *((ends, ids[0], hashlib.sha256(ends.encode()).hexdigest()) if ids else (None, None, None)),
        )
        rest = members ^ here
        while rest:
            first = (rest & -rest).bit_length() - 1
            turn = shard[first].turns[_WIDTH * depth : _WIDTH * (depth + 1)]
            child = members & postings[depth, turn]
            stack.append((child, depth + 1, turn, shard[first].sizes[depth]))
            rest &= ~child


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch[c].to_pylist() for c in ("base", "conv_id", "head", "digest", "n_bytes")])


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Conversation]]:
    """The conversations of each family; rows come family by family, its first conversation before the others."""
    for base, rows in groupby(_rows(batches), key=itemgetter(0)):
        family, lead_turns, lead_sizes = [], b"", array("q")
        for conv_id, own in groupby(rows, key=itemgetter(1)):
            turns, sizes = bytearray(), array("q")
            for _, _, head, digest, n_bytes in own:
                turns += digest
                sizes.append(n_bytes)
            if conv_id == base:
                lead_turns, lead_sizes = bytes(turns[: _WIDTH * HEADS]), sizes[:HEADS]
            elif head:
                turns = lead_turns[: _WIDTH * head] + turns[_WIDTH * head :]
                sizes = lead_sizes[:head] + sizes[head:]
            family.append(Conversation(conv_id, bytes(turns), sizes))
        yield family


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Conversation]]:
    shard: list[Conversation] = []
    turns = 0
    for family in _families(batches):
        more = sum(len(c.sizes) for c in family)
        if shard and (len(shard) + len(family) > SHARD_CONVERSATIONS or turns + more > SHARD_TURNS):
            yield shard
            shard, turns = [], 0
        shard += family
        turns += more
    if shard:
        yield shard


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for shard in _shards(batches):
        for row in walk(shard):
            held.append(row)
            if len(held) == _BATCH:
                yield _batch(held)
                held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), _NODES.types)]
    return pa.RecordBatch.from_arrays(columns, schema=_NODES)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest over the lists of each node, which come one after the other; no list is held beside the running digest."""
    key = digest = None
    for batch in batches:
        keys, found = [], []
        for own, ends in zip(batch["key"].to_pylist(), batch["ends"].to_pylist()):
            if own != key:
                if key is not None:
                    keys.append(key)
                    found.append(digest.hexdigest())
                key, digest = own, hashlib.sha256(ends.encode())
            else:
                digest.update(b"," + ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["of", "all_ends"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["of", "all_ends"])


def _sorted_turns(conversations: DataFrame, rebuild: bool) -> DataFrame:
    """A digest per turn instead of its text, family by family in ranges of ids."""
    conv_id = F.col("conv_id").cast("long")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    head = F.crc32(conv_id.cast("string").cast("binary")) % HEADS if rebuild else F.lit(0)
    turns = conversations.select(
        conv_id.alias("conv_id"),
        # The rest has the sign of the id.
        (conv_id - conv_id % FAMILY if rebuild else conv_id).alias("base"),
        head.cast("int").alias("head"),
        F.col("turn"),
        F.substring(F.unhex(F.sha2(content, 256)), 1, _WIDTH).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    ).filter("conv_id is not null")
    tasks = max(turns.sparkSession.sparkContext.defaultParallelism, -(-conversations.count() // TASK_TURNS))
    order = ["base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "digest"]
    return turns.repartitionByRange(tasks, "base").sortWithinPartitions(*order)


def trie(conversations: DataFrame, rebuild: bool = False) -> DataFrame:
    """A row per node: ``key`` (a digest of the turns that lead there) and the columns of ``digest``.

    Turns are ordered by ``turn``, null first, and equal ones by a digest of role and
    text; null roles and texts are empty ones.  Rows of one conversation and turn are
    turns one after the other.  Rows without a conv_id belong to no conversation, and
    an empty table has no nodes.  With ``rebuild`` every conversation c starts with
    the first crc32(c) % 9 turns of conversation c - c % 5 in place of its own.
    """
    walked = write_once(_sorted_turns(conversations, rebuild).mapInArrow(_walk, _NODES_DDL), "trie-shards")
    nodes = write_once(
        walked.groupBy("key").agg(
            F.first("depth").alias("depth"),
            F.first("up").alias("up"),
            F.first("n_bytes").alias("n_bytes"),
            F.sum("n_convs").alias("n_convs"),
            F.min("conv_id").alias("conv_id"),
            F.count("first_end").alias("lists"),
            F.min("ends_sha256").alias("ends_sha256"),
        ),
        "trie-nodes",
    )
    shared = _summed(nodes, walked)
    # A node with one member has that member's chain below it.
    alone = nodes.filter("n_convs = 1").select(
        *_OWN, (1 - F.col("lists")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"),
    )
    # The parent of a node with one member has the same one, unless it is shared.
    parents = shared.select(F.col("key").alias("of"), F.col("conv_id").alias("shared_by"))
    both = shared.unionByName(alone).join(parents, F.get("up", 0) == F.col("of"), "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("shared_by", "conv_id"))
    return both.select("key", *_digest_columns(parent))


_OWN = ["key", "depth", "up", "n_convs", "conv_id"]
_NONE = hashlib.sha256(b"").hexdigest()


def _digest_columns(parent: Column | str) -> list:
    parent = F.col(parent) if isinstance(parent, str) else parent
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    return ["conv_id", "depth", parent.alias("parent_conv_id"), *sums, "ends_sha256"]


def _summed(nodes: DataFrame, walked: DataFrame) -> DataFrame:
    """The nodes with several members, with sums over their subtrees and the digest of all their ends.

    A sum over a subtree doubles its reach in each round: what is summed up within a
    distance of 2^k is handed to the ancestor 2^k above, which every node names.
    """
    below = nodes.filter("depth > 0").groupBy(F.get("up", 0).alias("of")).agg(
        F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("chains")
    )
    several = nodes.filter("lists > 1").select(F.col("key").alias("listed"))
    lists = walked.filter("first_end is not null").select("key", "first_end", "ends")
    lists = lists.join(several, F.col("key") == F.col("listed"), "left_semi")
    # Ids of different shards are in different ranges.
    joined = lists.repartition("key").sortWithinPartitions("key", "first_end").mapInArrow(_joined, "of binary, all_ends string")
    many = nodes.filter("n_convs > 1").join(below, F.col("key") == F.col("of"), "left").drop("of")
    many = many.join(joined, F.col("key") == F.col("of"), "left").drop("of")
    children = F.coalesce("n_children", F.lit(0))
    many = write_once(
        many.select(
            *_OWN,
            children.alias("n_children"),
            # Below a child with one member there is one leaf.
            F.when(children == 0, 1).otherwise(F.col("chains")).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"),
            F.coalesce("all_ends", "ends_sha256", F.lit(_NONE)).alias("ends_sha256"),
        ),
        "trie-shared",
    )
    deepest = many.agg(F.max("depth")).first()[0] or 0
    for level in range(int(deepest).bit_length()):
        handed = many.filter(F.col("depth") >= 1 << level).groupBy(F.get("up", level).alias("of")).agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_tokens")
        )
        many = many.join(handed, F.col("key") == F.col("of"), "left").select(
            *_OWN,
            "n_children",
            (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("more_tokens", F.lit(0))).alias("saved_tokens"),
            "ends_sha256",
        )
        many = write_once(many, f"trie-sums-{level}")
    return many


def digest(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves and
    saved_tokens over the subtree, and the digest of the ids that end there.
    """
    return trie(conversations, rebuild=True).select(*_digest_columns("parent_conv_id"))


#: The same nodes in SQL, with whole prefixes as keys.
SQL = """
WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
heads AS (
  SELECT c, c - c % 5 AS base, CAST(xor(list_reduce(
    list_concat([CAST(4294967295 AS UBIGINT)], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
    lambda crc, byte: list_reduce(
      list_concat([xor(crc, byte)], list_transform(range(8), lambda i: CAST(i AS UBIGINT))),
      lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS UBIGINT)) ELSE v >> 1 END)
    ), CAST(4294967295 AS UBIGINT)) % 9 AS BIGINT) AS h FROM ids),
filled AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
named AS (SELECT *, sha256(concat(length(role), ':', role, text)) AS name FROM filled),
turns AS (
  SELECT conv_id, name, strlen(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, name) AS p FROM named),
rebuilt AS (
  SELECT c, 0 AS own, p, name, n FROM heads JOIN turns ON conv_id = base WHERE p <= h
  UNION ALL SELECT c, 1, p, name, n FROM heads JOIN turns ON conv_id = c WHERE p > h),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d FROM rebuilt),
paths AS (
  SELECT c, d, n, array_to_string(list(name) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING), '/') AS path FROM placed
  UNION ALL SELECT c, 0, 0, '' FROM ids),
lengths AS (SELECT c, max(d) AS d FROM paths GROUP BY c),
nodes AS (
  SELECT path, p.d, min(p.c) AS conv_id, count(*) AS n_convs, max(n) AS n_bytes,
    sha256(coalesce(string_agg(CASE WHEN l.d = p.d THEN CAST(p.c AS VARCHAR) END, ',' ORDER BY p.c), '')) AS ends_sha256
  FROM paths p JOIN lengths l ON p.c = l.c GROUP BY path, p.d),
ups AS (SELECT DISTINCT a.path AS parent, b.path AS child FROM paths a JOIN paths b ON a.c = b.c AND b.d = a.d + 1),
fans AS (SELECT parent, count(*) AS n_children FROM ups GROUP BY parent),
pairs AS (SELECT DISTINCT a.path AS top, b.path AS path FROM paths a JOIN paths b ON a.c = b.c AND b.d >= a.d),
sums AS (
  SELECT top, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n_convs - 1) * n_bytes) AS saved_tokens
  FROM pairs JOIN nodes USING (path) LEFT JOIN fans ON parent = path GROUP BY top)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs,
  CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums ON top = n.path LEFT JOIN fans f ON f.parent = n.path
LEFT JOIN ups u ON u.child = n.path LEFT JOIN nodes up ON up.path = u.parent
"""
