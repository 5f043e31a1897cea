"""Language-model scores by context-tree weighting.

Every byte is eight binary decisions.  Each decision has a tree of contexts, the last
0 to ``DEPTH`` bytes, and every node of it estimates the bit by Krichevsky and Trofimov's
rule.  A node's weighted probability is half its own estimate and half the product of
its children's, so that a prediction mixes the estimates of all depths by how well each
depth has coded the training texts.

Texts are packed into blocks once.  A block asks for its different strings of a context
and a byte, of which it has few, and counts those of its training texts; what all
blocks ask for is added up in buckets by hash.  The different strings are sorted by
context, their trees are computed below every pair of bytes on its own, and the two
levels above are small by the alphabet.  Buckets answer every block with a code length
per string asked for, and the block adds them up per text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.llm.textbytes import field_names, mix, release_memory
from tagwright.session import write_once

#: Bytes of context; with the byte itself and its text's place in a part they fill 64 bits.
DEPTH = 6
#: Bytes of text in a block, about, and texts in it at most.
BLOCK_BYTES = 24 << 20
BLOCK_TEXTS = 1 << 20
#: Bytes of text that are worked on at a time, about, and texts at most.
PART_BYTES = 2 << 20
PART_TEXTS = 1 << 8
#: Bytes of text for each bucket of strings, and buckets at most; strings grow far slower than texts.
BUCKET_BYTES = 16 << 20
BUCKETS = 4096
#: Strings that a task gets, and that are worked on at a time.
TASK_STRINGS = 1 << 20
SEGMENT_STRINGS = 1 << 18
#: Remainder of crc32(doc_id as text) by 5 of the texts that are not learnt from.
HELD_OUT = 1

#: Token that ends every text; no word has a line end.
END = b"\n"
_PAST = END * DEPTH


# --- packing --------------------------------------------------------------------


def _zip(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def _unzip(data: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(data, decompressed_size=size, asbytes=True) if size else b""


def pack(values: np.ndarray) -> bytes:
    """Nonnegative whole numbers, byte plane by byte plane."""
    return _zip(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(_unzip(data, 8 * n), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(n)


def _pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=0))


def _unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(data, n))


def tokens_of(text: str | None) -> bytes:
    """A text as its lower-case words, a blank between each two, and the end."""
    return b" ".join((text or "").encode().lower().split()) + END


def _cut(data: bytes, limit: int) -> Iterator[tuple[int, int]]:
    """Parts of a long text that end behind a blank; a word is never cut."""
    at = 0
    while len(data) - at > limit:
        end = data.rfind(b" ", at, at + limit) + 1 or data.find(b" ", at + limit) + 1
        if not end:
            break
        yield at, end
        at = end
    yield at, len(data)


_BLOCK = (
    "block long, size long, rows array<long>, doc_ids array<long>, held array<boolean>, starts array<long>, ends array<long>, data binary"
)


class _Block:
    """Texts gathered until there are enough; each has the bytes before it in front."""

    def __init__(self, number: int):
        self.number = number
        self.size = 0
        self.pieces: list[bytes] = []
        self.columns: tuple[list, ...] = ([], [], [], [], [])

    def add(self, row: int | None, doc_id: int | None, held: bool, past: bytes, data: bytes) -> int:
        """The row's name: that of its first piece."""
        row = self.number * BLOCK_TEXTS + len(self.columns[0]) if row is None else row
        start = self.size + len(past)
        self.pieces += [past, data]
        self.size = start + len(data)
        for column, value in zip(self.columns, (row, doc_id, held, start, self.size)):
            column.append(value)
        return row

    def batch(self) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
        lists = [pa.array([c], pa.list_(t)) for c, t in zip(self.columns, types)]
        data = _zip(b"".join(self.pieces))
        return pa.RecordBatch.from_arrays(
            [pa.array([self.number]), pa.array([self.size]), *lists, pa.array([data], pa.binary())], names=field_names(_BLOCK)
        )


def _pack_texts(block_bytes: int) -> Callable:
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(TaskContext.get().partitionId() << 20)
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, held = batch["doc_id"][i].as_py(), batch["held"][i].as_py()
                data = tokens_of(batch["text"][i].as_py())
                row, past = None, _PAST
                for start, end in _cut(data, PART_BYTES):
                    if block.size and (block.size + end - start > block_bytes or len(block.columns[0]) == BLOCK_TEXTS):
                        yield block.batch()
                        block = _Block(block.number + 1)
                    row = block.add(row, doc_id, held, past, data[start:end])
                    past = (_PAST + data[:end] if end < DEPTH else data[end - DEPTH : end])[-DEPTH:]
        if block.size:
            yield block.batch()
        release_memory()

    return packed


# --- strings and tokens of a block ------------------------------------------------


class Part(NamedTuple):
    """Some neighbouring texts of a block: its first one, its bytes, and where each text starts and ends in them."""

    first: int
    data: bytes
    starts: np.ndarray
    ends: np.ndarray


def _parts(row: dict) -> Iterator[Part]:
    data = _unzip(row["data"], row["size"])
    starts, ends = np.array(row["starts"], np.int64), np.array(row["ends"], np.int64)
    at = 0
    while at < len(starts):
        low = int(starts[at]) - DEPTH
        end = max(at + 1, min(at + PART_TEXTS, int(np.searchsorted(ends, low + PART_BYTES, side="right"))))
        yield Part(at, data[low : int(ends[end - 1])], starts[at:end] - low, ends[at:end] - low)
        at = end


class Strings(NamedTuple):
    """Different strings in order; and of every occurrence, sorted alike, the string's rank and its text.

    A string is a byte, lowest, below its context, the byte right before it on top.
    """

    keys: np.ndarray
    rank: np.ndarray
    text: np.ndarray


def strings_of(part: Part) -> Strings:
    every = np.frombuffer(part.data + b"\0\0", np.uint8)
    n = len(every) - 2 - DEPTH
    # Eight bytes from the farthest of the context on, the lowest first; only the context stays.
    keys = np.ndarray((n,), np.dtype("<u8"), buffer=every, strides=(1,)) << np.uint64(16)
    # Bytes in front of a text are context only.
    edges = np.zeros(len(every) + 1, np.int8)
    edges[part.starts] += 1
    edges[part.ends] -= 1
    real = np.cumsum(edges[:-1], dtype=np.int8)[DEPTH : DEPTH + n].astype(bool)
    keys = keys[real]
    low = every[DEPTH : DEPTH + n][real].astype(np.uint16) << np.uint16(8)
    low |= np.repeat(np.arange(len(part.starts), dtype=np.uint16), part.ends - part.starts)
    keys |= low
    keys.sort()
    text = (keys & np.uint64(PART_TEXTS - 1)).astype(np.uint8)
    keys >>= np.uint64(8)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return Strings(keys[new].astype(np.int64), np.cumsum(new, dtype=np.int32) - 1, text)


class Tokens(NamedTuple):
    """Different tokens of a block, bucket by bucket and in order within one; and each part's tokens as places among them."""

    tokens: list[bytes]
    bounds: np.ndarray
    places: list[np.ndarray]
    texts: list[np.ndarray]


def tokens_by_bucket(parts: list[Part], buckets: int) -> Tokens:
    coded, texts = [], []
    for part in parts:
        found: list[bytes] = []
        sizes = []
        for start, end in zip(part.starts.tolist(), part.ends.tolist()):
            piece = part.data[start:end]
            before = len(found)
            found += piece.split()
            if piece.endswith(END):
                found.append(END)
            sizes.append(len(found) - before)
        coded.append(pa.array(found, pa.large_binary()).dictionary_encode())
        texts.append(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes))
    # The parts' own tokens once more, for those of the block.
    whole = pa.concat_arrays([c.dictionary for c in coded]).dictionary_encode()
    of = whole.indices.to_numpy(zero_copy_only=False)
    different = whole.dictionary.to_pylist()
    bucket = np.fromiter((bucket_of(t, buckets) for t in different), np.int64, len(different))
    order = np.array(sorted(range(len(different)), key=different.__getitem__), np.int64)
    order = order[np.argsort(bucket[order], kind="stable")]
    back = np.empty(len(order), np.int32)
    back[order] = np.arange(len(order))
    places, at = [], 0
    for c in coded:
        mine = back[of[at : at + len(c.dictionary)]]
        places.append(mine[c.indices.to_numpy(zero_copy_only=False)])
        at += len(c.dictionary)
    return Tokens([different[i] for i in order.tolist()], np.searchsorted(bucket[order], np.arange(buckets + 1)), places, texts)


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the strings, bucket by bucket and in order within one, and where each bucket starts.

    Strings with the same last four bytes of context share a bucket, so that those of a bucket lie close.
    """
    bucket = (mix((keys >> 8 * (DEPTH - 3)).astype(np.uint64)) >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket.astype(np.uint16), kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))


def bucket_of(token: bytes, buckets: int) -> int:
    return zlib.crc32(token) % buckets


#: Rows that go to the buckets: code lengths of strings (kind 0), counts of tokens (1), what a block asks for (2).
_ASKED = (
    "bucket int, kind int, block long, n_keys long, keys binary, key_values binary, n_tokens long, tokens binary, token_values binary"
)


def _asked(bucket, kind, block, keys, key_values, tokens, token_values) -> pa.RecordBatch:
    values = [bucket, kind, block, len(keys), _pack_sorted(keys), key_values, len(tokens), _joined(tokens), token_values]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=field_names(_ASKED))


def _joined(tokens: list[bytes]) -> bytes:
    data = b" ".join(tokens)
    return len(data).to_bytes(8, "little") + _zip(data) if tokens else b""


def _tokens(data: bytes) -> list[bytes]:
    return _unzip(data[8:], int.from_bytes(data[:8], "little")).split(b" ") if data else []


def _ask(buckets: int) -> Callable:
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            learnt = ~np.array(row["held"], bool)
            parts = list(_parts(row))
            mine = [learnt[p.first : p.first + len(p.starts)] for p in parts]
            strings = _Sums()
            for part, some in zip(parts, mine):
                s = strings_of(part)
                strings.add(s.keys, np.bincount(s.rank, weights=some[s.text], minlength=len(s.keys)).astype(np.int64))
            keys, n = strings.done()
            order, bounds = _by_bucket(keys, buckets)
            t = tokens_by_bucket(parts, buckets)
            held = np.zeros(len(t.tokens), np.int64)
            for place, text, some in zip(t.places, t.texts, mine):
                held += np.bincount(place, weights=some[text], minlength=len(held)).astype(np.int64)
            for b in range(buckets):
                some, c, d = order[bounds[b] : bounds[b + 1]], t.bounds[b], t.bounds[b + 1]
                if len(some) or d > c:
                    yield _asked(b, 2, row["block"], keys[some], pack(n[some]), t.tokens[c:d], pack(held[c:d]))
        release_memory()

    return asked


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


# --- adding up in buckets -----------------------------------------------------------


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return np.flatnonzero(new)


class _Sums:
    """Different strings in order, and sums of their counts.

    A count travels in the lowest byte below its string, several times where it is
    larger, so that one sort of plain numbers brings them together.
    """

    def __init__(self) -> None:
        self.keys, self.totals = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        small = (keys.astype(np.uint64) << np.uint64(8)) | np.minimum(counts, 255).astype(np.uint64)
        large = np.flatnonzero(counts > 255)
        if len(large):
            whole, rest = np.divmod(counts[large] - 255, 255)
            more = np.repeat(keys[large].astype(np.uint64) << np.uint64(8) | np.uint64(255), whole)
            small = np.concatenate([small, more, (keys[large].astype(np.uint64) << np.uint64(8)) | rest.astype(np.uint64)])
        self.waiting.append(small)
        self.held += len(small)
        if self.held > len(self.keys) + 8 * SEGMENT_STRINGS:
            self.done()

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        if self.held:
            every = np.concatenate([self.keys.astype(np.uint64) << np.uint64(8), *self.waiting])
            every.sort()
            keys = (every >> np.uint64(8)).astype(np.int64)
            first = _starts(keys)
            totals = np.add.reduceat((every & np.uint64(255)).astype(np.int64), first)
            keys = keys[first]
            totals[np.searchsorted(keys, self.keys)] += self.totals
            self.keys, self.totals, self.waiting, self.held = keys, totals, [], 0
        return self.keys, self.totals


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = _starts(keys)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


_MERGED = "bucket int, n_keys long, keys binary, counts binary, n_tokens long, tokens binary, token_counts binary, known long, total long"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per bucket with all that blocks ask for; blocks come one by one."""
    for bucket, rows in groupby(_each(batches), key=itemgetter("bucket")):
        strings = _Sums()
        tokens: dict[bytes, int] = {}
        for row in rows:
            strings.add(_unpack_sorted(row["keys"], row["n_keys"]), unpack(row["key_values"], row["n_keys"]))
            for token, n in zip(_tokens(row["tokens"]), unpack(row["token_values"], row["n_tokens"]).tolist()):
                tokens[token] = tokens.get(token, 0) + n
        every, n = strings.done()
        found = np.fromiter(tokens.values(), np.int64, len(tokens))
        values = [bucket, len(every), _pack_sorted(every), pack(n), len(tokens), _joined(list(tokens)), pack(found)]
        values += [int((found > 0).sum()), int(found.sum())]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=field_names(_MERGED)).cast(_MERGED_SCHEMA)
    release_memory()


_MERGED_SCHEMA = pa.schema(
    [(name, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[kind]) for name, kind in (f.split() for f in _MERGED.split(","))]
)


def _string_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _each(batches):
        keys, counts = _unpack_sorted(row["keys"], row["n_keys"]), unpack(row["counts"], row["n_keys"])
        for at in range(0, len(keys), SEGMENT_STRINGS):
            part = keys[at : at + SEGMENT_STRINGS]
            pair = part >> 8 * (DEPTH - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair), pa.array(part), pa.array(counts[at : at + SEGMENT_STRINGS]), pa.array(np.full(len(part), row["bucket"], np.int32))],
                names=field_names(_STRINGS),
            )


_STRINGS = "pair long, key long, n long, bucket int"


# --- trees ----------------------------------------------------------------------------

_FEW = 1 << 12
_HALVES = np.array([math.lgamma(i + 0.5) for i in range(_FEW)])
_WHOLES = np.array([math.lgamma(i + 1.0) for i in range(_FEW)])


def _lgamma(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    out = table[np.minimum(n, _FEW - 1)]
    large = n >= _FEW
    if large.any():
        z = n[large] + shift
        out[large] = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3)
    return out


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones in some order."""
    return _lgamma(zeros, _HALVES, 0.5) + _lgamma(ones, _HALVES, 0.5) - _lgamma(zeros + ones, _WHOLES, 1.0) - math.log(math.pi)


def log_weighted(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, children) - math.log(2)


def share_of_own(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Weight of a node's own estimate in its predictions, after what it has coded."""
    return 1 / (1 + np.exp(np.clip(children - own, -700, 700)))


def next_one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1.0)


class Level(NamedTuple):
    """Nodes of one depth for one bit of the byte: their names in order, and the bits that followed."""

    names: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray


def _levels(keys: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Different (context, byte) of every depth from 2 on, and their counts."""
    out = [(keys, counts)]
    for _ in range(DEPTH - 2):
        keys, counts = _added((keys >> 16 << 8) | (keys & 255), counts)
        out.append((keys, counts))
    return out[::-1]


def _nodes(keys: np.ndarray, counts: np.ndarray, bit: int) -> Level:
    names = ((keys >> 8) << bit) | ((keys & 255) >> (8 - bit))
    first = _starts(names)
    ones = counts * (keys >> (7 - bit) & 1)
    total, ones = (np.add.reduceat(c, first) for c in (counts, ones))
    return Level(names[first], total - ones, ones)


class Trees(NamedTuple):
    """For one bit: nodes of depth 2 and deeper, places of their parents, own and weighted probabilities."""

    levels: list[Level]
    parents: list[np.ndarray]
    own: list[np.ndarray]
    children: list[np.ndarray]
    weighted: np.ndarray


def trees(tables: list[tuple[np.ndarray, np.ndarray]], bit: int) -> Trees:
    levels = [_nodes(*table, bit) for table in tables]
    parents = [
        np.searchsorted(above.names, (below.names >> bit + 8 << bit) | (below.names & (1 << bit) - 1))
        for above, below in zip(levels, levels[1:])
    ]
    own = [log_estimate(level.zeros, level.ones) for level in levels]
    weighted, children = own[-1], []
    for up in range(len(levels) - 2, -1, -1):
        children.insert(0, np.bincount(parents[up], weights=weighted, minlength=len(own[up])))
        weighted = log_weighted(own[up], children[0])
    return Trees(levels, parents, own, children, weighted)


class Top(NamedTuple):
    """Depths 0 and 1 by last byte and decision: the chance of a one, and its weight against deeper ones."""

    one: list[np.ndarray]
    share: list[np.ndarray]


_TOP = "last int, decision int, zeros long, ones long, weighted double"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Strings, counts and buckets of whole pairs of last bytes."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(tuple(batch[c].to_numpy() for c in ("key", "n", "bucket")))
        size += batch.num_rows
        if size >= SEGMENT_STRINGS:
            keys, counts, bucket = (np.concatenate(c) for c in zip(*held))
            # The last pair may go on.
            cut = int(np.searchsorted(keys, keys[-1] >> 8 * (DEPTH - 1) << 8 * (DEPTH - 1)))
            if cut:
                yield keys[:cut], counts[:cut], bucket[:cut]
            held, size = [(keys[cut:], counts[cut:], bucket[cut:])], len(keys) - cut
    if size:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over pairs of last bytes, by the last one and by decision."""
    for keys, counts, _ in _segments(batches):
        tables = _levels(keys, counts)
        for bit in range(8):
            done = trees(tables, bit)
            level = done.levels[0]
            at = (level.names >> bit + 8 << 8) | (1 << bit) | (level.names & (1 << bit) - 1)
            order = np.argsort(at, kind="stable")
            at = at[order]
            first = _starts(at)
            sums = [np.add.reduceat(v[order], first) for v in (level.zeros, level.ones, done.weighted)]
            at = at[first]
            columns = [(at >> 8).astype(np.int32), (at & 255).astype(np.int32), *sums]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=field_names(_TOP))


def top_of(rows: list[tuple]) -> Top:
    """Depths 1 and 0 from the sums per last byte and decision, 255 times 256 of them at most."""
    zeros, ones, children = np.zeros((256, 256), np.int64), np.zeros((256, 256), np.int64), np.zeros((256, 256))
    for last, decision, z, o, w in rows:
        zeros[last, decision], ones[last, decision], children[last, decision] = z, o, w
    own = log_estimate(zeros, ones)
    weighted = log_weighted(own, children)
    root_zeros, root_ones, below = zeros.sum(axis=0), ones.sum(axis=0), weighted.sum(axis=0)
    root = log_estimate(root_zeros, root_ones)
    return Top(
        [next_one(root_zeros, root_ones), next_one(zeros, ones)],
        [share_of_own(root, below), share_of_own(own, children)],
    )


def code_lengths(keys: np.ndarray, counts: np.ndarray, top: Top) -> np.ndarray:
    """Bits that each string's byte takes in its context."""
    tables = _levels(keys, counts)
    total = np.zeros(len(keys))
    last = keys >> 8 * DEPTH
    for bit in range(8):
        done = trees(tables, bit)
        names = ((keys >> 8) << bit) | ((keys & 255) >> (8 - bit))
        node = np.cumsum(np.diff(names, prepend=names[:1]) != 0)
        at = np.arange(len(done.levels[-1].names))
        one = next_one(done.levels[-1].zeros, done.levels[-1].ones)
        for up in range(len(done.parents) - 1, -1, -1):
            at = done.parents[up][at]
            share = share_of_own(done.own[up], done.children[up])
            estimate = next_one(done.levels[up].zeros, done.levels[up].ones)
            one = share[at] * estimate[at] + (1 - share[at]) * one
        one = one[node]
        decision = (1 << bit) | ((keys & 255) >> (8 - bit))
        one = top.share[1][last, decision] * top.one[1][last, decision] + (1 - top.share[1][last, decision]) * one
        one = top.share[0][decision] * top.one[0][decision] + (1 - top.share[0][decision]) * one
        total -= np.log2(np.where(keys >> (7 - bit) & 1, one, 1 - one))
    return total


def _answer_strings(top: Top) -> Callable:
    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts, bucket in _segments(batches):
            lengths = code_lengths(keys, counts, top).astype(np.float32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            for a, z in zip(cuts, cuts[1:]):
                part = order[a:z]
                yield _asked(int(bucket[part[0]]), 0, None, keys[part], lengths[part].tobytes(), [], b"")
        release_memory()

    return answered


# --- answers --------------------------------------------------------------------------

_ANSWERS = "block long, bucket int, lengths binary, n_tokens long, counts binary"


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block what it asked the bucket for; the bucket's own rows come first."""
    for bucket, rows in groupby(_each(batches), key=itemgetter("bucket")):
        parts: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.float32))]
        keys = lengths = None
        counts: dict[bytes, int] = {}
        for row in rows:
            if row["kind"] == 0:
                parts.append((_unpack_sorted(row["keys"], row["n_keys"]), np.frombuffer(row["key_values"], np.float32)))
                continue
            if row["kind"] == 1:
                counts.update(zip(_tokens(row["tokens"]), unpack(row["token_values"], row["n_tokens"]).tolist()))
                continue
            if keys is None:
                keys, lengths = (np.concatenate(c) for c in zip(*parts))
                order = np.argsort(keys, kind="stable")
                keys, lengths = keys[order], lengths[order]
            place = np.searchsorted(keys, _unpack_sorted(row["keys"], row["n_keys"]))
            found = np.array([counts[t] for t in _tokens(row["tokens"])], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["block"]]),
                    pa.array([bucket], pa.int32()),
                    pa.array([lengths[place].tobytes()], pa.binary()),
                    pa.array([len(found)]),
                    pa.array([pack(found)], pa.binary()),
                ],
                names=field_names(_ANSWERS),
            )
    release_memory()


_PIECES = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, bits double, n_bytes long"


def _score(buckets: int, normal: float) -> Callable:
    def scored(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        row = blocks.to_pylist()[0]
        answers = sorted(answers.to_pylist(), key=itemgetter("bucket"))
        # What was asked for comes back in the order of asking.
        parts = list(_parts(row))
        strings = _Sums()
        for part in parts:
            mine = strings_of(part).keys
            strings.add(mine, np.zeros(len(mine), np.int64))
        keys, _ = strings.done()
        lengths = np.empty(len(keys), np.float64)
        lengths[_by_bucket(keys, buckets)[0]] = np.frombuffer(b"".join(a["lengths"] for a in answers), np.float32)
        t = tokens_by_bucket(parts, buckets)
        counts = np.concatenate([unpack(a["counts"], a["n_tokens"]) for a in answers])
        logs = np.log10(counts + 0.5)
        n_tokens, known, base, bits = [], [], [], []
        for part, place, text in zip(parts, t.places, t.texts):
            texts = len(part.starts)
            s = strings_of(part)
            bits.append(np.bincount(s.text, weights=lengths[np.searchsorted(keys, s.keys)][s.rank], minlength=texts))
            n_tokens.append(np.bincount(text, minlength=texts))
            base.append(np.bincount(text, weights=logs[place], minlength=texts) - n_tokens[-1] * normal)
            known.append(np.bincount(text, weights=(counts > 0)[place], minlength=texts).astype(np.int64))
        sizes = np.array(row["ends"]) - np.array(row["starts"])
        columns = [row["rows"], row["doc_ids"], row["held"], *map(np.concatenate, (n_tokens, known, base, bits)), sizes]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=field_names(_PIECES))

    return scored


def scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: its log10 probability by the weighted context trees, and by single tokens.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and
    bits_per_byte.  A text is coded as its tokens: lower-case words with a blank
    between each two, then a line end, so that ``score`` and ``base_score`` are
    probabilities of the same thing; contexts at its start are line ends.  Documents
    with crc32(doc_id as text) % 5 = 1 are not learnt from.  A null text is an empty
    one, which has its end only; a null id counts as an empty text and is learnt from.
    Repeated rows are learnt from and returned as often as they occur.  Without
    training texts every byte takes 8 bits.  Code lengths of single strings travel
    in single precision.
    """
    doc_id = F.col("doc_id").cast("long")
    number = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    texts = docs.select(doc_id.alias("doc_id"), (number % 5 == HELD_OUT).alias("held"), F.col("text").cast("string").alias("text"))
    blocks = write_once(texts.mapInArrow(_pack_texts(block_bytes), _BLOCK), "codelength-blocks")
    size = blocks.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, min(BUCKETS, -(-size // BUCKET_BYTES)))
    asked = write_once(blocks.mapInArrow(_ask(buckets), _ASKED), "codelength-asked")
    # All that a bucket is asked for comes to one task, one block after the other.
    by_bucket = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    merged = write_once(by_bucket.mapInArrow(_merge, _MERGED), "codelength-strings")
    sums = merged.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_keys", "known", "total")]).first()
    tasks = max(1, -(-sums["n_keys"] // TASK_STRINGS))
    strings = merged.select("bucket", "n_keys", "keys", "counts").mapInArrow(_string_rows, _STRINGS)
    strings = strings.repartition(tasks, "pair").sortWithinPartitions("key")
    climbed = strings.mapInArrow(_climb, _TOP).groupBy("last", "decision")
    sums_above = climbed.agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")])
    # A row per last byte and decision.
    top = top_of([tuple(r) for r in sums_above.collect()])
    lengths = strings.mapInArrow(_answer_strings(top), _ASKED)
    nothing = F.lit(b"")
    tokens = merged.select(
        "bucket", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("block"), F.lit(0).cast("long").alias("n_keys"),
        nothing.alias("keys"), nothing.alias("key_values"), "n_tokens", "tokens", F.col("token_counts").alias("token_values"),
    )
    # Counts have been added up; the order of what is asked for is all that answers need.
    wanted = asked.withColumn("key_values", nothing).withColumn("token_values", nothing)
    every = wanted.unionByName(lengths).unionByName(tokens)
    answers = every.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_answer, _ANSWERS)
    normal = math.log10(sums["total"] + 0.5 * (sums["known"] + 1))
    pieces = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(buckets, normal), _PIECES)
    # A long text is in several pieces.
    whole = pieces.groupBy("row").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "held_out")], *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "bits", "n_bytes")]
    )
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(sums["total"]).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        (-F.col("bits") * math.log10(2)).alias("score"),
        "n_bytes",
        (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )
