"""Suffix-array dedup: a logarithmic family of sorted string arrays finds repeated byte strings.

Every string of ``length`` bytes is filed under one of its own 16-byte seeds: the
one with the smallest hash, the first among equals.  The choice depends on the
string alone, so equal strings are always filed under equal seeds, and about one
position in seventeen is a seed.  A seed with the bytes of its strings is an entry.

Rows are sorted by doc_id and gathered in pieces, and a piece is known by its number.  A string
reaches far to the right of its seed or far to the left, so it contains the seed with its next 18 bytes or
with its last 17 (at 50 bytes): the entry's two keys.  First only 32-bit hashes of keys travel, to the shard of
their key, which answers with one bit for each: whether another piece has it too.  Only strings of such
keys travel with their bytes, as runs of one piece and shard.  So a seed that is common in many surroundings
brings nothing along.  Every shard takes its runs in the order of doc_id, in batches: a batch is
sorted by the hashes of its strings, and each different string is looked up in the levels of the index, which
are arrays of strings in the same order; what has one hash is compared byte by byte, and strings that are new become a
level; levels of about equal size are merged.  The index has each string once, so the work of a batch follows its
own strings and not the places where their seeds occurred before, and passages seen before add nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwright.llm.textbytes import (
    column_bytes,
    field_names,
    gram_hashes,
    gram_words,
    hashed,
    mix,
    pieces,
    ragged,
    release_memory,
    sliding_min,
)
from tagwright.session import write_once

LENGTH = 50
SEED = 16

#: Entries that a shard gathers before it scans them against the index.
BATCH_ENTRIES = 12_000
#: Bytes of text that a piece holds at most.  Every piece sends a run to every shard, and both are as many as the input is
#: long, so the number of runs falls with the square of this.
PIECE_BYTES = 4 << 20
#: Bytes beside a seed that count in its keys, at most.
REACH = 32
#: Bytes of text that are cut into entries at a time; small enough for a processor's cache.
BLOCK_BYTES = 256 << 10

#: Stands for a null doc_id: smaller than no other.
_LAST = np.iinfo(np.int64).max
#: Stands for a string that a level does not have.  No batch follows one with a document of this id.
_NONE = np.iinfo(np.int64).max
_POSITION = np.uint64((1 << 22) - 1)

_PIECE = "piece long, ids array<long>, sizes array<int>, nulls array<boolean>, text binary"
_SEEDS = "shard int, piece long, seeds binary"
_MARKS = "piece long, shard int, n int, marks binary"
_RUN = "shard int, first_id long, last_id long, n int, run binary"
_SPAN = "piece long, spans binary"
_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _entries(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Place of the seed, first and last string of each entry of one piece; ``starts`` are the rows' first bytes."""
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros((3, 0), np.int64))
    seeds = gram_hashes(data, SEED)
    ordered = (seeds & ~_POSITION) | np.arange(len(seeds), dtype=np.uint64)
    seed_at = (sliding_min(ordered, length - SEED + 1) & _POSITION).astype(np.int64)
    # A string must end in the row in which it starts.
    closed = np.zeros(len(data) + 1, np.int32)
    np.add.at(closed, np.maximum(starts[1:] - length + 1, starts[:-1]), 1)
    np.add.at(closed, starts[1:], -1)
    at = np.flatnonzero(np.cumsum(closed)[:n] == 0)
    if not len(at):
        return tuple(np.zeros((3, 0), np.int64))
    chosen = seed_at[at]
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    return chosen[new], at[new], at[last]


def _hash_at(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The hashes that ``gram_hashes`` has at some places."""
    return hashed(w[at] for w in gram_words(data, length)) if len(at) else np.zeros(0, np.uint64)


def _packed(number: int, fields: np.ndarray, text: np.ndarray, pack: zstandard.ZstdCompressor) -> bytes:
    """A run: its piece, and of each entry five 32-bit fields, byte by byte, and the text."""
    planes = np.ascontiguousarray(fields, np.uint32).view(np.uint8).reshape(*fields.shape, 4).transpose(0, 2, 1)
    return pack.compress(np.int64(number).tobytes() + planes.tobytes() + text.tobytes())


def _unpacked(n: int, run: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(run), np.uint8)
    planes = raw[8 : 8 + 20 * n].reshape(5, 4, n).transpose(0, 2, 1)
    return int(raw[:8].view(np.int64)[0]), np.ascontiguousarray(planes).view(np.uint32)[..., 0], raw[8 + 20 * n :]


def _gather(batches: Iterator[pa.RecordBatch], extra: list[str]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows as pieces of about ``PIECE_BYTES``, their texts packed together."""
    pack = zstandard.ZstdCompressor(level=1)
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        data, offsets = column_bytes(batch["text"])
        null = batch["text"].is_null().to_numpy(zero_copy_only=False)
        first = 0
        while first < batch.num_rows:
            end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, "right")) - 1)
            columns = [
                pa.array([number], pa.int64()),
                _one_list(batch["row_id"].slice(first, end - first)),
                _one_list(pa.array(np.diff(offsets[first : end + 1]).astype(np.int32))),
                _one_list(pa.array(null[first:end])),
                pa.array([pack.compress(np.ascontiguousarray(data[offsets[first] : offsets[end]]))], pa.binary()),
                *[_one_list(batch[c].slice(first, end - first)) for c in extra],
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*field_names(_PIECE), *extra])
            first, number = end, number + 1


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


class _Piece:
    """A piece's entries: seed, row, first and last string of each, as places in the piece's bytes; and their keys."""

    def __init__(self, text: bytes, sizes: np.ndarray, length: int, shards: int):
        self.data = np.frombuffer(zstandard.decompress(text), np.uint8)
        self.shard_count = shards
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        seed_at, begin, last, row = [], [], [], []
        for first, end, low, high in pieces(offsets, BLOCK_BYTES, length - 1):
            starts = np.append(np.maximum(offsets[first:end], low) - low, high - low)
            found, at, to = _entries(self.data[low:high], starts, length)
            seed_at.append(found + low), begin.append(at + low), last.append(to + low)
            row.append(first + np.searchsorted(starts, at, side="right") - 1)
        self.seed_at, self.begin, self.last, self.row = (
            np.concatenate([np.zeros(0, np.int64), *parts]) for parts in (seed_at, begin, last, row)
        )
        # Strings with fewer than ``half`` bytes before their seed have the right key, the others the left one.
        self.half = (length - SEED + 1) // 2
        to_right, to_left = min(length - SEED - self.half + 1, REACH), min(self.half, REACH)
        self.right = np.flatnonzero(self.last > self.seed_at - self.half)
        self.left = np.flatnonzero(self.begin <= self.seed_at - self.half)
        key = np.concatenate([
            _hash_at(self.data, self.seed_at[self.right], SEED + to_right),
            _hash_at(self.data, self.seed_at[self.left] - to_left, SEED + to_left),
        ])
        # A key's place: its shard, then 32 bits that are independent of the shard.
        place = self._shard_of(key) << np.uint64(32) | mix(key) >> np.uint64(32)
        self.order = np.argsort(place)
        place = place[self.order]
        self.new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])[: len(place)])
        self.places = place[self.new]

    def _shard_of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(8) & np.uint64(0xFFFFFF)) % np.uint64(self.shard_count)

    def shards(self) -> tuple[np.ndarray, np.ndarray]:
        """The shards met, and where the places of each begin."""
        return np.unique(self.places >> np.uint64(32), return_index=True)

    def met_inside(self) -> np.ndarray:
        """Of each place, whether several rows of the piece have it."""
        if not len(self.new):
            return np.zeros(0, bool)
        row = np.concatenate([self.row[self.right], self.row[self.left]])[self.order]
        return np.minimum.reduceat(row, self.new) < np.maximum.reduceat(row, self.new)

    def narrowed(self, shared: np.ndarray) -> tuple[np.ndarray, ...]:
        """The entries that have strings of shared places: shard, entry, first and last such string of each."""
        hit = np.empty(len(self.order), bool)
        hit[self.order] = np.repeat(shared, np.diff(np.append(self.new, len(self.order))))
        right, left = np.zeros((2, len(self.row)), bool)
        right[self.right], left[self.left] = hit[: len(self.right)], hit[len(self.right) :]
        at = np.flatnonzero(right | left)
        edge = self.seed_at[at] - self.half
        begin = np.where(left[at], self.begin[at], np.maximum(self.begin[at], edge + 1))
        last = np.where(right[at], self.last[at], np.minimum(self.last[at], edge))
        return self._shard_of(_hash_at(self.data, self.seed_at[at], SEED)).astype(np.int32), at, begin, last


def _cut_seeds(shards: int, length: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for number, sizes, text in zip(batch["piece"].to_pylist(), batch["sizes"], batch["text"]):
                piece = _Piece(text.as_py(), sizes.values.to_numpy(), length, shards)
                met, first = piece.shards()
                parts = np.split((piece.places & np.uint64(0xFFFFFFFF)).astype(np.uint32), first[1:])
                packed = [pack.compress(np.diff(p, prepend=np.uint32(0)).tobytes()) for p in parts[: len(met)]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(met.astype(np.int32)), pa.array(np.full(len(met), number)), pa.array(packed, pa.binary())],
                    names=field_names(_SEEDS),
                )
        release_memory()

    return cut


def _mark_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each seed in a run, whether another piece has it; runs come sorted by shard."""

    def marked(shard: int, runs: list[tuple[int, bytes]]) -> pa.RecordBatch:
        seeds = [np.cumsum(np.frombuffer(zstandard.decompress(r), np.uint32), dtype=np.uint32) for _, r in runs]
        sizes = [len(s) for s in seeds]
        ordered = np.concatenate(seeds).astype(np.uint64) << np.uint64(32) | np.arange(sum(sizes), dtype=np.uint64)
        ordered.sort()
        seen = ordered >> np.uint64(32)
        same = np.concatenate([[False], seen[1:] == seen[:-1], [False]])
        again = np.zeros(len(ordered), bool)
        again[(ordered & np.uint64(0xFFFFFFFF)).astype(np.int64)] = same[:-1] | same[1:]
        bits = np.split(again, np.cumsum(sizes)[:-1])
        columns = [[p for p, _ in runs], [shard] * len(runs), sizes, [np.packbits(b).tobytes() for b in bits]]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=field_names(_MARKS))

    held: list[tuple[int, bytes]] = []
    at = None
    for batch in batches:
        for shard, piece, run in zip(*[batch[c].to_pylist() for c in ("shard", "piece", "seeds")]):
            if shard != at and held:
                yield marked(at, held)
                held = []
            at = shard
            held.append((piece, run))
    if held:
        yield marked(at, held)
    held = []
    release_memory()


def _cut_runs(shards: int, length: int) -> Callable:
    def runs_of(number: int, ids: np.ndarray, piece: _Piece, marks: list[dict], pack) -> pa.RecordBatch | None:
        answers = [np.unpackbits(np.frombuffer(m["marks"], np.uint8), count=m["n"]) for m in sorted(marks, key=_shard)]
        shard, at, begin, last = piece.narrowed(np.concatenate(answers).astype(bool) | piece.met_inside())
        if not len(at):
            return None
        order = np.argsort(shard, kind="stable")
        shard, at, begin, last = shard[order], at[order], begin[order], last[order]
        sizes, held = last - begin + length, ids[piece.row[at]]
        edges = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(at)]])
        first = edges[:-1]
        steps, moved = np.diff(begin, prepend=0), np.diff(held, prepend=0)
        steps[first], moved[first] = begin[first], held[first]
        wide = np.ascontiguousarray(moved).view(np.uint32).reshape(-1, 2)
        fields = np.stack([steps, sizes, piece.seed_at[at] - begin, wide[:, 0], wide[:, 1]]).astype(np.uint32)
        content = piece.data[ragged(begin, sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        runs = [
            _packed(number, fields[:, a:b], content[ends[a] : ends[b]], pack) for a, b in zip(edges[:-1], edges[1:])
        ]
        columns = [shard[first], np.minimum.reduceat(held, first), np.maximum.reduceat(held, first), np.diff(edges), runs]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=field_names(_RUN))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=5)
        for batch in batches:
            for i, number in enumerate(batch["piece"].to_pylist()):
                ids = batch["ids"][i].values.fill_null(_LAST).to_numpy()
                piece = _Piece(batch["text"][i].as_py(), batch["sizes"][i].values.to_numpy(), length, shards)
                runs = runs_of(number, ids, piece, batch["answers"][i].as_py(), pack)
                if runs is not None:
                    yield runs
        release_memory()

    return cut


def _shard(mark: dict) -> int:
    return mark["shard"]


class _Entries:
    """Entries: seed, document, piece and place in it of each, and where the bytes of its strings are."""

    FLAT = ("seed", "row_id", "piece", "start")

    def __init__(self, flat: dict[str, np.ndarray], begin: np.ndarray, sizes: np.ndarray, text: np.ndarray):
        self.flat, self.begin, self.sizes, self.text = flat, begin, sizes, text
        self.seed, self.row_id = flat["seed"], flat["row_id"]

    @classmethod
    def read(cls, runs: list[tuple[int, bytes]]) -> _Entries:
        numbers, fields, texts = zip(*[_unpacked(*run) for run in runs])
        piece = np.repeat(np.array(numbers, np.int64), [f.shape[1] for f in fields])
        start = np.concatenate([np.cumsum(f[0], dtype=np.int64) for f in fields])
        row_id = np.concatenate([np.cumsum(np.ascontiguousarray(f[3:].T).view(np.int64)[:, 0]) for f in fields])
        sizes, seed_at = (np.concatenate([f[i] for f in fields]).astype(np.int64) for i in (1, 2))
        text, begin = np.concatenate(texts), np.cumsum(sizes) - sizes
        seed = _hash_at(text, begin + seed_at, SEED)
        return cls({"seed": seed, "row_id": row_id, "piece": piece, "start": start}, begin, sizes, text)

    def take(self, at: np.ndarray) -> _Entries:
        """Some entries in another order; their bytes stay where they are."""
        return _Entries({c: v[at] for c, v in self.flat.items()}, self.begin[at], self.sizes[at], self.text)

    def copied(self) -> _Entries:
        """With the bytes of these entries alone, one after the other."""
        begin = np.cumsum(self.sizes) - self.sizes
        return _Entries(self.flat, begin, self.sizes, self.text[ragged(self.begin, self.sizes)])

    def with_(self, other: _Entries) -> _Entries:
        return _Entries(
            {c: np.concatenate([v, other.flat[c]]) for c, v in self.flat.items()},
            np.concatenate([self.begin, other.begin + len(self.text)]),
            np.concatenate([self.sizes, other.sizes]),
            np.concatenate([self.text, other.text]),
        )

    def __len__(self):
        return len(self.seed)


class _Level:
    """Strings that differ, sorted by hash: the place of each in the bytes of the entries that have them."""

    def __init__(self, entries: _Entries, key: np.ndarray, place: np.ndarray):
        self.entries, self.key, self.place = entries, key, place
        self.row_id, self.text = entries.row_id, entries.text

    def first_id(self, key: np.ndarray, words: list[np.ndarray], place: np.ndarray, length: int) -> np.ndarray:
        """The document of each string that is here, given by sorted hashes and places in other bytes; else ``_NONE``."""
        out = np.full(len(key), _NONE)
        own = gram_words(self.text, length)
        open_, at = np.arange(len(key)), np.searchsorted(self.key, key)
        while len(open_):
            open_, at = open_[at < len(self.key)], at[at < len(self.key)]
            same = self.key[at] == key[open_]
            open_, at = open_[same], at[same]
            equal = np.ones(len(at), bool)
            for o, w in zip(own, words):
                equal &= o[self.place[at]] == w[place[open_]]
            holder = np.searchsorted(self.entries.begin, self.place[at[equal]], side="right") - 1
            out[open_[equal]] = self.row_id[holder]
            # Other bytes with the same hash: the next one.
            open_, at = open_[~equal], at[~equal] + 1
        return out

    def with_(self, other: _Level) -> _Level:
        key = np.concatenate([self.key, other.key])
        order = np.argsort(key, kind="stable")
        place = np.concatenate([self.place, other.place + len(self.text)])
        return _Level(self.entries.with_(other.entries), key[order], place[order])

    def __len__(self):
        return len(self.key)


class IndexFamily:
    """Levels of sorted strings; ``add`` scans a batch of later documents against all of them."""

    def __init__(self, length: int):
        self.length, self.levels = length, []

    def add(self, batch: _Entries) -> tuple[_Entries, np.ndarray, np.ndarray, np.ndarray]:
        """The sorted batch, and the entry, first and last string of each repeated stretch in it."""
        batch = batch.take(np.argsort(batch.seed, kind="stable"))
        strings = batch.sizes - self.length + 1
        place = ragged(batch.begin, strings)
        owner = np.repeat(np.arange(len(batch)), strings)
        if not len(owner):
            return batch, *[np.zeros(0, np.int64)] * 3
        words = gram_words(batch.text, self.length)
        # Only where strings start: an entry has three times as many bytes.
        key = hashed(w[place] for w in words)
        order, group = self._grouped(key, words, place)
        sizes = np.diff(np.append(group, len(order)))
        held = batch.row_id[owner[order]]
        smallest = np.minimum.reduceat(held, group)
        found, known = smallest.copy(), np.zeros(len(group), bool)
        for level in self.levels:
            # A string is in one level at most.
            ask = np.flatnonzero(~known)
            first = order[group[ask]]
            ids = level.first_id(key[first], words, place[first], self.length)
            met = ids != _NONE
            known[ask[met]] = True
            found[ask[met]] = np.minimum(found[ask[met]], ids[met])
        # Of each new string, the place in the document with the smallest id.
        of_smallest = np.flatnonzero(held == np.repeat(smallest, sizes))
        holder = order[of_smallest[np.searchsorted(of_smallest, group[~known])]]
        self._insert(batch, owner[holder], key[holder], place[holder])
        first_id = np.empty(len(order), np.int64)
        first_id[order] = np.repeat(found, sizes)
        repeated = np.flatnonzero(first_id < batch.row_id[owner])
        if not len(repeated):
            return batch, *[np.zeros(0, np.int64)] * 3
        owner, offset = owner[repeated], (place - batch.begin[owner])[repeated]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)])
        begin = np.flatnonzero(new)
        last = np.concatenate([begin[1:], [len(owner)]]) - 1
        return batch, owner[begin], offset[begin], offset[last]

    def _grouped(self, key: np.ndarray, words: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings sorted by hash, equal ones side by side, and where each different string begins among them."""
        order = np.argsort(key)
        ordered = key[order]
        same = ordered[1:] == ordered[:-1]
        equal = same.copy()
        at = np.flatnonzero(same)
        for w in words:
            equal[at] &= w[place[order[at]]] == w[place[order[at + 1]]]
        if (same & ~equal).any():  # two strings with one hash: order by the bytes as well
            order = np.lexsort([*(w[place] for w in words), key])
            equal = np.ones(len(order) - 1, bool)
            for w in words:
                found = w[place[order]]
                equal &= found[1:] == found[:-1]
        return order, np.flatnonzero(np.concatenate([[True], ~equal]))

    def _insert(self, batch: _Entries, owner: np.ndarray, key: np.ndarray, place: np.ndarray) -> None:
        """Strings that are new, sorted by hash, as a level with the bytes of their entries."""
        if not len(owner):
            return
        used = np.zeros(len(batch), bool)
        used[owner] = True
        entries = batch.take(np.flatnonzero(used)).copied()
        begin = entries.begin[(np.cumsum(used) - 1)[owner]]
        self.levels.append(_Level(entries, key, begin + place - batch.begin[owner]))
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            last = self.levels.pop()
            self.levels.append(self.levels.pop().with_(last))


def _scan_runs(length: int, batch_entries: int) -> Callable:
    def spans(family: IndexFamily, runs: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        batch, at, begin, last = family.add(_Entries.read(runs))
        order = np.argsort(batch.flat["piece"][at], kind="stable")
        at, begin, last = at[order], begin[order], last[order]
        start = batch.flat["start"][at]
        ranges = np.stack([start + begin, start + last + length], axis=1).astype(np.uint32)
        number, first = np.unique(batch.flat["piece"][at], return_index=True)
        parts = [p.tobytes() for p in np.split(ranges, first[1:])][: len(number)]
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(parts, pa.binary())], names=field_names(_SPAN))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, held, size, reach = IndexFamily(length), [], 0, -1
        for batch in batches:
            for first, last, n, run in zip(*[batch[c].to_pylist() for c in ("first_id", "last_id", "n", "run")]):
                # Documents before all that follow are scanned; runs that overlap in doc_id stay together.
                if size >= batch_entries and first > reach:
                    yield from spans(family, held)
                    held, size = [], 0
                held.append((n, run))
                size += n
                reach = max(reach, last)
        if held:
            yield from spans(family, held)
        del family, held
        release_memory()

    return scan


def _with_spans(docs: DataFrame, length: int, batch_entries: int) -> DataFrame:
    """Pieces of the documents, the packed byte ranges found in each, and all other columns of ``docs``.

    Rows are told apart by piece and place, so ids may be null or repeated.
    """
    if not 2 * SEED <= length <= 1 << 16:
        raise ValueError(f"a length between {2 * SEED} and 65536 is needed, got {length}")
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    extra = [c for c in docs.columns if c not in ("row_id", "text")]
    schema = ", ".join([_PIECE, *[f"{c} array<{docs.schema[c].dataType.simpleString()}>" for c in extra]])
    # Pieces in the order of doc_id, whatever the table's layout: else no batch of runs would end
    # before the last.  Rows of one id, or of none, are spread by their texts.
    order = F.col("row_id").asc_nulls_last()
    docs = docs.repartitionByRange(shards, order, F.xxhash64("text")).sortWithinPartitions(order)
    gathered = write_once(docs.mapInArrow(lambda batches: _gather(batches, extra), schema), "pieces")
    # Spelled out, as the inner join would add it for itself alone and so read another exchange.
    gathered = gathered.filter(F.col("piece").isNotNull())

    seeds = gathered.select("piece", "sizes", "text").mapInArrow(_cut_seeds(shards, length), _SEEDS)
    marks = seeds.repartitionById(shards, "shard").sortWithinPartitions("shard").mapInArrow(_mark_shared, _MARKS)
    answers = marks.groupBy(F.col("piece").alias("marked")).agg(
        F.collect_list(F.struct("shard", "n", "marks")).alias("answers")
    )
    asked = gathered.join(answers, F.col("piece") == F.col("marked"))
    # With all columns of the pieces, so that both joins share one exchange of them.
    runs = asked.select(*gathered.columns, "answers").mapInArrow(_cut_runs(shards, length), _RUN)
    sorted_runs = runs.repartitionById(shards, "shard").sortWithinPartitions("first_id", "last_id")
    spans = sorted_runs.select("first_id", "last_id", "n", "run").mapInArrow(_scan_runs(length, batch_entries), _SPAN)
    per_piece = spans.groupBy(F.col("piece").alias("spanned")).agg(F.collect_list("spans").alias("spans"))
    return gathered.join(per_piece, F.col("piece") == F.col("spanned"), "left")


def _cuts(text: bytes, sizes: np.ndarray, spans: list[bytes] | None) -> Iterator[tuple[bytes, int, int]]:
    """Of each row of a piece: what stays of its text, the bytes removed, and the number of ranges."""
    raw = zstandard.decompress(text)
    ranges = np.frombuffer(b"".join(spans or ()), np.uint32).reshape(-1, 2).astype(np.int64)
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    # No range reaches beyond the row in which it starts.
    cuts = np.searchsorted(ranges[:, 0], offsets)
    ranges -= np.repeat(offsets[:-1], np.diff(cuts))[:, None]
    at = 0
    for row, size in enumerate(sizes.tolist()):
        merged: list[list[int]] = []
        for start, end in ranges[cuts[row] : cuts[row + 1]].tolist():
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        edges = [0, *[edge for pair in merged for edge in pair], size]
        kept = b"".join(raw[at + a : at + b] for a, b in zip(edges[::2], edges[1::2]))
        yield kept, size - len(kept), len(merged)
        at += size


def dedup_digest(docs: DataFrame, length: int = LENGTH, batch_entries: int = BATCH_ENTRIES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256.

    A byte goes if a string of ``length`` bytes that covers it starts in a document
    with a smaller doc_id as well.  A null text has no bytes.  A null doc_id counts
    as the largest and makes no other document lose bytes; rows with one doc_id do
    not make each other lose bytes.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, text, spans in zip(*[batch[c] for c in ("ids", "sizes", "text", "spans")]):
                done = list(_cuts(text.as_py(), sizes.values.to_numpy(), spans.as_py()))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.values,
                        pa.array([len(kept) + removed for kept, removed, _ in done], pa.int64()),
                        pa.array([removed for _, removed, _ in done], pa.int64()),
                        pa.array([n for *_, n in done], pa.int64()),
                        pa.array([hashlib.sha256(kept).hexdigest() for kept, *_ in done], pa.string()),
                    ],
                    names=field_names(_DIGEST),
                )

    keyed = docs.select(F.col("doc_id").cast("long").alias("row_id"), "text")
    joined = _with_spans(keyed, length, batch_entries)
    return joined.mapInArrow(digest, _DIGEST)


def dedup(docs: DataFrame, length: int = LENGTH, batch_entries: int = BATCH_ENTRIES) -> DataFrame:
    """The documents without their repeated bytes, in the columns of ``docs``.

    A character of which a byte was removed goes as a whole, n_chars (if there)
    is counted anew, and a document that loses all of its text is dropped.  Null
    and empty texts stay.  Nulls and repeats of doc_id as in ``dedup_digest``.
    """
    names = docs.columns
    carried = [f"_{i}" for i in range(len(names))]
    rest = [c for n, c in zip(names, carried) if n != "text"]
    renamed = docs.select(
        F.col("doc_id").cast("long").alias("row_id"), "text", *[F.col(f"`{n}`").alias(c) for n, c in zip(names, carried) if n != "text"]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                done = list(_cuts(batch["text"][i].as_py(), batch["sizes"][i].values.to_numpy(), batch["spans"][i].as_py()))
                null = batch["nulls"][i].as_py()
                texts = [None if n else kept.decode("utf-8", "ignore") for n, (kept, *_) in zip(null, done)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(texts, pa.string()), pa.array([r > 0 for _, r, _ in done]), *[batch[c][i].values for c in rest]],
                    names=["text", "cut", *rest],
                )

    joined = _with_spans(renamed, length, batch_entries)
    schema = ", ".join(
        ["text string, cut boolean", *[f"{c} {renamed.schema[c].dataType.simpleString()}" for c in rest]]
    )
    left = joined.mapInArrow(cut, schema).filter(~F.col("cut") | (F.col("text") != ""))
    if "n_chars" in names:
        place = carried[names.index("n_chars")]
        left = left.withColumn(
            place, F.when(F.col("cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(place))
        )
    return left.select(*[F.col("text" if n == "text" else c).alias(n) for n, c in zip(names, carried)])
