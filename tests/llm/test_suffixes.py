"""Suffix-array dedup against a byte-by-byte search."""

import hashlib
import random
import tempfile

import numpy as np
import pytest

from tagwright.llm import suffixes
from tagwright.llm.textbytes import gram_hashes, pieces, sliding_min


def expected(rows, length=50):
    """Per row: bytes, removed bytes, ranges and digest, from a dictionary of all strings."""
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        for s in range(len(data) - length + 1):
            string = data[s : s + length]
            if i is not None:
                first[string] = min(first.get(string, i), i)
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            seen = first.get(data[s : s + length])
            if seen is not None and (i is None or seen < i):
                gone[s : s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(data, gone) if not g)
        n = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(data), sum(gone), n, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed=3, n=60):
    draw = random.Random(seed)
    words = ["über", "the", "of", "café", "long", "word", "thing", "a"]
    passages = [" ".join(draw.choice(words) for _ in range(30)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [" ".join(draw.choice(words) + str(draw.randrange(1000)) for _ in range(draw.randrange(1, 60)))]
        for _ in range(draw.randrange(3)):
            parts.append(draw.choice(passages))
            parts.append(" ".join(str(draw.random()) for _ in range(draw.randrange(4))))
        draw.shuffle(parts)
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (102, "x" * 400), (103, "x" * 120), (104, ""), (105, None)]
    rows += [(106, "ab" * 100), (None, rows[7][1]), (7, rows[7][1]), (8, rows[3][1] + "!"), (107, passages[0][:50])]
    draw.shuffle(rows)
    return rows


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted((tuple(r) for r in suffixes.dedup_digest(docs, **options).collect()), key=repr)


def test_equals_brute_force(spark):
    rows = corpus()
    assert found(spark, rows) == expected(rows)


def test_many_batches_and_pieces(spark, monkeypatch):
    """Batches of a few entries make several levels."""
    rows = corpus(seed=4, n=120)
    assert found(spark, rows, batch_entries=20) == expected(rows)


def test_other_length(spark):
    rows = corpus(seed=5)
    assert found(spark, rows, length=77) == expected(rows, 77)
    with pytest.raises(ValueError):
        suffixes.dedup_digest(spark.createDataFrame(rows, "doc_id long, text string"), length=20)


def test_blocks_of_one_text_meet_at_their_edges():
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    offsets = np.array([0, 10, 4900, 5000])
    for limit in (64, 1000, 10_000):
        at = []
        for first, end, low, high in pieces(offsets, limit, 49):
            starts = np.append(np.maximum(offsets[first:end], low) - low, high - low)
            _, begin, last = suffixes._entries(data[low:high], starts, 50)
            at += [p + low for b, t in zip(begin, last) for p in range(b, t + 1)]
        assert sorted(at) == [s for a, b in zip(offsets, offsets[1:]) for s in range(a, b - 49)]


def test_entries_are_ordered_without_moving_their_bytes():
    flat = {c: np.array([3, 1, 2]) for c in suffixes._Entries.FLAT}
    entries = suffixes._Entries(flat, np.array([0, 2, 3]), np.array([2, 1, 3]), np.frombuffer(b"aabccc", np.uint8))
    ordered = entries.take(np.argsort(entries.seed))
    assert ordered.text is entries.text and ordered.seed.tolist() == [1, 2, 3]
    assert ordered.copied().text.tobytes() == b"bcccaa" and ordered.copied().begin.tolist() == [0, 1, 4]
    both = ordered.take(np.array([2])).with_(entries.take(np.array([2, 1]))).copied()
    assert both.text.tobytes() == b"aacccb" and both.sizes.tolist() == [2, 3, 1]


def test_only_places_where_strings_start_are_hashed(monkeypatch):
    """An entry of one string has ``length`` bytes and one hash."""
    real, sizes = suffixes.hashed, []

    def counting(words):
        out = real(words)
        sizes.append(len(out))
        return out

    monkeypatch.setattr(suffixes, "hashed", counting)
    flat = {c: np.array([5, 5, 5]) for c in suffixes._Entries.FLAT} | {"row_id": np.array([1, 2, 3])}
    text = np.frombuffer(b"x" * 50 + b"y" * 50 + b"x" * 50, np.uint8)
    family = suffixes.IndexFamily(50)
    batch, at, begin, last = family.add(suffixes._Entries(flat, np.array([0, 50, 100]), np.array([50, 50, 50]), text))
    assert sizes == [3] and batch.row_id[at].tolist() == [3] and begin.tolist() == last.tolist() == [0]
    assert family.levels[0].row_id.tolist() == [1, 2] and len(family.levels[0].text) == 100


def test_sliding_min_and_hashes():
    values = np.random.default_rng(1).integers(0, 100, 50).astype(np.uint64)
    assert sliding_min(values, 7).tolist() == [values[i : i + 7].min() for i in range(44)]
    data = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz" * 2, np.uint8)
    hashes = gram_hashes(data, 20)
    assert len(hashes) == 33 and hashes[0] == hashes[26] and len(set(hashes.tolist())) == 26


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.dedup_digest(docs).collect() == []
    assert suffixes.dedup(docs).collect() == []


def test_documents_keep_their_columns(spark):
    passage = "ein längerer Satz, der in mehreren Dokumenten genau so vorkommt, Wort für Wort"
    rows = [(1, f"eins {passage} ä", 3, "a"), (2, f"zwei {passage}", 4, "b"), (3, passage, 5, "c"), (4, None, 6, "d"), (5, "", 0, "e")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_chars long, spans string")
    done = {r.doc_id: r for r in suffixes.dedup(docs).collect()}
    assert suffixes.dedup(docs).schema == docs.schema
    assert done[1].text == rows[0][1] and done[1].n_chars == 3
    assert done[2].text == "zwei" and done[2].n_chars == 4 and done[2].spans == "b"
    assert 3 not in done and done[4].text is None and done[5].text == ""


def test_shuffled_table_takes_several_batches(spark, monkeypatch, tmp_path):
    real, folder = suffixes._scan_runs, str(tmp_path)

    def counting(length, batch_entries):
        scan = real(length, batch_entries)

        def counted(batches):
            for spans in scan(batches):
                tempfile.mkstemp(dir=folder)
                yield spans

        return counted

    monkeypatch.setattr(suffixes, "_scan_runs", counting)
    rows = corpus(seed=6, n=300)
    assert found(spark, rows, batch_entries=1) == expected(rows)
    # Each of the 8 shards takes its runs in one batch where every piece spans all ids.
    assert len(list(tmp_path.iterdir())) >= 16


def entries(ids, strings, seed=5):
    """One string an entry, all of one seed."""
    n, length = len(ids), len(strings[0])
    flat = {c: np.full(n, seed) for c in suffixes._Entries.FLAT} | {"row_id": np.array(ids)}
    text = np.frombuffer(b"".join(strings), np.uint8)
    return suffixes._Entries(flat, np.arange(n) * length, np.full(n, length), text)


def test_a_seed_in_many_surroundings_is_no_work_for_later_batches(monkeypatch):
    """A batch hashes its own strings, however many entries before it have the same seed."""
    real, sizes = suffixes.hashed, []

    def counting(words):
        out = real(words)
        sizes.append(len(out))
        return out

    monkeypatch.setattr(suffixes, "hashed", counting)
    draw, family = random.Random(2), suffixes.IndexFamily(50)
    strings = [draw.randbytes(50) for _ in range(300)]
    for i in range(0, 300, 10):
        assert not len(family.add(entries(range(i, i + 10), strings[i : i + 10]))[1])
    assert sizes == [10] * 30
    assert sum(len(level) for level in family.levels) == 300 and len(family.levels) <= 9
    batch, at, *_ = family.add(entries([400, 401, 402], [strings[7], b"x" * 50, strings[299]]))
    assert sorted(batch.row_id[at].tolist()) == [400, 402]
    assert sum(len(level) for level in family.levels) == 301


def test_strings_of_one_hash_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(suffixes, "hashed", lambda words: sum(w * np.uint64(0) for w in words))
    draw, family = random.Random(3), suffixes.IndexFamily(50)
    strings = [draw.randbytes(50) for _ in range(8)]
    for i in range(0, 8, 2):
        assert not len(family.add(entries([i, i + 1, i + 1], [strings[i], strings[i + 1], strings[i + 1]]))[1])
    batch, at, *_ = family.add(entries([20, 21, 22, 23, 24], [strings[6], b"x" * 50, strings[1], b"x" * 50, strings[0]]))
    assert sorted(batch.row_id[at].tolist()) == [20, 22, 23, 24]


def test_a_seed_in_other_surroundings_does_not_travel(spark, monkeypatch, tmp_path):
    """Only strings whose seed has 17 more bytes beside it in common with another piece's go to a shard."""
    real, folder = suffixes._scan_runs, str(tmp_path)

    def counting(length, batch_entries):
        scan = real(length, batch_entries)

        def counted(batches):
            for batch in batches:
                for _ in range(batch.num_rows):
                    tempfile.mkstemp(dir=folder)
                yield from scan(iter([batch]))

        return counted

    monkeypatch.setattr(suffixes, "_scan_runs", counting)
    draw = random.Random(8)
    noise = lambda: "".join(chr(draw.randrange(97, 123)) for _ in range(40))
    rows = [(i, noise() + " the common phrase of them all " + noise()) for i in range(100)]
    assert found(spark, rows) == expected(rows)
    assert not list(tmp_path.iterdir())
    rows += [(200 + i, rows[i][1][: 60 + i]) for i in range(0, 20, 5)]
    assert found(spark, rows) == expected(rows)
    assert list(tmp_path.iterdir())


def test_narrowed_runs_keep_every_string(spark):
    """Copies that begin and end at all places around their seeds, across pieces."""
    draw = random.Random(9)
    text = "".join(chr(draw.randrange(97, 123)) for _ in range(400))
    rows = [(0, text)] + [(1 + i, "#" * (i % 3) + text[i : i + 50 + i % 40] + "#") for i in range(300)]
    draw.shuffle(rows)
    assert found(spark, rows, batch_entries=5) == expected(rows)


def test_runs_come_back_as_they_were():
    fields = np.array([[5, 2, 2**32 - 1], [50, 84, 60], [0, 34, 12], [7, 0, 2**32 - 1], [2**31, 0, 2**32 - 1]], np.uint32)
    text = np.frombuffer(random.Random(4).randbytes(194), np.uint8)
    run = suffixes._packed(7 << 32, fields, text, suffixes.zstandard.ZstdCompressor(level=5))
    number, back, bytes_ = suffixes._unpacked(3, run)
    assert number == 7 << 32 and (back == fields).all() and bytes_.tobytes() == text.tobytes()
