"""SimHash near-dedup against a comparison of all pairs."""

import random
from itertools import combinations

import pytest
import xxhash

from pyspark.sql import functions as F

from tagwright.llm import simhash
from tagwright.llm.textbytes import parts_between_words


def fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows, max_bits=2):
    prints = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= max_bits:
            parent[root(i)] = root(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            smallest[root(i)] = min(smallest.get(root(i), doc_id), doc_id)
    return sorted(((d, f"{p:016x}", smallest.get(root(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=repr)


def corpus(n=80):
    draw = random.Random(2)
    rows = []
    for i in range(n):
        words = [draw.choice("abcdefgh") * draw.randrange(1, 4) for _ in range(draw.randrange(1, 300))]
        rows.append((10 * i, " ".join(words)))
        for k in range(draw.randrange(3)):
            words[draw.randrange(len(words))] = "changed"
            rows.append((10 * i + k + 1, "\n".join(words)))
    rows += [(2000, ""), (2001, None), (2002, " \t\n"), (2003, "One"), (2004, "one"), (2005, "Two words"), (None, "one")]
    rows += [(2006, "É x y z"), (2007, "é x y z"), (2003, "One"), (2003, "three is here now"), (2008, "one two three four")]
    draw.shuffle(rows)
    return rows


def test_equals_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in simhash.digest(docs).collect()), key=repr) == expected(rows)


@pytest.mark.parametrize("max_bits", [0, 1, 2, 3, 6])
def test_links_lose_no_pair(spark, max_bits):
    draw = random.Random(max_bits)
    base = [draw.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for value in base:
        for _ in range(6):
            flipped = value
            for b in draw.sample(range(64), draw.randrange(1, 8)):
                flipped ^= 1 << b
            prints.add(flipped)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    distinct = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    found = {tuple(r) for r in simhash.links(distinct, max_bits).distinct().collect()}
    mask = (1 << 64) - 1
    assert found == {
        (a, b) for a, b in combinations(sorted(signed), 2) if ((a ^ b) & mask).bit_count() <= max_bits
    }


def test_references_tell_bits_apart():
    for width in (8, 11, 16):
        refs = [simhash._reference(n, width) for n in range(simhash.REFERENCES)]
        draw = random.Random(width)
        values = {draw.getrandbits(width) for _ in range(3000)}
        assert len({tuple((v ^ r).bit_count() for r in refs) for v in values}) == len(values)


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr("tagwright.llm.textbytes.WORD_BYTES", 50)
    text = (" ".join(f"word{i}" for i in range(100)) + " " + "x" * 120 + "\nend").encode()
    assert b"".join(parts_between_words(text)) == text
    assert [w for p in parts_between_words(text) for w in p.split()] == text.split()
    whole = [h for part in simhash.shingle_hashes(text, 3) for h in part.tolist()]
    words = text.split()
    assert whole == [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]


def test_one_of_each_group_stays(spark):
    text = "the same words in this document and in the other one"
    rows = [(3, text, 1), (1, text, 2), (1, text, 2), (2, text.upper(), 3), (9, "something else altogether here", 4), (None, None, 5), (None, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint long")
    kept = simhash.first_of_each(docs)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id or 0, r.fingerprint) for r in kept.collect() if r.doc_id) == [(1, 2), (9, 4)]
    assert kept.filter(F.col("doc_id").isNull()).count() == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.digest(docs).collect() == [] and simhash.first_of_each(docs).collect() == []


def test_pairs_are_no_cross_join(spark):
    plan = simhash.links(spark.createDataFrame([(1,), (2,)], "fingerprint long"))
    text = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    assert "Cartesian" not in text and "NestedLoop" not in text
