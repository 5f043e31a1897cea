"""Context-tree weighting against trees made of dictionaries, and the gain on held-out texts."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tagwright.llm import codelength as cl


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


class Direct:
    """All trees as dictionaries: (decision, context) to the bits that followed."""

    def __init__(self, texts):
        self.bits = defaultdict(lambda: [0, 0])
        for text in texts:
            for decision, context, bit in self.decisions(text):
                for d in range(cl.DEPTH + 1):
                    self.bits[decision, context[:d]][bit] += 1
        self.children = defaultdict(set)
        for decision, context in list(self.bits):
            if context:
                self.children[decision, context[:-1]].add((decision, context))
        self.known = {}

    @staticmethod
    def decisions(text):
        data = b"\n" * cl.DEPTH + text
        for p in range(cl.DEPTH, len(data)):
            context, node = data[p - cl.DEPTH : p][::-1], 1
            for j in range(7, -1, -1):
                bit = data[p] >> j & 1
                yield node, context, bit
                node = node << 1 | bit

    @staticmethod
    def own(zeros, ones):
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)

    def weighted(self, node):
        """Logarithms of a node's own, its children's and its weighted probability."""
        if node not in self.known:
            own = self.own(*self.bits[node]) if node in self.bits else 0.0
            below = sum(self.weighted(c)[2] for c in self.children.get(node, ()))
            mixed = own if len(node[1]) == cl.DEPTH else np.logaddexp(own, below) - math.log(2)
            self.known[node] = own, below, mixed
        return self.known[node]

    def bits_of(self, text):
        total = 0.0
        for decision, context, bit in self.decisions(text):
            chance = None
            for d in range(cl.DEPTH, -1, -1):
                node = decision, context[:d]
                seen = self.bits.get(node, [0, 0])
                estimate = (seen[bit] + 0.5) / (sum(seen) + 1)
                if chance is None:
                    chance = estimate
                else:
                    own, below, _ = self.weighted(node)
                    share = 1 / (1 + math.exp(min(700, max(-700, below - own))))
                    chance = share * estimate + (1 - share) * chance
            total -= math.log2(chance)
        return total


def expected(rows):
    texts = [(i, cl.tokens_of(t)) for i, t in rows]
    model = Direct([t for i, t in texts if not held(i)])
    counts = Counter(w for i, t in texts if not held(i) for w in [*t.split(), b"\n"])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in texts:
        words = [*t.split(), b"\n"]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        bits = model.bits_of(t)
        out.append((i, held(i), len(words), sum(counts[w] > 0 for w in words), n, base, -bits * math.log10(2), len(t), bits / len(t)))
    return sorted(out, key=repr)


def same(got, want):
    got = sorted((tuple(r) for r in got), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[7] == b[7]
        assert a[5] == pytest.approx(b[5], rel=1e-12, abs=1e-12) and a[6] == pytest.approx(b[6], rel=2e-6) and a[8] == pytest.approx(b[8], rel=2e-6)


def corpus(n=60, seed=1):
    draw = random.Random(seed)
    words = ["stone", "Lake", "river", "cloud", "rivers", "été", "日本", "a", "b1"]
    rows = [(i, " ".join(draw.choice(words) for _ in range(draw.randrange(30))) + draw.choice(["", " ", "\n\n", "\t x"])) for i in range(n)]
    rows += [(n + 1, None), (n + 2, ""), (None, "river without a number"), (n + 3, rows[3][1]), (3, rows[3][1]), (3, rows[3][1])]
    return rows + [(n + 4, "\x00\x0b\x0c end"), (n + 5, "ÀÉ ẞ İ"), (n + 6, "z" * 300)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' key", "1 block", "2 held", "3 n_tokens")


def test_equals_dictionaries(spark):
    rows = corpus()
    same(cl.scores(frame(spark, rows).repartition(4)).collect(), expected(rows))


def test_many_blocks_buckets_and_segments(spark, monkeypatch):
    monkeypatch.setattr(cl, "BUCKET_BYTES", 500)
    monkeypatch.setattr(cl, "SEGMENT_STRINGS", 40)
    monkeypatch.setattr(cl, "TASK_STRINGS", 100)
    monkeypatch.setattr(cl, "PART_BYTES", 120)
    rows = corpus(80, 2) + [(500, "one long text " * 40 + "y" * 700 + " after"), (501, "w" * 900)]
    same(cl.scores(frame(spark, rows).repartition(3), block_bytes=300).collect(), expected(rows))


def test_nothing_to_learn_from(spark):
    rows = [(i, "some words") for i in range(40) if held(i)]
    got = cl.scores(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r.bits_per_byte == pytest.approx(8) and r.base_score == 0 and r.train_tokens == r.n_known == 0 for r in got)
    assert cl.scores(frame(spark, rows).limit(0)).collect() == []


def test_probabilities_of_next_bytes_sum_to_one(spark):
    model = Direct([cl.tokens_of(t) for _, t in corpus()])
    before = model.bits_of(b"river st")
    assert sum(2 ** (before - model.bits_of(b"river st" + bytes([x]))) for x in range(256)) == pytest.approx(1)


def test_estimates_of_large_counts():
    zeros, ones = np.array([0, 3, 5000, 4096, 10**6, 10**9]), np.array([0, 0, 1, 4095, 10**6, 7])
    want = [Direct.own(int(a), int(b)) for a, b in zip(zeros, ones)]
    assert cl.log_estimate(zeros, ones) == pytest.approx(want, rel=1e-12, abs=1e-5)


def test_held_out_texts_gain_from_context_and_from_more_text(spark, small_folder):
    docs = spark.read.parquet(f"{small_folder}/documents.parquet")
    got = [r for r in cl.scores(docs).collect() if r.held_out]
    few = [r for r in cl.scores(docs.filter("doc_id < 60")).collect() if r.held_out]
    both = {r.doc_id: r.bits_per_byte for r in got}
    assert np.mean([both[r.doc_id] for r in few]) < np.mean([r.bits_per_byte for r in few])


def test_more_than_one_part_of_texts(spark, monkeypatch):
    monkeypatch.setattr(cl, "SEGMENT_STRINGS", 500)
    rows = corpus(600, 4)
    same(cl.scores(frame(spark, rows).coalesce(1)).collect(), expected(rows))
