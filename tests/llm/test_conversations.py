"""The prefix trie against one built of dictionaries, with shards and copies of every size."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from check_oracle import rows_of
from tagwright.llm import conversations as trie


def expected(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[c].append(((turn is not None, turn or 0), name, (role, text)))
    own = {c: [t for _, _, t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        size = len(node[-1][1].encode()) if node else 0
        leaves, saved = (0 if children[node] else 1), (len(members[node]) - 1) * size
        for child in children[node]:
            leaves, saved = leaves + sums[child][0], saved + sums[child][1]
        sums[node] = leaves, saved
    out = []
    for node, found in members.items():
        ends = ",".join(map(str, sorted(c for c in found if whole[c] == node)))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(found), len(node), parent, len(found), len(children[node]), *sums[node], digest))
    return sorted(out, key=repr)


def found(frame, rebuild=True):
    done = trie.trie(frame, rebuild)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in done.select(*names).collect()), key=repr)


def corpus(n, seed, turns=8, kinds=3):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        if draw.random() < 0.15:
            continue
        kind = draw.random()
        for t in range(draw.randrange(1, turns) if kind < 0.9 else 25):
            text = f"t{draw.randrange(kinds)}" if draw.random() < 0.8 else "é" * draw.randrange(30)
            rows.append((c, t, draw.choice(["user", "bot"]) if t % 7 == 6 else "user", "hot" if kind < 0.3 else text))
    draw.shuffle(rows)
    return rows


COLUMNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("rebuild", [True, False])
@pytest.mark.parametrize("size", [2048, 7])
def test_equals_dictionaries(spark, monkeypatch, size, rebuild):
    monkeypatch.setattr(trie, "SHARD_CONVERSATIONS", size)
    rows = corpus(300, 1)
    frame = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert found(frame, rebuild) == expected(rows, rebuild)


def test_odd_rows(spark):
    rows = [(0, 0, None, "a"), (0, None, "user", None), (0, None, "user", None), (3, 1, "user", "b"), (3, 1, "user", "a"), (3, 1, "user", "a")]
    rows += [(None, 0, "user", "lost"), (-3, 0, "user", "x"), (-5, 0, "user", "x"), (-7, 0, "user", "y"), (-7, 1, "", ""), (4, 0, "us", "era")]
    rows += [(9, 0, "u", "sera"), (1 << 40, 5, "user", "long " * 20_000), (7, 9, "user", "a"), (7, -9, "user", "a")]
    frame = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'clash' key", "1 depth", "2 up", "3 base", "4 digest")
    assert found(frame) == expected(rows)
    assert found(frame, False) == expected(rows, False)
    assert found(frame.limit(0)) == [] and trie.digest(frame.filter("conv_id is null")).collect() == []


def test_long_shared_chain(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_TURNS", 100)
    rows = [(c, t, "user", f"{t}") for c in (10, 20, 30, 11) for t in range(150)] + [(40, t, "user", f"{t}") for t in range(77)]
    frame = spark.createDataFrame(rows, COLUMNS)
    assert found(frame) == expected(rows)


def test_one_group_of_copies_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_CONVERSATIONS", 10)
    rows = [(c, t, "user", f"same {t}") for c in range(400) for t in range(3)] + corpus(50, 5)
    rows = [(c + (1000 if i >= 1200 else 0), *rest) for i, (c, *rest) in enumerate(rows)]
    assert found(spark.createDataFrame(rows, COLUMNS).repartition(7)) == expected(rows)


def test_equals_sql(spark, tmp_path):
    import duckdb

    rows = corpus(120, 3) + [(200, None, None, "x"), (200, None, "user", None), (None, 1, "user", "x"), (203, 4, "user", "x")]
    frame = spark.createDataFrame(rows, COLUMNS)
    con = duckdb.connect()
    con.register("conversations", frame.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert rows_of(con.execute(trie.SQL).df()) == rows_of(trie.digest(frame).toPandas())
