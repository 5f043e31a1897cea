"""License scans against a search of all windows."""

import random
import re

import pytest

from tagwright.llm import licenses


def words(text):
    return re.findall(r"[0-9a-z\x80-￿]+", (text or "").lower())


def shingles(ws, size=5):
    return {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)}


LONG = " ".join(f"term{i} of clause{i % 7}" for i in range(60))
TEMPLATES = {**licenses.TEMPLATES, "long": LONG}


def matches(text, threshold=0.8):
    """Templates of which some stretch of about their own length holds enough shingles."""
    ws, out = words(text), set()
    for name, template in TEMPLATES.items():
        t = shingles(words(template))
        span = len(words(template))
        best = max((len(shingles(ws[i : i + span]) & t) for i in range(max(1, len(ws) - span + 1))), default=0)
        if best / len(t) >= threshold:
            out.add(name)
    return out


def corpus():
    draw = random.Random(3)
    vocabulary = ["the", "of", "license", "under", "version", "näch", "2", "word"]
    rows = []
    for i in range(150):
        ws = [draw.choice(vocabulary) for _ in range(draw.randrange(0, 120))]
        for name in draw.sample(sorted(TEMPLATES), draw.randrange(3)):
            text = TEMPLATES[name].split()
            if name == "long" and draw.random() < 0.6:
                text[draw.randrange(len(text))] = "changed"
            at = draw.randrange(len(ws) + 1)
            ws[at:at] = [w.upper() if draw.random() < 0.2 else w for w in text]
        rows.append((i, draw.choice([" ", "\n", "  "]).join(ws)))
    rows += [(900, None), (901, ""), (902, "Released under the MIT"), (903, "x" * 3000), (904, "Released   under; the (MIT) license")]
    rows += [(905, "pad " * 400_000 + " Licensed under CC BY-NC 4.0. " + "end " * 300_000), (0, rows[0][1]), (None, TEMPLATES["MIT"])]
    return rows


def test_equals_search_of_all_windows(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or -1, r.license) for r in licenses.scanned(docs, TEMPLATES).collect())
    small = [(i, t) for i, t in rows if not t or len(t) < 10_000]
    want = [(i or -1, name) for i, t in small for name in matches(t)] + [(905, "CC-BY-NC-4.0")]
    assert got == sorted((-1 if i == 0 else i, n) for i, n in want) or got == sorted(want)


def test_place_of_the_match(spark):
    text = "é padding words first\nLicensed under the Apache License, Version 2.0. and more"
    docs = spark.createDataFrame([(1, text, "clash")], "doc_id int, text string, license string")
    row = licenses.scanned(docs).first()
    assert text.encode()[row.first_byte : row.end_byte].decode() == "Licensed under the Apache License, Version 2.0"
    assert (row.license, row.containment) == ("Apache-2.0", 1.0)


def test_near_match_and_near_miss(spark):
    ws = LONG.split()
    near = [w if i != 90 else "other" for i, w in enumerate(ws)]
    far = [w if i % 12 else "other" for i, w in enumerate(ws)]
    docs = spark.createDataFrame([(1, " ".join(near)), (2, " ".join(far))], "doc_id long, text string")
    rows = licenses.scanned(docs, TEMPLATES).collect()
    assert [r.doc_id for r in rows] == [1] and 0.8 <= rows[0].containment < 1


def test_bands_guarantee():
    n = licenses.bands_for(0.25, 1)
    assert (1 - 0.25) ** n <= licenses.MISS < (1 - 0.25) ** (n - 1)
    assert licenses.bands_for(0.5, 2, 0.01) == 17


def test_empty_table_and_bad_templates(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scanned(docs).collect() == []
    assert licenses.scanned(spark.createDataFrame([(1, "a")], docs.schema), {}).collect() == []
    with pytest.raises(ValueError):
        licenses.scanned(docs, {"short": "two words"})


def test_full_texts_and_headers_are_found(spark):
    rows = [(i, f"some words before, {text}\nand after") for i, text in enumerate(licenses.NOTICES.values())]
    got = {(r.doc_id, r.license) for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(enumerate(licenses.NOTICES)) <= got
    assert {"MIT text", "Apache-2.0 header", "GPL-3.0 header", "BSD-3-Clause text", "MPL-2.0 header"} <= {n for _, n in got}


def test_inserts_inside_long_templates(spark):
    template = " ".join(f"w{i}" for i in range(516))
    ws, rows = template.split(), []
    for i, at in enumerate((60, 128, 256, 400, 500)):
        edited = [*ws[:at], *[f"new{j}" for j in range(300)], *ws[at:]]
        rows.append((i, "pad " * (3 * i) + " ".join(edited)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in licenses.scanned(docs, {"long": template}).collect():
        whole = shingles(words(rows[r.doc_id][1])) & shingles(ws)
        assert r.containment == pytest.approx(len(whole) / 512)
    assert licenses.scanned(docs, {"long": template}).count() == len(rows)
