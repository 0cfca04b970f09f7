"""Fingerprints and components against a plain version that compares all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from gridstat.llm import simhash

WORDS = [f"w{i}" for i in range(200)]


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    spans = [words[i : i + 4] for i in range(len(words) - 3)] or [words]
    h = [xxhash.xxh64(" ".join(s).encode(), seed=42).intdigest() for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    """(doc_id, fingerprint, component) of (doc_id, text), by repeated passes over all pairs."""
    fps = [(d, plain_fingerprint(t)) for d, t in rows]
    near = [[j for j, y in enumerate(fps) if (x[1] ^ y[1]).bit_count() <= 4] for x in fps]
    group, todo = [None] * len(fps), 0
    for i in range(len(fps)):
        stack = [i] if group[i] is None else []
        while stack:
            k = stack.pop()
            if group[k] is None:
                group[k] = todo
                stack += near[k]
        todo += 1
    least = {}
    for g, (d, _) in zip(group, fps, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return sorted(((d, f"{f:016x}", least.get(g)) for g, (d, f) in zip(group, fps, strict=True)), key=str)


def corpus():
    r = random.Random(5)
    base = [r.choice(WORDS) for _ in range(400)]
    rows = [None, None, "", " \t\n\x0b\x0c\r", "one", "One", "one two three", "one two three four", "a b c d e", "é Ü 日本 \x85 ü", "\x00 \x1c", "word " * 5000]
    for k in range(60):  # near copies, so that grid points are shared by many
        w = list(base)
        for _ in range(k % 4):
            w[r.randrange(len(w))] = r.choice(WORDS)
        rows.append(" ".join(w))
    rows += [" ".join(base)] * 20 + [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 60))) for _ in range(80)]
    return [(3 * i, t) for i, t in enumerate(rows)]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("cell", "width"), [(100, 2), (5, 2), (5, 1)])
def test_components(spark, monkeypatch, cell, width):
    """The same whether grid points are compared whole or are taken for crowded ones, and on either grid."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, fp int, cell string").repartition(3)
    df = simhash.classes(docs, width=width)
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    assert got(df) == plain_components(rows)


def test_blocks_find_what_rounds_leave(spark, monkeypatch):
    """Without a round, all links of crowded points come from blocks."""
    monkeypatch.setattr(simhash, "CELL", 4)
    monkeypatch.setattr(simhash, "ROUNDS", 0)
    rows = corpus()[10:110]
    assert got(simhash.classes(spark.createDataFrame(rows, "doc_id long, text string"))) == plain_components(rows)


def test_ids(spark):
    """Null and repeated ids, ids that are no numbers, and an empty table."""
    rows = [(None, "a b c d"), (None, "z"), (7, "a b c d"), (7, "y x"), (5, "y x"), (None, None)]
    assert got(simhash.classes(spark.createDataFrame(rows, "doc_id long, text string"))) == plain_components(rows)
    named = [(None if d is None else f"id{d}", t) for d, t in rows]
    assert got(simhash.classes(spark.createDataFrame(named, "doc_id string, text string"))) == plain_components(named)
    assert got(simhash.classes(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_grid_covers_all_near_pairs(spark):
    """Any two fingerprints of 4 differing bits share a grid point, on both grids."""
    r = random.Random(3)
    pairs = []
    for _ in range(300):
        a = r.getrandbits(64) if r.random() < 0.8 else r.choice([0, 2**64 - 1])
        b = a
        for bit in r.sample(range(64), 4):
            b ^= 1 << bit
        pairs.append(tuple(int(np.uint64(v).astype(np.int64)) for v in (a, b)))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pairs, "a long, b long")
    for width in (1, 2):
        share = F.arrays_overlap(simhash.grid_points(F.col("a"), width), simhash.grid_points(F.col("b"), width))
        assert df.filter(~share).isEmpty()


def test_long_text():
    """Counted in several parts."""
    text = " ".join(str(i * 7919 % 10007) for i in range(2 * simhash.COUNTED + 5))
    assert np.int64(simhash.fingerprint_of(text)).view(np.uint64) == plain_fingerprint(text)
