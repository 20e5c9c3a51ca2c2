"""Ranked lexical search against a plain count, and its odd cases."""

from __future__ import annotations

import math
import random
import re

import numpy as np

from boxloom.llm import lexical

DOCS = "doc_id long, text string, item_id string, rank int, score string, key long, item int, term long"
ITEMS = "item_id long, text string, doc_id string, key int"


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_ranking(docs, items, k):
    """Sorted (item_id, rank, doc_id, score)."""
    held = [(d, plain_terms(t)) for d, t in docs]
    held = [(d, t) for d, t in held if t]
    n_docs, total = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        found = []
        for d, t in held:
            m, score = 100 - 50 + (50 * len(t) * n_docs) // total, 0
            for x in set(plain_terms(text)) & set(t):
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * t.count(x)) // (1000 * t.count(x) + 20 * m))
            if score:
                found.append((-score, d is not None, d if d is not None else 0))
        out += [(item, r, d if here else None, -s) for r, (s, here, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def ranked(spark, docs, items, **kw):
    a = spark.createDataFrame([(d, t, "i", 1, "s", 2, 3, 4) for d, t in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(i, t, "d", 1) for i, t in items], ITEMS)
    out = lexical.ranked(a, b, **kw)
    assert out.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted([tuple(r) for r in out.collect()], key=str)


def corpus(rng):
    words = ["Haus", "haus", "über", "ÜBER", "日本", "a1", "b-c", "x_y", "été", "Z", "0"] + [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    docs += [(200 + i, "same text here, again and again") for i in range(20)]
    docs += [(300, None), (301, ""), (302, " \n.,!"), (303, "w1 " * 50_000), (None, "w1 w2 haus"), (None, "w1 w2 haus"), (7, "w1 w2 haus"), (7, "w1 w2 haus")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(20)]
    items += [(50, None), (51, "  "), (52, "nowhere found"), (53, "again SAME again"), (None, "w1"), (3, "w2 w3"), (3, "w2 w3")]
    return docs, items


def test_ranking(spark):
    docs, items = corpus(random.Random(1))
    assert ranked(spark, docs, items, k=7) == plain_ranking(docs, items, 7)


def test_small_tiles_and_blocks_give_the_same(spark):
    docs, items = corpus(random.Random(2))
    assert ranked(spark, docs, items[:9], k=3, item_tile=2, doc_tile=5, block_bytes=400) == plain_ranking(docs, items[:9], 3)


def test_empty_tables(spark):
    docs, items = corpus(random.Random(3))
    assert ranked(spark, [], items) == []
    assert ranked(spark, docs, []) == []
    assert ranked(spark, [(1, None), (2, "..")], items) == []


def test_cuts_keep_partial_sums_exact():
    block = lexical.Block.of([(1, " ".join(f"t{i}" for i in range(40)))])
    weights = np.full(40, 30_000, np.int64)
    limit = 12 * 30_000 * lexical.IMPACT
    tile = lexical.tiles(block, weights, exact=limit)[0]
    assert [b - a for a, b, _ in tile.cuts] == [11, 11, 11, 7]
    assert all(w.sum() * lexical.IMPACT < limit for _, _, w in tile.cuts)


def test_ties_of_a_tile_go_by_key():
    best = lexical._Best(1, 3)
    best.add(0, np.array([[5, 9, 5, 5, 5]]), [40, 50, 30, 20, 10])
    best.add(0, np.array([[5, 5]]), [5, 60])
    best.cut(0)
    assert [(x[2], -x[0]) for x in best.held[0]] == [(50, 9), (5, 5), (10, 5)]
