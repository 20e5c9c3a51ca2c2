"""Neighbour votes against a plain computation, held-out accuracy, and odd cases."""

from __future__ import annotations

import random
import zlib

import numpy as np

from boxloom.llm import quality

DOCS = "doc_id long, text string, score string, predicted string, k int, y int"
LABELS = "doc_id long, quality int, text string"


def corpus(n=240):
    rng = random.Random(6)
    words = [a + b for a in ("the", "an", "ou", "er", "in") for b in ("ed", "st", "ly", "", "wh", "re")]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(3, 60))]
        good = i % 3 > 0
        if not good:
            text = [[w.upper() + "!!" for w in text], [w + rng.choice("%%% ### $$$".split()) for w in text], [w for w in text for _ in range(5)]][i // 3 % 3]
        docs.append((i, " ".join(text) + "."))
        labels.append((i, int(good)))
    return docs, labels


def tables(spark, docs, labels):
    return spark.createDataFrame([(d, t, "s", "p", 1, 2) for d, t in docs], DOCS), spark.createDataFrame([(d, q, "x") for d, q in labels], LABELS)


def score(spark, docs, labels):
    a, b = tables(spark, docs, labels)
    out = quality.scored(a, quality.train(a, b))
    assert out.dtypes == [("doc_id", "bigint"), ("score", "double"), ("predicted", "int")]
    return [tuple(r) for r in out.collect()]


def test_votes_equal_a_plain_computation(spark):
    docs, labels = corpus(90)
    a, b = tables(spark, docs, labels)
    model = quality.train(a, b)
    held = {d for d, _ in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    assert len(model.labels) == len(docs) - len(held)
    rows = [quality.terms(t) for _, t in docs]
    latent = np.vstack([model.latent([r])[0] for r in rows]).astype(np.float64)
    for (doc, _), one, got in zip(docs, latent, score(spark, docs, labels)):
        near = [float(one @ v) for v in model.vectors.astype(np.float64)]
        last = sorted(near)[-quality.NEIGHBOURS]
        votes = [max(x, 0) ** quality.SHARPNESS if x >= last - quality.TIE else 0 for x in near]
        want = sum(v * y for v, y in zip(votes, model.labels)) / sum(votes)
        assert got[0] == doc and abs(got[1] - want) < 1e-3
        assert got[2] == int(got[1] >= quality.PREDICT)


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    right = [(p == q) for (d, _, p), (_, q) in zip(score(spark, docs, labels), labels) if zlib.crc32(str(d).encode()) % 4 == 2]
    assert len(right) > 40 and sum(right) / len(right) >= 0.9


def test_held_out_labels_are_never_read(spark):
    docs, labels = corpus(120)
    other = [(d, 1 - q if zlib.crc32(str(d).encode()) % 4 == 2 else q) for d, q in labels]
    assert score(spark, docs, labels) == score(spark, docs, other)


def test_odd_rows(spark):
    docs, labels = corpus(60)
    odd = [(None, "no id."), (None, None), (900, None), (901, ""), (902, " \n"), (903, "word " * 40_000), (3, docs[3][1]), (904, "\x00"), (905, "日本語 🙂")]
    more = [(None, 1), (900, 1), (901, None), (3, None), (3, 1), (12345, 0)]
    got = score(spark, docs + odd, labels + more)
    assert len(got) == len(docs) + len(odd)
    assert all(0 <= s <= 1 for _, s, _ in got)
    empty = {s for d, s, _ in got if d in (900, 901, 902)}
    assert len(empty) == 1


def test_nothing_to_learn_from_and_empty_tables(spark):
    docs, labels = corpus(6)
    assert {r[1:] for r in score(spark, docs, [])} == {(0.5, 0)}
    assert {r[1:] for r in score(spark, docs, [(d, None) for d, _ in docs])} == {(0.5, 0)}
    assert score(spark, [], labels) == []
    assert {r[2] for r in score(spark, docs[:3], [(0, 1), (1, 1), (2, 1)])} <= {1, 0}
