"""The classifier by held-out accuracy, its parts by direct computation."""

import random
import zlib

import numpy as np
import pyarrow as pa

from quillon.llm.quality import dual_coordinate_descent, features, fit_quality, keep_quality, score_quality

DOC = "doc_id bigint, text string, score string, label int"


def corpus(n=600):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeionrst") for _ in range(rng.randint(2, 9)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(5, 200))]
        bad = rng.random() < 0.3
        if bad:
            kind = rng.randrange(3)
            w = [x.upper() + "!!" for x in w] if kind == 0 else [x + rng.choice(["$$$", "%%%"]) for x in w] if kind == 1 else [w[0]] * len(w)
        docs.append((i, " ".join(w)))
        labels.append((i, 0 if bad else 1))
    return docs, labels


def test_held_out(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], DOC).repartition(3)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int")
    model = fit_quality(d, lab, bits=16)
    got = {r.doc_id: r.score for r in score_quality(d, model, bits=16).collect()}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    truth = dict(labels)
    assert np.mean([(got[i] >= 0.5) == bool(truth[i]) for i in held]) > 0.97
    flipped = spark.createDataFrame([(i, q if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - q) for i, q in labels], "doc_id bigint, quality int")
    again = {r.doc_id: r.score for r in score_quality(d, fit_quality(d, flipped, bits=16), bits=16).collect()}
    assert again == got  # held-out labels are never used
    kept = keep_quality(d, model, bits=16)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.5}


def test_edges(spark):
    d = spark.createDataFrame([(1, None, "x", 1), (2, "", "x", 1), (None, "a", "x", 1), (3, "a b", "x", 1), (3, "a b", "x", 1), (4, "w " * 20_000, "x", 1)], DOC)
    none = spark.createDataFrame([(1, None)], "doc_id bigint, quality int")
    assert {r.score for r in score_quality(d, fit_quality(d, none, bits=12), bits=12).collect()} == {0.5}
    one = spark.createDataFrame([(i, q) for i in (1, 2, 3, 4) for q in (1, None, 0)] + [(9, 1)], "doc_id bigint, quality int")
    got = [r.score for r in score_quality(d, fit_quality(d, one, bits=12), bits=12).collect()]
    assert len(got) == 6 and len(set(np.round(got, 9))) == 1 and got[0] > 0.5
    assert score_quality(d.limit(0), fit_quality(d, one, bits=12), bits=12).collect() == []


def test_features_and_descent():
    slot, at = features(pa.array(["a b", None, "A b", "x x x"]), 16)
    sets = [set(slot[at[i] : at[i + 1]].tolist()) for i in range(4)]
    assert not sets[1] and sets[0] != sets[2] and sets[0] & sets[2] and len(sets[0]) == 5  # two words, a pair, one shape twice, a pair of shapes
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 3))
    y = np.where(x[:, 0] - 0.5 * x[:, 1] > 0.1, 1.0, -1.0)
    w, b = dual_coordinate_descent(np.tile(np.arange(3), 80), np.arange(0, 241, 3), x.ravel(), y, np.full(80, 10.0), 3, passes=200)
    assert np.mean(np.sign(x @ w + b) == y) > 0.97
