"""Top-k against all inner products in Python integers."""

import math
import random

import numpy as np
import pytest

from quillon.llm.topk import DualSearch, _scores, top_inner_products

SCHEMA = "vec_id bigint, embedding array<float>, rank int, score string"


def brute(rows, k=5, every=50):
    def ints(v):
        return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) for x in v]

    ok = [(i, x) for i, v in rows if i is not None and (x := ints(v)) is not None]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        best = []
        for x in {tuple(x) for i, x in ok if i == q}:
            best += [(-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in ok if i != q and len(x) == len(y)]
        out += [(q, r + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, i) in enumerate(sorted(best)[:k])]
    return out


def ours(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], SCHEMA).repartition(3)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_inner_products(df, **kw).collect())


def f32(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_like_all_pairs(spark):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(6)]
    rows = [(i, [f32(c + rng.gauss(0, 0.05)) for c in centres[i % 6]]) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]
    rng.shuffle(rows)
    assert ours(spark, rows) == brute(rows)
    assert ours(spark, rows, query_block=7, k=3) == brute(rows, k=3)
    assert ours(spark, rows, query_block=3, piece_rows=40, routed=2) == brute(rows)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0]), (100, [float("nan"), 1.0]), (150, None), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [None, 1.0]), (4, [float("inf"), 0.0]), (0, [1.0, 2.0]), (200, []), (5, [])]
    assert ours(spark, rows) == brute(rows)
    assert ours(spark, []) == []
    large = [(0, [1e12, 3.0]), (1, [f32(1e12), 1.0]), (2, [1.0, 1.0]), (3, [-1e12, 0.0])]
    large = [(i, [f32(x) for x in v]) for i, v in large]
    assert ours(spark, large) == brute(large)
    wide = [(i, [f32((1 + (i * 7 % 13)) * 1e12 * (-1 if i % 3 == 0 else 1)), 1.0]) for i in range(60)] + [(50, [1.0, 2.0])]
    want = brute(wide)
    assert ours(spark, wide) == want and len({s for _, _, _, s in want}) < len(want)  # cut, but ranked by exact scores
    assert ours(spark, wide, piece_rows=7) == want


def test_repeated_rows(spark):
    """A third of the rows is one row; query rows that repeat count once."""
    rows = [(0, [1.0, 0.0])] * 40 + [(7, [0.9, 0.1])] * 40 + [(i, [0.01 * i, 0.5]) for i in range(1, 41)]
    assert ours(spark, rows) == brute(rows)
    assert ours(spark, rows, piece_rows=11) == brute(rows)


def test_order_of_scores_beyond_64_bits():
    s = np.array([2**70, 2**63, 2**63 - 1, 5, -(2**63), -(2**63) - 1, -(2**70)], object)
    keys = list(zip(_scores(s)["score"], _scores(s)["beyond"], strict=True))
    assert keys == sorted(keys, reverse=True) and len(set(keys)) == len(keys)


@pytest.mark.parametrize("spread,most", [(0.02, 0.1), (0.05, 0.4)])
def test_prunes_clustered_rows(spread, most):
    """The share of all pairs that is multiplied out, on 16,384 unit vectors of 64 dimensions around 200 centres."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(200, 64))
    centres /= np.sqrt((centres**2).sum(1))[:, None]
    y = np.floor(256 * (centres[rng.integers(0, 200, 16_384)] + spread * rng.normal(size=(16_384, 64))))
    ids = np.arange(len(y))
    at = np.flatnonzero(ids % 50 == 0)
    dual = DualSearch(ids, y, 5)
    q, r, s = dual.run(ids[at], y[at], np.full(len(at), -np.inf))
    product = y[at] @ y.T
    product[np.arange(len(at)), at] = -np.inf
    want = np.lexsort((np.broadcast_to(ids, product.shape), -product), axis=-1)[:, :5]
    got = {(int(a), int(b), float(c)) for a, b, c in zip(q, r, s, strict=True)}
    assert got == {(i, int(j), float(product[i, j])) for i in range(len(at)) for j in want[i]}
    assert dual.visited < most * dual.pairs
