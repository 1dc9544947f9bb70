"""Scores against a plain recursion over counters."""

import collections
import math
import zlib

import pytest

from quillon.llm.lm_scoring import score_texts

SCHEMA = "doc_id bigint, text string, score int, block string"


def brute(rows, order=2, mu=4.0):
    seqs = [(d, ["<s>", *(t or "").encode().lower().split(), "</s>"]) for d, t in rows]
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = collections.Counter()
    for d, s in seqs:
        if not out(d):
            for k in range(1, order + 1):
                c.update(tuple(s[i : i + k]) for i in range(len(s) - k + 1))
    uni = {g: n for g, n in c.items() if len(g) == 1 and g != ("<s>",)}
    n, v = sum(uni.values()), len(uni)

    def p(h, w):
        if not h:
            return (uni.get((w,), 0) + 1) / (n + v + 1)
        past = c[h]
        return (c[(*h, w)] + mu * p(h[1:], w)) / (past + mu) if past else p(h[1:], w)

    got = []
    for d, s in seqs:
        score = sum(math.log10(p(tuple(s[max(0, i - order + 1) : i]), s[i])) for i in range(1, len(s)))
        base = sum(math.log10(p((), w)) for w in s[1:])
        got.append((d, out(d), len(s) - 1, sum(uni.get((w,), 0) > 0 for w in s[1:]), n, base, score))
    return sorted(got, key=str)


def check(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, 1, "b") for d, t in rows], SCHEMA).repartition(3)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in score_texts(df, **kw).collect()), key=str)
    want = brute(rows, **kw)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert g[6] == pytest.approx(w[6], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_like_recursion(spark, order):
    rows = [(i, " ".join(f"W{(i * j * j) % 13}" for j in range(i % 40))) for i in range(60)]
    check(spark, rows, order=order)


def test_edges(spark):
    check(spark, [(1, None), (2, ""), (3, " \t\n"), (None, "a b"), (4, "a B a"), (4, "a B a"), (5, "É é\x0bx y"), (6, "z " * 20_000)])
    check(spark, [])
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    check(spark, [(held[0], "only held out")])


def test_whole_fixture(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, rows)
