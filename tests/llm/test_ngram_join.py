"""Components against all pairs."""

import itertools
import random

import pytest

from quillon.llm.ngram_join import near_duplicate_groups

SCHEMA = "doc_id bigint, text string, n string, v string, component_id int"


def brute(rows, size=4, percent=85):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    low = {d: d for d, _ in rows if d is not None}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if None not in (rows[i][0], rows[j][0]) and a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((root(rows[i][0]), root(rows[j][0])))
            low[y] = x
    return sorted(((d, len(s), root(d) if d is not None else None) for (d, _), s in zip(rows, sets, strict=True)), key=str)


def ours(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA).repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicate_groups(df, **kw).collect()), key=str)


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(vocab) for _ in range(60)]
    texts = []
    while len(texts) < n:
        base = [rng.choice(vocab) for _ in range(rng.choice([2, 5, 30, 80, 150, 300]))]
        if rng.random() < 0.3:
            base[len(base) // 2 : len(base) // 2] = passage
        texts.append(base)
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                k = rng.randrange(len(copy))
                copy[k : k + rng.randint(0, 2)] = [rng.choice(vocab)] * rng.randint(0, 2)
            texts.append(copy)
    rows = [(i * 3 + 1, " ".join(t).upper() if i % 7 == 0 else "\n".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,hot_df", [(1, 1024), (2, 4), (3, 1)])
def test_like_all_pairs(spark, seed, hot_df):
    rows = corpus(seed)
    got = ours(spark, rows, hot_df=hot_df)
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(rows)


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, "  \n\t "), (8, "one two"), (2, "ONE\x0btwo"), (9, "one two three"), (None, "one two"), (3, "a b c d e"), (3, "a b c d e"), (4, "é É"), (1, "É É")]
    assert ours(spark, rows) == brute(rows)
    assert ours(spark, []) == []
    text = " ".join(f"x{i}" for i in range(20_000))
    assert ours(spark, [(2, text), (1, text + " end"), (3, "other words are here now")]) == brute([(2, text), (1, text + " end"), (3, "other words are here now")])


def test_other_thresholds(spark):
    rows = corpus(9, 60)
    assert ours(spark, rows, percent=60) == brute(rows, percent=60)
    assert ours(spark, rows, percent=100, size=2) == brute(rows, size=2, percent=100)
