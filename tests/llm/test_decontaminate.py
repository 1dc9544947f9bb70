"""Containment against sets of word tuples."""

import random

from quillon.llm.decontaminate import contained_items, drop_contaminated

DOC = "doc_id bigint, text string, item_id string"
ITEM = "item_id bigint, text string, doc_id string"


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(docs, items):
    out = {}
    for d, t in docs:
        own = shingles(t)
        for i, q in items:
            want = shingles(q)
            if d is not None and i is not None and want and 100 * len(want & own) >= 80 * len(want):
                out[d, i] = max(out.get((d, i), (0, 1)), (len(want & own), len(want)), key=lambda x: x[0] / x[1])
    return sorted((d, i, c, n) for (d, i), (c, n) in out.items())


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], DOC).repartition(2)
    q = spark.createDataFrame([(a, b, "y") for a, b in items], ITEM)
    return sorted((r.doc_id, r.item_id, r.n_common, r.n_item) for r in contained_items(d, q, **kw).collect()), d, q


def corpus():
    rng = random.Random(4)
    word = lambda: f"v{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 6, 11, 12, 40, 90, 400])))) for i in range(40)]
    docs = []
    for d in range(150):
        w = [word() for _ in range(rng.choice([0, 4, 60, 400, 5000]))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            q = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, len(q) // 20])):
                q[rng.randrange(len(q))] = word()
            at = rng.randrange(len(w) + 1)
            half = len(q) // 2 if rng.random() < 0.2 else len(q)
            w[at:at] = q[:half]
            w += q[half:]
        docs.append((d, " ".join(w)))
    return docs, items


def test_like_sets(spark):
    docs, items = corpus()
    want = brute(docs, items)
    got, d, q = run(spark, docs, items)
    assert got == want and len(want) > 30
    assert run(spark, docs, items, block_items=7)[0] == want
    kept = drop_contaminated(d, q, block_items=13)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {x for x, _ in docs} - {w[0] for w in want}


def test_edges(spark):
    docs = [(1, None), (2, ""), (None, "a b c d e f"), (3, "A b C d e f"), (3, "A b C d e f"), (4, "one two")]
    items = [(1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (4, "one two"), (None, "a b c d e f")]
    assert run(spark, docs, items)[0] == brute(docs, items) == [(3, 3, 2, 2), (4, 4, 1, 1)]
    assert run(spark, [], items)[0] == [] and run(spark, docs, [])[0] == []
