"""Rates against numpy, and what they must reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import mixing
from quillon.llm.mixing import fit_rates, mix

SCHEMA = "doc_id bigint, text string, lang string, rate int"
WORDS = {"en": ["the", "of", "and", "house", "tree"], "fr": ["le", "la", "et", "maison", "arbre"], "de": ["der", "die", "und", "haus", "baum"]}


def docs(n=120):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        lang = ["en", "en", "en", "fr", "de"][i % 5]
        rows.append((i, " ".join(rng.choice(WORDS[lang], rng.integers(3, 60))), lang, 9))
    rows += [(n + i, " ".join(rng.choice(WORDS["en"] + WORDS["fr"], 30)), None, 9) for i in range(10)]
    return rows


def test_targets_met(spark):
    rows = docs()
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labelled = d.where("lang IS NOT NULL").select("doc_id", "text", d.lang.alias("domain"))
    target = {"en": 0.2, "fr": 0.5, "de": 0.3}
    got = mix(d, labelled, target).collect()
    assert len(got) == len(rows) and all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in got)
    total = sum(r.n_tokens for r in got)
    for k, share in target.items():
        assert sum(r.rate * r.n_tokens * r.domains[k] for r in got) / total == pytest.approx(share, abs=1e-5)
    assert all(max(r.domains, key=r.domains.get) == r.lang for r in got if r.lang)
    assert sum(r.copies for r in got) == pytest.approx(sum(r.rate for r in got), rel=0.2)


def test_cut_off_rates(spark):
    """A target of zero pushes rates to 0, where they stay."""
    p = np.array([[0.9, 0.1], [0.5, 0.5], [0.1, 0.9], [0.02, 0.98]])
    n = np.array([10, 20, 30, 40])
    m = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n bigint, p array<double>")
    goal = np.array([0.02, 0.98])
    steps, _ = fit_rates(m, goal, rounds=200)
    r = np.ones(4)
    for e in steps:
        r = np.maximum(0, r - p @ np.array(e))
    assert (r == 0).any() and (n * r) @ p / n.sum() == pytest.approx(goal, abs=2e-3)


def test_edges(spark):
    d = spark.createDataFrame([(1, None, "en", 9), (2, "", "en", 9), (None, "the of", "en", 9), (3, "the " * 20_000, "en", 9), (3, "le la", "fr", 9)], SCHEMA)
    labelled = d.select("doc_id", "text", d.lang.alias("domain"))
    got = mix(d, labelled, {"en": 1, "fr": 1}).collect()
    assert len(got) == 5 and {r.n_tokens for r in got} == {0, 2, 20_000}
    none = mix(d, labelled.where("domain IS NULL"), {}).collect()
    assert {r.rate for r in none} == {1.0} and {r.copies for r in none} == {1} and none[0].domains == {}
    assert mix(d.limit(0), labelled, {"en": 1}).collect() == []
    with pytest.raises(ValueError, match="xx"):
        mix(d, labelled, {"xx": 1})


def test_plans_hold_vectors_and_weights_once(spark):
    """A round's vectors are once in its plan, and a domain's weights are one literal, so that plans stay small on the driver."""
    slots = F.array(F.lit(1))
    weights = mixing._likelihood(slots, np.full(1024, -0.25))
    assert spark.range(1).select(weights.alias("x")).first()["x"] == -0.25
    assert spark.range(1).select(weights.alias("x"))._jdf.queryExecution().analyzed().toString().count(", -0.25") == 0
    seen = []

    class Members:
        def __getattr__(self, name):
            return getattr(held, name)

        def select(self, *columns):
            out = held.select(*columns)
            seen.append(out._jdf.queryExecution().analyzed().toString().count("aggregate("))
            return out

    held = spark.createDataFrame([(10, [0.9, 0.1]), (5, [0.2, 0.8])], "n long, p array<double>")
    _, totals = mixing.fit_rates(Members(), np.array([0.5, 0.5]))
    assert np.allclose(totals, 7.5, atol=1e-3) and seen[0] == 0 and {*seen[1:]} == {2}
