"""Mixing sources to target weights with soft domain membership.  DataFrame functions only.

1. *Classifier.*  Naive Bayes on hashed words, learned from a labelled table
   (at most ``max_train`` rows of it, those of least hashed id: the documented
   bound of what a broadcast join carries).  A document's posterior over domains
   uses the mean log-likelihood of its words, weighted as ``evidence`` words at
   most, so that long documents keep soft memberships.
2. *Rates.*  Each document d with n_d words and posterior p_d gets a rate
   r_d >= 0, so that the expected domain totals sum(r_d n_d p_d) match targets
   T.  Projected gradient on the least squares of the whitened misfit
   e = H^-1 (sum(r_d n_d p_d) - T), H = sum(n_d p_d p_d^T): from r = 1, each round
   sets r_d := max(0, r_d - p_d . e).  In this metric the objective has curvature
   one, so that the full step is safe, and one step is exact where no rate is
   cut off at 0.  Where rates are, H over the documents whose rate isn't 0 gives
   longer steps, taken while they lower the misfit.  A round is one or two
   aggregations of k + k * k numbers over (n_d, p_d).

A document's rate depends on its posterior and on the rounds' vectors e alone,
so that rates are no table: the final column folds the vectors over p_d.  Only
k numbers a round, k * k of H and k * buckets class counts reach the driver.

Targets are weights by domain, scaled to sum 1; the total is that of the
documents' words.  A target for a domain that the labelled table lacks can't be
met and raises ``ValueError``; domains without a target get target 0.

Where rates that aren't negative can't meet the targets, they come as near as
the rounds bring them, and a warning says how near.

``copies`` realises the rate: its whole part, plus one with the probability of
its fraction, decided by a hash of the id.

Nulls and edges: documents without words get the class shares as posterior and
weigh nothing.  Null labels are no labels.  Without labelled rows the result
has rate 1 and no posteriors (an empty map).  Repeated rows count each, and
have the same rate; of equal posteriors each keeps its own share.  Whole texts
count, however long: a text's evidence is bounded, its words aren't.  An empty
table gives no rows.  Columns of the result that clash with a column of
the documents replace it.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialise

BUCKETS = 1024
MAX_TRAIN = 10_000
SPACE = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")


def _slots(text: Column, buckets: int) -> Column:
    return F.transform(_words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def learn_domains(labelled: DataFrame, *, buckets: int = BUCKETS, max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Domains, log shares and log word-bucket probabilities from rows (id, text, domain)."""
    rows = labelled.where("domain IS NOT NULL").withColumn("h", F.xxhash64("id", "text")).orderBy("h", "id").limit(max_train)
    rows = materialise(rows, "labelled")
    seen = rows.groupBy("domain").agg(F.count("*").alias("n")).collect()
    domains = sorted(r["domain"] for r in seen)
    if not domains:
        return [], np.zeros(0), np.zeros((0, buckets))
    share = np.array([next(r["n"] for r in seen if r["domain"] == d) for d in domains], float)
    counts = np.ones((len(domains), buckets))
    for r in rows.select("domain", F.explode(_slots(F.col("text"), buckets)).alias("b")).groupBy("domain", "b").agg(F.count("*").alias("n")).collect():
        counts[domains.index(r["domain"]), r["b"]] += r["n"]
    return domains, np.log(share / share.sum()), np.log(counts / counts.sum(1, keepdims=True))


def _likelihood(slots: Column, log_word: np.ndarray) -> Column:
    # one literal: as an array of literals, each weight would be an object of the driver's in every plan
    weights = F.split(F.lit(" ".join(repr(round(float(x), 6)) for x in log_word)), " ").cast("array<double>")
    return F.aggregate(slots, F.lit(0.0), lambda acc, b: acc + F.element_at(weights, b + 1))


def with_posterior(docs: DataFrame, text: Column, log_share: np.ndarray, log_word: np.ndarray, evidence: float, buckets: int, n_col: str, p_col: str) -> DataFrame:
    """Number of words and array of domain probabilities.

    Step by step: a column that is used more than once stays a column of its
    own, so that no likelihood is computed twice.
    """
    slots, part, taken = "quillon_slots", "quillon_part", [*docs.columns, n_col, p_col]
    slots, part = _free(slots, taken), _free(part, taken)
    out = docs.withColumn(slots, _slots(text, buckets)).withColumn(n_col, F.size(slots).cast("bigint"))
    n = F.col(n_col)
    weigh = F.when(n > 0, F.least(n.cast("double"), F.lit(evidence)) / n).otherwise(0.0)
    out = out.withColumn(part, F.array(*(F.lit(float(log_share[k])) + weigh * _likelihood(F.col(slots), log_word[k]) for k in range(len(log_share))))).drop(slots)
    out = out.withColumn(part, F.transform(part, lambda x: F.exp(x - F.array_max(part))))
    return out.withColumn(p_col, F.transform(part, lambda x: x / F.aggregate(part, F.lit(0.0), lambda a, b: a + b))).drop(part)


def rate(p: Column, steps: list[list[float]]) -> Column:
    """max(0, r - p . e) folded over the rounds' vectors, from 1."""
    if not steps:
        return F.lit(1.0)
    dot = lambda e: F.aggregate(F.zip_with(p, e, lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b)
    return F.aggregate(F.lit([[float(x) for x in e] for e in steps]), F.lit(1.0), lambda r, e: F.greatest(F.lit(0.0), r - dot(e)))


def fit_rates(members: DataFrame, targets: np.ndarray, *, rounds: int = 60, tolerance: float = 1e-7) -> tuple[list[list[float]], np.ndarray]:
    """The rounds' vectors, and the totals that they reach, from rows (n, p)."""
    k = len(targets)
    at = lambda i: F.element_at("p", i + 1)
    upper = [(i, j) for i in range(k) for j in range(i, k)]

    def state(steps):
        """Totals, and H over all documents and over those whose rate isn't 0, as shares of all words."""
        # a column, so that the vectors are once in a round's plan and not once in each sum
        r = F.col("r")
        live = F.when(r > 0, F.col("n")).otherwise(0)
        x = members.select("n", "p", rate(F.col("p"), steps).alias("r")).agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * r * at(i)).alias(f"t{i}") for i in range(k)), *(F.sum(w * at(i) * at(j)).alias(f"{name}{i}_{j}") for name, w in (("h", F.col("n")), ("a", live)) for i, j in upper)).first()
        total = float(x["n"] or 0)
        matrix = lambda name: np.array([[x[f"{name}{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float) / total
        return (total, np.array([x[f"t{i}"] for i in range(k)], float) / total, matrix("h"), matrix("a")) if total else (0.0, np.zeros(k), np.eye(k), np.eye(k))

    inverse = lambda m: np.linalg.pinv(m + 1e-12 * np.eye(k))
    steps: list[list[float]] = []
    total, reached, whole, live = state(steps)
    for _ in range(rounds):
        miss = reached - targets
        if not total or np.abs(miss).max() < tolerance:
            break
        misfit = lambda e: float(e @ inverse(whole) @ e)
        for metric in (live, whole):
            step = [round(float(x), 12) for x in inverse(metric) @ miss]
            _, after, _, living = state([*steps, step])
            if misfit(after - targets) < misfit(miss):
                break
        steps.append(step)
        reached, live = after, living
    if total and np.abs(reached - targets).max() >= 1e3 * tolerance:
        warnings.warn(f"rates meet the targets to {np.abs(reached - targets).max():.2g} of all words only: {reached.tolist()} for {targets.tolist()}", stacklevel=2)
    return steps, reached * total


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, buckets: int = BUCKETS, max_train: int = MAX_TRAIN, evidence: float = 20.0, rounds: int = 60, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_text_col: str = "text", label_col: str = "domain") -> DataFrame:
    """All columns of ``docs`` with n_tokens, domains (map to posterior), rate and copies.

    ``labelled`` has an id, a text and a domain.
    """
    known = labelled.select(F.col(label_id_col).alias("id"), F.col(label_text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("domain"))
    domains, log_share, log_word = learn_domains(known, buckets=buckets, max_train=max_train)
    n_col, p_col = _free("quillon_n", docs.columns), _free("quillon_p", docs.columns)
    if domains and (odd := sorted(set(targets) - set(domains))):
        raise ValueError(f"no labelled rows for the targets {odd}")
    if domains:
        with_p = with_posterior(docs, F.col(text_col), log_share, log_word, evidence, buckets, n_col, p_col)
    else:
        with_p = docs.withColumn(n_col, F.size(_words(F.col(text_col))).cast("bigint")).withColumn(p_col, F.array().cast("array<double>"))
    held = materialise(with_p, "members")
    steps: list[list[float]] = []
    if domains:
        goal = np.array([targets.get(d, 0.0) for d in domains], float)
        steps, _ = fit_rates(held.select(F.col(n_col).alias("n"), F.col(p_col).alias("p")), goal / max(goal.sum(), 1e-300), rounds=rounds)
    r = F.round(rate(F.col(p_col), steps), 9)
    chance = F.pmod(F.xxhash64(F.lit("copies"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    out = held.withColumn("n_tokens", F.col(n_col)).withColumn("domains", F.map_from_arrays(F.lit(domains).cast("array<string>"), F.transform(F.col(p_col), lambda x: F.round(x, 9))))
    out = out.withColumn("rate", r).withColumn("copies", (F.floor(r) + F.when(chance < r - F.floor(r), 1).otherwise(0)).cast("bigint"))
    return out.drop(n_col, p_col)


__all__ = ["BUCKETS", "fit_rates", "learn_domains", "mix", "rate", "with_posterior"]
