"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by class log-count ratios (NB-SVM).

Features of a text are which n-grams it has, hashed into 2**``bits`` slots:
single words and pairs of words, and runs of one to three word shapes.  A shape
says what kinds of characters a word is made of (lower case, upper case, digits,
other letters), how it ends, and whether it repeats the word before it, so that
n-grams also generalise to words never seen.

Fit: with p and q the smoothed counts of documents of label 1 and 0 that have a
feature, r = log((p / |p|) / (q / |q|)); a text is the vector of the r of its
features, scaled to length 1.  The dual of the L1-loss linear SVM is solved by
coordinate descent: one multiplier a document, updated in random order within
[0, C].  C is weighted by class so that both classes weigh the same.  A logistic
curve fitted to the margins of labelled documents kept out of the descent turns
margins into scores.

The fit takes at most ``max_train`` labelled documents, those of least hashed
id: a bound on one task's memory, stated here and in the README.  The model is
2 * 2**``bits`` floats whatever the corpus, so that it can be broadcast; every
document is scored from its whole text.

Nulls and edges: a null or empty text has no features and scores as the
intercept.  Null labels are no labels; of several labels of an id the greatest
counts.  With labels of one class only, all scores are that class's share,
(n1 + 1) / (n0 + n1 + 2); without labels, 0.5.  Rows that repeat give as many
rows.  Labels, language, source and ids are never inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import textkernel as tk
from quillon.llm.common import as_array, remainder, ship

BITS = 20
MAX_TRAIN = 12_000


def features(texts, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of each text, sorted and once each, and where each text's begin."""
    words, shapes, at = tk.words_and_shapes(texts)
    if len(words):
        same = np.zeros(len(words), np.uint64)
        same[1:] = words[1:] == words[:-1]
        same[at[:-1][np.diff(at) > 0]] = 0
        shapes = shapes | (same << np.uint64(40))
    kinds = []
    for salt, stream, sizes in ((11, words, (1, 2)), (13, shapes, (1, 2, 3))):
        for m in sizes:
            if len(stream) < m:
                continue
            first = np.arange(len(stream) - m + 1)
            own = np.searchsorted(at, first, side="right")
            ok = first + m <= at[np.minimum(own, len(at) - 1)]
            key = tk.chain(np.full(len(first), salt, np.uint64), *(stream[i : i + len(first)] for i in range(m)))
            kinds.append((own[ok] - 1, key[ok] >> np.uint64(64 - bits)))
    doc = np.concatenate([k[0] for k in kinds]) if kinds else np.zeros(0, np.int64)
    slot = np.concatenate([k[1] for k in kinds]) if kinds else np.zeros(0, np.uint64)
    both = np.sort((doc.astype(np.uint64) << np.uint64(bits)) | slot)
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    doc, slot = (both >> np.uint64(bits)).astype(np.int64), (both & np.uint64((1 << bits) - 1)).astype(np.int64)
    return slot, np.searchsorted(doc, np.arange(len(at)))


def dual_coordinate_descent(slot: np.ndarray, at: np.ndarray, value: np.ndarray, y: np.ndarray, cost: np.ndarray, dim: int, passes: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and intercept of the L1-loss linear SVM; ``cost`` bounds each document's multiplier."""
    w, b, alpha = np.zeros(dim), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(seed)
    square = np.add.reduceat(np.append(value**2, 0), at[:-1]) if len(y) else np.zeros(0)
    square = np.where(np.diff(at) > 0, square, 0) + 1  # 1: the intercept's own feature
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(y)):
            s, v = slot[at[i] : at[i + 1]], value[at[i] : at[i + 1]]
            g = y[i] * (w[s] @ v + b) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if (step := (new - alpha[i]) * y[i]) != 0.0:
                w[s] += step * v
                b += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, b


def logistic(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits labels 0/1 to margins, by damped Newton steps on smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -30, 30)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * (a - 1), (p - target).sum()])
        h = p * (1 - p)
        hess = np.array([[(h * margin**2).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess + 1e-9 * np.eye(2), g)
        step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(c)


def _pack(bits: int):
    def run(batches):
        for b in batches:
            for part in tk.slices(b, "text"):
                slot, at = features(part.column("text"), bits)
                yield pa.record_batch([part.column("label"), part.column("h"), pa.array([slot[at[i] : at[i + 1]].astype("<i4").tobytes() for i in range(part.num_rows)], pa.binary())], names=["label", "h", "slots"])

    return run


def _fit(table: pa.Table, bits: int, c: float) -> pa.Table:
    order = np.argsort(as_array(table["h"]).to_numpy(), kind="stable")
    label = as_array(table["label"]).to_numpy()[order].astype(np.int64)
    rows = [np.frombuffer(x, "<i4") for x in table["slots"].take(pa.array(order)).to_pylist()]
    n1, n0, dim = int(label.sum()), int(len(label) - label.sum()), 1 << bits
    r, w, out = np.zeros(dim), np.zeros(dim), (0.0, 1.0, 0.0)
    if n1 == 0 or n0 == 0:
        p = (n1 + 1) / (n0 + n1 + 2)
        out = (0.0, 1.0, float(np.log(p / (1 - p))))
    else:
        kept = np.arange(len(label)) % 5 == 4  # for the curve
        if min(label[kept].sum(), (1 - label[kept]).sum()) < 1 or min(label[~kept].sum(), (1 - label[~kept]).sum()) < 1:
            kept = np.zeros(len(label), bool)
        fit = np.flatnonzero(~kept)
        counts = [np.bincount(np.concatenate([rows[i] for i in fit if label[i] == k] or [np.zeros(0, np.int64)]), minlength=dim) + 1.0 for k in (1, 0)]
        r = np.log((counts[0] / counts[0].sum()) / (counts[1] / counts[1].sum())).astype(np.float32).astype(np.float64)
        r[(counts[0] == 1) & (counts[1] == 1)] = 0

        def vectors(which):
            at = np.concatenate([[0], np.cumsum([len(rows[i]) for i in which])]).astype(np.int64)
            slot = np.concatenate([rows[i] for i in which] or [np.zeros(0, np.int32)])
            value = r[slot]
            total = np.concatenate([[0], np.cumsum(value**2)])
            length = np.sqrt(np.maximum(total[at[1:]] - total[at[:-1]], 1e-12))
            return slot, at, value / np.repeat(length, np.diff(at))

        slot, at, value = vectors(fit)
        y = np.where(label[fit] > 0, 1.0, -1.0)
        f1, f0 = (y > 0).sum(), (y < 0).sum()
        w, b = dual_coordinate_descent(slot, at, value, y, c * np.where(y > 0, len(y) / (2 * f1), len(y) / (2 * f0)), dim)
        which = np.flatnonzero(kept) if kept.any() else fit
        slot, at, value = vectors(which)
        total = np.concatenate([[0], np.cumsum(w[slot] * value)])
        a, off = logistic(total[at[1:]] - total[at[:-1]] + b, label[which])
        out = (b, a, off)
    return pa.table({"ratios": pa.array([r.astype("<f4").tobytes()], pa.binary()), "weights": pa.array([w.astype("<f4").tobytes()], pa.binary()), "curve": pa.array([list(out)], pa.list_(pa.float64()))})


def _apply(shared, bits: int):
    def run(batches):
        r, w, (b, a, off) = shared.value
        rw, rr = r * w, r * r
        for batch in batches:
            for part in tk.slices(batch, "text"):
                slot, at = features(part.column("text"), bits)
                num, den = (np.concatenate([[0], np.cumsum(x[slot])]) for x in (rw, rr))
                margin = (num[at[1:]] - num[at[:-1]]) / np.sqrt(np.maximum(den[at[1:]] - den[at[:-1]], 1e-12)) + b
                score = 1 / (1 + np.exp(-np.clip(a * margin + off, -30, 30)))
                names = [n for n in part.schema.names if n != "text"]
                yield pa.record_batch([*(part.column(n) for n in names), pa.array(score)], names=[*names, "score"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, *, bits: int = BITS, max_train: int = MAX_TRAIN, c: float = 1.0, modulus: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"):
    """The model as (log-count ratios, weights, (intercept, slope, offset))."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.where(remainder(F.col("doc_id"), modulus) != held).groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("h", F.xxhash64("doc_id"))
    known = known.orderBy("h", "doc_id").limit(max_train)
    sample = texts.join(F.broadcast(known), "doc_id").select("label", "h", "text")  # at most max_train rows of 24 bytes
    packed = sample.mapInArrow(_pack(bits), "label int, h bigint, slots binary")
    got = packed.groupBy(F.lit(0).alias("one")).applyInArrow(lambda t: _fit(t, bits, c), "ratios binary, weights binary, curve array<double>").collect()
    if not got:
        return np.zeros(1 << bits), np.zeros(1 << bits), (0.0, 1.0, 0.0)
    return tuple(np.frombuffer(x, "<f4").astype(np.float64) for x in (got[0]["ratios"], got[0]["weights"])) + (tuple(got[0]["curve"]),)


def score_quality(docs: DataFrame, model, *, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_apply(shared, bits), "doc_id bigint, score double")


def keep_quality(docs: DataFrame, model, *, threshold: float = 0.5, bits: int = BITS, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is at least ``threshold``."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    score = _apply(shared, bits)

    def run(batches):
        for b in batches:
            texts = pa.RecordBatch.from_arrays([b.column(text_col), pa.array(np.arange(b.num_rows))], names=["text", "row"])
            for got in score(iter([texts])):
                rows = got.column("row").to_numpy()[got.column("score").to_numpy() >= threshold]
                if len(rows):
                    yield b.take(pa.array(rows))

    return docs.mapInArrow(run, docs.schema)
