"""Language-model scoring with a weighted backoff automaton.

Training gathers the n-grams (``order`` 2: words and pairs) of all documents
that are not held out.  The unigram model at the root adds one to each count::

    P(w) = (c(w) + 1) / (N + V + 1)

Longer histories are smoothed with a Dirichlet prior of ``mu`` tokens drawn
from the next shorter one::

    P(w | h) = (c(h w) + mu * P(w | h')) / (c(h) + mu)

As an automaton: each history h seen in training is a state; each n-gram h w
seen is an arc of weight log10 P(w | h); the failure arc of h has weight
log10(mu / (c(h) + mu)) and leads to the state of h'.  A text's score is the
weight of the one path that reads its words and the end mark from left to
right.  The state that the path is in is all that is carried.

**How it is spread out.**  The automaton of a whole corpus fits no machine, so
each block of documents gets the part that its own texts can reach: a block
sends its distinct n-gram hashes, packed and sorted, to ranges of the hash space
(an eighth of the blocks, or the number of partitions); each range adds up
counts over all blocks and answers each block in the order that it asked.  Keys
are combined in the block first, so that a common n-gram has one entry a block,
whatever its count; a block sends a row to the ranges that it has keys for only,
so that rows are never more than keys.

Nulls and edges: a null or empty text is the end mark alone.  Null ids are kept
(their remainder is that of the empty text); rows that repeat are scored once
each and count once each in training.  An empty table gives no rows.  Without
training documents, N = V = 0 and every token weighs log10(1 / 1) = 0.  Equal
texts have equal scores.  Whole texts are read; a block of them is a task's
work, so that a text must fit in a task's memory.  Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import textkernel as tk
from quillon.llm.common import as_array, blocks_for, bucket_edges, deal, merge_totals, pack_ints, pack_keys, ranges_for, remainder, ship, sorted_distinct, unpack_ints, unpack_keys, with_inverse

BEGIN, END = np.uint64(0x1BADB002B16B00B5), np.uint64(0x0DDB1A5E5BA5E000 | 1)
SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def padded(texts) -> tuple[np.ndarray, np.ndarray]:
    """Each text as begin mark, words, end mark; and where each begins."""
    tokens, at = tk.words(texts)
    n = len(at) - 1
    begin = at + 2 * np.arange(n + 1)
    seq = np.empty(begin[-1], np.uint64)
    keep = np.ones(len(seq), bool)
    keep[begin[:-1]] = keep[begin[1:] - 1] = False
    seq[keep] = tokens
    seq[begin[:-1]], seq[begin[1:] - 1] = BEGIN, END
    return seq, begin


def grams(seq: np.ndarray, begin: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k tokens that end at each place, and the places that have k tokens of their own text."""
    inside = np.arange(len(seq)) - np.repeat(begin[:-1], np.diff(begin))
    at = np.flatnonzero(inside >= k - 1)
    return (seq[at] if k == 1 else tk.chain(*(seq[at - k + 1 + i] for i in range(k)))), at


def _block_keys(table: pa.Table, order: int, buckets: int) -> pa.Table:
    """A block's distinct n-grams with their counts in training, by range of the hash space."""
    seq, begin = padded(as_array(table["text"]))
    train = np.repeat(~np.asarray(as_array(table["held_out"]).to_numpy(zero_copy_only=False), bool), np.diff(begin))
    block = table["block"][0].as_py()
    out: dict[str, list] = {c: [] for c in ("r", "block", "k", "keys", "counts")}
    for k in range(1, order + 1):
        key, at = grams(seq, begin, k)
        asked, _ = sorted_distinct(key)
        known, n = sorted_distinct(key[train[at]])
        count = np.zeros(len(asked), np.int64)
        count[np.searchsorted(asked, known)] = n
        edges = bucket_edges(asked, buckets)
        for r in np.flatnonzero(np.diff(edges)):
            part = slice(edges[r], edges[r + 1])
            for name, v in zip(out, (int(r), block, k, pack_keys(asked[part]), pack_ints(count[part])), strict=True):
                out[name].append(v)
    return pa.table(out, schema=KEYS)


KEYS = pa.schema([("r", pa.int32()), ("block", pa.int32()), ("k", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
TOTALS = pa.schema([("block", pa.int32()), ("r", pa.int32()), ("k", pa.int32()), ("counts", pa.binary())])


def _answer(table: pa.Table) -> pa.Table:
    """One range of the hash space: counts over all blocks, in the order of each block's keys."""
    k, out = table["k"].to_numpy(), []
    for kind in np.unique(k):
        own = table.filter(pa.array(k == kind))
        _, total, places = merge_totals([unpack_keys(b) for b in own["keys"].to_pylist()], [unpack_ints(b) for b in own["counts"].to_pylist()])
        out.append(pa.table([own["block"], own["r"], own["k"], pa.array([pack_ints(total[p]) for p in places], pa.binary())], schema=TOTALS))
    return pa.concat_tables(out)


class BackoffAutomaton:
    """The states and arcs that a block of padded texts can reach.

    ``counts[k]`` holds, for each distinct k-gram of the block in the order of
    its hash, the count in training.  An n-gram's place in that order stands for
    it; a history of k tokens that training has is the state (k, place).
    """

    def __init__(self, seq: np.ndarray, begin: np.ndarray, counts: dict[int, np.ndarray], tokens: int, types: int, order: int, mu: float):
        self.begin, self.order = begin, order
        self.gram: dict[int, np.ndarray] = {}  # by place in seq: which k-gram ends there, -1 where none does
        self.arc: dict[int, np.ndarray] = {}  # by k-gram: weight of the arc that reads its last token, nan without
        self.fail: dict[int, np.ndarray] = {}  # by k-gram as a history: weight of its failure arc, nan for what is no state
        self.root = np.log10((counts[1] + 1) / (tokens + types + 1))
        p = 10**self.root
        for k in range(1, order + 1):
            key, at = grams(seq, begin, k)
            found, inverse = with_inverse(key)
            if len(found) != len(counts[k]):
                raise ValueError("a block holds other texts than it asked for")
            self.gram[k] = np.full(len(seq), -1, np.int64)
            self.gram[k][at] = inverse
            if k > 1:
                where = np.empty(len(found), np.int64)
                where[inverse] = at
                past = counts[k - 1][self.gram[k - 1][where - 1]]
                lower = p[self.gram[k - 1][where]]
                p = np.where(past > 0, (counts[k] + mu * lower) / (past + mu), lower)
                self.arc[k] = np.where(counts[k] > 0, np.log10(p), np.nan)
            if k < order:
                self.fail[k] = np.where(counts[k] > 0, np.log10(mu / (counts[k] + mu)), np.nan)

    def score(self) -> np.ndarray:
        """Read all texts from left to right, one token a step, the longest texts first in line."""
        n = np.diff(self.begin) - 1  # what is read: words and end mark
        line = np.argsort(-n, kind="stable")
        lengths, place = n[line], self.begin[:-1][line]
        total, state = np.zeros(len(line)), np.zeros(len(line), np.int64)  # state: tokens of history that are carried
        if self.order > 1 and len(line):
            state[:] = np.where(np.isnan(self.fail[1][self.gram[1][place]]), 0, 1)
        alive = len(line)
        for step in range(1, int(lengths[0]) + 1 if len(line) else 0):
            while lengths[alive - 1] < step:
                alive -= 1
            at, s, weight = place[:alive] + step, state[:alive].copy(), np.zeros(alive)
            for k in range(self.order - 1, 0, -1):
                here = s == k
                if not here.any():
                    continue
                arc = self.arc[k + 1][self.gram[k + 1][at]]
                missing = here & np.isnan(arc)
                weight += np.where(here & ~missing, arc, 0)
                weight[missing] += self.fail[k][self.gram[k][at[missing] - 1]]
                s[missing] = k - 1
            lowest = s == 0
            weight[lowest] += self.root[self.gram[1][at[lowest]]]
            total[:alive] += weight
            for k in range(self.order - 1, 0, -1):  # the arc's end, or the longest suffix of it that is a state
                fits = (s + 1 >= k) & (self.gram[k][at] >= 0)
                known = fits & ~np.isnan(self.fail[k][np.maximum(self.gram[k][at], 0)])
                if k == self.order - 1:
                    after = np.where(known, k, 0)
                else:
                    after = np.where((after == 0) & known, k, after)
            if self.order > 1:
                state[:alive] = after
        out = np.empty(len(line))
        out[line] = total
        return out


def _score_block(docs: pa.Table, totals: pa.Table, order: int, mu: float, tokens: int, types: int) -> pa.Table:
    if not docs.num_rows:
        return pa.table([pa.array([], t) for t in OUT.types], schema=OUT)
    kinds, at = totals["k"].to_numpy(), totals["r"].to_numpy()
    counts = {}
    for k in range(1, order + 1):
        own = np.flatnonzero(kinds == k)
        parts = totals["counts"].take(pa.array(own[np.argsort(at[own])])).to_pylist()
        counts[k] = np.concatenate([unpack_ints(b) for b in parts] or [np.zeros(0)]).astype(np.int64)
    seq, begin = padded(as_array(docs["text"]))
    machine = BackoffAutomaton(seq, begin, counts, tokens, types, order, mu)
    gram = machine.gram[1]
    root, known = machine.root[gram], counts[1][gram] > 0
    root[begin[:-1]], known[begin[:-1]] = 0, False  # the begin mark is no token
    sums = lambda x: np.add.reduceat(x, begin[:-1])
    return pa.table([as_array(docs["doc_id"]), as_array(docs["held_out"]), pa.array(np.diff(begin) - 1), pa.array(sums(known.astype(np.int64))), pa.array(np.full(docs.num_rows, tokens)), pa.array(sums(root)), pa.array(machine.score())], schema=OUT)


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _type_counts(ranges: int):
    """Tokens and types of training, by range of the hash space: distinct words once a task."""

    def gather(batches):
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            seq, begin = padded(b.column("text"))
            train = np.repeat(~np.asarray(b.column("held_out").to_numpy(zero_copy_only=False), bool), np.diff(begin))
            train[begin[:-1]] = False
            kept.append(sorted_distinct(seq[train]))
            if len(kept) > 16 or sum(len(x[0]) for x in kept) > 2_000_000:
                keys, total, _ = merge_totals([x[0] for x in kept], [x[1] for x in kept])
                kept = [(keys, total)]
        if kept:
            keys, total, _ = merge_totals([x[0] for x in kept], [x[1] for x in kept])
            edges = bucket_edges(keys, ranges)
            r = np.flatnonzero(np.diff(edges))
            yield pa.record_batch([pa.array(r.astype(np.int32)), pa.array([pack_keys(keys[edges[i] : edges[i + 1]]) for i in r], pa.binary()), pa.array([int(total[edges[i] : edges[i + 1]].sum()) for i in r], pa.int64())], names=["r", "keys", "n"])

    return gather


def _types(table: pa.Table) -> pa.Table:
    found, _, _ = merge_totals(keys := [unpack_keys(b) for b in table["keys"].to_pylist()], [np.ones(len(k)) for k in keys])
    return pa.table({"n": pa.array([int(np.sum(table["n"].to_numpy()))], pa.int64()), "types": pa.array([len(found)], pa.int64())})


def score_texts(docs: DataFrame, *, order: int = 2, mu: float = 4.0, modulus: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the documents whose crc32 remainder isn't ``held``, and score all of them.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (root
    state alone) and score (whole automaton).  ``order``: longest n-gram.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", "text", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"))
    blocks = blocks_for(rows)
    ranges = ranges_for(rows, blocks)
    counted = rows.mapInArrow(_type_counts(ranges), "r int, keys binary, n bigint").groupBy("r").applyInArrow(_types, "n bigint, types bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("types"), F.lit(0)).alias("types")).first()
    tokens, types = int(counted["n"]), int(counted["types"])
    placed = rows.withColumn("block", deal(blocks))
    asked = placed.groupBy("block").applyInArrow(lambda t: _block_keys(t, order, ranges), "r int, block int, k int, keys binary, counts binary")
    totals = asked.groupBy("r").applyInArrow(_answer, "block int, r int, k int, counts binary")
    return placed.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(lambda d, t: _score_block(d, t, order, mu, tokens, types), SCHEMA)
