"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A document contains an item when it has at least ``percent`` percent of the
item's distinct ``size``-word shingles, anywhere in its whole text.

Items are partitioned by the size q of their sets, 2**c <= q < 2**(c+1).  For
each partition, documents are cut into windows of 3 * 2**c shingles that begin
every 2**c shingles, so that a passage of an item lies in a window of at most
three times its size: against a whole long document the Jaccard similarity of a
short item vanishes, against such a window an item at 80 % containment has at
least 0.8 / 3.2 = 0.25.  Item and window are sketched by one-permutation
MinHash: 64 bins by the hash's low bits, each bin's least hash.  A shared bin
value makes the pair of document and item a candidate; at 0.25 a window misses
all 64 bins with probability 1e-8.  Items of fewer than eight shingles are
sketched by their whole sets, so that nothing is missed there.  Every candidate
is then counted exactly on whole sets, so that no false one is returned.

Benchmark items are the stated query set: they are read in blocks of
``block_items`` rows, each block's index is broadcast (its size is bounded by
the block), and every block searches all documents.  Documents are read once a
block and nothing of them is shuffled.

Nulls and edges: null or empty texts on either side have no shingles and match
nothing.  An item of fewer than ``size`` words is one shingle of all its words,
found only in a document of just these words.  Repeated rows give one result a
pair of ids; null ids are left out.  Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import textkernel as tk
from quillon.llm.common import ship

BINS = 64
WHOLE = 8  # items with fewer shingles are their own sketch
SCHEMA = "doc_id bigint, item_id bigint, n_common bigint, n_item bigint, containment double"


def _least_of_bins(h: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """One-permutation MinHash of each group: a row of BINS least hashes (all bits set: empty bin)."""
    out = np.full(groups * BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, group * BINS + (h & np.uint64(BINS - 1)).astype(np.int64), h)
    return out.reshape(groups, BINS)


def item_index(ids: list[int], texts: list[str | None], size: int) -> dict:
    """The sets of a block of items and, for each size partition, which items have which sketch value."""
    tokens, at = tk.words(pa.array(texts, pa.string()))
    values, begin = tk.distinct(*tk.shingles(tokens, at, size))
    n = np.diff(begin)
    parts: dict[int, list] = {}
    for i in np.flatnonzero(n):
        own = values[begin[i] : begin[i + 1]]
        c = -1 if n[i] < WHOLE else int(n[i]).bit_length() - 1
        sketch = own if c < 0 else np.unique(_least_of_bins(own, np.zeros(len(own), np.int64), 1))
        parts.setdefault(c, []).append((sketch[sketch != np.iinfo(np.uint64).max], i))
    tables = {}
    for c, own in parts.items():
        value, item = np.concatenate([s for s, _ in own]), np.concatenate([np.full(len(s), i) for s, i in own])
        order = np.argsort(value, kind="stable")
        tables[c] = (value[order], item[order])
    return {"ids": np.array(ids, np.int64), "values": values, "begin": begin, "tables": tables}


def _lookup(found: np.ndarray, doc: np.ndarray, table) -> np.ndarray:
    """Pairs (document, item) of sketch values that occur in the table."""
    value, item = table
    low = np.searchsorted(value, found, side="left")
    hit = np.flatnonzero(value[np.minimum(low, len(value) - 1)] == found)
    if not len(hit):
        return np.zeros((0, 2), np.int64)
    low = low[hit]
    many = np.searchsorted(value, found[hit], side="right") - low
    rows = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
    return np.unique(np.stack([np.repeat(doc[hit], many), item[rows]], 1), axis=0)


def candidates(h: np.ndarray, begin: np.ndarray, index: dict) -> np.ndarray:
    """Pairs (document, item) that share a sketch value in some window."""
    n = np.diff(begin)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - np.repeat(begin[:-1], n)
    found = []
    for c, table in index["tables"].items():
        if c < 0:
            found.append(_lookup(h, doc, table))
            continue
        cells = (n + (1 << c) - 1) >> c
        first = np.concatenate([[0], np.cumsum(cells)])
        least = _least_of_bins(h, first[doc] + (place >> c), int(first[-1]))
        owner = np.repeat(np.arange(len(n)), cells)
        window = least.copy()
        for k in (1, 2):  # a window is three cells of one document
            same = np.flatnonzero(owner[k:] == owner[:-k])
            window[same] = np.minimum(window[same], least[same + k])
        found.append(_lookup(window.ravel(), np.repeat(owner, BINS), table))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def _search(shared, size: int, percent: int):
    def run(batches):
        index = shared.value
        for b in batches:
            for part in tk.slices(b, "text"):
                tokens, at = tk.words(part.column("text"))
                h, begin = tk.shingles(tokens, at, size)
                ids, out, own, last = part.column("doc_id").to_pylist(), [], None, -1
                for d, i in candidates(h, begin, index):
                    if d != last:
                        own, last = np.sort(h[begin[d] : begin[d + 1]]), d
                    item = index["values"][index["begin"][i] : index["begin"][i + 1]]
                    where = np.searchsorted(own, item)
                    where[where == len(own)] = 0
                    common = int((own[where] == item).sum())
                    if ids[d] is not None and common * 100 >= percent * len(item):
                        out.append((ids[d], int(index["ids"][i]), common, len(item), common / len(item)))
                cols = list(zip(*out, strict=True)) if out else [()] * 5
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.float64()], strict=True)], names=["doc_id", "item_id", "n_common", "n_item", "containment"])

    return run


def _clean(shared, size: int, percent: int, text_col: str):
    """The rows, with all their columns, of texts that contain no item of the block."""
    search = _search(shared, size, percent)

    def run(batches):
        for b in batches:
            texts = pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), b.column(text_col)], names=["doc_id", "text"])
            keep = np.ones(b.num_rows, bool)
            for found in search(iter([texts])):
                keep[found.column("doc_id").to_numpy()] = False
            if keep.any():
                yield b.filter(pa.array(keep))

    return run


def _index_blocks(items: DataFrame, size: int, block_items: int, id_col: str, text_col: str):
    """Broadcast indexes of the items, ``block_items`` rows each (one at least, maybe empty)."""
    ids: list[int] = []
    texts: list[str] = []
    asked = items.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    done = 0
    for row in asked.toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        if len(ids) == block_items:
            yield items.sparkSession.sparkContext.broadcast(item_index(ids, texts, size))
            ids, texts, done = [], [], done + 1
    if ids or not done:
        yield items.sparkSession.sparkContext.broadcast(item_index(ids, texts, size))


def contained_items(docs: DataFrame, items: DataFrame, *, size: int = 5, percent: int = 80, block_items: int = 20_000, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_common, n_item and containment of every document that contains an item."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for shared in _index_blocks(items, size, block_items, item_id_col, item_text_col):
        found = rows.mapInArrow(_search(shared, size, percent), SCHEMA)
        out = found if out is None else out.unionByName(found)
    best = F.max_by(F.struct("n_common", "n_item", "containment"), F.struct("containment", "n_common")).alias("x")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.n_common", "x.n_item", "x.containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, *, size: int = 5, percent: int = 80, block_items: int = 20_000, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that contain no item; nothing is shuffled."""
    ship(docs.sparkSession)
    for shared in _index_blocks(items, size, block_items, item_id_col, item_text_col):
        docs = docs.mapInArrow(_clean(shared, size, percent, text_col), docs.schema)
    return docs
