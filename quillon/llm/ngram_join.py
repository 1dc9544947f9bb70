"""Exact n-gram Jaccard self-join with set-relation skipping; result as components.

A document's set is its distinct ``size``-word shingles.  Two documents link
when 100 * intersection >= percent * union.  The result says of each document
how large its set is and the smallest id that it reaches over links.

**Order and prefixes.**  Shingles are put in one order, by how many documents of
the whole corpus have them (in powers of two), then by hash.  Counts come from
one exchange: a block of documents sends its shingles, shortened to 48 bits,
sorted and packed, to ranges of the hash space, and gets a byte for each back.
Any order is right; this one keeps passages that many documents share out of
the index.  Of two sets that link, the first common shingle stands within a
short prefix of both, so that only prefixes are indexed, and of them only
shingles that two documents have: a larger partner is found from its first
n - ceil(t n) + 1 places, a smaller one needs only its first
n - ceil(2t/(1+t) n) + 1.  Most documents have no index entry at all.

**Skipping within lists (index level).**  An index list is split by set size
into blocks whose sizes differ by less than the threshold allows; a set looks at
its own block and the next smaller one, and skips a block in which no set is
small enough for what its place in the list leaves: after place i at most n - i
shingles can be common.

**Answers from similar sets (answer level).**  Each block has a pivot, the entry
with the least hashed id.  Every set of the block is compared with the pivot
exactly, and its difference from the pivot is kept: what it lacks and what it
adds.  Links to the pivot give components.  For two sets x, y of one block in
different components, the counts against the pivot a bound their intersection,
|x & y| <= |x & a| + |y - a|; where that leaves them open, the intersection
follows exactly from the two differences, without the sets.  No pair that could
link is left out, and a group of m near copies takes about m comparisons of
texts.

**Hot keys.**  Equal sets are one set from the start.  Lists of frequent
shingles are never gathered: their pivots come from an aggregation with
partial sums, and every task compares its own sets with them.  Groups left open
are split into parts of ``OPEN_GROUP`` sets; each pair of parts with an open set
is a task's work, so that two sets meet once.

Nulls and edges: a null or empty text has an empty set, links with nothing, and
its component is its own id; a null id gives a row with a null component.  Rows
that share an id are one document that links where any of its texts does; rows
that repeat give a row each.  Whole texts are compared, however long.  A set at
exactly the threshold links.  An empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import textkernel as tk
from quillon.llm.common import as_array, blocks_for, bucket_edges, deal, materialise, merge_totals, pack_ints, pack_keys, ranges_for, ship, sorted_distinct, unpack_ints, unpack_keys
from quillon.llm.components import components

HOT_DF = 1024  # a shingle of so many documents is never gathered as a list
HOT_LISTS = 1 << 18  # lists that may be hot: bounds the pivots that are broadcast to some 12 MB, not the result
OPEN_GROUP = 500  # rows of a side of a pivot's group that one task compares at a time


class Sizes:
    """What the threshold allows, in integers."""

    def __init__(self, percent: int):
        self.p = percent
        self.width = math.log(max(100 / percent, 1.01) * 1.0001)

    def block(self, n: np.ndarray) -> np.ndarray:
        return np.floor(np.log(np.maximum(n, 1)) / self.width).astype(np.int64)

    def least_common(self, nx, ny):
        """Fewest common shingles of sets that link."""
        return -((-self.p * (nx + ny)) // (100 + self.p))

    def prefix(self, n):
        return n - (-((-self.p * n) // 100)) + 1

    def largest_partner(self, rest, n):
        """Largest smaller set that a set of n may link with when ``rest`` of its shingles are left."""
        return rest * (100 + self.p) // self.p - n

    def indexed(self, rest, n):
        return rest >= self.least_common(n, n)


def _sets(texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    tokens, at = tk.words(texts)
    return tk.distinct(*tk.shingles(tokens, at, size))


SHORT = np.uint64(16)  # bits cut off where shingles are only counted: a rare false repeat changes the order, not the result


def _block_counts(table: pa.Table, size: int, buckets: int) -> pa.Table:
    """A block's shingles and how many of its documents have each, packed by range of the hash space."""
    kept = []
    for batch in table.select(["text"]).combine_chunks().to_batches():
        for part in tk.slices(batch, "text"):
            kept.append(_sets(part.column("text"), size)[0] >> SHORT)
    keys, n = sorted_distinct(np.concatenate(kept) if kept else np.zeros(0, np.uint64))
    edges = bucket_edges(keys << SHORT, buckets)
    r = np.flatnonzero(np.diff(edges))
    cut = [slice(edges[i], edges[i + 1]) for i in r]
    block = table["block"][0].as_py()
    return pa.table([pa.array(r, pa.int32()), pa.array([block] * len(r), pa.int32()), pa.array([pack_keys(keys[c]) for c in cut], pa.binary()), pa.array([pack_ints(n[c]) for c in cut], pa.binary())], names=["r", "block", "keys", "counts"])


def _classes(table: pa.Table) -> pa.Table:
    """For each block, the class of each of its shingles: 0 where one document of the corpus has it, else 1 + floor(log2(documents))."""
    _, total, places = merge_totals([unpack_keys(b) for b in table["keys"].to_pylist()], [unpack_ints(b) for b in table["counts"].to_pylist()])
    kind = np.where(total > 1, 1 + np.floor(np.log2(np.maximum(total, 1))), 0).astype(np.uint8)
    return pa.table([table["block"], table["r"], pa.array([kind[p].tobytes() for p in places], pa.binary())], names=["block", "r", "kinds"])


SET_SCHEMA = "doc_id bigint, n bigint, sig binary, shingles binary, places binary, kinds binary"
SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("shingles", pa.binary()), ("places", pa.binary()), ("kinds", pa.binary())])


def _prefixes(docs: pa.Table, kinds: pa.Table, size: int, sizes: Sizes) -> pa.Table:
    """Each row's set size and signature, and its prefix: shingles that other documents have too, with place and class."""
    out: list[tuple] = []
    if docs.num_rows:
        parts = [p for b in docs.select(["doc_id", "text"]).combine_chunks().to_batches() for p in tk.slices(b, "text")]
        keys, _ = sorted_distinct(np.concatenate([_sets(p.column("text"), size)[0] >> SHORT for p in parts]))
        answer = kinds["kinds"].take(pa.array(np.argsort(kinds["r"].to_numpy()))).to_pylist() if kinds.num_rows else []
        kind_of = np.frombuffer(b"".join(answer), np.uint8)
        if len(kind_of) != len(keys):
            raise ValueError("a block holds other texts than it asked for")
        for part in parts:
            values, at = _sets(part.column("text"), size)
            kind = kind_of[np.searchsorted(keys, values >> SHORT)]
            with np.errstate(over="ignore"):
                one, two = np.cumsum(np.append(np.uint64(0), values * values)), np.cumsum(np.append(np.uint64(0), tk.mix(values)))
                one, two = one[at[1:]] - one[at[:-1]], two[at[1:]] - two[at[:-1]]
            for i, doc in enumerate(part.column("doc_id").to_pylist()):
                own, n = slice(at[i], at[i + 1]), int(at[i + 1] - at[i])
                first = np.lexsort((values[own], kind[own]))[: sizes.prefix(n)] if n else np.zeros(0, np.int64)
                shared = np.flatnonzero(kind[own][first] > 0)
                first = first[shared]
                out.append((doc, n, one[i].tobytes() + two[i].tobytes(), values[own][first].tobytes(), pack_ints(shared), kind[own][first].tobytes()))
    cols = list(zip(*out, strict=True)) if out else [()] * len(SETS)
    return pa.table([pa.array(c, t) for c, t in zip(cols, SETS.types, strict=True)], schema=SETS)


def _entries(b: pa.RecordBatch, sizes: Sizes) -> tuple[np.ndarray, ...]:
    """Prefix entries of a batch of sets: shingle, id, set size, shingles left from there on, class."""
    raw = b.column("shingles").to_pylist()
    m = np.array([len(x) // 8 for x in raw], np.int64)
    place = [unpack_ints(x) for x in b.column("places").to_pylist()]
    n = np.repeat(b.column("n").to_numpy(), m)
    return np.frombuffer(b"".join(raw), np.uint64), np.repeat(b.column("v").to_numpy(), m), n, n - (np.concatenate(place) if place else np.zeros(0)).astype(np.int64), np.frombuffer(b"".join(b.column("kinds").to_pylist()), np.uint8)


def _block_key(shingle: np.ndarray, block: np.ndarray) -> np.ndarray:
    return tk.chain(shingle, block.astype(np.uint64))


def _pivots(key: np.ndarray, v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each list block: the entry of least hashed id, and the smallest set."""
    if not len(key):
        return key, v, n
    order = np.lexsort((tk.mix(v.view(np.uint64)), key))
    k = key[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], v[order][first], np.minimum.reduceat(n[order], first)


def _with_pivots(shingle, v, n, rest, sizes: Sizes, table) -> pa.Table:
    """(a, y, rest): each entry with the pivot of its own block and of the next smaller one, unless the block is skipped."""
    keys, pivot, smallest = table
    out = []
    for less in (0, 1):
        key = _block_key(shingle, sizes.block(n) - less)
        at = np.searchsorted(keys, key)
        at[at == len(keys)] = 0
        keep = np.flatnonzero((keys[at] == key) & (smallest[at] <= sizes.largest_partner(rest, n)) & (pivot[at] != v)) if len(keys) else np.zeros(0, np.int64)
        out.append((pivot[at[keep]], v[keep], rest[keep]))
    a, y, r = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((-r, y, a))
    a, y, r = a[order], y[order], r[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (y[1:] != y[:-1])])) if len(a) else np.zeros(0, np.int64)
    return pa.table({"a": pa.array(a[first], pa.int64()), "y": pa.array(y[first], pa.int64()), "rest": pa.array(r[first], pa.int64())})


def _hot_pivots(sizes: Sizes, hot: int):
    """Pivots of a task's own list blocks of shingles of class ``hot`` and above."""

    def run(batches):
        kept = []
        for b in batches:
            shingle, v, n, rest, kind = _entries(b, sizes)
            own = (kind >= hot) & sizes.indexed(rest, n)
            kept.append(_pivots(_block_key(shingle[own], sizes.block(n[own])), v[own], n[own]))
        if kept:
            key, v, n = _pivots(*(np.concatenate(x) for x in zip(*kept, strict=True)))
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(tk.mix(v.view(np.uint64)).astype(np.float64)), pa.array(v, pa.int64()), pa.array(n, pa.int64())], names=["key", "h", "v", "n"])

    return run


def _hot_pairs(sizes: Sizes, hot: int, table):
    def run(batches):
        for b in batches:
            entries = _entries(b, sizes)
            own = entries[-1] >= hot
            yield from _with_pivots(*(x[own] for x in entries[:-1]), sizes, table.value).to_batches()

    return run


def _postings(sizes: Sizes, buckets: int, hot: int):
    """A task's index entries of the other shingles, packed by range of the hash space."""

    def run(batches):
        held, rows = [], 0

        def pack():
            shingle, v, n, rest = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(shingle)
            shingle, v, n, rest = (x[order] for x in (shingle, v, n, rest))
            edges = bucket_edges(shingle, buckets)
            r = np.flatnonzero(np.diff(edges))
            cut = [slice(edges[i], edges[i + 1]) for i in r]
            cols = [pa.array([f(x[c]) for c in cut], pa.binary()) for f, x in ((pack_keys, shingle), (lambda z: z.astype("<i8").tobytes(), v), (pack_ints, n), (pack_ints, n - rest))]
            return pa.record_batch([pa.array(r.astype(np.int32)), *cols], names=["r", "shingles", "v", "n", "place"])

        for b in batches:
            entries = _entries(b, sizes)
            own = entries[-1] < hot
            held.append(tuple(x[own] for x in entries[:-1]))
            rows += len(held[-1][0])
            if rows > 3_000_000:
                yield pack()
                held, rows = [], 0
        if held:
            yield pack()

    return run


def _list_pairs(table: pa.Table, sizes: Sizes) -> pa.Table:
    cols = [[f(b) for b in table[c].to_pylist()] for f, c in ((unpack_keys, "shingles"), (lambda b: np.frombuffer(b, np.int64), "v"), (unpack_ints, "n"), (unpack_ints, "place"))]
    shingle, v, n, place = (np.concatenate(c) for c in cols)
    n, rest = n.astype(np.int64), (n - place).astype(np.int64)
    found, count = sorted_distinct(shingle)
    more = np.isin(shingle, found[count > 1], kind="sort")
    shingle, v, n, rest = shingle[more], v[more], n[more], rest[more]
    own = sizes.indexed(rest, n)
    return _with_pivots(shingle, v, n, rest, sizes, _pivots(_block_key(shingle[own], sizes.block(n[own])), v[own], n[own]))


COMPARED = pa.schema([(c, pa.int64()) for c in ("a", "shape", "y", "rest", "na", "ny", "common")] + [("missing", pa.binary()), ("extra", pa.binary())])


def _differences(docs: pa.Table, asked: pa.Table, size: int) -> pa.Table:
    """Exact differences of a block's documents from the pivots asked for: places of the pivot's shingles that are missing, and shingles that are extra."""
    out: list[tuple] = []
    if docs.num_rows and asked.num_rows:
        sets: dict[int, list[np.ndarray]] = {}
        for batch in docs.select(["doc_id", "text"]).combine_chunks().to_batches():
            for part in tk.slices(batch, "text"):
                values, at = _sets(part.column("text"), size)
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    sets.setdefault(doc, []).append(values[at[i] : at[i + 1]])
        for batch in asked.combine_chunks().to_batches():
            for part in tk.slices(batch, "pivot_text"):
                values, at = _sets(part.column("pivot_text"), size)
                for i, (a, ys) in enumerate(zip(part.column("a").to_pylist(), part.column("ys").to_pylist(), strict=True)):
                    own = values[at[i] : at[i + 1]]
                    if not len(own):
                        continue
                    shape = int(tk.mix(own).sum(dtype=np.uint64).view(np.int64))
                    for item in ys:
                        for other in sets.get(item["y"], ()):
                            where = np.searchsorted(own, other)
                            where[where == len(own)] = 0
                            same = own[where] == other
                            missing = np.ones(len(own), bool)
                            missing[where[same]] = False
                            out.append((a, shape, item["y"], item["rest"], len(own), len(other), int(same.sum()), pack_ints(np.flatnonzero(missing)), other[~same].tobytes()))
    cols = list(zip(*out, strict=True)) if out else [()] * len(COMPARED)
    return pa.table([pa.array(c, t) for c, t in zip(cols, COMPARED.types, strict=True)], schema=COMPARED)


BLOOM_BITS = 1 << 23


def _needed(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is among ``ids``: first by a bit table of fixed size, so that other texts are not moved, then exactly."""
    spark = rows.sparkSession
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(BLOOM_BITS))
    words = ids.select(slot.alias("s")).groupBy(F.expr("cast(s div 64 as int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("b")).toArrow()
    table = np.zeros(BLOOM_BITS // 64, np.uint64)
    table[as_array(words["w"]).to_numpy()] = as_array(words["b"]).to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(table)

    def test(s: pa.Array) -> pa.Array:
        x = s.to_numpy(zero_copy_only=False).astype(np.uint64)
        return pa.array((shared.value[x >> np.uint64(6)] >> (x & np.uint64(63))) & np.uint64(1) == 1)

    maybe = F.arrow_udf(test, "boolean")
    return rows.where(F.col("doc_id").isNotNull()).where(maybe(slot)).join(ids, "doc_id", "left_semi")


def _compare(rows: DataFrame, pairs: DataFrame, size: int, blocks: int) -> DataFrame:
    """(a, y, rest) to each y's exact difference from its pivot a: a block of documents gets each pivot's text once."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("y")).distinct()
    spot = F.pmod(F.xxhash64("doc_id", F.length("text"), F.xxhash64("text")), F.lit(blocks)).cast("int")
    texts = materialise(_needed(rows, ids).withColumn("block", spot), "texts")
    repeated = materialise(texts.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():  # rows that repeat say nothing new, and would gather in one block
        once = texts.join(repeated, "doc_id", "left_semi").distinct()
        texts = materialise(texts.join(repeated, "doc_id", "left_anti").unionByName(once), "texts")
    place = texts.select(F.col("doc_id").alias("y"), F.col("block").alias("at")).distinct()
    asked = pairs.join(place, "y").groupBy("at", "a").agg(F.collect_list(F.struct("y", "rest")).alias("ys"))
    asked = asked.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("pivot_text")), "a").select("at", "a", "ys", "pivot_text")
    left = texts.join(pairs.select(F.col("y").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return left.groupBy("block").cogroup(asked.groupBy("at")).applyInArrow(lambda d, q: _differences(d, q, size), "a bigint, shape bigint, y bigint, rest bigint, na bigint, ny bigint, common bigint, missing binary, extra binary")


class _Deltas:
    """Differences of many sets from one pivot, laid end to end."""

    def __init__(self, rows: list[np.ndarray]):
        self.at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.all = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.sizes = np.diff(self.at)

    def common(self, own: np.ndarray) -> np.ndarray:
        """How many values each set shares with ``own`` (sorted)."""
        if not len(own) or not len(self.all):
            return np.zeros(len(self.sizes), np.int64)
        where = np.searchsorted(own, self.all)
        where[where == len(own)] = 0
        total = np.concatenate([[0], np.cumsum(own[where] == self.all)])
        return total[self.at[1:]] - total[self.at[:-1]]


def _open_links(table: pa.Table, sizes: Sizes) -> pa.Table:
    """Links between components that one pivot's group still has: of its ``left`` sets with its ``right`` ones, derived from the differences.

    |x & y| = |a| - |a - x| - |a - y| + |(a - x) & (a - y)| + |(x - a) & (y - a)|.
    """
    left, right = (np.flatnonzero(as_array(table[c]).to_numpy(zero_copy_only=False)) for c in ("left", "right"))
    col = {c: as_array(table[c]).to_numpy() for c in ("c", "na", "ny", "common", "rest")}
    found: set[tuple[int, int]] = set()
    if len(left) and len(right):
        raw = [table[c].to_pylist() for c in ("missing", "extra")]
        missing = [unpack_ints(b).astype(np.int64) for b in raw[0]]
        extra = [np.frombuffer(b, np.uint64) for b in raw[1]]
        m, e = _Deltas([missing[i] for i in right]), _Deltas([extra[i] for i in right])
        oy, ny, ry, cy = (col[c][right] for c in ("common", "ny", "rest", "c"))
    for i in left if len(right) else ():
        o, n, r, c = (int(col[k][i]) for k in ("common", "ny", "rest", "c"))
        need = sizes.least_common(n, ny)
        ok = (cy != c) & (np.minimum(n, ny) >= need) & (np.minimum(o + ny - oy, oy + n - o) >= need) & (np.minimum(r, ry) >= need)
        if not ok.any():
            continue
        both = int(col["na"][i]) - len(missing[i]) - m.sizes + m.common(missing[i]) + e.common(extra[i])
        for other in np.unique(cy[ok & (both >= need)]):
            found.add((min(c, int(other)), max(c, int(other))))
    a, b = zip(*sorted(found), strict=True) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _dealt(member: DataFrame) -> DataFrame:
    """A pivot's group in cells, so that each open set meets each other open set, and each of the closed ones, in one cell.

    Open sets are dealt to ``opens`` parts, closed ones to ``others``; a cell has
    an open part on its left, and that or a later open part, or a closed part,
    on its right.
    """
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    part = F.pmod(F.xxhash64("y"), F.when(F.col("is_x"), F.col("opens")).otherwise(F.col("others"))).cast("int")
    side = lambda kind, i, j, left: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), left.alias("left"), (~left | ((F.lit(kind) == 0) & (i == j))).alias("right"))
    p = F.col("own_part")
    of_open = F.concat(F.transform(upto("opens"), lambda j: side(0, F.least(p, j), F.greatest(p, j), p <= j)), F.transform(upto("others"), lambda j: side(1, p, j, F.lit(True))))
    of_closed = F.transform(upto("opens"), lambda i: side(1, i, p, F.lit(False)))
    cells = member.withColumn("own_part", part).withColumn("cell", F.explode(F.when(F.col("is_x"), of_open).otherwise(of_closed)))
    return cells.select("a", "shape", "cell.*", "c", "na", "ny", "common", "rest", "missing", "extra")


def near_duplicate_groups(docs: DataFrame, *, size: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", hot_df: int = HOT_DF) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    spark = docs.sparkSession
    ship(spark)
    sizes = Sizes(percent)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = blocks_for(rows)
    ranges = ranges_for(rows, blocks)

    placed = rows.withColumn("block", deal(blocks))
    counted = placed.groupBy("block").applyInArrow(lambda t: _block_counts(t, size, ranges), "r int, block int, keys binary, counts binary")
    kinds = counted.groupBy("r").applyInArrow(_classes, "block int, r int, kinds binary")
    sets = materialise(placed.groupBy("block").cogroup(kinds.groupBy("block")).applyInArrow(lambda d, k: _prefixes(d, k, size, sizes), SET_SCHEMA), "sets")
    whole = sets.where("doc_id IS NOT NULL AND n > 0")
    least = whole.groupBy("n", "sig").agg(F.min("doc_id").alias("v"), F.max(F.struct("shingles", "places", "kinds")).alias("p"))
    indexed = materialise(least.where("length(p.shingles) > 0").select("v", "n", "p.*"), "indexed")
    entries = indexed.agg(F.coalesce(F.sum(F.length("shingles")), F.lit(0))).first()[0] // 8
    hot = 1 + max(hot_df, entries // HOT_LISTS).bit_length()  # so many lists at most are longer

    pivots = indexed.mapInArrow(_hot_pivots(sizes, hot), "key bigint, h double, v bigint, n bigint").groupBy("key").agg(F.min(F.struct("h", "v")).alias("p"), F.min("n").alias("n")).select("key", "p.v", "n").toArrow()
    hot_keys = as_array(pivots["key"]).to_numpy().view(np.uint64)
    order = np.argsort(hot_keys)
    table = spark.sparkContext.broadcast((hot_keys[order], as_array(pivots["v"]).to_numpy()[order], as_array(pivots["n"]).to_numpy()[order]))
    pair = "a bigint, y bigint, rest bigint"
    lists = indexed.mapInArrow(_postings(sizes, ranges, hot), "r int, shingles binary, v binary, n binary, place binary").groupBy("r").applyInArrow(lambda t: _list_pairs(t, sizes), pair)
    pairs = materialise(indexed.mapInArrow(_hot_pairs(sizes, hot, table), pair).unionByName(lists).groupBy("a", "y").agg(F.max("rest").alias("rest")), "pairs")

    compared = materialise(_compare(rows, pairs, size, blocks), "compared")
    linked = F.expr(f"common * {100 + percent} >= {percent} * (na + ny)")
    near = components(compared.where(linked).select("a", F.col("y").alias("b")))

    label = lambda df, v, c: df.join(near.select(F.col("v").alias(v), F.col("c").alias(c)), v, "left").withColumn(c, F.coalesce(c, v))
    group = label(label(compared.select("a", "shape", "y", "ny", "common"), "a", "ca"), "y", "c").withColumn("open", F.col("ca") != F.col("c"))
    left_open = F.min(F.when(F.col("open"), F.expr(f"(ny * {percent} + 99) div 100 - common"))).alias("least")
    in_parts = lambda n: F.ceil(n / OPEN_GROUP).cast("int")
    totals = group.groupBy("a", "shape").agg(left_open, in_parts(F.count_if("open")).alias("opens"), F.greatest(F.lit(1), in_parts(F.count_if(~F.col("open")))).alias("others"))
    totals = materialise(totals.where("least IS NOT NULL"), "totals")  # a plain table, so that the join can split a hot pivot's rows
    if not totals.isEmpty():
        member = label(label(compared.join(totals, ["a", "shape"]), "a", "ca"), "y", "c").withColumn("is_x", F.col("ca") != F.col("c")).where("is_x OR ny - common >= least")
        late = materialise(_dealt(member).groupBy("a", "shape", "kind", "i", "j").applyInArrow(lambda t: _open_links(t, sizes), "a bigint, b bigint").distinct(), "late")
        if not late.isEmpty():
            joined = components(late).select(F.col("v").alias("c"), F.col("c").alias("low"))
            extra = joined.select(F.col("c").alias("v"), F.col("low").alias("c"))  # a component may be one unlinked id
            near = near.join(joined, "c", "left").select("v", F.coalesce("low", "c").alias("c")).unionByName(extra.join(near.select("v"), "v", "left_anti"))

    reached = least.select("n", "sig", "v").join(near, "v", "left").select("n", "sig", F.coalesce("c", "v").alias("c"))
    return sets.select("doc_id", "n", "sig").join(reached, ["n", "sig"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("doc_id"))).alias("component_id"))
