"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are turned into integers, floor(scale * x).

*Pieces.*  Rows are placed by their nearest pivot (``PIVOTS`` rows of least
hashed id; they only choose places) and dealt in that order to ranges, so that
neighbours meet and a hot pivot is split by hashed ids.  A range is cut into
pieces of ``piece_rows`` and ``PIECE_BYTES`` at most.  A piece searches its own query rows as it is
cut: each query's k-th score there is its floor from then on.

*Routes.*  A piece is known by its centre, radius and longest row.  A query goes
to all other pieces that can hold an inner product at or over its floor.  Pieces
are compared in blocks of ``routed``, so that what is broadcast is bounded.

*Trees.*  A cover tree node has a centre, a covering radius over all its rows,
the length of its longest row, and children a 1.3th of its radius apart
(farthest-first, at most ``FAN``); up to ``FEW`` rows in which no such children
are found stay a leaf.  A task holds a piece's tree and lets its queries stream
past in blocks of ``query_block``, each with a tree of its own.  A pair of nodes with centres q and r gives no inner product over

    min(<q, r> + rad(q) |r| + rad(r) |q| + rad(q) rad(r), longest(q) longest(r))

and is pruned where that lies below the worst k-th score of the query node.
Within a query leaf each query has its own bound, min(<x, r> + rad(r) |x|, |x|
longest(r)).  Leaves that one of them can reach are multiplied out, those of the
best bounds first and about ``TOGETHER`` rows at a time, until no bound is left
over the k-th scores.  Equal bounds are kept, as ties go to the smaller id.
Products are exact: in doubles while every sum stays below 2**53, in unbounded
integers beyond.

Nothing of rows or queries reaches the driver; each query row is sent to a piece
once at most, and only k rows a query and piece come back.

Nulls and edges: rows whose id or vector is null, or whose vector holds null or
non-finite components (or components whose ``scale``-fold is), take no part.
Vectors of different lengths don't meet; empty ones have product 0.  Every row
is a candidate, repeated rows too, except those with the query's own id.  Query
rows that repeat count once; different vectors of one query id are one query
with the best of both.  A query with fewer than k candidates returns them all,
one with none no row.  Equal scores are ranked by smaller vec_id.  Ranks are by
exact scores; those beyond 64 bits are cut to the range when they are returned.
Long vectors make pieces of fewer rows.  An empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import textkernel as tk
from quillon.llm.common import as_array, blocks_for, materialise, ship

FAN, LEAF, SHRINK, FEW, TOGETHER = 32, 64, 1.3, 512, 512
PIECE_ROWS, PIECE_BYTES, QUERIES, PIVOTS, ROUTED, ROUTE_ROWS = 1 << 15, 32 << 20, 4096, 256, 16_384, 256
EXACT = 2.0**53
NONE = np.iinfo(np.int64).max


class Tree:
    """Cover tree over the rows of ``x``; rows are put in order, so that each node's are neighbours."""

    def __init__(self, x: np.ndarray, few: int = LEAF):
        order, size = np.arange(len(x)), np.sqrt((x * x).sum(1))
        spans, centres, self.children, radius = [(0, len(x))], [0], [], []
        at = 0
        while at < len(spans):
            (lo, hi), first = spans[at], centres[at]
            rows = order[lo:hi]
            own = x[rows]
            near = np.sqrt(((own - x[first]) ** 2).sum(1))
            radius.append(float(near.max(initial=0)))
            self.children.append(slice(0, 0))
            if hi - lo > LEAF and radius[at] > 0:
                picked, owner = [first], np.zeros(hi - lo, np.int64)
                while len(picked) < FAN and near.max() > radius[at] / SHRINK:
                    far = int(near.argmax())
                    d = np.sqrt(((own - own[far]) ** 2).sum(1))
                    closer = d < near
                    owner[closer], near[closer] = len(picked), d[closer]
                    picked.append(int(rows[far]))
                if hi - lo <= few and near.max() > radius[at] / SHRINK:
                    at += 1  # no clusters in it: smaller leaves wouldn't pay
                    continue
                order[lo:hi] = rows[np.argsort(owner, kind="stable")]
                count = np.bincount(owner, minlength=len(picked))
                ends = lo + np.cumsum(count)
                self.children[at] = slice(len(spans), len(spans) + int((count > 0).sum()))
                for c, n, end in zip(picked, count, ends, strict=True):
                    if n:
                        spans.append((int(end - n), int(end)))
                        centres.append(c)
            at += 1
        self.order, self.x, self.size = order, x[order], size[order]
        self.lo, self.hi = (np.array(s, np.int64) for s in zip(*spans, strict=True))
        self.centre, self.length = x[centres] if len(x) else np.zeros((1, x.shape[1])), size[centres] if len(x) else np.zeros(1)
        self.radius = np.array(radius) * (1 + 1e-9)
        self.most = np.array([self.size[a:b].max(initial=0) for a, b in spans]) * (1 + 1e-9)
        self.first, self.past = (np.array([getattr(c, end) for c in self.children], np.int64) for end in ("start", "stop"))
        self.inner = self.past > self.first

    def below(self, nodes: np.ndarray) -> np.ndarray:
        """The children of some nodes."""
        n = (self.past - self.first)[nodes]
        return np.repeat(self.first[nodes] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _over(dots: np.ndarray, lengths: np.ndarray, centre: np.ndarray, radius: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Upper bounds of inner products of vectors of some lengths with rows around centres, over rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        bound = np.minimum(dots + lengths * radius, lengths * most) + 1e-9 * lengths * (centre + radius) + 1e-6
    return np.where(np.isnan(bound), np.inf, bound)


class DualSearch:
    """Best k rows of a piece for blocks of queries."""

    def __init__(self, ids: np.ndarray, y: np.ndarray, k: int):
        self.tree, self.k = Tree(y, FEW), k
        self.ids, self.top = ids[self.tree.order], float(np.abs(y).max(initial=0))
        self.visited = self.pairs = 0  # products made, and all there are

    def run(self, ids: np.ndarray, x: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vec_id, score) of each query's best k; those under its floor may be left out."""
        if not len(x) or not len(self.ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.exact = self.top * float(np.abs(x).max(initial=0)) * max(1, x.shape[1]) >= EXACT
        q = self.q = Tree(x)
        self.q_ids, self.kth = ids[q.order], floor[q.order].copy()
        self.score = np.full((len(x), self.k), -np.inf, object if self.exact else np.float64)
        self.found = np.full((len(x), self.k), NONE, np.int64)
        self.pairs += len(x) * len(self.ids)
        stack = [(0, np.zeros(1, np.int64))]  # a query node, and the data nodes that it may need
        while stack:
            a, front = stack.pop()
            front = self._reach(a, front)
            if len(front) and q.children[a].stop == q.children[a].start:
                self._leaf(np.arange(q.lo[a], q.hi[a]), front)
            elif len(front):
                stack.extend((c, front) for c in range(q.children[a].start, q.children[a].stop))
        row, place = np.nonzero(self.found != NONE)
        return q.order[row], self.found[row, place], self.score[row, place]

    def _reach(self, a: int, front: np.ndarray) -> np.ndarray:
        """Data nodes no wider than query node ``a`` that aren't pruned for all of its queries."""
        q, r = self.q, self.tree
        while len(front):
            dots = r.centre[front] @ q.centre[a] + q.radius[a] * (r.length[front] + r.radius[front])
            bound = _over(dots, q.length[a] + q.radius[a], r.length[front], r.radius[front], np.inf)
            bound = np.minimum(bound, q.most[a] * r.most[front] * (1 + 1e-9) + 1e-6)
            front = front[bound >= self.kth[q.lo[a] : q.hi[a]].min()]
            wide = r.inner[front] & (r.radius[front] >= q.radius[a])
            if not wide.any():
                break
            front = np.concatenate([front[~wide], r.below(front[wide])])
        return front

    def _leaf(self, rows: np.ndarray, front: np.ndarray) -> None:
        """The queries of one leaf against data nodes: down to the leaves that one of them can reach, the best first."""
        r, leaves, bounds = self.tree, [], []
        while len(front):
            bound = _over(self.q.x[rows] @ r.centre[front].T, self.q.size[rows][:, None], r.length[front], r.radius[front], r.most[front])
            alive = (bound >= self.kth[rows][:, None]).any(0)
            last = alive & ~r.inner[front]
            leaves.append(front[last])
            bounds.append(bound[:, last])
            front = r.below(front[alive & r.inner[front]])
        leaf, bound = np.concatenate(leaves or [front]), np.concatenate(bounds, 1) if bounds else np.zeros((len(rows), 0))
        best = bound.max(0) if len(leaf) else np.zeros(0)
        order, at = np.argsort(-best), 0
        ends = np.cumsum((r.hi - r.lo)[leaf[order]])
        while at < len(order) and best[order[at]] >= self.kth[rows].min():
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, side="right")))
            part = order[at:to]
            alive = bound[:, part] >= self.kth[rows][:, None]
            part, own = leaf[part[alive.any(0)]], rows[alive.any(1)]
            if len(part):
                self._multiply(own, np.concatenate([np.arange(r.lo[i], r.hi[i]) for i in part]))
            at = to

    def _multiply(self, rows: np.ndarray, part: np.ndarray) -> None:
        x, y, ids = self.q.x[rows], self.tree.x[part], self.ids[part]
        self.visited += len(x) * len(y)
        if self.exact:
            self._multiply_exactly(rows, x, y, ids)
            return
        s = x @ y.T
        own = np.isin(self.q_ids[rows], ids)
        if own.any():
            s[self.q_ids[rows][:, None] == ids[None, :]] = -np.inf
        better = np.flatnonzero((s.max(1) >= self.kth[rows]) & (s.max(1) > -np.inf))
        if not len(better):
            return
        rows, s = rows[better], s[better]
        least = self.kth[rows]
        if s.shape[1] > self.k:  # the k-th best of these rows is a floor too; ties are kept
            least = np.maximum(least, np.partition(s, -self.k, axis=1)[:, -self.k])
        row, col = np.nonzero((s >= least[:, None]) & (s > -np.inf))
        old, place = np.nonzero(self.found[rows] != NONE)
        owner = np.concatenate([old, row])
        score = np.concatenate([self.score[rows][old, place], s[row, col]])
        found = np.concatenate([self.found[rows][old, place], ids[col]])
        order = np.lexsort((found, -score, owner))
        owner, score, found = owner[order], score[order], found[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        best = rank < self.k
        self.score[rows[owner[best]], rank[best]], self.found[rows[owner[best]], rank[best]] = score[best], found[best]
        self.kth[rows] = np.maximum(self.kth[rows], self.score[rows, -1])

    def _multiply_exactly(self, rows: np.ndarray, x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> None:
        x, y = ([[int(v) for v in row] for row in m] for m in (x, y))
        for row, own in zip(rows, x, strict=True):
            found = [(-s, int(i)) for s, i in zip(self.score[row], self.found[row], strict=True) if i != NONE]
            found += [(-sum(a * b for a, b in zip(own, other, strict=True)), int(i)) for other, i in zip(y, ids, strict=True) if i != self.q_ids[row]]
            for j, (s, i) in enumerate(sorted(found)[: self.k]):
                self.score[row, j], self.found[row, j] = -s, i
            if self.found[row, -1] != NONE:
                self.kth[row] = max(self.kth[row], np.nextafter(float(self.score[row, -1]), -np.inf))


def _matrices(ids: np.ndarray, vectors: pa.Array, scale: int):
    """(length, ids, integer matrix) for each vector length; rows that take no part are left out."""
    values, offsets = vectors.flatten(), vectors.offsets.to_numpy()
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(scale * values.to_numpy(zero_copy_only=False).astype(np.float64))
    offsets = offsets - offsets[0]
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    n = np.diff(offsets)
    ok = (bad[offsets[1:]] == bad[offsets[:-1]]) & vectors.is_valid().to_numpy(zero_copy_only=False)
    for size in np.unique(n[ok]):
        rows = np.flatnonzero(ok & (n == size))
        yield int(size), ids[rows], flat[offsets[rows][:, None] + np.arange(size)].reshape(len(rows), size)


def _pack(x: np.ndarray) -> list[bytes]:
    """Each row's integers in two, four or (as doubles) eight bytes."""
    top = np.abs(x).max(initial=0)
    kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8"
    return [row.tobytes() for row in np.ascontiguousarray(x.astype(kind))]


def _unpack(rows: list[bytes], size: int) -> np.ndarray:
    out = np.zeros((len(rows), size))
    wide = np.array([len(r) for r in rows]) // max(1, size)
    for n, kind in ((2, "<i2"), (4, "<i4"), (8, "<f8")):
        at = np.flatnonzero(wide == n)
        if len(at):
            out[at] = np.frombuffer(b"".join(rows[i] for i in at), kind).reshape(len(at), size)
    return out


def _chain(x: np.ndarray) -> np.ndarray:
    """Rows in an order in which each is followed by the nearest one left."""
    left, order = list(range(len(x))), []
    while left:
        order.append(left.pop(0 if not order else int(((x[left] - x[order[-1]]) ** 2).sum(1).argmin())))
    return x[order] if order else x


PLACED = "size int, pivot int, salt bigint, vec_id bigint, vector binary"


def _place(shared, scale: int, k: int):
    """Each row's integers with the number of its nearest pivot; of rows that repeat within a batch, k stay, as no query can return more."""

    def run(batches):
        for b in batches:
            for size, ids, x in _matrices(b.column("vec_id").to_numpy(), b.column("vector"), scale):
                packed = _pack(x)
                if len(np.unique(ids)) < len(ids):
                    seen: dict = {}
                    keep = []
                    for i, key in enumerate(zip(ids.tolist(), packed, strict=True)):
                        seen[key] = seen.get(key, 0) + 1
                        if seen[key] <= k:
                            keep.append(i)
                    ids, x, packed = ids[keep], x[keep], [packed[i] for i in keep]
                p, pivot = shared.value.get(size), np.zeros(len(ids), np.int32)
                if p is not None and len(p):
                    with np.errstate(over="ignore", invalid="ignore"):
                        pivot = ((p * p).sum(1)[None, :] - 2 * (x @ p.T)).argmin(1).astype(np.int32)
                yield pa.record_batch([pa.array(np.full(len(ids), size, np.int32)), pa.array(pivot), pa.array(tk.mix(ids.view(np.uint64)).view(np.int64)), pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], names=["size", "pivot", "salt", "vec_id", "vector"])

    return run


# What a piece leaves behind, by kind: its rows (0), its queries with their floors (1), its centre, radius and longest row (2), scores (3).
CUT = "kind int, piece bigint, size int, vec_id bigint, vector binary, floor double, radius double, most double, query_id bigint, score bigint, beyond string"
FIELDS = pa.schema([("kind", pa.int32()), ("piece", pa.int64()), ("size", pa.int32()), ("vec_id", pa.int64()), ("vector", pa.binary()), ("floor", pa.float64()), ("radius", pa.float64()), ("most", pa.float64()), ("query_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.string())])


def _cut_rows(kind: int, n: int, **columns) -> pa.RecordBatch:
    columns["kind"] = np.full(n, kind, np.int32)
    return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in FIELDS], schema=FIELDS)


def _scores(score: np.ndarray) -> dict:
    """Scores cut to 64 bits, and a text that sorts those beyond."""
    if score.dtype != object:
        return {"score": score.astype(np.int64), "beyond": ["M"] * len(score)}
    low, high = -(2**63), 2**63 - 1
    digits = [str(abs(int(s))) for s in score]
    under = lambda d: "C" + f"{999 - len(d):03d}" + "".join(chr(105 - ord(c)) for c in d)
    return {"score": [min(max(int(s), low), high) for s in score], "beyond": ["M" if low <= int(s) <= high else f"P{len(d):03d}{d}" if s > 0 else under(d) for s, d in zip(score, digits, strict=True)]}


def _cut(k: int, every: int, block: int, piece_rows: int):
    """Pieces of a task's rows, each with its own queries searched."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, packed, held = [], [], -1

        def piece():
            nonlocal number, ids, packed
            own, y = np.array(ids, np.int64), _unpack(packed, held)
            name, n = number, len(ids)
            yield _cut_rows(0, n, piece=np.full(n, name), size=np.full(n, held, np.int32), vec_id=own, vector=packed)
            with np.errstate(over="ignore", invalid="ignore"):
                centre, most = y.mean(0), float(np.sqrt((y * y).sum(1)).max())
                radius = float(np.sqrt(((y - centre) ** 2).sum(1)).max())
            yield _cut_rows(2, 1, piece=[name], size=[held], vector=[centre.astype("<f8").tobytes()], radius=[radius], most=[most])
            asked = {}
            for i in np.flatnonzero(own % every == 0).tolist():
                asked.setdefault((ids[i], packed[i]), i)
            at = np.array(list(asked.values()), np.int64)
            if len(at):
                dual, floor = DualSearch(own, y, k), np.full(len(at), -np.inf)
                for a in range(0, len(at), block):
                    part = at[a : a + block]
                    q, r, s = dual.run(own[part], y[part], floor[a : a + block])
                    back = dual.q.order
                    floor[a + back] = np.where(dual.found[:, -1] == NONE, -np.inf, dual.kth)
                    yield _cut_rows(3, len(q), query_id=own[part][q], vec_id=r, **_scores(s))
                yield _cut_rows(1, len(at), piece=np.full(len(at), name), size=np.full(len(at), held, np.int32), vec_id=own[at], vector=[packed[i] for i in at], floor=floor)
            number, ids, packed = number + 1, [], []

        for b in batches:
            sizes = b.column("size").to_numpy()
            for size in np.unique(sizes):
                part = b.filter(pa.array(sizes == size))
                most = max(1, min(piece_rows, PIECE_BYTES // (8 * max(1, int(size)))))
                if ids and size != held:
                    yield from piece()
                held = int(size)
                new, vectors, at = part.column("vec_id").to_pylist(), part.column("vector").to_pylist(), 0
                while at < len(new):
                    to = at + most - len(ids)
                    ids, packed, at = ids + new[at:to], packed + vectors[at:to], to
                    if len(ids) >= most:
                        yield from piece()
        if ids:
            yield from piece()

    return run


ROUTE = "kind int, piece bigint, size int, vec_id bigint, vector binary, floor double"


def _route(shared):
    """Queries to all pieces but their own that can hold something at or over their floors."""

    def run(batches):
        for b in batches:
            sizes, ids, floor = b.column("size").to_numpy(), b.column("vec_id").to_numpy(), b.column("floor").to_numpy()
            homes, vectors = b.column("homes").to_pylist(), b.column("vector").to_pylist()
            for size in np.unique(sizes):
                pieces, centre, radius, most = shared.value.get(int(size), (np.zeros(0, np.int64), *[None] * 3))
                rows = np.flatnonzero(sizes == size)
                for a in range(0, len(rows) if len(pieces) else 0, ROUTE_ROWS):
                    part = rows[a : a + ROUTE_ROWS]
                    x = _unpack([vectors[i] for i in part], int(size))
                    length, far = np.sqrt((x * x).sum(1))[:, None], np.sqrt((centre * centre).sum(1))
                    fits = _over(x @ centre.T, length, far, radius * (1 + 1e-9), most * (1 + 1e-9)) >= floor[part][:, None]
                    for i, row in enumerate(part):
                        fits[i, np.isin(pieces, homes[row])] = False
                    q, p = np.nonzero(fits)
                    for c in range(0, len(q), 1 << 16):
                        own, to = part[q[c : c + (1 << 16)]], pieces[p[c : c + (1 << 16)]]
                        n = len(own)
                        yield pa.record_batch([pa.array(np.full(n, 1, np.int32)), pa.array(to), pa.array(np.full(n, size, np.int32)), pa.array(ids[own]), pa.array([vectors[i] for i in own], pa.binary()), pa.array(floor[own])], names=["kind", "piece", "size", "vec_id", "vector", "floor"])

    return run


def _search(k: int, block: int):
    """Pieces with the queries routed to them: a piece's rows come first, then its queries, block by block."""

    def run(batches):
        piece, dual, ids, packed, asked, size = None, None, [], [], [], 0

        def ask(rows):
            nonlocal dual, ids, packed
            if dual is None:
                dual, ids, packed = DualSearch(np.array(ids, np.int64), _unpack(packed, size), k), [], []
            own, vectors, floor = zip(*rows, strict=True)
            q, r, s = dual.run(np.array(own, np.int64), _unpack(list(vectors), size), np.array(floor))
            out = _scores(s)
            return pa.record_batch([pa.array(np.array(own, np.int64)[q], pa.int64()), pa.array(r, pa.int64()), pa.array(out["score"], pa.int64()), pa.array(out["beyond"], pa.string())], names=["query_id", "vec_id", "score", "beyond"])

        for b in batches:
            pieces, kinds = b.column("piece").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (pieces[1:] != pieces[:-1]) | (kinds[1:] != kinds[:-1])])) if len(pieces) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(pieces)], strict=True):
                part = b.slice(lo, hi - lo)
                if pieces[lo] != piece:
                    if asked:
                        yield ask(asked)
                    piece, dual, ids, packed, asked, size = pieces[lo], None, [], [], [], int(part.column("size")[0].as_py())
                if kinds[lo] == 0:
                    ids += part.column("vec_id").to_pylist()
                    packed += part.column("vector").to_pylist()
                else:
                    asked += zip(part.column("vec_id").to_pylist(), part.column("vector").to_pylist(), part.column("floor").to_pylist(), strict=True)
                    while len(asked) >= block:
                        yield ask(asked[:block])
                        asked = asked[block:]
        if asked:
            yield ask(asked)

    return run


def _piece_blocks(found: DataFrame, routed: int):
    """Broadcast summaries of ``routed`` pieces each, by vector length."""
    block: list = []

    def share():
        by: dict[int, list] = {}
        for r in block:
            by.setdefault(r["size"], []).append(r)
        return found.sparkSession.sparkContext.broadcast({s: (np.array([r["piece"] for r in rows], np.int64), np.array([np.frombuffer(r["vector"], "<f8") for r in rows]).reshape(len(rows), s), np.array([r["radius"] for r in rows]), np.array([r["most"] for r in rows])) for s, rows in by.items()})

    for row in found.where("kind = 2").select("piece", "size", "vector", "radius", "most").toLocalIterator():
        block.append(row)
        if len(block) == routed:
            yield share()
            block = []
    if block:
        yield share()


def top_inner_products(vectors: DataFrame, *, k: int = 5, scale: int = 256, every: int = 50, query_block: int = QUERIES, piece_rows: int = PIECE_ROWS, routed: int = ROUTED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: each query row's k best rows."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(PIVOTS).toArrow()
    pivots = {size: _chain(x) for size, _, x in _matrices(as_array(sample["vec_id"]).to_numpy(), as_array(sample["vector"]), scale)} if sample.num_rows else {}
    shared = spark.sparkContext.broadcast(pivots)

    parts, order = blocks_for(rows), ("size", "pivot", "salt", "vec_id", "vector")
    dealt = rows.mapInArrow(_place(shared, scale, k), PLACED).repartitionByRange(parts, *order[:3]).sortWithinPartitions(*order)
    found = materialise(dealt.mapInArrow(_cut(k, every, query_block, piece_rows), CUT), "pieces", by=["kind"])
    queries = found.where("kind = 1").groupBy("size", "vec_id", "vector").agg(F.max("floor").alias("floor"), F.collect_set("piece").alias("homes"))
    sent = found.where("kind = 0").select("kind", "piece", "size", "vec_id", "vector", "floor")
    for block in _piece_blocks(found, routed):
        sent = sent.unionByName(queries.mapInArrow(_route(block), ROUTE))
    scored = sent.repartition(parts, "piece").sortWithinPartitions("piece", "kind").mapInArrow(_search(k, query_block), "query_id bigint, vec_id bigint, score bigint, beyond string")
    scored = scored.unionByName(found.where("kind = 3").select("query_id", "vec_id", "score", "beyond"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
