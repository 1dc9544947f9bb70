"""Reports on the graph, the tags and the answers, with their nulls and controls."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import stats as st
from quillon.operators.facets import row_numbers


def signal_shares(edges: DataFrame, column: str = "signal") -> DataFrame:
    """(value, n, share)."""
    n = edges.groupBy(column).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(edges.agg(F.count("*").alias("t")))).select(column, "n", (F.col("n") / F.col("t")).alias("share"))


def repeated_lines(edges: DataFrame, column: str = "claim") -> DataFrame:
    """(repeated, all, share): edges whose line another edge has too."""
    n = edges.groupBy(column).agg(F.count("*").alias("n"))
    return n.agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated"), F.sum("n").alias("all")).withColumn("share", F.col("repeated") / F.col("all"))


def map_diversity(maps: DataFrame) -> DataFrame:
    """Means over seeds of: same-hand share, dominant type's share, number of types, span of years; from (seed, hand, seed_hand, type, year)."""
    types = maps.groupBy("seed", "type").agg(F.count("*").alias("n")).groupBy("seed").agg((F.max("n") / F.sum("n")).alias("dominant"), F.count("*").alias("types"))
    per = maps.groupBy("seed").agg(F.avg(F.when(F.col("hand") == F.col("seed_hand"), 1.0).otherwise(0.0)).alias("same"), (F.max("year") - F.min("year")).alias("span"))
    return per.join(types, "seed").agg(F.avg("same").alias("same_hand"), F.avg("dominant").alias("dominant"), F.avg("types").alias("types"), F.avg("span").alias("span"))


def greedy_clusters(phrases: list[tuple[str, int]], threshold: float) -> dict[str, str]:
    """Leader clustering by word Jaccard, most frequent phrase first: order decides, so that it runs in one place on a vocabulary."""
    leaders: list[tuple[str, set]] = []
    out = {}
    for phrase, _ in sorted(phrases, key=lambda p: (-p[1], p[0])):
        words = set(phrase.split())
        for name, own in leaders:
            if words | own and len(words & own) / len(words | own) >= threshold:
                out[phrase] = name
                break
        else:
            leaders.append((phrase, words))
            out[phrase] = phrase
    return out


def leader_clusters(phrases: DataFrame, threshold: float) -> DataFrame:
    """(phrase, leader), as :func:`greedy_clusters` finds them, from (phrase, n), without gathering the phrases.

    Phrases that share a word are compared; of a pair, the more frequent one
    comes first.  A phrase leads if none that comes before it and is alike leads;
    each round settles those whose earlier likes are all settled, or one of
    which leads.  Rounds end, as the first unsettled phrase is settled by each.
    """
    words = phrases.withColumn("w", F.array_distinct(F.filter(F.split("phrase", r"\s+"), lambda w: w != "")))
    one = words.select("phrase", "n", F.size("w").alias("k"), F.explode("w").alias("w"))
    two = one.select(F.col("phrase").alias("before"), F.col("n").alias("m"), F.col("k").alias("j"), "w")
    first = (F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("before") < F.col("phrase")))
    common = one.join(two, "w").where(first).groupBy("phrase", "k", "before", "m", "j").agg(F.count("*").alias("c"))
    alike = common.where(F.col("c") >= threshold * (F.col("k") + F.col("j") - F.col("c")) - 1e-12).select("phrase", "before", "m").checkpoint()
    state = phrases.select("phrase", F.lit(None).cast("boolean").alias("leads")).checkpoint()
    while not state.where("leads IS NULL").isEmpty():
        known = alike.join(state.select(F.col("phrase").alias("before"), "leads"), "before")
        seen = known.groupBy("phrase").agg(F.bool_or(F.coalesce("leads", F.lit(False))).alias("led"), F.bool_or(F.col("leads").isNull()).alias("open"))
        settled = F.when(F.col("led").isNull(), True).when(F.col("led"), False).when(~F.col("open"), True)
        state = state.join(seen, "phrase", "left").select("phrase", F.coalesce("leads", settled).alias("leads")).checkpoint()
    heads = alike.join(state.where("leads").select(F.col("phrase").alias("before")), "before")
    chosen = heads.groupBy("phrase").agg(F.min_by("before", F.struct((-F.col("m")).alias("d"), "before")).alias("leader"))
    return state.join(chosen, "phrase", "left").select("phrase", F.when(F.col("leads"), F.col("phrase")).otherwise(F.col("leader")).alias("leader"))


def predicate_pairs(tags: DataFrame) -> DataFrame:
    """(a, b, predicate, ca, cb, oa, ob) of entities that share a predicate."""
    a = tags.select(F.col("entity").alias("a"), "predicate", F.col("centrality").alias("ca"), F.col("outcome").alias("oa"))
    b = tags.select(F.col("entity").alias("b"), "predicate", F.col("centrality").alias("cb"), F.col("outcome").alias("ob"))
    return a.join(b, "predicate").where("a < b")


def family_score(surprise: Column, centrality: Column, complementary: Column) -> Column:
    """(.40 + .34 min(1, s / 6)) (.6 + .4 c), x 1.15 if complementary, at most .95."""
    return F.least(F.lit(0.95), (0.40 + 0.34 * F.least(F.lit(1.0), surprise / 6)) * (0.6 + 0.4 * centrality) * F.when(complementary, 1.15).otherwise(1.0))


def score_predicate_pairs(tags: DataFrame, total: int, complements: list[tuple[str, str]] = ()) -> DataFrame:
    """(a, b, k, lead, strength): shared predicates, the most central one, and the family score with its Poisson surprise."""
    n = tags.groupBy("predicate").agg(F.count_distinct("entity").alias("n"))
    lam = tags.join(n, "predicate").groupBy("entity").agg(F.sum((F.col("n") - 1) / float(max(1, total - 1))).alias("lam"))
    p = predicate_pairs(tags).withColumn("c", F.sqrt(F.col("ca") * F.col("cb")))
    opposed = F.lit(False)
    for x, y in complements:
        opposed = opposed | ((F.col("oa") == x) & (F.col("ob") == y)) | ((F.col("oa") == y) & (F.col("ob") == x))
    g = p.withColumn("comp", opposed).groupBy("a", "b").agg(F.count("*").alias("k"), F.max_by("predicate", F.struct("c", "predicate")).alias("lead"), F.max("c").alias("c"), F.bool_or("comp").alias("comp"))
    g = g.join(lam.select(F.col("entity").alias("a"), F.col("lam").alias("la")), "a").join(lam.select(F.col("entity").alias("b"), F.col("lam").alias("lb")), "b")
    s = st.poisson_surprise(F.col("k"), (F.col("la") + F.col("lb")) / 2)
    return g.select("a", "b", "k", "lead", F.round(family_score(s, F.col("c"), F.col("comp")), 3).alias("strength"))


def leverage_ok(low: float, high: float, most: float = 4.0) -> bool:
    """Is one factor's range within the allowed ratio?"""
    return high / low <= most


def realised_leverage(df: DataFrame, factor: str) -> DataFrame:
    """(p01, p99, ratio) of a factor, by the upper order statistics."""
    runs = df.where(F.col(factor).isNotNull()).groupBy(F.col(factor).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    total = runs.agg(F.sum("c").alias("t"))
    x = runs.withColumn("upto", upto).join(F.broadcast(total))
    at = lambda p, name: F.min(F.when(F.col("upto") >= F.floor((F.col("t") - 1) * p) + 1, F.col("v"))).alias(name)
    return x.agg(at(0.01, "p01"), at(0.99, "p99")).withColumn("ratio", F.try_divide("p99", "p01"))


def prevalence(tags: DataFrame, total: int, low: float = 0.004, high: float = 0.08) -> DataFrame:
    """(predicate, n, share, in_band)."""
    x = tags.groupBy("predicate").agg(F.count_distinct("entity").alias("n")).withColumn("share", F.col("n") / float(max(1, total)))
    return x.withColumn("in_band", (F.col("share") >= low) & (F.col("share") <= high))


def pair_facts(pairs: DataFrame, **tables: DataFrame) -> DataFrame:
    """Pairs with a boolean column for each table of pairs (edge, two_hop, crew, ...) that holds them."""
    for name, t in tables.items():
        t = t.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn(name, F.lit(True))
        pairs = pairs.join(t, ["a", "b"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return pairs


def predicate_reach(tags: DataFrame, facts: DataFrame, reachable: str = "edge") -> DataFrame:
    """(predicate, pairs, unreachable, lift): how many of its pairs nothing else connects, against all pairs' share."""
    p = predicate_pairs(tags).select("a", "b", "predicate").join(facts, ["a", "b"], "left")
    open_ = F.when(F.coalesce(F.col(reachable), F.lit(False)), 0).otherwise(1)
    whole = facts.agg((1 - F.avg(F.col(reachable).cast("int"))).alias("base"))
    return p.groupBy("predicate").agg(F.count("*").alias("pairs"), F.sum(open_).alias("unreachable")).join(F.broadcast(whole)).select("predicate", "pairs", "unreachable", F.try_divide(F.col("unreachable") / F.col("pairs"), "base").alias("lift"))


def pair_stats(tags: DataFrame, side: str) -> DataFrame:
    """(predicate, pairs, across): distinct pairs, and those across a grouping such as shard or region; counted from group sizes, without the pairs."""
    rows = tags.select("predicate", "entity", F.col(side).alias("side")).distinct()
    pairs = lambda of, n: F.sum(F.col(of) * F.col(of)).alias(n)
    entity = rows.groupBy("predicate", "entity").agg(F.count("*").alias("r")).groupBy("predicate").agg(F.sum("r").alias("rows"), pairs("r", "own"))
    within = rows.groupBy("predicate", "side").agg(F.count("*").alias("r")).groupBy("predicate").agg(F.sum(F.expr("r * (r - 1) div 2")).alias("within"))
    counted = entity.join(within, "predicate").withColumn("pairs", F.expr("(rows * rows - own) div 2")).where("pairs > 0")
    return counted.select("predicate", "pairs", (F.col("pairs") - F.col("within")).alias("across"))


def rebuttals(tags: DataFrame, opposed: list[tuple[str, str]]) -> DataFrame:
    """(predicate, a, b) where two entities' outcomes oppose each other."""
    cond = F.lit(False)
    for x, y in opposed:
        cond = cond | ((F.col("oa") == x) & (F.col("ob") == y)) | ((F.col("oa") == y) & (F.col("ob") == x))
    return predicate_pairs(tags).where(cond).select("predicate", "a", "b")


TILE_ROWS = 6_000_000  # rows (entity, phrase) that one tile's task holds
TILE_PAIRS = 4_000_000  # pairs that it makes at a time


def _blob(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(len(x).to_bytes(8, "little") + x.tobytes() for x in arrays), 1)


def _unblob(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zlib.decompress(data), 0, []
    for kind in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, kind, n, at + 8))
        at += 8 + n * np.dtype(kind).itemsize
    return out


def pack_tiles(e: np.ndarray, key: np.ndarray, cluster_of_key: np.ndarray, part: int, blocks: int):
    """Rows for :func:`count_tile`: each block's entities with the keys that they hold go to every tile of that block."""
    names, code = np.unique(e, return_inverse=True)
    held = np.unique(code.astype(np.int64) * len(cluster_of_key) + key)
    code, key = held // max(1, len(cluster_of_key)), held % max(1, len(cluster_of_key))
    mixed = (names.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (names.astype(np.uint64) >> np.uint64(29))
    block = ((mixed >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)
    counts = np.bincount(code, minlength=len(names))
    for i in np.unique(block):
        mine = block == i
        data = _blob(np.diff(names[mine], prepend=0), counts[mine].astype(np.int32), key[mine[code]].astype(np.int32), cluster_of_key.astype(np.int32))
        for j in range(blocks):
            yield min(i, j) * blocks + max(i, j), i, part, data


def _pairs_of(code, key, other_code, other_key, n_other, same: bool) -> int:
    """Distinct (entity, other) that share a key, from rows (entity, key) of both; later others only, if both sides are the same."""
    by = np.argsort(other_key, kind="stable")
    other, ok = other_code[by], other_key[by]
    order = np.argsort(code, kind="stable")
    code, key = code[order], key[order]
    lo, hi = np.searchsorted(ok, key, "left"), np.searchsorted(ok, key, "right")
    met = hi > lo
    code, lo, size = code[met], lo[met], (hi - lo)[met]
    ends, total = np.append(np.flatnonzero(np.diff(code)) + 1, len(code)), 0
    made = np.append(0, np.cumsum(size))
    first = 0
    while first < len(code):
        # as many whole entities as make up to TILE_PAIRS, one at least
        k = np.searchsorted(ends, np.searchsorted(made, made[first] + TILE_PAIRS, "right") - 1, "right") - 1
        last = ends[max(k, np.searchsorted(ends, first, "right"))]
        if made[last] - made[first] > TILE_PAIRS:
            seen = np.zeros(n_other, bool)
            for a, n in zip(lo[first:last], size[first:last], strict=True):
                seen[other[a : a + n]] = True
            total += int(seen[code[first] + 1 :].sum() if same else seen.sum())
        else:
            n = size[first:last]
            at = np.arange(made[last] - made[first]) + np.repeat(lo[first:last] - (made[first:last] - made[first]), n)
            a, b = np.repeat(code[first:last].astype(np.int64), n), other[at]
            pair = a * n_other + b
            pair = np.sort(pair[b > a] if same else pair)
            total += int((np.diff(pair) != 0).sum()) + (len(pair) > 0)
        first = last
    return total


def count_tile(rows: pd.DataFrame, blocks: int) -> pd.DataFrame:
    """(lexical, clustered) of one tile: pairs of an entity of one block and one of another, or of two of the same."""
    tile = int(rows["tile"].iloc[0])
    same, at, clusters_at, sides = tile // blocks == tile % blocks, {}, {}, {}
    keys = clusters = 0
    for i, part, data in zip(rows["block"], rows["part"], rows["data"], strict=True):
        step, counts, key, cluster_of_key = _unblob(data, "<i8", "<i4", "<i4", "<i4")
        if part not in at:
            at[part], clusters_at[part] = keys, clusters
            keys, clusters = keys + len(cluster_of_key), clusters + int(cluster_of_key.max(initial=-1)) + 1
        c = cluster_of_key[key]
        sides.setdefault(i, []).append((np.cumsum(step), counts, key + np.int32(at[part]), np.where(c < 0, -1, c + clusters_at[part]).astype(np.int32)))
    held = []
    for i in sorted(sides):
        names = np.unique(np.concatenate([x[0] for x in sides[i]]))
        code = np.concatenate([np.repeat(np.searchsorted(names, x[0]).astype(np.int32), x[1]) for x in sides[i]])
        held.append((len(names), code, np.concatenate([x[2] for x in sides[i]]), np.concatenate([x[3] for x in sides.pop(i)])))
    if not same and len(held) < 2:
        return pd.DataFrame({"lexical": [0], "clustered": [0]})
    (_, a, ka, ca), (n, b, kb, cb) = held[0], held[-1]
    lexical = _pairs_of(a, ka, b, kb, n, same)
    clustered = _pairs_of(a[ca >= 0], ca[ca >= 0], b[cb >= 0], cb[cb >= 0], n, same)
    return pd.DataFrame({"lexical": [lexical], "clustered": [clustered]})


def joinability(phrases: DataFrame, clusters: DataFrame, rows: int | None = None) -> DataFrame:
    """(lexical, clustered): distinct entity pairs that share a phrase, and that share a phrase's cluster.

    No pair is moved.  Entities are dealt into blocks, and each two blocks are a tile, whose task counts its
    own pairs from the rows of its blocks; a pair is in one tile only.  What moves is each row (packed to a few
    bytes) once for each block; ``rows``, a bound of the rows of ``phrases``, sets how many blocks there are.
    """
    from quillon.operators import audit

    rows = phrases.count() if rows is None else rows
    blocks, parts = max(1, -(-2 * rows // TILE_ROWS)), int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = phrases.select("entity", "phrase").where("entity IS NOT NULL AND phrase IS NOT NULL")
    if not isinstance(x.schema["entity"].dataType, T.IntegralType):
        x = x.join(row_numbers(x.select("entity").distinct(), "entity"), "entity").select(F.col("row").alias("entity"), "phrase")
    x = x.join(clusters.select("phrase", "cluster").where("cluster IS NOT NULL").distinct(), "phrase", "left").select(F.col("entity").cast("bigint").alias("entity"), "phrase", "cluster")
    together = F.when(F.col("cluster").isNull(), F.xxhash64("phrase")).otherwise(F.xxhash64("cluster"))

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        batches = list(batches)
        if sum(b.num_rows for b in batches):
            t = pa.Table.from_batches(batches)
            code = lambda c: t[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            both, key = np.unique(code("phrase") * (t.num_rows + 1) + code("cluster") + 1, return_inverse=True)
            for row in audit.pack_tiles(t["entity"].to_numpy(), key, both % (t.num_rows + 1) - 1, TaskContext.get().partitionId(), blocks):
                yield pa.RecordBatch.from_arrays([pa.array([int(v)], pa.int64()) for v in row[:3]] + [pa.array([row[3]], pa.binary())], ["tile", "block", "part", "data"])

    packed = x.repartition(parts, together).mapInArrow(pack, "tile bigint, block bigint, part bigint, data binary")
    n = packed.groupBy("tile").applyInPandas(lambda df: audit.count_tile(df, blocks), "lexical bigint, clustered bigint")
    return n.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in n.columns))


def set_agreement(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(n, mean_jaccard, exact) between two taggings of the same keys."""
    g = lambda df, name: df.groupBy(key).agg(F.collect_set(value).alias(name))
    x = g(a, "x").join(g(b, "y"), key)
    j = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    return x.agg(F.count("*").alias("n"), F.avg(j).alias("mean_jaccard"), F.avg(F.when(j == 1, 1.0).otherwise(0.0)).alias("exact"))


def stability(a: DataFrame, b: DataFrame, key: str, label: str, none: str = "NONE") -> DataFrame:
    """(n, exact, named, flips): agreement, agreement where both name something, and share that flips to or from nothing."""
    x = a.select(key, F.col(label).alias("x")).join(b.select(key, F.col(label).alias("y")), key)
    both = (F.col("x") != none) & (F.col("y") != none)
    return x.agg(F.count("*").alias("n"), F.avg((F.col("x") == F.col("y")).cast("int")).alias("exact"), F.avg(F.when(both, (F.col("x") == F.col("y")).cast("int"))).alias("named"), F.avg(((F.col("x") == none) != (F.col("y") == none)).cast("int")).alias("flips"))


def wishlist(nominations: DataFrame, held: DataFrame) -> DataFrame:
    """(title, score): nominators times reasons, at least one, for titles that aren't held."""
    x = nominations.join(held.select("title").distinct(), "title", "left_anti")
    return x.groupBy("title").agg((F.count_distinct("nominator") * F.greatest(F.lit(1), F.count_distinct("reason"))).alias("score"))


def predicate_coverage(tags: DataFrame, least: int = 6, regions: int = 3, span: int = 30) -> DataFrame:
    """Predicates with enough entities, regions and years: (predicate, n, regions, span)."""
    x = tags.groupBy("predicate").agg(F.count_distinct("entity").alias("n"), F.count_distinct("region").alias("regions"), (F.max("year") - F.min("year")).alias("span"))
    return x.where((F.col("n") >= least) & (F.col("regions") >= regions) & (F.col("span") >= span))


def pole_prevalence(scores: DataFrame, low: int = 30, high: int = 70) -> DataFrame:
    """(axis, low, high, ok): shares at either pole, both within 5 to 35 %."""
    x = scores.groupBy("axis").agg(F.avg((F.col("score") <= low).cast("int")).alias("low"), F.avg((F.col("score") >= high).cast("int")).alias("high"))
    return x.withColumn("ok", F.col("low").between(0.05, 0.35) & F.col("high").between(0.05, 0.35))


def null_honesty(scores: DataFrame) -> DataFrame:
    """(axis, n): scored without a basis, or a basis with no score."""
    return scores.groupBy("axis").agg(F.count_if(F.col("score").isNotNull() & (F.length(F.coalesce("basis", F.lit(""))) == 0)).alias("n"))


def directional_share(edges: DataFrame) -> DataFrame:
    """(type, share): of directed edges that go forward in time; null without any."""
    return edges.groupBy("type").agg(F.try_divide(F.count_if(F.col("directed") & (F.col("to_year") > F.col("from_year"))), F.count_if("directed")).alias("share"))


def neighbourhood_residual(edges_both: DataFrame, values: DataFrame, least: int = 3, near_values: DataFrame | None = None) -> DataFrame:
    """(entity, residual): own value less the mean of at least three neighbours; ``near_values``: those of the ``v`` side, where it is of another kind with keys of its own."""
    of = values if near_values is None else near_values
    near = edges_both.join(of.select(F.col("entity").alias("v"), F.col("value").alias("x")), "v").groupBy("u").agg(F.avg("x").alias("m"), F.count("x").alias("n")).where(F.col("n") >= least)
    return values.join(near, F.col("entity") == F.col("u")).select("entity", (F.col("value") - F.col("m")).alias("residual"))


def discounted_score(claims: DataFrame, key: str, quality: str) -> DataFrame:
    """(key, score): sum of the i-th best quality over 2**i."""
    i = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(quality))) - 1
    return claims.withColumn("_i", i).groupBy(key).agg(F.sum(F.col(quality) / F.pow(F.lit(2.0), F.col("_i"))).alias("score"))


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("component").agg(F.count("*").alias("n"))


def hub_share(degrees: DataFrame, top: int = 10) -> DataFrame:
    """Share of all degrees that the ``top`` entities hold."""
    best = degrees.orderBy(F.desc("degree"), "entity").limit(top).agg(F.sum("degree").alias("a"))
    return best.join(degrees.agg(F.sum("degree").alias("b"))).select((F.col("a") / F.col("b")).alias("share"))


def derangement(df: DataFrame, order: str) -> DataFrame:
    """Rows paired with another row: i with (i + 1 + i mod 7) mod n.  (i, other): a null without own pairs."""
    x = row_numbers(df, order).withColumnRenamed("row", "i")
    n = x.agg(F.count("*").alias("n"))
    return x.join(F.broadcast(n)).withColumn("j", (F.col("i") + 1 + F.col("i") % 7) % F.col("n"))


def find_coverage(queries: DataFrame, shown: DataFrame) -> DataFrame:
    """(answered, hit, good, worthless) counts: from queries (query, wanted array) and shown (query, entity)."""
    got = shown.groupBy("query").agg(F.collect_set("entity").alias("got"))
    x = queries.join(got, "query", "left").withColumn("got", F.coalesce("got", F.array().cast("array<bigint>")))
    found = F.size(F.array_intersect("wanted", "got"))
    return x.agg(F.count_if(F.size("got") > 0).alias("answered"), F.count_if(found > 0).alias("hit"), F.count_if(found >= F.ceil(F.size("wanted") / 2)).alias("good"), F.count_if((F.size("got") > 0) & (found == 0)).alias("worthless"))


def seat_allocation(strata: DataFrame, seats: int) -> DataFrame:
    """(stratum, seats): largest remainders, ties by name."""
    x = strata.groupBy("stratum").agg(F.count("*").alias("n"))
    x = x.join(F.broadcast(x.agg(F.sum("n").alias("t")))).withColumn("exact", F.col("n") * seats / F.col("t"))
    x = x.withColumn("base", F.floor("exact")).withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 12)), "stratum")))
    return x.join(F.broadcast(x.agg((F.lit(seats) - F.sum("base")).alias("left")))).select("stratum", (F.col("base") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).alias("seats"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, size: int, floor: int = 2, salt: str = "s") -> DataFrame:
    """About ``size`` rows: ``floor`` of each stratum, then by largest remainder, chosen by salted hash."""
    seats = seat_allocation(rows.select(F.col(stratum).alias("stratum")), size).withColumn("seats", F.greatest(F.col("seats"), F.lit(floor)))
    order = F.row_number().over(Window.partitionBy(stratum).orderBy(F.sha1(F.concat_ws("|", F.lit(salt), F.col(key).cast("string")).cast("binary"))))
    return rows.withColumn("_i", order).join(F.broadcast(seats.withColumnRenamed("stratum", stratum)), stratum).where("_i <= seats").drop("_i", "seats")


def cohort_candidates(rows: DataFrame, size: int, key: str, margins: list[str]) -> DataFrame:
    """The first ``size`` rows, by key as text, of each combination of margins: a cohort of that size takes no others, as rows of one combination differ by key alone."""
    place = F.row_number().over(Window.partitionBy(*margins).orderBy(F.col(key).cast("string")))
    return rows.withColumn("_i", place).where(F.col("_i") <= size).drop("_i")


def deficit_cohort(rows: list[dict], margins: dict[str, dict[str, int]], size: int, cap: tuple[str, int]) -> list:
    """Greedy cohort: each step takes the row that fills most of the open margins, under a cap a hand; ties by key."""
    have = {m: Counter() for m in margins}
    hands, out, left = Counter(), [], sorted(rows, key=lambda r: str(r["key"]))
    while left and len(out) < size:
        worth = lambda r: sum(max(0, margins[m].get(r[m], 0) - have[m][r[m]]) / max(1, margins[m].get(r[m], 1)) for m in margins)
        open_ = [r for r in left if hands[r[cap[0]]] < cap[1]] or left
        best = max(open_, key=worth)
        left.remove(best)
        out.append(best["key"])
        hands[best[cap[0]]] += 1
        for m in margins:
            have[m][best[m]] += 1
    return out


def surface_partition(rows: DataFrame, order: list[Column], top: int, writers: int) -> DataFrame:
    """The first ``top`` rows dealt to writers in turn."""
    x = rows.withColumn("i", F.row_number().over(Window.orderBy(*order)) - 1).where(F.col("i") < top)
    return x.withColumn("writer", (F.col("i") % writers).cast("int"))


def decoys(items: DataFrame, every: int = 3, salt: str = "decoy") -> DataFrame:
    """(item, shown, real): items in a salted order, in which every third shows another's label, if that differs; from (item, label)."""
    x = derangement(items.withColumn("o", F.struct(F.sha1(F.concat_ws("|", F.lit(salt), "item").cast("binary")).alias("h"), "item")), "o")
    other = x.select(F.col("i").alias("j"), F.col("label").alias("other"))
    fake = (F.col("i") % every == every - 1) & (F.col("other") != F.col("label"))
    return x.join(other, "j").select("item", F.when(fake, F.col("other")).otherwise(F.col("label")).alias("shown"), (~fake).alias("real"))


def decoy_verdict(real_rate: float, decoy_rate: float) -> str:
    """void above 40 % accepted decoys, weak above 20 %."""
    return "void" if decoy_rate > 0.40 else "weak" if decoy_rate > 0.20 else "sound" if real_rate > decoy_rate else "void"


def fold_labels(labels: DataFrame, folds: DataFrame) -> DataFrame:
    """(label, absorbed): labels after a fold map, with what each absorbed."""
    x = labels.join(folds, "label", "left").withColumn("into", F.coalesce("into", "label"))
    return x.groupBy(F.col("into").alias("label")).agg(F.array_sort(F.collect_set("label")).alias("absorbed"))


def assign_known(rows: DataFrame, vocabulary: DataFrame, column: str, none: str = "NONE") -> DataFrame:
    """Rows whose label isn't in the vocabulary get ``none``."""
    v = vocabulary.select(F.col("label").alias("_l")).distinct()
    return rows.join(F.broadcast(v), F.col(column) == F.col("_l"), "left").withColumn(column, F.coalesce("_l", F.lit(none))).drop("_l")


def candidate_expansion(ties: DataFrame, held: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(candidate, score): entities outside that share people with held ones, by distinct held entities and role weight; duplicates by title and year folded to the best."""
    w = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    inside = ties.join(held.select("entity"), "entity", "left_semi").select(F.col("entity").alias("own"), "person", "role")
    outside = ties.join(held.select("entity"), "entity", "left_anti")
    x = outside.join(inside.drop("role"), "person").groupBy("entity", "person", "role").agg(F.count_distinct("own").alias("n"))
    return x.groupBy(F.col("entity").alias("candidate")).agg(F.sum(F.col("n") * F.coalesce(w[F.col("role")], F.lit(0.0))).alias("score"))


