"""Dense retrieval, rank fusion and the measures that audit them.

Queries are a stated set: they are counted, and broadcast in blocks of about
``MAX_QUERIES`` rows, so that what is broadcast doesn't grow with the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import stats as st
from quillon.operators.facets import row_numbers

MAX_QUERIES = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def query_blocks(queries: DataFrame, most: int = MAX_QUERIES) -> list[DataFrame]:
    """The query set in blocks of about ``most`` rows, each marked for broadcast."""
    n = -(-queries.count() // most)
    if n <= 1:
        return [F.broadcast(queries)]
    return [F.broadcast(queries.where(F.pmod(F.xxhash64("query"), F.lit(n)) == i)) for i in range(n)]


def centroids(chunks: DataFrame, key: str, vector: str, eps: float = 1e-12) -> DataFrame:
    """(key, centroid): mean of the chunk vectors, scaled to length 1.  Sums meet per key and dimension, not whole vectors."""
    flat = chunks.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = flat.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return c.select(key, F.transform("c", lambda x: x / F.greatest(norm(F.col("c")), F.lit(eps))).alias("centroid"))


def cosine_scores(queries: DataFrame, chunks: DataFrame, vector: str = "vector") -> DataFrame:
    """(query, <chunk columns>, sim) of every query against every chunk: queries in broadcast blocks."""
    sim = dot(F.col(vector), F.col("_q")) / F.greatest(norm(F.col(vector)) * F.col("_nq"), F.lit(1e-12))
    blocks = query_blocks(queries.select("query", F.col(vector).alias("_q"), norm(F.col(vector)).alias("_nq")))
    return reduce(DataFrame.unionByName, [chunks.join(q).withColumn("sim", sim).drop("_q", "_nq", vector) for q in blocks])


def rollup(scores: DataFrame, key: str, how: str = "max") -> DataFrame:
    """(query, key, score, best_chunk): an entity scores as its best chunk, or as the mean of its chunks."""
    agg = F.max("sim") if how == "max" else F.avg("sim")
    return scores.groupBy("query", key).agg(agg.alias("score"), F.max_by("chunk", F.struct("sim", -F.col("chunk"))).alias("best_chunk"))


def composed(scores: DataFrame, key: str) -> DataFrame:
    """(pair, key, score): likeness to all works of a choice at once, the geometric mean of what is above 0; unlike one is unlike all."""
    return scores.groupBy("pair", key).agg(F.pow(F.product(F.greatest("sim", F.lit(0.0))), 1.0 / F.count("*")).alias("score"))


def length_batches(texts: DataFrame, key: str, column: str, size: int) -> DataFrame:
    """(key, n, batch, padded): texts in batches of like length, and the length that each is padded to in its batch."""
    rows = texts.select(F.struct(F.coalesce(F.length(column), F.lit(0)).alias("n"), F.col(key)).alias("o"))
    dealt = row_numbers(rows, "o").select(f"o.{key}", "o.n", F.floor(F.col("row") / size).alias("batch"))
    return dealt.join(dealt.groupBy("batch").agg(F.max("n").alias("padded")), "batch").select(key, "n", "batch", "padded")


def rank_of(scores: DataFrame, key: str, digits: int = 9) -> DataFrame:
    """Scores with their rank within the query, ties by key."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", digits)), key)))


def top_k(scores: DataFrame, key: str, k: int) -> DataFrame:
    return rank_of(scores, key).where(F.col("rank") <= k)


def band(scores: DataFrame, k: int) -> DataFrame:
    """Everything at least as good as a query's k-th score, ties kept."""
    return scores.withColumn("_r", F.rank().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("_r") <= k).drop("_r")


def reciprocal_rank_fusion(a: DataFrame, b: DataFrame, key: str, k: int = 60) -> DataFrame:
    """(query, key, score): 1 / (k + rank) summed over both rankings (each with ``rank``)."""
    x, y = a.select("query", key, F.col("rank").alias("_a")), b.select("query", key, F.col("rank").alias("_b"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return x.join(y, ["query", key], "full").select("query", key, (part("_a") + part("_b")).alias("score"))


def mean_blend(a: DataFrame, b: DataFrame, key: str, share: Column | float = 0.5) -> DataFrame:
    """(query, key, score): share of a's percentile and the rest of b's (each with ``pct``); an absent side counts 0."""
    x, y = a.select("query", key, F.col("pct").alias("_a")), b.select("query", key, F.col("pct").alias("_b"))
    s = F.lit(share) if isinstance(share, float) else share
    return x.join(y, ["query", key], "full").select("query", key, (s * F.coalesce("_a", F.lit(0.0)) + (1 - s) * F.coalesce("_b", F.lit(0.0))).alias("score"))


def confirm(a: DataFrame, b: DataFrame, key: str, n: int) -> DataFrame:
    """b's ranking, those among a's first n first (in b's order), then the rest."""
    ok = a.where(F.col("rank") <= n).select("query", key, F.lit(0).alias("_first"))
    x = b.join(ok, ["query", key], "left")
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.coalesce("_first", F.lit(1)), "rank"))).drop("_first")


def veto(ranking: DataFrame, refused: DataFrame, key: str) -> DataFrame:
    """The ranking with refused entities last."""
    x = ranking.join(refused.select("query", key, F.lit(1).alias("_no")), ["query", key], "left")
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.coalesce("_no", F.lit(0)), "rank"))).drop("_no")


def band_order(a_scores: DataFrame, b: DataFrame, key: str, k: int) -> DataFrame:
    """a's band of k, ordered by b, ahead of the rest in a's order."""
    inside = band(a_scores, k).select("query", key, F.lit(0).alias("_in"))
    x = rank_of(a_scores, key).join(inside, ["query", key], "left").join(b.select("query", key, F.col("rank").alias("_b")), ["query", key], "left")
    order = (F.coalesce("_in", F.lit(1)), F.when(F.col("_in").isNotNull(), F.coalesce("_b", F.lit(1 << 30))).otherwise(F.col("rank")), F.col("rank"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).drop("_in", "_b")


def read_fraction(unread: DataFrame) -> DataFrame:
    """(query, share): part of the query's words that the parser read, from (query, words, unread)."""
    return unread.select("query", (1 - F.col("unread") / F.greatest(F.col("words"), F.lit(1))).alias("share"))


def blend_by_reading(a: DataFrame, b: DataFrame, key: str, fraction: DataFrame, strict: bool = False) -> DataFrame:
    """Mean blend with a's share the part of the query that was read; strict: a alone where all was read, b alone elsewhere."""
    s = F.coalesce("share", F.lit(0.0))
    s = F.when(s >= 1, 1.0).otherwise(0.0) if strict else s
    x = mean_blend(a, b, key, 1.0).withColumnRenamed("score", "_sa").join(mean_blend(a, b, key, 0.0).withColumnRenamed("score", "_sb"), ["query", key])
    return x.join(F.broadcast(fraction), "query", "left").select("query", key, (s * F.col("_sa") + (1 - s) * F.col("_sb")).alias("score"))


def restrict(ranking: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    """The ranking within a universe, applied after ranking."""
    x = ranking.join(universe.select(key), key, "left_semi")
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank")))


def precision_at(ranking: DataFrame, facts: DataFrame, key: str, k: int = 10) -> DataFrame:
    """(query, precision): share of the first k that hold the fact."""
    x = ranking.where(F.col("rank") <= k).join(facts.select("query", key, F.lit(1).alias("_hit")), ["query", key], "left")
    return x.groupBy("query").agg((F.count("_hit") / float(k)).alias("precision"))


def violations(ranking: DataFrame, known_absent: DataFrame, key: str, k: int = 10) -> DataFrame:
    """(query, n): entities of the first k that have what the query excludes."""
    return ranking.where(F.col("rank") <= k).join(known_absent, ["query", key], "left_semi").groupBy("query").agg(F.count("*").alias("n"))


def reach(rankings: DataFrame, key: str, k: int = 10) -> DataFrame:
    """How many different entities the first k of all queries show, and the largest share of one."""
    x = rankings.where(F.col("rank") <= k).groupBy(key).agg(F.count("*").alias("n"))
    return x.agg(F.count("*").alias("distinct"), (F.max("n") / F.sum("n")).alias("largest"))


def displacement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(query, mean, median, largest, kept): how far ranks move between two runs, and how many of the first ten stay."""
    x = a.select("query", key, F.col("rank").alias("_a")).join(b.select("query", key, F.col("rank").alias("_b")), ["query", key])
    d = F.abs(F.col("_a") - F.col("_b"))
    return x.groupBy("query").agg(F.avg(d).alias("mean"), F.median(d).alias("median"), F.max(d).alias("largest"), F.count_if((F.col("_a") <= 10) & (F.col("_b") <= 10)).alias("kept"))


def neighbours(chunks: DataFrame, key: str, vector: str, of: DataFrame, k: int) -> DataFrame:
    """The k nearest entities of the stated ones, without themselves."""
    q = of.select(F.col(key).alias("query"), F.col(vector).alias("vector"))
    s = cosine_scores(q, chunks.select(F.col(key), F.col(vector).alias("vector"))).where(F.col("query") != F.col(key)).withColumnRenamed("sim", "score")
    return top_k(s, key, k)


def weighted_rating(votes: Column, rating: Column, mean: Column, m: float = 25_000.0) -> Column:
    """v / (v + m) R + m / (v + m) C, to two decimals."""
    return F.round(votes / (votes + m) * rating + m / (votes + m) * mean, 2)


def fame_lift(top: DataFrame, everyone: DataFrame, fame: str) -> DataFrame:
    """Upper median of fame among the first over that of all."""
    return top.agg(st.upper_median(fame).alias("a")).join(everyone.agg(st.upper_median(fame).alias("b"))).select(F.try_divide("a", "b").alias("lift"))
