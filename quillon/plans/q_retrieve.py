"""Retrieval queries over the embeddings, with labels as works and vectors as chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import retrieve as r
from quillon.plans.registry import query, table

ASKED = "vec_id % 100 = 0"  # the stated query set
SIM = "list_sum(list_transform(range(1, len(c.embedding) + 1), lambda i: c.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE)) / greatest(1e-12, sqrt(list_sum(list_transform(c.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))))"
SIM_SQL = f"sim AS (SELECT q.vec_id AS query, c.vec_id AS chunk, c.label, {SIM} AS sim FROM embeddings c CROSS JOIN embeddings q WHERE q.vec_id % 100 = 0)"


def _sims(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where(ASKED).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return r.cosine_scores(q, e.select(F.col("vec_id").alias("chunk"), "label", F.col("embedding").alias("vector")))


@query("cosine_search", "J18 Q15 K04", f"WITH {SIM_SQL}, k AS (SELECT query, chunk, sim, row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, chunk) AS rank FROM sim) SELECT query, chunk, round(sim, 6) AS score, rank FROM k WHERE rank <= 10")
def cosine_search(spark, sf):
    return r.top_k(_sims(spark, sf).withColumnRenamed("sim", "score"), "chunk", 10).select("query", "chunk", F.round("score", 6).alias("score"), "rank")


@query("chunk_rollup", "A15 Q16", f"WITH {SIM_SQL} SELECT query, label, round(max(sim), 6) AS best, round(avg(sim), 6) AS mean FROM sim GROUP BY query, label")
def chunk_rollup(spark, sf):
    s = _sims(spark, sf).cache()
    a = r.rollup(s, "label").select("query", "label", F.round("score", 6).alias("best"))
    return a.join(r.rollup(s, "label", "mean").select("query", "label", F.round("score", 6).alias("mean")), ["query", "label"])


@query("best_chunk", "Q16 A15", f"WITH {SIM_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY sim DESC, chunk) AS rn FROM sim) SELECT query, label, chunk AS best_chunk FROM k WHERE rn = 1")
def best_chunk(spark, sf):
    return r.rollup(_sims(spark, sf), "label").select("query", "label", "best_chunk")


@query("centroids", "A16 Z21", "WITH f AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings CROSS JOIN range(1, 65) t(i) GROUP BY label, i), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM f GROUP BY label) SELECT label, round(max(CASE WHEN i = 1 THEN m / n END), 6) AS first, round(max(CASE WHEN i = 64 THEN m / n END), 6) AS last FROM f JOIN n USING (label) GROUP BY label")
def centroids(spark, sf):
    c = r.centroids(table(spark, sf, "embeddings"), "label", "embedding")
    return c.select("label", F.round(F.element_at("centroid", 1), 6).alias("first"), F.round(F.element_at("centroid", -1), 6).alias("last"))


@query("euclid_neighbours", "M07", "SELECT a.vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2))), 6) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def euclid_neighbours(spark, sf):
    a = table(spark, sf, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(r.euclid(F.col("embedding"), F.col("other")), 6).alias("d"))


@query("attribute_matrix", "J19", "WITH c AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings CROSS JOIN range(1, 65) t(i) GROUP BY label, i) GROUP BY label) SELECT a.label AS query, b.label AS label, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM c a CROSS JOIN c b")
def attribute_matrix(spark, sf):
    c = r.centroids(table(spark, sf, "embeddings"), "label", "embedding").cache()
    return r.cosine_scores(c.select(F.col("label").alias("query"), F.col("centroid").alias("vector")), c.select("label", F.col("centroid").alias("vector"))).select("query", "label", F.round("sim", 6).alias("sim"))


RANKS_SQL = f"{SIM_SQL}, a AS (SELECT query, chunk, row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, chunk) AS rank, round(sim, 9) AS score FROM sim), b AS (SELECT query, chunk, row_number() OVER (PARTITION BY query ORDER BY abs(label - query % 10), chunk) AS rank FROM sim)"


def _two(spark, sf):
    s = _sims(spark, sf).withColumn("score", F.round("sim", 9)).cache()
    a = r.rank_of(s.select("query", "chunk", "score"), "chunk")
    b = r.rank_of(s.select("query", "chunk", (-F.abs(F.col("label") - F.col("query") % 10)).cast("double").alias("score")), "chunk")
    return s, a, b


@query("rank_fusion", "Q17", f"WITH {RANKS_SQL} SELECT query, chunk, round(1.0 / (60 + a.rank) + 1.0 / (60 + b.rank), 9) AS score FROM a JOIN b USING (query, chunk)")
def rank_fusion(spark, sf):
    _, a, b = _two(spark, sf)
    return r.reciprocal_rank_fusion(a, b, "chunk").select("query", "chunk", F.round("score", 9).alias("score"))


@query("confirm_25", "Q17", f"WITH {RANKS_SQL} SELECT query, chunk, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN a.rank <= 25 THEN 0 ELSE 1 END, b.rank) AS rank FROM a JOIN b USING (query, chunk)")
def confirm_25(spark, sf):
    _, a, b = _two(spark, sf)
    return r.confirm(a, b, "chunk", 25).select("query", "chunk", "rank")


@query("veto", "Q17", f"WITH {RANKS_SQL} SELECT query, chunk, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN chunk % 5 = 0 THEN 1 ELSE 0 END, rank) AS rank FROM a")
def veto(spark, sf):
    _, a, _ = _two(spark, sf)
    return r.veto(a, a.where("chunk % 5 = 0"), "chunk").select("query", "chunk", "rank")


@query("band_order", "Q17 K03", f"WITH {RANKS_SQL}, w AS (SELECT query, chunk, b.rank, rank() OVER (PARTITION BY query ORDER BY score DESC) AS place, a.rank AS ar FROM a JOIN b USING (query, chunk)) SELECT query, chunk, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN place <= 60 THEN 0 ELSE 1 END, CASE WHEN place <= 60 THEN rank ELSE ar END, ar) AS rank FROM w")
def band_order(spark, sf):
    s, _, b = _two(spark, sf)
    return r.band_order(s.select("query", "chunk", "score"), b, "chunk", 60).select("query", "chunk", "rank")


PCT_SQL = f"{RANKS_SQL}, n AS (SELECT count(*) AS n FROM embeddings), p AS (SELECT query, chunk, 1 - (a.rank - 1.0) / (n - 1) AS pa, 1 - (b.rank - 1.0) / (n - 1) AS pb FROM a JOIN b USING (query, chunk) CROSS JOIN n)"


def _pct(x, n):
    return x.withColumn("pct", 1 - (F.col("rank") - 1) / float(n - 1))


@query("mean_blend", "Q17 W03", f"WITH {PCT_SQL} SELECT query, chunk, round(0.5 * pa + 0.5 * pb, 9) AS score FROM p")
def mean_blend(spark, sf):
    _, a, b = _two(spark, sf)
    n = table(spark, sf, "embeddings").count()
    return r.mean_blend(_pct(a, n), _pct(b, n), "chunk").select("query", "chunk", F.round("score", 9).alias("score"))


@query("blend_by_reading", "Q17", f"WITH {PCT_SQL} SELECT query, chunk, round(s * pa + (1 - s) * pb, 9) AS score FROM p JOIN (SELECT DISTINCT vec_id AS query, 1 - (vec_id // 100 % 4) / 4.0 AS s FROM embeddings) v USING (query)")
def blend_by_reading(spark, sf):
    _, a, b = _two(spark, sf)
    n = table(spark, sf, "embeddings").count()
    unread = table(spark, sf, "embeddings").where(ASKED).select(F.col("vec_id").alias("query"), F.lit(4).alias("words"), F.expr("vec_id div 100 % 4").cast("int").alias("unread"))
    return r.blend_by_reading(_pct(a, n), _pct(b, n), "chunk", r.read_fraction(unread)).select("query", "chunk", F.round("score", 9).alias("score"))


@query("restricted_universe", "Q19 Q15", f"WITH {RANKS_SQL} SELECT query, chunk, row_number() OVER (PARTITION BY query ORDER BY rank) AS rank FROM a WHERE chunk % 3 = 0")
def restricted_universe(spark, sf):
    _, a, _ = _two(spark, sf)
    return r.restrict(a, table(spark, sf, "embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").alias("chunk")), "chunk").select("query", "chunk", "rank")


@query("hybrid_measures", "Q18 A48", f"WITH {RANKS_SQL}, t AS (SELECT * FROM a WHERE rank <= 10) SELECT query, round(count(CASE WHEN label = query % 10 THEN 1 END) / 10.0, 6) AS precision, count(CASE WHEN label = 0 THEN 1 END) AS violations FROM t JOIN (SELECT vec_id AS chunk, label FROM embeddings) USING (chunk) GROUP BY query")
def hybrid_measures(spark, sf):
    s, a, _ = _two(spark, sf)
    facts = s.where("label = query % 10").select("query", "chunk")
    p = r.precision_at(a, facts, "chunk").select("query", F.round("precision", 6).alias("precision"))
    return p.join(r.violations(a, s.where("label = 0").select("query", "chunk"), "chunk"), "query", "left").select("query", "precision", F.coalesce("n", F.lit(0)).alias("violations"))


@query("reach", "Q18 A48", f"WITH {RANKS_SQL}, t AS (SELECT chunk, count(*) AS n FROM a WHERE rank <= 10 GROUP BY chunk) SELECT count(*) AS distinct_shown, round(max(n) * 1.0 / sum(n), 6) AS largest FROM t")
def reach(spark, sf):
    _, a, _ = _two(spark, sf)
    return r.reach(a, "chunk").select(F.col("distinct").alias("distinct_shown"), F.round("largest", 6).alias("largest"))


@query("rank_displacement", "Z22 Z23", f"WITH {RANKS_SQL} SELECT query, round(avg(abs(a.rank - b.rank)), 6) AS mean, median(abs(a.rank - b.rank)) AS median, max(abs(a.rank - b.rank)) AS largest, count(CASE WHEN a.rank <= 10 AND b.rank <= 10 THEN 1 END) AS kept FROM a JOIN b USING (query, chunk) GROUP BY query")
def rank_displacement(spark, sf):
    _, a, b = _two(spark, sf)
    return r.displacement(a, b, "chunk").select("query", F.round("mean", 6).alias("mean"), "median", "largest", "kept")


@query("neighbours", "Q15 J15", f"WITH {SIM_SQL}, k AS (SELECT query, chunk, row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, chunk) AS rank FROM sim WHERE query <> chunk) SELECT query, chunk AS vec_id, rank FROM k WHERE rank <= 5")
def neighbours(spark, sf):
    e = table(spark, sf, "embeddings")
    return r.neighbours(e, "vec_id", "embedding", e.where(ASKED), 5).select("query", "vec_id", "rank")


@query("weighted_rating", "A17 S07", "WITH v AS (SELECT l_partkey AS p, count(*) AS v, avg(l_quantity) AS r FROM lineitem GROUP BY l_partkey), c AS (SELECT avg(r) AS c FROM v) SELECT p, round(v / (v + 30.0) * r + 30.0 / (v + 30.0) * c, 2) AS score FROM v CROSS JOIN c")
def weighted_rating(spark, sf):
    v = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p")).agg(F.count("*").alias("v"), F.avg("l_quantity").alias("r"))
    return v.join(F.broadcast(v.agg(F.avg("r").alias("c")))).select("p", r.weighted_rating(F.col("v"), F.col("r"), F.col("c"), 30.0).alias("score"))


@query("fame_lift", "A47 Q18", "WITH v AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), t AS (SELECT n FROM v ORDER BY n DESC, o_custkey LIMIT 50) SELECT round((SELECT list_sort(list(n))[CAST(floor(count(*) / 2) AS INT) + 1] FROM t) * 1.0 / (SELECT list_sort(list(n))[CAST(floor(count(*) / 2) AS INT) + 1] FROM v), 6) AS lift")
def fame_lift(spark, sf):
    v = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return r.fame_lift(v.orderBy(F.desc("n"), "o_custkey").limit(50), v, "n").select(F.round("lift", 6).alias("lift"))
